"""The text operators against brute force, on rows with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trailmill.llm import crf, flac, hmm, jaccard, mixing, pieces, pii, quality, tokenfile, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, `key` string, score double"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "delta,", "é", "字字", "ing", "the", "of", "x1", "+1", "idiot"]
    base = [" ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(60)) for _ in range(6)]
    near = base[0].split(" ")
    near[30] = "changed"
    return [
        *base, base[0], base[0], " ".join(near), None, "", " ", "one two", "one two", "a  b\n c ", "\n\n", "w" * 3000, " ".join(["long"] * 9000),
        "mail a.b@c.org, a@b@c.com x@y; ip 10.0.0.1 999.1.1.1 card 4111 1111 1111 1111 tel +1 (499) 555-6503", "https://ex.org/a GB82 WEST 1234 5698 7654 32 account no. 12345678",
    ]


@pytest.fixture(scope="module")
def rows():
    got = [(i, t, "en", ["b", "a", None][i % 3], len(t or ""), 7, "clash", 0.5) for i, t in enumerate(texts())]
    return [*got, (None, "a null id", "en", "a", 9, 7, "clash", 0.5), got[3]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int("idiot" in (t or "")), 1) for i, t in enumerate(texts())] + [(0, None, None, 1), (0, 0, 1, 1)], "doc_id long, quality int, toxic int, extra int")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_topk(spark):
    rng = random.Random(1)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    data = [(i, vec()) for i in range(0, 300)] + [(400, None), (401, [None, 1.0, 0.0, 0.0]), (402, [float("nan")] * 4), (None, vec()), (450, [0.5, 0.5])]
    data += [(500 + i, [0.25] * 4) for i in range(8)] + [(50, data[50][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    v = topk.quantised(df)
    got = {}
    for r in topk.top_k(v, v.filter("id % 50 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    clean = {i: np.floor(256 * np.float32(x).astype(float)).astype(int) for i, x in data if i is not None and x and None not in x and not any(np.isnan(y) for y in x)}
    pad = lambda x: np.pad(x, (0, 4 - len(x)))
    for q in (i for i in clean if i % 50 == 0):
        want = sorted((-int(pad(clean[q]) @ pad(x)), i) for i, x in clean.items() if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert topk.top_k(v.limit(0), v.limit(0), 5).count() == 0


def test_topk_of_large_components(spark):
    """No finite component is too large; scores stay exact integers beyond 2**53; what a long cannot hold is an error."""
    rows = [(0, [1.0, 0.0]), (1, [6e5, 0.0]), (2, [1.0, 1.0]), (50, [3e6, 1.0]), (3, [3e6, 7.0])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(v, v.filter("id % 50 = 0"), 2).collect()}
    big = 768_000_000
    assert got == {(0, 1): (3, 256 * big), (0, 2): (50, 256 * big), (50, 1): (3, big * big + 7 * 65536), (50, 2): (1, big * 153_600_000)}
    far = topk.quantised(spark.createDataFrame([(0, [1e9]), (1, [1e9])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="does not fit"):
        topk.top_k(far, far, 1).collect()
    beyond = topk.quantised(spark.createDataFrame([(0, [1e30])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="beyond a long"):
        beyond.collect()


def test_topk_over_shards(spark, monkeypatch):
    """Floors from a first shard leave out nothing: several shards and batches against all pairs, with ties."""
    monkeypatch.setattr(topk, "SHARD", 60)
    monkeypatch.setattr(topk, "BATCH", 7)
    rng = random.Random(9)
    data = [(i, [rng.choice([-1.0, -0.5, 0.25, 1.0]) for _ in range(3)]) for i in range(400)]
    v = topk.quantised(spark.createDataFrame(data, "vec_id long, embedding array<float>"))
    got = {}
    for r in topk.top_k(v, v.filter("id % 20 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = {i: [int(256 * c) for c in e] for i, e in data}
    for q in range(0, 400, 20):
        want = sorted((-sum(a * b for a, b in zip(x[q], x[i])), i) for i in x if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_jaccard(docs, nothing):
    got = by_id(jaccard.duplicates(docs, 4, 85, 100))
    sets = {}
    for i, t in enumerate(texts()):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert {i: (got[i]["n_shingles"], got[i]["component_id"]) for i in sets} == {i: (len(sets[i]), root[i]) for i in sets}
    assert got[None]["component_id"] is None and jaccard.duplicates(docs, 4, 85, 100).count() == docs.count()
    assert jaccard.duplicates(nothing, 4, 85, 100).count() == 0


def test_jaccard_near_family(spark, monkeypatch):
    """Many variants of one text, few of them directly alike: components and links, over several blocks, equal those of all pairs."""
    monkeypatch.setattr(jaccard, "BLOCK", 9)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    data = []
    for i in range(60):
        w = base[:]
        for _ in range(rng.randrange(9)):
            w[rng.randrange(80)] = f"n{rng.randrange(50)}"
        data.append((i, " ".join(w)))
    got = by_id(jaccard.duplicates(spark.createDataFrame(data, "doc_id long, text string"), 5, 80, 100, counted=True))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(76)} for i, t in data}
    root = {i: i for i in sets}
    for _ in range(8):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert {i: r["component_id"] for i, r in got.items()} == root
    alike = lambda a, b: a != b and 100 * len(a & b) >= 80 * len(a | b)
    different = {frozenset(x) for x in sets.values()}
    want = {i: sum(alike(sets[i], x) for x in different) for i in sets}
    assert {i: got[i]["n_links"] for i in sets} == want and max(want.values()) > 9


def test_flac(docs, nothing):
    got = by_id(flac.digest(flac.media(docs)))
    for i, t in enumerate(texts()):
        n, p = flac.payload_of(t)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    blocks = flac.pcm_blocks(flac.media(docs)).filter("doc_id = 17").orderBy("sample_offset").collect()
    assert b"".join(bytes(b["pcm"]) for b in blocks) == flac.payload_of(texts()[17])[1]
    for first, count in ((0, 10), (4600, 30), (5000, 9000), (10**7, 5)):
        found: dict = {}
        for r in flac.seek(flac.media(docs), first, count).orderBy("sample_offset").collect():
            if r["doc_id"] is not None and r["doc_id"] != 3:
                found[r["doc_id"]] = found.get(r["doc_id"], b"") + bytes(r["pcm"])
        want = {i: flac.payload_of(t)[1][first : first + count] for i, t in enumerate(texts()) if i != 3}
        assert found == {i: p for i, p in want.items() if p}
    assert flac.digest(flac.media(nothing)).count() == 0


def test_flac_codec():
    rng = random.Random(4)
    payloads = [bytes(576), bytes(rng.randrange(256) for _ in range(5760)), bytes(128 + int(90 * np.sin(i / 9)) for i in range(9216))]
    streams = flac.encode_many(payloads)
    assert flac.decode_many(streams) == payloads and len(streams[2]) < 6000
    assert flac.read_at(streams[2], 4600, 30) == payloads[2][4600:4630]
    hurt = bytearray(streams[1])
    hurt[-9] ^= 4
    with pytest.raises(flac.FlacError):
        flac.decode_many([bytes(hurt)])


def test_mixing(docs, nothing):
    rows = mixing.copies(docs.select("doc_id", "source", "text")).collect()
    assert len(rows) == docs.count()
    total = sum(r["size"] for r in rows)
    assert abs(sum({r["key"]: r["target"] for r in rows}.values()) - 1.5 * total) < 1e-6 * total
    assert all(r["copies"] <= 2 and r["target"] <= 2 * r["source_size"] for r in rows)
    again = mixing.copies(docs.select("doc_id", "source", "text")).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in rows if r["copies"])
    assert mixing.mix(nothing).count() == 0


def test_mixing_crossings_are_exact(spark):
    """Copies in integers at ranks where doubles round, and at most two."""
    rows = [(rate, offset, rank) for rate in (2.0, 1.9999999998, 1.5, 2 / 3, 0.1, 0.0) for offset in (0.0, 0.25, 4294967295 / 4294967296) for rank in (1, 2, 3, 65536, 10**9 + 7, 10**12 + 1, 2**52 + 1)]
    got = spark.createDataFrame(rows, "rate double, offset double, rank long").select("*", mixing.crossings(F.col("rank")).alias("c")).collect()
    for r in got:
        f, o = int(r["rate"] * 2**32), int(r["offset"] * 2**32)
        assert r["c"] == (f * r["rank"] + o >> 32) - (f * (r["rank"] - 1) + o >> 32) <= 2


def test_mixing_of_clashing_names(spark):
    df = spark.createDataFrame([(i, "a b c", "x", "k", 1, 2, 3) for i in range(20)], "doc_id long, text string, source string, key string, size int, n int, total int")
    out = mixing.mix(df)
    assert out.columns == df.columns and out.count() == 30


def test_hmm(docs, nothing):
    frame = docs.select("doc_id", "text", (F.col("doc_id") % 7 == 2).alias("held_out")).filter("doc_id IS NOT NULL")
    rows = hmm.scores(frame).collect()
    counts: dict = {}
    for r in frame.collect():
        if not r["held_out"]:
            for w in [*hmm.words_of(r["text"]), b""]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    text = {r["doc_id"]: r["text"] for r in frame.collect()}
    for r in rows:
        w = [*hmm.words_of(text[r["doc_id"]]), b""]
        assert r["n_tokens"] == len(w) and r["train_tokens"] == n and r["n_known"] == sum(x in counts for x in w)
        assert abs(r["base_score"] - sum(np.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w)) < 1e-6 * len(w)
        assert np.isfinite(r["score"]) and r["score"] < 0
    assert hmm.scores(nothing.select("doc_id", "text", F.lit(False).alias("held_out"))).count() == 0


def test_hmm_forward_is_exact(monkeypatch):
    """The scaled recursion against a sum over all state paths; expected counts sum to the tokens."""
    monkeypatch.setattr(hmm, "CLASSES", 5)
    rng = np.random.default_rng(0)
    m = hmm.Hmm(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), rng.dirichlet(np.ones(5), 2).T)
    seqs = [[0, 3, 1, 2], [4], [2, 2, 0]]
    got = m.forward(np.array(sum(seqs, []), np.uint16), np.array([4, 1, 3]))[0]
    for s, g in zip(seqs, got):
        a = m.start * m.emit[s[0]]
        for c in s[1:]:
            a = (a @ m.move) * m.emit[c]
        assert abs(np.log10(a.sum()) - g) < 1e-9
    e = m.expect(np.array(sum(seqs, []), np.uint16), np.array([4, 1, 3]))
    assert abs(e[:2].sum() - 3) < 1e-9 and abs(e[2:6].sum() - 5) < 1e-9 and abs(e[6:16].sum() - 8) < 1e-9


def test_crf_marginals_are_exact():
    chain = crf.Chain(np.array([[0.5, -0.3], [0.1, 0.9]]))
    e = np.array([0.2, -1.0, 0.7, 1.5])
    want = np.zeros(4)
    z = 0
    for y in range(16):
        bits = [y >> i & 1 for i in range(4)]
        w = np.exp(sum(e[i] * b for i, b in enumerate(bits)) + sum(chain.transitions[a, b] for a, b in zip(bits, bits[1:])))
        z += w
        want += w * np.array(bits)
    assert np.allclose(chain.marginals(e, np.array([4])), want / z)
    assert np.allclose(chain.marginals(np.r_[e, 0.3], np.array([4, 0, 1]))[:4], want / z)


def test_toxicity_and_quality(spark, docs, labels, nothing):
    rng = random.Random(6)
    text = lambda bad: " ".join(f"w{rng.randrange(900)}" for _ in range(30)) + (" a worthless moron, " if bad else " a long road, ") + " ".join(f"w{rng.randrange(900)}" for _ in range(9))
    rows = [(i, text(i % 4 == 0), i) for i in range(400)]
    many = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    marks = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.score(many, toxicity.train(many, marks)))
    assert np.mean([got[i]["predicted"] == int(i % 4 == 0) for i in range(400)]) > 0.98
    assert "worthless" in rows[0][1] and got[0]["spans"]
    start, end, _ = got[0]["spans"].split(",")[0].split(":")
    assert rows[0][1][int(start) : int(end)] in ("worthless", "moron")
    kept = toxicity.reject(many, toxicity.train(many, marks))
    assert kept.columns == many.columns and 290 <= kept.count() <= 310
    for module in (toxicity, quality):
        model = module.train(docs, labels)
        out = module.score(docs, model).collect()
        assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
        assert module.score(nothing, module.train(nothing, labels)).count() == 0


def test_toxic_words_of_a_small_share():
    rng = random.Random(8)
    fill = lambda k: [f"{k}{rng.randrange(10**6):06d}".encode() for _ in range(40)]
    rare = [[*fill("r"), b"zorrupt" + b"abcdefgh"[i : i + 1], *fill("r")] for i in range(8)]
    common = [[*fill("c"), rng.choice([b"moron", b"idiot"]), *fill("c")] for _ in range(392)]
    clean = [fill(k) + fill(k) for k in ["r"] * 48 + ["c"] * 352]
    words = rare + common + clean
    labels = toxicity._token_labels(words, np.array([1.0] * 400 + [0.0] * 400))
    flat = [w for ws in words for w in ws]
    marked = [w for w, x in zip(flat, labels) if x]
    assert sum(w.startswith(b"zorrupt") for w in marked) == 8  # 2 % of the toxic documents
    assert sum(w in (b"moron", b"idiot") for w in marked) == 392 and len(marked) == 400
    assert not toxicity._token_labels(words[:400], np.ones(400)).any()


def test_quality_accuracy(spark):
    rng = random.Random(3)
    good = lambda: "\n".join(" ".join(rng.choice(["the", "stone", "walks", "over", "green", "hills,"]) for _ in range(12)) + "." for _ in range(4))
    bad = lambda: "\n".join("%%% ".join(rng.choice(["BUY", "NOW", "$$$"]) for _ in range(12)) for _ in range(4))
    df = spark.createDataFrame([(i, bad() if i % 5 == 0 else good()) for i in range(300)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(300)], "doc_id long, quality int")
    got = by_id(quality.score(df, quality.train(df, marks)))
    assert np.mean([got[i]["predicted"] == int(i % 5 != 0) for i in range(300)]) > 0.98


def test_pieces(docs, nothing):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for chunk in (pieces.CHUNK, 50):
        got = by_id(pieces.encode(docs, PIECES, chunk))
        for i, t in enumerate(texts()):
            assert np.frombuffer(got[i]["ids"], np.uint16).tolist() == lib.encode(t or "")
    back = by_id(pieces.decode(pieces.encode(docs, PIECES), PIECES))
    assert all(back[i]["text"] == (t or "") for i, t in enumerate(texts()))
    assert pieces.encode(nothing, PIECES).count() == 0


def test_pieces_of_giant_texts(spark):
    """Chunks and a tree of several levels give what the whole texts and the library give."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(12)
    words = ["strange", "unbelievably", "x" * 900, "é字", "co-operate", "▁", "3.14159", "ab" * 200]
    giant = ["".join(rng.choice(words) + rng.choice(["", " ", "  ", "\n"]) for _ in range(1500)), "lowercase" * 4000, " " * 3000, "a"]
    df = spark.createDataFrame(list(enumerate(giant)), "doc_id long, text string")
    for chunk, fan in ((700, 3), (5000, 2), (1 << 20, 64)):
        got = by_id(pieces.encode(df, PIECES, chunk, fan))
        for i, t in enumerate(giant):
            assert np.frombuffer(got[i]["ids"], np.uint16).tolist() == lib.encode(t), (chunk, i)


def test_caches_stay_in_their_bytes():
    """A worker's caches at their limits: the memory they take is near their budget."""
    import tracemalloc

    from trailmill.llm import common

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 14)))
    model = pieces.Pieces(PIECES)
    tracemalloc.start()
    for _ in range(12):
        model.encode_marked(["▁" + "▁".join(word() for _ in range(40_000))])
    assert tracemalloc.get_traced_memory()[0] < 2 * common.CACHE_BYTES
    tracemalloc.stop()
    tracemalloc.start()
    hashes = common.WordHashes()
    for _ in range(common.WordHashes.MOST + 10):
        hashes[word().encode()]
    assert tracemalloc.get_traced_memory()[1] < 1.5 * common.CACHE_BYTES
    tracemalloc.stop()


def test_pieces_compose_is_associative():
    a, b, c = {1: {2, 3}}, {2: {5}, 3: {6}}, {5: {7}, 6: set()}
    assert pieces.compose(pieces.compose(a, b), c) == pieces.compose(a, pieces.compose(b, c)) == {1: {7}}


def test_tokenfile(docs, nothing, spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    folder = tokenfile.stage_path(spark, "test")
    tokenfile.write(docs, path, folder)
    rows = tokenfile.read(spark, folder).collect()
    order = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect()))
    start = 0
    for r, (_, doc, text) in zip(sorted(rows, key=lambda r: r["start"]), order):
        ids = [*tk.encode(text, add_special_tokens=False).ids, 2]
        assert (r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    empty = tokenfile.stage_path(spark, "test")
    tokenfile.write(nothing, path, empty)
    assert tokenfile.read(spark, empty).count() == 0


def test_tokenfile_special_tokens(spark):
    """Ids are the library's own, special tokens in the text included."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    some = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b  c", "see <|endoftext|> here", "<|endoftext", " <|endoftext|>\n<|endoftext|> "]
    got = tokenfile.Encoder(path).encode(some)
    assert [g.tolist() for g in got] == [tk.encode(t, add_special_tokens=False).ids for t in some] and got[0].tolist() == [31373, 220, 50256, 995]


def test_tokenfile_codes():
    v = np.array([0, 1, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7], np.uint32)
    for n in range(len(v) + 1):
        assert tokenfile.decode_values(*tokenfile.encode_values(v[:n]), n).tolist() == v[:n].tolist()
    segment = tokenfile.pack_segment([None, 5], [2, 1], np.array([9, 2, 2]), 3, 4) + tokenfile.TRAILER
    part, seq, ids, counts, got = tokenfile.unpack_segment(segment)
    assert (part, seq, ids, counts.tolist(), got.tolist()) == (3, 4, [None, 5], [2, 1], [9, 2, 2])
    with pytest.raises(ValueError):
        tokenfile.unpack_segment(segment[:-1])


def base_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii(docs, nothing):
    got = by_id(pii.digest(docs))
    for i, t in enumerate(texts()):
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(t or ""))
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[i]["spans"].startswith(want)
    assert {s.split(":")[0] for s in got[19]["spans"].split(",")} == {"url", "iban", "account"}
    rng = random.Random(8)
    a = pii.automaton()
    for _ in range(4000):
        t = "".join(rng.choice(["1", "22", ".", "@", "+", "-", " ", "a.b", "(", ")", "4111111111111111", "é", "\n", "com"]) for _ in range(rng.randrange(25)))
        assert [s for s in pii.find_spans(t, a) if s[0] in pii.BASE] == base_spans(t)
    digits = "1" * 400_000 + " " + "7." * 200_000 + " +" + "5" * 100_000
    began = time.process_time()
    found = pii.find_spans(digits, a)
    assert time.process_time() - began < 5 and [s for s in found if s[0] == "ip"][:2] == [("ip", 400_001, 400_008), ("ip", 400_009, 400_016)]
    clean = by_id(pii.redacted(docs))
    assert "@c.org" not in clean[18]["text"] and "<EMAIL>" in clean[18]["text"] and clean[18]["n_chars"] == len(clean[18]["text"])
    assert pii.digest(nothing).count() == 0 and pii.redacted(nothing).columns == nothing.columns
