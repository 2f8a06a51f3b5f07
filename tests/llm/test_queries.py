"""Every opN query and the pipeline on made-up tables, against brute force or DuckDB."""

import hashlib
import random
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest

import __spark_entry__

WORDS = ["stone", "river", "walks", "over", "green", "hills,", "the", "of", "slow", "bright", "morning", "Window", "été", "straße"]
TOXIC = ["moron", "worthless", "scumbag"]


def made(seed: int, n: int = 60, bad: bool = False, key: str = "") -> str:
    rng = random.Random(seed)
    out = [rng.choice(WORDS) + (str(rng.randrange(30)) if rng.random() < 0.5 else "") + key for _ in range(n)]
    for _ in range(4 if bad else 0):
        out[rng.randrange(n)] = rng.choice(TOXIC)
    return " ".join(out)


def rows() -> list[tuple]:
    """doc_id, text, lang, source, n_chars, toxic."""
    out = [(i, made(i, 40 + i % 30, i % 5 == 0), i % 5 == 0) for i in range(160)]
    near = out[7][1].split(" ")
    near[20] = "changed"
    far = out[8][1].split(" ")
    far[::5] = ["different"] * len(far[::5])
    extra = [out[7][1], out[7][1], " ".join(near), " ".join(far), None, "", "  \n ", "one two", "one two", "long " * 30_000, made(9, 45_000, key="q")]
    extra += ["mail a.b@c.org ip 10.0.0.1 and 999.1.1.1 card 4111 1111 1111 1111 tel +1 (499) 555-6503 end", "see https://ex.org/a?b=1 or GB82 WEST 1234 5698 7654 32 account no. 12345678 at 12 Green Hill Road today", "hello <|endoftext|> world"]
    out += [(200 + i, t, False) for i, t in enumerate(extra)]
    full = [(i, t, "en", ["b", "a", None, "é"][i % 4], len(t or ""), bad) for i, t, bad in out]
    # a null id, a repeated row, an id with two texts
    return [*full, (None, made(900), "en", "a", 1, False), full[3], (4, made(901), "fr", "b", 1, False)]


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def sf(spark, data, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([r[:5] for r in data], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], int(not r[5]), int(r[5])) for r in data if r[0] is not None and r[0] < 200] + [(3, None, None), (None, 1, 1), (999, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rng = random.Random(3)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(220)] + [(50, None), (300, [None] * 6), (350, [float("inf")] * 6), (None, [1.0] * 6), (7, [0.5] * 6)]
    vectors += [vectors[10], vectors[100], (400, [0.25, 0.5]), (401, [0.25, 0.5, 0.0, 0.0, 0.0, 0.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("none"))
    for t in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


def query(name):
    return next(q for k, q in __spark_entry__.queries().items() if k.startswith(name + "_"))


def words(t):
    return (t or "").encode().lower().split()


def components(sets: list, num: int, den: int) -> list[int]:
    """For each set the first set of its component."""
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and den * len(a & b) >= num * len(a | b):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def shingled(t, n):
    w = words(t)
    return {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize("op", [f"op{n}" for n in range(1, 11)])
def test_empty_tables(spark, empty, op):
    assert query(op)(spark, empty).count() == 0


@pytest.mark.parametrize("op, keys", [("op1", ("query_id", "rank")), ("op4", ("doc_id", "size", "taken"))])
def test_against_sql(spark, sf, op, keys):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    name = next(k for k in __spark_entry__.queries() if k.startswith(op + "_"))
    got, want = query(op)(spark, sf), con.sql(__spark_entry__.oracle_sql()[name])
    cols = sorted(want.columns)
    order = lambda r: tuple(str(x) for x in r)
    assert sorted(got.columns) == cols
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=order) == sorted(want.project(", ".join(cols)).fetchall(), key=order)


def test_op2(spark, sf, data):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in query("op2")(spark, sf).collect() if r["doc_id"] is not None)
    known = [(r[0], shingled(r[1], 4)) for r in data if r[0] is not None]
    root = components([s for _, s in known], 85, 100)
    # rows of one doc_id with several texts belong together by their id
    ids = [i for i, _ in known]
    for i, x in enumerate(ids):
        for j, y in enumerate(ids[:i]):
            if x == y and known[i][1] == known[j][1] and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = {r: min(i for i, s in zip(ids, root) if s == r) for r in set(root)}
    different = {frozenset(s) for _, s in known if s}
    n_links = lambda s: sum(x != s and 100 * len(x & s) >= 85 * len(x | s) for x in different)
    assert got == sorted((i, len(s), least[r] if s else i, n_links(s)) for (i, s), r in zip(known, root))


def test_op3(spark, sf, data):
    got = query("op3")(spark, sf).collect()
    assert len(got) == len(data)
    by_text: dict = {}
    for r in got:
        if r["doc_id"] not in (3, 4, None):
            text = next(x[1] for x in data if x[0] == r["doc_id"])
            raw = (text or "").encode()
            p = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
            x = np.frombuffer(p, np.uint8).astype(int) - 128
            assert r["feature"] == f"n={len(p)};sum={x.sum()};energy={(x * x).sum()};crossings={np.count_nonzero(np.diff(x < 0))};peak={abs(x).max()}"
            from trailmill.llm import flac

            stream = flac.encode_many([p])[0]
            assert (r["media_bytes"], r["media_sha256"]) == (len(stream), hashlib.sha256(stream).hexdigest())
            mine = (r["media_bytes"], r["media_sha256"], r["feature"])
            assert by_text.setdefault(text, mine) == mine


def test_op4_targets_and_reruns(spark, sf):
    got = query("op4")(spark, sf).collect()
    taken, target = {}, {}
    for r in got:
        taken[r["source_size"]] = taken.get(r["source_size"], 0) + r["taken"]
        target[r["source_size"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert sorted(map(str, got)) == sorted(map(str, query("op4")(spark, sf).collect()))


def test_op5(spark, sf, data):
    """Counts and base by brute force; score by a forward recursion of our own over the model that the query trains."""
    from trailmill.llm import hmm

    caught = {}
    real = hmm.likelihoods

    def spy(coded, model):
        caught["model"] = model
        return real(coded, model)

    hmm.likelihoods = spy
    try:
        got = query("op5")(spark, sf).collect()
    finally:
        hmm.likelihoods = real
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    counts: dict = {}
    for r in data:
        if not held(r[0]):
            for w in [*words(r[1]), b""]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    m = caught["model"]
    by_count = sorted(counts, key=lambda w: (w != b"", -counts[w], hmm._hash(w)))
    cls = {w: i for i, w in enumerate(by_count[: hmm.OWN])}
    tokens, distinct = np.zeros(hmm.HASHED), np.zeros(hmm.HASHED)
    for w in by_count[hmm.OWN :]:
        tokens[hmm._hash(w) % hmm.HASHED] += counts[w]
        distinct[hmm._hash(w) % hmm.HASHED] += 1
    for r in got:
        if r["doc_id"] in (3, 4, None):
            continue
        w = [*words(next(x[1] for x in data if x[0] == r["doc_id"])), b""]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(w), sum(x in counts for x in w), n)
        assert abs(r["base_score"] - sum(np.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w)) < 1e-6 * len(w)
        if len(w) > 2000:
            continue
        a, total = m.start.copy(), 0.0
        for t, x in enumerate(w):
            if t:
                a = a @ m.move
            h = hmm._hash(x) % hmm.HASHED
            a = a * m.emit[cls.get(x, hmm.OWN + h)]
            if x not in cls:
                total += np.log10((counts.get(x, 0) + 1) / (tokens[h] + distinct[h] + 1))
            total += np.log10(a.sum())
            a = a / a.sum()
        assert abs(r["score"] - total) < 1e-6 * len(w)
    assert len(got) == len(data)


@pytest.mark.parametrize("op, modulus, remainder, cut, label", [("op6", 5, 0, 0.5, 1), ("op8", 4, 2, 0.7, 0)])
def test_op6_op8(spark, sf, data, op, modulus, remainder, cut, label):
    got = query(op)(spark, sf).collect()
    assert len(got) == len(data)
    right = []
    for r in got:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % modulus == remainder)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
        if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 160 and r["doc_id"] not in (3, 4):
            right.append(r["predicted"] == (label if r["doc_id"] % 5 == 0 else 1 - label))
    if op == "op6":
        assert np.mean(right) > 0.9
    again = query(op)(spark, sf).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_op7(spark, sf, data):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = query("op7")(spark, sf).collect()
    assert len(got) == len(data)
    for r in got:
        if r["doc_id"] not in (3, 4, None):
            text = next(x[1] for x in data if x[0] == r["doc_id"]) or ""
            ids = lib.encode(text)
            assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            assert (r["decoded_chars"], r["decoded_sha256"]) == (len(text), hashlib.sha256(text.encode()).hexdigest())


def test_op9(spark, sf, data):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, want = 0, []
    for r in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tk.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in query("op9")(spark, sf).collect()), key=lambda r: r[1]) == want


def test_op10(spark, sf, data):
    from test_operators import base_spans

    got = {r["doc_id"]: r for r in query("op10")(spark, sf).collect()}
    for r in data:
        if r[0] not in (3, 4, None):
            base = base_spans(r[1] or "")
            text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
            mine = got[r[0]]
            assert [mine[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]
            assert mine["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and mine["spans"].startswith(text)
    assert {s.split(":")[0] for s in got[212]["spans"].split(",")} == {"url", "iban", "account", "address"}


# ---- the pipeline


def frame(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages(spark, sf, data):
    """Each stage against brute force on rows with nulls, repeats, ids with two texts and giant texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert kept.columns == docs.columns
    left = kept.collect()
    bad = lambda t: sum(w in (t or "").split(" ") for w in TOXIC)
    assert all(not bad(r["text"]) for r in left) and len(left) == sum(not bad(r[1]) for r in data)

    once = corpus_pipeline.drop_near_duplicates(spark, kept, sf)
    assert once.columns == docs.columns
    known = sorted((r["doc_id"], r["text"]) for r in left if r["doc_id"] is not None and r["text"] is not None)
    known = sorted(set(known))
    sets = [shingled(t, 5) for _, t in known]
    root = components(sets, 80, 100)
    first = {r: min((i, t) for (i, t), x in zip(known, root) if x == r) for r in set(root)}
    want = {(i, t) for (i, t), r, s in zip(known, root, sets) if not s or first[r][0] == i}
    got = [(r["doc_id"], r["text"]) for r in once.collect()]
    assert sorted(x for x in got if x[0] is not None and x[1] is not None) == sorted(want)
    assert sum(x[0] is None for x in got) == 1 and sum(x[1] is None for x in got) == 1

    clean = corpus_pipeline.redact_personal_data(spark, once, sf)
    assert clean.columns == docs.columns and clean.count() == len(got)
    by_id = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert by_id[211].count("<") == 4 and not re.search(r"c\.org|10\.0\.0\.1|4111|555", by_id[211])
    assert all(by_id[i] == t for i, t in got if i is not None and i < 160 and i not in (3, 4))

    mixed = corpus_pipeline.mix_sources(spark, clean, sf).collect()
    source = {}
    for r in mixed:
        source.setdefault((r["doc_id"], r["text"]), []).append(r)
    assert set(source) <= {(r["doc_id"], r["text"]) for r in clean.collect()} and max(map(len, source.values())) <= 2

    ids = corpus_pipeline.encode_pieces(spark, clean, sf).collect()
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = sorted(np.array(lib.encode(t or ""), "<u2").tobytes() for t in (r["text"] for r in clean.collect()))
    assert sorted(bytes(r["ids"]) for r in ids) == texts and all(r["n_tokens"] * 2 == len(r["ids"]) for r in ids)


def test_run_is_its_stages(spark, sf):
    """run() on documents gives what the stages give one after the other."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, sf)
    assert frame(__spark_entry__.queries()["pipeline"](spark, sf)) == frame(docs)


def test_pipeline_of_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_stages_keep_extra_columns(spark, sf):
    """Columns whose names the operators use themselves stay as they are."""
    names = ["key", "size", "n", "label", "low", "component_id", "score", "row", "copies", "total"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, name in enumerate(names):
        docs = docs.selectExpr("*", f"{k} AS `{name}`")
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, sf)
        assert out.columns == docs.columns and out.select(*names).distinct().collect()[0] == tuple(range(len(names)))
