"""SimHash components against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__
from trailmill.llm import simhash


def brute(text, n=4):
    words = (text or "").encode().lower().split()
    found = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in found]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components(fps, radius):
    """For each distinct fingerprint the smallest one reachable."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}
    find = lambda x: x if root[x] == x else find(root[x])
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def made(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(["Stone", "river", "walks", "über", "the"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.mark.parametrize("shingles", [1 << 16, 3])
def test_fingerprint(monkeypatch, shingles):
    monkeypatch.setattr(simhash, "SHINGLES", shingles)
    for t in [None, "", " \n\t", "one", "One two three", "a b c d", "a  b\x0bc d e f", "été " * 30, made(1), made(2, 500)]:
        assert simhash.fingerprint(t) == brute(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=12), st.integers(0, 6), st.integers(0, 10**6))
def test_tiles_and_forest(seeds, radius, seed):
    """Home and visitors in tiles of 4: the same components as all pairs."""
    rng = random.Random(seed)
    fps = set(seeds)
    for f in seeds:
        for _ in range(4):
            for _ in range(rng.randrange(4)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = list(fps)
    rng.shuffle(fps)
    parts = [np.array(fps[i::3], np.uint64) for i in range(3)]
    simhash.TILE, before = 4, simhash.TILE
    try:
        edges = []
        for i, part in enumerate(parts):
            if len(part):
                home = simhash.Home(part, radius)
                for a, b in [home.within(), *[home.visited(v) for v in parts[i + 1 :] if len(v)]]:
                    assert len(a) == len(b) <= len(fps)
                    edges += zip(a.tolist(), b.tolist())
    finally:
        simhash.TILE = before
    root = {f: f for f in fps}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in edges:
        assert (a ^ b).bit_count() <= 64
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {f: find(f) for f in fps} == components(fps, radius)


@pytest.mark.parametrize("chunk", [1 << 16, 5])
def test_links(spark, monkeypatch, chunk):
    """Cells, chunks and visits: the same components as all pairs; a group of near copies sends no pairs."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(chunk)
    base = [rng.getrandbits(64) for _ in range(150)] + [0, 2**64 - 1, 1, 7]
    fps = set(base)
    for f in base[:20]:
        for _ in range(6):
            f ^= 1 << rng.randrange(64)
            fps.add(f)
    hot = base[0]
    fps |= {hot ^ (1 << i) for i in range(64)}
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    edges = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(spark.createDataFrame(signed, "fp long")).collect()]
    assert len(edges) < 64 * 63 / 4 + len(fps) * 4
    root = {f: f for f in fps}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {f: find(f) for f in fps} == components(fps, 4)


def test_op12(spark, tmp_path):
    texts = [made(i, 40 + i) for i in range(60)]
    words = texts[7].split(" ")
    texts += [texts[7], " ".join([*words[:-1], "end"]), " ".join(["start", *words[1:]]), texts[7].upper(), None, "", " \n", "one two", "ONE two", "long " * 20_000, "straße " * 9]
    rows = [(500 + i if i < 40 else i, t, "en", "0", 5) for i, t in enumerate(texts)]
    rows += [rows[3], (rows[4][0], made(99), "fr", None, 1), (None, texts[8], "en", "x", 1), (None, made(77), "en", "x", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, fp string, n long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["op12_simhash"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    fps = [brute(r[1]) for r in rows]
    root = components([f for f, r in zip(fps, rows) if r[0] is not None], 4)
    least = {}
    for f, r in zip(fps, rows):
        if r[0] is not None:
            least[root[f]] = min(least.get(root[f], r[0]), r[0])
    want = [(r[0], f"{f:016x}", None if r[0] is None else least[root[f]]) for f, r in zip(fps, rows)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert __spark_entry__.queries()["op12_simhash"](spark, str(tmp_path)).collect() == []
