"""SimHash near-duplicates: components of documents whose 64-bit fingerprints differ in few bits.

1. A fingerprint is made from every word shingle of a whole text, repeats included: a
   bit is 1 where it is set in over half of the shingles' hashes (XXH64, seed 42).
2. Equal fingerprints are one, with the smallest doc_id.
3. Tiles. The population counts of a fingerprint's two halves put it in a cell; two
   fingerprints within radius r lie in cells whose counts differ by r at most, over
   both halves together. A cell's fingerprints stay at home in chunks of bounded
   rows, packed, and visit the chunks of the later cells within reach, so every two
   cells meet once; a cell's chunks visit its own earlier ones. A task holds one chunk
   at home while its visitors stream by. Either is sorted
   by the population counts of their eight bytes and cut into tiles; a pair of tiles
   is skipped where the ranges of these counts lie more than r apart in sum, and
   compared whole, by exclusive-or and bit counts, where they do not. This is exact:
   no sum of differences of population counts exceeds the number of differing bits.
4. A chunk sends no pairs but a spanning forest of what it has linked, one edge for
   each fingerprint at home or visiting at most; components follow by minimum labels in staged rounds.

Scale: a fingerprint's cell has 21 cells in reach, so it travels 21 times the chunks
of a cell, 8 bytes each, whatever the number of documents up to CHUNK a cell (the
largest cell holds about 2 %); beyond that the work grows with the square, as
exact comparison by this method does, split over chunks. Cells number 33 * 33 at
most, so the table of their chunks is small by proof. Copies of one text are one fingerprint; a
group of near copies with many fingerprints meets in a few cells, whose tiles cost
the same whether they link or not.

Edge cases: a null text counts as empty; a text without words has fingerprint zero,
linked like any other; a null doc_id gives its fingerprint no smaller id and its row
a null component, and a fingerprint that only such rows have links nothing;
repeated rows are alike; a text's words are held in one task, its shingles hashed
SHINGLES at a time; extra columns, whatever their names, are cut first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop_stage, partitions, slices, stage
from .jaccard import components

WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints at home in one chunk of a cell, in a tile, and shingles hashed at once.
CHUNK, TILE, SHINGLES = 1 << 16, 256, 1 << 16
_U = np.uint64


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of a whole text."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return 0
    flat = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    n = max(1, len(found) - words + 1)
    last = ends[words - 1 :] if len(found) >= words else ends[-1:]
    first = np.concatenate([[0], ends[: n - 1] + 1])
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for low in range(0, n, SHINGLES):
        pairs = zip(first[low : low + SHINGLES].tolist(), last[low : low + SHINGLES].tolist())
        h = np.array([digest(flat[a:b], seed) for a, b in pairs], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit number) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                made = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], _U).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _halves(fp):
    """Population counts of the low and the high half."""
    return F.bit_count(fp.bitwiseAND(F.lit(0xFFFFFFFF))), F.bit_count(F.shiftrightunsigned(fp, 32))


def _reach(radius: int) -> list[tuple[int, int]]:
    """Steps to the later cells within reach: each two cells meet once."""
    return [(i, j) for i in range(radius + 1) for j in range(-radius, radius + 1) if i + abs(j) <= radius and (i, j) > (0, 0)]


class Forest:
    """Labels of items, some connected before (their label is the first of them), and what join() connects."""

    def __init__(self, before: np.ndarray):
        self.before = self.label = before
        self.parent = np.arange(len(before))

    def _root(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Connect a[i] with b[i]; pairs that share a label cost no step of their own."""
        a, b = self.label[a], self.label[b]
        apart = a != b
        if not apart.any():
            return
        for x, y in np.unique(np.stack([a[apart], b[apart]]), axis=1).T.tolist():
            x, y = self._root(x), self._root(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
        while (after := self.parent[self.parent]).tobytes() != self.parent.tobytes():
            self.parent = after
        self.label = self.parent[self.label]


def _tiles(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by the bytes' population counts, where each tile starts, and the least and largest counts in it."""
    counts = np.bitwise_count(fps.view(np.uint8)).reshape(-1, 8)
    order = np.lexsort(counts.T)
    starts = np.arange(0, len(fps), TILE)
    counts = counts[order].astype(np.int16)
    return order, starts, np.minimum.reduceat(counts, starts), np.maximum.reduceat(counts, starts)


class Home:
    """The fingerprints at home in a chunk, in tiles, with the labels of what is connected so far."""

    def __init__(self, fps: np.ndarray, radius: int):
        self.fps, self.radius = fps, radius
        self.tiles = _tiles(fps)
        self.label = np.arange(len(fps))

    def _compare(self, forest: Forest, theirs: np.ndarray, tiles: tuple, base: int, own: bool) -> None:
        order, starts, low, high = tiles
        mine, at, least, most = self.tiles
        theirs, ours = theirs[order], self.fps[mine]
        for i, first in enumerate(at.tolist()):
            gap = np.maximum(0, np.maximum(low - most[i], least[i] - high)).sum(axis=1)
            near = np.flatnonzero(gap <= self.radius)
            one = ours[first : first + TILE, None]
            for j in near[near >= i].tolist() if own else near.tolist():
                two = theirs[starts[j] : starts[j] + TILE]
                hit = np.flatnonzero(np.bitwise_count(one ^ two) <= self.radius)
                if len(hit):
                    a, b = np.divmod(hit, len(two))
                    forest.join(mine[first + a], base + order[starts[j] + b])

    def within(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a spanning forest of the links at home."""
        forest = Forest(self.label)
        self._compare(forest, self.fps, self.tiles, 0, True)
        return self._edges(forest, self.fps)

    def visited(self, visitors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges that the links between home and visitors add to what is connected."""
        forest = Forest(np.concatenate([self.label, len(self.fps) + np.arange(len(visitors))]))
        self._compare(forest, visitors, _tiles(visitors), len(self.fps), False)
        return self._edges(forest, np.concatenate([self.fps, visitors]))

    def _edges(self, forest: Forest, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.flatnonzero((forest.before == np.arange(len(items))) & (forest.label != forest.before))
        # a label is the first item of what is connected, so one at home as soon as an item at home is part of it
        self.label = forest.label[: len(self.fps)]
        return items[new], items[forest.label[new]]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges a, b between the distinct fingerprints (fp) that connect all those within radius."""
    low, high = _halves(F.col("fp"))
    cells = distinct.select("fp", low.alias("p"), high.alias("q"))
    chunks = stage(cells.groupBy("p", "q").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "simhash-cells")
    here = F.broadcast(chunks)  # 33 * 33 rows at most
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")

    def pack(table: pa.Table) -> pa.Table:
        return table.select(["p", "q", "chunk"]).slice(0, 1).append_column("fps", pa.array([np.asarray(table.column("fp")).tobytes()], pa.binary()))

    packed = cells.join(here, ["p", "q"]).select("p", "q", chunk.alias("chunk"), "fp").groupBy("p", "q", "chunk").applyInArrow(pack, "p int, q int, chunk int, fps binary")
    packed = stage(packed, "simhash-chunks")
    home = packed.withColumn("visit", F.lit(False))
    # its own cell: the earlier chunks; later cells: all chunks
    inside = packed.filter("chunk > 0").select("p", "q", F.explode(F.sequence(F.lit(0), F.col("chunk") - 1)).alias("chunk"), "fps", F.lit(True).alias("visit"))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _reach(radius)]))
    away = packed.select("p", "q", "fps", steps.alias("step")).select((F.col("p") + F.col("step.i")).alias("p"), (F.col("q") + F.col("step.j")).alias("q"), "fps").join(here, ["p", "q"])
    visits = away.select("p", "q", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "fps", F.lit(True).alias("visit"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = None
        for batch in batches:
            for visit, raw in zip(batch.column("visit").to_pylist(), batch.column("fps").to_pylist()):
                fps = np.frombuffer(raw, _U)
                if visit:
                    a, b = home.visited(fps)
                else:
                    home = Home(fps, radius)
                    a, b = home.within()
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    # a chunk's home comes first, its visitors stream by
    dealt = home.union(inside).union(visits).repartition(partitions(distinct.sparkSession), "p", "q", "chunk").sortWithinPartitions("p", "q", "chunk", "visit")
    return dealt.select("visit", "fps").mapInArrow(compare, "a long, b long")


def duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable by links, itself included) of every row."""
    rows = stage(fingerprints(docs, words), "simhash-rows")
    distinct = stage(rows.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("label")), "simhash-distinct")
    edges = stage(links(distinct.select("fp"), radius), "simhash-links")
    roots = components(edges)
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "label", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("label").alias("component"))
    # written first, so that the last join stands on two plain shuffles, which Spark splits where a fingerprint has many rows
    known = stage(rooted.join(smallest, "root").select(F.col("fp").alias("known"), "component"), "simhash-components")
    drop_stage(edges)
    joined = rows.join(known, F.col("fp") == F.col("known"), "left")
    return joined.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op12_simhash": op12_simhash}
ORACLE: dict[str, str] = {}
