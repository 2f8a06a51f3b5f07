"""N-gram Jaccard join by a token-group matrix: components of documents whose shingle sets are alike.

Tokens are 64-bit hashes of word shingles; sizes and overlaps are exact but for
hash collisions inside a pair. With a threshold num / den, a set of n tokens
shares at least ceil(n num / den) tokens with any partner. The join goes:

1. Equal sets become one class (a 128-bit key of the set; smallest doc_id).
2. Unshared tokens. Of every set, the tokens that a fixed hash rule selects (one
   in `stride`) are counted over the whole corpus in packed buckets; a map task
   counts its own tokens first, so a common token leaves it once. A set with more
   unshared selected tokens than n - ceil(n num / den) has no partner and rests.
3. Groups. Remaining sets are put together by the smallest hash among their
   shared selected tokens, large groups in chunks of bounded sets and tokens, and
   compared inside the chunk. Tokens that only one set has play no part, so the
   variants of a text fall into few groups whether they link or not. A group is
   kept as the union of its tokens; a set in it is a list of places in the union.
4. Token-group matrix. Tokens are ordered by the number of groups whose union has
   them, rare first; of each set only the first n - ceil(n num / den) + 1 are
   entered (two linked sets share one of these). Groups in one row of the matrix
   may hold linked sets. Of each such pair of groups only the sets that have a
   token of a row the two share, and a size that fits, leave their groups: their
   selected tokens first, which bound a set's overlap with the other side, then
   those that qualify, and sets not yet connected are compared. A group itself
   never travels with its pairs, which are many for a group of many sets.
   In round one the row's smallest group stands for all; in round two only pairs
   whose groups are not yet wholly connected are left.
5. Components of the links by minimum labels, in staged rounds.
6. Number of links, where asked for. All links lie inside components, so the
   different sets of a component are dealt to blocks of bounded sets and tokens,
   and each block is counted against itself and the component's other blocks. Rows
   are blocks, never pairs of sets; a component of b blocks has b (b - 1) / 2 of them
   to compare, which is what counting all its links takes.

No group of copies is expanded into its pairs. Edge cases: a null or empty text
has an empty set and links with nothing; a null doc_id takes no part and has a
null component; repeated rows are equal sets; rows of one doc_id with different
texts are linked by what either is alike; a text's words are held in one task;
extra columns, whatever their names, are cut first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, buckets_for, documents, drop_stage, joined, lean, lean_group, mix, pack, partitions, settings, shingles, slices, stage, words_of

#: Sets and tokens in a chunk of a group (one set at least), tokens and sets a map task counts before it sends them.
CHUNK, CHUNK_TOKENS, FLUSH, FLUSH_SETS = 1024, 1 << 20, 1_000_000, 200_000
#: Sets and tokens in a block of a component while its links are counted (one set at least).
BLOCK, BLOCK_TOKENS = 512, 1 << 19
#: Shared tokens, or bytes in 32s of lists of sets, that a task looks up in a group at once; bytes it gathers before it sends them.
WANTED, SENT = 1 << 15, 1 << 20
#: Bytes of text that a bucket of counted tokens answers for; a worker takes about five times as many to count it.
COUNTED_BYTES = 32 << 20
#: The place of a set without shared tokens.
NO_LOW = (1 << 63) - 1
_U = np.uint64


def least_shared(n: np.ndarray | int, num: int, den: int):
    """Fewest tokens a set of n shares with any partner."""
    return -(-n * num // den)


def links(inter: int, n1: int, n2: int, num: int, den: int) -> bool:
    """Whether intersection / union is at least num / den."""
    return inter > 0 and inter * (den + num) >= num * (n1 + n2)


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Tokens in both of two ascending arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def stride_of(num: int, den: int) -> int:
    """One token in so many is counted over the corpus: more than the share that may be unshared."""
    return max(1, int(den / ((den - num) * 1.6)))


def _sets(b: pa.RecordBatch, hashes: WordHashes, words: int) -> list[np.ndarray]:
    get = hashes.__getitem__
    out = []
    for t in b.column("text").to_pylist():
        w = words_of(t)
        out.append(shingles(np.fromiter(map(get, w), _U, len(w)), words))
    return out


def _selected(s: np.ndarray, stride: int) -> np.ndarray:
    return s[s % _U(stride) == 0]


def _place(tokens: np.ndarray) -> np.ndarray:
    """A scattered non-negative number for each token."""
    return (mix(tokens ^ _U(0x5851F42D4C957F2D)) >> _U(1)).astype(np.int64)


def survey(docs: DataFrame, words: int, num: int, den: int, buckets: int) -> DataFrame:
    """Staged rows: for each document row, doc_id, n, key, chosen (selected tokens); and packed tokens by bucket."""
    stride = stride_of(num, den)
    schema = "bucket long, row long, doc_id long, n long, key binary, chosen long, shared long, low long, tokens binary, rows binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, row = WordHashes(), TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # row, doc_id, n, key
        chosen: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(c) for c in chosen])
            tokens = np.concatenate(chosen) if chosen else np.zeros(0, _U)
            owner = np.repeat(np.arange(len(held)), sizes)
            found, at, count = np.unique(tokens, return_inverse=True, return_counts=True)
            common = count[at] > 1
            own = np.bincount(owner, common, len(held)).astype(np.int64)
            low = np.full(len(held), NO_LOW)
            np.minimum.at(low, owner[common], _place(tokens[common]))
            n = len(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1] * n, pa.int64()), *[pa.array([h[i] for h in held], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], pa.array(sizes, pa.int64()), pa.array(own), pa.array(low), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())],
                names,
            )
            if len(found):
                # a token of one row here goes with its row, one of several goes once, as row -1
                rows = np.full(len(found), -1, np.int64)
                single = count[at] == 1
                rows[at[single]] = np.array([h[0] for h in held], np.int64)[owner[single]]
                packed = list(pack((mix(found) % _U(buckets)).astype(np.int64), found, rows))
                k = len(packed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in packed], pa.int64()), *[pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())], pa.array([p[1] for p in packed], pa.binary()), pa.array([p[2] for p in packed], pa.binary())],
                    names,
                )
            held.clear(), chosen.clear()

        waiting = 0
        for whole in batches:
            for b in slices(whole):
                for doc, s in zip(b.column("doc_id").to_pylist(), _sets(b, hashes, words)):
                    held.append((row, doc, len(s), set_key(s)))
                    chosen.append(_selected(s, stride))
                    waiting += len(chosen[-1])
                    row += 1
                if waiting > FLUSH or len(held) > FLUSH_SETS:
                    yield from flush()
                    waiting = 0
        if held:
            yield from flush()

    return stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), schema), "jaccard-survey")


def _shared(surveyed: DataFrame) -> DataFrame:
    """row, found, found_low: selected tokens of a row that some row of another flush has too; their smallest place."""

    def by_token(table: pa.Table) -> pa.Table:
        tokens, rows = joined(table.column("tokens"), _U), joined(table.column("rows"), np.int64)
        _, at = np.unique(tokens, return_inverse=True)
        weight = np.bincount(at, np.where(rows < 0, 2, 1))
        hit = rows[(weight[at] > 1) & (rows >= 0)]
        row, where, n = np.unique(hit, return_inverse=True, return_counts=True)
        low = np.full(len(row), NO_LOW)
        np.minimum.at(low, where, _place(tokens[(weight[at] > 1) & (rows >= 0)]))
        packed = list(pack(row >> 40, row, n.astype(np.int64), low))
        return pa.table({"part": pa.array([p[0] for p in packed], pa.int64()), **{c: pa.array([p[i] for p in packed], pa.binary()) for i, c in ((1, "rows"), (2, "counts"), (3, "lows"))}})

    def by_row(table: pa.Table) -> pa.Table:
        rows, n = joined(table.column("rows"), np.int64), joined(table.column("counts"), np.int64)
        row, at = np.unique(rows, return_inverse=True)
        low = np.full(len(row), NO_LOW)
        np.minimum.at(low, at, joined(table.column("lows"), np.int64))
        return pa.table({"row": row, "found": np.bincount(at, n, len(row)).astype(np.int64), "found_low": low})

    tokens = surveyed.filter("bucket >= 0").select("bucket", "tokens", "rows")
    dealt = tokens.groupBy("bucket").applyInArrow(lean_group(by_token), "part long, rows binary, counts binary, lows binary")
    return dealt.groupBy("part").applyInArrow(lean_group(by_row), "row long, found long, found_low long")


def classes(surveyed: DataFrame, num: int, den: int) -> DataFrame:
    """key, label (smallest doc_id), n, low, hopeful: whether the set may have a partner besides its copies."""
    rows = surveyed.filter("bucket < 0 AND n > 0 AND doc_id IS NOT NULL").select("row", "doc_id", "n", "key", "chosen", "shared", "low")
    unshared = F.col("chosen") - F.col("shared") - F.coalesce(F.col("found"), F.lit(0))
    both = rows.join(_shared(surveyed), "row", "left").withColumn("hopeful", unshared <= F.col("n") - least_expr(num, den))
    return both.groupBy("key").agg(F.min("doc_id").alias("label"), F.first("n").alias("n"), F.min(F.least("low", F.coalesce("found_low", "low"))).alias("low"), F.max(F.col("hopeful").cast("int")).alias("hopeful"))


def least_expr(num: int, den: int):
    """ceil(n num / den) over column n, in integers."""
    return F.expr(f"(n * {num}L + {den - 1}L) div {den}L")


def sets_of(docs: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """Staged key, label, n, tokens, low for the chosen classes, made anew from the text of their labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for b in slices(whole):
                got = _sets(b, hashes, words)
                out = [pa.array([set_key(s) for s in got], pa.binary()), b.column("doc_id"), pa.array([len(s) for s in got], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())]
                made = pa.RecordBatch.from_arrays([*out, b.column("low")], ["key", "label", "n", "tokens", "low"])
                # a row whose class is known by now: other texts of its doc_id go
                yield made.filter(pc.or_kleene(pc.is_null(b.column("wanted")), pc.equal(out[0], b.column("wanted"))))

    schema = "key binary, label long, n long, tokens binary, low long"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = chosen.select(F.col("label").alias("doc_id"), F.col("key").alias("wanted"), "low")
    # the smallest doc_id of several classes (its rows differ in text): its sets are found by their keys
    several = labels.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    odd = several.limit(1).count() > 0
    kept = texts.join(labels.join(several, "doc_id", "left_anti") if odd else labels, "doc_id").select("doc_id", "text", "wanted", "low").mapInArrow(lean(run), schema)
    if odd:
        some = texts.join(several, "doc_id", "left_semi").select("doc_id", "text", F.lit(None).cast("binary").alias("wanted"), F.lit(NO_LOW).alias("low"))
        wanted = labels.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("d"), "wanted", F.col("low").alias("l"))
        found = some.mapInArrow(lean(run), schema).join(wanted, (F.col("label") == F.col("d")) & (F.col("key") == F.col("wanted")))
        kept = kept.union(found.select("key", "label", "n", "tokens", F.col("l").alias("low")))
    # a Bloom filter of bounded size (Spark's limit) over the labels drops other texts before their shuffle
    with settings(docs.sparkSession, {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}):
        return stage(kept, "jaccard-sets")


def _root(parent: dict, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _connected(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each set the first set of its component: overlaps with all others from lists of the sets that hold a token."""
    n, sizes = len(sets), np.array([len(x) for x in sets])
    label = np.arange(n)
    owner = np.repeat(label, sizes)
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = owner[np.argsort(token, kind="stable")]
    starts = np.cumsum(df) - df
    ends = np.cumsum(sizes)
    for i in range(1, n):
        t = token[ends[i] - sizes[i] : ends[i]]
        t = t[df[t] > 1]
        if not len(t):
            continue
        k = df[t]
        at = np.repeat(starts[t] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        inter = np.bincount(holders[at], minlength=n)[:i]
        linked = np.flatnonzero((inter > 0) & (inter * (den + num) >= num * (sizes[i] + sizes[:i])))
        if len(linked):
            joined_ = np.unique(np.append(label[linked], label[i]))
            label[np.isin(label, joined_)] = joined_[0]
    return label


GROUP = "gid long, lo long, hi long, sizes binary, tokens binary, places binary, keys binary, labels binary, nodes binary"


def _group(sets: list[np.ndarray]) -> tuple[bytes, bytes, bytes]:
    """Sizes, the union of the tokens, and each set's places in it (none for a single set, which is the union)."""
    sizes = np.array([len(a) for a in sets], np.int64)
    if len(sets) == 1:
        return sizes.tobytes(), sets[0].tobytes(), b""
    union, at = np.unique(np.concatenate(sets), return_inverse=True)
    return sizes.tobytes(), union.tobytes(), at.astype(np.uint32).tobytes()


class Group:
    """A token group opened: its union, the sizes of its sets, their places in the union one set after the other."""

    def __init__(self, sizes: bytes, tokens: bytes, places: bytes):
        self.sizes, self.union = np.frombuffer(sizes, np.int64), np.frombuffer(tokens, _U)
        self.places = np.frombuffer(places, np.uint32) if len(self.sizes) > 1 else np.arange(len(self.union), dtype=np.uint32)
        self.ends = np.cumsum(self.sizes)

    def sets(self) -> list[np.ndarray]:
        return np.split(self.union[self.places], self.ends[:-1])

    def one(self, i: int) -> np.ndarray:
        return self.union[self.places[self.ends[i] - self.sizes[i] : self.ends[i]]]

    def within(self, other: "Group") -> np.ndarray:
        """Of each set, how many tokens are in the other group's union."""
        if not len(other.union) or not len(self.union):
            return np.zeros(len(self.sizes), np.int64)
        at = np.searchsorted(other.union, self.union)
        at[at == len(other.union)] = 0
        hits = np.concatenate([[0], np.cumsum((other.union[at] == self.union)[self.places])])
        return hits[self.ends] - hits[self.ends - self.sizes]

    def some(self, on: np.ndarray) -> tuple[bytes, bytes, bytes]:
        """The group of these sets alone, packed."""
        if len(on) == 1:
            return self.sizes[on].tobytes(), self.one(on[0]).tobytes(), b""
        at = np.concatenate([self.places[e - n : e] for e, n in zip(self.ends[on].tolist(), self.sizes[on].tolist())])
        kept, places = np.unique(at, return_inverse=True)
        return self.sizes[on].tobytes(), self.union[kept].tobytes(), places.astype(np.uint32).tobytes()

    def holders(self, tokens: np.ndarray) -> list[np.ndarray]:
        """The sets that have each of these tokens of the union (ascending, distinct)."""
        nth = np.full(len(self.union), -1)
        nth[np.searchsorted(self.union, tokens)] = np.arange(len(tokens))
        held = nth[self.places]
        on = np.flatnonzero(held >= 0)
        on = on[np.argsort(held[on], kind="stable")]
        return np.split(np.searchsorted(self.ends, on, "right"), np.searchsorted(held[on], np.arange(1, len(tokens))))

    def selected(self, stride: int) -> tuple[bytes, bytes, bytes]:
        """The group of the sets' selected tokens, packed."""
        on = self.union % _U(stride) == 0
        place = np.cumsum(on) - 1
        kept = on[self.places]
        counts = np.concatenate([[0], np.cumsum(kept)])
        sizes = counts[self.ends] - counts[self.ends - self.sizes]
        return sizes.astype(np.int64).tobytes(), self.union[on].tobytes(), place[self.places[kept]].astype(np.uint32).tobytes() if len(sizes) > 1 else b""


def groups_of(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Staged groups: gid, lo and hi (smallest and largest set), the union of the tokens, and for each set its size, places, key, label and node.

    A node stands for sets of the group that are connected inside it.
    """

    def gather(table: pa.Table) -> pa.Table:
        rows = list({r["key"]: r for r in sorted(table.to_pylist(), key=lambda r: (r["label"], r["key"]))}.values())
        arrays = [np.frombuffer(r["tokens"], _U) for r in rows]
        label = _connected(arrays, num, den)
        ids = [int.from_bytes(r["key"][:8], "little", signed=True) for r in rows]
        sizes, union, places = _group(arrays)
        return pa.table({
            "gid": pa.array([ids[0]], pa.int64()), "lo": [min(map(len, arrays))], "hi": [max(map(len, arrays))], "sizes": [sizes],
            "tokens": [union], "places": [places], "keys": [b"".join(r["key"] for r in rows)],
            "labels": [np.array([r["label"] for r in rows], np.int64).tobytes()],
            "nodes": [np.array([ids[i] for i in label.tolist()], np.int64).tobytes()],
        })

    # the chunks of a group follow from its sets and their tokens
    many = sets.groupBy("low").agg(F.count("*").alias("sets"), F.sum("n").alias("in_all")).select("low", F.greatest(F.ceil(F.col("sets") / CHUNK), F.ceil(F.col("in_all") / CHUNK_TOKENS)).alias("chunks")).filter("chunks > 1")
    dealt = sets.join(many, "low", "left").withColumn("chunk", F.pmod(F.xxhash64("label"), F.coalesce("chunks", F.lit(1)))).drop("chunks")
    dealt = dealt.repartition(partitions(sets.sparkSession), "low", "chunk")
    return stage(dealt.groupBy("low", "chunk").applyInArrow(lean_group(gather), GROUP), "jaccard-groups")


def _split(sizes: bytes, tokens: bytes) -> list[np.ndarray]:
    n = np.frombuffer(sizes, np.int64)
    return np.split(np.frombuffer(tokens, _U), np.cumsum(n)[:-1])


def _groups_in(b: pa.RecordBatch) -> Iterator[Group]:
    for row in zip(*(b.column(c).to_pylist() for c in ("sizes", "tokens", "places"))):
        yield Group(*row)


def _entries(s: np.ndarray, stride: int, num: int, den: int) -> np.ndarray:
    """Tokens of a set that may be among its first: the selected ones, then others by hash if these are too few."""
    first = s % _U(stride) == 0
    short = len(s) - least_shared(len(s), num, den) + 1 - int(first.sum())
    if short > 0:
        rest = np.flatnonzero(~first)
        first = first.copy()
        first[rest[np.argsort(mix(s[rest]), kind="stable")[:short]]] = True
    return s[first]


def matrix(groups: DataFrame, num: int, den: int, buckets: int) -> DataFrame:
    """Staged token-group matrix: (token, gid, lo, hi) for the first tokens of the groups' sets that two groups or more have; lo and hi of these sets."""
    stride = stride_of(num, den)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, gids = [], []
            for gid, group in zip(b.column("gid").to_pylist(), _groups_in(b)):
                t = np.unique(np.concatenate([_entries(s, stride, num, den) for s in group.sets()]))
                parts.append(t)
                gids.append(np.full(len(t), gid, np.int64))
            if parts:
                t = np.concatenate(parts)
                packed = list(pack((mix(t) % _U(buckets)).astype(np.int64), t, np.concatenate(gids)))
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in packed], pa.int64()), pa.array([p[1] for p in packed], pa.binary()), pa.array([p[2] for p in packed], pa.binary())], ["bucket", "tokens", "gids"])

    def frequencies(table: pa.Table) -> pa.Table:
        t, g = joined(table.column("tokens"), _U), joined(table.column("gids"), np.int64)
        _, at, n = np.unique(t, return_inverse=True, return_counts=True)
        hit = n[at] > 1
        t, g, n = t[hit], g[hit], n[at][hit].astype(np.int64)
        packed = list(pack((mix(g.view(_U)) % _U(buckets)).astype(np.int64), g, t, n))
        return pa.table({"part": pa.array([p[0] for p in packed], pa.int64()), **{c: pa.array([p[i] for p in packed], pa.binary()) for i, c in ((1, "gids"), (2, "tokens"), (3, "counts"))}})

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        g, t, n = joined(right.column("gids"), np.int64), joined(right.column("tokens"), _U), joined(right.column("counts"), np.int64)
        order = np.lexsort((t, g))
        g, t, n = g[order], t[order], n[order]
        out_t, out_g, out_lo, out_hi = [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for gid, sizes, picks, raw in zip(*(left.column(c).to_pylist() for c in ("gid", "sizes", "picks", "entries"))):
            low, high = np.searchsorted(g, gid, "left"), np.searchsorted(g, gid, "right")
            shared, count = t[low:high], n[low:high]
            picked = []
            for size, e in zip(np.frombuffer(sizes, np.int64).tolist(), _split(picks, raw)):
                seen = np.ones(len(e), np.int64)
                if len(shared):
                    at = np.minimum(np.searchsorted(shared, e), len(shared) - 1)
                    same = shared[at] == e
                    seen[same] = count[at[same]]
                # selected tokens by frequency, then the others by hash; the same order for all sets
                other = e % _U(stride) != 0
                rank = np.lexsort((mix(e), np.where(other, 0, seen), other))[: size - least_shared(size, num, den) + 1]
                picked.append(e[rank][seen[rank] > 1])
            got, at = np.unique(np.concatenate(picked), return_inverse=True)
            own = np.repeat(np.frombuffer(sizes, np.int64), [len(p) for p in picked])
            lo, hi = np.full(len(got), NO_LOW), np.zeros(len(got), np.int64)
            np.minimum.at(lo, at, own)
            np.maximum.at(hi, at, own)
            out_t.append(got)
            out_g.append(np.full(len(got), gid, np.int64))
            out_lo.append(lo)
            out_hi.append(hi)
        return pa.table({"token": np.concatenate(out_t).view(np.int64), "gid": np.concatenate(out_g), "lo": np.concatenate(out_lo), "hi": np.concatenate(out_hi)})

    packed = groups.select("gid", "sizes", "tokens", "places").mapInArrow(lean(tokens), "bucket long, tokens binary, gids binary")
    counted = packed.groupBy("bucket").applyInArrow(lean_group(frequencies), "part long, gids binary, tokens binary, counts binary")

    def part_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = np.asarray(b.column("gid"))
            part = (mix(g.view(_U).copy()) % _U(buckets)).astype(np.int64)
            own = [[_entries(s, stride, num, den) for s in group.sets()] for group in _groups_in(b)]
            picks = [np.array([len(e) for e in x], np.int64).tobytes() for x in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), b.column("gid"), b.column("sizes"), pa.array(picks, pa.binary()), pa.array([b"".join(e.tobytes() for e in x) for x in own], pa.binary())],
                ["part", "gid", "sizes", "picks", "entries"],
            )

    # the rank needs a set's entries and size alone, a quarter of its tokens
    dealt = groups.select("gid", "sizes", "tokens", "places").mapInArrow(lean(part_of), "part long, gid long, sizes binary, picks binary, entries binary")
    return stage(dealt.groupBy("part").cogroup(counted.groupBy("part")).applyInArrow(lean_group(first), "token long, gid long, lo long, hi long"), "jaccard-matrix")


def _cross(one: Group, two: Group, nodes_one: bytes, nodes_two: bytes, num: int, den: int) -> list[tuple[int, int]]:
    """Links between the nodes of two groups, as many as connect them; bounds first."""
    in_two, in_one = one.within(two), two.within(one)
    open_a = np.flatnonzero(in_two >= least_shared(one.sizes, num, den)).tolist()
    open_b = np.flatnonzero(in_one >= least_shared(two.sizes, num, den)).tolist()
    if not open_a or not open_b:
        return []
    node_a, node_b = np.frombuffer(nodes_one, np.int64).tolist(), np.frombuffer(nodes_two, np.int64).tolist()
    size_a, size_b = one.sizes.tolist(), two.sizes.tolist()
    opened_b = {j: two.one(j) for j in open_b}
    parent = {n: n for n in (*node_a, *node_b)}
    out = []
    for i in open_a:
        x = one.one(i)
        for j in open_b:
            u, v = _root(parent, node_a[i]), _root(parent, node_b[j])
            fits = min(size_a[i], size_b[j]) * den >= num * max(size_a[i], size_b[j])
            if u != v and fits and links(overlap(x, opened_b[j]), size_a[i], size_b[j], num, den):
                parent[max(u, v)] = min(u, v)
                out.append((node_a[i], node_b[j]))
    return out


def _open(one: Group, two: Group, n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of the first group's sets, of n tokens each, those whose selected tokens (the groups hold no others) leave a link possible.

    A set of n may miss n - ceil(n num / den) of its tokens in a partner, so it
    misses no more of its selected ones in the union of the partner's group.
    """
    return np.flatnonzero(one.sizes - one.within(two) <= n - least_shared(n, num, den))


SIDE = "a long, b long, second boolean, sizes binary, tokens binary, places binary, more binary, sets binary"
_SIDE = [c.split()[0] for c in SIDE.split(", ")]


def sides(wanted: DataFrame, groups: DataFrame, weight, part: Callable[..., Iterator[tuple]]) -> DataFrame:
    """The two sides of pairs (a, b) of groups, one after the other; wanted has gid, other and what part asks for.

    part(group, nodes, rows by other) yields other, sets and their packed group for what is wanted of a group. A
    group is opened for rows of a bounded weight at once.
    """
    many = wanted.groupBy("gid").agg(F.ceil(F.sum(weight) / WANTED).alias("chunks")).filter("chunks > 1")
    chunk = F.pmod(F.xxhash64("other"), F.coalesce("chunks", F.lit(1)))
    of_group = wanted.join(many, "gid", "left").groupBy("gid", chunk.alias("chunk")).agg(F.collect_list(F.struct(*[c for c in wanted.columns if c != "gid"])).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0

        def sent() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 5))], _SIDE)
            out.clear()
            return made

        for b in batches:
            for gid, nodes, rows, group in zip(b.column("gid").to_pylist(), b.column("nodes").to_pylist(), b.column("wanted"), _groups_in(b)):
                rows = pa.RecordBatch.from_struct_array(rows.values)
                rows = rows.take(pc.sort_indices(rows, [("other", "ascending")]))
                for other, *side in part(group, np.frombuffer(nodes, np.int64), rows):
                    out.append((min(gid, other), max(gid, other), gid > other, *side))
                    held += sum(map(len, side)) + 64
                    if held > SENT:
                        yield sent()
                        held = 0
        if out:
            yield sent()

    made = groups.select("gid", "sizes", "tokens", "places", "nodes").join(of_group, "gid").select("gid", "sizes", "tokens", "places", "nodes", "wanted").mapInArrow(lean(run), SIDE)
    return made.repartition(partitions(groups.sparkSession), "a", "b").sortWithinPartitions("a", "b", "second")


def _runs(rows: pa.RecordBatch) -> Iterator[tuple[int, int, int]]:
    """other, start and end of the rows of each."""
    other = np.asarray(rows.column("other"))
    cuts = [0, *(np.flatnonzero(other[1:] != other[:-1]) + 1).tolist(), len(other)]
    for low, high in zip(cuts, cuts[1:]):
        yield int(other[low]), low, high


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple]]:
    """The pairs of which both sides have a set left."""
    last = None
    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in _SIDE)):
            if last and last[:2] == r[:2]:
                yield last, r
            last = r


def bounded(candidates: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """Staged gid, other, sets: for the pairs of groups in candidates (token, a, b and the sizes of either's sets that have
    the token) the sets that may link by their selected tokens, a fraction of their bytes."""
    stride = stride_of(num, den)

    def part(group: Group, nodes: np.ndarray, rows: pa.RecordBatch) -> Iterator[tuple]:
        distinct, nth = np.unique(np.asarray(rows.column("token")).view(_U), return_inverse=True)
        held, lo, hi = group.holders(distinct), np.asarray(rows.column("lo")), np.asarray(rows.column("hi"))
        few = Group(*group.selected(stride))
        for other, low, high in _runs(rows):
            on = np.unique(np.concatenate([held[i] for i in nth[low:high]]))
            n = group.sizes[on]
            on = on[(n * den >= num * lo[low:high].min()) & (n * num <= den * hi[low:high].max())]
            if len(on):
                yield other, *few.some(on), group.sizes[on].tobytes(), on.astype(np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r1, r2 in _both(batches):
            one, two = Group(*r1[3:6]), Group(*r2[3:6])
            on = [np.frombuffer(r[7], np.uint32)[_open(x, y, np.frombuffer(r[6], np.int64), num, den)] for r, x, y in ((r1, one, two), (r2, two, one))]
            if len(on[0]) and len(on[1]):
                yield pa.RecordBatch.from_arrays([pa.array(r1[:2], pa.int64()), pa.array(r1[1::-1], pa.int64()), pa.array([x.tobytes() for x in on], pa.binary())], ["gid", "other", "sets"])

    side = lambda gid, other: F.struct(F.col(gid).alias("gid"), F.col(other).alias("other"), "token", F.col(f"lo_{other}").alias("lo"), F.col(f"hi_{other}").alias("hi"))
    wanted = candidates.select(F.inline(F.array(side("a", "b"), side("b", "a"))))
    return stage(sides(wanted, groups, F.lit(1), part).mapInArrow(lean(run), "gid long, other long, sets binary"), "jaccard-bounded")


def opened(candidates: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) of nodes found in the pairs of groups that qualify."""
    wanted = bounded(candidates, groups, num, den)

    def part(group: Group, nodes: np.ndarray, rows: pa.RecordBatch) -> Iterator[tuple]:
        for other, sets in zip(rows.column("other").to_pylist(), rows.column("sets").to_pylist()):
            on = np.frombuffer(sets, np.uint32)
            yield other, *group.some(on), nodes[on].tobytes(), b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, two in _both(batches):
            found = _cross(Group(*one[3:6]), Group(*two[3:6]), one[6], two[6], num, den)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    links_ = stage(sides(wanted, groups, F.octet_length("sets") / 32 + 1, part).mapInArrow(lean(run), "a long, b long"), "jaccard-links")
    drop_stage(wanted)
    return links_


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for the nodes of edges (a, b): large-star and small-star rounds, each staged."""
    h = F.xxhash64("u", "v")
    # tables of the same rows have the same marks; rows are distinct
    marks = lambda rows: rows.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
    both = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "jaccard-edges")
    before = marks(both)
    while True:
        # large star: larger neighbours of a node join its smallest neighbour
        around = both.select("u", "v").union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = around.join(least, around.u == least.c).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # small star: smaller neighbours of a node, and the node, join the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(low, large.u == low.c)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = stage(small, "jaccard-edges")
        now = marks(after)
        drop_stage(both)
        if now == before:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both, before = after, now


def members_of(groups: DataFrame) -> DataFrame:
    """Staged member (key), label, node, gid, n of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [raw[i : i + 16] for raw in b.column("keys").to_pylist() for i in range(0, len(raw), 16)]
            labels, nodes = joined(b.column("labels"), np.int64), joined(b.column("nodes"), np.int64)
            gids = np.repeat(np.asarray(b.column("gid")), [len(raw) // 16 for raw in b.column("keys").to_pylist()])
            sizes = joined(b.column("sizes"), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(labels), pa.array(nodes), pa.array(gids), pa.array(sizes)], ["member", "label", "node", "gid", "n"])

    return stage(groups.select("keys", "labels", "nodes", "gid", "sizes").mapInArrow(lean(run), "member binary, label long, node long, gid long, n long"), "jaccard-members")


def _linked(one: Group, two: Group, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set of either group, how many sets of the other it links with; of one group given twice, how many others."""
    same = one is two
    at = np.searchsorted(two.union, one.union)
    at[at == len(two.union)] = 0
    at[two.union[at] != one.union] = -1
    mark, starts = np.zeros(len(two.union), np.int32), two.ends - two.sizes
    n_one, n_two = np.zeros(len(one.sizes), np.int64), np.zeros(len(two.sizes), np.int64)
    for i, (end, size) in enumerate(zip(one.ends.tolist(), one.sizes.tolist())):
        found = at[one.places[end - size : end]]
        found = found[found >= 0]
        mark[found] = 1
        inter = np.add.reduceat(mark[two.places], starts)
        mark[found] = 0
        hit = (inter > 0) & (inter * (den + num) >= num * (size + two.sizes))
        if same:
            hit[: i + 1] = False
        n_one[i] += int(hit.sum())
        n_two += hit
    return n_one, n_two


def link_counts(groups: DataFrame, rooted: DataFrame, num: int, den: int) -> DataFrame:
    """Staged set, n_links for the sets with a link: how many other sets they link with. rooted: member, gid, n, root."""
    chunks = F.greatest(F.ceil(F.col("sets") / BLOCK), F.ceil(F.col("in_all") / BLOCK_TOKENS))
    many = rooted.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("in_all")).filter("sets > 1").select("root", chunks.alias("chunks"))
    dealt = rooted.join(many, "root").select("gid", F.struct("member", "root", F.pmod(F.xxhash64("member"), "chunks").alias("block")).alias("s"))
    # a group holds CHUNK sets at most
    of_group = dealt.groupBy("gid").agg(F.collect_list("s").alias("dealt"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, wanted, group in zip(b.column("keys").to_pylist(), b.column("dealt").to_pylist(), _groups_in(b)):
                nth = {keys[i : i + 16]: i // 16 for i in range(0, len(keys), 16)}
                tokens = [group.one(nth[w["member"]]).tobytes() for w in wanted]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w["root"] for w in wanted], pa.int64()), pa.array([w["block"] for w in wanted], pa.int64()), pa.array([w["member"] for w in wanted], pa.binary()), pa.array(tokens, pa.binary())],
                    ["root", "block", "member", "set"],
                )

    def gather(table: pa.Table) -> pa.Table:
        sizes, union, places = _group([np.frombuffer(x, _U) for x in table.column("set").to_pylist()])
        return pa.table({"root": table.column("root")[:1], "block": table.column("block")[:1], "sizes": [sizes], "tokens": [union], "places": [places], "keys": [b"".join(table.column("member").to_pylist())]})

    def counts(keys: bytes, n: np.ndarray) -> pa.RecordBatch:
        on = np.flatnonzero(n).tolist()
        return pa.RecordBatch.from_arrays([pa.array([keys[16 * i : 16 * i + 16] for i in on], pa.binary()), pa.array(n[on], pa.int64())], ["set", "n_links"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, block in zip(b.column("keys").to_pylist(), _groups_in(b)):
                yield counts(keys, sum(_linked(block, block, num, den)))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in zip(*(b.column(f"{c}_{f}").to_pylist() for c in "ab" for f in fields)):
                for keys, n in zip((r[3], r[7]), _linked(Group(*r[:3]), Group(*r[4:7]), num, den)):
                    yield counts(keys, n)

    fields = ("sizes", "tokens", "places", "keys")
    opened_sets = groups.select("gid", *fields).join(of_group, "gid").mapInArrow(lean(split), "root long, block long, member binary, set binary")
    opened_sets = opened_sets.repartition(partitions(groups.sparkSession), "root", "block")
    blocks = stage(opened_sets.groupBy("root", "block").applyInArrow(lean_group(gather), "root long, block long, sizes binary, tokens binary, places binary, keys binary"), "jaccard-blocks")
    found = blocks.select(*fields).mapInArrow(lean(within), "set binary, n_links long")
    pairs = blocks.select("root", F.col("block").alias("a")).join(blocks.select("root", F.col("block").alias("b")), "root").filter("a < b")
    if pairs.limit(1).count():
        side = lambda c: blocks.select("root", F.col("block").alias(c), *[F.col(f).alias(f"{c}_{f}") for f in fields])
        found = found.union(pairs.join(side("a"), ["root", "a"]).join(side("b"), ["root", "b"]).mapInArrow(lean(across), "set binary, n_links long"))
    out = stage(found.groupBy("set").agg(F.sum("n_links").alias("n_links")), "jaccard-counts")
    drop_stage(blocks)
    return out


def group_links(groups: DataFrame, members: DataFrame, num: int, den: int, buckets: int) -> DataFrame:
    """node, root of the connected nodes (nodes without links are left out)."""
    entries = matrix(groups, num, den, buckets)
    groups = stage(groups.select("gid", "sizes", "tokens", "places", "nodes").join(entries.select("gid").distinct(), "gid", "left_semi"), "jaccard-entered")
    fits = (F.col("hi_a") * den >= F.col("lo_b") * num) & (F.col("hi_b") * den >= F.col("lo_a") * num)
    of = lambda side, gid="gid", lo="lo", hi="hi": [F.col(gid).alias(side), F.col(lo).alias(f"lo_{side}"), F.col(hi).alias(f"hi_{side}")]
    centre = entries.groupBy("token").agg(F.min(F.struct("gid", "lo", "hi")).alias("c"), F.max("gid").alias("z")).filter("c.gid <> z")
    centre = centre.select("token", *of("a", "c.gid", "c.lo", "c.hi"))
    stars = stage(entries.select("token", *of("b")).join(centre, "token").filter(fits & (F.col("a") != F.col("b"))), "jaccard-stars")
    found = opened(stars, groups, num, den)
    roots = components(found)
    # a group whose nodes have one root by now is known by that root, any other by itself
    by_group = members.select("gid", "node").distinct().join(roots, "node", "left").groupBy("gid").agg(F.min(F.coalesce("root", "node")).alias("x"), F.max(F.coalesce("root", "node")).alias("y"))
    state = by_group.select(F.col("gid").alias("g"), F.when(F.col("x") == F.col("y"), F.concat(F.lit("r"), "x")).otherwise(F.concat(F.lit("g"), "gid")).alias("root"))
    rooted = entries.join(state, F.col("gid") == F.col("g")).drop("g")
    mixed = rooted.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("token")
    rest = rooted.join(mixed, "token", "left_semi")
    one, two = rest.select("token", *of("a"), F.col("root").alias("root_a")), rest.select("token", *of("b"), F.col("root").alias("root_b"))
    pairs = one.join(two, "token").filter(fits & (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b"))).drop("root_a", "root_b")
    # a pair of a star has been looked through for the sets of its token only
    pairs = stage(pairs.join(stars.select("token", "a", "b"), ["token", "a", "b"], "left_anti"), "jaccard-pairs")
    more = opened(pairs, groups, num, den)
    for done in (entries, groups, stars, pairs):
        drop_stage(done)
    if more.limit(1).count():
        return components(found.union(more))
    return roots


def duplicates(docs: DataFrame, words: int, num: int, den: int, counted: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs; if counted also n_links.

    n_links is the number of other shingle sets that link with the row's own, however many rows have them: copies
    of one text are one set. It is 0 for a row without words, without a doc_id or without such a partner.
    """
    buckets = buckets_for(docs, most=COUNTED_BYTES)
    surveyed = survey(docs, words, num, den, buckets)
    known = stage(classes(surveyed, num, den), "jaccard-classes")
    rows = stage(surveyed.filter("bucket < 0").select("doc_id", "n", "key"), "jaccard-rows")
    drop_stage(surveyed)
    sets = sets_of(docs, known.filter("hopeful > 0"), words)
    groups = groups_of(sets, num, den)
    drop_stage(sets)
    members = members_of(groups)
    roots = group_links(groups, members, num, den, buckets).withColumnRenamed("node", "linked")
    rooted = members.join(roots, F.col("node") == F.col("linked"), "left").select("member", "label", "gid", "n", F.coalesce("root", "node").alias("root"))
    numbers = link_counts(groups, rooted, num, den) if counted else None
    drop_stage(groups)
    smallest = rooted.groupBy("root").agg(F.min("label").alias("component"))
    of_set = rooted.select("member", "root").join(smallest, "root").select("member", "component")
    of_class = known.select("key", "label").join(of_set, F.col("key") == F.col("member"), "left").select(F.col("key").alias("k"), F.coalesce("component", "label").alias("component"))
    if counted:
        of_class = of_class.join(numbers, F.col("k") == F.col("set"), "left").select("k", "component", "n_links")
    # written first, so that the last join stands on two plain shuffles, which Spark splits where a key has many rows
    of_class = stage(of_class, "jaccard-components")
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("key")).alias("key"))
    number = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if counted else []
    return rows.join(of_class, F.col("key") == F.col("k"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), *number)


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(documents(spark, sf_dir), 4, 85, 100, counted=True)


QUERIES = {"op2_jaccard": op2_jaccard}
ORACLE: dict[str, str] = {}
