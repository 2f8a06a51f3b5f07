"""Language-model scores from a hidden Markov model trained by Baum-Welch.

Words are tied into a bounded number of classes: the most frequent words have a
class each, all others fall into classes by hash. Hidden states emit classes, and
a class emits its words by their smoothed counts, so

    log P(text) = log P(classes of the text; HMM) + sum of log P(word | class)

is the exact likelihood of the text under one hidden Markov model over an open
vocabulary. The first term comes from the scaled forward recursion, stepped
through many texts at once. Baum-Welch runs over all training texts: each
partition sums its expected counts, and the sums are added across partitions in
two levels, by slices of the parameter vector.

Word counts are exact and distributed (a row of packed arrays for each bucket of
word hashes). Counts of the most frequent words (HEAD, a bound) are sent to the
executors; rarer words of the texts are dealt to the buckets and looked up there,
so neither driver nor broadcast grows with the vocabulary. Words are told apart
by 64-bit hashes.

The states' first guess is a clustering of all training texts by their frequent
classes: a seeded random direction for each state deals the texts, then a few
rounds of spherical k-means, each a pass that adds up the states' class counts.
Baum-Welch goes on until a round gains less than TOLERANCE per token, or for
MOST_ROUNDS. Counts, expected counts and scores take every text.

Edge cases: a null or empty text is just the end token; a null doc_id counts as
the empty text in the fold; repeated rows count and are scored each; with no
training text N is 0, V is 0 and every token has base 1; a text of any length is
one sequence; extra columns, whatever their names, are cut before they come here.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, crc_mod, documents, joined, pack, room, slices, stage, time_major, words_of

STATES = 6
#: Words whose counts are sent to the executors, words with a class of their own, classes of the others.
HEAD, OWN, HASHED = 1 << 19, 24_000, 4096
CLASSES = OWN + HASHED
#: log10 likelihood a token gains in the last round but one at least, and rounds at most.
TOLERANCE, MOST_ROUNDS = 0.005, 6
#: Classes that texts are clustered by, rounds of clustering, and words in slices of texts worked on at once.
FREQUENT, CLUSTERINGS, SLICE_WORDS = 1500, 3, 400_000
#: Partitions whose vectors one task adds up.
FAN = 128
#: Words a map task counts before it sends them: about 150 bytes each.
COUNTED = room(150)
#: Words' worth of the unigram distribution in a state's emissions.
PRIOR = 200.0
#: The end token's key: no word is empty.
END = b""
_SLICE = 16_384
_CUTS = "slice long, salt long, v binary"
_U, _D = np.uint64, np.float64


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def word_counts(train: DataFrame, buckets: int) -> DataFrame:
    """bucket, hashes, counts (packed, hashes ascending), distinct, tokens: all words and end tokens of train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            h = np.fromiter(map(_hash, seen), _U, len(seen))
            rows = list(pack((h % _U(buckets)).astype(np.int64), h, np.fromiter(seen.values(), np.int64, len(seen))))
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "hashes", "counts"])

        for whole in batches:
            for b in slices(whole):
                for text in b.column("text").to_pylist():
                    seen.update(words_of(text))
                    seen[END] += 1
                if len(seen) > COUNTED:
                    yield flush()
        if seen:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        h, c = joined(table.column("hashes"), _U), joined(table.column("counts"), np.int64)
        words, at = np.unique(h, return_inverse=True)
        total = np.bincount(at, c, len(words)).astype(np.int64)
        return pa.table({"bucket": [table.column("bucket")[0].as_py()], "hashes": [words.tobytes()], "counts": [total.tobytes()], "distinct": [len(words)], "tokens": [int(total.sum())]})

    partial = train.select("text").mapInArrow(run, "bucket long, hashes binary, counts binary")
    return partial.groupBy("bucket").applyInArrow(merge, "bucket long, hashes binary, counts binary, distinct long, tokens long")


@dataclass
class Vocabulary:
    """Hashes (ascending), counts and classes of the frequent words; N, V; tokens and words of the hashed classes."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    n: int
    v: int
    class_tokens: np.ndarray
    class_words: np.ndarray
    unigram: np.ndarray

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of a token's add-one probability from its count."""
        return np.log10((counts + 1) / (self.n + 1 * (self.v + 1)))

    def within(self, hashed: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 P(word | hashed class)."""
        return np.log10((counts + 1) / (self.class_tokens[hashed] + self.class_words[hashed] + 1))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """What is sent to the executors: bounded by HEAD and CLASSES."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column("counts").to_pylist():
                e, n = np.unique(np.log2(np.frombuffer(c, np.int64)).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()), pa.array(n, pa.int64())], ["e", "n"])

    total = counts.agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v")).first()
    by_size = {r["e"]: r["n"] for r in counts.select("counts").mapInArrow(sizes, "e long, n long").groupBy("e").agg(F.sum("n").alias("n")).collect()}
    least, held = 64, 0
    while least > 0 and held + by_size.get(least - 1, 0) <= HEAD:
        least -= 1
        held += by_size.get(least, 0)
    floor = 1 << least

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, c in zip(b.column("hashes").to_pylist(), b.column("counts").to_pylist()):
                h, c = np.frombuffer(h, _U), np.frombuffer(c, np.int64)
                on = c >= floor
                yield pa.RecordBatch.from_arrays([pa.array([h[on].tobytes()], pa.binary()), pa.array([c[on].tobytes()], pa.binary())], ["h", "c"])

    got = counts.select("hashes", "counts").mapInArrow(frequent, "h binary, c binary").collect()
    h = np.frombuffer(b"".join(r["h"] for r in got), _U)
    c = np.frombuffer(b"".join(r["c"] for r in got), np.int64)
    order = np.argsort(h)
    h, c = h[order], c[order]
    by_count = np.lexsort((h, -c, h != _U(_hash(END))))  # the end token first
    own = by_count[:OWN]
    classes = OWN + (h % _U(HASHED)).astype(np.int64)
    classes[own] = np.arange(len(own))
    own_hashes = np.sort(h[own])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * HASHED)
        for b in batches:
            for hb, cb in zip(b.column("hashes").to_pylist(), b.column("counts").to_pylist()):
                hh, cc = np.frombuffer(hb, _U), np.frombuffer(cb, np.int64)
                rest = ~np.isin(hh, own_hashes)
                k = (hh[rest] % _U(HASHED)).astype(np.int64)
                total += np.concatenate([np.bincount(k, cc[rest], HASHED), np.bincount(k, minlength=HASHED)])
        yield from _cut(total)

    both = _add_up(counts.select("hashes", "counts").mapInArrow(hashed, _CUTS))
    tokens, words = (both[:HASHED], both[HASHED:]) if len(both) else (np.zeros(HASHED), np.zeros(HASHED))
    mass = np.concatenate([np.zeros(OWN), tokens + 1])
    mass[: len(own)] = c[own] + 1
    return Vocabulary(h, c, classes.astype(np.uint16), int(total["n"] or 0), int(total["v"] or 0), tokens, words, mass / mass.sum())


def encode(docs: DataFrame, sent, buckets: int) -> DataFrame:
    """Staged rows of two kinds: texts as classes with what frequent words add, and packed rare words by bucket."""
    schema = "bucket long, row long, doc_id long, held_out boolean, n_tokens long, known long, base double, within double, classes binary, hashes binary, rows binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc: Vocabulary = sent.value
        row = TaskContext.get().partitionId() << 40
        end_hash = _hash(END)
        for whole in batches:
            for b in slices(whole):
                index: dict[bytes, int] = {END: 0}
                put = index.setdefault
                texts = [[put(w, len(index)) for w in words_of(t)] + [0] for t in b.column("text").to_pylist()]
                lengths = np.array([len(t) for t in texts])
                flat = np.fromiter((i for t in texts for i in t), np.int64, int(lengths.sum()))
                h = np.fromiter(map(_hash, index), _U, len(index))
                h[0] = _U(end_hash)
                at = np.minimum(np.searchsorted(voc.hashes, h), max(0, len(voc.hashes) - 1))
                head = voc.hashes[at] == h if len(voc.hashes) else np.zeros(len(h), bool)
                count = np.where(head, voc.counts[at], 0) if len(voc.hashes) else np.zeros(len(h))
                hashed = (h % _U(HASHED)).astype(np.int64)
                cls = np.where(head, voc.classes[at], OWN + hashed) if len(voc.hashes) else OWN + hashed
                base = np.where(head, voc.base(count), 0.0)
                within = np.where(head & (cls >= OWN), voc.within(hashed, count), 0.0)
                starts = np.cumsum(lengths) - lengths
                rows = row + np.arange(len(texts))
                row += len(texts)
                codes = cls.astype(np.uint16)[flat]
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1] * n, pa.int64()), pa.array(rows, pa.int64()), b.column("doc_id"), b.column("held_out"), pa.array(lengths, pa.int64()), pa.array(np.add.reduceat(head[flat].astype(np.int64), starts)), pa.array(np.add.reduceat(base[flat], starts)), pa.array(np.add.reduceat(within[flat], starts)), pa.array([codes[s : s + k].tobytes() for s, k in zip(starts.tolist(), lengths.tolist())], pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())],
                    names,
                )
                rare = np.flatnonzero(~head[flat])
                if len(rare):
                    word = h[flat[rare]]
                    packed = list(pack((word % _U(buckets)).astype(np.int64), word, np.repeat(rows, lengths)[rare]))
                    k = len(packed)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p[0] for p in packed], pa.int64()), *[pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())], pa.array([p[1] for p in packed], pa.binary()), pa.array([p[2] for p in packed], pa.binary())],
                        names,
                    )

    return stage(docs.mapInArrow(run, schema), "hmm-classes")


def rare_words(coded: DataFrame, counts: DataFrame, sent) -> DataFrame:
    """row, known, base, within: sums over a text's rare words, looked up in the buckets of the counts."""

    def look_up(table: pa.Table) -> pa.Table:
        voc: Vocabulary = sent.value
        words, total = joined(table.column("hashes").filter(table.column("counts").is_valid()), _U), joined(table.column("counts"), np.int64)
        asked = table.filter(table.column("rows").is_valid())
        h, rows = joined(asked.column("hashes"), _U), joined(asked.column("rows"), np.int64)
        order = np.argsort(words)
        words, total = words[order], total[order]
        if len(words):
            at = np.minimum(np.searchsorted(words, h), len(words) - 1)
            c = np.where(words[at] == h, total[at], 0)
        else:
            c = np.zeros(len(h), np.int64)
        texts, where = np.unique(rows, return_inverse=True)
        add = lambda x: np.bincount(where, x, len(texts)).astype(_D)
        return pa.table({"row": texts, "known": add((c > 0).astype(_D)).astype(np.int64), "base": add(voc.base(c)), "within": add(voc.within((h % _U(HASHED)).astype(np.int64), c))})

    asked = coded.filter("bucket >= 0").select("bucket", "hashes", F.lit(None).cast("binary").alias("counts"), "rows")
    known = counts.select("bucket", "hashes", "counts", F.lit(None).cast("binary").alias("rows"))
    found = known.unionByName(asked).groupBy("bucket").applyInArrow(look_up, "row long, known long, base double, within double")
    return found.groupBy("row").agg(*[F.sum(c).alias(f"rare_{c}") for c in ("known", "base", "within")])


@dataclass
class Hmm:
    """Start and transition probabilities; emissions by class (rows) and state."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def forward(self, codes: np.ndarray, lengths: np.ndarray, keep: bool = False) -> tuple:
        """log10 likelihood of each sequence; with keep also what the backward pass needs."""
        plan = time_major(lengths)
        by_length, order, starts, alive = plan
        e = self.emit[codes[order]].astype(_D)
        scale = np.empty(len(order))
        alpha = e if keep else None
        if keep:
            alpha = np.empty_like(e)
        bounds = starts.tolist()
        a = self.start * e[: bounds[1]]
        for t in range(len(alive)):
            low, high = bounds[t], bounds[t + 1]
            if t:
                a = (a[: high - low] @ self.move) * e[low:high]
            s = a.sum(axis=1)
            a = a / s[:, None]
            scale[low:high] = s
            if keep:
                alpha[low:high] = a
        step = np.arange(len(order)) - np.repeat(starts[:-1], alive)
        likelihood = np.empty(len(lengths))
        likelihood[by_length] = np.bincount(step, np.log10(scale), len(lengths))
        return (likelihood, plan, e, scale, alpha) if keep else (likelihood,)

    def expect(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Expected counts of starts, moves and emissions, in one vector, with the likelihood at the end."""
        likelihood, (_, order, starts, alive), e, scale, alpha = self.forward(codes, lengths, True)
        k = len(self.start)
        moves = np.zeros((k, k))
        gamma = alpha  # becomes alpha * beta from the last step back
        bounds = starts.tolist()
        b = np.ones((int(alive[-1]), k))
        for t in range(len(alive) - 1, 0, -1):
            low, high = bounds[t], bounds[t + 1]
            x = e[low:high] * b / scale[low:high, None]
            before = gamma[bounds[t - 1] : bounds[t - 1] + high - low]
            moves += before.T @ x
            gamma[low:high] *= b
            b = np.ones((int(alive[t - 1]), k))
            b[: high - low] = x @ self.move.T
        gamma[: bounds[1]] *= b
        seen = codes[order]
        emitted = np.stack([np.bincount(seen, gamma[:, j], CLASSES) for j in range(k)], axis=1)
        return np.concatenate([gamma[: bounds[1]].sum(axis=0), (moves * self.move).ravel(), emitted.ravel(), [likelihood.sum()]])

    @staticmethod
    def of(counts: np.ndarray, unigram: np.ndarray, k: int) -> "Hmm":
        """Parameters from (expected) counts."""
        start = counts[:k] + 1
        move = counts[k : k + k * k].reshape(k, k) + 1
        emit = counts[k + k * k : k + k * k + CLASSES * k].reshape(CLASSES, k) + PRIOR * unigram[:, None]
        return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), (emit / emit.sum(axis=0)).astype(np.float32))


def _groups(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of about the same length together: places in the batch, their classes, their lengths."""
    raw = b.column("classes").to_pylist()
    sizes = np.array([len(r) // 2 for r in raw])
    order = np.argsort(-sizes, kind="stable")
    cuts = np.cumsum(sizes[order]) // SLICE_WORDS
    for part in np.split(order, np.flatnonzero(np.diff(cuts)) + 1):
        if len(part):
            yield part, np.frombuffer(b"".join(raw[i] for i in part), np.uint16), sizes[part]


def _shape(histograms: np.ndarray) -> np.ndarray:
    """Unit vectors of the roots of class counts (rows); the end token's class plays no part."""
    x = np.sqrt(histograms.astype(_D))
    x[:, 0] = 0
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def first_guess(train: DataFrame, unigram: np.ndarray) -> Hmm:
    """States from clusters of all training texts."""
    sc = train.sparkSession.sparkContext
    centres = np.random.default_rng(7).standard_normal((STATES, FREQUENT))
    counts = np.zeros((STATES, CLASSES))
    for _ in range(1 + CLUSTERINGS):
        sent = sc.broadcast(centres)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros((STATES, CLASSES))
            some = False
            for b in batches:
                for raw in np.array_split(np.array(b.column("classes").to_pylist(), object), -(-b.num_rows // 1000) or 1):
                    texts = [np.frombuffer(r, np.uint16) for r in raw]
                    if texts:
                        near = (_shape(np.stack([np.bincount(t[t < FREQUENT], minlength=FREQUENT) for t in texts])) @ sent.value.T).argmax(axis=1)
                        for j in np.unique(near).tolist():
                            total[j] += np.bincount(np.concatenate([t for t, k in zip(texts, near) if k == j]), minlength=CLASSES)
                        some = True
            if some:
                yield from _cut(total.ravel())

        got = _add_up(train.select("classes").mapInArrow(run, _CUTS))
        sent.unpersist()
        if not len(got):
            break
        counts = got.reshape(STATES, CLASSES)
        lively = counts[:, :FREQUENT].sum(axis=1) > 0
        centres = np.where(lively[:, None], _shape(counts[:, :FREQUENT]), centres)
    move = np.full((STATES, STATES), 1.0) + np.eye(STATES) * 200
    return Hmm.of(np.concatenate([np.full(STATES, 1.0), move.ravel(), counts.T.ravel()]), unigram, STATES)


def _cut(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A partition's vector in slices."""
    cuts = [total[i : i + _SLICE].tobytes() for i in range(0, len(total), _SLICE)]
    part = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int64()), pa.array([part] * len(cuts), pa.int64()), pa.array(cuts, pa.binary())], ["slice", "salt", "v"])


def _add_up(parts: DataFrame) -> np.ndarray:
    """Sum the partitions' vectors slice by slice, FAN of them in a task, twice; the driver adds the few that are left."""

    def total(table: pa.Table) -> pa.Table:
        v = sum(np.frombuffer(x, _D) for x in table.column("v").to_pylist())
        return pa.table({"slice": [table.column("slice")[0].as_py()], "salt": [table.column("salt")[0].as_py() // FAN], "v": [v.tobytes()]})

    for _ in range(2):
        parts = parts.groupBy("slice", F.floor(F.col("salt") / FAN)).applyInArrow(total, _CUTS)
    out: dict[int, np.ndarray] = {}
    for r in parts.collect():
        v = np.frombuffer(r["v"], _D)
        out[r["slice"]] = out[r["slice"]] + v if r["slice"] in out else v
    return np.concatenate([out[k] for k in sorted(out)]) if out else np.zeros(0)


def baum_welch(train: DataFrame, model: Hmm, unigram: np.ndarray, tokens: int, rounds: int = MOST_ROUNDS) -> Hmm:
    """Rounds of expectation over all training texts and maximisation on the driver (vectors of bounded size)."""
    sc = train.sparkSession.sparkContext
    before = -np.inf
    for _ in range(rounds):
        sent = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for _, codes, lengths in _groups(b):
                    got = sent.value.expect(codes, lengths)
                    total = got if total is None else total + got
            if total is not None:
                yield from _cut(total)

        total = _add_up(train.select("classes").mapInArrow(run, _CUTS))
        sent.unpersist()
        if not len(total):
            break
        model = Hmm.of(total, unigram, STATES)
        if total[-1] - before < TOLERANCE * tokens:
            break
        before = total[-1]
    return model


def likelihoods(coded: DataFrame, model: Hmm) -> DataFrame:
    """The texts' rows with hmm, the log10 likelihood of their classes."""
    sent = coded.sparkSession.sparkContext.broadcast(model)
    kept = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "within"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = np.empty(b.num_rows)
                for at, codes, lengths in _groups(b):
                    out[at] = sent.value.forward(codes, lengths)[0]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(out)], [*kept, "hmm"])

    return coded.select(*kept, "classes").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, within double, hmm double")


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for docs (doc_id, text, held_out)."""
    spark = docs.sparkSession
    buckets = buckets_for(docs)
    counts = stage(word_counts(docs.filter(~F.col("held_out")), buckets), "hmm-counts")
    voc = vocabulary(counts)
    sent = spark.sparkContext.broadcast(voc)
    coded = encode(docs, sent, buckets)
    texts = coded.filter("bucket < 0")
    train = texts.filter(~F.col("held_out"))
    model = baum_welch(train, first_guess(train, voc.unigram), voc.unigram, voc.n)
    rare = rare_words(coded, counts, sent)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return likelihoods(texts, model).join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("rare_known")).alias("n_known"), F.lit(voc.n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"), (F.col("hmm") + F.col("within") + zero("rare_within")).alias("score"),
    )


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_mod("doc_id", 7) == 2).alias("held_out")))


QUERIES = {"op5_hmm": op5_hmm}
ORACLE: dict[str, str] = {}
