"""Toxic spans by a linear-chain conditional random field over words.

Tokens are labelled from labelled documents: a word of a toxic document counts as
toxic if it, or its first four to eight characters, stands in toxic training
documents significantly more often than the documents of similar vocabulary let
expect, tested anew among the toxic documents that no form found so far explains;
no share of all is asked for, so a language with few of the toxic rows gets its
forms too. The chain's emissions add learned
weights of the word, its beginnings and both neighbours. Forward-backward
marginals of all words of a text give the document's score (a logistic function
of the logarithm of their sum, faint ones left out, and of their maximum) and its offending spans.

Training takes a bounded sample (TRAIN_ROWS labelled rows); scoring takes every
word of every text. Weights are a table of fixed size, so what is sent to the
executors does not grow with the data; rows stay in their partitions.

Edge cases: a null or empty text has no words and gets the score of no toxic
word; without labelled rows of both kinds every score is 0; repeated label rows
of a document count once, toxic if any is; of rows with one doc_id and different
texts the first by text is trained on, and each is scored; a null doc_id is scored
and never trained on; a text of any length is one chain when scored, and is
trained on whole, cut into chains of bounded length; extra columns are cut first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf
from .common import SLICE_BYTES, bound_batches, crc_mod, documents, lean, mix, room, slices, words_of

#: Labelled rows trained on at most (scoring has no such bound).
TRAIN_ROWS = 2400
TABLE = 1 << 18
ROUNDS = 30
#: Lengths of the word beginnings that are forms of a word.
PREFIXES = (4, 5, 6, 7, 8)
#: False discovery rate of the forms that mark toxic documents, and how many times the expected odds they have at least.
FALSE_RATE, TIMES = 0.05, 8
#: Toxic documents a form must stand in, copies counted once.
LEAST = 3
#: Marginals below this do not count in the sum of a text.
FAINT = 0.1
_EDGE = b".,;:!?%*$&#|()[]{}<>\"'"
_WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def _forms(word: bytes) -> tuple[bytes, ...]:
    """The word without punctuation around it, and its first four to eight characters if it goes on after them."""
    core = word.strip(_EDGE) or word
    if core.isascii():
        return (b"w" + core, *(b"p" + core[:n] for n in PREFIXES if len(core) > n))
    text = core.decode("utf-8", "replace")
    return (b"w" + core, *(b"p" + text[:n].encode() for n in PREFIXES if len(text) > n))


@dataclass
class Model:
    """Weights by slot for a word itself, for the word before and the word after; chain; document weights."""

    own: np.ndarray
    near: np.ndarray
    bias: float
    chain: crf.Chain
    document: np.ndarray
    trained: bool = True


class _Values:
    """Weights of words, remembered: its own, as the word before, as the word after."""

    #: A word, its place and its three weights take about 230 bytes.
    MOST = room(230)

    def __init__(self, model: Model):
        self.model = model
        self.places: dict[bytes, int] = {}
        self.weights = np.zeros((3, 0), np.float32)

    def of(self, words: list[bytes]) -> np.ndarray:
        """Three rows, a column for each of the words; those not met yet are looked up together."""
        fresh = [w for w in dict.fromkeys(words) if w not in self.places]
        if len(self.places) + len(fresh) > self.MOST:
            self.places, self.weights = {}, self.weights[:, :0]
            fresh = list(dict.fromkeys(words))
        if fresh:
            hashes = _form_hashes(fresh)
            slots = hashes & np.uint64(TABLE - 1)
            own = self.model.own[slots]
            own[:, 1:] *= hashes[:, 1:] != hashes[:, :1]
            self.places.update(zip(fresh, range(len(self.places), len(self.places) + len(fresh))))
            self.weights = np.concatenate([self.weights, np.stack([own.sum(axis=1), *self.model.near[:, slots[:, 0]]])], axis=1)
        return self.weights[:, np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))]


def _emission(words: list[bytes], lengths: np.ndarray, values: _Values, bias: float) -> np.ndarray:
    """Emissions of the words of many texts, one after the other."""
    own, before, after = values.of(words).astype(float)
    ends = np.cumsum(lengths)
    first, last = (ends - lengths)[lengths > 0], (ends - 1)[lengths > 0]
    before, after = np.roll(before, 1), np.roll(after, -1)
    before[first] = 0
    after[last] = 0
    return own + bias + before + after


def _document_features(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log(1 + sum of the marginals from FAINT on) and largest marginal of each text.

    The many smaller marginals of a long clean text would add up to a toxic word.
    """
    out = np.zeros((len(lengths), 2))
    some = np.flatnonzero(lengths > 0)
    if len(some):
        starts = (np.cumsum(lengths) - lengths)[some]
        out[some, 0] = np.log1p(np.add.reduceat(np.where(p >= FAINT, p, 0), starts))
        out[some, 1] = np.maximum.reduceat(p, starts)
    return out


def _form_hashes(words: list[bytes]) -> np.ndarray:
    """A row for each word: hashes of its forms, the first one again where there are fewer."""
    digest, width = xxhash.xxh3_64_intdigest, 1 + len(PREFIXES)
    out: list[int] = []
    for w in words:
        got = [digest(f) for f in _forms(w)]
        out += got
        out += got[:1] * (width - len(got))
    return np.array(out, np.uint64).reshape(-1, width)


def _distinct(texts: list[np.ndarray], hashes: np.ndarray) -> list[int]:
    """Texts (indices of words) that share none of three minima of hashed word pairs with an earlier one: one of each group of near copies."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for i, t in enumerate(texts):
        h = hashes[t]
        pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) > 1 else h
        marks = {(k, int(mix(pairs ^ np.uint64(0x5851F42D4C957F2D * (k + 1) & (1 << 64) - 1)).min()) if len(pairs) else 0) for k in range(3)}
        if not marks & seen:
            kept.append(i)
        seen |= marks
    return kept


def _expected(forms: np.ndarray, owner: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Toxic and clean documents with each of n forms, and the toxic share to expect there.

    A document's expected share is that of the other documents, each counted as often
    as it shares a form with it; a form's is the mean of its documents', at least the
    share among all.
    """
    a, both = np.bincount(forms, y[owner], n), np.bincount(forms, minlength=n)
    own, docs = y[owner], len(y)
    rate = y.sum() / docs
    toxic, others = np.bincount(owner, a[forms] - own, docs), np.bincount(owner, both[forms] - 1, docs)
    share = (toxic + rate) / (others + 1)
    return a, both - a, np.maximum(rate, np.bincount(forms, share[owner], n) / np.maximum(both, 1))


def _significant(a: np.ndarray, b: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Forms in a toxic and b clean documents that stand in toxic ones too often for the share expected.

    The bound exp(-KL) of the binomial tail stands for the probability; the step-up
    rule of Benjamini and Hochberg with FALSE_RATE goes over all forms of these toxic
    documents that occur often enough to be able to pass. Fewer than LEAST documents are no repeated evidence: all
    words of a single one would pass or fail together.
    """
    rate = np.clip(rate, 1e-9, 1 - 1e-9)
    able = np.flatnonzero((a > 0) & ((a + b) * -np.log(rate) >= -np.log(FALSE_RATE)))
    x, y, r = a[able], b[able], rate[able]
    share = x / (x + y)
    log_p = np.where(share > r, -x * np.log(share / r) - y * np.log(np.maximum(1 - share, 1e-300) / (1 - r)), 0.0)
    ranked = np.sort(log_p)
    passed = np.flatnonzero(ranked <= np.log(FALSE_RATE * np.arange(1, len(able) + 1) / max(1, len(able))))
    out = np.zeros(len(a), bool)
    if len(passed):
        out[able] = (x >= LEAST) & (log_p <= ranked[passed[-1]]) & (x * (1 - r) > TIMES * (y + 0.25) * r)
    return out


def _token_labels(texts: list[list[bytes]], y: np.ndarray) -> np.ndarray:
    """1 for words of toxic documents of which a form marks toxic documents.

    Forms are tested in rounds, each among the toxic documents without a form of an
    earlier round and the clean ones, until no more are explained; copies count once.
    """
    known: dict[bytes, int] = {}
    places = [np.array([known.setdefault(w, len(known)) for w in t], np.int64) for t in texts]
    return _marked(places, _form_hashes(list(known)), y)


def _marked(texts: list[np.ndarray], hashes: np.ndarray, y: np.ndarray) -> np.ndarray:
    """_token_labels() of texts given as indices of words, and the hashes of each word's forms."""
    if not len(hashes):
        return np.zeros(0)
    found, at = np.unique(hashes, return_inverse=True)
    form = at.reshape(hashes.shape)
    kept = _distinct(texts, hashes[:, 0])
    rows = [np.unique(form[texts[i]]) for i in kept]
    marked = np.zeros(len(found), bool)
    left = [(row, float(y[i])) for row, i in zip(rows, kept) if len(row)]
    while any(label for _, label in left):
        forms, labels = np.concatenate([row for row, _ in left]), np.array([label for _, label in left])
        a, b, rate = _expected(forms, np.repeat(np.arange(len(left)), [len(row) for row, _ in left]), labels, len(found))
        a[marked] = 0
        marked |= _significant(a, b, rate)
        after = [(row, label) for row, label in left if not (label and marked[row].any())]
        if len(after) == len(left):
            break
        left = after
    toxic = marked[form].any(axis=1)
    return np.concatenate([toxic[t] & bool(label) for t, label in zip(texts, y)]).astype(float)


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> Model:
    """Fit words and chain on token labels, then the document's logistic function."""
    texts, y, weight = crf.sample(docs, labels, "toxic", modulus, held, TRAIN_ROWS)
    empty = Model(np.zeros(TABLE, np.float32), np.zeros((2, TABLE), np.float32), 0.0, crf.Chain(), np.zeros(3), False)
    if len(set(y.tolist())) < 2:
        return empty
    known: dict[bytes, int] = {}
    words = [np.array([known.setdefault(w, len(known)) for w in words_of(t)], np.int32) for t in texts]
    lengths = np.array([len(w) for w in words])
    index = np.concatenate(words)
    if not len(index):
        return empty
    hashes = _form_hashes(list(known))
    tokens = _marked(words, hashes, y)
    slots = (hashes & np.uint64(TABLE - 1)).astype(np.int32)
    weighs = np.ones(slots.shape, np.float32)
    weighs[:, 1:] = hashes[:, 1:] != hashes[:, :1]
    del hashes, words
    ends = np.cumsum(lengths)
    first, last = (ends - lengths)[lengths > 0], (ends - 1)[lengths > 0]
    own, near, bias = np.zeros(TABLE), np.zeros((2, TABLE)), np.full(1, -4.0)
    core = slots[:, 0]

    def emit() -> np.ndarray:
        e = (own[slots] * weighs).sum(axis=1)[index] + bias[0]
        before, after = np.roll(near[0][core][index], 1), np.roll(near[1][core][index], -1)
        before[first] = 0
        after[last] = 0
        return e + before + after

    def gradient(d: np.ndarray) -> list[np.ndarray]:
        by_word = np.bincount(index, d, len(known))
        g_own = np.bincount(slots.ravel(), (weighs * by_word[:, None]).ravel(), TABLE)
        to_before, to_after = np.roll(d, -1), np.roll(d, 1)
        to_before[last] = 0
        to_after[first] = 0
        g_near = np.stack([np.bincount(core, np.bincount(index, x, len(known)), TABLE) for x in (to_before, to_after)])
        return [g_own, g_near, np.array([d.sum()])]

    chain = crf.fit(emit, gradient, [own, near, bias], tokens, crf.cut(lengths), ROUNDS, 0.5, 0.05)
    model = Model(own.astype(np.float32), near.astype(np.float32), float(bias[0]), chain, np.zeros(3))
    p = chain.marginals(emit(), lengths)
    model.document = crf.logistic(_document_features(p, lengths), y, weight)
    return model


def _scores(texts: list[str | None], values: _Values) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document scores, marginals of all words, words of each text."""
    m = values.model
    words = [words_of(t) for t in texts]
    lengths = np.array([len(w) for w in words])
    flat = [w for ws in words for w in ws]
    p = m.chain.marginals(_emission(flat, lengths, values, m.bias), lengths) if flat else np.zeros(0)
    f = np.column_stack([_document_features(p, lengths), np.ones(len(texts))])
    score = 1 / (1 + np.exp(-np.clip(f @ m.document, -30, 30)))
    return score if m.trained else np.zeros(len(texts)), p, lengths


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, spans (start:end:probability of words with a marginal of at least a half, by code point)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = _Values(sent.value)
        for whole in batches:
            for b in slices(whole, limit=SLICE_BYTES // 2):
                texts = b.column("text").to_pylist()
                got, p, lengths = _scores(texts, values)
                spans = [""] * len(texts)
                ends = np.cumsum(lengths)
                hits = np.flatnonzero(p >= 0.5)
                owners = np.searchsorted(ends, hits, side="right")
                for i in np.unique(owners).tolist():
                    at = [m.span() for m in _WORD.finditer(texts[i])]
                    own = hits[owners == i]
                    spans[i] = ",".join("{}:{}:{:.3f}".format(*at[j - ends[i] + lengths[i]], p[j]) for j in own.tolist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.float64()), pa.array((got >= 0.5).astype(np.int32)), pa.array(spans, pa.string())], ["doc_id", "score", "predicted", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, score double, predicted int, spans string")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text is not predicted toxic, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = _Values(sent.value)
        for whole in batches:
            for b in slices(whole, limit=SLICE_BYTES // 2):
                got, _, _ = _scores(b.column("text").to_pylist(), values)
                yield b.filter(pa.array(got < 0.5))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(lean(run), docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "spans")


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE: dict[str, str] = {}
