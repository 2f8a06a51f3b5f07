"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad from features of itself and of the lines
before and after it. Training labels a line as its document is labelled.
Forward-backward marginals, weighted by line length, average to the share of
good text, which a logistic function turns into the document's score.

Training takes a bounded sample (TRAIN_ROWS labelled rows); scoring takes every
line of every text, where it is; there is no shuffle.

Edge cases: a null or empty text is one empty line; without labelled rows of both
kinds every score is 0.5; repeated label rows of a document count once, good if
any is; of rows with one doc_id and different texts the first by text is trained
on, and each is scored; a null doc_id is scored and never trained on; a text of
any length is one chain; extra columns, whatever their names, are cut first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf
from .common import crc_mod, documents, slices

#: Labelled rows trained on at most (scoring has no such bound).
TRAIN_ROWS = 3000
ROUNDS = 120
#: From this score on a document counts as good.
GOOD = 0.7
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"%*$&#@!|<>{}[]=~^_\\/+"
_PIPE = b"|"
_STOP = b".,;:?!"
_HIGH = bytes(range(128, 256))
FEATURES = 12


def line_features(line: bytes) -> tuple[float, ...]:
    """What a line looks like, as numbers of about the same size."""
    n = len(line)
    if not n:
        return (0.0,) * (FEATURES - 1) + (1.0,)
    left = lambda drop: (n - len(line.translate(None, drop))) / n
    words = line.split()
    k = len(words)
    upper, lower = left(_UPPER), left(_LOWER)
    same = sum(map(eq, words, words[1:])) / (k - 1) if k > 1 else 0.0
    return (
        min(upper, 0.5) * 4, lower, left(_DIGIT) * 4, min(left(_SYMBOL), 0.25) * 8, min(left(_PIPE), 0.1) * 20, left(_STOP) * 8, left(_HIGH) * 2,
        same, 1 - len(set(words)) / k if k else 1.0, min(k, 64) / 64, min(n / k, 24) / 24 if k else 0.0, 0.0,
    )


def _matrix(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line with those of its neighbours, lines of each text, length of each line."""
    rows, counts, sizes = [], [], []
    for t in texts:
        lines = (t or "").encode("utf-8", "surrogatepass").split(b"\n")
        counts.append(len(lines))
        for line in lines:
            rows.append(line_features(line))
            sizes.append(len(line) + 1)
    own, lengths = np.array(rows), np.array(counts)
    ends = np.cumsum(lengths)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[ends - lengths] = 0
    after[ends - 1] = 0
    return np.hstack([own, before, after, np.ones((len(own), 1))]), lengths, np.array(sizes, float)


@dataclass
class Model:
    """Weights by feature, chain, and (slope, constant) of the document's logistic function."""

    weights: np.ndarray
    chain: crf.Chain
    document: np.ndarray


def _share(p: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals of each text, as log-odds kept within 6."""
    starts = np.cumsum(lengths) - lengths
    mean = np.add.reduceat(p * sizes, starts) / np.add.reduceat(sizes, starts)
    return np.clip(np.log((mean + 1e-4) / (1 - mean + 1e-4)), -6, 6)


def train(docs: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2) -> Model:
    """Fit features and chain on line labels, then the document's logistic function."""
    texts, y, weight = crf.sample(docs, labels, "quality", modulus, held, TRAIN_ROWS)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(3 * FEATURES + 1), crf.Chain(), np.zeros(2))
    x, lengths, sizes = _matrix(texts)
    w = np.zeros(x.shape[1])
    chain = crf.fit(lambda: x @ w, lambda d: [d @ x], [w], np.repeat(y, lengths), crf.cut(lengths), ROUNDS, 0.3, 0.05)
    p = chain.marginals(x @ w, lengths)
    return Model(w, chain, crf.logistic(_share(p, lengths, sizes)[:, None], y, weight))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, lines and bad lines of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in batches:
            for b in slices(whole):
                x, lengths, sizes = _matrix(b.column("text").to_pylist())
                p = m.chain.marginals(x @ m.weights, lengths)
                got = 1 / (1 + np.exp(-np.clip(_share(p, lengths, sizes) * m.document[0] + m.document[1], -30, 30)))
                bad = np.add.reduceat((p < 0.5).astype(np.int64), np.cumsum(lengths) - lengths)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.float64()), pa.array((got >= GOOD).astype(np.int32)), pa.array(lengths, pa.int64()), pa.array(bad, pa.int64())], ["doc_id", "score", "predicted", "n_lines", "n_bad_lines"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int, n_lines long, n_bad_lines long")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "n_lines", "n_bad_lines")


QUERIES = {"op8_quality": op8_quality}
ORACLE: dict[str, str] = {}
