"""MLR1 to MLR4: a small logistic model fitted on the driver, applied as one SQL expression."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sampling

# Descent and thresholds.
RATE, EPOCHS, L2 = 0.05, 2000, 0.05
EASY, MEDIUM = 0.75, 0.35
#: Rows a fit collects at most, the first in hash order; applying the model covers every row.
MAX_ROWS = 4000


@dataclass(frozen=True)
class Model:
    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float
    version: str

    def probability(self) -> Column:
        """MLR2: probability of success; null where a feature is null."""
        terms = [(F.col(f).cast("double") - m) / s * w for f, m, s, w in zip(self.features, self.means, self.scales, self.weights)]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-sum(terms, F.lit(self.intercept))))


def samples(df: DataFrame, key: str, features: list[str], label: str, valid: Column, seed: str = "fit") -> DataFrame:
    """MLR4: rows of valid attempts with all features and a label."""
    whole = valid
    for f in features:
        whole = whole & F.col(f).isNotNull()
    return df.filter(whole & F.col(label).isNotNull()).select(key, *[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("int").alias(label)).orderBy(sampling.digest(seed, F.col(key)), key).limit(MAX_ROWS)


def fit(rows: DataFrame, key: str, features: list[str], label: str) -> Model:
    """MLR1: full-batch descent from zero on standardised features (population deviation, 1 if it is 0)."""
    got = rows.orderBy(key, *features).toPandas()
    y = got[label].to_numpy(float)
    if len(y) < 2 or y.min() == y.max():
        raise ValueError("a fit needs rows of both labels")
    raw = got[features].to_numpy(float)
    mean, scale = raw.mean(axis=0), raw.std(axis=0)
    scale[scale == 0] = 1.0
    x = (raw - mean) / scale
    w, b = np.zeros(len(features)), 0.0
    for _ in range(EPOCHS):
        error = 1.0 / (1.0 + np.exp(-np.clip(x @ w + b, -700, 700))) - y
        b -= RATE * error.mean()
        w = w - RATE * (x.T @ error / len(y) + L2 * w)
    seen = [[str(k), int(t), *[round(v, 9) for v in r]] for k, t, r in zip(got[key], y, raw.tolist())]
    text = json.dumps([features, RATE, EPOCHS, L2, seen, [round(v, 9) for v in w.tolist()], round(float(b), 9)])
    return Model(tuple(features), tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()), float(b), hashlib.sha256(text.encode()).hexdigest()[:16])


def label_of(p: Column) -> Column:
    """MLR2: easy, medium or hard."""
    return F.when(p >= EASY, "easy").when(p >= MEDIUM, "medium").when(p.isNotNull(), "hard")


def scored(df: DataFrame, model: Model) -> DataFrame:
    """MLR2: score (1 - p) and difficulty of every row."""
    p = model.probability()
    return df.withColumn("score", 1 - p).withColumn("difficulty", label_of(p))


def validated(rows: DataFrame, key: str, group: str, features: list[str], label: str, seed: str, share: float = 0.2) -> tuple[Model, dict]:
    """MLR3: fit on some groups, measure log loss and accuracy on the others, fit again on all."""
    held = sampling.fraction(seed, F.col(group)) < share
    first = fit(rows.filter(~held), key, features, label)
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), first.probability()))
    loss = F.avg(-F.when(F.col(label) == 1, F.ln(p)).otherwise(F.ln(1 - p)))
    m = rows.filter(held).agg(F.count("*").alias("n"), loss.alias("log_loss"), F.avg(((p >= 0.5).cast("int") == F.col(label)).cast("double")).alias("accuracy")).first().asDict()
    return fit(rows, key, features, label), {k: v if v is not None else math.nan for k, v in m.items()}
