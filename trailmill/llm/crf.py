"""A linear-chain conditional random field with two labels, stepped through many chains at once.

A chain's position has an emission: the log-odds of label 1 against 0 from its
features. Forward and backward recursions keep ratios of label 1 to label 0, so
they need no scaling: with transition factors T and g = exp(emission),

    r[t] = g[t] (T01 + r[t-1] T11) / (T00 + r[t-1] T10)
    s[t] = (T10 + T11 g[t+1] s[t+1]) / (T00 + T01 g[t+1] s[t+1])
    P(label 1 at t) = r[t] s[t] / (1 + r[t] s[t])
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, time_major

CLIP = 18.0


@dataclass
class Chain:
    """Transition log-weights (2 x 2) and the log-odds of label 1 at the start."""

    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def ratios(self, emission: np.ndarray, plan: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """g, r and s in step order."""
        _, order, starts, alive = plan
        t00, t01, t10, t11 = np.exp(self.transitions).ravel()
        g = np.exp(np.clip(emission, -CLIP, CLIP))[order]
        r, s = g.copy(), np.ones_like(g)
        bounds = starts.tolist()
        for t in range(1, len(alive)):
            a, b = bounds[t], bounds[t + 1]
            before = r[bounds[t - 1] : bounds[t - 1] + b - a]
            r[a:b] *= (t01 + before * t11) / (t00 + before * t10)
        for t in range(len(alive) - 1, 0, -1):
            a, b = bounds[t], bounds[t + 1]
            x = g[a:b] * s[a:b]
            s[bounds[t - 1] : bounds[t - 1] + b - a] = (t10 + t11 * x) / (t00 + t01 * x)
        return g, r, s

    def marginals(self, emission: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """P(label 1) at each position, in the order given."""
        plan = time_major(lengths[lengths > 0])
        _, r, s = self.ratios(emission, plan)
        out = np.empty(len(emission))
        odds = r * s
        out[plan[1]] = odds / (1 + odds)
        return out

    def pairs(self, plan: tuple, g: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Expected counts of the four transitions."""
        _, _, starts, alive = plan
        if len(alive) < 2:
            return np.zeros((2, 2))
        later = np.arange(starts[1], starts[-1])
        step = np.repeat(np.arange(1, len(alive)), alive[1:])
        earlier = starts[step - 1] + later - starts[step]
        t = np.exp(self.transitions)
        x, q = g[later] * s[later], r[earlier]
        w = np.stack([np.full(len(x), t[0, 0]), t[0, 1] * x, t[1, 0] * q, t[1, 1] * q * x])
        return (w / w.sum(axis=0)).sum(axis=1).reshape(2, 2)


def observed_pairs(y: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Counts of the four transitions between neighbouring labels of a chain."""
    ends = np.cumsum(lengths[lengths > 0])[:-1]
    inside = np.ones(max(0, len(y) - 1), bool)
    inside[ends - 1] = False
    a, b = y[:-1][inside].astype(int), y[1:][inside].astype(int)
    return np.bincount(2 * a + b, minlength=4).reshape(2, 2).astype(float)


def fit(emit, gradient, parameters: list[np.ndarray], y: np.ndarray, lengths: np.ndarray, rounds: int, rate: float, decay: float) -> Chain:
    """Raise the likelihood of the labels by AdaGrad steps.

    emit(): emissions from the parameters as they are; gradient(d): the
    parameters' gradients for a gradient d by emission. Both work on the arrays
    in parameters, which change in place.
    """
    lengths = lengths[lengths > 0]
    chain, plan = Chain(), time_major(lengths)
    seen = observed_pairs(y, lengths)
    sums = [np.full_like(p, 1e-8) for p in parameters]
    t_sum = np.full((2, 2), 1e-8)
    for _ in range(rounds):
        g, r, s = chain.ratios(emit(), plan)
        odds = r * s
        p = np.empty(len(y))
        p[plan[1]] = odds / (1 + odds)
        for value, total, d in zip(parameters, sums, gradient(y - p)):
            d = d - decay * value
            total += d * d
            value += rate * d / np.sqrt(total)
        d = seen - chain.pairs(plan, g, r, s) - decay * chain.transitions
        t_sum += d * d
        chain.transitions = np.clip(chain.transitions + 0.5 * rate * d / np.sqrt(t_sum), -6, 6)
    return chain


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (the last is the constant) of a logistic regression by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
    return w


#: Positions of a chain that is trained on at most: longer ones are cut, and no part is left out.
CHAIN = 512


def cut(lengths: np.ndarray, most: int = CHAIN) -> np.ndarray:
    """Lengths of the parts, one after the other, that chains of these lengths are cut into."""
    whole, rest = lengths // most, lengths % most
    parts = np.repeat(np.array([most, 0])[None, :], len(lengths), axis=0)
    parts[:, 1] = rest
    return np.repeat(parts.ravel(), np.column_stack([whole, rest > 0]).ravel())


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, rows: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights of a bounded training sample.

    At most rows / 2 documents of each label, the first by a hash of doc_id, from
    labelled rows outside the held-out fold, with their whole texts. Of rows with
    one doc_id the first by text counts. Weights restore the labels' shares among
    all such rows.
    """
    known = labels.select("doc_id", F.col(label).alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", modulus) != held))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)
        chosen = part if chosen is None else chosen.unionByName(part)
    # the chosen rows are bounded by the parameter, so their broadcast is too
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").collect()
    first: dict[int, tuple[str, int]] = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["text"] or "")):
        first.setdefault(r["doc_id"], (r["text"], r["y"]))
    y = np.array([v for _, v in first.values()], float)
    weight = np.array([shares[int(v)] / max(1, (y == v).sum()) for v in y])
    return [t for t, _ in first.values()], y, weight / max(weight.mean(), 1e-12) if len(weight) else weight
