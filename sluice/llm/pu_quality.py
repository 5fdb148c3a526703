"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) are set against unlabelled web text.  The share of positives in the unlabelled text is
estimated first: a positive-against-unlabelled classifier ranks both, and the share is the least ratio of their masses above a
score (with a margin for the sample's size).  Then a linear model over binned features minimises the non-negative unbiased risk

    prior * loss(positives, +1) + max(0, loss(unlabelled, -1) - prior * loss(positives, -1)),

stepping back along the second part where it falls below zero.  The labelled rows that may be learned from set the scale of the scores.

The features are shapes of the text alone (shares of letter cases, marks, repeats, line and word lengths), over whole
texts.  Models are fitted on the driver from samples whose sizes are parameters; only feature rows go there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.arrays import chunks, lists, words
from sluice.llm.labelled import held_out, sample, texts_of, trained

#: Rows sampled to fit: trusted positives, unlabelled texts, labelled rows for the scale.
POSITIVES, UNLABELLED, SCALED = 12_000, 24_000, 12_000
BINS = 10
STEPS = 300


def features(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, features) of a chunk; an empty text has zeros."""
    w = words(data, starts)
    n, texts = np.diff(w.at), len(starts) - 1
    doc = np.repeat(np.arange(texts), n)
    size = (w.end - w.start).astype(np.float64)
    kind = np.zeros(256, dtype=np.uint8)  # 1 capital, 2 small, 3 digit, 4 mark, 5 beyond ASCII
    kind[65:91], kind[97:123], kind[48:58], kind[128:] = 1, 2, 3, 5
    kind[[c for c in range(33, 127) if not chr(c).isalnum()]] = 4
    of = kind[data]

    def per_text(flag):
        total = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
        return np.diff(total[starts]).astype(np.float64)

    def per_word(value):
        return np.bincount(doc, weights=value, minlength=texts)

    def span(flag):  # how many bytes of each word have it
        total = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
        return total[w.end] - total[w.start]

    marks, capitals, small = span(of == 4), span(of == 1), span(of == 2)
    last = of[w.end - 1] == 4 if len(w.end) else np.zeros(0, bool)
    before = (of[np.maximum(w.end - 2, 0)] == 4) & (size > 1) if len(w.end) else last
    again, pair = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    pair[2:] = (w.hash[2:] == w.hash[:-2]) & (doc[2:] == doc[:-2])
    order = np.lexsort((w.hash, doc))
    new = np.ones(len(doc), bool)
    new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=texts).astype(np.float64)
    lines = per_text(data == 10) + 1
    m, b = np.maximum(n, 1).astype(np.float64), np.maximum(np.diff(starts), 1).astype(np.float64)
    mean = per_word(size) / m
    cols = [
        np.log1p(n), mean, np.sqrt(np.maximum(per_word(size ** 2) / m - mean ** 2, 0)),
        per_text(of == 1) / b, per_text(of == 3) / b, per_text(of == 4) / b, per_text(of == 5) / b,
        per_word(marks == size) / m, per_word(last) / m, per_word(last & before) / m,
        per_word((capitals > 1) & (small == 0)) / m, per_word(marks > 0) / m,
        per_word(again) / m, per_word(pair) / m, distinct / m, np.log1p(n) * distinct / m, lines / m, np.log1p(n / lines),
    ]
    out = np.stack(cols, axis=1)
    out[n == 0] = 0
    return out


def _feature_rows(batches):
    for batch in batches:
        for row, data, starts in chunks(batch.column("text")):
            f = features(data, starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("kind").slice(row, len(f)), lists(f.reshape(-1), np.arange(len(f) + 1) * f.shape[1], pa.float64())], names=["kind", "f"])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Binned:
    """One-hot quantile bins of each feature."""

    def __init__(self, rows: np.ndarray, bins: int = BINS):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in rows.T]
        self.width = sum(len(e) + 1 for e in self.edges)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        out, at = np.zeros((len(rows), self.width)), 0
        for c, e in zip(rows.T, self.edges, strict=True):
            # Ties with an edge fall below it, so a value that most texts share has a bin of its own.
            out[np.arange(len(rows)), at + np.searchsorted(e, c, side="left")] = 1
            at += len(e) + 1
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights (the last for the constant) by Newton's method."""
    a, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled, from scores under which positives rank high: the least ratio of the masses
    above a score, each within a margin of its sample's size."""
    p, u = np.sort(positive), np.sort(unlabelled)
    at = np.unique(p)
    above_p = 1 - np.searchsorted(p, at, side="left") / len(p)
    above_u = 1 - np.searchsorted(u, at, side="left") / len(u)
    margin = np.sqrt(np.log(20) / (2 * len(p))) + np.sqrt(np.log(20) / (2 * len(u)))
    ok = above_p >= min(8 * margin, 0.5)
    best = np.argmin(((above_u + margin) / above_p)[ok])
    return float(np.clip(above_u[ok][best] / above_p[ok][best], 0.05, 0.98))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior from rows that the ranking classifier was not fitted on: it is fitted on every second one."""
    a, b = positive[::2], unlabelled[::2]
    w = logistic(np.concatenate([a, b]), np.concatenate([np.ones(len(a)), np.zeros(len(b))]), ridge=5.0)[:-1]
    rest_p, rest_u = (positive[1::2], unlabelled[1::2]) if min(len(positive), len(unlabelled)) > 1 else (a, b)
    return class_prior(rest_p @ w, rest_u @ w)


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = 0.05, decay: float = 1e-2) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk with the sigmoid loss (Adam, whole batches)."""
    a, b = np.c_[positive, np.ones(len(positive))], np.c_[unlabelled, np.ones(len(unlabelled))]
    w = np.zeros(a.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        sp, su = sigmoid(a @ w), sigmoid(b @ w)
        slope_p, slope_u = (sp * (1 - sp)) @ a / len(a), (su * (1 - su)) @ b / len(b)
        rest = su.mean() - prior * sp.mean()  # loss(unlabelled, -1) - prior * loss(positives, -1)
        grad_rest = slope_u - prior * slope_p
        grad = -prior * slope_p + grad_rest if rest >= 0 else -grad_rest
        grad = grad + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def _collected(rows: DataFrame) -> dict[str, np.ndarray]:
    found: dict[str, list] = {}
    for r in rows.mapInArrow(_feature_rows, "kind string, f array<double>").toLocalIterator():
        found.setdefault(r["kind"], []).append(r["f"])
    return {k: np.array(v) for k, v in found.items()}


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", seed: int = 11):
    """The scoring function over feature rows, and the estimated prior.  Without positives every score is 0."""
    known = trained(labels, label)
    good = sample(known.where("label = 1").select("doc_id"), POSITIVES, seed).withColumn("kind", F.lit("positive"))
    scaled = sample(known, SCALED, seed + 1).select("doc_id", F.when(F.col("label") == 1, "scale1").otherwise("scale0").alias("kind"))
    web = sample(docs.where("doc_id IS NOT NULL").select("doc_id").distinct(), UNLABELLED, seed + 2).withColumn("kind", F.lit("unlabelled"))
    chosen = good.unionByName(scaled).unionByName(web)  # bounded by the three sample sizes
    got = _collected(texts_of(docs, chosen, "kind").select("kind", "text"))
    p, u = got.get("positive"), got.get("unlabelled")
    if p is None or u is None:
        return (lambda f: np.zeros(len(f))), 0.0
    binned = Binned(u)
    xp, xu = binned(p), binned(u)
    prior = estimated_prior(xp, xu)
    w = fit_pu(xp, xu, prior)
    one, none = got.get("scale1"), got.get("scale0")
    slope = np.array([1.0, 0.0])
    if one is not None and none is not None:
        g = np.concatenate([binned(one), binned(none)]) @ w[:-1] + w[-1]
        slope = logistic(g[:, None], np.concatenate([np.ones(len(one)), np.zeros(len(none))]), ridge=1e-3)
        if slope[0] <= 0:
            slope = np.array([1.0, 0.0])
    return (lambda f: sigmoid((binned(f) @ w[:-1] + w[-1]) * slope[0] + slope[1])), prior


def _scored(score, at: int, name: str):
    def run(batches):
        for batch in batches:
            out = [score(features(data, starts)) for _, data, starts in chunks(batch.column(at))]
            column = pa.array(np.concatenate(out) if out else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])
    return run


def with_score(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, label: str = "quality") -> tuple[DataFrame, str]:
    """``docs`` with a score from 0 to 1 for every row, learned from ``corpus`` (else ``docs``) and ``labels``, and the new column's
    name (``score``, with underscores in front while ``docs`` has such a column).

    A null text scores as an empty one.  Rows without id are scored and never learned from; repeated rows score alike, and of the
    rows under one id the least text alone is learned from.
    """
    corpus = docs if corpus is None else corpus
    score, _ = fit_quality(corpus.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, label)
    name = "score"
    while name.lower() in [c.lower() for c in docs.columns]:
        name = "_" + name
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(_scored(score, docs.columns.index("text"), name), schema), name


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    scored, name = with_score(docs.select("doc_id", "text"), labels)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), name, (F.col(name) >= threshold).cast("int").alias("predicted"))
