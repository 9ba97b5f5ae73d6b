"""Toxicity by cumulative-link ordinal regression on sparse text features.

``P(grade > k) = logistic(w . x - t_k)`` with one weight vector for all grades and ordered
thresholds ``t_0 < t_1 < ...``.  The expected severity is the sum of these probabilities; a
document is toxic when ``P(grade > 0)`` is at least a half.

Features are a document's lower-case words and the beginnings of its longer words, so that
inflected forms share weight; the value is ``log(1 + occurrences)``.  The telling
ones get a weight: those in at least ``MIN_DOCS`` documents of a label whose smoothed share of documents
differs between the labels by ``MIN_LOG`` on the logarithmic scale.  The rule does not depend on the number of
labelled rows; how much a feature counts is left to the penalised fit.

The model is fitted on a bounded sample of labelled rows: at most ``SAMPLE`` toxic and as
many other documents, those with the smallest hash of their key; each stands for as many labelled rows
of its label as there are to one in the sample, so the cut means the same at every size.  Everything else
covers all rows.  Labels have two values, so severity grades within the toxic sample come from the number
of occurrences of telling features, cut at its terciles: grade 0 is not toxic, 1 to 3 are mild
to severe.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Largest number of labelled documents of each label in the fit.
SAMPLE = 4000
#: Lengths of word beginnings that are features.
BEGINNINGS = (4, 5, 6)
#: A feature is telling from this logarithm of the ratio of its shares, and must be in so many documents
#: of the label that it tells.
MIN_LOG, MIN_DOCS = 2.0, 2
GRADES = 4
RIDGE = 1e-4
STEPS = 400

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """A word and its beginnings, each marked so that they differ from the word itself."""
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


def features(text: str | None) -> Counter:
    """Occurrences of every feature in a whole text."""
    out: Counter = Counter()
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        for f in word_features(word):
            out[f] += n
    return out


class OrdinalModel:
    """Weights by feature and the ordered thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: list[float]) -> None:
        self.weights, self.thresholds = weights, thresholds

    def score(self, text: str | None) -> float:
        seen: Counter = Counter()
        get = self.weights.get
        for word, n in Counter(_WORD.findall((text or "").lower())).items():
            for f in word_features(word):
                if get(f) is not None:
                    seen[f] += n
        return float(sum(self.weights[f] * np.log1p(n) for f, n in seen.items()))

    def exceed(self, scores: np.ndarray) -> np.ndarray:
        """``P(grade > k)``: a row per score, a column per threshold."""
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - scores[:, None], -50, 50)))


def grade(heavy: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0 for what is not toxic; 1 to 3 by terciles of ``heavy``, the occurrences of telling features."""
    cuts = np.quantile(heavy[toxic], [1 / 3, 2 / 3]) if toxic.any() else [0, 0]
    return np.where(toxic, 1 + (heavy > cuts[0]) + (heavy > cuts[1]), 0)


def fit_ordinal(docs: list[tuple[int, dict[str, int]]], chosen: dict[str, float], rows_of: tuple[float, float] = (1, 1)) -> OrdinalModel:
    """Fit on (toxic 0/1, occurrences of chosen features) by gradient steps on the penalised
    log-likelihood; ``chosen`` has the logarithm of the ratio of shares of each feature,
    ``rows_of`` how many rows a document of each label stands for.

    With one label only, or no telling feature, nothing is toxic."""
    if len({y for y, _ in docs}) < 2 or not chosen:
        return OrdinalModel({}, [50.0] * (GRADES - 1))
    names = sorted(chosen)
    at = {f: k for k, f in enumerate(names)}
    cells = sorted((k, at[f], n) for k, (_, own) in enumerate(docs) for f, n in own.items())
    row, col, times = (np.array([c[j] for c in cells], np.int64) for j in range(3))
    val = np.log1p(times.astype(float))
    toxic, telling = np.array([y for y, _ in docs]) == 1, np.array([chosen[f] > 0 for f in names])
    y = grade(np.bincount(row, times * telling[col], len(docs)), toxic)
    n, m, cuts = len(docs), len(names), GRADES - 1
    weight = np.where(toxic, rows_of[1], rows_of[0])
    weight = weight / weight.mean()
    params = np.zeros(m + cuts)  # weights, the first threshold, then logarithms of the steps to the next ones
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, STEPS + 1):
        w, t = params[:m], params[m] + np.concatenate([[0], np.cumsum(np.exp(params[m + 1:]))])
        score = np.bincount(row, val * w[col], n)
        s = 1 / (1 + np.exp(np.clip(t[None, :] - score[:, None], -50, 50)))  # P(y > k)
        upper = np.where(y == 0, 1.0, s[np.arange(n), np.maximum(y - 1, 0)])
        lower = np.where(y == cuts, 0.0, s[np.arange(n), np.minimum(y, cuts - 1)])
        p = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = weight * upper * (1 - upper) / p, weight * lower * (1 - lower) / p
        d_score = d_upper - d_lower
        d_t = np.array([(d_lower[y == k]).sum() - (d_upper[y == k + 1]).sum() for k in range(cuts)])
        grad = np.concatenate([
            np.bincount(col, val * d_score[row], m) / n - RIDGE * w,
            [d_t.sum() / n],
            [d_t[k + 1:].sum() / n * np.exp(params[m + 1 + k]) for k in range(cuts - 1)]])
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        params = params + 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    t = params[m] + np.concatenate([[0], np.cumsum(np.exp(params[m + 1:]))])
    return OrdinalModel(dict(zip(names, map(float, params[:m]), strict=True)), [float(x) for x in t])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most ``sample`` documents of each label.

    Rows of ``labels`` with a null key or label are left out; of several labels of a key the
    largest counts.  Of several rows of a key the smallest text is fitted, and each row counts in its label's weight."""
    truth = (labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull())
             .groupBy(F.col(key).alias("_key")).agg(F.when(F.max("toxic") > 0, 1).otherwise(0).alias("_toxic")))
    keys = docs.select(F.col(key).alias("_key")).join(truth, "_key").select("_key", "_toxic")
    by_hash = [F.xxhash64("_key"), F.col("_key")]
    distinct = keys.distinct()
    sampled = materialise(distinct.where("_toxic = 1").orderBy(*by_hash).limit(sample)
                          .union(distinct.where("_toxic = 0").orderBy(*by_hash).limit(sample)))  # at most 2 * sample rows
    size = {r["_toxic"]: r["count"] for r in sampled.groupBy("_toxic").count().collect()}
    labelled = {r["_toxic"]: r["count"] for r in keys.groupBy("_toxic").count().collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    of = sampled.select(F.col("_key").alias("of"), F.col("_toxic").alias("toxic"))
    # the texts of the sample only, one for each key, written once for both passes
    rows = materialise(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(of), F.col("key") == F.col("of"))
                       .groupBy("key", "toxic").agg(F.min("text").alias("text")))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Toxic and other documents of the task with each feature."""
        seen = (Counter(), Counter())
        for batch in batches:
            for y, t in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen[1 - y].update(features(t).keys())
        names = sorted({*seen[0], *seen[1]})
        for at in range(0, len(names), 10_000):
            some = names[at:at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([c[f] for f in some], pa.int64()) for c in seen)],
                                             ["feature", "a", "b"])

    ratio = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    telling = (rows.mapInArrow(frequencies, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
               .select("feature", ratio.alias("ratio"), F.when(ratio > 0, F.col("a")).otherwise(F.col("b")).alias("n"))
               .where((F.col("n") >= MIN_DOCS) & (F.abs("ratio") >= MIN_LOG)))  # features of a bounded number of texts
    weights = {r["feature"]: r["ratio"] for r in telling.collect()} if n0 and n1 else {}
    if not weights:
        return fit_ordinal([], {})
    table = docs.sparkSession.sparkContext.broadcast(weights)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(str(v), y, {f: n for f, n in features(t).items() if f in table.value})
                     for v, y, t in zip(*(batch.column(c).to_pylist() for c in ("key", "toxic", "text")), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v for v, _, _ in found], pa.string()), pa.array([y for _, y, _ in found], pa.int32()),
                 pa.array([list(own.items()) for _, _, own in found], pa.map_(pa.string(), pa.int64()))], ["key", "toxic", "own"])

    docs_ = [(r["key"], r["toxic"], sorted(r["own"].items())) for r in rows.mapInArrow(occurrences, "key string, toxic int, own map<string,bigint>").collect()]
    held = Counter(y for _, y, _ in docs_)
    return fit_ordinal([(y, dict(own)) for _, y, own in sorted(docs_)], weights, tuple(labelled[y] / held[y] for y in (0, 1)))


def judge(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """``docs`` with ``severity`` (expected grade), ``grade`` (the most probable) and ``toxic``.

    A null or empty text, or one without known features, has the score zero, whose probabilities the
    thresholds give.  Columns of ``docs`` with the new names are replaced."""
    new = ("severity", "grade", "toxic")
    keep = [f for f in docs.schema.fields if f.name not in new]
    names = [f.name for f in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "severity double, grade int, toxic boolean"])
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel(*shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                above = own.exceed(np.array([own.score(t) for t in part.column(text).to_pylist()], float))
                each = np.concatenate([np.ones((len(above), 1)), above], axis=1) - np.concatenate([above, np.zeros((len(above), 1))], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*part.select(names).columns, pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1), pa.int32()), pa.array(above[:, 0] >= 0.5)],
                    [*names, *new])

    return docs.select(*names).mapInArrow(scored, schema)


def without_toxic(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic; columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel(*shared.value)
        for batch in batches:
            scores = np.array([own.score(t) for t in batch.column(text).to_pylist()], float)
            yield batch.take(pa.array(np.flatnonzero(own.exceed(scores)[:, 0] < 0.5))).select(names)

    return docs.mapInArrow(clean, docs.schema)
