"""Quality classification by a regularised quadratic discriminant.

Each text is reduced to a dozen statistics, transformed to be roughly bell-shaped and written as a small table.
Labelled rows of that table give the class means and covariances, summed by Spark over all of them; the covariances
are shrunk towards the pooled one and towards a multiple of the identity. Their Cholesky factors are computed once
on the driver, and every document's score is the logistic of the difference of the two log densities, each from a
Mahalanobis distance solved with the cached factor, plus that of the log priors.

Defined cases: a null text counts as empty, and empty texts have statistics (and so a score) like any other. Labels
of one doc_id that contradict each other are not learned from. Without labels of both classes every score is 0.5.
Rows with equal or null doc_id are separate documents. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ROW, drop_rows, lean, numbered, owing, release, staged

_UPPER = bytes(range(65, 91))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGITS = b"0123456789"
_PLAIN = _LETTERS + _DIGITS + b" \t\n\x0b\x0c\r.,'-"

#: Number of statistics; shares of the pooled covariance and of the identity in each class's covariance.
N_STATS, TO_POOLED, TO_IDENTITY = 13, 0.1, 0.02


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    n, size = len(words), len(data)
    letters = size - len(data.translate(None, _LETTERS))
    share = lambda k, of: math.sqrt(k / of) if of else 0.0
    lengths = [*map(len, words)]
    lines = data.count(b"\n") + 1
    sentences = data.count(b".") + data.count(b"!") + data.count(b"?")
    return [
        math.log1p(n),
        math.log1p(sum(lengths) / n) if n else 0.0,
        math.log1p(max(lengths)) if n else 0.0,
        share(size - len(data.translate(None, _UPPER)), letters),
        share(size - len(data.translate(None, _DIGITS)), size),
        share(len(data.translate(None, _PLAIN)), size),
        share(len(set(words)), n),
        share(sum(map(eq, words, words[1:])), n),
        share(data.count(b"|"), n),
        share(data.count(b"!"), n),
        share(sum(k <= 3 for k in lengths), n),
        math.log1p(n / (1 + sentences)),
        math.log1p(n / lines),
    ]


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats, an array of N_STATS doubles, for each document; and ROW where docs has it."""
    more = [ROW] if ROW in docs.columns else []

    @lean()
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "stats": [statistics(t) for t in b["text"]]} | {c: b[c] for c in more})

    own = docs.select(F.col("doc_id").cast("string").alias("key"), F.coalesce("text", F.lit("")).alias("text"), *more)
    out = own.mapInPandas(run, "key string, stats array<double>" + "".join(f", {c} long" for c in more))
    return out.select(F.col("key").cast("long").alias("doc_id"), "stats", *more)


@dataclass(frozen=True)
class Discriminant:
    """means, factors (lower Cholesky), log_dets and log_priors of the classes 0 and 1; None where there is nothing to learn."""

    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    log_dets: np.ndarray | None = None
    log_priors: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), 0.5)
        density = []
        for mean, factor, log_det, log_prior in zip(self.means, self.factors, self.log_dets, self.log_priors):
            z = np.linalg.solve(factor, (x - mean).T)
            density.append(log_prior - 0.5 * (log_det + (z * z).sum(axis=0)))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """stats: doc_id, stats. labels: doc_id, quality. All rows that both have are learned from."""
    agreed = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
    rows = stats.join(agreed.filter("label = other").select("doc_id", "label"), "doc_id")
    x = [F.col("stats")[i] for i in range(N_STATS)]
    pairs = [(i, j) for i in range(N_STATS) for j in range(i + 1)]
    sums = [F.count("*"), *(F.sum(c) for c in x), *(F.sum(x[i] * x[j]) for i, j in pairs)]
    found = {r[0]: np.array(r[1:], float) for r in rows.groupBy("label").agg(*sums).collect()}
    if len(found) < 2:
        return Discriminant()
    counts, means, scatters = [], [], []
    for label in (0, 1):
        n, mean = found[label][0], found[label][1 : 1 + N_STATS] / found[label][0]
        second = np.zeros((N_STATS, N_STATS))
        for (i, j), v in zip(pairs, found[label][1 + N_STATS :]):
            second[i, j] = second[j, i] = v / n
        counts.append(n)
        means.append(mean)
        scatters.append(second - np.outer(mean, mean))
    pooled = np.average(scatters, axis=0, weights=counts)
    factors = []
    for own in scatters:
        shrunk = (1 - TO_POOLED) * own + TO_POOLED * pooled
        level = max(np.trace(shrunk) / N_STATS, 1e-9)
        factors.append(np.linalg.cholesky((1 - TO_IDENTITY) * shrunk + TO_IDENTITY * level * np.eye(N_STATS)))
    log_dets = np.array([2 * np.log(np.diag(f)).sum() for f in factors])
    return Discriminant(np.array(means), np.array(factors), log_dets, np.log(np.array(counts) / sum(counts)))


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document (and ROW where docs has it); held-out labels are not learned from."""
    more = [ROW] if ROW in docs.columns else []
    stats = staged(text_statistics(docs), "text-statistics")
    model = fit(stats.filter(~F.coalesce(held_out(), F.lit(False))), labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"key": b["key"], "score": model.score(np.stack(b["stats"].to_numpy()))} | {c: b[c] for c in more})

    scored = stats.select(F.col("doc_id").cast("string").alias("key"), "stats", *more).mapInPandas(run, "key string, score double" + "".join(f", {c} long" for c in more))
    scored = scored.select(F.col("key").cast("long").alias("doc_id"), "score", *more)
    out = scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *more)
    return owing(out, stats)


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents that are rejected."""
    rows = numbered(docs)
    scored = quality_scores(rows, labels)
    gone = staged(scored.filter("predicted = 0").select(ROW), "rejected")
    release(scored)
    return drop_rows(rows, gone, gone.count())


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
