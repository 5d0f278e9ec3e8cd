"""Languages by the nearest of several clustered centroids per language, as cosines of normalised TF-IDF vectors of letter n-grams.

A text's words are its runs of letters, lower-cased, with a space on either side. Runs of one letter, and of two and three
characters within a word and its spaces, are counted in DIMS hashed places; a place weighs sqrt(count) * idf, and a vector has
length one. The classifier is fitted on a bounded sample: about SAMPLE different texts of each of the LANGUAGES most frequent
languages, drawn by a hash of the text. Each language's sample is clustered (spherical k-means) by a task of its own.

Rejection: each language keeps the mean and the deviation of its sample's distances (one minus cosine) from the nearest centroid. A
text that lies further off than the mean and REJECT deviations is `rejected`: of no learned language for sure. languages() gives such
texts as und if asked to; op12 names the nearest language and keeps the mark beside it.

Defined cases: a null text, or one without a letter, is und with score 0, and so is every text when nothing could be learned. Rows
with a null doc_id are learned from, and aren't held out. Null languages aren't learned; an empty string is a language like any
other. Equal texts count once in the sample. Of equally near languages the first in order is taken. Very long texts are counted
slice by slice, cut at letters' ends. An empty table gives no rows. Other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lean, release, staged

DIMS_BITS = 14
DIMS = 1 << DIMS_BITS

#: Bounds of what the classifier is fitted on, and of the model: LANGUAGES * CENTROIDS vectors of DIMS numbers.
SAMPLE, LANGUAGES = 800, 200
CENTROIDS, ROUNDS, REJECT = 4, 12, 4.0

#: Characters that are counted at once, and texts that are weighed at once.
SLICE, CHUNK = 1 << 20, 64

_SHIFT, _ODD = np.uint64(21), np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _slices(text: str) -> Iterator[str]:
    """A text in slices that end where a word does, or at SLICE characters of one word."""
    at = 0
    while len(text) - at > SLICE:
        end = at + SLICE
        while end > at and text[end].isalpha() and text[end - 1].isalpha():
            end -= 1
        end = end if end > at else at + SLICE
        yield text[at:end]
        at = end
    yield text[at:]


def grams(text: str) -> Iterator[np.ndarray]:
    """The places of a text's n-grams, a slice at a time."""
    for part in _slices(text):
        points = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.concatenate([[32], np.where(letters()[points], points, 32), [32]]).astype(np.uint64)
        space = points == 32
        keep = ~(space & np.append(False, space[:-1]))  # one space between words
        points, space = points[keep], space[keep]
        two = (points[:-1] << _SHIFT) | points[1:]
        three = (two[:-1] << _SHIFT) | points[2:]
        with np.errstate(over="ignore"):
            for codes in (points[~space], two, three[~space[1:-1]]):
                yield ((codes * _ODD) >> np.uint64(64 - DIMS_BITS)).astype(np.int64)


def counted(texts: list[str]) -> np.ndarray:
    """sqrt(count) of each place, a row for each text."""
    out = np.empty((len(texts), DIMS), np.float32)
    for k, text in enumerate(texts):
        own = np.zeros(DIMS, np.int64)
        for places in grams(text):
            own += np.bincount(places, minlength=DIMS)
        out[k] = own
    return np.sqrt(out, out=out)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    size = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(size > 0, size, 1)[:, None].astype(x.dtype)


def clustered(x: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of unit rows: centroids, and the distance of each row from its own. It starts from rows at even steps of the
    order by nearness to the mean, so that no outlier gets a centroid of its own from the start."""
    order = np.argsort(x @ unit(x.mean(axis=0, keepdims=True))[0], kind="stable")
    centroids = x[order[(np.arange(min(k, len(x))) * 2 + 1) * len(x) // (2 * min(k, len(x)))]]
    for _ in range(rounds):
        own = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        moved = np.where(sums.any(axis=1)[:, None], unit(sums), centroids)
        if np.allclose(moved, centroids, atol=1e-6):
            break
        centroids = moved
    return centroids, 1 - (x @ centroids.T).max(axis=1)


@dataclass(frozen=True)
class LanguageModel:
    names: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    limits: np.ndarray  # the largest distance that isn't rejected

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The nearest language, its cosine, and whether that is too far off."""
        names, scores, far = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        own = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.names else []
        for part in (own[k : k + CHUNK] for k in range(0, len(own), CHUNK)):
            cosines = unit(counted([texts[k] for k in part]) * self.idf) @ self.centroids.T
            best = np.argmax(cosines, axis=1)
            scores[part] = np.clip(cosines[np.arange(len(part)), best], 0, 1)
            far[part] = 1 - scores[part] > self.limits[best]
            for k, c in zip(part, best):
                names[k] = self.names[c]
        return names, scores, far


def learned(doc_id: Column) -> Column:
    """Whether a row may be learned from; the others are held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != 2, F.lit(True))


def sampled(docs: DataFrame, size: int = SAMPLE, languages: int = LANGUAGES) -> DataFrame:
    """lang and text: about so many different texts of each of the most frequent languages, by a hash of the text."""
    rows = docs.filter(learned(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("h"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("texts")).orderBy(F.desc("n"), "lang").limit(languages)
    # At most `languages` rows, with the part of the hashes that is taken.
    part = F.broadcast(sizes.select("lang", (F.lit(float(size)) / F.col("texts")).alias("part")))
    taken = (F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))) < F.col("part")
    return rows.join(part, "lang").filter(taken).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, size: int = SAMPLE, languages: int = LANGUAGES, centroids: int = CENTROIDS, reject: float = REJECT) -> LanguageModel:
    """The classifier, from text, lang and doc_id of docs."""

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [counted([t])[0] for t in b["text"]]
            places = [np.flatnonzero(r) for r in rows]
            yield pd.DataFrame({"lang": b["lang"], "places": places, "weights": [r[p] for r, p in zip(rows, places)]})

    sample = staged(sampled(docs, size, languages).mapInPandas(vectors, "lang string, places array<int>, weights array<float>"), "language-sample")
    n = sample.count()
    found = sample.select(F.explode("places").alias("place")).groupBy("place").count().collect()  # DIMS rows at most
    idf = np.full(DIMS, np.log(1.0 + n) + 1, np.float32)
    for place, docs_with in found:
        idf[place] = np.log((1.0 + n) / (1.0 + docs_with)) + 1

    def own(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(rows), DIMS), np.float32)
        for k, (p, w) in enumerate(zip(rows["places"], rows["weights"])):
            x[k, p] = w
        found, distance = clustered(unit(x * idf), centroids)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": list(found), "limit": distance.mean() + reject * distance.std()})

    rows = sample.groupBy("lang").applyInPandas(own, "lang string, centroid array<float>, limit double").collect()
    release(sample)
    rows = sorted(rows, key=lambda r: (r.lang, r.limit, r.centroid))
    return LanguageModel([r.lang for r in rows], idf, np.array([r.centroid for r in rows], np.float32).reshape(-1, DIMS), np.array([r.limit for r in rows]))


def languages(docs: DataFrame, model: LanguageModel, reject: bool = True) -> DataFrame:
    """doc_id, lang_pred, score (cosine of the nearest centroid) and rejected. With reject, rejected texts are und."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @lean()
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            names, scores, far = own.predict([None if t is None or t is pd.NA else t for t in b["text"]])
            yield pd.DataFrame({"doc_id": b["doc_id"], "lang_pred": ["und" if reject and f else x for x, f in zip(names, far)], "score": scores, "rejected": far})

    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInPandas(run, "doc_id string, lang_pred string, score double, rejected boolean")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = languages(docs, fit(docs), reject=False)
    return found.select("doc_id", (~learned(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "rejected")
