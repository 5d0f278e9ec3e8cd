"""Substring deduplication: passages that repeat across or within documents.

A paragraph is a line of MIN_WORDS words or more, or neighbouring shorter lines joined: a block of them ends behind a
blank line, or a line chosen by its own content (one in four), once it has MIN_WORDS words. Paragraphs are sketched as
five-word shingle sets and banded for high recall: 14 bands of 3 rows let a pair of similarity 0.75 meet with
probability 0.9995. Colliding paragraphs are joined, their exact Jaccard similarity is verified, and similar ones form
components. Of a component the paragraph with the least (doc_id, place) stays; the others are removals.

Bands, neighbours in large buckets, and components work as for whole documents (see minhash).

Runs are passages that repeat word for word (A-Z as a-z, any white space between words), however lines are broken. Of
each RUN_WORDS - MIN_WORDS + 1 neighbouring windows of MIN_WORDS words the one with the least hash is chosen, so texts
that share RUN_WORDS words choose a window in common; many shorter runs are found as well. Windows that were chosen
more than once are grouped by 64-bit hash and confirmed by another hash of 31 bits, and overlapping ones of a document are merged. A run's ends may lie up to
RUN_WORDS - MIN_WORDS words inside the shared passage.

Defined cases: null and empty texts have no paragraphs; less than MIN_WORDS words are never removed. Paragraphs of a null
doc_id stay only where no other can. Documents with equal doc_id and a repeated paragraph at one place count as two paragraphs.
An empty table gives no rows. Columns other than doc_id and text are ignored by repeats() and kept by remove_repeats(),
which cuts paragraphs out and leaves runs inside other lines.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import BROADCAST_IDS, lean, looked_up, owing, release, staged
from .elias_fano import U
from .minhash import SIGNED, SIGNED_TYPES, Banding, near_classes, shingles_of, signed
from .sp_sampling import mixed
from .word_hashes import word_hashes, word_places

#: Least words of a paragraph that may be removed; the banding of paragraphs.
MIN_WORDS = 30
_BASE, _OTHER_BASE = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
#: Words of a verbatim run that is found for certain, wherever lines are broken.
RUN_WORDS = 50
#: Bytes of texts whose words are taken together: few enough for the processor's cache.
CHUNK_BYTES = 250_000
PARAGRAPHS = Banding(bands=14, rows=3, least_agreement=0.4)


def spans(n_words: list[int], ends: Callable[[int], bool], min_words: int) -> Iterator[tuple[int, int]]:
    """First and last line of each paragraph of a text. n_words: of each line; ends: whether a line's content ends a block."""
    start, n = None, 0
    for place, own in enumerate(n_words):
        if own >= min_words:
            yield place, place
            start, n = None, 0
            continue
        if own:
            start, n = place if start is None else start, n + own
        if n >= min_words and (not own or ends(place)):
            yield start, place
            start, n = None, 0
    if n >= min_words:
        yield start, place


def _blocks(data: bytes, sizes: list[int], starts: np.ndarray, min_words: int) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """The paragraphs of texts of so many bytes, joined to data by line breaks, whose words begin at starts: (text, first line, last
    line), first and last line counted in data, and the places of each line of data and, last, of one beyond it."""
    lines = np.concatenate([[0], np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1, [len(data) + 1]])
    n_words = np.diff(np.searchsorted(starts, lines)).tolist()
    texts = np.searchsorted(lines, np.cumsum([0, *(n + 1 for n in sizes)])).tolist()
    at = lines.tolist()
    found, where = [], []
    for k, (i, j) in enumerate(pairwise(texts)):
        for first, last in spans(n_words[i:j], lambda line: zlib.crc32(data[at[i + line] : at[i + line + 1] - 1]) % 4 == 0, min_words):
            found.append((k, first, last))
            where.append((i + first, i + last))
    first, last = np.array(where, np.int64).reshape(-1, 2).T
    return found, first, last, lines


def _paragraph_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """key (doc_id) and text of the documents that may have paragraphs."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.col("text"))
    return own.filter(F.length("text") >= 2 * min_words - 1)


def _parts(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """Ranges of texts of about CHUNK_BYTES, and these texts joined by line breaks."""
    part = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) // CHUNK_BYTES
    for i, j in pairwise([0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]):
        if i < j:
            yield i, j, b"\n".join(texts[i:j])


def paragraphs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """key (doc_id, first and last line), text: the paragraphs of at least so many words."""

    @lean()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column("key").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()
            for i, j, data in _parts(texts):
                found, first, last, lines = _blocks(data, [*map(len, texts[i:j])], word_places(data)[0], min_words)
                own = [data[x : z - 1] for x, z in zip(lines[first].tolist(), lines[last + 1].tolist())]
                yield pa.RecordBatch.from_arrays([_keys(keys[i:j], found), pa.array(own, pa.binary()).cast(pa.string())], names=["key", "text"])

    return _paragraph_rows(docs, min_words).mapInArrow(run, "key string, text string")


def _keys(keys: list[str], found: list[tuple[int, int, int]]) -> pa.Array:
    return pa.array([f"{keys[k]}:{first}:{last}" for k, first, last in found], pa.string())


def paragraph_signatures(docs: DataFrame, min_words: int, how: Banding) -> DataFrame:
    """The signatures of paragraphs(docs), in one pass over the documents' words."""

    @lean()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column("key").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()
            for i, j, data in _parts(texts):
                low = data.lower()
                w, starts = word_hashes(low)
                found, first, last, lines = _blocks(data, [*map(len, texts[i:j])], starts, min_words)
                first, end = np.searchsorted(starts, lines[first]), np.searchsorted(starts, lines[last + 1])
                made = signed(*shingles_of(low, w, starts, first, end, how.words), how.bands, how.rows)
                yield pa.RecordBatch.from_arrays([_keys(keys[i:j], found), *made], names=["key", *SIGNED])

    made = _paragraph_rows(docs, min_words).mapInArrow(run, f"key string, {SIGNED_TYPES}")
    return made.select("key", F.monotonically_increasing_id().alias("row_id"), *SIGNED)


def _identity() -> Column:
    parts = F.split("key", ":")
    own = F.when(parts[0] != "", parts[0]).cast("long")
    return F.struct(own.isNull().alias("unknown"), own.alias("doc_id"), parts[1].cast("long").alias("place"), parts[2].cast("long").alias("last"))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, how: Banding = PARAGRAPHS) -> DataFrame:
    """doc_id, paragraph, n_shingles, keep_id, keep_paragraph, removed, last_paragraph: for each paragraph that has a similar one."""
    found = near_classes(paragraphs(docs, min_words), _identity(), how, paragraph_signatures(docs, min_words, how))
    rows = staged(found.select(_identity().alias("own"), "n_shingles", "lowest"), "paragraph-classes")
    release(found)
    # A hot passage's rows are counted with partial aggregation; the counts of repeated ones alone are joined back.
    several = rows.groupBy("lowest").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("lowest").alias("named"))
    several = staged(several, "repeated")
    several = F.broadcast(several) if several.count() <= BROADCAST_IDS else several
    return rows.join(several, F.col("lowest").eqNullSafe(F.col("named")), "left_semi").select(
        F.col("own.doc_id").alias("doc_id"),
        F.col("own.place").alias("paragraph"),
        "n_shingles",
        F.col("lowest.doc_id").alias("keep_id"),
        F.col("lowest.place").alias("keep_paragraph"),
        (~F.col("own").eqNullSafe(F.col("lowest"))).alias("removed"),
        F.col("own.last").alias("last_paragraph"),
    )


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.cumprod(out)


def _rolled(w: np.ndarray, size: int, base: U) -> np.ndarray:
    """The sum of w[i + k] * base ** (size - 1 - k) of each run of size numbers, modulo 2 ** 64, from sums of all before it."""
    n = 1 << len(w).bit_length()
    sums = np.zeros(len(w) + 1, U)
    np.cumsum(w * _powers(pow(int(base), -1, 1 << 64), n)[: len(w)], out=sums[1:])
    return (sums[size:] - sums[:-size]) * _powers(int(base), n)[size - 1 : len(w)]


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least number of each run of width numbers, from runs of twice the length each time."""
    at, have = np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:-step], at[step:]
        at, have = np.where(h[left] <= h[right], left, right), have + step
    return at


def chosen_of(w: np.ndarray, sizes: np.ndarray, size: int, run_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the windows of size words that are chosen, and two independent hashes of each, of 64 and 31 bits; texts that
    share run_words words share one. w: hashes of the words of texts one after the other; sizes: each one's number of them."""
    if len(w) < size:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = mixed(_rolled(w, size, _BASE))
    ends, most = np.cumsum(sizes), run_words - size + 1
    n = sizes - size + 1
    own = np.repeat(ends, sizes)[: len(h)]
    picked = np.zeros(len(h), bool)
    if len(h) >= most:
        # Runs of windows that lie within a text; texts of fewer windows choose one of all.
        inside = np.flatnonzero(np.arange(len(h) - most + 1) + run_words <= own[: len(h) - most + 1])
        picked[_least(h, most)[inside]] = True
    for k in np.flatnonzero((n > 0) & (n < most)).tolist():
        start = int(ends[k] - sizes[k])
        picked[start + int(h[start : start + int(n[k])].argmin())] = True
    at = np.flatnonzero(picked)
    other = mixed(_rolled(mixed(w), size, _OTHER_BASE)[at])
    return at, h[at].view(np.int64), (other >> U(33)).view(np.int64)


def chosen_windows(words: list[bytes], size: int, run_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """chosen_of one text's words."""
    return chosen_of(np.fromiter(map(xxhash.xxh64_intdigest, words), U, len(words)), np.array([len(words)]), size, run_words)


def windows(docs: DataFrame, size: int = MIN_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """window and other (hashes), doc_id, row_id, pos (its first word), line, last (lines of its first and last word)."""

    @lean()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for i, j, data in _parts(texts):
                w, starts = word_hashes(data.lower())
                lines = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
                text_at = np.cumsum([0, *(len(t) + 1 for t in texts[i:j])])
                edges = np.searchsorted(starts, text_at)
                at, h, other = chosen_of(w, np.diff(edges), size, run_words)
                text = np.searchsorted(edges[1:], at, "right")
                line, last = (np.searchsorted(lines, starts[place]) - np.searchsorted(lines, text_at[text]) for place in (at, at + size - 1))
                took = pa.array(text + i)
                made = [h, other.astype(np.int32), at - edges[text], line, last]
                kinds = [pa.int64(), *[pa.int32()] * 4]
                columns = [pa.array(x.astype(kind.to_pandas_dtype()), kind) for x, kind in zip(made, kinds)]
                yield pa.RecordBatch.from_arrays([*columns[:2], b.column("doc_id").take(took), b.column("row_id").take(took), *columns[2:]], names=names)

    names = ["window", "other", "doc_id", "row_id", "pos", "line", "last"]
    own = docs.select(F.col("doc_id").cast("string").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), "text")
    return own.filter(F.length("text") >= 2 * size - 1).mapInArrow(run, "window long, other int, doc_id long, row_id long, pos int, line int, last int")


def repeated_runs(docs: DataFrame, size: int = MIN_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """The columns of repeats(), first_word, n_words, keep_first_word: for each run that stands in several places."""
    every = staged(windows(docs, size, run_words), "windows")
    counts = every.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1")
    counts, total = staged(counts, "window-counts"), every.count()
    met = staged(looked_up(every, counts, "window", "n", total), "repeated-windows")
    release(every, counts)
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "pos", "row_id", "line")
    keep = met.groupBy("window", "other").agg(F.min(place).alias("keep"), F.count("*").alias("n")).filter("n > 1")
    keep = staged(keep.withColumnRenamed("other", "same"), "kept-windows")
    rows = looked_up(met.drop("n"), keep, "window", "n", total).filter("other = same")
    same = F.col("row_id") == F.col("keep.row_id")
    # A window that overlaps the one that stays is no copy beside it.
    rows = rows.withColumn("removed", ~(same & (F.col("pos") == F.col("keep.pos")))).filter(~(F.col("removed") & same & (F.col("pos") - F.col("keep.pos") < size)))
    # Windows of a run follow each other with no gap: its first one names it, its last one tells where it ends.
    own = Window.partitionBy("row_id", "removed").orderBy("pos")
    rows = rows.withColumn("first", F.coalesce(F.col("pos") > F.lag("pos").over(own) + size, F.lit(True)))
    rows = rows.withColumn("ends", F.coalesce(F.lead("pos").over(own) > F.col("pos") + size, F.lit(True))).filter("first OR ends")
    end = lambda c: F.when(F.col("ends"), F.col(c)).otherwise(F.lead(c).over(own))
    runs = rows.withColumns({"end_pos": end("pos"), "end_line": end("last")}).filter("first")
    out = runs.select(
        "doc_id",
        F.col("line").cast("long").alias("paragraph"),
        F.lit(None).cast("long").alias("n_shingles"),
        F.col("keep.doc_id").alias("keep_id"),
        F.col("keep.line").cast("long").alias("keep_paragraph"),
        "removed",
        F.col("end_line").cast("long").alias("last_paragraph"),
        F.col("pos").cast("long").alias("first_word"),
        (F.col("end_pos") - F.col("pos") + size).cast("long").alias("n_words"),
        F.col("keep.pos").cast("long").alias("keep_first_word"),
    )
    return owing(out, met, keep)


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, how: Banding = PARAGRAPHS) -> DataFrame:
    """docs with its removals cut out of their texts; all columns are kept."""
    gone = repeats(docs, min_words, how).filter("removed").groupBy(F.col("doc_id").alias("__id")).agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("paragraph", "last_paragraph")))).alias("__gone"))
    gone = staged(gone, "paragraph-removals")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS // 10 else gone
    lines = F.filter(F.split(docs["text"], "\n"), lambda line, place: ~F.array_contains(gone["__gone"], place.cast("long")))
    text = F.when(gone["__gone"].isNull(), docs["text"]).otherwise(F.array_join(lines, "\n"))
    met = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]), "left")
    return met.select(*[text.alias(c) if c == "text" else docs[f"`{c}`"] for c in docs.columns])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated paragraphs, with null in the columns of words, and repeated runs, with null in n_shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    runs = staged(found := repeated_runs(docs), "runs")
    release(found)
    return repeats(docs).unionByName(runs, allowMissingColumns=True)
