"""Benchmark decontamination with a distributed positional inverted index.

A window is a run of consecutive words of a benchmark item (the whole item when it is shorter). The documents are
read once to count the benchmark's terms and once more to store postings: term, document, position and the words
around it, for each window's rarest terms. Every shard of documents keeps its lists sorted by term. A window's
occurrences are found by intersecting the offset-adjusted lists of its rarest terms, and what is left is compared
word by word with the words stored beside the rarest term's posting.

Term and window tables are broadcast only after their rows are counted. Beyond BROADCAST_ROWS they are joined by
shuffle: terms are counted before they move, then places alone (row, position, term) are joined, gathered by document
and brought back to its text once. A document's length is one more posting, of the empty term. save() and load() keep an
index for later applications.

phrase_matches() gives exact phrases, which is what counts as contamination; proximity_matches() gives the places
where each word of a window stands at most slop words from where the phrase has it.

Defined cases: a null text has no words; an item without words has no window. Rows with equal or null doc_id are
separate documents. Items with equal item_id are one item; a null item_id is written as an empty string. With an
empty benchmark nothing is hit; without documents there are no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import ROW, drop_rows, numbered, owing, release, staged
from ._words import SQL_WORDS, word_array

WINDOW = 10

#: Most rows of a term or window table that are broadcast (some hundred bytes each).
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class PositionalIndex:
    """each: wid, item, words. windows: wid, words. items: wid, item. probes: wid, words, term, offset, rank. postings: doc_id, row_id, term, pos, around, lead."""

    each: DataFrame
    windows: DataFrame
    items: DataFrame
    probes: DataFrame
    postings: DataFrame
    small: bool

    @classmethod
    def of(cls, each: DataFrame, probes: DataFrame, postings: DataFrame) -> PositionalIndex:
        return cls(each, each.select("wid", "words").distinct(), each.select("wid", "item").distinct(), probes, postings, probes.count() <= BROADCAST_ROWS)

    def save(self, path: str) -> None:
        """Write the index to a folder that doesn't exist yet."""
        for name in ("each", "probes", "postings"):
            getattr(self, name).write.parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PositionalIndex:
        return cls.of(*(spark.read.parquet(f"{path}/{name}") for name in ("each", "probes", "postings")))


def _sized(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def benchmark_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """wid, item, words: each distinct window of each item."""
    own = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), word_array(F.col("text")).alias("ws"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - size + 1, F.lit(1)))
    each = own.filter(F.size("ws") > 0).select("item", "ws", F.explode(starts).alias("at"))
    words = each.select("item", F.slice("ws", F.col("at"), F.lit(size)).alias("words"))
    return words.select(F.sha2(F.array_join("words", " "), 256).alias("wid"), "item", "words").distinct()


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, row_id, words."""
    row = F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()
    return docs.select("doc_id", row.alias("row_id"), word_array(F.col("text")).alias("words"))


def _posting(size: int) -> list[Column]:
    """What is kept of a place (row, position, term) in a document's words."""
    lead = F.least(F.col("pos"), F.lit(size - 1))
    around = F.when(F.col("term") != "", F.slice("words", F.col("pos") - lead + 1, lead + size))
    return [F.col("doc_id"), F.col("row_id"), F.col("term"), F.col("pos"), around.alias("around"), lead.alias("lead")]


def _postings(docs: DataFrame, wanted: DataFrame, size: int, small: bool) -> DataFrame:
    if small:
        # The empty word behind the last one carries the document's length.
        rows = _rows(docs).withColumn("words", F.array_append("words", F.lit("")))
        placed = rows.select("doc_id", "row_id", "words", F.posexplode("words").alias("pos", "term"))
        none = docs.sparkSession.range(1).select(F.lit("").alias("term"))
        return placed.join(F.broadcast(wanted.union(none)), "term").select(*_posting(size))
    rows = _rows(docs)
    places = rows.select("row_id", F.posexplode("words").alias("pos", "term")).join(wanted, "term")
    # As many places as a document has words at most.
    at = places.groupBy("row_id").agg(F.collect_list(F.struct("pos", "term")).alias("at"))
    found = rows.join(at, "row_id").select("doc_id", "row_id", "words", F.inline("at")).select(*_posting(size))
    lengths = rows.select("doc_id", "row_id", F.lit("").alias("term"), F.size("words").alias("pos"), F.lit(None).cast("array<string>").alias("around"), F.lit(0).alias("lead"))
    return found.unionByName(lengths)


def build_index(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> PositionalIndex:
    each = staged(benchmark_windows(benchmark, size), "windows")
    terms = each.select("wid", "words").distinct().select("wid", "words", F.posexplode("words").alias("offset", "term"))
    # What is broadcast is the windows' vocabulary, so its own size decides.
    vocabulary = staged(terms.select("term").distinct(), "vocabulary")
    small = vocabulary.count() <= BROADCAST_ROWS
    if not small and ROW not in docs.columns:
        docs = numbered(docs)  # rows are told apart in two readings
    words = _rows(docs).select(F.explode("words").alias("term"))
    if small:
        counts = words.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count("*").alias("n"))
    else:
        counts = words.groupBy("term").agg(F.count("*").alias("n")).join(vocabulary, "term")
    rarest = Window.partitionBy("wid").orderBy(F.coalesce("n", F.lit(0)), "offset")
    ranked = terms.join(counts, "term", "left").withColumn("rank", F.row_number().over(rarest))
    probes = staged(ranked.filter("rank <= 2").select("wid", "words", "term", "offset", "rank"), "probes")
    found = _postings(docs, probes.select("term").distinct(), size, small)
    return PositionalIndex.of(each, probes, staged(found.sortWithinPartitions("term", "row_id", "pos"), "postings"))


def _lists(index: PositionalIndex, rank: int, *more: str | Column) -> DataFrame:
    """The offset-adjusted list of each window's rank-th rarest term."""
    probes = index.probes.filter(F.col("rank") == rank)
    met = index.postings.filter("term <> ''").join(_sized(probes, index.small), "term")
    return met.select("wid", "row_id", (F.col("pos") - F.col("offset")).alias("start"), *more)


def phrase_matches(index: PositionalIndex) -> DataFrame:
    """doc_id, row_id, wid, start, length: each place where a window's words stand."""
    from_rarest = _lists(index, 1, "doc_id", "around", "lead", "words", "offset").filter("start >= 0")
    long, short = from_rarest.filter(F.size("words") > 1), from_rarest.filter(F.size("words") == 1)
    both = long.join(_lists(index, 2), ["wid", "row_id", "start"], "left_semi").unionByName(short)
    stands = F.slice("around", F.col("lead") - F.col("offset") + 1, F.size("words")) == F.col("words")
    return both.filter((F.col("lead") >= F.col("offset")) & stands).select("doc_id", "row_id", "wid", "start", F.size("words").alias("length"))


def proximity_matches(index: PositionalIndex, slop: int) -> DataFrame:
    """doc_id, row_id, wid, pos: places of a window's rarest word around which each word of the window stands at most slop words
    from its place in the phrase, and no farther from the rarest than the window is long."""
    first = _lists(index, 1, "doc_id", "pos", "around", "lead", "words", "offset")
    second = _lists(index, 2).withColumn("start", F.explode(F.sequence(F.col("start") - slop, F.col("start") + slop))).distinct()
    near = first.filter(F.size("words") > 1).join(second, ["wid", "row_id", "start"], "left_semi").unionByName(first.filter(F.size("words") == 1))

    def stands(word: Column, i: Column) -> Column:
        place = F.col("lead") - F.col("offset") + i + 1  # in the words around, from 1
        low = F.greatest(place - slop, F.lit(1))
        return F.array_contains(F.slice("around", low, F.greatest(place + slop - low + 1, F.lit(0))), word)

    missing = F.exists(F.transform("words", lambda w, i: ~stands(w, i)), lambda x: x)
    return near.filter(~missing).select("doc_id", "row_id", "wid", "pos").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document, with the columns of the query below."""
    index = build_index(docs, benchmark, size)
    places = staged(phrase_matches(index), "places")
    spans = places.select("row_id", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    before = Window.partitionBy("row_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))))
    hits = spans.select("row_id", new.alias("new")).groupBy("row_id").agg(F.sum("new").alias("n_hit"))
    named = places.select("row_id", "wid").distinct().join(_sized(index.items, index.small), "wid").groupBy("row_id")
    named = named.agg(F.sort_array(F.collect_set("item")).alias("items"))
    rows = index.postings.filter("term = ''").select("doc_id", "row_id", F.col("pos").cast("long").alias("n_words"))
    out = rows.join(hits.join(named, "row_id"), "row_id", "left")
    out = out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
    return owing(out, places, index.postings, index.probes, index.each)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs without the documents that hold a window."""
    rows = numbered(docs)
    index = build_index(rows, benchmark, size)
    hit = staged(phrase_matches(index).select(F.col("row_id").alias(ROW)).distinct(), "contaminated")
    release(index.postings, index.probes, index.each)
    return drop_rows(rows, hit, hit.count())


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP8_SQL = f"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {SQL_WORDS} AS ws FROM benchmark),
w AS (SELECT item_id, ws[s + 1 : s + {WINDOW}] AS win FROM (SELECT item_id, ws, unnest(range(greatest(len(ws) - {WINDOW - 1}, 1))) AS s FROM b WHERE len(ws) > 0)),
u AS (SELECT DISTINCT win, win[1] AS head FROM w),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM d),
c AS (SELECT p.doc_id, p.pos, u.win FROM p JOIN u ON p.word = u.head),
o AS (SELECT c.doc_id, c.pos, c.win FROM c JOIN d USING (doc_id) WHERE d.ws[c.pos + 1 : c.pos + len(c.win)] = c.win),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, pos + unnest(range(len(win))) AS at FROM o) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT o.doc_id, CAST(w.item_id AS VARCHAR) AS item FROM o JOIN w USING (win)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
