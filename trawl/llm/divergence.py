"""How the sources of a language differ in their words: exact sums of differences of smoothed term shares.

Terms are counted by (lang, source); a language keeps the terms that stand in enough of its documents. The kept terms of a
language are cut into blocks by hash, and a group's counts in a block become arrays sorted by term id. Groups are dealt to tiles;
a task gets two tiles of one block, co-grouped, and prices each unordered pair of their groups: a galloping intersection of
the two id arrays finds terms of both; terms of one side and terms of neither side are priced from it, for both directions at
once. Sums over blocks give the pair's value. All shares are whole numbers, and no array is longer than a block.

Defined cases: null text, lang and source count as ''. Repeated rows and ids are documents of their own. A group without terms has
count 0 for all kept terms; a language that keeps none has pairs of value 0 and no terms. A group alone in its language has no pairs.
Ties are ranked by the item's UTF-8 bytes. An empty table gives no rows. Other columns aren't looked at.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import lean, owing, release, staged

#: What stands between terms becomes a space: all of ASCII but the letters.
_SEPARATED = bytes(c if c >= 0x80 or chr(c).isalpha() else 32 for c in range(256))

LEAST_DOCS, TOP_TERMS, SMOOTHING, SCALE = 30, 50, 5, 1_000_000_000

#: About so many terms a block, and groups a tile.
BLOCK_TERMS, TILE_GROUPS = 32_768, 8

#: Sums that a task holds, and bytes that it splits at once.
KEPT_TERMS, SLICE = 400_000, 1 << 20

#: Keys that gallop from the place of one found before them.
STRIDE = 8


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text's UTF-8 bytes, about SLICE bytes at a time."""
    text = text.lower().translate(_SEPARATED)  # of bytes, both touch ASCII alone
    at = 0
    while len(text) - at > SLICE:
        end = text.find(b" ", at + SLICE) + 1 or len(text)
        yield text[at:end].split()
        at = end
    yield text[at:].split()


def group_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it), with nulls as ''. A task adds up what it reads, and
    gives away its sums once it holds KEPT_TERMS of them."""

    @lean()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, kept = defaultdict(Counter), defaultdict(Counter), 0

        def sums() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in n.items():
                columns = [pa.array([lang] * len(own), pa.string()), pa.array([source] * len(own), pa.string()), pa.array(own.keys(), pa.binary()).cast(pa.string())]
                docs_with = map(held[lang, source].__getitem__, own)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(own.values(), pa.int64()), pa.array(docs_with, pa.int64())], names=names)
            n.clear()
            held.clear()

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                own, distinct = n[lang, source], set()
                kept -= len(own)
                for words in terms_of(text.as_py()):
                    own.update(words)
                    distinct.update(words)
                kept += len(own)
                held[lang, source].update(distinct)
                if kept > KEPT_TERMS:
                    yield from sums()
                    kept = 0
        yield from sums()

    names = ["lang", "source", "term", "n", "docs"]
    rows = docs.select(_named("lang"), _named("source"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def share(count: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / whole), in longs: three digits at a time, so that no product leaves them."""
    out, rest = F.lit(0).cast("long"), (count + SMOOTHING).cast("long")
    for _ in range(3):
        out, rest = out * 1000 + _div(rest * 1000, whole), rest * 1000 % whole
    return out + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def shares(counts: np.ndarray, whole: int) -> np.ndarray:
    """share() of an array."""
    out, rest = np.zeros(len(counts), np.int64), counts + SMOOTHING
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // whole, rest * 1000 % whole
    return out + 1


def gallop(keys: np.ndarray, run: np.ndarray) -> np.ndarray:
    """For each of the sorted keys, the place of the first item of a sorted run that isn't less: every STRIDE-th key is placed first,
    and the keys behind it start there, in steps that double until they have passed, and halve again."""
    if len(keys) <= STRIDE:
        return np.searchsorted(run, keys)
    low = np.repeat(gallop(keys[::STRIDE], run), STRIDE)[: len(keys)]
    high, live, step = np.full(len(keys), len(run)), np.arange(len(keys)), 1
    while len(live):
        probe = low[live] + step - 1
        inside = probe < len(run)
        live, probe = live[inside], probe[inside]
        passed = run[probe] >= keys[live]
        high[live[passed]] = probe[passed]
        live = live[~passed]
        low[live] = probe[~passed] + 1
        step *= 2
    while len(live := np.flatnonzero(low < high)):
        mid = (low[live] + high[live]) // 2
        less = run[mid] < keys[live]
        low[live[less]] = mid[less] + 1
        high[live[~less]] = mid[~less]
    return low


def distance(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int], n_terms: int) -> int:
    """The summed differences of two groups over a block of n_terms terms. A group: term ids, ascending; counts; what its shares are of."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    (few, few_n, few_whole), (many, many_n, many_whole) = a, b
    at = gallop(few, many)
    both = np.zeros(len(few), bool)
    inside = at < len(many)
    both[inside] = many[at[inside]] == few[inside]
    one, other = shares(few_n, few_whole), shares(many_n, many_whole)
    none = np.zeros(1, np.int64)
    few_0, many_0 = int(shares(none, few_whole)[0]), int(shares(none, many_whole)[0])
    alone = np.ones(len(many), bool)
    alone[at[both]] = False
    total = np.abs(one[both] - other[at[both]]).sum() + np.abs(one[~both] - many_0).sum() + np.abs(other[alone] - few_0).sum()
    return int(total) + abs(few_0 - many_0) * (n_terms - len(many) - int((~both).sum()))


def _groups(table: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray, int]]:
    ids, counts = (table.column(c).combine_chunks() for c in ("ids", "counts"))
    rows = zip(table.column("source").to_pylist(), ids, counts, table.column("whole").to_pylist())
    return {s: (i.values.to_numpy(), n.values.to_numpy(), w) for s, i, n, w in rows}


def _price(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """The pairs of two tiles: a before b in name where both are of one tile."""
    lang, _, t, u = (k.as_py() for k in key)
    one, other = _groups(left), _groups(right)
    n_terms = left.column("n_terms")[0].as_py() if left.num_rows else 0
    found = [(a, b, distance(x, y, n_terms) if n_terms else 0) for a, x in one.items() for b, y in other.items() if t != u or a < b]
    return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "a": pa.array([x[0] for x in found], pa.string()), "b": pa.array([x[1] for x in found], pa.string()), "value": pa.array([x[2] for x in found], pa.int64())})


def pair_values(vectors: DataFrame) -> DataFrame:
    """lang, a, b (an unordered pair of sources) and value, from rows of lang, source, tile, n_tiles, block, ids, counts, whole and n_terms."""
    columns = ["lang", "block", "t", "u", "source", "ids", "counts", "whole", "n_terms"]
    left = vectors.withColumn("t", F.col("tile")).withColumn("u", F.explode(F.sequence("tile", F.col("n_tiles") - 1))).select(columns)
    right = vectors.withColumn("u", F.col("tile")).withColumn("t", F.explode(F.sequence(F.lit(0), "tile"))).select(columns)
    by = ["lang", "block", "t", "u"]
    priced = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_price, "lang string, a string, b string, value long")
    return priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, block_terms: int = BLOCK_TERMS, tile_groups: int = TILE_GROUPS) -> DataFrame:
    """lang, source, part, item, value, rank: the group's distance to each other source of its language (part pair), and the top terms
    that it uses more than its language does (part term)."""
    counts = staged(group_counts(docs), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    kept = staged(kept.select("lang", "term", "total", F.monotonically_increasing_id().alias("id")), "divergence-terms")
    # A language's blocks; a row for each language that keeps a term.
    blocks = F.ceil(F.count("*") / F.lit(float(block_terms))).cast("int")
    langs = staged(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"), blocks.alias("n_blocks")), "divergence-languages")
    hashed = F.pmod(F.xxhash64("term"), F.col("n_blocks")).cast("int").alias("block")
    entries = kept.join(langs, "lang").join(counts.select("lang", "source", "term", "n"), ["lang", "term"])
    entries = staged(entries.select("lang", "source", "term", "id", hashed, "n", "total", "v", "lang_n"), "divergence-entries")
    names = docs.select(_named("lang"), _named("source")).distinct()
    many = names.groupBy("lang").agg(F.ceil(F.count("*") / F.lit(float(tile_groups))).cast("int").alias("n_tiles"))
    groups = names.join(many, "lang").join(langs, "lang", "left").join(entries.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left")
    v = F.coalesce("v", F.lit(0))
    whole = F.coalesce("group_n", F.lit(0)) + SMOOTHING * v
    tile = F.pmod(F.xxhash64("source"), F.col("n_tiles")).cast("int")
    groups = staged(groups.select("lang", "source", whole.alias("whole"), tile.alias("tile"), "n_tiles", F.coalesce("n_blocks", F.lit(1)).alias("n_blocks")), "divergence-groups")

    arrays = entries.groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("own"))
    sizes = kept.join(langs, "lang").groupBy("lang", hashed).agg(F.count("*").alias("n_terms"))
    cells = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).join(sizes, ["lang", "block"], "left").join(arrays, ["lang", "source", "block"], "left")
    filled = lambda c: F.coalesce(c, F.array().cast("array<bigint>"))
    vectors = cells.select("lang", "source", "tile", "n_tiles", "block", filled(F.col("own.id")).alias("ids"), filled(F.col("own.n")).alias("counts"), "whole", F.coalesce("n_terms", F.lit(0)).alias("n_terms"))
    vectors = staged(vectors, "divergence-arrays")
    pairs = pair_values(vectors)
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", "value", both.alias("x")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    more = share(F.col("n"), F.col("whole")) - share(F.col("total"), F.col("lang_n") + SMOOTHING * F.col("v"))
    terms = entries.join(groups.select("lang", "source", "whole"), ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), more.alias("value")).filter("value > 0")
    by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    release(counts, kept, langs)
    return owing(pairs.withColumn("rank", F.row_number().over(by)).unionByName(terms), entries, groups, vectors)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), per_doc AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
c AS (SELECT lang, source, term, sum(n) AS n, count(*) AS docs FROM per_doc GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total, l.v, l.lang_n
  FROM g JOIN kept k ON g.lang = k.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, n,
    1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p,
    1 + (1000000000::HUGEINT * (total + 5)) // (lang_n + 5 * v) AS q
  FROM grid
), f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT * FROM (SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM f)
WHERE part = 'pair' OR rank <= 50
"""
