"""Counts, document filters and statistics. Per-document values are computed within the row; only totals are gathered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.dialect import compile_patterns
from trawl.operators.context import selected_array
from trawl.operators.lines import computed, let, line_array, n_bytes, others
from trawl.operators.match import hit, prefiltered
from trawl.operators.spans import covering_spans
from trawl.spec import SearchSpec


def _matching(search: SearchSpec, text: Column) -> Column:
    """The matching lines that count."""
    if search.stop_on_nonmatch:
        rows = selected_array(search.but(before=0, after=0, passthru=False), text)
        return F.transform(rows, lambda r: r["line"])
    lines = F.filter(line_array(text, search.separator), lambda x: hit(search, x))
    return F.slice(lines, F.lit(1), F.lit(search.max_count)) if search.max_count is not None else lines


def matches_in(search: SearchSpec, lines: Column) -> Column:
    """The number of matches in an array of lines; none when inverted."""
    if search.invert or not search.patterns:
        return F.lit(0).cast("long")
    regex = compile_patterns(search).regex
    return F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.regexp_count(x, F.lit(regex)))


def count_lines(df: DataFrame, search: SearchSpec, text: str = "text", include_zero: bool = False) -> DataFrame:
    """The other columns and n: matching lines of each document that has any, or of all."""
    rows = df if include_zero else prefiltered(df, search, text)
    rows = computed(rows, others(df, text), F.size(_matching(search, F.col(text))).cast("long"), "n")
    return rows if include_zero else rows.filter("n > 0")


def count_matches(df: DataFrame, search: SearchSpec, text: str = "text", include_zero: bool = False) -> DataFrame:
    """The other columns and n: matches in each document that has any, or in all. Inverted, lines are counted."""
    if search.invert:
        return count_lines(df, search, text, include_zero)
    rows = df if include_zero else prefiltered(df, search, text)
    rows = computed(rows, others(df, text), matches_in(search, _matching(search, F.col(text))), "n")
    return rows if include_zero else rows.filter("n > 0")


def has_match(search: SearchSpec, text: Column) -> Column:
    return F.exists(line_array(text, search.separator), lambda x: hit(search, x))


def docs_with_match(df: DataFrame, search: SearchSpec, text: str = "text") -> DataFrame:
    """Documents with at least one matching line, with all their columns."""
    return prefiltered(df, search, text).filter(has_match(search, F.col(text)))


def docs_without_match(df: DataFrame, search: SearchSpec, text: str = "text") -> DataFrame:
    """Documents without a matching line."""
    return df.filter(~has_match(search, F.col(text)))


def any_match(df: DataFrame, search: SearchSpec, text: str = "text") -> bool:
    """Whether any document has a match; tasks stop at the first."""
    return not docs_with_match(df, search, text).limit(1).isEmpty()


def doc_stats(df: DataFrame, search: SearchSpec, text: str = "text") -> DataFrame:
    """The other columns and each document's searches, searches_with_match, bytes_searched, matched_lines, matches.

    With max_count, the search ends after the last counted line and its trailing context; what matches there counts too.
    """
    if search.multiline:
        return _multiline_stats(df, search, text)
    whole = F.coalesce(F.col(text), F.lit(""))
    keys = others(df, text)
    if search.max_count is None and not search.stop_on_nonmatch:
        lines = F.filter(line_array(F.col(text), search.separator), lambda x: hit(search, x))
        rows = df.select(*keys, n_bytes(whole, search.raw).cast("long").alias("bytes_searched"), lines.alias("__m"))
    else:
        def bounded(shown: Column) -> Column:
            last = F.element_at(shown, -1)
            end = F.least(last["absolute_offset"] + n_bytes(last["line"], search.raw) + 1, n_bytes(whole, search.raw).cast("long"))
            own = F.transform(F.filter(shown, lambda r: r["role"] == "match"), lambda r: r["line"])
            full = search.max_count is not None
            reached = F.size(own) >= F.lit(search.max_count or 0) if full else F.size(shown) > 0
            return F.struct(F.when(reached & (F.size(shown) > 0), end).otherwise(n_bytes(whole, search.raw).cast("long")).alias("bytes"), own.alias("lines"))

        both = let(selected_array(search.but(before=0), F.col(text)), bounded)
        rows = df.select(*keys, both.alias("__b")).select(*keys, F.col("__b.bytes").alias("bytes_searched"), F.col("__b.lines").alias("__m"))
    n = F.size("__m").cast("long")
    return rows.select(*keys, F.lit(1).cast("long").alias("searches"), (n > 0).cast("long").alias("searches_with_match"), "bytes_searched", n.alias("matched_lines"), matches_in(search, F.col("__m")).alias("matches"))


def _multiline_stats(df: DataFrame, search: SearchSpec, text: str) -> DataFrame:
    whole, keys = F.coalesce(F.col(text), F.lit("")), others(df, text)
    rows = df.select(*keys, n_bytes(whole, search.raw).cast("long").alias("bytes_searched"), covering_spans(search, whole).alias("__s"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("__s", lambda s: F.sequence(s["first_line"], s["last_line"]))))).cast("long")
    n = F.size("__s").cast("long")
    return rows.select(*keys, F.lit(1).cast("long").alias("searches"), (n > 0).cast("long").alias("searches_with_match"), "bytes_searched", covered.alias("matched_lines"), n.alias("matches"))


def stats(df: DataFrame, search: SearchSpec, text: str = "text", printed: Sequence[str] | None = None) -> DataFrame:
    """One row: the sums of doc_stats; with printed, also bytes_printed.

    printed: what stands before each shown line, behind each a separator: columns of df, and line_number. With context, two
    dashes and a line feed stand between groups of lines. It is one reading of the documents for all.
    """
    names = ["searches", "searches_with_match", "bytes_searched", "matched_lines", "matches"]
    rows = df
    if printed is not None:
        fields = [c for c in printed if c != "line_number"]
        before = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 1 for c in fields), F.lit(0))

        def size(r: Column) -> Column:
            number = F.octet_length(r["line_number"].cast("string")) + 1 if "line_number" in printed else F.lit(0)
            return before + number + n_bytes(r["line"], search.raw) + 1

        shown = selected_array(search, F.coalesce(F.col(text), F.lit("")))
        both = let(shown, lambda a: F.struct(F.aggregate(a, F.lit(0).cast("long"), lambda n, r: n + size(r)).alias("bytes"), F.coalesce(F.try_element_at(a, F.lit(-1))["group_id"], F.lit(0)).alias("groups")))
        rows = df.withColumn("__printed", both)
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names]
    if printed is not None:
        dashes = F.greatest(F.sum("__printed.groups") - 1, F.lit(0)) * 3 if search.before or search.after else F.lit(0)
        sums.append(F.coalesce(F.sum("__printed.bytes") + dashes, F.lit(0)).cast("long").alias("bytes_printed"))
    return doc_stats(rows, search, text).agg(*sums)


def grouped(df: DataFrame, search: SearchSpec, text: str = "text") -> DataFrame:
    """A row per document with matches: the other columns and lines, an array of (line_number, line). No shuffle."""
    rows = prefiltered(df, search, text).select(*others(df, text), selected_array(search, F.col(text)).alias("lines"))
    return rows.filter(F.size("lines") > 0).withColumn("lines", F.transform("lines", lambda r: F.struct(r["line_number"].alias("line_number"), r["line"].alias("line"))))
