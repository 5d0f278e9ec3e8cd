"""Lines of documents: arrays within a row, or one row per line. No form but the one for tables of lines moves a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trawl.spec import SpecError

#: What each line of a document gets; numbers that running() sums at once.
LINE_COLUMNS, SUMMED = ("line_number", "line", "terminator", "absolute_offset"), 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row wherever body uses it, also inside further lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def line_array(text: Column, separator: str = "\n") -> Column:
    """The lines of a text; a final terminator doesn't start another, and an empty text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), "\\x00" if separator == "\0" else separator, -1)
    return let(parts, lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a))


def running(values: Column) -> Column:
    """The sum of the numbers before each one of an array. Sums are made block by block, so that an array of any length takes time in
    proportion (appending sum after sum would copy what is there each time)."""
    zero = F.lit(0).cast("long")

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda s, x: s + x)

    def before(sums: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("starts"))
        add = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts"))
        return F.aggregate(sums, start, add, lambda acc: acc["starts"])

    def placed(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), (F.size(v) / SUMMED).cast("int")), lambda b: total(F.slice(v, b * SUMMED + 1, F.lit(SUMMED))))
        return let(before(blocks), lambda s: F.transform(v, lambda _, i: F.get(s, (i / SUMMED).cast("int")) + total(F.slice(v, i - i % SUMMED + 1, i % SUMMED))))

    return let(values.cast("array<bigint>"), placed)


def n_bytes(text: Column, raw: bool = False) -> Column:
    """The bytes of a text; of a raw one, each character is one."""
    return F.char_length(text) if raw else F.octet_length(text)


def line_starts(lines: Column, raw: bool = False) -> Column:
    """The byte offset of each line of an array."""
    return running(F.transform(lines, lambda line: n_bytes(line, raw) + 1))


def others(df: DataFrame, text: str, *made: str) -> list[str]:
    """The columns that go along with each line. They may not have the names of those that are made (for lines, LINE_COLUMNS)."""
    clash = {*LINE_COLUMNS, *made} & {c.lower() for c in df.columns if c != text}
    if clash:
        raise SpecError(f"rename the columns {', '.join(sorted(clash))}, which the result has as well")
    return [c for c in df.columns if c != text]


def items(df: DataFrame, kept: list, array: Column | str, pos: str, item: str) -> DataFrame:
    """What is kept of df, with a row for each item of an array.

    The outer form with a filter behind it, since Spark infers filters of the plain one that compute the array three times."""
    return df.select(*kept, F.posexplode_outer(array).alias(pos, item)).filter(F.col(pos).isNotNull())


def computed(df: DataFrame, kept: list, value: Column, name: str) -> DataFrame:
    """What is kept of df, with a value that filters behind it don't compute once more, as they would that of a projection."""
    return df.select(*kept, F.explode_outer(F.array(value)).alias(name))


def split_lines(df: DataFrame, text: str = "text", separator: str = "\n") -> DataFrame:
    """A row per line: the other columns, line_number from 1, line, and terminator (empty after an unended last line)."""
    keys = others(df, text)
    ended = F.coalesce(F.col(text), F.lit("")).endswith(separator)
    rows = df.select(*keys, ended.alias("__ended"), line_array(F.col(text), separator).alias("__lines"))
    rows = items(rows, [*keys, "__ended", F.size("__lines").alias("__n")], "__lines", "__pos", "line")
    unended = (F.col("__pos") + 1 == F.col("__n")) & ~F.col("__ended")
    return rows.select(*keys, (F.col("__pos") + 1).alias("line_number"), "line", F.when(unended, "").otherwise(separator).alias("terminator"))


def with_offsets(df: DataFrame, text: str = "text", separator: str = "\n", raw: bool = False) -> DataFrame:
    """split_lines with absolute_offset, the byte at which each line starts; computed within the document's row."""
    keys = others(df, text)
    ended = F.coalesce(F.col(text), F.lit("")).endswith(separator)
    zipped = let(line_array(F.col(text), separator), lambda a: F.arrays_zip(a.alias("line"), line_starts(a, raw).alias("absolute_offset")))
    rows = df.select(*keys, ended.alias("__ended"), zipped.cast("array<struct<line:string,absolute_offset:bigint>>").alias("__lines"))
    rows = items(rows, [*keys, "__ended", F.size("__lines").alias("__n")], "__lines", "__pos", "__l")
    unended = (F.col("__pos") + 1 == F.col("__n")) & ~F.col("__ended")
    terminator = F.when(unended, "").otherwise(separator).alias("terminator")
    return rows.select(*keys, (F.col("__pos") + 1).alias("line_number"), F.col("__l.line").alias("line"), terminator, F.col("__l.absolute_offset").alias("absolute_offset"))


#: Lines of a block in the forms for tables of lines: a task's part of a text, however long that is.
LINES_A_BLOCK = 100_000

#: What tells a block of a text apart. A struct equals one with the same nulls, so that null keys are keys like any other.
BLOCK = ["__key", "__block"]


def blocked(lines: DataFrame, *keys: str) -> DataFrame:
    """A table of lines (keys, and line_number from 1 without gaps) with the columns of BLOCK."""
    at = F.floor((F.col("line_number") - 1) / LINES_A_BLOCK).cast("long")
    return lines.withColumn("__key", F.struct(*keys)).withColumn("__block", at)


def within_block() -> WindowSpec:
    return Window.partitionBy(*BLOCK).orderBy("line_number")


def blocks_before() -> WindowSpec:
    """Over a table with a row per block: those before a block in its text."""
    return Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)


def offsets_over(lines: DataFrame, *keys: str, raw: bool = False) -> DataFrame:
    """absolute_offset for a table of lines (keys, line_number, line), for texts of any length: sums of blocks first, which then start
    the running sums within each. No task gets more of a text than a block."""
    own = blocked(lines, *keys).withColumn("__bytes", (n_bytes(F.col("line"), raw) + 1).cast("long"))
    sums = own.groupBy(*BLOCK).agg(F.sum("__bytes").alias("__sum"))
    starts = sums.select(*BLOCK, F.coalesce(F.sum("__sum").over(blocks_before()), F.lit(0)).alias("__start"))
    before = F.sum("__bytes").over(within_block().rowsBetween(Window.unboundedPreceding, -1))
    placed = own.join(starts, BLOCK).withColumn("absolute_offset", F.col("__start") + F.coalesce(before, F.lit(0)))
    return placed.select(*lines.columns, "absolute_offset")
