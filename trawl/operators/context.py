"""Lines around matches, caps and runs: within a document's row, or over a table of lines, block by block."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.operators.lines import BLOCK, blocked, blocks_before, items, let, line_array, line_starts, others, running, within_block
from trawl.operators.match import hit, prefiltered
from trawl.sources.written import written_once
from trawl.spec import SearchSpec


def _numbers(flags: Column) -> Column:
    """The numbers of all matching lines."""
    return F.filter(F.transform(flags, lambda x, i: F.when(x, i + 1)), lambda n: n.isNotNull())


def _counted(search: SearchSpec, hits: Column) -> Column:
    """The matching lines that count: the first run with stop_on_nonmatch, and no more than max_count."""
    out = hits
    if search.stop_on_nonmatch:
        out = let(out, lambda h: F.filter(h, lambda n, i: n - i == F.get(h, F.lit(0))))
    return F.slice(out, F.lit(1), F.lit(search.max_count)) if search.max_count is not None else out


def selected_array(search: SearchSpec, text: Column) -> Column:
    """An array of the lines that are shown: line_number, line, role, group_id, absolute_offset."""

    def shown(a: Column, flags: Column, counted: Column) -> Column:
        n = F.size(a)

        def around(i: Column, k: Column) -> Column:
            """The lines near a match that aren't near the one before it."""
            first = F.greatest(i - search.before, F.coalesce(F.get(counted, k - 1) + search.after, F.lit(0)) + 1)
            last = F.least(i + search.after, n)
            return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

        if search.passthru:
            last = n
            if search.stop_on_nonmatch:
                last = F.when(F.size(counted) > 0, F.least(F.element_at(counted, -1) + 1, n)).otherwise(n)
            kept = F.when(n > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        else:
            kept = counted if search.before == search.after == 0 else F.flatten(F.transform(counted, around))
        if search.max_count == 0:
            kept = F.array().cast("array<int>")

        def rows(k: Column, starts: Column, breaks: Column, before: Column) -> Column:
            def one(i: Column, at: Column) -> Column:
                role = F.when(F.get(flags, i - 1), "match").otherwise("context")
                group = (F.get(before, at) + F.get(breaks, at)).cast("int")
                return F.struct(i.alias("line_number"), F.get(a, i - 1).alias("line"), role.alias("role"), group.alias("group_id"), F.get(starts, i - 1).alias("absolute_offset"))

            return F.transform(k, one)

        def broken(k: Column) -> Column:
            """1 for each shown line that starts a group."""
            return F.transform(k, lambda i, at: F.when((at == 0) | (i - F.get(k, at - 1) > 1), 1).otherwise(0))

        return let(kept, lambda k: let(line_starts(a, search.raw), lambda s: let(broken(k), lambda b: let(running(b), lambda g: rows(k, s, b, g)))))

    def marked(a: Column, flags: Column) -> Column:
        return let(_numbers(flags), lambda h: let(_counted(search, h), lambda c: shown(a, flags, c)))

    return let(line_array(text, search.separator), lambda a: let(F.transform(a, lambda x: hit(search, x)), lambda flags: marked(a, flags)))


def selected(df: DataFrame, search: SearchSpec, text: str = "text") -> DataFrame:
    """A row per shown line: the other columns, line_number, line, role (match or context), group_id, absolute_offset. No shuffle."""
    keys = others(df, text, "role", "group_id")
    rows = items(prefiltered(df, search, text), keys, selected_array(search, F.col(text)), "__pos", "__l")
    return rows.select(*keys, *[F.col(f"__l.{c}").alias(c) for c in ("line_number", "line", "role", "group_id", "absolute_offset")])


def _last_counted(marked: DataFrame, search: SearchSpec) -> DataFrame:
    """__key and __last, the number of the last line that may count, for texts where there is one."""
    hits = marked.filter("__hit")
    bounds = []
    if search.stop_on_nonmatch:
        # A line counts while no non-matching line has followed the first match.
        first = hits.groupBy("__key").agg(F.min("line_number").alias("__first"))
        ends = marked.filter("NOT __hit").join(first, "__key").filter(F.col("line_number") > F.col("__first"))
        bounds.append(ends.groupBy("__key").agg((F.min("line_number") - 1).alias("__last")))
    if search.max_count is not None:
        # The block in which the count is reached, and within that the line.
        sums = hits.groupBy(*BLOCK).agg(F.count("*").alias("__n"))
        reached = sums.withColumn("__before", F.coalesce(F.sum("__n").over(blocks_before()), F.lit(0))).filter((F.col("__before") < search.max_count) & (F.col("__before") + F.col("__n") >= search.max_count))
        ranked = hits.join(reached.select(*BLOCK, "__before"), BLOCK).withColumn("__rank", F.col("__before") + F.row_number().over(within_block()))
        bounds.append(ranked.filter(F.col("__rank") == search.max_count).select("__key", F.col("line_number").alias("__last")))
    return reduce(DataFrame.unionByName, bounds).groupBy("__key").agg(F.min("__last").alias("__last"))


def context_over(lines: DataFrame, search: SearchSpec, *keys: str) -> DataFrame:
    """The form for a table of lines (keys, line_number from 1 without gaps, line), for texts of any length: role and group_id of the lines
    that are shown. A block knows the nearest matches and the number of groups before and behind it from a row per block; no task gets
    more of a text than a block."""
    marked = blocked(lines.select(*keys, "line_number", "line"), *keys).withColumn("__hit", F.coalesce(hit(search, F.col("line")), F.lit(False)))
    if search.max_count == 0:
        marked = marked.filter(F.lit(False))
    counts = F.col("__hit")
    if search.stop_on_nonmatch or search.max_count:
        marked = marked.join(_last_counted(marked, search), "__key", "left")
        counts = counts & F.coalesce(F.col("line_number") <= F.col("__last"), F.lit(True))
    number = F.when(counts, F.col("line_number"))
    blocks = marked.groupBy(*BLOCK).agg(F.min(number).alias("__first"), F.max(number).alias("__final"))
    behind = Window.partitionBy("__key").orderBy("__block").rowsBetween(1, Window.unboundedFollowing)
    blocks = blocks.select(*BLOCK, F.max("__final").over(blocks_before()).alias("__above"), F.min("__first").over(behind).alias("__below"))
    by, line, never = within_block(), F.col("line_number"), 1 << 62
    upto = lambda frame: F.coalesce(F.max(number).over(frame), F.col("__above"), F.lit(-never))
    placed = marked.join(blocks, BLOCK).select(
        *keys, "line_number", "line", *BLOCK, "__hit",
        upto(by.rowsBetween(Window.unboundedPreceding, 0)).alias("__at"),
        upto(by.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"),
        F.coalesce(F.min(number).over(by.rowsBetween(0, Window.unboundedFollowing)), F.col("__below"), F.lit(never)).alias("__next"),
    )
    shown = (line - F.col("__at") <= search.after) | (F.col("__next") - line <= search.before)
    # The line above is shown for its own match, one further up, or the next one from here on.
    joined = (line > 1) & ((line - 1 - F.col("__before") <= search.after) | (F.col("__next") - (line - 1) <= search.before))
    kept = placed.filter(shown).select(*keys, "line_number", "line", *BLOCK, "__hit", (~joined).cast("int").alias("__start"))
    kept = written_once(kept, "shown-lines")
    sums = kept.groupBy(*BLOCK).agg(F.sum("__start").alias("__n"))
    sums = sums.select(*BLOCK, F.coalesce(F.sum("__n").over(blocks_before()), F.lit(0)).alias("__groups"))
    group = (F.col("__groups") + F.sum("__start").over(by)).cast("int").alias("group_id")
    return kept.join(sums, BLOCK).select(*keys, "line_number", "line", F.when(F.col("__hit"), "match").otherwise("context").alias("role"), group)
