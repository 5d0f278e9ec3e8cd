"""Spans of matches, captures and replacements, without Python in the tasks.

Each match is fenced in by a string that neither the text nor its replacement holds; splitting there leaves gaps and matches
in turn, whose byte lengths give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.dialect import compile_patterns, compile_template
from trawl.operators.lines import items, let, line_array, n_bytes, others, running, split_lines, with_offsets
from trawl.operators.match import hit, prefiltered
from trawl.spec import SearchSpec

#: What fences matches in. A text that holds it gets a run of it that is longer than any in the result, and an end behind that.
FENCE, END = "\ufdd0", "\ufdd1"

SPAN = "struct<start_byte:int,end_byte:int,start_column:int,end_column:int,text:string,replacement:string,replaced_column:int>"
SPAN_COLUMNS = ("start_byte", "end_byte", "start_column", "end_column", "text", "replacement", "replaced_column")
LINED_SPAN = SPAN.removesuffix(">") + ",lines_before:int,lines_inside:int>"


def _pieces(text: Column, regex: str, replacement: str = "$0") -> Column:
    held = F.length(text) - F.length(F.replace(text, F.lit(FENCE), F.lit("")))
    # Each group that a replacement names may hold all of them once more.
    most = held * (replacement.count("$") + 1) + replacement.count(FENCE)
    fence = F.when(~text.contains(FENCE) & F.lit(FENCE not in replacement), F.lit(FENCE)).otherwise(F.concat(F.repeat(F.lit(FENCE), most + 1), F.lit(END)))
    return let(fence, lambda s: F.split(F.regexp_replace(text, F.lit(regex), F.concat(s, F.lit(replacement), s)), s, -1))


def _spans(search: SearchSpec, text: Column, lined: bool) -> Column:
    """The non-overlapping matches in a text, in order; with lined, also the newlines before and in each. An empty match at the
    end of a match before it isn't one. Offsets are running sums over the pieces, so many matches cost no more each than few."""
    kind = LINED_SPAN if lined else SPAN
    if not search.patterns:
        return F.array().cast(f"array<{kind}>")
    compiled = compile_patterns(search)
    shown = _pieces(text, compiled.regex, compile_template(search.template, compiled)) if search.template is not None else F.lit(None).cast("array<string>")
    lengths = lambda p: F.transform(p, lambda x: n_bytes(x, search.raw))
    newlines = lambda p: F.transform(p, lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))))
    none = F.lit(None).cast("array<bigint>")

    def spans(p: Column, r: Column, at: Column, shifted: Column, lines: Column) -> Column:
        def one(k: Column) -> Column:
            own, start = F.get(p, 2 * k - 1), F.get(at, 2 * k - 1)
            end = start + n_bytes(own, search.raw)
            parts = [start.alias("start_byte"), end.alias("end_byte"), (start + 1).alias("start_column"), (end + 1).alias("end_column"), own.alias("text"), F.get(r, 2 * k - 1).alias("replacement"), (F.get(shifted, 2 * k - 1) + 1).alias("replaced_column")]
            if lined:
                before = F.get(lines, 2 * k - 1)
                inside = F.length(own) - F.length(F.replace(own, F.lit("\n"), F.lit(""))) - own.endswith("\n").cast("int")
                parts += [before.alias("lines_before"), inside.alias("lines_inside")]
            return F.struct(*parts)

        def real(k: Column) -> Column:
            touches = (F.get(p, 2 * k - 1) == "") & (F.get(p, 2 * k - 2) == "") & (F.get(p, 2 * k - 3) != "")
            return ~F.coalesce(touches & (k > 1), F.lit(False))

        numbers = F.filter(F.sequence(F.lit(1), (F.size(p) / 2).cast("int")), real)
        return F.when(F.size(p) >= 3, F.transform(numbers, one)).otherwise(F.array().cast(f"array<{kind}>"))

    def placed(p: Column, r: Column) -> Column:
        moved = running(lengths(r)) if search.template is not None else none
        counted = running(newlines(p)) if lined else none
        return let(running(lengths(p)), lambda at: let(moved, lambda m: let(counted, lambda c: spans(p, r, at, m, c))))

    return let(_pieces(text, compiled.regex), lambda p: let(shown, lambda r: placed(p, r))).cast(f"array<{kind}>")


def span_array(search: SearchSpec, text: Column) -> Column:
    """The non-overlapping matches in a text, in order."""
    return _spans(search, text, False)


def match_rows(df: DataFrame, search: SearchSpec, text: str = "text") -> DataFrame:
    """A row per matching line with its spans: the other columns, line_number, line, terminator, absolute_offset, match_count, spans."""
    lines = with_offsets(prefiltered(df, search, text), text, search.separator, search.raw).filter(hit(search, F.col("line")))
    empty = F.array().cast(f"array<{SPAN}>")
    lines = lines.withColumn("spans", empty if search.invert else span_array(search, F.col("line")))
    return lines.select(*others(df, text, "match_count", "spans"), "line_number", "line", "terminator", "absolute_offset", F.size("spans").alias("match_count"), "spans")


def spans(df: DataFrame, search: SearchSpec, text: str = "text") -> DataFrame:
    """A row per match: the other columns, line_number, span_index, start_byte, end_byte, start_column, end_column, text, replacement, replaced_column, absolute_offset."""
    keys = others(df, text, "span_index", *SPAN_COLUMNS)
    rows = items(match_rows(df, search.but(invert=False), text), [*keys, "line_number", "absolute_offset"], "spans", "span_index", "s")
    named = [F.col(f"s.{c}").alias(c) for c in SPAN_COLUMNS]
    return rows.select(*keys, "line_number", "span_index", *named, (F.col("absolute_offset") + F.col("s.start_byte")).alias("absolute_offset"))


def only_matching(df: DataFrame, search: SearchSpec, text: str = "text") -> DataFrame:
    """A row per match of the lines that count: the other columns, line_number, span_index, text (or the replacement)."""
    keys = others(df, text, "span_index", "text")
    lines = split_lines(prefiltered(df, search, text), text, search.separator) if search.max_count is None else _first_lines(df, search, text)
    rows = items(lines.filter(hit(search, F.col("line"))), [*keys, "line_number"], span_array(search, F.col("line")), "span_index", "s")
    return rows.select(*keys, "line_number", "span_index", F.coalesce("s.replacement", "s.text").alias("text"))


def _first_lines(df: DataFrame, search: SearchSpec, text: str) -> DataFrame:
    from trawl.operators.context import selected

    return selected(df, search, text).filter("role = 'match'")


def first_column(search: SearchSpec, line: Column) -> Column:
    """The 1-based byte column of a line's first match; null without one."""
    at = F.regexp_instr(line, F.lit(compile_patterns(search).regex))
    # regexp_instr is 0 for no match; an empty match has a place as well.
    return F.when(line.rlike(compile_patterns(search).regex), n_bytes(F.substring(line, F.lit(1), F.greatest(at, F.lit(1)) - 1), search.raw) + 1)


def replaced(search: SearchSpec, line: Column) -> Column:
    """A line with each match replaced by the template."""
    compiled = compile_patterns(search)
    return F.regexp_replace(line, F.lit(compiled.regex), F.lit(compile_template(search.template or "", compiled)))


def replace(df: DataFrame, search: SearchSpec, text: str = "text") -> DataFrame:
    """Matching lines as they are shown after replacement: the other columns, line_number, line."""
    lines = split_lines(prefiltered(df, search, text), text, search.separator).filter(hit(search, F.col("line")))
    return lines.select(*others(df, text), "line_number", replaced(search, F.col("line")).alias("line"))


def rewrite(df: DataFrame, search: SearchSpec, text: str = "text") -> DataFrame:
    """Documents with the replacement made in every line; no match crosses a line's end."""
    whole = F.coalesce(F.col(text), F.lit(""))
    ended = F.when(whole.endswith(search.separator), search.separator).otherwise("")
    lines = F.transform(line_array(F.col(text), search.separator), lambda x: replaced(search, x))
    new = F.when(F.col(text).isNotNull(), F.concat(F.array_join(lines, search.separator), ended))
    return df.select(*[new.alias(c) if c == text else F.col(c) for c in df.columns])


def captures(df: DataFrame, search: SearchSpec, text: str = "text") -> DataFrame:
    """A row per match and group: the other columns, line_number, match_index, group, name, value (empty where a group took no part)."""
    keys, compiled = others(df, text, "match_index", "group", "name", "value"), compile_patterns(search)
    names = {k: n for n, k in compiled.groups.items()}
    lines = split_lines(prefiltered(df, search, text), text, search.separator).filter(hit(search, F.col("line")))
    groups = [
        F.struct(F.lit(g).alias("group"), F.lit(names.get(g)).cast("string").alias("name"), F.regexp_extract_all("line", F.lit(compiled.regex), F.lit(g)).alias("values"))
        for g in range(compiled.n_groups + 1)
    ]
    rows = lines.select(*keys, "line_number", F.explode(F.array(*groups)).alias("g"))
    rows = items(rows, [*keys, "line_number", "g.group", "g.name"], "g.values", "match_index", "value")
    return rows.select(*keys, "line_number", "match_index", "group", "name", "value")


def search_multiline(df: DataFrame, search: SearchSpec, text: str = "text") -> DataFrame:
    """A row per match in whole texts: the other columns, span_index, start_byte, end_byte, text, first_line, last_line."""
    keys = others(df, text, "span_index", "start_byte", "end_byte", "text", "first_line", "last_line")
    rows = items(prefiltered(df, search, text), keys, covering_spans(search.but(multiline=True), F.coalesce(F.col(text), F.lit(""))), "span_index", "s")
    return rows.select(*keys, "span_index", *[F.col(f"s.{c}").alias(c) for c in ("start_byte", "end_byte", "text", "first_line", "last_line")])


def covering_spans(search: SearchSpec, text: Column) -> Column:
    """span_array of a whole text with the lines that each match covers; its final newline belongs to the line that it ends."""

    def lined(s: Column, n: Column) -> Column:
        first = F.least(s["lines_before"] + 1, F.greatest(n, F.lit(1)))
        last = F.greatest(F.least(s["lines_before"] + 1 + s["lines_inside"], n), first)
        return F.struct(s["start_byte"].alias("start_byte"), s["end_byte"].alias("end_byte"), s["text"].alias("text"), first.alias("first_line"), last.alias("last_line"))

    return let(text, lambda t: let(F.size(line_array(t)), lambda n: F.transform(_spans(search, t, True), lambda s: lined(s, n))))


def lines_covered(df: DataFrame, search: SearchSpec, text: str = "text") -> DataFrame:
    """The distinct lines that multi-line matches cover: the other columns, line_number."""
    keys = others(df, text)
    spans_ = covering_spans(search.but(multiline=True), F.coalesce(F.col(text), F.lit("")))
    covered = F.array_distinct(F.flatten(F.transform(spans_, lambda s: F.sequence(s["first_line"], s["last_line"]))))
    return items(prefiltered(df, search, text), keys, covered, "__pos", "line_number").drop("__pos")
