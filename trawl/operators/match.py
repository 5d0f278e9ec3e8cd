"""Match predicates: one Column for a whole search, evaluated where the scan runs."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawl.functions.dialect import Compiled, compile_patterns, in_order, ordered
from trawl.operators import pattern_index
from trawl.operators.lines import line_array, others, split_lines
from trawl.sources.written import written_once
from trawl.spec import SearchSpec, SpecError, spec

#: Most patterns that are constants of a plan.
MOST_PATTERNS = 100_000

#: Patterns whose lines are told apart in one reading of the corpus; up to FEW_PATTERNS are tried without an index.
PATTERNS_A_PASS, FEW_PATTERNS = 1000, 20

#: Characters, at least, of a text that a regular expression needs and is looked up by.
LEAST_CHARS = 3

#: Rows of two numbers that are broadcast.
MOST_SENT = 8_000_000


def found(search: SearchSpec, line: Column) -> Column:
    """Whether any pattern is found in a line, before inversion."""
    if not search.patterns:
        return F.lit(False)
    compiled = compile_patterns(search)
    if compiled.literals is not None:
        return F.lit(True) if "" in compiled.literals else reduce(or_, (line.contains(t) for t in compiled.literals))
    return line.rlike(compiled.regex)


def hit(search: SearchSpec, line: Column) -> Column:
    return ~found(search, line) if search.invert else found(search, line)


def may_match(search: SearchSpec, text: Column) -> Column | None:
    """A cheap test that every document with a match passes, which Parquet scans can take; None if there is none."""
    if search.invert or search.passthru or not search.patterns:
        return None
    compiled = compile_patterns(search)
    if compiled.literals is not None:
        return None if "" in compiled.literals else reduce(or_, (text.contains(t) for t in compiled.literals))
    return text.contains(compiled.required) if compiled.required else None


def prefiltered(df: DataFrame, search: SearchSpec, text: str = "text") -> DataFrame:
    test = may_match(search, F.col(text))
    return df if test is None else df.filter(test)


def grep(df: DataFrame, search: SearchSpec, text: str = "text") -> DataFrame:
    """A row per matching line: the other columns, line_number, line."""
    lines = split_lines(prefiltered(df, search, text), text, search.separator)
    return lines.filter(hit(search, F.col("line"))).select(*others(df, text), "line_number", "line")


def _known(patterns: DataFrame, column: str) -> DataFrame:
    """The distinct patterns of a table, without a carriage return at the end; null ones don't count."""
    return patterns.select(F.regexp_replace(column, "\r$", "").alias("word")).filter("word IS NOT NULL").distinct()


def patterns_from(df: DataFrame, column: str = "pattern") -> tuple[str, ...]:
    """Patterns of a table, without a carriage return at the end; null ones don't count."""
    rows = _known(df, column).limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise SpecError(f"more than {MOST_PATTERNS} patterns")
    return tuple(sorted(r[0] for r in rows))


def grep_table(df: DataFrame, patterns: DataFrame, column: str = "pattern", text: str = "text") -> DataFrame:
    """grep for the fixed strings of a table of any size.

    Up to PATTERNS_A_PASS of them are constants of the plan. More are looked up in an index of their grams where lines are read,
    in one reading and without a shuffle; beyond pattern_index.MOST_CHARS characters, ids of lines are joined with patterns by gram.
    """
    known = _known(patterns, column)
    n, chars, empty = known.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0)), F.coalesce(F.max(F.col("word") == ""), F.lit(False))).first()
    if n <= PATTERNS_A_PASS or empty:
        return grep(df, spec(*(("",) if empty else patterns_from(patterns, column)), fixed=True), text)
    keys, lines = others(df, text), split_lines(df, text).drop("terminator")
    if chars <= pattern_index.MOST_CHARS:
        words = known.toArrow().column("word").combine_chunks()
        return pattern_index.indexed(lines, pattern_index.GramIndex(words, np.arange(len(words)))).select(*keys, "line_number", "line")
    return pattern_index.met(_numbered(lines), known, "__id").dropDuplicates(["__id"]).select(*keys, "line_number", "line")


def _numbered(lines: DataFrame) -> DataFrame:
    """lines with an id, written once, so that both sides of a join see the same ids."""
    return written_once(lines.withColumn("__id", F.monotonically_increasing_id()), "numbered-lines")


def patterns_of(text: str) -> tuple[str, ...]:
    """Patterns of a pattern file: one a line; a final newline is no further pattern; an empty file has none."""
    lines = text.split("\n")
    return tuple(line.removesuffix("\r") for line in (lines[:-1] if lines[-1] == "" else lines))


def attribute(df: DataFrame, patterns: DataFrame, search: SearchSpec | None = None, text: str = "text") -> DataFrame:
    """Which patterns (pattern_id, pattern) each line matches: the other columns, line_number, pattern_id.

    Patterns that are plain texts, or hold one that every match has, are looked up by it in one reading of the corpus, and regular
    expressions tried only on the lines that hold it, each once however many ids it has; ids come last, so that no line's text is
    repeated for them. Two texts with .* between are looked up both, and told by their places without an expression. Patterns without such a text are tried on every line, PATTERNS_A_PASS of them in a reading; there may be
    MOST_PATTERNS of these. Repeated rows of patterns count once. Needed texts and distinct patterns of more than
    pattern_index.MOST_CHARS characters are looked up by join.
    """
    search, keys = search or spec(), others(df, text, "pattern_id")
    own = patterns.select("pattern_id", "pattern").filter("pattern IS NOT NULL").distinct()
    lines = split_lines(df, text, search.separator).select(*keys, "line_number", "line")
    # The first rows tell mostly, and don't take the whole table as its distinct rows do.
    many = len(patterns.select("pattern_id", "pattern").filter("pattern IS NOT NULL").limit(FEW_PATTERNS + 1).collect()) > FEW_PATTERNS
    own = written_once(own, "patterns") if many else own
    few = own.limit(FEW_PATTERNS + 1).collect()
    if len(few) <= FEW_PATTERNS:
        return _tried(lines, few, search, own, keys)
    each = written_once(_needed(own, search).withColumn("__p", F.monotonically_increasing_id()), "distinct-patterns")
    ids = own.join(each.select("pattern", "__p"), "pattern").select("__p", "pattern_id")
    rest = own.join(each.filter("words IS NULL").select("pattern"), "pattern").select("pattern_id", "pattern").limit(MOST_PATTERNS + 1).collect()
    each = each.filter("words IS NOT NULL")
    out = [_looked_up(lines, each, keys).join(_sent(ids), "__p").select(*keys, "line_number", "pattern_id")]
    return reduce(DataFrame.unionByName, [*out, _tried(lines, rest, search, own, keys)] if rest else out)


def _needed(own: DataFrame, search: SearchSpec) -> DataFrame:
    """The distinct patterns, words (as _needs has them), behind and __regex, worked out in tasks.

    __regex is null for plain texts; with behind, a line matches where it holds one of these texts behind one of words, and not otherwise."""

    def one(pattern: str) -> tuple:
        own = search.but(patterns=(pattern,))
        parts = in_order(own) or []
        if 1 <= len(parts) <= 2 and min(map(len, parts[0])) >= LEAST_CHARS:
            return (*parts, None, None)[:2] + (ordered(parts) if len(parts) == 2 else None,)
        compiled = compile_patterns(own)
        return _needs(compiled), None, None if compiled.literals is not None else compiled.regex

    def run(batches):
        for b in batches:
            words, behind, regex = zip(*map(one, b["pattern"])) if len(b) else ((), (), ())
            yield b.assign(words=words, behind=behind, __regex=regex)

    # Few bytes, but some work for each: dealt out to all cores.
    each = own.select("pattern").distinct().repartition(own.sparkSession.sparkContext.defaultParallelism, "pattern")
    return each.mapInPandas(run, "pattern string, words array<string>, behind array<string>, __regex string")


def _sent(rows: DataFrame) -> DataFrame:
    """rows of numbers, broadcast where they are few enough."""
    return F.broadcast(rows) if rows.count() <= MOST_SENT else rows


def _looked_up(lines: DataFrame, each: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_number, __p: the patterns with needed words that each line matches."""
    texts = each.select(F.explode(F.array("words", "behind")).alias("words")).filter("words IS NOT NULL").distinct()
    groups = written_once(texts.withColumn("__g", F.monotonically_increasing_id()), "needed-texts")
    words = groups.select("__g", F.explode("words").alias("word"))
    known = each.join(groups, "words")
    matches = F.col("__regex").isNull() | F.regexp_like("line", F.col("__regex"))
    alone, pairs = known.filter("behind IS NULL").select("__g", "__p", "__regex"), known.filter("behind IS NOT NULL")
    size = lambda rows, column: rows.agg(F.coalesce(F.sum(F.length(column)), F.lit(0))).first()[0]
    if size(words, "word") + size(each, "pattern") <= pattern_index.MOST_CHARS:
        held = words.toArrow().combine_chunks()
        # A pair is found under a number of its own, below 0.
        seconds = groups.select(F.col("words").alias("behind"), F.col("__g").alias("__second"))
        both = pairs.join(seconds, "behind").select("__g", "__second", (-1 - F.col("__p")).alias("__pair")).toArrow()
        both = np.stack([both.column(k).to_numpy() for k in both.column_names], axis=1)
        own = alone.groupBy("__g").agg(F.count("__regex").alias("n")).toArrow()
        single, tried = own.column("__g").to_numpy(), own.column("n").to_numpy() > 0
        index = pattern_index.GramIndex(held.column("word").combine_chunks(), held.column("__g").to_numpy(), both, single)
        known = alone.unionByName(pairs.select((-1 - F.col("__p")).alias("__g"), "__p", F.lit(None).cast("string").alias("__regex")))
        # As large as the patterns, which were counted.
        found = pattern_index.indexed(lines, index, number="__g", texts_of=single[tried]).join(F.broadcast(known), "__g")
        return found.filter(matches).select(*keys, "line_number", "__p")
    # Distinct texts meet ids of lines; patterns come to the lines that hold them.
    known = known.select("__g", "__p", "__regex")
    words = words.join(known, "__g", "left_semi")
    held = pattern_index.met(_numbered(lines), words.select("word").distinct(), "__id").join(words, "word").join(known, "__g")
    return held.filter(matches).dropDuplicates(["__id", "__p"]).select(*keys, "line_number", "__p")


def _needs(compiled: Compiled) -> tuple[str, ...] | None:
    """Texts one of which every line with a match holds; None where there are none."""
    words = compiled.literals if compiled.literals is not None else (compiled.required or "",)
    return words if all(words) else None


def _tried(lines: DataFrame, rows: list, search: SearchSpec, own: DataFrame, keys: list[str]) -> DataFrame:
    """Patterns as constants of the plan, tried on every line."""
    if len(rows) > MOST_PATTERNS:
        raise SpecError(f"more than {MOST_PATTERNS} patterns without a plain text that every match holds")
    kind = own.schema["pattern_id"].dataType
    passes = [rows[k : k + PATTERNS_A_PASS] for k in range(0, len(rows), PATTERNS_A_PASS)] or [[]]
    one = lambda r: F.when(found(search.but(patterns=(r[1],)), F.col("line")), F.struct(F.lit(r[0]).cast(kind).alias("pattern_id")))
    kinds = F.array().cast(T.ArrayType(T.StructType([T.StructField("pattern_id", kind)])))
    each = [F.array_compact(F.array(*map(one, part))) if part else kinds for part in passes]
    return reduce(DataFrame.unionByName, [lines.select(*keys, "line_number", F.inline(ids)) for ids in each])


def binary_policy(df: DataFrame, search: SearchSpec, mode: str = "auto", content: str = "content", explicit: str = "is_explicit") -> DataFrame:
    """A row per document with what is to be shown: the other columns, binary_offset, matched, show_lines, record.

    auto: a document with a NUL byte is passed over, or, when it was named explicitly, gets one record instead of
    lines. search: any binary document gets the record. text: NUL is an ordinary byte. content is binary or a string.
    """
    if mode not in ("auto", "search", "text"):
        raise SpecError(f"mode is auto, search or text, not {mode!r}")
    string = dict(df.dtypes)[content] == "string"
    at = F.locate("\0", F.col(content)) if string else F.position(F.lit(b"\0"), F.col(content))
    text = F.col(content) if string else F.make_valid_utf8(F.col(content).cast("string"))
    # A match that starts before or behind the NUL counts alike: documents are searched whole.
    offset = F.when(at > 0, F.octet_length(F.substring_index(F.col(content), "\0", 1)) if string else at - 1)
    rows = df.select(*others(df, content), F.coalesce(F.col(explicit), F.lit(False)).alias("__explicit"), offset.cast("long").alias("binary_offset"), F.exists(line_array(text), lambda x: hit(search, x)).alias("matched"))
    binary = F.col("binary_offset").isNotNull() & F.lit(mode != "text")
    searched = ~binary | F.lit(mode == "search") | F.col("__explicit")
    matched = F.col("matched") & searched
    out = rows.select(*[c for c in rows.columns if c not in ("__explicit", "binary_offset", "matched")], F.when(binary, F.col("binary_offset")).alias("binary_offset"), matched.alias("matched"), (~binary & matched).alias("show_lines"), (binary & matched).alias("record"))
    return out

