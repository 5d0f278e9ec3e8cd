"""Output shapes and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.operators.aggregate import doc_stats
from trawl.operators.context import selected_array
from trawl.operators.lines import items, let, n_bytes, others
from trawl.operators.spans import match_rows, span_array
from trawl.sources.written import written_once
from trawl.spec import SearchSpec


def data_object(content: Column) -> Column:
    """text for valid UTF-8, else bytes in base 64; to_json leaves out the one that is null."""
    text = content.cast("string")
    valid = F.is_valid_utf8(text)
    return F.struct(F.when(valid, text).alias("text"), F.when(~valid, F.base64(content.cast("binary"))).alias("bytes"))


COUNTERS = ("searches", "searches_with_match", "bytes_searched", "bytes_printed", "matched_lines", "matches")
_SUBMATCH = "struct<match:struct<text:string,bytes:string>,replacement:struct<text:string,bytes:string>,start:int,end:int>"


def _messages(df: DataFrame, search: SearchSpec, path: str, text: str) -> DataFrame:
    """A row per document: path, counters, and its begin and line messages, all made within the row in one reading."""
    own = df.select(F.col(path).cast("string").alias("path"), F.coalesce(F.col(text), F.lit("")).alias("whole"), F.col(text).alias("text"))
    rows = doc_stats(own, search).select("*", selected_array(search, F.col("whole")).alias("shown"))
    named = data_object(F.col("path")).alias("path")
    none = F.array().cast(f"array<{_SUBMATCH}>")
    blank = [F.lit(None).cast(k).alias(c) for c, k in (("line_number", "int"), ("absolute_offset", "bigint"), ("lines", "string"), ("submatches", "int"))]

    def content(text_: Column) -> Column:
        return data_object(F.encode(text_, "ISO-8859-1") if search.raw else text_)

    def submatch(s: Column) -> Column:
        replacement = F.when(s["replacement"].isNotNull(), content(s["replacement"]))
        return F.struct(content(s["text"]).alias("match"), replacement.alias("replacement"), s["start_byte"].alias("start"), s["end_byte"].alias("end"))

    def message(shown: Column) -> Column:
        ended = ~F.col("whole").endswith("\n") & (shown["absolute_offset"] + n_bytes(shown["line"], search.raw) >= n_bytes(F.col("whole"), search.raw))
        line = F.concat(shown["line"], F.when(ended, "").otherwise("\n"))
        found = none if search.invert else F.when(shown["role"] == "match", F.transform(span_array(search, shown["line"]), submatch)).otherwise(none)
        return let(found.cast(f"array<{_SUBMATCH}>"), lambda m: let(line, lambda whole: one(shown, whole, m)))

    def one(shown: Column, line: Column, found: Column) -> Column:
        data = F.struct(named, content(line).alias("lines"), shown["line_number"].alias("line_number"), shown["absolute_offset"].alias("absolute_offset"), found.alias("submatches"))
        value = F.to_json(F.struct(shown["role"].alias("type"), data.alias("data")))
        return F.struct(shown["role"].alias("type"), shown["line_number"].cast("long").alias("seq"), shown["line_number"].alias("line_number"), shown["absolute_offset"].alias("absolute_offset"), line.alias("lines"), F.size(found).alias("submatches"), value.alias("value"))

    begin = F.struct(F.lit("begin").alias("type"), F.lit(0).cast("long").alias("seq"), *blank, F.to_json(F.struct(F.lit("begin").alias("type"), F.struct(named).alias("data"))).alias("value"))
    lines = F.transform("shown", message)
    # Only documents with a match (with passthru: with a line) have events.
    messages = F.when(F.size("shown") > 0, F.concat(F.array(begin), lines)).otherwise(F.array().cast("array<struct<type:string,seq:bigint,line_number:int,absolute_offset:bigint,lines:string,submatches:int,value:string>>"))
    rows = rows.select("path", *[c for c in COUNTERS if c != "bytes_printed"], messages.alias("messages"))
    printed = F.aggregate("messages", F.lit(0).cast("long"), lambda n, m: n + F.octet_length(m["value"]) + 1)
    return rows.withColumn("bytes_printed", printed)


def event_columns(df: DataFrame, search: SearchSpec, path: str = "path", text: str = "text") -> DataFrame:
    """The events as columns: type, path, seq, line_number, absolute_offset, lines, submatches (their number), the counters of
    end and summary (bytes_printed: the begin and line messages with their line feeds), and value, the event as JSON.

    seq orders the events of a path: begin, its lines, end. Messages and counters are written once, as one reading of the documents
    gives them; events and summary are made of that.
    """
    rows = written_once(_messages(df, search, path, text), "search-messages")
    counted = F.struct(*COUNTERS).alias("stats")
    end = F.to_json(F.struct(F.lit("end").alias("type"), F.struct(data_object(F.col("path")).alias("path"), counted).alias("data")))
    kinds = "struct<type:string,seq:bigint,line_number:int,absolute_offset:bigint,lines:string,submatches:int,value:string>"
    last = F.struct(F.lit("end"), F.lit(2**62), *[F.lit(None).cast(k) for k in ("int", "bigint", "string", "int")], end).cast(kinds)
    every = F.when(F.size("messages") > 0, F.array_append("messages", last)).otherwise(F.col("messages"))
    events = rows.select("path", *COUNTERS, F.inline_outer(every)).filter("type IS NOT NULL")
    events = events.select("type", "path", "seq", "line_number", "absolute_offset", "lines", "submatches", *[F.when(F.col("type") == "end", F.col(c)).alias(c) for c in COUNTERS], "value")
    total = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS))
    whole = F.to_json(F.struct(F.lit("summary").alias("type"), F.struct(counted).alias("data")))
    summary = total.select(F.lit("summary").alias("type"), F.lit(None).cast("string").alias("path"), F.lit(2**62).alias("seq"), *[F.lit(None).cast(k).alias(c) for c, k in (("line_number", "int"), ("absolute_offset", "bigint"), ("lines", "string"), ("submatches", "int"))], *COUNTERS, whole.alias("value"))
    return events.unionByName(summary)


def json_events(df: DataFrame, search: SearchSpec, path: str = "path", text: str = "text") -> DataFrame:
    """path, seq, value: one JSON text an event; order by path (null last) and seq, then write as text. With a raw search,
    what isn't UTF-8 is an object with bytes instead of text."""
    return event_columns(df, search, path, text).select("path", "seq", "value")


def write_json_events(df: DataFrame, search: SearchSpec, out: str, path: str = "path", text: str = "text") -> None:
    """The events as text files whose rows are sorted by path and place."""
    events = json_events(df, search, path, text).repartitionByRange(F.col("path").asc_nulls_last(), "seq")
    events.sortWithinPartitions(F.col("path").asc_nulls_last(), "seq").select("value").write.text(out)


def vimgrep(df: DataFrame, search: SearchSpec, path: str = "path", text: str = "text") -> DataFrame:
    """A row per match: path, line_number, column, line."""
    keys = [c for c in others(df, text) if c == path]
    rows = items(match_rows(df.select(*keys, text), search, text), [*keys, "line_number", "line"], "spans", "__pos", "s")
    return rows.select(F.col(path).alias("path"), "line_number", F.col("s.start_column").alias("column"), "line")


def write_paths(df: DataFrame, out: str, path: str = "path", nul: bool = False) -> None:
    """The paths as text, each followed by a newline or NUL."""
    df.select(F.col(path).cast("string")).write.option("lineSep", "\0" if nul else "\n").text(out)


def search(df: DataFrame, spec: SearchSpec, text: str = "text") -> DataFrame:
    """The library's search: lines, matches and spans, ready to be written."""
    return match_rows(df, spec, text)

