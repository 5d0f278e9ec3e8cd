"""How shown lines look: trimming, long lines, separators, and one text for a row's fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.operators.lines import n_bytes
from trawl.operators.spans import span_array
from trawl.spec import SearchSpec

# The notices for long lines.
OMITTED = {"match": "[Omitted long matching line]", "context": "[Omitted long context line]"}


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, F.lit("^[ \t\r\n]+"), F.lit(""))


def limited(search: SearchSpec, line: Column, role: Column | None = None, matches: Column | None = None) -> Column:
    """A line of max_columns bytes or more as a notice, or with max_columns_preview its first columns and a notice.

    matches: the number of matches, for the notice that counts them; with a preview, those that are left behind it, see
    remaining_matches(). Context lines have no number.
    """
    if search.max_columns is None:
        return line
    n = search.max_columns
    if search.max_columns_preview:
        plain = F.lit(" [... omitted end of long line]")
        counted = None if matches is None else F.concat(F.lit(" [... "), matches.cast("string"), F.when(matches == 1, " more match]").otherwise(" more matches]"))
        notice = plain if counted is None else counted if role is None else F.when(role == "match", counted).otherwise(plain)
        short = F.concat(F.substring(line, 1, n), notice)
    elif matches is not None:
        short = F.concat(F.lit("[Omitted long line with "), matches.cast("string"), F.lit(" matches]"))
    else:
        short = F.when((role if role is not None else F.lit("match")) == "match", OMITTED["match"]).otherwise(OMITTED["context"])
    return F.when(n_bytes(line, search.raw) >= n, short).otherwise(line)


def remaining_matches(search: SearchSpec, line: Column) -> Column:
    """The matches that start behind the previewed columns."""
    return F.size(F.filter(span_array(search, line), lambda s: s["start_byte"] >= search.max_columns))


def with_separator(path: Column, separator: str) -> Column:
    return F.translate(path, "/", separator)


def render_lines(rows: DataFrame, fields: list[str], line: str = "line", role: str | None = None, match_separator: str = ":", context_separator: str = "-") -> DataFrame:
    """rows with rendered: the fields and the line, with the match separator or, for context, the other one between them."""
    parts = [F.col(c).cast("string") for c in (*fields, line)]
    text = F.concat_ws(match_separator, *parts)
    if role:
        text = F.when(F.col(role) == "match", text).otherwise(F.concat_ws(context_separator, *parts))
    return rows.withColumn("rendered", text)


def sort_by(df: DataFrame, key: str = "path", reverse: bool = False, path: str = "path", time: str = "modificationTime") -> DataFrame:
    """By path, component by component, or by modified time and then path."""
    keys = [F.split(F.col(path), "/")] if key == "path" else [F.col(time), F.split(F.col(path), "/")]
    return df.orderBy(*[k.desc() if reverse else k.asc() for k in keys])


def bytes_printed(rows: DataFrame, rendered: str = "rendered") -> DataFrame:
    """One row: the bytes that rendered lines take, each with its line feed."""
    return rows.agg(F.coalesce(F.sum(F.octet_length(rendered) + 1), F.lit(0)).cast("long").alias("bytes_printed"))
