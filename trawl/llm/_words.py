"""Word arrays for the operators that take runs of ASCII letters, digits and non-ASCII characters as words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._common import lower_ascii

#: What separates words once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The same for DuckDB, with words as matches.
SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def word_array(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")
