"""Search over streams. Row-wise operators work on streams as they are; these are the ones that keep state."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from trawl.operators.match import hit
from trawl.operators.spans import match_rows
from trawl.spec import SearchSpec

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def search_stream(stream: DataFrame, search: SearchSpec, text: str = "text") -> DataFrame:
    """Matching lines with spans from a stream of whole documents; no state, append mode."""
    return match_rows(stream, search, text)


def grep_stream(stream: DataFrame, search: SearchSpec, line: str = "line") -> DataFrame:
    """Matching rows from a stream of lines."""
    return stream.filter(hit(search, F.col(line)))


def running_counts(stream: DataFrame, search: SearchSpec, *keys: str, line: str = "line") -> DataFrame:
    """Matching lines of each key as they arrive; for the update or complete mode."""
    return grep_stream(stream, search, line).groupBy(*keys).agg(F.count("*").alias("n"))


def windowed_counts(stream: DataFrame, search: SearchSpec, time: str = "ts", line: str = "line", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An addition: matching rows in each tumbling window of event time; rows later than the watermark don't count."""
    rows = grep_stream(stream, search, line).withWatermark(time, late).groupBy(F.window(time, length).alias("w"))
    return rows.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


#: The name of the mark that goes along; pandas renames columns that start with an underscore.
_HIT = "row_is_a_hit"
_STATE = StructType([StructField("a", LongType()), StructField("b", LongType())])


class Step:
    """What a run of a key's rows, in order, and two numbers of state give: places of rows that are kept, columns that are made for
    them, and the next numbers. hits: whether each row matches; lines: their texts."""

    made: tuple[str, ...] = ()

    def __call__(self, hits: list[bool], lines: list[str | None], a: int, b: int) -> tuple[list[int], list[list[int]], tuple[int, int]]:
        raise NotImplementedError


class First(Step):
    """At most n rows that are hits; a counts those so far."""

    def __init__(self, n: int):
        self.n = n

    def __call__(self, hits, lines, a, b):
        kept = [k for k, is_hit in enumerate(hits) if is_hit][: max(0, self.n - a)]
        return kept, [], (a + len(kept), b)


class Run(Step):
    """The first run of hits; a is 0 before it, 1 in it and 2 behind it."""

    def __call__(self, hits, lines, a, b):
        kept = []
        for k, is_hit in enumerate(hits):
            a = 1 if a == 0 and is_hit else 2 if a == 1 and not is_hit else a
            if a == 1:
                kept.append(k)
        return kept, [], (a, b)


class Numbered(Step):
    """Line numbers and byte offsets; a lines and b bytes have passed."""

    made = ("line_number", "absolute_offset")

    def __call__(self, hits, lines, a, b):
        starts = [*accumulate((len((x or "").encode()) + 1 for x in lines), initial=b)]
        return [*range(len(lines))], [[*range(a + 1, a + 1 + len(lines))], starts[:-1]], (a + len(lines), starts[-1])


class _Keyed(StatefulProcessor):
    """A step with its state for each key; rows of a trigger are taken in the order of a sequence column, all of a key at once
    (streaming.ordered takes them one batch after the other)."""

    def __init__(self, order: str, line: str, step: Step, expires: int | None):
        self.order, self.line, self.step, self.expires = order, line, step, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("numbers", _STATE, self.expires)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get() if self.state.exists() else (0, 0)
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        kept, made, now = self.step(batch[_HIT].tolist(), batch[self.line].tolist(), int(now[0]), int(now[1]))
        self.state.update(now)
        if kept:
            yield batch.iloc[kept].drop(columns=_HIT).assign(**dict(zip(self.step.made, made)))

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, search: SearchSpec | None, key: str, line: str, processor: _Keyed, extra: str = "") -> DataFrame:
    """A key's state is removed once it had no rows for the milliseconds that the processor has as expires."""
    marked = stream.withColumn(_HIT, F.coalesce(hit(search, F.col(line)), F.lit(False)) if search else F.lit(True))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema) + extra
    return marked.groupBy(key).transformWithStateInPandas(processor, outputStructType=kinds, outputMode="Append", timeMode="ProcessingTime" if processor.expires else "None")


def max_count_stream(stream: DataFrame, search: SearchSpec, key: str, order: str, line: str = "line", expires: int | None = None) -> DataFrame:
    """The first max_count matching rows of each key. Needs the RocksDB state store (ROCKS)."""
    return _stateful(stream, search, key, line, _Keyed(order, line, First(search.max_count or 0), expires))


def stop_stream(stream: DataFrame, search: SearchSpec, key: str, order: str, line: str = "line", expires: int | None = None) -> DataFrame:
    """Each key's first run of matching rows."""
    return _stateful(stream, search, key, line, _Keyed(order, line, Run(), expires))


def number_stream(stream: DataFrame, key: str, order: str, line: str = "line", expires: int | None = None) -> DataFrame:
    """line_number and absolute_offset of each row within its key, in the order of a sequence column."""
    return _stateful(stream, None, key, line, _Keyed(order, line, Numbered(), expires), ", line_number bigint, absolute_offset bigint")
