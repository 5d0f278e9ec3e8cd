"""Searches that keep state by key and take rows in order, for keys of any number of rows in a trigger.

Each micro-batch is dealt by key and sorted by key and order on Spark, which spills; tasks then walk the sorted rows a batch of
Arrow at a time, with two numbers of state for the key at hand. A key's state comes as a row in front of its own rows, and leaves
as one behind them. A version of all states is written with each micro-batch, so a micro-batch that is run again starts from the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from trawl.operators.match import hit
from trawl.spec import SearchSpec
from trawl.streaming.search import _HIT, First, Numbered, Run, Step

#: Versions of the states that are kept: the last one, and the one that it was made from.
VERSIONS = 2

_STATE = ("state_a", "state_b", "state_seen", "row_is_state")


def walked(rows: DataFrame, key: str, line: str, step: Step) -> DataFrame:
    """Rows sorted by key, states first, through step; the new states come as rows with row_is_state."""
    kept = [f for f in rows.schema if f.name not in (_HIT, *_STATE)]
    made = [T.StructField(c, T.LongType()) for c in step.made]
    states = [rows.schema[c] for c in _STATE]
    # A row of state has nulls where other rows never do.
    kinds = T.StructType([T.StructField(f.name, f.dataType) for f in (*kept, *made, *states)])
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        at, a, b, seen, used, like = nothing, 0, 0, None, False, None

        def new_state() -> pa.RecordBatch:
            # like: a row with the key. A key without new rows keeps the time at which it had some.
            when = like.column(names.index("state_seen")).type
            values = {key: like.column(names.index(key)), "state_a": pa.array([a]), "state_b": pa.array([b]), "state_seen": pa.array([datetime.now(timezone.utc) if used else seen], when), "row_is_state": pa.array([True])}
            others = [values.get(f.name, pa.nulls(1, like.column(names.index(f.name)).type if f.name in names else pa.int64())) for f in kinds]
            return pa.RecordBatch.from_arrays(others, names=kinds.names)

        for batch in batches:
            column = lambda c: batch.column(names.index(c)).to_pylist()  # noqa: B023, E731
            keys, hits, texts, is_state = column(key), column(_HIT), column(line), column("row_is_state")
            ends = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]] + [len(keys)]
            for start, end in zip([0, *ends], ends):
                if at is nothing or keys[start] != at:
                    if at is not nothing:
                        yield new_state()
                    at, a, b, seen, used, like = keys[start], 0, 0, None, False, batch.slice(start, 1)
                if is_state[start]:
                    a, b, seen = (batch.column(names.index(c))[start].as_py() for c in ("state_a", "state_b", "state_seen"))
                    start += 1
                if start < end:
                    used = True
                    places, columns, (a, b) = step(hits[start:end], texts[start:end], a, b)
                    if places:
                        own = batch.take(pa.array([start + k for k in places]))
                        made_ = dict(zip(step.made, columns)) | {"row_is_state": [False] * len(places)}
                        arrays = [pa.array(made_[f.name]) if f.name in made_ else pa.nulls(len(places), own.column(names.index(f.name)).type) if f.name in _STATE else own.column(names.index(f.name)) for f in kinds]
                        yield pa.RecordBatch.from_arrays(arrays, names=kinds.names)
        if at is not nothing:
            yield new_state()

    return rows.mapInArrow(run, kinds)


def ordered(stream: DataFrame, search: SearchSpec | None, key: str, order: str, line: str, step: Step, sink: Callable[[DataFrame, int], None], folder: str, expires: str | None = None) -> DataStreamWriter:
    """A writer that hands each micro-batch's result to sink(rows, batch id) and keeps states under folder, which driver and executors share.

    expires: an interval ("2 hours") after which the state of a key without rows is removed; a later row starts it anew. A null key is
    a key like any other.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marked = batch.withColumn(_HIT, F.coalesce(hit(search, F.col(line)), F.lit(False)) if search else F.lit(True)).withColumn("row_is_state", F.lit(False))
        kinds = "state_a long, state_b long, state_seen timestamp"
        before = spark.read.parquet(f"{folder}/{number - 1}/state") if number else spark.createDataFrame([], T.StructType([batch.schema[key], *T._parse_datatype_string(kinds).fields]))
        if expires:
            before = before.filter(F.col("state_seen") >= F.current_timestamp() - F.expr(f"INTERVAL {expires}"))
        rows = before.withColumn("row_is_state", F.lit(True)).unionByName(marked, allowMissingColumns=True)
        names = [*batch.columns, _HIT, *_STATE]
        dealt = rows.select(*names).repartition(F.col(key)).sortWithinPartitions(key, F.desc("row_is_state"), order)
        out = walked(dealt, key, line, step)
        out.write.mode("overwrite").partitionBy("row_is_state").parquet(f"{folder}/{number}/all")
        whole = spark.read.schema(out.schema).parquet(f"{folder}/{number}/all")
        whole.filter("row_is_state").select(key, "state_a", "state_b", "state_seen").write.mode("overwrite").parquet(f"{folder}/{number}/state")
        sink(whole.filter("NOT row_is_state").drop(*_STATE), number)
        for old in range(max(0, number - VERSIONS - 1), number - VERSIONS + 1):
            there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{old}")
            there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)

    return stream.writeStream.foreachBatch(take)


def max_count_ordered(stream: DataFrame, search: SearchSpec, key: str, order: str, sink, folder: str, line: str = "line", expires: str | None = None) -> DataStreamWriter:
    """The first max_count matching rows of each key."""
    return ordered(stream, search, key, order, line, First(search.max_count or 0), sink, folder, expires)


def stop_ordered(stream: DataFrame, search: SearchSpec, key: str, order: str, sink, folder: str, line: str = "line", expires: str | None = None) -> DataStreamWriter:
    """Each key's first run of matching rows."""
    return ordered(stream, search, key, order, line, Run(), sink, folder, expires)


def number_ordered(stream: DataFrame, key: str, order: str, sink, folder: str, line: str = "line", expires: str | None = None) -> DataStreamWriter:
    """line_number and absolute_offset of each row within its key."""
    return ordered(stream, None, key, order, line, Numbered(), sink, folder, expires)
