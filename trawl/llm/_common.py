"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that several operators split on or delete.
SPACES = " \t\n\x0b\x0c\r"

#: Most ids that are ever broadcast (16 bytes each); beyond it, joins shuffle.
BROADCAST_IDS = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset, and all runs on one machine, one of our own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    system, there = hadoop_path(spark, path)
    system.deleteOnExit(there)
    return path


def hadoop_path(spark: SparkSession, path: str):
    """A path's file system and the path for it."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, which appears whole."""
    system, there = hadoop_path(spark, path)
    _, part = hadoop_path(spark, re.sub("([^/]*)$", rf"_\1.{uuid.uuid4().hex}", path))
    out = system.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    system.delete(there, False)
    if not system.rename(part, there):
        raise OSError(f"{path} can't be written")


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of such a file, or None where there is none."""
    system, there = hadoop_path(spark, path)
    if not system.exists(there):
        return None
    file = system.open(there)
    data = bytes(file.readAllBytes())
    file.close()
    return data.decode()


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete written tables that nothing reads any more, and what frames owe."""
    for df in frames:
        release(*df.__dict__.pop("owes", ()))
        if path := df.__dict__.pop("staged_at", None):
            system, there = hadoop_path(df.sparkSession, path)
            system.delete(there, True)


def owing(df: DataFrame, *frames: DataFrame) -> DataFrame:
    """df, which still reads these written tables; release(df) deletes them once df itself has been written."""
    df.owes = frames
    return df


def lean(*forget: Callable[[], None]) -> Callable:
    """For functions over a partition's batches: at its end, caches are emptied and free memory goes back to the system.

    Spark uses its Python workers again, beside those of other operators."""

    def around(run: Callable) -> Callable:
        @wraps(run)
        def wrapped(batches: Iterator) -> Iterator:
            try:
                yield from run(batches)
            finally:
                for clear in forget:
                    clear()
                pa.default_memory_pool().release_unused()
                if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                    trim(0)

        return wrapped

    return around


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII strings take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


#: The column that tells rows apart where ids are null or repeated.
ROW = "__row"


def numbered(docs: DataFrame) -> DataFrame:
    """docs written once with ROW. A column that has this name already is put off to another one."""
    own = [F.col(f"`{c}`").alias(f"{c}_own" if re.fullmatch(rf"{ROW}(_own)*", c.lower()) else c) for c in docs.columns]
    return staged(docs.select(*own, F.monotonically_increasing_id().alias(ROW)), "numbered-rows")


def drop_rows(rows: DataFrame, gone: DataFrame, n: int) -> DataFrame:
    """Numbered rows without the n that are in gone (ROW), and with the columns from before they were numbered."""
    left = rows.join(F.broadcast(gone) if n <= BROADCAST_IDS else gone, ROW, "left_anti").drop(ROW)
    back = [F.col(f"`{c}`").alias(c.removesuffix("_own") if re.fullmatch(rf"{ROW}(_own)+", c.lower()) else c) for c in left.columns]
    return owing(left.select(*back), rows, gone)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Keys with at least one row in so many are hot; there are at most as many of them.
HOT_SHARE = 1000


def looked_up(rows: DataFrame, table: DataFrame, key: str, n_rows: str, total: int) -> DataFrame:
    """rows inner-joined with table, which has one row per key and counts in n_rows how many of total rows have it.

    A hot key's row is broadcast (there are at most HOT_SHARE), so its rows are joined where they lie; others shuffle.
    """
    hot = (F.col(n_rows) * HOT_SHARE >= max(total, HOT_SHARE)).alias("__hot")
    marked = rows.join(F.broadcast(table.filter(hot).withColumn("__hot", F.lit(True))), key, "left")
    cold = marked.filter(F.col("__hot").isNull()).select(*rows.columns).join(table.filter(~hot), key)
    return marked.filter(F.col("__hot").isNotNull()).drop("__hot").unionByName(cold)
