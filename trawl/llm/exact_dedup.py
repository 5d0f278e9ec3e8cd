"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, one row per distinct text. A batch of documents is
reduced to one row per digest, sort-merge anti-joined with the index and appended to it. Documents then look up
the row that stays for their digest. A digest that holds a thousandth of the batch or more (there are at most a
thousand of those) is looked up by broadcast, so that a hot group of copies never meets in one task.

The number of buckets is written beside the index and used whenever it is opened; another one is refused. A batch is
appended under its id and counts once a marker of its own stands in the folder, so a batch that was broken off can be added
again, and one that is there already adds nothing and gets the same answer.

Each batch adds a file to a bucket and a marker to the folder. compact() writes the entries that count to a new generation of
the table, one sorted file a bucket, with the ids of its batches as rows of a table; add() does so by itself once MOST_OPEN
batches stand open. So neither files, markers nor constants of a plan grow with the number of batches. A generation counts once
a manifest names it; the one before it is left for readers until the next. One application writes to an index at a time.

Texts are equal when they are identical once ASCII white space is deleted. Of a batch's equal texts the row with
the most code points stays, then the smallest doc_id; an earlier batch's row always stays.

Defined cases: a null text counts as empty, and all empty texts are equal. A null doc_id is a document like any
other and loses ties against ids. Of wholly repeated rows exactly one stays. An empty table gives no rows.
Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import ROW, SPACES, drop_rows, hadoop_path, looked_up, new_path, numbered, owing, read_text, release, shuffle_partitions, staged, write_text

_SCHEMA = T.StructType(
    [T.StructField("digest", T.BinaryType()), T.StructField("keep_id", T.LongType()), T.StructField("attempt", T.StringType()), T.StructField("folded", T.BooleanType())]
)

#: Batches that stand open (a marker, a constant of the plans and a file a bucket each) before they are folded.
MOST_OPEN = 64


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_code_points, digest (SHA-256 of the text without white space), row_id; one row per row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(text).alias("n_code_points"),
        F.unhex(F.sha2(F.translate(text, SPACES, ""), 256)).alias("digest"),
        (F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()).alias("row_id"),
    )


class ExactDedupIndex:
    """A digest index kept at a path; open the same path again to go on with it in a later application."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        """path: a shared folder; None makes an index that lasts as long as the application. buckets: of a new index."""
        self.spark = spark
        self.path = path or new_path(spark, "digest-index")
        known = self._manifest()
        self.buckets = known["buckets"] if known else buckets or shuffle_partitions(spark)
        if buckets not in (None, self.buckets):
            raise ValueError(f"the index has {self.buckets} buckets, not {buckets}")
        if not known:
            known = {"generation": 0, "buckets": self.buckets, "folder": "g0", "ids": None}
            write_text(spark, f"{self.path}/_manifests/m0", json.dumps(known))
        self._open(known, self._create(known["folder"]))

    def _names(self, folder: str) -> list[str]:
        system, there = hadoop_path(self.spark, f"{self.path}/{folder}")
        return [s.getPath().getName() for s in system.listStatus(there)] if system.exists(there) else []

    def _manifest(self) -> dict | None:
        """The manifest that counts, which is the newest one."""
        newest = max((int(name[1:]) for name in self._names("_manifests") if name[0] == "m"), default=None)
        return None if newest is None else json.loads(read_text(self.spark, f"{self.path}/_manifests/m{newest}"))

    def _create(self, folder: str) -> str:
        table = f"digest_index_{uuid.uuid4().hex}"
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _SCHEMA)
        self.spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'"
        )
        return table

    def _write(self, rows: DataFrame, table: str) -> None:
        rows = rows.repartition(self.buckets, "digest")
        rows.write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").saveAsTable(table)

    def _open(self, manifest: dict, table: str) -> None:
        self.generation, self.folder, self.ids, self.table = manifest["generation"], manifest["folder"], manifest["ids"], table

    def batches(self) -> dict[str, str]:
        """The ids of the open batches, each with the attempt that wrote it; there are at most MOST_OPEN."""
        names = [name for name in self._names(f"{self.folder}/_batches") if name[0] == "b"]
        return {base64.urlsafe_b64decode(name[1:]).decode(): read_text(self.spark, f"{self.path}/{self.folder}/_batches/{name}") for name in names}

    def folded(self) -> DataFrame:
        """batch, attempt: a row for each batch that was folded."""
        schema = "batch string, attempt string"
        return self.spark.read.schema(schema).parquet(f"{self.path}/{self.ids}") if self.ids else self.spark.createDataFrame([], schema)

    def _attempt(self, batch: str) -> str | None:
        """The attempt that wrote a batch, if it is in the index."""
        if own := self.batches().get(batch):
            return own
        row = self.folded().filter(F.col("batch") == batch).first() if self.ids else None
        return row and row.attempt

    def entries(self) -> DataFrame:
        """digest, keep_id, attempt: the texts of all batches that count."""
        counts = F.col("folded") | F.col("attempt").isin([*self.batches().values()])
        return self.spark.table(self.table).filter(counts).drop("folded")

    def compact(self) -> None:
        """Fold the open batches into a new generation; what batches that were broken off left isn't taken along."""
        generation, before = self.generation + 1, (self.folder, self.ids)
        # Names of their own, so that what a compaction that was broken off has left is never read.
        folder, ids = f"g{generation}-{uuid.uuid4().hex}", f"ids{generation}-{uuid.uuid4().hex}"
        table = self._create(folder)
        self._write(self.entries().withColumn("folded", F.lit(True)), table)
        opened = self.spark.createDataFrame([*self.batches().items()], "batch string, attempt string")
        self.folded().unionByName(opened).write.parquet(f"{self.path}/{ids}")
        manifest = {"generation": generation, "buckets": self.buckets, "folder": folder, "ids": ids}
        write_text(self.spark, f"{self.path}/_manifests/m{generation}", json.dumps(manifest))
        self._open(manifest, table)
        for name in self._names(""):
            if name[0] != "_" and name not in (folder, ids, *before):
                system, there = hadoop_path(self.spark, f"{self.path}/{name}")
                system.delete(there, True)

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Append what is new in docs; return doc_id, keep_id, group_size (rows of this batch with the text), kept, digest for every row of docs.

        batch: an id under which these documents are added once, however often the call is repeated.
        """
        batch = batch or uuid.uuid4().hex
        rows = staged(digests(docs), "digests")
        best = F.max(F.struct("n_code_points", F.bitwise_not("doc_id").alias("rank"), F.bitwise_not("row_id").alias("row_rank")))
        groups = rows.groupBy("digest").agg(best.alias("best"), F.count("*").alias("n_rows"))
        groups = staged(groups.select("digest", F.bitwise_not("best.rank").alias("best_id"), F.bitwise_not("best.row_rank").alias("best_row"), "n_rows"), "digest-groups")
        attempt = self._attempt(batch) or self._append(groups, batch)
        entries = self.entries().hint("merge")
        own = (F.col("attempt") == attempt).alias("own")
        found = staged(groups.join(entries, "digest").select("digest", "keep_id", "best_row", "n_rows", own), "digest-answers")
        release(groups)
        out = looked_up(rows, found, "digest", "n_rows", rows.count()).select(
            "doc_id",
            "keep_id",
            F.col("n_rows").alias("group_size"),
            (F.col("own") & (F.col("row_id") == F.col("best_row"))).alias("kept"),
            "digest",
            "n_code_points",
            "row_id",
        )
        return owing(out, rows, found)

    def _append(self, groups: DataFrame, batch: str) -> str:
        if len(self.batches()) >= MOST_OPEN:
            self.compact()
        attempt = uuid.uuid4().hex
        known = self.entries().select("digest").hint("merge")
        fresh = groups.join(known, "digest", "left_anti").select("digest", F.col("best_id").alias("keep_id"), F.lit(attempt).alias("attempt"), F.lit(False).alias("folded"))
        self._write(fresh, self.table)
        name = "b" + base64.urlsafe_b64encode(batch.encode()).decode()
        write_text(self.spark, f"{self.path}/{self.folder}/_batches/{name}", attempt)
        return attempt


def exact_dedup(docs: DataFrame, index: ExactDedupIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    rows = numbered(docs)
    added = (index or ExactDedupIndex(docs.sparkSession)).add(rows, batch)
    gone = staged(added.filter(~F.col("kept")).select(F.col("row_id").alias(ROW)), "exact-gone")
    release(added)
    return drop_rows(rows, gone, gone.count())


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ExactDedupIndex(spark).add(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d
  WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
"""
