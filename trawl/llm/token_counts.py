"""Token counts as delta-maintained rollups.

A batch of changes is a table of signed documents: +1 for an insert, -1 for a delete, and both for a revision (its
old count out, its new one in). A commit sums a batch by source, language and tokenizer version, with partial
aggregation, and writes those sums under the batch's id; totals are sums over all committed batches, so they never
need the documents again. A batch id is committed once: doing it again changes nothing, and a commit that was
broken off leaves no success marker and is done anew. compact() folds committed batches into one and remembers their ids.
Every group whose sums aren't all zero is kept, also where revisions leave characters or tokens without documents.

Defined cases: null and empty texts have no tokens but are documents; a null source or language is a group of its
own. Repeated rows count as often as they occur. An empty batch is committed and changes nothing. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lean, new_path, staged

#: A tokenizer: its ranks, the pattern that it splits texts by (the published one of byte-level BPE), and its version's name.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VERSION = "byte_bpe_50k@1"

#: What a revision of the query makes a single 0.
NUMBERS = "[0-9]+"

_GROUP = ["source", "lang", "version"]
_KINDS = "source string, lang string, version string, n_docs long, n_tokens long, n_chars long"
#: What a write holds: sums, and rows with mark that carry a batch id each.
_WRITTEN = _KINDS + ", mark boolean, batch string, place string"


@lru_cache(maxsize=2)
def _encoding(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def count_tokens(texts: list[str], ranks: str = RANKS, pattern: str = PATTERN) -> list[int]:
    encode = _encoding(ranks, pattern).encode_ordinary
    return [len(encode(t)) for t in texts]


def token_counts(docs: DataFrame, ranks: str = RANKS, version: str = VERSION, pattern: str = PATTERN) -> DataFrame:
    """doc_id, source, lang, version, n_tokens, n_chars for each row of docs."""

    @lean()
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(n_tokens=count_tokens(b["text"].tolist(), ranks, pattern))[["key", "source", "lang", "n_tokens", "n_chars"]]

    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("string").alias("key"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))
    out = own.mapInPandas(run, "key string, source string, lang string, n_tokens long, n_chars long")
    return out.select(F.col("key").cast("long").alias("doc_id"), "source", "lang", F.lit(version).alias("version"), "n_tokens", "n_chars")


def revision(old: DataFrame, new: DataFrame) -> DataFrame:
    """The changes that put new counts in the place of old ones (both as token_counts() gives them)."""
    return old.withColumn("sign", F.lit(-1)).unionByName(new.withColumn("sign", F.lit(1)))


class TokenLedger:
    """Committed batches under a path in a shared folder; the same path opens the same ledger again."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "token-ledger")

    def _file(self, path: str):
        jvm = self.spark.sparkContext._jvm
        there = jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), there

    def _committed(self) -> list[str]:
        system, root = self._file(self.path)
        if not system.exists(root):
            return []
        paths = [s.getPath().toString() for s in system.listStatus(root)]
        return [p for p in paths if self._file(f"{p}/_SUCCESS")[0].exists(self._file(f"{p}/_SUCCESS")[1])]

    def _marks(self) -> DataFrame | None:
        """place (of a committed write) and batch, a row for each batch id that it holds; None without any."""
        paths = self._committed()
        return self.spark.read.schema(_WRITTEN).parquet(*paths).filter("mark").select("place", "batch") if paths else None

    def _current(self) -> list[str]:
        """Paths that count: not those whose batches a compaction holds as well, should it have broken off before deleting."""
        marks = self._marks()
        if marks is None:
            return []
        own = marks.join(marks.groupBy("place").agg(F.count("*").alias("n")), "place")
        other = own.select("batch", F.col("place").alias("larger"), F.col("n").alias("more"))
        folded = own.join(other.filter("more > 1"), "batch").filter("more > n").groupBy("place", "n", "larger").agg(F.count("*").alias("held")).filter("held = n")
        places = marks.select("place").distinct().join(folded.select("place").distinct(), "place", "left_anti").collect()
        return [f"{self.path}/{r.place}" for r in places]  # a row a write; compact() keeps them few

    def batches(self) -> set[str]:
        """The ids of all committed batches."""
        marks = self._marks()
        return set() if marks is None else {r.batch for r in marks.select("batch").distinct().collect()}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch (sign, source, lang, version, n_tokens, n_chars) to the totals; False if its id is there already."""
        marks = self._marks()
        if marks is not None and not marks.filter(F.col("batch") == batch).isEmpty():
            return False
        sums = [F.sum("sign").alias("n_docs"), *(F.sum(F.col("sign") * F.col(c)).alias(c) for c in ("n_tokens", "n_chars"))]
        self._write(changes.groupBy(*_GROUP).agg(*sums), self.spark.createDataFrame([(batch,)], "batch string"), batch)
        return True

    def _write(self, sums: DataFrame, batches: DataFrame, name: str) -> None:
        # Rows without counts carry the ids, so an empty batch is remembered as well.
        columns = [k.split() for k in _KINDS.split(", ")]
        ids = batches.select(*(F.lit(None).cast(k).alias(c) for c, k in columns), F.lit(True).alias("mark"), "batch")
        rows = sums.select(*(F.col(c).cast(k) for c, k in columns), F.lit(False).alias("mark"), F.lit(None).cast("string").alias("batch")).unionByName(ids)
        place = "b" + (base64.urlsafe_b64encode(name.encode()).decode().rstrip("=") or "empty")
        rows.withColumn("place", F.lit(place)).write.mode("overwrite").parquet(f"{self.path}/{place}")

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens, n_chars: groups that have documents, tokens or characters left."""
        found = self._current()
        rows = self.spark.read.schema(_WRITTEN).parquet(*found) if found else self.spark.createDataFrame([], _WRITTEN)
        out = rows.filter(~F.col("mark")).groupBy(*_GROUP).agg(*(F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_chars")))
        return out.filter("n_docs <> 0 OR n_tokens <> 0 OR n_chars <> 0")

    def compact(self) -> None:
        """Fold all committed batches into one write; the old ones go once it is there."""
        old = self._committed()
        if len(old) > 1:
            marks = staged(self._marks().select("batch").distinct(), "ledger-batches")
            # The same batches get the same name, in whatever order.
            name = "compacted:" + "-".join(map(str, marks.agg(F.count("*"), F.sum(F.xxhash64("batch").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("batch"))).first()))
            self._write(staged(self.totals(), "ledger"), marks, name)
            new = set(self._committed()) - set(old)
            for p in old if new else []:
                system, there = self._file(p)
                system.delete(there, True)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after all documents are inserted, those labelled as low quality are deleted again, and the counts of the others
    are revised, as each run of digits in their texts becomes 0; the first batch is sent twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = staged(token_counts(docs), "token-counts")
    poor = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 0").select("doc_id").distinct()
    ledger, inserts = TokenLedger(spark), counts.withColumn("sign", F.lit(1))
    ledger.commit("documents", inserts)
    ledger.commit("low quality", counts.join(poor, "doc_id", "left_semi").withColumn("sign", F.lit(-1)))
    ledger.commit("documents", inserts)
    changed = docs.filter(F.col("text").rlike(NUMBERS))
    revised = revision(token_counts(changed), token_counts(changed.withColumn("text", F.regexp_replace("text", NUMBERS, "0"))))
    ledger.commit("numbers", revised.join(poor, "doc_id", "left_anti"))
    return ledger.totals()
