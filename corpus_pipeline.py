"""A corpus pipeline of five stages; each reads what the one before it wrote.

    quality classifier      documents that it rejects go
    exact dedup             one row of equal texts stays
    MinHash near-dedup      one document of each component stays
    decontamination         documents that hold a window of a benchmark item go
    SentencePiece           sampled pieces of each text, decoded again to the same text

The first four return the columns of documents; the last returns doc_id, lang, source, n_pieces and pieces.

Defined cases, as the operators define them: null and empty texts are documents (all equal in exact dedup, linked with nothing
in near-dedup, without pieces at the end); rows with equal or null doc_id are judged each for itself; of ties and repeated
rows one stays, the one with the least doc_id; empty tables give no rows; further columns are kept, whatever their names, by
all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm import decontam, exact_dedup, minhash, quality, sp_sampling
from trawl.llm._common import release, staged


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = sp_sampling.encode(docs.select("doc_id", "lang", "source", "text"))
    return own.select("doc_id", "lang", "source", F.size("pieces").alias("n_pieces"), "pieces")


STAGES = [
    ("quality classifier", drop_low_quality),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: SQL can't express the classifier, the component search or the sampling; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, made = docs, stage(spark, docs, sf_dir)
        docs = made
        if k < len(STAGES) - 1:
            docs = staged(made, f"stage-{k + 1}")
            release(made, before)
    return docs
