"""Headline searches, timed: one JSON line. BENCH_SF_DIR is the input, BENCH_CPUS the cores, BENCH_RUNS the timed runs (the median counts).

Every run builds its DataFrame anew; one warm-up run comes first. mb_per_s_core is the text's size by time and core. The
cases in "large" read a table of COPIES times the documents (1 GB of text at scale 0.1), so that bytes outweigh what a job costs;
scan reads it alone, and net rates leave its time out. They aren't part of the sum.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trawl.operators import aggregate, filters, match  # noqa: E402
from trawl.plans import catalog  # noqa: E402
from trawl.spec import spec  # noqa: E402


def counted(search):
    """Matching lines of all documents."""
    return lambda s, d: aggregate.count_lines(catalog.docs(s, d), search).agg(F.sum("n").alias("n"))


CASES = {
    "literal": counted(spec("License, Version", fixed=True)),
    "literal_ignore_case": counted(spec("license, version", fixed=True, case="ignore")),
    "word": counted(spec("license", boundary="word")),
    "alternation": counted(spec("Apache License|MIT License")),
    "regex_required_literal": counted(spec(r"Version [0-9]+\.[0-9]")),
    "literal_absent": counted(spec("no such text anywhere", fixed=True)),
    "regex_no_literal": counted(spec(r"[a-z]{4}on\b [a-z]+ed\b")),
    "docs_with_match": lambda s, d: aggregate.docs_with_match(catalog.docs(s, d), spec("[Ll]icense")).agg(F.count("*")),
    "grep_lines": lambda s, d: match.grep(catalog.docs(s, d), spec("[Ll]icense")).agg(F.count("*")),
    "match_spans": lambda s, d: catalog.match_spans(s, d).agg(F.sum("start_byte")),
    "context": lambda s, d: catalog.queries()["context_both"](s, d).agg(F.count("*")),
    "search_stats": lambda s, d: catalog.queries()["search_stats"](s, d),
    "listing_with_filters": lambda s, d: filters.glob_filter(filters.hidden_filter(catalog.tree(s, d).select("doc_id", "path")), ["*.md", "*.py"]).agg(F.count("*")),
}


#: How often the documents are written for the large cases, and the row groups of about so many MB that they are written in.
COPIES, FILES = 40, 64


def written(spark: SparkSession, sf_dir: str) -> str:
    """The documents, COPIES times, in files with several row groups, which Spark splits as it does by default."""
    folder = tempfile.mkdtemp(prefix="spark-bench-")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    rows = rows.withColumn("doc_id", F.col("doc_id") * COPIES + F.col("copy")).drop("copy").repartition(FILES)
    rows.write.option("parquet.block.size", 4 << 20).parquet(f"{folder}/documents.parquet")
    return folder


#: scan reads the same bytes and does nothing else with them.
LARGE = {
    "scan": lambda s, d: catalog.docs(s, d).agg(F.sum(F.octet_length("text"))),
    "literal": CASES["literal"],
    "literal_absent": CASES["literal_absent"],
    "regex_no_literal": CASES["regex_no_literal"],
}


def main() -> None:
    sf_dir, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
    # Several tasks for each core also where the input is one small file.
    spark = builder.config("spark.sql.files.maxPartitionBytes", "2m").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    size = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0] / 1e6
    times = {}
    for name, case in CASES.items():
        case(spark, sf_dir).collect()
        own = []
        for _ in range(runs):
            began = time.perf_counter()
            case(spark, sf_dir).collect()
            own.append(time.perf_counter() - began)
        times[name] = round(statistics.median(own), 4)
    rates = {k: round(size / v / int(cpus), 2) for k, v in times.items()}
    large, folder = {}, written(spark, sf_dir)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, case in LARGE.items():
        own = []
        for _ in range(runs):
            began = time.perf_counter()
            case(spark, folder).collect()
            own.append(time.perf_counter() - began)
        took = statistics.median(own)
        net = took - large.get("scan", {"s": 0})["s"]
        large[name] = {"s": round(took, 2), "text_mb": round(size * COPIES), "mb_per_s_core": round(size * COPIES / took / int(cpus), 2), "net_mb_per_s_core": round(size * COPIES / max(net, 1e-3) / int(cpus), 2)}
    print(json.dumps({"metric": "search_total_seconds", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "text_mb": round(size, 2), "cpus": int(cpus), "mb_per_s_core": rates, "large": large}))


if __name__ == "__main__":
    main()
