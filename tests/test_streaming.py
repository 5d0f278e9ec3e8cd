import pytest
from pyspark.sql import functions as F

from trawl.operators import context, lines
from trawl.operators.spans import match_rows
from trawl.spec import spec
from trawl.streaming import ordered, search


def collected(spark, stream, mode="append"):
    name = f"out_{abs(hash(stream))}"
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


@pytest.fixture
def streamed(spark, tmp_path):
    def make(df, files=3):
        path = str(tmp_path / "in")
        df.repartition(files).write.parquet(path)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return make


def test_rows_equal_a_batch(spark, corpus, streamed):
    own = corpus(a="x\nneedle x\n", b="none\n", c="needle needle")
    found = collected(spark, search.search_stream(streamed(own), spec("needle")))
    key = lambda df: sorted((r.path, r.line_number, r.match_count) for r in df.collect())
    assert key(found) == key(match_rows(own, spec("needle")))


def test_context_in_a_stream(spark, corpus, streamed):
    own = corpus(a="1\n2\nneedle\n4\n", b="needle")
    found = collected(spark, context.selected(streamed(own), spec("needle", before=1, after=1)))
    assert sorted((r.path, r.line_number, r.role) for r in found.collect()) == [("a", 2, "context"), ("a", 3, "match"), ("a", 4, "context"), ("b", 1, "match")]


def test_running_counts(spark, streamed):
    own = spark.createDataFrame([("a", "x"), ("a", "xy"), ("b", "y"), ("b", "x")], "path string, line string")
    found = collected(spark, search.running_counts(streamed(own), spec("x"), "path"), "complete")
    assert sorted(map(tuple, found.collect())) == [("a", 2), ("b", 1)]


def test_windowed_counts(spark, streamed):
    own = spark.createDataFrame([(f"2024-01-01 0{h}:10:00", t) for h, t in ((0, "x"), (0, "x"), (1, "y"), (2, "x"), (5, "x"))], "ts string, line string").selectExpr("cast(ts as timestamp) ts", "line")
    found = collected(spark, search.windowed_counts(streamed(own, 1), spec("x")), "complete")
    assert sorted((r.start.hour, r.n) for r in found.collect()) == [(0, 2), (2, 1), (5, 1)]


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", search.ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_state(spark, streamed, rocks):
    texts = {"a": "hay\nm1\nm2\nhay\nm3\n", "b": "m1\nm2\nm3\n", "c": "é\nhay\n"}
    docs = spark.createDataFrame(list(texts.items()), "path string, text string")
    rows = lines.with_offsets(docs).select("path", "line_number", "line", "absolute_offset")
    stream = streamed(rows.selectExpr("path", "line_number AS seq", "line").coalesce(1), 1)
    first = collected(spark, search.max_count_stream(stream, spec("m", max_count=2), "path", "seq"))
    assert sorted((r.path, r.seq) for r in first.collect()) == [("a", 2), ("a", 3), ("b", 1), ("b", 2)]
    run = collected(spark, search.stop_stream(stream, spec("m"), "path", "seq"))
    assert sorted((r.path, r.seq) for r in run.collect()) == [("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 3)]
    numbered = collected(spark, search.number_stream(stream, "path", "seq"))
    assert sorted((r.path, r.line_number, r.absolute_offset) for r in numbered.collect()) == sorted((r.path, r.line_number, r.absolute_offset) for r in rows.collect())


@pytest.mark.parametrize("batch", ["10000", "2"])
def test_ordered_forms_equal_those_of_whole_texts(spark, streamed, tmp_path, batch):
    texts = {"a": "hay\nm1\nm2\nhay\nm3\n", "b": "m1\nm2\nm3\n", "c": "é\nhay\n", None: "x\nm\nm\ny\nm"}
    rows = lines.with_offsets(spark.createDataFrame(list(texts.items()), "path string, text string")).select("path", "line_number", "line", "absolute_offset")
    # Three triggers, each with later lines than the one before.
    for k, (low, high) in enumerate([(0, 2), (2, 3), (3, 9)]):
        rows.filter(f"line_number > {low} AND line_number <= {high}").selectExpr("path", "line_number AS seq", "line").orderBy(F.desc("seq")).coalesce(1).write.parquet(str(tmp_path / f"in/part{k}"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    own = spark.readStream.schema("path string, seq int, line string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    found = {}

    def run(make, *args):
        out = []
        writer = make(own, *args, "path", "seq", lambda df, _: out.extend(df.collect()), str(tmp_path / f"state{len(found)}"))
        q = writer.option("checkpointLocation", str(tmp_path / f"check{len(found)}")).start()
        q.processAllAvailable()
        q.stop()
        found[make.__name__] = out
        return out

    try:
        assert sorted((str(r.path), r.seq) for r in run(ordered.max_count_ordered, spec("m", max_count=2))) == [("None", 2), ("None", 3), ("a", 2), ("a", 3), ("b", 1), ("b", 2)]
        assert sorted((str(r.path), r.seq) for r in run(ordered.stop_ordered, spec("m"))) == [("None", 2), ("None", 3), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 3)]
        want = sorted((str(r.path), r.line_number, r.absolute_offset, r.line) for r in rows.collect())
        assert sorted((str(r.path), r.line_number, r.absolute_offset, r.line) for r in run(ordered.number_ordered)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(list((tmp_path / "state0").iterdir())) <= ordered.VERSIONS + 1


def test_a_key_of_many_rows(spark, tmp_path):
    n = 2_000_000
    rows = spark.range(n).selectExpr("'one' AS path", "id AS seq", "concat('line ', id) AS line", "true AS row_is_a_hit", "false AS row_is_state", "0L AS state_a", "0L AS state_b", "current_timestamp() AS state_seen")
    out = ordered.walked(rows.repartition(F.col("path")).sortWithinPartitions("path", "seq"), "path", "line", search.Numbered())
    (r,) = out.filter("NOT row_is_state").agg(F.count("*").alias("n"), F.max("line_number").alias("last"), F.max("absolute_offset").alias("offset")).collect()
    assert (r.n, r.last, r.offset) == (n, n, sum(6 + len(str(k)) for k in range(n - 1)))


def test_states_expire(spark, tmp_path):
    import time

    out = []
    for k in range(3):
        spark.createDataFrame([("a", k, "m")], "path string, seq int, line string").coalesce(1).write.parquet(str(tmp_path / f"in/part{k}"))
        if not k:
            stream = spark.readStream.schema("path string, seq int, line string").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        q = ordered.max_count_ordered(stream, spec("m", max_count=1), "path", "seq", lambda df, _: out.extend(r.seq for r in df.collect()), str(tmp_path / "state"), expires="4 seconds").option("checkpointLocation", str(tmp_path / "check")).start()
        q.processAllAvailable()
        q.stop()
        if k == 1:
            time.sleep(5)
    assert out in ([0, 2], [0, 1, 2])  # the second is too many, unless the machine took its time
