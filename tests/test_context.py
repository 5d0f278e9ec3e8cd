import random

import pytest
from pyspark.sql import functions as F

from trawl.operators import aggregate, context, display, lines
from trawl.spec import spec

SEVEN = "one\ntwo\nmatch\nfour\nfive\nother\nseven\n"


def shown(df):
    return [(r.line_number, r.role) for r in df.orderBy("path", "line_number").collect()]


def test_context(corpus):
    own = corpus(a=SEVEN)
    assert shown(context.selected(own, spec("match", before=1, after=1))) == [(2, "context"), (3, "match"), (4, "context")]
    rows = context.selected(own, spec("match", "other", after=1)).orderBy("line_number").collect()
    assert [(r.line_number, r.group_id) for r in rows] == [(3, 1), (4, 1), (6, 2), (7, 2)]


def test_documents(corpus):
    own = corpus(a="needle\nafter\n", b="needle\nafter\n", c="")
    assert len(shown(context.selected(own, spec("needle", passthru=True)))) == 4
    assert lines.split_lines(corpus(c="", d=None)).count() == 0


@pytest.mark.parametrize(("n", "found"), [(1, [1]), (2, [1, 2]), (0, [])])
def test_max_count(corpus, n, found):
    own = corpus(a="needle one\nneedle two\nneedle three\n")
    assert [k for k, _ in shown(context.selected(own, spec("needle", max_count=n)))] == found


def test_stop(corpus):
    own = corpus(a="hay\nmatch1\nmatch2\nhay\nmatch3\n")
    only = lambda **o: [k for k, _ in shown(context.selected(own, spec("match", stop_on_nonmatch=True, **o)))]
    assert only() == [2, 3] and only(after=1) == [2, 3, 4] and only(passthru=True) == [1, 2, 3, 4]
    assert aggregate.count_lines(own, spec("match", stop_on_nonmatch=True)).first().n == 2


@pytest.mark.parametrize(
    "search", [spec("a", before=1, after=2), spec("a", max_count=2, after=1), spec("a", stop_on_nonmatch=True), spec("a", invert=True, before=2), spec("a", stop_on_nonmatch=True, max_count=1, before=1)]
)
def test_row_form_equals_window_form(spark, search):
    rows = [(str(k), "\n".join("ab"[(k >> i) & 1] for i in range(7))) for k in range(128)]
    own = spark.createDataFrame(rows, "path string, text string")
    a = context.selected(own, search).select("path", "line_number", "role", "group_id")
    b = context.context_over(lines.split_lines(own), search, "path").select("path", "line_number", "role", "group_id")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("block", [2])
@pytest.mark.parametrize("search", [spec("b", before=5, after=4), spec("b", before=1, after=3, max_count=3), spec("b", after=2, stop_on_nonmatch=True), spec("b", before=1, max_count=1, stop_on_nonmatch=True), spec("b", max_count=0)])
def test_blocks_agree_with_rows(spark, monkeypatch, search, block):
    monkeypatch.setattr(lines, "LINES_A_BLOCK", block)
    rng = random.Random(3)
    rows = [(k if k else None, "\n".join(rng.choice("aaaab") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 30)))) for k in range(25)]
    own = spark.createDataFrame(rows, "doc int, text string")
    a = context.selected(own, search).select("doc", "line_number", "line", "role", "group_id")
    b = context.context_over(lines.split_lines(own), search, "doc").select("doc", "line_number", "line", "role", "group_id")
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_one_long_text_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(lines, "LINES_A_BLOCK", 10_000)
    n = 300_000
    text = spark.range(n).select(F.lit("one").alias("doc"), (F.col("id") + 1).alias("line_number"), F.concat(F.lit("é" * 3), F.col("id").cast("string")).alias("line"))
    got = lines.offsets_over(text, "doc")
    width = lambda k: 7 + len(str(k))
    assert got.agg(F.max("absolute_offset")).first()[0] == sum(map(width, range(n - 1)))
    assert got.filter("line_number = 123457").first().absolute_offset == sum(map(width, range(123_456)))
    assert max(r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < 0.7 * n
    found = context.context_over(text, spec("é9999$", before=1, after=2), "doc").orderBy("line_number").collect()
    assert [(r.line_number, r.role, r.group_id) for r in found] == [(9999, "context", 1), (10000, "match", 1), (10001, "context", 1), (10002, "context", 1)]


def test_counts(corpus):
    own = corpus(many="needle needle\nno\nneedle\n", none="hay\n")
    n = lambda df: {r.path: r.n for r in df.collect()}
    assert n(aggregate.count_lines(own, spec("needle"))) == {"many": 2}
    assert n(aggregate.count_matches(own, spec("needle"))) == {"many": 3}
    assert n(aggregate.count_lines(own, spec("needle|no"))) == {"many": 3}
    assert n(aggregate.count_matches(own, spec("needle|no"))) == {"many": 4}
    assert n(aggregate.count_lines(own, spec("needle"), include_zero=True)) == {"many": 2, "none": 0}
    assert [r.path for r in aggregate.docs_without_match(own, spec("needle")).collect()] == ["none"]
    assert aggregate.any_match(own, spec("hay")) and not aggregate.any_match(own, spec("straw"))


def test_stats(corpus):
    own = corpus(a="needle\nneedle two\nnope\n")
    r = aggregate.stats(own, spec("needle")).first()
    assert (r.matches, r.matched_lines, r.searches_with_match, r.bytes_searched) == (2, 2, 1, 23)
    r = aggregate.stats(own, spec("needle", invert=True)).first()
    assert (r.matches, r.matched_lines) == (0, 1)
    r = aggregate.stats(corpus(a="foo1\nfoo2\nfoo3\nfoo4\nfoo5\n"), spec("foo", max_count=2)).first()
    assert (r.matches, r.bytes_searched) == (2, 10)
    r = aggregate.stats(corpus(a="pre\nneedle one\nctx\nneedle two\npost\n"), spec("needle", max_count=1, after=2)).first()
    assert (r.matches, r.matched_lines, r.bytes_searched) == (2, 2, 30)
    assert aggregate.stats(corpus(a=""), spec("x")).first().searches == 1


def test_offsets(corpus):
    own = corpus(a="é\n\nxy\nz", b="\n")
    rows = lines.with_offsets(own).orderBy("path", "line_number").collect()
    assert [(r.path, r.line, r.absolute_offset, r.terminator) for r in rows] == [("a", "é", 0, "\n"), ("a", "", 3, "\n"), ("a", "xy", 4, "\n"), ("a", "z", 7, ""), ("b", "", 0, "\n")]


def test_long_lines(corpus):
    own = corpus(a="short needle\nverylong needle tail\n")
    limit = lambda **o: [r[0] for r in lines.split_lines(own).orderBy("line_number").select(display.limited(spec("needle", max_columns=12, **o), F.col("line"))).collect()]
    assert limit() == ["[Omitted long matching line]"] * 2
    assert limit(max_columns_preview=True) == ["short needle [... omitted end of long line]", "verylong nee [... omitted end of long line]"]


def test_sort_and_render(spark):
    own = spark.createDataFrame([("a+", 1), ("a/b", 2), ("b", 0)], "path string, modificationTime int")
    assert [r.path for r in display.sort_by(own).collect()] == ["a/b", "a+", "b"]
    assert [r.path for r in display.sort_by(own, "path", reverse=True).collect()] == ["b", "a+", "a/b"]
    assert [r.path for r in display.sort_by(own, "modified").collect()] == ["b", "a+", "a/b"]
    rows = spark.createDataFrame([("p", 1, "x", "match"), ("p", 2, "y", "context")], "path string, n int, line string, role string")
    assert [r.rendered for r in display.render_lines(rows, ["path", "n"], role="role").orderBy("n").collect()] == ["p:1:x", "p-2-y"]


def test_bytes_printed_in_stats(corpus):
    own = corpus(a="pre\nneedle one\nctx\nx\ny\nneedle é\n", bb="needle", c="hay")
    r = aggregate.stats(own, spec("needle"), printed=["path", "line_number"]).first()
    assert r.bytes_printed == len("a:2:needle one\na:6:needle é\nbb:1:needle\n".encode()) and (r.searches, r.searches_with_match, r.matches) == (3, 2, 3)
    r = aggregate.stats(own, spec("needle", before=1), printed=[]).first()
    assert r.bytes_printed == len("pre\nneedle one\n--\ny\nneedle é\n--\nneedle\n".encode())
    assert aggregate.stats(own, spec("nothing", after=1), printed=["path"]).first().bytes_printed == 0
