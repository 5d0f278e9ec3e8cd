import base64
import bz2
import gzip
import json
import lzma

import pytest
from pyspark.sql import functions as F

from trawl.operators import aggregate, context, display, match, spans
from trawl.sources import files, sinks
from trawl.spec import SpecError, spec


def lines_found(df, search):
    return sorted(r.line_number for r in match.grep(df.select("path", "text"), search).collect())


def test_tree(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/x.txt").write_text("needle\n")
    (tmp_path / "a/y.txt").write_text("hay\n")
    own = files.from_files(spark, str(tmp_path / "a"))
    assert sorted(r.rel_path for r in files.list_files(own).collect()) == ["b/x.txt", "y.txt"]
    assert [r.rel_path for r in match.grep(files.decode(own).drop("content", "path", "root", "modificationTime", "length", "is_valid_utf8"), spec("needle")).collect()] == ["b/x.txt"]
    assert files.first_document(own).count() == 1
    plan = files.list_files(own)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_several_roots(spark, tmp_path):
    for n in ("r1", "r2"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "f").write_text("x")
    missing = []
    roots = [str(tmp_path / n) for n in ("r1", "gone", "r2")]
    assert files.from_files(spark, roots, missing).count() == 2 and missing == [roots[1]]
    with pytest.raises(SpecError):
        files.from_files(spark, roots)


@pytest.mark.parametrize(
    ("data", "encoding", "line"),
    [
        ("hay\nneedle\n".encode("utf-16"), "auto", 2),
        (b"\xfe\xff" + "needle\n".encode("utf-16-be"), "auto", 1),
        ("hay\nneedle\n".encode("utf-16-le"), "utf-16le", 2),
        (b"\xfe\xff" + "needle\n".encode("utf-16-be"), "utf-16le", 1),
        (b"\xef\xbb\xbfhay\nneedle\n", "auto", 2),
        ("日本\nneedle\n".encode("shift_jis"), "shift_jis", 2),
        ("日本\nneedle\n".encode("euc-jp"), "euc-jp", 2),
        (b"\xff\xe9\nneedle\n", "auto", 2),
        (b"\xe9\nneedle\n", "none", 2),
        ("жук\nneedle\n".encode("koi8-u"), "KOI8-U", 2),
        ("ğ\nneedle\n".encode("cp1254"), "latin5", 2),
        ("ĥ\nneedle\n".encode("iso-8859-3"), "iso-8859-3", 2),
        ("hay\nneedle\n".encode("utf-16") + b"x", "auto", 2),
    ],
)
def test_encodings(spark, data, encoding, line):
    own = spark.createDataFrame([("p", bytearray(data))], "path string, content binary")
    assert lines_found(files.decode(own, encoding), spec("needle")) == [line]


def test_unknown_encoding(spark):
    with pytest.raises(SpecError):
        files.decode(spark.createDataFrame([("p", bytearray(b""))], "path string, content binary"), "klingon")


def test_compressed(spark, tmp_path):
    for name, pack in (("a.gz", gzip.compress), ("b.bz2", bz2.compress), ("c.xz", lzma.compress), ("d.txt", bytes)):
        (tmp_path / name).write_bytes(pack(b"hay\nneedle\n" * 50))
    rows = files.compressed_texts(spark, str(tmp_path))
    assert sorted(r.path[-1] for r in match.grep(rows, spec("needle")).collect()) == ["2"] * 50 + ["t"] * 50 + ["z"] * 100
    assert match.grep(files.decode(files.from_files(spark, str(tmp_path))).select("path", "text"), spec("^needle$")).count() == 50


def test_preprocess(corpus):
    own = corpus(**{"doc.md": "raw", "x.txt": "raw"})
    new = files.preprocess(own, lambda t: F.concat(F.lit("converted "), t), ["*.md"])
    assert {r.path: r.text for r in new.collect()} == {"doc.md": "converted raw", "x.txt": "raw"}
    assert {r.text for r in files.preprocess_batches(own, lambda s: s.str.upper()).collect()} == {"RAW"}


def test_json_events(spark, corpus, tmp_path):
    own = corpus(**{"f.txt": "hay\nneedle here\nthere\n", "g.txt": "none\n"})
    sinks.write_json_events(own, spec("needle", before=1, after=1), str(tmp_path / "out"))
    rows = [json.loads(line) for p in sorted((tmp_path / "out").glob("part-*")) for line in p.read_text().splitlines()]
    assert [r["type"] for r in rows] == ["begin", "context", "match", "context", "end", "summary"]
    data = rows[2]["data"]
    assert data["line_number"] == 2 and data["absolute_offset"] == 4 and data["lines"]["text"] == "needle here\n"
    assert data["submatches"] == [{"match": {"text": "needle"}, "start": 0, "end": 6}]
    assert rows[5]["data"]["stats"]["searches"] == 2 and rows[5]["data"]["stats"]["searches_with_match"] == 1
    inverted = sinks.json_events(own, spec("needle", invert=True)).filter("value LIKE '%\"match\"%'").collect()
    assert all(json.loads(r.value)["data"]["submatches"] == [] for r in inverted)
    passthru = sinks.json_events(own, spec("zzz", passthru=True)).collect()
    assert [json.loads(r.value)["type"] for r in passthru].count("context") == 4


def test_bytes_printed(corpus):
    own = corpus(**{"f.txt": "hay\nneedle needle\nthere", "g.txt": "none\n", "h.txt": "needle"})
    events = sinks.json_events(own, spec("needle", after=1)).orderBy(F.col("path").asc_nulls_last(), "seq").collect()
    rows = [json.loads(r.value) for r in events]
    assert [r["type"] for r in rows] == ["begin", "match", "context", "end", "begin", "match", "end", "summary"]
    assert rows[3]["data"]["stats"]["bytes_printed"] == sum(len(r.value) + 1 for r in events[:3]) and rows[6]["data"]["stats"]["bytes_printed"] == sum(len(r.value) + 1 for r in events[4:6])
    assert rows[7]["data"]["stats"] == {"searches": 3, "searches_with_match": 2, "bytes_searched": 34, "bytes_printed": rows[3]["data"]["stats"]["bytes_printed"] + rows[6]["data"]["stats"]["bytes_printed"], "matched_lines": 2, "matches": 3}
    assert [m["start"] for m in rows[1]["data"]["submatches"]] == [0, 7] and rows[2]["data"]["lines"] == {"text": "there"}
    plan = sinks.json_events(own, spec("needle"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") <= 2
    shown = display.render_lines(context.selected(own, spec("needle")), ["line_number"])
    assert display.bytes_printed(shown).first().bytes_printed == len("2:needle needle\n1:needle\n")


def test_raw_texts_keep_their_bytes(spark):
    own = spark.createDataFrame([("p", bytearray(b"\xe9\na needle \xff needle\nb\n"))], "path string, content binary")
    own, search = files.decode(own, "none").select("path", "text"), spec("needle|b", raw=True)
    rows = spans.spans(own, search).orderBy("line_number", "span_index").collect()
    assert [(r.line_number, r.start_byte, r.end_byte, r.absolute_offset) for r in rows] == [(2, 2, 8, 4), (2, 11, 17, 13), (3, 0, 1, 20)]
    events = [json.loads(r.value)["data"] for r in sinks.json_events(own, search).orderBy(F.col("path").asc_nulls_last(), "seq").collect()]
    assert events[1]["lines"] == {"bytes": base64.b64encode(b"a needle \xff needle\n").decode()} and events[1]["absolute_offset"] == 2
    assert events[1]["submatches"][0] == {"match": {"text": "needle"}, "start": 2, "end": 8} and events[2]["lines"] == {"text": "b\n"}
    assert events[-1]["stats"]["bytes_searched"] == 22 and aggregate.doc_stats(own, search).first().bytes_searched == 22


def test_previews_count_what_they_hide(corpus):
    search = spec("needle", max_columns=10, max_columns_preview=True)
    rows = match.grep(corpus(a="needle needle\nneedle 789needle\nno\nneedle\nneedle ..needle needle needle\n"), search)
    line = F.col("line")
    shown = rows.select(display.limited(search, line, matches=display.remaining_matches(search, line)).alias("s"))
    assert [r.s for r in shown.collect()] == ["needle nee [... 0 more matches]", "needle 789 [... 1 more match]", "needle", "needle ..n [... 2 more matches]"]


def test_clashing_columns(spark):
    own = spark.createDataFrame([("x", 3, 4)], "text string, line int, spans int")
    with pytest.raises(SpecError, match="line"):
        match.grep(own, spec("x"))
    with pytest.raises(SpecError, match="spans"):
        spans.match_rows(own.drop("line"), spec("x"))
    assert match.grep(own.drop("line"), spec("x")).count() == 1


def test_data_object(spark):
    own = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"\xff"),)], "c binary").select(F.to_json(sinks.data_object(F.col("c"))).alias("j"))
    assert sorted(r.j for r in own.collect()) == ['{"bytes":"/w=="}', '{"text":"ok"}']


def test_paths_with_nul(corpus, tmp_path):
    sinks.write_paths(corpus(a="", b="").coalesce(1), str(tmp_path / "p"), nul=True)
    assert b"".join(p.read_bytes() for p in (tmp_path / "p").glob("part-*")) == b"a\0b\0"


def test_vimgrep(corpus):
    rows = sinks.vimgrep(corpus(a="xx y x\n"), spec("x")).orderBy("column").collect()
    assert [(r.path, r.line_number, r.column, r.line) for r in rows] == [("a", 1, 1, "xx y x"), ("a", 1, 2, "xx y x"), ("a", 1, 6, "xx y x")]
