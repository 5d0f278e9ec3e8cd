import bz2
import gzip
import lzma
import os
import resource

import pytest
import zstandard
from pyspark.sql import functions as F

from trawl.operators import filters, lines
from trawl.operators.match import hit
from trawl.sources import tree
from trawl.spec import SpecError, spec


@pytest.fixture
def root(tmp_path):
    for name, data in {"visible.txt": b"needle\n", ".hidden.txt": b"needle", "empty.txt": b"", ".hidden-dir/nested.txt": b"x\nneedle\n", "a/b/deep.txt": b"hay\n"}.items():
        (tmp_path / "r" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / name).write_bytes(data)
    (tmp_path / "other").mkdir()
    (tmp_path / "other/far.txt").write_text("needle far\n")
    os.symlink(tmp_path / "r/visible.txt", tmp_path / "r/to-file")
    os.symlink(tmp_path / "other", tmp_path / "r/to-folder")
    os.symlink(tmp_path / "r", tmp_path / "r/a/loop")
    os.symlink(tmp_path / "gone", tmp_path / "r/broken")
    os.mkfifo(tmp_path / "r/pipe")
    return tmp_path / "r"


def listed(df):
    return {r.rel_path: (r.is_link, r.problem) for r in df.collect()}


def test_hidden_empty_and_linked_files(spark, root, monkeypatch):
    plain = {"visible.txt", ".hidden.txt", "empty.txt", ".hidden-dir/nested.txt", "a/b/deep.txt"}
    for folders in (tree.FOLDERS, 2):
        monkeypatch.setattr(tree, "FOLDERS", folders)
        own = listed(tree.file_tree(spark, str(root)))
        assert own == {p: (False, None) for p in plain} | {p: (True, None) for p in ("to-file", "to-folder", "a/loop", "broken")} | {"pipe": (False, "not a file")}
        followed = listed(tree.file_tree(spark, str(root), follow=True))
        assert followed == {p: (False, None) for p in plain} | {"to-file": (True, None), "to-folder/far.txt": (False, None), "a/loop": (True, "link to a folder above"), "broken": (True, "broken link"), "pipe": (False, "not a file")}
    sizes = {r.rel_path: r.length for r in tree.unlinked(tree.file_tree(spark, str(root))).collect()}
    assert sizes["empty.txt"] == 0 and sizes["visible.txt"] == 7 and "pipe" not in sizes and "to-file" not in sizes


def test_roots(spark, root):
    missing = []
    got = tree.file_tree(spark, [str(root / "a"), str(root / "nothing"), str(root / "visible.txt"), str(root / "to-folder")], missing=missing)
    assert {(os.path.basename(r.root), r.rel_path) for r in got.collect()} == {("a", "b/deep.txt"), ("a", "loop"), ("visible.txt", ""), ("to-folder", "far.txt")} and len(missing) == 1
    with pytest.raises(SpecError):
        tree.file_tree(spark, str(root / "nothing"))


def test_reasons(spark, root):
    rows = filters.explain_filters(tree.file_tree(spark, str(root)), path="rel_path", max_size=6, link="is_link").collect()
    got = {r.rel_path: r.skip_reason for r in rows}
    assert got == {"visible.txt": "size", ".hidden.txt": "hidden", "empty.txt": None, ".hidden-dir/nested.txt": "hidden", "a/b/deep.txt": None, "to-file": "link", "to-folder": "link", "a/loop": "link", "broken": "link", "pipe": None}


def test_packed_files(spark, tmp_path):
    data = {"a.gz": gzip.compress(b"needle in gzip\n"), "b.bz2": bz2.compress(b"x\nneedle"), "c.xz": lzma.compress(b"needle"), "d.lzma": lzma.compress(b"needle", lzma.FORMAT_ALONE), "e.zst": zstandard.compress(b"hay\nneedle\n"), "f.txt": b"needle plain", "bad.gz": b"not gzip\nneedle\n", "u.gz": gzip.compress("\ufeffneedle\n".encode("utf-16-le"))}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    listing = tree.file_tree(spark, str(tmp_path))
    found = tree.lines_of_files(listing, decompress=True).filter(hit(spec("needle"), F.col("line")))
    assert {(r.rel_path, r.line_number) for r in found.collect()} == {("a.gz", 1), ("b.bz2", 2), ("c.xz", 1), ("d.lzma", 1), ("e.zst", 2), ("f.txt", 1), ("u.gz", 1)}
    (bad,) = tree.lines_of_files(listing, decompress=True).filter("problem IS NOT NULL").collect()
    assert bad.rel_path == "bad.gz" and "gzip" in bad.problem.lower() and bad.line is None
    raw = tree.lines_of_files(listing).filter(hit(spec("needle"), F.col("line")))
    own = {r.rel_path for r in raw.collect()}  # short data may stand in a packed file as it is
    assert {"f.txt", "bad.gz"} <= own and not {"a.gz", "b.bz2", "d.lzma", "u.gz"} & own
    text = tree.lines_of_files(listing, decompress=True).filter("rel_path = 'a.gz'")
    assert text.agg(F.sum(F.octet_length("line") + 1)).first()[0] == len(b"needle in gzip\n")


def test_lines_like_those_of_whole_texts(spark, tmp_path):
    texts = {"a": "x\n\ny\r\nz", "b": "", "c": "\n", "d": "é\u2028f\x0bg\x1ch\n", "e": "last\n\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = sorted((r.rel_path, r.line_number, r.line) for r in tree.lines_of_files(tree.file_tree(spark, str(tmp_path))).collect())
    own = lines.split_lines(spark.createDataFrame([*texts.items()], "rel_path string, text string"))
    assert got == sorted((r.rel_path, r.line_number, r.line) for r in own.collect())


def test_memory_does_not_depend_on_size(tmp_path):
    # 400 MB unpacked: read batch by batch, in this process.
    with gzip.open(tmp_path / "big.gz", "wb", compresslevel=1) as out:
        for _ in range(400):
            out.write(b"needle in a long haystack of bytes\n" * 30_000)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    with tree._opened(str(tmp_path / "big.gz"), True, "auto") as file:
        assert sum(1 for _ in file) == 12_000_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000
