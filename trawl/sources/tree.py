"""File trees as a Spark data source: hidden, empty and linked files too, and their lines as streams.

Each task lists subtrees of its own; nothing is opened while listing. Roots are folders that the driver and all executors have
mounted under one path (files.from_files reads stores that only Spark can reach, without hidden, empty and linked files).
"""

from __future__ import annotations

import bz2
import codecs
import gzip
import io
import json
import lzma
import os
import stat
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trawl.spec import SpecError

#: Folders that are dealt to tasks, at least where there are so many; rows and bytes of text of a batch.
FOLDERS, ROWS, TEXT_BYTES = 256, 5000, 1 << 20

SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("root", T.StringType()),
        T.StructField("rel_path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("is_link", T.BooleanType()),
        T.StructField("problem", T.StringType()),
    ]
)
_ARROW = pa.schema([("path", pa.string()), ("root", pa.string()), ("rel_path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("is_link", pa.bool_()), ("problem", pa.string())])


class _Part(InputPartition):
    def __init__(self, root: str, folders: list[tuple[str, bool]]):
        super().__init__(root)
        self.root, self.folders = root, folders  # folder, and whether all below it is meant or only its own files


class _Tree(DataSourceReader):
    def __init__(self, roots: list[str], follow: bool):
        self.roots, self.follow = roots, follow

    def _row(self, root: str, path: str, found: os.stat_result | None, link: bool, problem: str | None = None) -> tuple:
        when = datetime.fromtimestamp(found.st_mtime, timezone.utc) if found else None
        rel = "" if path == root else path[len(root.rstrip("/")) + 1 :]
        return path, root, rel, when, found.st_size if found else None, link, problem

    def _entries(self, root: str, folder: str, above: frozenset) -> Iterator[tuple[tuple | None, str | None]]:
        """A row for each file of a folder, and each folder below it; what can't be read is a row with its problem."""
        try:
            names = sorted(os.listdir(folder))
        except OSError as e:
            yield self._row(root, folder, None, False, e.strerror), None
            return
        for name in names:
            path = os.path.join(folder, name)
            try:
                own = os.lstat(path)
                link = stat.S_ISLNK(own.st_mode)
                if link and not self.follow:
                    yield self._row(root, path, own, True), None
                    continue
                found = os.stat(path) if link else own
            except OSError as e:
                yield self._row(root, path, None, os.path.islink(path), "broken link" if os.path.islink(path) else e.strerror), None
                continue
            if stat.S_ISDIR(found.st_mode):
                if (found.st_dev, found.st_ino) in above:
                    yield self._row(root, path, found, link, "link to a folder above"), None
                else:
                    yield None, path
            elif stat.S_ISREG(found.st_mode):
                yield self._row(root, path, found, link), None
            else:
                yield self._row(root, path, None, link, "not a file"), None

    def _above(self, root: str, folder: str) -> frozenset:
        """What identifies a folder and those above it, up to the root."""
        out, at = set(), root.rstrip("/") or "/"
        parts = [p for p in folder[len(at) :].split("/") if p]
        for k in range(len(parts) + 1):
            found = os.stat(os.path.join(at, *parts[:k]))
            out.add((found.st_dev, found.st_ino))
        return frozenset(out)

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for root in self.roots:
            whole, own = [root], []
            while os.path.isdir(root) and whole and len(whole) < FOLDERS // len(self.roots):
                below = [p for f in whole for _, p in self._entries(root, f, self._above(root, f)) if p]
                own += whole
                whole = below
            folders = [*((f, True) for f in whole), *((f, False) for f in own)]
            step = -(-len(folders) // FOLDERS) or 1
            out += [_Part(root, folders[k : k + step]) for k in range(0, len(folders), step)]
        return out

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        rows = []
        for row in self._walk(partition):
            rows.append(row)
            if len(rows) == ROWS:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _walk(self, partition: _Part) -> Iterator[tuple]:
        root = partition.root
        for first, all_ in partition.folders:
            if not os.path.isdir(first):
                yield self._row(root, first, os.stat(first), False)
                continue
            left = [first]
            while left:
                folder = left.pop()
                try:
                    above = self._above(root, folder)
                except OSError:
                    above = frozenset()
                for row, below in self._entries(root, folder, above):
                    if row:
                        yield row
                    elif all_:
                        left.append(below)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Tree(json.loads(self.options["roots"]), self.options.get("follow", "false") == "true")


def file_tree(spark: SparkSession, roots: str | Sequence[str], follow: bool = False, missing: list[str] | None = None) -> DataFrame:
    """path, root, rel_path, modificationTime, length, is_link and problem of every file under the roots.

    Hidden and empty files are rows like others. A link (also to a folder) is a row with is_link and isn't followed; with follow, its target's
    files are, and links that are broken or lead to a folder above are rows with a problem. So is what can't be listed, or isn't a regular
    file. A root that is a link itself is followed. Roots that don't exist are added to missing, or are an error without it.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    there = [os.path.abspath(r) for r in roots if os.path.exists(r)]
    gone = [r for r in roots if not os.path.exists(r)]
    if gone and missing is None or not there:
        raise SpecError(f"no such path: {', '.join(gone)}")
    if missing is not None:
        missing.extend(gone)
    spark.dataSource.register(FileTree)
    return spark.read.format("file_tree").option("roots", json.dumps(there)).option("follow", str(follow).lower()).load()


def _zstd(file):
    import zstandard

    return zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True)


#: What reads compressed files as streams, by the end of their names.
UNPACKERS = {".gz": gzip.open, ".tgz": gzip.open, ".bz2": bz2.open, ".tbz2": bz2.open, ".xz": lzma.open, ".txz": lzma.open, ".lzma": lzma.open, ".zst": _zstd, ".zstd": _zstd}

#: Byte order marks, which decide before any label.
MARKS = {codecs.BOM_UTF8: "utf-8", codecs.BOM_UTF16_LE: "utf-16-le", codecs.BOM_UTF16_BE: "utf-16-be"}


def _opened(path: str, decompress: bool, encoding: str) -> io.TextIOWrapper:
    file = open(path, "rb")  # noqa: SIM115
    unpack = UNPACKERS.get(os.path.splitext(path)[1].lower()) if decompress else None
    stream = io.BufferedReader(unpack(file) if unpack else file)
    start = stream.peek(3)[:3]
    for mark, name in MARKS.items():
        if start.startswith(mark):
            stream.read(len(mark))
            return io.TextIOWrapper(stream, name, "replace", newline="\n")
    return io.TextIOWrapper(stream, "utf-8" if encoding == "auto" else encoding, "replace", newline="\n")


def lines_of_files(listing: DataFrame, decompress: bool = False, encoding: str = "auto", path: str = "path", tasks: int | None = None) -> DataFrame:
    """The other columns of a listing with line_number, line and problem: a row per line of each file, which is read as a stream.

    A task holds a batch of lines at a time, so memory doesn't depend on a file's size, packed or not. decompress unpacks
    what a name's ending says is packed (UNPACKERS). A file that can't be opened or unpacked has a row with the problem behind what was read.
    """
    if encoding != "auto":
        codecs.lookup(encoding)
    kept = [c for c in listing.columns if c not in ("problem",)]
    at = kept.index(path)
    fields = [listing.schema[c] for c in kept]
    kinds = T.StructType([*fields, T.StructField("line_number", T.LongType()), T.StructField("line", T.StringType()), T.StructField("problem", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, name in enumerate(b.column(at).to_pylist()):
                for first, lines, problem in _chunks(name):
                    n = len(lines) + (problem is not None)
                    own = [pa.concat_arrays([c.slice(k, 1)] * n) if n == 1 else c.take(pa.array([k] * n)) for c in b.columns]
                    numbers = [*range(first, first + len(lines)), *([None] * (problem is not None))]
                    text = [*lines, *([None] * (problem is not None))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(numbers, pa.int64()), pa.array(text, pa.string()), pa.array([None] * len(lines) + [problem] * (problem is not None), pa.string())], names=[f.name for f in kinds])

    def _chunks(name: str) -> Iterator[tuple[int, list[str], str | None]]:
        lines, size, first = [], 0, 1
        try:
            with _opened(name, decompress, encoding) as file:
                for line in file:
                    lines.append(line.removesuffix("\n"))
                    size += len(line)
                    if size >= TEXT_BYTES or len(lines) >= ROWS:
                        yield first, lines, None
                        lines, size, first = [], 0, first + len(lines)
        except (OSError, EOFError, lzma.LZMAError, ValueError) as e:
            yield first, lines, str(e) or type(e).__name__
            return
        except Exception as e:  # zstandard's own errors
            if type(e).__module__.split(".")[0] != "zstandard":
                raise
            yield first, lines, str(e)
            return
        if lines:
            yield first, lines, None

    dealt = listing.select(*kept).repartition(tasks or listing.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, kinds)


def unlinked(listing: DataFrame) -> DataFrame:
    """What of a listing is searched: no links that weren't followed, and nothing with a problem."""
    return listing.filter(~F.col("is_link") & F.col("problem").isNull())
