"""Sources: tables and file trees as documents."""

from __future__ import annotations

import lzma
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.globs import compile_glob
from trawl.operators.filters import glob_decision
from trawl.sources.written import written_once  # noqa: F401
from trawl.spec import SpecError

#: Encoding labels and the character sets that the JVM knows them by.
CHARSETS = {
    "utf-8": "UTF-8", "utf8": "UTF-8", "utf-16": "UTF-16LE", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE",
    "latin1": "windows-1252", "l1": "windows-1252", "cp1252": "windows-1252", "x-cp1252": "windows-1252", "iso8859-1": "windows-1252", "iso_8859-1": "windows-1252",
    "iso-8859-9": "windows-1254", "latin5": "windows-1254", "l5": "windows-1254", "iso-8859-11": "x-windows-874", "tis-620": "x-windows-874",
    "ks_c_5601-1987": "x-windows-949", "korean": "x-windows-949", "x-gbk": "GBK", "chinese": "GBK", "x-sjis": "Shift_JIS", "macintosh": "x-MacRoman", "x-mac-cyrillic": "x-MacCyrillic",
     "iso-8859-1": "windows-1252", "ascii": "windows-1252", "us-ascii": "windows-1252", "windows-1252": "windows-1252",
    "iso-8859-2": "ISO-8859-2", "iso-8859-5": "ISO-8859-5", "iso-8859-7": "ISO-8859-7", "iso-8859-15": "ISO-8859-15",
    "windows-1250": "windows-1250", "windows-1251": "windows-1251", "koi8-r": "KOI8-R",
    "shift_jis": "Shift_JIS", "shift-jis": "Shift_JIS", "sjis": "Shift_JIS", "euc-jp": "EUC-JP", "iso-2022-jp": "ISO-2022-JP",
    "gbk": "GBK", "gb2312": "GBK", "gb18030": "GB18030", "big5": "Big5", "euc-kr": "EUC-KR",
}
_NATIVE = ("UTF-8", "UTF-16LE", "UTF-16BE")


def _charset(label: str) -> str:
    """The character set of a label: one of CHARSETS, or any other that the JVM knows under that name."""
    own = label.lower().strip()
    if own in CHARSETS:
        return CHARSETS[own]
    known = SparkSession.active()._jvm.java.nio.charset.Charset
    if not re.fullmatch(r"[a-z0-9][a-z0-9+.:_-]*", own) or not known.isSupported(own):
        raise SpecError(f"unknown encoding {label}")
    return known.forName(own).name()


def corpus(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text: each row is one document; no other column is read."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def from_files(spark: SparkSession, roots: str | Sequence[str], missing: list[str] | None = None) -> DataFrame:
    """path, root, rel_path, modificationTime, length, content of every regular file under the roots.

    Roots that don't exist are added to missing (or are an error without it), and the others go on. Spark's file
    source passes over names that start with a dot or underscore and over empty files; a table has no such gaps.
    """
    frames, roots = [], [roots] if isinstance(roots, str) else list(roots)
    for root in roots:
        jvm = spark.sparkContext._jvm
        there = jvm.org.apache.hadoop.fs.Path(root)
        system = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(there):
            if missing is None:
                raise SpecError(f"no such path: {root}")
            missing.append(root)
            continue
        full = system.getFileStatus(there).getPath().toString().rstrip("/")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        rel = F.when(F.col("path") == full, "").otherwise(F.substring(F.col("path"), F.lit(len(full) + 2), F.length("path")))
        frames.append(files.select("path", F.lit(root).alias("root"), rel.alias("rel_path"), "modificationTime", "length", "content"))
    if not frames:
        raise SpecError("none of the paths exist")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def list_files(df: DataFrame) -> DataFrame:
    """Paths that would be searched, without their content."""
    return df.drop("content", "text")


def first_document(df: DataFrame) -> DataFrame:
    """One path that would be searched, if there is any; tasks stop at the first."""
    return list_files(df).limit(1)


def compressed_texts(spark: SparkSession, root: str) -> DataFrame:
    """path, text of plain and compressed files: gzip, bzip2, zstandard and lz4 by extension through Spark's codecs, xz and lzma in Arrow batches."""
    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [lzma.decompress(c).decode("utf-8", "replace") for c in b["content"]]})

    read = spark.read.option("recursiveFileLookup", "true")
    plain = read.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).filter(~F.col("path").rlike(r"\.(xz|lzma)$"))
    packed = read.format("binaryFile").load(root).filter(F.col("path").rlike(r"\.(xz|lzma)$")).select("path", "content")
    return plain.unionByName(packed.mapInPandas(unpack, "path string, text string"))


def preprocess(df: DataFrame, fn: Callable[[Column], Column], globs: Sequence[str] = (), text: str = "text", path: str = "path") -> DataFrame:
    """df with its text replaced by fn(text), for documents that the globs include, or all."""
    new = fn(F.col(text))
    if globs:
        new = F.when(F.coalesce(glob_decision(F.col(path), globs), F.lit("include")) == "include", new).otherwise(F.col(text))
    return df.select(*[new.alias(c) if c == text else F.col(c) for c in df.columns])


def preprocess_batches(df: DataFrame, fn: Callable[[pd.Series], pd.Series], text: str = "text") -> DataFrame:
    """df with its text replaced by a heavy converter, applied to Arrow batches."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return fn(s)

    return df.select(*[run(F.col(c)).alias(c) if c == text else F.col(c) for c in df.columns])


def decoded(content: Column, encoding: str = "auto") -> Column:
    """Binary content as text. A byte order mark decides first; auto is else UTF-8; none keeps bytes, one character each."""
    if encoding == "none":
        return F.decode(content, "ISO-8859-1")
    charset = _charset("utf-8" if encoding == "auto" else encoding)
    rest = lambda k: F.substring(content, F.lit(k + 1), F.greatest(F.octet_length(content) - k, F.lit(0)))
    mark = lambda k: F.hex(F.substring(content, 1, k))
    utf8 = lambda c: F.make_valid_utf8(c.cast("string"))
    plain = utf8(content) if charset == "UTF-8" else F.decode(content, charset)
    even = lambda k: F.substring(content, F.lit(k + 1), F.greatest(F.octet_length(content) - k, F.lit(0)) - F.pmod(F.octet_length(content), F.lit(2)))
    if charset.startswith("UTF-16"):
        plain = F.decode(even(0), charset)
    out = F.when(mark(3) == "EFBBBF", utf8(rest(3))).when(mark(2) == "FFFE", F.decode(even(2), "UTF-16LE")).when(mark(2) == "FEFF", F.decode(even(2), "UTF-16BE"))
    return out.otherwise(plain)


def decode(df: DataFrame, encoding: str = "auto", content: str = "content", text: str = "text") -> DataFrame:
    """df with text and is_valid_utf8. Encodings beyond UTF and Latin 1 need spark.sql.legacy.javaCharsets."""
    if encoding not in ("auto", "none") and _charset(encoding) not in _NATIVE and df.sparkSession.conf.get("spark.sql.legacy.javaCharsets", "false") != "true":
        raise SpecError(f"{encoding} needs the session setting spark.sql.legacy.javaCharsets=true")
    return df.withColumn(text, decoded(F.col(content), encoding)).withColumn("is_valid_utf8", F.is_valid_utf8(F.col(content).cast("string")))


def matching_paths(df: DataFrame, glob: str, path: str = "path") -> DataFrame:
    """Rows whose whole path a single glob matches."""
    return df.filter(F.col(path).rlike(compile_glob(glob)))
