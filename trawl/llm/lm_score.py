"""Language-model scores from an Elias-Fano bigram trie.

Training documents are split into tokens (words, then one end); every chunk of text is counted on its own and only
distinct tokens and bigrams with their counts are shuffled, to shards by ranges of hashes. A context is a word and
four bits of the next word's hash, so a word that starts a third of all bigrams is spread over sixteen ranges.
Each shard is one file in the shared folder, with two levels:

    tokens    hashes, and the running sum of their counts (monotone, so a difference is a count)
    bigrams   context hashes, monotone pointers to each context's first successor, the successors' hashes relative
              to their context, and the log10 counts quantised to 256 values

Scoring reads each text once more where it lies. A chunk's distinct tokens and bigrams are looked up together in
the memory-mapped levels: successor search finds the context, then the word within the context's range. Nothing but
two totals passes through the driver, and the documents aren't shuffled.

    p(w)     = (c(w) + 1) / (N + V + 1)
    p(w | v) = BIGRAM * c(v w) / c(v) + (1 - BIGRAM) * p(w), or p(w) where c(v) = 0

Defined cases: a null or empty text is one end token. Without training documents N = V = 0 and every token has
probability 1. A null doc_id counts as training. Rows with equal or null doc_id are separate documents. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lean, new_path, shuffle_partitions
from .elias_fano import EliasFano, U, from_buffer, to_bytes
from .sp_sampling import mixed

#: The bigram's weight; tokens that are counted or scored together; distinct words whose hashes a worker keeps.
BIGRAM, CHUNK, KEPT_WORDS = 0.6, 1_000_000, 500_000
END, BEGIN = xxhash.xxh64_intdigest(b"", 1), xxhash.xxh64_intdigest(b"", 2)

#: Bytes of training text for which there is a shard.
SHARD_TEXT = 32_000_000

_hashes: dict[bytes, int] = {}


def forget() -> None:
    _hashes.clear()
    _shard.cache_clear()


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the tokens of all texts one after the other, and how many each has."""
    if len(_hashes) > KEPT_WORDS:
        _hashes.clear()
    out, sizes = [], []
    for text in texts:
        words = text.encode("utf-8", "replace").lower().split()
        for w in set(words).difference(_hashes):
            _hashes[w] = xxhash.xxh64_intdigest(w)
        out.append(np.fromiter(map(_hashes.__getitem__, words), U, len(words)))
        out.append(np.array([END], U))
        sizes.append(len(words) + 1)
    return np.concatenate(out), np.array(sizes, np.int64)


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    """Texts together of about CHUNK tokens, at some six bytes each."""
    own, size = [], 0
    for t in texts:
        own.append(t)
        size += len(t)
        if size >= 6 * CHUNK:
            yield own
            own, size = [], 0
    if own:
        yield own


def _bigrams(w: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word before each token, and the 48-bit hash of its context and the 32-bit one of the token in it."""
    before = np.concatenate([[U(BEGIN)], w[:-1]]).astype(U)
    before[np.cumsum(sizes)[:-1]] = U(BEGIN)
    return before, mixed(mixed(before) ^ (w & U(15))) >> U(16), w >> U(32)


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where the rows of sorted columns change."""
    change = np.zeros(len(sorted_columns[0]), bool)
    change[:1] = True
    for c in sorted_columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _squeezed(*columns: np.ndarray) -> bytes:
    """Equally long columns, byte planes together so that equal high bytes vanish."""
    body = b"".join(np.ascontiguousarray(c.astype(U).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def _spread(data: bytes, k: int) -> list[np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8:]), np.uint8).reshape(k, 8, n)
    return [np.ascontiguousarray(p.T).view(U).reshape(-1) for p in planes]


def _counts(docs: DataFrame, shards: int) -> DataFrame:
    """shard, kind (0 tokens, 1 bigrams), data: the counts of each chunk, split by shard."""

    @lean(forget)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for texts in _chunks(b["text"].tolist()):
                w, sizes = tokens(texts)
                rows = []
                own, n = np.unique(w, return_counts=True)
                for s, a, z in _slices(own >> U(16), shards):
                    rows.append((s, 0, _squeezed(np.diff(own[a:z], prepend=U(0)), n[a:z])))
                _, context, word = _bigrams(w, sizes)
                order = np.lexsort((word, context))
                context, word = context[order], word[order]
                first = _runs(context, word)
                n = np.diff(first, append=len(word))
                context, word = context[first], word[first]
                for s, a, z in _slices(context, shards):
                    rows.append((s, 1, _squeezed(np.diff(context[a:z], prepend=U(0)), word[a:z], n[a:z])))
                yield pd.DataFrame(rows, columns=["shard", "kind", "data"])

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "shard int, kind int, data binary")


def _slices(keys: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """shard, start, end of sorted 48-bit keys, by equal ranges."""
    bounds = np.array([(s << 48) // shards for s in range(1, shards)], U)
    cuts = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        yield s, int(cuts[s]), int(cuts[s + 1])


def _summed(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    first = _runs(*keys) if len(order) else np.empty(0, np.int64)
    return [k[first] for k in keys], np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.empty(0, np.int64)


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and codes: exact up to 256 distinct values, else the nearest of 256 quantiles."""
    values = np.unique(x)
    if len(values) > 256:
        values = np.unique(np.quantile(values, np.linspace(0, 1, 256)))
    middle = (values[1:] + values[:-1]) / 2
    return values, np.searchsorted(middle, x).astype(np.uint8)


def shard_file(blobs: list[tuple[int, bytes]]) -> tuple[bytes, int, int]:
    """A shard's two levels as one file, and its numbers of tokens and of distinct tokens."""
    parts = [_spread(d, 2) for kind, d in blobs if kind == 0]
    column = lambda k: np.concatenate([p[k] for p in parts]) if parts else np.empty(0, U)
    for p in parts:
        p[0] = np.cumsum(p[0], dtype=U)
    (words,), counts = _summed([column(0)], column(1))
    out = EliasFano.of(words).parts("words") | EliasFano.of(np.concatenate([[0], np.cumsum(counts)])).parts("sums")
    total, distinct = int(counts.sum()), len(words)
    parts = [_spread(d, 3) for kind, d in blobs if kind == 1]
    for p in parts:
        p[0] = np.cumsum(p[0], dtype=U)
    (contexts, successors), counts = _summed([column(0), column(1)], column(2))
    first = _runs(contexts) if len(contexts) else np.empty(0, np.int64)
    rank = np.repeat(np.arange(len(first)), np.diff(first, append=len(contexts))).astype(U)
    values, codes = _quantised(np.log10(counts))
    out |= EliasFano.of(contexts[first]).parts("contexts") | EliasFano.of(np.append(first, len(contexts))).parts("pointers")
    out |= EliasFano.of((rank << U(32)) | successors).parts("successors") | {"values": values, "codes": codes}
    return to_bytes(out), total, distinct


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@lru_cache(maxsize=4096)
def _shard(path: str) -> dict:
    """A shard's levels: a memory map where the shared folder is a mounted one, else read through its own file system."""
    system, own = _filesystem(path)
    data = np.asarray(np.memmap(own, np.uint8, "r")) if system.type_name == "local" else np.frombuffer(system.open_input_file(own).read(), np.uint8)
    parts = from_buffer(data)
    levels = {name: EliasFano.from_parts(parts, name) for name in ("words", "sums", "contexts", "pointers", "successors")}
    return levels | {"counts": 10 ** parts["values"], "codes": parts["codes"]}


@dataclass(frozen=True)
class BigramModel:
    """A trained trie: its folder, its non-empty shards of so many, and the numbers of tokens and of distinct tokens."""

    path: str
    shards: int
    present: frozenset[int]
    n_tokens: int
    n_distinct: int

    def _open(self, s: int) -> dict | None:
        return _shard(f"{self.path}/{s}.trie") if s in self.present else None

    def token_counts(self, words: np.ndarray) -> np.ndarray:
        """c of each of these ascending hashes."""
        out = np.zeros(len(words), np.int64)
        for s, a, z in _slices(words >> U(16), self.shards):
            if levels := self._open(s):
                at, known = levels["words"].successor(words[a:z])
                at = at[known]
                out[a:z][known] = (levels["sums"][at + 1] - levels["sums"][at]).astype(np.int64)
        return out

    def bigram_counts(self, contexts: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """The quantised count of each bigram, sorted by context and successor."""
        out = np.zeros(len(contexts))
        for s, a, z in _slices(contexts, self.shards):
            if levels := self._open(s):
                rank, known = levels["contexts"].successor(contexts[a:z])
                rank = rank[known]
                start, stop = levels["pointers"][rank], levels["pointers"][rank + 1]
                at, equal = levels["successors"].successor((rank.astype(U) << U(32)) | successors[a:z][known])
                equal &= (at >= start) & (at < stop)
                found = np.zeros(len(rank))
                found[equal] = levels["counts"][levels["codes"][at[equal]]]
                out[a:z][known] = found
        return out

    def scores(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base score and score of each text."""
        w, sizes = tokens(texts)
        words, of = np.unique(w, return_inverse=True)
        count = self.token_counts(words)
        c = count[of]
        whole = self.n_tokens + self.n_distinct + 1
        plain = (c + 1) / whole
        before, context, successor = _bigrams(w, sizes)
        order = np.lexsort((successor, context))
        context, successor = context[order], successor[order]
        first = _runs(context, successor)
        pair = np.empty(len(w))
        pair[order] = np.repeat(self.bigram_counts(context[first], successor[first]), np.diff(first, append=len(w)))
        ends = self.token_counts(np.array([END], U))[0]
        # A text's first word follows its beginning, which occurs as often as an end.
        c_before = np.concatenate([[ends], c[:-1]])
        starts = np.cumsum(sizes) - sizes
        c_before[starts] = ends
        mixed_p = np.where(c_before > 0, BIGRAM * pair / np.maximum(c_before, 1) + (1 - BIGRAM) * plain, plain)
        total = lambda x: np.add.reduceat(x, starts)
        return sizes, total((c > 0).astype(np.int64)), total(np.log10(plain)), total(np.log10(mixed_p))


def train(docs: DataFrame, shards: int | None = None) -> BigramModel:
    """A trie of all texts of docs, in the shared folder.

    shards: how many files; by default one for SHARD_TEXT bytes of text, and as many as there are shuffle partitions at
    least. One task builds a shard in memory, with some 60 bytes for each distinct bigram of each chunk, which is about
    four times its share of the text. A chunk's lookups go to every shard, so CHUNK should grow along with them.
    """
    spark = docs.sparkSession
    if not shards:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(shuffle_partitions(spark), -(-size // SHARD_TEXT))
    path = new_path(spark, "bigram-trie")
    system, own = _filesystem(path)
    system.create_dir(own)

    def build(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        data, total, distinct = shard_file([*zip(table["kind"].to_pylist(), table["data"].to_pylist())])
        system, own = _filesystem(f"{path}/{shard}.trie")
        part = f"{own}.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as f:
            f.write(data)
        system.move(part, own) if system.type_name != "local" else os.replace(part, own)
        return pa.table({"shard": pa.array([shard], pa.int32()), "total": pa.array([total]), "n": pa.array([distinct])})

    rows = _counts(docs, shards).groupBy("shard").applyInArrow(build, "shard int, total long, n long").collect()  # a row for each shard
    return BigramModel(path, shards, frozenset(r["shard"] for r in rows), sum(r["total"] for r in rows), sum(r["n"] for r in rows))


def score(docs: DataFrame, model: BigramModel) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every document."""

    @lean(forget)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = 0
            for texts in _chunks(b["text"].tolist()):
                n, known, base, full = model.scores(texts)
                yield pd.DataFrame({"key": b["key"].iloc[done : done + len(texts)], "n_tokens": n, "n_known": known, "base_score": base, "score": full})
                done += len(texts)

    own = docs.select(F.col("doc_id").cast("string").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    out = own.mapInPandas(run, "key string, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("key").cast("long").alias("doc_id"), "n_tokens", "n_known", "base_score", "score")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def train_and_score(docs: DataFrame) -> DataFrame:
    """Learn from the documents that aren't held out, and score all."""
    model = train(docs.filter(~held_out()))
    out = score(docs, model).withColumn("held_out", held_out()).withColumn("train_tokens", F.lit(model.n_tokens).cast("long"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
