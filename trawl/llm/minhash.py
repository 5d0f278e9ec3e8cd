"""Near-duplicate detection with fast similarity sketching, banding and exact verification.

A text's set is its distinct five-word shingles (a shorter text is one shingle). A sketch has BANDS * ROWS
coordinates, filled in rounds: in each round of the first half every shingle is thrown at one coordinate, in round
i of the second half all are thrown at coordinate i, and the smallest (round, hash) stays; a text is done as soon as
all its coordinates are filled, which takes few rounds and at most twice as many as there are coordinates. The share of
equal coordinates is concentrated about the Jaccard similarity.

Equal sets are one class, of which one row goes on. Band values are range-partitioned and sorted by (band value,
next band's value), so that a bucket of any size lies over as many tasks as it needs, and each row is paired with
the next NEIGHBOURS rows of its bucket: buckets up to that size are paired fully, and in a larger one the rows that
agree in further coordinates are neighbours. Pairs whose sketches agree in less than LEAST_AGREEMENT of the coordinates
are dropped (five standard deviations below the threshold). Then full sets are compared: first one partner for each
document, and, once linked documents have become components, every remaining pair across two of them. So a large
group of near copies costs a few comparisons a member.

What neighbours in large buckets don't see of each other is completed exactly. Large buckets that still hold several
components tie these into clusters, of which each text is one row however many buckets it shares. What lies
outside a cluster's largest component is a query set, held against the cluster in blocks of bounded size, where full
sets are counted against each other at once and only links that join components leave a block. A first round holds
each query block against FIRST blocks, which links most of a large group of near copies; a second one covers the rest
of the clusters that still hold several components. Texts with too few shingles in any other text of the clusters
are ruled out before. So no pair that shares a bucket goes unseen.

A pair of similarity 0.75 shares no bucket with probability 2e-5; more similar ones are missed more rarely.

Defined cases: null texts and texts without words have no shingles and are linked with nothing. Documents with equal
doc_id are one document's copies: each gets its row. A null doc_id is linked like any other, and is a component's
id only where there is no other. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BROADCAST_IDS, ROW, drop_rows, lean, looked_up, numbered, owing, release, shuffle_partitions, staged
from .components import connected_components
from .elias_fano import U
from .sp_sampling import mixed
from .word_hashes import word_hashes

#: Words in a shingle; similarity as intersection * 100 >= union * 75; bands of rows; partners in a bucket on either side.
WORDS, SIMILAR, BANDS, ROWS, NEIGHBOURS, LEAST_AGREEMENT = 5, (75, 100), 40, 5, 3, 0.6

#: Most texts of a block and bytes of their sets when clusters are compared; blocks that a query block meets in the first round.
BLOCK, BLOCK_BYTES, FIRST = 512, 4_000_000, 2

#: Shared shingles that are counted in one matrix product.
COLUMNS = 2048

#: Bytes and texts that are sketched together.
CHUNK_BYTES, CHUNK_TEXTS = 2_000_000, 2000
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts one after the other, ascending in each, and each text's number of them."""
    data = b"\n".join(texts).lower()
    w, starts = word_hashes(data)
    edges = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    return shingles_of(data, w, starts, edges[:-1], edges[1:], words)


def shingles_of(data: bytes, w: np.ndarray, starts: np.ndarray, first: np.ndarray, end: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The same for pieces of lower-cased data, each from its word number first to before its word number end.

    w, starts: word_hashes(data)."""
    sizes = end - first
    n = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
    ends = np.cumsum(n)
    at = np.arange(n.sum()) + np.repeat(first - ends + n, n)
    every = max(0, len(w) - words + 1)
    with np.errstate(over="ignore"):
        h = sum((w[j : j + every] * U(_ODD[j % 5] + 2 * (j // 5)) for j in range(words)), np.zeros(every, U))
    h = mixed(h[np.minimum(at, every - 1)]) if every else np.zeros(len(at), U)
    for k in np.flatnonzero((sizes > 0) & (sizes < words)).tolist():
        own = data[starts[first[k]] : starts[end[k]] if end[k] < len(starts) else len(data)].split()
        h[ends[k] - 1] = xxhash.xxh64_intdigest(b" ".join(own), 3)
    for m, z in zip(n.tolist(), ends.tolist()):
        h[z - m : z].sort()
    text = np.repeat(np.arange(len(n)), n)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.bincount(text[new], minlength=len(n))


def sketches(h: np.ndarray, sizes: np.ndarray, t: int) -> np.ndarray:
    """A row of t coordinates for each non-empty set; empty sets get rows without meaning."""
    most = U(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sizes), t), most)
    of, flat = np.repeat(np.arange(len(sizes)), sizes), out.reshape(-1)
    open_ = np.flatnonzero(sizes)
    low = U((1 << 48) - 1)
    for i in range(2 * t):
        if not len(h):
            break
        thrown = mixed(h ^ mixed(np.array([i], U)))
        bins = ((thrown >> U(32)) * U(t) >> U(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(flat, of * t + bins, (thrown & low) | U(i << 48))
        open_ = open_[(out[open_] == most).any(axis=1)]
        on = np.zeros(len(sizes), bool)
        on[open_] = True
        on = on[of]
        h, of = h[on], of[on]
    return out


def band_values(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sketch.reshape(len(sketch), bands, rows)
    out = np.broadcast_to(mixed(np.arange(bands, dtype=U)), (len(sketch), bands))
    for k in range(rows):
        out = mixed(out ^ parts[:, :, k])
    return out.view(np.int64)


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_BYTES or k + 1 - start >= CHUNK_TEXTS:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _set_keys(h: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    ends = np.cumsum(sizes)
    return [xxhash.xxh3_128_digest(h[e - n : e]) if n else None for e, n in zip(ends.tolist(), sizes.tolist())]


def byte_rows(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Rows of so many bytes each, one after the other in data."""
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


#: What signed() gives for a set.
SIGNED = ("n_shingles", "set_key", "sketch", "bands")
SIGNED_TYPES = "n_shingles long, set_key binary, sketch binary, bands array<long>"


def signed(h: np.ndarray, sizes: np.ndarray, bands: int, band_rows: int) -> list[pa.Array]:
    """n_shingles, set_key, sketch (a byte a coordinate) and bands of sets as shingles() gives them."""
    sketch = sketches(h, sizes, bands * band_rows)
    values = pa.array(band_values(sketch, bands, band_rows).reshape(-1))
    return [
        pa.array(sizes),
        pa.array(_set_keys(h, sizes), pa.binary()),
        byte_rows(sketch.astype(np.uint8), np.full(len(sizes), bands * band_rows)),
        pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * np.int32(bands)), values),
    ]


def signatures(rows: DataFrame, bands: int, band_rows: int, words: int = WORDS) -> DataFrame:
    """key, row_id, n_shingles, set_key, sketch (a byte a coordinate), bands; for each row of rows (key, text: strings)."""

    @lean()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for i, j in _chunks(texts):
                own = b.slice(i, j - i)
                made = signed(*shingles(texts[i:j], words), bands, band_rows)
                yield pa.RecordBatch.from_arrays([own.column("key"), own.column("row_id"), *made], names=["key", "row_id", *SIGNED])

    own = rows.select("key", F.monotonically_increasing_id().alias("row_id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(run, f"key string, row_id long, {SIGNED_TYPES}")


def neighbour_pairs(nodes: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """a, b, chain. Pairs of nodes (node, bands) that are near each other in a bucket; and, with chain set, pairs that hold each
    bucket together that has more rows than neighbours see of each other. A bucket that may go on in the next
    partition is such a bucket, and is a negative number in a pair with one of its nodes. Rows may be repeated."""
    n = shuffle_partitions(nodes.sparkSession)
    each = nodes.select("node", "bands", F.posexplode("bands").alias("band", "bucket"))
    following = F.get("bands", (F.col("band") + 1) % F.size("bands"))
    rows = each.select("node", "bucket", following.alias("following"))
    ordered = rows.repartitionByRange(n, "bucket", "following").sortWithinPartitions("bucket", "following", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, node = np.empty(0, np.int64), np.empty(0, np.int64)
        first = None
        w = neighbours + 1
        for b in batches:
            if not b.num_rows:
                continue
            old = len(bucket)
            bucket, node = np.concatenate([bucket, b.column("bucket").to_numpy()]), np.concatenate([node, b.column("node").to_numpy()])
            if first is None:
                first = bucket[0]
                yield _pairs_batch(_name(bucket[:1]), node[:1], True)
            found = [np.empty((2, 0), np.int64)]
            for d in range(1, neighbours + 1):
                start = max(0, old - d)  # pairs that end in this batch
                at = start + np.flatnonzero(bucket[start : max(start, len(bucket) - d)] == bucket[start + d :])
                found.append(np.stack([node[at], node[at + d]]))
            a, z = np.sort(np.concatenate(found, axis=1), axis=0)
            order = np.lexsort((z, a))
            a, z = a[order], z[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (z[1:] != z[:-1])
            yield _pairs_batch(a[new], z[new], False)
            # A row is of a large bucket if it is one of w + 1 rows or more, or if the bucket may go on in another partition.
            far = bucket == first
            if len(bucket) > w:
                long = bucket[w:] == bucket[:-w]
                for d in range(w + 1):
                    far[d : d + len(long)] |= long
            at = np.flatnonzero(far[:-1] & (bucket[1:] == bucket[:-1]))
            yield _pairs_batch(node[at], node[at + 1], True)
            bucket, node = bucket[-w:], node[-w:]
        if first is not None:
            at = np.flatnonzero(bucket == bucket[-1])
            yield _pairs_batch(np.append(node[at[:-1]], _name(bucket[-1:])), np.append(node[at[1:]], node[-1:]), True)

    return ordered.select("bucket", "node").mapInArrow(run, "a long, b long, chain boolean")


def _name(bucket: np.ndarray) -> np.ndarray:
    """A bucket as a number that no node has."""
    return ~(bucket & np.int64(2**63 - 1))


def _pairs_batch(a: np.ndarray, b: np.ndarray, chain: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), chain))], names=["a", "b", "chain"])


def agreeing(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """a, b, agreement: the pairs whose sketches agree in at least that share of the coordinates."""

    @F.pandas_udf("double")
    def agreement(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([np.mean(np.frombuffer(p, np.uint8) == np.frombuffer(q, np.uint8)) for p, q in zip(x, y)], dtype=float)

    own = nodes.select("node", "sketch")
    met = pairs.join(own.toDF("a", "sketch_a"), "a").join(own.toDF("b", "sketch_b"), "b")
    return met.select("a", "b", agreement("sketch_a", "sketch_b").alias("agreement")).filter(F.col("agreement") >= least)


def full_sets(rows: DataFrame, wanted: DataFrame, n: int, words: int = WORDS) -> DataFrame:
    """node, members (8 bytes a shingle): the sets of wanted (n rows: key, set_key, node), made from the texts anew."""

    @lean()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for i, j in _chunks(texts):
                h, sizes = shingles(texts[i:j], words)
                yield pa.RecordBatch.from_arrays([pa.array(_set_keys(h, sizes), pa.binary()), byte_rows(h, 8 * sizes)], names=["set_key", "members"])

    keys = wanted.select("key").distinct()
    keys = F.broadcast(keys) if n <= BROADCAST_IDS else keys
    texts = rows.join(keys, "key", "left_semi").select(F.coalesce("text", F.lit("")).alias("text"))
    made = texts.mapInArrow(run, "set_key binary, members binary")
    return made.join(wanted.select("set_key", "node"), "set_key").select("node", "members")


def verified(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    least, of = similar

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p, U), np.frombuffer(q, U)
            if min(len(p), len(q)) * of < max(len(p), len(q)) * least:
                out.append(False)
                continue
            both = np.concatenate([p, q])
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            out.append(shared * of >= (len(both) - shared) * least)
        return pd.Series(out, dtype=bool)

    met = pairs.select("a", "b").join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    return met.filter(alike("set_a", "set_b")).select("a", "b").distinct()


@dataclass(frozen=True)
class Banding:
    """How sketches are compared: see the module's notes."""

    bands: int = BANDS
    rows: int = ROWS
    neighbours: int = NEIGHBOURS
    least_agreement: float = LEAST_AGREEMENT
    words: int = WORDS
    similar: tuple[int, int] = SIMILAR


def near_classes(rows: DataFrame, identity: Column, how: Banding, made: DataFrame | None = None) -> DataFrame:
    """key, n_shingles, lowest: of each row of rows (key, text: strings), the least identity in its component.

    identity: an expression over key, whose least value names a component; empty sets are alone. made: the signatures of
    rows, where they are made in another way.
    """
    sketched = staged(signatures(rows, how.bands, how.rows, how.words) if made is None else made, "signatures")
    slim = staged(sketched.select("key", "row_id", "n_shingles", "set_key"), "set-keys")
    first = F.min(F.struct(identity.alias("identity"), "row_id", "key")).alias("first")
    classes = slim.filter("n_shingles > 0").groupBy("set_key").agg(first, F.count("*").alias("n_rows"))
    classes = staged(classes.select("set_key", "first.identity", "first.key", F.col("first.row_id").alias("node"), "n_rows"), "classes")
    total = classes.agg(F.sum("n_rows"), F.count("*")).first()
    linked, links, nodes = classes.withColumn("component", F.lit(None).cast("long")), classes, classes
    if total[1] > 1:
        reps = sketched.filter("n_shingles > 0").withColumnRenamed("row_id", "node")
        # Rows that copy another row's set go no further.
        reps = reps.join(classes.select("node"), "node", "left_semi") if total[0] > total[1] else reps
        nodes = staged(reps.select("node", "sketch", "bands"), "nodes")
        release(sketched)
        links = _links(rows, nodes, classes, how)
        linked = staged(classes.join(links.toDF("node", "component"), "node", "left"), "linked-classes")
    least = linked.filter("component IS NOT NULL").groupBy("component").agg(F.min("identity").alias("lowest"), F.count("*").alias("n_nodes"))
    least = staged(least, "components")
    # Large components, and what is in none, stay where they lie.
    named = looked_up(linked.filter("component IS NOT NULL").select("component", "set_key", "n_rows"), least, "component", "n_nodes", total[1])
    alone = linked.filter("component IS NULL").select("set_key", F.col("identity").alias("lowest"), "n_rows")
    named = staged(named.select("set_key", "lowest", "n_rows").unionByName(alone), "named-classes")
    release(sketched, links, nodes, linked, least, classes)
    full = looked_up(slim.filter("n_shingles > 0"), named, "set_key", "n_rows", total[0] or 0)
    empty = slim.filter("n_shingles = 0").withColumn("lowest", identity)
    return owing(full.select("key", "n_shingles", "lowest").unionByName(empty.select("key", "n_shingles", "lowest")), slim, named)


def _links(rows: DataFrame, nodes: DataFrame, classes: DataFrame, how: Banding) -> DataFrame:
    """node, component for the nodes that are similar to another."""
    near = staged(neighbour_pairs(nodes, how.neighbours), "neighbours")
    pairs = near.filter("NOT chain AND a <> b").select("a", "b").distinct()
    pairs = staged(agreeing(pairs, nodes, how.least_agreement), "pairs")
    chain = staged(near.filter("chain").select("a", "b").distinct(), "chains")
    release(near)
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets_of(rows, ends, classes, how)
    # First one partner for each node; among clear ones any, so that no node is everyone's partner.
    worth = F.when(F.col("agreement") >= 0.85, 1 + F.abs(F.xxhash64("a", "b") % 1_000_003)).otherwise(F.col("agreement"))
    chosen = staged(pairs.groupBy("b").agg(F.max_by("a", worth).alias("a")).select("a", "b"), "chosen")
    links = staged(verified(chosen, sets, how.similar), "links-1")
    first = connected_components(links)
    found = staged(first, "components-1")
    across = _across(pairs.join(chosen, ["a", "b"], "left_anti").select("a", "b"), found)
    more = staged(verified(across, sets, how.similar), "links-2")
    release(first, links, chosen, sets, pairs)
    return _completed(rows, chain, _joined(found, more), classes, how)


def _sets_of(rows: DataFrame, nodes: DataFrame, classes: DataFrame, how: Banding) -> DataFrame:
    wanted = staged(classes.join(nodes, "node").select("key", "set_key", "node"), "wanted")
    out = staged(full_sets(rows, wanted, wanted.count(), how.words), "sets")
    release(wanted)
    return out


def _across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    met = pairs.join(found.toDF("a", "component_a"), "a", "left").join(found.toDF("b", "component_b"), "b", "left")
    return met.filter(F.coalesce("component_a", "a") != F.coalesce("component_b", "b")).select("a", "b")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components of found (node, component) with more links, and the two given tables deleted if they are done with.

    Only the components that links tie together are searched again; the others keep their names."""
    if links.isEmpty():
        release(links)
        return found
    met = links.join(found.toDF("a", "component_a"), "a", "left").join(found.toDF("b", "component_b"), "b", "left")
    tied = connected_components(met.select(F.coalesce("component_a", "a").alias("a"), F.coalesce("component_b", "b").alias("b")))
    names = staged(tied.toDF("component", "name"), "names")
    release(tied)
    few = F.broadcast(names) if names.count() <= BROADCAST_IDS else names
    renamed = found.join(few, "component", "left").select("node", F.coalesce("name", "component").alias("component"))
    # A component's name is one of its nodes, so what is no node in found is a text without a component so far.
    lone = names.toDF("node", "component").join(found.select("node"), "node", "left_anti")
    out = staged(renamed.unionByName(lone), "joined")
    release(names, found, links)
    return out


def _completed(rows: DataFrame, chain: DataFrame, found: DataFrame, classes: DataFrame, how: Banding) -> DataFrame:
    """found (node, component) with what large buckets, held together by chain (a, b), still hide."""
    members = _clusters(chain, found)
    release(chain)
    if members is None:
        return found
    sets = _sets_of(rows, members.select("node"), classes, how)
    able = staged(members.join(_able(sets, how.similar), "node"), "able-members")
    release(members)
    for rounds in (FIRST, None):
        several = _several(able)
        left = staged(several if rounds else several.filter(F.col("m") > FIRST), "members-left")
        release(several)
        links = staged(_block_links(left, sets, how.similar, rounds), "links-blocks")
        release(left)
        known = None if links.isEmpty() else F.coalesce("now", "component")
        found = _joined(found, links)
        if rounds and known is not None:
            again = able.join(found.toDF("node", "now"), "node", "left").withColumn("component", known).drop("now")
            before, able = able, staged(again, "members-again")
            release(before)
    release(able, sets)
    return found


def _clusters(chain: DataFrame, found: DataFrame) -> DataFrame | None:
    """node, component, cluster: the nodes of components that large buckets tie together; None if there are none."""
    met = chain.join(found.toDF("a", "component_a"), "a", "left").join(found.toDF("b", "component_b"), "b", "left")
    met = staged(met.select("a", "b", F.coalesce("component_a", "a").alias("component_a"), F.coalesce("component_b", "b").alias("component_b")), "chained")
    bridges = met.filter("component_a <> component_b").select(F.col("component_a").alias("a"), F.col("component_b").alias("b"))
    if bridges.isEmpty():
        release(met)
        return None
    tied = connected_components(bridges)
    clusters = staged(tied.toDF("component", "cluster"), "clusters")
    release(tied)
    ends = met.select(F.col("a").alias("node"), F.col("component_a").alias("component")).unionByName(met.select(F.col("b").alias("node"), F.col("component_b").alias("component")))
    ends = ends.filter("node >= 0").distinct()
    if clusters.count() <= BROADCAST_IDS:
        out = staged(ends.join(F.broadcast(clusters), "component"), "cluster-members")
    else:
        ends = staged(ends, "cluster-ends")
        sized = staged(clusters.join(ends.groupBy("component").agg(F.count("*").alias("n_ends")), "component"), "cluster-sizes")
        out = staged(looked_up(ends, sized, "component", "n_ends", ends.count()).select("component", "node", "cluster"), "cluster-members")
        release(ends, sized)
    release(met, clusters)
    return out


def _able(sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """node, size (bytes of its set): the sets of which enough shingles stand in another one to be similar to it."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in range(0, len(b), 100):
                own = b.iloc[start : start + 100]
                sizes = [len(x) // 8 for x in own["members"]]
                yield pd.DataFrame({"node": np.repeat(own["node"].to_numpy(), sizes), "shingle": np.frombuffer(b"".join(own["members"]), np.int64)})

    each = sets.mapInPandas(spread, "node long, shingle long")
    counts = each.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    # A shingle of one text alone is found by its only node.
    alone = counts.filter("low = high").groupBy(F.col("low").alias("node")).agg(F.count("*").alias("alone"))
    least, of = similar
    size = F.octet_length("members")
    met = sets.select("node", size.alias("size")).join(alone, "node", "left")
    return met.filter((F.col("size") / 8 - F.coalesce("alone", F.lit(0))) * of >= F.col("size") / 8 * least).select("node", "size")


def _several(members: DataFrame) -> DataFrame:
    """node, component, cluster, main, m, q: the members of clusters with more than one component, with the cluster's largest
    component, and its numbers of blocks of members and of queries, which lie outside that component."""
    by = members.groupBy("cluster", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    one = F.max(F.struct("n", "component", "size"))
    sizes = by.groupBy("cluster").agg(one.alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("int")
    m, q = blocks(F.col("n"), F.col("size")), blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size"))
    sizes = staged(sizes.filter("n > main.n").select("cluster", F.col("main.component").alias("main"), m.alias("m"), q.alias("q")), "cluster-sizes")
    return owing(members.drop("size").join(F.broadcast(sizes) if sizes.count() <= BROADCAST_IDS else sizes, "cluster"), sizes)


def _block_links(members: DataFrame, sets: DataFrame, similar: tuple[int, int], rounds: int | None) -> DataFrame:
    """a, b: similar pairs of different components that join all components which similar pairs of a block join.

    Each block of queries meets every block of its cluster's members, or as many as rounds says. Sets are counted
    against each other by products of zero-one matrices, whose columns are the shingles that several sets share.
    """
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = members.join(sets, "node").withColumn("mb", place("m"))
    met = every("q") if rounds is None else F.filter(every("q"), lambda k: F.pmod(F.col("mb") - k, F.col("m")) < rounds)
    columns = ("node", "component", "members")
    held = own.select("cluster", "mb", F.explode(met).alias("qb"), *columns, F.lit(False).alias("query"))
    asked = own.filter("component <> main").withColumn("qb", place("q"))
    met = every("m") if rounds is None else F.transform(F.sequence(F.lit(0), F.least(F.col("m"), F.lit(rounds)) - 1), lambda k: F.pmod(F.col("qb") + k, F.col("m")))
    asked = asked.select("cluster", F.explode(met).alias("mb"), "qb", *columns, F.lit(True).alias("query"))

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["query", "node"])
        n = int((~rows["query"]).sum())
        pairs = _joining(rows["node"].to_numpy(), rows["component"].to_numpy(), [np.frombuffer(x, U) for x in rows["members"]], n, similar)
        return pd.DataFrame({"a": pairs[0], "b": pairs[1]})

    # A given number of tasks, since blocks are few bytes and much work.
    n = shuffle_partitions(members.sparkSession)
    blocks = held.unionByName(asked).repartition(n, "cluster", "mb", "qb").groupBy("cluster", "mb", "qb")
    return blocks.applyInPandas(link, "a long, b long").distinct()


def _joining(node: np.ndarray, component: np.ndarray, sets: list[np.ndarray], n: int, similar: tuple[int, int]) -> np.ndarray:
    """Similar pairs a < b, one of the first n sets and one of the others, that join components not joined before."""
    sizes = np.array([*map(len, sets)])
    order = np.argsort(flat := np.concatenate(sets), kind="stable")
    flat, row = flat[order], np.repeat(np.arange(len(sets)), sizes)[order]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    count = np.diff(first, append=len(flat))
    shared = np.repeat(count > 1, count)  # a shingle of one set alone is in no intersection
    row, column = row[shared], np.repeat(np.cumsum(count > 1) - 1, count)[shared]
    both = np.zeros((n, len(sets) - n), np.float32)
    for start in range(0, int((count > 1).sum()), COLUMNS):
        a, z = np.searchsorted(column, [start, start + COLUMNS])
        grid = np.zeros((len(sets), COLUMNS), np.float32)
        grid[row[a:z], column[a:z] - start] = 1
        both += grid[:n] @ grid[n:].T
    shared = both.astype(np.int64)
    union = sizes[:n, None] + sizes[None, n:] - shared
    i, j = np.nonzero((shared * similar[1] >= union * similar[0]) & (component[:n, None] != component[None, n:]))
    j += n
    # One pair for each two components, then those of a spanning forest.
    named, at = np.unique(component, return_inverse=True)
    _, one = np.unique(at[i] * len(named) + at[j], return_index=True)
    parent = [*range(len(named))]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k in one.tolist():
        x, y = root(at[i[k]]), root(at[j[k]])
        if x != y:
            parent[x] = y
            kept.append(k)
    return np.sort(np.stack([node[i[kept]], node[j[kept]]]), axis=0)


def near_duplicates(docs: DataFrame, how: Banding = Banding()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key")
    own = F.when(F.col("key") != "", F.col("key")).cast("long")
    found = near_classes(docs.select(key, "text"), F.struct(own.isNull().alias("unknown"), own.alias("doc_id")), how)
    out = found.select(own.alias("doc_id"), "n_shingles", F.col("lowest.doc_id").alias("component_id"))
    return owing(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), found)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the least (doc_id, row), where a null doc_id comes last."""
    rows = numbered(docs)
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), ROW).alias("key")
    parts = F.split("key", ":")
    own = F.when(parts[0] != "", parts[0]).cast("long")
    identity = F.struct(own.isNull().alias("unknown"), own.alias("doc_id"), parts[1].cast("long").alias("row"))
    found = near_classes(rows.select(key, "text"), identity, Banding())
    gone = staged(found.select(parts[1].cast("long").alias(ROW), F.col("lowest.row").alias("kept")).filter(F.col(ROW) != F.col("kept")).select(ROW), "near-gone")
    release(found)
    return drop_rows(rows, gone, gone.count())


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
