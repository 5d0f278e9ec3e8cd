"""Hard negatives of anchors: rows of other labels whose score lies in a window below that of each of the anchor's positives.

Each row's vector, norm and angles to a few reference directions are stored once, in an order by nearest direction and angle, cut into
tiles. The angle between two rows is at least the difference of their angles to a direction and at most their sum (or what that lacks
of a full turn); the tightest over all directions gives an interval of cosines, and times both norms, widened by more than any rounding,
one of scores. Anchors meet rows tile by tile. Blocks of rows whose interval can't reach an anchor block are passed over, then rows whose own
interval overlaps no window; what is left gets whole-number inner products. Positives are found first: their window is open above and
starts at the fifth best score so far. Every row is indexed and the result is exact; the directions only decide how much is passed over.
They are picked from a bounded sample of rows (SAMPLE).

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part. A vector that is shorter than others
has zeros behind its end; an empty one scores 0. A null vec_id is no anchor, loses ties, and is returned as null. Repeated rows are rows
of their own: each anchor row gives results, and copies of an anchor can be its positives. Ties are settled by vec_id. Anchors without positives, and
positives without negatives, give no rows; a negative positive score has an empty window. Scores that doubles don't hold exactly are
computed with Python's integers; one beyond 64 bits is an error. An empty table gives no rows. Other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import owing, release, staged

#: Rows that the reference directions are picked from, and how many directions.
SAMPLE, DIRECTIONS = 1000, 8

#: Most rows, and anchors, in a tile (as ranges are cut, up to a few times that); rows of a block within one.
TILE_ROWS, TILE_ANCHORS, BLOCK_ROWS, BLOCK_ANCHORS = 16_384, 4096, 2048, 64

POSITIVES, NEGATIVES, ANCHOR_EVERY, FACTOR = 5, 5, 100, 256

#: What intervals are widened by: an angle, a part of the norms' product, and a whole score.
SLACK, UNITS = 1e-9, 1.0

#: Products of whole numbers up to this, and a hundred times their sum, are exact in doubles and longs.
EXACT = 2.0**46

NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Vectors:
    uid: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    x: np.ndarray  # whole numbers, as doubles
    norm: np.ndarray
    angle: np.ndarray  # to each direction

    @staticmethod
    def of(table: pa.Table, directions: int) -> Vectors:
        column = lambda c: table.column(c).combine_chunks()
        flat = lambda c, width: column(c).flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, width)
        dims = len(column("x").flatten()) // max(table.num_rows, 1)
        return Vectors(*(column(c).to_numpy(zero_copy_only=False) for c in ("uid", "vec_id", "label")), flat("x", dims), column("norm").to_numpy(zero_copy_only=False), flat("angle", directions))

    def __getitem__(self, rows: slice | np.ndarray) -> Vectors:
        return Vectors(*(v[rows] for v in (self.uid, self.vec_id, self.label, self.x, self.norm, self.angle)))

    def __len__(self) -> int:
        return len(self.uid)


def angles(x: np.ndarray, norm: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles of rows to unit directions, exact to a few rounding errors also where they are small."""
    u = x / np.where(norm > 0, norm, 1)[:, None]
    return np.stack([2 * np.arctan2(np.linalg.norm(u - d, axis=1), np.linalg.norm(u + d, axis=1)) for d in directions], axis=1)


def directions_of(x: np.ndarray, k: int) -> np.ndarray:
    """k unit directions out of rows: the mean's, then each the one furthest from those before it."""
    size = np.linalg.norm(x, axis=1)
    u = x[size > 0] / size[size > 0][:, None]
    out = np.zeros((k, x.shape[1]))
    if len(u):
        mean = u.mean(axis=0)
        out[0] = mean / np.linalg.norm(mean) if np.linalg.norm(mean) > 1e-6 else u[0]
        near = u @ out[0]
        for i in range(1, k):
            out[i] = u[np.argmin(near)]
            near = np.maximum(near, u @ out[i])
    return out


def bounds(a: Vectors, b: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """What the score of each row of a with each of b is at least and at most."""
    least, most = np.zeros((len(a), len(b))), np.full((len(a), len(b)), np.pi)
    for k in range(a.angle.shape[1]):
        one, other = a.angle[:, k, None], b.angle[None, :, k]
        np.maximum(least, np.abs(one - other), out=least)
        both = one + other
        np.minimum(most, np.minimum(both, 2 * np.pi - both), out=most)
    with np.errstate(over="ignore", invalid="ignore"):
        scale = a.norm[:, None] * b.norm[None, :]
        room = scale * SLACK + UNITS
        low, high = np.cos(np.minimum(most + SLACK, np.pi)) * scale - room, np.cos(np.maximum(least - SLACK, 0)) * scale + room
    return np.nan_to_num(low, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(high, nan=np.inf, posinf=np.inf, neginf=-np.inf)


def block_bounds(a: Vectors, b: Vectors) -> tuple[float, float]:
    """The same for all rows of a with all of b at once, from the ranges of their angles and norms."""
    low_a, high_a, low_b, high_b = a.angle.min(axis=0), a.angle.max(axis=0), b.angle.min(axis=0), b.angle.max(axis=0)
    least = max(0.0, (low_a - high_b).max(), (low_b - high_a).max()) - SLACK
    most = min(np.pi, (high_a + high_b).min(), (2 * np.pi - low_a - low_b).min()) + SLACK
    small, large = a.norm.min() * b.norm.min(), a.norm.max() * b.norm.max()
    if not np.isfinite(large):
        return -np.inf, np.inf
    low, high = np.cos(min(most, np.pi)), np.cos(max(least, 0.0))
    return min(low * small, low * large) - large * SLACK - UNITS, max(high * small, high * large) + large * SLACK + UNITS


def scores(a: Vectors, b: Vectors) -> np.ndarray:
    """Whole-number inner products: longs, or Python's integers where doubles wouldn't be exact."""
    top = lambda v: np.abs(v.x).max(initial=0.0)
    with np.errstate(over="ignore"):
        if top(a) * top(b) * max(a.x.shape[1], 1) < EXACT:
            return (a.x @ b.x.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return whole(a.x).astype(object) @ whole(b.x).astype(object).T


class Best:
    """The best n (score, vec_id, uid) so far for each of some searches."""

    def __init__(self, searches: int, n: int):
        self.n, self.rows = n, [[] for _ in range(searches)]
        self.floor = np.full(searches, -np.inf)  # scores below it are of no use

    def add(self, k: int, found: np.ndarray, rows: Vectors) -> None:
        if len(found) > self.n:
            order = np.lexsort((rows.uid, rows.vec_id, -found))[: self.n] if found.dtype != object else np.array(sorted(range(len(found)), key=lambda i: (-found[i], rows.vec_id[i], rows.uid[i]))[: self.n])
            found, rows = found[order], rows[order]
        new = zip((-found).tolist(), rows.vec_id.tolist(), rows.uid.tolist())
        self.rows[k] = sorted([*self.rows[k], *new])[: self.n]
        if len(self.rows[k]) == self.n:
            self.floor[k] = -self.rows[k][-1][0]


def blocks(rows: Vectors, size: int) -> list[Vectors]:
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def nearest(anchors: Vectors, rows: Vectors, n: int) -> Best:
    """Each anchor's best other rows of its label."""
    out, parts = Best(len(anchors), n), blocks(rows, BLOCK_ROWS)
    for first in range(0, len(anchors), BLOCK_ANCHORS):
        own = anchors[first : first + BLOCK_ANCHORS]
        floor = out.floor[first : first + len(own)]  # a view
        for high, part in sorted(((block_bounds(own, p)[1], p) for p in parts), key=lambda x: -x[0]):
            if high < floor.min():
                break
            open_ = (own.label[:, None] == part.label) & (own.uid[:, None] != part.uid)
            open_ &= bounds(own, part)[1] >= floor[:, None]
            met = np.flatnonzero(open_.any(axis=0))
            left, open_ = part[met], open_[:, met]
            found = scores(own, left)
            open_ &= (found >= floor[:, None]).astype(bool)
            for k in np.flatnonzero(open_.any(axis=1)):
                out.add(first + k, found[k, open_[k]], left[open_[k]])
    return out


def in_windows(anchors: Vectors, windows: list[list[int]], rows: Vectors, n: int) -> list[Best]:
    """For each anchor and score p of its windows: the best rows of other labels with 80 p <= 100 score <= 100 p."""
    out, parts = [Best(len(w), n) for w in windows], blocks(rows, BLOCK_ROWS)
    for first in range(0, len(anchors), BLOCK_ANCHORS):
        own, best = anchors[first : first + BLOCK_ANCHORS], out[first : first + BLOCK_ANCHORS]
        width = max(map(len, windows[first : first + BLOCK_ANCHORS]))
        top = np.full((len(own), width), -np.inf)
        for k, w in enumerate(windows[first : first + len(own)]):
            top[k, : len(w)] = [p if p >= 0 else -np.inf for p in w]
        bottom = np.where(top >= 0, 0.8 * top * (1 - SLACK), np.inf)
        for part in parts:
            floors = np.full_like(top, -np.inf)
            for k, b in enumerate(best):
                floors[k, : len(b.floor)] = b.floor
            least, most = block_bounds(own, part)
            if not ((bottom <= most) & (top >= least) & (floors <= most)).any():
                continue
            low, high = bounds(own, part)
            open_ = np.zeros_like(low, bool)
            for j in range(width):
                open_ |= (high >= np.maximum(bottom, floors)[:, j, None]) & (low <= top[:, j, None])
            open_ &= own.label[:, None] != part.label
            met = np.flatnonzero(open_.any(axis=0))
            left, open_ = part[met], open_[:, met]
            found = scores(own, left)
            for k in np.flatnonzero(open_.any(axis=1)):
                there, rest = found[k, open_[k]], left[open_[k]]
                for j, p in enumerate(windows[first + k]):
                    fits = ((100 * there >= 80 * p) & (there <= p) & (there >= best[k].floor[j])).astype(bool)
                    if fits.any():
                        best[k].add(j, there[fits], rest[fits])
    return out


def indexed(vectors: DataFrame, directions: int = DIRECTIONS) -> DataFrame:
    """uid, vec_id, label, x, norm, angle, cell (the nearest direction) and near (the angle to it) of the rows that take part, written."""
    v, label = F.col("embedding").cast("array<double>"), F.col("label").cast("long")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(fine).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), moved.alias("label"), v.alias("v"))
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0

    def padded(column: pa.ListArray) -> np.ndarray:
        sizes = np.diff(column.offsets.to_numpy())
        out = np.zeros((len(column), dims))
        out[np.arange(dims) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore"):
            return np.floor(FACTOR * out)

    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v")
    own = directions_of(padded(pa.array(sample.to_pylist(), pa.list_(pa.float64()))), directions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = padded(b.column("v"))
            with np.errstate(over="ignore", invalid="ignore"):
                norm = np.linalg.norm(x, axis=1)
                angle = angles(x, norm, own)
            cell = np.argmin(angle, axis=1).astype(np.int32) if len(x) else np.zeros(0, np.int32)
            lists = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1]).cast(pa.list_(pa.float64())) if m.shape[1] else pa.array([[]] * len(m), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), lists(x), pa.array(norm), lists(angle), pa.array(cell), pa.array(angle.min(axis=1, initial=np.pi))], names=["vec_id", "label", "x", "norm", "angle", "cell", "near"])

    found = rows.mapInArrow(run, "vec_id long, label long, x array<double>, norm double, angle array<double>, cell int, near double")
    return staged(found.select(F.monotonically_increasing_id().alias("uid"), "*"), "vector-index")


def tiled(rows: DataFrame, n: int, size: int, column: str) -> tuple[DataFrame, int]:
    """n rows in order, cut into tiles that are numbered in a column, and how many numbers there are."""
    tiles = max(1, -(-n // size))
    cut = rows.repartitionByRange(tiles, "cell", "near", "vec_id", "uid").sortWithinPartitions("cell", "near", "vec_id")
    out = staged(cut.withColumn(column, F.spark_partition_id()), f"vectors-{column}")
    return out, (out.agg(F.max(column)).first()[0] or 0) + 1


VECTOR = ["uid", "vec_id", "label", "x", "norm", "angle"]


def met(anchors: DataFrame, n_anchor: int, rows: DataFrame, n_row: int, run, schema: str) -> DataFrame:
    """What run makes of each anchor tile with each tile of rows: a stated set of queries against all rows, in blocks."""
    left = anchors.withColumn("row_tile", F.explode(F.sequence(F.lit(0), F.lit(n_row - 1))))
    right = rows.withColumn("anchor_tile", F.explode(F.sequence(F.lit(0), F.lit(n_anchor - 1)))).select(*VECTOR, "anchor_tile", "row_tile")
    by = ["anchor_tile", "row_tile"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema)


def _rows(found: list[tuple], names: str) -> pa.Table:
    columns = [*zip(*found)] or [()] * len(names.split())
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names.split(), columns)})


def hard_negatives(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, directions: int = DIRECTIONS, tile_rows: int = TILE_ROWS, tile_anchors: int = TILE_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    index = indexed(vectors, directions)
    n, n_anchors = index.select(F.count("*"), F.count_if(is_anchor())).first()
    # Small tables are cut finer, so that all cores have a tile.
    size = min(tile_rows, max(1024, -(-n // (2 * index.sparkSession.sparkContext.defaultParallelism))))
    rows, n_row = tiled(index, n, size, "row_tile")
    anchors, n_anchor = tiled(index.filter(is_anchor()), n_anchors, tile_anchors, "anchor_tile")
    release(index)

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        own, rest = Vectors.of(left, directions), Vectors.of(right, directions)
        best = nearest(own, rest, positives).rows if len(own) and len(rest) else []
        return _rows([(a, -s, i, u) for a, found in zip(own.uid.tolist(), best) for s, i, u in found], "anchor score id uid")

    found = met(anchors.select(*VECTOR, "anchor_tile"), n_anchor, rows, n_row, first, "anchor long, score long, id long, uid long")
    order = [F.desc("score"), "id", "uid"]
    top = found.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).filter(F.col("place") <= positives)
    windows = top.groupBy(F.col("anchor").alias("uid")).agg(F.sort_array(F.collect_list(F.struct("place", "score", "id"))).alias("w"))
    searches = anchors.join(windows, "uid").select(*VECTOR, "anchor_tile", F.col("w.score").alias("tops"), F.col("w.id").alias("ids"))
    searches = staged(searches, "hard-negative-windows")

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        own, rest = Vectors.of(left, directions), Vectors.of(right, directions)
        tops, ids = left.column("tops").to_pylist(), left.column("ids").to_pylist()
        best = in_windows(own, tops, rest, negatives) if len(own) and len(rest) else []
        flat = [(a, k, v, i, p, -s, j, u) for a, v, p_ids, w, b in zip(own.uid.tolist(), own.vec_id.tolist(), ids, tops, best) for k, (i, p, rows_) in enumerate(zip(p_ids, w, b.rows)) for s, j, u in rows_]
        return _rows(flat, "anchor place anchor_id positive_id positive_score score id uid")

    kinds = ", ".join(f"{c} long" for c in "anchor place anchor_id positive_id positive_score score id uid".split())
    found = met(searches, n_anchor, rows, n_row, second, kinds)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "place").orderBy(*order))).filter(F.col("rank") <= negatives)
    some = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    out = ranked.select("anchor_id", some("positive_id").alias("positive_id"), "rank", some("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    release(anchors)
    return owing(out, rows, searches)


def is_anchor():
    return (F.col("vec_id") % ANCHOR_EVERY == 0) & (F.col("vec_id") != NO_ID)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = """
WITH r AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.uid AS anchor, a.vec_id AS anchor_id, a.label AS own, b.uid, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.uid <> b.uid WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor, uid, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, uid) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor, p.uid ORDER BY score DESC, s.vec_id, s.uid)::INT AS rank,
  s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor = s.anchor AND s.label <> s.own AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
