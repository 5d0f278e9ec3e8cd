"""Connected components: local contraction, then alternating large and small stars, on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ._common import owing, release, staged

#: Links that a task contracts at once (16 bytes each).
LOCAL = 200_000


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of edges (a, b: longs that are not null).

    Links are dealt out to tasks of about LOCAL, each of which links its nodes to the smallest that it can reach. Where one
    task is enough, that is the answer. Else stars follow: every half-step groups by a node with partial aggregation and
    joins two written tables, which adaptive execution may split where a node has many edges; rows are two longs. The rounds
    grow with the logarithm of the longest path. Self-loops and repeated edges do no harm; without edges there are no rows.
    """
    own = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    tasks = -(-own.count() // LOCAL)
    links = staged(own.repartition(max(1, tasks)).mapInPandas(_contracted, "u long, v long"), "contracted")
    release(own)
    before = None
    while tasks > 1:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, _ = _star(both, F.col("v") > F.col("u"), "large-star")
        release(links)
        links, now = _star(large, F.lit(True), "small-star")
        release(large)
        if now == before:
            break
        before = now
    leaves = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return owing(leaves.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), links)


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each node of a task's links (u, v) but the smallest of its component there, linked to that one."""
    parts = [b[["u", "v"]].to_numpy() for b in batches if len(b)]
    if not parts:
        return
    links = np.concatenate(parts)
    nodes, at = np.unique(links, return_inverse=True)
    at = at.reshape(links.shape)
    label = np.arange(len(nodes))
    while True:
        ends = np.sort(label[at], axis=1)
        open_ = ends[ends[:, 0] < ends[:, 1]]
        if not len(open_):
            break
        np.minimum.at(label, open_[:, 1], open_[:, 0])
        while (label[label] != label).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    yield pd.DataFrame({"u": nodes[moved], "v": nodes[label[moved]]})


def _star(links: DataFrame, kept: Column, name: str) -> tuple[DataFrame, dict]:
    """The kept neighbours of each node, and the node, linked to the smallest of them all; and what tells these links from others,
    observed while they are written."""
    least = staged(links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
    met = links.join(least, "u").filter(kept).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v")) if name == "small-star" else None
    met = met.unionByName(own) if own is not None else met
    seen = Observation()
    new = met.filter("u <> v").distinct().observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hashes"))
    out = staged(new, f"{name}-links")
    release(least)
    return out, seen.get
