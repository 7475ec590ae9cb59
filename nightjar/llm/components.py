"""Connected components of a link table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.llm.common import arrow_map, cut_lineage


def _forest(df: DataFrame, flush: int = 500_000) -> DataFrame:
    """Union-find over the links of each task, ``flush`` at a time: every node points at the least one it reaches."""

    def solve(a: np.ndarray, b: np.ndarray) -> pa.Table:
        ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = flat[:len(a)], flat[len(a):]
        parent = np.arange(len(ids))
        while True:
            low = np.minimum(parent[x], parent[y])
            before = parent.copy()
            np.minimum.at(parent, parent[x], low)
            np.minimum.at(parent, parent[y], low)
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            if np.array_equal(before, parent):
                break
        own = np.flatnonzero(parent != np.arange(len(ids)))
        return pa.table([pa.array(ids[own]), pa.array(ids[parent[own]])], names=["a", "b"])

    def run(batches):
        held: list = []
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("a", "b")])
            if sum(len(h[0]) for h in held) >= flush:
                yield solve(*map(np.concatenate, zip(*held)))
                held = []
        if held:
            yield solve(*map(np.concatenate, zip(*held)))

    return arrow_map(df, run, "a bigint, b bigint")


def _meet(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step: each node's neighbours (the larger, or the smaller and itself) point at its least neighbour."""
    near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = near.join(least, "a")
    if larger:
        return out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the least node of its component.

    Links are folded to forests inside each task first; then large-star and small-star steps alternate
    until nothing moves. Aggregates fold map-side, so a node with very many links is no hot key, and the
    links never leave the executors. Self-links, repeated links and an empty table are fine.
    """
    proper = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut_lineage(_forest(proper).distinct())
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(edges)
    while seen[0]:
        edges = cut_lineage(_meet(_meet(edges, True), False))
        now = mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
