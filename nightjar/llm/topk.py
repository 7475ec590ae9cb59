"""Exact top-k search by inner product over KD-trees, one per shard."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightjar.llm.common import arrow_map, cut_lineage

ROWS_PER_SHARD = 4096
QUERIES_PER_BLOCK = 256
LEAF = 64


class KdTree:
    """Median splits of the widest side down to leaves of LEAF rows, with the tight box of every node.

    Nodes are stored in arrays: ``order`` lists the rows leaf by leaf, node i holds rows
    ``span[i]`` of it and has children ``child[i]``, -1 for leaves.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.arange(len(points))
        span, child, low, high = [], [], [], []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = points[self.order[a:b]]
            node = len(span)
            span.append((a, b))
            child.append([-1, -1])
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            if parent >= 0:
                child[parent][side] = node
            if b - a > LEAF and (high[-1] > low[-1]).any():
                axis = int(np.argmax(high[-1] - low[-1]))
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], middle)]
                todo += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
        self.span, self.child = np.array(span), np.array(child)
        self.low, self.high = np.array(low), np.array(high)

    def search(self, query: np.ndarray, k: int, ids: np.ndarray, own_id: int, floor: int) -> list[tuple[int, int]]:
        """The k best (score, id) other than ``own_id`` that score ``floor`` or more, ties to the smaller id.

        Nodes are opened best bound first; a node's bound is the largest inner product its box allows. The
        search ends when the best bound left is below the k-th best score, be it found here or before.
        """
        bounds = np.where(query > 0, self.high * query, self.low * query).sum(axis=1)
        queue, best = [(-int(bounds[0]), 0)], []  # best: a heap of (score, -id)
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < floor or (len(best) == k and -bound < best[0][0]):
                break
            if self.child[node, 0] >= 0:
                for c in self.child[node].tolist():
                    heapq.heappush(queue, (-int(bounds[c]), c))
                continue
            rows = self.order[slice(*self.span[node])]
            scores = self.points[rows] @ query
            for s, i in zip(scores.tolist(), ids[rows].tolist()):
                if s >= floor and i != own_id:
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def _points(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, point) with integer components; vectors that are null, empty or hold a null, NaN or infinity are left out."""
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda v: F.floor(F.lit(scale) * v).cast("bigint")).alias("point"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.int64)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """The ``k`` rows of ``vectors`` (vec_id, embedding) with the largest integer inner product per query.

    Components become floor(scale * x). Queries are the rows whose vec_id is divisible by ``every``;
    candidates are all rows but those with the query's own id. Returns query_id, rank from 1, vec_id and score, ties
    to the smaller vec_id, all candidates if there are fewer than ``k``.

    Rows are dealt by a hash into shards of about ROWS_PER_SHARD, and a KD-tree is built per shard. Queries
    travel in blocks of about QUERIES_PER_BLOCK. Each block searches the shard of its own number first; the k-th
    score found there is then a floor for all other shards, where boxes that cannot reach it are not
    opened. Both rounds are exact, so the result is that of a full scan.

    Vectors that are null, empty or hold a null or non-finite component take no part, nor do null
    ids; all others must have one length. Rows with equal vec_ids stay separate candidates, and each is
    a query of its own with the same id: equal results are returned once. An empty table gives an empty
    one; extra columns are ignored.
    """
    points = cut_lineage(_points(vectors, scale))
    n, widths = points.agg(F.count("*"), F.collect_set(F.size("point"))).first()
    if len(widths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(widths)}")
    shards = max(1, math.ceil(n / ROWS_PER_SHARD))
    blocks = max(1, math.ceil(n / every / QUERIES_PER_BLOCK))
    width = widths[0] if widths else 1

    def gather(group: pa.Table) -> pa.Table:
        ids = np.array(group.column("vec_id").to_pylist(), np.int64)
        return pa.table([group.column("lot")[:1].combine_chunks(), pa.array([ids.tobytes()], pa.binary()), pa.array([_matrix(group.column("point")).tobytes()], pa.binary())], names=["lot", "ids", "body"])

    packed = lambda df, lots, seed: df.withColumn("lot", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id() if seed else F.lit(0)), F.lit(lots)).cast("int")).groupBy(
        "lot").applyInArrow(gather, "lot int, ids binary, body binary")
    trees = cut_lineage(packed(points, shards, 1).withColumnsRenamed({"lot": "shard"}))
    asked = points.where(F.col("vec_id") % every == 0).distinct()
    queries = cut_lineage(packed(asked, blocks, 0).withColumnsRenamed({"lot": "block", "ids": "query_ids", "body": "query_body"}))

    def search(batches):
        last = tree = None
        for batch in batches:
            for block, shard, ids, body, query_ids, query_body, floors in zip(*[batch.column(c).to_pylist() for c in ("block", "shard", "ids", "body", "query_ids", "query_body", "floors")]):
                if shard != last:
                    last, own_ids, tree = shard, np.frombuffer(ids, np.int64), KdTree(np.frombuffer(body, np.int64).reshape(-1, width))
                known = np.frombuffer(floors, np.int64) if floors else np.full(len(query_ids) // 8, np.iinfo(np.int64).min)
                out = [(block, place, q, s, i) for place, (q, point, floor) in enumerate(zip(np.frombuffer(query_ids, np.int64).tolist(), np.frombuffer(query_body, np.int64).reshape(-1, width), known.tolist()))
                       for s, i in tree.search(point, k, own_ids, q, floor)]
                columns = list(zip(*out)) or [()] * 5
                yield pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])], names=["block", "place", "query_id", "score", "vec_id"])

    schema = "block int, place int, query_id bigint, score bigint, vec_id bigint"
    columns = ["block", "shard", "ids", "body", "query_ids", "query_body", "floors"]
    home = F.pmod(F.col("block"), F.lit(shards))
    first = cut_lineage(arrow_map(queries.withColumn("shard", home).withColumn("floors", F.lit(None).cast("binary")).join(trees, "shard").select(columns), search, schema))

    def floors_of(group: pa.Table) -> pa.Table:
        place, score = np.array(group.column("place").to_pylist()), np.array(group.column("score").to_pylist(), np.int64)
        out = np.full(int(group.column("n")[0].as_py()), np.iinfo(np.int64).min)
        full = np.flatnonzero(np.bincount(place, minlength=len(out)) >= k)
        least = np.full(len(out), np.iinfo(np.int64).max)
        np.minimum.at(least, place, score)
        out[full] = least[full]
        return pa.table([group.column("block")[:1].combine_chunks(), pa.array([out.tobytes()], pa.binary())], names=["block", "floors"])

    sized = first.join(queries.select("block", (F.octet_length("query_ids") / 8).cast("bigint").alias("n")), "block")
    floors = sized.groupBy("block").applyInArrow(floors_of, "block int, floors binary")
    others = queries.join(floors, "block", "left").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != home)
    second = arrow_map(others.join(trees, "shard").select(columns), search, schema)
    rank = F.row_number().over(Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id"))
    return first.unionByName(second).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").distinct()
