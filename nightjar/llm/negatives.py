"""Hard-negative mining by exact searches in score windows over STR-packed R-trees."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nightjar.llm.common import arrow_map, cut_lineage

ROWS_PER_SHARD = 4096
ANCHORS_PER_BLOCK = 256
SHARDS_PER_PAGE = 512
LEAF = 256
FAN = 8
LEAST, MOST = -(1 << 62), 1 << 62

REQUEST = "block string, width int, ids binary, labels binary, body binary, counts binary, lo binary, hi binary"
FOUND = "block string, place int, slot int, anchor_id bigint, vec_id bigint, score bigint"


def str_order(points: np.ndarray, labels: np.ndarray, leaf: int) -> np.ndarray:
    """Sort-tile-recursive order: slabs by label, in them slabs by the widest coordinate, in them rows by the next one."""
    slabs = math.ceil((len(points) / leaf) ** (1 / 3))
    wide = np.argsort(-points.astype(float).var(axis=0), kind="stable")[:2]
    keys = [labels, *(points[:, a] for a in wide)]

    def cut(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        rows = rows[np.argsort(keys[depth][rows], kind="stable")]
        if depth == len(keys) - 1:
            return [rows]
        step = max(leaf, math.ceil(len(rows) / slabs / leaf) * leaf)
        return [x for a in range(0, len(rows), step) for x in cut(rows[a:a + step], depth + 1)]

    return np.concatenate(cut(np.arange(len(points)), 0))


class RTree:
    """Rows in STR order under boxes: leaves of LEAF rows, each node above over FAN neighbours.

    A box is the least and largest value of every coordinate and of the label. For a query it gives an
    interval that holds all inner products with the rows under it.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray):
        self.ids, self.labels, self.points = ids, labels, points
        sides = []
        for x, least in ((points, np.minimum), (points, np.maximum), (labels, np.minimum), (labels, np.maximum)):
            levels = [least.reduceat(x, np.arange(0, len(x), LEAF))]
            while len(levels[-1]) > 1:
                levels.append(least.reduceat(levels[-1], np.arange(0, len(levels[-1]), FAN)))
            sides.append(levels)
        self.start = np.cumsum([0, *map(len, sides[0])])
        self.low, self.high, self.label_low, self.label_high = (np.concatenate(s) for s in sides)

    def intervals(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return intervals(queries, self.low, self.high)

    def children(self, node: int) -> range:
        level = int(np.searchsorted(self.start, node, "right")) - 1
        a = self.start[level - 1] + (node - self.start[level]) * FAN
        return range(int(a), int(min(a + FAN, self.start[level])))

    def search(self, query: np.ndarray, own_id: int, label: int, same: bool, windows: list[tuple[int, int]], k: int,
               lower: np.ndarray, upper: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per window its number and the scores and ids of the ``k`` best rows inside, ties to the smaller id.

        Rows share the label, or do not, and have another id than the query. Nodes are opened by the best score their
        interval leaves within the window; those outside the window, or strictly below the k-th best, are not opened.
        """
        scores: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def leaf(node: int):
            if node not in scores:
                own = slice(node * LEAF, node * LEAF + LEAF)
                fits = ((self.labels[own] == label) == same) & (self.ids[own] != own_id)
                scores[node] = (self.points[own] @ query)[fits].astype(np.int64), self.ids[own][fits]
            return scores[node]

        other = (self.label_low > label) | (self.label_high < label)
        alike = (self.label_low == label) & (self.label_high == label)
        shut = other if same else alike
        for number, (lo, hi) in enumerate(windows):
            best, names = np.zeros(0, np.int64), np.zeros(0, np.int64)
            open_ = ~shut & (lower <= hi) & (upper >= lo)
            bound = np.minimum(upper, hi)
            queue = [(-int(bound[-1]), len(bound) - 1)] if open_[-1] else []
            while queue:
                top, node = heapq.heappop(queue)
                if len(best) == k and -top < best[-1]:
                    break
                if node >= self.start[1]:
                    for c in self.children(node):
                        if open_[c]:
                            heapq.heappush(queue, (-int(bound[c]), c))
                    continue
                s, i = leaf(node)
                inside = (s >= (best[-1] if len(best) == k else lo)) & (s <= hi)
                if inside.any():
                    best, names = np.concatenate([best, s[inside]]), np.concatenate([names, i[inside]])
                    order = np.lexsort((names, -best))[:k]
                    best, names = best[order], names[order]
            if len(best):
                yield number, best, names


def intervals(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of every query with any point of every box, coordinate by coordinate."""
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    return plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T


def _usable(vectors: DataFrame, scale: float) -> DataFrame:
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.size("embedding").alias("width"),
                       F.transform(x, lambda v: F.floor(F.lit(scale) * v).cast("bigint")).alias("point"),
                       F.array_max(F.transform(x, lambda v: F.abs(F.floor(F.lit(scale) * v).cast("double")))).alias("peak"))


def _tiled(points: DataFrame, shards: int) -> DataFrame:
    """Add ``slab`` (by label, then by the coordinate that varies most) and ``shard``: STR over all rows.

    Cut points are approximate quantiles, so a value held by many rows makes a larger tile; such a tile is dealt
    further into shards of about ROWS_PER_SHARD.
    """
    slabs = max(1, round(shards ** (1 / 3)))
    spread = points.select(F.posexplode("point")).groupBy("pos").agg(F.variance("col").alias("v")).orderBy(F.desc_nulls_last("v"), "pos").limit(2)
    axes = [r.pos for r in spread.collect()]
    tiled, by = points.withColumn("t0", F.col("width")), ["t0"]
    for depth, value in enumerate([F.col("label"), *(F.get("point", F.lit(a)) for a in axes)], 1):
        tiled = tiled.withColumn("_v", value.cast("double"))
        cuts = tiled.groupBy(*by).agg(F.percentile_approx("_v", [i / slabs for i in range(1, slabs)]).alias("_cuts")) if slabs > 1 else None
        if cuts is None:
            tiled = tiled.withColumn(f"t{depth}", F.lit(0))
        else:
            below = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c < F.col("_v")))
            tiled = cut_lineage(tiled.join(cuts, by).withColumn(f"t{depth}", below).drop("_cuts"))
        by = [*by, f"t{depth}"]
    sizes = tiled.groupBy(*by).agg(F.ceil(F.count("*") / ROWS_PER_SHARD).alias("_parts"))
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("_parts"))
    return tiled.join(sizes, by).withColumn("shard", F.concat_ws("-", *by, part)).withColumn("slab", F.concat_ws("-", *by[:3])).select("vec_id", "label", "width", "point", "slab", "shard")


def _one(group: pa.Table, column: str):
    return group.column(column)[0].as_py()


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [part.strip().split(" ") for part in schema.split(",")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


class _Search:
    """The steps of a search that need the numbers' type: float64 where all inner products are exact in it, else int64."""

    def __init__(self, kind: str, every: int):
        self.kind, self.every = kind, every

    def matrix(self, raw: bytes, width: int) -> np.ndarray:
        return np.frombuffer(raw, self.kind).reshape(-1, width)

    def trees(self, tiled: DataFrame) -> DataFrame:
        """One row per shard: its rows in STR order and the box of all."""
        schema = "shard string, width int, slab string, ids binary, labels binary, body binary, low binary, high binary, label_low bigint, label_high bigint"

        def build(group: pa.Table) -> pa.Table:
            points = np.array(group.column("point").to_pylist(), np.int64).astype(self.kind)
            ids, labels = (group.column(c).to_numpy() for c in ("vec_id", "label"))
            order = str_order(points, labels, LEAF)
            points, ids, labels = points[order], ids[order], labels[order]
            return _rows([(_one(group, "shard"), _one(group, "width"), _one(group, "slab"), ids.tobytes(), labels.tobytes(), points.tobytes(),
                           points.min(axis=0).tobytes(), points.max(axis=0).tobytes(), int(labels.min()), int(labels.max()))], schema)

        return tiled.groupBy("shard").applyInArrow(build, schema)

    def tree(self, row: dict) -> RTree:
        return RTree(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), self.matrix(row["body"], row["width"]))

    def anchors(self, trees: DataFrame, k: int) -> DataFrame:
        """Every anchor with the k-th score of its label inside its own shard: a floor for the search in all."""
        schema = "slab string, width int, vec_id bigint, label bigint, body binary, floor bigint"

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    tree, out = self.tree(row), []
                    asked = np.flatnonzero(tree.ids % self.every == 0)
                    lower, upper = tree.intervals(tree.points[asked])
                    for q, lo, hi in zip(asked.tolist(), lower, upper):
                        found = list(tree.search(tree.points[q], tree.ids[q], tree.labels[q], True, [(LEAST, MOST)], k, lo, hi))
                        floor = int(found[0][1][-1]) if found and len(found[0][1]) == k else LEAST
                        out.append((row["slab"], row["width"], int(tree.ids[q]), int(tree.labels[q]), tree.points[q].tobytes(), floor))
                    yield _rows(out, schema)

        return arrow_map(trees.select("slab", "width", "ids", "labels", "body"), run, schema)

    def blocks(self, anchors: DataFrame) -> DataFrame:
        """Requests of about ANCHORS_PER_BLOCK anchors of one slab, each with one window from its floor upwards."""
        parts = anchors.groupBy("slab").agg(F.ceil(F.count("*") / ANCHORS_PER_BLOCK).alias("parts"))
        block = F.concat_ws("-", "slab", F.pmod(F.xxhash64("vec_id", "body"), F.col("parts")))

        def gather(group: pa.Table) -> pa.Table:
            n = group.num_rows
            whole = lambda x: np.array(x, np.int64).tobytes()
            return _rows([(_one(group, "block"), _one(group, "width"), whole(group.column("vec_id")), whole(group.column("label")), b"".join(group.column("body").to_pylist()),
                           whole(np.ones(n)), whole(group.column("floor")), whole(np.full(n, MOST)))], REQUEST)

        return anchors.join(parts, "slab").withColumn("block", block).groupBy("block").applyInArrow(gather, REQUEST)

    def pairs(self, requests: DataFrame, pages: DataFrame, page_counts: DataFrame, same: bool, probe: bool) -> DataFrame:
        """(block, shard, need): the shards whose box may hold rows of a window, and a byte per anchor that needs it.

        With ``probe`` each anchor asks one shard of a page only, the one whose box promises the best score.
        """

        def run(batches):
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    queries = self.matrix(row["body"], row["width"])
                    low, high = (self.matrix(row[c], row["width"]) for c in ("lows", "highs"))
                    label = np.frombuffer(row["labels"], np.int64)[:, None]
                    first, last = (np.array(row[c])[None, :] for c in ("label_lows", "label_highs"))
                    fits = (first <= label) & (label <= last) if same else ~((first == label) & (label == last))
                    lower, upper = intervals(queries, low, high)
                    owner = np.repeat(np.arange(len(queries)), np.frombuffer(row["counts"], np.int64))
                    lo, hi = (np.frombuffer(row[c], np.int64)[:, None] for c in ("lo", "hi"))
                    reach = (upper[owner] >= lo) & (lower[owner] <= hi) & fits[owner]
                    need = np.zeros(fits.shape, bool)
                    np.logical_or.at(need, owner, reach)
                    if probe:
                        promise = np.where(need, upper, -np.inf)
                        need &= np.arange(need.shape[1]) == promise.argmax(axis=1)[:, None]
                    for s in np.flatnonzero(need.any(axis=0)).tolist():
                        out.append((row["block"], row["shards"][s], need[:, s].astype(np.uint8).tobytes()))
                yield _rows(out, "block string, shard string, need binary")

        every = F.explode(F.sequence(F.lit(0), F.col("pages") - 1))
        asked = requests.join(page_counts, "width").withColumn("page", every).join(pages, ["width", "page"])
        return arrow_map(asked.select("block", "width", "labels", "body", "counts", "lo", "hi", "shards", "lows", "highs", "label_lows", "label_highs"), run, "block string, shard string, need binary")

    def pages(self, trees: DataFrame, shards: int) -> DataFrame:
        """The boxes of all shards, SHARDS_PER_PAGE to a row."""
        schema = "width int, page int, shards array<string>, lows binary, highs binary, label_lows array<bigint>, label_highs array<bigint>"
        n = max(1, math.ceil(shards / SHARDS_PER_PAGE))

        def gather(group: pa.Table) -> pa.Table:
            return pa.table([group.column("width")[:1].combine_chunks(), group.column("page")[:1].combine_chunks(), pa.array([group.column("shard").to_pylist()], pa.list_(pa.string())),
                             *(pa.array([b"".join(group.column(c).to_pylist())], pa.binary()) for c in ("low", "high")),
                             *(pa.array([group.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("label_low", "label_high"))],
                            names=["width", "page", "shards", "lows", "highs", "label_lows", "label_highs"])

        boxes = trees.select("width", F.pmod(F.xxhash64("shard"), F.lit(n)).cast("int").alias("page"), "shard", "low", "high", "label_low", "label_high")
        return boxes.groupBy("width", "page").applyInArrow(gather, schema)

    def found(self, requests: DataFrame, pairs: DataFrame, trees: DataFrame, same: bool, k: int) -> DataFrame:
        """The ``k`` best rows of every window among the shards of ``pairs``: FOUND with their rank."""

        def run(batches):
            last = tree = None
            for batch in batches:
                for row in batch.to_pylist():
                    if row["shard"] != last:
                        last, tree = row["shard"], self.tree(row)
                    queries = self.matrix(row["query_body"], row["width"])
                    ids, labels = (np.frombuffer(row[c], np.int64) for c in ("query_ids", "query_labels"))
                    lo, hi = (np.frombuffer(row[c], np.int64).tolist() for c in ("lo", "hi"))
                    ends = np.cumsum(np.frombuffer(row["counts"], np.int64)).tolist()
                    lower, upper = tree.intervals(queries)
                    out = []
                    for q in np.flatnonzero(np.frombuffer(row["need"], np.uint8)).tolist():
                        a = ends[q - 1] if q else 0
                        for slot, best, names in tree.search(queries[q], ids[q], labels[q], same, list(zip(lo[a:ends[q]], hi[a:ends[q]])), k, lower[q], upper[q]):
                            out += [(row["block"], q, slot, int(ids[q]), i, s) for i, s in zip(names.tolist(), best.tolist())]
                    yield _rows(out, FOUND)

        asked = requests.withColumnsRenamed({"ids": "query_ids", "labels": "query_labels", "body": "query_body"}).drop("width")
        rows = pairs.join(asked, "block").join(trees.select("shard", "width", "ids", "labels", "body"), "shard")
        every = arrow_map(rows.select("block", "shard", "need", "query_ids", "query_labels", "query_body", "counts", "lo", "hi", "width", "ids", "labels", "body"), run, FOUND)
        rank = F.row_number().over(Window.partitionBy("block", "place", "slot").orderBy(F.desc("score"), "vec_id"))
        return every.withColumn("rank", rank).where(F.col("rank") <= k)


def _windows(requests: DataFrame, positives: DataFrame, low: int, high: int) -> DataFrame:
    """Requests whose anchors have one window per positive: low % to high % of its score."""

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        if not block.num_rows or not found.num_rows:
            return _rows([], REQUEST)
        n = len(block.column("ids")[0].as_py()) // 8
        order = np.lexsort((found.column("rank").to_numpy(), found.column("place").to_numpy()))
        scores = [int(x) for x in found.column("score").to_numpy()[order]]
        counts = np.bincount(found.column("place").to_numpy(), minlength=n).astype(np.int64)
        lo = np.array([-(-low * s // 100) for s in scores], np.int64)
        hi = np.array([high * s // 100 for s in scores], np.int64)
        return _rows([(*(_one(block, c) for c in ("block", "width", "ids", "labels", "body")), counts.tobytes(), lo.tobytes(), hi.tobytes())], REQUEST)

    return requests.groupBy("block").cogroup(positives.select("block", "place", "rank", "score").groupBy("block")).applyInArrow(run, REQUEST)


def _raised(requests: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The requests with each window's lower end at the k-th score found so far: what lies strictly below cannot be among the k best."""

    def run(block: pa.Table, floors: pa.Table) -> pa.Table:
        if not block.num_rows:
            return _rows([], REQUEST)
        counts = np.frombuffer(_one(block, "counts"), np.int64)
        lo = np.frombuffer(_one(block, "lo"), np.int64).copy()
        at = (np.cumsum(counts) - counts)[floors.column("place").to_numpy()] + floors.column("slot").to_numpy()
        np.maximum.at(lo, at, floors.column("score").to_numpy())
        return _rows([(*(_one(block, c) for c in ("block", "width", "ids", "labels", "body", "counts")), lo.tobytes(), _one(block, "hi"))], REQUEST)

    floors = found.where(F.col("rank") == k).select("block", "place", "slot", "score")
    return requests.groupBy("block").cogroup(floors.groupBy("block")).applyInArrow(run, REQUEST)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0) -> DataFrame:
    """Rows of other labels that score a little less than an anchor's positives.

    ``vectors`` holds vec_id, embedding and label; components become floor(scale * x) and a score is the integer inner
    product. Anchors are the rows whose vec_id is divisible by ``every``; an anchor's positives are its ``positives``
    best rows of the same label and another vec_id. For each positive the first ``negatives`` rows of other labels with
    ``low * positive_score <= 100 * score <= high * positive_score`` are returned: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score. Higher scores come first, ties by smaller vec_id; fewer rows are all returned.

    Rows are tiled by label and coordinates (sort-tile-recursive) into shards with one R-tree each. The search for
    positives starts from the k-th score in the anchor's own shard, that for negatives from what one promising shard holds;
    blocks of anchors then meet just the shards whose boxes may reach a window, found from pages of boxes. All is exact.

    Rows with a null vec_id, label or vector, an empty vector, or a null or non-finite component take no part. Rows of
    different lengths never meet. Rows with equal vec_ids stay separate rows; equal results are returned once. A positive with a
    negative score has an empty window. An empty table gives an empty one; extra columns are ignored. Components so large that an
    inner product could pass 2^62 raise an error.
    """
    points = cut_lineage(_usable(vectors, scale))
    n, reach = points.agg(F.count("*"), F.max(F.col("width") * F.col("peak") * F.col("peak"))).first()
    if n and not reach < 2.0 ** 62:
        raise ValueError("components too large: an inner product may pass 2^62")
    shards = max(1, math.ceil(n / ROWS_PER_SHARD))
    steps = _Search("<f8" if not n or reach < 2.0 ** 53 else "<i8", every)
    trees = cut_lineage(steps.trees(cut_lineage(_tiled(points.drop("peak"), shards))))
    pages = cut_lineage(steps.pages(trees, shards))
    page_counts = pages.groupBy("width").agg((F.max("page") + 1).alias("pages"))
    asked = cut_lineage(steps.blocks(steps.anchors(trees, positives)))
    near = cut_lineage(steps.found(asked, steps.pairs(asked, pages, page_counts, True, False), trees, True, positives))
    windows = cut_lineage(_windows(asked, near, low, high))
    probed = steps.found(windows, steps.pairs(windows, pages, page_counts, False, True), trees, False, negatives)
    raised = cut_lineage(_raised(windows, probed, negatives))
    far = steps.found(raised, steps.pairs(raised, pages, page_counts, False, False), trees, False, negatives)
    chosen = near.select("block", "place", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(chosen, ["block", "place", "slot"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).distinct()
