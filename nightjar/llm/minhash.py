"""SuperMinHash signatures, band buckets, exact verification and union-find groups of near copies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.llm.common import arrow_map, cut_lineage, give_back, typed
from nightjar.llm.components import connected_components
from nightjar.llm.text import LOWER, WHITE, blocks, mix, shingle_hashes, word_hashes

UNIT = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def document_shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For every text of a block its distinct k-word shingles as sorted hashes.

    Words are runs of bytes other than white space, A-Z lower-cased. A text of fewer than ``k`` words
    has the whole sequence as its one shingle; one without words has none.
    """
    _, _, text, words = word_hashes(LOWER[data], offsets, ~WHITE)
    bounds = np.searchsorted(text, np.arange(len(offsets)))
    runs = shingle_hashes(words, k)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            own = np.sort(runs[a:b - k + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            out.append(shingle_hashes(words[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def superminhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash of every set, all sets level by level: (set, slot) -> level and 24 random bits.

    Each element walks the slots in a random order of its own (a Fisher-Yates shuffle by its hash); at
    level j it offers j + r to the j-th slot of that order and a slot keeps the least offer. A set stops
    at the first level below which all its slots lie, since later offers are larger: the early stop.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    signature = np.full((len(sets), slots), 0xFFFFFFFF, np.uint32)
    flat = signature.reshape(-1)
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    swaps: list[np.ndarray] = []
    for level in range(slots):
        if not len(element):
            break
        draw = mix(element + np.uint64(int(GOLDEN) * (level + 1) % (1 << 64)))
        swap = level + ((draw >> np.uint64(32)) * np.uint64(slots - level) >> np.uint64(32)).astype(np.int32)
        slot = swap.copy()
        for earlier in range(level - 1, -1, -1):
            slot[slot == swaps[earlier]] = earlier
        np.minimum.at(flat, owner * slots + slot, (draw & np.uint64(0xFFFFFF)).astype(np.uint32) | np.uint32(level << 24))
        going = signature.max(axis=1) >= np.uint32((level + 1) << 24)
        keep = going[owner]
        swaps.append(swap)
        element, owner, swaps = element[keep], owner[keep], [s[keep] for s in swaps]
    return signature


def band_hashes(signature: np.ndarray, rows: int) -> np.ndarray:
    """One hash per band of ``rows`` slots."""
    n, slots = signature.shape
    part = signature[:, :slots // rows * rows].reshape(n, -1, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, part.shape[1] + 1, dtype=np.uint64) * GOLDEN, part.shape[:2])
    for i in range(rows):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + part[:, :, i])
    return h


def signatures(docs: DataFrame, k: int, rows: int, bands: int) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): set size, 64-bit hash of the set, band hashes and one byte per slot."""

    def run(batches):
        import xxhash

        for part, data, offsets in blocks(batches, "text", UNIT):
            sets = document_shingles(data, offsets, k)
            signature = superminhash(sets, rows * bands)
            keys = band_hashes(signature, rows).astype("<u8").view(np.int64)
            sketch = (mix(signature.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
            yield pa.table([
                part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array([xxhash.xxh3_64_intdigest(s.astype("<u8").tobytes()) for s in sets], np.uint64).view(np.int64)),
                pa.array([x if len(s) else [] for x, s in zip(keys, sets)], pa.list_(pa.int64())), pa.array([x.tobytes() for x in sketch], pa.binary()),
            ], names=["doc_id", "n_shingles", "node", "bands", "sketch"])

    return arrow_map(typed(docs, doc_id="bigint", text="string"), run, "doc_id bigint, n_shingles bigint, node bigint, bands array<bigint>, sketch binary")


def shingle_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the wanted (node, doc_id), one row per node, computed anew from the whole texts."""

    def run(batches):
        import xxhash

        for part, data, offsets in blocks(batches, "text", UNIT):
            raw = [s.astype("<u8").tobytes() for s in document_shingles(data, offsets, k)]
            node = np.array([xxhash.xxh3_64_intdigest(r) for r in raw], np.uint64).view(np.int64)
            own = np.flatnonzero(node == part.column("node").to_numpy())
            yield pa.table([pa.array(node[own]), pa.array([raw[i] for i in own], pa.binary())], names=["node", "shingles"])

    rows = typed(docs, doc_id="bigint", text="string").join(wanted.select("node", "doc_id"), "doc_id")
    return arrow_map(rows, run, "node bigint, shingles binary")


def similar_enough(inter, size_a, size_b, percent: int):
    """100 * intersection >= percent * union."""
    return 100 * inter >= percent * (size_a + size_b - inter)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                keep.append(bool(similar_enough(np.intersect1d(x, y, assume_unique=True).size, x.size, y.size, percent)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return arrow_map(pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "sa", "sb"), run, "a bigint, b bigint")


def _alike(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of sketch bytes of ``b`` agree with ``a`` in enough slots."""
    return (a == b).mean(axis=-1) >= least


def _sketch_filter(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("ka", "kb"))
            yield batch.select(["a", "b"]).filter(pa.array(_alike(x, y, least)))

    one = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("ka"))
    two = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("kb"))
    return arrow_map(pairs.join(one, "a").join(two, "b").select("a", "b", "ka", "kb"), run, "a bigint, b bigint")


def _settle(own: dict, rows: np.ndarray, percent: int, least: float) -> list[tuple]:
    """Links across components within one family: every left row against the rows it has not met, on full sets.

    Links that join nothing new are left out, so what comes out is a forest.
    """
    node, size, comp, left, sketch = (own[c] for c in ("node", "n_shingles", "comp", "left", "sketch"))
    others = rows[~left[rows]]
    tokens = [np.frombuffer(own["shingles"][j], "<u8") for j in others]
    vocabulary, flat = np.unique(np.concatenate(tokens), return_inverse=True)
    ends = np.cumsum([len(t) for t in tokens])
    starts = ends - size[others]
    mark = np.zeros(len(vocabulary), np.int32)
    root = {c: c for c in comp[rows].tolist()}

    def find(c):
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    main, out = own["main"], []
    for i in rows[left[rows]]:
        fits = (comp[others] != comp[i]) & (100 * np.minimum(size[i], size[others]) >= percent * np.maximum(size[i], size[others]))
        fits &= (comp[others] == main[others]) | (node[others] > node[i])  # two left rows meet once
        js = np.flatnonzero(fits)
        js = js[_alike(sketch[i], sketch[others[js]], least)]
        js = js[[find(comp[others[j]]) != find(comp[i]) for j in js]] if len(js) else js
        if not len(js):
            continue
        held = np.searchsorted(vocabulary, mine := np.frombuffer(own["shingles"][i], "<u8"))
        held = held[(held < len(vocabulary))]
        held = held[np.isin(vocabulary[held], mine)]
        mark[held] = 1
        lengths = size[others[js]]
        at = np.repeat(starts[js] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        inter = np.add.reduceat(mark[flat[at]], np.cumsum(lengths) - lengths)
        mark[held] = 0
        for j in js[similar_enough(inter, size[i], lengths, percent)]:
            x, y = find(comp[i]), find(comp[others[j]])
            if x != y:
                root[x] = y
                out.append((node[i], node[others[j]]))
    return out


def _left_over_links(members: DataFrame, sets: DataFrame, percent: int, least: float, block: int = 16 << 20) -> DataFrame:
    """Links across components inside the families (family, node, n_shingles, comp, sketch) that the pivots left unsettled.

    In each family the members outside its largest component meet all members. Both sides are dealt into
    blocks of about ``block`` bytes of sets, so a family of any size is compared block by block in many
    tasks; pairs are made, looked at and dropped inside a task, and only a forest of links comes out.
    """
    bytes_ = F.sum(8 * F.col("n_shingles"))
    sizes = cut_lineage(members.groupBy("family", "comp").agg(bytes_.alias("b")).groupBy("family").agg(
        F.sum("b").alias("b"), F.max(F.struct("b", "comp")).alias("top"), F.count("*").alias("k")).where("k > 1").select(
        "family", "b", F.ceil(F.col("b") / block).cast("int").alias("mb"), F.ceil((F.col("b") - F.col("top.b")) / block).cast("int").alias("rb"), F.col("top.comp").alias("main")))
    small = max(64, int(2 * (sizes.where("mb = 1").agg(F.sum("b")).first()[0] or 0) // block))
    unit = F.when(F.col("mb") == 1, F.pmod(F.xxhash64("family"), F.lit(small))).otherwise(F.col("family"))
    rows = members.join(sizes, "family").withColumn("unit", unit).join(sets, "node")
    spot = lambda n: F.pmod(F.xxhash64("node", "family"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = ["unit", "family", "node", "n_shingles", "comp", "main", "sketch", "shingles"]
    left = rows.where("comp <> main").select(*own, spot("rb").alias("r"), F.lit(True).alias("left"), every("mb").alias("m"))
    full = rows.select(*own, spot("mb").alias("m"), F.lit(False).alias("left"), every("rb").alias("r"))

    def compare(group: pa.Table) -> pa.Table:
        own = {c: group.column(c).to_numpy() for c in ("family", "node", "n_shingles", "comp", "main")}
        own["left"] = group.column("left").to_numpy(zero_copy_only=False)
        own["shingles"] = group.column("shingles").to_pylist()
        own["sketch"] = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(group.num_rows, -1)
        order = np.argsort(own["family"], kind="stable")
        links: list[tuple] = []
        for rows in np.split(order, np.flatnonzero(np.diff(own["family"][order])) + 1):
            if own["left"][rows].any() and not own["left"][rows].all():
                links += _settle(own, rows, percent, least)
        a, b = zip(*links) if links else ((), ())
        give_back()
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return left.unionByName(full).groupBy("unit", "r", "m").applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, rows: int = 5, bands: int = 25) -> DataFrame:
    """Groups of near copies in ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, one row per input row.

    Documents are linked if ``100 * intersection >= percent * union`` of their full ``k``-word shingle
    sets; groups are the connected components and ``component_id`` the smallest doc_id in one. Rows with
    equal sets are one node, so copies are never compared. Nodes that share a band bucket are candidates:
    all of a bucket against its pivot first; then, in each family of nodes that buckets hold together,
    whatever lies in different components so far. Sketches (one byte a slot) throw out pairs over four standard errors below the limit, the rest is
    decided on full sets. A pair just at the limit of 0.85 shares none of 25 bands of 5 rows with
    probability 4e-7. Rows without words (null, empty, white space) have size 0, are linked with nothing
    and form a component of their own; equal doc_ids with different texts are separate nodes; a null
    doc_id is never the smallest. An empty table gives an empty one; extra columns are ignored.
    """
    limit = percent / 100
    least = limit - 4.5 * (limit * (1 - limit) / (rows * bands)) ** 0.5
    signed = cut_lineage(signatures(docs, k, rows, bands))
    nodes = cut_lineage(signed.where("n_shingles > 0").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles"), F.max(F.struct("bands", "sketch")).alias("s"))
        .select("node", "doc_id", "n_shingles", "s.bands", "s.sketch"))
    buckets = nodes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    pivots = buckets.groupBy("bucket").agg(F.min(F.struct("node", "n_shingles")).alias("p"), F.count("*").alias("size")).where("size > 1").select(
        "bucket", F.col("p.node").alias("pivot"), F.col("p.n_shingles").alias("pivot_n"))
    shared = cut_lineage(buckets.join(pivots, "bucket"))
    fits = 100 * F.least("n_shingles", "pivot_n") >= percent * F.greatest("n_shingles", "pivot_n")
    stars = shared.where((F.col("node") != F.col("pivot")) & fits).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    sketches = nodes.select("node", "sketch")
    likely = cut_lineage(_sketch_filter(stars, sketches, least))
    sets = cut_lineage(shingle_sets(docs, nodes.select("node", "doc_id").join(shared.select("node").distinct(), "node"), k).dropDuplicates(["node"]))
    groups = connected_components(verified(likely, sets, percent))
    members = shared.join(groups, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    mixed = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    unsettled = cut_lineage(members.join(mixed, "bucket").select("node", "pivot", "n_shingles", "comp"))
    families = connected_components(unsettled.select(F.col("pivot").alias("a"), F.col("node").alias("b"))).withColumnRenamed("root", "family")
    left_over = cut_lineage(unsettled.select("node", "n_shingles", "comp").distinct().join(families, "node").join(sketches, "node"))
    second = _left_over_links(left_over, sets, percent, least)
    roots = connected_components(groups.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(second))
    rooted = signed.join(roots, "node", "left").withColumn("root", F.when(F.col("n_shingles") > 0, F.coalesce("root", "node")))
    rooted = rooted.select("doc_id", "n_shingles", "root")
    named = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = rooted.where("root is not null").join(named, "root").select("doc_id", "n_shingles", "component_id")
    alone = rooted.where("root is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
