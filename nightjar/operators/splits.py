"""Subject-level splits, folds, samples and their guards, drawn from md5 so every engine agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightjar.functions.expressions import hash_draw
from nightjar.operators.running import running_totals
from nightjar.session import cut_lineage


def hash_rank(ids: DataFrame, by: list[str], key: str, *parts: Column | str) -> DataFrame:
    """Add ``_rank`` (0, 1, ...) and ``_size`` per ``by``, in the order of the md5 draw, ids breaking ties."""
    draws = ids.withColumn("_draw", hash_draw(*parts, key))
    # equal draws are numbered inside their own tiny group, whole groups by running totals
    counts = draws.groupBy(*by, "_draw").agg(F.count("*").alias("_n"))
    first = running_totals(counts, by, "_draw", ["_n"]).select(*by, "_draw", "_n_before", "_n_total")
    tie = F.row_number().over(Window.partitionBy(*by, "_draw").orderBy(key)) - 1
    return draws.withColumn("_tie", tie).join(first, [*by, "_draw"]).select(
        *ids.columns, (F.col("_n_before") + F.col("_tie")).alias("_rank"), F.col("_n_total").alias("_size"))


def group_split(ids: DataFrame, test: float = 0.2, val: float = 0.05, seed: int = 42) -> DataFrame:
    """Nested subject holdout: test takes ceil(test * n) of the sorted draws, val ceil(val * rest)."""
    d = hash_rank(ids.select("subject_id").distinct(), [], "subject_id", F.lit(f"outer{seed}"))
    n_test = F.ceil(F.col("_size") * test)
    outer = d.select("subject_id", (F.col("_rank") < n_test).alias("_test"))
    inner = hash_rank(outer.where("NOT _test").select("subject_id"), [], "subject_id", F.lit(f"inner{seed}"))
    parts = inner.select("subject_id", F.when(F.col("_rank") < F.ceil(F.col("_size") * val), "val").otherwise("train").alias("part"))
    return outer.where("_test").select("subject_id", F.lit("test").alias("part")).unionByName(parts)


def _turns(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, list[tuple[int, list[int]]]]]:
    """Per size, largest first: which folds take turns, and from which subject of that size on.

    Subjects of one size, each to the lightest fold, meet the folds in rounds: in round u those whose load is less than u + 1
    sizes above the lightest, in the order of what their load leaves over. So a size has at most k spans of turns.
    """
    loads, out = [0] * k, []
    for size, n in sizes:
        low = min(loads)
        ahead = [divmod(load - low, size) for load in loads]
        starts = sorted({rounds for rounds, _ in ahead})
        spans, first = [], 0
        for u, until in zip(starts, [*starts[1:], None]):
            turn = sorted((i for i in range(k) if ahead[i][0] <= u), key=lambda i: (ahead[i][1], i))
            spans.append((first, turn))
            left = n - first if until is None else min(n - first, (until - u) * len(turn))
            each, extra = divmod(left, len(turn))
            for place, i in enumerate(turn):
                loads[i] += size * (each + (place < extra))
            first += left
            if first == n:
                break
        out.append((size, spans))
    return out


def group_kfold(rows: DataFrame, k: int) -> DataFrame:
    """Subjects to folds balanced on row count: largest first (of equals by id), each to the lightest fold (of equals the first).

    The deal runs over the histogram of sizes, not over subjects: N rows have at most sqrt(2 N) distinct sizes, so it is
    small at any scale, and a subject finds its fold from its place among those of its size.
    """
    n = cut_lineage(rows.groupBy("subject_id").agg(F.count("*").alias("n_rows")))
    sizes = [(r.n_rows, r["count"]) for r in n.groupBy("n_rows").count().orderBy(F.desc("n_rows")).collect()]
    spans = [(size, [{"first": first, "turn": turn} for first, turn in own]) for size, own in _turns(sizes, k)]
    deal = rows.sparkSession.createDataFrame(spans, "n_rows bigint, spans array<struct<first: bigint, turn: array<int>>>")
    ids = running_totals(n.withColumn("_one", F.lit(1).cast("bigint")), ["n_rows"], "subject_id", ["_one"])
    own = F.element_at(F.filter("spans", lambda s: s["first"] <= F.col("_one_before")), -1)
    place = F.pmod(F.col("_one_before") - own["first"], F.size(own["turn"])).cast("int")
    return ids.join(deal, "n_rows").select("subject_id", "n_rows", F.get(own["turn"], place).alias("fold"))


def stratified_kfold(ids: DataFrame, strata: list[str], k: int, repeats: int = 1, seed: int = 42) -> DataFrame:
    """Folds balanced inside each stratum, repeated with fresh draws."""
    reps = ids.withColumn("repeat", F.explode(F.array(*[F.lit(i) for i in range(repeats)])))
    d = hash_rank(reps, [*strata, "repeat"], "subject_id", F.lit(seed), "repeat")
    return d.select("subject_id", *strata, "repeat", F.pmod("_rank", F.lit(k)).cast("int").alias("fold"))


def undersample(rows: DataFrame, label: str, key: list[str], ratio: float, seed: int = 42) -> DataFrame:
    """All positives and the n_pos / ratio negatives with the smallest draws."""
    pos = rows.where(F.col(label) == 1)
    keyed = rows.where(F.col(label) == 0).withColumn("_key", F.concat_ws("-", *key))
    d = hash_rank(keyed, [], "_key", F.lit(seed))
    n_keep = pos.agg(F.floor(F.count("*") / ratio)).scalar()
    return pos.unionByName(d.where(F.col("_rank") < n_keep).select(*rows.columns))


def sample_subjects(ids: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n subjects by smallest draw (TakeOrderedAndProject)."""
    d = ids.select("subject_id").distinct()
    return d.orderBy(hash_draw(F.lit(seed), "subject_id"), "subject_id").limit(n)


def shuffled(ids: DataFrame, seed: int = 42) -> DataFrame:
    """Deterministic permutation: the position of every id."""
    d = hash_rank(ids.select("subject_id").distinct(), [], "subject_id", F.lit(seed))
    return d.select("subject_id", F.col("_rank").alias("position"))


def class_balance(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """Rows, positives and the negative-to-positive ratio per split."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("n_pos"),
        F.try_divide(F.count("*") - F.sum(F.col(label).cast("bigint")), F.sum(F.col(label).cast("bigint"))).alias("scale_pos_weight"))


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """Row weight n / (classes * class count).

    The few class counts come back as one map in a scalar subquery, so the rows are not shuffled on
    their class.
    """
    c = rows.groupBy(label).agg(F.count("*").alias("_n"))
    entries = F.collect_list(F.struct(F.col(label), F.col("_n")))
    table = c.agg(F.struct(F.map_from_entries(entries).alias("n"), (F.sum("_n") / F.count("*")).alias("even")).alias("t")).scalar()
    return rows.withColumn("_t", table).withColumn(
        "weight", F.col("_t.even") / F.element_at(F.col("_t.n"), F.col(label))).drop("_t")


def split_report(rows: DataFrame, split: DataFrame, label: str) -> DataFrame:
    """Epochs, subjects and positive share per part."""
    return rows.join(split, "subject_id").groupBy("part").agg(
        F.count("*").alias("n_epochs"), F.count_distinct("subject_id").alias("n_subjects"), F.avg(F.col(label).cast("double")).alias("positive_share"))


def part_overlaps(split: DataFrame) -> DataFrame:
    """Subjects that sit in more than one part; empty for a valid split."""
    return split.groupBy("subject_id").agg(F.count_distinct("part").alias("n_parts")).where("n_parts > 1")


def split_guard(ids: DataFrame, split: DataFrame, part: str) -> DataFrame:
    """One row: ids outside the split, ids of another part, test ids among them."""
    d = ids.select("subject_id").distinct().join(split, "subject_id", "left")
    return d.agg(F.count("*").alias("n_ids"), F.count_if(F.col("part").isNull()).alias("not_in_split"),
                 F.count_if(F.col("part") != part).alias("other_part"),
                 F.count_if((F.col("part") == "test") & F.lit(part != "test")).alias("test_leak"))


def set_difference(a: DataFrame, b: DataFrame, examples: int = 5) -> DataFrame:
    """Ids only on one side: their count and the first few as examples."""

    def side(x: DataFrame, y: DataFrame, name: str) -> DataFrame:
        only = x.select("subject_id").distinct().join(y.select("subject_id"), "subject_id", "left_anti")
        few = only.orderBy("subject_id").limit(examples).agg(F.array_join(F.sort_array(F.collect_list("subject_id")), ",").alias("e"))
        return only.agg(F.lit(name).alias("side"), F.count("*").alias("n")).withColumn("examples", few.scalar())

    return side(a, b, "only_a").unionByName(side(b, a, "only_b"))


def ids_fingerprint(ids: DataFrame, by: list[str]) -> DataFrame:
    """Order-free fingerprint of an id set: count, xor and sum (of the low 32 bits) of the ids' md5 draws.

    It folds map-side, so the id list is never gathered the way a hash of the joined list would be.
    """
    d = ids.select(*by, "subject_id").distinct().withColumn("_h", hash_draw("subject_id"))
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.bit_xor("_h").alias("xor_hash"), F.sum(F.col("_h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("sum_hash"))


def ids_sha256(ids: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, sha256): a content hash of each part's sorted whole-number ids, by the same rule at any size.

    Ids are hashed in blocks of 2^16 neighbouring numbers, the block hashes in blocks of 2^16 blocks
    and so on up to 64 bits: a tree whose shape depends on the ids alone. No task joins more than 2^16
    ids or hashes, and a part may hold any number of them.
    """
    d = cut_lineage(ids.select(*by, F.col("subject_id").cast("bigint").alias("id")).distinct())
    high = F.shiftright("block", 16).alias("block")
    joined = lambda c: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["text"]), ","), 256).alias("mark")
    marks = d.groupBy(*by, F.shiftright("id", 16).alias("block")).agg(joined(F.struct("id", F.col("id").cast("string").alias("text"))))
    item = F.struct("block", F.concat_ws(":", F.col("block").cast("string"), "mark").alias("text"))
    for _ in range(3):
        marks = marks.groupBy(*by, high).agg(joined(item))
    return d.groupBy(*by).agg(F.count("*").alias("n")).join(marks.groupBy(*by).agg(joined(item)).withColumnRenamed("mark", "sha256"), by)


def split_record(split: DataFrame) -> DataFrame:
    """Counts and content hashes per part: the row set that is frozen and compared."""
    return ids_sha256(split, ["part"]).join(ids_fingerprint(split, ["part"]).drop("n"), "part")


def split_changes(current: DataFrame, frozen: DataFrame) -> DataFrame:
    """Parts whose count or hash differ from the frozen record; empty when the split is unchanged."""
    marks = ["n", "sha256", "xor_hash", "sum_hash"]
    f = frozen.select("part", *[F.col(m).alias(f"frozen_{m}") for m in marks])
    same = F.lit(True)
    for m in marks:
        same = same & F.col(m).eqNullSafe(F.col(f"frozen_{m}"))
    return current.join(f, "part", "full_outer").where(~same)
