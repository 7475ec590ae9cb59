"""Ordered running totals that never put a whole group into one task.

A plain ``sum(...) over (partition by g order by x)`` sends all of ``g`` to one task. Here the
order axis is cut at approximate quantiles, each (group, bucket) is summed on its own and the
bucket totals, at most groups x buckets rows, give the offsets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nightjar.session import cut_lineage

HOT_KEYS = 1000  # a key with more than this part of all rows is joined on its own


def bucket_count(df: DataFrame) -> int:
    return max(8, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to a fixed number of tasks by ``keys``, where a key costs more than its bytes, say a file of its own.

    A shuffle without a number is merged again to tasks of enough bytes, so that a few tasks would open all the files; so is one
    by the very keys of the shuffle before it, hence the hash.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, bucket_count(df) // 2), F.xxhash64(*keys))


def quantile_bucket(df: DataFrame, value: str, name: str, buckets: int | None = None) -> DataFrame:
    """Add ``name``: how many approximate quantiles of ``value`` lie strictly below it.

    The cut points are one row of ``buckets - 1`` doubles, read as a scalar subquery. They are
    searched in two steps of about sqrt(buckets) comparisons. ``df`` is read twice, so pass a table
    that is already written or cheap to recompute.
    """
    n = buckets or bucket_count(df)
    step = max(2, int(n ** 0.5))
    cuts = (
        df.agg(F.percentile_approx(F.col(value).cast("double"), [i / n for i in range(1, n)]).alias("c"))
        .select(F.struct(
            F.col("c").alias("fine"),
            F.filter("c", lambda _, i: i % step == step - 1).alias("coarse"),
        ).alias("cuts"))
        .scalar()
    )
    x = F.col(value).cast("double")
    block = F.size(F.filter("_cuts.coarse", lambda c: c < x)) * step
    inside = F.size(F.filter(F.slice("_cuts.fine", block + 1, step), lambda c: c < x))
    return df.withColumn("_cuts", cuts).withColumn(name, F.coalesce(block + inside, F.lit(0))).drop("_cuts")


def running_totals(df: DataFrame, by: list[str], order: str, values: list[str],
                   buckets: int | None = None, bucket: str | None = None) -> DataFrame:
    """Add ``<v>_before`` (sum over strictly smaller ``order``) and ``<v>_total`` per group.

    ``df`` holds one row per (``by``, ``order``), so pre-aggregate first: that also folds any hot
    value into a single row. The aggregate is written once and read for the cut points, the offsets
    and the windows, so the input is scanned a single time. An iterative caller that keeps the same
    order passes ``bucket``, a column numbered by ``quantile_bucket`` beforehand; nothing is written then.
    """
    if bucket:
        d = df.withColumnRenamed(bucket, "_bucket")
    else:
        d = quantile_bucket(cut_lineage(df), order, "_bucket", buckets)
    across = Window.partitionBy(*(by or [F.lit(0)]))
    earlier = across.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        d.groupBy(*by, "_bucket")
        .agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
        .select(*by, "_bucket",
                *[F.coalesce(F.sum(f"_s_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}") for v in values],
                *[F.sum(f"_s_{v}").over(across).alias(f"{v}_total") for v in values])
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        d.join(offsets, [*by, "_bucket"])
        .withColumns({f"{v}_before": F.col(f"_o_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))
                      for v in values})
        .drop("_bucket", *[f"_o_{v}" for v in values])
    )


def row_positions(df: DataFrame, by: list[str], block: Column, order: list[str], name: str) -> DataFrame:
    """Zero-based row number per ``by``; ``block`` is a coarse, order-preserving slice of ``order``.

    Rows are numbered inside (group, block); the counts of earlier blocks come from an aggregate.
    """
    d = df.withColumn("_block", block)
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = d.groupBy(*by, "_block").agg(F.count("*").alias("_n")).select(
        *by, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_block").orderBy(*order)
    return (
        d.join(offsets, [*by, "_block"])
        .withColumn(name, (F.col("_offset") + F.row_number().over(inside) - 1).cast("int"))
        .drop("_block", "_offset")
    )


def dense_index(df: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct ``key`` values numbered 0, 1, 2, ... in ascending order."""
    ids = df.select(key).distinct().withColumn("_one", F.lit(1).cast("bigint"))
    return running_totals(ids, [], key, ["_one"]).select(
        key, F.col("_one_before").alias(name), F.col("_one_total").alias("n_ids"))


def midranks(df: DataFrame, by: list[str], value: str, name: str = "midrank") -> DataFrame:
    """One row per (``by``, value): count ``n``, group size ``n_total`` and 1-based average rank."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return running_totals(counts, by, value, ["n"]).withColumn(
        name, F.col("n_before") + (F.col("n") + 1) / F.lit(2.0))


def join_by_value(rows: DataFrame, facts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Inner join of rows to ``facts``, one row per ``keys`` of which ``n`` rows hold the same, without a hot key in one task.

    Keys with more than a thousandth of all rows, so fewer than a thousand keys, are broadcast; the other rows meet their
    facts in a shuffle. ``n`` is dropped. ``facts`` is written once.
    """
    facts = cut_lineage(facts)
    share = F.col(n) * HOT_KEYS > facts.agg(F.sum(n)).scalar()
    hot = F.broadcast(facts.where(share).drop(n).withColumn("_hot", F.lit(True)))
    marked = rows.join(hot, keys, "left")
    rest = marked.where("_hot IS NULL").select(*rows.columns).join(facts.where(~share).drop(n), keys)
    return marked.where("_hot").drop("_hot").unionByName(rest)


def grouped_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group, for groups of any size."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    ranked = running_totals(counts, by, value, ["n"])

    def at(k: Column) -> Column:
        hit = (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
        return F.max(F.when(hit, F.col(value)))

    aggs, outs = [F.max("n_total").alias("n_values")], []
    for out, p in probs.items():
        h = F.lit(float(p)) * (F.col("n_total") - 1)
        lo = F.floor(h)
        aggs += [at(lo).alias(f"_lo_{out}"), at(F.least(lo + 1, F.col("n_total") - 1)).alias(f"_hi_{out}"),
                 F.max(h - lo).alias(f"_f_{out}")]
        outs.append((F.col(f"_lo_{out}") + F.col(f"_f_{out}") * (F.col(f"_hi_{out}") - F.col(f"_lo_{out}"))).alias(out))
    return ranked.groupBy(*by).agg(*aggs).select(*by, "n_values", *outs)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Row concat of frames whose columns may differ; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
