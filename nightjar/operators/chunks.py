"""Positional windows over long subjects, split into chunks with a halo.

A subject's rows are cut by position into chunks; the rows next to a border are copied to the
neighbour as halo. Every chunk is its own window partition, so one very long subject spreads over
many tasks. Positions are contiguous (0, 1, 2, ...) per subject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

CHUNK_EPOCHS = 4096
CHUNK_SECONDS = 36_000


def with_halo(df: DataFrame, pos: str, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Add ``_chunk`` and ``_own``; a halo row is a copy with ``_own`` false."""
    home = F.floor(F.col(pos) / size).cast("bigint")
    offset = F.pmod(F.col(pos), F.lit(size))
    copies = F.array_compact(F.array(
        home,
        F.when(offset >= size - before, home + 1) if before else F.lit(None).cast("bigint"),
        F.when((offset < after) & (home > 0), home - 1) if after else F.lit(None).cast("bigint"),
    ))
    return (
        df.withColumn("_home", home)
        .withColumn("_chunk", F.explode(copies))
        .withColumn("_own", F.col("_chunk") == F.col("_home"))
        .drop("_home")
    )


def chunk_window(by: list[str], pos: str) -> WindowSpec:
    return Window.partitionBy(*by, "_chunk").orderBy(pos)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_chunk", "_own")


def islands(df: DataFrame, by: list[str], pos: str, flag: Column, aggs: dict[str, tuple[str, str]],
            size: int = CHUNK_SECONDS) -> DataFrame:
    """Maximal runs of consecutive flagged positions: ``start``, ``length`` and merged aggregates.

    ``aggs`` maps an output name to (column, kind) with kind ``min``, ``max``, ``sum`` or ``first``.
    Runs are found per chunk; only runs that touch a chunk border are stitched across chunks.
    """
    flagged = df.where(F.coalesce(flag, F.lit(False))).withColumn("_chunk", F.floor(F.col(pos) / size))
    w = Window.partitionBy(*by, "_chunk").orderBy(pos)
    # position minus row number is constant inside a run of consecutive positions
    runs = (
        flagged.withColumn("_run", F.col(pos) - F.row_number().over(w))
        .groupBy(*by, "_chunk", "_run")
        .agg(F.min(pos).alias("start"), F.count("*").alias("length"),
             *[_piece(c, kind, pos).alias(out) for out, (c, kind) in aggs.items()])
        .drop("_run")
    )
    edge = (F.pmod("start", F.lit(size)) == 0) | (F.pmod(F.col("start") + F.col("length"), F.lit(size)) == 0)
    inner = runs.where(~edge).select(*by, "start", "length", *aggs)
    ws = Window.partitionBy(*by).orderBy("start")
    touching = (
        runs.where(edge)
        .withColumn("_new", (F.lag(F.col("start") + F.col("length")).over(ws) == F.col("start")))
        .withColumn("_new", F.when(F.col("_new"), 0).otherwise(1))
        .withColumn("_id", F.sum("_new").over(ws))
        .groupBy(*by, "_id")
        .agg(F.min("start").alias("_start"), F.sum("length").alias("length"),
             *[_piece(out, kind, "start").alias(out) for out, (_, kind) in aggs.items()])
        .select(*by, F.col("_start").alias("start"), "length", *aggs)
    )
    return inner.unionByName(touching)


def _piece(column: str, kind: str, pos: str) -> Column:
    if kind == "first":
        return F.min_by(column, pos)
    return {"min": F.min, "max": F.max, "sum": F.sum}[kind](column)
