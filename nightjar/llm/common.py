"""Small things the operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar.session import cut_lineage

__all__ = ["arrow_map", "cut_lineage", "give_back", "read", "small_batches", "tokenizer_path", "typed"]

Batches = Iterator[pa.RecordBatch]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def typed(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns only, cast: extra columns of the input, whatever their names, go no further."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep the session's Arrow batches to ``rows`` rows at most: a batch of whole texts lies in memory several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and what they keep adds up beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_map(df: DataFrame, fn: Callable[[Batches], Iterator[pa.RecordBatch | pa.Table]], schema: str) -> DataFrame:
    """``mapInArrow`` whose function may yield tables too."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        for out in fn(batches):
            if isinstance(out, pa.Table):
                yield from out.combine_chunks().to_batches()
            else:
                yield out
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)
