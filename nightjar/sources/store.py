"""Parquet, JSON and CSV sinks and their readers: epochs, predictions, metrics, replicate tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.session import cut_lineage

SUBJECT_FILES = "shhs1-*.parquet"



def write_epochs(df: DataFrame, path: str) -> None:
    """Epoch table partitioned by version; re-running a version replaces only that partition.

    Rows are clustered by subject, so a subject's epochs sit in one file and later per-subject
    work reads them together.
    """
    (
        df.repartition("features_version", "subject_id").sortWithinPartitions("subject_id", "epoch_idx")
        .write.partitionBy("features_version").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    )


def read_epochs(spark: SparkSession, path: str, version: str | None = None, columns: list[str] | None = None,
                glob: str | None = None) -> DataFrame:
    """The cohort's epochs: version filter (partition pruning), column pruning, narrow types.

    ``glob`` reads a folder of per-subject files (``SUBJECT_FILES``) and leaves side files out.
    """
    reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
    d = reader.parquet(path)
    if version is not None:
        d = d.where(F.col("features_version") == version)
    keep = columns or [c for c in d.columns if c not in ("cohort", "epoch_start_sec")]
    narrow = {"subject_id": "int", "epoch_idx": "int", "apnoea_label": "tinyint"}
    types = dict(d.dtypes)
    return d.select(*[
        F.col(c).cast(narrow.get(c, "float" if types[c] == "double" else types[c])).alias(c) for c in keep])


def load_rows(spark: SparkSession, path: str, version: str, columns: list[str], subjects: DataFrame | None = None,
              margin: int | None = 60) -> DataFrame:
    """Chosen rows and columns in one plan: version and columns are pruned in the scan, the in-bed
    window (``margin`` epochs around sleep, None for all) and the subject list filter the rows."""
    from nightjar.operators.epochs import trim_window

    keep = list(dict.fromkeys(["subject_id", "epoch_idx", "sleep_stage", *columns]))
    d = read_epochs(spark, path, version, keep)
    if subjects is not None:
        d = d.join(subjects.select("subject_id").distinct(), "subject_id", "left_semi")
    return d if margin is None else trim_window(d, margin)


def write_predictions(df: DataFrame, path: str, run_id: str) -> None:
    """One run's predictions in the fixed schema under its run partition."""
    from nightjar.operators.align import PREDICTION_SCHEMA

    df.select(*[F.col(f.name).cast(f.dataType) for f in PREDICTION_SCHEMA], F.lit(run_id).alias("run_id")).write.partitionBy(
        "run_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_predictions(spark: SparkSession, path: str, run_id: str | None = None, columns: list[str] | None = None) -> DataFrame:
    d = spark.read.parquet(path)
    d = d if run_id is None else d.where(F.col("run_id") == run_id)
    return d if columns is None else d.select(*columns)


def write_replicates(df: DataFrame, path: str, run_id: str, metric: str, value: str) -> None:
    """Replicate values as a (run, metric, replicate, value) table."""
    df.select("replicate", F.col(value).alias("value"), F.lit(run_id).alias("run_id"), F.lit(metric).alias("metric")).write.partitionBy(
        "run_id", "metric").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """Metric records as JSON lines; NULL metrics are kept as explicit nulls."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_table_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_cohort_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """A cohort CSV with lower-cased column names; unparsable numbers become NULL."""
    raw = spark.read.option("header", "true").csv(path)
    raw = raw.toDF(*[c.lower() for c in raw.columns])
    types = types or {}
    return raw.select(*[F.expr(f"try_cast(`{c}` as {types[c]})").alias(c) if c in types else F.col(c)
                        for c in (columns or raw.columns)])


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested structs to dotted columns, resolved from the schema at plan time."""
    def walk(schema: T.StructType, prefix: tuple[str, ...]):
        for f in schema:
            path = (*prefix, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, path)
            else:
                yield path

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in walk(df.schema, ())])


def flatten_json(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys..., key, value) rows: every numeric leaf of a JSON text column under its dotted path, at any depth.

    A pass opens the objects that the one before found, until it finds none; each level is written once.
    """
    level = df.select(*keys, F.lit("").alias("key"), F.col(column).alias("_v"))
    leaves = []
    while True:
        opened = cut_lineage(level.select(*keys, F.col("key").alias("_p"), F.explode(F.from_json("_v", "map<string,string>")).alias("_k", "_v")).select(
            *keys, F.when(F.col("_p") == "", F.col("_k")).otherwise(F.concat("_p", F.lit("."), "_k")).alias("key"), "_v"))
        leaves.append(opened.select(*keys, "key", F.expr("try_cast(_v as double)").alias("value")).where("value IS NOT NULL AND NOT isnan(value)"))
        level = opened.where(F.col("_v").startswith("{"))
        if not level.take(1):
            return reduce(DataFrame.unionByName, leaves)


def find_key(df: DataFrame, column: str, keys: list[str], names: Sequence[str]) -> DataFrame:
    """(keys..., key, value): the numeric leaf of a JSON text column whose last name is the first of ``names`` that occurs.

    Names are tried in order; among leaves of one name the least deep wins, then the first path.
    """
    order = F.array_position(F.lit(list(names)), F.element_at(F.split("key", "[.]"), -1))
    ranked = flatten_json(df, column, keys).withColumn("_o", order).where("_o > 0")
    best = F.min_by(F.struct("key", "value"), F.struct("_o", F.size(F.split("key", "[.]")), "key"))
    return ranked.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.key", "_b.value")
