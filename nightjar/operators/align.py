"""Aligning prediction runs, attaching metadata, and the contracts that guard those joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.functions.expressions import subject_number

KEY = ["subject_id", "epoch_idx"]

PREDICTION_SCHEMA = T.StructType([
    T.StructField("subject_id", T.IntegerType()),
    T.StructField("epoch_idx", T.IntegerType()),
    T.StructField("apnoea_label", T.ByteType()),
    T.StructField("pred_prob", T.DoubleType()),
    T.StructField("pred_label", T.LongType()),
])


def align_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows both runs score: label of run a, both scores."""
    right = b.select(*KEY, F.col("pred_prob").alias("prob_b"))
    return a.select(*KEY, "apnoea_label", F.col("pred_prob").alias("prob_a")).join(right, KEY)


def alignment_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: shared rows, rows on one side only, labels that disagree."""
    j = a.select(*KEY, F.col("apnoea_label").alias("ya"), F.lit(1).alias("_a")).join(
        b.select(*KEY, F.col("apnoea_label").alias("yb"), F.lit(1).alias("_b")), KEY, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return j.agg(F.count_if(both).alias("n_pairs"), F.count_if(F.col("_b").isNull()).alias("only_a"),
                 F.count_if(F.col("_a").isNull()).alias("only_b"),
                 F.count_if(both & ~F.col("ya").eqNullSafe(F.col("yb"))).alias("label_mismatches"))


def align_strict(a: DataFrame, b: DataFrame) -> DataFrame:
    """Like ``align_runs`` but any one-sided row or label difference fails the job when it is met."""
    j = a.select(*KEY, "apnoea_label", F.col("pred_prob").alias("prob_a")).join(
        b.select(*KEY, F.col("apnoea_label").alias("_yb"), F.col("pred_prob").alias("prob_b")), KEY, "full_outer")
    ok = F.col("apnoea_label").isNotNull() & F.col("apnoea_label").eqNullSafe(F.col("_yb"))
    return j.select(*KEY, _require(ok, F.col("apnoea_label"), "runs do not share rows and labels").alias("apnoea_label"),
                    "prob_a", "prob_b")


def _require(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def assembly_report(scores: DataFrame, key: DataFrame, prob: str = "pred_prob") -> DataFrame:
    """One row of violation counts: duplicates, key rows without score, extra scores, label differences."""
    s = scores.groupBy(*KEY).agg(F.count("*").alias("_n"), F.max(prob).alias("_p"), F.max("apnoea_label").alias("_y"))
    j = key.select(*KEY, F.col("apnoea_label").alias("_yk"), F.lit(1).alias("_k")).join(s, KEY, "full_outer")
    known = F.col("_k").isNotNull()
    finite = F.col("_p").isNotNull() & ~F.isnan("_p")
    return j.agg(F.count_if(F.col("_n") > 1).alias("duplicates"), F.count_if(known & ~finite).alias("missing"),
                 F.count_if(~known).alias("extra"),
                 F.count_if(known & finite & (F.col("_y") != F.col("_yk"))).alias("label_mismatches"))


def assemble_predictions(scores: DataFrame, key: DataFrame, threshold: float, prob: str = "pred_prob") -> DataFrame:
    """Scores joined one to one onto the key in the fixed schema; pred_label = score > threshold.

    A duplicate, missing or extra score or a differing label fails the job.
    """
    s = scores.groupBy(*KEY).agg(F.count("*").alias("_n"), F.max(prob).alias("_p"), F.max("apnoea_label").alias("_y"))
    j = key.select(*KEY, F.col("apnoea_label").alias("_yk")).join(s, KEY, "full_outer")
    ok = F.col("_yk").isNotNull() & (F.col("_n") == 1) & F.col("_p").isNotNull() & ~F.isnan("_p") & (F.col("_y") == F.col("_yk"))
    p = _require(F.coalesce(ok, F.lit(False)), F.col("_p"), "scores and key do not match one to one")
    return j.select(F.col("subject_id").cast("int").alias("subject_id"), F.col("epoch_idx").cast("int").alias("epoch_idx"),
                    F.col("_yk").cast("tinyint").alias("apnoea_label"), p.alias("pred_prob"),
                    (p > threshold).cast("bigint").alias("pred_label"))


def check_predictions(df: DataFrame, key: DataFrame | None = None) -> DataFrame:
    """One row of violations of the prediction contract; the schema itself is compared at plan time."""
    want = [(f.name, f.dataType) for f in PREDICTION_SCHEMA]
    if [(f.name, f.dataType) for f in df.schema] != want:
        raise ValueError(f"prediction columns {df.dtypes} differ from {PREDICTION_SCHEMA.simpleString()}")
    null = F.lit(False)
    for c in df.columns:
        null = null | F.col(c).isNull()
    null = null | F.isnan("pred_prob")
    base = df.agg(F.count("*").alias("n_rows"), F.count_if(null).alias("n_null"))
    dup = df.groupBy(*KEY).count().where("count > 1").agg(F.count("*").alias("n_duplicate_keys"))
    out = base.withColumn("n_duplicate_keys", dup.scalar())
    if key is not None:
        rep = alignment_report(df, key)
        out = out.withColumn("n_key_violations", rep.select(F.col("only_a") + F.col("only_b") + F.col("label_mismatches")).scalar())
    return out


def canonical_order(df: DataFrame) -> DataFrame:
    """Globally sorted by (subject, epoch): a range shuffle, one sorted run per task."""
    return df.orderBy(*KEY)


def attach_metadata(pred: DataFrame, meta: DataFrame, columns: list[str]) -> DataFrame:
    """Left join of per-subject columns; the metadata id may be a number or text ending in digits."""
    m = meta.select(subject_number("subject_id").alias("_sid"), *columns).where("_sid IS NOT NULL")
    return pred.join(m, pred.subject_id == F.col("_sid"), "left").drop("_sid")


def reindex(ids: DataFrame, table: DataFrame, on: str = "subject_id") -> DataFrame:
    """Every id once, with the table's columns or NULL."""
    return ids.select(on).distinct().join(table, on, "left")


def short_event_endpoint(pred: DataFrame, context: DataFrame, max_seconds: float = 20.0) -> DataFrame:
    """Positives whose longest labelling event is a short hypopnoea, and all negatives."""
    c = context.select(*KEY, "event_kind", "event_duration_s")
    d = pred.join(c, KEY)
    pos = (F.col("apnoea_label") == 1) & (F.col("event_kind") == "hypopnoea") & (F.col("event_duration_s") < max_seconds)
    return d.where((F.col("apnoea_label") == 0) | F.coalesce(pos, F.lit(False)))


def frame_diff(a: DataFrame, b: DataFrame, on: list[str], columns: list[str], digits: int = 8) -> DataFrame:
    """Rows on one side only and, per shared column, how many values differ after rounding."""
    j = a.select(*on, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(1).alias("_a")).join(
        b.select(*on, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(1).alias("_b")), on, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    numeric = {f.name for f in a.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}

    def same(c: str) -> Column:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        return F.round(x, digits).eqNullSafe(F.round(y, digits)) if c in numeric else x.eqNullSafe(y)

    return j.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"),
                 *[F.count_if(both & ~same(c)).alias(f"diff_{c}") for c in columns])


def reproduction_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """AUC difference, largest score difference and label differences of two aligned prediction sets."""
    from nightjar.operators.metrics import discrimination

    j = a.select(*KEY, "apnoea_label", "pred_prob", "pred_label").join(
        b.select(*KEY, F.col("apnoea_label").alias("_y"), F.col("pred_prob").alias("_p"), F.col("pred_label").alias("_h")), KEY)
    base = j.agg(F.count("*").alias("n"), F.max(F.abs(F.col("pred_prob") - F.col("_p"))).alias("max_abs_prob_diff"),
                 F.count_if(F.col("apnoea_label") != F.col("_y")).alias("label_mismatches"),
                 F.count_if(F.col("pred_label") != F.col("_h")).alias("pred_label_mismatches"))
    auc = lambda d: discrimination(d, []).select("auc").scalar()
    return base.withColumn("auc_diff", auc(a) - auc(b))
