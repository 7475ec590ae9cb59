"""DeLong test of two aligned scorers from distinct-score rank tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.functions.expressions import normal_cdf
from nightjar.operators.metrics import score_counts
from nightjar.operators.running import running_totals


def placements(df: DataFrame, by: list[str], label: str, score: str, name: str) -> DataFrame:
    """Per distinct score: share of negatives ranked below (v10, for positives) and of positives (v01)."""
    r = running_totals(score_counts(df, by, label, score), by, score, ["pos", "neg"])
    return r.select(*by, score, ((F.col("neg_before") + F.col("neg") / 2.0) / F.col("neg_total")).alias(f"{name}_v10"),
                    ((F.col("pos_before") + F.col("pos") / 2.0) / F.col("pos_total")).alias(f"{name}_v01"))


def delong(pairs: DataFrame, by: list[str], label: str = "apnoea_label", a: str = "prob_a", b: str = "prob_b") -> DataFrame:
    """AUCs, variance of their difference, z, two-sided p and 95 % interval per ``by``.

    Rows are first folded to (label, score a, score b) counts; placements are looked up per distinct
    score, so the joins carry each score combination once.
    """
    cells = pairs.groupBy(*by, label, a, b).agg(F.count("*").alias("n"))
    d = cells.join(placements(pairs, by, label, a, "a"), [*by, a]).join(placements(pairs, by, label, b, "b"), [*by, b])
    n = F.col("n")
    aggs = []
    for cls, v in ((1, "v10"), (0, "v01")):
        here = F.col(label) == cls
        x, y = F.col(f"a_{v}"), F.col(f"b_{v}")
        aggs += [F.sum(F.when(here, n)).alias(f"n{cls}"),
                 F.sum(F.when(here, n * x)).alias(f"sx{cls}"), F.sum(F.when(here, n * y)).alias(f"sy{cls}"),
                 F.sum(F.when(here, n * x * x)).alias(f"sxx{cls}"), F.sum(F.when(here, n * y * y)).alias(f"syy{cls}"),
                 F.sum(F.when(here, n * x * y)).alias(f"sxy{cls}")]
    g = d.groupBy(*by).agg(*aggs)

    def cov(p: str, q: str, pq: str, cls: int):
        m = F.col(f"n{cls}")
        return (F.col(f"{pq}{cls}") - F.col(f"{p}{cls}") * F.col(f"{q}{cls}") / m) / (m - 1)

    def part(p: str, q: str, pq: str):
        return cov(p, q, pq, 1) / F.col("n1") + cov(p, q, pq, 0) / F.col("n0")

    auc_a, auc_b = F.col("sx1") / F.col("n1"), F.col("sy1") / F.col("n1")
    var = part("sx", "sx", "sxx") + part("sy", "sy", "syy") - 2 * part("sx", "sy", "sxy")
    g = g.select(*by, (F.col("n1") + F.col("n0")).alias("n_pairs"), auc_a.alias("auc_a"), auc_b.alias("auc_b"),
                 (auc_b - auc_a).alias("auc_diff"), var.alias("delong_var"))
    z = F.when(F.col("delong_var") > 0, -F.col("auc_diff") / F.sqrt("delong_var")).otherwise(F.lit(0.0))
    g = g.withColumn("z_score", z)
    p = F.when(F.col("delong_var") > 0, 2 * (1 - normal_cdf(F.abs("z_score")))).otherwise(F.lit(1.0))
    se = F.sqrt(F.greatest(F.lit(0.0), F.col("delong_var")))
    return g.select("*", p.alias("p_value"), (F.col("auc_diff") - 1.96 * se).alias("ci_low"),
                    (F.col("auc_diff") + 1.96 * se).alias("ci_high"))
