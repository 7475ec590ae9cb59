"""The given tables seen as epochs, signals, events, predictions and cohorts.

Each view has a DataFrame form and the same definition as SQL text for the cross-check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar.operators.running import row_positions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (user, n-th event): a contiguous epoch grid. Rows are numbered day by day."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject_id"), "ts", "event_id", "event_type", "value")
    e = row_positions(e, ["subject_id"], F.to_date("ts"), ["ts", "event_id"], "epoch_idx")
    t = F.col("event_type")
    stage = F.when(t == "signup", "W").when(t == "view", "N1").when(t == "click", "N2").when(t == "purchase", "N3").otherwise("?")
    return e.select("subject_id", "epoch_idx", stage.alias("sleep_stage"), (F.col("value") > 60).cast("int").alias("apnoea_label"),
                    F.col("value").alias("x"), "event_id")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-second trace: second = position, values above 150 are missing samples."""
    return epochs(spark, sf_dir).select("subject_id", F.col("epoch_idx").alias("sec"),
                                        F.when(F.col("x") <= 150, 100 - F.col("x") / 10).alias("value"))


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval events at the unscored epochs, with all four kinds and a scoring order."""
    e = epochs(spark, sf_dir).where("sleep_stage = '?'")
    k = F.pmod("event_id", F.lit(4))
    kind = F.when(k == 0, "Obstructive apnea").when(k == 1, "Central apnea").when(k == 2, "Mixed apnea").otherwise("Hypopnea")
    return e.select("subject_id", (F.col("epoch_idx") * 30 + F.col("x") / 10).alias("start_sec"),
                    (5 + F.col("x") / 2).alias("duration_sec"), kind.alias("kind"), F.col("event_id").alias("event_seq"))


def nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("subject_id")).agg(
        F.count("*").cast("int").alias("n_epochs"))


def predictions(spark: SparkSession, sf_dir: str, run: str = "a") -> DataFrame:
    """Epoch predictions of run a or b in the fixed prediction schema, plus the stage for cuts."""
    mult = {"a": 37, "b": 91}[run]
    prob = F.pmod(F.col("event_id") * mult, F.lit(1000)) / 2000.0 + F.least("x", F.lit(200.0)) / 400.0
    return epochs(spark, sf_dir).withColumn("pred_prob", prob).select(
        F.col("subject_id").cast("int").alias("subject_id"), "epoch_idx", "apnoea_label", "pred_prob",
        (F.col("pred_prob") > 0.5).cast("bigint").alias("pred_label"))


def score_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heavily tied scores: 50 distinct quantities."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("apnoea_label"),
                                                   (F.col("l_quantity") / 50).alias("pred_prob"))


def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follow-up days, event flag, score and five strata."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_linestatus", "l_quantity", "l_discount", "l_tax")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return l.join(o, l.l_orderkey == o.o_orderkey).select(
        (F.abs(F.datediff("l_shipdate", "o_orderdate")) + 1).cast("double").alias("time"),
        (F.col("l_linestatus") == "F").cast("int").alias("event"), F.col("l_quantity").alias("score"),
        F.col("o_orderpriority").alias("stratum"), "l_discount", "l_tax")


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as subjects: balances, segments and order days since 1992-01-01 as dated outcomes."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("timestamp"))
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min(F.when(F.col("o_orderstatus") == "F", day)).alias("f_day"),
        F.min(F.when(F.col("o_orderstatus") == "P", day)).alias("p_day"),
        F.max(day).alias("last_day"), F.count("*").alias("n_orders"))
    known = F.col("c_custkey") % 7 != 0
    return c.join(o, c.c_custkey == o.o_custkey, "left").select(
        F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"),
        F.when(known, F.col("c_acctbal")).alias("acctbal"), "f_day", "p_day", "last_day", "n_orders")


def class5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-class truth and prediction per vector; the subject is vec_id mod 25."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return e.select((F.col("vec_id") % 25).cast("int").alias("subject_id"), "vec_id", (F.col("label") % 5).alias("true"),
                    ((F.col("label") + F.when(F.col("vec_id") % 10 < 7, 0).otherwise(1)) % 5).alias("pred"))


def embed_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 64-float vector as one epoch of samples."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("subject_id"), F.col("vec_id"), F.col("embedding").cast("array<double>").alias("samples"))


# ---- the same views as SQL --------------------------------------------------------------------

_SQL = {
    "v_epochs": ([], """
        select user_id as subject_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as integer) as epoch_idx,
               case event_type when 'signup' then 'W' when 'view' then 'N1' when 'click' then 'N2' when 'purchase' then 'N3' else '?' end as sleep_stage,
               case when value > 60 then 1 else 0 end as apnoea_label, value as x, event_id
        from events"""),
    "v_signal": (["v_epochs"], """
        select subject_id, epoch_idx as sec, case when x <= 150 then 100 - x / 10 end as value from v_epochs"""),
    "v_scored_events": (["v_epochs"], """
        select subject_id, epoch_idx * 30 + x / 10 as start_sec, 5 + x / 2 as duration_sec,
               case event_id % 4 when 0 then 'Obstructive apnea' when 1 then 'Central apnea' when 2 then 'Mixed apnea' else 'Hypopnea' end as kind,
               event_id as event_seq
        from v_epochs where sleep_stage = '?'"""),
    "v_nights": ([], "select user_id as subject_id, cast(count(*) as integer) as n_epochs from events group by user_id"),
    "v_pred_a": (["v_epochs"], """
        select cast(subject_id as integer) as subject_id, epoch_idx, apnoea_label, p as pred_prob, cast(p > 0.5 as bigint) as pred_label
        from (select *, ((event_id * 37) % 1000) / 2000.0::double + least(x, 200.0::double) / 400.0::double as p from v_epochs)"""),
    "v_pred_b": (["v_epochs"], """
        select cast(subject_id as integer) as subject_id, epoch_idx, apnoea_label, p as pred_prob, cast(p > 0.5 as bigint) as pred_label
        from (select *, ((event_id * 91) % 1000) / 2000.0::double + least(x, 200.0::double) / 400.0::double as p from v_epochs)"""),
    "v_score_big": ([], "select cast(l_returnflag = 'R' as integer) as apnoea_label, l_quantity / 50 as pred_prob from lineitem"),
    "v_surv": ([], """
        select cast(abs(date_diff('day', o_orderdate, l_shipdate)) + 1 as double) as time, cast(l_linestatus = 'F' as integer) as event,
               l_quantity as score, o_orderpriority as stratum, l_discount, l_tax
        from lineitem join orders on l_orderkey = o_orderkey"""),
    "v_cohort": ([], """
        select c_custkey as subject_id, c_mktsegment as segment, c_nationkey as nation,
               case when c_custkey % 7 <> 0 then c_acctbal end as acctbal, f_day, p_day, last_day, n_orders
        from customer left join (
            select o_custkey,
                   cast(min(date_diff('day', timestamp '1992-01-01', o_orderdate)) filter (o_orderstatus = 'F') as integer) as f_day,
                   cast(min(date_diff('day', timestamp '1992-01-01', o_orderdate)) filter (o_orderstatus = 'P') as integer) as p_day,
                   cast(max(date_diff('day', timestamp '1992-01-01', o_orderdate)) as integer) as last_day, count(*) as n_orders
            from orders group by o_custkey) on c_custkey = o_custkey"""),
    "v_class5": ([], """
        select cast(vec_id % 25 as integer) as subject_id, vec_id, label % 5 as "true",
               (label + case when vec_id % 10 < 7 then 0 else 1 end) % 5 as pred from embeddings"""),
}


def with_views(body: str, *names: str, **ctes: str) -> str:
    """``body`` behind the CTEs it needs; extra ``ctes`` follow the views in the given order."""
    done: dict[str, str] = {}

    def add(n: str) -> None:
        needs, text = _SQL[n]
        for m in needs:
            add(m)
        done.setdefault(n, text)

    for n in names:
        add(n)
    done.update(ctes)
    if not done:
        return body
    return "with " + ",\n".join(f"{n} as ({t})" for n, t in done.items()) + "\n" + body
