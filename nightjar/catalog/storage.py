"""Queries that write the given tables in a store's layout and read them back through its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.catalog import query
from nightjar.catalog.splits import draw
from nightjar.operators.running import dealt
from nightjar.plans import views as V
from nightjar.plans.views import with_views
from nightjar.session import run_folder
from nightjar.sources import annotations as A
from nightjar.sources import files as FI
from nightjar.sources import incremental as I
from nightjar.sources import recordings as RE
from nightjar.sources import store as ST


def folder(spark, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(with_views("""
    select subject_id::integer as subject_id, epoch_idx, sleep_stage, apnoea_label::tinyint as apnoea_label, x::float as x from v_epochs where subject_id % 3 = 1""", "v_epochs"))
def epoch_store(spark, sf) -> DataFrame:
    path = folder(spark, "epochs")
    v = F.concat(F.lit("v"), F.col("subject_id") % 3)
    ST.write_epochs(V.epochs(spark, sf).select("subject_id", "epoch_idx", "sleep_stage", "apnoea_label", "x", v.alias("features_version")), path)
    return ST.read_epochs(spark, path, "v1", ["subject_id", "epoch_idx", "sleep_stage", "apnoea_label", "x"])


@query(with_views("select subject_id, epoch_idx, apnoea_label::tinyint as apnoea_label from v_pred_b", "v_pred_b"))
def prediction_store(spark, sf) -> DataFrame:
    path = folder(spark, "predictions")
    for run in ("a", "b"):
        ST.write_predictions(V.predictions(spark, sf, run), path, run)
    return ST.read_predictions(spark, path, "b", ["subject_id", "epoch_idx", "apnoea_label"])


@query("select c_custkey, case when c_custkey % 4 <> 0 then c_acctbal end as c_acctbal, c_mktsegment from customer")
def cohort_csv(spark, sf) -> DataFrame:
    path = folder(spark, "cohort")
    c = V.table(spark, sf, "customer").select(
        "C_CUSTKEY", F.when(F.col("c_custkey") % 4 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("C_ACCTBAL"), F.col("c_mktsegment").alias("C_MKTSEGMENT"))
    ST.write_table_csv(c, path)
    return ST.read_cohort_csv(spark, path, {"c_custkey": "bigint", "c_acctbal": "double"})


@query("""
    select subject_id, attempt, status from (select user_id as subject_id, event_id as attempt, event_type as status, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events)
    where rn = 1 and status in ('error', 'click')""")
def attempt_ledger(spark, sf) -> DataFrame:
    path = folder(spark, "ledger")
    e = V.table(spark, sf, "events").select(
        F.col("user_id").alias("subject_id"), F.concat_ws("#", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("ts"),
        F.col("event_id").alias("attempt"), F.col("event_type").alias("status"))
    I.append_ledger(e, path)
    e.limit(1).select(F.lit('{"subject_id": 1, "ts": "9999", "att').alias("value")).write.mode("append").text(path)  # a torn line
    ledger = I.read_ledger(spark, path, "subject_id bigint, ts string, attempt bigint, status string")
    return I.latest_attempts(ledger).where(F.col("status").isin("error", "click")).select("subject_id", "attempt", "status")


def _metric_docs(spark, sf) -> DataFrame:
    """Six levels of nested objects per user, written as JSON lines and read back as text."""
    path = folder(spark, "metrics")
    g = V.table(spark, sf, "events").groupBy(F.col("user_id").alias("subject_id")).agg(
        F.round(F.avg("value"), 6).alias("p"), F.round(F.min("value"), 6).alias("l"), F.round(F.max("value"), 6).alias("h"), F.count("*").alias("n"))
    deep = F.struct(F.struct(F.struct(F.struct(F.col("h").alias("high")).alias("d")).alias("c")).alias("b"), F.lit("x").alias("low"))
    doc = F.to_json(F.struct(F.struct(F.col("p").alias("point"), F.struct(F.col("l").alias("low"), deep.alias("a")).alias("ci")).alias("auc"), "n", F.lit("text").alias("note")))
    ST.write_metrics(g.select("subject_id", doc.alias("doc")), path)
    return spark.read.schema("subject_id bigint, doc string").json(path)


@query("""
    select user_id::bigint as subject_id, 'auc.point' as key, round(avg(value), 6)::double as value from events group by 1 union all
    select user_id::bigint, 'auc.ci.low', round(min(value), 6)::double from events group by 1 union all
    select user_id::bigint, 'auc.ci.a.b.c.d.high', round(max(value), 6)::double from events group by 1 union all
    select user_id::bigint, 'n', count(*)::double from events group by 1""")
def flattened_metrics(spark, sf) -> DataFrame:
    return ST.flatten_json(_metric_docs(spark, sf), "doc", ["subject_id"])


@query("select user_id::bigint as subject_id, 'auc.ci.a.b.c.d.high' as key, round(max(value), 6)::double as value from events group by 1")
def json_key_search(spark, sf) -> DataFrame:
    return ST.find_key(_metric_docs(spark, sf), "doc", ["subject_id"], ["upper", "high", "low", "point"])


@query("""
    select 'run_' || l_suppkey as run_id, case when l_suppkey % 4 = 0 then 'basic' else 'ext' end as model, round(case when l_suppkey % 4 = 0 then avg(l_discount) else avg(l_tax) end, 6) as test_auc,
           count(*)::double as n_test_epochs, case when l_suppkey % 4 = 0 then 'epoch' else 'subject' end as ci_basis from lineitem group by l_suppkey""")
def metrics_registry(spark, sf) -> DataFrame:
    g = V.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_discount"), 6).alias("d"), F.round(F.avg("l_tax"), 6).alias("t"), F.count("*").alias("n"))
    run = F.concat(F.lit("run_"), "l_suppkey").alias("run_id")
    basic = g.select(run, F.lit("2024-01-01").alias("date"), F.to_json(F.struct(F.lit("basic").alias("model"), F.col("d").alias("test_auc_roc"), F.col("n").alias("n_test"))).alias("doc"))
    ext = g.where("l_suppkey % 4 <> 0").select(run, F.lit("2024-01-02").alias("date"), F.to_json(F.struct(F.lit("ext").alias("model"), F.col("t").alias("auc_roc"))).alias("doc"))
    return FI.registry(basic, ext).select("run_id", "model", "test_auc", "n_test_epochs", "ci_basis")


XML_STAGES = "select subject_id, epoch_idx, sleep_stage from v_epochs"


def _annotations(spark, sf) -> DataFrame:
    path = folder(spark, "annotations")
    e = V.epochs(spark, sf)
    code = F.create_map(*[F.lit(x) for kv in {"W": "Wake|0", "N1": "Stage 1 sleep|1", "N2": "Stage 2 sleep|2", "N3": "Stage 4 sleep|4", "?": "Unsure"}.items() for x in kv])
    stages = e.select("subject_id", F.lit("Stages|Stages").alias("EventType"), F.element_at(code, F.col("sleep_stage")).alias("EventConcept"),
                      (F.col("epoch_idx") * 30.0).alias("Start"), F.lit(30.0).alias("Duration"))
    ev = V.scored_events(spark, sf)
    kind = F.when(F.col("kind") == "Central apnea", "SpO2 artifact").otherwise(F.col("kind"))
    resp = ev.select("subject_id", F.lit("Respiratory|Respiratory").alias("EventType"), F.concat_ws("|", kind, kind).alias("EventConcept"),
                     F.round("start_sec", 3).alias("Start"), F.round("duration_sec", 3).alias("Duration"))
    dealt(stages.unionByName(resp), "subject_id").write.partitionBy("subject_id").format("xml").option("rowTag", "ScoredEvent").option("rootTag", "ScoredEvents").save(path)
    return A.read_scored_events(spark, path, r"subject_id=(\d+)")


@query(with_views("select subject_id::integer as subject_id, start_sec, stage from (select subject_id, epoch_idx * 30.0::double as start_sec, sleep_stage as stage from v_epochs)", "v_epochs"))
def annotation_stages(spark, sf) -> DataFrame:
    return A.stage_runs(_annotations(spark, sf)).select("subject_id", "start_sec", "stage")


@query(with_views("""
    select subject_id::integer as subject_id, round(start_sec, 3) as start_sec, round(duration_sec, 3) as duration_sec, kind from v_scored_events where kind <> 'Central apnea'""", "v_scored_events"))
def annotation_events(spark, sf) -> DataFrame:
    return A.respiratory_events(_annotations(spark, sf)).drop("event_seq")


@query(with_views("select 'SpO2 artifact' as concept, count(*) as n from v_scored_events where kind = 'Central apnea'", "v_scored_events"))
def annotation_audit(spark, sf) -> DataFrame:
    return A.ignored_concepts(_annotations(spark, sf))


# ---- selective loads, discovery, verification --------------------------------------------------

@query(with_views("""
    select e.subject_id::integer as subject_id, epoch_idx, sleep_stage, x::float as x from v_epochs e
    join (select subject_id, min(epoch_idx) as lo, max(epoch_idx) as hi from v_epochs where sleep_stage in ('N1', 'N2', 'N3', 'REM') group by 1) s using (subject_id)
    where sleep_stage <> '?' and epoch_idx between lo - 2 and hi + 2 and e.subject_id % 3 = 1 and e.subject_id in (select o_custkey from orders)""", "v_epochs"))
def selected_rows(spark, sf) -> DataFrame:
    path = folder(spark, "epochs")
    v = F.concat(F.lit("v"), F.col("subject_id") % 3)
    ST.write_epochs(V.epochs(spark, sf).select("subject_id", "epoch_idx", "sleep_stage", "apnoea_label", "x", v.alias("features_version")), path)
    wanted = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("subject_id"))
    return ST.load_rows(spark, path, "v1", ["x"], wanted, margin=2)


@query("select distinct user_id::integer as subject_id from events")
def discovered_subjects(spark, sf) -> DataFrame:
    path = folder(spark, "subjects")
    dealt(V.table(spark, sf, "events").select("user_id", "event_id"), "user_id").write.partitionBy("user_id").json(path)
    return FI.discover_subject_ids(spark, path + "/*/*.json", r"user_id=(\d+)/")


@query("select distinct event_type as config, (user_id % 3)::integer as seed from events")
def discovered_runs(spark, sf) -> DataFrame:
    path = folder(spark, "runs")
    e = V.table(spark, sf, "events").groupBy(F.col("event_type").alias("config"), (F.col("user_id") % 3).alias("seed")).agg(F.avg("value").alias("auc"))
    e.write.partitionBy("config", "seed").json(path)
    return FI.discover_runs(spark, path, "part-*.json", r"config=([^/]+)/seed=(\d+)/").select("config", "seed").distinct()


@query("""
    select distinct user_id % 7 as part, case when user_id % 7 = 0 then 'missing' when user_id % 7 = 1 then 'unexpected' else 'changed' end as state from events where user_id % 7 in (0, 1, 2)""")
def verified_manifest(spark, sf) -> DataFrame:
    from nightjar.operators import quality as Q

    path = folder(spark, "files")
    V.table(spark, sf, "events").select("user_id", "event_id", (F.col("user_id") % 7).alias("part")).repartition("part").write.partitionBy("part").json(path)
    files = spark.read.format("binaryFile").load(path + "/*/*.json")
    number = F.regexp_extract("path", r"part=(\d+)/", 1).cast("bigint")
    kept = Q.manifest(files).withColumn("part", number)
    expected = kept.where("part <> 1").withColumn("sha256", F.when(F.col("part") == 2, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    found = Q.manifest_verify(files.where(number != 0), expected)
    return found.select(number.alias("part"), "state").distinct()


@query(with_views("""
    select 0::bigint as only_a, 0::bigint as only_b, count(*) filter (apnoea_label = 1) as diff_x from v_epochs join picked using (subject_id)""", "v_epochs",
                  picked="select subject_id from (select distinct subject_id from v_epochs) order by " + draw("'5'", "subject_id::varchar") + ", subject_id limit 20"))
def repeated_extraction(spark, sf) -> DataFrame:
    from nightjar.operators.quality import repeatability

    d = V.epochs(spark, sf).select("subject_id", "epoch_idx", "apnoea_label", "x")
    again = lambda ids: d.join(ids, "subject_id").withColumn("x", F.when(F.col("apnoea_label") == 1, F.col("x") + 1).otherwise(F.col("x")))
    return repeatability(d, again, 20, ["x"], seed=5)


DIGITAL = """
    select subject_id, epoch_idx, 'SaO2' as label, k, (event_id * (k + 1)) % 4001 - 2000 as d, -2000 as dmin, 2000 as dmax, 0.025::double as gain from v_epochs, range(30) t(k)
    union all select subject_id, epoch_idx, 'PULSE', k, floor(x)::bigint % 200 + k, 0, 250, 1.0::double from v_epochs, range(3) t(k)"""


def recordings(spark, sf, path: str) -> DataFrame:
    """One EDF file per user, an oxygen and a pulse channel, written from the event table by Spark and read by ranges of epochs."""
    k30, k3 = (F.sequence(F.lit(0), F.lit(n - 1)) for n in (30, 3))
    oxygen = F.transform(k30, lambda k: (F.pmod(F.col("event_id") * (k + 1), F.lit(4001)) - 2000).cast("smallint"))
    pulse = F.transform(k3, lambda k: (F.floor("x") % 200 + k).cast("smallint"))
    channel = lambda i, label, fs, gain, dmin, dmax, x: F.struct(
        F.lit(i).alias("channel_index"), F.lit(label).alias("label"), F.lit("u").alias("unit"), F.lit(fs).alias("fs"), F.lit(gain).alias("gain"),
        F.lit(dmin).alias("dmin"), F.lit(dmax).alias("dmax"), F.lit(0.0).alias("pmin"), x.alias("samples"))
    both = F.array(channel(0, "SaO2", 1.0, 0.025, -2000, 2000, oxygen), channel(1, "PULSE", 0.1, 1.0, 0, 250, pulse))
    chunks = V.epochs(spark, sf).select(F.col("subject_id").cast("int").alias("subject_id"), "epoch_idx", F.explode(both).alias("c")).select("subject_id", "epoch_idx", "c.*")
    RE.export_recordings(chunks, path).write.format("noop").mode("overwrite").save()
    return RE.read_recordings(spark, path, subject=r"(\d+)", range_bytes=4096)


@query(with_views("""
    select subject_id::integer as subject_id, label, count(distinct epoch_idx) as n_epochs, count(*) as n_samples, sum(d)::bigint as total, round(avg((d - dmin) * gain), 6) as mean_physical,
           count(*) filter (d <= dmin or d >= dmax) as at_rail, round(sqrt(avg(spread * spread)), 6) as spread_lsb
    from (select *, stddev_pop(d) over (partition by subject_id, label, epoch_idx) as spread from digital) group by all""", "v_epochs", digital=DIGITAL))
def recording_table(spark, sf) -> DataFrame:
    """Recording files -> the partitioned chunk table with its quality, summed per channel."""
    path = folder(spark, "recording-table")
    RE.write_recordings(recordings(spark, sf, folder(spark, "recordings")), path)
    n = F.size("samples")
    digits = F.aggregate("samples", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    d = spark.read.parquet(path).groupBy("subject_id", "label", "gain", "dmin", "pmin").agg(
        F.countDistinct("epoch_idx").alias("n_epochs"), F.sum(n).alias("n_samples"), F.sum(digits).alias("total"),
        F.sum(F.round(F.col("rail_frac") * n)).cast("bigint").alias("at_rail"),
        F.round(F.sqrt(F.sum(F.col("spread_lsb") * F.col("spread_lsb") * n) / F.sum(n)), 6).alias("spread_lsb"))
    # whole digits add up the same in any order of rows; the scale of a channel follows once
    physical = (F.col("total") - F.col("dmin") * F.col("n_samples")) * F.col("gain") / F.col("n_samples") + F.col("pmin")
    return d.withColumn("mean_physical", F.round(physical, 6)).drop("gain", "dmin", "pmin")


@query(with_views("""
    select subject_id::integer as subject_id, case label when 'SaO2' then 'SPO2' else 'HR' end as channel, epoch_idx, count(*)::integer as n, round(sum((d - dmin) * gain), 4) as total,
           round(max((d - dmin) * gain) - min((d - dmin) * gain), 4) as span
    from digital where subject_id % 2 = 0 and label = 'SaO2' or subject_id % 2 = 1 group by all""", "v_epochs", digital=DIGITAL))
def recording_channels(spark, sf) -> DataFrame:
    """Recording files -> physical samples of the chosen channels, all channels or one per file."""
    path = folder(spark, "recordings")
    every = RE.canonical_channels(recordings(spark, sf, path)).where("subject_id % 2 = 1")
    oxygen = RE.canonical_channels(RE.read_recordings(spark, path, subject=r"(\d+)", labels=["SaO2"])).where("subject_id % 2 = 0")
    total = F.aggregate("samples", F.lit(0.0), lambda acc, x: acc + x)
    return every.unionByName(oxygen).select("subject_id", "channel", "epoch_idx", F.size("samples").alias("n"), F.round(total, 4).alias("total"),
                                            F.round(F.array_max("samples") - F.array_min("samples"), 4).alias("span"))
