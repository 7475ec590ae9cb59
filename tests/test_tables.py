"""Cohort worked examples, column sets, contracts, sources and whole chains on small files."""

import json
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nightjar.operators import align as A
from nightjar.operators import cohort as C
from nightjar.operators import columns as CO
from nightjar.operators import quality as Q
from nightjar.sources import annotations as AN
from nightjar.sources import files as FI
from nightjar.sources import incremental as I
from nightjar.sources import recordings as RE
from nightjar.sources import store as ST


# ---- cohort -----------------------------------------------------------------------------------

def test_published_risk_examples(spark):
    d = spark.createDataFrame([(61.0, 180.0, 47.0, 124.0, 0, 1, 0, 0), (53.0, 161.0, 55.0, 125.0, 1, 0, 1, 1)],
                              "age double, chol double, hdl double, sbp double, trt int, smk int, dm int, male int")
    lp = C.risk_linear_predictor(*[F.col(c) for c in d.columns])
    got = [r[0] for r in d.select(C.risk_10_years(lp, F.col("male"))).collect()]
    assert abs(got[0] - 0.1048) < 5e-4 and abs(got[1] - 0.156) < 5e-4


def test_event_weighted_rate(spark):
    cols = "savbnbh double, nremepbp double, savbnoh double, nremepop double, savbrbh double, remepbp double, savbroh double, remepop double, hrqual int"
    d = spark.createDataFrame([(60.0, 100.0, 70.0, 300.0, 80.0, 100.0, None, 5.0, 4), (60.0, 100.0, 70.0, 300.0, 80.0, 100.0, None, 5.0, 1)], cols)
    got = [r[0] for r in d.select(C.event_weighted_rate()).collect()]
    assert got == [(60 * 100 + 70 * 300 + 80 * 100) / 500, None]


def test_self_report_flag(spark):
    d = spark.createDataFrame([(1, 0, 0), (0, 8, None), (None, None, None), (0, 0, 0)], "a int, b int, c int")
    assert [r[0] for r in d.select(C.any_answered(["a", "b", "c"])).collect()] == [1.0, 0.0, None, 0.0]
    assert [r[0] for r in d.select(C.any_or_all_zero(["a", "b", "c"])).collect()] == [1.0, None, None, 0.0]


def test_late_and_undated_events(spark):
    d = spark.createDataFrame([(1, 500, 400), (1, None, 400), (0, 100, 400), (1, 100, 400), (None, 100, 400)], "mi int, mi_date int, cens int")
    cols = C.event_time({"mi": "event"}, ["mi_date"], "cens", "mi")
    got = [tuple(r) for r in d.select(*[c.alias(n) for n, c in cols.items()]).collect()]
    assert got == [(0, 400.0, False, True), (1, 400.0, True, False), (0, 400.0, False, False), (1, 100.0, False, False), (0, 400.0, False, False)]
    kept = C.event_time({"mi": "event"}, ["mi_date"], "cens", "mi", keep_late=True)
    assert tuple(d.select(kept["E_mi"], kept["T_mi"]).first()) == (1, 500.0)


def test_outcome_build_and_audit(spark):
    zero = {c: 0 for c in C.HISTORY}
    out_cols = {c: 0 for c in ("mi", "stroke", "chf", "revasc_proc", "ptca", "cabg", "cvd_death", "chd_death", "any_cvd")}
    dates = {d: None for d in ("mi_date", "stk_date", "chf_date", "revpro_date", "ptca_date", "cabg_date", "cvd_dthdt", "chd_dthdt")}
    rows = [
        {"nsrrid": 1, **zero, **out_cols, **dates, "censdate": 1000, "vital": 1, "mi": 1, "mi_date": 300},
        {"nsrrid": 2, **zero, **out_cols, **dates, "censdate": 900, "vital": 0, "prev_ang": None},
        {"nsrrid": 3, **zero, **out_cols, **dates, "censdate": 900, "vital": 1, "prev_mi": None},
        {"nsrrid": 4, **zero, **out_cols, **dates, "censdate": 900, "vital": 1, "prev_stk": 1},
        {"nsrrid": 5, **zero, **out_cols, **dates, "censdate": 900, "vital": 1, "prev_revpro": None},
    ]
    schema = "nsrrid int, " + ", ".join(f"{c} int" for c in [*zero, *out_cols, *dates, "censdate", "vital"])
    summary = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    base = spark.createDataFrame([(i, 0, None, 1, *[8] * 6) for i in range(1, 6)],
                                 "nsrrid int, shhs1_tcvd int, date25 int, race int, " + ", ".join(f"{c} int" for c in C.SELF_REPORT))
    o = C.build_outcomes(summary, base)
    got = {r.nsrrid: r for r in o.collect()}
    assert [got[i].coh for i in range(1, 6)] == ["CHS", "ARIC", "NY", "CHS", "FHS-A"]
    assert (got[1].E_cvd, got[1].T_cvd, got[1].E_hf, got[2].E_death) == (1, 300.0, 0, 1)
    assert sorted(r.nsrrid for r in C.incident_cohort(o).collect()) == [1, 2, 5]
    audit = {(r.definition, r.coh): r for r in C.audit_counts(o, ["cvd"]).collect()}
    assert audit[("P3", None)].n == 3 and audit[("P3", "CHS")].events_cvd == 1


# ---- column sets ------------------------------------------------------------------------------

ALL = [b + s for b in CO.BASE_FEATURES for s in ("", *CO.CONTEXT_SUFFIXES)]


PHYSIO = CO.select_features(ALL, CO.known_at(0), CO.of_kind("physio", "unknown"))


def test_feature_counts():
    assert len(CO.BASE_FEATURES) == 57 and len(ALL) == 399
    f = CO.describe("spo2_min_roll5_std")
    assert (f.base, f.context, f.kind, f.batch, f.looks_ahead) == ("spo2_min", "_roll5_std", "aasm", None, True)
    assert CO.describe("resp_thor_rms").kind == "unknown" and CO.describe("eeg_beta_rel").kind == "physio"
    assert CO.describe("spo2_sampen_lag1").batch == 0 and not CO.describe("hr_mean_lag1").looks_ahead
    kinds = [CO.select_features(ALL, CO.of_kind(k)) for k in ("aasm", "physio", "unknown")]
    assert sum(map(len, kinds)) == len(ALL) and CO.select_features(["subject_id", "hr_mean"]) == ["hr_mean"]


def test_matched_cells():
    assert len(PHYSIO) == 217
    assert [len(CO.matched_cell(c, PHYSIO)) for c in ("physio_only_repro", "ecg_only", "ecg_belt")] == [217, 56, 77]
    with pytest.raises(CO.CellError):
        CO.matched_cell("ecg_only", PHYSIO[:-1])
    with pytest.raises(CO.CellError, match="variants"):
        CO.matched_cell("ecg_only", [*PHYSIO[:-1], "hr_extra"])


def test_causal_and_first_schema():
    keep = CO.select_features(ALL, CO.causal)
    assert not any(CO.describe(c).looks_ahead for c in keep) and "hr_mean_lag1" in keep
    assert len(CO.select_features(ALL, CO.known_at(0), CO.not_in_sprint)) == 203
    for config in CO.STAGING_RULES:
        assert not any(c.startswith(CO.STAGE_LEAK_PREFIXES) for c in CO.staging_features(ALL, config))


def test_column_expressions_follow_the_names(spark):
    d = spark.createDataFrame([(n,) for n in ALL], "n string").select("n", CO.base_column(F.col("n")).alias("b"), CO.kind_column(F.col("n")).alias("c"))
    for r in d.collect():
        assert (r.b, r.c) == (CO.describe(r.n).base, CO.describe(r.n).kind)
    wide = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "subject_id int, hr_mean double, odi3_count_lead1 double, spo2_sampen double")
    rows = {r.name: r for r in CO.column_catalog(wide).collect()}
    assert rows["odi3_count_lead1"].looks_ahead and rows["odi3_count_lead1"].leaks_stage and rows["spo2_sampen"].batch == 0
    assert [r.name for r in CO.literature_table(wide).where("present").collect()] == ["hr_mean"]


# ---- contracts --------------------------------------------------------------------------------

def pred(spark, rows):
    return spark.createDataFrame(rows, "subject_id int, epoch_idx int, apnoea_label int, pred_prob double, pred_label bigint")


def test_strict_alignment_refuses(spark):
    a = pred(spark, [(1, 0, 0, 0.1, 0), (1, 1, 1, 0.9, 1)])
    assert A.align_strict(a, a).count() == 2
    for b in (pred(spark, [(1, 0, 0, 0.1, 0)]), pred(spark, [(1, 0, 1, 0.1, 0), (1, 1, 1, 0.9, 1)])):
        with pytest.raises(Exception, match="do not share"):
            A.align_strict(a, b).collect()


@pytest.mark.parametrize("bad", [[(1, 0, 0, 0.1, 0)], [(1, 0, 0, 0.1, 0), (1, 1, 1, 0.9, 1), (2, 0, 0, 0.5, 0)],
                                 [(1, 0, 0, 0.1, 0), (1, 1, 0, 0.9, 1)], [(1, 0, 0, 0.1, 0), (1, 0, 0, 0.1, 0), (1, 1, 1, 0.9, 1)],
                                 [(1, 0, 0, float("nan"), 0), (1, 1, 1, 0.9, 1)]])
def test_assembly_refuses(spark, bad):
    key = pred(spark, [(1, 0, 0, 0.0, 0), (1, 1, 1, 0.0, 0)])
    with pytest.raises(Exception, match="one to one"):
        A.assemble_predictions(pred(spark, bad), key, 0.5).collect()
    assert sum(A.assembly_report(pred(spark, bad), key).first()) >= 1


def test_schema_contract(spark):
    with pytest.raises(ValueError):
        A.check_predictions(pred(spark, []))


def test_label_parity_detects_a_changed_row(spark):
    e = spark.createDataFrame([(1, i, "N2", i % 2) for i in range(6)], "subject_id int, epoch_idx int, sleep_stage string, apnoea_label int")
    ref = spark.createDataFrame([(1, 6, 6, 3)], "subject_id int, n_epochs int, n_sleep int, n_apnoea int")
    key = e.select("subject_id", "epoch_idx", "apnoea_label")
    assert all(Q.label_parity(e, ref, key).select("n_epochs_ok", "n_sleep_ok", "apnoea_sum_ok", "key_rows_ok").first())
    swapped = key.withColumn("apnoea_label", 1 - F.col("apnoea_label"))
    r = Q.label_parity(e, ref, swapped).first()
    assert r.apnoea_sum_ok and not r.key_rows_ok


# ---- sources ----------------------------------------------------------------------------------

SIGNALS = [("SaO2", 1, 0, 100), ("EEG", 125, -125, 125), ("ECG", 125, -1.25, 1.25), ("THOR RES", 10, 1, -1), ("ABDO RES", 10, 1, -1),
           ("AIRFLOW", 10, 1, -1), ("NEW AIR", 10, -1, 1), ("POSITION", 1, 0, 3)]


def edf(path, seconds, records=None, truncate=0, seed=0):
    """A small EDF file; returns the digital samples per label."""
    rng = np.random.default_rng(seed)
    data = {}
    for name, fs, _, _ in SIGNALS:
        n = seconds * fs
        if name == "ECG":
            t = np.arange(n) / fs
            x = 3000 * sum(np.exp(-0.5 * ((t - b) / 0.02) ** 2) for b in np.arange(0.5, seconds, 0.9))
        elif name == "SaO2":
            x = np.full(n, 64000 / 2 - 1400.0) - 1500 * (np.arange(n) % 60 > 40)
        elif name == "AIRFLOW":
            x = rng.integers(-1, 2, n)
        elif name == "POSITION":
            x = np.full(n, 11000)
        else:
            x = 2000 * np.sin(2 * np.pi * 0.25 * np.arange(n) / fs) + rng.normal(0, 100, n)
        data[name] = np.clip(x, -32768, 32767).astype("<i2")
    ns = len(SIGNALS)
    f = lambda v, w: str(v).ljust(w)[:w].encode()
    head = f("0", 8) + f("", 80) + f("", 80) + f("01.01.95", 8) + f("22.00.00", 8) + f(256 * (ns + 1), 8) + f("", 44) + f(records if records is not None else seconds, 8) + f(1, 8) + f(ns, 4)
    for values, w in (([s[0] for s in SIGNALS], 16), ([""] * ns, 80), (["u"] * ns, 8), ([s[2] for s in SIGNALS], 8), ([s[3] for s in SIGNALS], 8),
                      ([-32768] * ns, 8), ([32767] * ns, 8), ([""] * ns, 80), ([s[1] for s in SIGNALS], 8), ([""] * ns, 32)):
        head += b"".join(f(v, w) for v in values)
    body = b"".join(data[n][r * fs:(r + 1) * fs].tobytes() for r in range(seconds) for n, fs, _, _ in SIGNALS)
    path.write_bytes((head + body)[: len(head) + len(body) - truncate])
    return data


@pytest.fixture(scope="module")
def night_files(tmp_path_factory):
    d = tmp_path_factory.mktemp("night")
    data = {200001: edf(d / "shhs1-200001.edf", 317), 200002: edf(d / "shhs1-200002.edf", 400, records=-1, seed=1)}
    edf(d / "shhs1-200003.edf", 90, truncate=2 * 600)
    (d / "shhs1-200004.edf").write_bytes(b"garbage")
    rec = lambda t, c, s, l: f"<ScoredEvent><EventType>{t}</EventType><EventConcept>{c}</EventConcept><Start>{s}</Start><Duration>{l}</Duration></ScoredEvent>"
    for sid in data:
        x = rec("Stages|Stages", "Wake|0", 0, 60) + rec("Stages|Stages", "Stage 2 sleep|2", 60, 150) + rec("Stages|Stages", "Stage 4 sleep|4", 210, 90)
        x += rec("Respiratory|Respiratory", "Obstructive apnea|Obstructive Apnea", 75, 25) + rec("Respiratory|Respiratory", "SpO2 artifact|SpO2 artifact", 10, 5)
        x += rec("Respiratory|Respiratory", "Hypopnea|Hypopnea", 155.5, 20) + rec("Arousals|Arousals", "Arousal|Arousal ()", 5, 3)
        x += rec("Respiratory|Respiratory", "Hypopnea|Hypopnea", "bad", 20)
        (d / f"shhs1-{sid}-nsrr.xml").write_text(f"<PSGAnnotation><ScoredEvents>{x}</ScoredEvents></PSGAnnotation>")
    return d, data


def test_recordings_round_trip(spark, night_files):
    d, data = night_files
    c = RE.read_recordings(spark, str(d)).cache()
    bad = c.where("error IS NOT NULL").collect()
    assert [r.subject_id for r in bad] == [200004]
    for sid, want in data.items():
        for name, fs, _, _ in SIGNALS:
            got = c.where((F.col("subject_id") == sid) & (F.col("label") == name)).orderBy("epoch_idx").collect()
            x = np.concatenate([r.samples for r in got])
            n = len(want[name]) // (30 * fs) * 30 * fs
            np.testing.assert_array_equal(x, want[name][:n])
            assert got[0].fs == fs
    notes = {r.subject_id: r.note for r in c.where("error IS NULL").select("subject_id", "note").distinct().collect()}
    assert notes == {200001: "", 200002: "record count derived from size", 200003: "truncated"}
    live = RE.canonical_channels(c).where("channel = 'AIRFLOW' AND subject_id = 200001 AND epoch_idx = 0").first()
    np.testing.assert_allclose(live.samples, (data[200001]["NEW AIR"][:300].astype(float) + 32768) * 2 / 65535 - 1, atol=1e-9)
    thor = RE.canonical_channels(c).where("channel = 'THOR' AND subject_id = 200001 AND epoch_idx = 0").first()
    np.testing.assert_allclose(thor.samples, (data[200001]["THOR RES"][:300].astype(float) + 32768) * -2 / 65535 + 1, atol=1e-9)


def test_annotations(spark, night_files):
    s = AN.read_scored_events(spark, str(night_files[0] / "*.xml"))
    runs = sorted((r.subject_id, r.start_sec, r.stage) for r in AN.stage_runs(s).collect())
    assert runs[:3] == [(200001, 0.0, "W"), (200001, 60.0, "N2"), (200001, 210.0, "N3")]
    ev = sorted((r.subject_id, r.start_sec, r.kind) for r in AN.respiratory_events(s).collect())
    assert ev[:2] == [(200001, 75.0, "Obstructive apnea"), (200001, 155.5, "Hypopnea")]
    assert [(r.concept, r.n) for r in AN.ignored_concepts(s).collect()] == [("SpO2 artifact", 2)]


def test_discovery_and_manifest(spark, night_files):
    d, _ = night_files
    ids = FI.discover_subject_ids(spark, str(d / "*.edf"))
    assert [r.subject_id for r in ids.collect()] == [200001, 200002, 200003, 200004]
    files = spark.read.format("binaryFile").load(str(d / "*.edf"))
    m = Q.manifest(files)
    assert Q.manifest_verify(files, m).count() == 0
    changed = m.withColumn("sha256", F.when(F.col("path").contains("200002"), "x").otherwise(F.col("sha256")))
    assert [r.state for r in Q.manifest_verify(files, changed).collect()] == ["changed"]
    assert I.pilot_subset(ids, spark.createDataFrame([(200002,)], "subject_id int")).count() == 1


def test_extraction_end_to_end(spark, night_files):
    from nightjar.plans.extraction import derive_channels, extract_epochs

    d, _ = night_files
    ch = RE.canonical_channels(RE.read_recordings(spark, str(d))).where("subject_id IN (200001, 200002)").cache()
    s = AN.read_scored_events(spark, str(d / "*.xml"))
    rates = {"ECG": 125, "EEG": 125, "THOR": 10, "ABDO": 10, "AIRFLOW": 10, "SPO2": 1, "POSITION": 1}
    wide = extract_epochs(ch, AN.stage_runs(s), AN.respiratory_events(s), rates, "test-v1").toPandas().sort_values(["subject_id", "epoch_idx"])
    assert len(wide) == 10 + 13 and set(CO.BASE_FEATURES) <= set(wide.columns)
    assert len([c for c in wide.columns if c in ALL]) == 399
    one = wide[wide.subject_id == 200001].reset_index(drop=True)
    assert list(one["sleep_stage"]) == ["W"] * 2 + ["N2"] * 5 + ["N3"] * 3
    assert list(one["apnoea_label"]) == [0, 0, 1, 1, 0, 1, 0, 0, 0, 0]
    assert abs(one["hr_mean"][4] - 60 / 0.9) < 1 and abs(one["resp_breath_rate_bpm"][4] - 15) < 1.1
    assert one["hypoxic_burden_epoch"].sum() > 0 and one["eeg_total_power"].notna().all()
    x = derive_channels(ch, rates).groupBy("subject_id", "channel").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.sum(F.isnan("value").cast("int")).alias("nan")).toPandas()
    assert set(x["channel"]) == {"RR", "EDR", "THOR", "ABDO", "AIRFLOW", "SPO2"} and x["nan"].sum() == 0
    assert (x[(x.subject_id == 200001) & x.channel.isin(["THOR", "ABDO", "SPO2"])]["n"] == 1200).all()
    assert x[x.channel == "RR"]["m"].abs().max() < 5


def test_registry_from_run_folders(spark, tmp_path):
    for run, ext in (("a_seed42", True), ("old_sleep_run", False), ("_old/x", True)):
        p = tmp_path / run
        p.mkdir(parents=True)
        (p / "metrics.json").write_text(json.dumps({"model": "m", "test_auc_roc": 0.7, "feature_cols": ["a", "b"], "f1": None}))
        if ext:
            (p / "metrics_extended.json").write_text(json.dumps({"auc_roc": 0.8, "brier": float("nan")}))
    root = str(tmp_path)
    got = {r.run_id: r for r in FI.registry(FI.read_metrics(spark, root, "metrics.json"), FI.read_metrics(spark, root, "metrics_extended.json"), [("a_seed", "all"), ("sleep_run$", "sleep-only"), ("old", "none")]).collect()}
    assert set(got) == {"a_seed42", "old_sleep_run"} and got["a_seed42"].filter_used == "all"
    assert got["a_seed42"].test_auc == 0.8 and got["a_seed42"].ci_basis == "subject" and got["a_seed42"].brier is None and got["a_seed42"].n_features == 2
    assert got["old_sleep_run"].test_auc == 0.7 and got["old_sleep_run"].filter_used == "sleep-only"
    runs = FI.discover_runs(spark, root, "metrics.json").collect()
    assert [(r.config, r.seed) for r in runs] == [("a", 42)]


def test_epoch_store_prunes_versions_and_replaces_only_its_own(spark, tmp_path):
    d = spark.createDataFrame([(1, 0, "v1", 1.0), (1, 1, "v1", 2.0), (2, 0, "v2", 3.0)], "subject_id int, epoch_idx int, features_version string, x double")
    path = str(tmp_path / "e")
    ST.write_epochs(d, path)
    ST.write_epochs(d.where("features_version = 'v2'").withColumn("x", F.lit(9.0)), path)
    got = ST.read_epochs(spark, path, "v1", ["subject_id", "x"])
    assert sorted(r.x for r in got.collect()) == [1.0, 2.0]
    assert [r.x for r in ST.read_epochs(spark, path, "v2").collect()] == [9.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(features_version" in plan and "epoch_idx" not in plan.split("ReadSchema")[-1]


def test_ledger_skips_torn_lines(spark, tmp_path):
    p = tmp_path / "ledger.jsonl"
    p.write_text('{"subject_id": 1, "ts": "a", "status": "failed"}\n{"subject_id": 1, "ts": "b", "status": "ok"}\n{"subject_id": 2, "ts"')
    led = I.read_ledger(spark, str(p), "subject_id int, ts string, status string")
    assert [(r.subject_id, r.status) for r in I.latest_attempts(led).collect()] == [(1, "ok")]


def test_flatten_struct(spark):
    d = spark.createDataFrame([((1.0, ("x",)),)], "a struct<b: double, c: struct<d: string>>")
    assert ST.flatten_struct(d).columns == ["a.b", "a.c.d"]


def test_streaming_epochs(spark, tmp_path):
    from nightjar.streaming.epochs import epoch_stats

    ts = pd.date_range("2024-01-01", periods=120, freq="s")
    pdf = pd.DataFrame({"subject_id": 1, "ts": ts, "value": np.arange(120.0)})
    spark.createDataFrame(pdf).write.parquet(str(tmp_path / "in"))
    q = epoch_stats(spark.readStream.schema("subject_id long, ts timestamp, value double").parquet(str(tmp_path / "in"))).writeStream.outputMode(
        "complete").format("memory").queryName("epochs_out").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select * from epochs_out order by epoch_start").collect()
    assert [r.spo2_mean for r in got] == [14.5, 44.5, 74.5, 104.5]
