"""Recordings read by ranges of epochs, written and laid out as tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_tables import SIGNALS, edf

from nightjar.sources import recordings as RE


def samples_of(df, sid, label):
    return np.concatenate([r.samples for r in df.where((F.col("subject_id") == sid) & (F.col("label") == label)).orderBy("epoch_idx").collect()])


@pytest.mark.parametrize("range_bytes,split_bytes", [(1, 1), (50_000, 60_000), (16 << 20, 128 << 20)])
def test_any_range_size_reads_the_same(spark, tmp_path, range_bytes, split_bytes):
    data = {300001: edf(tmp_path / "x-300001.edf", 317), 300002: edf(tmp_path / "x-300002.edf", 400, seed=1)}
    d = RE.read_recordings(spark, str(tmp_path), range_bytes=range_bytes, split_bytes=split_bytes).cache()
    for sid, want in data.items():
        for name, fs, _, _ in SIGNALS:
            np.testing.assert_array_equal(samples_of(d, sid, name), want[name][:len(want[name]) // (30 * fs) * 30 * fs])
    if split_bytes == 1:
        assert RE.read_recordings(spark, str(tmp_path), range_bytes=1, split_bytes=1).rdd.getNumPartitions() == 10 + 13


def test_records_that_do_not_divide_an_epoch(spark, tmp_path):
    """Records of 7 s at 3 and 4 samples a record: an epoch is 13 or 17 samples and starts inside a record."""
    r = np.random.default_rng(1)
    a, b = (r.integers(-500, 500, (60, n)).astype("<i2") for n in (3, 4))
    f = lambda v, w: str(v).ljust(w).encode()
    head = f("0", 8) + f("", 176) + f(768, 8) + f("", 44) + f(60, 8) + f(7, 8) + f(2, 4)
    for values, w in ((("A", "B"), 16), (("", ""), 80), (("u", "u"), 8), ((-1, -1), 8), ((1, 1), 8), ((-500, -500), 8), ((500, 500), 8), (("", ""), 80), ((3, 4), 8), (("", ""), 32)):
        head += b"".join(f(v, w) for v in values)
    (tmp_path / "y-300003.edf").write_bytes(head + np.concatenate([a, b], axis=1).tobytes())
    d = RE.read_recordings(spark, str(tmp_path), range_bytes=1).cache()
    for label, x, per in (("A", a, 13), ("B", b, 17)):
        np.testing.assert_array_equal(samples_of(d, 300003, label), x.ravel()[:x.size // per * per])


def test_a_file_beyond_two_gibibytes(spark, tmp_path):
    """Sparse on disk. One channel is read; each task holds at most one range."""
    path = tmp_path / "z-300004.edf"
    edf(path, 30, records=-1)
    os.truncate(path, (2 << 30) + (64 << 20))
    size = os.path.getsize(path)
    header = RE.read_header(str(path), size)
    ranges = RE.plan_ranges(header)
    record = 2 * sum(header["samples"])
    assert max((b - a) * record for a, b in (RE.record_span(header, *x) for x in ranges)) <= RE.RANGE_BYTES + 30 * record
    assert [a for a, _ in ranges[1:]] == [b for _, b in ranges[:-1]] and ranges[0][0] == 0
    d = RE.read_recordings(spark, str(tmp_path), labels=["POSITION"])
    n = (size - header["size"]) // record // 30
    got = d.agg(F.count("*"), F.countDistinct("epoch_idx"), F.max("epoch_idx"), F.collect_set("label"), F.sum(F.size("samples"))).first()
    assert tuple(got) == (n, n, n - 1, ["POSITION"], 30 * n) and d.rdd.getNumPartitions() >= 8


def test_unwanted_channels_are_not_decoded(tmp_path, monkeypatch):
    path = tmp_path / "w-300005.edf"
    edf(path, 60)
    header = RE.read_header(str(path), os.path.getsize(path))
    data = path.read_bytes()[header["size"]:]
    copied = []
    plain = np.ascontiguousarray
    monkeypatch.setattr(RE.np, "ascontiguousarray", lambda x: copied.append(x.shape) or plain(x))
    out = list(RE.decode_range(header, data, 0, 0, 2, {"SaO2"}))
    assert [(i, e.tolist(), x.shape) for i, e, x in out] == [(0, [0, 1], (2, 30))] and copied == [(60, 1)]


def test_written_files_and_table(spark, tmp_path):
    edf(tmp_path / "x-300001.edf", 95)
    edf(tmp_path / "x-300002.edf", 120, seed=2)
    (tmp_path / "x-300003.edf").write_bytes(b"")
    first = RE.read_recordings(spark, str(tmp_path)).cache()
    good = first.where("error IS NULL").where("NOT (subject_id = 300002 AND label = 'EEG' AND epoch_idx = 1)")
    out = sorted(map(tuple, RE.export_recordings(good, str(tmp_path / "out")).collect()))
    assert [(s, n) for s, _, n in out] == [(300001, 3), (300002, 4)] and first.where("error IS NOT NULL").count() == 1
    second = RE.read_recordings(spark, str(tmp_path / "out")).cache()
    columns = ["subject_id", "channel_index", "label", "unit", "fs", "dmin", "dmax", "epoch_idx", "samples"]
    filled = second.select(columns).exceptAll(good.select(columns)).collect()
    assert [(r.label, r.epoch_idx, set(r.samples)) for r in filled] == [("EEG", 1, {-32768})]
    assert good.select(columns).exceptAll(second.select(columns)).count() == 0
    RE.write_recordings(first, str(tmp_path / "table"))
    table = spark.read.parquet(str(tmp_path / "table"))
    assert table.count() == first.where("error IS NULL").count() and os.path.isdir(tmp_path / "table" / "label=SaO2")
    row = table.where("label = 'EEG' AND subject_id = 300001 AND epoch_idx = 0").first()
    assert row.rail_frac == np.mean(np.isin(row.samples, (-32768, 32767))) and row.spread_lsb == pytest.approx(np.std(row.samples))


def test_planning_opens_no_small_file(tmp_path, monkeypatch):
    """The plan of many files grows with their names: headers are left to the tasks."""
    for i in range(40):
        edf(tmp_path / f"v-{300100 + i}.edf", 61, seed=i)

    def closed(*_):
        raise AssertionError("a header was read for the plan")

    reader = RE._RecordingReader({"path": str(tmp_path), "range_bytes": "4096"})
    with monkeypatch.context() as m:
        m.setattr(RE, "read_header", closed)
        parts = reader.partitions()
    assert sum(len(p.parts) for p in parts) == 40
    rows = [r for p in parts for b in reader.read(p) for r in b.select(["subject_id", "epoch_idx", "label", "error"]).to_pylist()]
    assert {r["subject_id"] for r in rows} == set(range(300100, 300140)) and not any(r["error"] for r in rows)
    assert len(rows) == 40 * 2 * len(SIGNALS)
