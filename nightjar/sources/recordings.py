"""EDF recordings <-> signal chunks: one row per (subject, channel, epoch) with native-rate samples.

The data source ``edf`` plans from names and sizes; only a file beyond one task's share has its header read for the
plan. A file is cut into ranges of epochs, and a task holds the bytes of one range at a time, so a recording of any
size is read by many tasks and the plan grows with the names alone.
"""

from __future__ import annotations

import fnmatch
import math
import posixpath
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from nightjar.functions.expressions import EPOCH_SECONDS
from nightjar.operators.running import dealt

# Aliases per canonical channel in order of preference, candidate airflow labels, native rates.
CHANNEL_ALIASES = {
    "ECG": ("ECG", "EKG"), "THOR": ("THOR RES", "THOR"), "ABDO": ("ABDO RES", "ABDO"), "SPO2": ("SaO2", "SpO2"),
    "HR": ("H.R.", "HR", "PULSE"), "POSITION": ("POSITION",), "OXSTAT": ("OX stat", "OXSTAT"),
    "EEG": ("EEG", "EEG1", "C4"), "AIRFLOW": ("AIRFLOW", "NEW AIR", "nasal"),
}
EXPECTED_RATES = {"ECG": 125.0, "THOR": 10.0, "ABDO": 10.0, "AIRFLOW": 10.0, "SPO2": 1.0, "HR": 1.0, "POSITION": 1.0, "OXSTAT": 1.0}
# EDF header: (field, bytes) of the per-signal block, each stored for all signals in turn
SIGNAL_FIELDS = (("label", 16), ("transducer", 80), ("unit", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8),
                 ("prefilter", 80), ("samples", 8), ("reserved", 32))

CHUNK_SCHEMA = ("path string, subject_id int, channel_index int, label string, unit string, fs double, record_sec double, "
                "gain double, dmin int, dmax int, pmin double, epoch_idx int, samples array<smallint>, note string, error string")


RANGE_BYTES = 16 << 20   # bytes of a file that a task holds at once
SPLIT_BYTES = 128 << 20  # bytes that a task reads, of one file or of many small ones
OPEN_BYTES = 256 << 10   # what opening a small file counts for in a task's share
BATCH_BYTES = 4 << 20    # samples of small ranges that leave a task together


def file_system(path: str):
    """The store of a path and the path inside it; a path without a scheme is local."""
    from pyarrow import fs

    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]+:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", path))
    return fs.LocalFileSystem(), path


def list_recordings(path: str, pattern: str = "*.edf") -> list[tuple[str, int]]:
    """Path and size of every recording in a folder, or of those a path with wildcards names, in name order."""
    from pyarrow import fs

    store, inside = file_system(path)
    info = store.get_file_info(inside)
    if info.type == fs.FileType.File:
        found = [info]
    else:
        folder = inside
        if info.type == fs.FileType.NotFound:
            folder, pattern = posixpath.split(inside)
        found = [i for i in store.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, pattern)]
    scheme = path[:len(path) - len(inside)] if path.endswith(inside) else ""
    return sorted((scheme + i.path, i.size) for i in found)


def parse_header(buf: bytes, file_size: int) -> dict:
    """Fixed and per-signal EDF header fields, with the number of complete records really present."""
    head = buf[:256].decode("latin-1")
    n_signals = int(head[252:256])
    size, n_records, record_sec = int(head[184:192]), int(head[236:244]), float(head[244:252])
    if size != 256 * (n_signals + 1) or len(buf) < size:
        raise ValueError("header size does not match the number of signals")
    out: dict = {"record_sec": record_sec, "size": size}
    at = 256
    for name, width in SIGNAL_FIELDS:
        out[name] = [buf[at + i * width: at + (i + 1) * width].decode("latin-1").strip() for i in range(n_signals)]
        at += width * n_signals
    for name, kind in (("pmin", float), ("pmax", float), ("dmin", int), ("dmax", int), ("samples", int)):
        out[name] = [kind(v) for v in out[name]]
    if any(lo == hi for lo, hi in zip(out["dmin"], out["dmax"])):
        raise ValueError("a signal has an empty digital range")
    per_record = 2 * sum(out["samples"])
    present = (file_size - size) // per_record
    out["note"] = "record count derived from size" if n_records < 0 else "truncated" if present < n_records else ""
    out["n_records"] = present if n_records < 0 else min(n_records, present)
    return out


def read_header(path: str, file_size: int) -> dict:
    """The header of one file: its fixed part tells how many bytes the rest has."""
    store, inside = file_system(path)
    with store.open_input_file(inside) as f:
        head = f.read(256)
        return parse_header(head + f.read(max(0, int(head[184:192]) - 256)), file_size)


def epoch_lengths(header: dict) -> list[int]:
    """Samples per epoch of every signal; an epoch of a signal starts at its multiple of that number."""
    return [round(EPOCH_SECONDS * n / header["record_sec"]) for n in header["samples"]]


def plan_ranges(header: dict, range_bytes: int = RANGE_BYTES) -> list[tuple[int, int]]:
    """Ranges (first, behind the last) of whole epochs that take about ``range_bytes`` of the file each."""
    per = epoch_lengths(header)
    epochs = max((header["n_records"] * n // p for n, p in zip(header["samples"], per) if p), default=0)
    step = max(1, int(range_bytes / (2 * sum(header["samples"]) * EPOCH_SECONDS / header["record_sec"])))
    return [(a, min(a + step, epochs)) for a in range(0, epochs, step)]


def record_span(header: dict, first: int, last: int) -> tuple[int, int]:
    """The records that hold the epochs ``first`` to ``last`` (not included) of all signals."""
    spans = [(first * p // n, min(header["n_records"], -(-last * p // n))) for n, p in zip(header["samples"], epoch_lengths(header)) if p]
    return min(a for a, _ in spans), max(b for _, b in spans)


def decode_range(header: dict, data: bytes, record: int, first: int, last: int, labels: set[str] | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per wanted signal its number, epochs and samples from the bytes of whole records that start at ``record``."""
    width = sum(header["samples"])
    table = np.frombuffer(data, "<i2").reshape(-1, width)
    ends = np.cumsum(header["samples"])
    for i, (n, per, end) in enumerate(zip(header["samples"], epoch_lengths(header), ends)):
        stop = min(last, header["n_records"] * n // per) if per else 0
        if stop > first and (labels is None or header["label"][i] in labels):
            x = np.ascontiguousarray(table[:, end - n:end]).ravel()[first * per - record * n:stop * per - record * n]
            yield i, np.arange(first, stop, dtype=np.int32), x.reshape(-1, per)


@dataclass
class _Ranges(InputPartition):
    """Work of one task: files of ``folder`` as (name, size, first epoch, end); no end means the whole file."""

    folder: str
    parts: list[tuple]


class _RecordingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.pattern = re.compile(options.get("subject", r"(\d{6})"))
        self.labels = set(options["labels"].split("|")) if options.get("labels") else None
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self) -> list[InputPartition]:
        """Small files together, large ones as runs of ranges, about ``split_bytes`` to a task.

        Only headers of files beyond ``split_bytes`` are read, many at a time; all others wait for their task.
        """

        def look(found: tuple[str, int]) -> list[tuple]:
            path, size = found
            name = posixpath.basename(path)
            if size <= self.split_bytes:
                return [(max(size, OPEN_BYTES), name, size, 0, None)]
            try:
                ranges = plan_ranges(read_header(path, size), self.range_bytes)
            except Exception:  # noqa: BLE001 - the task that reads it reports the error
                return [(0, name, size, 0, None)]
            each = max(1, int(self.split_bytes * len(ranges) / size))
            runs = [ranges[i:i + each] for i in range(0, len(ranges), each)]
            return [(size * len(run) / len(ranges), name, size, run[0][0], run[-1][1]) for run in runs]

        listed = list_recordings(self.path)
        folder = posixpath.dirname(listed[0][0]) if listed else ""
        out: list[InputPartition] = []
        held, room = [], 0.0
        with ThreadPoolExecutor(16) as pool:
            for at in range(0, len(listed), 4096):
                for parts in pool.map(look, listed[at:at + 4096]):
                    for cost, *part in parts:
                        held.append(tuple(part))
                        room += cost
                        if room >= self.split_bytes:
                            out.append(_Ranges(folder, held))
                            held, room = [], 0.0
        return out + ([_Ranges(folder, held)] if held else [])

    def read(self, partition: _Ranges) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<smallint>": pa.list_(pa.int16())}
        fields = [(name, kinds[kind]) for name, kind in (c.split() for c in CHUNK_SCHEMA.split(", "))]

        def batch(n: int, **values) -> pa.RecordBatch:
            columns = [values[c] if isinstance(values.get(c), pa.Array) else pa.array([values.get(c)] * n, t) for c, t in fields]
            return pa.RecordBatch.from_arrays(columns, names=[c for c, _ in fields])

        def ranges(name: str, size: int, first: int, end: int | None) -> Iterator[pa.RecordBatch]:
            path = posixpath.join(partition.folder, name)
            hit = self.pattern.search(name)
            subject = int(hit.group(1)) if hit else -1
            try:
                h = read_header(path, size)
                spans = [(a, b) for a, b in plan_ranges(h, self.range_bytes) if a >= first and (end is None or b <= end)]
            except Exception as exc:  # noqa: BLE001 - one bad file must not stop the cohort
                yield batch(1, path=path, subject_id=subject, error=f"{type(exc).__name__}: {exc}")
                return
            width = 2 * sum(h["samples"])
            store, inside = file_system(path)
            for first, last in spans:
                a, b = record_span(h, first, last)
                with store.open_input_file(inside) as f:
                    f.seek(h["size"] + a * width)
                    data = f.read((b - a) * width)
                for i, epochs, x in decode_range(h, data, a, first, last, self.labels):
                    lists = pa.ListArray.from_arrays(np.arange(len(epochs) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
                    yield batch(len(epochs), path=path, subject_id=subject, channel_index=i, label=h["label"][i], unit=h["unit"][i], fs=h["samples"][i] / h["record_sec"],
                                record_sec=h["record_sec"], gain=(h["pmax"][i] - h["pmin"][i]) / (h["dmax"][i] - h["dmin"][i]), dmin=h["dmin"][i], dmax=h["dmax"][i],
                                pmin=h["pmin"][i], epoch_idx=pa.array(epochs), samples=lists, note=h["note"])

        held, room = [], 0
        for part in partition.parts:
            for found in ranges(*part):
                held.append(found)
                room += found.nbytes
                if room >= BATCH_BYTES:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, room = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class RecordingSource(DataSource):
    """``spark.read.format("edf").load(folder)``; options: labels (joined by |), subject, range_bytes, split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "edf"

    def schema(self) -> str:
        return CHUNK_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _RecordingReader(dict(self.options))


def read_recordings(spark: SparkSession, path: str, subject: str = r"(\d{6})", labels: list[str] | None = None,
                    range_bytes: int = RANGE_BYTES, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Whole 30 s epochs of every channel of every EDF file under ``path``; the tail below 30 s is dropped.

    Files are read as ranges of epochs; a task holds one range at a time and decodes the channels named by
    ``labels``, by default all. A file that cannot be read yields one row with ``error`` set
    instead of failing the job.
    """
    spark.dataSource.register(RecordingSource)
    reader = spark.read.format("edf").option("subject", subject).option("range_bytes", range_bytes).option("split_bytes", split_bytes)
    return (reader.option("labels", "|".join(labels)) if labels else reader).load(path)


def export_recordings(chunks: DataFrame, folder: str) -> DataFrame:
    """Write one EDF file per subject, an epoch to a record; returns (subject_id, path, n_records) of what was written.

    ``chunks`` has the columns of ``read_recordings`` with whole numbers of samples per epoch. Rows arrive sorted
    by epoch, so a task holds one record; a file appears under its name when it is complete. Samples of an
    epoch that a channel lacks are written as its digital minimum.
    """
    signals = chunks.groupBy("subject_id").agg(
        F.sort_array(F.collect_set(F.struct("channel_index", "label", "unit", "fs", "gain", "dmin", "dmax", "pmin"))).alias("signals"),
        (F.max("epoch_idx") + 1).alias("n_records"))
    rows = chunks.select("subject_id", "epoch_idx", "channel_index", "samples").join(signals, "subject_id")
    rows = dealt(rows, "subject_id").sortWithinPartitions("subject_id", "epoch_idx", "channel_index")

    def header(own: list[dict], n_records: int) -> bytes:
        text = lambda v, width: str(v)[:width].ljust(width).encode("latin-1", "replace")
        out = b"".join(text(v, w) for v, w in (("0", 8), ("", 160), ("01.01.0000.00.00", 16), (256 * (len(own) + 1), 8), ("", 44), (n_records, 8), (EPOCH_SECONDS, 8), (len(own), 4)))
        number = lambda v: text(f"{v:.8g}", 8)
        per = {"label": lambda s: text(s["label"], 16), "unit": lambda s: text(s["unit"] or "", 8), "pmin": lambda s: number(s["pmin"]),
               "pmax": lambda s: number(s["pmin"] + s["gain"] * (s["dmax"] - s["dmin"])), "dmin": lambda s: text(s["dmin"], 8),
               "dmax": lambda s: text(s["dmax"], 8), "samples": lambda s: text(round(s["fs"] * EPOCH_SECONDS), 8)}
        return out + b"".join(per.get(name, lambda s, w=width: b" " * w)(s) for name, width in SIGNAL_FIELDS for s in own)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inside = file_system(folder)
        store.create_dir(inside, recursive=True)
        subject, epoch, stream, blank, done = None, -1, None, [], []

        def flush(until: int) -> None:
            nonlocal epoch, record
            while epoch < until:
                stream.write(b"".join(x.tobytes() for x in record))
                epoch, record = epoch + 1, list(blank)

        def close() -> pa.RecordBatch:
            flush(n_records)
            stream.close()
            store.move(f"{target}.part", target)
            return pa.RecordBatch.from_pylist([{"subject_id": subject, "path": f"{folder}/{subject:06d}.edf", "n_records": n_records}], pa.schema([("subject_id", pa.int32()), ("path", pa.string()), ("n_records", pa.int32())]))

        record: list[np.ndarray] = []
        n_records, target, place = 0, "", {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["subject_id"] != subject:
                    if subject is not None:
                        yield close()
                    subject, n_records, own = row["subject_id"], row["n_records"], row["signals"]
                    target = f"{inside}/{subject:06d}.edf"
                    stream = store.open_output_stream(f"{target}.part")
                    stream.write(header(own, n_records))
                    blank = [np.full(round(s["fs"] * EPOCH_SECONDS), s["dmin"], "<i2") for s in own]
                    place = {s["channel_index"]: i for i, s in enumerate(own)}
                    epoch, record = 0, list(blank)
                flush(row["epoch_idx"])
                record[place[row["channel_index"]]] = np.array(row["samples"], "<i2")
        if subject is not None:
            yield close()

    return rows.mapInArrow(write, "subject_id int, path string, n_records int")


def with_chunk_quality(chunks: DataFrame) -> DataFrame:
    """Add per chunk: ``rail_frac``, the share of samples at the digital limits, and ``spread_lsb``, their standard deviation in digital steps."""
    n = F.size("samples")
    at_rail = F.size(F.filter("samples", lambda x: (x <= F.col("dmin")) | (x >= F.col("dmax"))))
    total = lambda f: F.aggregate(F.transform("samples", f), F.lit(0.0), lambda acc, x: acc + x)
    centred = chunks.withColumn("_mean", total(lambda x: x.cast("double")) / n)
    square = lambda x: (x - F.col("_mean")) * (x - F.col("_mean"))
    return centred.withColumn("rail_frac", at_rail / n).withColumn("spread_lsb", F.sqrt(total(square) / n)).drop("_mean")


def write_recordings(chunks: DataFrame, path: str) -> None:
    """The chunk table with its quality, partitioned by channel label so that one-channel features read one folder.

    Rows are dealt by channel, subject and blocks of epochs: a long night is written by many tasks.
    """
    block = F.floor(F.col("epoch_idx") / 512)
    good = with_chunk_quality(chunks.where("error IS NULL"))
    good.repartition("label", "subject_id", block).write.partitionBy("label").mode("overwrite").parquet(path)


def alias_table(spark: SparkSession) -> DataFrame:
    rows = [(a, c, i) for c, names in CHANNEL_ALIASES.items() for i, a in enumerate(names)]
    return spark.createDataFrame(rows, "alias string, canonical string, priority int")


def canonical_channels(chunks: DataFrame) -> DataFrame:
    """Physical-unit samples of the chosen channel per canonical name.

    Airflow candidates compete by whole-night spread, every other channel goes to its first alias.
    """
    from nightjar.operators.signals import channel_spread, pick_alias, pick_live_channel, to_physical

    good = chunks.where("error IS NULL")
    listed = good.select("subject_id", "channel_index", "label").distinct()
    picked = pick_alias(listed, alias_table(chunks.sparkSession)).where("canonical <> 'AIRFLOW'").select("subject_id", "channel_index", "canonical")
    air = good.where(F.upper(F.trim("label")).isin(*[a.upper() for a in CHANNEL_ALIASES["AIRFLOW"]]))
    live = pick_live_channel(channel_spread(air, ["subject_id", "channel_index", "label"])).where("ok").select(
        "subject_id", "channel_index", F.lit("AIRFLOW").alias("canonical"))
    d = good.join(picked.unionByName(live), ["subject_id", "channel_index"])
    return d.select("subject_id", F.col("canonical").alias("channel"), "fs", "epoch_idx", to_physical("samples", "gain", "dmin", "pmin").alias("samples"))
