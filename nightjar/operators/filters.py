"""Recursive filters over nights cut into chunks: the state at every border comes from a scan of affine maps.

A chunk of n samples turns the state s before it into A^n s + b, where b is its end state from rest. The b of all
chunks, a few numbers each, are composed in order; then every chunk runs from its true start state. Forward
and backward this equals one serial recursion over the night, at any chunk size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.functions import kernels
from nightjar.operators.running import grouped_quantiles
from nightjar.session import cut_lineage

SERIES = ["subject_id", "channel"]


def _filled(chunks: DataFrame) -> DataFrame:
    """Missing samples become the median of their own series; a series without any value becomes zero."""
    missing = chunks.where(F.exists("samples", lambda v: v.isNull() | F.isnan(v)))
    if missing.isEmpty():
        return chunks
    holed = chunks.join(missing.select(*SERIES).distinct(), SERIES, "left_semi")
    values = holed.select(*SERIES, F.explode("samples").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    fill = grouped_quantiles(values, SERIES, "v", {"fill": 0.5}).select(*SERIES, "fill")
    value = F.coalesce("fill", F.lit(0.0))
    whole = F.transform("samples", lambda v: F.when(v.isNull() | F.isnan(v), value).otherwise(v))
    return chunks.join(fill, SERIES, "left").withColumn("samples", whole).drop("fill")


def _start_states(ends: DataFrame, recursion: kernels.Recursion, backward: bool) -> DataFrame:
    """(series, _chunk, start) from the chunks' end states from rest: one small row a chunk, composed in order of time."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk", ascending=not backward)
        state = recursion.steady * float(pdf["edge"].iloc[0])
        out = []
        for n, rest in zip(pdf["n"], pdf["rest"]):
            out.append(state)
            state = recursion.power(int(n)) @ state + np.asarray(rest)
        return pdf[[*SERIES, "_chunk"]].assign(start=pd.Series([s.tolist() for s in out], index=pdf.index, dtype=object))

    schema = T.StructType([*ends.select(*SERIES, "_chunk").schema, T.StructField("start", T.ArrayType(T.DoubleType()))])
    return ends.select(*SERIES, "_chunk", "n", "rest", "edge").groupBy(*SERIES).applyInPandas(scan, schema)


def filtered_chunks(chunks: DataFrame, fs: float, lo: float, hi: float, size: int = 20) -> DataFrame:
    """Zero-phase Butterworth band-pass of every (subject_id, channel): the recursion runs forward, then backward.

    ``chunks``: (subject_id, channel, epoch_idx, samples). Both ends of a night are extended by odd reflection and start from
    the steady state, as for one long array. Epochs that are absent are passed over. No task holds more than ``size``
    epochs of one channel; missing samples become the night's median; a band outside (0, Nyquist) leaves the signal as it is.
    """
    d = chunks.select(*SERIES, "epoch_idx", F.col("samples").cast("array<double>").alias("samples"))
    if not 0 < lo < hi < fs / 2:
        return d
    recursion = kernels.Recursion(kernels.bandpass_sections(fs, lo, hi))
    edge = recursion.edge
    d = _filled(d).withColumn("_chunk", F.floor(F.col("epoch_idx") / size))
    ends_of = d.groupBy(*SERIES).agg(F.min("_chunk").alias("_first"), F.max("_chunk").alias("_last"))
    key = d.select(*SERIES, "_chunk").schema.fields
    numbers, double = T.ArrayType(T.DoubleType()), T.DoubleType()
    piece = T.StructType([*key, T.StructField("epochs", T.ArrayType(T.IntegerType())), T.StructField("x", numbers), T.StructField("head", T.IntegerType()),
                          T.StructField("tail", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("rest", numbers), T.StructField("edge", double)])

    def gathered(pdf: pd.DataFrame) -> pd.DataFrame:
        """One row a chunk: its samples with the extension at the night's ends, and its end state from rest."""
        pdf = pdf.sort_values("epoch_idx")
        x = np.concatenate([np.asarray(s, float) for s in pdf["samples"]])
        row = pdf.iloc[0]
        head = min(edge, x.size - 1) if row["_chunk"] == row["_first"] else 0
        tail = min(edge, x.size - 1) if row["_chunk"] == row["_last"] else 0
        x = np.concatenate([2 * x[0] - x[head:0:-1], x, 2 * x[-1] - x[-2:-tail - 2:-1]])
        return pd.DataFrame([{**{c: row[c] for c in [*SERIES, "_chunk"]}, "epochs": pdf["epoch_idx"].tolist(), "x": x, "head": head, "tail": tail, "n": x.size,
                              "rest": recursion.end_from_rest(x), "edge": x[0]}])

    def forward(batches):
        for pdf in batches:
            y = [recursion.run(np.asarray(x), np.asarray(s)) for x, s in zip(pdf["x"], pdf["start"])]
            yield pdf.drop(columns="start").assign(x=pd.Series(y, index=pdf.index, dtype=object), edge=[v[-1] for v in y],
                                                   rest=pd.Series([recursion.end_from_rest(v[::-1]) for v in y], index=pdf.index, dtype=object))

    def backward(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                y = recursion.run(np.asarray(row["x"])[::-1], np.asarray(row["start"]))[::-1]
                y = y[row["head"]:y.size - row["tail"]].reshape(len(row["epochs"]), -1)
                yield pd.DataFrame({**{c: row[c] for c in SERIES}, "epoch_idx": np.asarray(row["epochs"], np.int32), "samples": pd.Series(list(y), dtype=object)})

    by = [*SERIES, "_chunk"]
    one = cut_lineage(d.join(ends_of, SERIES).groupBy(*by).applyInPandas(gathered, piece))
    two = cut_lineage(one.join(_start_states(one, recursion, False), by).mapInPandas(forward, T.StructType([*piece.fields])))
    out = T.StructType([*chunks.select(*SERIES).schema, T.StructField("epoch_idx", T.IntegerType()), T.StructField("samples", numbers)])
    return two.join(_start_states(two, recursion, True), by).select(*SERIES, "epochs", "x", "head", "tail", "start").mapInPandas(backward, out)
