"""Cubic splines through long runs of knots: a tridiagonal system solved in chunks.

Every chunk eliminates its own unknowns, which leaves each as p + q * left + r * right in the two neighbouring
unknowns outside the chunk. The first and last unknowns of all chunks make a small system of their own, solved in one
sweep per run, and its solution is put back into the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightjar.operators.chunks import chunk_window, own_rows, with_halo
from nightjar.session import cut_lineage

RUN = ["subject_id", "segment"]


def eliminate(a: np.ndarray, b: np.ndarray, c: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Rows (p, q, r): the unknowns of one stretch in terms of the unknown before it and the one behind it.

    ``a``, ``b``, ``c`` are the lower, main and upper diagonal; a[0] and c[-1] reach out of the stretch.
    """
    n = len(b)
    up, known = [0.0] * n, [(0.0, 0.0)] * n
    before, held = 0.0, (0.0, 0.0)
    lower, upper = a.tolist(), c.tolist()
    for i, (x, y, z) in enumerate(zip(b.tolist(), upper, rhs.tolist())):
        low = lower[i] if i else 0.0
        pivot = x - low * before
        held = ((z - low * held[0]) / pivot, ((0.0 if i else -lower[0]) - low * held[1]) / pivot)
        before = y / pivot
        up[i], known[i] = before, held
    out = np.empty((n, 3))
    p, q, r = known[-1][0], known[-1][1], -up[-1]
    out[-1] = p, q, r
    for i in range(n - 2, -1, -1):
        p, q, r = known[i][0] - up[i] * p, known[i][1] - up[i] * q, -up[i] * r
        out[i] = p, q, r
    return out


def border_values(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per chunk of one run the unknown before it and the one behind it, from the chunks' first and last (p, q, r); 0 at the run's ends."""
    n = len(first)
    alpha, beta = np.zeros(n + 1), np.zeros(n + 1)  # the unknown before chunk k is alpha + beta * (first unknown of chunk k)
    for k in range(n):
        p, q, r = last[k]
        fp, fq, fr = first[k]
        free = 1 - fq * beta[k]
        gain = q * beta[k] / free
        alpha[k + 1] = p + q * alpha[k] + gain * (fp + fq * alpha[k])
        beta[k + 1] = r + gain * fr
    before, behind = np.zeros(n), np.zeros(n)
    value = 0.0
    for k in range(n - 1, -1, -1):
        behind[k] = value
        fp, fq, fr = first[k]
        value = (fp + fq * alpha[k] + fr * value) / (1 - fq * beta[k])
        before[k] = alpha[k] + beta[k] * value
    return before, behind


def _system() -> dict[str, Column]:
    """Diagonals and right side for the slopes of the cubic spline whose first two and last two pieces are one cubic each."""
    t, v = F.col("t"), F.col("v")
    step = lambda a, b: F.col(b) - F.col(a)
    hl, hr = step("_t_p1", "t"), step("t", "_t_n1")
    dl, dr = (v - F.col("_v_p1")) / hl, (F.col("_v_n1") - v) / hr
    hl2, hr2 = step("_t_p2", "_t_p1"), step("_t_n1", "_t_n2")
    dl2, dr2 = step("_v_p2", "_v_p1") / hl2, step("_v_n1", "_v_n2") / hr2
    first, last = F.col("_t_p1").isNull(), F.col("_t_n1").isNull()
    pick = lambda at_first, at_last, inside: F.when(first, at_first).when(last, at_last).otherwise(inside)
    return {"_a": pick(F.lit(0.0), hl + hl2, hr), "_b": pick(hr2, hl2, 2 * (hl + hr)), "_c": pick(hr + hr2, F.lit(0.0), hl),
            "_y": pick(((3 * hr + 2 * hr2) * hr2 * dr + hr * hr * dr2) / (hr + hr2), (hl * hl * dl2 + (3 * hl + 2 * hl2) * hl2 * dl) / (hl + hl2), 3 * (hr * dl + hl * dr))}


def solve_runs(batches):
    """(subject_id, segment, beat, _chunk, _cut, p, q, r) from sorted rows of the system, run after run; only the rows of an open run are held over."""
    keys, held = ["subject_id", "segment", "beat", "_chunk", "_cut"], None

    def solved(t: pa.Table, cuts: list[int]) -> pa.RecordBatch:
        a, b, c, y = (t.column(x).to_numpy() for x in ("_a", "_b", "_c", "_y"))
        out = np.concatenate([eliminate(a[i:j], b[i:j], c[i:j], y[i:j]) for i, j in zip(cuts[:-1], cuts[1:])])
        t = t.select(keys)
        for k, name in enumerate(("p", "q", "r")):
            t = t.append_column(name, pa.array(out[:, k]))
        return t.combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = (pa.concat_tables([held, t]) if held is not None else t).combine_chunks()
        new = np.zeros(len(t) - 1, bool)
        for c in (*RUN, "_chunk"):
            x = t.column(c)
            new |= pc.not_equal(x.slice(1), x.slice(0, len(t) - 1)).to_numpy()
        cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
        if len(cuts) > 1:
            yield solved(t.slice(0, cuts[-1]), cuts)
        held = t.slice(cuts[-1])
    if held is not None:
        yield solved(held, [0, len(held)])


def spline_slopes(knots: DataFrame, min_points: int = 4, size: int = 20_000) -> DataFrame:
    """``knots`` (subject_id, beat, t, v, segment; contiguous ``beat``) with ``_slope``, the spline's slope at each knot.

    A segment is one run; those of fewer than ``min_points`` knots (four at least) get no slope. No task holds more than
    ``size`` knots of a run at once. A run inside one chunk is solved there; only runs over several chunks meet again, one small row a chunk.
    ``knots`` is read three times, so pass a table that is already written.
    """
    if size < 2:
        raise ValueError("a chunk holds two knots at least: that is how far the first and last equations reach")
    home = F.floor(F.col("beat") / size)
    long = knots.groupBy(*RUN).agg(F.count("*").alias("_m"), (F.max(home) > F.min(home)).alias("_cut")).where(F.col("_m") >= max(4, min_points))
    d = with_halo(knots.select("subject_id", "beat", "t", "v", "segment"), "beat", size, before=2, after=2)
    w = chunk_window(["subject_id"], "beat")
    for k, name in ((-2, "p2"), (-1, "p1"), (1, "n1"), (2, "n2")):
        near = lambda c: F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w)  # noqa: B023, E731
        d = d.withColumns({f"_{c}_{name}": F.when(near("segment") == F.col("segment"), near(c)) for c in ("t", "v")})
    rows = own_rows(d).join(long, RUN).withColumns(_system()).withColumn("_chunk", home)
    rows = rows.select("subject_id", "segment", "beat", "_chunk", "_cut", "_a", "_b", "_c", "_y")
    solved = T.StructType([*rows.schema.fields[:5], *(T.StructField(c, T.DoubleType()) for c in ("p", "q", "r"))])
    rows = rows.repartition("subject_id", "_chunk").sortWithinPartitions("subject_id", "_chunk", "beat")
    rows = cut_lineage(rows.mapInArrow(solve_runs, solved))
    pqr = F.array("p", "q", "r")
    parted = rows.where("_cut")
    borders = parted.groupBy(*RUN, "_chunk").agg(F.min_by(pqr, "beat").alias("first"), F.max_by(pqr, "beat").alias("last"))

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        before, behind = border_values(np.stack(pdf["first"]), np.stack(pdf["last"]))
        return pdf[[*RUN, "_chunk"]].assign(before=before, behind=behind)

    outer = T.StructType([*borders.select(*RUN, "_chunk").schema, T.StructField("before", T.DoubleType()), T.StructField("behind", T.DoubleType())])
    ends = borders.groupBy(*RUN).applyInPandas(sweep, outer)
    slope = F.col("p") + F.col("q") * F.col("before") + F.col("r") * F.col("behind")
    slopes = rows.where("NOT _cut").select("subject_id", "beat", F.col("p").alias("_slope")).unionByName(
        parted.join(ends, [*RUN, "_chunk"]).select("subject_id", "beat", slope.alias("_slope")))
    return knots.join(slopes, ["subject_id", "beat"], "left")
