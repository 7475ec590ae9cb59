"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightjar.llm.common import arrow_map, cut_lineage, small_batches, typed
from nightjar.llm.text import LOWER, Rolling, blocks, mix, shingle_hashes

UNIT = 1 << 20
_KIND = np.full(256, 2, np.uint8)  # marks
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def ngram_buckets(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every unigram (lower-cased) and bigram (as written) of a block.

    Tokens are runs of letters and digits and runs of other visible characters.
    """
    n, kind = len(data), _KIND[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[1:n] |= kind[1:] != kind[:-1]
    cuts = np.flatnonzero(edge)
    start, end = cuts[:-1], cuts[1:]
    seen = kind[start] > 0
    start, end = start[seen], end[seen]
    text = np.searchsorted(offsets, start, "right") - 1
    size = (end - start).astype(np.uint64)
    one = mix(Rolling(LOWER[data]).slices(start, end) + size)
    two = mix(shingle_hashes(mix(Rolling(data).slices(start, end) + size), 2) + np.uint64(7))
    same = text[1:] == text[:-1]
    bucket = np.concatenate([one, two[same]]) >> np.uint64(64 - bits)
    return np.concatenate([text, text[1:][same]]), bucket.astype(np.int64)


@dataclass
class Model:
    """Log ratio of target to raw frequency per bucket, and the cut that separates the held-out labelled rows best."""

    ratios: np.ndarray
    bits: int
    damping: float
    cut: float = -math.inf

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean log ratio per n-gram, damped for short texts, and the number of n-grams."""
        text, bucket = ngram_buckets(data, offsets, self.bits)
        total = np.bincount(text, weights=self.ratios[bucket], minlength=len(offsets) - 1)
        n = np.bincount(text, minlength=len(offsets) - 1)
        return total / (n + self.damping), n


def _labelled(labels: DataFrame, limit: int, is_target: Column, is_other: Column) -> dict[int, str]:
    """At most ``limit`` labelled ids, by the order of their hash: two thirds to fit on, the rest to set the cut with."""
    use = F.when(is_target, F.when(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) < 2, "fit").otherwise("target")).when(is_other, "other")
    rows = labels.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), use.alias("use")).where("use is not null")
    return {r.doc_id: r.use for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "use").limit(limit).collect()}


def _counts(docs: DataFrame, labelled: dict[int, str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts per bucket over all documents, and over the labelled target documents."""
    def run(batches):
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for part, data, offsets in blocks(batches, "text", UNIT):
            text, bucket = ngram_buckets(data, offsets, bits)
            raw += np.bincount(bucket, minlength=1 << bits)
            fit = np.array([labelled.get(d) == "fit" for d in part.column("doc_id").to_pylist()], bool)
            target += np.bincount(bucket[fit[text]], minlength=1 << bits)
        own = np.flatnonzero(raw)
        yield pa.table([pa.array(own, pa.int32()), pa.array(raw[own]), pa.array(target[own])], names=["bucket", "raw", "target"])

    rows = arrow_map(docs, run, "bucket int, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    for r in rows:  # one row per bucket: bounded by the model's size
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    return raw, target


def _scored(docs: DataFrame, model: Model, labelled: dict[int, str]) -> DataFrame:
    def run(batches):
        for part, data, offsets in blocks(batches, "text", UNIT):
            score, n = model.scores(data, offsets)
            use = [labelled.get(d) for d in part.column("doc_id").to_pylist()]
            yield pa.table([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(score, pa.float64()), pa.array(use, pa.string())],
                           names=["doc_id", "n_ngrams", "log_ratio", "use"])

    return arrow_map(docs, run, "doc_id bigint, n_ngrams bigint, log_ratio double, use string")


def _best_cut(target: np.ndarray, other: np.ndarray, care: float) -> float:
    """The cut with the least care * (share of target below) + (share of others above), midway between two scores."""
    if not len(target) or not len(other):
        return -math.inf
    at = np.unique(np.concatenate([target, other]))
    at = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2])
    lost = np.searchsorted(np.sort(target), at) / len(target)
    kept = 1 - np.searchsorted(np.sort(other), at) / len(other)
    return float(at[np.argmin(care * lost + kept)])


def _kth_largest(keys: DataFrame, k: int, bins: int = 1024, few: int = 10_000) -> float:
    """The exact k-th largest ``key``, by histograms that close in on it; never more than ``few`` rows are collected."""
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while True:
        width = (hi - lo) / bins
        inside = keys.where((F.col("key") >= lo) & (F.col("key") <= hi))
        if width <= abs(hi) * 1e-15:
            return lo
        bin_of = F.least(F.floor((F.col("key") - lo) / width), F.lit(bins - 1))
        counts = inside.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for r in sorted(counts, key=lambda r: -r.b):
            if above + r.n >= k:
                lo, hi = r.lo, r.hi
                break
            above += r.n
        if r.n <= few:
            rows = keys.where((F.col("key") >= lo) & (F.col("key") <= hi)).select("key").collect()
            return sorted((x.key for x in rows), reverse=True)[k - above - 1]


def gumbel(seed: int) -> Column:
    """A standard Gumbel draw from the document id."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


@dataclass
class Sample:
    """A fitted model, every document's score and key, and the least key that is kept."""

    model: Model
    scored: DataFrame
    least: float
    sharpness: float
    seed: int

    def key(self) -> Column:
        return F.lit(self.sharpness) * F.col("log_ratio") + F.coalesce(gumbel(self.seed), F.lit(0.0))

    def keep(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` with a kept key, all columns as they are: texts are scored again, not shuffled."""
        model = self.model
        small_batches(docs.sparkSession)

        @F.arrow_udf("double")
        def log_ratio(text: pa.Array) -> pa.Array:
            rows = pa.RecordBatch.from_arrays([text], names=["text"])
            parts = [model.scores(data, offsets)[0] for _, data, offsets in blocks(iter([rows]), "text", UNIT)]
            return pa.array(np.concatenate(parts) if parts else np.zeros(0))

        noise = F.coalesce(gumbel(self.seed), F.lit(0.0))
        return docs.where(F.lit(self.sharpness) * log_ratio(F.col("text").cast("string")) + noise >= F.lit(self.least))


def fit(docs: DataFrame, labels: DataFrame, is_target: str = "quality = 1 and toxic = 0", is_other: str = "quality = 0", sharpness: float = 256.0,
        bits: int = 17, prior: float = 3.0, damping: float = 8.0, care: float = 5.0, labelled_limit: int = 60_000, seed: int = 5) -> Sample:
    """Models of target and raw text and the Gumbel top-k of ``docs`` (doc_id, text); ``resample`` says more."""
    docs = typed(docs, doc_id="bigint", text="string")
    labelled = _labelled(labels, labelled_limit, F.expr(is_target), F.expr(is_other))
    raw, target = _counts(docs, labelled, bits)
    share = target.sum() / max(1.0, raw.sum())
    sample = Sample(Model(np.log((target + prior) / (raw * share + prior)), bits, damping), docs, -math.inf, sharpness, seed)
    sample.scored = cut_lineage(_scored(docs, sample.model, labelled).withColumn("key", sample.key()))
    held = sample.scored.where("use <> 'fit'").select("use", "log_ratio").collect() if set(labelled.values()) >= {"fit", "target", "other"} else []
    cut = _best_cut(*[np.array([r.log_ratio for r in held if r.use == u]) for u in ("target", "other")], care)
    k = sample.scored.where(F.col("log_ratio") > cut).count() if math.isfinite(cut) else 0
    if k:
        sample.least = _kth_largest(sample.scored.select("key"), k)
    return sample


def resample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Importance resampling of ``docs`` (doc_id, text) towards the target rows of ``labels`` (doc_id, ...).

    One row per row of ``docs``: doc_id, n_ngrams, log_ratio, key, kept. Uni- and bigrams are hashed into
    2^bits buckets; the raw model counts all documents, the target model the labelled target documents.
    A bucket's log ratio is log((target + prior) / (expected + prior)) with the target count that the
    raw model expects, so rare n-grams weigh little. ``log_ratio`` is a document's mean over its n-grams,
    and its key is ``sharpness`` times that plus a Gumbel draw; the k largest keys are a sample without
    replacement by importance weight. k is the number of documents above the cut that separates labelled
    rows best, target rows counting ``care`` times.

    At most ``labelled_limit`` labelled rows are used (the bounded sample; two thirds of its target rows
    fit the model, all other rows set the cut). Without target or without other rows everything is kept.
    A null, empty or blank text has no n-grams and log ratio 0. Rows with equal doc_id and text get equal
    keys and stay or go together; rows whose key ties with the last one kept are kept. A null doc_id is
    scored like any other. An empty table gives an empty one; extra columns are ignored.
    """
    sample = fit(docs, labels, **options)
    return sample.scored.select("doc_id", "n_ngrams", "log_ratio", "key", (F.col("key") >= F.lit(sample.least)).alias("kept"))
