"""A training corpus from ``documents``: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes all that its predecessor kept, written as Parquet and read again; all but the last
return the columns of ``documents``. A text that a stage shortens gets its new ``n_chars``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar.llm.common import cut_lineage, read, tokenizer_path
from nightjar.llm.decontaminate import contamination
from nightjar.llm.lines import dedup_lines_sparing_copies
from nightjar.llm.minhash import near_duplicates
from nightjar.llm.packing import pack
from nightjar.llm.quality import fit


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the importance resample towards the labelled good documents."""
    return fit(docs, read(spark, sf_dir, "labels")).keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines found in ten or more documents; a document left without text goes.

    Copies of one another keep the lines that stand in them alone: near-dedup chooses one of them.
    """
    out = dedup_lines_sparing_copies(docs, min_docs=10)
    kept = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^ \t\n\x0b\f\r]"))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group: five-word shingles, similarity 0.8 or more."""
    gone = near_duplicates(docs, k=5, percent=80).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item within a fifth of its words in edits."""
    hits = cut_lineage(contamination(docs, read(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    return docs.join(hits, "doc_id", "left_anti").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 4096-id sequences."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("decontamination", decontaminate), ("packing", packing)]

#: Random walks, hashed models and a tokenizer have no SQL counterpart; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
