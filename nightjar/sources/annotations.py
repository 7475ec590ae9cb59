"""Scored-event XML: stage runs, respiratory events and an audit of the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar.functions.expressions import EVENT_BITS

# Stage code after the bar in a stage concept.
STAGE_OF_CODE = {"0": "W", "1": "N1", "2": "N2", "3": "N3", "4": "N3", "5": "REM", "9": "?"}
SCHEMA = "EventType string, EventConcept string, Name string, Start string, Duration string"


def read_scored_events(spark: SparkSession, path: str, subject: str = r"(\d{6})") -> DataFrame:
    """All scored records with the subject id taken from the file path and their order in the file.

    Annotation files are far below the split size, so a file is read by one task and the row ids
    follow its order.
    """
    raw = spark.read.format("xml").option("rowTag", "ScoredEvent").schema(SCHEMA).option("recursiveFileLookup", "true").load(path)
    concept = F.trim(F.coalesce("EventConcept", "Name", F.lit("")))
    return raw.select(
        F.regexp_extract(F.col("_metadata.file_path"), subject, 1).cast("int").alias("subject_id"),
        F.trim(F.coalesce("EventType", F.lit(""))).alias("event_type"), concept.alias("concept"),
        F.col("Start").try_cast("double").alias("start_sec"), F.col("Duration").try_cast("double").alias("duration_sec"),
        F.monotonically_increasing_id().alias("seq")).where("start_sec IS NOT NULL AND duration_sec IS NOT NULL")


def stage_runs(scored: DataFrame) -> DataFrame:
    """Stage records: the code after the bar, unknown codes as '?'."""
    parts = F.split("concept", r"\|")
    code = F.when(F.size(parts) == 2, F.trim(parts[1])).otherwise("9")
    stage = F.element_at(F.create_map(*[F.lit(x) for kv in STAGE_OF_CODE.items() for x in kv]), code)
    return scored.where(F.col("event_type").startswith("Stages")).select(
        "subject_id", "start_sec", "duration_sec", F.coalesce(stage, F.lit("?")).alias("stage"), F.col("seq").alias("run_seq"))


def _primary():
    return F.trim(F.split("concept", r"\|")[0])


def respiratory_events(scored: DataFrame) -> DataFrame:
    """The four scored respiratory kinds as interval events."""
    return scored.where(~F.col("event_type").startswith("Stages") & _primary().isin(*EVENT_BITS)).select(
        "subject_id", "start_sec", "duration_sec", _primary().alias("kind"), F.col("seq").alias("event_seq"))


def ignored_concepts(scored: DataFrame) -> DataFrame:
    """Respiratory-typed records outside the four kinds, counted for the audit."""
    return scored.where(~F.col("event_type").startswith("Stages") & F.col("event_type").contains("Respiratory")
                        & ~_primary().isin(*EVENT_BITS)).groupBy(_primary().alias("concept")).agg(F.count("*").alias("n"))
