"""License scans by diagonal voting over word k-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.llm.common import arrow_map, cut_lineage, typed
from nightjar.llm.text import LOWER, blocks, shingle_hashes, word_hashes

UNIT = 1 << 20
SUMMARY = 0  # the key of the one row that says how many words a document has

#: Words are runs of digits, lower-case letters and everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

# Phrases that name a license by themselves.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# Sentences of public license notices, which may be quoted with small changes.
NOTICES = [
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
]


def gram_keys(text: str, k: int) -> np.ndarray:
    """Keys of the k-grams of a template, as the documents' ones are made."""
    data = np.frombuffer(text.encode(), np.uint8)
    return _keys(word_hashes(LOWER[data], np.array([0, len(data)]), WORD)[3], k)


def _keys(words: np.ndarray, k: int) -> np.ndarray:
    return (shingle_hashes(words, k) | np.uint64(1)).view(np.int64)


def _grams(docs: DataFrame, k: int) -> DataFrame:
    """All rolling k-grams (row, place, key) of all documents, and one SUMMARY row per document with its id and word count."""
    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for part, data, offsets in blocks(batches, "text", UNIT):
            _, _, text, words = word_hashes(LOWER[data], offsets, WORD)
            n = len(offsets) - 1
            bounds = np.searchsorted(text, np.arange(n + 1))
            keys = _keys(words, k)
            inside = np.flatnonzero(text[:len(keys)] == text[k - 1:]) if len(keys) else np.zeros(0, np.int64)
            yield pa.table([
                pa.array(np.concatenate([row + text[inside], row + np.arange(n)])), pa.array(np.concatenate([inside - bounds[text[inside]], np.diff(bounds)])),
                pa.array(np.concatenate([keys[inside], np.full(n, SUMMARY)])), pa.concat_arrays([pa.nulls(len(inside), pa.int64()), part.column("doc_id")]),
            ], names=["row", "place", "key", "doc_id"])
            row += n

    return arrow_map(typed(docs, doc_id="bigint", text="string"), run, "row bigint, place bigint, key bigint, doc_id bigint")


def closest(spans: DataFrame, longest: int) -> DataFrame:
    """Spans (row, first_word, last_word, closeness, ...) that no closer span of the same row overlaps.

    Spans have at most ``longest`` words, so two that overlap meet in a cell of that many words: the join is on (row, cell) and
    a cell holds the spans of two notices' length only.
    """
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("first_word") / longest), F.floor(F.col("last_word") / longest))))
    best = cells.groupBy("row", "cell", "first_word", "last_word").agg(F.max("closeness").alias("closer"))
    best = best.select("row", "cell", F.col("first_word").alias("o_first"), F.col("last_word").alias("o_last"), "closer")
    beaten = cells.join(best, ["row", "cell"]).where(
        (F.col("o_first") <= F.col("last_word")) & (F.col("o_last") >= F.col("first_word")) & (F.col("closer") > F.col("closeness")))
    keys = ["row", "label", "first_word", "last_word"]
    return spans.join(beaten.select(*keys).distinct(), keys, "left_anti")


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES, k: int = 3, slack: int = 4,
         least: float = 0.75, broadcast_limit: int = 200_000) -> DataFrame:
    """License evidence per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, and ``spans``, the notices found (label, first_word, last_word, share).

    The keys of all rolling k-grams are joined to the template positions that hold them; a match votes for
    the diagonal place - position. A phrase stands where a single diagonal has all its votes. A notice may
    have been edited, which shifts the rest of it by a few words: votes on diagonals up to ``slack`` apart
    are merged (two overlapping grids of cells of 2 x slack diagonals hold any such set), and the merged
    span counts if it holds ``least`` of the notice's k-grams and is at most half as long again as the
    notice. Notices differ from each other by a word or two, so spans that overlap are held against each other:
    ``closeness`` is the share of shared k-grams in the longer of notice and span, and only the closest of overlapping
    spans stays (all of them, if equally close). ``score`` is the largest share of a template's k-grams found together, 0 without any.

    The templates are broadcast if they have at most ``broadcast_limit`` k-grams in all. Null, empty and
    blank texts have no words, no labels ('') and score 0. Rows are kept apart by place, so equal rows and
    doc_ids give equal results; an empty table gives an empty one; extra columns are ignored.
    """
    templates, rows = [*[(*x, True) for x in phrases], *[(*x, False) for x in notices]], []
    sizes = []
    for t, (label, text, base) in enumerate(templates):
        keys = gram_keys(text, k)
        if not len(keys):
            raise ValueError(f"a template needs {k} words or more: {text!r}")
        sizes.append((t, label, base, len(keys), len(keys) + k - 1))
        rows += [(int(h), t, i) for i, h in enumerate(keys)]
    spark = docs.sparkSession
    places = spark.createDataFrame([(SUMMARY, -1, 0), *rows], "key bigint, template int, position int")
    if len(rows) <= broadcast_limit:
        places = F.broadcast(places)
    hits = cut_lineage(_grams(docs, k).join(places, "key").select("row", "place", "template", "position", "doc_id"))
    kinds = spark.createDataFrame(sizes, "template int, label string, base boolean, grams int, words int")
    votes = (
        hits.where("template >= 0").groupBy("row", "template", (F.col("place") - F.col("position")).alias("diagonal"))
        .agg(F.collect_set("position").alias("positions")).join(F.broadcast(kinds), "template")
    )
    base = votes.where(F.col("base") & (F.size("positions") == F.col("grams"))).groupBy("row").agg(
        F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("own"))
    grid = F.explode(F.array(*[F.struct(F.lit(g).alias("grid"), F.floor((F.col("diagonal") + g * slack) / (2 * slack)).alias("cell")) for g in (0, 1)]))
    merged = (
        votes.withColumn("g", F.when(F.col("base"), F.struct(F.lit(0).alias("grid"), F.col("diagonal").alias("cell")))).where("base")
        .unionByName(votes.where("not base").withColumn("g", grid))
        .groupBy("row", "template", "label", "base", "grams", "words", "g")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("found"),
             F.min(F.col("diagonal") + F.array_min("positions")).alias("first_word"), F.max(F.col("diagonal") + F.array_max("positions") + (k - 1)).alias("last_word"))
        .withColumn("share", F.col("found") / F.col("grams"))
    )
    length = F.col("last_word") - F.col("first_word") + 1
    good = ~F.col("base") & (F.col("share") >= least) & (length <= 1.5 * F.col("words"))
    merged = merged.withColumn("closeness", F.col("found") / F.greatest(F.col("grams"), length - (k - 1)))
    kept = closest(merged.where(good).select("row", "label", "first_word", "last_word", "share", "closeness").distinct(), int(1.5 * max(x[4] for x in sizes)) + 1)
    found = kept.groupBy("row").agg(F.collect_set("label").alias("more"), F.collect_set(F.struct("label", "first_word", "last_word", "share")).alias("spans"))
    method = merged.groupBy("row").agg(F.max("share").alias("score")).join(found, "row", "left")
    summary = hits.where("template < 0").select("row", "doc_id", F.col("place").alias("n_words"))
    none = F.array().cast("array<string>")
    named = lambda c: F.array_join(F.array_sort(c), ",")
    return (
        summary.join(base.join(method, "row", "full"), "row", "left")
        .select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), F.col("first_word").cast("bigint"), F.col("last_word").cast("bigint"),
                named(F.coalesce("own", none)).alias("base_labels"), named(F.array_union(F.coalesce("own", none), F.coalesce("more", none))).alias("labels"),
                F.coalesce("score", F.lit(0.0)).alias("score"),
                F.coalesce("spans", F.array().cast("array<struct<label:string,first_word:bigint,last_word:bigint,share:double>>")).alias("spans"))
    )
