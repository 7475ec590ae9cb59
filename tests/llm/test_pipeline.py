"""The pipeline's stages and its whole run against plain versions."""

import random

import numpy as np
import public_tokenizers
import pytest
from test_lines import brute as brute_lines
from test_minhash import brute as brute_groups
from tokenizers import Tokenizer

import corpus_pipeline as P
from nightjar.llm import decontaminate as D
from nightjar.llm.quality import resample


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(11)
    words = [f"word{i}" for i in range(300)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [line(25) for _ in range(5)]
    rows, labels = [], []
    for d in range(400):
        text = "\n".join(line(r.randrange(8, 30)) for _ in range(r.randrange(1, 6)))
        if d % 7 == 0:
            text = " ".join(f"JUNK{r.randrange(30)}!!" for _ in range(60))
        elif d % 11 == 0:
            text += "\nThis line stands in many documents"
        elif d % 13 == 0 and len(rows) > 20:
            text = rows[d - 12 - (d - 12) % 7 + 1][1]
        elif d % 17 == 0:
            text += " " + items[d % 5]
        rows.append((d, text, "en", f"src{d % 3}", len(text)))
        if d % 2:
            labels.append((d, 0 if d % 7 == 0 else 1, 0))
    rows += [(500, None, "en", "s", 0), (501, "", "en", "s", 0), (502, "This line stands in many documents", "en", "s", 34)]
    sf = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, rows, items


def coded(texts):
    number: dict = {}
    return [np.array([number.setdefault(w, len(number)) for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()], np.uint64) for t in texts]


def test_stages_and_run(spark, tables):
    sf, rows, items = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    at = docs
    kept = {r.doc_id for r in resample(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    have = sorted((d, t) for d, t, *_ in rows if d in kept)
    at = P.quality(spark, at, sf)
    assert at.columns == docs.columns and sorted((r.doc_id, r.text) for r in at.collect()) == have
    assert sum(d % 7 == 0 for d, _ in have if d < 500) <= 2 and sum(d % 7 != 0 for d, _ in have) >= 0.99 * sum(d % 7 != 0 for d, *_ in rows)

    after = brute_lines([t for _, t in have], 10)
    have = [(d, x[0] if t is not None or x[2] else x[0]) for (d, t), x in zip(have, after) if x[2] == 0 or x[0].strip()]
    at = P.cut_lineage(P.lines(spark, at, sf))
    got = sorted((r.doc_id, r.text or "", r.n_chars) for r in at.collect())
    assert at.columns == docs.columns and [g[:2] for g in got] == have
    assert all(n == len(t) for _, t, n in got)

    groups = {d: keep for d, _, _, keep in brute_groups(have, 5, 80)}
    have = [(d, t) for d, t in have if groups[d]]
    at = P.cut_lineage(P.near_copies(spark, at, sf))
    assert at.columns == docs.columns and sorted((r.doc_id, r.text or "") for r in at.collect()) == have

    codes = coded([t for _, t in have] + items)
    bench = codes[len(have):]
    have = [(d, t) for (d, t), c in zip(have, codes) if all(D.closest(b, c)[0] > D.edit_budget(len(b), 0.8) for b in bench)]
    at = P.cut_lineage(P.decontaminate(spark, at, sf))
    assert at.columns == docs.columns and sorted((r.doc_id, r.text or "") for r in at.collect()) == have

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = {d: len(tok.encode(t, add_special_tokens=False).ids) + 1 for d, t in have}
    out = P.run(spark, sf).toPandas()
    assert out.groupby("doc_id").length.sum().to_dict() == total
    assert set(out.doc_tokens) <= set(total.values())
    assert out.groupby("sequence_id").length.sum().max() <= 4096


def test_empty_table(spark, tables):
    sf = tables[0]
    none = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 0")
    for _, stage in P.STAGES:
        assert stage(spark, none, sf).count() == 0


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_line_dedup_leaves_groups_of_copies_to_near_dedup(spark, limit, monkeypatch):
    from functools import partial

    monkeypatch.setattr(P, "dedup_lines_sparing_copies", partial(P.dedup_lines_sparing_copies, broadcast_limit=limit))
    body = "\n\n".join(" ".join(f"copy{i}x{j}" for j in range(12)) for i in range(4))
    rows = [(d, f"Home page\n{body}\n\t") for d in range(25)] + [(30 + d, f"Home page\nown text number {d}") for d in range(12)] + [(50, "Home page"), (51, "home page\n \t\n"), (52, "\t"), (53, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = P.cut_lineage(P.lines(spark, docs, ""))
    copy = f"{body}\n\t"
    want = [(d, copy) for d in range(25)] + [(30 + d, f"own text number {d}") for d in range(12)] + [(52, "\t"), (53, "")]
    assert out.columns == docs.columns and sorted((r.doc_id, r.text or "") for r in out.collect()) == want
    assert all(r.n_chars == len(r.text or "") for r in out.collect())
    assert [r.doc_id for r in P.near_copies(spark, out, "").where("doc_id < 25").collect()] == [0]
