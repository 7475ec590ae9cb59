"""Every registered query over its whole table at the smallest scale, against a plain version."""

import hashlib
import html
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from test_licenses import brute as brute_licenses
from test_minhash import brute as brute_groups
from test_simhash import brute as brute_prints
from test_suffixes import brute as brute_spans
from test_topk import brute as brute_top
from tokenizers import Tokenizer

from nightjar.llm import decontaminate as D
from nightjar.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())


def rows(spark, sf, name):
    return QUERIES[name](spark, sf).collect()


def ids_of(name, text, end):
    return [*Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids, end]


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r) for r in got.select(columns).collect()) == sorted(want.fetchall())


def test_suffix_dedup(spark, sf, docs):
    want = {d: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for (d, _), x in zip(docs, brute_spans([t for _, t in docs], 100))}
    assert {r.doc_id: tuple(r)[1:] for r in rows(spark, sf, "op2_suffix_dedup")} == want


def test_decontamination(spark, sf, docs):
    words = lambda t: re.findall("[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    number: dict = {}
    coded = lambda t: np.array([number.setdefault(w, len(number)) for w in words(t)], np.uint64)
    items = [(r.item_id, coded(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {}
    for d, t in docs:
        own = coded(t)
        for i, item in items:
            distance = D.closest(item, own)[0] if len(item) >= 5 else len(item)
            if len(item) >= 5 and distance <= D.edit_budget(len(item), 0.8):
                want[d, i] = distance
    got = {(r.doc_id, r.item_id): r.distance for r in rows(spark, sf, "op3_benchmark_decontamination")}
    assert got == want and got


def test_id_files(spark, sf, docs):
    got, start = {r.doc_id: tuple(r)[1:] for r in rows(spark, sf, "op4_huffman_ids")}, 0
    for d, t in docs:
        ids = np.array(ids_of("byte_bpe_50k.json", t, 0), "<u4")
        assert got[d] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_packing(spark, sf, docs):
    pieces: dict = {}
    sequences: dict = {}
    for r in rows(spark, sf, "op5_harmonic_packing"):
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, t in docs:
        ids, at = np.array(ids_of("word_bpe_49k.json", t, 2), "<u4"), 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at:at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        own.sort()
        ends = np.cumsum([n for _, n in own])
        assert [o for o, _ in own] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_quality(spark, sf, docs):
    got = {r.doc_id: r for r in rows(spark, sf, "op6_quality_resampling")}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert set(got) == {d for d, _ in docs}
    assert np.mean([got[r.doc_id].kept == (r.quality == 1) for r in labels]) >= 0.97
    kept = [r.key for r in got.values() if r.kept]
    assert min(kept) > max(r.key for r in got.values() if not r.kept)


def test_licenses(spark, sf, docs):
    got = {r.doc_id: r for r in rows(spark, sf, "op7_license_diagonals")}
    for d, t in docs:
        r = got[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(t)
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_pages(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        text = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:h1|p|br)>", " ", body))).split())
        want[r.page_id] = (r.url, text, len(text))
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in rows(spark, sf, "op8_tag_path_text")} == want


def test_near_duplicates(spark, sf, docs):
    assert sorted(tuple(r) for r in rows(spark, sf, "op9_superminhash_near_dedup")) == brute_groups(docs, 3, 85)


def test_top_five(spark, sf):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {tuple(r) for r in rows(spark, sf, "op10_kdtree_top5")} == brute_top(vectors, 5, 50)


def test_linked_fingerprints(spark, sf, docs):
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, sf, "op13_covering_simhash")} == brute_prints(docs)
