"""The registered queries of the operators: each applies one to its whole table and derives the asked columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightjar.llm.common import read, tokenizer_path
from nightjar.llm.decontaminate import contamination
from nightjar.llm.html import extract
from nightjar.llm.idfiles import round_trip
from nightjar.llm.licenses import scan
from nightjar.llm.lines import dedup_lines
from nightjar.llm.minhash import near_duplicates
from nightjar.llm.negatives import hard_negatives
from nightjar.llm.packing import pack
from nightjar.llm.phrases import collocations
from nightjar.llm.quality import resample
from nightjar.llm.simhash import near_duplicates as linked_fingerprints
from nightjar.llm.suffixes import remove_repeats
from nightjar.llm.topk import top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


LINE_SQL = """
    with lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from {docs}),
    keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
    frequent as (select key as often from keyed where length(key) >= 1 group by key having count(distinct doc_id) >= 10)"""

ORACLES["op1_line_dedup"] = LINE_SQL.format(docs="documents") + """
    select doc_id, count(*) as n_lines, count(often) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where often is null), '')) as kept_sha256
    from keyed left join frequent on key = often group by doc_id"""


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, min_docs=10).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2).drop("ids")


@query
def op9_superminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85)


@query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), similarity=0.8)


@query
def op6_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)


@query
def op7_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).drop("spans")


@query
def op8_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


ORACLES["op10_kdtree_top5"] = """
    with points as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as point from embeddings
        where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.point::double[], c.point::double[])::bigint as score
        from points q join points c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
    ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from scored)
    select query_id, rank, vec_id, score from ranked where rank <= 5"""


@query
def op10_kdtree_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), k=5, every=50)


@query
def op13_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_fingerprints(read(spark, sf_dir, "documents"), k=4, radius=4).select("doc_id", "fingerprint", "component_id")


ORACLES["op12_tiled_collocations"] = """
    with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\x0C\\r]')) as piece from documents),
    spoken as (select lang, list_filter(string_split_regex(piece, '[ \\t]'), lambda w: w <> '') as words from pieces),
    grams as (select lang, m, unnest(list_transform(range(1, len(words) - m + 2), lambda i: words[i:i + m - 1])) as gram from spoken, range(1, 6) as lengths(m)),
    counted as (select lang, m, gram, count(*) as f from grams group by all),
    spoken_words as (select lang, sum(f)::bigint as n from counted where m = 1 group by lang),
    found as (select * from counted where m > 1 and f >= 100),
    covers as (select lang, gram[:m - 1] as gram, f from found union all select lang, gram[2:], f from found),
    kept as (select * from found x where not exists (select 1 from covers y where y.lang = x.lang and y.gram = x.gram and 100 * y.f >= 100 * x.f)),
    cuts as (select x.*, n, k, one.f as l, two.f as r, (1000::hugeint * x.f * n) // (one.f::hugeint * two.f) as score
        from kept x join spoken_words using (lang) join range(1, 5) as places(k) on k < m
        join counted one on one.lang = x.lang and one.gram = x.gram[:k] join counted two on two.lang = x.lang and two.gram = x.gram[k + 1:]),
    lowest as (select * from cuts qualify row_number() over (partition by lang, gram order by score, k) = 1),
    ranked as (select lang, array_to_string(gram, ' ') as phrase, f as a, l, r, n, score::bigint as score from lowest)
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from ranked
    qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000"""


@query
def op12_tiled_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"), longest=5, least=100, covered_percent=100, top=2000)


ORACLES["op11_rtree_hard_negatives"] = """
    with points as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as point from embeddings
        where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (select a.vec_id as anchor_id, a.label as own, c.vec_id, c.label, list_inner_product(a.point, c.point)::bigint as score
        from points a join points c on a.vec_id <> c.vec_id and len(a.point) = len(c.point) where a.vec_id % 100 = 0),
    near as (select anchor_id, vec_id as positive_id, score as positive_score from scored where label = own
        qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
    far as (select s.anchor_id, positive_id, row_number() over (partition by s.anchor_id, positive_id order by score desc, vec_id)::integer as rank, vec_id as negative_id, positive_score, score as negative_score
        from scored s join near n on n.anchor_id = s.anchor_id where label <> own and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
    select * from far where rank <= 10"""


@query
def op11_rtree_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings").withColumn("label", relabelled), every=100, positives=5, negatives=10, low=30, high=90)
