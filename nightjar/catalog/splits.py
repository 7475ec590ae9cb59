"""Queries for splits, folds, samples and their guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightjar.catalog import query
from nightjar.catalog.metrics import rounded
from nightjar.operators import splits as S
from nightjar.plans import views as V
from nightjar.plans.views import with_views


def draw(*parts: str) -> str:
    text = " || ':' || ".join(parts)
    return f"cast('0x' || substr(md5({text}), 1, 15) as bigint)"


IDS = "select distinct user_id as subject_id from events"
SPLIT = f"""
    select subject_id, case when r <= ceil(n * 0.2) then 'test' when r2 <= ceil((n - ceil(n * 0.2)) * 0.05) then 'val' else 'train' end as part
    from (select *, row_number() over (partition by r <= ceil(n * 0.2) order by {draw("'inner42'", "subject_id::varchar")}, subject_id) as r2
          from (select subject_id, row_number() over (order by {draw("'outer42'", "subject_id::varchar")}, subject_id) as r, count(*) over () as n from ids))"""


def ids(spark, sf) -> DataFrame:
    return V.table(spark, sf, "events").select(F.col("user_id").alias("subject_id"))


@query(with_views("select subject_id, part from split", ids=IDS, split=SPLIT))
def group_split(spark, sf) -> DataFrame:
    return S.group_split(ids(spark, sf))


@query(with_views("""
    select part, count(*) as n_epochs, count(distinct subject_id) as n_subjects, round(avg(apnoea_label), 6) as positive_share
    from v_epochs join split using (subject_id) group by 1""", "v_epochs", ids=IDS, split=SPLIT))
def split_report(spark, sf) -> DataFrame:
    return rounded(S.split_report(V.epochs(spark, sf), S.group_split(ids(spark, sf)), "apnoea_label"))


@query(with_views("""
    select part, count(*) as n, sum(apnoea_label)::bigint as n_pos, round((count(*) - sum(apnoea_label)) / sum(apnoea_label)::double, 6) as scale_pos_weight
    from v_epochs join split using (subject_id) where sleep_stage in ('N1','N2','N3','REM') group by 1""", "v_epochs", ids=IDS, split=SPLIT))
def class_balance(spark, sf) -> DataFrame:
    from nightjar.functions.expressions import is_sleep

    d = V.epochs(spark, sf).where(is_sleep("sleep_stage")).join(S.group_split(ids(spark, sf)), "subject_id")
    return rounded(S.class_balance(d, ["part"], "apnoea_label"))


@query(with_views("""
    select subject_id, epoch_idx, sleep_stage, round(n / (k * c::double), 6) as weight from (
        select *, count(*) over () as n, count(*) over (partition by sleep_stage) as c, (select count(distinct sleep_stage) from v_epochs) as k from v_epochs)""", "v_epochs"))
def balanced_class_weights(spark, sf) -> DataFrame:
    d = S.balanced_weights(V.epochs(spark, sf).select("subject_id", "epoch_idx", "sleep_stage"), "sleep_stage")
    return rounded(d.select("subject_id", "epoch_idx", "sleep_stage", "weight"))


TREE = "".join(f"""
    , level{k} as (select part, block >> 16 as block, sha256(string_agg(block || ':' || mark, ',' order by block)) as mark from level{k - 1} group by 1, 2)""" for k in (2, 3, 4))


@query("with ids as (" + IDS + "), split as (" + SPLIT + """),
    level1 as (select part, subject_id >> 16 as block, sha256(string_agg(subject_id::varchar, ',' order by subject_id)) as mark from split group by 1, 2)""" + TREE + """
    select part, n, sha256(string_agg(block || ':' || mark, ',' order by block)) as sha256 from level4 join (select part, count(*) as n from split group by 1) using (part) group by 1, 2""")
def split_record(spark, sf) -> DataFrame:
    return S.split_record(S.group_split(ids(spark, sf))).select("part", "n", "sha256")


@query(with_views(f"""
    select part, count(*) as n, bit_xor({draw("subject_id::varchar")}) as xor_hash, sum({draw("subject_id::varchar")} & 4294967295)::bigint as sum_hash from split group by 1""",
                  ids=IDS, split=SPLIT))
def split_fingerprint(spark, sf) -> DataFrame:
    return S.ids_fingerprint(S.group_split(ids(spark, sf)), ["part"])


@query(with_views("""
    select count(distinct o.subject_id) as n_ids, count(distinct o.subject_id) filter (part is null) as not_in_split,
           count(distinct o.subject_id) filter (part <> 'train') as other_part, count(distinct o.subject_id) filter (part = 'test') as test_leak
    from (select distinct o_custkey as subject_id from orders) o left join split using (subject_id)""", ids=IDS, split=SPLIT))
def split_guard(spark, sf) -> DataFrame:
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("subject_id"))
    return S.split_guard(o, S.group_split(ids(spark, sf)), "train")


@query("""
    select user_id as subject_id, count(distinct event_type) as n_parts from events group by 1 having count(distinct event_type) > 1""")
def part_overlaps(spark, sf) -> DataFrame:
    e = V.table(spark, sf, "events").select(F.col("user_id").alias("subject_id"), F.col("event_type").alias("part"))
    return S.part_overlaps(e)


@query("""
    select 'only_a' as side, count(*) as n, (select string_agg(k::varchar, ',' order by k) from (select k from a where k not in (select k from b) order by k limit 5)) as examples from a where k not in (select k from b)
    union all
    select 'only_b', count(*), (select string_agg(k::varchar, ',' order by k) from (select k from b where k not in (select k from a) order by k limit 5)) from b where k not in (select k from a)
    """.replace("select 'only_a'", "with a as (select distinct o_custkey as k from orders where o_orderpriority = '1-URGENT'), b as (select distinct o_custkey as k from orders where o_orderpriority = '5-LOW')\n    select 'only_a'", 1))
def id_set_difference(spark, sf) -> DataFrame:
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("subject_id"), "o_orderpriority")
    return S.set_difference(o.where("o_orderpriority = '1-URGENT'"), o.where("o_orderpriority = '5-LOW'"))


@query("""
    with recursive sizes as (select user_id as subject_id, count(*) as n_rows from events group by 1),
    queue as (select *, row_number() over (order by n_rows desc, subject_id) as p from sizes),
    deal as (
        select cast(0 as bigint) as p, cast([0, 0, 0, 0, 0] as bigint[]) as loads, cast(null as bigint) as fold
        union all
        select q.p, list_transform(d.loads, lambda x, i: x + case when i = list_position(d.loads, list_min(d.loads)) then q.n_rows else 0 end),
               list_position(d.loads, list_min(d.loads)) - 1
        from deal d join queue q on q.p = d.p + 1)
    select subject_id, n_rows, cast(fold as integer) as fold from queue join deal using (p)""")
def group_kfold(spark, sf) -> DataFrame:
    return S.group_kfold(ids(spark, sf), 5)


@query(f"""
    select subject_id, segment, rep as repeat, cast((row_number() over (partition by segment, rep order by {draw("'42'", "rep::varchar", "subject_id::varchar")}, subject_id) - 1) % 5 as integer) as fold
    from (select c_custkey as subject_id, c_mktsegment as segment, cast(unnest([0, 1, 2]) as integer) as rep from customer)""")
def stratified_kfold(spark, sf) -> DataFrame:
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("segment"))
    return S.stratified_kfold(c, ["segment"], 5, repeats=3)


@query(with_views(f"""
    select subject_id, epoch_idx, apnoea_label from v_epochs where apnoea_label = 1 union all
    select subject_id, epoch_idx, apnoea_label from (
        select *, row_number() over (order by {draw("'42'", "subject_id || '-' || epoch_idx")}, subject_id || '-' || epoch_idx) as r from v_epochs where apnoea_label = 0)
    where r <= (select floor(count(*) / 0.75) from v_epochs where apnoea_label = 1)""", "v_epochs"))
def undersampled_rows(spark, sf) -> DataFrame:
    e = V.epochs(spark, sf).select("subject_id", "epoch_idx", "apnoea_label")
    return S.undersample(e, "apnoea_label", ["subject_id", "epoch_idx"], 0.75)


@query(f"""select c_custkey as subject_id from customer order by {draw("'42'", "c_custkey::varchar")}, c_custkey limit 20""")
def subject_sample(spark, sf) -> DataFrame:
    return S.sample_subjects(V.table(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id")), 20)


@query(f"""select c_custkey as subject_id, row_number() over (order by {draw("'42'", "c_custkey::varchar")}, c_custkey) - 1 as position from customer""")
def subject_shuffle(spark, sf) -> DataFrame:
    return S.shuffled(V.table(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id")))


@query("select c_custkey as subject_id from customer where c_custkey >= 100 and c_custkey not in (select o_custkey from orders where o_orderstatus = 'P') order by 1 limit 25")
def next_batch(spark, sf) -> DataFrame:
    from nightjar.sources.incremental import next_batch

    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id"))
    done = V.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("subject_id"))
    return next_batch(c, done, start=100, n=25)


@query("""select c_custkey as subject_id from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')""")
def stale_subjects(spark, sf) -> DataFrame:
    from nightjar.sources.incremental import stale_subjects

    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id"))
    done = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderpriority").alias("features_version"))
    return stale_subjects(c, done, "1-URGENT")


@query("""
    select o_orderpriority as features_version, count(distinct o_custkey) as n_subjects from orders group by 1 order by 2 desc, 1""")
def version_histogram(spark, sf) -> DataFrame:
    from nightjar.sources.incremental import version_histogram

    return version_histogram(V.table(spark, sf, "orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderpriority").alias("features_version")))


@query("""
    select state, coalesce(sum(n) filter (part = 'val'), 0)::bigint as val, coalesce(sum(n) filter (part = 'test'), 0)::bigint as test, coalesce(sum(n) filter (part = 'train'), 0)::bigint as train from (
        select part, case when f then 'cached' when o is null then 'file_missing'
                          when failed and part in ('val', 'test') and transient then 'todo_transient_auto_retry' when failed then 'failed_before_skipped' else 'todo' end as state, count(*) as n
        from (select c_custkey, case c_custkey % 5 when 0 then 'val' when 1 then 'test' else 'train' end as part, coalesce(bool_or(o_orderstatus = 'P'), false) as f, max(o_custkey) as o,
                     c_nationkey % 3 = 0 as failed, c_nationkey % 2 = 0 as transient from customer left join orders on o_custkey = c_custkey group by 1, c_nationkey) group by 1, 2) group by 1""")
def ingest_status(spark, sf) -> DataFrame:
    from nightjar.sources.incremental import ingest_status

    c = V.table(spark, sf, "customer")
    k = F.col("c_custkey") % 5
    split = c.select(F.col("c_custkey").alias("subject_id"), F.when(k == 0, "val").when(k == 1, "test").otherwise("train").alias("part"))
    o = V.table(spark, sf, "orders")
    files = o.select(F.col("o_custkey").alias("subject_id")).distinct()
    cached = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("subject_id")).distinct()
    err = F.when(F.col("c_nationkey") % 2 == 0, "TimeoutError").otherwise("ValueError")
    ledger = c.where("c_nationkey % 3 = 0").select(F.col("c_custkey").alias("subject_id"), F.lit("failed").alias("status"), err.alias("error_type"))
    return ingest_status(split, files, cached, ledger, ["TimeoutError"])
