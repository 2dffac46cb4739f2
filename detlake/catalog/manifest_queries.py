"""Registered queries: the canonical manifest, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from detlake import fixed_values as fv
from detlake.catalog.base import query, rounded
from detlake.catalog.views import table, view
from detlake.functions import paths as P
from detlake.operators import manifest as M


def _manifest(spark, sf_dir):
    return view(spark, sf_dir, "v_manifest")


ALL = '''dataset_id, utt_id, path, label, split, attack_type, "condition", transmission, vocoder, speaker_id,
 sample_rate, codec, duration'''


@query("coerce_schema", """select cast(l_orderkey as string) dataset_id, cast(l_linenumber as string) utt_id,
 l_returnflag path, cast(l_linenumber%2 as bigint) label, 'train' split, cast(null as string) attack_type,
 cast(null as string) "condition", cast(null as string) transmission, cast(null as string) vocoder,
 cast(l_suppkey as string) speaker_id, cast(l_quantity as bigint) sample_rate, cast(null as string) codec,
 l_discount duration from lineitem""")
def q_coerce_schema(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    raw = li.select(
        F.col("l_orderkey").alias("dataset_id"), F.col("l_linenumber").alias("utt_id"),
        F.col("l_tax").alias("an_extra_column"), F.col("l_returnflag").alias("path"),
        (F.col("l_linenumber") % 2).cast("string").alias("label"), F.lit("train").alias("split"),
        F.col("l_suppkey").alias("speaker_id"), F.col("l_quantity").alias("sample_rate"),
        F.col("l_discount").cast("string").alias("duration"))
    return M.coerce_schema(raw)


@query("select_split", f"""select {ALL} from v_manifest
 where (dataset_id='1-URGENT' and split='train') or (dataset_id='2-HIGH' and split='dev')""", ["v_manifest"])
def q_select_split(spark, sf_dir):
    return M.select_split(_manifest(spark, sf_dir), [("1-URGENT", "train"), ("2-HIGH", "dev")])


@query("union_manifests", f"""select {ALL} from v_manifest where dataset_id='1-URGENT'
 union all select {ALL} from v_manifest where split='dev'
 union all select dataset_id, utt_id, path, label, split, attack_type, null, null, null, null, null, null, null
  from v_manifest where label=0""", ["v_manifest"])
def q_union_manifests(spark, sf_dir):
    """Overlapping parts, one of them without the optional columns; repeats stay."""
    m = _manifest(spark, sf_dir)
    short = m.filter("label = 0").select("dataset_id", "utt_id", "path", "label", "split", "attack_type")
    return M.union_manifests([m.filter("dataset_id = '1-URGENT'"), m.filter("split = 'dev'"), short])


@query("filter_conjunctive", f"""select {ALL} from v_manifest
 where label=1 and split='test' and attack_type='BUILDING'""", ["v_manifest"])
def q_filter_conjunctive(spark, sf_dir):
    return M.filter_conjunctive(_manifest(spark, sf_dir), label=1, split="test",
                                attack_type="BUILDING", condition=None)


@query("namespaced_key", """select dataset_id || '__' || utt_id utt_id, dataset_id || '/' || utt_id || '.flac' path
 from v_manifest""", ["v_manifest"])
def q_namespaced_key(spark, sf_dir):
    ds, utt = F.col("dataset_id"), F.col("utt_id")
    return _manifest(spark, sf_dir).select(
        P.namespaced_utt(ds, utt).alias("utt_id"), P.namespaced_path(ds, utt, F.col("path")).alias("path"))


@query("stable_key_sort", f"select {ALL} from v_manifest order by dataset_id, utt_id", ["v_manifest"])
def q_stable_key_sort(spark, sf_dir):
    return M.stable_key_sort(_manifest(spark, sf_dir))


@query("limit_first_n", f"select {ALL} from v_manifest order by dataset_id, utt_id limit 250", ["v_manifest"])
def q_limit_first_n(spark, sf_dir):
    return M.limit_first_n(_manifest(spark, sf_dir), 250)


@query("seeded_sample_n", f"""select {ALL} from v_manifest
 order by md5(concat_ws(',', '1337', dataset_id, utt_id)), dataset_id, utt_id limit 200""", ["v_manifest"])
def q_seeded_sample_n(spark, sf_dir):
    return M.seeded_sample_n(_manifest(spark, sf_dir), 200)


@query("domain_except", """select distinct split from v_dirty
 where split is not null except (select unnest(['train','dev','test']))""", ["v_dirty"])
def q_domain_except(spark, sf_dir):
    return M.domain_except(view(spark, sf_dir, "v_dirty"), "split", fv.SPLITS)


@query("sentinel_intersect", """select distinct lower(attack_type) attack_type from v_dirty
 intersect (select unnest(['', '-', 'bonafide', 'unknown', 'none', 'n/a']))""", ["v_dirty"])
def q_sentinel_intersect(spark, sf_dir):
    return M.sentinel_intersect(view(spark, sf_dir, "v_dirty"), "attack_type")


@query("dedupe_keys", "select distinct dataset_id, utt_id from v_shards", ["v_shards"])
def q_dedupe_keys(spark, sf_dir):
    return M.dedupe_keys(view(spark, sf_dir, "v_shards"))


# --- small balanced dataset: every customer's orders are one source -----------

SQL_SOURCES = """(select 'c' || cast(o_custkey as string) dataset_id, 'O' || cast(o_orderkey as string) utt_id,
 'flac/O' || cast(o_orderkey as string) || '.flac' path, cast(case when o_orderstatus='F' then 0 else 1 end as bigint) label,
 case when o_orderstatus='O' then o_orderpriority end attack_type from orders)"""
SQL_FIRST = f"""select * from (select *, row_number() over (partition by dataset_id, label order by utt_id) rn from {SQL_SOURCES})
 where rn<=5 and dataset_id in (select dataset_id from {SQL_SOURCES} group by dataset_id
  having sum(label)>=5 and sum(1-label)>=5)"""
SQL_SPLIT = "case when rn<=2 then 'train' when rn<=4 then 'dev' when rn<=5 then 'test' else 'train' end"


def _sources(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    utt = F.concat(F.lit("O"), "o_orderkey")
    return o.select(
        F.concat(F.lit("c"), "o_custkey").alias("dataset_id"), utt.alias("utt_id"),
        F.concat(F.lit("flac/"), utt, F.lit(".flac")).alias("path"),
        F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).cast("long").alias("label"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).alias("attack_type"))


@query("first_k_per_class", f"select dataset_id, label, utt_id, cast(rn as integer) \"rank\" from ({SQL_FIRST})")
def q_first_k_per_class(spark, sf_dir):
    return M.first_k_per_class(_sources(spark, sf_dir)).select("dataset_id", "label", "utt_id", "rank")


@query("split_by_rank_quota", f"""select o_custkey, o_orderkey, {SQL_SPLIT} split from
 (select *, row_number() over (partition by o_custkey order by o_orderkey) rn from orders)""")
def q_split_by_rank_quota(spark, sf_dir):
    """Quota split of every order by its place among the orders of its customer."""
    from detlake.operators.prefix import ordinal_within

    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    ranked = ordinal_within(o, ["o_custkey"], "o_orderkey", [], "place")
    return ranked.select("o_custkey", "o_orderkey", M.split_by_rank_quota(F.col("place") + 1).alias("split"))


@query("mini_dataset", f"""select dataset_id || '__' || utt_id utt_id, dataset_id || '/' || utt_id || '.flac' path, label,
 {SQL_SPLIT} split, dataset_id source_dataset_id, utt_id source_utt_id, attack_type from ({SQL_FIRST})""")
def q_mini_dataset(spark, sf_dir):
    return M.mini_dataset(_sources(spark, sf_dir))


@query("mini_skipped_sources", f"""select dataset_id, cast(sum(1-label) as bigint) n_bonafide, cast(sum(label) as bigint) n_spoof
 from {SQL_SOURCES} group by dataset_id having sum(label)<5 or sum(1-label)<5""")
def q_mini_skipped_sources(spark, sf_dir):
    return M.skipped_sources(_sources(spark, sf_dir))
