"""Registered queries: composition, column statistics, durations."""

from __future__ import annotations

from pyspark.sql import functions as F

from detlake import schema
from detlake.catalog.base import query, rounded
from detlake.catalog.views import view
from detlake.operators import profile as P

COUNTS = """cast(sum(case when label=0 then 1 else 0 end) as bigint) bonafide,
 cast(sum(case when label=1 then 1 else 0 end) as bigint) spoof, count(*) total"""


MANIFEST_COLUMNS = [f.name for f in schema.MANIFEST if f.dataType.simpleString() != "double"]


def _manifest(spark, sf_dir):
    return view(spark, sf_dir, "v_manifest")


@query("class_balance", f"select split, {COUNTS} from v_manifest group by split", ["v_manifest"])
def q_class_balance(spark, sf_dir):
    return P.class_balance(_manifest(spark, sf_dir))


@query("class_balance_by_dataset",
       f"select dataset_id, {COUNTS} from v_manifest group by dataset_id", ["v_manifest"])
def q_class_balance_by_dataset(spark, sf_dir):
    return P.class_balance_by_dataset(_manifest(spark, sf_dir))


@query("split_composition",
       f"select dataset_id, split, {COUNTS} from v_manifest group by dataset_id, split", ["v_manifest"])
def q_split_composition(spark, sf_dir):
    return P.split_composition(_manifest(spark, sf_dir))


@query("composition_table", f"""select *, round_even(100.0e0*spoof/total, 1) spoof_pct from
 (select dataset_id, split, {COUNTS} from v_manifest group by dataset_id, split)""", ["v_manifest"])
def q_composition_table(spark, sf_dir):
    return P.composition_table(_manifest(spark, sf_dir))


@query("attack_counts", """select dataset_id, attack_type, count(*) n_rows from v_manifest
 where attack_type is not null group by dataset_id, attack_type""", ["v_manifest"])
def q_attack_counts(spark, sf_dir):
    return P.attack_counts(_manifest(spark, sf_dir))


def _quoted(c: str) -> str:
    return f'"{c}"' if c == "condition" else c


SQL_LONG = " union all ".join(
    f"select '{c}' \"column\", cast({_quoted(c)} as string) \"value\" from v_manifest"
    for c in schema.OPTIONAL_COLUMNS
)


@query("column_profile", f"""select "column", count("value") non_null, count(distinct "value") n_unique
 from ({SQL_LONG}) group by "column" """, ["v_manifest"])
def q_column_profile(spark, sf_dir):
    return P.column_profile(_manifest(spark, sf_dir))


@query("column_profile_approx", f"""select "column", count("value") non_null, true close
 from ({SQL_LONG}) group by "column" """, ["v_manifest"])
def q_column_profile_approx(spark, sf_dir):
    """The distinct counts of one pass, held against the exact ones: within five standard errors."""
    m = _manifest(spark, sf_dir)
    exact = P.column_profile(m).select("column", F.col("n_unique").alias("n"))
    got = P.column_profile_approx(m, 0.02).join(exact, "column")
    close = F.abs(F.col("n_unique") - F.col("n")) <= F.greatest(0.1 * F.col("n"), F.lit(1))
    return got.select("column", "non_null", close.alias("close"))


@query("value_counts_capped", f"""with l as (select * from ({SQL_LONG}) where "value" is not null)
select "column", "value", count(*) n_rows from l where "column" in
 (select "column" from l group by "column" having count(distinct "value") <= 64)
group by "column", "value" """, ["v_manifest"])
def q_value_counts_capped(spark, sf_dir):
    return P.value_counts_capped(_manifest(spark, sf_dir))


SQL_ROW_MD5 = "select md5(concat_ws(chr(31), " + ", ".join(
    f"""coalesce(cast("{c}" as varchar), '\\N')""" for c in MANIFEST_COLUMNS) + ")) h from v_manifest"


@query("table_fingerprint", f"""select count(*) n_rows, md5(concat_ws(',', cast(count(*) as varchar), """ + ", ".join(
    f"cast(sum(('0x' || substr(h, {15 * i + 1}, 15))::bigint) as varchar)" for i in range(2)) + f""")) fingerprint
from ({SQL_ROW_MD5})""", ["v_manifest"])
def q_table_fingerprint(spark, sf_dir):
    return P.table_fingerprint(_manifest(spark, sf_dir).select(*MANIFEST_COLUMNS))


@query("pos_weight", """select dataset_id, round(cast(sum(1-label) as double)/sum(label), 9) pos_weight
 from v_manifest where split='train' group by dataset_id""", ["v_manifest"])
def q_pos_weight(spark, sf_dir):
    train = _manifest(spark, sf_dir).filter("split = 'train'")
    return P.pos_weight(train, ["dataset_id"]).withColumn("pos_weight", rounded("pos_weight", 9))


@query("dataset_counts", """select dataset_id, count(*) n, cast(sum(1-label) as bigint) n_bonafide,
 cast(sum(label) as bigint) n_spoof,
 cast(sum(case when label=1 and attack_type is null then 1 else 0 end) as bigint) n_spoof_without_attack_type
 from v_manifest group by dataset_id""", ["v_manifest"])
def q_dataset_counts(spark, sf_dir):
    return P.dataset_counts(_manifest(spark, sf_dir))


SQL_LENGTHS = """select case when cast(utt_id as bigint)%3=0 then 'a' else 'b' end dataset_id,
 count(*) n_frames from v_frames group by utt_id"""


def _lengths(spark, sf_dir):
    """Utterance lengths of two datasets: event counts per user."""
    counts = P.frame_counts(view(spark, sf_dir, "v_frames"))
    ds = F.when(F.col("utt_id").cast("long") % 3 == 0, "a").otherwise("b")
    return counts.withColumn("dataset_id", ds)


@query("frame_counts", "select dataset_id, utt_id, count(*) n_frames from v_frames group by all", ["v_frames"])
def q_frame_counts(spark, sf_dir):
    return P.frame_counts(view(spark, sf_dir, "v_frames"))


@query("duration_stats", f"""with s as (select dataset_id, n_frames, n_frames*160.0e0/16000.0e0 sec from ({SQL_LENGTHS}))
select dataset_id, count(*) n, round_even(quantile_cont(sec, 0.5), 2) median_sec,
 round_even(quantile_cont(sec, 0.05), 2) p05_sec, round_even(quantile_cont(sec, 0.95), 2) p95_sec,
 round_even(100.0e0*sum(case when n_frames<65 then 1 else 0 end)/count(*), 1) pct_shorter
from s group by dataset_id""", ["v_frames"])
def q_duration_stats(spark, sf_dir):
    return P.duration_stats(_lengths(spark, sf_dir), 160, 16000, 65)


@query("duration_histogram", f"""with s as (select dataset_id, n_frames*160.0e0/16000.0e0 sec from ({SQL_LENGTHS})),
sp as (select dataset_id, min(sec) lo, max(sec) hi, count(*) total from s group by dataset_id),
h as (select dataset_id, least(cast(floor((sec-lo)/(hi-lo)*60) as integer), 59) bin, count(*) n
 from s join sp using (dataset_id) group by all),
grid as (select *, unnest(range(60)) bin from sp)
select g.dataset_id, cast(g.bin as integer) bin, round(g.lo+g.bin*((g.hi-g.lo)/60), 9) left_sec,
 coalesce(h.n, 0) n, round(coalesce(h.n, 0)/(g.total*((g.hi-g.lo)/60)), 9) density
from grid g left join h on g.dataset_id=h.dataset_id and g.bin=h.bin""", ["v_frames"])
def q_duration_histogram(spark, sf_dir):
    out = P.duration_histogram(_lengths(spark, sf_dir), 160, 16000)
    return out.withColumn("left_sec", rounded("left_sec", 9)).withColumn("density", rounded("density", 9))
