"""Registered queries: resume by key, histories, scores and run identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from detlake.catalog.base import query, rounded
from detlake.catalog.views import view
from detlake.operators import resume as R
from detlake.plans.evaluate import run_fingerprint
from detlake.session import shared_path
from detlake.sinks import tables as sinks


def _manifest(spark, sf_dir):
    return view(spark, sf_dir, "v_manifest")


SQL_DONE = "(select dataset_id, utt_id from v_scores where score<200)"


def _done(spark, sf_dir):
    return view(spark, sf_dir, "v_scores").filter("score < 200")


@query("todo_by_key", f"""select dataset_id, utt_id, label, split from v_manifest m
 where not exists (select 1 from {SQL_DONE} d where d.dataset_id=m.dataset_id and d.utt_id=m.utt_id)""",
       ["v_manifest", "v_scores"])
def q_todo_by_key(spark, sf_dir):
    return R.todo_by_key(_manifest(spark, sf_dir), _done(spark, sf_dir)).select("dataset_id", "utt_id", "label", "split")


@query("present_in_cache", f"""select dataset_id, utt_id, label, split from v_manifest m
 where exists (select 1 from {SQL_DONE} d where d.dataset_id=m.dataset_id and d.utt_id=m.utt_id)""",
       ["v_manifest", "v_scores"])
def q_present_in_cache(spark, sf_dir):
    return R.present_in_cache(_manifest(spark, sf_dir), _done(spark, sf_dir)).select("dataset_id", "utt_id", "label", "split")


@query("attach_scores", """select m.dataset_id, m.utt_id, m.split, m.label, m.attack_type, s.score
 from v_manifest m join v_scores s on s.dataset_id=m.dataset_id and s.utt_id=m.utt_id
 where s.score<200""", ["v_manifest", "v_scores"])
def q_attach_scores(spark, sf_dir):
    return R.attach_scores(_manifest(spark, sf_dir), _done(spark, sf_dir))


@query("latest_wins", """select dataset_id, utt_id, score from v_shards qualify row_number() over
 (partition by dataset_id, utt_id order by l_shipdate desc, l_partkey desc, l_suppkey desc, score desc)=1""", ["v_shards"])
def q_latest_wins(spark, sf_dir):
    s = view(spark, sf_dir, "v_shards")
    order = ["l_shipdate", "l_partkey", "l_suppkey", "score"]
    return R.latest_wins(s, ["dataset_id", "utt_id"], order).select("dataset_id", "utt_id", "score")


@query("union_shards", "select dataset_id, utt_id, score from v_shards", ["v_shards"])
def q_union_shards(spark, sf_dir):
    """Parts written apart by ship flag and read back as one table."""
    root = shared_path(spark, "parts")
    s = view(spark, sf_dir, "v_shards").select("dataset_id", "utt_id", "score")
    early = F.length("dataset_id") % 2 == 0
    s.filter(early).write.parquet(f"{root}/part_a")
    s.filter(~early).write.parquet(f"{root}/part_b")
    return spark.read.schema(s.schema).parquet(f"{root}/part_a", f"{root}/part_b")


SQL_LOGS = """old as (select dataset_id, utt_id, path, 'old' error from v_manifest where utt_id like '%3'),
new as (select dataset_id, utt_id, path, 'new' error from v_manifest where utt_id like '%33' or utt_id like '%44')"""


def _logs(spark, sf_dir):
    m = _manifest(spark, sf_dir).select("dataset_id", "utt_id", "path")
    ends = lambda s: F.endswith("utt_id", F.lit(s))
    return (m.filter(ends("3")).withColumn("error", F.lit("old")),
            m.filter(ends("33") | ends("44")).withColumn("error", F.lit("new")))


@query("deadletter_merge", f"""with {SQL_LOGS} select * from new union all
 select * from old where not exists (select 1 from new where new.dataset_id=old.dataset_id and new.utt_id=old.utt_id)""",
       ["v_manifest"])
def q_deadletter_merge(spark, sf_dir):
    return R.deadletter_merge(*_logs(spark, sf_dir), partial=True)


@query("deadletter_merge_full", f"with {SQL_LOGS} select * from new", ["v_manifest"])
def q_deadletter_merge_full(spark, sf_dir):
    return R.deadletter_merge(*_logs(spark, sf_dir), partial=False)


# --- histories ---------------------------------------------------------------

SQL_LAST = """(select * from v_history qualify row_number() over (partition by run, epoch order by seq desc)=1)"""


def _history(spark, sf_dir):
    return R.latest_wins(view(spark, sf_dir, "v_history"), ["run", "epoch"], ["seq"])


@query("history_truncate", f"select run, epoch, val_eer from {SQL_LAST} where coalesce(epoch,-1)<=80", ["v_history"])
def q_history_truncate(spark, sf_dir):
    return R.history_truncate(_history(spark, sf_dir), 80).select("run", "epoch", "val_eer")


@query("best_epoch", f"""select run, epoch, val_eer from {SQL_LAST} where val_eer is not null
 qualify row_number() over (partition by run order by val_eer, epoch)=1""", ["v_history"])
def q_best_epoch(spark, sf_dir):
    return R.best_epoch(_history(spark, sf_dir), ["run"])


@query("running_best", f"""select run, epoch, val_eer, min(val_eer) over (partition by run order by epoch) best_so_far,
 val_eer is not null and coalesce(val_eer < min(val_eer) over (partition by run order by epoch
   rows between unbounded preceding and 1 preceding), true) improved from {SQL_LAST}""", ["v_history"])
def q_running_best(spark, sf_dir):
    return R.running_best(_history(spark, sf_dir), ["run"]).select("run", "epoch", "val_eer", "best_so_far", "improved")


SQL_BEST = f"""(select run, epoch from {SQL_LAST} where val_eer is not null
 qualify row_number() over (partition by run order by val_eer, epoch)=1)"""


@query("threshold_by_epoch", f"""select h.run, h.epoch, h.val_threshold from v_history h join {SQL_BEST} b
 on b.run=h.run and b.epoch=h.epoch qualify row_number() over (partition by h.run, h.epoch order by seq desc)=1""", ["v_history"])
def q_threshold_by_epoch(spark, sf_dir):
    best = R.best_epoch(_history(spark, sf_dir), ["run"])
    return R.threshold_by_epoch(view(spark, sf_dir, "v_history"), best, ["run"], ["seq"])


@query("threshold_by_epoch_first", f"""select h.run, h.epoch, h.val_threshold from v_history h join {SQL_BEST} b
 on b.run=h.run and b.epoch=h.epoch qualify row_number() over (partition by h.run, h.epoch order by seq)=1""", ["v_history"])
def q_threshold_by_epoch_first(spark, sf_dir):
    best = R.best_epoch(_history(spark, sf_dir), ["run"])
    return R.threshold_by_epoch(view(spark, sf_dir, "v_history"), best, ["run"], ["seq"], first=True)


@query("run_fingerprint", """select dataset_id, sha1('{"weights":"best","epoch":' || cast(max_epoch as string)
 || ',"model_name":"statpool_mlp","feature_id":null,"t_fixed":400,"window":"fixed","selectors":['
 || sel || ']}') run_id from (select dataset_id, count(*)%50 max_epoch,
 string_agg(distinct '"' || dataset_id || ':' || split || '"', ',' order by '"' || dataset_id || ':' || split || '"') sel
 from v_manifest group by dataset_id)""", ["v_manifest"])
def q_run_fingerprint(spark, sf_dir):
    """One run per dataset over the splits it has."""
    per = _manifest(spark, sf_dir).groupBy("dataset_id").agg(
        (F.count("*") % 50).alias("epoch"),
        F.collect_set(F.concat_ws(":", "dataset_id", "split")).alias("selectors"))
    return per.select("dataset_id", run_fingerprint(
        F.lit("best"), F.col("epoch"), F.lit("statpool_mlp"), F.lit(None).cast("string"),
        F.lit(400), F.lit("fixed"), F.col("selectors")).alias("run_id"))
