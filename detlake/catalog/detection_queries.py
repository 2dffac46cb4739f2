"""Registered queries: detection metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from detlake import fixed_values as fv
from detlake.catalog.base import query, rounded
from detlake.catalog.views import view
from detlake.functions import numeric as N
from detlake.operators import bootstrap, detection as D


def sql_curve(src: str, g: str, keep: str = "rn=1 or rn=cnt or lp<>p or ln<>n") -> str:
    """CTEs up to the kept ROC nodes of ``src`` grouped by ``g``."""
    return f"""
nodes as (select {g}, score, cast(sum(label) as bigint) p, cast(count(*)-sum(label) as bigint) n
  from {src} group by {g}, score),
cum as (select *, sum(p) over (partition by {g} order by score desc) tp,
  sum(n) over (partition by {g} order by score desc) fp,
  sum(p) over (partition by {g}) ap, sum(n) over (partition by {g}) an,
  row_number() over (partition by {g} order by score desc) rn, count(*) over (partition by {g}) cnt,
  lead(p) over (partition by {g} order by score desc) lp,
  lead(n) over (partition by {g} order by score desc) ln from nodes),
kept as (select * from cum where ap>0 and an>0 and ({keep}))"""


def sql_eer(src: str, g: str) -> str:
    """Statement giving ``<g>, eer, threshold`` of the groups of ``src``."""
    return f"""
with {sql_curve(src, g)},
pts as (select {g}, score, tp, fp, an, cast((ap-tp)*an-fp*ap as double) k from kept
  union all select distinct {g}, cast('infinity' as double), 0, 0, an, cast(ap*an as double) from kept),
a as (select {g}, arg_min(score, k) s, arg_min(fp, k) f, min(k) k, max(an) an from pts where k>=0 group by {g}),
b as (select {g}, arg_max(score, k) s, arg_max(fp, k) f, max(k) k from pts where k<0 group by {g}),
lim as (select {g}, min(score) lo, max(score) hi from nodes group by {g})
select {g}, (a.f + a.k/(a.k-b.k)*(b.f-a.f))/a.an eer,
 case when isinf(a.s) then case when hi>lo then cast('infinity' as double) end
      else a.s + a.k/(a.k-b.k)*(b.s-a.s) end threshold
from lim left join a using ({g}) left join b using ({g})"""


EER_SCORES = sql_eer("v_scores", "dataset_id")


def _scores(spark, sf_dir):
    return view(spark, sf_dir, "v_scores")


@query("eer", f"select dataset_id, round(eer, 9) eer, round(threshold, 6) threshold from ({EER_SCORES})",
       ["v_scores"])
def q_eer(spark, sf_dir):
    out = D.eer(_scores(spark, sf_dir), ["dataset_id"])
    return out.select("dataset_id", rounded("eer", 9).alias("eer"), rounded("threshold", 6).alias("threshold"))


@query("eer_lineitem",
       "select dataset_id, round(eer, 9) eer, round(threshold, 4) threshold from ("
       + sql_eer("v_line_scores", "dataset_id") + ")", ["v_line_scores"])
def q_eer_lineitem(spark, sf_dir):
    out = D.eer(view(spark, sf_dir, "v_line_scores"), ["dataset_id"])
    return out.select("dataset_id", rounded("eer", 9).alias("eer"), rounded("threshold", 4).alias("threshold"))


SQL_BY_ATTACK = """
with grp as (select dataset_id, {by} kind, count(*) n_spoof from {src}
   where label=1 and {by} is not null group by dataset_id, {by}),
rep as (select g.dataset_id || '|' || g.kind gk, s.label, s.score from grp g join {src} s
   on s.dataset_id=g.dataset_id and (s.label=0 or (s.label=1 and s.{by}=g.kind))),
e as ({eer})
select grp.dataset_id, grp.kind {by}, grp.n_spoof, round(e.eer, 6) eer
from grp join e on e.gk = grp.dataset_id || '|' || grp.kind"""


def sql_by(src: str, by: str) -> str:
    return SQL_BY_ATTACK.format(src=src, by=by, eer=sql_eer("rep", "gk"))


@query("eer_by_group", sql_by("v_scores", "attack_type"), ["v_scores"])
def q_eer_by_group(spark, sf_dir):
    return D.eer_by_group(_scores(spark, sf_dir), ["dataset_id"]).withColumn("eer", rounded("eer", 6))


@query("eer_by_attack_lineitem", sql_by("v_line_scores", "attack_type"), ["v_line_scores"])
def q_eer_by_attack_lineitem(spark, sf_dir):
    out = D.eer_by_group(view(spark, sf_dir, "v_line_scores"), ["dataset_id"])
    return out.withColumn("eer", rounded("eer", 6))


@query("eer_by_condition", sql_by("c_scores", "grp").replace("with grp as", """with c_scores as (
  select s.dataset_id, s.label, s.score, m."condition" grp from v_scores s join v_manifest m
  on s.dataset_id=m.dataset_id and s.utt_id=m.utt_id), grp as""", 1)
       .replace("grp.kind grp", 'grp.kind "condition"'), ["v_scores", "v_manifest"])
def q_eer_by_condition(spark, sf_dir):
    m = view(spark, sf_dir, "v_manifest").select("dataset_id", "utt_id", "condition")
    s = _scores(spark, sf_dir).join(m, ["dataset_id", "utt_id"])
    return D.eer_by_group(s, ["dataset_id"], ["condition"]).withColumn("eer", rounded("eer", 6))


@query("negatives_per_attack", """
select g.dataset_id, g.attack_type, g.n_spoof, count(*) n_bonafide,
  cast(sum(case when s.score>=g.top then 1 else 0 end) as bigint) n_bonafide_at_top
from (select dataset_id, attack_type, count(*) n_spoof, max(score) top from v_scores
      where label=1 and attack_type is not null group by dataset_id, attack_type) g
join v_scores s on s.dataset_id=g.dataset_id and s.label=0
group by g.dataset_id, g.attack_type, g.n_spoof""", ["v_scores"])
def q_negatives_per_attack(spark, sf_dir):
    """All negatives of the dataset meet each attack, through counts instead of copies."""
    return D.negatives_at_or_above(_scores(spark, sf_dir), ["dataset_id"])


SQL_ROC = f"""with {sql_curve('v_scores', 'dataset_id')}
select dataset_id, score threshold, round(cast(fp as double)/an, 9) fpr, round(cast(tp as double)/ap, 9) tpr from kept
union all select distinct dataset_id, cast('infinity' as double), 0.0e0, 0.0e0 from kept"""


@query("roc_points", SQL_ROC, ["v_scores"])
def q_roc_points(spark, sf_dir):
    out = D.roc_points(_scores(spark, sf_dir), ["dataset_id"])
    return out.select("dataset_id", "threshold", rounded("fpr", 9).alias("fpr"), rounded("tpr", 9).alias("tpr"))


def sql_probit(p: str) -> str:
    """The probit expression of :func:`detlake.functions.numeric.probit` as SQL."""
    def poly(x, cs):
        out = repr(cs[0])
        for c in cs[1:]:
            out = f"({out}*({x})+({c!r}))"
        return out

    def tail(q):
        u = f"sqrt(-2*ln({q}))"
        return f"({poly(u, N.PROBIT_C)}/{poly(u, N.PROBIT_D)})"

    c = f"({p}-0.5)"
    mid = f"({poly(f'{c}*{c}', N.PROBIT_A)}*{c}/{poly(f'{c}*{c}', N.PROBIT_B)})"
    return (f"case when {p}<=0 then null when {p}>=1 then cast('infinity' as double) "
            f"when {p}<{N.PROBIT_TAIL} then {tail(p)} "
            f"when {p}>1-{N.PROBIT_TAIL} then -{tail(f'(1-{p})')} else {mid} end")


@query("det_points", f"""with {sql_curve('v_scores', 'dataset_id')},
r as (select dataset_id, score threshold, cast(fp as double)/an fpr, 1-cast(tp as double)/ap fnr from kept)
select dataset_id, threshold, round(fpr, 9) fpr, round(fnr, 9) fnr,
 round({sql_probit('fpr')}, 6) probit_fpr, round({sql_probit('fnr')}, 6) probit_fnr
from r where fpr>0 and fnr>0""", ["v_scores"])
def q_det_points(spark, sf_dir):
    out = D.det_points(_scores(spark, sf_dir), ["dataset_id"])
    return out.select("dataset_id", "threshold", *[
        rounded(c, d).alias(c) for c, d in
        [("fpr", 9), ("fnr", 9), ("probit_fpr", 6), ("probit_fnr", 6)]
    ])


SQL_CONFUSION = """select dataset_id, 280.0e0 threshold,
 cast(sum(case when label=0 and score<280 then 1 else 0 end) as bigint) tn,
 cast(sum(case when label=0 and score>=280 then 1 else 0 end) as bigint) fp,
 cast(sum(case when label=1 and score<280 then 1 else 0 end) as bigint) fn,
 cast(sum(case when label=1 and score>=280 then 1 else 0 end) as bigint) tp
from v_scores group by dataset_id"""


@query("confusion_at", SQL_CONFUSION, ["v_scores"])
def q_confusion_at(spark, sf_dir):
    return D.confusion_at(_scores(spark, sf_dir), ["dataset_id"], 280.0)


@query("error_rates", f"""select *, round(cast(fp as double)/nullif(tn+fp,0), 9) fpr,
 round(cast(fn as double)/nullif(fn+tp,0), 9) fnr from ({SQL_CONFUSION})""", ["v_scores"])
def q_error_rates(spark, sf_dir):
    out = D.error_rates(D.confusion_at(_scores(spark, sf_dir), ["dataset_id"], 280.0))
    return out.withColumn("fpr", rounded("fpr", 9)).withColumn("fnr", rounded("fnr", 9))


@query("confusion_row_share", f"""with c as ({SQL_CONFUSION}),
u as (select dataset_id, 'bonafide' actual, 'bonafide' predicted, tn n, tn+fp w from c
 union all select dataset_id, 'bonafide', 'spoof', fp, tn+fp from c
 union all select dataset_id, 'spoof', 'bonafide', fn, fn+tp from c
 union all select dataset_id, 'spoof', 'spoof', tp, fn+tp from c)
select dataset_id, actual, predicted, n, round(cast(n as double)/nullif(w,0), 9) share from u""", ["v_scores"])
def q_confusion_row_share(spark, sf_dir):
    c = D.confusion_at(_scores(spark, sf_dir), ["dataset_id"], 280.0)
    return D.confusion_row_share(c, ["dataset_id"]).withColumn("share", rounded("share", 9))


@query("operating_points", f"""with e as ({EER_SCORES}),
t as (select dataset_id, 'eer' "at", threshold from e where eer is not null
 union all select dataset_id, 'val', avg_t from
   (select dataset_id, cast(floor(avg(score)) as double) avg_t from v_scores where split='dev' group by dataset_id)),
c as (select t.dataset_id, t."at", t.threshold,
 cast(sum(case when label=0 and score<threshold then 1 else 0 end) as bigint) tn,
 cast(sum(case when label=0 and score>=threshold then 1 else 0 end) as bigint) fp,
 cast(sum(case when label=1 and score<threshold then 1 else 0 end) as bigint) fn,
 cast(sum(case when label=1 and score>=threshold then 1 else 0 end) as bigint) tp
 from t join v_scores s on s.dataset_id=t.dataset_id group by t.dataset_id, t."at", t.threshold)
select dataset_id, "at", round(threshold, 6) threshold, tn, fp, fn, tp,
 round(cast(fp as double)/nullif(tn+fp,0), 9) fpr, round(cast(fn as double)/nullif(fn+tp,0), 9) fnr from c""",
       ["v_scores"])
def q_operating_points(spark, sf_dir):
    s = _scores(spark, sf_dir)
    val = s.filter("split = 'dev'").groupBy("dataset_id").agg(
        F.floor(F.avg("score")).cast("double").alias("threshold")
    )
    out = D.operating_points(s, val)
    return out.select("dataset_id", "at", rounded("threshold", 6).alias("threshold"),
                      "tn", "fp", "fn", "tp", rounded("fpr", 9).alias("fpr"), rounded("fnr", 9).alias("fnr"))


def sql_boot(n_boot: int) -> str:
    """CTEs up to ``x``: the EER of each dataset and replicate."""
    return f"""with rk as (select dataset_id, label, score,
  row_number() over (partition by dataset_id, label order by score)-1 i,
  count(*) over (partition by dataset_id, label) size from v_scores),
reps as (select unnest(range({n_boot})) rep),
dr as (select dataset_id, label, rep,
  ('0x' || substr(md5(concat_ws(',', '1337', dataset_id, cast(label as string), cast(rep as string), cast(i as string))),1,8))::bigint % size pick
  from rk, reps),
bs as (select d.dataset_id || '|' || cast(d.rep as string) gk, r.label, r.score from dr d
  join rk r on r.dataset_id=d.dataset_id and r.label=d.label and r.i=d.pick),
e as ({sql_eer('bs', 'gk')}),
x as (select split_part(gk, '|', 1) dataset_id, split_part(gk, '|', 2) rep, eer from e)
"""


@query("eer_bootstrap_md5", sql_boot(5) + """select dataset_id, round(quantile_cont(eer, 0.025), 9) lo,
 round(quantile_cont(eer, 0.975), 9) hi, count(*) n_boot from x group by dataset_id""", ["v_scores"])
def q_eer_bootstrap_md5(spark, sf_dir):
    out = bootstrap.eer_bootstrap_hashed(_scores(spark, sf_dir), 5)
    return out.select("dataset_id", rounded("lo", 9).alias("lo"), rounded("hi", 9).alias("hi"), "n_boot")


@query("eer_bootstrap", f"select dataset_id, cast(100 as bigint) n_boot, true around, true narrow from ({EER_SCORES}) where eer is not null",
       ["v_scores"])
def q_eer_bootstrap(spark, sf_dir):
    """The default form: its interval holds the EER of the data and is no wider than chance allows."""
    s = _scores(spark, sf_dir)
    sizes = s.groupBy("dataset_id").agg(F.least(F.sum("label"), F.sum(1 - F.col("label"))).alias("least"))
    got = bootstrap.eer_bootstrap(s, 100).join(D.eer(s, ["dataset_id"]), "dataset_id").join(sizes, "dataset_id")
    around = F.col("eer").between(F.col("lo"), F.col("hi"))
    narrow = F.col("hi") - F.col("lo") <= 5 / F.sqrt("least")
    return got.select("dataset_id", "n_boot", around.alias("around"), narrow.alias("narrow"))


SQL_REPORT = f"""with e as ({EER_SCORES})
select s.dataset_id, count(*) n, cast(sum(1-label) as bigint) bonafide, cast(sum(label) as bigint) spoof,
 round_even(round_even(max(e.eer), 6)*100, 2) eer_pct
from v_scores s left join e using (dataset_id) group by s.dataset_id"""


@query("eer_report", SQL_REPORT, ["v_scores"])
def q_eer_report(spark, sf_dir):
    return D.eer_report(_scores(spark, sf_dir))


@query("eer_report_ci", sql_boot(fv.DEFAULT_BOOTSTRAP) + f""", ci as (select dataset_id, quantile_cont(eer, 0.025) lo,
 quantile_cont(eer, 0.975) hi from x group by dataset_id)
select r.*, round_even(round_even(lo, 6)*100, 2) ci_lo_pct, round_even(round_even(hi, 6)*100, 2) ci_hi_pct
from ({SQL_REPORT}) r join ci using (dataset_id)""", ["v_scores"])
def q_eer_report_ci(spark, sf_dir):
    s = _scores(spark, sf_dir)
    return D.eer_report(s, bootstrap.eer_bootstrap_hashed(s, fv.DEFAULT_BOOTSTRAP))


@query("cumulative_by_range", """select dataset_id, score, p, n,
 cast(sum(p) over (partition by dataset_id order by score desc) as bigint) cum_p,
 cast(sum(n) over (partition by dataset_id order by score desc) as bigint) cum_n
from (select dataset_id, score, cast(sum(label) as bigint) p, cast(count(*)-sum(label) as bigint) n
      from v_line_scores group by dataset_id, score)""", ["v_line_scores"])
def q_cumulative_by_range(spark, sf_dir):
    from detlake.operators.prefix import running_totals

    nodes = D.score_nodes(view(spark, sf_dir, "v_line_scores"), ["dataset_id"])
    return running_totals(nodes, ["dataset_id"], "score", ["p", "n"], descending=True)


SQL_GATED = """select dataset_id, utt_id, label, case
   when cast(substr(utt_id, 2) as bigint) % 97 = 0 then cast('nan' as double)
   when cast(substr(utt_id, 2) as bigint) % 89 = 0 then cast('infinity' as double)
   when cast(substr(utt_id, 2) as bigint) % 83 = 0 then cast('-infinity' as double)
   when cast(substr(utt_id, 2) as bigint) % 79 = 0 then null else score end score from v_scores"""


@query("score_gate", f"""with p_scores as ({SQL_GATED}),
u_scores as (select * from p_scores where score is not null and not isnan(score)),
e as ({sql_eer('u_scores', 'dataset_id')}),
u as (select dataset_id, count(*) n_report,
  cast(sum(case when label=1 and score>=200 then 1 else 0 end) as bigint) tp,
  cast(sum(case when label=0 and score>=200 then 1 else 0 end) as bigint) fp from u_scores group by dataset_id),
c as (select dataset_id, count(*) n, cast(sum(case when score is null then 1 else 0 end) as bigint) n_null,
  cast(sum(case when isnan(score) then 1 else 0 end) as bigint) n_nan,
  cast(sum(case when isinf(score) then 1 else 0 end) as bigint) n_infinite from p_scores group by dataset_id)
select c.*, n - n_null - n_nan n_used, n_report, tp, fp, n_report n_confusion, round(eer, 9) eer
from c join u using (dataset_id) join e using (dataset_id)""", ["v_scores"])
def q_score_gate(spark, sf_dir):
    """All metrics count the same rows when some scores are NaN, NULL or infinite."""
    k = F.substring("utt_id", 2, 20).cast("long")
    score = (F.when(k % 97 == 0, float("nan")).when(k % 89 == 0, float("inf"))
             .when(k % 83 == 0, float("-inf")).when(k % 79 != 0, F.col("score")))
    s = _scores(spark, sf_dir).withColumn("score", score)
    found = D.eer(s, ["dataset_id"])
    at = D.confusion_at(s, ["dataset_id"], 200.0)
    cells = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    at = at.select("dataset_id", "tp", "fp", cells.alias("n_confusion"))
    report = D.eer_report(s, point=found).select("dataset_id", F.col("n").alias("n_report"))
    return (
        D.score_gate(s, ["dataset_id"]).drop("n_no_label").join(report, "dataset_id").join(at, "dataset_id")
        .join(found.select("dataset_id", rounded("eer", 9).alias("eer")), "dataset_id")
    )
