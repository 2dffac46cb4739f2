"""Registered queries: scorers and the evaluation run."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from detlake import fixed_values as fv
from detlake.catalog.base import query, rounded
from detlake.catalog.detection_queries import sql_eer
from detlake.catalog.views import view
from detlake.operators.frames import pooled_features
from detlake.operators.resume import present_in_cache
from detlake.plans import scoring as Sc
from detlake.plans.evaluate import RunConditions, evaluate_experiment
from detlake.session import materialize, shared_path

C, H, T = 4, 2, 24

# A tiny network with plain weights, written out so that SQL can repeat it.
WEIGHTS = Sc.StatPoolWeights(
    frame_w=np.array([[1.0, -0.5, 0.25, 2.0], [-1.5, 1.0, 0.75, -0.25]]),
    frame_b=np.array([0.05, 0.1]),
    hidden_w=np.array([[1.0, -2.0, 3.0, 0.5], [-0.5, 1.5, -1.0, 2.0]]),
    hidden_b=np.array([0.1, -0.05]),
    out_w=np.array([2.0, -1.5]),
    out_b=0.25,
)


def sql_statpool() -> str:
    """``dataset_id, utt_id, label, score`` of the tiny network on ``v_emb_frames``."""
    w = WEIGHTS
    h = [" + ".join(f"c{i}*({float(w.frame_w[j][i])!r})" for i in range(C))
         + f" + {float(w.frame_b[j])!r}" for j in range(H)]
    stats = ["m0", "m1", "s0", "s1"]
    hid = [" + ".join(f"{s}*({float(w.hidden_w[j][i])!r})" for i, s in enumerate(stats))
           + f" + ({float(w.hidden_b[j])!r})" for j in range(H)]
    return f"""select dataset_id, utt_id, label,
 greatest({hid[0]}, 0)*({float(w.out_w[0])!r}) + greatest({hid[1]}, 0)*({float(w.out_w[1])!r}) + {w.out_b!r} score
from (select dataset_id, utt_id, label, avg(h0) m0, avg(h1) m1,
  sqrt(greatest(var_pop(h0), 1e-5)) s0, sqrt(greatest(var_pop(h1), 1e-5)) s1
 from (select *, greatest({h[0]}, 0) h0, greatest({h[1]}, 0) h1 from
   (select * from v_emb_frames union all select * replace (frame+16 as frame) from v_emb_frames) where frame<{T})
 group by dataset_id, utt_id, label)"""


def _frames(spark, sf_dir):
    return view(spark, sf_dir, "v_emb_frames")


def _labels(spark, sf_dir):
    return view(spark, sf_dir, "v_wave").select("dataset_id", "utt_id", "label")


@query("score_statpool_mlp", f"select dataset_id, utt_id, round(score, 7)+0.0 score from ({sql_statpool()})", ["v_emb_frames"])
def q_score_statpool_mlp(spark, sf_dir):
    out = Sc.score_statpool_mlp(_frames(spark, sf_dir), C, T, WEIGHTS)
    return out.withColumn("score", rounded("score", 7))


def _pooled(spark, sf_dir):
    """Pooled vectors with label and a split by key."""
    p = pooled_features(_frames(spark, sf_dir), C, T)
    n = F.substring("utt_id", 2, 20).cast("long")
    split = F.when(n % 10 < 6, "train").when(n % 10 < 8, "dev").otherwise("test")
    return materialize(p.join(_labels(spark, sf_dir), ["dataset_id", "utt_id"]).withColumn("split", split), "pooled")


@query("fit_scorer", f"""select cast(t as integer) term, true flat, (select count(*) from v_wave
 where cast(substr(utt_id,2) as bigint)%10<6) n_train from range({2 * C + 1}) r(t)""", ["v_wave"])
def q_fit_scorer(spark, sf_dir):
    """The class-weighted log loss is flat at the fit: every part of its gradient is near zero."""
    train = _pooled(spark, sf_dir).filter("split = 'train'")
    model = Sc.fit_scorer(train, max_iter=200)
    w = Sc.class_weight(train)
    scored = Sc.batch_score(model, train.withColumn("x", F.col("features")))
    miss = (F.col("label") - 1 / (1 + F.exp(-F.col("score")))) * F.when(F.col("label") == 1, w).otherwise(1.0)
    terms = [F.col("x")[i] for i in range(2 * C)] + [F.lit(1.0)]
    parts = [
        F.struct(F.lit(i).alias("term"), (F.abs(F.sum(miss * x)) < 1e-3 * F.sum(F.abs(miss * x))).alias("flat"))
        for i, x in enumerate(terms)
    ]
    return scored.agg(F.array(*parts).alias("t"), F.count("*").alias("n_train")).select(F.inline("t"), "n_train")


@query("batch_score", "select dataset_id, utt_id, label, true agrees from v_wave", ["v_wave"])
def q_batch_score(spark, sf_dir):
    """Scores of all keys against intercept and coefficients written out as a sum."""
    p = _pooled(spark, sf_dir)
    model = Sc.fit_scorer(p.filter("split = 'train'"))
    scored = Sc.batch_score(model, p.withColumn("x", F.col("features")))
    total = F.lit(float(model.intercept))
    for i, c in enumerate(model.coefficients):
        total = total + F.lit(float(c)) * F.col("x")[i]
    agrees = F.abs(F.col("score") - total) <= 1e-9 * (1 + F.abs(total))
    return scored.select("dataset_id", "utt_id", "label", agrees.alias("agrees"))


PLANTED = ["score", "-score", "score + 30 * label", "0.0"]
SQL_PLANTED = " union all ".join(f"select {i} candidate, label, cast({s} as double) score from v_scores" for i, s in enumerate(PLANTED))


@query("select_by_val_eer", f"""with p as ({SQL_PLANTED}), e as ({sql_eer('p', 'candidate')})
select cast(candidate as integer) candidate, round(eer, 9) val_eer, eer = min(eer) over () best from e""", ["v_scores"])
def q_select_by_val_eer(spark, sf_dir):
    """Planted candidates: the scores as they are, reversed, shifted for spoof, and constant."""
    s = view(spark, sf_dir, "v_scores")
    planted = [s.select(F.lit(i).alias("candidate"), "label", F.expr(e).cast("double").alias("score")) for i, e in enumerate(PLANTED)]
    best, found = Sc.least_eer(reduce(DataFrame.unionByName, planted))
    return found.select("candidate", rounded("val_eer", 9).alias("val_eer"), (F.col("candidate") == best).alias("best"))


@query("fit_and_select", """select dataset_id, count(*) n_scored, true in_range from v_wave group by dataset_id""", ["v_wave"])
def q_fit_and_select(spark, sf_dir):
    """Three fits chosen by dev EER; the chosen one scores all frames through the scorer interface."""
    p = _pooled(spark, sf_dir)
    grid = [{"reg": 0.0}, {"reg": 0.1}, {"reg": 0.1, "weight": "none"}]
    _, model, found = Sc.select_by_val_eer(p.filter("split = 'train'"), p.filter("split = 'dev'"), grid)
    ok = found.filter("val_eer between 0 and 1").count() == len(grid)
    scored = Sc.SCORERS.get("logistic")(model, C, T).score(_frames(spark, sf_dir))
    finite = F.count_if(F.abs("score") < float("inf")) == F.count("*")
    return scored.groupBy("dataset_id").agg(F.count("*").alias("n_scored"), (finite & F.lit(ok)).alias("in_range"))


SQL_EVAL = f"""with s as (select * from ({sql_statpool()}) where cast(substr(utt_id,2) as bigint)%200<>7),
e as ({sql_eer('s', 'dataset_id')})
select s.dataset_id, count(*) n, cast(sum(1-label) as bigint) n_bonafide, cast(sum(label) as bigint) n_spoof,
 round(max(e.eer), 6)+0.0 eer, round(max(e.threshold), 6)+0.0 eer_threshold
from s join e using (dataset_id) group by s.dataset_id"""


@query("evaluate_experiment", SQL_EVAL, ["v_emb_frames"])
def q_evaluate_experiment(spark, sf_dir):
    """A whole run: selection, scoring with a gap in the features, coverage, metrics."""
    frames = _frames(spark, sf_dir)
    have = frames.filter(F.substring("utt_id", 2, 20).cast("long") % 200 != 7)
    manifest = _labels(spark, sf_dir).withColumn("split", F.lit("test")).withColumn(
        "attack_type", F.when(F.col("label") == 1, F.substring("utt_id", -1, 1)))
    selectors = [("emb0", "test"), ("emb1", "test"), ("emb2", "test")]
    out = evaluate_experiment(
        manifest, selectors,
        lambda rows: Sc.SCORERS.get("statpool_mlp")(WEIGHTS, C, T).score(present_in_cache(have, rows)),
        RunConditions("tiny", 1, "statpool_mlp", "raw4", T, "fixed", selectors),
        shared_path(spark, "scores"), n_boot=0, min_coverage=0.9,
    )
    return out["summary"].select(
        "dataset_id", "n", "n_bonafide", "n_spoof",
        rounded("eer", 6).alias("eer"), rounded("eer_threshold", 6).alias("eer_threshold"))
