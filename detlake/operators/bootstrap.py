"""Stratified bootstrap intervals for the EER.

Both methods resample each class by itself with its size kept exactly and take a
percentile interval.

``eer_bootstrap`` draws multinomial counts in two steps: first how many
resampled rows fall in each bin of scores, then, only in the bin where the
curves cross, how many fall on each score. Counts inside a bin depend on the
bin's total alone, so the result follows the same law as resampling every row,
for the cost of the bins instead of rows times replicates.

``eer_bootstrap_hashed`` draws row by row from md5, so that another engine can
repeat it to the digit. It costs rows times replicates. Every row is drawn in every
replicate, but a draw is only counted where it is made: by score close to the
crossing of the data, as above or below elsewhere. Exact counts prove for each replicate that its
crossing lies there; the others are drawn again and joined with all their rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from detlake import fixed_values as fv
from detlake.functions.md5 import md5_heads
from detlake.functions.numeric import md5_int
from detlake.operators import prefix
from detlake.operators.detection import curve_of, eer_of_nodes, eer_of_zoned, gate, ranged_nodes, score_nodes
from detlake.session import materialize, ship_package

CHUNK = 50      # replicates drawn together
PIECE = 10_000  # ranks of one score, or draws, written out together
DRAWS = 250_000  # draws a task joins with their rows
COUNTED = 1_000_000  # draws a task counts
AT_ONCE = 16_384  # draws hashed together
SIGMAS = 6.0    # standard errors of the difference of the two rates that a bracket reaches beyond the crossing
MOST = 100_000  # scores of a class inside its bracket; a group with more is joined with its rows


def _generator(seed: int, *parts) -> np.random.Generator:
    """Generator named by its place in the job, not by the task that runs it."""
    digest = hashlib.sha1(repr((seed, *parts)).encode()).digest()
    return np.random.default_rng(np.frombuffer(digest[:16], np.uint32))


def _multinomial(rng: np.random.Generator, total: int, weights: np.ndarray) -> np.ndarray:
    if total == 0 or not weights.sum():
        return np.zeros(len(weights), np.int64)
    return rng.multinomial(total, weights / weights.sum())


def _first_below(tp, fp, all_p: int, all_n: int) -> int:
    """Index of the first place where FPR exceeds FNR, in exact integers."""
    balance = (all_p - tp).astype(object) * all_n - fp.astype(object) * all_p
    rough = (all_p - tp).astype(float) * all_n - fp.astype(float) * all_p
    near = np.abs(rough) <= 1e-9 * all_p * all_n
    side = np.sign(rough)
    side[near] = [np.sign(b) for b in balance[near]]
    return int(np.argmax(side < 0))


def eer_replicates(
    scores: DataFrame,
    n_boot: int = fv.DEFAULT_BOOTSTRAP,
    seed: int = fv.DEFAULT_SEED,
    group: str = "dataset_id",
) -> DataFrame:
    """One EER per group and replicate: ``<group>, rep, eer``."""
    ship_package(scores.sparkSession)
    # Bins by rank: about sqrt(rows) bins of at most sqrt(rows) scores, whatever the
    # values are and however the table is stored.
    curve = curve_of(ranged_nodes(score_nodes(scores, [group]), [group]), [group], False)
    step = F.ceil(F.sqrt(F.col("all_p") + F.col("all_n")))
    at = F.floor((F.col("tp") + F.col("fp") - 1) / step).alias("_bin")
    ranged = materialize(curve.select(group, at, "score", "p", "n"), "boot_nodes")

    # The bins of a group as arrays.
    bins = ranged.groupBy(group, "_bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    hist = (
        bins.groupBy(group)
        .agg(
            F.sort_array(F.collect_list(F.struct("_bin", "p", "n"))).alias("bins"),
            F.sum("p").alias("all_p"), F.sum("n").alias("all_n"),
        )
        .filter((F.col("all_p") > 0) & (F.col("all_n") > 0))
    )
    chunks = hist.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // CHUNK))).alias("chunk")
    ).repartition(group, "chunk")

    def cross(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                name = getattr(row, group)
                p = np.array([b["p"] for b in row.bins], np.int64)
                n = np.array([b["n"] for b in row.bins], np.int64)
                out = []
                for rep in range(row.chunk * CHUNK, min(n_boot, (row.chunk + 1) * CHUNK)):
                    rng = _generator(seed, name, rep)
                    cp = _multinomial(rng, row.all_p, p)
                    cn = _multinomial(rng, row.all_n, n)
                    tp, fp = np.cumsum(cp), np.cumsum(cn)
                    i = _first_below(tp, fp, row.all_p, row.all_n)
                    at = row.bins[i]
                    out.append((
                        name, rep, at["_bin"], int(cp[i]), int(cn[i]),
                        int(tp[i] - cp[i]), int(fp[i] - cn[i]), row.all_p, row.all_n,
                    ))
                yield pd.DataFrame(out, columns=[
                    group, "rep", "_bin", "draw_p", "draw_n", "tp", "fp",
                    "all_p", "all_n",
                ])

    crossings = chunks.mapInPandas(
        cross,
        f"{group} string, rep int, _bin long, draw_p long, draw_n long, "
        "tp long, fp long, all_p long, all_n long",
    )
    crossings = materialize(crossings, "boot_crossings").withColumn(
        "chunk", F.floor(F.col("rep") / CHUNK)
    )

    # Only the crossing ranges are opened, once per chunk of replicates.
    place = [group, "_bin", "chunk"]
    wanted = crossings.select(*[F.col(c).alias(c) for c in place]).distinct()
    inside = ranged.join(wanted, [group, "_bin"]).select(*place, "score", "p", "n")

    def settle(nodes: pd.DataFrame, reps: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("score", ascending=False, kind="stable")
        p, n = nodes["p"].to_numpy(), nodes["n"].to_numpy()
        out = []
        for r in reps.sort_values("rep").itertuples(index=False):
            name = getattr(r, group)
            rng = _generator(seed, name, r.rep, "inside")
            cp, cn = _multinomial(rng, r.draw_p, p), _multinomial(rng, r.draw_n, n)
            hit = np.flatnonzero(cp + cn)
            tp, fp = r.tp + np.cumsum(cp)[hit], r.fp + np.cumsum(cn)[hit]
            i = _first_below(tp, fp, r.all_p, r.all_n)
            tp_a, fp_a = int(tp[i] - cp[hit][i]), int(fp[i] - cn[hit][i])
            k_a = (r.all_p - tp_a) * r.all_n - fp_a * r.all_p
            k_b = int(r.all_p - tp[i]) * r.all_n - int(fp[i]) * r.all_p
            out.append((name, r.rep, (fp_a + k_a / (k_a - k_b) * (int(fp[i]) - fp_a)) / r.all_n))
        return pd.DataFrame(out, columns=[group, "rep", "eer"])

    return (
        inside.groupBy(*place)
        .cogroup(crossings.groupBy(*place))
        .applyInPandas(settle, f"{group} string, rep int, eer double")
    )


def percentile_interval(
    replicates: DataFrame, ci: float = fv.DEFAULT_CI, group: str = "dataset_id"
) -> DataFrame:
    """``lo``, ``hi`` and the number of replicates behind them."""
    a = (1.0 - ci) / 2.0
    return (
        replicates.filter(F.col("eer").isNotNull())
        .groupBy(group)
        .agg(
            F.percentile("eer", a).alias("lo"), F.percentile("eer", 1.0 - a).alias("hi"),
            F.count("*").alias("n_boot"),
        )
    )


def eer_bootstrap(
    scores: DataFrame,
    n_boot: int = fv.DEFAULT_BOOTSTRAP,
    seed: int = fv.DEFAULT_SEED,
    ci: float = fv.DEFAULT_CI,
    group: str = "dataset_id",
) -> DataFrame:
    """Interval per group with both classes; none for ``n_boot`` of zero."""
    if n_boot <= 0:
        return scores.sparkSession.createDataFrame(
            [], f"{group} string, lo double, hi double, n_boot long"
        )
    return percentile_interval(eer_replicates(scores, n_boot, seed, group), ci, group)


def _class_nodes(scores: DataFrame, group: str) -> DataFrame:
    """One row per distinct score of a class: ``<group>, label, score, w, cum_w``, from the lowest up."""
    counts = (
        gate(scores)
        .groupBy(group, "label", F.col("score").cast("double").alias("score"))
        .agg(F.count("*").alias("w"))
    )
    return prefix.running_totals(counts, [group, "label"], "score", ["w"])


def _ranks(nodes: DataFrame, group: str, tasks: int) -> DataFrame:
    """The ranks of each node written out, in pieces dealt to ``tasks`` tasks."""
    start, end = F.col("cum_w") - F.col("w"), F.col("cum_w") - 1
    piece = lambda i: F.floor(i / PIECE).cast("long")
    pieces = nodes.select(
        group, "label", "score", start.alias("start"), end.alias("end"),
        F.explode(F.sequence(piece(start), piece(end))).alias("piece"),
    ).repartition(tasks, group, "label", "piece")
    ranks = F.sequence(
        F.greatest(F.col("start"), F.col("piece") * PIECE),
        F.least(F.col("end"), (F.col("piece") + 1) * PIECE - 1),
    )
    return pieces.select(group, "label", F.explode(ranks).alias("i"), "score")


def ranked_scores(scores: DataFrame, group: str) -> DataFrame:
    """One row per score row: ``<group>, label, i, score`` with ``i`` the rank in its class.

    Ranks come from the running count over distinct scores. A score that a third
    of the rows share is one node there; its ranks are written out in pieces that
    are spread first.
    """
    nodes = materialize(_class_nodes(scores, group), "boot_class_nodes")
    return _ranks(nodes, group, _tasks(nodes, 1))


def _tasks(nodes: DataFrame, n_boot: int) -> int:
    """Tasks that share the draws of all classes, ``DRAWS`` each.

    Rows are told by their counts here, as a few nodes or pieces become very many
    draws: their stored size says nothing about the work.
    """
    total = nodes.agg(F.sum("w")).first()[0] or 0
    return total * n_boot // DRAWS + 1


def _drawn(nodes: DataFrame, n_boot: int, seed: int, group: str, tasks: int, only: DataFrame | None = None) -> DataFrame:
    """Every draw: ``<group>, label, rep, pick``; ``only``: those of these groups and replicates."""
    sizes = nodes.groupBy(group, "label").agg(F.sum("w").alias("size"))
    reps = F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep")
    sizes = sizes.select("*", reps) if only is None else sizes.join(only, group)
    last = F.col("size") - 1
    pieces = (
        sizes.select("*", F.explode(F.sequence(F.lit(0), F.floor(last / PIECE).cast("long"))).alias("piece"))
        .repartition(tasks, group, "label", "piece", "rep")
    )
    ranks = F.sequence(F.col("piece") * PIECE, F.least(last, (F.col("piece") + 1) * PIECE - 1))
    return pieces.select(group, "label", "size", "rep", F.explode(ranks).alias("i")).select(
        group, "label", "rep",
        F.pmod(md5_int(F.lit(seed), group, "label", "rep", "i"), F.col("size")).alias("pick"),
    )


def _joined(nodes: DataFrame, n_boot: int, seed: int, group: str, only: DataFrame) -> DataFrame:
    """EER of the replicates in ``only`` from the whole curve.

    Draws find their row by rank through an equi-join, spread over all ranks. The
    tasks grow with the draws, so what one task holds stays the same.
    """
    nodes = nodes.join(only.select(group).distinct(), group, "left_semi")
    sizes = nodes.groupBy(group).agg(F.sum("w").alias("w"))
    tasks = (only.join(sizes, group).agg(F.sum("w")).first()[0] or 0) // DRAWS + 1
    place = [group, "label", "pick"]
    draws = _drawn(nodes, n_boot, seed, group, tasks, only).repartition(tasks, *place)
    ranked = _ranks(nodes, group, tasks).withColumnRenamed("i", "pick").repartition(tasks, *place)
    weighted = (
        draws.join(ranked.hint("shuffle_hash"), place)
        .groupBy(group, "rep", "score")
        .agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    )
    return eer_of_nodes(weighted, [group, "rep"]).select(group, "rep", "eer")


def _crossings(nodes: DataFrame, group: str) -> DataFrame:
    """``<group>, lo, hi`` of the groups with both classes: the scores between which replicates are likely to cross.

    One score more on either side belongs to them, as a node only counts once the next is known.
    """
    of_class = lambda y: F.coalesce(F.sum(F.when(F.col("label") == y, F.col("w"))), F.lit(0))
    both = nodes.groupBy(group, "score").agg(of_class(1).alias("p"), of_class(0).alias("n"))
    curve = curve_of(ranged_nodes(both, [group]), [group], False).filter("all_p > 0 and all_n > 0")
    off = (F.col("all_p") - F.col("tp")) / F.col("all_p") - F.col("fp") / F.col("all_n")
    margin = SIGMAS / 2 * F.sqrt(1 / F.col("all_p") + 1 / F.col("all_n"))
    curve = materialize(curve.select(group, "score", (off / margin).alias("off")), "boot_curve")
    ends = curve.groupBy(group).agg(
        F.max(F.when(F.col("off") < -1, F.col("score"))).alias("below"), F.min(F.when(F.col("off") > 1, F.col("score"))).alias("above"))
    return curve.join(ends, group).groupBy(group).agg(
        F.max(F.when(F.col("score") < F.col("below"), F.col("score"))).alias("lo"),
        F.min(F.when(F.col("score") > F.col("above"), F.col("score"))).alias("hi"),
    )


def _classes(nodes: DataFrame, ends: DataFrame, group: str) -> DataFrame:
    """Size of each class, rows below the bracket, and scores inside with the ranks they end at.

    Groups with too many scores inside are left out.
    """
    rows, score = nodes.join(ends, group), F.col("score")
    below, above = F.coalesce(score < F.col("lo"), F.lit(False)), F.coalesce(score > F.col("hi"), F.lit(False))
    rows = rows.select(*nodes.columns, below.alias("below"), (~below & ~above).alias("inside"))
    sizes = rows.groupBy(group, "label").agg(
        F.sum("w").alias("size"), F.sum(F.when(F.col("below"), F.col("w")).otherwise(0)).alias("low"), F.count_if("inside").alias("many"))
    few = sizes.groupBy(group).agg(F.max("many").alias("most")).filter(F.col("most") <= MOST).select(group)
    inside = rows.filter("inside").join(few, group, "left_semi").groupBy(group, "label").agg(
        F.sort_array(F.collect_list(F.struct("score", "cum_w"))).alias("at"))
    return sizes.join(few, group, "left_semi").join(inside, [group, "label"], "left").select(
        group, "label", "size", "low", F.coalesce("at.score", F.array().cast("array<double>")).alias("scores"),
        F.coalesce("at.cum_w", F.array().cast("array<bigint>")).alias("ends"))


def _count_draws(n_boot: int, step: int):
    """Counts of the draws of some replicates and ranks of a class: by score inside the bracket, in total below and above."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                label, size, low, scores, ends, name, first, reps, rep = (c[k] for c in batch.columns[1:])
                size, first, since = size.as_py(), first.as_py(), rep.as_py()
                until = min(n_boot, since + reps.as_py())
                edges = np.append(low.as_py(), ends.values.to_numpy()).astype(np.int64)
                wide = len(edges) + 1
                found = np.zeros((until - since) * wide, np.int64)
                for drawn, heads in md5_heads(name.as_py(), since, until, first, min(size, first + step), AT_ONCE):
                    at = edges.searchsorted(heads % size, "right")
                    at += (drawn - since) * wide
                    part = np.bincount(at - (low_at := int(at.min())))
                    found[low_at:low_at + len(part)] += part
                own, at = np.nonzero(found.reshape(until - since, wide))
                count = found[own * wide + at]
                zone = np.where(at == 0, -1, np.where(at == wide - 1, 1, 0))
                score = np.append(scores.values.to_numpy(), [0.0, 0.0])[at - 1]
                zero, spoof = np.zeros_like(count), label.as_py() == 1
                yield pa.RecordBatch.from_arrays([
                    pa.repeat(batch.column(0)[k], len(own)), pa.array((own + since).astype(np.int32)), pa.array(zone.astype(np.int32)),
                    pa.array(score, mask=zone != 0), pa.array(count if spoof else zero), pa.array(zero if spoof else count),
                ], [batch.schema.names[0], "rep", "zone", "score", "p", "n"])

    return run


def _counted(nodes: DataFrame, classes: DataFrame, n_boot: int, seed: int, group: str) -> DataFrame:
    """Every draw of the given classes, counted by replicate and score inside the brackets (:func:`detection.zoned_nodes`)."""
    total = classes.agg(F.sum("size")).first()[0] or 0
    name = F.concat_ws(",", F.lit(seed), F.col(group).cast("string"), F.col("label").cast("string"), F.lit(""))
    step = F.greatest(F.lit(1), F.floor(COUNTED / F.col("size"))).cast("int")
    units = classes.select(
        group, "label", "size", "low", "scores", "ends", name.cast("binary").alias("name"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(COUNTED).cast("long"))).alias("first"), step.alias("reps"))
    units = units.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1), F.col("reps"))).alias("rep"))
    kind = nodes.schema[group].dataType.simpleString()
    counts = units.repartition(total * n_boot // COUNTED + 1).mapInArrow(
        _count_draws(n_boot, COUNTED), f"`{group}` {kind}, rep int, zone int, score double, p bigint, n bigint")
    return counts.groupBy(group, "rep", "zone", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def eer_replicates_hashed(
    scores: DataFrame, n_boot: int, seed: int = fv.DEFAULT_SEED, group: str = "dataset_id"
) -> DataFrame:
    """Row-by-row draws: draw ``i`` of a class takes the row ranked
    ``md5(seed,group,label,replicate,i) mod class size`` by score.

    Draws are counted task by task around the crossing; replicates that cross elsewhere, and groups with very many
    scores there, take the whole curve (:func:`_joined`). A group with one class has NULL.
    """
    ship_package(scores.sparkSession)
    nodes = materialize(_class_nodes(scores, group).filter(F.col(group).isNotNull()), "boot_class_nodes")
    reps = lambda groups: groups.select(group, F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep"))
    ends = materialize(_crossings(nodes, group), "boot_ends")
    classes = materialize(_classes(nodes, ends, group), "boot_classes")
    found = eer_of_zoned(materialize(_counted(nodes, classes, n_boot, seed, group), "boot_nodes"), [group, "rep"])
    found = materialize(found.select(group, "rep", "eer", "settled"), "boot_found")
    one_class = reps(nodes.select(group).distinct().join(ends, group, "left_anti")).withColumn("eer", F.lit(None).cast("double"))
    out = found.filter("settled").drop("settled").unionByName(one_class)
    left = reps(ends.join(classes, group, "left_anti")).unionByName(found.filter("not settled").select(group, "rep"))
    left = materialize(left, "boot_left")
    return out if left.isEmpty() else out.unionByName(_joined(nodes, n_boot, seed, group, left))


def eer_bootstrap_hashed(
    scores: DataFrame, n_boot: int, seed: int = fv.DEFAULT_SEED,
    ci: float = fv.DEFAULT_CI, group: str = "dataset_id",
) -> DataFrame:
    return percentile_interval(eer_replicates_hashed(scores, n_boot, seed, group), ci, group)
