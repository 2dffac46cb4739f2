"""Detection metrics on score tables: ROC, DET, EER, confusion, reports.

A score table has ``label`` (1 = spoof) and ``score`` (larger = spoof) next to
the group columns. All results are per group, never pooled over datasets.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from detlake import fixed_values as fv
from detlake.functions.numeric import probit, share
from detlake.operators import bracket, prefix
from detlake.session import broadcast_if_small, materialize

INF = float("inf")


# --- scores that count -------------------------------------------------------

def gate(scores: DataFrame) -> DataFrame:
    """The rows every metric rests on: a label of 0 or 1 and a score that is a number.

    NULL and NaN scores are set aside (``score_gate`` counts them); infinite
    scores are kept, as they have a place in the order.
    """
    score = F.col("score").cast("double")
    return scores.filter(score.isNotNull() & ~F.isnan(score) & F.col("label").isin(0, 1))


def score_gate(scores: DataFrame, group: list[str]) -> DataFrame:
    """Rows per group, what :func:`gate` sets aside by reason, and what is used."""
    score, label = F.col("score").cast("double"), F.col("label")
    known = F.coalesce(label.isin(0, 1), F.lit(False))
    return scores.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.count_if(score.isNull()).alias("n_null"),
        F.count_if(F.isnan(score)).alias("n_nan"),
        F.count_if(~known).alias("n_no_label"),
        F.count_if(F.abs(score) == INF).alias("n_infinite"),
        F.count_if(known & score.isNotNull() & ~F.isnan(score)).alias("n_used"),
    )


# --- ROC ---------------------------------------------------------------------

def score_nodes(scores: DataFrame, group: list[str]) -> DataFrame:
    """One row per distinct score of a group: ``p`` spoof and ``n`` bonafide rows.

    Rows combine before the shuffle, so ties cost nothing and a group spreads
    over all tasks by its scores.
    """
    label = F.col("label")
    return (
        gate(scores)
        .groupBy(*group, F.col("score").cast("double").alias("score"))
        .agg(F.count_if(label == 1).alias("p"), F.count_if(label == 0).alias("n"))
    )


def roc_nodes(scores: DataFrame, group: list[str], drop_collinear: bool = True) -> DataFrame:
    """Cumulative counts at each distinct score, from the highest down.

    ``tp`` and ``fp`` count rows with ``score >= threshold``; ``all_p`` and
    ``all_n`` are the class sizes. With ``drop_collinear`` an inner node goes
    when the step into it equals the step out of it: the curve is unchanged, but
    interpolated thresholds depend on which nodes stay. Groups with one class
    are left out. The point before the first node is not a row here.
    """
    curve = curve_of(ranged_nodes(score_nodes(scores, group), group), group, drop_collinear)
    return curve.filter((F.col("all_p") > 0) & (F.col("all_n") > 0))


def ranged_nodes(nodes: DataFrame, group: list[str]) -> DataFrame:
    """Nodes of :func:`score_nodes`, written once and cut into ranges from the highest score down."""
    return prefix.with_ranges(nodes, group, "score", descending=True, name="nodes")


def curve_of(ranged: DataFrame, group: list[str], drop_collinear: bool) -> DataFrame:
    """The nodes of :func:`roc_nodes`, for groups with one class too."""
    out = _walked(ranged, group)
    if drop_collinear:
        out = out.filter(F.col("first") | F.col("next_p").isNull() | _turns())
    return out.drop("next_p", "next_n")


def _turns() -> Column:
    """Whether the step into a node differs from the step out of it."""
    return (F.col("next_p") != F.col("p")) | (F.col("next_n") != F.col("n"))


def _walked(ranged: DataFrame, group: list[str]) -> DataFrame:
    """All nodes with running counts, the next node's counts and whether a node is the first."""
    top = [F.max_by(c, "score").alias(f"top_{c}") for c in ("p", "n")]
    per_range = prefix.range_totals(ranged, group, ["p", "n"], top)

    by_range = Window.partitionBy(*group).orderBy(*prefix.RANGE)
    before = prefix.before_range(group)
    whole = Window.partitionBy(*group)
    offsets = per_range.select(
        *group, *prefix.RANGE,
        F.coalesce(F.sum("p").over(before), F.lit(0)).alias("off_p"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off_n"),
        F.sum("p").over(whole).alias("all_p"),
        F.sum("n").over(whole).alias("all_n"),
        F.lead("top_p").over(by_range).alias("after_p"),
        F.lead("top_n").over(by_range).alias("after_n"),
        (F.row_number().over(by_range) == 1).alias("first_range"),
    )

    local = Window.partitionBy(*group, *prefix.RANGE).orderBy(F.col("score").desc())
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    return prefix.join_offsets(ranged, offsets, group).select(
        *group, "score", "p", "n", "all_p", "all_n",
        (F.col("off_p") + F.sum("p").over(upto)).alias("tp"),
        (F.col("off_n") + F.sum("n").over(upto)).alias("fp"),
        F.coalesce(F.lead("p").over(local), F.col("after_p")).alias("next_p"),
        F.coalesce(F.lead("n").over(local), F.col("after_n")).alias("next_n"),
        (F.col("first_range") & (F.row_number().over(local) == 1)).alias("first"),
    )


def roc_points(scores: DataFrame, group: list[str]) -> DataFrame:
    """ROC curve: ``threshold, fpr, tpr`` with the leading (+inf, 0, 0) point."""
    nodes = roc_nodes(scores, group)
    point = lambda t, fp, tp: F.struct(
        t.alias("threshold"), fp.alias("fpr"), tp.alias("tpr")
    )
    here = point(
        F.col("score"), share(F.col("fp"), F.col("all_n")), share(F.col("tp"), F.col("all_p"))
    )
    start = point(F.lit(INF), F.lit(0.0), F.lit(0.0))
    points = F.when(F.col("first"), F.array(start, here)).otherwise(F.array(here))
    return nodes.select(*group, F.inline(points))


def det_points(scores: DataFrame, group: list[str]) -> DataFrame:
    """DET curve in normal deviates, where both error rates are above zero.

    A rate of exactly one has an infinite deviate.
    """
    deviate = lambda rate: F.when(rate >= 1.0, F.lit(INF)).otherwise(probit(rate))
    points = roc_points(scores, group).withColumn("fnr", 1.0 - F.col("tpr"))
    return points.filter((F.col("fpr") > 0) & (F.col("fnr") > 0)).select(
        *group, "threshold", "fpr", "fnr",
        deviate(F.col("fpr")).alias("probit_fpr"),
        deviate(F.col("fnr")).alias("probit_fnr"),
    )


# --- EER ---------------------------------------------------------------------

def _balance(tp: Column, fp: Column) -> Column:
    """``P*N*(fnr - fpr)`` as an exact integer; it falls from P*N to -P*N."""
    wide = lambda c: c.cast("decimal(19,0)")
    p, n = F.col("all_p"), F.col("all_n")
    exact = wide(p - tp) * wide(n) - wide(fp) * wide(p)
    return exact


def _side(tp: Column, fp: Column) -> Column:
    """Sign of the balance. Doubles settle it except close to the crossing."""
    p, n = F.col("all_p").cast("double"), F.col("all_n").cast("double")
    rough = (p - tp.cast("double")) * n - fp.cast("double") * p
    return F.when(F.abs(rough) > p * n * 1e-9, F.signum(rough)).otherwise(
        F.signum(_balance(tp, fp).cast("double"))
    )


def eer(scores: DataFrame, group: list[str]) -> DataFrame:
    """Equal error rate and its threshold per group.

    The crossing of FNR and FPR is interpolated between the two neighbouring ROC
    nodes. A group with one class has NULL for both. A crossing before the first
    node has threshold +inf, or NULL when all scores are equal.

    Quantile sketches bracket the crossing (:mod:`detlake.operators.bracket`). Rows
    outside a bracket are counted, only distinct scores inside are stored and walked, range
    by range (:mod:`detlake.operators.prefix`). A group whose crossing, or a node it
    is interpolated from, is not proven to lie inside is done again with a wider
    bracket, at last with the whole curve.
    """
    rows = gate(scores).select(*group, "label", F.col("score").cast("double").alias("score"))
    of_class = bracket.sketches(rows, [*group, "label"], "sketch").groupBy(*group).agg(
        F.max(F.when(F.col("label") == 1, F.col("sketch"))).alias("spoof"),
        F.max(F.when(F.col("label") == 0, F.col("sketch"))).alias("bona"),
    )
    of_class = materialize(of_class, "eer_sketches")
    one_class = F.col("spoof").isNull() | F.col("bona").isNull()
    none = F.lit(None).cast("double")
    out = of_class.filter(one_class).select(*group, none.alias("eer"), none.alias("threshold"))
    left, margin = of_class.filter(~one_class), bracket.MARGIN
    while True:
        found = materialize(_bracketed(rows, bracket.brackets(left, group, margin), group), "eer_found")
        out = out.unionByName(found.filter("settled").drop("settled"))
        if margin is None or found.filter("not settled").isEmpty():
            return out
        left, margin = of_class.join(found.filter("not settled").select(*group), group, "left_semi"), bracket.wider(margin)


def zoned_nodes(rows: DataFrame, ends: DataFrame, group: list[str]) -> DataFrame:
    """Counts per distinct score inside the brackets, and in total above and below; stored."""
    zone = bracket.zone(F.col("score"), F.col("lo"), F.col("hi"))
    inside = F.when(F.col("zone") == 0, F.col("score"))
    zoned = rows.join(ends, group).withColumn("zone", zone).withColumn("score", inside)
    nodes = zoned.groupBy(*group, "zone", "score").agg(
        F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    return materialize(nodes, "eer_nodes")


def _bracketed(rows: DataFrame, ends: DataFrame, group: list[str]) -> DataFrame:
    """EER and threshold of each bracketed group and whether they are proven right (``settled``)."""
    return eer_of_zoned(zoned_nodes(rows, ends, group), group)


def eer_of_zoned(nodes: DataFrame, group: list[str]) -> DataFrame:
    """:func:`_bracketed` of a stored :func:`zoned_nodes` table."""
    of_zone = lambda z, c: F.coalesce(F.sum(F.when(F.col("zone") == z, c)), F.lit(0))
    sizes = nodes.groupBy(*group).agg(
        of_zone(1, F.col("p")).alias("above_p"), of_zone(1, F.col("n")).alias("above_n"),
        of_zone(-1, F.col("p") + F.col("n")).alias("below"),
        F.sum("p").alias("size_p"), F.sum("n").alias("size_n"),
    )
    inside = nodes.filter("zone = 0").drop("zone")
    walked = _walked(ranged_nodes(inside, group), group).join(sizes, group)
    no_above, no_below = F.col("above_p") + F.col("above_n") == 0, F.col("below") == 0
    kept = (F.col("first") & no_above) | F.when(F.col("next_p").isNull(), no_below).otherwise(_turns())
    curve = walked.filter(kept).select(
        *group, "score", (F.col("tp") + F.col("above_p")).alias("tp"), (F.col("fp") + F.col("above_n")).alias("fp"),
        F.col("size_p").alias("all_p"), F.col("size_n").alias("all_n"),
    )
    found = sizes.select(*group, no_above.alias("no_above")).join(_neighbours(curve, group), group, "left")
    settled = (F.col("no_above") | F.col("a_score").isNotNull()) & F.col("b_tp").isNotNull()
    return _interpolated(found, [*group, settled.alias("settled")])


def eer_of_nodes(nodes: DataFrame, group: list[str]) -> DataFrame:
    """:func:`eer` of a :func:`score_nodes` table."""
    return _crossing(curve_of(ranged_nodes(nodes, group), group, drop_collinear=True), group)


def _crossing(curve: DataFrame, group: list[str]) -> DataFrame:
    """EER and threshold between the last node above and the first node below."""
    return _interpolated(_neighbours(curve, group), group)


def _neighbours(curve: DataFrame, group: list[str]) -> DataFrame:
    """The last node above the crossing (``a_``) and the first below (``b_``) of each group."""
    above = _side(F.col("tp"), F.col("fp")) >= 0
    hi = lambda c: F.when(above, F.col(c))
    lo = lambda c: F.when(~above, F.col(c))
    # Counts grow and scores fall along the curve: the extremes on each side of
    # the crossing are its two neighbouring nodes.
    return curve.groupBy(*group).agg(
        F.min(hi("score")).alias("a_score"), F.max(lo("score")).alias("b_score"),
        F.coalesce(F.max(hi("tp")), F.lit(0)).alias("a_tp"), F.min(lo("tp")).alias("b_tp"),
        F.coalesce(F.max(hi("fp")), F.lit(0)).alias("a_fp"), F.min(lo("fp")).alias("b_fp"),
        F.max("all_p").alias("all_p"), F.max("all_n").alias("all_n"),
    )


def _interpolated(found: DataFrame, group: list[str | Column]) -> DataFrame:
    """EER and threshold between the two neighbours."""
    k_a = _balance(F.col("a_tp"), F.col("a_fp")).cast("double")
    k_b = _balance(F.col("b_tp"), F.col("b_fp")).cast("double")
    found = found.withColumn("t", k_a / F.nullif(k_a - k_b, F.lit(0.0)))
    t, c = F.col("t"), F.col
    rate = (c("a_fp") + t * (c("b_fp") - c("a_fp"))) / c("all_n")
    one_score = (c("b_tp") == c("all_p")) & (c("b_fp") == c("all_n"))
    between = c("a_score") + t * (c("b_score") - c("a_score"))
    threshold = F.when(  # between infinite scores there is no number to give
        c("a_score").isNotNull(), F.when(~F.isnan(between), between)
    ).when(~one_score, F.lit(INF))
    both = (c("all_p") > 0) & (c("all_n") > 0)
    return found.select(
        *group, F.when(both, rate).alias("eer"), F.when(both, threshold).alias("threshold")
    )


def eer_by_group(
    scores: DataFrame, within: list[str], by: list[str] | None = None
) -> DataFrame:
    """EER of each kind of spoof against all bonafide rows of its dataset.

    ``by`` names the columns that tell spoof kinds apart (attack by default);
    spoof rows with a NULL kind are left out, bonafide rows always count. The
    negatives are not repeated per kind: each spoof score only needs how many
    bonafide scores lie at or above it, which one running total per dataset gives.

    Every kind has its own bracket (:mod:`detlake.operators.bracket`); bonafide scores are kept
    only where some bracket of the dataset lies and counted by gap elsewhere, so what
    is sorted is a part of the scores. Kinds that are not proven to cross inside are done
    again with wider brackets.
    """
    by = by or ["attack_type"]
    kinds = [*within, *by]
    is_spoof = F.col("label") == fv.LABEL_SPOOF
    rows = gate(scores).select(
        *within, *[F.when(is_spoof, F.col(c)).alias(c) for c in by], "label", F.col("score").cast("double").alias("score"))
    named = functools.reduce(lambda a, c: a & F.col(c).isNotNull(), by, F.lit(True))
    rows = rows.filter(~is_spoof | named)
    sketches = materialize(bracket.sketches(rows, [*kinds, "label"], "sketch"), "kind_sketches")
    bona = sketches.filter(~is_spoof).select(*within, F.col("sketch").alias("bona"))
    of_kind = sketches.filter(is_spoof).select(*kinds, F.col("sketch").alias("spoof")).join(bona, within, "left")
    n_spoof = F.kll_sketch_get_n_double("spoof").alias("n_spoof")
    out = of_kind.filter("bona is null").select(*kinds, n_spoof, F.lit(None).cast("double").alias("eer"))
    left, margin = of_kind.filter("bona is not null"), bracket.MARGIN
    while True:
        found = materialize(_kinds_bracketed(rows, bracket.brackets(left, kinds, margin), within, by), "kind_found")
        out = out.unionByName(found.filter("settled").drop("settled"))
        if margin is None or found.filter("not settled").isEmpty():
            return out.withColumn("eer", F.bround("eer", 6))
        left = of_kind.join(found.filter("not settled").select(*kinds), kinds, "left_semi")
        margin = bracket.wider(margin)


def _covered(ends: DataFrame, within: list[str]) -> DataFrame:
    """The brackets of a dataset's kinds as separate intervals: arrays ``los``, ``his`` in ascending order."""
    open_ends = ends.select(*within, F.coalesce("lo", F.lit(-INF)).alias("lo"), F.coalesce("hi", F.lit(INF)).alias("hi"))
    in_order = Window.partitionBy(*within).orderBy("lo", "hi")  # one row per kind
    reach = F.max("hi").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.coalesce((F.col("lo") > reach).cast("int"), F.lit(1))
    islands = open_ends.withColumn("new", starts).withColumn("island", F.sum("new").over(in_order))
    islands = islands.groupBy(*within, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return islands.groupBy(*within).agg(
        F.sort_array(F.collect_list("lo")).alias("los"), F.sort_array(F.collect_list("hi")).alias("his"))


def _kinds_bracketed(rows: DataFrame, ends: DataFrame, within: list[str], by: list[str]) -> DataFrame:
    """EER of the bracketed kinds and whether their crossing is proven to lie inside."""
    kinds, is_spoof = [*within, *by], F.col("label") == fv.LABEL_SPOOF
    # One pass: spoof scores inside their own bracket, bonafide scores under any bracket, and
    # one row per gap between brackets, which stands at the end of the bracket below it.
    held = rows.join(ends.withColumn("known", F.lit(True)), kinds, "left").join(_covered(ends, within), within)
    at_least = F.size(F.filter("los", lambda x: x <= F.col("score")))
    beyond = F.size(F.filter("his", lambda x: x < F.col("score")))
    gap = F.when(F.col("gap") > 0, F.get("his", F.col("gap") - 1)).otherwise(-INF)
    held = held.filter(~is_spoof | F.col("known")).select(
        *kinds, "label", "score", "his",
        F.when(is_spoof, bracket.zone(F.col("score"), F.col("lo"), F.col("hi"))).alias("zone"),
        F.when(~is_spoof & (at_least == beyond), at_least).alias("gap"),
    )
    place = F.when(F.col("zone") != 0, None).when(F.col("gap").isNull(), F.col("score")).otherwise(gap)
    held = held.groupBy(*kinds, "label", "zone", F.col("gap").isNull().alias("real"), place.alias("score"))
    nodes = materialize(held.agg(F.count("*").alias("rows")), "kind_scores")
    spoof = nodes.filter(is_spoof).withColumnRenamed("rows", "p")
    of_zone = lambda z: F.coalesce(F.sum(F.when(F.col("zone") == z, F.col("p"))), F.lit(0))
    sizes = spoof.groupBy(*kinds).agg(of_zone(1).alias("above_p"), of_zone(-1).alias("below_p"), F.sum("p").alias("all_p"))
    count = lambda on: F.when(on, F.col("rows")).otherwise(0)
    merged = nodes.filter(~is_spoof | (F.col("zone") == 0)).select(
        *kinds, "score", count(is_spoof).alias("p"), count(~is_spoof).alias("n"), count(~is_spoof & F.col("real")).alias("here"))

    # Bonafide rows at each score, then at or above it, for every spoof node.
    ranged = prefix.with_ranges(merged, within, "score", descending=True, name="kind_nodes")
    offsets = prefix.range_totals(ranged, within, ["n"]).select(
        *within, *prefix.RANGE,
        F.coalesce(F.sum("n").over(prefix.before_range(within)), F.lit(0)).alias("off_n"),
        F.sum("n").over(Window.partitionBy(*within)).alias("all_n"),
    )
    kind_offsets = prefix.range_totals(ranged.filter(F.col("p") > 0), kinds, ["p"]).select(
        *kinds, *prefix.RANGE, F.coalesce(F.sum("p").over(prefix.before_range(kinds)), F.lit(0)).alias("off_p"))
    in_range = Window.partitionBy(*within, *prefix.RANGE)
    upto = in_range.orderBy(F.col("score").desc()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    same = Window.partitionBy(*within, *prefix.RANGE, "score")
    with_fp = (
        prefix.join_offsets(ranged, offsets, within)
        .withColumn("fp", F.col("off_n") + F.sum("n").over(upto))
        .withColumn("n_here", F.sum("here").over(same))
        .filter(F.col("p") > 0)
    )
    kind_upto = (
        Window.partitionBy(*kinds, *prefix.RANGE)
        .orderBy(F.col("score").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    nodes = prefix.join_offsets(with_fp, kind_offsets, kinds).join(sizes, kinds)
    nodes = nodes.withColumn("tp", F.col("above_p") + F.col("off_p") + F.sum("p").over(kind_upto))
    past = _side(F.col("tp"), F.col("fp")) < 0
    found = nodes.groupBy(*kinds).agg(
        F.max("all_n").alias("all_n"), F.bool_or(~past).alias("some_before"),
        *[F.min(F.when(past, F.col(c))).alias(f"b_{c}") for c in ("tp", "fp")],
        F.min(F.when(past, F.col("tp") - F.col("p"))).alias("a_tp"),
        F.min(F.when(past, F.col("fp") - F.col("n_here"))).alias("a_fp"),
    )
    found = sizes.join(found, kinds, "left")
    # Up to node b only the bonafide count moves; the crossing lies there or on b.
    p, n = F.col("all_p").cast("double"), F.col("all_n").cast("double")
    tp_a, fp_a = F.col("a_tp"), F.col("a_fp")
    k_a = _balance(tp_a, fp_a).cast("double")
    k_b = _balance(F.col("b_tp"), F.col("b_fp")).cast("double")
    t = k_a / (k_a - k_b)
    value = (
        F.when(F.col("b_tp").isNull(), 0.0)
        .when(k_a < 0, 1.0 - tp_a / p)
        .otherwise((fp_a + t * (F.col("b_fp") - fp_a)) / n)
    )
    before = (F.col("above_p") == 0) | F.coalesce("some_before", F.lit(False))
    after = (F.col("below_p") == 0) | F.col("b_tp").isNotNull()
    return found.select(*kinds, F.col("all_p").alias("n_spoof"), value.alias("eer"), (before & after).alias("settled"))


def negatives_at_or_above(
    scores: DataFrame, within: list[str], by: list[str] | None = None
) -> DataFrame:
    """Per kind of spoof its rows, all bonafide rows of the dataset, and those at or above the kind's top score.

    ``n_spoof``, ``n_bonafide``, ``n_bonafide_at_top``; kinds as in :func:`eer_by_group`. All
    negatives meet each kind through one running total, not as copies.
    """
    by = by or ["attack_type"]
    ok = gate(scores).withColumn("score", F.col("score").cast("double"))
    cum = prefix.running_totals(score_nodes(ok, within), within, "score", ["n"], descending=True)
    size = ok.filter(F.col("label") == fv.LABEL_BONAFIDE).groupBy(*within).agg(F.count("*").alias("n_bonafide"))
    kinds = ok.filter(F.col("label") == fv.LABEL_SPOOF)
    for c in by:
        kinds = kinds.filter(F.col(c).isNotNull())
    kinds = kinds.groupBy(*within, *by).agg(F.count("*").alias("n_spoof"), F.max("score").alias("score"))
    return kinds.join(size, within).join(cum.select(*within, "score", "cum_n"), [*within, "score"]).select(
        *within, *by, "n_spoof", "n_bonafide", F.col("cum_n").alias("n_bonafide_at_top"))


# --- confusion ---------------------------------------------------------------

def confusion_at(
    scores: DataFrame, group: list[str], threshold: str | float, name: str = "threshold"
) -> DataFrame:
    """``tn, fp, fn, tp`` for ``score >= threshold``, compared as doubles.

    ``threshold`` is a number or a column of ``scores``. A NULL threshold column
    predicts bonafide everywhere, as a comparison with NaN does. Only rows that
    pass :func:`gate` are counted.
    """
    at = F.lit(float(threshold)) if not isinstance(threshold, str) else F.col(threshold)
    hit = F.coalesce(F.col("score").cast("double") >= at, F.lit(False))
    spoof, bona = F.col("label") == fv.LABEL_SPOOF, F.col("label") == fv.LABEL_BONAFIDE
    return gate(scores).groupBy(*group).agg(
        F.max(at).alias(name),
        F.count_if(bona & ~hit).alias("tn"), F.count_if(bona & hit).alias("fp"),
        F.count_if(spoof & ~hit).alias("fn"), F.count_if(spoof & hit).alias("tp"),
    )


def error_rates(confusion: DataFrame) -> DataFrame:
    """Add ``fpr`` and ``fnr``, NULL for an empty class."""
    c = F.col
    return confusion.withColumn("fpr", share(c("fp"), c("tn") + c("fp"))).withColumn(
        "fnr", share(c("fn"), c("fn") + c("tp"))
    )


def confusion_row_share(confusion: DataFrame, group: list[str]) -> DataFrame:
    """Row-normalised matrix as ``actual, predicted, n, share``."""
    c = F.col
    cell = lambda actual, predicted, n, total: F.struct(
        F.lit(actual).alias("actual"), F.lit(predicted).alias("predicted"),
        n.alias("n"), share(n, total).alias("share"),
    )
    neg, pos = c("tn") + c("fp"), c("fn") + c("tp")
    return confusion.select(
        *group,
        F.inline(F.array(
            cell("bonafide", "bonafide", c("tn"), neg), cell("bonafide", "spoof", c("fp"), neg),
            cell("spoof", "bonafide", c("fn"), pos), cell("spoof", "spoof", c("tp"), pos),
        )),
    )


def operating_points(
    scores: DataFrame, val_thresholds: DataFrame | None = None, group: str = "dataset_id",
    point: DataFrame | None = None,
) -> DataFrame:
    """Confusion at the EER threshold and, where known, at a validation threshold.

    ``val_thresholds`` has ``dataset_id, threshold``; ``point`` is a result of
    :func:`eer` to reuse. The EER point exists only for groups with both classes.
    Without a finite crossing its threshold is NULL and everything counts as
    bonafide.
    """
    found = point if point is not None else eer(scores, [group])
    points = found.filter(F.col("eer").isNotNull()).select(
        group, F.lit("eer").alias("at"), F.col("threshold").alias("_t")
    )
    if val_thresholds is not None:
        points = points.unionByName(
            val_thresholds.filter(F.col("threshold").isNotNull()).select(
                group, F.lit("val").alias("at"), F.col("threshold").alias("_t")
            )
        )
    return error_rates(score_counts_at(scores, materialize(points, "points"), group))


def score_counts_at(scores: DataFrame, points: DataFrame, group: str) -> DataFrame:
    """Confusion of each ``(group, at)`` threshold in one pass over the scores.

    A dataset may hold most of the scores, so they should not be hashed by it:
    the thresholds are broadcast after their number is checked.
    """
    joined = scores.select(group, "label", "score").join(broadcast_if_small(points), group)
    return confusion_at(joined, [group, "at"], "_t")


def coverage_by_dataset(requested: DataFrame, scored: DataFrame) -> DataFrame:
    """Requested and scored rows per dataset with their ratio to six places."""
    a = requested.groupBy("dataset_id").agg(F.count("*").alias("n_requested"))
    b = scored.groupBy("dataset_id").agg(F.count("*").alias("n_scored"))
    return a.join(b, "dataset_id", "left").na.fill(0, ["n_scored"]).withColumn(
        "ratio", F.bround(F.col("n_scored") / F.col("n_requested"), 6)
    )


def eer_report(
    scores: DataFrame, ci: DataFrame | None = None, point: DataFrame | None = None
) -> DataFrame:
    """One row per dataset: counts of the rows that pass :func:`gate`, EER and its interval in percent to two places.

    ``ci`` has ``dataset_id, lo, hi`` as :mod:`detlake.operators.bootstrap` gives;
    ``point`` is a result of :func:`eer` to reuse.
    """
    counts = gate(scores).groupBy("dataset_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("label") == fv.LABEL_BONAFIDE).alias("bonafide"),
        F.count_if(F.col("label") == fv.LABEL_SPOOF).alias("spoof"),
    )
    pct = lambda c: F.bround(F.bround(F.col(c), 6) * 100.0, 2)
    found = point if point is not None else eer(scores, ["dataset_id"])
    out = counts.join(found.drop("threshold"), "dataset_id", "left")
    out = out.select("dataset_id", "n", "bonafide", "spoof", pct("eer").alias("eer_pct"))
    if ci is not None:
        out = out.join(
            ci.select("dataset_id", pct("lo").alias("ci_lo_pct"), pct("hi").alias("ci_hi_pct")),
            "dataset_id", "left",
        )
    return out.orderBy("dataset_id")
