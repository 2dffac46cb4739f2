"""Brackets around the place where two error curves cross, from mergeable quantile sketches.

One pass builds a KLL sketch per group and class. Its quantiles tell roughly where the
miss rate of spoof rows overtakes the false alarm rate of bonafide rows; a margin on both
sides gives a bracket ``[lo, hi]`` of scores. Whoever uses it counts the rows outside
exactly, keeps distinct scores only inside, and proves on exact counts that the
crossing lies there. Where it does not, the bracket is widened: a sketch never
decides a result, only how much is looked at. NULL stands for an open end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

K = 1024       # size of a sketch: ranks are right to about 0.3 %
GRID = 256     # quantiles taken of each class
MARGIN = 0.02  # difference of the two rates at the ends of a bracket
FEW = 16.0     # rows of each class that a bracket reaches beyond the crossing at least
WIDER = 8.0

LARGEST = 1.7976931348623157e308


def sketches(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One KLL sketch of the scores per group, as column ``name``; infinities count as the largest numbers."""
    score = F.greatest(F.least(F.col("score"), F.lit(LARGEST)), F.lit(-LARGEST))
    return rows.groupBy(*keys).agg(F.kll_sketch_agg_double(score, F.lit(K)).alias(name))


def brackets(both: DataFrame, keys: list[str], margin: float | None) -> DataFrame:
    """``keys, lo, hi`` of a table with the sketches ``spoof`` and ``bona``; no margin: open on both ends."""
    if margin is None:
        none = F.lit(None).cast("double")
        return both.select(*keys, none.alias("lo"), none.alias("hi"))
    ranks = F.expr(f"array({', '.join(f'{i / GRID}D' for i in range(GRID + 1))})")
    quantiles = lambda c: F.kll_sketch_get_quantile_double(c, ranks)
    rows = both.select(*keys, quantiles("spoof").alias("q"), quantiles("bona").alias("r"), _margin(margin).alias("margin"))
    rows = rows.withColumn("at", F.array_sort(F.array_distinct(F.concat("q", "r"))))
    # Miss rate less false alarm rate at each place; it rises with the score.
    upto = lambda c, x: F.size(F.filter(c, lambda y: y <= x)) / float(GRID + 1)
    off = lambda x: upto("q", x) + upto("r", x) - 1.0
    rows = rows.withColumn("at", F.transform("at", lambda x: F.struct(x.alias("at"), off(x).alias("off"))))
    below = F.filter("at", lambda x: x["off"] < -F.col("margin"))
    above = F.filter("at", lambda x: x["off"] > F.col("margin"))
    return rows.select(
        *keys, F.array_max(F.transform(below, lambda x: x["at"])).alias("lo"),
        F.array_min(F.transform(above, lambda x: x["at"])).alias("hi"),
    )


def _margin(margin: float) -> Column:
    few = [F.lit(FEW) / F.kll_sketch_get_n_double(c) for c in ("spoof", "bona")]
    return F.greatest(F.lit(margin), *few)


def wider(margin: float) -> float | None:
    """The next margin, or none for open ends."""
    return margin * WIDER if margin * WIDER < 1.0 else None


def zone(score: Column, lo: Column, hi: Column) -> Column:
    """1 above the bracket, 0 inside, -1 below."""
    return F.when(score > hi, 1).when(score < lo, -1).otherwise(0)
