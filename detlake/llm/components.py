"""Connected components of a table of links, by contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from detlake.session import materialize


def _least(pairs: DataFrame) -> DataFrame:
    """Per node the smallest of its values, which carry their order first."""
    return pairs.groupBy("a").agg(F.min("b").alias("b"))


def components(links: DataFrame, name: str) -> DataFrame:
    """Nodes of ``links(a, b)`` and one ``root`` per component, as ``(node, root)``.

    Each round every node takes the least node within two steps, by a hashed
    order, and the links between the taken nodes make the next, smaller table.
    Stars shrink in one round and chains by a constant share, so the rounds grow
    with the logarithm of the nodes. All groupings are minima, which combine
    before the shuffle, and the joins have both sides shuffled by key, so that a
    node with very many links can be split. The driver only learns whether links
    are left. Nodes of any one sortable type; null ends are dropped; no links give
    an empty table.
    """
    a, b = F.col("a"), F.col("b")
    links = links.filter(a.isNotNull() & b.isNotNull() & (a != b)).select("a", "b")
    links = materialize(links.distinct(), f"{name}-links")
    maps: list[DataFrame] = []
    while not links.isEmpty():
        order = F.struct(F.xxhash64("b", F.lit(len(maps))).alias("h"), b.alias("v")).alias("b")
        both = links.unionByName(links.select(b.alias("a"), a.alias("b")))
        own = both.select("a", a.alias("b"))
        near = materialize(_least(both.unionByName(own).select("a", order)), f"{name}-near")
        via = both.join(near.select(a.alias("b"), b.alias("far")), "b").select("a", F.col("far").alias("b"))
        taken = materialize(
            _least(via.unionByName(near)).select(a.alias("node"), F.col("b.v").alias("root")), f"{name}-taken"
        )
        ends = taken.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        other = taken.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = links.join(ends, "a").join(other, "b").filter("ra <> rb")
        low, high = F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")
        links = materialize(moved.select(low, high).distinct(), f"{name}-links")
        maps.append(taken)
    if not maps:
        return links.select(a.alias("node"), b.alias("root"))
    out = maps.pop()
    while maps:
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = maps.pop().join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return out
