"""Connected groups of linked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweft.llm.common import drop_table, keep


def connected(links: DataFrame) -> DataFrame:
    """``node, group`` for every node of ``links(a, b)``: ``group`` is the smallest node that it is connected with.

    Each round lets every group take the smallest neighbouring group as its parent, follows parents twice, and contracts the links; long
    chains and stars shrink alike. All steps are joins and map-side minima; links and groups stay in written tables.
    """
    edges = keep(links.select("a", "b").filter("a <> b").distinct())
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    groups = keep(nodes.select("node", F.col("node").alias("group")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = keep(both.groupBy(F.col("a").alias("child")).agg(F.min("b").alias("near"))
                  .select("child", F.least("child", "near").alias("parent")))
        top = up
        for _ in range(2):
            nxt = up.select(F.col("child").alias("parent"), F.col("parent").alias("next"))
            top = top.join(nxt, "parent", "left").select("child", F.coalesce("next", "parent").alias("parent"))
        top = keep(top)
        moved = keep(groups.join(top, groups["group"] == top["child"], "left").select("node", F.coalesce("parent", "group").alias("group")))
        ends = edges.join(top.select(F.col("child").alias("a"), F.col("parent").alias("pa")), "a").join(
            top.select(F.col("child").alias("b"), F.col("parent").alias("pb")), "b")
        rest = keep(ends.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).filter("a <> b").distinct())
        for table in (edges, groups, up, top):
            drop_table(table)
        edges, groups = rest, moved
    drop_table(edges)
    return groups
