"""Connected components of a link table, by hooking and pointer jumping in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lineside.llm.tables import written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """The smallest vertex that each linked vertex reaches: columns ``v`` and ``root``.

    ``links`` has ``a`` and ``b`` (long, no nulls); either order, repeats and loops are fine.
    Vertices without a link are not returned. A round takes, for every vertex, the smallest
    grandparent among its neighbours, hooks the vertex and its parent below that, and halves the
    paths; it is one written table, whose number of changed parents is observed on the way.
    Minimums are combined before the shuffle, so a vertex with a third of all links is one
    row for each task; joins on a parent that many share are inner joins that Spark may split.
    """
    both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    arcs = written(links.where("a <> b").select(both.alias("x")).select("x.*").distinct())
    labels = written(arcs.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("p")))
    for _ in range(most_rounds):
        grand = labels.join(labels.select(F.col("v").alias("p"), F.col("p").alias("g")), "p").select("v", "p", "g")
        near = (arcs.join(grand.select(F.col("v").alias("b"), "g"), "b")
                .groupBy(F.col("a").alias("v")).agg(F.min("g").alias("m")))
        moved = grand.join(near, "v").select(F.explode(F.array(
            F.struct("v", F.least("p", "g", "m").alias("p"), F.col("p").alias("was")),
            F.struct(F.col("p").alias("v"), F.least("g", "m").alias("p"), F.lit(None).cast("long").alias("was")))).alias("x")).select("x.*")
        seen = Observation()
        labels = written(moved.groupBy("v").agg(F.min("p").alias("p"), F.max("was").alias("was"))
                         .observe(seen, F.count_if(F.col("p") != F.col("was")).alias("changed")).select("v", "p"))
        if not seen.get["changed"]:
            return labels.select("v", F.col("p").alias("root"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def grown(reach: DataFrame, links: DataFrame) -> DataFrame:
    """``reach`` of :func:`components` after further ``links`` between its roots and vertices without a link so far.

    Only the roots that the links touch are searched, whatever the size of their components.
    """
    up = components(links)
    below = reach.join(up.select(F.col("v").alias("root"), F.col("root").alias("top")), "root", "left")
    fresh = up.join(reach, "v", "left_anti")
    return written(below.select("v", F.coalesce("top", "root").alias("root")).union(fresh.select("v", "root")))
