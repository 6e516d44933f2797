"""Similarity of entity series to the mean series of known groups; grouping and silhouettes from it.

Work and output grow with rows x groups: no two entities are compared with each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineside.functions.columns import between, stable
from lineside.operators.broadcasts import attach_row
from lineside.operators.order import medians
from lineside.session import settle

#: A series whose variance is below this share of its mean square is constant up to the noise of doubles.
_FLAT = 1e-24


def centre_correlations(df: DataFrame, members: DataFrame, entity: str, period: str, value: str,
                        min_overlap: int = 24) -> DataFrame:
    """Pearson correlation of every entity with the mean series of every group of every family.

    ``members`` has ``entity``, ``family`` and ``centre``, one row per entity and family, with few
    centres. An entity's own values are taken out of the mean of its group. With fewer than
    ``min_overlap`` common periods, or where either series is constant, the correlation is not
    measured and the median of the measured ones stands in (``imputed``).
    """
    rows = df.where(F.col(value).isNotNull()).select(entity, period, F.col(value).cast("double").alias("x"))
    sums = settle(rows.join(members, entity).groupBy("family", "centre", period).agg(F.sum("x").alias("s"), F.count("x").alias("c")))
    own = members.select(entity, "family", F.col("centre").alias("_own"))
    met = rows.join(sums, period).join(own, [entity, "family"], "left")
    rest = F.try_divide(F.col("s") - F.col("x"), F.nullif(F.col("c") - 1, F.lit(0)))
    met = met.withColumn("y", F.when(F.col("_own") == F.col("centre"), rest).otherwise(F.col("s") / F.col("c"))).where("y IS NOT NULL")
    varies = [F.var_pop(c) > _FLAT * F.avg(F.col(c) * F.col(c)) for c in ("x", "y")]
    found = settle(met.groupBy(entity, "family", "centre").agg(
        F.count("y").alias("n"),
        F.when((F.count("y") >= min_overlap) & varies[0] & varies[1], between(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")), -1.0, 1.0)).alias("measured")))
    return attach_row(found, medians(found, "measured", name="_middle")).select(
        entity, "family", "centre", "n", F.col("measured").isNull().alias("imputed"),
        F.coalesce("measured", "_middle").alias("correlation"))


def nearest_centres(table: DataFrame, entity: str) -> DataFrame:
    """Per entity and family the centre of largest correlation (ties: first name) and the silhouette against the next.

    The distance is 1 - r, cut to [0, 2]; with one centre only the silhouette is 0.
    """
    apart = between(1 - stable(F.col("correlation")), 0.0, 2.0)
    ranked = table.groupBy(entity, "family").agg(
        F.array_sort(F.collect_list(F.struct(apart.alias("d"), "centre"))).alias("by"))  # one entry per centre: few
    own, other = F.col("by")[0]["d"], F.get("by", F.lit(1))["d"]
    worst = F.greatest(own, other)
    score = F.when(other.isNotNull() & (worst > 0), (other - own) / worst)
    return ranked.select(entity, "family", F.col("by")[0]["centre"].alias("centre"), F.coalesce(score, F.lit(0.0)).alias("silhouette"))


def family_scores(nearest: DataFrame) -> DataFrame:
    """Mean silhouette and number of groups in use per family."""
    return nearest.groupBy("family").agg(F.avg("silhouette").alias("silhouette"), F.count_distinct("centre").alias("n_groups"))


def co_movement(table: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """Entities grouped by their nearest centre, in the family with the best mean silhouette.

    Returns (node, cluster, cluster_size) and the score table of the families.
    """
    nearest = settle(nearest_centres(table, entity))
    scores = family_scores(nearest)
    best = scores.orderBy(stable(F.col("silhouette")).desc(), "family").limit(1).select("family")
    chosen = nearest.join(F.broadcast(best), "family")  # one row
    sizes = chosen.groupBy("centre").agg(F.count(F.lit(1)).alias("cluster_size"))
    return chosen.join(sizes, "centre").select(F.col(entity).alias("node"), F.col("centre").alias("cluster"), "cluster_size"), scores
