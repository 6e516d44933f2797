"""The same aggregation for overlapping strata ("all" and "bus") in one pass."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_strata(df: DataFrame, strata: Mapping[str, Column | None], name: str = "stratum") -> DataFrame:
    """One copy of each row per stratum it belongs to (``None`` means every row).

    The strata overlap, so this is not a grouping set. The copies stay in the mapper: a
    following groupBy combines them before anything is shuffled.
    """
    tags = [F.lit(tag) if cond is None else F.when(cond, F.lit(tag)) for tag, cond in strata.items()]
    return df.withColumn(name, F.explode(F.array_compact(F.array(*tags))))


def all_and_bus(df: DataFrame, mode: str = "mode") -> DataFrame:
    return with_strata(df, {"all": None, "bus": F.col(mode) == "BUS"})
