"""Joins to a side whose size is bounded by construction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Put the columns of a one-row frame (a global aggregate) on every row of ``df``.

    Only for frames that hold a single row by construction; that row is what is broadcast.
    """
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(row.withColumn("_one", F.lit(1))), "_one").drop("_one")
