"""Per-entity period series: lags, rolling baselines, trends, change points, event windows.

Every window here is partitioned by entity, so a partition holds at most one row per period.
Lags count rows, not calendar months: a gap in the months is not detected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineside.functions.columns import gap


def over_entity(entity: str | Sequence[str], period: str):
    keys = [entity] if isinstance(entity, str) else list(entity)
    return Window.partitionBy(*(keys or [F.lit(1)])).orderBy(period)


def trailing(value: str, window, size: int, min_rows: int, include_current: bool, fn=F.avg) -> Column:
    """Rolling aggregate over the last ``size`` rows; NULL below ``min_rows`` observations."""
    frame = window.rowsBetween(-size + 1, 0) if include_current else window.rowsBetween(-size, -1)
    return F.when(F.count(value).over(frame) >= min_rows, fn(value).over(frame))


def centred_trend(value: str, window, size: int = 12, min_rows: int = 6) -> Column:
    """Rolling mean of ``size`` rows read ``size / 2`` rows ahead; NULL where that row is missing."""
    ahead = size // 2
    frame = window.rowsBetween(ahead - size + 1, ahead)
    there = F.lead(F.lit(1), ahead).over(window).isNotNull()
    return F.when(there & (F.count(value).over(frame) >= min_rows), F.avg(value).over(frame))


def year_over_year(value: str, window, periods: int = 12) -> Column:
    return F.col(value) - F.lag(value, periods).over(window)


def first_differences(df: DataFrame, entity: str, period: str, values: Sequence[str]) -> DataFrame:
    """``delta_*`` of each value against the entity's previous row; the first row is dropped."""
    window = over_entity(entity, period)
    out = df.withColumns({f"prev_{v}": F.lag(v).over(window) for v in values})
    out = out.where(F.col(f"prev_{values[0]}").isNotNull())
    return out.withColumns({f"delta_{v}": F.col(v) - F.col(f"prev_{v}") for v in values})


def with_group_mean(df: DataFrame, group: str, means: Mapping[str, str]) -> DataFrame:
    """Join back group means (new column -> value column).

    The means are aggregated map-side first and joined, instead of a window over the group,
    because a group (a period) may hold a large share of all rows.
    """
    small = df.groupBy(group).agg(*[F.avg(v).alias(name) for name, v in means.items()])
    return df.join(small, group)


def period_ordinals(df: DataFrame, period: str, name: str = "ordinal", start: int = 0) -> DataFrame:
    """Distinct periods numbered in order. One row per period, so a window over all of it is small."""
    periods = df.select(period).distinct()
    return periods.withColumn(
        name, (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(period)) - 1 + start).cast("int"))


def last_periods(df: DataFrame, period: str, n: int) -> DataFrame:
    """Rows of the last ``n`` distinct periods found in ``df``."""
    recent = df.select(period).distinct().orderBy(F.col(period).desc()).limit(n)
    return df.join(F.broadcast(recent), period, "left_semi")  # n rows


def entities_with(df: DataFrame, entity: str, at_least: int, count: Column | None = None) -> DataFrame:
    """Keep entities with enough rows (or enough of ``count``), by a semi-join on the entity."""
    keep = df.groupBy(entity).agg((F.count(F.lit(1)) if count is None else count).alias("_n"))
    return df.join(keep.where(F.col("_n") >= at_least).select(entity), entity, "left_semi")


def balanced_panel(df: DataFrame, entity: str, month_num: str, months: int = 12) -> DataFrame:
    """Keep entities observed in every month of the year."""
    return entities_with(df, entity, months, F.count_distinct(month_num))


def linear_trend(df: DataFrame, by: Sequence[str], x: str, y: str, per_year: float = 12.0) -> DataFrame:
    """Least-squares slope of ``y`` on ``x`` per group with its standard error and 95 % interval.

    A group whose ``x`` never varies gets slope 0 and no interval.
    """
    fit = df.groupBy(*by).agg(
        F.regr_count(F.col(y), F.col(x)).alias("_n"), F.regr_sxx(F.col(y), F.col(x)).alias("_sxx"),
        F.regr_sxy(F.col(y), F.col(x)).alias("_sxy"), F.regr_syy(F.col(y), F.col(x)).alias("_syy"),
    )
    varies = F.col("_sxx") > 0
    sxx = F.nullif(F.col("_sxx"), F.lit(0.0))
    slope = F.try_divide(F.col("_sxy"), sxx)
    spread = F.greatest(F.col("_syy") - slope * F.col("_sxy"), F.lit(0.0))
    stderr = F.sqrt(F.try_divide(F.try_divide(spread, F.nullif(F.col("_n") - 2, F.lit(0))), sxx))
    fit = fit.withColumn("slope", F.when(varies, slope * per_year).otherwise(0.0))
    fit = fit.withColumn("slope_stderr", F.when(varies & (F.col("_n") > 2), stderr * per_year))
    fit = fit.withColumn("slope_ci_lo", F.col("slope") - 1.96 * F.col("slope_stderr"))
    fit = fit.withColumn("slope_ci_hi", F.col("slope") + 1.96 * F.col("slope_stderr"))
    certain = (F.col("slope_ci_lo") > 0) | (F.col("slope_ci_hi") < 0)
    return fit.withColumn("slope_significant", F.coalesce(certain, F.lit(False))).drop("_sxx", "_sxy", "_syy").withColumnRenamed("_n", "n")


def change_points(df: DataFrame, entity: str, period: str, code: str, carry: str) -> DataFrame:
    """Rows where ``code`` differs from the entity's previous row, with both codes and ``carry`` values."""
    window = over_entity(entity, period)
    out = df.select(
        entity, F.col(period).alias("change_period"),
        F.lag(code).over(window).alias("old_code"), F.col(code).alias("new_code"),
        F.lag(carry).over(window).alias("before"), F.col(carry).alias("after"),
    )
    return out.where(F.col("old_code").isNotNull() & (F.col("old_code") != F.col("new_code")))


def event_windows(events: DataFrame, series: DataFrame, entity: str, period: str, value: str,
                  width: int = 3, min_rows: int = 2) -> DataFrame:
    """Mean of ``value`` in the ``width`` periods before each event and from it on.

    ``events`` has ``entity`` and ``change_period``; events outside the periods of ``series``
    and events with fewer than ``min_rows`` values on a side are dropped. Each event asks for
    its ``2 * width`` period ordinals, so the match is an equi-join on (entity, ordinal).
    """
    ordinals = period_ordinals(series, period)
    placed = events.join(ordinals.withColumnRenamed(period, "change_period"), "change_period")
    wanted = placed.select(
        entity, "change_period",
        F.explode(F.sequence(F.col("ordinal") - width, F.col("ordinal") + width - 1)).alias("_at"),
        F.col("ordinal").alias("_event"),
    )
    observed = series.join(ordinals, period).select(entity, F.col("ordinal").alias("_at"), F.col(value).alias("_v"))
    before = F.when(F.col("_at") < F.col("_event"), F.col("_v"))
    after = F.when(F.col("_at") >= F.col("_event"), F.col("_v"))
    means = wanted.join(observed, [entity, "_at"]).groupBy(entity, "change_period").agg(
        F.avg(before).alias("value_before"), F.avg(after).alias("value_after"),
        F.count(before).alias("n_before"), F.count(after).alias("n_after"),
    ).where((F.col("n_before") >= min_rows) & (F.col("n_after") >= min_rows))
    return events.join(means, [entity, "change_period"]).withColumn(
        "value_delta", gap(F.col("value_after"), F.col("value_before")))
