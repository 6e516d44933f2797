"""Daily observations to monthly, and how far weather explains the measure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineside.functions.columns import indicator, month_of_year, sum_or_zero
from lineside.operators import series
from lineside.operators.association import correlate
from lineside.operators.broadcasts import attach_row
from lineside.operators.regression import (
    cluster_robust, complete_rows, correlation_matrix, fit_models, fit_ols, nested_f, with_residuals,
)
from lineside.session import settle

# The monthly weather columns and the subset used in the models.
WEATHER_VARS = [
    "total_precip_mm", "snow_days", "total_snow_mm", "mean_tmax_c", "mean_tmin_c", "freeze_days",
    "hot_days", "mean_wind_ms", "heavy_precip_days",
]
MODEL_VARS = ["total_precip_mm", "snow_days", "mean_tmax_c", "freeze_days", "mean_wind_ms"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def monthly_weather(daily: DataFrame, hot: float = 32.0, heavy: float = 25.0) -> DataFrame:
    """Monthly sums, means and day counts of daily observations; an all-missing sum is 0."""
    return daily.groupBy(F.substring("DATE", 1, 7).alias("month")).agg(
        sum_or_zero(F.col("PRCP")).alias("total_precip_mm"), F.count_if(F.col("SNOW") > 0).alias("snow_days"),
        sum_or_zero(F.col("SNOW")).alias("total_snow_mm"), F.avg("TMAX").alias("mean_tmax_c"),
        F.avg("TMIN").alias("mean_tmin_c"), F.count_if(F.col("TMIN") < 0).alias("freeze_days"),
        F.count_if(F.col("TMAX") >= hot).alias("hot_days"), F.avg("AWND").alias("mean_wind_ms"),
        F.count_if(F.col("PRCP") >= heavy).alias("heavy_precip_days"), F.count("DATE").alias("n_obs"))


def season_check(weather: DataFrame) -> DataFrame:
    """Winter against summer averages of the cold and hot day counts."""
    number = month_of_year(F.col("month"))
    winter, summer = number.isin(12, 1, 2), number.isin(6, 7, 8)

    def mean(where: Column, column: str) -> Column:
        return F.avg(F.when(where, F.col(column)))

    return weather.agg(
        mean(winter, "snow_days").alias("winter_snow_days"), mean(summer, "snow_days").alias("summer_snow_days"),
        mean(winter, "freeze_days").alias("winter_freeze_days"), mean(summer, "hot_days").alias("summer_hot_days"))


def joined_series(system: DataFrame, weather: DataFrame, value: str = "weighted_otp") -> DataFrame:
    """One row per month with the system value, the weather and the month's position.

    Monthly rows only, so the position window is small.
    """
    merged = system.select("month", F.col(value).alias("value")).join(weather, "month")
    return merged.join(series.period_ordinals(merged, "month", "linear_trend"), "month").withColumn(
        "linear_trend", F.col("linear_trend").cast("double"))


def weather_correlations(merged: DataFrame, variables: Sequence[str] = WEATHER_VARS, min_n: int = 10) -> DataFrame:
    """Pearson and Spearman of every weather column with the value, raw and with trends removed.

    A month without a detrended value is left out of the detrended part for every column.
    """
    typed = merged.select("month", "value", *[F.col(v).cast("double").alias(v) for v in variables])
    tall = typed.unpivot(["month", "value"], list(variables), "variable", "x")
    window = series.over_entity("variable", "month")
    tall = tall.withColumns({"_vt": series.centred_trend("value", window), "_xt": series.centred_trend("x", window)})
    kinds = F.explode(F.array(
        F.struct(F.lit("raw").alias("type"), F.col("x").alias("a"), F.col("value").alias("b")),
        F.struct(F.lit("detrended").alias("type"), (F.col("x") - F.col("_xt")).alias("a"),
                 (F.col("value") - F.col("_vt")).alias("b"))))
    rows = tall.select("variable", kinds.alias("_k")).select("variable", "_k.*")
    return correlate(rows, "a", "b", ["variable", "type"], min_n).where(F.col("n") >= min_n)


def weather_trend_models(merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Value on weather and trend, and the F-test of the weather columns against trend alone."""
    fits = fit_models(merged, "value", {"weather": [*MODEL_VARS, "linear_trend"], "trend": ["linear_trend"]})
    return fits.where("model = 'weather'").drop("model"), nested_f(fits, {"weather": ("trend", "weather")})


def month_columns() -> list[str]:
    return [f"month_{name}" for name in MONTHS[1:]]


def with_month_indicators(df: DataFrame) -> DataFrame:
    """0/1 columns for February to December; January is the reference."""
    number = month_of_year(F.col("month"))
    return df.withColumns({name: indicator(number == i) for i, name in enumerate(month_columns(), 2)})


def seasonal_models(merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Months-only, weather-only and joint models, and both nested tests on the same rows.

    The reported months-only model uses every month; in its test it uses the months with weather.
    """
    rows = settle(with_month_indicators(merged))
    months, climate = [*month_columns(), "linear_trend"], [*MODEL_VARS, "linear_trend"]
    shared = fit_models(rows, "value", {
        "months": months, "weather_only": climate, "month_plus_weather": [*month_columns(), *MODEL_VARS, "linear_trend"]})
    fits = fit_models(rows, "value", {"month_only": months}).unionByName(shared.where("model <> 'months'"))
    tests = nested_f(shared, {"weather": ("months", "month_plus_weather"), "months": ("weather_only", "month_plus_weather")}, "added")
    return fits, tests


def adjusted_profile(merged: DataFrame) -> DataFrame:
    """Mean per month of the year, raw and with the weather-only model's effect taken out."""
    features = [*MODEL_VARS, "linear_trend"]
    rows = settle(complete_rows(merged, [*features, "value"]))
    rows = with_residuals(rows, fit_ols(rows, "value", features), "value", features)
    rows = attach_row(rows, rows.agg(F.avg("value").alias("_grand")))
    return rows.groupBy(month_of_year(F.col("month")).alias("month_num")).agg(
        F.avg("value").alias("raw_otp"), F.avg(F.col("residual") + F.col("_grand")).alias("adjusted_otp"))


def panel_rows(panel: DataFrame, weather: DataFrame, entity: str = "route_id", value: str = "otp") -> DataFrame:
    """Entity-month rows with weather and the outcome minus its entity mean (regressors stay as they are)."""
    joined = panel.join(weather.select("month", *MODEL_VARS), "month")
    joined = series.with_group_mean(joined, entity, {"_mean": value})
    return joined.withColumn("demeaned", F.col(value) - F.col("_mean")).drop("_mean")


def weather_panel(panel: DataFrame, weather: DataFrame) -> DataFrame:
    """Entity fixed effects on the outcome, standard errors clustered by month."""
    return cluster_robust(settle(panel_rows(panel, weather)), "demeaned", MODEL_VARS, "month")


def weather_matrix(weather: DataFrame) -> DataFrame:
    return correlation_matrix(weather, WEATHER_VARS)
