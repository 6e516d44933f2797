"""Does one series move ahead of another? Lagged correlations and Granger tests per entity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineside.functions.columns import between, pearson, stable
from lineside.functions.special import f_upper
from lineside.operators.association import with_correlation_p
from lineside.operators.order import quantiles
from lineside.operators.series import over_entity


def lagged_correlations(df: DataFrame, entity: str, period: str, leader: str, follower: str, max_lag: int = 6) -> DataFrame:
    """Correlation of ``leader`` at row t with ``follower`` at row t + lag, for lags 0..max_lag.

    The leads and the grouping share the entity partitioning, so there is one shuffle.
    """
    window = over_entity(entity, period)
    lagged = df.withColumns({f"_f{k}": F.lead(follower, k).over(window) for k in range(max_lag + 1)})
    per_entity = lagged.groupBy(entity).agg(*[
        F.struct(F.lit(k).alias("lag"), pearson(F.col(leader), F.col(f"_f{k}")).alias("correlation"),
                 F.regr_count(F.col(leader), F.col(f"_f{k}")).alias("n")).alias(f"_c{k}")
        for k in range(max_lag + 1)])
    out = per_entity.select(entity, F.inline(F.array(*[f"_c{k}" for k in range(max_lag + 1)])))
    return with_correlation_p(out, "correlation", "n", "p_value")


def summarise_lags(lags: DataFrame, level: float = 0.05) -> DataFrame:
    """Median, nearest-rank quartiles, mean and number of significant positive entities per lag."""
    cut = lags.withColumn("correlation", stable(F.col("correlation")))
    middle = quantiles(cut, "correlation", {"median_r": 0.5}, ["lag"])
    quartiles = quantiles(cut, "correlation", {"q25_r": 0.25, "q75_r": 0.75}, ["lag"], method="nearest")
    counts = lags.groupBy("lag").agg(
        F.avg("correlation").alias("mean_r"),
        F.count_if((F.col("p_value") < level) & (F.col("correlation") > 0)).alias("n_significant"),
        F.count(F.lit(1)).alias("n_entities"))
    return counts.join(middle, "lag").join(quartiles, "lag")


class LaggedMoments:
    """Sums of products of a lag regression's columns, for a batch of entities, from one table of lagged cross-moments.

    A sum over the rows after lag L of y(t-i) y(t-j) is the sum of all products at distance j - i, less those that
    stick out at either end: these need only the first and last ``max_lag`` values.
    """

    def __init__(self, batch: pd.DataFrame, max_lag: int):
        self.n, self.reach = batch["n_months"].to_numpy(), max_lag
        self.sums = {c: batch[f"_s{c}"].to_numpy(dtype=float) for c in "xy"}
        self.products = {(a, b, k): batch[f"_{a}{b}{k}"].to_numpy(dtype=float) for a in "xy" for b in "xy" for k in range(max_lag + 1) if k or a <= b}
        self.products |= {("y", "x", 0): self.products["x", "y", 0]}
        self.head, self.tail = ({c: np.stack(batch[f"_{end}{c}"].to_numpy()).astype(float) for c in "xy"} for end in ("head", "tail"))

    def table(self, lag: int, columns: list[tuple[str, int]]) -> np.ndarray:
        """The moments of the constant and ``columns`` (series and shift) over the rows after ``lag``."""
        size = len(columns) + 1
        out = np.zeros((len(self.n), size, size))
        out[:, 0, 0] = self.n - lag
        for p, (a, i) in enumerate(columns, 1):
            out[:, 0, p] = out[:, p, 0] = self.sums[a] - self.head[a][:, :lag - i].sum(axis=1) - self.tail[a][:, self.reach - i:].sum(axis=1)
            for q, (b, j) in enumerate(columns[p - 1:], p):
                out[:, p, q] = out[:, q, p] = self._product(lag, (a, i), (b, j)) if i <= j else self._product(lag, (b, j), (a, i))
        return out

    def _product(self, lag: int, late: tuple[str, int], early: tuple[str, int]) -> np.ndarray:
        (a, i), (b, j) = late, early
        k, last = j - i, self.reach
        total = self.products[a, b, k].copy()
        if lag - i > k:
            total -= (self.head[a][:, k:lag - i] * self.head[b][:, :lag - i - k]).sum(axis=1)
        return total - (self.tail[a][:, last - i:] * self.tail[b][:, last - j:last - k]).sum(axis=1)


def _rest(moments: np.ndarray, columns: list[int]) -> np.ndarray:
    """Sums of squares that are left of the last column on ``columns``, for a stack of moment tables."""
    total = moments[:, -1, -1]
    design, target = moments[np.ix_(range(len(moments)), columns, columns)], moments[:, columns, -1]
    explained = np.einsum("ei,eij,ej->e", target, np.linalg.pinv(design, rcond=1e-13, hermitian=True), target)
    return np.maximum(total - explained, 1e-15 * total)


def granger(df: DataFrame, entity: str, period: str, cause: str, effect: str, max_lag: int = 6) -> DataFrame:
    """Smallest p over lags 1..max_lag of the SSR F-test that ``cause`` helps predict ``effect``.

    The products of both series with their lags are summed per entity in one scan (the series are first
    centred and scaled, which leaves F as it is); the normal equations of all lags then follow from these sums and are solved for a
    batch of entities at once. An entity (at most one row per period) that is too short, constant or has gaps in its values gets NULLs.
    ``p_bonferroni`` multiplies by the number of entities.
    """
    window, whole = over_entity(entity, period), Window.partitionBy(entity)

    def scaled(column: str) -> Column:
        value = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
        return (value - F.avg(value).over(whole)) / F.nullif(F.stddev_pop(value).over(whole), F.lit(0.0))

    reach = range(1, max_lag + 1)
    rows = df.select(entity, period, scaled(cause).alias("_x"), scaled(effect).alias("_y"),
                     F.row_number().over(window).alias("_t"), F.count(F.lit(1)).over(whole).alias("_n"))
    rows = rows.withColumns({f"_{c}{k}": F.lag(f"_{c}", k).over(window) for c in "xy" for k in reach})
    sums = [F.sum(f"_{c}").alias(f"_s{c}") for c in "xy"]
    sums += [F.sum(F.col(f"_{a}") * F.col(f"_{b}{k or ''}")).alias(f"_{a}{b}{k}") for a in "xy" for b in "xy" for k in (0, *reach) if k or a <= b]
    # the first and the last values, in order
    sums += [F.array(*(F.max(F.when(at == k, F.col(f"_{c}"))) for k in places)).alias(f"_{end}{c}") for c in "xy"
             for end, at, places in (("head", F.col("_t"), reach), ("tail", F.col("_n") - F.col("_t"), reversed(range(max_lag))))]
    whole_series = [(F.count(f"_{c}") == F.count(F.lit(1))) for c in "xy"]
    per_entity = rows.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n_months"), (whole_series[0] & whole_series[1] & (F.count(F.lit(1)) > 3 * max_lag + 1)).alias("_ready"), *sums)
    kind = df.schema[entity].dataType.simpleString()

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[[entity]].assign(best_lag=pd.array([None] * len(batch), dtype="Int32"), f_stat=np.nan, p_value=np.nan, n_months=batch["n_months"])
            at = np.flatnonzero(batch["_ready"].to_numpy(dtype=bool))
            if len(at):
                held = LaggedMoments(batch.iloc[at], max_lag)
                n, best = held.n, (np.zeros(len(at), int), np.zeros(len(at)), np.ones(len(at)))
                for lag in reach:
                    moments = held.table(lag, [*(("y", k) for k in range(1, lag + 1)), *(("x", k) for k in range(1, lag + 1)), ("y", 0)])
                    short, full = _rest(moments, list(range(lag + 1))), _rest(moments, list(range(2 * lag + 1)))
                    freedom = n - lag - 2 * lag - 1
                    open_ = (freedom > 0) & (full > 0)
                    f = np.where(open_, (short - full) / lag / np.where(open_, full, 1) * freedom, 0)
                    p = np.where(open_, f_upper(f, lag, np.where(open_, freedom, 1)), 1)
                    better = p < best[2]
                    for kept, new in zip(best, (lag, f, p)):
                        kept[better] = new if np.isscalar(new) else new[better]
                found = best[0] > 0
                out.iloc[at, 1] = pd.array(np.where(found, best[0], -1), dtype="Int32")
                out.iloc[at, 2], out.iloc[at, 3] = best[1], best[2]
                out["best_lag"] = out["best_lag"].mask(out["best_lag"] < 0)
            yield out

    tests = per_entity.mapInPandas(
        solve, f"`{entity}` {kind}, best_lag int, f_stat double, p_value double, n_months bigint")
    return tests.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("f_stat", "p_value")})


def bonferroni(tests: DataFrame, p: str, n_tests: DataFrame) -> DataFrame:
    """p times the number of tests, at most 1. ``n_tests`` is a one-row frame with ``m``."""
    from lineside.operators.broadcasts import attach_row

    return attach_row(tests, n_tests).withColumn(
        "p_bonferroni", between(F.col(p) * F.col("m"), 0.0, 1.0)).drop("m")


__all__: Sequence[str] = ("lagged_correlations", "summarise_lags", "granger", "bonferroni")
