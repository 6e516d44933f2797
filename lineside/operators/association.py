"""Correlations and two- or many-sample tests, each ending in one row per test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineside.functions.columns import between, indicator, pearson, stable
from lineside.functions.special import (
    chi2_p_value, normal_upper, signed_rank_p, t_critical_value, t_p_value,
)
from lineside.operators.order import value_ladder, with_average_ranks
from lineside.session import settle


def correlation_t(r: Column, n: Column) -> Column:
    """t statistic of a correlation; a perfect correlation gets a very large one."""
    rest = F.greatest(F.lit(1.0) - r * r, F.lit(1e-300))
    return r * F.sqrt(F.greatest(n - 2, F.lit(0)) / rest)


def with_correlation_p(df: DataFrame, r: str, n: str, p: str) -> DataFrame:
    freedom = (F.col(n) - 2).cast("double")
    return df.withColumn(p, F.when(F.col(n) > 2, t_p_value(correlation_t(F.col(r), F.col(n)), freedom)))


def pearson_test(df: DataFrame, x: str, y: str, by: Sequence[str] = (), min_n: int = 3) -> DataFrame:
    """n, r and two-sided p of x against y per group; NULL below ``min_n`` pairs."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pearson(F.col(x), F.col(y)).alias("pearson_r"))
    out = out.withColumn("pearson_r", F.when(F.col("n") >= min_n, F.col("pearson_r")))
    return with_correlation_p(out, "pearson_r", "n", "pearson_p")


def correlate(df: DataFrame, x: str, y: str, by: Sequence[str] = (), min_n: int = 3) -> DataFrame:
    """Pearson and Spearman correlation with two-sided p-values, one row per group.

    Ranks are taken on values cut to 12 digits, so equal values stay tied on every run.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"),
        stable(F.col(x)).alias("_sx"), stable(F.col(y)).alias("_sy"))
    ranked = with_average_ranks(pairs, {"_rx": "_sx", "_ry": "_sy"}, by)
    out = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        pearson(F.col("_x"), F.col("_y")).alias("pearson_r"),
        pearson(F.col("_rx"), F.col("_ry")).alias("spearman_r"))
    for name in ("pearson", "spearman"):
        out = out.withColumn(f"{name}_r", F.when(F.col("n") >= min_n, F.col(f"{name}_r")))
        out = with_correlation_p(out, f"{name}_r", "n", f"{name}_p")
    return out


def partial_correlation(df: DataFrame, x: str, y: str, given: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of x and y with ``given`` held fixed; the p-value uses n - 2 like a plain one."""
    full = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(given).isNotNull())
    a, b, c = F.col(x), F.col(y), F.col(given)
    out = full.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), pearson(a, b).alias("_ab"), pearson(a, c).alias("_ac"),
        pearson(b, c).alias("_bc"))
    rest = (1 - F.col("_ac") * F.col("_ac")) * (1 - F.col("_bc") * F.col("_bc"))
    r = F.try_divide(F.col("_ab") - F.col("_ac") * F.col("_bc"), F.nullif(F.sqrt(rest), F.lit(0.0)))
    return with_correlation_p(out.withColumn("partial_r", r), "partial_r", "n", "partial_p").drop("_ab", "_ac", "_bc")


def one_sample_t(df: DataFrame, value: str, by: Sequence[str] = (), confidence: float = 0.95) -> DataFrame:
    """Mean against zero: n, mean, sd, t, p and the confidence interval of the mean."""
    out = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    error = F.col("sd") / F.sqrt(F.col("n").cast("double"))
    freedom = (F.col("n") - 1).cast("double")
    out = out.withColumn("t", F.try_divide(F.col("mean"), F.nullif(error, F.lit(0.0))))
    out = out.withColumn("p", F.when(F.col("n") > 1, t_p_value(F.col("t"), freedom)))
    margin = F.when(F.col("n") > 1, t_critical_value(F.lit((1 + confidence) / 2), freedom)) * error
    return out.withColumn("ci_lower", F.col("mean") - margin).withColumn("ci_upper", F.col("mean") + margin)


def paired_t(df: DataFrame, first: str, second: str, by: Sequence[str] = ()) -> DataFrame:
    """Paired t-test of ``first`` minus ``second``."""
    pairs = df.withColumn("_diff", F.col(first) - F.col(second))
    return one_sample_t(pairs, "_diff", by)


def welch_t(df: DataFrame, value: str, first: Column, second: Column) -> DataFrame:
    """Two-sample t-test with unequal variances; ``first`` and ``second`` mark the groups."""
    sides = {"1": F.when(first, F.col(value)), "2": F.when(second, F.col(value))}
    out = df.agg(*[
        agg for s, v in sides.items()
        for agg in (F.count(v).alias(f"n{s}"), F.avg(v).alias(f"mean{s}"), F.var_samp(v).alias(f"_v{s}"))])
    e1, e2 = F.col("_v1") / F.col("n1"), F.col("_v2") / F.col("n2")
    out = out.withColumn("t", F.try_divide(F.col("mean1") - F.col("mean2"), F.nullif(F.sqrt(e1 + e2), F.lit(0.0))))
    freedom = F.try_divide((e1 + e2) * (e1 + e2), F.nullif(
        e1 * e1 / F.nullif(F.col("n1") - 1, F.lit(0)) + e2 * e2 / F.nullif(F.col("n2") - 1, F.lit(0)), F.lit(0.0)))
    out = out.withColumn("df", freedom)
    return out.withColumn("p", t_p_value(F.col("t"), F.col("df"))).drop("_v1", "_v2")


def _ties() -> Column:
    """Sum of t^3 - t over the groups of equal values of a ladder."""
    return F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n"))


def mann_whitney(df: DataFrame, value: str, first: Column, second: Column, alternative: str = "two-sided") -> DataFrame:
    """Mann-Whitney U of ``first`` against ``second``.

    The p-value is the normal approximation with tie and continuity correction, which is what
    applies from nine observations on; it is not the exact small-sample table.
    """
    sides = df.where((first | second) & F.col(value).isNotNull()).select(
        stable(F.col(value)).alias("_v"), indicator(first).alias("_first"))
    steps = value_ladder(sides, "_v", weight="_first")
    rank = F.col("before") + (F.col("n") + 1) / F.lit(2.0)
    out = steps.agg(F.sum(F.col("w") * rank).alias("_r1"), _ties().alias("_ties"),
                    F.max("w_total").alias("n1"), F.max("total").cast("double").alias("_n"))
    out = out.withColumn("n2", F.col("_n") - F.col("n1"))
    out = out.withColumn("u", F.col("_r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    middle = F.col("n1") * F.col("n2") / 2
    spread = F.sqrt(F.col("n1") * F.col("n2") / 12 * (
        F.col("_n") + 1 - F.try_divide(F.col("_ties"), F.col("_n") * (F.col("_n") - 1))))
    larger = F.greatest(F.col("u"), F.col("n1") * F.col("n2") - F.col("u")) if alternative == "two-sided" else F.col("u")
    out = out.withColumn("_z", F.try_divide(larger - middle - 0.5, F.nullif(spread, F.lit(0.0))))
    tail = normal_upper(F.col("_z")) * (2.0 if alternative == "two-sided" else 1.0)
    return out.select(F.col("n1").cast("bigint").alias("n1"), F.col("n2").cast("bigint").alias("n2"), "u",
                      between(tail, 0.0, 1.0).alias("p"))


#: Up to so many differences the signed-rank test counts its null distribution.
EXACT_RANKS = 50


def wilcoxon_signed_rank(df: DataFrame, difference: str) -> DataFrame:
    """Wilcoxon signed-rank test, zero differences dropped.

    Up to 50 differences without ties and zeros the p-value is exact; else it is the normal approximation with tie term.
    """
    cut = df.where(F.col(difference).isNotNull()).select(stable(F.col(difference)).alias("_d"))
    steps = value_ladder(cut.select(F.nullif(F.abs("_d"), F.lit(0.0)).alias("_v"), indicator(F.col("_d") > 0).alias("_up")), "_v", weight="_up")
    rank = F.col("before") + (F.col("n") + 1) / F.lit(2.0)
    out = steps.agg(F.sum(F.col("w") * rank).alias("_up"), F.sum((F.col("n") - F.col("w")) * rank).alias("_down"),
                    _ties().alias("_ties"), F.max("total").cast("double").alias("_n"))
    out = _side_by_side(out, cut.agg(F.count_if(F.col("_d") == 0).alias("_zeros")))
    n = F.col("_n")
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("_ties") / 2) / 24)
    out = out.withColumn("statistic", F.least(F.col("_up"), F.col("_down")))
    out = out.withColumn("_z", F.try_divide(F.col("statistic") - n * (n + 1) / 4, F.nullif(spread, F.lit(0.0))))
    exact = (n <= EXACT_RANKS) & (F.col("_ties") == 0) & (F.col("_zeros") == 0)
    out = out.withColumn("_exact", signed_rank_p(F.when(exact, n), F.col("statistic")))
    return out.select(n.cast("bigint").alias("n"), "statistic",
                      F.coalesce("_exact", between(normal_upper(F.abs(F.col("_z"))) * 2, 0.0, 1.0)).alias("p"))


def kruskal_wallis(df: DataFrame, value: str, group: str, by: Sequence[str] = (), min_group: int = 3) -> DataFrame:
    """Kruskal-Wallis H with tie correction over the groups of at least ``min_group`` values."""
    by = list(by)
    counts = settle(
        df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
        .groupBy(*by, group, stable(F.col(value)).alias("_v")).agg(F.count(F.lit(1)).alias("c")))
    sizes = counts.groupBy(*by, group).agg(F.sum("c").alias("_size")).where(F.col("_size") >= min_group)
    counts = counts.join(sizes, [*by, group])
    steps = value_ladder(counts, "_v", by, count="c")
    rank = (F.col("before") + (F.col("n") + 1) / F.lit(2.0)).alias("_rank")
    sums = counts.join(steps.select(*by, "_v", rank), [*by, "_v"]).groupBy(*by, group).agg(
        F.sum(F.col("c") * F.col("_rank")).alias("_r"), F.max("_size").alias("_size"))
    per_test = sums.groupBy(*by).agg(F.sum(F.col("_r") * F.col("_r") / F.col("_size")).alias("_rr"),
                                     F.count(F.lit(1)).alias("n_groups"), F.sum("_size").alias("n"))
    ties = steps.groupBy(*by).agg(_ties().alias("_ties"))
    out = per_test.join(ties, by) if by else _side_by_side(per_test, ties)
    n = F.col("n").cast("double")
    raw = F.lit(12.0) / (n * (n + 1)) * F.col("_rr") - 3 * (n + 1)
    out = out.where(F.col("n_groups") >= 2)
    out = out.withColumn("h", F.try_divide(raw, F.nullif(1 - F.col("_ties") / (n * n * n - n), F.lit(0.0))))
    out = out.withColumn("p", chi2_p_value(F.col("h"), (F.col("n_groups") - 1).cast("double")))
    return out.select(*by, "n_groups", "n", "h", "p")


def _side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    from lineside.operators.broadcasts import attach_row

    return attach_row(left, right)


def sign_quadrants(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """How many rows fall in each combination of rising and falling x and y."""
    up_x, up_y, down_x, down_y = F.col(x) > 0, F.col(y) > 0, F.col(x) < 0, F.col(y) < 0
    return df.groupBy(*by).agg(
        F.count_if(up_x & up_y).alias("n_both_up"), F.count_if(down_x & down_y).alias("n_both_down"),
        F.count_if(up_x & down_y).alias("n_x_up_y_down"), F.count_if(down_x & up_y).alias("n_x_down_y_up"))
