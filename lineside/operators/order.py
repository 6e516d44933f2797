"""Ranks, quantiles, running totals and concentration, without a single-task global sort.

The building block is the *value ladder*: one row per distinct value with the number (and
weight) of rows below it. Values are first counted where they lie, so a value shared by a third
of all rows is one ladder row. The order is then resolved in two steps: a coarse, order-keeping
bucket of each double (its exponent and the top of its mantissa, at most a few thousand in
practice) gets its offset from a running sum over the buckets, and the values inside one bucket
are ordered in their own window partition.

Ranks and positions of the rows themselves go by range: the rows are split on sampled bounds of the whole
sort key, numbered inside their partition, and shifted by the counts of the partitions before.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineside.session import settle

_MANTISSA_STEPS = 1024


def _bucket(value: Column) -> Column:
    """A bigint that never decreases as ``value`` grows."""
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    step = exponent * _MANTISSA_STEPS + F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * _MANTISSA_STEPS)
    offset = 1100 * _MANTISSA_STEPS
    ends = [(F.isnan(value), 2), (value == float("inf"), 1), (value == float("-inf"), -1)]  # NaN is last, as in Spark's own order
    found = F.when(size == 0, F.lit(0))
    for condition, place in ends:
        found = found.when(condition, F.lit(place << 40))
    return found.when(value > 0, step + offset).otherwise(-step - offset).cast("bigint")


def _sort_key(df: DataFrame, value: str, descending: bool) -> Column:
    """The column itself in its own type, turned round for descending order: large integers keep all digits."""
    kind = df.schema[value].dataType
    exact = isinstance(kind, (T.IntegralType, T.DecimalType))
    x = F.col(value).cast("decimal(38,0)" if isinstance(kind, T.IntegralType) else kind if exact else "double")
    return -x if descending and exact else (-x if descending else x) + F.lit(0 if exact else 0.0)


def _below(over: Sequence[str], order: str):
    partition = [F.col(c) for c in over] or [F.lit(1)]
    return Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def value_ladder(df: DataFrame, value: str, strata: Sequence[str] = (), weight: str | None = None,
                 count: str | None = None) -> DataFrame:
    """Distinct values with ``n``, ``before`` and ``total`` row counts per stratum.

    With ``weight`` also ``w``, ``w_before`` and ``w_total``. NULL values are left out. A frame
    that is already counted names its count column in ``count``.
    """
    strata = list(strata)
    sums = [(F.sum(count) if count else F.count(F.lit(1))).alias("n")]
    carried = {"n": "before"}
    totals = {"n": "total"}
    if weight is not None:
        sums.append(F.coalesce(F.sum(F.col(weight).cast("double")), F.lit(0.0)).alias("w"))
        carried["w"], totals["w"] = "w_before", "w_total"
    steps = df.where(F.col(value).isNotNull()).groupBy(*strata, value).agg(*sums)
    steps = steps.withColumn("_bucket", _bucket(F.col(value).cast("double")))
    everything = Window.partitionBy(*([F.col(c) for c in strata] or [F.lit(1)]))
    buckets = steps.groupBy(*strata, "_bucket").agg(*[F.sum(c).alias(c) for c in carried])
    buckets = buckets.select(
        *strata, "_bucket",
        *[F.coalesce(F.sum(c).over(_below(strata, "_bucket")), F.lit(0)).alias(f"_{b}") for c, b in carried.items()],
        *[F.sum(c).over(everything).alias(t) for c, t in totals.items()],
    )
    inside = _below([*strata, "_bucket"], value)
    return (
        _join_null_safe(steps, buckets, [*strata, "_bucket"])
        .withColumns({b: F.col(f"_{b}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c, b in carried.items()})
        .drop("_bucket", *[f"_{b}" for b in carried.values()])
    )


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also pairs NULL keys, keeping the left key columns."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def _in_ranges(df: DataFrame, strata: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` range-partitioned and sorted on the whole composite key, written once.

    ``_s`` stands for the stratum (NULLs are equal in it) and ``_pid`` for the partition. Bounds are sampled on all
    of ``order``, whose last column should tell rows of one value apart, so neither a heavy value nor one
    stratum stays in one task.
    """
    keyed = df.withColumn("_s", F.struct(*strata) if strata else F.struct(F.lit(0).alias("all")))
    laid = keyed.repartitionByRange("_s", *order).sortWithinPartitions("_s", *order)
    return settle(laid).withColumn("_pid", F.spark_partition_id())


def _earlier() -> WindowSpec:
    """The partitions of a stratum before this one: a few rows for each task of the range split."""
    return Window.partitionBy("_s").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)


def _with_border_runs(rows: DataFrame) -> DataFrame:
    """``rows`` with what its partition's first and last value need to know of the partitions around.

    A run of equal values may cross partitions. Where it begins and how long it is follow from a table with two rows
    for each partition and stratum.
    """
    here = ["_s", "_pid"]
    ends = rows.groupBy(*here).agg(
        F.count("_key").alias("_n"), F.count_if(F.col("_key").isNull()).alias("_nulls"), F.min("_key").alias("_first"), F.max("_key").alias("_last"))
    tied = (rows.join(ends.select(*here, "_first", "_last"), here).groupBy(*here)
            .agg(F.count_if(F.col("_key") == F.col("_first")).alias("_first_n"), F.count_if(F.col("_key") == F.col("_last")).alias("_last_n")))
    whole = Window.partitionBy("_s")
    ends = settle(ends.join(tied, here).withColumns({
        "_off": F.coalesce(F.sum("_n").over(_earlier()), F.lit(0)), "_total": F.sum("_n").over(whole)}))
    border = ends.select("_s", F.explode(F.when(
        F.col("_first") == F.col("_last"), F.array(F.struct(F.col("_first").alias("key"), F.col("_first_n").alias("n"), F.col("_off").alias("start"))))
        .otherwise(F.array(
            F.struct(F.col("_first").alias("key"), F.col("_first_n").alias("n"), F.col("_off").alias("start")),
            F.struct(F.col("_last").alias("key"), F.col("_last_n").alias("n"), (F.col("_off") + F.col("_n") - F.col("_last_n")).alias("start"))))).alias("x"))
    runs = border.where(F.col("x.key").isNotNull()).groupBy("_s", F.col("x.key").alias("_key")).agg(
        (F.min("x.start") + (F.sum("x.n") + 1) / F.lit(2.0)).alias("_rank"))
    for end in ("_first", "_last"):
        ends = ends.join(runs.withColumnsRenamed({"_key": end, "_rank": f"{end}_rank"}), ["_s", end], "left")
    return rows.join(ends.select(*here, "_first", "_last", "_first_rank", "_last_rank", "_off", "_nulls", "_total"), here)


def with_average_ranks(
    df: DataFrame, ranks: dict[str, str], strata: Sequence[str] = (), descending: Sequence[str] = (),
    within: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Add average ranks (ties share the mean rank). ``ranks`` maps new column to value column.

    NULL values stay unranked. Names in ``descending`` rank from the largest value down; a name
    in ``within`` has strata of its own. Rows are split by range on the value and a random number, so the rows of
    one value, or of none, lie in as many tasks as their share asks for; they are not joined back on the value.
    """
    columns, df = df.columns, settle(df)
    for name, value in ranks.items():
        by = list((within or {}).get(name, strata))
        rows = _in_ranges(df.withColumns({"_key": _sort_key(df, value, False), "_any": F.rand(5)}), by, ["_key", "_any"])
        local = Window.partitionBy("_s", "_pid")
        rows = _with_border_runs(rows).withColumns({
            "_below": F.rank().over(local.orderBy("_key")) - 1 - F.col("_nulls"),
            "_ties": F.count(F.lit(1)).over(Window.partitionBy("_s", "_pid", "_key"))})
        rank = (F.when(F.col("_key") == F.col("_first"), F.col("_first_rank")).when(F.col("_key") == F.col("_last"), F.col("_last_rank"))
                .otherwise(F.col("_off") + F.col("_below") + (F.col("_ties") + 1) / F.lit(2.0)))
        rank = F.when(F.col("_key").isNotNull(), F.col("_total") + 1 - rank if name in descending else rank)
        columns = [*columns, name]
        df = rows.withColumn(name, rank).select(columns)
    return df


def quantiles(df: DataFrame, value: str, picks: dict[str, float], strata: Sequence[str] = (),
              method: str = "linear") -> DataFrame:
    """Exact quantiles per stratum from the ladder, one column per pick.

    ``linear`` interpolates between neighbours, ``nearest`` takes the nearest position (halves
    round up), ``upper`` takes position ``n // 2`` counted from zero (for the median).
    """
    steps = value_ladder(df, value, strata)
    x = F.col(value).cast("double")
    found = []
    for name, p in picks.items():
        place = (F.col("total") - 1) * F.lit(float(p))
        if method == "linear":
            low, share = F.floor(place), place - F.floor(place)
            high = F.ceil(place)
        else:
            low = F.floor(F.col("total") / 2) if method == "upper" else F.floor(place + 0.5)
            high, share = low, F.lit(0.0)
        at = [F.max(F.when((F.col("before") <= q) & (q < F.col("before") + F.col("n")), x)) for q in (low, high)]
        found.append((at[0] + (at[1] - at[0]) * F.max(share)).alias(name))
    return steps.groupBy(*strata).agg(*found)


def medians(df: DataFrame, value: str, strata: Sequence[str] = (), name: str = "median") -> DataFrame:
    return quantiles(df, value, {name: 0.5}, strata)


def gini(df: DataFrame, value: str, strata: Sequence[str] = ()) -> DataFrame:
    """Gini coefficient of non-negative values per stratum; NULL for n < 2 or a zero total."""
    x, n = F.col(value).cast("double"), F.col("n")
    steps = value_ladder(df, value, strata)
    # the n equal values of a step hold positions before+1 .. before+n
    placed = F.sum(x * n * (F.col("before") + (n + 1) / F.lit(2.0)))
    total, count = F.sum(x * n), F.sum(n)
    return steps.groupBy(*strata).agg(
        F.when((count >= 2) & (total != 0), F.try_divide(2 * placed - (count + 1) * total, count * total)).alias("gini"),
        count.alias("n_values"), total.alias("total_value"), F.max(x).alias("max_value"),
    )


def with_positions(
    df: DataFrame, value: str, tiebreak: str, strata: Sequence[str] = (), descending: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Row position 1..n in the order of ``value`` (then ``tiebreak`` ascending as text, then a hash of the row).

    Adds ``position`` and ``total``, and with ``weight`` the running ``cum_weight`` and
    ``total_weight``. Rows with a NULL value are left out. Rows are split by range on all of that
    order, so neither a heavily repeated value nor ids that begin alike end up in one task. Weights are
    added as whole numbers of one unit (the largest weight has 61 bits), so sums don't depend on where
    the partitions end.
    """
    columns = df.columns
    rows = _in_ranges(
        df.where(F.col(value).isNotNull()).withColumns({
            "_key": _sort_key(df, value, descending), "_tie": F.col(tiebreak).cast("string"), "_row": F.xxhash64(*columns),
            "_w": F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(0.0)}),
        list(strata), ["_key", "_tie", "_row"])
    unit = 1.0
    if weight:
        largest = rows.agg(F.max(F.abs("_w"))).first()[0] or 0.0
        unit = 2.0 ** max(math.frexp(largest)[1] - 61, -1000) if math.isfinite(largest) else math.nan
    exact = math.isfinite(unit)
    rows = rows.withColumn("_u", F.bround(F.col("_w") / F.lit(unit)).cast("decimal(38,0)") if exact else F.col("_w"))
    here, whole = ["_s", "_pid"], Window.partitionBy("_s")
    ends = rows.groupBy(*here).agg(F.count(F.lit(1)).alias("_n"), F.sum("_u").alias("_us"))
    ends = ends.select(
        *here, F.coalesce(F.sum("_n").over(_earlier()), F.lit(0)).alias("_off"), F.sum("_n").over(whole).alias("total"),
        F.coalesce(F.sum("_us").over(_earlier()), F.lit(0)).alias("_before"), F.sum("_us").over(whole).alias("_all"))
    local = Window.partitionBy(*here).orderBy("_key", "_tie", "_row")
    running = F.sum("_u").over(local.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    size = F.lit(unit if exact else 1.0)
    found = {"position": F.col("_off") + F.row_number().over(local)}
    if weight:
        found |= {"cum_weight": (F.col("_before") + running).cast("double") * size, "total_weight": F.col("_all").cast("double") * size}
    return rows.join(ends, here).withColumns(found).select(*columns, "position", "total", *(["cum_weight", "total_weight"] if weight else []))


def ntile_of(position: Column, total: Column, tiles: int) -> Column:
    """Equal-size tiles 1..tiles over positions 1..total; the first tiles take the remainder."""
    size, extra = F.floor(total / tiles), total % tiles
    edge = extra * (size + 1)
    return (
        F.when(position <= edge, F.floor((position - 1) / (size + 1)) + 1)
        .otherwise(extra + F.floor(F.try_divide(position - edge - 1, F.nullif(size, F.lit(0)))) + 1)
        .cast("int")
    )
