"""Loading rules: first row per key, dominant row, constraints, profiles and coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class ForeignKeyError(ValueError):
    """A load referred to parent rows that do not exist."""


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Keep the first row per key in the given order.

    An aggregate (``min_by`` of the whole row), so partial winners are chosen before the
    shuffle and a key that holds much of the data does not land in one sorted window.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ranked).alias("_row")).select(
        *[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def dominant_row(df: DataFrame, keys: Sequence[str], measure: str, tiebreak: str) -> DataFrame:
    """Keep the row with the largest measure per key; ties go to the smaller ``tiebreak``."""
    size = F.coalesce(F.col(measure).cast("double"), F.lit(float("-inf")))
    return first_per_key(df, keys, [-size, F.col(tiebreak)])


def load_once(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], not_null: Sequence[str] = (),
              seen: Observation | None = None) -> DataFrame:
    """Rows an idempotent keyed load keeps.

    Rows that break NOT NULL are skipped, the first row per key wins, and rows with a NULL key
    part are all kept, since NULL never equals NULL in a key. With ``seen`` the breaches that ``check_table`` reports for the key
    and NOT NULL are counted on the way, once the rows are written.
    """
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    if seen is None:
        for column in not_null:
            df = df.where(F.col(column).isNotNull())
        return first_per_key(df.where(whole), keys, order).unionByName(df.where(~whole))
    fits = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in not_null], F.lit(True))
    ranked = F.when(fits, F.struct(*[F.col(o) if isinstance(o, str) else o for o in order]))
    rest = F.struct(*[c for c in df.columns if c not in keys])
    nulls = [F.count_if(F.col(c).isNull()).alias(f"_null{i}") for i, c in enumerate(not_null)]
    found = df.withColumn("_alone", F.when(~whole, F.monotonically_increasing_id())).groupBy(*keys, "_alone").agg(
        F.min_by(rest, ranked).alias("_row"), F.count(F.lit(1)).alias("_n"), F.count_if(fits).alias("_fit"), *nulls)
    found = found.observe(seen, F.sum(F.when(F.col("_alone").isNull(), F.col("_n") - 1)).alias("extra"), *[
        F.sum(f"_null{i}").alias(c) for i, c in enumerate(f"null_{c}" for c in not_null)])
    return found.where("_fit > 0").select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def append_new(current: DataFrame, arriving: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
               not_null: Sequence[str] = ()) -> DataFrame:
    """Rows of ``arriving`` that a keyed load adds to ``current``: those whose key is not there yet."""
    return load_once(arriving, keys, order, not_null).join(current.select(*keys), list(keys), "left_anti")


def check_table(name: str, df: DataFrame, key: Sequence[str] = (), not_null: Sequence[str] = (),
                parents: Mapping[str, tuple[DataFrame, str]] | None = None, seen: Observation | None = None) -> DataFrame:
    """Constraint report of one table: (table_name, check_name, column_name, violations).

    With ``seen`` the breaches of the key and NOT NULL were counted while ``load_once`` wrote the rows, and ``df`` is not read for them.
    """
    if seen is not None:
        counted = seen.get
        rows = [(name, "primary_key", ",".join(key), counted.get("extra") or 0)] if key else []
        rows += [(name, "not_null", c, counted.get(f"null_{c}") or 0) for c in not_null]
        report = df.sparkSession.createDataFrame(rows, "table_name string, check_name string, column_name string, violations bigint")
        return report.unionByName(check_table(name, df, parents=parents)) if parents else report

    def line(check: str, column: str, counted: DataFrame) -> DataFrame:
        return counted.select(F.lit(name).alias("table_name"), F.lit(check).alias("check_name"),
                              F.lit(column).alias("column_name"), F.coalesce("n", F.lit(0)).cast("bigint").alias("violations"))

    lines = []
    if key:
        whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
        extra = df.where(whole).groupBy(*key).agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c") - 1).alias("n"))
        lines.append(line("primary_key", ",".join(key), extra))
    if not_null:
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in not_null])
        tall = counts.unpivot([], list(not_null), "column_name", "n")
        lines.append(tall.select(F.lit(name).alias("table_name"), F.lit("not_null").alias("check_name"),
                                 "column_name", F.col("n").alias("violations")))
    for column, (parent, parent_key) in (parents or {}).items():
        lost = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("c")).join(
            parent.select(F.col(parent_key).alias(column)), column, "left_anti").agg(F.sum("c").alias("n"))
        lines.append(line("foreign_key", column, lost))
    return reduce(DataFrame.unionByName, lines)


def require_parents(report: DataFrame) -> None:
    """Stop a load whose report counts a foreign-key violation."""
    broken = report.where((F.col("check_name") == "foreign_key") & (F.col("violations") > 0)).limit(5).collect()
    if broken:
        raise ForeignKeyError("; ".join(f"{r['table_name']}.{r['column_name']}: {r['violations']} rows" for r in broken))


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL count and percentage per column, from one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    tall = counts.unpivot(["n_rows"], list(columns), "column_name", "n_null")
    return tall.withColumn("pct_null", F.try_divide(F.col("n_null") * 100.0, F.col("n_rows")))


def key_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many distinct keys two tables share and how many each has alone, in one row."""
    a = left.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_l", F.lit(1))
    b = right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_r", F.lit(1))
    both, only_l, only_r = (F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.col("_r").isNull(), F.col("_l").isNull())
    return a.join(b, key, "full").agg(
        F.count_if(both).alias("n_both"), F.count_if(only_l).alias("n_only_left"),
        F.count_if(only_r).alias("n_only_right"),
        F.min(F.when(both, F.col(key))).alias("first_both"), F.max(F.when(both, F.col(key))).alias("last_both"))


def period_change(df: DataFrame, period: str, value: str, first: str, second: str) -> DataFrame:
    """Totals of two periods and the percent change between them, in one row."""
    totals = df.where(F.col(period).isin(first, second)).agg(
        F.sum(F.when(F.col(period) == first, F.col(value))).alias("first_total"),
        F.sum(F.when(F.col(period) == second, F.col(value))).alias("second_total"))
    change = F.try_divide((F.col("second_total") - F.col("first_total")) * 100.0, F.nullif(F.col("first_total"), F.lit(0)))
    return totals.withColumn("pct_change", change)


def both_ends(df: DataFrame, value: str, tiebreak: str, k: int) -> DataFrame:
    """The ``k`` largest and ``k`` smallest rows by ``value``, without duplicates."""
    top = df.orderBy(F.col(value).desc_nulls_last(), tiebreak).limit(k)
    bottom = df.orderBy(F.col(value).asc_nulls_last(), tiebreak).limit(k)
    return top.unionByName(bottom).dropDuplicates()
