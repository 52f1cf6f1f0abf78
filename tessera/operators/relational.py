"""Aggregates, sets, windows, sorting and duplication with the engine's result types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(15,2)"


def sum_exact(x) -> Column:
    """Integers summed in 128 bits (38 digits)."""
    return F.sum((F.col(x) if isinstance(x, str) else x).cast("decimal(38,0)"))


def sum_money(x) -> Column:
    """Double money summed exactly as decimals, shown as a double."""
    return F.sum((F.col(x) if isinstance(x, str) else x).cast(MONEY)).cast("double")


def avg_double(x) -> Column:
    return F.avg((F.col(x) if isinstance(x, str) else x).cast("double"))


def stddev_samp(x) -> Column:
    """Sample deviation, NULL under two values; infinite values and NaN are an error."""
    v = (F.col(x) if isinstance(x, str) else x).cast("double")
    bad = F.bool_or(F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("stddev_samp of a value that is not finite")).cast("double")).otherwise(F.stddev_samp(v))


def count_distinct_rows(*columns: str) -> Column:
    """COUNT(DISTINCT (a, b)): NULL components count, as the tuple itself is not NULL."""
    return F.count_distinct(F.struct(*columns))


def first_row(*columns: str) -> Column:
    """FIRST of several columns, all from one row."""
    return F.first(F.struct(*columns))


def distinct_on(df: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    if not order:
        return df.dropDuplicates(keys)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def replicate(df: DataFrame, count: str) -> DataFrame:
    """Each row as often as its ``count`` says, without that column; less than 1 drops the row."""
    return df.where(F.col(count) > 0).withColumn("_r", F.explode(F.expr(f"array_repeat(0, cast(`{count}` as int))"))).drop("_r", count)


def limit_percent(df: DataFrame, percent: float, order: list[Column]) -> DataFrame:
    """The first ``percent`` of the ordered rows: those whose place is low enough, in as many tasks as the sort has."""
    from .joins import numbered

    placed, n = numbered(df, order)
    return placed.where(F.col("_n") < int(n * percent / 100)).drop("_n")


def top_n(df: DataFrame, order: list[Column], n: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(n) if offset else df.orderBy(*order).limit(n)


def grouping_sets(df: DataFrame, sets: list[list[str]], aggregates: list[Column], keys: list[str]) -> DataFrame:
    """GROUPING SETS; the sets with keys in one pass, each empty set as an ungrouped aggregate, which
    gives its one row for an empty input too."""
    keyed, totals = [x for x in sets if x], [x for x in sets if not x]
    out = df.groupingSets([[F.col(c) for c in x] for x in keyed], *keys).agg(*aggregates) if keyed else None
    for _ in totals:
        total = df.agg(*aggregates)
        total = total.select(*[F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys], *total.columns)
        out = total if out is None else out.unionByName(total)
    return out


# windows with excluded rows


def without_current(function: str, column: str, keys: list[str], order: list[Column], before: int, after: int) -> Column:
    """``function`` (sum, count, min or max) over ROWS BETWEEN before PRECEDING AND after FOLLOWING EXCLUDE CURRENT ROW:
    the frames on either side of the row, put together."""
    w = Window.partitionBy(*keys).orderBy(*order)
    one = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[function]
    sides = [one(column).over(w.rowsBetween(-before, -1)), one(column).over(w.rowsBetween(1, after))]
    if function == "min":
        return F.least(*sides)
    if function == "max":
        return F.greatest(*sides)
    both = F.coalesce(sides[0], F.lit(0)) + F.coalesce(sides[1], F.lit(0))
    return both if function == "count" else F.when(sides[0].isNotNull() | sides[1].isNotNull(), both)


def without_peers(function: str, column: str, keys: list[str], order: list[str], ties_only: bool = False) -> Column:
    """``function`` (sum or count) over the whole partition EXCLUDE GROUP, or EXCLUDE TIES (the row itself stays)."""
    one = {"sum": F.sum, "count": F.count}[function]
    own = F.col(column) if function == "sum" else F.col(column).isNotNull().cast("int")
    rest = F.coalesce(one(column).over(Window.partitionBy(*keys)), F.lit(0)) - F.coalesce(one(column).over(Window.partitionBy(*keys, *order)), F.lit(0))
    return rest + F.coalesce(own, F.lit(0)) if ties_only else rest
