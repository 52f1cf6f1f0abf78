"""Joins beyond what one ``DataFrame.join`` says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources import scratch


def mark_join(left: DataFrame, right: DataFrame, probe: str, key: str, mark: str = "mark") -> DataFrame:
    """Every left row with the three-valued answer to ``probe IN (SELECT key FROM right)``.

    An empty right side gives FALSE even for a NULL probe; otherwise NULL where nothing matches and the
    probe or a key is NULL. The right side's two facts are one row, its keys one row each."""
    keys = right.where(F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct()
    facts = right.agg(F.count(F.lit(1)).alias("_rows"), F.coalesce(F.bool_or(F.col(key).isNull()), F.lit(False)).alias("_nulls"))
    joined = left.join(keys, F.col(probe) == F.col("_key"), "left").crossJoin(F.broadcast(facts))  # one row
    flag = F.when(F.col("_key").isNotNull(), True).when(F.col("_rows") == 0, False).when(F.col(probe).isNull() | F.col("_nulls"), F.lit(None).cast("boolean")).otherwise(False)
    return joined.withColumn(mark, flag).drop("_key", "_rows", "_nulls")


def single_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, value: str, lenient: bool = False) -> DataFrame:
    """Left rows with the one matching value or NULL; more than one match is an error unless ``lenient``."""
    grouped = right.where(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias(value) if not lenient else F.first(value).alias(value))
    joined = left.join(grouped, F.col(left_key) == F.col("_key"), "left")
    if not lenient:
        kind = dict(joined.dtypes)[value]
        joined = joined.withColumn(value, F.when(F.col("_n") > 1, F.raise_error(F.lit("more than one row returned by a scalar subquery")).cast(kind)).otherwise(F.col(value)))
    return joined.drop("_key", "_n")


def null_safe_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    condition: Column = F.lit(True)
    for a, b in pairs:
        condition = condition & left[a].eqNullSafe(right[b])
    return left.join(right, condition, how)


def outer_count(left: DataFrame, right: DataFrame, left_key: str, right_key: str, count: str = "n") -> DataFrame:
    """count(right rows) per left row's key, 0 where there is none: the right side is counted before the join."""
    counts = right.groupBy(F.col(right_key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    return left.join(counts, F.col(left_key) == F.col("_key"), "left").withColumn(count, F.coalesce("_n", F.lit(0))).drop("_key", "_n")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str], slices: int = 64) -> DataFrame:
    """Each left row with the values of the last right row at or before it, per ``by`` key.

    Time is cut into ``slices`` of equal length, so a hot key is sorted in that many tasks; a row with no right row
    in its slice takes the last one of the key's earlier slices (one row a key and slice). No pair is formed."""
    kind = F.struct(F.lit(True).alias("_met"), *[F.col(v) for v in values])
    null = F.lit(None).cast(right.select(kind.alias("s")).schema["s"].dataType)
    a = left.withColumn("_t", F.col(left_on)).withColumn("_side", F.lit(1)).withColumn("_v", null)
    b = right.select(*by, F.col(right_on).alias("_t"), F.lit(0).alias("_side"), kind.alias("_v"))
    number = lambda c: c.cast("timestamp").cast("double") if dict(left.dtypes)[left_on] in ("date", "timestamp", "timestamp_ntz") else c.cast("double")
    span = left.agg(F.min(number(F.col(left_on))).alias("lo"), F.max(number(F.col(left_on))).alias("hi")).first()
    width = ((span["hi"] or 0) - (span["lo"] or 0)) / slices or 1.0
    part = F.greatest(F.lit(-1), F.least(F.lit(slices), F.floor((number(F.col("_t")) - F.lit(span["lo"] or 0.0)) / width))).cast("int")
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_slice", part)
    w = Window.partitionBy(*by, "_slice").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    ends = b.withColumn("_slice", part).groupBy(*by, "_slice").agg(F.max_by("_v", "_t").alias("_last"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # every slice of a key that has rows on either side
    seen = both.select(*by, "_slice").distinct().join(ends, [*by, "_slice"], "left").withColumn("_earlier", F.last("_last", ignorenulls=True).over(earlier))
    seen = seen.where("_earlier is not null").select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_slice").alias("_ks"), "_earlier")
    match = F.col("_slice") == F.col("_ks")
    for i, c in enumerate(by):
        match = match & (F.col(c) == F.col(f"_k{i}"))
    found = F.coalesce(F.col("_v"), F.col("_earlier"))
    return filled.join(seen, match, "left").select(*left.columns, *[found[v].alias(v) for v in values])


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """left.point in [right.low, right.high): an equi-join on bins and the exact condition.

    Bins of ``width`` double from level to level. An interval is put into the level where it spans at most three
    bins, however wide it is; a point looks into its bin of every level that occurs (at most 64)."""
    span = F.greatest(F.col(high) - F.col(low), F.lit(0.0)) / width
    level = F.when(span <= 1, 0).otherwise(F.ceil(F.log2(span))).cast("int")
    b = right.where(F.col(low) < F.col(high)).withColumn("_level", level).withColumn("_size", F.pow(F.lit(2.0), "_level") * width)
    levels = [r["_level"] for r in b.select("_level").distinct().collect()]  # at most 64
    b = b.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / F.col("_size")).cast("bigint"), F.floor(F.col(high) / F.col("_size")).cast("bigint"))))
    a = left.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    a = a.withColumn("_bin", F.floor(F.col(point) / (F.pow(F.lit(2.0), "_level") * width)).cast("bigint"))
    return a.join(b, ["_level", "_bin"]).where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_bin", "_level", "_size")


def max_before(df: DataFrame, by: list[str], order: str, value: str, name: str, slices: int = 64) -> DataFrame:
    """Each row with the largest ``value`` of the rows of its ``by`` key whose ``order`` (an integer) is smaller, or NULL.

    ``order`` is cut into ``slices`` of equal length, so a hot key is sorted in that many tasks; earlier slices give
    one row a key and slice. No pair is formed."""
    number = F.col(order).cast("double")
    span = df.agg(F.min(number).alias("lo"), F.max(number).alias("hi")).first()
    width = ((span["hi"] or 0) - (span["lo"] or 0)) / slices or 1.0
    # a row without a place is smaller than none
    seen = F.when(F.col(order).isNotNull(), F.col(value))
    cut = df.withColumn("_slice", F.floor((number - F.lit(span["lo"] or 0.0)) / width).cast("int")).withColumn("_v", seen)
    before = Window.partitionBy(*by, "_slice").orderBy(F.col(order).cast("decimal(20,0)")).rangeBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.where(F.col(order).isNotNull()).groupBy(*by, "_slice").agg(F.max("_v").alias("_m")).withColumn("_earlier", F.max("_m").over(earlier)).where("_earlier is not null")
    ends = ends.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_slice").alias("_ks"), "_earlier")
    match = F.col("_slice") == F.col("_ks")
    known = F.lit(True)
    for i, c in enumerate(by):
        match, known = match & (F.col(c) == F.col(f"_k{i}")), known & F.col(c).isNotNull()
    joined = cut.withColumn("_within", F.max("_v").over(before)).join(ends, match, "left")
    return joined.select(*df.columns, F.when(known, F.greatest("_within", "_earlier")).alias(name))


def count_below(left: DataFrame, right: DataFrame, probe: str, key: str, count: str = "n") -> DataFrame:
    """Each left row with the number of right rows whose ``key`` is less than its ``probe``; 0 for a NULL probe.

    Both sides are sorted together, the right one as one row a value, and stored with their partition; counts run
    within a partition and start at the sum of those before it. No pair is formed, and equal probes may be parted."""
    values = right.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_at")).agg(F.count(F.lit(1)).alias("_c"))
    # a value follows the probes equal to it; NULL probes come before all values
    probes = left.withColumn("_at", F.col(probe)).withColumn("_side", F.lit(0)).withColumn("_c", F.lit(0).cast("long")).withColumn("_tie", F.monotonically_increasing_id())
    both = probes.unionByName(values.withColumn("_side", F.lit(1)).withColumn("_tie", F.lit(0).cast("long")), allowMissingColumns=True)
    ordered = both.orderBy(F.asc_nulls_first("_at"), "_side", "_tie").withColumn("_p", F.spark_partition_id())
    at = scratch.path(left.sparkSession, "below")
    ordered.write.parquet(at)
    ordered = left.sparkSession.read.schema(ordered.schema).parquet(at)
    starts, total = [], 0
    for r in sorted(ordered.groupBy("_p").agg(F.sum("_c").alias("c")).collect()):  # one row a partition
        starts.append((r["_p"], total))
        total += r["c"]
    table = left.sparkSession.createDataFrame(starts, "_p int, _s bigint")
    w = Window.partitionBy("_p").orderBy(F.asc_nulls_first("_at"), "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = ordered.withColumn("_r", F.sum("_c").over(w)).where("_side = 0").join(F.broadcast(table), "_p")
    return running.select(*left.columns, (F.col("_s") + F.col("_r")).alias(count))


def positional_join(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """n-th row with n-th row, padded with NULLs; positions come from range-partitioned sorts."""
    return numbered(left, left_order)[0].join(numbered(right, right_order)[0], "_n", "full").drop("_n")


def numbered(df: DataFrame, order: list) -> tuple[DataFrame, int]:
    """``df`` with the place ``_n`` (from 0) of each row, and the number of rows.

    The sorted rows are stored with their partition and place there, so that both readings see the same partitions."""
    ordered = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    at = scratch.path(df.sparkSession, "numbered")
    ordered.write.parquet(at)
    ordered = df.sparkSession.read.schema(ordered.schema).parquet(at)
    ordered = ordered.withColumn("_p", F.shiftright("_id", 33)).withColumn("_i", F.col("_id").bitwiseAND((1 << 33) - 1))
    sizes = {r["_p"]: r["c"] for r in ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("c")).collect()}  # one row a partition
    starts, total = [], 0
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    table = df.sparkSession.createDataFrame(starts, "_p bigint, _s bigint")
    return ordered.join(F.broadcast(table), "_p").withColumn("_n", F.col("_s") + F.col("_i")).drop("_p", "_i", "_id", "_s"), total


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys are dealt over ``salts`` tasks; the right side is repeated that often."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the repeated side cannot be preserved")
    a = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [key, "_salt"], how).drop("_salt")
