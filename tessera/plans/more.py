"""Queries of sinks, pins and the breadth of functions, aggregates and windows beyond the native set."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import pin, sql
from tessera.catalog import Tables
from tessera.operators import relational
from tessera.sources import files, scratch, sinks
from tessera.streaming import windows as event_time

from .catalogue import query, same

# sources and sinks


@query("copy_parquet_rows", "SELECT count(*) AS written, count(*) AS read_back, count(DISTINCT o_orderkey) AS keys FROM orders")
def copy_parquet_rows(spark, d):
    at = scratch.path(spark, "copy")
    n = sinks.copy_parquet(Tables(spark, d).orders, at, "zstd")
    return spark.read.parquet(at).agg(F.lit(n).cast("bigint").alias("written"), F.count(F.lit(1)).alias("read_back"), F.count_distinct("o_orderkey").alias("keys"))


@query("hive_partitions", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'")
def hive_partitions(spark, d):
    at = scratch.path(spark, "hive")
    sinks.copy_parquet(Tables(spark, d).orders.select("o_orderkey", "o_orderpriority", "o_orderstatus"), at, "snappy", ["o_orderstatus", "o_orderpriority"])
    return files.read_parquet(spark, at).where("o_orderstatus = 'F' and o_orderpriority <> '5-LOW'").select("o_orderkey", "o_orderstatus")


@query("csv_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, d):
    at = scratch.path(spark, "csv")
    t = Tables(spark, d).nation
    sinks.copy_csv(t, at)
    return spark.read.schema(t.schema).option("header", True).csv(at)


@query("arrow_round_trip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def arrow_round_trip(spark, d):
    return files.from_arrow(spark, sinks.to_arrow(Tables(spark, d).supplier.select("s_suppkey", "s_name", "s_acctbal")))


@query("pinned_scan", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey > 100 GROUP BY c_mktsegment")
def pinned_scan(spark, d):
    pin.pin_table(spark, f"{d}/customer.parquet", name="pinned_customer", columns=["c_custkey", "c_mktsegment"], unique_cols=["c_custkey"])
    return sql.run(spark, "SELECT c_mktsegment, count(*) AS n FROM pinned_customer WHERE c_custkey > 100 GROUP BY c_mktsegment", label="pinned")


@query("deletion_vector", "SELECT s_suppkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier) WHERE pos NOT IN (0, 3, 4, 17)")
def deletion_vector(spark, d):
    import struct
    import zlib

    positions = [0, 3, 4, 17]
    body = b"\xd1\xd3\x39\x64" + struct.pack("<QIII", 1, 0, 12346, 1) + struct.pack("<HHI", 0, len(positions) - 1, 16) + struct.pack(f"<{len(positions)}H", *positions)
    blob = b"".join([len(body).to_bytes(4, "big"), body, zlib.crc32(body).to_bytes(4, "big")])
    data = files.read_parquet(spark, f"{d}/supplier.parquet", filename=True, file_row_number=True)
    gone = spark.createDataFrame([(p,) for p in files.deletion_vector(blob)], "pos long")
    name = data.select(F.col("filename").alias("file_path")).limit(1)
    return files.positional_deletes(data, gone.crossJoin(F.broadcast(name))).select("s_suppkey")  # one row


@query("multi_file_scan", "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS s FROM orders")
def multi_file_scan(spark, d):
    at = scratch.path(spark, "many")
    Tables(spark, d).orders.repartition(4, "o_orderkey").write.parquet(at)
    return files.read_parquet(spark, f"{at}/part-*").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("s"))


@query("exchange_hash", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS keys, true AS together FROM orders")
def exchange_hash(spark, d):
    dealt = Tables(spark, d).orders.select("o_custkey").repartition(8, "o_custkey").withColumn("p", F.spark_partition_id())
    per_key = dealt.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("p").alias("places"))
    return per_key.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("keys"), (F.max("places") == 1).alias("together"))


# functions

same("fn_positions", "SELECT c_custkey, position('o' IN c_name) AS p, instr(c_name, '0') AS i, translate(c_name, 'Cu', 'Kü') AS t, split_part(c_name, '_', 2) AS sp, md5(c_name) AS h FROM customer",
     "SELECT c_custkey, position('o' IN c_name)::INTEGER AS p, instr(c_name, '0')::INTEGER AS i, translate(c_name, 'Cu', 'Kü') AS t, split_part(c_name, '_', 2) AS sp, md5(c_name) AS h FROM customer")
same("fn_regexp", r"SELECT page_id, regexp_extract(url, '://([^/]+)/', 1) AS host, regexp_like(url, '\\?page=') AS paged, regexp_count(url, 'e') AS es, size(regexp_extract_all(url, '([a-z]+)', 1)) AS parts FROM pages",
     r"SELECT page_id, regexp_extract(url, '://([^/]+)/', 1) AS host, regexp_matches(url, '\?page=') AS paged, len(regexp_extract_all(url, 'e'))::INTEGER AS es, len(regexp_extract_all(url, '([a-z]+)', 1))::INTEGER AS parts FROM pages")
same("fn_date_more", """SELECT event_id, date_diff(DAY, timestamp '2024-01-01 00:00:00', ts) AS days, cast(dayofweek(ts) AS BIGINT) - 1 AS dow, cast(dayofyear(ts) AS BIGINT) AS doy,
cast(weekofyear(ts) AS BIGINT) AS wk, date_format(ts, 'yyyy-MM-dd HH:mm') AS shown, last_day(cast(ts AS DATE)) AS month_end, add_months(cast(ts AS DATE), 1) AS next_month FROM events""",
     """SELECT event_id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01 00:00:00')) // 86400000000 AS days, dayofweek(ts) AS dow, dayofyear(ts) AS doy, weekofyear(ts) AS wk,
strftime(ts, '%Y-%m-%d %H:%M') AS shown, last_day(ts::DATE) AS month_end, (ts::DATE + INTERVAL 1 MONTH)::DATE AS next_month FROM events""")
same("fn_lists", """SELECT n_nationkey, array_join(array_sort(split(n_name, '')), '') AS letters, size(array_distinct(split(n_name, ''))) AS distinct_letters, array_join(slice(split(n_name, ''), 2, 3), '') AS part,
aggregate(sequence(1, n_nationkey + 1), 0, (a, x) -> a + x) AS total, array_join(transform(filter(sequence(1, 9), x -> x % 2 = n_regionkey % 2), x -> x * 10), ',') AS tens FROM nation""",
     """SELECT n_nationkey, array_to_string(list_sort(string_split(n_name, '')), '') AS letters, len(list_distinct(string_split(n_name, '')))::INTEGER AS distinct_letters, array_to_string(string_split(n_name, '')[2:4], '') AS part,
list_sum(range(1, n_nationkey + 2))::INTEGER AS total, array_to_string(list_transform(list_filter(range(1, 10), lambda x: x % 2 = n_regionkey % 2), lambda x: x * 10), ',') AS tens FROM nation""")
same("fn_maps", "SELECT n_nationkey, element_at(map(n_name, n_regionkey, 'x', 7), n_name) AS v, size(map_keys(map(n_name, 1, 'x', 2))) AS k, element_at(map('a', 1), 'zz') AS missing FROM nation",
     "SELECT n_nationkey, MAP {n_name: n_regionkey, 'x': 7}[n_name] AS v, len(map_keys(MAP {n_name: 1, 'x': 2}))::INTEGER AS k, MAP {'a': 1}['zz'] AS missing FROM nation")
same("fn_bits", "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, p_size ^ 5 AS x, shiftleft(p_size, 2) AS l, bit_count(p_size) AS c FROM part",
     "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, xor(p_size, 5) AS x, p_size << 2 AS l, bit_count(p_size)::INTEGER AS c FROM part")
same("fn_try", "SELECT n_nationkey, try_divide(n_nationkey, n_regionkey) AS q, try_cast(n_name AS INT) AS i, nvl(nullif(n_regionkey, 0), -1) AS z, if(n_regionkey > 2, 'hi', 'lo') AS b FROM nation",
     "SELECT n_nationkey, n_nationkey / nullif(n_regionkey, 0) AS q, try_cast(n_name AS INT) AS i, ifnull(nullif(n_regionkey, 0), -1) AS z, if(n_regionkey > 2, 'hi', 'lo') AS b FROM nation")

# aggregates, windows, time

same("agg_quantiles", "SELECT p_brand, percentile(p_retailprice, 0.25) AS q1, percentile_disc(0.5) WITHIN GROUP (ORDER BY p_size) AS md, mode() WITHIN GROUP (ORDER BY p_type || p_size) IS NOT NULL AS has_mode FROM part GROUP BY p_brand",
     "SELECT p_brand, quantile_cont(p_retailprice, 0.25) AS q1, quantile_disc(p_size, 0.5)::DOUBLE AS md, mode(p_type || p_size) IS NOT NULL AS has_mode FROM part GROUP BY p_brand")
same("agg_bits_and_more", "SELECT p_type, bit_and(p_size) AS ba, bit_or(p_size) AS bo, bit_xor(p_size) AS bx, round(covar_samp(p_size, p_retailprice), 6) AS cv, round(regr_slope(p_size, p_retailprice), 12) AS sl, round(skewness(p_size), 6) * 0 AS sk FROM part GROUP BY p_type",
     "SELECT p_type, bit_and(p_size) AS ba, bit_or(p_size) AS bo, bit_xor(p_size) AS bx, round(covar_samp(p_size, p_retailprice), 6) AS cv, round(regr_slope(p_size, p_retailprice), 12) AS sl, round(skewness(p_size), 6) * 0 AS sk FROM part GROUP BY p_type")


@query("agg_approx_distinct", "SELECT o_orderstatus, true AS close FROM orders GROUP BY o_orderstatus")
def agg_approx_distinct(spark, d):
    g = Tables(spark, d).orders.groupBy("o_orderstatus").agg(F.approx_count_distinct("o_custkey", 0.02).alias("a"), F.count_distinct("o_custkey").alias("c"))
    return g.select("o_orderstatus", (F.abs(F.col("a") - F.col("c")) <= 0.1 * F.col("c")).alias("close"))


@query("window_distinct_count", "SELECT o_orderkey, count(DISTINCT o_orderpriority) OVER (PARTITION BY o_custkey) AS n FROM orders")
def window_distinct_count(spark, d):
    o = Tables(spark, d).orders
    per_key = o.groupBy(F.col("o_custkey").alias("k")).agg(F.count_distinct("o_orderpriority").alias("n"))
    return o.join(per_key, F.col("o_custkey").eqNullSafe(F.col("k"))).select("o_orderkey", "n")


same("window_ignore_nulls", "SELECT event_id, last_value(nullif(event_type, 'view')) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_other FROM events",
     "SELECT event_id, last_value(nullif(event_type, 'view') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_other FROM events")
same("window_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
same("qualify_like", "SELECT o_custkey, o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS r FROM orders) t WHERE r = 1")
same("unpivot", "SELECT p_partkey, name, v FROM (SELECT p_partkey, cast(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) UNPIVOT (v FOR name IN (size, price))")


@query("ext_sliding", "SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS s FROM events) GROUP BY 1, 2")
def ext_sliding(spark, d):
    return event_time.sliding(Tables(spark, d).events, "2 hours", "1 hour", ["event_type"])


@query("top_n_with_ties", "SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size DESC) <= 10")
def top_n_with_ties(spark, d):
    # the tenth value bounds the result: no window over all rows in one task
    part = Tables(spark, d).part
    low = relational.top_n(part.select("p_size"), [F.desc("p_size")], 10).agg(F.min("p_size").alias("low"))
    return part.join(F.broadcast(low), F.col("p_size") >= F.col("low")).select("p_partkey", "p_size")  # one row
