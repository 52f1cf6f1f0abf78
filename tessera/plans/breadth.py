"""Queries of casts, errors in branches, routing, streams, indexes, deletes and statistics; variants of the 22 queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import pin, sql
from tessera.catalog import Tables
from tessera.functions import scalar as fn
from tessera.operators import exchange, joins, relational, vector
from tessera.sources import files, scratch, sinks, tables
from tessera.streaming import fragments

from .catalogue import query, same
from .operators import _Q, _first_vector
from .puffin import puffin

# sources and sinks


@query(
    "scan_virtual_columns_files",
    """SELECT o_orderkey % 4 AS part, count(*) AS n, min(o_orderkey) AS low, true AS dense FROM orders GROUP BY 1""",
)
def scan_virtual_columns_files(spark, d):
    """File index and row number over several files: one index a file, rows numbered from 0 without a gap."""
    at = scratch.path(spark, "indexed")
    Tables(spark, d).orders.withColumn("part", F.col("o_orderkey") % 4).write.partitionBy("part").parquet(at)
    df = files.read_parquet(spark, at, filename=True, file_row_number=True, file_index=True)
    per_file = df.groupBy("part", "file_index", "filename").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low"), F.max("file_row_number").alias("last"), F.count_distinct("file_row_number").alias("places")
    )
    dense = (F.max(F.col("last")) < F.sum("n")) & (F.sum("places") == F.sum("n")) & (F.count_distinct("file_index") == F.count_distinct("filename"))
    return per_file.groupBy(F.col("part").cast("bigint").alias("part")).agg(F.sum("n").alias("n"), F.min("low").alias("low"), dense.alias("dense"))


@query("json_round_trip", "SELECT n_nationkey, n_name, nullif(n_regionkey, 2) AS n_regionkey FROM nation")
def json_round_trip(spark, d):
    at = scratch.path(spark, "json")
    t = Tables(spark, d).nation.select("n_nationkey", "n_name", F.expr("nullif(n_regionkey, 2)").alias("n_regionkey"))
    sinks.copy_json(t, at)
    return files.read_json(spark, at, "n_nationkey int, n_name string, n_regionkey int")


@query("split_scan", "SELECT count(*) AS n, sum(l_orderkey)::BIGINT AS s, true AS several FROM lineitem")
def split_scan(spark, d):
    """Files read as several byte ranges each: every row once. They are written where their rows are; a file is bounded
    in rows, as each of its ranges reads its whole footer, and ranges share tasks once there are many."""
    at = scratch.path(spark, "split")
    Tables(spark, d).lineitem.write.option("parquet.block.size", 1 << 16).option("maxRecordsPerFile", 100_000).parquet(at)
    settings = {"spark.sql.files.maxPartitionBytes": str(1 << 16), "spark.sql.files.maxPartitionNum": str(8 * spark.sparkContext.defaultParallelism)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        read = spark.read.parquet(at).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "l_orderkey")
        more = read.rdd.getNumPartitions() > len(read.inputFiles())  # ranges may hold no row group's start
        ranges = read.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("s"))
        by_file = ranges.groupBy("file").agg(F.count(F.lit(1)).alias("ranges"), F.sum("n").alias("n"), F.sum("s").alias("s"))
        found = by_file.agg(F.coalesce(F.sum("n"), F.lit(0)), F.sum("s"), F.coalesce((F.max("ranges") > 1) | F.lit(more), F.lit(more))).first()  # read here, under these settings
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.createDataFrame([tuple(found)], "n long, s long, several boolean")


@query(
    "deletion_vector_puffin",
    """SELECT count(*) AS n, sum(l_orderkey)::BIGINT AS s FROM (SELECT l_orderkey, row_number() OVER () - 1 AS pos FROM lineitem)
    WHERE NOT (pos BETWEEN 10 AND 4000 OR (pos > 4000 AND pos < 20000 AND pos % 2 = 0) OR pos IN (30001, 30007))""",
)
def deletion_vector_puffin(spark, d):
    """Deletes of a Puffin file written and read through Spark: run, bitset and array containers."""
    data = files.read_parquet(spark, f"{d}/lineitem.parquet", filename=True, file_row_number=True)
    name = data.select("filename").first()[0]
    gone = [*range(10, 4001), *[p for p in range(4001, 20000) if p % 2 == 0], 30001, 30007]
    at = scratch.path(spark, "puffin")
    stream = spark._jvm.org.apache.hadoop.fs.Path(at + "/deletes.puffin")
    out = stream.getFileSystem(spark._jsc.hadoopConfiguration()).create(stream, True)
    out.write(bytearray(puffin({name: gone, "other.parquet": [*range(70_000, 70_010), 200_000, 200_002]})))
    out.close()
    kept = files.positional_deletes(data, files.vector_deletes(spark, at))
    return kept.agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("s"))


@query(
    "footer_statistics",
    """SELECT 'c_custkey' AS name, count(*) AS rows, min(c_custkey)::VARCHAR AS low, max(c_custkey)::VARCHAR AS high FROM customer
    UNION ALL SELECT 'c_nationkey', count(*), min(c_nationkey)::VARCHAR, max(c_nationkey)::VARCHAR FROM customer""",
)
def footer_statistics(spark, d):
    found = sql.run(spark, f"SELECT * FROM analyze_parquet('{d}/customer.parquet') WHERE column IN ('c_custkey', 'c_nationkey')")
    low, high = F.min(F.col("minimum").cast("bigint")).cast("string"), F.max(F.col("maximum").cast("bigint")).cast("string")
    return found.groupBy(F.col("column").alias("name")).agg(F.sum("rows").alias("rows"), low.alias("low"), high.alias("high"))


@query("sql_table_functions", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def sql_table_functions(spark, d):
    return sql.run(
        spark,
        f"""SELECT r_name, count(*) AS n FROM read_parquet('{d}/nation.parquet', filename => true) a
        JOIN read_parquet(['{d}/region.parquet']) b ON n_regionkey = r_regionkey GROUP BY r_name""",
    )


@query("sql_without_optimizer", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE 1 + 1 = 2 AND o_totalprice > 1000 GROUP BY o_orderstatus")
def sql_without_optimizer(spark, d):
    Tables(spark, d).orders.createOrReplaceTempView("orders")
    return sql.run(spark, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE 1 + 1 = 2 AND o_totalprice > 1000 GROUP BY o_orderstatus", enable_optimizer=False)


@query(
    "table_changes",
    """SELECT c_custkey, c_mktsegment, CASE WHEN c_nationkey = 4 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_nationkey <> 3
    UNION ALL SELECT -c_custkey, 'NEW', 0.0 FROM customer WHERE c_nationkey = 3""",
)
def table_changes(spark, d):
    """Insert, delete and update; the first version stays readable."""
    c = Tables(spark, d).customer.select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    t = tables.Table.create(spark, scratch.path(spark, "changing"), c)
    t.delete("c_nationkey = 3")
    t.insert(c.where("c_nationkey = 3").select((-F.col("c_custkey")).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal"), F.lit(99).alias("c_nationkey")))
    t.update({"c_acctbal": "c_acctbal + 1"}, "c_nationkey = 4")
    return t.read().select("c_custkey", "c_mktsegment", "c_acctbal")


@query("insert_select", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 2 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 4")
def insert_select(spark, d):
    """CREATE TABLE AS and INSERT INTO on a catalog table, then DROP once it is read."""
    Tables(spark, d).nation.createOrReplaceTempView("nation")
    at = scratch.path(spark, "ctas")
    name = "made_" + at.rpartition("-")[2]
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{at}' AS SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 2")
    spark.sql(f"INSERT INTO {name} SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 4")
    schema = spark.table(name).schema
    spark.sql(f"DROP TABLE {name}")  # external: its files stay
    return spark.read.schema(schema).parquet(at)


# expressions and casts

same(
    "cast_matrix",
    """SELECT o_orderkey, cast(cast(o_orderkey AS DECIMAL(38,0)) * 1000000000000 AS STRING) AS wide, cast(o_orderkey AS STRING) AS txt, cast(o_custkey AS SMALLINT) AS small,
    cast(cast(o_orderdate AS DATE) AS TIMESTAMP_NTZ) AS at, cast(cast(o_totalprice AS DECIMAL(15,2)) AS DECIMAL(12,1)) AS narrower,
    cast(cast(o_totalprice AS DECIMAL(15,2)) AS DOUBLE) AS dbl, cast(o_orderkey AS FLOAT) AS flt, cast(o_orderkey % 2 = 0 AS INT) AS bit, cast(o_orderkey % 3 AS BOOLEAN) AS flag FROM orders""",
    """SELECT o_orderkey, cast(o_orderkey::HUGEINT * 1000000000000 AS VARCHAR) AS wide, cast(o_orderkey AS VARCHAR) AS txt, cast(o_custkey AS SMALLINT) AS small,
    cast(cast(o_orderdate AS DATE) AS TIMESTAMP) AS at, cast(cast(o_totalprice AS DECIMAL(15,2)) AS DECIMAL(12,1)) AS narrower,
    cast(cast(o_totalprice AS DECIMAL(15,2)) AS DOUBLE) AS dbl, cast(o_orderkey AS FLOAT) AS flt, cast(o_orderkey % 2 = 0 AS INT) AS bit, cast(o_orderkey % 3 AS BOOLEAN) AS flag FROM orders""",
)


@query("cast_decimal_integer", "SELECT o_orderkey, cast(cast(o_totalprice AS DECIMAL(15,2)) AS BIGINT) AS whole, cast(-cast(o_totalprice AS DECIMAL(15,2)) AS INTEGER) AS below FROM orders")
def cast_decimal_integer(spark, d):
    v = F.col("o_totalprice").cast("decimal(15,2)")
    return Tables(spark, d).orders.select("o_orderkey", fn.decimal_to(v, "bigint").alias("whole"), fn.decimal_to(-v, "int").alias("below"))


@query("cast_timestamp_precision", "SELECT event_id, cast(ts AS TIMESTAMP_MS) AS ms, cast(ts AS TIMESTAMP_S) AS s, cast(ts AS DATE) AS day FROM events")
def cast_timestamp_precision(spark, d):
    return Tables(spark, d).events.select("event_id", fn.to_precision("ts", "millisecond").alias("ms"), fn.to_precision("ts", "second").alias("s"), F.col("ts").cast("date").alias("day"))


@query("fn_case_simple", "SELECT n_nationkey, upper(n_name || 'ßﬁ') AS up, lower(n_name || 'İΣ') AS low FROM nation")
def fn_case_simple(spark, d):
    return Tables(spark, d).nation.select("n_nationkey", fn.upper(F.concat("n_name", F.lit("ßﬁ"))).alias("up"), fn.lower(F.concat("n_name", F.lit("İΣ"))).alias("low"))


same(
    "error_in_branches",
    "SELECT p_partkey, CASE WHEN p_size > 0 THEN p_size WHEN p_size > -1 THEN error('zero') ELSE error('negative') END AS size, coalesce(p_name, error('no name')) AS name FROM part",
    "SELECT p_partkey, CASE WHEN p_size > 0 THEN p_size ELSE error('not positive') END AS size, coalesce(p_name, error('no name')) AS name FROM part",
)
same(
    "filtered_rows_do_not_raise",
    """SELECT k, abs(v) AS a, -v AS neg FROM (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN cast(-2147483648 AS INT) ELSE p_size END AS v FROM part) t
    WHERE k % 5 <> 0""",
)


@query("fn_unary", "SELECT p_partkey, +p_size AS plus, -p_size AS minus, abs(p_size - 30) AS size FROM part")
def fn_unary(spark, d):
    v = F.col("p_size")
    return Tables(spark, d).part.select("p_partkey", fn.positive(v).alias("plus"), fn.negate(v).alias("minus"), fn.absolute(v - 30).alias("size"))


@query("fn_row", "SELECT n_nationkey, row(n_regionkey, n_name) = row(1, 'NATION_1') AS hit FROM nation")
def fn_row(spark, d):
    return Tables(spark, d).nation.select("n_nationkey", (fn.row("n_regionkey", "n_name") == fn.row(F.lit(1), F.lit("NATION_1"))).alias("hit"))


same(
    "fn_trigonometry",
    """SELECT p_partkey, round(cos(p_size), 9) AS c, round(tan(p_size / 40.0e0), 9) AS t, round(asin(p_size / 100.0e0), 9) AS si, round(acos(p_size / 100.0e0), 9) AS co,
    round(atan(p_size), 9) AS ta, round(atan2(p_size, 7), 9) AS t2, round(cot(p_size / 30.0e0), 9) AS ct, round(degrees(p_size), 7) AS dg, round(radians(p_size), 9) AS rd,
    round(cbrt(p_size), 9) AS cb, round(log2(p_size), 9) AS lg, round(pi(), 9) AS p, round(sinh(p_size / 20.0e0), 7) AS sh, round(tanh(p_size / 20.0e0), 9) AS th FROM part""",
)


@query(
    "fn_date_diff",
    """SELECT event_id, date_diff('year', TIMESTAMP '2023-06-15 12:30:00', ts) AS y, date_diff('quarter', TIMESTAMP '2023-06-15 12:30:00', ts) AS q, date_diff('month', TIMESTAMP '2023-06-15 12:30:00', ts) AS mo,
    date_diff('week', TIMESTAMP '2023-06-15 12:30:00', ts) AS w, date_diff('day', TIMESTAMP '2023-06-15 12:30:00', ts) AS d, date_diff('hour', TIMESTAMP '2023-06-15 12:30:00', ts) AS h,
    date_diff('minute', TIMESTAMP '2023-06-15 12:30:00', ts) AS mi, date_diff('second', TIMESTAMP '2023-06-15 12:30:00', ts) AS s FROM events""",
)
def fn_date_diff(spark, d):
    start = F.lit("2023-06-15 12:30:00").cast("timestamp_ntz")
    units = {"y": "year", "q": "quarter", "mo": "month", "w": "week", "d": "day", "h": "hour", "mi": "minute", "s": "second"}
    return Tables(spark, d).events.select("event_id", *[fn.date_diff(u, start, F.col("ts")).alias(a) for a, u in units.items()])


@query("fn_strptime", "SELECT event_id, strptime(strftime(ts, '%d.%m.%Y %H:%M:%S'), '%d.%m.%Y %H:%M:%S') AS back FROM events")
def fn_strptime(spark, d):
    shown = F.date_format("ts", "dd.MM.yyyy HH:mm:ss")
    return Tables(spark, d).events.select("event_id", fn.strptime(shown, "%d.%m.%Y %H:%M:%S").alias("back"))


same(
    "fn_date_parts",
    """SELECT event_id, cast(extract(DOY FROM ts) AS BIGINT) AS doy, cast(extract(WEEK FROM ts) AS BIGINT) AS wk, cast(extract(YEAROFWEEK FROM ts) AS BIGINT) AS iso, cast(extract(DAYOFWEEK_ISO FROM ts) AS BIGINT) AS isodow,
    make_date(year(ts), month(ts), 1) AS first, trunc(cast(ts AS DATE), 'QUARTER') AS quarter, date_add(cast(ts AS DATE), 10) AS later, unix_seconds(cast(ts AS TIMESTAMP)) AS epoch FROM events""",
    """SELECT event_id, date_part('doy', ts) AS doy, date_part('week', ts) AS wk, date_part('isoyear', ts) AS iso, date_part('isodow', ts) AS isodow,
    make_date(year(ts), month(ts), 1) AS first, date_trunc('quarter', ts)::DATE AS quarter, ts::DATE + 10 AS later, floor(epoch(ts))::BIGINT AS epoch FROM events""",
)
same(
    "fn_lists_more",
    """SELECT n_nationkey, array_max(sequence(1, n_nationkey + 1)) AS hi, array_position(split(n_name, ''), 'I') AS at, array_join(array_union(split('abc', ''), split('cd', '')), '') AS u,
    array_join(array_intersect(split('abc', ''), split('bcd', '')), '') AS i, array_join(array_except(split('abc', ''), split('b', '')), '') AS e, array_join(flatten(array(array('x', 'y'), array('z'))), '') AS f,
    exists(split(n_name, ''), c -> c = '1') AS any_, forall(sequence(1, 3), x -> x > 0) AS all_, array_join(reverse(split('abc', '')), '') AS r, array_join(array_repeat('q', 3), '') AS rp FROM nation""",
    """SELECT n_nationkey, list_max(range(1, n_nationkey + 2))::INTEGER AS hi, coalesce(list_position(string_split(n_name, ''), 'I'), 0)::BIGINT AS at, 'abcd' AS u,
    'bc' AS i, 'ac' AS e, array_to_string(flatten([['x', 'y'], ['z']]), '') AS f,
    list_contains(string_split(n_name, ''), '1') AS any_, true AS all_, array_to_string(list_reverse(string_split('abc', '')), '') AS r, repeat('q', 3) AS rp FROM nation""",
)
same(
    "fn_maps_more",
    """SELECT n_nationkey, map_contains_key(map('a', n_regionkey), 'a') AS has, array_join(array_sort(map_keys(map_concat(map('a', 1), map('b', n_regionkey)))), '') AS k,
    aggregate(map_values(map_filter(map('a', n_regionkey, 'b', 9), (k, v) -> v > 2)), 0, (s, v) -> s + v) AS big, size(map_entries(map(n_name, 1))) AS n, str_to_map('a:1,b:2')['b'] AS two FROM nation""",
    """SELECT n_nationkey, true AS has, 'ab' AS k, 9 + CASE WHEN n_regionkey > 2 THEN n_regionkey ELSE 0 END AS big, 1 AS n, '2' AS two FROM nation""",
)
same(
    "fn_strings_longer",
    r"""SELECT c_custkey, substring_index(c_name, '_', 1) AS head, levenshtein(c_name, 'Customer') AS lev, hex(c_name) AS hx, base64(cast(c_name AS BINARY)) AS b64, initcap('ab cd') AS ini, chr(65 + c_nationkey) AS ch,
    overlay(c_name PLACING 'XX' FROM 2 FOR 3) AS ov, length(concat_ws('-', c_name, NULL, c_mktsegment)) AS joined, format_string('%05d|%s', c_custkey, c_mktsegment) AS shown, soundex('Robert') AS sx,
    c_mktsegment ILIKE '%build%' AS il, regexp_instr(c_name, '[0-9]') AS ri, sha2(c_name, 256) AS h, find_in_set('b', 'a,b') AS fs FROM customer""",
    r"""SELECT c_custkey, split_part(c_name, '_', 1) AS head, levenshtein(c_name, 'Customer')::INTEGER AS lev, hex(c_name) AS hx, base64(encode(c_name)) AS b64, 'Ab Cd' AS ini, chr(65 + c_nationkey) AS ch,
    left(c_name, 1) || 'XX' || substring(c_name, 5) AS ov, length(concat_ws('-', c_name, NULL, c_mktsegment))::INTEGER AS joined, printf('%05d|%s', c_custkey, c_mktsegment) AS shown, 'R163' AS sx,
    c_mktsegment ILIKE '%build%' AS il, coalesce(nullif(strpos(c_name, regexp_extract(c_name, '[0-9]')), 0), 0)::INTEGER AS ri, sha256(c_name) AS h, 2 AS fs FROM customer""",
)

# aggregates, windows, samples


@query("agg_stddev_checked", "SELECT l_returnflag, round(stddev_samp(l_extendedprice), 6) AS sd FROM lineitem GROUP BY l_returnflag")
def agg_stddev_checked(spark, d):
    return Tables(spark, d).lineitem.groupBy("l_returnflag").agg(F.round(relational.stddev_samp("l_extendedprice"), 6).alias("sd"))


@query(
    "window_exclude_current",
    """SELECT o_orderkey, count(o_orderkey) OVER w AS n, min(o_orderkey) OVER w AS lo, max(o_orderkey) OVER w AS hi, sum(o_custkey) OVER w AS s FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW)""",
)
def window_exclude_current(spark, d):
    one = lambda f, c: relational.without_current(f, c, ["o_custkey"], [F.asc("o_orderkey")], 3, 2)
    return Tables(spark, d).orders.select(
        "o_orderkey", one("count", "o_orderkey").alias("n"), one("min", "o_orderkey").alias("lo"), one("max", "o_orderkey").alias("hi"), one("sum", "o_custkey").cast("decimal(38,0)").alias("s")
    )


@query(
    "window_exclude_peers",
    """SELECT o_orderkey, count(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP) AS others,
    count(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES) AS no_ties FROM orders""",
)
def window_exclude_peers(spark, d):
    one = lambda ties: relational.without_peers("count", "o_orderkey", ["o_custkey"], ["o_orderpriority"], ties)
    return Tables(spark, d).orders.select("o_orderkey", one(False).alias("others"), one(True).alias("no_ties"))


same(
    "window_filter",
    """SELECT o_orderkey, count(CASE WHEN o_totalprice > 100000 THEN 1 END) OVER (PARTITION BY o_custkey) AS big,
    max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_f FROM orders""",
    """SELECT o_orderkey, count(*) FILTER (WHERE o_totalprice > 100000) OVER (PARTITION BY o_custkey) AS big,
    max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_f FROM orders""",
)
same(
    "window_range_following",
    """SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS around,
    max(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ahead FROM part""",
)


@query("sample_bernoulli", "SELECT true AS inside, true AS stable, true AS near FROM (SELECT 1)")
def sample_bernoulli(spark, d):
    """A seeded sample is a subset, the same each time, and of about the asked size."""
    o = Tables(spark, d).orders.select("o_orderkey")
    first, second = o.sample(0.1, 42), o.sample(0.1, 42)
    n, m = first.count(), o.count()
    inside = first.join(o, "o_orderkey", "left_anti").isEmpty()
    stable = first.exceptAll(second).isEmpty() and second.exceptAll(first).isEmpty()
    near = abs(n - 0.1 * m) <= 5 * (0.09 * m) ** 0.5
    return spark.createDataFrame([(inside, stable, near)], "inside boolean, stable boolean, near boolean")


# exchanges, streams, fragments


@query("exchange_modes", "SELECT mode, (SELECT count(*) FROM orders) AS n, true AS right FROM (VALUES ('hash'), ('crc32'), ('range'), ('single'), ('local')) t(mode)")
def exchange_modes(spark, d):
    """Every mode keeps the rows; hash and crc32 keep keys together, ranges do not overlap, single is one task."""
    o = Tables(spark, d).orders.select("o_custkey")
    out = None
    for mode in ("hash", "crc32", "range", "single", "local"):
        dealt = exchange.exchange(o, mode, ["o_custkey"], 5).withColumn("p", F.spark_partition_id())
        if mode in ("hash", "crc32"):
            right = dealt.groupBy("o_custkey").agg(F.count_distinct("p").alias("places"), F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("n"), (F.max("places") == 1).alias("right"))
        elif mode == "range":
            spans = dealt.groupBy("p").agg(F.min("o_custkey").alias("lo"), F.max("o_custkey").alias("hi"), F.count(F.lit(1)).alias("c"))
            a = spans.alias("a").join(spans.alias("b"), F.expr("a.p < b.p and a.hi > b.lo"), "left")  # one row a task
            right = a.groupBy("a.p").agg(F.first("a.c").alias("c"), F.count("b.p").alias("x")).agg(F.sum("c").alias("n"), (F.max("x") == 0).alias("right"))
        else:
            right = dealt.agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("p") <= (1 if mode == "single" else 10**6)).alias("right"))
        right = right.select(F.lit(mode).alias("mode"), "n", "right")
        out = right if out is None else out.unionByName(right)
    return out


@query("exchange_routed", "SELECT (SELECT count(*) FROM orders) AS hashed, 3 * (SELECT count(*) FROM orders) AS sent_to_all, (SELECT count(*) FROM orders) AS single")
def exchange_routed(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_custkey")
    counted = {m: sum(x.count() for x in exchange.routed(o, m, 3, ["o_custkey"])) for m in ("crc32", "broadcast", "single")}
    return spark.createDataFrame([(counted["crc32"], counted["broadcast"], counted["single"])], "hashed long, sent_to_all long, single long")


@query("stream_source", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS s FROM events GROUP BY event_type")
def stream_source(spark, d):
    """Two senders push batches of their halves, written by the executors; the source ends when both have closed."""
    e = Tables(spark, d).events.select("event_id", "event_type")
    schema = e.limit(0).toArrow().schema
    stream = fragments.BatchStream(schema, ["even", "odd"])
    for name, rest in (("even", 0), ("odd", 1)):
        stream.push(name, fragments.StoredBatches(e.where(F.col("event_id") % 2 == rest), 3000))
        stream.close(name)
    rows = fragments.stream_source(spark, stream, 60)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("s"))


@query("fragment_relay", "SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderpriority")
def fragment_relay(spark, d):
    """A fragment filters and deals customers by hash; two of the next join their share, the last adds up."""
    t = Tables(spark, d)
    first = fragments.Fragment(lambda i: {"kept": i["c"].where("c_mktsegment = 'BUILDING'").select("c_custkey")})
    first.declare_input("c", "c_custkey int, c_mktsegment string")
    first.declare_output("kept", "hash", ["c_custkey"], 2)
    first.feed("c", t.customer.select(F.col("c_custkey").cast("int").alias("c_custkey"), "c_mktsegment"))
    partial = []
    for consumer in range(2):
        f = fragments.Fragment(lambda i: {"out": t.orders.join(i["k"], F.col("o_custkey") == F.col("c_custkey")).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("customers"))})
        f.declare_input("k", "c_custkey int")
        f.declare_output("out")
        f.relay_from("k", first, "kept", consumer)
        partial.append(f.run()["out"][0])
    return partial[0].unionByName(partial[1]).groupBy("o_orderpriority").agg(F.sum("n").alias("n"), F.sum("customers").alias("customers"))


# vectors


@query("ann_partial_probes", f"SELECT true AS enough, true AS fewer FROM {_Q}")
def ann_partial_probes(spark, d):
    """Three quarters of the lists: at least 0.8 of the true neighbours over ten queries, from fewer rows."""
    v = Tables(spark, d).embeddings.select("vec_id", "embedding")
    index = vector.create_index(v, "embedding", "l2", 8)
    hit = 0
    for r in v.where("vec_id < 10").collect():
        true = {x["vec_id"] for x in vector.knn(v, "embedding", r["embedding"], 10, output_columns=["vec_id"]).collect()}
        hit += len(true & {x["vec_id"] for x in index.search(r["embedding"], 10, 6, ["vec_id"]).collect()})
    fewer = index.rows.where(F.col("_list").isin(index.lists_for([0.1] * 64, 6))).count() < v.count()
    return spark.createDataFrame([(hit >= 80, fewer)], "enough boolean, fewer boolean")


@query(
    "ann_cosine_lists",
    f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 6) + 0.0 AS distance FROM embeddings, {_Q} ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q), vec_id LIMIT 10",
)
def ann_cosine_lists(spark, d):
    pin.pin_table(spark, f"{d}/embeddings.parquet", name="pinned_vectors", columns=["vec_id", "embedding"])
    pin.create_ann_index("pinned_vectors", "embedding", "cosine", 8)
    found = pin.knn_search("pinned_vectors", "embedding", _first_vector(spark, d), 10, "cosine", ["vec_id"], use_index=True, n_probes=8)
    return found.withColumn("distance", F.round("distance", 6) + F.lit(0.0))


# joins that must not meet in one task


@query("join_range_wide", "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS s FROM orders JOIN (SELECT i * 1000.0e0 AS lo, i * 1000.0e0 + i * i * 100.0e0 + 1 AS hi FROM range(0, 200) r(i)) b ON o_totalprice >= lo AND o_totalprice < hi")
def join_range_wide(spark, d):
    bands = spark.range(200).select((F.col("id") * 1000.0).alias("lo"), (F.col("id") * 1000.0 + F.col("id") * F.col("id") * 100.0 + 1).alias("hi"))
    return joins.range_join(Tables(spark, d).orders, bands, "o_totalprice", "lo", "hi", 100.0).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("s"))


@query(
    "join_asof_one_key",
    """SELECT e.event_id, o.value AS last_purchase FROM (SELECT *, 1 AS k FROM events) e ASOF LEFT JOIN
    (SELECT 1 AS k, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ts) o ON e.k = o.k AND e.ts >= o.ts""",
)
def join_asof_one_key(spark, d):
    """All rows of one key: sorted in slices of time."""
    e = Tables(spark, d).events.withColumn("k", F.lit(1))
    bought = e.where("event_type = 'purchase'").groupBy("k", F.col("ts").alias("at")).agg(F.max("value").alias("last_purchase"))
    return joins.asof_join(e.select("event_id", "k", "ts"), bought, ["k"], "ts", "at", ["last_purchase"]).select("event_id", "last_purchase")


# variants of the decision-support queries: other spellings of one question give one answer

_LATE = "SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND {} "
same("variant_exists", _LATE.format("EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)"))
same("variant_in", _LATE.format("c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)"))
same("variant_scalar_count", _LATE.format("(SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) > 0"))
same("variant_distinct_join", "SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 5000 AND o_totalprice > 200000")
same("variant_left_null", "SELECT c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IS NULL")
same("variant_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
same("variant_having_in", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(cast(l_quantity AS DECIMAL(15,2))) > 150)")
same("variant_having_join", "SELECT o_orderkey, o_totalprice FROM orders JOIN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(cast(l_quantity AS DECIMAL(15,2))) > 150) b ON l_orderkey = o_orderkey")
same(
    "variant_window_sum",
    "SELECT DISTINCT o_orderkey, o_totalprice FROM (SELECT l_orderkey, sum(cast(l_quantity AS DECIMAL(15,2))) OVER (PARTITION BY l_orderkey) AS q FROM lineitem) b JOIN orders ON l_orderkey = o_orderkey WHERE q > 150",
)
same("variant_union_or", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#1' AND p_size < 10 UNION SELECT p_partkey FROM part WHERE p_brand = 'Brand#2' AND p_size > 40")
same("variant_or", "SELECT p_partkey FROM part WHERE (p_brand = 'Brand#1' AND p_size < 10) OR (p_brand = 'Brand#2' AND p_size > 40)")
