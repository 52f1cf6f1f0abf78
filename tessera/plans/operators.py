"""One query for each operator and function family, with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import Tables
from tessera.functions import scalar as fn
from tessera.operators import joins, relational, vector
from tessera.sources import files
from tessera.streaming import windows as event_time

from .catalogue import query, same

# scans and sources


@query("scan_projection", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'O'")
def scan_projection(spark, d):
    return Tables(spark, d).orders.where("o_totalprice > 1000 and o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")


@query("scan_virtual_columns", "SELECT s_suppkey, 'supplier.parquet' AS file, 0::BIGINT AS file_index, row_number() OVER (ORDER BY s_suppkey) - 1 AS file_row_number FROM supplier")
def scan_virtual_columns(spark, d):
    df = files.read_parquet(spark, f"{d}/supplier.parquet", filename=True, file_row_number=True, file_index=True)
    return df.select("s_suppkey", F.regexp_extract("filename", r"(supplier\.parquet)", 1).alias("file"), "file_index", "file_row_number")


same("values_rows", "SELECT a, b FROM (VALUES (1, 'x'), (2, NULL), (3, 'z')) AS t(a, b)")
same("dummy_scan", "SELECT 1 + 2 AS three, 'a' AS letter")
same("empty_result", "SELECT o_orderkey FROM orders WHERE 1 = 0")


@query("positional_deletes", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS pos FROM supplier) WHERE pos % 7 = 0)")
def positional_deletes(spark, d):
    data = files.read_parquet(spark, f"{d}/supplier.parquet", filename=True, file_row_number=True)
    gone = data.where("file_row_number % 7 = 0").select(F.col("filename").alias("file_path"), F.col("file_row_number").alias("pos"))
    return files.positional_deletes(data, gone).select("s_suppkey", "s_name")


@query("equality_deletes", "SELECT c_custkey, c_nationkey FROM customer WHERE NOT (c_nationkey = 3 AND c_mktsegment = 'BUILDING') AND c_nationkey <> 5")
def equality_deletes(spark, d):
    c = Tables(spark, d).customer
    gone = spark.createDataFrame([(3, "BUILDING")], "c_nationkey int, c_mktsegment string")
    kept = files.equality_deletes(c, gone, ["c_nationkey", "c_mktsegment"])
    return files.equality_deletes(kept.withColumn("seq", F.lit(1)), spark.createDataFrame([(5, 2), (6, 1)], "c_nationkey int, s int"), ["c_nationkey"], ("seq", "s")).select("c_custkey", "c_nationkey")


# predicates and expressions

same("kleene_logic", """SELECT a, b, a AND b AS both_, a OR b AS either_, NOT a AS not_a, a IS NULL AS a_null, b IS NOT NULL AS b_there FROM
(VALUES (true), (false), (CAST(NULL AS BOOLEAN))) AS x(a) CROSS JOIN (VALUES (true), (false), (CAST(NULL AS BOOLEAN))) AS y(b)""")
same("comparison_null_safe", """SELECT l.id AS lid, r.id AS rid, l.k IS DISTINCT FROM r.k AS dist, l.k IS NOT DISTINCT FROM r.k AS same_, l.k = r.k AS eq, l.k <= r.k AS le
FROM (VALUES (7, 3), (8, NULL), (9, 5)) AS l(id, k) CROSS JOIN (VALUES (4, NULL), (5, 3)) AS r(id, k)""")
same("between_in", "SELECT p_partkey, p_size BETWEEN 5 AND 10 AS mid, p_size IN (1, 2, NULL) AS in_null, p_size NOT IN (1, 2) AS not_in FROM part")
same("case_coalesce", """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
coalesce(nullif(o_orderstatus, 'F'), 'none') AS status FROM orders""")
same("guarded_division", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_quantity / nullif(l_linenumber % 3, 0) END AS q FROM lineitem")
same("casts", """SELECT p_partkey, cast(p_size AS BIGINT) AS big, cast(p_size AS DOUBLE) AS dbl, cast(p_size AS DECIMAL(9,2)) AS dec_, cast(p_partkey AS VARCHAR(20)) AS txt FROM part""", "SELECT p_partkey, cast(p_size AS BIGINT) AS big, cast(p_size AS DOUBLE) AS dbl, cast(p_size AS DECIMAL(9,2)) AS dec_, cast(p_partkey AS VARCHAR) AS txt FROM part")


@query("cast_rounding", "SELECT l_orderkey, l_linenumber, cast(l_quantity / 2 AS INTEGER) AS half_even, cast(cast(l_extendedprice AS DECIMAL(15,2)) AS INTEGER) AS half_away, try_cast(l_returnflag AS INTEGER) AS bad FROM lineitem")
def cast_rounding(spark, d):
    li = Tables(spark, d).lineitem
    return li.select("l_orderkey", "l_linenumber", fn.to_int(F.col("l_quantity") / 2).alias("half_even"), fn.decimal_to_int(F.col("l_extendedprice").cast("decimal(15,2)")).alias("half_away"), F.col("l_returnflag").try_cast("int").alias("bad"))


@query("constant_or_null", "SELECT o_orderkey, CASE WHEN nullif(o_orderstatus, 'F') IS NOT NULL THEN 7 END AS seven FROM orders")
def constant_or_null(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", fn.constant_or_null(7, F.expr("nullif(o_orderstatus, 'F')")).alias("seven"))


# scalar functions


@query("fn_arithmetic", """SELECT o_orderkey, o_orderkey + 1 AS plus, o_orderkey - 5 AS minus, o_orderkey * 3 AS times, o_orderkey / 4 AS quotient, o_orderkey // 4 AS int_quotient,
o_orderkey % 7 AS rest, -o_orderkey AS neg, abs(o_orderkey - 100) AS absolute, round(o_totalprice / 7, 1) AS rounded FROM orders""")
def fn_arithmetic(spark, d):
    k = F.col("o_orderkey")
    return Tables(spark, d).orders.select(k, (k + 1).alias("plus"), (k - 5).alias("minus"), (k * 3).alias("times"), fn.divide(k, F.lit(4)).alias("quotient"), fn.int_divide(k, F.lit(4)).alias("int_quotient"), fn.modulus(k, F.lit(7)).alias("rest"), (-k).alias("neg"), F.abs(k - 100).alias("absolute"), fn.round_half_up(F.col("o_totalprice") / 7, 1).alias("rounded"))


@query("fn_divide_zero", "SELECT * FROM (SELECT p_partkey, cast(p_size % 3 AS DOUBLE) / cast(0 AS DOUBLE) > 1 AS infinite, isnan(cast(p_size % 3 AS DOUBLE) / cast(0 AS DOUBLE)) AS nan FROM part)")
def fn_divide_zero(spark, d):
    q = fn.divide(F.col("p_size") % 3, F.lit(0))
    return Tables(spark, d).part.select("p_partkey", (q > 1).alias("infinite"), F.isnan(q).alias("nan"))


@query("fn_strings", """SELECT c_custkey, substring(c_name, 3, 4) AS mid, substring(c_name, -3, 2) AS tail, substring(c_name, 0, 4) AS zero, upper(c_mktsegment) AS up, lower(c_name) AS low,
strlen(c_name) AS bytes, length(c_name) AS chars, concat(nullif(c_mktsegment, 'BUILDING'), '-', c_name) AS joined, nullif(c_mktsegment, 'BUILDING') || '-' AS piped,
contains(c_name, '12') AS has, starts_with(c_name, 'Cust') AS pre, ends_with(c_name, '7') AS suf, c_name LIKE '%0_1' AS lk, c_name NOT LIKE 'C%' AS nlk FROM customer""")
def fn_strings(spark, d):
    seg = F.expr("nullif(c_mktsegment, 'BUILDING')")
    return Tables(spark, d).customer.select("c_custkey", fn.substring("c_name", 3, 4).alias("mid"), fn.substring("c_name", -3, 2).alias("tail"), fn.substring("c_name", 0, 4).alias("zero"), F.upper("c_mktsegment").alias("up"), F.lower("c_name").alias("low"), fn.strlen("c_name").alias("bytes"), fn.length("c_name").alias("chars"), fn.concat(seg, F.lit("-"), F.col("c_name")).alias("joined"), fn.concat_op(seg, F.lit("-")).alias("piped"), fn.contains("c_name", "12").alias("has"), fn.prefix("c_name", "Cust").alias("pre"), fn.suffix("c_name", "7").alias("suf"), fn.like("c_name", "%0_1").alias("lk"), (~fn.like("c_name", "C%")).alias("nlk"))


@query("fn_unicode", "SELECT doc_id, strlen(text) AS bytes, length(text) AS chars, substring(text, 2, 9) AS part, upper(substring(lang, 1, 1)) AS l FROM documents")
def fn_unicode(spark, d):
    return Tables(spark, d).documents.select("doc_id", fn.strlen("text").alias("bytes"), fn.length("text").alias("chars"), fn.substring("text", 2, 9).alias("part"), F.upper(fn.substring("lang", 1, 1)).alias("l"))


@query("fn_regexp_replace", r"SELECT page_id, regexp_replace(url, '^[a-z]+://(?:blog\.|m\.)?([^/]+)(/.*)$', '\1') AS host, regexp_replace(url, '[aeiou]', '*') AS first_vowel FROM pages")
def fn_regexp_replace(spark, d):
    return Tables(spark, d).pages.select("page_id", fn.regexp_replace_first("url", r"^[a-z]+://(?:blog\.|m\.)?([^/]+)(/.*)$", r"\1").alias("host"), fn.regexp_replace_first("url", "[aeiou]", "*").alias("first_vowel"))


@query("fn_dates", """SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS dd, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, millisecond(ts) AS ms, microsecond(ts) AS us,
date_trunc('day', ts) AS t_day, date_trunc('hour', ts) AS t_hour, date_trunc('month', ts) AS t_month, date_trunc('week', ts) AS t_week, date_trunc('quarter', ts) AS t_quarter, quarter(ts) AS q FROM events""")
def fn_dates(spark, d):
    parts = [fn.date_part(u, "ts").alias(a) for u, a in (("year", "y"), ("month", "mo"), ("day", "dd"), ("hour", "h"), ("minute", "mi"), ("second", "s"), ("millisecond", "ms"), ("microsecond", "us"), ("quarter", "q"))]
    return Tables(spark, d).events.select("event_id", *parts, *[fn.date_trunc(u, "ts").alias(f"t_{u}") for u in ("day", "hour", "month", "week", "quarter")])


@query("fn_date_arithmetic", "SELECT o_orderkey, cast(o_orderdate AS DATE) + 30 AS later, cast(o_orderdate AS DATE) - 7 AS earlier, cast(o_orderdate AS DATE) - date '1996-01-01' AS days FROM orders")
def fn_date_arithmetic(spark, d):
    day = F.col("o_orderdate").cast("date")
    return Tables(spark, d).orders.select("o_orderkey", fn.date_plus(day, 30).alias("later"), fn.date_plus(day, -7).alias("earlier"), fn.date_minus(day, F.lit("1996-01-01").cast("date")).alias("days"))


@query("fn_structs", "SELECT n_nationkey, s.name AS name, s.region AS region FROM (SELECT n_nationkey, struct_pack(name := n_name, region := n_regionkey) AS s FROM nation)")
def fn_structs(spark, d):
    return Tables(spark, d).nation.select("n_nationkey", fn.struct_pack(name="n_name", region="n_regionkey").alias("s")).select("n_nationkey", "s.name", "s.region")


same("fn_more_strings", """SELECT c_custkey, trim('  ' || c_name || ' ') AS t, ltrim('  a') AS l, rtrim('a  ') AS r, replace(c_name, '0', 'o') AS rep, reverse(c_mktsegment) AS rev,
left(c_name, 3) AS lft, right(c_name, 3) AS rgt, lpad(c_mktsegment, 12, '*') AS lp, rpad(c_mktsegment, 12, '*') AS rp, repeat('ab', 2) AS rpt, ascii(c_name) AS code,
greatest(c_nationkey, 10) AS g, least(c_nationkey, 10) AS le FROM customer""")
same("fn_more_math", """SELECT p_partkey, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, round(sqrt(p_retailprice), 6) AS sq, round(power(p_size, 2), 6) AS pw, round(ln(p_size), 9) AS ln_,
round(exp(p_size / 50.0e0), 6) AS ex, sign(p_size - 25) AS sg, round(sin(p_size), 9) AS si, round(log10(p_size), 9) AS lg FROM part""",
     """SELECT p_partkey, floor(p_retailprice)::BIGINT AS f, ceil(p_retailprice)::BIGINT AS c, round(sqrt(p_retailprice), 6) AS sq, round(power(p_size, 2), 6) AS pw, round(ln(p_size), 9) AS ln_,
round(exp(p_size / 50.0e0), 6) AS ex, sign(p_size - 25)::DOUBLE AS sg, round(sin(p_size), 9) AS si, round(log10(p_size), 9) AS lg FROM part""")
same("fn_json_list", """SELECT event_id, cast(get_json_object(props, '$.k') AS BIGINT) AS k, size(split(event_type, 'i')) AS pieces, array_contains(split(event_type, 'i'), 'cl') AS has FROM events""",
     """SELECT event_id, cast(json_extract_string(props, '$.k') AS BIGINT) AS k, len(string_split(event_type, 'i'))::INTEGER AS pieces, list_contains(string_split(event_type, 'i'), 'cl') AS has FROM events""")

# joins

_L = "(VALUES (7, 1), (8, NULL), (9, 4), (10, 1), (11, 6)) AS l(id, k)"
_R = "(VALUES (7, NULL), (8, 4), (9, 4), (10, 1), (12, 5)) AS r(id, k)"
for _how in "INNER LEFT RIGHT FULL".split():
    same(f"join_{_how.lower()}", f"SELECT c_custkey, o_orderkey, o_totalprice FROM customer {_how} JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000")
    same(f"join_{_how.lower()}_null_keys", f"SELECT l.id AS lid, r.id AS rid, l.k AS lk, r.k AS rk FROM {_L} {_how} JOIN {_R} ON l.k = r.k")


@query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(spark, d):
    t = Tables(spark, d)
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("join_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_anti(spark, d):
    t = Tables(spark, d)
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("join_right_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def join_right_semi(spark, d):
    t = Tables(spark, d)
    return t.orders.join(t.customer.where("c_mktsegment = 'MACHINERY'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("join_right_anti", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def join_right_anti(spark, d):
    t = Tables(spark, d)
    return t.orders.join(t.customer.where("c_mktsegment = 'MACHINERY'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")


@query("join_mark", "SELECT n_nationkey, nullif(n_regionkey, 2) IN (SELECT nullif(r_regionkey, 1) FROM region) AS mark FROM nation")
def join_mark(spark, d):
    t = Tables(spark, d)
    left = t.nation.select("n_nationkey", F.expr("nullif(n_regionkey, 2)").alias("p"))
    return joins.mark_join(left, t.region.select(F.expr("nullif(r_regionkey, 1)").alias("k")), "p", "k").select("n_nationkey", "mark")


@query("join_mark_empty", "SELECT n_nationkey, nullif(n_regionkey, 2) IN (SELECT r_regionkey FROM region WHERE r_regionkey > 99) AS mark FROM nation")
def join_mark_empty(spark, d):
    t = Tables(spark, d)
    left = t.nation.select("n_nationkey", F.expr("nullif(n_regionkey, 2)").alias("p"))
    return joins.mark_join(left, t.region.where("r_regionkey > 99"), "p", "r_regionkey").select("n_nationkey", "mark")


@query("join_single", "SELECT n_nationkey, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey + 1) AS r_name FROM nation")
def join_single(spark, d):
    t = Tables(spark, d)
    return joins.single_join(t.nation.withColumn("k", F.col("n_regionkey") + 1), t.region, "k", "r_regionkey", "r_name").select("n_nationkey", "r_name")


same("join_mixed", "SELECT a.o_orderkey AS ak, count(*) AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_totalprice < b.o_totalprice GROUP BY a.o_orderkey")
same("join_mixed_anti", "SELECT a.o_orderkey FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey)")
same("join_residual", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND (o_totalprice > 250000 OR c_acctbal < 0)")


@query("join_null_safe", f"SELECT l.id AS lid, r.id AS rid FROM {_L} JOIN {_R} ON l.k IS NOT DISTINCT FROM r.k AND l.id = r.id")
def join_null_safe(spark, d):
    ls = spark.createDataFrame([(7, 1), (8, None), (9, 4), (10, 1), (11, 6)], "id int, k int")
    rs = spark.createDataFrame([(7, None), (8, 4), (9, 4), (10, 1), (12, 5)], "rid int, k int")
    return joins.null_safe_join(ls, rs, [("k", "k"), ("id", "rid")]).select(ls["id"].alias("lid"), "rid")


same("join_null_safe_outer", f"SELECT l.id AS lid, r.id AS rid FROM {_L} FULL JOIN {_R} ON l.k IS NOT DISTINCT FROM r.k")


@query("join_theta", "SELECT s_suppkey, count(*) AS cheaper FROM supplier JOIN part ON p_retailprice < s_acctbal GROUP BY s_suppkey")
def join_theta(spark, d):
    """Parts below each balance are counted in sorted order, not paired."""
    t = Tables(spark, d)
    counted = joins.count_below(t.supplier.select("s_suppkey", "s_acctbal"), t.part, "s_acctbal", "p_retailprice")
    return counted.where("n > 0").groupBy("s_suppkey").agg(F.sum("n").alias("cheaper"))


same("join_theta_left", "SELECT n_nationkey, r_regionkey FROM nation LEFT JOIN region ON n_regionkey < r_regionkey - 2")
same("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
same("join_cross_left_empty", "SELECT r_name, n_name FROM region LEFT JOIN (SELECT * FROM nation WHERE n_nationkey > 99) e ON 1 = 1")
same("join_any", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey OR s_suppkey = n_nationkey")
same("join_expression_keys", "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_partkey % 50 = s_suppkey + 1")


@query("join_delim", "SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.5e0 * max(b.o_totalprice) FROM orders b WHERE b.o_custkey = o.o_custkey AND b.o_orderkey < o.o_orderkey)")
def join_delim(spark, d):
    """A running maximum of each customer; Spark's own plan pairs all orders with all earlier ones."""
    o = Tables(spark, d).orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return joins.max_before(o, ["o_custkey"], "o_orderkey", "o_totalprice", "most").where("o_totalprice > 1.5e0 * most").select("o_orderkey", "o_totalprice")


@query("join_dense_count", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_dense_count(spark, d):
    t = Tables(spark, d)
    return joins.outer_count(t.customer.select("c_custkey"), t.orders, "c_custkey", "o_custkey")


@query("join_salted", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_salted(spark, d):
    t = Tables(spark, d)
    return joins.salted_join(t.orders.select("o_orderkey", F.col("o_custkey").alias("k")), t.customer.select(F.col("c_custkey").alias("k"), "c_name"), "k", 4).select("o_orderkey", "c_name")


@query("join_asof", """SELECT e.event_id, o.value AS last_purchase FROM events e ASOF LEFT JOIN
(SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) o ON e.user_id = o.user_id AND e.ts >= o.ts""")
def join_asof(spark, d):
    e = Tables(spark, d).events
    bought = e.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("at")).agg(F.max("value").alias("last_purchase"))
    return joins.asof_join(e.select("event_id", "user_id", "ts"), bought, ["user_id"], "ts", "at", ["last_purchase"]).select("event_id", "last_purchase")


@query("join_range", "SELECT o_orderkey, b.lo AS lo FROM orders JOIN (SELECT i * 20000.0e0 AS lo, i * 20000.0e0 + 15000.0e0 AS hi FROM range(0, 30) r(i)) b ON o_totalprice >= lo AND o_totalprice < hi")
def join_range(spark, d):
    bands = spark.range(30).select((F.col("id") * 20000.0).alias("lo"), (F.col("id") * 20000.0 + 15000.0).alias("hi"))
    return joins.range_join(Tables(spark, d).orders, bands, "o_totalprice", "lo", "hi", 5000.0).select("o_orderkey", "lo")


@query("join_positional", "SELECT n_name, s_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) a FULL JOIN (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) b ON a.i = b.i")
def join_positional(spark, d):
    t = Tables(spark, d)
    return joins.positional_join(t.nation, t.supplier, ["n_nationkey"], ["s_suppkey"]).select("n_name", "s_name")


same("join_nested_keys", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON struct(a.n_regionkey, a.n_nationkey % 2) = struct(b.n_regionkey, b.n_nationkey % 2)",
     "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON row(a.n_regionkey, a.n_nationkey % 2) = row(b.n_regionkey, b.n_nationkey % 2)")
same("subquery_not_in_null", "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT nullif(r_regionkey, 1) FROM region)")
same("subquery_scalar", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
same("lateral_join", "SELECT n_nationkey, t.m FROM nation, LATERAL (SELECT max(s_acctbal) AS m FROM supplier WHERE s_nationkey = n_nationkey) t")

# aggregation

same("agg_ungrouped_empty", "SELECT count(*) AS n, count(o_orderkey) AS c, min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_totalprice) AS mean FROM orders WHERE o_orderkey < 0")
same("agg_null_keys", "SELECT nullif(o_orderstatus, 'F') AS k, count(*) AS n, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY nullif(o_orderstatus, 'F')")


@query("agg_sum_types", """SELECT l_returnflag, cast(sum(l_orderkey) AS DECIMAL(38,0)) AS s_int, cast(sum(cast(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS s_dec,
cast(sum(cast(l_quantity AS DECIMAL(15,2))) AS DOUBLE) AS s_money, avg(l_linenumber) AS mean FROM lineitem GROUP BY l_returnflag""")
def agg_sum_types(spark, d):
    return Tables(spark, d).lineitem.groupBy("l_returnflag").agg(relational.sum_exact("l_orderkey").alias("s_int"), F.sum(F.col("l_extendedprice").cast("decimal(15,2)")).cast("decimal(38,2)").alias("s_dec"), relational.sum_money("l_quantity").alias("s_money"), relational.avg_double("l_linenumber").alias("mean"))


same("agg_stddev", "SELECT l_returnflag, round(stddev_samp(l_quantity), 9) AS sd, round(var_samp(l_quantity), 9) AS v FROM lineitem GROUP BY l_returnflag")
same("agg_stddev_single", "SELECT o_orderkey, stddev_samp(o_totalprice) AS sd FROM orders GROUP BY o_orderkey")


@query("agg_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT (o_orderpriority, o_custkey)) AS pairs FROM orders GROUP BY o_orderstatus")
def agg_count_distinct(spark, d):
    return Tables(spark, d).orders.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"), relational.count_distinct_rows("o_orderpriority", "o_custkey").alias("pairs"))


same("agg_distinct_other", "SELECT p_brand, sum(DISTINCT p_size) AS s, avg(DISTINCT p_size) AS a FROM part GROUP BY p_brand", "SELECT p_brand, cast(sum(DISTINCT p_size) AS BIGINT) AS s, avg(DISTINCT p_size) AS a FROM part GROUP BY p_brand")
same("agg_filter", """SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, min(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS lo,
count(DISTINCT o_custkey) FILTER (WHERE nullif(o_orderpriority, '5-LOW') IS NULL) AS c FROM orders GROUP BY o_orderstatus""")


@query("agg_first_row", "SELECT o_custkey, count(*) AS n, true AS coherent FROM orders GROUP BY o_custkey")
def agg_first_row(spark, d):
    o = Tables(spark, d).orders
    g = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), relational.first_row("o_orderkey", "o_totalprice").alias("r"))
    real = o.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    return g.join(real, F.col("r.o_orderkey") == F.col("k")).select("o_custkey", "n", (F.col("r.o_totalprice") == F.col("p")).alias("coherent"))


_G = "o_orderstatus AS st, o_orderpriority AS pr, count(*) AS n, max(o_totalprice) AS hi"
same("grouping_sets", f"SELECT {_G} FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderstatus), ())")
same("rollup", f"SELECT {_G}, cast(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
same("cube", f"SELECT {_G}, cast(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")


@query("grouping_sets_empty", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY GROUPING SETS ((o_orderstatus), ())")
def grouping_sets_empty(spark, d):
    return relational.grouping_sets(Tables(spark, d).orders.where("o_orderkey < 0"), [["o_orderstatus"], []], [F.count(F.lit(1)).alias("n")], ["o_orderstatus"])


same("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")


@query("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark, d):
    return relational.distinct_on(Tables(spark, d).orders, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


same("agg_more", """SELECT p_brand, median(p_size) AS med, bool_and(p_size > 0) AS every_, bool_or(p_size > 49) AS some_, min_by(p_partkey, p_retailprice * 100000 + p_partkey) AS cheapest,
max_by(p_partkey, p_retailprice * 100000 + p_partkey) AS dearest, round(corr(p_size, p_retailprice), 9) AS c, round(var_pop(p_size), 9) AS vp, count_if(p_size > 10) AS ci FROM part GROUP BY p_brand""",
     """SELECT p_brand, median(p_size) AS med, bool_and(p_size > 0) AS every_, bool_or(p_size > 49) AS some_, arg_min(p_partkey, p_retailprice * 100000 + p_partkey) AS cheapest,
arg_max(p_partkey, p_retailprice * 100000 + p_partkey) AS dearest, round(corr(p_size, p_retailprice), 9) AS c, round(var_pop(p_size), 9) AS vp, cast(count_if(p_size > 10) AS BIGINT) AS ci FROM part GROUP BY p_brand""")
same("agg_ordered_list", "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
same("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")

# windows

_W = "PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey"
same("window_ranking", f"""SELECT o_orderkey, cast(row_number() OVER ({_W}) AS BIGINT) AS rn, cast(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk,
cast(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr FROM orders""")
same("window_whole_partition", """SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, min(o_totalprice) OVER (PARTITION BY o_custkey) AS lo, max(o_totalprice) OVER (PARTITION BY o_custkey) AS hi,
cast(sum(cast(o_totalprice AS DECIMAL(15,2))) OVER (PARTITION BY o_custkey) AS DOUBLE) AS s FROM orders""")
same("window_running", f"""SELECT o_orderkey, cast(sum(cast(o_totalprice AS DECIMAL(15,2))) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS s,
count(*) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n, min(o_orderkey) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo,
max(o_orderkey) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM orders""")
same("window_nulls_order", "SELECT o_orderkey, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderpriority, '1-URGENT') ASC NULLS FIRST, o_orderkey DESC) AS BIGINT) AS rn FROM orders")
same("window_offsets", f"""SELECT o_orderkey, lag(o_orderkey) OVER ({_W}) AS prev, lead(o_orderkey, 2) OVER ({_W}) AS next2, first_value(o_orderkey) OVER ({_W}) AS fst,
cast(ntile(3) OVER ({_W}) AS BIGINT) AS nt, nth_value(o_orderkey, 2) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS nth FROM orders""")
same("window_frames", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n4,
max(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS hi, count(*) OVER (PARTITION BY user_id ORDER BY ts) AS range_n FROM events""")
same("window_distribution", "SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice), 9) AS pr, round(cume_dist() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice), 9) AS cd FROM orders")

# sort and limit

same("order_by", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey DESC NULLS LAST, c_acctbal ASC NULLS FIRST, c_custkey")
same("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
same("top_n_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 40")


@query("limit_unordered", "SELECT 17::BIGINT AS n")
def limit_unordered(spark, d):
    return Tables(spark, d).orders.limit(17).agg(F.count(F.lit(1)).alias("n"))


@query("limit_percent", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i, count(*) OVER () AS n FROM orders) WHERE i <= floor(n * 0.1)")
def limit_percent(spark, d):
    return relational.limit_percent(Tables(spark, d).orders.select("o_orderkey"), 10, [F.asc("o_orderkey")])


# sets and duplication

_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier WHERE s_nationkey < 15"
for _op in ("UNION ALL", "UNION", "INTERSECT", "EXCEPT", "INTERSECT ALL", "EXCEPT ALL"):
    same("set_" + _op.lower().replace(" ", "_"), f"{_A} {_op} {_B}")
same("set_null_rows", "SELECT nullif(n_regionkey, 1) AS k FROM nation INTERSECT SELECT nullif(r_regionkey, 1) AS k FROM region")


@query("set_union_by_name", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION BY NAME SELECT r_name AS name, r_regionkey AS k FROM region")
def set_union_by_name(spark, d):
    t = Tables(spark, d)
    return t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).unionByName(t.region.select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k"))).distinct()


@query("replicate", "SELECT n_name FROM nation, range(0, n_regionkey) r(i)")
def replicate(spark, d):
    return relational.replicate(Tables(spark, d).nation.select("n_name", "n_regionkey"), "n_regionkey")


same("cte_reuse", "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.o_custkey, a.n FROM c a WHERE a.n > (SELECT avg(n) FROM c)")
same("recursive_cte", "WITH RECURSIVE t(n, f) AS (SELECT 1, cast(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
same("unnest", "SELECT n_nationkey, w FROM nation LATERAL VIEW explode(split(n_name, 'A')) x AS w", "SELECT n_nationkey, unnest(string_split(n_name, 'A')) AS w FROM nation")
same("pivot", "SELECT * FROM (SELECT o_orderstatus AS st, o_orderpriority AS p FROM orders) PIVOT (count(*) FOR p IN ('1-URGENT' AS urgent, '5-LOW' AS low))",
     "SELECT o_orderstatus AS st, nullif(count(*) FILTER (WHERE o_orderpriority = '1-URGENT'), 0) AS urgent, nullif(count(*) FILTER (WHERE o_orderpriority = '5-LOW'), 0) AS low FROM orders GROUP BY o_orderstatus")

# vectors, text tables, conversations


def _first_vector(spark, d) -> list[float]:
    return [float(x) for x in Tables(spark, d).embeddings.where("vec_id = 7").select("embedding").first()[0]]


_Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7)"


@query("knn_l2", f"SELECT vec_id, label, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - q[i]) * (embedding[i]::DOUBLE - q[i])))), 6) AS distance FROM embeddings, {_Q} ORDER BY distance, vec_id LIMIT 10")
def knn_l2(spark, d):
    return vector.knn(Tables(spark, d).embeddings, "embedding", _first_vector(spark, d), 10, "l2", ["vec_id", "label"]).withColumn("distance", F.round("distance", 6))


@query("knn_cosine", f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], q), 6) + 0.0 AS distance FROM embeddings, {_Q} ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q), vec_id LIMIT 10")
def knn_cosine(spark, d):
    return vector.knn(Tables(spark, d).embeddings, "embedding", _first_vector(spark, d), 10, "cosine", ["vec_id"]).withColumn("distance", F.round("distance", 6) + F.lit(0.0))


@query("ann_all_lists", f"SELECT vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - q[i]) * (embedding[i]::DOUBLE - q[i])))), 6) AS distance FROM embeddings, {_Q} ORDER BY distance, vec_id LIMIT 10")
def ann_all_lists(spark, d):
    index = vector.create_index(Tables(spark, d).embeddings.select("vec_id", "embedding"), "embedding", "l2", 8)
    return index.search(_first_vector(spark, d), 10, 8, ["vec_id"]).withColumn("distance", F.round("distance", 6))


same("array_passthrough", "SELECT vec_id, embedding[0] AS first, size(embedding) AS n FROM embeddings", "SELECT vec_id, embedding[1] AS first, len(embedding)::INTEGER AS n FROM embeddings")
same("text_tables", "SELECT role, count(*) AS n, cast(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")

# event time (beyond the reference)


@query("ext_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, max(value) AS hi FROM events GROUP BY 1, 2")
def ext_tumbling(spark, d):
    return event_time.tumbling(Tables(spark, d).events, "1 hour", ["event_type"]).select("start", "event_type", "n", "hi")


@query("ext_sessions", """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def ext_sessions(spark, d):
    return event_time.sessions(Tables(spark, d).events, "2 hours")


@query("ext_stream_tumbling", "SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_stream_tumbling(spark, d):
    return event_time.stream_tumbling(spark, f"{d}/events.parquet", "6 hours")


@query("ranked_top_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def ranked_top_per_group(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return Tables(spark, d).orders.withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey")
