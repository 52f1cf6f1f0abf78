"""The 22 decision-support queries, restated for the tables at hand.

Money is a double in the files: it is summed as exact decimals and shown as a double. Where the original
needs part-supplier rows, they are derived from line items; receipt and commit dates and ship modes,
which the tables lack, are replaced by predicates on the columns there are. Filters come before the
aggregates over line items, and what two readings of one table would give is taken from one. The text is ANSI SQL."""

from __future__ import annotations

from .catalogue import same

D = "cast({} as decimal(15,2))"
EXT, DISC, TAX, QTY = (D.format(c) for c in ("l_extendedprice", "l_discount", "l_tax", "l_quantity"))
REV = f"{EXT} * (1 - {DISC})"
PARTSUPP = f"SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min({EXT}) AS ps_supplycost, sum({QTY}) AS ps_availqty FROM lineitem GROUP BY l_partkey, l_suppkey"

TPCH = {
    1: f"""SELECT l_returnflag, l_linestatus, count(*) AS count_order, cast(sum({QTY}) as double) AS sum_qty, cast(sum({EXT}) as double) AS sum_base_price,
        cast(sum({REV}) as double) AS sum_disc_price, cast(sum({REV} * (1 + {TAX})) as double) AS sum_charge,
        cast(sum({QTY}) as double) / count(*) AS avg_qty, cast(sum({EXT}) as double) / count(*) AS avg_price,
        cast(sum({DISC}) as double) / count(*) AS avg_disc
        FROM lineitem WHERE l_shipdate < date '1998-09-03' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    2: f"""WITH ps AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min({EXT}) AS ps_supplycost
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' AND p_size <= 15 GROUP BY l_partkey, l_suppkey),
        m AS (SELECT ps.*, min(ps_supplycost) OVER (PARTITION BY ps_partkey) AS mc FROM ps)
        SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM m JOIN part ON p_partkey = ps_partkey JOIN supplier ON s_suppkey = ps_suppkey
        JOIN nation ON s_nationkey = n_nationkey WHERE ps_supplycost = mc ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    3: f"""SELECT l_orderkey, cast(sum({REV}) as double) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey
        JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < date '1998-03-15' AND l_shipdate > date '1998-03-15'
        GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    4: """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE date '1997-10-01' > o_orderdate AND o_orderdate >= date '1997-07-01'
        AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    5: f"""SELECT n_name, cast(sum({REV}) as double) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE r_name = 'ASIA' AND date '1998-01-01' > o_orderdate AND o_orderdate >= date '1996-01-01' GROUP BY n_name ORDER BY revenue DESC, n_name""",
    6: f"""SELECT cast(sum({EXT} * {DISC}) as double) AS revenue FROM lineitem WHERE date '1997-01-01' > l_shipdate AND l_shipdate >= date '1996-01-01'
        AND {DISC} BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    7: f"""SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, cast(year(l_shipdate) as bigint) AS l_year, cast(sum({REV}) as double) AS revenue
        FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
        JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
        WHERE n1.n_regionkey = 3 AND n2.n_regionkey = 2 AND l_shipdate BETWEEN date '1997-01-01' AND date '1998-12-31'
        GROUP BY n1.n_name, n2.n_name, cast(year(l_shipdate) as bigint) ORDER BY supp_nation, cust_nation, l_year""",
    8: f"""SELECT cast(year(o_orderdate) as bigint) AS o_year, cast(sum(CASE WHEN n2.n_nationkey = 8 THEN {REV} ELSE 0 END) as double) / cast(sum({REV}) as double) AS mkt_share
        FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
        JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN nation n2 ON s_nationkey = n2.n_nationkey
        JOIN region ON n1.n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND p_type = 'ECONOMY' GROUP BY cast(year(o_orderdate) as bigint) ORDER BY o_year""",
    9: f"""WITH l AS (SELECT l_orderkey, l_suppkey, {REV} AS rev, {QTY} AS qty, min({EXT}) OVER (PARTITION BY l_partkey, l_suppkey) AS ps_supplycost
        FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_name LIKE '%red%')
        SELECT n_name AS nation, cast(year(o_orderdate) as bigint) AS o_year, cast(sum(rev - ps_supplycost * qty) as double) AS sum_profit
        FROM l JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey
        GROUP BY n_name, cast(year(o_orderdate) as bigint) ORDER BY nation, o_year DESC""",
    10: f"""SELECT c_custkey, c_name, cast(sum({REV}) as double) AS revenue, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey
        JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE date '1997-01-01' > o_orderdate AND o_orderdate >= date '1996-10-01'
        AND l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    11: f"""WITH ps AS (SELECT l_partkey AS ps_partkey, l_suppkey, min({EXT}) * sum({QTY}) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 3 GROUP BY l_partkey, l_suppkey),
        g AS (SELECT ps_partkey, sum(v) AS v FROM ps GROUP BY ps_partkey)
        SELECT ps_partkey, cast(v as double) AS value FROM g WHERE cast(v as double) > (SELECT cast(sum(v) as double) * 0.001 FROM g) ORDER BY value DESC, ps_partkey""",
    12: """SELECT l_linestatus, cast(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) as bigint) AS high_line_count,
        cast(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) as bigint) AS low_line_count FROM orders JOIN lineitem ON o_orderkey = l_orderkey
        WHERE date '1998-01-01' > l_shipdate AND l_shipdate >= date '1997-01-01' AND l_returnflag IN ('A', 'N') GROUP BY l_linestatus ORDER BY l_linestatus""",
    13: """WITH per_customer AS (SELECT c_custkey, count(o_orderkey) AS made FROM customer LEFT JOIN orders ON c_custkey = o_custkey
        AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) SELECT made, count(*) AS customers FROM per_customer GROUP BY made ORDER BY customers DESC, made DESC""",
    14: f"""SELECT 100.00 * cast(sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REV} ELSE 0 END) as double) / cast(sum({REV}) as double) AS promo_revenue
        FROM lineitem JOIN part ON l_partkey = p_partkey WHERE date '1997-10-01' > l_shipdate AND l_shipdate >= date '1997-09-01'""",
    15: f"""WITH r AS (SELECT l_suppkey AS supplier_no, sum({REV}) AS total FROM lineitem WHERE date '1997-04-01' > l_shipdate AND l_shipdate >= date '1997-01-01' GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, cast(total as double) AS total_revenue FROM supplier JOIN r ON s_suppkey = supplier_no WHERE total = (SELECT max(total) FROM r) ORDER BY s_suppkey""",
    16: f"""WITH ps AS ({PARTSUPP}) SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM ps JOIN part ON p_partkey = ps_partkey
        WHERE p_brand <> 'Brand#3' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49)
        AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_type, p_brand, p_size ORDER BY supplier_cnt DESC, p_type, p_size, p_brand""",
    17: f"""WITH l AS (SELECT {EXT} AS price, l_quantity, 0.5e0 * cast(sum({QTY}) OVER (PARTITION BY l_partkey) as double) / count(*) OVER (PARTITION BY l_partkey) AS half
        FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#3')
        SELECT cast(sum(price) as double) / 7.0e0 AS avg_yearly FROM l WHERE l_quantity < half""",
    18: f"""WITH big AS (SELECT l_orderkey, sum({QTY}) AS q FROM lineitem GROUP BY l_orderkey HAVING sum({QTY}) > 200)
        SELECT o_orderkey, o_totalprice, o_orderdate, c_custkey, c_name, cast(q as double) AS sum_qty FROM big JOIN orders ON o_orderkey = l_orderkey
        JOIN customer ON c_custkey = o_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
    19: f"""SELECT cast(sum({REV}) as double) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE (p_brand = 'Brand#1' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
        OR (p_brand = 'Brand#2' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)
        OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 50)""",
    20: f"""WITH ps AS ({PARTSUPP}) SELECT s_name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 AND s_suppkey IN
        (SELECT ps_suppkey FROM ps WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '%7%') AND ps_availqty > 40) ORDER BY s_name, s_suppkey""",
    21: """SELECT s_name, count(*) AS numwait FROM lineitem late JOIN supplier ON s_suppkey = late.l_suppkey JOIN orders ON o_orderkey = late.l_orderkey
        WHERE late.l_returnflag = 'R' AND o_orderstatus = 'F'
        AND EXISTS (SELECT 1 FROM lineitem other WHERE late.l_orderkey = other.l_orderkey AND late.l_suppkey <> other.l_suppkey)
        AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_returnflag = 'R' AND late.l_orderkey = x.l_orderkey AND late.l_suppkey <> x.l_suppkey)
        GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    22: f"""SELECT c_mktsegment, count(*) AS numcust, cast(sum({D.format('c_acctbal')}) as double) AS totacctbal FROM customer
        WHERE {D.format('c_acctbal')} > (SELECT cast(sum({D.format('c_acctbal')}) as double) / count(*) FROM customer WHERE c_acctbal > 0)
        AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY c_mktsegment ORDER BY c_mktsegment""",
}
for _n, _sql in TPCH.items():
    same(f"tpch_q{_n}", _sql)
