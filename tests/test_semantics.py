"""Errors, casts, COPY rules, labels, indexes, streams, deletes and plans on small tables."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import pin, sql
from tessera.functions import scalar as fn
from tessera.operators import exchange, joins, relational, vector
from tessera.plans import catalogue, puffin
from tessera.sources import files, scratch, sinks, tables
from tessera.streaming import fragments

from .conftest import SF


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# expressions


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "bigint"])
@pytest.mark.parametrize("function", [fn.negate, fn.absolute])
def test_smallest_integers_have_no_opposite(spark, kind, function):
    low = {"tinyint": -(2**7), "smallint": -(2**15), "int": -(2**31), "bigint": -(2**63)}[kind]
    value = lambda v: F.lit(str(v)).cast(kind)
    assert one(spark, function(value(low + 1))) == -(low + 1)
    with pytest.raises(Exception, match="(?i)overflow"):
        one(spark, function(value(low)))
    rows = spark.createDataFrame([(low,), (5,), (None,)], "v bigint").select(F.col("v").cast(kind).alias("v"))
    assert [r["v"] for r in rows.where("v > 0").select(function(F.col("v")).alias("v")).collect()] in ([5], [-5])


@pytest.mark.parametrize(("text", "kind", "wanted"), [("99.5", "tinyint", 100), ("-2.5", "int", -3), ("2.49", "bigint", 2), ("127.5", "tinyint", None), ("32768", "smallint", None), ("9223372036854775807.4", "bigint", 2**63 - 1)])
def test_decimal_to_integer(spark, text, kind, wanted):
    value = fn.decimal_to(F.lit(text).cast("decimal(30,5)"), kind)
    if wanted is None:
        with pytest.raises(Exception, match="(?i)overflow|out of range"):
            one(spark, value)
    else:
        assert one(spark, value) == wanted


def test_other_casts(spark):
    assert one(spark, fn.to_decimal(F.lit(2.345), 5, 2)).as_tuple().digits in ((2, 3, 5), (2, 3, 4))
    with pytest.raises(Exception, match="(?i)out_of_range|cannot be represented"):
        one(spark, fn.to_decimal(F.lit(99999), 4, 1))
    big = "17014118346046923173168730371588410572"
    assert one(spark, F.lit(big).cast("decimal(38,0)").cast("string")) == big
    assert str(one(spark, F.lit("2024-02-29").cast("date").cast("timestamp_ntz"))) == "2024-02-29 00:00:00"
    assert str(one(spark, fn.to_precision(F.lit("2024-01-01 00:00:00.999500").cast("timestamp_ntz"), "millisecond"))) == "2024-01-01 00:00:01"
    assert str(one(spark, fn.to_precision(F.lit("1969-12-31 23:59:59.4").cast("timestamp_ntz"), "second"))) == "1969-12-31 23:59:59"


def test_case_mapping_character_by_character(spark):
    assert one(spark, fn.upper(F.lit("straße ﬁ ŉ i"))) == "STRAẞE ﬁ ŉ I"
    assert one(spark, fn.lower(F.lit("İI ΣΑΣ"))) == "ii σασ"
    assert one(spark, fn.upper(F.lit(None).cast("string"))) is None


def test_errors_only_in_branches_that_run(spark):
    rows = spark.createDataFrame([(1,), (2,)], "v int")
    guarded = F.when(F.col("v") < 3, F.col("v")).otherwise(fn.error("too large").cast("int"))
    assert [r[0] for r in rows.select(guarded).collect()] == [1, 2]
    with pytest.raises(Exception, match="too large"):
        rows.select(F.when(F.col("v") < 2, F.col("v")).otherwise(fn.error("too large").cast("int"))).collect()
    assert rows.select(F.coalesce(F.col("v"), fn.error("null").cast("int"))).count() == 2
    with pytest.raises(Exception, match="(?i)divi"):
        rows.select(fn.int_divide(F.lit(1), F.col("v") - 1)).collect()


@pytest.mark.parametrize(("pattern", "groups"), [("a(b)(c)", 2), ("(?:a)(?<n>b)", 1), (r"\(a\)[(](b)", 1), ("(?<=x)(?<!y)(a)", 1), (r"\Q(a)\E(b)", 1), ("[a&&[(]](b)", 1), ("a*+(b)", 1)])
def test_groups_of_a_pattern(pattern, groups):
    assert fn.group_count(pattern) == groups


def test_pattern_that_python_cannot_read(spark):
    assert one(spark, fn.regexp_replace_first(F.lit("xaay"), r"\p{L}a*+(y)", r"<\1>")) == "<y>"


def test_stddev_wants_finite_values(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("c", float("inf")), ("c", 1.0), ("d", None)], "k string, v double")
    finite = {r["k"]: r["s"] for r in rows.where("k <> 'c'").groupBy("k").agg(relational.stddev_samp("v").alias("s")).collect()}
    assert finite == {"a": pytest.approx(0.5**0.5), "b": None, "d": None}
    with pytest.raises(Exception, match="not finite"):
        rows.groupBy("k").agg(relational.stddev_samp("v")).collect()


# sinks and sources


def test_copy_into_an_empty_tree(spark, tmp_path):
    t = spark.createDataFrame([(1, "a")], "a int, b string")
    (tmp_path / "tree/inner").mkdir(parents=True)
    assert sinks.copy_parquet(t, f"{tmp_path}/tree") == 1
    with pytest.raises(FileExistsError):
        sinks.copy_parquet(t, f"{tmp_path}/tree")
    (tmp_path / "other/inner").mkdir(parents=True)
    (tmp_path / "other/inner/note").write_text("x")
    with pytest.raises(FileExistsError):
        sinks.copy_parquet(t, f"{tmp_path}/other")


@pytest.mark.parametrize("column", ["array(map('a', 1))", "named_struct('x', named_struct('y', map(1, 2)))", "cast(1 as decimal(38,0))", "array(cast(1 as decimal(38,0)))", "parse_json('{}')"])
def test_copy_refuses_types(spark, tmp_path, column):
    with pytest.raises(ValueError, match="not exported"):
        sinks.copy_parquet(spark.range(1).select(F.expr(column).alias("c")), f"{tmp_path}/x")


def test_bitmaps_of_every_container():
    rng = random.Random(1)
    runs, dense = list(range(70_000, 90_000)), sorted(rng.sample(range(131_072, 196_608), 5000))
    sparse = sorted(rng.sample(range(200_000, 260_000), 50))
    assert files.deletion_vector(puffin.roaring(runs + dense + sparse)) == sorted(runs + dense + sparse)
    data = puffin.puffin({"a": runs, "b": sparse})
    assert files.puffin_vectors(data) == {"a": runs, "b": sparse}
    for broken in (data[:-1], b"XXXX" + data[4:], data[:20] + b"\xff" + data[21:]):
        with pytest.raises((ValueError, KeyError)):
            files.puffin_vectors(broken)


def test_uris_and_file_index(spark, tmp_path):
    assert files.rewrite_uri("s3://bucket/x.parquet") == "s3a://bucket/x.parquet" and files.rewrite_uri("/s3://x") == "/s3://x"
    for i in range(3):
        spark.range(5).withColumn("f", F.lit(i)).coalesce(1).write.parquet(f"{tmp_path}/p{i}")
    df = files.read_parquet(spark, f"{tmp_path}/p0", f"{tmp_path}/p1", f"{tmp_path}/p2", file_index=True, file_row_number=True)
    assert sorted((r["f"], r["file_index"], r["file_row_number"]) for r in df.collect()) == [(i, i, n) for i in range(3) for n in range(5)]


def test_no_local_folder_on_a_cluster(spark):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Elsewhere.conf)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.path(Elsewhere, "x")


def test_versions_of_a_table(spark, tmp_path):
    t = tables.Table.create(spark, f"file://{tmp_path}/t", spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "k int, v string"))
    first = t.read()
    t.delete("k = 2")
    t.update({"v": "concat(v, '!')"}, "k is null")
    t.insert(spark.createDataFrame([("z", 9)], "v string, k long"))
    rows = lambda df: sorted((str(r["k"]), r["v"]) for r in df.collect())
    assert rows(t.read()) == [("1", "a"), ("9", "z"), ("None", "c!")]
    assert rows(first) == rows(t.read(1)) == [("1", "a"), ("2", "b"), ("2", "b"), ("None", "c")] and rows(t.read(2)) == [("1", "a"), ("None", "c")]
    with pytest.raises(tables.ConflictError):
        t.delete("k = 1", base=2)
    for bad in (lambda: t.read(7), lambda: t.update({"zz": "1"}, "true"), lambda: t.insert(spark.range(1)), lambda: tables.Table(spark, f"file://{tmp_path}/no").read()):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(FileExistsError):
        tables.Table.create(spark, f"file://{tmp_path}/t", spark.range(1))


# SQL entry


def test_optimizer_is_off_when_the_result_is_used(spark):
    query = "SELECT id + 0 + (1 + 1) AS v FROM range(10) WHERE id > 2 + 3"
    on, off = sql.run(spark, query), sql.run(spark, query, enable_optimizer=False)
    assert sorted(on.collect()) == sorted(off.collect())
    optimized = lambda df: df.where("v > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert "(2 + 3)" in optimized(off).replace("cast(", "").replace(" as bigint)", "") and "2 + 3" not in optimized(on)
    assert "2 + 3" not in optimized(sql.run(spark, query))


def test_labels_are_used_once(spark):
    shown = lambda: spark.sparkContext.getLocalProperty("spark.job.description")
    sql.set_session_label("night run")
    sql.set_query_label("first")
    sql.run(spark, "SELECT 1").collect()
    assert shown() == "first"
    sql.run(spark, "SELECT 1").collect()
    assert shown() == "night run"
    sql.run(spark, "SELECT 1", label="third").collect()
    assert shown() == "third"
    sql.set_session_label(None)
    sql.run(spark, "SELECT 1")
    assert shown() is None


def test_table_functions(spark, tmp_path):
    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id int, v array<double>").write.parquet(f"{tmp_path}/vec.parquet")
    assert sql.run(spark, f"CALL pin_table('{tmp_path}/vec.parquet', name => 'vec', tier => 'host', unique_cols => ['id'], compression => 'none')").first()["rows"] == 20
    assert sql.run(spark, "CALL create_ann_index('vec', 'v', metric => 'l2', n_lists => 4)").first()["lists"] == 4
    near = "SELECT id FROM knn_search('vec', 'v', [3.1, 1.0], k => 2, metric => 'l2', output_columns => ['id'], use_index => {}, n_probes => 4)"
    assert {r["id"] for r in sql.run(spark, near.format("true")).collect()} == {3, 4} == {r["id"] for r in sql.run(spark, near.format("false")).collect()}
    assert sql.run(spark, "CALL drop_ann_index('vec', 'v')").first()["dropped"] == 1
    with pytest.raises(vector.StaleIndexError):
        sql.run(spark, near.format("true"))
    sql.run(spark, "CALL unpin_table('vec')")
    with pytest.raises(ValueError, match="not pinned"):
        sql.run(spark, near.format("false"))
    assert sql.run(spark, f"SELECT count(*) AS n FROM read_parquet(['{tmp_path}/vec.parquet'], filename => true) WHERE filename LIKE '%vec%'").first()["n"] == 20
    for bad in ({"compression": "best"}, {"tier": "moon"}, {"columns": ["zz"]}):
        with pytest.raises(ValueError):
            pin.pin_table(spark, f"{tmp_path}/vec.parquet", **bad)


# vectors


def test_index_goes_stale(spark, tmp_path):
    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(50)] + [(99, None), (98, [])]
    t = spark.createDataFrame(rows, "id int, v array<double>")
    t.write.parquet(f"{tmp_path}/t")
    index = vector.create_index(spark.read.parquet(f"{tmp_path}/t"), "v", "l2", 4)
    assert index.search([1.0, 1.0], 60, 4, ["id"]).count() == 50  # rows without a vector are in no list
    t.write.mode("append").parquet(f"{tmp_path}/t")
    index.source = spark.read.parquet(f"{tmp_path}/t")
    with pytest.raises(vector.StaleIndexError, match="changed"):
        index.search([1.0, 1.0])
    fresh = vector.create_index(t, "v", "cosine", 4)
    fresh.drop()
    with pytest.raises(vector.StaleIndexError, match="dropped"):
        fresh.search([1.0, 1.0])
    with pytest.raises(ValueError):
        vector.create_index(t, "v", "dot")
    assert vector.create_index(t.where("id > 1000"), "v").search([1.0], 3, 1, ["id"]).count() == 0


def test_cosine_lists_ignore_length(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) * 10 ** (i % 5) for _ in range(6)]) for i in range(400)]
    t = spark.createDataFrame(rows, "id int, v array<double>")
    index = vector.create_index(t, "v", "cosine", 8)
    query = [x / 1000 for x in rows[4][1]]
    true = {r["id"] for r in vector.knn(t, "v", query, 10, "cosine", ["id"]).collect()}
    assert len(true & {r["id"] for r in index.search(query, 10, 5, ["id"]).collect()}) >= 8
    assert index.lists_for(query, 3) == index.lists_for([x * 7 for x in query], 3)


# exchanges, streams


def test_exchange_errors(spark, monkeypatch):
    t = spark.range(10)
    for bad in (("pigeon", ["id"]), ("hash", None), ("crc32", None)):
        with pytest.raises(ValueError):
            exchange.exchange(t, *bad)
    monkeypatch.setattr(exchange, "MOST_BROADCAST", 5)
    with pytest.raises(ValueError, match="not broadcast"):
        exchange.exchange(t, "broadcast")
    parts = [x.count() for x in exchange.routed(t, "crc32", 3, ["id"])]
    assert sum(parts) == 10 and [x.count() for x in exchange.routed(t, "single", 3)] == [10, 0, 0]


def test_crc32_places(spark):
    import zlib

    rows = spark.createDataFrame([(1, "a"), (2, None), (None, "")], "k int, s string")
    got = [r[0] for r in rows.select(exchange.crc32_partition(["k", "s"], 7)).collect()]
    assert got == [zlib.crc32(t.encode()) % 7 for t in ("=1\x1f=a", "=2\x1f~", "~\x1f=")]


def test_batch_stream(spark):
    schema = pa.schema([("a", pa.int64())])
    stream = fragments.BatchStream(schema, ["x", "y"])
    batch = pa.RecordBatch.from_pylist([{"a": 1}, {"a": 2}], schema)
    assert stream.try_pull() is None and not stream.wait(0.01)
    stream.push("x", batch)
    stream.close("x")
    with pytest.raises(ValueError, match="closed"):
        stream.push("x", batch)
    with pytest.raises(ValueError, match="not declared"):
        stream.push("z", batch)
    with pytest.raises(ValueError, match="schema"):
        stream.push("y", pa.RecordBatch.from_pylist([{"b": 1}]))
    with pytest.raises(TimeoutError):
        stream.table(0.01)
    failing = fragments.BatchStream(schema, ["x"])
    failing.fail(RuntimeError("first"))
    failing.fail(RuntimeError("second"))
    with pytest.raises(RuntimeError, match="first"):
        failing.table(1)
    ended = fragments.BatchStream(schema, ["x"])
    ended.push("x", batch)
    ended.close("x")
    assert [r["a"] for r in fragments.stream_source(spark, ended, 1).collect()] == [1, 2]


def test_fragment_rules(spark):
    f = fragments.Fragment(lambda i: {"out": i["a"]})
    f.declare_input("a", "v bigint")
    with pytest.raises(ValueError, match="not fed"):
        f.build()
    with pytest.raises(ValueError, match="schema"):
        f.feed("a", spark.range(3))
    with pytest.raises(ValueError, match="not declared"):
        f.feed("b", spark.range(3))
    f.feed("a", spark.range(3).select(F.col("id").alias("v")))
    f.declare_output("out", "broadcast", consumers=2)
    assert [x.count() for x in f.run()["out"]] == [3, 3]


# joins


def test_asof_over_slices(spark):
    rng = random.Random(9)
    left = [(rng.randrange(3), rng.randrange(1000)) for _ in range(300)] + [(7, 5), (None, 4)]
    right = [(rng.randrange(3), rng.randrange(-50, 900), i) for i in range(60)] + [(0, 5, None)]
    kept = {(k, t): v for k, t, v in right}  # one row a key and time
    got = joins.asof_join(spark.createDataFrame(left, "k int, t int"), spark.createDataFrame([(k, t, v) for (k, t), v in kept.items()], "k int, at int, v int"), ["k"], "t", "at", ["v"], 7)
    want = []
    for k, t in left:
        before = [(at, v) for (kk, at), v in kept.items() if kk == k and at <= t]
        want.append((k, t, max(before, key=lambda x: x[0])[1] if before else None))
    order = lambda rows: sorted(map(str, rows))
    assert order(tuple(r) for r in got.collect()) == order(want)


def test_range_join_of_any_width(spark):
    rng = random.Random(2)
    points = [rng.uniform(-500, 500) for _ in range(200)]
    spans = [(lo, lo + 10 ** rng.uniform(-2, 6)) for lo in (rng.uniform(-600, 500) for _ in range(60))] + [(3.0, 3.0), (5.0, 1.0)]
    got = joins.range_join(spark.createDataFrame([(p,) for p in points], "p double"), spark.createDataFrame(spans, "lo double, hi double"), "p", "lo", "hi", 0.5)
    assert got.count() == sum(lo <= p < hi for p in points for lo, hi in spans)


# plans


def test_join_strategies(spark):
    big, small = spark.range(1000).withColumn("v", F.col("id") * 2), spark.range(10)
    assert "BroadcastHashJoin" in plan(big.join(small, "id"))
    assert "SortMergeJoin" in plan(big.join(small.hint("merge"), "id"))
    assert "ShuffledHashJoin" in plan(big.join(small.hint("shuffle_hash"), "id"))
    assert "CartesianProduct" not in plan(catalogue.QUERIES["tpch_q11"](spark, SF))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalogue.QUERIES["scan_projection"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_totalprice), IsNotNull(o_orderstatus)" in text and "o_comment" not in text.split("ReadSchema")[1]


def test_aggregates_are_partial_first(spark):
    text = plan(spark.range(100).groupBy(F.col("id") % 3).agg(F.sum("id")))
    assert text.count("HashAggregate") == 2 and text.count("Exchange") == 1


@pytest.mark.parametrize("name", ["tpch_q9", "tpch_q17", "tpch_q18"])
def test_line_items_are_read_once(spark, name):
    assert plan(catalogue.QUERIES[name](spark, SF)).count("lineitem.parquet") == 1


@pytest.mark.parametrize("seed", range(12))
def test_random_queries(spark, duck, seed):
    """Seeded random statements over the star schema give what DuckDB gives."""
    rng = random.Random(seed)
    where = " AND ".join(
        rng.sample(["o_totalprice > 50000", "o_orderkey % 3 <> 1", "o_orderstatus IN ('F', 'O')", "o_orderpriority LIKE '%E%'", "o_orderdate >= date '1996-01-01'", "(o_custkey < 90 OR o_totalprice < 99999)", "o_orderpriority IS NOT NULL"], rng.randint(1, 4))
    )
    key = rng.choice(["o_orderstatus", "o_orderpriority", "cast(o_custkey % 7 AS INT)", "CASE WHEN o_totalprice > 150000 THEN 'hi' ELSE 'lo' END"])
    aggregates = ", ".join(f"{a} AS a{i}" for i, a in enumerate(rng.sample(["count(*)", "min(o_totalprice)", "max(o_orderdate)", "count(DISTINCT o_custkey)", "avg(o_custkey)", "cast(sum(cast(o_totalprice AS DECIMAL(15,2))) AS DOUBLE)"], 3)))
    source = rng.choice(["orders", f"orders {rng.choice(['JOIN', 'LEFT JOIN'])} customer ON o_custkey = c_custkey", "(SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey < 500) u"])
    having = rng.choice(["", " HAVING count(*) > 3"])
    statement = f"SELECT {key} AS k, {aggregates} FROM {source} WHERE {where} GROUP BY {key}{having}"
    for t in ("orders", "customer"):
        spark.read.parquet(f"{SF}/{t}.parquet").createOrReplaceTempView(t)
    from .test_queries import rows

    mine, theirs = sql.run(spark, statement), duck.sql(statement)
    assert rows(mine.columns, mine.collect()) == rows(theirs.columns, theirs.fetchall()), statement


@pytest.mark.parametrize("name", ["join_delim", "join_theta"])
def test_growing_tables_are_not_paired(spark, name):
    shown = plan(catalogue.QUERIES[name](spark, SF))
    assert "NestedLoopJoin" not in shown and "CartesianProduct" not in shown


def test_split_scan_writes_no_file_of_all_rows(spark, tmp_path, monkeypatch):
    """Two input files give two files or more, and each is read as several ranges."""
    spark.read.parquet(f"{SF}/lineitem.parquet").repartition(2).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(scratch, "path", lambda *_: f"{tmp_path}/out")
    n, _, several = catalogue.QUERIES["split_scan"](spark, str(tmp_path)).first()
    assert several and n == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert spark.read.parquet(f"{tmp_path}/out").select("_metadata.file_path").distinct().count() >= 2
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != str(1 << 16)


def test_stored_batches_stay_with_the_executors(spark):
    df = spark.createDataFrame([(i, f"x{i % 3}" if i % 5 else None) for i in range(100)], "a bigint, b string").repartition(3)
    pushed = fragments.StoredBatches(df, 7)
    stream = fragments.BatchStream(pushed.schema, ["x", "y"])
    stream.push("x", pushed)
    stream.push("y", pa.RecordBatch.from_pylist([{"a": 500, "b": "held"}], pushed.schema))
    stream.close("x")
    stream.close("y")
    assert max(b.num_rows for b in pushed.batches()) == 7
    found = fragments.stream_source(spark, stream, 5)
    assert sorted(str(tuple(r)) for r in found.collect()) == sorted(str(tuple(r)) for r in [*df.collect(), (500, "held")])
    again = fragments.BatchStream(pushed.schema, ["x"])
    again.push("x", pushed)
    again.close("x")
    assert again.table(5).num_rows == 100


def test_stream_source_hands_no_rows_to_the_driver(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("rows at the driver")

    monkeypatch.setattr(sinks, "arrow_batches", refused)
    monkeypatch.setattr("pyspark.sql.DataFrame.toLocalIterator", refused)
    monkeypatch.setattr(fragments.BatchStream, "table", refused)
    assert catalogue.QUERIES["stream_source"](spark, SF).count() > 0
