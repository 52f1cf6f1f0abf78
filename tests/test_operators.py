"""Semantics on small tables with NULLs, ties, empty inputs and errors."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import pin, sql
from tessera.functions import scalar as fn
from tessera.operators import joins, relational, vector
from tessera.sources import files, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_mark_three_values(spark):
    probe = spark.createDataFrame([(1,), (2,), (None,)], "p int")
    build = lambda *v: spark.createDataFrame([(x,) for x in v], "k int")
    ask = lambda b: {r["p"]: r["mark"] for r in joins.mark_join(probe, b, "p", "k").collect()}
    assert ask(build(1, 1)) == {1: True, 2: False, None: None}
    assert ask(build(1, None)) == {1: True, 2: None, None: None}
    assert ask(build()) == {1: False, 2: False, None: False}


def test_single_join_rejects_two_rows(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "a int"), spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(Exception, match="more than one row"):
        joins.single_join(left, right, "a", "k", "v").collect()
    assert joins.single_join(left, right, "a", "k", "v", lenient=True).count() == 2


def test_asof_takes_last_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (1, 6, "c")], "k int, at int, v string")
    assert sorted(joins.asof_join(left, right, ["k"], "t", "at", ["v"]).collect()) == [(1, 1, None), (1, 5, "b"), (2, 9, None)]


def test_largest_before(spark):
    least = -(2**63)
    data = [(1, 5, 2.0), (1, 5, 9.0), (1, 6, 1.0), (1, None, 50.0), (1, 4, None), (2, 7, 3.0), (2, 3, float("nan")), (None, 1, 8.0), (None, 2, 4.0), (3, least, 1.0), (3, 9, None), (3, 8, 2.0)]
    df = spark.createDataFrame(data, "k int, o bigint, v double")
    smaller = lambda a: [r[2] for r in data if None not in (*r, a[0], a[1]) and r[0] == a[0] and r[1] < a[1]]
    largest = lambda v: None if not v else "nan" if any(x != x for x in v) else str(max(v))
    for slices in (1, 3, 64):
        found = joins.max_before(df, ["k"], "o", "v", "m", slices).collect()
        assert sorted(str((*r[:3], None if r["m"] is None else str(r["m"]))) for r in found) == sorted(str((*r, largest(smaller(r)))) for r in data)
    assert joins.max_before(df.limit(0), ["k"], "o", "v", "m").collect() == []


def test_count_below(spark):
    nan = float("nan")
    probes = [(1, 2.0), (1, 2.0), (2, None), (None, 9.0), (3, nan), (4, -1.0), (5, 0.0)] + [(10 + i, float(i)) for i in range(40)]
    keys = [2.0, 2.0, 1.0, None, nan, nan, -0.0, 7.5]
    left, right = spark.createDataFrame(probes, "a int, p double"), spark.createDataFrame([(k,) for k in keys], "k double")
    less = lambda k, p: k is not None and p is not None and k == k and (p != p or k < p)  # noqa: E731  NaN is the largest
    wanted = [(a, p, sum(less(k, p) for k in keys)) for a, p in probes]
    assert sorted(map(str, (tuple(r) for r in joins.count_below(left, right, "p", "k").collect()))) == sorted(map(str, wanted))
    assert [r["n"] for r in joins.count_below(left, right.limit(0), "p", "k").collect()] == [0] * len(probes)
    assert joins.count_below(left.limit(0), right, "p", "k").collect() == []


def test_division(spark):
    assert one(spark, fn.divide(F.lit(1), F.lit(0))) == float("inf")
    assert one(spark, fn.divide(F.lit(-1), F.lit(0))) == float("-inf")
    assert one(spark, fn.divide(F.lit(None), F.lit(0))) is None
    with pytest.raises(Exception, match="(?i)divi"):
        one(spark, fn.int_divide(F.lit(1), F.lit(0)))


@pytest.mark.parametrize(("value", "wanted"), [(0.5, 0), (1.5, 2), (2.5, 2), (-2.5, -2)])
def test_double_to_int(spark, value, wanted):
    assert one(spark, fn.to_int(F.lit(value))) == wanted


@pytest.mark.parametrize(("text", "pattern", "new", "wanted"), [("aXbX", "X", "-", "a-bX"), ("k=v;k=w", r"k=(\w)", r"<\1>", "<v>;k=w"), ("a\nb", "b$", "c", "a\nc"), ("none", "z", "y", "none"), ("a$b", r"\$", "$", "a$b"), ("abab", r"(a)(b)", r"\2\1\0", "baabab")])
def test_regexp_replace_first(spark, text, pattern, new, wanted):
    assert one(spark, fn.regexp_replace_first(F.lit(text), pattern, new)) == wanted


def test_strings(spark):
    assert one(spark, fn.substring(F.lit("abcdef"), 0, 3)) == "ab"
    assert one(spark, fn.concat(F.lit(None).cast("string"), F.lit("x"))) == "x"
    assert one(spark, fn.concat_op(F.lit(None).cast("string"), F.lit("x"))) is None
    assert one(spark, fn.like(F.lit("a\\xb"), "a\\%b")) is True
    assert (one(spark, fn.strlen(F.lit("é"))), one(spark, fn.length(F.lit("é")))) == (2, 1)


def test_in_list_and_between(spark):
    assert one(spark, fn.in_list(F.lit(3), [1, None])) is None
    assert one(spark, fn.in_list(F.lit(1), [1, None])) is True
    assert one(spark, fn.between(F.lit(1), F.lit(1), F.lit(2), low_open=True)) is False


def test_exact_sum(spark):
    big = spark.createDataFrame([(2**63 - 1,), (2**63 - 1,)], "v bigint")
    assert int(big.agg(relational.sum_exact("v")).first()[0]) == 2 * (2**63 - 1)


def test_replicate_and_sets(spark):
    t = spark.createDataFrame([("a", 2), ("b", 0), ("c", None)], "v string, n int")
    assert sorted(relational.replicate(t, "n").collect()) == [("a",), ("a",)]


def test_vector_errors_and_clamp(spark):
    t = spark.createDataFrame([(i, [float(i)] * 3) for i in range(5)], "id int, v array<float>")
    assert [r["id"] for r in vector.knn(t, "v", [1.2] * 3, 9, output_columns=["id"]).collect()] == [1, 2, 0, 3, 4]
    for bad in ({"metric": "dot"}, {"output_columns": []}, {"output_columns": ["zz"]}):
        with pytest.raises(ValueError):
            vector.knn(t, "v", [1.0] * 3, 2, **bad)
    with pytest.raises(Exception, match="dimensions"):
        vector.knn(t, "v", [1.0], 2).collect()


def test_ann_recall(spark):
    import random

    random.seed(1)
    rows = [(i, [random.gauss(i % 5 * 4, 1) for _ in range(8)]) for i in range(600)]
    t = spark.createDataFrame(rows, "id int, v array<double>")
    index = vector.create_index(t, "v", n_lists=8)
    near = {r["id"] for r in vector.knn(t, "v", rows[3][1], 10, output_columns=["id"]).collect()}
    assert len(near & {r["id"] for r in index.search(rows[3][1], 10, 3, ["id"]).collect()}) >= 9


def test_deletion_vector():
    import struct
    import zlib

    body = b"\xd1\xd3\x39\x64" + struct.pack("<Q", 1) + struct.pack("<I", 0) + struct.pack("<II", 12346, 1) + struct.pack("<HH", 0, 2) + struct.pack("<I", 16) + struct.pack("<3H", 1, 5, 9)
    assert files.deletion_vector(b"".join([len(body).to_bytes(4, "big"), body, zlib.crc32(body).to_bytes(4, "big")])) == [1, 5, 9]


def test_copy_rules(spark, tmp_path):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "a int, b string")
    assert sinks.copy_parquet(t, f"{tmp_path}/x", "zstd") == 2
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.copy_parquet(t, f"{tmp_path}/x")
    with pytest.raises(ValueError):
        sinks.copy_parquet(t.select(F.create_map("a", "b").alias("m")), f"{tmp_path}/y")
    assert sinks.to_arrow(files.from_arrow(spark, pa.table({"a": [1, 2]}))).num_rows == 2
    t.write.partitionBy("a").parquet(f"{tmp_path}/hive")
    assert files.read_parquet(spark, f"{tmp_path}/hive").where("a = 2").collect() == [("b", 2)]


def test_sql_entry(spark):
    assert sql.run(spark, "SELECT 7 // 2 AS a, 'x//y' AS b, strlen('é') AS c;").first().asDict() == {"a": 3, "b": "x//y", "c": 2}
    with pytest.raises(ValueError):
        sql.run(spark, "SELECT 1; SELECT 2")
    assert sql.run(spark, "SELECT :n + 1 AS v", n=4).first()["v"] == 5


def test_pins(spark, tmp_path):
    spark.createDataFrame([(1, 2), (1, 3)], "a int, b int").write.parquet(f"{tmp_path}/t.parquet")
    assert pin.pin_table(spark, f"{tmp_path}/t.parquet", columns=["b"], unique_cols=["b"]).count() == 2
    assert spark.table("t").columns == ["b"]
    with pytest.raises(ValueError):
        pin.pin_table(spark, f"{tmp_path}/t.parquet", unique_cols=["a"])
    pin.unpin_table("t")
