"""Snapshots, sequence numbers and schemas of hand-made tables."""

import pytest
from pyspark.sql import functions as F

from tessera.plans import iceberg_table
from tessera.sources import iceberg

FIELDS = [{"id": 1, "name": "k", "type": "long"}, {"id": 2, "name": "v", "type": "string"}]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_snapshots_and_sequences(spark, tmp_path):
    make = lambda *pairs: spark.createDataFrame(list(pairs), "k long, v string")
    w = iceberg_table.Writer(spark, f"file://{tmp_path}/t", FIELDS)
    w.commit(w.data(make((1, "a"), (2, "b"), (3, None))))
    w.commit(w.equalities(make((2, "x")).select("k"), {"k": 1}), w.equalities(make((0, None)).select("v"), {"v": 2}))
    w.refs["kept"] = {"snapshot-id": 1, "type": "tag"}
    w.commit(w.data(make((2, "new"), (9, None))))  # younger than the deletes: stays
    scan = lambda **of: rows(iceberg.iceberg_scan(spark, w.path, **of))
    key = lambda r: (r[0], r[1] or "")
    assert sorted(iceberg.iceberg_scan(spark, w.path).collect(), key=key) == [(1, "a"), (2, "new"), (9, None)]
    assert scan(snapshot_id=2) == [(1, "a")] == scan(as_of_ms=2500)
    assert len(scan(ref="kept")) == 3 == len(scan(as_of_ms=1000))
    for bad in ({"snapshot_id": 77}, {"as_of_ms": 5}, {"ref": "none"}, {"snapshot_id": 1, "ref": "kept"}):
        with pytest.raises(ValueError):
            iceberg.iceberg_scan(spark, w.path, **bad)


def test_vectors_stand_for_positions(spark, tmp_path):
    w = iceberg_table.Writer(spark, f"file://{tmp_path}/t", FIELDS[:1])
    data = w.data(spark.range(10).select(F.col("id").alias("k")))
    w.commit(data)
    w.commit(w.positions(spark.createDataFrame([(data["file_path"], 0), (data["file_path"], 1)], "file_path string, pos long")))
    assert rows(iceberg.iceberg_scan(spark, w.path)) == [(i,) for i in range(2, 10)]
    w.commit(*w.vectors({data["file_path"]: [4, 5]}))
    assert rows(iceberg.iceberg_scan(spark, w.path)) == [(i,) for i in (0, 1, 2, 3, 6, 7, 8, 9)]


def test_deletes_by_a_dropped_column(spark, tmp_path):
    w = iceberg_table.Writer(spark, f"file://{tmp_path}/t", FIELDS)
    w.commit(w.data(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")))
    w.evolve([FIELDS[0], {"id": 5, "name": "w", "type": "double"}])
    w.commit(w.equalities(spark.createDataFrame([("a",)], "v string"), {"v": 2}))
    assert rows(iceberg.iceberg_scan(spark, w.path)) == [(2, None)]


def test_no_table(spark, tmp_path):
    (tmp_path / "metadata").mkdir()
    with pytest.raises(ValueError, match="no metadata"):
        iceberg.iceberg_scan(spark, f"file://{tmp_path}")
    with pytest.raises(ValueError, match="not an Avro"):
        iceberg.avro_records(b"PAR1")


@pytest.mark.parametrize("deflate", [False, True])
def test_avro(deflate):
    entry = {"status": 1, "snapshot_id": -5, "sequence_number": None, "data_file": {"content": 2, "file_path": "é" * 100, "file_format": "PARQUET", "record_count": 2**40, "equality_ids": [1, 2], "referenced_data_file": None}}
    assert iceberg.avro_records(iceberg_table.avro(iceberg_table.ENTRY, [entry] * 3, deflate)) == [entry] * 3
