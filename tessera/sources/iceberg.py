"""Iceberg tables without a connector: metadata and manifests are read by the driver, data and deletes by Spark.

Versions 1 to 3: snapshots by id, time or branch; partition and file pruning is Spark's own on the data files;
columns by field id, so renamed, added and dropped columns read right; positional deletes, equality deletes and
deletion vectors with their sequence numbers. The driver gets one row a data or delete file, no data."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files

# Avro object container files, as far as manifests need them


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) != n:
            raise ValueError("the file is cut off")
        self.at += n
        return out

    def long(self) -> int:
        shift = value = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 127) << shift
            if b < 128:
                return (value >> 1) ^ -(value & 1)
            shift += 7

    def bytes_(self) -> bytes:
        return self.take(self.long())

    def value(self, kind, known: dict):
        if isinstance(kind, list):
            return self.value(kind[self.long()], known)
        if isinstance(kind, str):
            if kind in known:
                return self.value(known[kind], known)
            return {
                "null": lambda: None,
                "boolean": lambda: self.take(1) == b"\1",
                "int": self.long,
                "long": self.long,
                "float": lambda: struct.unpack("<f", self.take(4))[0],
                "double": lambda: struct.unpack("<d", self.take(8))[0],
                "bytes": self.bytes_,
                "string": lambda: self.bytes_().decode(),
            }[kind]()
        if kind.get("name"):
            known[kind["name"]] = kind
        if kind["type"] == "record":
            return {f["name"]: self.value(f["type"], known) for f in kind["fields"]}
        if kind["type"] == "fixed":
            return self.take(kind["size"])
        if kind["type"] == "enum":
            return kind["symbols"][self.long()]
        if kind["type"] in ("array", "map"):
            out = []
            while n := self.long():
                if n < 0:
                    n = -n
                    self.long()
                for _ in range(n):
                    out.append(self.value(kind["items"], known) if kind["type"] == "array" else (self.bytes_().decode(), self.value(kind["values"], known)))
            return out if kind["type"] == "array" else dict(out)
        return self.value(kind["type"], known)


def avro_records(data: bytes) -> list[dict]:
    """Records of an object container file (no codec or deflate)."""
    r = _Reader(data)
    if r.take(4) != b"Obj\1":
        raise ValueError("not an Avro file")
    meta = r.value({"type": "map", "values": "bytes"}, {})
    schema, codec = json.loads(meta["avro.schema"]), meta.get("avro.codec", b"null")
    if codec not in (b"null", b"deflate"):
        raise ValueError(f"codec {codec!r} is not read")
    r.take(16)
    out = []
    while r.at < len(data):
        n, block = r.long(), r.bytes_()
        inner = _Reader(zlib.decompress(block, -15) if codec == b"deflate" else block)
        out += [inner.value(schema, {}) for _ in range(n)]
        r.take(16)
    return out


# metadata


def _read(spark: SparkSession, path: str) -> bytes:
    """A small metadata file, through Spark's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def _metadata(spark: SparkSession, table: str) -> dict:
    """The newest metadata file: the one the version hint names, or that with the highest number."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/metadata")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    if "version-hint.text" in names:
        hint = _read(spark, f"{table}/metadata/version-hint.text").decode().strip()
        for name in (hint, f"v{hint}.metadata.json"):
            if name in names:
                return json.loads(_read(spark, f"{table}/metadata/{name}"))
    found = [(int(m[1]), n) for n in names if (m := re.match(r"v?(\d+).*\.metadata\.json$", n))]
    if not found:
        raise ValueError(f"{table} has no metadata")
    return json.loads(_read(spark, f"{table}/metadata/{max(found)[1]}"))


def snapshot_of(meta: dict, snapshot_id: int | None = None, as_of_ms: int | None = None, ref: str | None = None) -> dict | None:
    """The snapshot that is asked for, the current one by default; None for a table without any."""
    if sum(x is not None for x in (snapshot_id, as_of_ms, ref)) > 1:
        raise ValueError("give a snapshot, a time or a branch")
    by_id = {s["snapshot-id"]: s for s in meta.get("snapshots", [])}
    if as_of_ms is not None:
        log = [x for x in meta.get("snapshot-log", []) if x["timestamp-ms"] <= as_of_ms]
        if not log:
            raise ValueError("the table has no snapshot as old as that")
        snapshot_id = max(log, key=lambda x: x["timestamp-ms"])["snapshot-id"]
    if ref is not None:
        if ref not in meta.get("refs", {}):
            raise ValueError(f"no branch or tag {ref}")
        snapshot_id = meta["refs"][ref]["snapshot-id"]
    if snapshot_id is None:
        snapshot_id = meta.get("current-snapshot-id")
        if snapshot_id in (None, -1):
            return None
    if snapshot_id not in by_id:
        raise ValueError(f"no snapshot {snapshot_id}")
    return by_id[snapshot_id]


_PRIMITIVES = {
    "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(),
    "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "string": T.StringType(), "binary": T.BinaryType(), "uuid": T.StringType(),
}


def _type(kind) -> T.DataType:
    if isinstance(kind, str):
        if m := re.match(r"decimal\((\d+),\s*(\d+)\)", kind):
            return T.DecimalType(int(m[1]), int(m[2]))
        return T.BinaryType() if kind.startswith("fixed") else _PRIMITIVES[kind]
    if kind["type"] == "struct":
        return T.StructType([_field(f) for f in kind["fields"]])
    if kind["type"] == "list":
        return T.ArrayType(_type(kind["element"]))
    return T.MapType(_type(kind["key"]), _type(kind["value"]))


def _field(f: dict) -> T.StructField:
    """A field that Spark's Parquet reader matches by its id."""
    return T.StructField(f["name"], _type(f["type"]), True, {"parquet.field.id": f["id"]})


def _schema(meta: dict, snapshot: dict | None) -> dict:
    wanted = (snapshot or {}).get("schema-id", meta.get("current-schema-id", 0))
    return next((s for s in meta.get("schemas", []) if s.get("schema-id") == wanted), meta.get("schema") or meta["schemas"][-1])


def _files(spark: SparkSession, snapshot: dict) -> list[dict]:
    """Live entries of all manifests: content, file_path, sequence number and what deletes need."""
    manifests = avro_records(_read(spark, snapshot["manifest-list"])) if "manifest-list" in snapshot else [{"manifest_path": p} for p in snapshot["manifests"]]
    out = []
    for m in manifests:
        for e in avro_records(_read(spark, m["manifest_path"])):
            if e["status"] == 2:  # deleted
                continue
            sequence = e.get("sequence_number")
            out.append({"content": 0, **e["data_file"], "sequence": (m.get("sequence_number") or 0) if sequence is None else sequence})
    return out


def _plain(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


def iceberg_scan(spark: SparkSession, table: str, snapshot_id: int | None = None, as_of_ms: int | None = None, ref: str | None = None) -> DataFrame:
    """The rows of a table at a snapshot, without those that its deletes drop."""
    meta = _metadata(spark, table)
    snapshot = snapshot_of(meta, snapshot_id, as_of_ms, ref)
    fields = _schema(meta, snapshot)["fields"]
    schema = T.StructType([_field(f) for f in fields])
    names = [f["name"] for f in fields]
    found = _files(spark, snapshot) if snapshot else []
    data = [f for f in found if f["content"] == 0]
    if bad := {f["file_format"].lower() for f in found} - {"parquet", "puffin"}:
        raise ValueError(f"files of {bad} are not read")
    if not data:
        return spark.createDataFrame([], schema)
    spark.conf.set("spark.sql.parquet.fieldId.read.enabled", "true")
    spark.conf.set("spark.sql.parquet.fieldId.read.ignoreMissing", "true")
    deletes = [f for f in found if f["content"] != 0]
    # equality deletes may name columns that the schema has no more
    every = {f["id"]: f for s in meta.get("schemas", [meta.get("schema")]) for f in s["fields"]} | {f["id"]: f for f in fields}
    extra = [i for f in deletes for i in f.get("equality_ids") or [] if i not in {x["id"] for x in fields}]
    wide = T.StructType([*schema.fields, *[T.StructField(f"_d{i}", _type(every[i]["type"]), True, {"parquet.field.id": i}) for i in dict.fromkeys(extra)]])
    rows = spark.read.schema(wide).parquet(*[f["file_path"] for f in data])
    if not deletes:
        return rows.select(*names)
    rows = rows.withColumn("_path", F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")).withColumn("_pos", F.col("_metadata.row_index"))
    sequences = spark.createDataFrame([(_plain(f["file_path"]), f["sequence"]) for f in data], "_path string, _sequence long")  # one row a file
    rows = rows.join(sequences, "_path")
    positional = [f for f in deletes if f["content"] == 1 and f["file_format"].lower() == "parquet"]
    vectors = [f for f in deletes if f["file_format"].lower() == "puffin"]
    gone = None
    with_vectors = {_plain(f["referenced_data_file"]) for f in vectors if f.get("referenced_data_file")}
    by_sequence: dict[int, list[str]] = defaultdict(list)
    for f in positional:
        by_sequence[f["sequence"]].append(f["file_path"])
    plain_path = F.regexp_replace("file_path", "^file:/+", "/")
    for sequence, paths in by_sequence.items():
        one = spark.read.schema(T.StructType([T.StructField("file_path", T.StringType(), True, {"parquet.field.id": 2147483546}), T.StructField("pos", T.LongType(), True, {"parquet.field.id": 2147483545})])).parquet(*paths)
        one = one.select(plain_path.alias("_f"), F.col("pos").alias("_p"), F.lit(sequence).cast("long").alias("_s"))
        gone = one if gone is None else gone.unionByName(one)
    if gone is not None and with_vectors:  # a data file's vector stands for all positional deletes of it
        gone = gone.where(~F.col("_f").isin(sorted(with_vectors)))
    for path in sorted({f["file_path"] for f in vectors}):
        one = files.vector_deletes(spark, path).select(plain_path.alias("_f"), F.col("pos").alias("_p"), F.lit(2**62).alias("_s"))
        gone = one if gone is None else gone.unionByName(one)
    if gone is not None:
        # a positional delete holds for data as old as itself or older
        rows = rows.join(gone, (F.col("_path") == F.col("_f")) & (F.col("_pos") == F.col("_p")) & (F.col("_sequence") <= F.col("_s")), "left_anti")
    by_keys: dict[tuple[int, ...], list[dict]] = defaultdict(list)
    for f in deletes:
        if f["content"] == 2:
            by_keys[tuple(f["equality_ids"])].append(f)
    column = {f["id"]: f["name"] for f in fields}
    for ids, of_keys in by_keys.items():
        keyed = None
        for f in of_keys:
            one = spark.read.schema(T.StructType([T.StructField(f"_k{i}", _type(every[i]["type"]), True, {"parquet.field.id": i}) for i in ids])).parquet(f["file_path"]).withColumn("_s", F.lit(f["sequence"]).cast("long"))
            keyed = one if keyed is None else keyed.unionByName(one)
        # an equality delete holds for data older than itself: the youngest of equal ones decides
        keyed = keyed.groupBy(*[f"_k{i}" for i in ids]).agg(F.max("_s").alias("_s"))
        match = F.col("_sequence") < F.col("_s")
        for i in ids:
            match = match & F.col(column.get(i, f"_d{i}")).eqNullSafe(F.col(f"_k{i}"))
        rows = rows.join(keyed, match, "left_anti")
    return rows.select(*names)
