"""Sinks: multipart Parquet with the COPY rules, CSV, JSON, Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODECS = ("snappy", "zstd", "gzip", "lz4", "uncompressed")


def holds_files(spark: SparkSession, path: str) -> bool:
    """Whether there is a file at or anywhere under ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(at) and (fs.getFileStatus(at).isFile() or fs.listFiles(at, True).hasNext()))


def _refused(name: str, kind: T.DataType) -> Iterator[str]:
    """Columns and fields, at any depth, of a type that is not exported: MAP, 128-bit integers, JSON values."""
    if isinstance(kind, (T.MapType, T.VariantType)) or kind == T.DecimalType(38, 0):
        yield name
    elif isinstance(kind, T.ArrayType):
        yield from _refused(f"{name}.element", kind.elementType)
    elif isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from _refused(f"{name}.{f.name}", f.dataType)


def copy_parquet(df: DataFrame, path: str, compression: str = "snappy", partition_by: list[str] | None = None) -> int:
    """Write a multipart directory that must not hold files yet (it may exist); returns the rows written."""
    if compression.lower() not in CODECS:
        raise ValueError(f"compression must be one of {CODECS}")
    if bad := [x for f in df.schema.fields for x in _refused(f.name, f.dataType)]:
        raise ValueError(f"columns {bad} have a type that is not exported")
    if holds_files(df.sparkSession, path):
        raise FileExistsError(f"{path} already exists and holds files")
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").option("compression", compression.lower())
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return seen.get["rows"]


def copy_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("error").option("header", header).csv(path)


def copy_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; NULL fields are written."""
    df.write.mode("error").option("ignoreNullFields", False).json(path)


def to_arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()


def arrow_batches(df: DataFrame, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The result as a stream of record batches; the driver holds one partition at a time."""
    names = df.columns
    held: list[tuple] = []
    schema = df.limit(0).toArrow().schema
    for r in df.toLocalIterator():
        held.append(tuple(r))
        if len(held) == rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, t, strict=True)) for t in held], schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(names, t, strict=True)) for t in held], schema)
