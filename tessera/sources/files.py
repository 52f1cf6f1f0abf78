"""Sources: Parquet with its virtual columns, hive partitions, row deletes, values, Arrow."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, *paths: str, merge_schema: bool = False, filename: bool = False, file_row_number: bool = False, file_index: bool = False) -> DataFrame:
    """Parquet files, globs or hive-partitioned directories; virtual columns on demand."""
    df = spark.read.option("mergeSchema", merge_schema).parquet(*[rewrite_uri(p) for p in paths])
    if filename or file_index:
        df = df.withColumn("filename", F.col("_metadata.file_path"))
    if file_row_number:
        df = df.withColumn("file_row_number", F.col("_metadata.row_index"))
    if file_index:
        files = df.inputFiles()
        plain = re.compile(r"^file:/+")
        order = spark.createDataFrame([(plain.sub("/", f), i) for i, f in enumerate(sorted(files))], "_file string, file_index bigint")
        df = df.join(order, F.regexp_replace("filename", "^file:/+", "/") == F.col("_file"), "left").drop("_file")
        df = df if filename else df.drop("filename")
    return df


def positional_deletes(data: DataFrame, deletes: DataFrame) -> DataFrame:
    """Drop rows whose (filename, file_row_number) is among ``deletes`` (file_path, pos)."""
    return data.join(deletes.select("file_path", "pos").distinct(), (F.col("filename") == F.col("file_path")) & (F.col("file_row_number") == F.col("pos")), "left_anti")


def equality_deletes(data: DataFrame, deletes: DataFrame, keys: list[str], sequence: tuple[str, str] | None = None) -> DataFrame:
    """Drop rows equal to a delete in all keys (NULL equals NULL); with sequence columns (data's, delete's)
    only deletes that are younger than the row apply."""
    d = deletes.select(*[F.col(k).alias(f"_d_{k}") for k in keys], *([F.col(sequence[1]).alias("_seq")] if sequence else []))
    if sequence:
        d = d.groupBy(*[f"_d_{k}" for k in keys]).agg(F.max("_seq").alias("_seq"))
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_d_{k}"))
    if sequence:
        condition = condition & (F.col(sequence[0]) < F.col("_seq"))
    return data.join(d, condition, "left_anti")


def deletion_vector(blob: bytes) -> list[int]:
    """Positions of a v3 deletion vector: length, magic, a 64-bit roaring bitmap, CRC-32."""
    import struct
    import zlib

    size = struct.unpack_from(">I", blob, 0)[0]
    body = blob[4 : 4 + size]
    if body[:4] != b"\xd1\xd3\x39\x64":
        raise ValueError("not a deletion vector")
    if zlib.crc32(body) != struct.unpack_from(">I", blob, 4 + size)[0]:
        raise ValueError("the deletion vector's checksum differs")
    at, out = 12, []
    for _ in range(struct.unpack_from("<Q", body, 4)[0]):
        high = struct.unpack_from("<I", body, at)[0]
        at = _roaring(body, at + 4, high << 32, out)
    return out


def _roaring(data: bytes, at: int, base: int, out: list[int]) -> int:
    import struct

    cookie = struct.unpack_from("<I", data, at)[0]
    at += 4
    if cookie & 0xFFFF == 12347:
        n = (cookie >> 16) + 1
        flags = data[at : at + (n + 7) // 8]
        at += (n + 7) // 8
        has_offsets = n >= 4
    elif cookie == 12346:
        n, flags, has_offsets = struct.unpack_from("<I", data, at)[0], b"", True
        at += 4
    else:
        raise ValueError("unknown bitmap")
    heads = [struct.unpack_from("<HH", data, at + 4 * i) for i in range(n)]
    at += 4 * n + (4 * n if has_offsets else 0)
    for i, (key, card) in enumerate(heads):
        low = base + (key << 16)
        if flags and flags[i // 8] >> (i % 8) & 1:
            runs = struct.unpack_from("<H", data, at)[0]
            at += 2
            for _ in range(runs):
                start, more = struct.unpack_from("<HH", data, at)
                out.extend(range(low + start, low + start + more + 1))
                at += 4
        elif card + 1 > 4096:
            bits = int.from_bytes(data[at : at + 8192], "little")
            out.extend(low + b for b in range(65536) if bits >> b & 1)
            at += 8192
        else:
            out.extend(low + v for v in struct.unpack_from(f"<{card + 1}H", data, at))
            at += 2 * (card + 1)
    return at


def puffin_vectors(data: bytes) -> dict[str, list[int]]:
    """Deletion vectors of a Puffin file by the data file they belong to.

    Magic, blobs, then the footer: magic, JSON that says where the blobs are, its size, flags, magic."""
    import json
    import struct

    magic = b"PFA1"
    if data[:4] != magic or data[-4:] != magic:
        raise ValueError("not a Puffin file")
    size, flags = struct.unpack_from("<iI", data, len(data) - 12)
    start = len(data) - 12 - size
    if start < 8 or data[start - 4 : start] != magic:
        raise ValueError("the footer is broken")
    if flags & 1:
        raise ValueError("compressed footers are not read")
    out: dict[str, list[int]] = {}
    for blob in json.loads(data[start : start + size])["blobs"]:
        if blob["type"] == "deletion-vector-v1":
            if blob.get("compression-codec"):
                raise ValueError("a deletion vector is never compressed")
            raw = data[blob["offset"] : blob["offset"] + blob["length"]]
            found = deletion_vector(raw)
            props = blob.get("properties", {})
            if int(props.get("cardinality", len(found))) != len(found):
                raise ValueError("a deletion vector's cardinality differs")
            out.setdefault(props.get("referenced-data-file", ""), []).extend(found)
    return out


def vector_deletes(spark: SparkSession, puffins: str) -> DataFrame:
    """(file_path, pos) of all deletion vectors in the Puffin files of a path or glob, each read by one task."""
    from collections.abc import Iterator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                for name, positions in puffin_vectors(blob.as_py()).items():
                    for at in range(0, len(positions), 65_536):
                        part = positions[at : at + 65_536]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(part, pa.int64())], names=["file_path", "pos"])

    _ship(spark)
    return spark.read.format("binaryFile").load(puffins).select("content").mapInArrow(run, "file_path string, pos long")


def _ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the executors run."""
    import os
    import tempfile
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_tessera_files_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="ship-"), "tessera_sources.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            if "llm" not in path.parts:
                z.write(path, f"{package.name}/{path.relative_to(package)}")
    sc.addPyFile(target)
    sc._tessera_files_shipped = True


def footer_statistics(spark: SparkSession, *paths: str, most_files: int = 10_000) -> DataFrame:
    """file, row_group, column, rows, nulls, minimum, maximum (as text) from the footers of Parquet files.

    Only footers are read, by the driver through Spark's own reader, of at most ``most_files`` files."""
    found = spark.read.parquet(*[rewrite_uri(p) for p in paths]).inputFiles()
    if len(found) > most_files:
        raise ValueError(f"{len(found)} files are more than {most_files}")
    conf, rows = spark._jsc.hadoopConfiguration(), []
    for name in sorted(found):
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        for g, block in enumerate(spark._jvm.org.apache.parquet.hadoop.ParquetFileReader.readFooter(conf, at).getBlocks()):
            for column in block.getColumns():
                stats = column.getStatistics()
                known = stats is not None and stats.hasNonNullValue()
                nulls = stats.getNumNulls() if stats is not None and stats.isNumNullsSet() else None
                shown = (stats.minAsString(), stats.maxAsString()) if known else (None, None)
                rows.append((name, g, column.getPath().toDotString(), block.getRowCount(), nulls, *shown))
    return spark.createDataFrame(rows, "file string, row_group int, column string, rows long, nulls long, minimum string, maximum string")


def rewrite_uri(uri: str) -> str:
    """Object-store addresses in the spelling of Spark's connector: ``s3://`` and ``s3n://`` become ``s3a://``."""
    return re.sub(r"^s3n?://", "s3a://", uri)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON object a line."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    return spark.createDataFrame(table)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
