"""Tables that change: inserts, deletes and updates over Parquet files, with snapshots.

A commit is a small numbered file that lists data folders and delete folders. Data files are never changed: a delete
writes the (file, row number) of the rows it drops, an update writes a delete and the new rows in one commit. A
reader sees the commits up to the version it opened, whatever is committed later (an insert's rows, a delete's mask).
Two writers that start from one version cannot both commit the next one: the second is told so."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files


class ConflictError(RuntimeError):
    """Another writer has committed since this one's snapshot."""


class Table:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: DataFrame) -> Table:
        """A new table with ``rows``; its schema is theirs."""
        table = cls(spark, path)
        if table.version():
            raise FileExistsError(f"{path} is a table already")
        table._commit(0, {"schema": rows.schema.json(), "data": [table._written(rows)], "deletes": []})
        return table

    # the log

    def _path(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_log/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def version(self) -> int:
        fs, folder = self._path("")
        return max((int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(folder)), default=0) if fs.exists(folder) else 0

    def _commit(self, base: int, entry: dict) -> int:
        fs, at = self._path(f"{base + 1:012d}.json")
        try:
            out = fs.create(at, False)  # fails if there is one
        except Exception as e:
            raise ConflictError(f"version {base + 1} is committed already") from e
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        return base + 1

    def _entries(self, version: int) -> list[dict]:
        fs, _ = self._path("")
        found = []
        for n in range(1, version + 1):
            stream = fs.open(self._path(f"{n:012d}.json")[1])
            found.append(json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
            stream.close()
        return found

    def _written(self, rows: DataFrame, kind: str = "data") -> str:
        at = f"{self.path}/{kind}/{uuid.uuid4().hex}"
        rows.write.parquet(at)
        return at

    # reading

    def _visible(self, version: int) -> DataFrame:
        """Rows with filename and file_row_number, without those that are deleted."""
        entries = self._entries(version)
        if not entries:
            raise ValueError(f"{self.path} is no table")
        schema = T.StructType.fromJson(json.loads(entries[0]["schema"]))
        data, deletes = [p for e in entries for p in e["data"]], [p for e in entries for p in e["deletes"]]
        rows = self.spark.read.schema(schema).parquet(*data)
        rows = rows.select("*", F.col("_metadata.file_path").alias("filename"), F.col("_metadata.row_index").alias("file_row_number"))
        return files.positional_deletes(rows, self.spark.read.parquet(*deletes)) if deletes else rows

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default; later commits do not change what it gives."""
        newest = self.version()
        if version is not None and not 0 < version <= newest:
            raise ValueError(f"no version {version}")
        return self._visible(version or newest).drop("filename", "file_row_number")

    # writing

    def _hit(self, base: int, where: str) -> DataFrame:
        return self._visible(base).where(where)

    def insert(self, rows: DataFrame, base: int | None = None) -> int:
        """Append rows; the new version. ``base``: the version the writer has seen."""
        base = self.version() if base is None else base
        columns = T.StructType.fromJson(json.loads(self._entries(1)[0]["schema"]))
        if set(rows.columns) != set(columns.names):
            raise ValueError(f"the table has the columns {columns.names}")
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in columns.fields])
        return self._commit(base, {"data": [self._written(rows)], "deletes": []})

    def delete(self, where: str, base: int | None = None) -> int:
        """Drop the rows for which the condition is true."""
        base = self.version() if base is None else base
        gone = self._hit(base, where).select(F.col("filename").alias("file_path"), F.col("file_row_number").alias("pos"))
        return self._commit(base, {"data": [], "deletes": [self._written(gone, "deletes")]})

    def update(self, changes: dict[str, str], where: str, base: int | None = None) -> int:
        """Set columns to SQL expressions over the old row, where the condition is true; one commit."""
        base = self.version() if base is None else base
        hit = self._hit(base, where)
        kinds = dict(hit.dtypes)
        if missing := [c for c in changes if c not in kinds]:
            raise ValueError(f"unknown columns {missing}")
        new = hit.select(*[F.expr(changes[c]).cast(kinds[c]).alias(c) if c in changes else F.col(c) for c in hit.columns if c not in ("filename", "file_row_number")])
        gone = hit.select(F.col("filename").alias("file_path"), F.col("file_row_number").alias("pos"))
        return self._commit(base, {"data": [self._written(new)], "deletes": [self._written(gone, "deletes")]})
