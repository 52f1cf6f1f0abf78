"""Pinned tables: named cached copies of a table or of files, with a column subset and a level; their vector indexes."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import vector

TIERS = {"memory": StorageLevel.MEMORY_ONLY, "host": StorageLevel.MEMORY_AND_DISK, "disk": StorageLevel.DISK_ONLY}
#: Spark's cache compresses column by column; ``none`` keeps rows as they are.
COMPRESSIONS = ("auto", "none")
_PINS: dict[str, DataFrame] = {}
_INDEXES: dict[tuple[str, str, str], vector.IvfIndex] = {}


def pin_table(spark: SparkSession, source: str, name: str | None = None, columns: list[str] | None = None, tier: str = "host", unique_cols: list[str] | None = None, compression: str = "auto") -> DataFrame:
    """Cache ``source`` (a view's name or a Parquet path) and make it a view ``name``; a pin of this name goes, and
    with it its indexes."""
    if tier not in TIERS:
        raise ValueError(f"tier must be one of {sorted(TIERS)}")
    if compression not in COMPRESSIONS:
        raise ValueError(f"compression must be one of {COMPRESSIONS}")
    df = spark.read.parquet(source) if "/" in source else spark.table(source)
    if columns and (missing := [c for c in columns if c not in df.columns]):
        raise ValueError(f"unknown columns {missing}")
    df = df.select(*columns) if columns else df
    if unique_cols and not df.groupBy(*unique_cols).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError(f"{unique_cols} are not unique")
    name = name or source.rstrip("/").rpartition("/")[2].removesuffix(".parquet")
    unpin_table(name)
    spark.conf.set("spark.sql.inMemoryColumnarStorage.compressed", str(compression == "auto").lower())
    _PINS[name] = df.persist(TIERS[tier])
    df.createOrReplaceTempView(name)
    return df


def unpin_table(name: str) -> None:
    drop_ann_index(name)
    if df := _PINS.pop(name, None):
        df.unpersist()


def reset_cache(spark: SparkSession) -> None:
    for name in list(_PINS):
        unpin_table(name)
    spark.catalog.clearCache()


def pinned(name: str) -> DataFrame:
    if name not in _PINS:
        raise ValueError(f"{name} is not pinned")
    return _PINS[name]


def create_ann_index(table: str, column: str, metric: str = "l2", n_lists: int = 16) -> vector.IvfIndex:
    """An inverted-file index of a pinned table's column; one a metric."""
    index = vector.create_index(pinned(table), column, metric, n_lists)
    _INDEXES[table, column, metric] = index
    return index


def drop_ann_index(table: str, column: str | None = None, metric: str | None = None) -> int:
    """Drop one metric's index of a column, all of a column or all of a table; returns how many."""
    gone = [k for k in _INDEXES if k[0] == table and column in (None, k[1]) and metric in (None, k[2])]
    for k in gone:
        _INDEXES.pop(k).drop()
    return len(gone)


def knn_search(table: str, column: str, query: list[float], k: int = 10, metric: str = "l2", output_columns: list[str] | None = None, use_index: bool = False, n_probes: int = 8) -> DataFrame:
    """k nearest rows of a pinned table: exact, or by its index if that is asked for."""
    df = pinned(table)
    if not use_index:
        return vector.knn(df, column, query, k, metric, output_columns)
    if metric not in vector.METRICS:
        raise ValueError(f"metric must be one of {vector.METRICS}, not {metric!r}")
    if (table, column, metric) not in _INDEXES:
        raise vector.StaleIndexError(f"{table}.{column} has no index for {metric}")
    return _INDEXES[table, column, metric].search(query, k, n_probes, output_columns or df.columns)
