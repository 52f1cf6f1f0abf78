"""Exchanges: how rows are dealt to tasks, or handed to the consumers of a fragment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("hash", "range", "broadcast", "single", "local", "crc32")
#: Rows that a broadcast may have.
MOST_BROADCAST = 1_000_000


def crc32_partition(keys: list[str], parts: int) -> Column:
    """Partition of a row by the CRC-32 of its keys' text (NULL apart from the empty text), as a frontend computes it."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("~")) for k in keys])
    return F.pmod(F.crc32(text.cast("binary")), F.lit(parts)).cast("int")


def exchange(df: DataFrame, mode: str, keys: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Deal rows: equal keys together (hash, crc32), in key order (range), all to each task of a join
    (broadcast, only up to ``MOST_BROADCAST`` rows), all in one (single), or not at all (local)."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode in ("hash", "range", "crc32") and not keys:
        raise ValueError(f"{mode} needs keys")
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if mode == "hash":
        return df.repartition(n, *keys)
    if mode == "range":
        return df.repartitionByRange(n, *keys)
    if mode == "crc32":
        return df.repartitionById(n, crc32_partition(keys, n))
    if mode == "single":
        return df.repartition(1)
    if mode == "broadcast":
        if df.limit(MOST_BROADCAST + 1).count() > MOST_BROADCAST:
            raise ValueError(f"over {MOST_BROADCAST} rows are not broadcast; deal them by hash")
        return F.broadcast(df)
    return df


def routed(df: DataFrame, mode: str, consumers: int, keys: list[str] | None = None) -> list[DataFrame]:
    """What each of ``consumers`` gets of ``df``: its share by key, everything (broadcast), or all for the first (single)."""
    if mode == "broadcast":
        return [df] * consumers
    if mode in ("single", "local"):
        return [df, *[df.limit(0)] * (consumers - 1)]
    if not keys:
        raise ValueError(f"{mode} needs keys")
    of = crc32_partition(keys, consumers) if mode == "crc32" else F.pmod(F.hash(*keys), F.lit(consumers))
    return [df.where(of == i) for i in range(consumers)]
