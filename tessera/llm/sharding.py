"""Sharding by longest-processing-time scheduling.

Rows of equal text form a group that must stay together. Groups, largest first, go to the least-loaded
shard through a heap. Groups of one size are interchangeable, so the heap works on (size, number of
groups): D distinct sizes need a total of at least D²/2 bytes, so the driver gets no more than
sqrt(2 * bytes) pairs. Groups take their shard by rank within their size, rows by their group.

Cases: null text has size 1 and shares the group of the empty text; repeated rows belong to one
group; ties in size are broken by the text's digest; an empty table gives no rows."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHARDS = 16


def schedule(sizes: list[tuple[int, int]], shards: int) -> dict[int, list[tuple[int, int]]]:
    """{size: [(first rank past, shard)]} of longest-processing-time scheduling of (size, groups)."""
    heap = [(0, s) for s in range(shards)]
    out: dict[int, list[tuple[int, int]]] = {}
    for size, n in sorted(sizes, reverse=True):
        got = [0] * shards
        if n > 4 * shards:  # what each shard takes until all loads are within one size of each other
            low = sorted(heap)
            level, spare = 0, n
            loads = [x for x, _ in low]
            lo, hi = loads[0], loads[-1] + size * n
            while lo < hi:  # highest level to which n groups fill without overshooting
                mid = (lo + hi + 1) // 2
                if sum((mid - x) // size for x in loads if mid > x) <= n:
                    lo = mid
                else:
                    hi = mid - 1
            level = lo
            heap = []
            for x, s in low:
                k = max(0, (level - x) // size)
                got[s] = k
                spare -= k
                heap.append((x + k * size, s))
            heapq.heapify(heap)
            n = spare
        for _ in range(n):
            load, s = heapq.heappop(heap)
            got[s] += 1
            heapq.heappush(heap, (load + size, s))
        ends, at = [], 0
        for s, k in enumerate(got):
            if k:
                at += k
                ends.append((at, s))
        out[size] = ends
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row."""
    with common.tidy(docs.sparkSession) as keep:
        placed = keep(_placed(docs, shards))
    # order of a shard's rows: by id, then by text; equal rows are dealt by the hash of both
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size")]
    slots = common.ranked(placed, ["shard"], order, F.xxhash64("doc_id", "text_crc32"), common.buckets_for(placed.count(), 20_000), "slot")
    return slots.select("doc_id", "size", "text_crc32", "shard", "slot")


def _placed(docs: DataFrame, shards: int) -> DataFrame:
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    size = F.when(F.col("text").isNull(), 1).otherwise(F.octet_length(text) + 1).cast("long")
    rows = common.stored(docs.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("_key")), "shard-rows")
    groups = common.stored(rows.groupBy("_key").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows")), "shard-groups")
    sizes = [(r["_bytes"], r["n"]) for r in groups.groupBy("_bytes").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()]
    total = sum(n for _, n in sizes)
    plan = spark.createDataFrame(list(schedule(sizes, shards).items()), "_bytes long, _ends array<struct<last: long, shard: int>>")
    numbered = common.ranked(groups, ["_bytes"], [F.col("_key")], F.xxhash64("_key"), common.buckets_for(total))
    chosen = numbered.join(plan, "_bytes").select("_key", F.element_at(F.filter("_ends", lambda e: F.col("rank") < e["last"]), 1)["shard"].alias("shard"))
    # a hot text is a key that adaptive execution splits, as rows are the larger side
    return common.stored(rows.join(chosen, "_key").drop("_key"), "shard-placed")


def op2_lpt_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(common.tables(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The heap, one group at a time, largest first; groups of one size are ranked by digest over what the shards took of
#: that size. CRC-32 by its table, built by its rule.
OP2_SQL = """
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t FROM range(256) r(k)),
b AS (SELECT doc_id, text IS NULL AS void, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, CASE WHEN void THEN 1 ELSE len(h) // 2 + 1 END::BIGINT AS size, md5(text) AS k,
      xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
          lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS text_crc32 FROM b CROSS JOIN crc),
g AS (SELECT k, sum(size)::BIGINT AS bytes FROM d GROUP BY k),
o AS (SELECT bytes, row_number() OVER (ORDER BY bytes DESC) AS i FROM g),
heap(i, bytes, shard, loads) AS (
  SELECT 0::BIGINT, 0::BIGINT, 0, list_transform(range(16), lambda x: 0::BIGINT)
  UNION ALL SELECT o.i, o.bytes, list_position(loads, list_min(loads))::INTEGER,
    list_transform(loads, lambda x, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN x + o.bytes ELSE x END) FROM heap JOIN o ON o.i = heap.i + 1),
took AS (SELECT bytes, shard - 1 AS shard, row_number() OVER (PARTITION BY bytes ORDER BY shard) AS r FROM heap WHERE i > 0),
placed AS (SELECT k, shard FROM (SELECT k, bytes, row_number() OVER (PARTITION BY bytes ORDER BY k) AS r FROM g) a JOIN took USING (bytes, r))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INTEGER AS shard, (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, text_crc32, size) - 1)::BIGINT AS slot,
  NULL::INTEGER AS grown_shard FROM d JOIN placed USING (k)"""
