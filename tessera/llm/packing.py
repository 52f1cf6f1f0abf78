"""Packing by cutting-stock column generation.

Documents become token ids plus an end id. Full pieces of a sequence's length stand alone; what is left
of each document is an item, rounded up to a length class. A linear program over patterns (how many
items of each class share a sequence) is solved by column generation: a dense revised simplex over
the classes, columns priced by a knapsack dynamic program. The patterns' counts are rounded down, what
demand remains is placed first-fit decreasing by class, and items take their places by rank in the class.

Only the histogram over at most ``limit / unit`` classes reaches the driver, whatever the corpus.

Cases: null text is an empty text; an empty text is the end id alone; repeated rows are packed each for
itself; ties in rank are broken by doc_id (null last) and checksum; an empty table gives no pieces."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .tokens import tokenizer

LIMIT, END_ID, UNIT = 4096, 2, 16


def _knapsack(value: np.ndarray, weight: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: best value and counts. Weights are distinct positive integers 1..capacity."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    by_weight = np.full(capacity + 1, -1.0)
    index = np.full(capacity + 1, -1)
    by_weight[weight] = value
    index[weight] = np.arange(len(weight))
    for c in range(1, capacity + 1):
        gain = by_weight[1 : c + 1] + best[c - 1 :: -1][:c]
        w = int(gain.argmax()) + 1
        if gain[w - 1] > best[c - 1] + 1e-12:
            best[c], take[c] = gain[w - 1], w
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(weight), int), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            counts[index[take[c]]] += 1
            c -= take[c]
    return float(best[capacity]), counts


def cutting_stock(demand: dict[int, int], capacity: int, most_columns: int = 6000, tolerance: float = 2e-3) -> list[tuple[dict[int, int], int]]:
    """(pattern {class: items}, copies) that hold every item of ``demand`` {class weight: items}."""
    weight = np.array(sorted(w for w, d in demand.items() if d > 0), int)
    if not len(weight):
        return []
    need = np.array([demand[w] for w in weight], float)
    k = len(weight)
    columns = np.diag((capacity // weight).astype(float))
    inverse, x, cost = np.diag(1.0 / np.diag(columns)), need / np.diag(columns), np.ones(k)
    for _ in range(most_columns):
        dual = cost @ inverse
        price = 1.0
        if dual.min() < -1e-9:  # a surplus column: more of a class than is asked for
            new, price = np.zeros(k), 0.0
            new[int(dual.argmin())] = -1.0
        else:
            best, new = _knapsack(np.maximum(dual, 0), weight, capacity)
            if best <= 1 + tolerance:
                break
        step = inverse @ new
        ok = step > 1e-10
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, step, 1), np.inf)
        out = int(ratio.argmin())
        x = x - ratio[out] * step
        x[out] = ratio[out]
        x = np.maximum(x, 0)
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
        columns[:, out], cost[out] = new, price
    plan: list[tuple[dict[int, int], int]] = []
    left = need.astype(int)
    for j in np.argsort(-x):
        n = int(np.floor(x[j] + 1e-9))
        held = columns[:, j].astype(int)
        if cost[j] == 0:
            continue
        if n and held.any():
            n = min(n, int((left[held > 0] // held[held > 0]).min()))
        if n > 0:
            left = left - n * held
            plan.append(({int(weight[i]): int(held[i]) for i in np.flatnonzero(held)}, n))
    while left.any():  # first fit decreasing over classes; equal patterns in one go
        room, held = capacity, np.zeros(k, int)
        for i in range(k - 1, -1, -1):
            n = min(int(left[i]), room // int(weight[i]))
            if n > 0:
                held[i] = n
                room -= n * int(weight[i])
        n = int((left[held > 0] // held[held > 0]).min())
        left = left - n * held
        plan.append(({int(weight[i]): int(held[i]) for i in np.flatnonzero(held)}, n))
    return plan


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens (and the ids themselves, if asked)."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")], *[T.StructField("ids", T.BinaryType())] * with_ids])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    which, rows, kept = [], [], []
                    for i, ids in enumerate(tok.encode(part.column(1).to_pylist())):
                        ids += end
                        n = len(ids) // 4
                        for s in range(0, n, limit):
                            cut = ids[4 * s : 4 * (s + limit)]
                            which.append(i)
                            rows.append((s, len(cut) // 4, zlib.crc32(cut), n))
                            if with_ids:
                                kept.append(cut)
                    columns = [part.column(0).take(pa.array(which, pa.int32())), *[pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)]]
                    yield pa.RecordBatch.from_arrays([*columns, *[pa.array(kept, pa.binary())] * with_ids], names=schema.names)
        finally:
            tok.forget()

    common.ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def place(cut: DataFrame, limit: int = LIMIT, unit: int = UNIT) -> DataFrame:
    """Add sequence_id and offset to a stored table of pieces."""
    spark = cut.sparkSession
    capacity = limit // unit
    cut = cut.withColumn("_class", F.least(F.ceil(F.col("length") / unit), F.lit(capacity)).cast("int"))
    histogram = {r["_class"]: r["n"] for r in cut.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()}
    spans: dict[int, list[tuple[int, int, int, int]]] = {}
    begun: dict[int, int] = {}
    base = 0
    for held, copies in cutting_stock(histogram, capacity):
        for c, each in held.items():
            start = begun.get(c, 0)
            begun[c] = start + copies * each
            spans.setdefault(c, []).append((start, start + copies * each, base, each))
        base += copies
    plan = spark.createDataFrame([(c, s) for c, s in spans.items()], "_class int, _spans array<struct<first: long, last: long, base: long, each: long>>")
    n = sum(histogram.values())
    order = [F.col("length").desc(), F.col("doc_id").asc_nulls_last(), F.col("start"), F.col("ids_crc32")]
    placed = common.ranked(cut, ["_class"], order, F.xxhash64("doc_id", "start", "ids_crc32"), common.buckets_for(n, 20_000))
    #: at most limit / unit classes, each with at most one span a pattern
    placed = placed.join(F.broadcast(plan), "_class")
    placed = placed.withColumn("_s", F.element_at(F.filter("_spans", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["last"])), 1))
    placed = placed.withColumn("sequence_id", F.col("_s.base") + F.floor((F.col("rank") - F.col("_s.first")) / F.col("_s.each")).cast("long"))
    from pyspark.sql import Window

    w = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), F.col("doc_id").asc_nulls_last(), "start", "rank")
    before = F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("offset", before).drop("_class", "_spans", "_s", "rank")


def pack(docs: DataFrame, path: str, limit: int = LIMIT, unit: int = UNIT, with_ids: bool = False) -> DataFrame:
    return place(common.stored(pieces(docs, path, limit, with_ids=with_ids), "pieces"), limit, unit)


def op5_cutting_stock(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.tables(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
