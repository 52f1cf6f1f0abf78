"""Mixing sources to target weights by subset-sum budget fitting.

Per source: whole epochs first, then the remaining budget is met by a subset of the documents. The
subset works on the histogram (words, documents): every length gives its share rounded down, the rest
is filled largest first down to a window, and a bounded-knapsack dynamic program over the lengths still
left hits what remains exactly, or as near below as lengths allow. Documents of a length are
taken in the order of a seeded hash, so reruns agree: what is taken ends, per source and length, at one key, and
a document is held against that key where it lies. No text is shuffled as long as these keys (at most
sqrt(2 * words) lengths a source) are small enough for adaptive execution to broadcast.

A source's histogram is fitted in one task, in memory of one window; documents never are.
One row per source reaches the driver, for the shares.

Cases: null text has no words and is never taken; null source is a source of its own, last in order;
repeated rows count each for itself (equal ones at the key are numbered in blocks, and as many as are still
wanted are taken); ties are broken by a seeded hash, then by text and id, also for null ids; empty tables give
no rows; columns of any name are kept."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, SHARE, MOST, SEED, WINDOW = (3, 1, 2), Fraction(3, 2), 2, 20240917, 1 << 16


def shares(sizes: list[int], weights: list[int], share: Fraction = SHARE, most: int = MOST) -> list[Fraction]:
    """Targets by weight of ``share`` of all sizes, none above ``most`` times its size, the excess reshared."""
    left, out, free = share * sum(sizes), [Fraction(0)] * len(sizes), set(range(len(sizes)))
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] > most * sizes[i] * w}
        if not over:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = Fraction(most * sizes[i])
        left -= sum(out[i] for i in over)
        free -= over
    return out


def fit(histogram: dict[int, int], budget: int, window: int = WINDOW) -> dict[int, int]:
    """How many documents of each length to take so that their words sum to ``budget``, or as near
    below as possible within the last window."""
    lengths = sorted((x for x in histogram if x > 0), reverse=True)
    total = sum(x * histogram[x] for x in lengths)
    budget = max(0, min(budget, total))
    take = {x: histogram[x] * budget // total if total else 0 for x in lengths}
    left = budget - sum(x * n for x, n in take.items())
    for x in lengths:  # down to half a window, largest first
        if left - x >= window // 2:
            n = min(histogram[x] - take[x], (left - window // 2) // x)
            take[x] += n
            left -= n * x
    given = True
    while given and left < window // 2:  # or up to it: one of each length is given back at a time
        given = False
        for x in lengths:
            if take[x] and left + x <= window // 2:
                take[x] -= 1
                left += x
                given = True
    # bounded knapsack over what is left: bit b of `reach` says that b words can be made, by[b] which step made it
    reach, steps, mask, by = 1, [], (1 << (left + 1)) - 1, np.full(left + 1, -1, np.int32)
    for x in lengths:
        spare, k = min(histogram[x] - take[x], left // x), 1
        while spare > 0:
            n = min(k, spare)
            new = (reach << (x * n)) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(left // 8 + 1, "little"), np.uint8), bitorder="little")
                by[np.flatnonzero(bits)] = len(steps)
                reach |= new
            steps.append((x, n))
            spare -= n
            k *= 2
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    while at:  # a bit's step reached it first, so what it came from was made by earlier ones
        x, n = steps[by[at]]
        take[x] += n
        at -= x * n
    return take


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target and taken (words, repeats counted); where docs has a column of such a
    name, it stays and ours has a number after it (``common.free_name``)."""
    spark = docs.sparkSession
    used = ["doc_id", "text", "source"]
    words = F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("long")
    # order of documents of one length: a seeded hash, its ties by text and id
    draw = F.xxhash64(F.lit(seed), "doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1))
    key = F.struct(F.col("draw"), F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("digest"), F.col("doc_id").alias("id"))
    keyed = common.nested(docs, used).withColumn("size", words).withColumn("draw", draw).withColumn("key", key)
    with common.tidy(spark) as keep:
        slim = common.stored(keyed.select("source", "size", "draw", "key").groupBy("source", "size", "draw", "key").agg(F.count(F.lit(1)).alias("c")), "mix-rows")
        cuts = keep(_cuts(slim, spark, weights, share, most))
    cut = cuts.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "source_size", "target", "epochs", "last", "k", "c")
    met = keyed.join(cut, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
    before = F.when(F.col("last").isNull() | (F.col("key") > F.col("last")), F.lit(0)).otherwise(F.lit(1))
    names = {c: common.free_name(docs.columns, c) for c in ("size", "source_size", "target", "taken")}

    def shown(df: DataFrame, extra: Column) -> DataFrame:
        taken = F.col("size") * (F.col("epochs") + extra)
        return df.select(*common.unnested(docs.columns, used), *[F.col(c).alias(names[c]) for c in ("size", "source_size", "target")], taken.cast("long").alias(names["taken"]))

    if cuts.where("k < c").isEmpty():
        return shown(met, before)
    # rows that repeat at a cut, of which some are taken: they are equal, so any number of them will do
    some = F.coalesce((F.col("k") < F.col("c")) & (F.col("key") == F.col("last")), F.lit(False))
    equal = common.stored(met.where(some).withColumn("i", F.monotonically_increasing_id()), "mix-equal")
    numbered = common.ranked(equal, ["_source", "_size"], [F.col("i")], F.xxhash64("i"), common.buckets_for(equal.count(), 20_000))
    return shown(met.where(~some), before).unionByName(shown(numbered, (F.col("rank") < F.col("k")).cast("int")))


def _cuts(rows: DataFrame, spark, weights, share, most) -> DataFrame:
    """Per source and length: source_size, target, epochs, and the last key of which some are taken: ``k`` of ``c``."""
    histogram = common.stored(rows.groupBy("source", "size").agg(F.sum("c").alias("n")), "mix-histogram")
    found = sorted(((r["source"], int(r["s"]), r["n"]) for r in histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s"), F.sum("n").alias("n")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    targets = shares([s for _, s, _ in found], [weights[i % len(weights)] for i in range(len(found))], share, most)
    plan = []
    for (source, size, _), t in zip(found, targets, strict=True):
        words = round(t)
        epochs = min(most, words // size) if size else 0
        plan.append((source, size, float(t), int(epochs), int(words - epochs * size)))
    plan = spark.createDataFrame(plan, "_source string, source_size long, target double, _epochs long, _rest long")

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        take = fit(dict(zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True)), int(pdf["_rest"].iloc[0]))
        return pdf.assign(take=[take.get(x, 0) for x in pdf["size"]]).rename(columns={"_epochs": "epochs"})[["source", "size", "source_size", "target", "epochs", "take"]]

    common.ship(spark)
    # one row a source: left to adaptive execution to broadcast
    chosen = histogram.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    chosen = chosen.withColumn("_group", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    chosen = common.stored(chosen.groupBy("_group").applyInPandas(fitted, "source string, size long, source_size long, target double, epochs long, take long"), "mix-fitted")
    # rows ahead of a key: those of earlier buckets of the draw, and of its own bucket
    n = sum(n for _, _, n in found)
    bits = min(40, common.buckets_for(n, 20_000).bit_length())
    rows = rows.withColumn("b", F.shiftright("draw", 62 - bits))
    wanted = chosen.where("take > 0").select(F.col("source").alias("_source"), F.col("size").alias("_size"), "take")
    within = Window.partitionBy("source", "size", "b").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("source", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source", "size", "b").agg(F.sum("c").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # only the bucket in which the take ends is ordered
    starts = starts.join(wanted, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))).where("start < take and take <= start + n")
    ends = starts.select(F.col("_source").alias("s"), F.col("_size").alias("z"), F.col("b").alias("_b"), "start", "take")
    last = rows.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("b") == F.col("_b"))).withColumn("ahead", F.col("start") + F.coalesce(F.sum("c").over(within), F.lit(0)))
    last = last.where("ahead < take and take <= ahead + c").select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("key").alias("last"), (F.col("take") - F.col("ahead")).alias("k"), "c")
    out = chosen.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left")
    return common.stored(out.select("source", "size", "source_size", "target", "epochs", "last", "k", "c"), "mix-cuts")


def op7_subset_sum(spark, sf_dir: str) -> DataFrame:
    docs = common.tables(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
