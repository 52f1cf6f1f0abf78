"""Approximate nearest neighbours by learned partitions.

On a bounded sample: a graph of nearest neighbours by inner product, cut into balanced parts by recursive
bisection (median along the leading direction, refined by swaps that lower the cut), and a small
network that predicts in which parts a vector's neighbours lie. The number of parts follows from the number of
rows (``parts_for``), at every size. Every row is indexed under its most probable part. A query goes to its most
probable parts until their probabilities add up to ``reach``; all candidates there are reranked by the
exact inner product in double precision. Queries that find too few are searched in all parts.

``reach`` is set on held-out rows: vectors outside the sample are searched exactly in the whole table, and
``reach`` is the least that finds ``TARGET`` of their neighbours. So a table with clusters is asked in few parts
and one without structure in most; ``Router.recall`` and ``Router.probed`` say what was measured.

Parts of any size are searched in blocks of candidates and queries, so a hot part never meets in one task.

Cases: null, zero, null-holding and non-finite vectors take no part, nor do vectors of another length
than most have; ties go to the smaller vec_id; repeated rows are candidates each for itself, except a
query's own id, and are asked once; a vec_id with several different vectors is asked once with each, so it
has as many lists, each ranked from 1; an empty table gives no rows; under 8 rows make one part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .neardup import _grouped

NEIGHBOURS, K, LEAST_PARTS, MOST_PARTS, TARGET = 10, 20, 4, 256, 0.95
#: Sampled rows a part, and in all; held-out rows that are searched exactly.
PER_PART, SAMPLE, HELD_OUT = 512, 32_768, 256
CANDIDATES, QUERIES = 4096, 2048


def parts_for(n: int) -> int:
    """A power of two near a quarter of the root of ``n``, 4 to 256; parts hold four rows at least."""
    parts = 1
    while parts < MOST_PARTS and (parts < LEAST_PARTS or 64 * parts * parts <= n) and 8 * parts <= n:
        parts *= 2
    return parts


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest inner products of each row, itself excluded."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 512] = np.argpartition(-s, k, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Part of each row; sizes differ by at most one at every bisection."""
    label = np.zeros(len(x), np.int64)
    n_edges = graph.shape[1]
    src, dst = np.repeat(np.arange(len(x)), n_edges), graph.ravel()
    width = 1
    while width < parts:
        for part in range(width):
            rows = np.flatnonzero(label == part)
            if len(rows) < 2:
                continue
            v = x[rows] - x[rows].mean(0)
            direction = np.random.default_rng(part).normal(size=x.shape[1])
            for _ in range(10):
                direction = v.T @ (v @ direction)
                direction /= max(np.linalg.norm(direction), 1e-30)
            side = np.zeros(len(x), np.int8)
            order = rows[np.argsort(v @ direction, kind="stable")]
            side[order[len(order) // 2 :]] = 1
            inside = np.zeros(len(x), bool)
            inside[rows] = True
            keep = inside[src] & inside[dst]
            a, b = src[keep], dst[keep]
            for _ in range(rounds):
                apart = np.where(side[a] != side[b], 1, -1)
                gain = np.bincount(a, apart, len(x)) + np.bincount(b, apart, len(x))
                zero, one = rows[side[rows] == 0], rows[side[rows] == 1]
                zero, one = zero[np.argsort(-gain[zero], kind="stable")], one[np.argsort(-gain[one], kind="stable")]
                m = min(len(zero), len(one))
                swaps = int((gain[zero[:m]] + gain[one[:m]] > 2).sum()) // 2
                if not swaps:
                    break
                side[zero[:swaps]], side[one[:swaps]] = 1, 0
            label[rows[side[rows] == 1]] += width
        width *= 2
    return label


class Router:
    """A network with one hidden layer: vector -> probability of each part."""

    def __init__(self, d: int, parts: int, hidden: int = 64):
        rng = np.random.default_rng(3)
        self.parts, self.scale, self.reach = parts, 1.0, 1.0
        self.recall = self.probed = None
        self.p = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, parts)), np.zeros(parts)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x * self.scale @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def train(self, x: np.ndarray, target: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 0.004) -> None:
        self.scale = 1 / max(float(x.std()), 1e-30)
        x = x * self.scale
        rng = np.random.default_rng(4)
        m1, m2, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                i = order[at : at + batch]
                h = np.maximum(x[i] @ self.p[0] + self.p[1], 0)
                z = h @ self.p[2] + self.p[3]
                e = np.exp(z - z.max(1, keepdims=True))
                dz = (e / e.sum(1, keepdims=True) - target[i]) / len(i)
                dh = (dz @ self.p[2].T) * (h > 0)
                t += 1
                for k, g in enumerate([x[i].T @ dh + 1e-4 * self.p[0], dh.sum(0), h.T @ dz + 1e-4 * self.p[2], dz.sum(0)]):
                    m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.999 * m2[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts from the most to the least probable, and the probability of those before each."""
        z = self.logits(x)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        order = np.argsort(-p, axis=1, kind="stable")
        sorted_p = np.take_along_axis(p, order, axis=1)
        return order, np.cumsum(sorted_p, axis=1) - sorted_p

    def set_reach(self, asked: np.ndarray, near: np.ndarray, target: float) -> None:
        """``near``: (query, vector) pairs of true neighbours, as (index in ``asked``, their vectors)."""
        order, ahead = self.route(asked)
        place = np.argsort(order, axis=1)
        own = self.route(near[1])[0][:, 0]
        need = np.sort(ahead[near[0], place[near[0], own]])
        at = min(len(need) - 1, int(np.ceil(target * len(need))) - 1)
        self.reach = float(np.nextafter(need[at], 2.0))
        self.recall, self.probed = float((need < self.reach).mean()), float((ahead < self.reach).sum(1).mean())


def learn(x: np.ndarray, parts: int) -> Router:
    graph = neighbour_graph(x, min(NEIGHBOURS, len(x) - 1))
    label = balanced_parts(x, graph, parts)
    aim = np.eye(parts)[label] * 2
    for j in range(graph.shape[1]):
        aim[np.arange(len(x)), label[graph[:, j]]] += 1
    router = Router(x.shape[1], parts)
    router.train(x, aim / aim.sum(1, keepdims=True))
    return router


def fit(rows: DataFrame, n: int, k: int = K, target: float = TARGET) -> Router | None:
    """Router of a stored table of ``n`` usable rows; None where one part holds them all."""
    parts = parts_for(n)
    if parts == 1:
        return None
    draw = F.pmod(F.xxhash64(F.lit("ann"), "vec_id", "embedding"), F.lit(1_000_000))
    # four fifths at most, so that some rows are always held out; drawn by hash, so the bound holds but for chance
    share = min(0.8, min(SAMPLE, PER_PART * parts) / n)
    held_share = min(0.2, HELD_OUT / n)
    taken = lambda where: rows.where(where).orderBy("vec_id").limit(2 * SAMPLE).toArrow()
    sample = taken(draw < int(1_000_000 * share))
    held = taken(draw >= 1_000_000 - int(1_000_000 * held_share))
    if sample.num_rows < 2 * parts:
        return None
    router = learn(_matrix(sample.column("embedding").combine_chunks()), parts)
    if held.num_rows:
        ids, x = held.column("vec_id").to_numpy(), _matrix(held.column("embedding").combine_chunks())
        asked = rows.sparkSession.sparkContext.broadcast((ids, x))  # about HELD_OUT vectors

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qi, qx = asked.value
            near: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty((0, qx.shape[1])))] * len(qi)
            for batch in batches:
                ci, cx = batch.column(0).to_numpy(), _matrix(batch.column(1))
                if not len(ci):
                    continue
                score = qx @ cx.T
                score[qi[:, None] == ci[None, :]] = -np.inf
                for j, s in enumerate(score):
                    top = np.argpartition(-s, k - 1)[:k] if len(s) > k else np.arange(len(s))
                    top = top[np.isfinite(s[top])]
                    both, vectors = np.concatenate([near[j][0], s[top]]), np.vstack([near[j][1], cx[top]])
                    keep = np.argsort(-both, kind="stable")[:k]
                    near[j] = (both[keep], vectors[keep])
            which = np.concatenate([np.full(len(s), j) for j, (s, _) in enumerate(near)])
            scores, vectors = np.concatenate([s for s, _ in near]), np.vstack([v for _, v in near])
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(scores), pa.array(list(vectors), pa.list_(pa.float64()))], names=["q", "score", "embedding"])

        w = Window.partitionBy("q").orderBy(F.desc("score"))
        exact = rows.mapInArrow(best, "q int, score double, embedding array<double>")
        exact = exact.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q", "embedding").toArrow()
        if exact.num_rows:
            router.set_reach(x, (exact.column("q").to_numpy(), _matrix(exact.column("embedding").combine_chunks())), target)
    return router


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null and size(embedding) > 0")
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(~bad & F.exists("embedding", lambda c: c != 0))
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.where(F.size("embedding") == (sizes[0]["d"] if sizes else 0))


def search(vectors: DataFrame, every: int = 20, k: int = K, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by ``every``."""
    with common.tidy(vectors.sparkSession) as keep:
        return keep(common.stored(_search(vectors, every, k, target), "neighbours"))


def _search(vectors: DataFrame, every: int, k: int, target: float) -> DataFrame:
    spark = vectors.sparkSession
    common.ship(spark)
    rows = common.stored(usable(vectors), "vectors")
    n = rows.count()
    router = fit(rows, n, k, target)
    parts = router.parts if router else 1
    shared = spark.sparkContext.broadcast(router)  # bounded by MOST_PARTS

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            if r is None:
                order, probes = np.zeros((len(ids), 1), np.int32), np.ones(len(ids), np.int64)
            else:
                order, ahead = r.route(_matrix(batch.column(1)))
                order, probes = order.astype(np.int32), (ahead < r.reach).sum(1)
            asked = [o[:p].tolist() if i % every == 0 else None for i, o, p in zip(ids.tolist(), order, probes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(order[:, 0]), pa.array(asked, pa.list_(pa.int32()))], names=["vec_id", "embedding", "part", "probes"])

    indexed = common.stored(rows.mapInArrow(assign, "vec_id long, embedding array<double>, part int, probes array<int>"), "indexed")
    queries = indexed.where("probes is not null").groupBy("vec_id", "embedding").agg(F.min("probes").alias("probes"))
    queries = common.stored(queries.withColumn("version", F.xxhash64("embedding")), "queries")
    found = _ranked_best(indexed, queries, k)
    if parts > 1:
        found = common.stored(found, "found")
        few = found.groupBy("query_id", "version").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= min(k, n - 1))
        short = queries.join(few.select(F.col("query_id").alias("vec_id"), "version"), ["vec_id", "version"], "left_anti")
        if not short.isEmpty():
            every_part = F.array(*[F.lit(p) for p in range(parts)])
            whole = _ranked_best(indexed, short.withColumn("probes", every_part), k)
            found = found.join(few.select("query_id", "version"), ["query_id", "version"], "left_semi").unionByName(whole)
    return found.drop("version")


def _ranked_best(indexed: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """version, query_id, rank, vec_id, score; a query is a (vec_id, version)."""
    asked = queries.select("vec_id", "version", "embedding", F.explode("probes").alias("part"))
    sizes = indexed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / CANDIDATES).cast("long").alias("cb"))
    sizes = sizes.join(asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("long").alias("qb")), "part")
    sizes = F.broadcast(sizes)  # at most MOST_PARTS rows
    number = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.col(blocks))
    held = indexed.join(sizes, "part").select("vec_id", F.lit(0).cast("long").alias("version"), "embedding", "part", number("cb").alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb") - 1)).alias("q"), F.lit(False).alias("is_query"))
    asks = asked.join(sizes, "part").select("vec_id", "version", "embedding", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cb") - 1)).alias("c"), number("qb").alias("q"), F.lit(True).alias("is_query"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, "task"):
            task, ids, versions, is_query = (table.column(c).to_numpy() for c in ("task", "vec_id", "version", "is_query"))
            x = _matrix(table.column("embedding").combine_chunks())
            start = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
            out: list[list[np.ndarray]] = [[], [], [], []]
            for a, b in zip(start, np.append(start[1:], len(task)), strict=True):
                flag = is_query[a:b]
                qi, qv, qx, ci, cx = ids[a:b][flag], versions[a:b][flag], x[a:b][flag], ids[a:b][~flag], x[a:b][~flag]
                if not len(qi) or not len(ci):
                    continue
                for at in range(0, len(qi), 256):
                    rough = qx[at : at + 256] @ cx.T
                    rough[qi[at : at + 256, None] == ci[None, :]] = -np.inf
                    for j, s in enumerate(rough):
                        low = np.partition(s, -k)[-k] if len(s) > k else -np.inf
                        near = np.flatnonzero((s >= low - 1e-9 * max(1.0, abs(low)) if np.isfinite(low) else np.isfinite(s)) & np.isfinite(s))
                        score = (cx[near] * qx[at + j]).sum(axis=1)
                        order = np.lexsort((ci[near], -score))[:k]
                        out[0].append(np.full(len(order), qi[at + j]))
                        out[1].append(ci[near][order])
                        out[2].append(score[order])
                        out[3].append(np.full(len(order), qv[at + j]))
            joined = [np.concatenate(o) if o else np.empty(0) for o in out]
            yield pa.RecordBatch.from_arrays([pa.array(joined[0].astype(np.int64)), pa.array(joined[1].astype(np.int64)), pa.array(joined[2].astype(np.float64)), pa.array(joined[3].astype(np.int64))], names=["query_id", "vec_id", "score", "version"])

    tasks = held.unionByName(asks).withColumn("task", F.xxhash64("part", "c", "q")).repartition("task").sortWithinPartitions("task", "is_query", "vec_id")
    made = tasks.select("task", "vec_id", "version", "embedding", "is_query").mapInArrow(best, "query_id long, vec_id long, score double, version long")
    w = Window.partitionBy("query_id", "version").orderBy(F.desc("score"), "vec_id")
    return made.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("version", "query_id", "rank", "vec_id", "score")


def op3_learned_partitions(spark, sf_dir: str) -> DataFrame:
    return search(common.tables(spark, sf_dir, "embeddings"))
