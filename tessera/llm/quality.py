"""Quality classifier by positive-unlabelled learning.

A small network over counts of a whole text (character classes, repetition, word and line shapes) minimises
the non-negative unbiased risk: trusted positives, unlabelled web text and an estimated class prior. The
prior is the smallest ratio between the unlabelled and the positive share below a score of a first,
plain positive-versus-unlabelled fit. Labels of either kind, where there are any, then scale the scores.

Fitted on at most ``most`` rows of each kind, chosen by a hash of doc_id; the driver gets ``len(NAMES)``
numbers for each. Every document is scored.

Cases: null and empty texts get a score like any other (all counts 0); without labelled rows every score
is 0.5; a document with labels of both kinds counts as unlabelled; very long texts are read whole; repeated rows
are scored each for itself and drawn for the fit once a text; samples are ordered before they are cut, so reruns agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MOST, THRESHOLD = 6000, 0.3
_MARKS = b"!#$%&*|,.?:;@=/-\"'()<>[]{}_+"
NAMES = ["log_bytes", "upper", "lower", "digit", "space", "line", "high", "control", *[f"mark_{chr(c)}" for c in _MARKS], "log_words", "word_length", "word_spread", "distinct", "top", "same_next", "same_pair", "distinct_pairs", "line_words", "distinct_lines", "marked_words", "log_distinct"]
_MARK_AT = np.frombuffer(_MARKS, np.uint8)


def counts(text: str | None) -> np.ndarray:
    out = np.zeros(len(NAMES), np.float32)
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return out
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    by = np.bincount(raw, minlength=256)
    out[:8] = np.log1p(n), by[65:91].sum() / n, by[97:123].sum() / n, by[48:58].sum() / n, by[32] / n, by[10] / n, by[128:].sum() / n, (by[:9].sum() + by[14:32].sum()) / n
    k = 8 + len(_MARKS)
    out[8:k] = by[_MARK_AT] / n
    w = common.word_hashes(data)
    if len(w):
        m = len(w)
        _, each = np.unique(w, return_counts=True)
        letters = n - by[[9, 10, 11, 12, 13, 32]].sum()
        pairs = w[:-1] * np.uint64(31) + w[1:] if m > 1 else w
        lines = data.split(b"\n")
        words = data.split()
        lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.ones(1)
        marked = sum(1 for x in words if not (x[-1:].isalnum() or x[-1] >= 128 or x[-1] in b".,?!;:"))
        out[k:] = (np.log1p(m), letters / m, lengths.std(), len(each) / m, each.max() / m, (w[1:] == w[:-1]).mean() if m > 1 else 0, (w[2:] == w[:-2]).mean() if m > 2 else 0, len(np.unique(pairs)) / len(pairs), np.log1p(m / len(lines)), len(set(lines)) / len(lines), marked / m, np.log1p(len(each)))
    return out


class Network:
    """One hidden layer with tanh; ``score`` gives 0 to 1."""

    def __init__(self, d: int, hidden: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, 0.5 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self.mean, self.scale, self.a, self.b = np.zeros(d), np.ones(d), 1.0, 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.p[0] + self.p[1])
        return h @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margin(x) + self.b, -30, 30)))

    def train(self, pos: np.ndarray, unl: np.ndarray, prior: float | None, epochs: int = 60, batch: int = 512, rate: float = 0.01, seed: int = 11) -> None:
        """Non-negative unbiased risk with the sigmoid loss; ``prior`` None: plain positive against unlabelled."""
        rng = np.random.default_rng(seed)
        m1, m2 = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        steps = max(1, max(len(pos), len(unl)) // batch)
        t = 0
        for _ in range(epochs):
            for _ in range(steps):
                i, j = rng.integers(0, len(pos), min(batch, len(pos))), rng.integers(0, len(unl), min(batch, len(unl)))
                x = np.clip((np.vstack([pos[i], unl[j]]) - self.mean) / self.scale, -8, 8)
                h = np.tanh(x @ self.p[0] + self.p[1])
                g = h @ self.p[2] + self.p[3][0]
                s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
                slope = s * (1 - s)
                n = len(i)
                dg = np.empty(len(g))
                if prior is None:
                    dg[:n], dg[n:] = (s[:n] - 1) / n, s[n:] / len(j)
                else:
                    negative = s[n:].mean() - prior * s[:n].mean()  # risk of the unlabelled as negatives, less the positives' part
                    if negative >= 0:
                        dg[:n], dg[n:] = -2 * prior * slope[:n] / n, slope[n:] / len(j)
                    else:  # over-fitted: climb back
                        dg[:n], dg[n:] = prior * slope[:n] / n, -slope[n:] / len(j)
                dh = np.outer(dg, self.p[2]) * (1 - h * h)
                grads = [x.T @ dh + 1e-4 * self.p[0], dh.sum(0), h.T @ dg + 1e-4 * self.p[2], np.array([dg.sum()])]
                t += 1
                for k, gr in enumerate(grads):
                    m1[k] = 0.9 * m1[k] + 0.1 * gr
                    m2[k] = 0.999 * m2[k] + 0.001 * gr * gr
                    self.p[k] = self.p[k] - rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Share of positives among the unlabelled: smallest upper-tail ratio of scores."""
    best = 1.0
    for q in np.linspace(0.05, 0.95, 19):
        t = np.quantile(pos, q)
        best = min(best, ((unl >= t).mean() + 1 / np.sqrt(len(unl))) / max((pos >= t).mean(), 1e-9))
    return float(np.clip(best, 0.05, 0.98))


def fit_rows(pos: np.ndarray, neg: np.ndarray, unl: np.ndarray) -> Network:
    d = len(NAMES)
    net = Network(d)
    if not len(pos) or not len(unl):
        net.a = 0.0
        return net
    net.mean, net.scale = unl.mean(0), unl.std(0) + 1e-6
    first = Network(d, seed=5)
    first.mean, first.scale = net.mean, net.scale
    first.train(pos, unl, None, epochs=15)
    net.train(pos, unl, prior := class_prior(first.margin(pos), first.margin(unl)))
    net.prior = prior
    if len(neg):  # logistic scaling on labelled rows of both kinds
        g = np.concatenate([net.margin(pos), net.margin(neg)])
        y = np.concatenate([np.ones(len(pos)), np.zeros(len(neg))])
        share = np.where(y > 0, 0.5 / len(pos), 0.5 / len(neg))
        a, b = 1.0, 0.0
        for _ in range(500):
            r = (1 / (1 + np.exp(-np.clip(a * g + b, -30, 30))) - y) * share
            a, b = a - 0.5 * float(r @ g) - 0.5 * 1e-3 * a, b - 0.5 * float(r.sum())
        net.a, net.b = max(a, 1e-3), b
    return net


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Network:
    """``labels``: doc_id, quality of the rows to learn from; other documents of ``docs`` are the web text."""
    spark = docs.sparkSession
    common.ship(spark)
    # a document with labels of both kinds counts as unlabelled
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("quality").alias("low")).where("quality = low").drop("low")
    sizes = {r["kind"]: r["n"] for r in docs.select("doc_id").join(known, "doc_id", "left").groupBy(F.coalesce(F.col("quality"), F.lit(2)).alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return fit_rows(*[np.zeros((0, len(NAMES)), np.float32)] * 3)
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1_000_000))
    bound = F.coalesce(*[F.when(F.col("kind") == k, F.lit(int(1_000_000 * min(1.0, most / n)))) for k, n in sizes.items()])
    # which documents are drawn is settled before any text moves
    drawn = docs.select("doc_id").join(known, "doc_id", "left").withColumn("kind", F.coalesce(F.col("quality"), F.lit(2))).where(draw < bound).select("doc_id", "kind").distinct()
    kind = {r["doc_id"]: r["kind"] for r in drawn.orderBy("doc_id").limit(4 * most).collect()}
    wanted = spark.sparkContext.broadcast(kind)  # at most 4 * most ids
    schema = "doc_id long, kind int, x binary"

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = wanted.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            keep = [i for i, d in enumerate(ids) if d in of]
            if keep:
                texts = batch.column(1).take(pa.array(keep)).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.int64()), pa.array([of[ids[i]] for i in keep], pa.int32()), pa.array([counts(t).astype("<f4").tobytes() for t in texts], pa.binary())], names=["doc_id", "kind", "x"])

    rows = sorted(docs.select("doc_id", "text").where(draw < max(1_000_000 * min(1.0, most / n) for n in sizes.values())).mapInArrow(vectors, schema).distinct().orderBy("doc_id", "x").limit(8 * most).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, bytes(r["x"])))
    def of_kind(k: int) -> np.ndarray:
        return np.frombuffer(b"".join(bytes(r["x"]) for r in rows if r["kind"] == k), "<f4").reshape(-1, len(NAMES)).astype(float)

    return fit_rows(of_kind(1), of_kind(0), of_kind(2))


def score(docs: DataFrame, model: Network) -> DataFrame:
    """docs with score; where docs has a column of this name, it stays and ours is score_1."""
    spark = docs.sparkSession
    common.ship(spark)
    own = common.free_name(docs.columns, "score")
    shared = spark.sparkContext.broadcast(model)
    names, at = [*docs.columns, own], docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            x = np.array([counts(t) for t in batch.column(at).to_pylist()], float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m.score(x), pa.float64())], names=names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(own, T.DoubleType())]))


def op1_pu_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.tables(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.tables(spark, sf_dir, "labels").where(~held_out())
    model = fit(docs.where(~held_out()), labels)
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
