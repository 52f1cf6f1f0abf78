"""Language identification by hierarchical discrimination.

A text's features are the square roots of its hashed byte-trigram counts (letters only, lower-cased,
other characters as one space), scaled to unit length. One linear support vector machine per language
family, one against the rest, picks the family; inside it, one-versus-one linear machines vote.

The machines are fitted on at most ``per_language`` labelled documents of each of the ``MOST_LANGUAGES`` commonest
languages, ``MOST_ROWS`` in all (2048 numbers each at the driver), chosen by a
hash of doc_id; features are computed on the executors, so the driver gets ``bins`` numbers per sampled document.

Cases: null text and text without a letter give ``und`` with score 0; without any labelled row every
text does; very long texts are read whole; repeated rows are answered each for itself."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BINS, PER_LANGUAGE, MOST_LANGUAGES, MOST_ROWS = 2048, 600, 200, 24_000
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "indic": "hi ur bn mr gu pa ne si",
    "turkic": "tr az kk uz ky tk",
    "uralic": "fi et hu",
    "semitic": "ar he mt am",
    "sinitic": "zh yue",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = re.compile(r"[^\W\d_]")
_CLEAN = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def family(lang: str) -> str:
    """A language's family; an unlisted language is a family of its own."""
    return _FAMILY.get(re.split(r"[-_]", lang.lower())[0], f"own:{lang}")


def features(text: str, bins: int = BINS) -> np.ndarray:
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_CLEAN).split()) + b" "
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(bins, np.float32)
    code = (raw[:-2] | (raw[1:-1] << np.uint32(8)) | (raw[2:] << np.uint32(16))) * np.uint32(2654435761)
    counts = np.sqrt(np.bincount(code >> np.uint32(32 - int(bins).bit_length() + 1), minlength=bins)).astype(np.float32)
    return counts / max(float(np.sqrt(counts @ counts)), 1e-9)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 50.0, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Linear squared-hinge support vector machine, classes weighted alike, by accelerated gradient."""
    n, d = x.shape
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w, b = np.zeros(d, np.float32), 0.0
    u, c, rate = w, b, 1.0 / (1 + 4 * cost)
    for t in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ u + c)) * y * share * (-2 * cost)
        nw, nb = u - rate * (u + gap @ x), c - rate * float(gap.sum())
        k = t / (t + 3)
        u, c = nw + k * (nw - w), nb + k * (nb - b)
        w, b = nw, nb
    return w, float(b)


class Model:
    """Families' machines, one against the rest, and pairs' machines inside each family."""

    def __init__(self, x: np.ndarray, langs: list[str], bins: int = BINS):
        self.bins = bins
        self.langs = sorted(set(langs))
        self.families = sorted({family(v) for v in self.langs})
        lang, fam = np.array(langs), np.array([family(v) for v in langs])
        self.members = {f: [v for v in self.langs if family(v) == f] for f in self.families}
        rows, self.offsets, self.pairs = [], [], []
        if len(self.families) > 1:
            for f in self.families:
                w, b = svm(x, np.where(fam == f, 1.0, -1.0).astype(np.float32))
                rows.append(w)
                self.offsets.append(b)
        for f in self.families:
            own = self.members[f]
            for i, p in enumerate(own):
                for q in own[i + 1 :]:
                    pick = (lang == p) | (lang == q)
                    w, b = svm(x[pick], np.where(lang[pick] == p, 1.0, -1.0).astype(np.float32))
                    self.pairs.append((p, q, len(rows)))
                    rows.append(w)
                    self.offsets.append(b)
        self.weights = np.array(rows, np.float32).reshape(len(rows), bins)
        self.offsets = np.array(self.offsets)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0
        margin = self.weights @ features(text, self.bins) + self.offsets if len(self.weights) else np.zeros(0)
        chosen, sure = self.families[0], 1.0
        if len(self.families) > 1:
            m = margin[: len(self.families)]
            e = np.exp(np.clip(2 * (m - m.max()), -50, 0))
            chosen, sure = self.families[int(m.argmax())], float(e.max() / e.sum())
        own = self.members[chosen]
        votes = dict.fromkeys(own, 0.0)
        for p, q, k in self.pairs:
            if p in votes:
                s = 1 / (1 + np.exp(-np.clip(2 * margin[k], -50, 50)))
                votes[p] += (s >= 0.5) + 1e-3 * s
                votes[q] += (s < 0.5) + 1e-3 * (1 - s)
        best = max(own, key=lambda v: votes[v])
        for p, q, k in self.pairs:
            if best in (p, q):
                s = 1 / (1 + np.exp(-np.clip(2 * margin[k], -50, 50)))
                sure = min(sure, float(s if best == p else 1 - s))
        return best, min(1.0, max(0.0, sure))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, bins: int = BINS, most_languages: int = MOST_LANGUAGES) -> Model:
    """Fit on labelled rows (doc_id, text, lang): at most ``per_language`` of each language, of at most
    ``most_languages`` languages (those with most rows, ties by name), and no more than ``MOST_ROWS`` in all."""
    spark = labelled.sparkSession
    common.ship(spark)
    usable = labelled.where("lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not counts:
        return Model(np.zeros((0, bins), np.float32), [], bins)
    per_language = min(per_language, max(1, MOST_ROWS // len(counts)))
    draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1_000_000))
    bound = F.coalesce(*[F.when(F.col("lang") == v, F.lit(int(1_000_000 * min(1.0, 1.3 * per_language / n)))) for v, n in counts.items()])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = [features(t, bins).astype("<f4").tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.binary()), part.column(2), part.column(3)], names=["doc_id", "x", "lang", "draw"])

    drawn = usable.withColumn("draw", draw).where(F.col("draw") < bound).mapInArrow(vectors, "doc_id long, x binary, lang string, draw long")
    w = Window.partitionBy("lang").orderBy("draw", "doc_id")
    rows = drawn.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_language).select("x", "lang", "draw", "doc_id").collect()
    rows.sort(key=lambda r: (r["lang"], r["draw"], r["doc_id"] if r["doc_id"] is not None else -1))
    x = np.frombuffer(b"".join(r["x"] for r in rows), "<f4").reshape(len(rows), bins).copy() if rows else np.zeros((0, bins), np.float32)
    return Model(x, [r["lang"] for r in rows], bins)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score; a column of docs of such a name stays, and ours has a number after it."""
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded: bins x machines
    own = [common.free_name(docs.columns, c) for c in ("lang_pred", "score")]
    names = [*docs.columns, *own]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            found = [m.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=names)

    schema = T.StructType([*docs.schema.fields, T.StructField(own[0], T.StringType()), T.StructField(own[1], T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_hierarchical_langid(spark, sf_dir: str) -> DataFrame:
    docs = common.tables(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    texts = identify(docs.select("doc_id", "text"), model)
    return texts.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
