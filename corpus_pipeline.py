"""The corpus pipeline: language ID, near-duplicates, surrogates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. A stage's result is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, langid, mixing, neardup, packing, surrogates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; null texts and texts without a letter (``und``) go."""
    model = langid.fit(docs.where(~langid.held_out()))
    told = common.free_name(docs.columns, "lang_pred")
    return langid.identify(docs, model).where(F.col(told) != "und").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates (five words, 0.8); repeated rows (of equal doc_id and
    text) stay once. Rows without doc_id or words are in no group and stay.

    Only rows of ids that occur again with their text are compared; no other text moves for it."""
    used = ["doc_id", "text"]
    found = neardup.near_duplicates(docs, 5, 80, 100)
    gone = common.stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    again = docs.where("doc_id is not null").groupBy("doc_id", digest.alias("d_")).agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1")
    again = common.stored(again.select(F.col("doc_id").alias("i_"), "d_"), "again")
    kept = common.nested(docs, used).join(gone, "doc_id", "left_anti")
    if not again.isEmpty():
        same = (F.col("doc_id") == F.col("i_")) & (digest == F.col("d_"))
        once = kept.join(again, same, "left_semi").withColumn("d_", digest).dropDuplicates(["doc_id", "d_"]).drop("d_")
        kept = kept.join(again, same, "left_anti").unionByName(once)
    return kept.select(*common.unnested(docs.columns, used))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by surrogates and n_chars counted anew."""
    out = surrogates.pseudonymize(docs)
    counted = F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[counted.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, each as often as it is taken (at most twice)."""
    size, taken = (F.col(common.free_name(docs.columns, c)) for c in ("size", "taken"))
    mixed = mixing.mix(docs).where(taken > 0)
    times = F.explode(F.sequence(F.lit(1), (taken / size).cast("int"))).alias("times_")
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    return mixed.select(row.alias("row_"), times).select(*[F.col("row_")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packed),
]

#: Trained models, minwise trees and a linear program are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return docs
