"""A training corpus from raw documents: identify, deduplicate, mix, tokenise.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, as
`run` and the check tool write them between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.llm import bpe, language_id, mixing, simhash, suffix_dedup
from panelwise.llm.queries import RANKS, in_fold, pattern, vocabulary
from panelwise.session import prepare, scratch_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those the models reject go. The given `lang` is kept."""
    prepare(spark)
    models = language_id.train(docs.select("doc_id", "text", "lang").where(~in_fold(1, 3)))
    named = docs.select(*[F.col(c).alias(f"doc_{c}") for c in docs.columns])
    found = language_id.predict(named, models, text_col="doc_text")
    return found.where("not rejected").select(*[F.col(f"doc_{c}").alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    prepare(spark)
    return simhash.keep_one(docs, words=3, distance=2)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id holds."""
    prepare(spark)
    return suffix_dedup.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, and small sources again, up to 1.5 times, in the mixture's order."""
    prepare(spark)
    return mixing.apply_mixture(docs, repetition=1.5)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document in the mixture, with its other columns."""
    prepare(spark)
    kept = [c for c in docs.columns if c != "text"]
    coded = bpe.encode(docs, vocabulary(RANKS), pattern(), keep=kept)
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mixing", mix_sources),
    ("byte-level BPE", tokenise),
]

ORACLE_SQL = None  # the language models and the tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch_dir(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
