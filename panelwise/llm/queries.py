"""The operators as queries over the sample tables, with production parameters."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.llm import (
    bpe,
    centroids,
    fingerprints,
    language_id,
    license_scan,
    mixing,
    phrase_index,
    simhash,
    spelling,
    suffix_dedup,
    token_files,
    topk_search,
    toxicity,
)
from panelwise.llm.common import documents
from panelwise.session import prepare

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def vocabulary(name: str) -> bytes:
    """A vocabulary file, read on the driver and sent to the tasks."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def in_fold(fold: int, of: int):
    """Whether the crc32 of the doc_id as text leaves this remainder."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == fold


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files.token_files(documents(spark, sf_dir), vocabulary(TOKENIZER))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.label_documents(documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_passages(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture with no source repeated more than twice."""
    mixed = mixing.mix(documents(spark, sf_dir), repetition=2.0)
    return mixed.select("doc_id", "source", "tokens", "epoch", "block", "place", "weight", "epochs")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents(spark, sf_dir)  # prepares the session
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk_search.exact_top_k(vectors, "vec_id % 20 = 0", k=20, scale=64.0)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprint_neighbours(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.base64("fingerprint").alias("fingerprint"), F.base64("edited_fingerprint").alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.link(documents(spark, sf_dir), words=3, distance=2)
    hexes = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return linked.select("doc_id", hexes.alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    learn = docs.select("doc_id", "text").where(~in_fold(0, 5))
    scored = toxicity.score(docs, toxicity.train(learn, labels), keep=["doc_id"])
    return scored.select("doc_id", in_fold(0, 5).alias("held_out"), "score", "predicted")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary(RANKS)
    coded = bpe.decode(bpe.encode(documents(spark, sf_dir), ranks, pattern()), ranks)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    models = language_id.train(docs.select("doc_id", "text", "lang").where(~in_fold(1, 3)))
    found = language_id.predict(docs, models, keep=["doc_id"])
    return found.select("doc_id", in_fold(1, 3).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    found = phrase_index.contaminated(documents(spark, sf_dir), items, words=10)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    found = centroids.cluster(vectors, size=64, scale=64.0, k=16, rounds=3, prefix="1:")
    return found.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia",
        centroids.centroid_digest(F.col("centroid")).alias("centroid_sha256"),
    )


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling.count_words(documents(spark, sf_dir), least_letters=5, least_count=3, slip_every=97)
    return spelling.group_variants(counts).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files, op2_license_scan, op3_suffix_dedup, op4_mixing, op5_topk_search,
        op6_fingerprints, op7_simhash, op8_toxicity, op9_bpe, op10_language_id,
        op11_decontamination, op12_centroids, op13_spelling,
    )
}
