"""Temperature mixing: source shares raised to an exponent, realised as blocks.

Source i holds t_i tokens. Its weight is t_i^a / sum t_j^a: a = 1 keeps the
shares, a = 0 makes all equal. The exponent is bisected until the weights have
the target entropy, or until no source is repeated more often than the limit.
The mixture is then dealt as a permutation of blocks that each spend the same
token budget by the weights.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.common import by_position, stored

STEPS = 6  # bisections settled by one pass over the sources
PASSES = 6


def count_tokens(text: Column) -> Column:
    """The tokens of a byte-level vocabulary without merges: UTF-8 bytes, which scripts without blanks have, too."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def source_tokens(docs: DataFrame, source: str, tokens: str) -> DataFrame:
    """Tokens and documents of each source."""
    return docs.groupBy(F.col(source).alias("source")).agg(
        F.sum(tokens).alias("tokens"), F.count("*").alias("documents")
    )


def find_exponent(sources: DataFrame, *, entropy: float | None = None, repetition: float | None = None) -> float:
    """The exponent in [0, 1] that meets the target.

    `entropy`: the share of the highest possible entropy (that of equal
    weights) to reach; the largest exponent that does. `repetition`: the
    smallest exponent with which no source is passed more than so many times
    while the source passed least is passed once. Both quantities change
    monotonically with the exponent; each pass over the sources tries the 63
    exponents that six bisections could meet. One source or none: 1.
    """
    if (entropy is None) == (repetition is None):
        raise ValueError("give a target entropy or a repetition limit")
    held = sources.where("tokens > 0").select(F.log("tokens").alias("l"))
    low, high, n = 0.0, 1.0, 1 << STEPS
    for _ in range(PASSES):
        tried = [low + (high - low) * i / n for i in range(1, n)]
        each = held.select("l", F.explode(F.array(*map(F.lit, tried))).alias("a"))
        # Sums of t^a stay in range for any counts of tokens that fit a long.
        sums = each.groupBy("a").agg(
            F.sum(F.exp(F.col("a") * F.col("l"))).alias("z"),
            F.sum(F.exp(F.col("a") * F.col("l")) * F.col("a") * F.col("l")).alias("s"),
            F.count("*").alias("sources"),
            F.max("l").alias("most"),
            F.min("l").alias("least"),
        )
        met = {}
        for r in sums.collect():  # one row per exponent tried
            if entropy is not None:
                h = log(r["z"]) - r["s"] / r["z"]
                met[r["a"]] = r["sources"] < 2 or h >= entropy * log(r["sources"])
            else:
                # Passes of a source go as t^(a - 1): the smallest is repeated most.
                passes = (1 - r["a"]) * (r["most"] - r["least"])
                met[r["a"]] = passes > log(repetition)
        if not met:
            return 1.0
        # `met` holds below the exponent sought and fails above it.
        below = [a for a in tried if met[a]]
        above = [a for a in tried if not met[a]]
        low, high = max(below, default=low), min(above, default=high)
    return low if entropy is not None else high


def weigh(sources: DataFrame, exponent: float) -> DataFrame:
    """source, tokens, documents, weight, and epochs: how often each source is passed.

    The budget is the smallest that passes every source at least once, so no
    document is left out. Sources without tokens are passed once.
    """
    raised = F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(exponent))).otherwise(0.0)
    powered = sources.withColumn("p", raised)
    total = powered.agg(
        F.sum("p").alias("z"), F.max(F.when(F.col("p") > 0, F.col("tokens") / F.col("p"))).alias("budget_over_z")
    )
    joined = powered.join(F.broadcast(total))  # one row
    epochs = F.when(F.col("p") > 0, F.col("p") * F.col("budget_over_z") / F.col("tokens")).otherwise(1.0)
    return joined.select(
        "source", "tokens", "documents",
        F.when(F.col("z") > 0, F.col("p") / F.col("z")).otherwise(0.0).alias("weight"),
        F.greatest(epochs, F.lit(1.0)).alias("epochs"),
    )


def mix(
    docs: DataFrame,
    *,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    entropy: float | None = None,
    repetition: float | None = 2.0,
    tokens_col: str | None = None,
    block_tokens: int = 4_000_000,
    bucket_documents: int = 2_000,
    seed: int = 0,
) -> DataFrame:
    """The mixture, one row per use of a document, without its text.

    A document's tokens are the number in `tokens_col` (null or below zero: 0)
    or else its UTF-8 bytes; put the counts of a tokenizer there to weigh by it.

    doc_id, text_hash, source, tokens, epoch (from 0), block, and place, by
    which the rows of a block are permuted. Every epoch is its own permutation
    of the source. The last, partial epoch takes documents in its order until
    its tokens are spent; a document belongs to it if it starts before that.
    All documents occur in epoch 0. A null source is a source of its own; null
    or empty texts have no tokens and occur once per full epoch. A text longer
    than a block is not cut; its block is larger. Ids become longs. Equal rows are
    separate documents with one place. No rows give no rows.

    A source of any size is ordered in buckets of about `bucket_documents`.
    """
    text = docs[text_col].cast("string")
    given = None if tokens_col is None else F.greatest(F.coalesce(docs[tokens_col].cast("long"), F.lit(0)), F.lit(0))
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
        docs[source_col].cast("string").alias("source"),
        (count_tokens(text) if given is None else given).alias("tokens"),
    )
    rows = stored(rows, "mixing-rows")
    sources = stored(source_tokens(rows, "source", "tokens"), "mixing-sources")
    exponent = find_exponent(sources, entropy=entropy, repetition=None if entropy is not None else repetition)
    weights = weigh(sources, exponent).select(
        F.col("source").alias("of"), F.col("tokens").alias("held"), "documents", "weight", "epochs"
    )
    weights = stored(weights, "mixing-weights")
    total = weights.agg(F.sum(F.col("epochs") * F.col("held")).alias("budget"))
    planned = rows.join(weights, rows["source"].eqNullSafe(weights["of"])).drop("of")
    last = F.ceil("epochs").cast("int") - 1
    dealt = planned.withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    # A uniform place per document and epoch; its leading part is the bucket.
    key = F.xxhash64(F.lit(seed), "epoch", "doc_id", "text_hash")
    dealt = dealt.withColumn("place", key)
    count = F.greatest(F.lit(1), F.ceil(F.col("documents") / bucket_documents)).cast("long")
    share = (F.shiftrightunsigned("place", 1) / F.lit(float(1 << 63))).cast("double")
    dealt = dealt.withColumn("bucket", F.least(F.floor(share * count), count - 1))
    by_source = ["source", "epoch"]
    sums = dealt.groupBy(*by_source, "bucket").agg(F.sum("tokens").alias("in_bucket"))
    earlier = Window.partitionBy(*by_source).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("bucket").alias("b"),
        F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("bucket_start"),
    )
    joined = dealt.join(
        starts, dealt["source"].eqNullSafe(starts["s"]) & (dealt["epoch"] == starts["e"]) & (dealt["bucket"] == starts["b"])
    ).drop("s", "e", "b")
    order = Window.partitionBy(*by_source, "bucket").orderBy("place", "doc_id", "text_hash")
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spent = F.col("epoch") * F.col("held") + F.col("bucket_start") + before
    cut = joined.withColumn("spent", spent).where(
        (F.col("epoch") == 0) | (F.col("epoch") < F.floor("epochs")) | (F.col("spent") < F.col("epochs") * F.col("held"))
    )
    blocks = F.greatest(F.lit(1), F.ceil(F.col("budget") / block_tokens))
    at = F.when(F.col("held") > 0, F.col("spent") / (F.col("epochs") * F.col("held"))).otherwise(share)
    return cut.join(F.broadcast(total)).select(
        "doc_id", "text_hash", "source", "tokens", "epoch",
        F.least(F.floor(at * blocks), blocks - 1).cast("long").alias("block"),
        F.xxhash64(F.lit(seed), "place").alias("place"), "weight", "epochs",
    )


def apply_mixture(docs: DataFrame, **options) -> DataFrame:
    """The documents as the mixture uses them, in its order: blocks, and places within them.

    A document used in several epochs occurs as often; all columns are returned.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    uses = mix(docs, **options)
    # Equal rows are used together.
    uses = uses.groupBy("doc_id", "text_hash", "epoch").agg(F.min("block").alias("block"), F.min("place").alias("place"))
    uses = uses.select(*[F.col(c).alias(f"use_{c}") for c in uses.columns])
    given, back = by_position(docs)
    own_id, own_text = (F.col(given.columns[docs.columns.index(c)]) for c in (id_col, text_col))
    given = given.withColumn("use_of", F.xxhash64(own_text.cast("string")))
    same = own_id.cast("long").eqNullSafe(F.col("use_doc_id")) & (F.col("use_of") == F.col("use_text_hash"))
    mixed = given.join(uses, same).repartitionByRange("use_block", "use_place")
    return mixed.sortWithinPartitions("use_block", "use_place").select(*back)
