"""Benchmark passages in training documents, by a positional inverted index.

1. Every word of every document becomes a posting (term, document, position).
   Documents are dealt to shards by their key, and a shard is stored in term
   order: the list of a frequent word is spread over all shards, and whatever
   is asked of one document stays in its shard.
2. A test item is cut into windows of consecutive words. The two rarest words
   of a window, by the lengths of their lists, lead.
3. The leaders' lists, each position less the word's offset in the window, are
   intersected; what remains are places where the window may start.
4. There the lists of all its words are read, of the remaining documents only:
   a place is an exact phrase, a proximity match (most words stand within a
   few places of where they should), or nothing.

All of it is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.common import BucketedTable, bucketed_table, remove, scratch_dir
from panelwise.session import prepare

# What may stand between words, and the letters that are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEADERS = 2
MOST_WORDS = 62  # the words of a window are the bits of a long


def cut_words(text: Column) -> Column:
    """The words of a text as an array, after an empty string; another one may follow the last word."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return F.split(F.concat(F.lit(" "), F.translate(whole, UPPER, LOWER)), BETWEEN)


@dataclass(frozen=True)
class PhraseIndex:
    """Postings `term, doc, copy, pos`, stored in shards of documents.

    Words count from 1. At position 0 every document has the empty term, with
    its id and its number of words. `copy` tells rows of one id and text apart.
    """

    table: BucketedTable

    @property
    def postings(self) -> DataFrame:
        return self.table.rows

    def documents(self) -> DataFrame:
        """One row per indexed row: doc, copy, doc_id, n_words."""
        return self.postings.where("term = ''").select("doc", "copy", "doc_id", "n_words")

    def lists(self, terms: DataFrame) -> DataFrame:
        """The postings of the terms, with the other columns of `terms`.

        The terms asked for are the small side; Spark broadcasts them below its
        size threshold and else shuffles both, splitting lists that are hot.
        """
        return self.postings.select("term", "doc", "copy", "pos").join(terms, "term")

    def within(self, docs: DataFrame) -> DataFrame:
        """The postings of the documents in `doc`: their shards are read where they are, only `docs` moves."""
        postings = self.postings.select("term", "doc", "copy", "pos")
        return postings.join(docs.hint("shuffle_hash"), "doc", "left_semi")

    def drop(self) -> None:
        self.table.drop()


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> PhraseIndex:
    """Index every word of every row, whatever the other columns are.

    Null texts have no words. Ids may be of any type that can be hashed and
    ordered, null or repeated: each row is a document of its own. One text is
    cut by one task, however long; its words then spread over rows.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    # Rows without an id are dealt by their text, lest all of them land in one shard.
    key = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    same = Window.partitionBy("doc").orderBy("doc_id", "text")
    last_empty = (F.size("words") > 1) & (F.element_at("words", -1) == "")
    first = F.col("pos") == 0
    postings = (
        rows.withColumn("doc", key)
        .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc")
        .withColumn("copy", F.row_number().over(same))
        .select("doc", "copy", "doc_id", cut_words(F.col("text")).alias("words"))
        .withColumn("n_words", (F.size("words") - 1 - last_empty.cast("int")).cast("long"))
        .select("doc", "copy", "doc_id", "n_words", F.posexplode("words").alias("pos", "term"))
        .where("term <> '' OR pos = 0")
        .select(
            "term", "doc", "copy", "pos",
            F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("n_words")).alias("n_words"),
        )
        .sortWithinPartitions("term")
    )
    return PhraseIndex(bucketed_table(postings, "doc", "phrase-postings"))


def cut_windows(items: DataFrame, words: int) -> DataFrame:
    """item_id and terms, per run of `words` consecutive words of an item; a shorter item is one run."""
    runs = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - words + 1))
    return (
        items.select("item_id", F.filter(cut_words(F.col("text")), lambda w: w != "").alias("all"))
        .where("size(all) > 0")
        .select("item_id", "all", F.explode(runs).alias("start"))
        .select("item_id", F.slice("all", F.col("start"), words).alias("terms"))
        .distinct()
    )


@dataclass(frozen=True)
class Matches:
    """Where windows of test items stand in documents; all stored.

    `places`: doc, copy, window, start, n_words, exact (else a proximity match).
    `windows`: window, item_id.
    """

    places: DataFrame
    windows: DataFrame
    folder: str


def find_items(
    index: PhraseIndex,
    items: DataFrame,
    *,
    id_col: str = "item_id",
    text_col: str = "text",
    words: int = 10,
    slop: int = 2,
    share: float = 0.8,
) -> Matches:
    """Every place where a window of an item stands, exactly or nearly.

    A proximity match has `share` of the window's words, in the same document
    and each at most `slop` places off where the rarest of them says it should
    be; that one and the second rarest must both be there. Exact places are
    found whatever `slop` and `share` are. Items without words (null texts) are
    never found; items of one id count as one item, null ids too.
    """
    if not 1 <= words <= MOST_WORDS:
        raise ValueError(f"a window has 1 to {MOST_WORDS} words")
    spark = index.postings.sparkSession
    folder = scratch_dir(spark, "phrase-matches")

    def keep(df: DataFrame, name: str) -> DataFrame:
        """Written and read again, so that Spark knows its size before it plans a join with it."""
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    given = items.select(items[id_col].alias("item_id"), items[text_col].alias("text"))
    cut = keep(cut_windows(given, words), "cut")
    named = cut.select("terms").distinct().withColumn("window", F.monotonically_increasing_id())
    windows = keep(named.select("window", "terms", F.size("terms").alias("n_words")), "windows")
    wanted = windows.select("window", "n_words", F.posexplode("terms").alias("offset", "term"))

    lengths = keep(
        index.lists(keep(wanted.select("term").distinct(), "terms")).groupBy("term").agg(F.count(F.lit(1)).alias("length")),
        "lengths",
    )
    by_rarity = Window.partitionBy("window").orderBy("length", "offset")
    known = (
        wanted.join(lengths, "term")
        .withColumn("rank", F.row_number().over(by_rarity))
        .withColumn("n_known", F.count(F.lit(1)).over(Window.partitionBy("window")))
        .withColumn("least", F.ceil(F.lit(share) * F.col("n_words")))
        .where("n_known >= least")
    )
    leaders = known.where(F.col("rank") <= LEADERS).select(
        "term", "window", "offset", "rank", F.least("n_known", F.lit(LEADERS)).alias("n_leaders")
    )
    led = index.lists(keep(leaders, "leaders")).withColumn("start", F.col("pos") - F.col("offset"))
    around = Window.partitionBy("doc", "copy", "window").orderBy("start").rangeBetween(-slop, slop)
    places = (
        led.withColumn("followed", F.max((F.col("rank") > 1).cast("int")).over(around))
        .where("rank = 1 AND (followed = 1 OR n_leaders = 1)")
        .select("doc", "copy", "window", "start")
    )
    places = keep(places, "places")

    lists = index.within(keep(places.select("doc").distinct(), "doc")).join(
        spark.read.parquet(f"{folder}/terms"), "term", "left_semi"
    )
    off = F.explode(F.sequence(F.lit(-slop), F.lit(slop))).alias("off")
    asked = (
        places.join(wanted, "window")
        .select("doc", "copy", "window", "start", "n_words", "offset", "term", off)
        .withColumn("pos", F.col("start") + F.col("offset") + F.col("off"))
    )
    bit = F.expr("shiftleft(1L, offset)")
    judged = (
        asked.join(lists, ["doc", "copy", "pos", "term"])
        .groupBy("doc", "copy", "window", "start", "n_words")
        .agg(
            F.bit_count(F.bit_or(bit)).alias("n_near"),
            F.bit_count(F.bit_or(F.when(F.col("off") == 0, bit).otherwise(F.lit(0)))).alias("n_exact"),
        )
        .withColumn("exact", F.col("n_exact") == F.col("n_words"))
        .where(F.col("exact") | (F.col("n_near") >= F.ceil(F.lit(share) * F.col("n_words"))))
        .select("doc", "copy", "window", "start", "n_words", "exact")
    )
    of_items = cut.join(windows, "terms").select("window", "item_id")
    return Matches(keep(judged, "judged"), keep(of_items, "items"), folder)


def covered(places: DataFrame) -> DataFrame:
    """doc, copy and n_hit, the number of words inside any exact place."""
    so_far = Window.partitionBy("doc", "copy").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # Of places that start together the longest covers the others.
    spans = places.where("exact").groupBy("doc", "copy", "start").agg(F.max("n_words").alias("n_words"))
    ended = spans.withColumn("end", F.col("start") + F.col("n_words"))
    ended = ended.withColumn("before", F.coalesce(F.max("end").over(so_far), F.lit(0)))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before"))
    return ended.groupBy("doc", "copy").agg(F.sum(new).alias("n_hit"))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    words: int = 10,
    slop: int = 2,
    share: float = 0.8,
) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit, n_items, item_ids, contaminated, n_nearby.

    n_hit counts the words inside an exact occurrence of a window, item_ids
    lists the items with such windows as sorted strings (a null id as the empty
    one), n_nearby counts the places of proximity matches. Empty tables give no
    rows, or rows without hits. The index and the lists in between are removed
    once the result is stored.
    """
    index = build_index(docs, id_col=id_col, text_col=text_col)
    spark = index.postings.sparkSession
    found = find_items(
        index, items, id_col=item_id_col, text_col=item_text_col, words=words, slop=slop, share=share
    )
    exact = found.places.where("exact").select("doc", "copy", "window").distinct()
    by_doc = (
        exact.join(found.windows, "window")
        .select("doc", "copy", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"))
        .distinct()
        .groupBy("doc", "copy")
        .agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    )
    nearby = found.places.where("NOT exact").groupBy("doc", "copy").agg(F.count(F.lit(1)).alias("n_nearby"))
    zero, none = F.lit(0).cast("long"), F.array().cast("array<string>")
    rows = (
        index.documents()
        .join(covered(found.places), ["doc", "copy"], "left")
        .join(by_doc, ["doc", "copy"], "left")
        .join(nearby, ["doc", "copy"], "left")
        .select(
            "doc_id", "n_words",
            F.coalesce("n_hit", zero).alias("n_hit"),
            F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"),
            F.coalesce("item_ids", none).alias("item_ids"),
            F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
            F.coalesce("n_nearby", zero).alias("n_nearby"),
        )
    )
    path = scratch_dir(spark, "contaminated")
    rows.write.option("compression", "zstd").parquet(path)
    index.drop()
    remove(spark, found.folder)
    return spark.read.schema(rows.schema).parquet(path)
