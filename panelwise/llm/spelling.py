"""Words one edit apart, by asymmetric q-chunks, and the form each is a variant of.

Of two near words let A be the shorter, or either if they are as long. A is cut
into two disjoint chunks; one edit leaves one of them whole, and B holds it as
a gram at the same place, or shifted by the difference in length if the edit is
before it. So A sends its two chunks, B the positional grams of the chunks'
lengths within shift one, and equal chunk and gram meet in a join.

A chunk that many words share would meet too many grams. Its words are not
paired but cut again: the chunk known to be whole is kept, the other, which
holds the edit, is halved, and the join key grows by the half that is whole
now. This ends at a single letter, where no more words share a key than the
alphabet allows. Every near pair meets in exactly one key, that of the piece
with the first place where the two words differ.

All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import stored
from panelwise.llm.phrase_index import LOWER, UPPER
from panelwise.session import prepare

# The letters of a word, after A-Z were lower-cased.
LETTERS = "[a-zÀ-ÿ]"
#: Pairs that may meet in one key before its words are cut again.
MOST_PAIRS = 256
#: Counts at least double along a chain of forms, so none is longer.
DOUBLINGS = 6


def without_letter(word: Column, at: Column) -> Column:
    """The word without its code point at a place counted from 0."""
    place = at.cast("int")
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def count_words(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_letters: int = 5,
    least_count: int = 3,
    slip_every: int | None = None,
) -> DataFrame:
    """word and n: the runs of letters of all texts, lower-cased, that are long and frequent enough.

    With `slip_every` a run loses a letter where that number divides the crc32
    of "<id>:<run>", the letter being that of the crc32 modulo the length: a
    repeatable source of misspelt words. Null texts have no words, a null id is
    an empty one there. Counts are combined before the shuffle.
    """
    prepare(docs.sparkSession)
    # A shorter run cannot become long enough.
    runs = F.regexp_extract_all(
        F.translate(F.col("text"), UPPER, LOWER), F.lit(f"{LETTERS}{{{least_letters},}}"), F.lit(0)
    )
    words = docs.select(
        F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), docs[text_col].cast("string").alias("text")
    ).select("id", F.explode(runs).alias("word"))
    if slip_every is not None:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        slipped = without_letter(F.col("word"), F.col("h") % F.length("word"))
        words = (
            words.withColumn("h", h)
            .select(F.when(F.col("h") % slip_every == 0, slipped).otherwise(F.col("word")).alias("word"))
            .where(F.length("word") >= least_letters)
        )
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def with_key(pieces: DataFrame) -> DataFrame:
    """The join key of a piece [s, e) of a word of `size` letters: what precedes and what follows it.

    Equal keys by chance do no harm, as pairs are verified.
    """
    before = F.substring("word", F.lit(1), F.col("s"))
    after = F.expr("right(word, size - e)")
    return pieces.withColumn("key", F.xxhash64("size", "s", "e", before, after))


def halves(pieces: DataFrame) -> DataFrame:
    """Each piece as its two halves."""
    middle = F.expr("s + (e - s) div 2").cast("int")
    rest = [c for c in pieces.columns if c not in ("s", "e", "key")]
    both = F.array(F.struct("s", middle.alias("e")), F.struct(middle.alias("s"), "e"))
    return with_key(pieces.select(*rest, F.explode(both).alias("half")).select(*rest, "half.s", "half.e"))


def chunks_and_grams(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two chunks of each word, and its grams for words of its own length and one letter less."""
    length = F.length("word").cast("int")
    whole = words.withColumn("length", length).withColumn("s", F.lit(0))
    chunks = whole.withColumn("size", F.col("length"))
    grams = whole.withColumn("size", F.explode(F.array(F.col("length"), F.col("length") - 1))).where("size > 0")
    return tuple(halves(side.withColumn("e", F.col("size"))) for side in (chunks, grams))


def crowded(chunks: DataFrame, grams: DataFrame, most_pairs: int) -> DataFrame:
    """Keys in which too many pairs would meet and that can be cut again."""
    sides = chunks.select("key", "s", "e", F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(
        grams.select("key", "s", "e", F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    counted = sides.groupBy("key").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"), F.max(F.col("e") - F.col("s")).alias("letters")
    )
    return counted.where((F.col("a") * F.col("b") > most_pairs) & (F.col("letters") > 1)).select("key")


def meet(chunks: DataFrame, grams: DataFrame) -> DataFrame:
    """Near pairs a, b with their counts, each once."""
    a = chunks.select("key", "size", "s", "e", *[F.col(c).alias(f"{c}_a") for c in ("id", "word", "n")])
    b = grams.select("key", "size", "s", "e", "length", *[F.col(c).alias(f"{c}_b") for c in ("id", "word", "n")])
    # The two words part inside the piece, or else a later piece has the pair, too.
    parted = F.expr("e = size OR left(word_a, e) <> left(word_b, e)")
    once = F.expr("length > size OR id_a < id_b")
    near = F.levenshtein("word_a", "word_b", 1) == 1
    return a.join(b, ["key", "size", "s", "e"]).where(once).where(parted).where(near).select("id_a", "n_a", "id_b", "n_b")


def tallied(pairs: DataFrame) -> DataFrame:
    """Per word: n_near, and the id of its form so far. Ids go by falling count, then by word."""
    def side(x: str, y: str) -> Column:
        form = F.when(F.col(f"n_{y}") >= 2 * F.col(f"n_{x}"), F.col(f"id_{y}"))
        return F.struct(F.col(f"id_{x}").alias("id"), form.alias("form_id"))

    each = pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("p")).select("p.id", "p.form_id")
    return each.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min("form_id").alias("form_id"))


def near_words(words: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """id, n_near and form_id of every word with a near word; `words` has id, word, n, ids by falling count."""
    chunks, grams = chunks_and_grams(words)
    tallies = []
    while True:
        hot = stored(crowded(chunks, grams, most_pairs), "spelling-crowded")
        paired = meet(chunks.join(hot, "key", "left_anti"), grams.join(hot, "key", "left_anti"))
        tallies.append(stored(tallied(paired), "spelling-tally"))
        if hot.isEmpty():
            break
        chunks, grams = (halves(side.join(hot, "key", "left_semi")) for side in (chunks, grams))
    together = tallies[0]
    for more in tallies[1:]:
        together = together.unionAll(more)
    return together.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("form_id").alias("form_id"))


def roots(forms: DataFrame) -> DataFrame:
    """id and root_id, the last of a chain of forms, from id and form_id."""
    state = stored(forms.select("id", F.coalesce("form_id", "id").alias("root_id")), "spelling-roots")
    for _ in range(DOUBLINGS):
        ahead = state.select(F.col("id").alias("root_id"), F.col("root_id").alias("next_id"))
        state = state.join(ahead, "root_id").select(
            "id", F.col("next_id").alias("root_id"), (F.col("root_id") != F.col("next_id")).alias("moved")
        )
        state = stored(state, "spelling-roots")
        if state.where("moved").isEmpty():
            break
        state = state.drop("moved")
    return state.select("id", "root_id")


def group_variants(counts: DataFrame, *, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Per word of `counts` (word, n; each word once): form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point.
    A word's form is its near word of largest n, ties to the smallest in code
    point order, if that n is at least twice the word's; its root is where the
    forms end. `most_pairs` changes the work, never the result. Null and empty
    words are left out; other columns are not read. No words, no rows.
    """
    prepare(counts.sparkSession)
    order = counts.select("word", F.col("n").cast("long").alias("n")).where("word <> ''")
    order = order.orderBy(F.desc("n"), "word").withColumn("id", F.monotonically_increasing_id())
    words = stored(order.select("id", "word", "n"), "spelling-words")
    found = stored(words.join(near_words(words, most_pairs), "id", "left"), "spelling-forms")
    ends = roots(found.select("id", "form_id"))
    forms = words.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    tops = words.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
    return (
        found.join(ends, "id")
        .join(forms, "form_id", "left")
        .join(tops, "root_id")
        .select("word", "form", "root", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )
