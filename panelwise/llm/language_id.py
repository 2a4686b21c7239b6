"""Language identification with interpolated Kneser-Ney character models.

One model per language, of orders 1 to `order`, trained on labelled documents.
All models lie in one table per order: sorted hashes of character n-grams, and
for each the log probability of its last character in every language. Where an
n-gram is unknown the next shorter one is used, with the back-off weight of the
unknown one's context. The language with the lowest cross-entropy per character
is chosen; how far a text may lie from its language before it is rejected is
calibrated on training documents held out from the counts.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.common import per_worker, share, slices, stored, trim

UNKNOWN = "und"
MIX = np.uint64(0x9E3779B97F4A7C15)
PREFIX_BITS = 16
LEAST_HELD_OUT = 10  # texts that make a limit of a language's own


def letter_table() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower case if it is a letter, itself if it is a mark, else 0; and whether it is a mark.

    Marks belong to words: the vowel signs of many scripts are marks.
    """
    table, marks = np.zeros(sys.maxunicode + 1, np.uint32), np.zeros(sys.maxunicode + 1, bool)
    for c in range(sys.maxunicode + 1):
        letter = chr(c)
        kind = unicodedata.category(letter)[0]
        if kind == "L":
            lower = letter.lower()
            table[c] = ord(lower) if len(lower) == 1 else c
        elif kind == "M":
            table[c], marks[c] = c, True
    return table, marks


def symbols(text: str) -> np.ndarray:
    """Lower-case letters and marks, with one 0 for each run of anything else and at both ends; empty without letters."""
    table, marks = per_worker("letters", letter_table)
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    found = table[codes]
    if not found.any() or marks[codes[found != 0]].all():
        return np.zeros(0, np.uint32)
    found = np.concatenate([[0], found, [0]]).astype(np.uint32)
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != 0) | (found[:-1] != 0)
    return found[keep]


def hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Per order 1 to `order` the hash of the n-gram that ends at each symbol.

    The first n - 1 values of an order cross the start and mean nothing.
    """
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(order):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[n:] = codes[: len(codes) - n] if n else codes
        h = (h ^ (shifted + np.uint64(1 + (n << 24)))) * MIX
        h ^= h >> np.uint64(29)
        out.append(h.copy())
    return out


@dataclass
class HashTable:
    """Sorted hashes with rows of values; the first bits of a hash say where to look."""

    keys: np.ndarray
    rows: np.ndarray
    first: np.ndarray = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self):
        prefixes = np.arange((1 << PREFIX_BITS) + 1, dtype=np.uint64)
        self.first = np.searchsorted(self.keys >> np.uint64(64 - PREFIX_BITS), prefixes)
        self.longest = int(np.diff(self.first).max()) if len(self.keys) else 0

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Row of each wanted hash, or -1; a binary search inside its prefix."""
        if not len(self.keys):
            return np.full(len(wanted), -1)
        prefix = (wanted >> np.uint64(64 - PREFIX_BITS)).astype(np.int64)
        low, high = self.first[prefix], self.first[prefix + 1]
        for _ in range(max(1, self.longest).bit_length()):
            middle = np.minimum((low + high) >> 1, len(self.keys) - 1)
            less = self.keys[middle] < wanted
            open_ = low < high
            low = np.where(less & open_, middle + 1, low)
            high = np.where(less | ~open_, high, middle)
        at = np.minimum(low, len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)


@dataclass
class LanguageModels:
    """Log probabilities and back-off weights of all languages, by order."""

    languages: list[str]
    tables: list[HashTable]  # [n - 1]: n-gram hash to log probability per language
    backoff: list[HashTable]  # [n - 1]: hash of n symbols as context to log weight per language
    unseen: float
    limit: np.ndarray | None = None  # the highest cross-entropy accepted, per language

    @property
    def order(self) -> int:
        return len(self.tables)

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language nats per character, and the number of characters."""
        split = [symbols(t) for t in texts]
        counts = np.array([max(0, len(s) - 1) for s in split], np.int64)
        total = np.zeros((len(texts), len(self.languages)))
        # Each text starts with its boundary, which is a context and is not scored.
        codes = np.concatenate([np.zeros(0, np.uint32), *split])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(s)) for s in split)])
        text = np.repeat(np.arange(len(texts)), [len(s) for s in split])
        of_order = hashes(codes, self.order)
        row, used = np.full(len(codes), -1), np.zeros(len(codes), np.int64)
        scored = np.flatnonzero(place > 0)
        weights = np.zeros((len(codes), len(self.languages)), np.float32)
        left = scored
        for n in range(self.order, 0, -1):
            here = left[place[left] >= n - 1]
            at = self.tables[n - 1].find(of_order[n - 1][here])
            known = at >= 0
            row[here[known]], used[here[known]] = at[known], n
            if n > 1:
                missed = here[~known]
                context = self.backoff[n - 2].find(of_order[n - 2][missed - 1])
                has = context >= 0
                weights[missed[has]] += self.backoff[n - 2].rows[context[has]]
                left = left[used[left] == 0]
        logs = weights
        for n in range(1, self.order + 1):
            mine = np.flatnonzero(used == n)
            logs[mine] += self.tables[n - 1].rows[row[mine]]
        logs[scored[used[scored] == 0]] += self.unseen
        logs = logs[scored]
        owner = text[scored]
        for k in range(len(self.languages)):
            total[:, k] = -np.bincount(owner, logs[:, k], len(texts))
        return total / np.maximum(counts, 1)[:, None], counts

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and whether it is rejected, per text."""
        if not self.languages:
            n = len(texts)
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
        entropy, counts = self.cross_entropy(texts)
        best = entropy.argmin(1)
        # How much likelier per character the chosen language is, as a share.
        odds = np.exp(-4.0 * (entropy - entropy.min(1)[:, None]))
        score = np.where(counts > 0, 1 / odds.sum(1), 0.0)
        least = entropy[np.arange(len(texts)), best]
        rejected = counts == 0
        if self.limit is not None:
            rejected |= least > self.limit[best]
        names = [self.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), counts.tolist(), strict=True)]
        return names, score, np.where(counts > 0, least, 0.0), rejected


def count_ngrams(texts: list[str], order: int) -> dict[str, int]:
    """Every n-gram of exactly `order` symbols, padded with boundaries, and how often it occurs."""
    counts: dict[str, int] = {}
    for text in texts:
        codes = symbols(text)
        if not len(codes):
            continue
        line = "".join(map(chr, np.where(codes == 0, 32, codes).tolist()))
        line = " " * (order - 1) + line
        for i in range(len(line) - order + 1):
            gram = line[i : i + order]
            counts[gram] = counts.get(gram, 0) + 1
    return counts


def kneser_ney(top: dict[str, int], order: int, vocabulary: int) -> tuple[list[dict[str, float]], list[dict[str, float]]]:
    """Interpolated Kneser-Ney from counts of the longest n-grams.

    Returns probabilities of n-grams and back-off weights of contexts by order.
    Shorter n-grams count the different symbols before them.
    """
    counts = [dict(top)]
    for _ in range(order - 1):
        shorter: dict[str, int] = {}
        for gram in counts[0]:
            shorter[gram[1:]] = shorter.get(gram[1:], 0) + 1
        counts.insert(0, shorter)
    probabilities: list[dict[str, float]] = []
    weights: list[dict[str, float]] = []
    for n, own in enumerate(counts, 1):
        ones = sum(1 for c in own.values() if c == 1)
        twos = sum(1 for c in own.values() if c == 2)
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        sums: dict[str, int] = {}
        kinds: dict[str, int] = {}
        for gram, c in own.items():
            sums[gram[:-1]] = sums.get(gram[:-1], 0) + c
            kinds[gram[:-1]] = kinds.get(gram[:-1], 0) + 1
        weight = {c: discount * kinds[c] / sums[c] for c in sums}
        found = {}
        for gram, c in own.items():
            lower = probabilities[-1][gram[1:]] if n > 1 else 1 / vocabulary
            found[gram] = (c - discount) / sums[gram[:-1]] + weight[gram[:-1]] * lower
        probabilities.append(found)
        weights.append(weight)
    return probabilities, weights


def kneser_ney_tables(grams: DataFrame, order: int) -> tuple[list[DataFrame], dict[tuple[str, int], int], int]:
    """What `kneser_ney` computes, for (lang, gram, n) of any number of n-grams of length `order`.

    Returns by order (lang, gram, n, p, weight), where n is the count, p the
    probability and weight the back-off weight of the n-gram's context; the
    number of n-grams by language and order; and the size of the vocabulary.
    """
    levels = [grams.select("lang", "gram", "n")]
    for length in range(order - 1, 0, -1):
        levels.insert(0, levels[0].groupBy("lang", F.substring("gram", 2, length).alias("gram")).agg(F.count("*").alias("n")))
    vocabulary = max(2, levels[0].select("gram").distinct().count() + 1)
    tables, numbers = [], {}
    for length, level in enumerate(levels, 1):
        of_lang = level.groupBy("lang").agg(
            F.count("*").alias("all"), F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos")
        )
        found = of_lang.collect()  # one row per language
        numbers.update({(r["lang"], length): r["all"] for r in found})
        discounts = [(r["lang"], r["ones"] / (r["ones"] + 2 * r["twos"]) if r["ones"] and r["twos"] else 0.5) for r in found]
        discount = grams.sparkSession.createDataFrame(discounts, "lang string, discount double")
        own = level.withColumn("head", F.substring("gram", 1, length - 1))
        heads = own.groupBy("lang", "head").agg(F.sum("n").alias("sum"), F.count("*").alias("kinds"))
        heads = heads.join(F.broadcast(discount), "lang")
        heads = heads.withColumn("weight", F.col("discount") * F.col("kinds") / F.col("sum"))
        own = own.join(heads, ["lang", "head"])
        if tables:
            lower = tables[-1].select("lang", F.col("gram").alias("tail"), F.col("p").alias("lower"))
            own = own.withColumn("tail", F.substring("gram", 2, length - 1)).join(lower, ["lang", "tail"])
        else:
            own = own.withColumn("lower", F.lit(1 / vocabulary))
        p = (F.col("n") - F.col("discount")) / F.col("sum") + F.col("weight") * F.col("lower")
        # Written, since the next order is computed from it and it is read for the pruning.
        tables.append(stored(own.select("lang", "gram", "n", p.alias("p"), "weight"), f"kneser-ney-{length}"))
    return tables, numbers, vocabulary


def pruned(tables: list[DataFrame], numbers: dict[tuple[str, int], int], max_ngrams: int | None) -> dict[str, tuple[list[dict], list[dict]]]:
    """Per language probabilities and back-off weights, by order, of all its n-grams or the `max_ngrams` most frequent of each order.

    Single symbols are all kept; Unicode bounds them. Where n-grams are missing
    the back-off weights are set anew so that each context's probabilities
    still sum to one.
    """
    models: dict[str, tuple[list[dict], list[dict]]] = {}
    for length, table in enumerate(tables, 1):
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
        whole = length == 1 or max_ngrams is None
        kept = table if whole else table.withColumn("r", rank).where(F.col("r") <= max_ngrams)
        for lang, gram, p, weight in kept.select("lang", "gram", "p", "weight").toArrow().to_pandas().itertuples(index=False):
            probabilities, weights = models.setdefault(lang, ([{} for _ in tables], [{} for _ in tables]))
            probabilities[length - 1][gram] = p
            weights[length - 1][gram[:-1]] = weight
    for lang, (probabilities, weights) in models.items():
        if any(numbers[lang, n] > len(own) for n, own in enumerate(probabilities, 1)):
            for n in range(2, len(tables) + 1):
                weights[n - 1] = renormalised(probabilities, weights, n)
    return models


def renormalised(probabilities: list[dict[str, float]], weights: list[dict[str, float]], n: int) -> dict[str, float]:
    """Back-off weights of the contexts of order n: what its n-grams leave, over what the lower orders leave for it."""

    def lower(gram: str) -> float:
        factor = 1.0
        while gram not in probabilities[len(gram) - 1]:
            factor *= weights[len(gram) - 1].get(gram[:-1], 1.0)
            gram = gram[1:]  # ends at a single symbol, and those are all there
        return factor * probabilities[len(gram) - 1][gram]

    taken: dict[str, tuple[float, float]] = {}
    for gram, p in probabilities[n - 1].items():
        mine, below = taken.get(gram[:-1], (0.0, 0.0))
        taken[gram[:-1]] = (mine + p, below + lower(gram[1:]))
    return {c: max(1 - mine, 1e-6) / max(1 - below, 1e-6) for c, (mine, below) in taken.items()}


def gram_hash(grams: list[str]) -> np.ndarray:
    """The hash of each n-gram, all of one length, as `hashes` gives it at the last symbol."""
    codes = np.array([[0 if c == " " else ord(c) for c in g] for g in grams], np.uint32)
    h = np.zeros(len(grams), np.uint64)
    for n in range(codes.shape[1]):
        h = (h ^ (codes[:, codes.shape[1] - 1 - n].astype(np.uint64) + np.uint64(1 + (n << 24)))) * MIX
        h ^= h >> np.uint64(29)
    return h


def build(counts: dict[str, dict[str, int]], order: int) -> LanguageModels:
    """The models of all languages from their counts of n-grams of length `order`."""
    languages = sorted(counts)
    vocabulary = max(2, len({g[-1] for c in counts.values() for g in c}) + 1)
    return assemble(languages, [kneser_ney(counts[name], order, vocabulary) for name in languages], order, vocabulary)


def assemble(languages: list[str], fitted: list[tuple[list[dict], list[dict]]], order: int, vocabulary: int) -> LanguageModels:
    """One table per order from the probabilities and back-off weights of each language."""
    lowest = np.log(1e-7)
    tables, backoff = [], []
    for n in range(1, order + 1):
        grams = sorted(set().union(*(p[n - 1] for p, _ in fitted)))
        rows = np.full((len(grams), len(languages)), lowest, np.float32)
        for k, (probabilities, weights) in enumerate(fitted):
            for i, gram in enumerate(grams):
                # A language that lacks the n-gram backs off inside its own model.
                rest, log = gram, 0.0
                while rest not in probabilities[len(rest) - 1]:
                    if len(rest) == 1:
                        log += np.log(0.5 / vocabulary)
                        break
                    log += np.log(max(weights[len(rest) - 1].get(rest[:-1], 1.0), 1e-6))
                    rest = rest[1:]
                else:
                    log += np.log(probabilities[len(rest) - 1][rest])
                rows[i, k] = log
        keys = gram_hash(grams) if grams else np.zeros(0, np.uint64)
        order_ = np.argsort(keys)
        tables.append(HashTable(keys[order_], rows[order_]))
        if n < order:
            contexts = sorted(set().union(*(w[n] for _, w in fitted)))
            own = np.zeros((len(contexts), len(languages)), np.float32)
            for k, (_, weights) in enumerate(fitted):
                own[:, k] = [np.log(max(weights[n].get(c, 1.0), 1e-6)) for c in contexts]
            keys = gram_hash(contexts) if contexts else np.zeros(0, np.uint64)
            order_ = np.argsort(keys)
            backoff.append(HashTable(keys[order_], own[order_]))
    return LanguageModels(languages, tables, backoff, float(np.log(0.5 / vocabulary)))


def train(
    labelled: DataFrame,
    *,
    order: int = 4,
    fit_rows: int = 600,
    calibrate_rows: int = 200,
    max_ngrams: int | None = None,
    margin: float = 0.6,
) -> LanguageModels:
    """Models from (doc_id, text, lang), of all languages that have texts with letters.

    Fitted on a bounded sample: per language the `fit_rows` + `calibrate_rows`
    documents with the lowest hashes of id and text, or all if there are fewer.
    The last of them, in the proportion of `calibrate_rows`, are held out from
    the counts, one at least wherever a language has two documents. The limit of
    a language is their highest cross-entropy plus `margin` nats. A language with
    fewer than LEAST_HELD_OUT of them has at least the highest of all languages,
    and if nothing could be held out anywhere, the limit is an even guess. The
    statistics are those of all n-grams of the sample, and so is the model, unless
    `max_ngrams` makes it smaller: then the most frequent of each language and
    order are kept. Its table has a column per language, so memory grows with
    languages times n-grams; that is meant for tens of languages. Rows whose
    text or language is null, or without letters, are left out; no rows give a
    model without languages.
    """
    rows = labelled.where(r"text is not null and lang is not null and text rlike r'\p{L}'").select(
        "lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h")
    )
    # The lowest hashes are found without the texts; groups are split before they are ordered.
    # What is broadcast has at most fit_rows + calibrate_rows rows per language.
    spread = rows.select("lang", "h").withColumn("salt", F.pmod("h", F.lit(64)))
    some = spread.withColumn("n", F.row_number().over(Window.partitionBy("lang", "salt").orderBy("h")))
    some = some.where(F.col("n") <= fit_rows + calibrate_rows)
    some = some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    some = some.where(F.col("n") <= fit_rows + calibrate_rows)
    some = some.withColumn("held", F.max("n").over(Window.partitionBy("lang")))
    part = F.floor(F.col("held") * calibrate_rows / (fit_rows + calibrate_rows))
    held = F.when(F.col("held") > 1, F.greatest(part, F.lit(1))).otherwise(0)
    some = some.select("lang", "h", "n", (F.col("n") > F.col("held") - held).alias("spare")).distinct()
    sample = stored(rows.join(F.broadcast(some), ["lang", "h"]).dropDuplicates(["lang", "n"]), "language-sample")

    def count(table: pa.Table) -> pa.Table:
        counts = count_ngrams(table.column("text").to_pylist(), order)
        langs = pa.array([table.column("lang")[0].as_py()] * len(counts), pa.string())
        return pa.table({"lang": langs, "gram": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    fit = sample.where("not spare").withColumn("part", F.col("n") % 8)
    grams = fit.groupBy("lang", "part").applyInArrow(count, "lang string, gram string, n long")
    grams = stored(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-ngrams")
    tables, numbers, vocabulary = kneser_ney_tables(grams, order)
    fitted = pruned(tables, numbers, max_ngrams)
    languages = sorted(fitted)
    models = assemble(languages, [fitted[x] for x in languages], order, vocabulary)
    models_of = share(labelled.sparkSession, models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices(batch, 1, 400_000):
                langs = own.column(0).to_pylist()
                entropy, n = models_of().cross_entropy(own.column(1).to_pylist())
                names = models_of().languages
                found = [float(entropy[i, names.index(x)]) if x in names and n[i] > 3 else None for i, x in enumerate(langs)]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(found, pa.float64())], ["lang", "entropy"])

    if models.languages:
        spare = sample.where("spare").select("lang", "text")
        high = spare.mapInArrow(measure, "lang string, entropy double").where("entropy is not null")
        high = high.groupBy("lang").agg(F.max("entropy").alias("e"), F.count("*").alias("n"))
        models.limit = limits(models, {r["lang"]: (r["e"], r["n"]) for r in high.collect()}, margin)
    return models


def limits(models: LanguageModels, held_out: dict[str, tuple[float, int]], margin: float) -> np.ndarray:
    """The limit per language, from the highest cross-entropy and the number of its held-out texts."""
    if not held_out:
        return np.full(len(models.languages), np.log(0.5) - models.unseen)  # log of the vocabulary
    pooled = max(e for e, _ in held_out.values())
    own = [held_out.get(x, (pooled, 0)) for x in models.languages]
    return np.array([(e if n >= LEAST_HELD_OUT else max(e, pooled)) + margin for e, n in own])


PREDICTED = "lang_pred string, score double, cross_entropy double, rejected boolean"


def predict(docs: DataFrame, models: LanguageModels, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) with lang_pred, score, cross_entropy and rejected.

    Only the text is scored, as a whole. A null text, or one without a letter,
    is `und`, scores 0 and is rejected. Kept columns with a result's name give way.
    """
    results = {"lang_pred", "score", "cross_entropy", "rejected"}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in results]
    models_of = share(docs.sparkSession, models)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices(batch, n, 200_000):
                texts = [t or "" for t in own.column(n).to_pylist()]
                names, score, entropy, rejected = models_of().predict(texts)
                yield pa.RecordBatch.from_arrays(
                    [*own.columns[:n], pa.array(names, pa.string()), pa.array(score), pa.array(entropy), pa.array(rejected)],
                    [*(f"c{i}" for i in range(n)), "lang_pred", "score", "cross_entropy", "rejected"],
                )
        trim()

    given = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(keep)], docs[text_col].cast("string").alias("text"))
    fields = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    out = given.mapInArrow(run, ", ".join([*fields, PREDICTED]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *sorted(results))
