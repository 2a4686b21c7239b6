"""Document fingerprints of improbable features, in chains of Bloom filters.

Every window of so many bytes has an entropy; how rare that entropy is in the
whole corpus ranks the window. A window that is the first rarest of enough of
the stretches of as many windows around it becomes a feature. Features are
hashed into Bloom filters, `PER_FILTER` to each, and the filters of a document
are its fingerprint. Two fingerprints are compared by the bits their filters
share, beyond what chance explains and relative to what was possible.

One rule holds for texts of any length: the features of windows of 64 bytes,
and while there are fewer than `LEAST` of them in all, those of 16 bytes, then
all windows of 8, 4, 2 bytes and 1. What a text gets from a larger scale it
keeps, so texts on either side of a step have the features of that scale in
common.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import slices
from panelwise.llm.suffix_dedup import gram_hashes

WINDOW, SMALL = 64, 16  # scales whose windows are ranked by entropy
SHORT = (8, 4, 2, 1)  # scales of which all windows are taken
LEAST = 32
LEVELS = 1000
DULL = 100  # levels below are never features
BITS = 2048
PER_FILTER = 160
HASHES = 5
LANES = 4096
PLACE = np.uint64((1 << 32) - 1)


def entropy_levels(raw: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The entropy of each window of a buffer, from 0 to LEVELS.

    The buffer is cut into stretches whose windows slide side by side. Sums are
    whole numbers, so a window's level depends on its bytes alone.
    """
    n = len(raw) - window + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    lanes = min(LANES, max(1, n // 128))
    length = -(-n // lanes)
    padded = np.zeros(lanes * length + window, np.uint8)
    padded[: len(raw)] = raw
    stretches = np.lib.stride_tricks.as_strided(padded, (lanes, length + window), (length, 1)).T.copy()
    c = np.arange(window + 2)
    terms = np.round(c * np.log2(np.maximum(c, 1)) * (1 << 16)).astype(np.int64)
    gain = np.diff(terms)
    base = np.arange(lanes) * 256
    counts = np.zeros(lanes * 256, np.int16)
    total = np.zeros(lanes, np.int64)
    out = np.empty((length, lanes), np.int64)
    for step in range(window + length - 1):
        cell = base + stretches[step]
        seen = counts[cell]
        total += gain[seen]
        counts[cell] = seen + 1
        if step >= window - 1:
            at = step - window + 1
            out[at] = total
            cell = base + stretches[at]
            seen = counts[cell] - 1
            total -= gain[seen]
            counts[cell] = seen
    full = int(terms[window])
    return ((full - out) * LEVELS // full).T.reshape(-1)[:n].astype(np.int32)


def rank_levels(counts: np.ndarray) -> np.ndarray:
    """Rank of each level, the rarest first; -1 for dull ones."""
    order = np.lexsort((np.arange(len(counts)), counts))
    ranks = np.empty(len(counts), np.int64)
    ranks[order] = np.arange(len(counts))
    ranks[:DULL] = -1
    return ranks


def features(
    levels: np.ndarray, ranks: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int = WINDOW
) -> np.ndarray:
    """Places of features in a buffer of documents, by the ranks of their windows.

    A feature is the first rarest window of a quarter of the stretches that hold
    it; a stretch has as many windows as a window has bytes. Levels are of the
    windows that start at each byte.
    """
    own = ranks[levels]
    ranked = np.where(own < 0, np.uint64(1 << 30), own.astype(np.uint64)) << np.uint64(32)
    ranked |= np.arange(len(levels), dtype=np.uint64)
    low = ranked
    span = 1
    while span < window and len(low) > span:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span != window or not len(low):
        return np.zeros(0, np.int64)
    windows = np.maximum(0, ends - starts - window + 1)
    doc = np.searchsorted(ends, np.arange(len(low)), "right")
    inside = np.arange(len(low)) + window <= (starts + windows)[np.minimum(doc, len(ends) - 1)]
    winners = low[inside]
    winners = (winners[winners >> np.uint64(32) < np.uint64(1 << 30)] & PLACE).astype(np.int64)
    return np.flatnonzero(np.bincount(winners, minlength=len(levels)) >= window // 4)


def filters_of(hashes: np.ndarray) -> np.ndarray:
    """The Bloom filters of distinct features in their order, a row of bytes each."""
    _, first = np.unique(hashes, return_index=True)
    own = hashes[np.sort(first)]
    number = -(-len(own) // PER_FILTER)
    bits = np.zeros((number, BITS), bool)
    which = np.arange(len(own)) // PER_FILTER
    for i in range(HASHES):
        bits[which, ((own >> np.uint64(11 * i)) % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def ranked_features(texts: list[bytes], ranks: np.ndarray, window: int) -> list[np.ndarray]:
    """Hashes of each text's features of one scale."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(np.array([len(t) for t in texts], np.int64))
    starts = np.concatenate([[0], ends[:-1]]) if len(texts) else ends
    levels = entropy_levels(raw, window)
    found = features(levels, ranks, starts, ends, window) if len(levels) else np.zeros(0, np.int64)
    hashes = gram_hashes(raw, window)[found] if len(found) else np.zeros(0, np.uint64)
    cuts = np.searchsorted(found, np.concatenate([[0], ends]))
    return [hashes[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]


def digests(texts: list[bytes], ranks: np.ndarray, small_ranks: np.ndarray | None = None) -> list[np.ndarray]:
    """The filters of each text, by the ranks of levels of large and of small windows. An empty one has none."""
    own = ranked_features(texts, ranks, WINDOW)
    few = [i for i, h in enumerate(own) if len(h) < LEAST and texts[i]]
    small = ranked_features([texts[i] for i in few], ranks if small_ranks is None else small_ranks, SMALL)
    for i, more in zip(few, small, strict=True):
        own[i] = np.concatenate([own[i], more])
        raw = np.frombuffer(texts[i], np.uint8)
        for window in SHORT:
            if len(own[i]) >= LEAST:
                break
            own[i] = np.concatenate([own[i], gram_hashes(raw, window)])
    return [filters_of(h) for h in own]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the shorter chain its best overlap with the other's, on average."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return float(len(b) == 0)
    x, y = a.view(np.uint64), b.view(np.uint64)
    p, q = np.bitwise_count(x).sum(1).astype(np.float64), np.bitwise_count(y).sum(1).astype(np.float64)
    total = 0.0
    for own, n in zip(x, p, strict=True):
        shared = np.bitwise_count(own & y).sum(1)
        most, chance = np.minimum(n, q), n * q / BITS
        cut = chance + 0.3 * (most - chance)
        total += float(np.clip((shared - cut) / np.maximum(most - cut, 1e-9), 0, 1).max())
    return total / len(a)


def level_counts(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """How often each entropy level occurs in the large and in the small windows of all texts."""
    scales = (WINDOW, SMALL)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(scales), LEVELS + 1), np.int64)
        for batch in batches:
            for own in slices(batch, 0, 4_000_000):
                texts = [t.encode() for t in own.column(0).to_pylist() if t]
                raw = np.frombuffer(b"".join(texts), np.uint8)
                ends = np.cumsum([len(t) for t in texts])
                for row, window in zip(counts, scales, strict=True):
                    levels = entropy_levels(raw, window)
                    if len(levels):
                        at = np.arange(len(levels))
                        inside = at + window <= ends[np.searchsorted(ends, at, "right")]
                        row += np.bincount(levels[inside], minlength=LEVELS + 1)
        for window, row in zip(scales, counts, strict=True):
            yield pa.RecordBatch.from_pydict({"scale": [window] * len(row), "level": np.arange(len(row)), "n": row})

    texts = docs.select(docs[text_col].cast("string").alias("text"))
    counted = texts.mapInArrow(count, "scale long, level long, n long").groupBy("scale", "level").agg(F.sum("n").alias("n"))
    out = np.zeros((len(scales), LEVELS + 1), np.int64)  # always this many levels
    for scale, level, n in counted.collect():
        out[scales.index(scale), level] = n
    return out[0], out[1]


def followed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and the text of the next document by descending id, in range buckets.

    Rows: bucket, halo (the first row of the next bucket, for its text only),
    doc_id, text; sorted within partitions. Rows without id come last; equal
    ids go by the hash of their texts. After the last row comes the first.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = rows.count()
    # Splitters only balance the buckets; about 50 keys each are drawn.
    share = min(1.0, 50.0 * parts / max(count, 1))
    drawn = rows.select("doc_id", "tie").sample(share, seed=1).collect()
    order = sorted(((r[0] is None, -(r[0] or 0), r[1]) for r in drawn))
    splitters = [order[len(order) * i // parts] for i in range(1, parts)] if order else []

    @F.pandas_udf("int")
    def bucket(missing: pd.Series, ids: pd.Series, ties: pd.Series) -> pd.Series:
        keys = zip(missing.tolist(), ids.tolist(), ties.tolist(), strict=True)
        return pd.Series([bisect_right(splitters, (no, -i, t)) for no, i, t in keys], dtype="int32")

    dealt = rows.withColumn("bucket", bucket(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "tie"))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), (-F.coalesce("doc_id", F.lit(0))).alias("id"), "tie")
    # One row per bucket.
    firsts = sorted(tuple(r) for r in dealt.groupBy("bucket").agg(F.min(rank).alias("f")).select("bucket", "f.no_id", "f.id", "f.tie").collect())
    before = [(firsts[i - 1][0], None if no else -i_, t) for i, (_, no, i_, t) in enumerate(firsts)]
    halo_of = spark.createDataFrame(before, "to_bucket int, first_id long, first_tie long")
    same = rows["doc_id"].eqNullSafe(halo_of["first_id"]) & (rows["tie"] == halo_of["first_tie"])
    halo = rows.join(F.broadcast(halo_of), same).select(
        F.col("to_bucket").alias("bucket"), F.lit(1).alias("halo"), "doc_id", "tie", "text"
    )
    both = dealt.select("bucket", F.lit(0).alias("halo"), "doc_id", "tie", "text").union(halo)
    down = F.col("doc_id").desc_nulls_last()
    return both.repartition(parts, "bucket").sortWithinPartitions("bucket", "halo", down, "tie")


FINGERPRINTED = """doc_id long, n_chars long, edited string, fingerprint binary, edited_fingerprint binary,
    near_edited double, near_next double"""


def edit(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike they and the next document's are.

    doc_id, n_chars, edited (the text), fingerprint, edited_fingerprint (the
    filters joined), near_edited, near_next. Null texts are empty; an empty
    fingerprint is like another empty one (1) and unlike all others (0). A
    single row follows itself. Other columns are not read.
    """
    ranks, small_ranks = (rank_levels(counts) for counts in level_counts(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows whose next row has not come yet, and the rows before them
        size = 0

        def flush(rows: list[tuple]) -> pa.RecordBatch | None:
            """Rows of one or more buckets, the last one only being followed."""
            texts = [r[3] for r in rows]
            pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
            if not pairs:
                return None
            edited = [edit(texts[i], texts[i + 1]) for i in pairs]
            made = digests([t.encode() for t in texts] + [e.encode() for e in edited], ranks, small_ranks)
            own, changed = made[: len(rows)], made[len(rows) :]
            columns = zip(
                *[
                    (rows[i][2], len(texts[i]), e, own[i].tobytes(), c.tobytes(), likeness(own[i], c), likeness(own[i], own[i + 1]))
                    for i, e, c in zip(pairs, edited, changed, strict=True)
                ],
                strict=True,
            )
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
            names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    # Of equal rows that could be the halo one is enough.
                    if row[1] and held and held[-1][1] and held[-1][0] == row[0]:
                        continue
                    held.append(row)
                    size += len(row[3])
                    if size > 2_000_000:
                        out = flush(held)
                        held = held[-1:]
                        size = len(held[0][3])
                        if out is not None:
                            yield out
        if held:
            out = flush(held)
            if out is not None:
                yield out

    rows = followed(docs, id_col, text_col).select("bucket", "halo", "doc_id", "text")
    return rows.mapInArrow(run, FINGERPRINTED)
