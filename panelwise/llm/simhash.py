"""SimHash fingerprints and their links by the general pigeonhole principle.

The 64 bits are split into partitions that keep correlated bits together. Two
fingerprints within `distance` bits agree in some partition i up to T_i bits
whenever the thresholds sum to distance - partitions + 1 (a threshold of -1
leaves its partition out). Each fingerprint picks the cheapest such thresholds
by dynamic programming on its estimated candidates, probes those partitions
and verifies what it finds.

With two partitions a fingerprint is indexed twice and probes a number of
values that does not depend on the data, so work grows with the documents. A
partition value that many fingerprints share is expensive and gets -1; no
fingerprint has more than 2,080 links at 2 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import by_position, slices, stored, text_bytes

BITS = 64


def fingerprint(text: bytes, words: int = 3) -> int:
    """The SimHash of the `words`-word shingles of a lower-cased text."""
    found = text.lower().split()  # bytes: only A-Z and the six ASCII blanks
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fingerprint (a long holding its 64 bits) and text_hash per row.

    A null text is empty; a text without words has fingerprint 0. Ids become
    longs. A very long text is read alone, its shingles all at once by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices(batch, 1, 8_000_000):
                found = np.array([fingerprint(t, words) for t in text_bytes(own.column(1))], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), pa.array(found.view(np.int64)), own.column(2)],
                    ["doc_id", "fingerprint", "text_hash"],
                )

    text = docs[text_col].cast("string")
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")
    )
    return rows.mapInArrow(run, "doc_id long, fingerprint long, text_hash long")


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and for each pair of bits in how many both are set."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, together = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            raw = np.asarray(batch.column(0)).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            together += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        cells = np.append(together.reshape(-1), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells))), pa.array(cells)], ["cell", "n"])

    cells = prints.select("fingerprint").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table = np.zeros(BITS * BITS + 1, np.int64)  # always this many cells
    for cell, n in cells.collect():
        table[cell] = n
    return int(table[-1]), table[:-1].reshape(BITS, BITS)


def group_bits(n: int, together: np.ndarray, partitions: int) -> list[list[int]]:
    """Equal partitions, each grown from a seed by the bits most correlated with it."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    cor = np.abs(cov / np.outer(scale, scale))
    free, groups = set(range(BITS)), []
    for left in range(partitions, 0, -1):
        size = len(free) // left
        seed = max(sorted(free), key=lambda b: sum(sorted(cor[b, list(free - {b})])[-size + 1 :]))
        group = [seed]
        free.discard(seed)
        while len(group) < size:
            best = max(sorted(free), key=lambda b: cor[b, group].sum())
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def project(prints: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint as one number."""
    out = np.zeros(len(prints), np.uint64)
    for place, bit in enumerate(bits):
        out |= ((prints >> np.uint64(bit)) & np.uint64(1)) << np.uint64(place)
    return out


def balls(width: int, radius: int) -> list[np.ndarray]:
    """For each distance up to `radius`, the masks that flip so many of `width` bits."""
    return [
        np.array([sum(1 << b for b in c) for c in combinations(range(width), r)], np.uint64)
        for r in range(radius + 1)
    ]


def choose_thresholds(costs: np.ndarray, total: int) -> np.ndarray:
    """Per row the thresholds (-1 up) with the given sum and the least cost.

    costs[row, partition, t + 1] is the cost of threshold t. Dynamic programming
    over partitions and sums.
    """
    rows, partitions, levels = costs.shape
    sums = total + partitions + 1  # of (t + 1) over the partitions: 0 to total + partitions
    best = np.full((rows, sums), np.inf)
    best[:, 0] = 0
    picks = []
    for i in range(partitions):
        new, pick = np.full((rows, sums), np.inf), np.zeros((rows, sums), np.int8)
        for level in range(min(levels, sums)):
            there = best[:, : sums - level] + costs[:, i, level][:, None]
            better = there < new[:, level:]
            new[:, level:] = np.where(better, there, new[:, level:])
            pick[:, level:] = np.where(better, level, pick[:, level:])
        best = new
        picks.append(pick)
    at, out = np.full(rows, sums - 1), np.zeros((rows, partitions), np.int8)
    for i in range(partitions - 1, -1, -1):
        out[:, i] = picks[i][np.arange(rows), at] - 1
        at = at - (out[:, i] + 1)
    return out


def near_pairs(prints: DataFrame, distance: int = 2, partitions: int = 2, common: int = 16) -> DataFrame:
    """All pairs (a, b) of different fingerprints at most `distance` bits apart.

    `prints` has one row per distinct fingerprint. A pair may come from both
    sides; each is given once or twice. Partition values that at least `common`
    fingerprints share are counted exactly, others estimated from the bits.
    """
    n, together = bit_statistics(prints)
    groups = group_bits(n, together, partitions)
    odds = np.clip(np.diag(together) / max(n, 1), 1e-6, 1 - 1e-6)
    total = distance - partitions + 1
    radius = max(0, distance)
    masks = [balls(len(g), radius) for g in groups]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column(0)).view(np.uint64)
            for i, bits in enumerate(groups):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), i, np.int32)), pa.array(project(own, bits).view(np.int64)),
                     pa.array(own.view(np.int64))],
                    ["part", "value", "a"],
                )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column(0)).view(np.uint64)
            shared = np.array(batch.column(1).to_pylist(), np.float64).reshape(len(own), partitions)
            costs = np.zeros((len(own), partitions, radius + 2))
            for i, bits in enumerate(groups):
                agree, flipped = np.zeros(len(own)), np.ones((len(own), radius + 1))
                flipped[:, 1:] = 0  # elementary sums of the odds of a differing bit
                for bit in bits:
                    is_set = ((own >> np.uint64(bit)) & np.uint64(1)).astype(bool)
                    same = np.where(is_set, odds[bit], 1 - odds[bit])
                    agree += np.log(same)
                    for r in range(radius, 0, -1):
                        flipped[:, r] += flipped[:, r - 1] * (1 - same) / same
                within = n * np.exp(agree)[:, None] * np.cumsum(flipped, axis=1)
                probes = np.cumsum([len(m) for m in masks[i]])
                costs[:, i, 1:] = probes + np.maximum(within, shared[:, i : i + 1])
            chosen = choose_thresholds(costs, total)
            for i, bits in enumerate(groups):
                value = project(own, bits)
                for r in range(radius + 1):
                    use = chosen[:, i] >= r
                    for from_ in range(0, int(use.sum()), 2000):
                        some = np.flatnonzero(use)[from_ : from_ + 2000]
                        keys = (value[some][:, None] ^ masks[i][r]).reshape(-1)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(keys), i, np.int32)), pa.array(keys.view(np.int64)),
                             pa.array(np.repeat(own[some], len(masks[i][r])).view(np.int64))],
                            ["part", "value", "b"],
                        )

    indexed = prints.select("fingerprint").mapInArrow(index, "part int, value long, a long")
    hot = indexed.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") >= common)
    counts = (
        indexed.join(hot, ["part", "value"])
        .groupBy("a")
        .agg(*[F.coalesce(F.max(F.when(F.col("part") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(partitions)])
    )
    asked = prints.select("fingerprint").join(counts, F.col("fingerprint") == F.col("a"), "left")
    shared = F.array(*[F.coalesce(F.col(f"n{i}"), F.lit(0)).cast("double") for i in range(partitions)])
    probes = asked.select("fingerprint", shared.alias("shared")).mapInArrow(probe, "part int, value long, b long")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return (
        indexed.join(probes, ["part", "value"])
        .where((F.col("a") != F.col("b")) & (apart <= distance))
        .select("a", "b")
    )


def components(pairs: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for every node of the pairs (a, b).

    Alternating large and small stars: edges are re-hung on the smallest
    neighbour until nothing changes, in rounds that grow with the logarithm of
    the chains. Each round is stored, and each node's neighbours are only ever
    reduced to their minimum.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = stored(pairs.select(high.alias("a"), low.alias("b")).where("a > b").distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.union(down.select("a", F.col("m").alias("b"))).where("a > b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select("node", F.col("node").alias("root"))
    )


def link(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint, text_hash, root and component_id per row.

    Rows whose fingerprints differ by at most `distance` bits are linked;
    component_id is the smallest doc_id reachable (null when no row reached has
    one), root the smallest fingerprint. Equal fingerprints are one node, so
    copies and empty texts cost no links. No rows give no rows.
    """
    prints = stored(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "fingerprints")
    nodes = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = components(near_pairs(nodes, distance))
    rooted = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")
    )
    rooted = stored(rooted, "roots")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = rooted.select("fingerprint", "root").join(ids, "root")
    return prints.join(labels, "fingerprint", "left").select(
        "doc_id", "fingerprint", "text_hash", "root", "component_id"
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """The documents without those linked to another: one row of each component stays.

    It is the row with the smallest id (rows without id last), then the
    smallest text hash; of equal rows one stays. All columns are returned.
    """
    linked = link(docs, id_col=id_col, text_col=text_col, words=words, distance=distance)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    chosen = linked.groupBy("root").agg(first).select(
        F.col("first.doc_id").alias("chosen_id"), F.col("first.text_hash").alias("chosen_hash")
    )
    given, back = by_position(docs)
    named = [given.columns[docs.columns.index(c)] for c in (id_col, text_col)]
    text_hash = F.xxhash64(F.col(named[1]).cast("string"))
    same = F.col(named[0]).cast("long").eqNullSafe(F.col("chosen_id")) & (text_hash == F.col("chosen_hash"))
    return given.join(chosen.distinct(), same, "left_semi").dropDuplicates(named).select(*back)
