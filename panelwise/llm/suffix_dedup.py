"""Repeated passages across documents by a distributed sort of suffixes.

A byte is removed if a window of `length` bytes that covers it also starts in a
document with a smaller id. The window's first lowest-hashed k-gram is its
anchor; equal windows have equal anchors at equal offsets. So it is enough to
sort the suffixes that start at anchors (about one position in 16), together
with the bytes before them that their windows reach:

1. Documents are packed into blocks, stored once with the places of their
   anchors and bucketed, so that joining them with what they are told moves no
   text.
2. Blocks send the hashes of their anchors to the hash's bucket, with how many
   different surroundings each has there, and learn which occur in another
   block, and which have very many surroundings in all.
3. The bytes around every other anchor, its context, are digested; blocks send
   96 bits and the smallest document id per distinct context. Of the blocks
   that hold a context one is elected, so copies are sent once.
4. Elected blocks sort the suffixes (with the bytes before them) and send the
   sorted runs front-coded (common prefix length and the rest) to buckets by
   the hash of their first k bytes, so that all equal windows meet.
5. A bucket merges the runs with a loser tree. Each contender knows its common
   prefix with the last winner, so no known prefix is compared again. In one
   group of suffixes with the same k-gram the smallest id of each window is
   found, and told to all blocks that hold the context.
6. Blocks mark and cut the windows.

An anchor with very many different contexts, such as one at the edge of a
passage that a third of the documents hold, would make a large group. Its
windows are sent one by one instead, dealt by the hash of all their bytes, and
each is its own group. What counts are contexts, not blocks, so this is the
same for inputs of any size; anchors inside copies have few contexts however
often they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import (
    bucketed,
    buckets_of,
    pack_arrays,
    pack_batch,
    per_worker,
    remove,
    slices,
    spread,
    stored,
    stored_at,
    text_column,
    trim,
    unpack_arrays,
    unpack_batch,
)

GRAM = 20
NO_ID = np.iinfo(np.int64).max
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
STEP = 1 << 16  # windows looked at together; their place must fit into 17 bits
PLACE = np.uint64((1 << 17) - 1)

KEYED = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("packed", pa.binary())])
KEYED_SQL = "block string, bucket int, packed binary"
BLOCK = pa.schema([("block", pa.string()), ("packed", pa.binary()), ("anchors", pa.binary())])
BLOCK_SQL = "block string, packed binary, anchors binary"


def keyed(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, KEYED, strict=True)], schema=KEYED
    )


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The powers of a number modulo 2**64, from 0 on; short rows are kept."""

    def make(count: int) -> np.ndarray:
        out = np.full(count, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    usual = STEP + 256
    return make(n) if n > usual else per_worker(f"powers-{base}", lambda: make(usual))[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(raw: np.ndarray, *lengths: int) -> list[np.ndarray] | np.ndarray:
    """For each length a mixed 64-bit hash of so many bytes from each position; alone if one is asked."""
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
    inverse = powers(INVERSE, n)
    out = [
        mixed((sums[size:] - sums[: n - size + 1]) * inverse[: n - size + 1]) if n >= size else np.zeros(0, np.uint64)
        for size in lengths
    ]
    return out[0] if len(lengths) == 1 else out


def joined(texts: list[bytes] | pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the length of each; an Arrow array is not copied."""
    if isinstance(texts, list):
        return np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts), np.int64)
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], np.diff(ends).astype(np.int64)


def hashes_at(raw: np.ndarray, *asked: tuple[np.ndarray, int]) -> list[np.ndarray]:
    """What `gram_hashes` gives for so many bytes from each of the places, which are in order."""
    out = [np.empty(len(places), np.uint64) for places, _ in asked]
    longest = max(size for _, size in asked)
    inverse = powers(INVERSE, STEP)
    for at in range(0, len(raw), STEP):
        part = raw[at : at + STEP + longest]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(part)), out=sums[1:])
        for found, (places, size) in zip(out, asked, strict=True):
            a, z = np.searchsorted(places, [at, at + STEP])
            own = places[a:z] - at
            found[a:z] = mixed((sums[own + size] - sums[own]) * inverse[own])
    return out


def binary_of(column: pa.Array) -> pa.BinaryArray:
    """UTF-8 bytes of texts; null is empty."""
    return pc.fill_null(column.cast(pa.binary()), b"")


class Anchors:
    """The anchors of a block and the range of window starts that each stands for.

    Finding them is the costly part of a block, so it is done once: `packed`
    holds them in few bytes, and with it only the hashes are computed again.
    """

    def __init__(self, texts: list[bytes] | pa.BinaryArray, length: int, gram: int, packed: bytes | None = None):
        self.raw, self.lengths = joined(texts)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.length = length
        if packed is None:
            self._find(length, gram)
        else:
            steps, more, ahead = unpack_arrays(packed, "u4", "u1", "u1")
            self.low = np.cumsum(steps, dtype=np.int64)
            self.high, self.at = self.low + more, self.low + ahead
            asked = [(self.at, gram), (self.low, length), (self.high, length)]
            self.hash, self.first, self.last = hashes_at(self.raw, *asked)
        self.doc = np.searchsorted(self.ends, self.low, "right")

    def pack(self) -> bytes:
        steps = np.diff(self.low, prepend=0).astype(np.uint32)
        return pack_arrays(steps, (self.high - self.low).astype(np.uint8), (self.at - self.low).astype(np.uint8))

    def _find(self, length: int, gram: int) -> None:
        reach = length - gram + 1  # k-grams in a window
        parts = []
        for at in range(0, max(0, len(self.raw) - length + 1), STEP):
            to = min(at + STEP, len(self.raw) - length + 1)
            hashes, whole = gram_hashes(self.raw[at : to + length - 1], gram, length)
            ranked = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
            span = 1
            while span < reach:  # the least of ever longer ranges; ties go to the first place
                step = min(span, reach - span)
                ranked = np.minimum(ranked[: len(ranked) - step], ranked[step:])
                span += step
            place = (ranked & PLACE).astype(np.int64)
            # Windows that would cross the end of a document.
            near = self.ends[np.searchsorted(self.ends, at, "right") : np.searchsorted(self.ends, to + length)]
            crossing = np.zeros(to - at + 1, np.int32)
            np.add.at(crossing, np.clip(near - length + 1 - at, 0, to - at), 1)
            np.add.at(crossing, np.clip(near - at, 0, to - at), -1)
            windows = np.flatnonzero(np.cumsum(crossing[:-1]) == 0)
            if len(windows):
                place = place[windows]
                new = np.ones(len(windows), bool)
                new[1:] = (np.diff(place) != 0) | (np.diff(windows) != 1)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(windows)) - 1
                low, high = windows[first], windows[last]
                parts.append((place[first] + at, low + at, high + at, hashes[place[first]], whole[low], whole[high]))
        kinds = [np.int64] * 3 + [np.uint64] * 3
        columns = list(zip(*parts, strict=True)) if parts else [[np.zeros(0, k)] for k in kinds]
        self.at, self.low, self.high, self.hash, self.first, self.last = (np.concatenate(c) for c in columns)

    def choose(self, which: np.ndarray) -> None:
        self.at, self.low, self.high = self.at[which], self.low[which], self.high[which]
        self.doc, self.hash = self.doc[which], self.hash[which]
        self.first, self.last = self.first[which], self.last[which]


def in_buckets(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (bucket, 32 bits of the hash) in order, where buckets start, and each hash's place."""
    joint = ((hashes >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))
    distinct, place = np.unique(joint, return_inverse=True)
    return distinct, np.searchsorted(distinct >> np.uint64(32), np.arange(buckets + 1)), place


def surroundings(anchors: Anchors, place: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Per distinct anchor how many contexts it has in a block, and 16 bits of one of them."""
    reach = ((anchors.at - anchors.low) * 256 + (anchors.at - anchors.high)).astype(np.uint64)
    digest = mixed(mixed(anchors.first + reach) + anchors.last * np.uint64(0x94D049BB133111EB))
    one = np.zeros(count, np.uint16)
    one[place] = (digest >> np.uint64(48)).astype(np.uint16)
    contexts = np.bincount(place, minlength=count).astype(np.uint32)
    # Few anchors occur more than once in a block; of these the different contexts count.
    often = contexts[place] > 1
    distinct = np.unique((place[often].astype(np.uint64) << np.uint64(32)) | (digest[often] >> np.uint64(32)))
    own = np.bincount((distinct >> np.uint64(32)).astype(np.int64), minlength=count)
    contexts[own > 0] = own[own > 0]
    return contexts, one


def all_surroundings(number: np.ndarray, counts: np.ndarray, one: np.ndarray, values: int) -> np.ndarray:
    """Per anchor the contexts of all blocks that hold it, given each block's count and, of a single one, its digest.

    Where blocks have one context each, equal ones count once, so that copies
    do not add up; where a block has several, they do. A digest has 16 bits, so
    this is right up to some thousands and then too low, but far above any limit.
    """
    single = counts == 1
    distinct = np.unique((number[single].astype(np.uint64) << np.uint64(32)) | one[single].astype(np.uint64))
    alike = np.bincount((distinct >> np.uint64(32)).astype(np.int64), minlength=values)
    return alike + np.bincount(number[~single], counts[~single].astype(np.int64), minlength=values).astype(np.int64)


def make_key(alone: bool, suffix: bytes, left: bytes, nearest: int) -> bytes:
    """A context as bytes that sort by suffix, then by what precedes it, read backwards.

    The last two bytes say how far to the left its windows reach, at most and
    at least. Windows that stand alone sort after all others.
    """
    return bytes((alone,)) + suffix + left[::-1] + bytes((len(left), nearest))


def split_key(key: bytes, length: int) -> tuple[bytes, bytes, int, int]:
    """Suffix, reversed left context, most and least reach to the left."""
    end = 1 + length - key[-1]
    return key[1:end], key[end:-2], key[-2], key[-1]


def group_of(key: bytes, gram: int) -> bytes:
    """What contexts must share to be compared: the k-gram, or all of a window that stands alone."""
    return key if key[0] else key[: 1 + gram]


class Contexts:
    """Distinct (bytes around an anchor, reach of its windows), with the smallest id of each.

    They are in the order of bucket, 64 and 32 bits of their digest.
    """

    def __init__(self, anchors: Anchors, ids: np.ndarray, hot: np.ndarray, buckets: int):
        length = self.length = anchors.length
        self.raw = anchors.raw.tobytes()
        at, low, high, doc = anchors.at, anchors.low, anchors.high, anchors.doc
        # The windows of a hot anchor stand alone: each starts at its own "anchor".
        n = (high - low + 1)[hot]
        alone = spread(low[hot], n)
        self.at = np.concatenate([at[~hot], alone])
        self.low = np.concatenate([low[~hot], alone])
        self.high = np.concatenate([high[~hot], alone])
        self.id = ids[np.concatenate([doc[~hot], np.repeat(doc[hot], n)])]
        self.alone = np.arange(len(self.at)) >= len(at) - int(hot.sum())
        # 128 bits of all the bytes, of which 96 are kept.
        ends = (self.high + length).tolist()
        wide = b"".join(xxhash.xxh3_128_digest(self.raw[a:z]) for a, z in zip(self.low.tolist(), ends, strict=True))
        halves = np.frombuffer(wide, "<u8").reshape(-1, 2)
        reach = ((self.at - self.low) * 256 + (self.at - self.high)).astype(np.uint64) * np.uint64(2)
        reach += self.alone.astype(np.uint64)
        digest, check = mixed(halves[:, 0] + reach), mixed(halves[:, 1] + reach) >> np.uint64(32)
        deal = np.concatenate([anchors.hash[~hot], halves[len(self.at) - len(alone) :, 0]])
        bucket = ((deal >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((check, digest, bucket))
        new = np.ones(len(order), bool)
        new[1:] = False
        for column in (bucket, digest, check):
            new[1:] |= column[order][1:] != column[order][:-1]
        group = np.cumsum(new) - 1
        self.member = np.empty(len(order), np.int64)
        self.member[order] = group
        self.example = order[new]
        self.digest, self.check = digest[self.example], check[self.example].astype(np.uint32)
        self.least = np.full(len(self.example), NO_ID)
        np.minimum.at(self.least, self.member, self.id)
        self.cuts = np.searchsorted(bucket[self.example], np.arange(buckets + 1))

    def key(self, context: int) -> bytes:
        i = self.example[context]
        p, a, z = int(self.at[i]), int(self.low[i]), int(self.high[i])
        return make_key(bool(self.alone[i]), self.raw[p : z + self.length], self.raw[a:p], p - z)


def common_prefix(x: bytes, y: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes need no look."""
    if x == y:
        return len(x)
    end = min(len(x), len(y))
    while end - known > 8:  # halve the unknown part
        middle = (known + end) // 2
        if x[known:middle] == y[known:middle]:
            known = middle
        else:
            end = middle
    while known < end and x[known] == y[known]:
        known += 1
    return known


def front_code(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common prefix with the key before, length of the rest, and the rests joined."""
    shared, rests, last = [], [], b""
    for key in keys:
        n = common_prefix(last, key)
        shared.append(n)
        rests.append(key[n:])
        last = key
    return (
        np.array(shared, np.uint8),
        np.array([len(r) for r in rests], np.uint8),
        np.frombuffer(b"".join(rests), np.uint8),
    )


def front_decode(shared: np.ndarray, lengths: np.ndarray, rests: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(common prefix with the key before, key), one after another."""
    raw, at, last = rests.tobytes(), 0, b""
    for n, size in zip(shared.tolist(), lengths.tolist(), strict=True):
        last = last[:n] + raw[at : at + size]
        at += size
        yield n, last


def merge_runs(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[bytes, int]]:
    """(key, run) in order from sorted runs of (common prefix with the key before, key).

    A loser tree. Contenders carry their common prefix with the last key given
    out: the longer one is smaller, and only equal ones are compared, from
    there on. The winner's successor has its run's own common prefix.
    """
    k = len(runs)
    if k == 1:
        for _, key in runs[0]:
            yield key, 0
        return
    done = (-1, b"", -1)

    def head(run: int) -> tuple[int, bytes, int]:
        n, key = next(runs[run], (-1, b""))
        return (n, key, run) if n >= 0 else done

    def play(x: tuple, y: tuple) -> tuple[tuple, tuple]:
        """Winner and loser, the loser's common prefix now being with the winner."""
        if x[0] != y[0]:
            return (x, y) if x[0] > y[0] else (y, x)
        if x[2] < 0:
            return x, y
        n = common_prefix(x[1], y[1], x[0])
        if x[1][n:] <= y[1][n:]:
            return x, (n, y[1], y[2])
        return y, (n, x[1], x[2])

    losers: list[tuple] = [done] * k

    def build(node: int) -> tuple:
        if node >= k:
            n, key, run = head(node - k)
            return (0, key, run) if n >= 0 else done
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    champion = build(1)
    while champion[2] >= 0:
        yield champion[1], champion[2]
        node = champion[2] + k
        contender = head(champion[2])
        while node > 1:
            node >>= 1
            rival = losers[node]
            if rival[0] > contender[0]:
                losers[node], contender = contender, rival
            elif rival[0] == contender[0] and rival[2] >= 0:
                contender, losers[node] = play(rival, contender)
        champion = contender


def smallest_ids(group: list[tuple[bytes, int]], length: int) -> list[list[int]]:
    """For each (key, smallest id of its holders): the smallest id of each of its windows.

    The windows of a key reach b to a bytes to the left of the anchor, in this order.
    """
    split = [split_key(key, length) for key, _ in group]
    out: list[list[int]] = [[] for _ in group]
    for o in range(min(s[3] for s in split), max(s[2] for s in split) + 1):
        least: dict[tuple, int] = {}
        there = []
        for i, (suffix, left, a, b) in enumerate(split):
            if b <= o <= a:
                window = (suffix[: length - o], left[:o])
                there.append((i, window))
                known = least.get(window)
                if known is None or group[i][1] < known:
                    least[window] = group[i][1]
        for i, window in there:
            out[i].append(least[window])
    return out


def resolve(runs: list[tuple[np.ndarray, list[np.ndarray]]], gram: int, length: int) -> list[list[list[int]]]:
    """Per run of (smallest ids, front-coded keys) the verdicts (place in the run, from, to, smaller id).

    from and to say how far windows reach to the left. Every key occurs once.
    """
    verdicts: list[list[list[int]]] = [[] for _ in runs]
    counts = [0] * len(runs)
    leasts = [r[0].tolist() for r in runs]

    def settle(group: list[tuple[bytes, int]], holders: list[tuple[int, int]]) -> None:
        for (key, own), (run, place), ids in zip(group, holders, smallest_ids(group, length), strict=True):
            o = key[-1]
            for value, same in groupby(ids):
                n = len(list(same))
                if value < own:
                    verdicts[run].append([place, o, o + n - 1, value])
                o += n

    group, holders, start = [], [], None
    for key, run in merge_runs([front_decode(*r[1]) for r in runs]):
        place = counts[run]
        counts[run] = place + 1
        begins = group_of(key, gram)
        if begins != start:
            if len(group) > 1:  # alone, a context has nothing to learn
                settle(group, holders)
            group, holders, start = [], [], begins
        group.append((key, leasts[run][place]))
        holders.append((run, place))
    if len(group) > 1:
        settle(group, holders)
    return verdicts


def whole_characters(raw: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Of the bytes of a UTF-8 text those whose character is marked throughout."""
    leads = np.flatnonzero((raw & 0xC0) != 0x80)
    return np.repeat(np.logical_and.reduceat(gone, leads), np.diff(np.append(leads, len(raw))))


def repeated_passages(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    length: int = 50,
    gram: int = GRAM,
    buckets: int | None = None,
    block_bytes: int = 4_000_000,
    hot_contexts: int = 4096,
    characters: bool = False,
) -> DataFrame:
    """Per row the columns `keep`, n_bytes, the removed byte spans and the kept bytes.

    `spans` is an array of (start, end), maximal and in order; `kept` is
    binary. Whole texts are read; null is empty. Windows are judged on the
    input. Rows with the same id never remove each other's bytes; a row without
    id loses what any row with an id holds and takes nothing from others. Texts
    shorter than `length` stay as they are. A kept column whose name is one of
    the results' gives way. `hot_contexts` bounds what is compared in one group
    and changes no result. With `characters`, one goes only if all its bytes are
    repeated, and `kept` is a valid text.
    """
    spark = docs.sparkSession
    results = {"n_bytes", "spans", "kept"}
    keep = [c for c in ([id_col] if keep is None else keep) if c.lower() not in results]
    buckets = buckets or buckets_of(spark)
    rows = docs.select(
        docs[id_col].cast("long").alias("id"), text_column(docs, text_col).alias("text"),
        *[docs[c].alias(f"c{i}") for i, c in enumerate(keep)],
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, 0
        task = TaskContext.get().partitionId()

        def done() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            anchors = Anchors(binary_of(whole.column(1)), length, gram).pack()
            row = [[f"{task}-{number}"], [pack_batch(whole)], [anchors]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, BLOCK, strict=True)], schema=BLOCK)

        for batch in batches:
            for own in slices(batch, 1, block_bytes // 4):
                held.append(own)
                size += pc.sum(pc.binary_length(own.column(1))).as_py() or 0
                if size >= block_bytes:
                    yield done()
                    held, size, number = [], 0, number + 1
                    trim()
        if held:
            yield done()

    def load(packed: bytes) -> tuple[pa.Table, pa.BinaryArray, np.ndarray]:
        table = unpack_batch(packed)
        ids = np.asarray(table.column(0).fill_null(NO_ID).combine_chunks(), np.int64)
        return table, binary_of(table.column(1).combine_chunks()), ids

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                anchors = Anchors(load(row["packed"])[1], length, gram, row["anchors"])
                distinct, starts, place = in_buckets(anchors.hash, buckets)
                low = (distinct & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                counts, one = surroundings(anchors, place, len(distinct))
                for b in np.flatnonzero(np.diff(starts)).tolist():
                    own = slice(starts[b], starts[b + 1])
                    yield keyed([(row["block"], b, pack_arrays(low[own], counts[own], one[own]))])
                del anchors, distinct, low, place, counts, one
                trim()

    def answer(table: pa.Table) -> pa.Table:
        rows_ = table.to_pylist()
        asked = [unpack_arrays(r["packed"], "u4", "u4", "u2") for r in rows_]
        low, counts, one = (np.concatenate(c) for c in zip(*asked, strict=True))
        values, number, n = np.unique(low, return_inverse=True, return_counts=True)
        elsewhere, hot = n > 1, all_surroundings(number, counts, one, len(values)) > hot_contexts
        out, at = [], 0
        for row, own in zip(rows_, asked, strict=True):
            mine = number[at : at + len(own[0])]
            at += len(mine)
            out.append((row["block"], row["bucket"], pack_arrays(np.packbits(elsewhere[mine]), np.packbits(hot[mine]))))
        return pa.Table.from_batches([keyed(out)])

    def contexts(block: dict, told: list[dict]) -> tuple[pa.Table, Anchors, Contexts]:
        """The block's documents, anchors that may repeat, and their contexts."""
        trim()
        table, texts, ids = load(block["packed"])
        anchors = Anchors(texts, length, gram, block["anchors"])
        distinct, starts, place = in_buckets(anchors.hash, buckets)
        elsewhere, hot = np.zeros(len(distinct), bool), np.zeros(len(distinct), bool)
        for row in told:
            span = slice(int(starts[row["bucket"]]), int(starts[row["bucket"] + 1]))
            for flags, packed in zip((elsewhere, hot), unpack_arrays(row["packed"], "u1", "u1"), strict=True):
                flags[span] = np.unpackbits(packed, count=span.stop - span.start).astype(bool)
        # In one block only: worth a look if two documents of the block hold it.
        first, last = np.full(len(distinct), len(ids)), np.full(len(distinct), -1)
        np.minimum.at(first, place, anchors.doc)
        np.maximum.at(last, place, anchors.doc)
        which = (elsewhere | (first < last))[place]
        is_hot = hot[place][which]
        anchors.choose(which)
        return table, anchors, Contexts(anchors, ids, is_hot, buckets)

    def told_by(rows_: pa.Table, kind: int) -> list[dict]:
        return [r for r in rows_.to_pylist() if r["kind"] == kind]

    def digest(blocks: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for block in blocks.to_pylist():
            found = contexts(block, told.to_pylist())[2]
            for b in np.flatnonzero(np.diff(found.cuts)).tolist():
                own = slice(found.cuts[b], found.cuts[b + 1])
                out.append((block["block"], b, pack_arrays(found.digest[own], found.check[own], found.least[own])))
        return pa.Table.from_batches([keyed(out)])

    def same_contexts(rows_: list[dict]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        """Where each block's contexts start, their ids, the number of each one's digest, and each digest's elected."""
        asked = [unpack_arrays(r["packed"], "u8", "u4", "i8") for r in rows_]
        digests, checks, least = (np.concatenate(c) for c in zip(*asked, strict=True))
        order = np.lexsort((least, checks, digests))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(digests[order]) != 0) | (checks[order][1:] != checks[order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        starts = np.cumsum([0, *(len(a[0]) for a in asked)]).tolist()
        return starts, least, number, order[new]

    def elect(table: pa.Table) -> pa.Table:
        rows_ = sorted(table.to_pylist(), key=lambda r: r["block"])
        starts, least, _, elected = same_contexts(rows_)
        chosen = np.zeros(len(least), bool)
        chosen[elected] = True
        out = [(r["block"], r["bucket"], pack_arrays(np.packbits(chosen[a:z]))) for r, a, z in zip(rows_, starts, starts[1:], strict=False)]
        return pa.Table.from_batches([keyed(out)])

    def send(blocks: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for block in blocks.to_pylist():
            found = contexts(block, told_by(told, 0))[2]
            for row in told_by(told, 1):
                a, z = int(found.cuts[row["bucket"]]), int(found.cuts[row["bucket"] + 1])
                mine = a + np.flatnonzero(np.unpackbits(unpack_arrays(row["packed"], "u1")[0], count=z - a))
                run = sorted((found.key(c), c) for c in mine.tolist())
                if run:
                    order = np.array([c for _, c in run], np.int64)
                    packed = pack_arrays((order - a).astype(np.uint32), found.least[order], *front_code([k for k, _ in run]))
                    out.append((block["block"], row["bucket"], packed))
        return pa.Table.from_batches([keyed(out)])

    def merge(table: pa.Table) -> pa.Table:
        rows_, runs, places = table.to_pylist(), [], []
        for row in rows_:
            place, least, shared, lengths, rests = unpack_arrays(row["packed"], "u4", "i8", "u1", "u1", "u1")
            places.append(place)
            runs.append((least, [shared, lengths, rests]))
        out = []
        for row, place, found in zip(rows_, places, resolve(runs, gram, length), strict=True):
            if found:
                cells = np.array(found, np.int64)
                cells[:, 0] = place[cells[:, 0]]
                out.append((row["block"], row["bucket"], pack_arrays(cells.reshape(-1))))
        return pa.Table.from_batches([keyed(out)])

    def tell(digests_: pa.Table, verdicts_: pa.Table) -> pa.Table:
        """What each block must know: the smallest id of each of its contexts, and of some of their windows."""
        rows_ = sorted(digests_.to_pylist(), key=lambda r: r["block"])
        if not rows_:
            return pa.Table.from_batches([keyed([])])
        starts, least, number, elected = same_contexts(rows_)
        smallest = least[elected]
        place_of = {r["block"]: a for r, a in zip(rows_, starts, strict=False)}
        cells = []
        for row in verdicts_.to_pylist():
            own = unpack_arrays(row["packed"], "i8")[0].reshape(-1, 4).copy()
            own[:, 0] = number[own[:, 0] + place_of[row["block"]]]
            cells.append(own)
        cells = np.concatenate(cells) if cells else np.zeros((0, 4), np.int64)
        cells = cells[np.argsort(cells[:, 0], kind="stable")]
        where = np.searchsorted(cells[:, 0], np.arange(len(elected) + 1))
        out = []
        for r, a, z in zip(rows_, starts, starts[1:], strict=False):
            mine = number[a:z]
            n = where[mine + 1] - where[mine]
            own = cells[spread(where[mine], n)]
            packed = pack_arrays(smallest[mine], np.repeat(np.arange(z - a), n), own[:, 1], own[:, 2], own[:, 3])
            out.append((r["block"], r["bucket"], packed))
        return pa.Table.from_batches([keyed(out)])

    fields = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    kept_type = "string" if characters else "binary"
    schema = ", ".join([*fields, f"n_bytes long, spans array<struct<start: long, end: long>>, kept {kept_type}"])

    def cut(blocks: pa.Table, told: pa.Table) -> pa.Table:
        batches = []
        for block in blocks.to_pylist():
            batches.append(cut_block(*contexts(block, told_by(told, 0)), told_by(told, 2)))
        return pa.Table.from_batches(batches)

    def cut_block(table: pa.Table, anchors: Anchors, found: Contexts, told: list[dict]) -> pa.RecordBatch:
        change = np.zeros(len(anchors.raw) + 1, np.int32)

        def mark(low: np.ndarray, high: np.ndarray) -> None:
            np.add.at(change, low, 1)
            np.add.at(change, high + length, -1)

        by_context = np.argsort(found.member, kind="stable")
        where = np.searchsorted(found.member[by_context], np.arange(len(found.example) + 1))
        least = found.least.copy()
        for row in told:
            a, z = int(found.cuts[row["bucket"]]), int(found.cuts[row["bucket"] + 1])
            smallest, context, from_, to, value = unpack_arrays(row["packed"], *["i8"] * 5)
            least[a:z] = smallest
            context = context + a
            n = where[context + 1] - where[context]
            member = by_context[spread(where[context], n)]
            smaller = found.id[member] > np.repeat(value, n)
            member = member[smaller]
            mark(found.at[member] - np.repeat(to, n)[smaller], found.at[member] - np.repeat(from_, n)[smaller])
        mine = found.id > least[found.member]
        mark(found.low[mine], found.high[mine])
        np.cumsum(change, out=change)  # in place: these are the largest arrays of a block
        gone = change[:-1] > 0
        spans, kept = [], []
        for a, z in zip(anchors.starts.tolist(), anchors.ends.tolist(), strict=True):
            mask = gone[a:z]
            if characters and mask.any():
                mask = whole_characters(anchors.raw[a:z], mask)
            if not mask.any():
                spans.append([])
                kept.append(anchors.raw[a:z].tobytes())
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
            spans.append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
            kept.append(anchors.raw[a:z][~mask].tobytes())
        own = [table.column(f"c{i}").combine_chunks() for i in range(len(keep))]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [*own, pa.array(anchors.lengths), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(kept_type)]
        return pa.RecordBatch.from_arrays(columns, [*(f"c{i}" for i in range(len(keep))), "n_bytes", "spans", "kept"])

    def told_to(blocks_: DataFrame, run, schema_: str, *tables: DataFrame) -> DataFrame:
        """Each block with the rows told to it; a table's rows carry its number as `kind`."""
        told = reduce(DataFrame.union, [t.withColumn("kind", F.lit(i)) for i, t in enumerate(tables) if t is not None])
        return blocks_.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema_)

    blocks = bucketed(rows.mapInArrow(pack, BLOCK_SQL), "block", "passage-blocks")
    flags = stored(blocks.mapInArrow(ask, KEYED_SQL).groupBy("bucket").applyInArrow(answer, KEYED_SQL), "passage-flags")
    digests, digests_at = stored_at(told_to(blocks, digest, KEYED_SQL, flags), "passage-digests")
    elected, elected_at = stored_at(digests.groupBy("bucket").applyInArrow(elect, KEYED_SQL), "passage-elected")
    runs = told_to(blocks, send, KEYED_SQL, flags, elected)
    verdicts, verdicts_at = stored_at(runs.groupBy("bucket").applyInArrow(merge, KEYED_SQL), "passage-verdicts")
    answers = digests.groupBy("bucket").cogroup(verdicts.groupBy("bucket")).applyInArrow(tell, KEYED_SQL)
    out = told_to(blocks, cut, schema, flags, None, stored(answers, "passage-answers"))
    for path in (digests_at, elected_at, verdicts_at):  # the answers hold what they told
        remove(spark, path)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "spans", "kept")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without their repeated passages, all columns kept in place.

    A character goes if all its bytes are repeated, so that texts stay valid.
    `n_chars`, where there is one, counts what is left. A null text stays null.
    """
    where = {c: f"k{i}" for i, c in enumerate(docs.columns)}
    given = docs.select(*[docs[c].alias(k) for c, k in where.items()], docs[text_col].isNull().alias("no_text"))
    # Of the text no second copy travels: what is left of it, and whether it was null, say all.
    keep = [c for c in given.columns if c != where[text_col]]
    found = repeated_passages(given, id_col=where[id_col], text_col=where[text_col], keep=keep, characters=True, **options)
    out = []
    for f in docs.schema:
        if f.name == text_col:
            column = F.when(~F.col("no_text"), F.col("kept"))
        elif f.name == "n_chars":
            column = F.length("kept").cast(f.dataType)
        else:
            column = F.col(where[f.name])
        out.append(column.alias(f.name))
    return found.select(*out)
