"""Byte-level BPE over all documents: every distinct word is encoded once.

1. Blocks of documents are cut into pre-tokens, once. A block is stored as, in
   order of position, a code for each pre-token, and as the lists of its
   distinct pre-tokens by the bucket of their hash.
2. The lists go to their buckets. A bucket encodes each distinct pre-token once
   and returns the ids to every block that asked.
3. Blocks, where they are stored, join the ids to their codes and reassemble
   documents by position.

So what is shuffled are the distinct words of blocks and their ids, never a row
per word nor the texts, and a word that fills a third of all texts is one entry
per block.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.chunks import PieceCache
from panelwise.llm.common import (
    bucketed,
    buckets_of,
    pack_arrays,
    pack_batch,
    per_worker,
    slices,
    spread,
    text_column,
    trim,
    unpack_arrays,
    unpack_batch,
)

PACKED = "block string, bucket int, packed binary"
TEXTS = -1  # in place of a bucket: the codes of the block's texts


def parse_ranks(tiktoken_file: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines of a vocabulary file."""
    pairs = (line.split() for line in tiktoken_file.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def rank_encoder(tiktoken_file: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding(
        "ranks", pat_str=pattern, mergeable_ranks=parse_ranks(tiktoken_file), special_tokens={}
    )


class Codes(dict):
    """Words to their codes, as four bytes, in the order in which words are first asked for."""

    def __missing__(self, word: str) -> bytes:
        code = self[word] = len(self).to_bytes(4, "little")
        return code


class Block:
    """Pre-tokens of a run of documents: distinct words, and their codes by position."""

    def __init__(self, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.code = Codes()
        self.cache = PieceCache(self._codes, 1 << 62)
        self.batches: list[pa.RecordBatch] = []
        self.sequences: list[bytes] = []
        self.size = 0

    def _codes(self, texts: list[str]) -> Iterator[bytes]:
        of, find = self.code.__getitem__, self.find
        for text in texts:
            if text.isalpha() or (text[0] == " " and text[1:].isalpha()):  # letters are one match
                yield of(text)
            else:
                yield b"".join(map(of, find(text)))

    def add(self, batch: pa.RecordBatch, texts: list[str]) -> None:
        self.sequences += self.cache.encode_texts(texts)
        self.batches.append(batch)
        self.size += sum(map(len, texts))

    def close(self) -> None:
        """No more texts come: what was kept to encode them goes."""
        self.cache = None

    def forget(self) -> None:
        self.code, self.batches, self.sequences = Codes(), [], []

    def key(self, number: int) -> str:
        """Names the block by its place and its words."""
        digest = xxhash.xxh3_64_hexdigest("\0".join(self.code).encode())
        return f"{TaskContext.get().partitionId()}-{number}-{digest}"


def cut(batches, pattern: str, text_at: int, block_chars: int) -> Iterator[tuple[str, Block]]:
    """Blocks of about `block_chars` characters; other columns travel with them."""
    number, block = 0, Block(pattern)
    for batch in batches:
        for own in slices(batch, text_at, 2_000_000):
            kept = pa.RecordBatch.from_arrays(
                [own.column(i) for i in range(text_at)], [f"c{i}" for i in range(text_at)]
            )
            block.add(kept, own.column(text_at).to_pylist())
            if block.size >= block_chars:
                block.close()
                yield block.key(number), block
                number, block = number + 1, Block(pattern)
                trim()
    if block.batches:
        block.close()
        yield block.key(number), block
    del block
    trim()


def pack_words(words: list[str]) -> bytes:
    raw = [w.encode() for w in words]
    return pack_arrays(np.array([len(w) for w in raw], np.uint32), np.frombuffer(b"".join(raw), np.uint8))


def unpack_words(packed: bytes) -> list[str]:
    lengths, raw = unpack_arrays(packed, "u4", "u1")
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    raw = raw.tobytes()
    return [raw[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)]


def by_bucket(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes in bucket order, and where each bucket starts."""
    place = np.array([xxhash.xxh3_64_intdigest(w.encode()) % buckets for w in words], np.int64)
    order = np.argsort(place, kind="stable")
    return order, np.searchsorted(place[order], np.arange(buckets + 1))


def out_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


ARROW_PACKED = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("packed", pa.binary())])


def encode(
    docs: DataFrame,
    tiktoken_file: bytes,
    pattern: str,
    *,
    text_col: str = "text",
    keep: list[str] | None = None,
    buckets: int | None = None,
    block_chars: int = 8_000_000,
) -> DataFrame:
    """The columns `keep` (by default doc_id) and `ids`, an array of token ids, per row.

    Each match of `pattern` is encoded on its own, without special tokens. A
    null or empty text has no ids. The pattern must keep a run of letters, with
    the blank before it, together and have white space only at a token's start. Equal rows give equal rows; no row, no row.
    Columns not kept are not read; a kept column called `ids` gives way. The
    blocks are cut and stored when this is called, the ids joined when the
    result is read. A text longer than `block_chars` is a block of its own.
    """
    spark = docs.sparkSession
    keep = [c for c in (["doc_id"] if keep is None else keep) if c.lower() != "ids"]
    buckets = buckets or buckets_of(spark)
    kept = [docs[c].alias(f"c{i}") for i, c in enumerate(keep)]
    rows = docs.select(*kept, text_column(docs, text_col).alias("text"))
    text_at = len(keep)
    vocabulary = spark.sparkContext.broadcast(tiktoken_file)

    def answer(table: pa.Table) -> pa.Table:
        encoder = per_worker(
            f"ranks-{hash(vocabulary.value)}-{pattern}", lambda: rank_encoder(vocabulary.value, pattern)
        )
        ids: dict[str, list[int]] = {}
        out = []
        for row in table.to_pylist():
            words = unpack_words(row["packed"])
            for w in words:
                if w not in ids:
                    ids[w] = encoder.encode_ordinary(w)
            found = [ids[w] for w in words]
            flat = np.array([i for f in found for i in f], np.uint32)
            lengths = np.array([len(f) for f in found], np.uint32)
            out.append((row["block"], row["bucket"], pack_arrays(lengths, flat)))
        return pa.Table.from_batches([out_batch(out, ARROW_PACKED)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = cut(batches, pattern, text_at, block_chars)
        for key, block in blocks:
            yield from packed(key, block)
            # The next block is cut while this loop's names still hold the last one.
            block.forget()
            trim()

    def packed(key: str, block: Block) -> Iterator[pa.RecordBatch]:
        words = list(block.code)
        order, starts = by_bucket(words, buckets)
        for b in range(buckets):
            own = [words[c] for c in order[starts[b] : starts[b + 1]]]
            if own:
                yield out_batch([(key, b, pack_words(own))], ARROW_PACKED)
        # Lists of the codes in bucket order, the positions, and the rows' other columns.
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        del words, order
        lengths = np.array([len(s) // 4 for s in block.sequences], np.int64)
        codes = rank[np.frombuffer(b"".join(block.sequences), "<u4")]
        # The bytes of a number apart: those that seldom change compress well.
        planes = codes.view(np.uint8).reshape(-1, 4).T.reshape(-1)
        del codes
        table = pa.Table.from_batches(block.batches)
        rest = pack_batch(table.combine_chunks().to_batches()[0]) if text_at else b""
        whole = pack_arrays(np.frombuffer(rest, np.uint8), starts.astype(np.int64), lengths, planes)
        yield out_batch([(key, TEXTS, whole)], ARROW_PACKED)

    fields = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    schema = ", ".join([*fields, "ids array<int>"])

    def reassemble(
        key: tuple, shipped: Iterator[pa.RecordBatch], answers: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        mine = [r for b in shipped for r in b.to_pylist()]
        told = {r["bucket"]: r["packed"] for b in answers for r in b.to_pylist()}
        for row in mine:
            rest, starts, lengths, planes = unpack_arrays(row["packed"], "u1", "i8", "i8", "u1")
            words = int(starts[-1])
            n_ids, first = np.zeros(words, np.int64), np.zeros(words, np.int64)
            flat, at = [np.zeros(0, np.uint32)], 0
            for b in np.flatnonzero(np.diff(starts)).tolist():
                own, ids = unpack_arrays(told[b], "u4", "u4")
                span = slice(int(starts[b]), int(starts[b + 1]))
                n_ids[span] = own
                first[span] = at + np.cumsum(own, dtype=np.int64) - own
                flat.append(ids)
                at += len(ids)
            flat = np.concatenate(flat)
            codes = planes.reshape(4, -1).T.copy().view(np.uint32).reshape(-1)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            table = unpack_batch(rest.tobytes()) if text_at else None
            at = 0
            while at < len(lengths):  # about a million words at a time
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + 1_000_000, "right")) - 1)
                own = codes[ends[at] : ends[to]]
                ids = flat[spread(first[own], n_ids[own])]
                through = np.concatenate([[0], np.cumsum(n_ids[own])])
                cuts = through[ends[at : to + 1] - ends[at]]
                lists = pa.ListArray.from_arrays(
                    pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32))
                )
                columns = [c.combine_chunks() for c in table.slice(at, to - at).columns] if table else []
                yield pa.RecordBatch.from_arrays([*columns, lists], [*(f"c{i}" for i in range(text_at)), "ids"])
                at = to

    blocks = bucketed(rows.mapInArrow(pack, PACKED), "block", "word-blocks")
    answers = blocks.where(F.col("bucket") != TEXTS).groupBy("bucket").applyInArrow(answer, PACKED)
    out = (
        blocks.where(F.col("bucket") == TEXTS)
        .groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(reassemble_tables(reassemble), schema)
    )
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "ids")


def reassemble_tables(make):
    """A function of two tables for cogrouped Arrow, from one of two iterators of batches."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        batches = list(make((), iter(left.to_batches()), iter(right.to_batches())))
        return pa.Table.from_batches(batches) if batches else None

    return run


def decode(encoded: DataFrame, tiktoken_file: bytes, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows with the bytes of their ids, by a join with the token-byte table.

    The table is as large as the vocabulary, so it is broadcast. Null ids give
    null, no ids no bytes; an unknown id raises. A column `out_col` is replaced.
    """
    table = encoded.sparkSession.sparkContext.broadcast(tiktoken_file)
    rows = encoded.drop(out_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{out_col}` binary"])
    at = rows.columns.index(ids_col)

    def load() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ranks = parse_ranks(table.value)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        lengths = np.array([len(t) for t in tokens], np.int64)
        return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, starts, lengths = per_worker(f"token-bytes-{hash(table.value)}", load)
        for batch in batches:
            for from_ in range(0, batch.num_rows, 200):
                own = batch.slice(from_, 200)
                column = own.column(at)
                ids = np.asarray(column.flatten(), np.int64)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(lengths) or not lengths[ids].all()):
                    raise ValueError("an id is not in the token-byte table")
                raw = flat[spread(starts[ids], lengths[ids])].tobytes()
                through = np.concatenate([[0], np.cumsum(lengths[ids])])
                sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0), np.int64)
                cuts = through[np.concatenate([[0], np.cumsum(sizes)])].tolist()
                given = column.is_valid().to_pylist()
                out = [raw[a:b] if ok else None for a, b, ok in zip(cuts, cuts[1:], given, strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(out, pa.binary())], [*own.schema.names, out_col]
                )

    return rows.mapInArrow(join, schema)
