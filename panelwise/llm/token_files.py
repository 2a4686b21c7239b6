"""Token ids in bit-packed files with block offsets.

A file holds documents in order. Its ids are cut into blocks of `BLOCK` ids,
and each block stores every id in `bits` bits, the fewest that hold the
vocabulary, lowest bit first, filled up to a whole byte. After the blocks:

    block offsets   uint64 x (blocks + 1), from the start of the file
    document ids    int64 x documents
    id missing      uint8 x documents
    first id        uint64 x (documents + 1), counted in the file
    footer          bits, ids per block: uint32; blocks, documents, ids: uint64;
                    magic: 8 bytes

So any range of ids is read by seeking to its blocks, and a block is unpacked
with whole-array operations.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.chunks import PieceCache
from panelwise.llm.common import per_worker, slices, text_column
from panelwise.session import scratch_dir
from panelwise.sources.files import read_range, resolve

MAGIC = b"PWBITS01"
FOOTER = "<IIQQQ8s"
BLOCK = 65_536
MANIFEST = "task int, part int, file string, n_docs long, n_ids long"
READ = "doc_id long, start long, n_tokens long, ids binary"


def width(vocabulary: int) -> int:
    """The fewest bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8), bitorder="little").tobytes()


def unpack_ids(raw: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little")
    places = np.uint32(1) << np.arange(bits, dtype=np.uint32)
    return (planes.reshape(n, bits) * places).sum(1, dtype=np.uint32)


class TokenFileWriter:
    """Writes one file; holds one block and the document table in memory."""

    def __init__(self, folder: str, name: str, bits: int):
        files, path = resolve(folder)
        files.create_dir(path, recursive=True)
        self.name, self.bits, self.out = name, bits, files.open_output_stream(f"{path}/{name}")
        self.offsets, self.doc_ids, self.firsts, self.rest = [0], [], [0], np.zeros(0, np.uint32)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.firsts += (self.firsts[-1] + np.cumsum(lengths)).tolist()
        ids = np.concatenate([self.rest, ids])
        full = len(ids) - len(ids) % BLOCK
        for at in range(0, full, BLOCK):
            self._block(ids[at : at + BLOCK])
        self.rest = ids[full:]

    def _block(self, ids: np.ndarray) -> None:
        raw = pack_ids(ids, self.bits)
        self.out.write(raw)
        self.offsets.append(self.offsets[-1] + len(raw))

    def close(self) -> tuple[int, int]:
        if len(self.rest):
            self._block(self.rest)
        n = len(self.doc_ids)
        for values, kind in (
            (self.offsets, "<u8"),
            ([d or 0 for d in self.doc_ids], "<i8"),
            ([d is None for d in self.doc_ids], "u1"),
            (self.firsts, "<u8"),
        ):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(struct.pack(FOOTER, self.bits, BLOCK, len(self.offsets) - 1, n, self.firsts[-1], MAGIC))
        self.out.close()
        return n, self.firsts[-1]


class TokenFileReader:
    """Random access to the ids of one file."""

    def __init__(self, folder: str, name: str):
        files, path = resolve(folder)
        self.handle = files.open_input_file(f"{path}/{name}")
        size = self.handle.size()
        foot = struct.unpack(FOOTER, read_range(self.handle, size - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
        self.bits, self.block, blocks, self.n_docs, self.n_ids, magic = foot
        if magic != MAGIC:
            raise ValueError(f"{name} is not a token file")
        tables = 8 * (blocks + 1) + 17 * self.n_docs + 8
        raw = read_range(self.handle, size - struct.calcsize(FOOTER) - tables, tables)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1).astype(np.int64)
        at = 8 * (blocks + 1)
        self.doc_ids = np.frombuffer(raw, "<i8", self.n_docs, at)
        self.missing = np.frombuffer(raw, "u1", self.n_docs, at + 8 * self.n_docs).astype(bool)
        self.firsts = np.frombuffer(raw, "<u8", self.n_docs + 1, at + 9 * self.n_docs).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the file, reading only their blocks."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        at, stop = int(self.offsets[first]), int(self.offsets[last + 1])
        raw = read_range(self.handle, at, stop - at)
        found = []
        for b in range(first, last + 1):
            own = raw[int(self.offsets[b]) - at : int(self.offsets[b + 1]) - at]
            found.append(unpack_ids(own, self.bits, min(self.block, self.n_ids - b * self.block)))
        return np.concatenate(found)[start - first * self.block : end - first * self.block]


# Fixed value: how byte-level BPE of this kind cuts pieces into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """Byte to the letter that stands for it in a byte-level vocabulary.

    Printable Latin-1 bytes stand for themselves, the others are numbered from 256 on.
    """
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def make_encoder(tokenizer_json: bytes) -> PieceCache:
    """Encodes distinct pieces of texts with the tokenizers library, as little-endian uint32.

    A byte-level BPE is asked for each distinct word of the pieces once, other
    tokenizers, and pieces that hold one of their special tokens, for whole
    pieces.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json.decode())
    parts = json.loads(tokenizer_json)
    before = parts.get("pre_tokenizer") or {}
    special = [t["content"] for t in parts.get("added_tokens", [])]
    by_word = (
        before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        and not parts.get("normalizer") and parts["model"]["type"] == "BPE"
    )
    find, letters, model = regex.compile(PATTERN).findall, byte_letters(), tokenizer.model
    holds_special = re.compile("|".join(map(re.escape, special)) or "(?!)").search
    as_bytes = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]

    # Letters alone, after one blank or none, hold no special token, and are one word.
    letters_alone = by_word and not any(t.removeprefix(" ").isalpha() or t == " " for t in special)

    class Words(dict):
        """Ids of words, worked out when first asked for."""

        def __missing__(self, word: str) -> bytes:
            if len(self) > 500_000:
                self.clear()
            if word.isascii() and word.isprintable():
                spelled = word.replace(" ", letters[32])
            else:
                spelled = word.encode().decode("latin-1").translate(letters)
            found = self[word] = b"".join([as_bytes[t.id] for t in model.tokenize(spelled)])
            return found

    words = Words()
    of = words.__getitem__

    def encode_one(text: str) -> bytes:
        if letters_alone and (text.isalpha() or (text[0] == " " and text[1:].isalpha())):
            return of(text)
        if not by_word or holds_special(text):
            return b"".join([as_bytes[i] for i in tokenizer.encode(text, add_special_tokens=False).ids])
        return b"".join(map(of, find(text)))

    class AfterBlank(dict):
        """Ids of pieces after a blank, worked out where they first occur, so that a text is looked up once."""

        def __missing__(self, piece: str) -> bytes:
            if not piece or piece[-1].isspace():  # goes on after the next blank
                raise KeyError(piece)
            found = self[piece] = encode_one(" " + piece)
            return found

    cache = PieceCache(lambda texts: map(encode_one, texts), 900_000)
    cache.after_blank = AfterBlank()
    return cache


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_json: bytes,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    shard_ids: int = 32_000_000,
) -> DataFrame:
    """Encode every whole text and write its ids, in ascending id order, under `path`.

    Each task writes its range of documents as files of about `shard_ids` ids
    (a document is never split between files) under names no other attempt
    uses; the returned manifest, stored beside them, names those that count.

    A null text is empty and holds only the end id. Rows without id come first.
    Rows with one id follow each other by the hash of their text. No rows: no
    files. Other columns are not read. Ids become longs. A text of any length is
    one document, encoded by one task in the pieces in which the tokenizer works.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(tokenizer_json)
    bits = width(max(Tokenizer.from_str(tokenizer_json.decode()).get_vocab_size(), end_id + 1))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = per_worker(f"tokenizer-{hash(model.value)}", lambda: make_encoder(model.value))
        end = np.array([end_id], "<u4").tobytes()
        task, part, writer = TaskContext.get().partitionId(), 0, None

        def done() -> pa.RecordBatch:
            n_docs, n_ids = writer.close()
            row = (task, part, writer.name, n_docs, n_ids)
            return pa.RecordBatch.from_pylist(
                [dict(zip(["task", "part", "file", "n_docs", "n_ids"], row, strict=True))],
                pa.schema([("task", pa.int32()), ("part", pa.int32()), ("file", pa.string()),
                           ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

        for batch in batches:
            for own in slices(batch, 1, 4_000_000):
                coded = [x + end for x in cache.encode_texts(own.column(1).to_pylist())]
                lengths = np.array([len(x) // 4 for x in coded], np.int64)
                if writer is None:
                    writer = TokenFileWriter(path, f"{task:06d}-{part:05d}-{uuid.uuid4().hex}.ids", bits)
                writer.add(own.column(0).to_pylist(), np.frombuffer(b"".join(coded), "<u4"), lengths)
                if writer.firsts[-1] >= shard_ids:
                    yield done()
                    writer, part = None, part + 1
        if writer is not None:
            yield done()

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    manifest = f"{path}/manifest"
    ordered.select("doc_id", "text").mapInArrow(write, MANIFEST).write.parquet(manifest)
    return spark.read.schema(MANIFEST).parquet(manifest)


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens and its ids as little-endian uint32.

    `start` counts the ids of all documents before it in all files.
    """
    spark = manifest.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = TokenFileReader(path, row["file"])
                firsts = reader.firsts
                at = 0
                while at < reader.n_docs:  # about 2 million ids at a time
                    to = max(at + 1, int(np.searchsorted(firsts, firsts[at] + 2_000_000, "right")) - 1)
                    raw = reader.ids(int(firsts[at]), int(firsts[to])).astype("<u4")
                    cuts = (firsts[at : to + 1] - firsts[at]).tolist()
                    ids = [raw[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(reader.doc_ids[at:to], pa.int64(), mask=reader.missing[at:to]),
                            pa.array(firsts[at:to] + row["file_start"], pa.int64()),
                            pa.array(np.diff(firsts[at : to + 1]), pa.int64()),
                            pa.array(ids, pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )
                    at = to

    # One row per file: small enough to order in one task. The starts travel with the files.
    before = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("file_start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    dealt = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    return dealt.mapInArrow(read, READ)


def token_files(docs: DataFrame, tokenizer_json: bytes, **options) -> DataFrame:
    """Write the files into a new folder of the shared storage and read them back."""
    path = scratch_dir(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, path, tokenizer_json, **options), path)
