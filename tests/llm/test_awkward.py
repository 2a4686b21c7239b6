"""Every earlier operator on very long texts, repeated rows, empty tables and clashing columns; the pipeline stage by stage."""

from __future__ import annotations

import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelwise.llm import (
    bpe,
    fingerprints,
    language_id,
    license_scan,
    mixing,
    simhash,
    suffix_dedup,
    token_files,
    toxicity,
)
from panelwise.llm.queries import RANKS, TOKENIZER, pattern, vocabulary
from tests.llm.test_operators import removed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "".join(f"word{i % 997} of a very long text, under the MIT License; line {i}\n" for i in range(25_000))  # 1.4 MB
ROWS = [
    (1, LONG, "en", "a", len(LONG)),
    (2, LONG[200_000:] + "end", "en", "a", 5),
    (3, "a short text of a few words", "en", "b", 5),
    (3, "a short text of a few words", "en", "b", 5),
    (4, None, None, None, None),
]
#: Names that operators use for columns of their own.
CLASHING = [
    "id", "tie", "bucket", "halo", "text_hash", "fingerprint", "edited", "blocks", "n_words", "labels", "score",
    "start", "n_tokens", "ids", "task", "part", "features", "lang_pred", "rejected", "word", "h", "draw", "tokens",
    "place", "epoch", "value", "node", "root", "component_id", "cell", "packed", "block", "n_bytes", "spans", "kept",
]


@pytest.fixture
def docs(frame):
    df = frame(SCHEMA, ROWS)
    for c in CLASHING:
        df = df.withColumn(c, F.lit(f"given {c}"))
    return df


@pytest.fixture
def nothing(docs):
    return docs.limit(0)


def test_token_files(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary(TOKENIZER).decode())
    found = token_files.token_files(docs, vocabulary(TOKENIZER), shard_ids=100_000).collect()
    start, want = 0, []
    for doc_id, text, *_ in ROWS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in found) == sorted(want)


def test_license_scan(docs):
    found = {(r.doc_id, r.n_words, r.n_base): r for r in license_scan.label_documents(docs).collect()}
    n = 25_000
    assert (1, sum(1 for _ in license_scan.words_of(LONG.encode())), n) in found
    assert {r.labels for r in found.values() if r.doc_id in (1, 2)} == {"mit"}
    assert {r.labels for r in found.values() if r.doc_id in (3, 4)} == {""}


def test_suffix_dedup(frame):
    # A quarter of a megabyte keeps the brute force short.
    rows = [(1, LONG[:250_000]), (2, LONG[100_000:260_000] + "end"), (3, "short"), (3, "short"), (4, None)]
    found = suffix_dedup.repeated_passages(frame("doc_id long, text string", rows), block_bytes=100_000).collect()
    assert sorted((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in found) == removed(rows)


def test_suffix_dedup_of_a_megabyte(docs):
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    left = {(r.doc_id, r.text) for r in out.collect()}
    texts = dict(left)
    assert texts[1] == LONG and texts[4] is None and texts[3] == ROWS[2][1]
    assert len(texts[2]) < 100  # all but its end is in the first


def test_mixing(docs):
    uses = mixing.mix(docs, repetition=2.0, block_tokens=100_000).collect()
    assert Counter(r.doc_id for r in uses if r.epoch == 0) == {1: 1, 2: 1, 3: 2, 4: 1}
    assert {r.tokens for r in uses if r.doc_id == 1} == {len(LONG.encode())}
    out = mixing.apply_mixture(docs, repetition=2.0)
    assert out.columns == docs.columns and {r["given"] for r in out.select(F.col("place").alias("given")).collect()} == {"given place"}
    assert Counter(r.doc_id for r in out.select("doc_id").collect())[3] >= 2


def test_fingerprints(docs):
    found = fingerprints.fingerprint_neighbours(docs).collect()
    assert Counter(r.doc_id for r in found) == {1: 1, 2: 1, 3: 2, 4: 1}
    same = {bytes(r.fingerprint) for r in found if r.doc_id == 3}
    assert len(same) == 1
    (long,) = (r for r in found if r.doc_id == 2)
    assert long.n_chars == len(ROWS[1][1]) and long.near_next > 0.1  # the next by falling id is the first


def test_simhash(docs):
    found = simhash.link(docs, words=3, distance=2).collect()
    prints = {r.doc_id: r.fingerprint & (2**64 - 1) for r in found}
    assert prints == {d: simhash.fingerprint((t or "").encode(), 3) for d, t, *_ in ROWS}
    assert len(found) == len(ROWS) and {r.component_id for r in found if r.doc_id == 3} == {3}
    kept = simhash.keep_one(docs, words=3, distance=2)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.select("doc_id").collect())[3] == 1


def test_toxicity(docs, nothing, frame):
    rows = [(i, f"text {i} number {i % 9} {'idiot' if i % 3 == 0 else 'person'} here", int(i % 3 == 0)) for i in range(200)]
    labelled = frame("doc_id long, text string, toxic int", rows + rows)  # every row twice
    model = toxicity.train(labelled)
    assert model.words.keys() == toxicity.train(frame("doc_id long, text string, toxic int", rows)).words.keys()
    found = toxicity.score(docs, model, keep=["doc_id", "features", "score", "word"])
    got = {(r.doc_id, r.score, r.predicted, r.word) for r in found.collect()}
    assert {(d, p, w) for d, _, p, w in got} == {(d, 0, "given word") for d in (1, 2, 3, 4)}
    assert toxicity.score(nothing, model).collect() == []
    insulting = frame("doc_id long, text string", [(1, LONG + " you idiot, you are an idiot. " * 30)])
    assert toxicity.score(insulting, model).first().predicted == 1


def test_bpe(docs):
    encoder = bpe.rank_encoder(vocabulary(RANKS), pattern())
    coded = bpe.encode(docs, vocabulary(RANKS), pattern(), keep=["doc_id", "block", "packed", "bucket"])
    assert sorted((r.doc_id, list(r.ids), r.block, r.packed, r.bucket) for r in coded.collect()) == sorted(
        (d, encoder.encode_ordinary(t or ""), "given block", "given packed", "given bucket") for d, t, *_ in ROWS
    )


def test_language_id(docs, nothing, spark, sf_dir):
    sample = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    models = language_id.train(sample)
    twice = language_id.train(sample.union(sample))
    assert models.languages == twice.languages
    found = language_id.predict(docs, models, keep=["doc_id", "lang_pred", "h", "n_words"]).collect()
    assert len(found) == len(ROWS) and {r.h for r in found} == {"given h"}
    assert {r.lang_pred for r in found if r.doc_id == 4} == {"und"} and len({(r.lang_pred, r.score) for r in found if r.doc_id == 3}) == 1
    assert language_id.predict(nothing, models).collect() == []


# The pipeline


def test_pipeline_stages_equal_brute_force(spark, sf_dir):
    """Each stage on what the one before kept."""
    import corpus_pipeline
    from panelwise.llm.queries import QUERIES

    stages = dict(corpus_pipeline.STAGES)
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")

    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=str)

    known = stages["language ID"](spark, given, sf_dir).cache()
    rejected = {r.doc_id for r in QUERIES["op10_language_id"](spark, sf_dir).where("rejected").collect()}
    assert rows(known) == rows(given.where(~F.col("doc_id").isin(list(rejected))))

    unique = stages["SimHash near-dedup"](spark, known, sf_dir).cache()
    prints = {r.doc_id: simhash.fingerprint((r.text or "").encode(), 3) for r in known.collect()}
    group = {d: d for d in prints}
    for d in sorted(prints):  # ids in order, so the smallest id names the group
        reach, seen = [d], {d}
        while reach and group[d] == d:
            at = reach.pop()
            for o in prints:
                if o not in seen and (prints[at] ^ prints[o]).bit_count() <= 2:
                    seen.add(o)
                    reach.append(o)
                    group[o] = min(group[o], d)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(d for d in prints if group[d] == d)
    assert rows(unique) == rows(known.where(F.col("doc_id").isin([d for d in prints if group[d] == d])))

    cut = stages["suffix-array dedup"](spark, unique, sf_dir).cache()
    want = {d: raw for d, _, _, raw in removed([(r.doc_id, r.text) for r in unique.collect()])}
    for r in cut.collect():
        # A character goes only if all its bytes do, so a cut through one leaves it.
        assert r.text.encode().decode() and abs(len(r.text.encode()) - len(want[r.doc_id])) <= 8 * r.text.count("") and r.n_chars == len(r.text)
        if r.text.isascii():
            assert r.text.encode() == want[r.doc_id]
    assert cut.columns == given.columns and cut.count() == unique.count()

    mixed = stages["mixing"](spark, cut, sf_dir).cache()
    times = Counter(r.doc_id for r in mixed.collect())
    held = Counter()
    for r in cut.collect():
        held[r.source] += len(r.text.encode())
    for r in cut.collect():
        assert 1 <= times[r.doc_id] <= 2
    used = Counter()
    for r in mixed.collect():
        used[r.source] += len(r.text.encode())
    assert all(held[s] <= used[s] <= 1.5 * held[s] + max(len(r.text.encode()) for r in cut.collect()) for s in held)

    encoder = bpe.rank_encoder(vocabulary(RANKS), pattern())
    coded = stages["byte-level BPE"](spark, mixed, sf_dir)
    assert Counter((r.doc_id, tuple(r.ids), r.n_tokens) for r in coded.collect()) == Counter(
        (r.doc_id, tuple(encoder.encode_ordinary(r.text or "")), len(encoder.encode_ordinary(r.text or ""))) for r in mixed.collect()
    )
