"""Each operator against a brute-force version, on awkward rows and on the sample table."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.llm import (
    bpe,
    chunks,
    fingerprints,
    language_id,
    license_scan,
    mixing,
    simhash,
    suffix_dedup,
    token_files,
    topk_search,
    toxicity,
)
from panelwise.llm.queries import QUERIES, RANKS, TOKENIZER, pattern, vocabulary

PASSAGE = "the long passage that several documents share, word for word, is here again"
AWKWARD = [
    (1, "Hello  world\n\n it's a <|endoftext|> test. MIT License!", "en", "a", 5),
    (2, None, None, "a", 0),
    (3, "", "en", None, 0),
    (4, "début " + PASSAGE + " fin é", "fr", "b", 1),
    (5, "other start " + PASSAGE + " other end", "en", "b", 1),
    (6, "x" * 120, "en", "b", 1),
    (7, "y" + "x" * 119 + "   z", "en", "b", 1),
    (7, "y" + "x" * 119 + "   z", "en", "b", 1),
    (8, "12345 ... \t\t ", "en", "b", 1),
    (None, "no id " + PASSAGE, "en", "c", 1),
    (9, ("Released under the MIT License. " + PASSAGE + " ") * 300, "en", "c", 9),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def awkward(frame):
    return frame(COLUMNS, AWKWARD)


@pytest.fixture
def nothing(frame):
    return frame(COLUMNS, [])


@pytest.fixture
def sample(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_pieces_keep_tokens_whole():
    import tiktoken  # noqa: F401

    encoder = bpe.rank_encoder(vocabulary(RANKS), pattern())
    for text in ["a  b", " a", "a \n b", "a\n b", "  x", "", " ", "it's 5 'll\tz  "]:
        whole = encoder.encode_ordinary(text)
        assert [i for p in chunks.pieces(text) for i in encoder.encode_ordinary(p)] == whole


@pytest.mark.parametrize("bits", [1, 7, 8, 16, 17, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(0).integers(0, 2**bits, 1001, dtype=np.uint32)
    raw = token_files.pack_ids(ids, bits)
    assert len(raw) == -(-1001 * bits // 8)
    assert (token_files.unpack_ids(raw, bits, 1001) == ids).all()


def test_random_access(tmp_path):
    ids = np.arange(200_000, dtype=np.uint32) % 100_000
    writer = token_files.TokenFileWriter(str(tmp_path), "f.ids", 17)
    writer.add([5, None], ids, np.array([150_000, 50_000]))
    assert writer.close() == (2, 200_000)
    reader = token_files.TokenFileReader(str(tmp_path), "f.ids")
    for a, z in [(0, 1), (65_535, 65_537), (131_000, 200_000), (7, 7)]:
        assert (reader.ids(a, z) == ids[a:z]).all()
    assert reader.missing.tolist() == [False, True] and reader.firsts.tolist() == [0, 150_000, 200_000]


@pytest.mark.parametrize("which", ["awkward", "sample"])
def test_token_files(which, request):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(which)
    tokenizer = Tokenizer.from_str(vocabulary(TOKENIZER).decode())
    read = token_files.token_files(docs, vocabulary(TOKENIZER), shard_ids=500).orderBy("start")
    got = [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in read.collect()]
    start, want = 0, []
    for doc_id, text in sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == want


@pytest.mark.parametrize("which", ["awkward", "sample"])
def test_bpe(which, request):
    docs = request.getfixturevalue(which).withColumn("ids", F.lit("clash"))
    encoder = bpe.rank_encoder(vocabulary(RANKS), pattern())
    coded = bpe.encode(docs, vocabulary(RANKS), pattern(), keep=["doc_id", "ids"], block_chars=3_000)
    decoded = bpe.decode(coded, vocabulary(RANKS)).collect()
    got = sorted((str(r["doc_id"]), list(r["ids"]), bytes(r["decoded"])) for r in decoded)
    want = sorted((str(d), encoder.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows_of(docs))
    assert got == want


def removed(rows, length=50):
    first = {}
    ranked = [(d if d is not None else 2**63 - 1, (t or "").encode()) for d, t in rows]
    for d, raw in ranked:
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            first[w] = min(d, first.get(w, d))
    out = []
    for d, raw in ranked:
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if first[raw[s : s + length]] < d:
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((d, len(raw), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("which", ["awkward", "sample"])
@pytest.mark.parametrize("options", [{}, {"block_bytes": 3_000, "hot_contexts": 1, "buckets": 3}])
def test_suffix_dedup(which, options, request):
    docs = request.getfixturevalue(which)
    found = suffix_dedup.repeated_passages(docs, **options).collect()
    got = [(2**63 - 1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], len(r["spans"]), bytes(r["kept"])) for r in found]
    assert sorted(got) == removed(rows_of(docs))


def test_remove_repeats_keeps_columns(awkward):
    out = suffix_dedup.remove_repeats(awkward)
    assert out.columns == awkward.columns
    left = {r["doc_id"]: r for r in out.collect()}
    assert left[2]["text"] is None and PASSAGE not in left[5]["text"] and PASSAGE in left[4]["text"]
    assert left[5]["n_chars"] == len(left[5]["text"])


def test_merge_of_runs_and_front_coding():
    rng = np.random.default_rng(1)
    runs = [sorted({bytes(rng.integers(97, 99, rng.integers(1, 12)).astype(np.uint8)) for _ in range(40)}) for _ in range(7)]
    coded = [suffix_dedup.front_decode(*suffix_dedup.front_code(r)) for r in runs]
    assert [k for k, _ in suffix_dedup.merge_runs(coded)] == sorted(k for r in runs for k in r)


def groups(values, near):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


@pytest.mark.parametrize("which", ["awkward", "sample"])
def test_simhash(which, request):
    docs = request.getfixturevalue(which)
    rows = sorted(rows_of(docs), key=lambda r: (r[0] is None, r[0] or 0))
    prints = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    roots = groups(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    want = sorted((str(d), p, str(rows[r][0])) for (d, _), p, r in zip(rows, prints, roots, strict=True))
    got = [(str(r["doc_id"]), r["fingerprint"] % 2**64, str(r["component_id"])) for r in simhash.link(docs).collect()]
    assert sorted(got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))


@pytest.mark.parametrize("partitions", [2, 3])
def test_near_pairs_of_clustered_prints(frame, partitions):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**63))
    values = {base} | {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 60, (60, 2))}
    values |= {int(v) for v in rng.integers(0, 2**63, 50)}
    prints = frame("fingerprint long", [(v,) for v in values])
    found = {tuple(sorted(r)) for r in simhash.near_pairs(prints, 2, partitions, common=2).collect()}
    assert found == {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2}


def test_thresholds_are_the_cheapest():
    costs = np.random.default_rng(3).random((50, 4, 4))
    chosen = simhash.choose_thresholds(costs, -1)
    for row, own in zip(costs, chosen, strict=True):
        every = [t for t in np.ndindex(4, 4, 4, 4) if sum(t) - 4 == -1]
        best = min(sum(row[i, x] for i, x in enumerate(t)) for t in every)
        assert sum(own) == -1 and np.isclose(sum(row[i, t + 1] for i, t in enumerate(own)), best)


def test_license_scan(awkward, nothing):
    got = {r["doc_id"]: r for r in license_scan.label_documents(awkward).collect()}
    assert len(got) == 10  # eleven rows, two with one id
    assert got[1]["base_labels"] == "mit" and (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (1, 7, 7)
    assert got[9]["n_base"] == 300 and got[9]["first_word"] == 3 and got[9]["labels"] == "mit"
    assert got[2]["n_words"] == 0 and got[2]["labels"] == "" and got[2]["score"] == 0
    assert license_scan.label_documents(nothing).count() == 0


def test_license_blocks_against_all_pairs(frame):
    rng = np.random.default_rng(4)
    words = ["a1", "b2", "c3", "d4", "e5", "f6", "g7", "h8", "z9"]
    templates = [("one", "a1 b2 c3 d4 e5"), ("two", "e5 f6 g7 h8 a1 b2")]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(30)]
    docs = frame("doc_id long, text string", list(enumerate(texts)))
    _, matches = license_scan.scan(docs, templates=templates, threshold=0.8)
    got = {(r["doc_id"], r["start"], r["label"]) for r in matches.collect()}
    want = set()
    for i, text in enumerate(texts):
        own = text.split()
        for start in range(0, len(own), 8):
            block = set(own[start : start + 16])
            for label, t in templates:
                t = set(t.split())
                if len(t & block) >= np.ceil(0.8 * len(t)):
                    want.add((i, start, label))
    assert got == want


def test_exact_top_k(frame):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(300)]
    vectors[7] = (7, vectors[20][1])
    vectors[8] = (8, None)
    vectors[9] = (9, [float("nan")] * 8)
    df = frame("vec_id long, embedding array<double>", vectors + [(None, [1.0] * 8)])
    whole = {i: np.floor(64 * np.array(v)) for i, v in vectors if v is not None and np.isfinite(v).all()}
    want = set()
    for q in [i for i in whole if i % 20 == 0]:
        scores = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:20]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)}
    for lists in (1, 2, 4):
        found = topk_search.exact_top_k(df, "vec_id % 20 = 0", lists=lists, block_rows=64, query_rows=5)
        assert {tuple(r) for r in found.collect()} == want
    few = frame("vec_id long, embedding array<double>", vectors[:3])
    assert topk_search.exact_top_k(few, "vec_id % 20 = 0").count() == 2
    assert topk_search.exact_top_k(few.limit(0), "vec_id % 20 = 0").count() == 0


def test_fingerprints(awkward):
    rows = sorted(rows_of(awkward), key=lambda r: (r[0] is None, -(r[0] or 0)))
    found = fingerprints.fingerprint_neighbours(awkward).collect()
    want = []
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, n = t or "", n or ""
        want.append((str(d), len(t), t[: len(t) - len(t) // 2] + n[: len(t) // 2]))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited"]) for r in found) == sorted(want)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[2]["fingerprint"] == by_id[3]["fingerprint"] == b"" and by_id[3]["near_next"] == 1
    assert all(0 <= r["near_edited"] <= 1 for r in found)


def test_fingerprints_of_short_near_copies():
    rng = np.random.default_rng(8)
    ranks = fingerprints.rank_levels(np.ones(fingerprints.LEVELS + 1, np.int64))
    for n in (20, 40, 63, 64, 90, 126):
        text = rng.integers(97, 123, n).astype(np.uint8)
        other = rng.integers(97, 123, n).astype(np.uint8)
        copies = []
        for at in range(0, n, 5):  # one changed character each
            copies.append(text.copy())
            copies[-1][at] = 65
        made = fingerprints.digests([x.tobytes() for x in (text, other, *copies)], ranks)
        assert all(m.shape[0] == 1 for m in made) and fingerprints.likeness(made[0], made[1]) < 0.1
        assert all(0.3 < fingerprints.likeness(made[0], m) < 1 for m in made[2:])
    one, turned, empty = fingerprints.digests([b"ab", b"ba", b""], ranks)
    assert fingerprints.likeness(one, one) == 1 and fingerprints.likeness(one, turned) < 1 and not len(empty)


def test_entropy_levels_match_counting():
    raw = np.random.default_rng(6).integers(97, 105, 3_000).astype(np.uint8)
    levels = fingerprints.entropy_levels(raw)
    for i in range(0, len(levels), 97):
        p = np.bincount(raw[i : i + 64]) / 64
        p = p[p > 0]
        assert abs(levels[i] - 1000 * -(p * np.log2(p)).sum() / 6) <= 1.1
    same = fingerprints.digests([raw.tobytes(), raw.tobytes(), raw[:1500].tobytes()], np.arange(1001))
    assert fingerprints.likeness(same[0], same[1]) == 1 and fingerprints.likeness(same[0], same[2]) > 0.3


def test_mixing(frame):
    rows = [(i, "w " * 10, "big" if i % 3 else f"s{i % 9}", 1) for i in range(900)] + [(None, None, None, 0)]
    docs = frame("doc_id long, text string, source string, n_chars int", rows)
    used = mixing.mix(docs, repetition=1.5, block_tokens=1_000, bucket_documents=50).collect()
    times = {}
    for r in used:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert set(times) == {r[0] for r in rows} and max(times.values()) == 2
    small = sum(r["tokens"] for r in used if r["source"] == "s0")
    assert abs(small - 3_000) <= 20  # bytes
    blocks = {}
    for r in used:
        blocks[r["block"]] = blocks.get(r["block"], 0) + r["tokens"]
    assert max(blocks.values()) < 1_600
    out = mixing.apply_mixture(docs, repetition=1.5)
    assert out.columns == docs.columns and out.count() == len(used)
    level = mixing.find_exponent(mixing.source_tokens(docs.withColumn("t", F.lit(10)), "source", "t"), entropy=0.9)
    t = np.array([6000, 1000, 1000, 1000, 10.0])
    w = t**level / (t**level).sum()
    assert abs(-(w * np.log(w)).sum() / np.log(5) - 0.9) < 1e-4


def test_toxicity_grammar():
    step, states = toxicity.grammar()

    def read(symbols):
        at, out = states, []
        for s in symbols:
            result, _, at = step(at, s)
            out.append(result)
        return "".join(out)

    assert read("OI") == "OI" and read("NOI") == "NOi" and read("NOOOI") == "NOOOI"
    assert read("ROI") == "ROQ" and read("GOI") == "GOD" and read("GNI") == "GNi"


def test_toxicity_target_on_either_side():
    scanner = toxicity.Scanner(toxicity.ToxicModel({"moron": 1.0}, {}, np.zeros(len(toxicity.OUTCOMES) + 1)))

    def outcome(text):
        found = dict(zip(toxicity.OUTCOMES, np.expm1(scanner.features(text)).round(6).tolist(), strict=True))
        return {k: v for k, v in found.items() if v and k != "clauses"}

    assert outcome("you will hurt") == outcome("I will kill you") == {"direct": 1.5}
    assert outcome("you moron") == outcome("moron, you") == outcome("you moron you") == {"direct": 1.5}
    assert outcome("I will kill one or two") == {"threat": 1.0} and outcome("a moron") == {"plain": 1.0}
    assert outcome("kill a b you") == {"direct": 1.5} and outcome("kill a b c you") == {"threat": 1.0}
    assert outcome("I will kill. you") == {"threat": 1.0}
    assert outcome("I will not kill you") == {"denied": 0.5} and outcome("I said kill you") == {"quoted": 0.7}


def test_toxicity_learns(frame):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        text = list(rng.choice(words, 40))
        if i % 4 == 0:
            for bad in rng.choice(["scumlike", "scumling", "moron"], 3):
                text.insert(int(rng.integers(40)), bad)
        rows.append((i, " ".join(text), int(i % 4 == 0)))
    rows += [(1000, None, 1), (1001, "x", None)]
    model = toxicity.train(frame("doc_id long, text string, toxic int", rows))
    docs = frame("doc_id long, text string, score string", [(1, "you moron, moron and scumlord", "q"), (2, "w1 w2", "q"), (3, None, "q")])
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert got[1]["predicted"] == 1 and got[2]["predicted"] == got[3]["predicted"] == 0
    empty = toxicity.train(frame("doc_id long, text string, toxic int", []))
    assert toxicity.score(docs, empty).count() == 3


def test_language_id(frame, sample):
    labelled = sample.select("doc_id", "text", "lang")
    models = language_id.train(labelled, fit_rows=40, calibrate_rows=10)
    docs = sample.withColumn("score", F.lit("clash"))
    found = language_id.predict(docs, models, keep=["doc_id", "lang", "score"])
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.avg(F.col("rejected").cast("double"))).first()
    assert right[0] > 0.95 and right[1] < 0.05
    odd = frame("doc_id long, text string", [(1, None), (2, ""), (3, "123 ... !"), (4, "the thing that was"), (5, "中文" * 30)])
    got = {r["doc_id"]: r for r in language_id.predict(odd, models).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0 for i in (1, 2, 3))
    assert got[4]["lang_pred"] == "en" and got[5]["rejected"]
    none = language_id.train(labelled.limit(0))
    assert language_id.predict(odd, none).where("lang_pred = 'und'").count() == 5


def test_language_id_rejects_after_few_rows(frame, sample):
    english = sample.where("lang = 'en'").select("doc_id", "text", "lang").limit(120)
    rare = sample.where("lang = 'fr'").select("doc_id", "text", "lang").limit(6)
    single = sample.where("lang = 'de'").select("doc_id", "text", "lang").limit(1)
    models = language_id.train(english.union(rare).union(single))
    assert models.languages == ["de", "en", "fr"] and np.isfinite(models.limit).all()
    assert min(models.limit) == models.limit[1]  # the others have too few rows for a lower limit
    odd = frame("doc_id long, text string", [(1, "中文" * 30), (2, "zxqj kvwq xzzk qjvx wqkz"), (3, "the thing that was")])
    got = {r["doc_id"]: r["rejected"] for r in language_id.predict(odd, models).collect()}
    assert got == {1: True, 2: True, 3: False}
    models = language_id.train(single)
    assert np.isfinite(models.limit).all()
    assert language_id.predict(odd.where("doc_id = 1"), models).first()["rejected"]


def test_kneser_ney_sums_to_one():
    counts = language_id.count_ngrams(["abracadabra arbre bar", "a"], 3)
    probabilities, _ = language_id.kneser_ney(counts, 3, 8)
    assert abs(sum(probabilities[0].values()) + sum([0.0]) - 1) < 0.2
    models = language_id.build({"x": counts}, 3)
    entropy, n = models.cross_entropy(["abra", ""])
    assert n.tolist() == [5, 0] and 0 < entropy[0, 0] < np.log(8)


def test_kneser_ney_is_pruned_only_when_finished(frame):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdefgh  "), 400)) for _ in range(6)]
    counts = language_id.count_ngrams(texts, 3)
    rows = [("x", g, n) for g, n in counts.items()] + [("y", g, n) for g, n in language_id.count_ngrams(["aha"], 3).items()]
    tables, numbers, vocabulary = language_id.kneser_ney_tables(frame("lang string, gram string, n long", rows), 3)
    exact, weights = language_id.kneser_ney(counts, 3, vocabulary)
    whole = language_id.pruned(tables, numbers, len(counts))["x"]
    few = language_id.pruned(tables, numbers, 40)["x"]
    for n in range(3):
        assert whole[0][n] == pytest.approx(exact[n]) and whole[1][n] == pytest.approx(weights[n])
        assert few[0][n] == pytest.approx({g: exact[n][g] for g in few[0][n]})
    assert len(few[0][1]) == len(few[0][2]) == 40

    def p(gram):
        if gram in few[0][len(gram) - 1]:
            return few[0][len(gram) - 1][gram]
        return few[1][len(gram) - 1].get(gram[:-1], 1.0) * p(gram[1:])

    left = 1 - sum(exact[0].values())  # for symbols that occur nowhere
    for context in {g[:-1] for g in counts}:
        backed = few[1][2].get(context, 1.0) * few[1][1].get(context[1:], 1.0)
        assert sum(p(context + w) for w in exact[0]) + backed * left == pytest.approx(1)


def test_language_id_statistics_ignore_pruning(frame, sample):
    english = sample.where("lang = 'en'").select("doc_id", "text", "lang")
    whole, few = (language_id.train(english, max_ngrams=m) for m in (10**6, 200))
    assert len(few.tables[3].keys) == 200 < len(whole.tables[3].keys)
    at = whole.tables[3].find(few.tables[3].keys)
    assert (at >= 0).all() and np.allclose(whole.tables[3].rows[at], few.tables[3].rows, atol=1e-4)


def test_empty_tables(nothing):
    ranks = vocabulary(RANKS)
    assert token_files.token_files(nothing, vocabulary(TOKENIZER)).count() == 0
    assert bpe.decode(bpe.encode(nothing, ranks, pattern()), ranks).count() == 0
    assert suffix_dedup.repeated_passages(nothing).count() == 0
    assert simhash.link(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0
    assert mixing.mix(nothing).count() == 0 and mixing.apply_mixture(nothing).count() == 0
    assert fingerprints.fingerprint_neighbours(nothing).count() == 0


def test_queries_and_pipeline(spark, sf_dir, sample):
    import corpus_pipeline

    n = sample.count()
    for name in ("op2_license_scan", "op3_suffix_dedup", "op6_fingerprints", "op8_toxicity"):
        assert QUERIES[name](spark, sf_dir).count() == n
    out = corpus_pipeline.run(spark, sf_dir)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "SimHash near-dedup", "suffix-array dedup", "mixing", "byte-level BPE",
    ]
    kept = out.select("doc_id").distinct().count()
    assert 0.8 * n < kept <= simhash.keep_one(sample).count()
    one = out.orderBy("doc_id").first()
    assert one["n_tokens"] == len(one["ids"]) and hashlib.sha256(b"").hexdigest()
