"""Phrase index, centroids and spelling variants against brute force, on awkward rows and on the sample."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.llm import (
    bpe,
    centroids,
    fingerprints,
    language_id,
    license_scan,
    mixing,
    phrase_index,
    simhash,
    spelling,
    suffix_dedup,
    token_files,
    topk_search,
    toxicity,
)
from panelwise.llm.queries import QUERIES, RANKS, pattern, vocabulary

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall((text or "").translate(FOLD))


def brute_contamination(docs, items, size=10):
    """Sorted (doc_id, n_words, n_hit, item ids) of rows (id, text)."""
    windows = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        n = min(size, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            windows[tuple(words[i : i + n])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words, hit, found = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(words[i : i + n])]
        out.append((doc, len(words), len(hit), sorted(found)))
    return sorted(out, key=str)


def contamination(docs, items, **options):
    found = phrase_index.contaminated(docs, items, **options)
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in found.collect()), key=str)


TEN = "one two three four five six seven eight nine ten"
ITEMS = [
    (1, TEN + " eleven twelve"),
    (2, "Short item!"),
    (3, None),
    (4, "... !!"),
    (5, TEN),
    (5, "another text of item five that is long enough to have eleven words"),
    (None, "nameless piece of writing"),
    (6, "a a a a a a a a a a a a"),
    (7, "é"),
]
DOCS = [
    (1, "x " + TEN.upper() + " ELEVEN, twelve... y"),
    (2, "one two three four five six seven eight nine"),
    (3, None),
    (4, ""),
    (5, "short; item short item SHORT--ITEM"),
    (6, "a " * 300),
    (6, "a " * 300),
    (6, "other text of the same id: nameless piece of writing"),
    (None, "nameless piece of writing é É"),
    (None, None),
    (8, "one two three four x five six seven eight nine ten eleven twelve"),
    (9, (TEN + " ") * 500),
    (10, "é"),
]


@pytest.fixture
def tables(frame):
    docs = frame("doc_id long, text string, pos int, term string, item_id string", [(*r, 0, "x", "y") for r in DOCS])
    return docs, frame("item_id long, text string, doc_id int, n_words int", [(*r, 0, 0) for r in ITEMS])


def test_contamination_equals_brute_force(tables):
    assert contamination(*tables) == brute_contamination(DOCS, ITEMS)


@pytest.mark.parametrize("size", [1, 2, 3, 62])
def test_contamination_at_other_sizes(tables, size):
    assert contamination(*tables, words=size) == brute_contamination(DOCS, ITEMS, size)


def test_contamination_on_the_sample(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    want = brute_contamination([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert any(r[2] for r in want)
    assert contamination(docs, items) == want
    got = QUERIES["op11_decontamination"](spark, sf_dir).collect()
    digests = {d: (w, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest()) for d, w, h, i in want}
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got} == digests


def test_contamination_of_empty_tables(tables):
    docs, items = tables
    assert contamination(docs.limit(0), items) == []
    assert contamination(docs, items.limit(0)) == [(d, w, 0, []) for d, w, _, _ in brute_contamination(DOCS, [])]
    assert contamination(docs.limit(0), items.limit(0)) == []


def test_contamination_takes_text_ids(tables):
    docs, items = tables
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    want = [(d if d is None else f"d{d}", *rest) for d, *rest in brute_contamination(DOCS, ITEMS)]
    assert contamination(named, items) == sorted(want, key=str)


def test_a_window_of_too_many_words_is_refused(tables):
    with pytest.raises(ValueError, match="1 to 62"):
        phrase_index.contaminated(*tables, words=63)


def test_proximity_finds_what_is_nearly_there(tables):
    found = phrase_index.contaminated(*tables)
    nearby = {r.doc_id: r.n_nearby for r in found.where("doc_id IN (2, 8, 10)").collect()}
    # Document 8 has one word more in the middle; document 2 lacks the last of ten words.
    assert nearby == {2: 1, 8: 3, 10: 0}
    none = phrase_index.contaminated(*tables, slop=0, share=1.0)
    assert none.where("n_nearby > 0").count() == 0


def test_one_very_long_text(frame):
    text = " ".join(f"w{i % 5000}" for i in range(250_000))  # 1.4 MB
    items = [(1, "w4998 w4999 w0 w1"), (2, "w1 w0")]
    docs = frame("doc_id long, text string", [(1, text), (2, "w4999 w0")])
    got = contamination(docs, frame("item_id long, text string", items))
    assert got == brute_contamination([(1, text), (2, "w4999 w0")], items)


def test_a_passage_in_a_third_of_the_rows(frame):
    docs = [(i, f"start{i} {TEN} the end" if i % 3 == 0 else f"the row the number {i}") for i in range(3000)]
    items = [(1, TEN), (2, "the end"), (3, "the row")]
    got = contamination(frame("doc_id long, text string", docs).repartition(16), frame("item_id long, text string", items))
    assert got == brute_contamination(docs, items)


def test_the_index_is_asked_without_moving_it(tables, spark):
    index = phrase_index.build_index(tables[0])
    some = spark.range(3).select(F.col("id").alias("doc"))
    plan = index.within(some)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and plan.count("Exchange hashpartitioning(doc") == 1
    index.drop()


def brute_clusters(rows, size=64, scale=64.0, k=16, rounds=3):
    """Sorted (vec_id, cluster, distance, cluster inertia, inertia, centroid)."""
    def usable(x):
        return x is not None and len(x) == size and all(c is not None and math.isfinite(c) for c in x)

    kept = [(i, [math.floor(scale * c) for c in x]) for i, x in rows if usable(x)]
    if not kept:
        return []
    def order(r):
        return hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]

    centers = [list(v) for _, v in sorted(kept, key=order)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centers))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        for i, own in groups.items():
            centers[i] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    ends = [(i, *nearest(v)) for i, v in kept]
    own = Counter()
    for _, d, c in ends:
        own[c] += d
    return sorted(((i, c, d, own[c], sum(own.values()), centers[c]) for i, d, c in ends), key=str)


def clusters(df, **options):
    return sorted((tuple(r) for r in centroids.cluster(df, **options).collect()), key=str)


VECTORS = [
    (1, [0.5, -0.5, 0.01]), (2, [0.5, -0.5, 0.01]), (2, [0.5, -0.5, 0.01]), (3, [-1.0, 2.0, 3.0]),
    (4, None), (5, [0.1, None, 0.2]), (6, [0.1, float("nan"), 0.2]), (7, [0.1, float("inf"), 0.2]),
    (8, [0.1, 0.2]), (9, [-0.001, -1.999, 3.001]), (None, [5.0, 5.0, -5.0]), (10, [0.0, 0.0, 0.0]), (11, []),
]


@pytest.mark.parametrize(("k", "rounds"), [(1, 3), (3, 0), (3, 4), (20, 3)])
def test_clusters_equal_brute_force(frame, k, rounds):
    df = frame("vec_id long, embedding array<double>, cluster int, v string", [(*r, 1, "x") for r in VECTORS])
    got = clusters(df, size=3, k=k, rounds=rounds)
    assert got == brute_clusters(VECTORS, size=3, k=k, rounds=rounds)


def test_clusters_of_the_sample(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.select("vec_id", "embedding").collect()]
    want = brute_clusters(rows)
    assert clusters(vectors) == want
    got = QUERIES["op12_centroids"](spark, sf_dir).collect()
    digest = {r[0]: hashlib.sha256(",".join(map(str, r[5])).encode()).hexdigest() for r in want}
    assert {r.vec_id: r.centroid_sha256 for r in got} == digest


def test_no_vectors_no_rows(frame):
    schema = "vec_id long, embedding array<float>"
    assert clusters(frame(schema, [])) == []
    assert clusters(frame(schema, [(1, None), (2, [0.5])])) == []


def test_a_component_out_of_range_is_an_error(frame):
    with pytest.raises(Exception, match="out of range"):
        clusters(frame("vec_id long, embedding array<double>", [(1, [1e9])]), size=1)


def test_clusters_use_expressions_only(frame):
    df = frame("vec_id long, embedding array<double>", VECTORS)
    plan = centroids.cluster(df, size=3, k=2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def brute_counts(docs, slip_every=97, least_letters=5, least_count=3):
    seen = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if slip_every and h % slip_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_letters:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= least_count}


def brute_variants(counts):
    """Sorted (word, form, root, n, n_near, form_n); words meet by what is left without one letter."""
    near, replaced = defaultdict(set), defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            replaced[i, rest].add(w)
            if rest in counts:
                near[w].add(rest)
                near[rest].add(w)
    for group in replaced.values():
        for w in group:
            near[w] |= group - {w}
    forms = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * n else None

    def root(w):
        while forms[w] is not None:
            w = forms[w]
        return w

    return sorted((w, forms[w], root(w), n, len(near[w]), counts.get(forms[w])) for w, n in counts.items())


def variants(counts, **options):
    return sorted(tuple(r) for r in spelling.group_variants(counts, **options).collect())


def as_frame(frame, counts):
    return frame("word string, n long, id int, form string", [(w, n, 1, "x") for w, n in counts.items()])


WORDS = {
    "colour": 9, "color": 40, "colours": 4, "colors": 20, "collor": 3, "clor": 19, "colur": 80, "aaaaa": 5, "aaaaaa": 5,
    "aaaaaaa": 11, "aabaa": 22, "été": 3, "étéé": 7, "ètéé": 7, "naïve": 5, "naive": 10, "naïf": 1, "x": 1, "y": 2, "xy": 4,
    "schlößchen": 3, "schlösschen": 6, "schloßchen": 12, "abcdef": 3, "bcdef": 6, "bcde": 12, "bce": 24, "be": 48, "b": 96,
    "nobody": 3,
}


@pytest.mark.parametrize("most_pairs", [0, 1, 3, 256])
def test_variants_equal_brute_force(frame, most_pairs):
    assert variants(as_frame(frame, WORDS), most_pairs=most_pairs) == brute_variants(WORDS)


@pytest.mark.parametrize("most_pairs", [0, 5, 1000])
def test_variants_of_random_words(frame, most_pairs):
    import random

    pick = random.Random(3)
    words = {"".join(pick.choices("abé", k=pick.randint(1, 7))): pick.randint(1, 40) for _ in range(500)}
    assert variants(as_frame(frame, words), most_pairs=most_pairs) == brute_variants(words)


def test_words_that_share_a_chunk_are_not_all_paired(frame):
    """A third of the words begin alike: their chunk is cut until few pairs are left to verify."""
    words = {f"prefix{i:05d}": 1 + i % 7 for i in range(3000)} | {f"w{i * 7919:08x}": 3 for i in range(6000)}
    words = {w.translate(str.maketrans("0123456789", "ghijklmnop")): n for w, n in words.items()}
    assert variants(as_frame(frame, words)) == brute_variants(words)


def test_counts_equal_brute_force(frame):
    docs = [(1, "Colour COLOUR colour colours coloür × été"), (2, None), (3, ""), (None, "colour " * 400), (4, "a1b2 " * 9)]
    docs += [(i, f"letters letters letter{i} Straßen") for i in range(300)]
    df = frame("doc_id long, text string, word string, n int", [(*r, "x", 1) for r in docs])
    for slip_every in (None, 1, 2, 97):
        got = {r.word: r.n for r in spelling.count_words(df, slip_every=slip_every).collect()}
        assert got == brute_counts(docs, slip_every)


def test_variants_of_the_sample(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = brute_variants(brute_counts([tuple(r) for r in docs]))
    assert any(r[1] for r in want)
    got = QUERIES["op13_spelling"](spark, sf_dir).select("word", "form", "root", "n", "n_near", "form_n")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_no_words_no_variants(frame):
    assert variants(frame("word string, n long", [])) == []
    assert variants(frame("word string, n long", [(None, 3), ("", 3)])) == []
    assert spelling.count_words(frame("doc_id long, text string", [])).collect() == []


def test_one_very_long_text_of_words(frame):
    text = "letter letters ladder " * 60_000  # 1.3 MB
    got = {r.word: r.n for r in spelling.count_words(frame("doc_id long, text string", [(1, text)])).collect()}
    assert got == {"letter": 60_000, "letters": 60_000, "ladder": 60_000}


# Mended operators

CLASHING = [
    "use_of", "use_block", "use_place", "use_doc_id", "use_epoch", "chosen_id", "chosen_hash", "root", "c0", "c1",
    "block", "bucket", "packed", "given_0", "text_hash", "fingerprint", "place", "epoch", "of", "tokens", "rank",
]
TEXTS = [
    (1, "one text about a thing that is long enough to count here", "a"),
    (2, "one text about a thing that is long enough to count here", "a"),
    (3, "another text of another source with other words in it", "b"),
    (3, "another text of another source with other words in it", "b"),
    (4, None, None), (5, "", "b"), (None, "no id but a text of some words", "c"),
]


def with_clashes(frame):
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    rows = [(*r, *[f"{c} of {i}" for c in CLASHING]) for i, r in enumerate(TEXTS)]
    return frame(schema, rows), rows


def test_given_columns_keep_their_values(frame):
    """Columns named like an operator's own come back as they were."""
    df, rows = with_clashes(frame)
    mixed = mixing.apply_mixture(df, repetition=1.5)
    assert mixed.columns == df.columns
    got = {tuple(r) for r in mixed.collect()}
    assert got == set(rows)
    kept = simhash.keep_one(df, words=3, distance=2)
    assert kept.columns == df.columns
    found = [tuple(r) for r in kept.collect()]
    assert set(found) <= set(rows) and sorted(str(r[0]) for r in found) == ["1", "3", "4", "None"]
    cut = suffix_dedup.remove_repeats(df)
    assert cut.columns == df.columns
    assert {r[3:] for r in map(tuple, cut.collect())} == {r[3:] for r in rows}
    coded = bpe.encode(df, vocabulary(RANKS), pattern(), keep=[c for c in df.columns if c != "text"])
    assert {tuple(r)[2:-1] for r in coded.collect()} == {r[3:] for r in rows}


def test_the_mixture_equals_brute_force(frame):
    """Epochs, blocks and places from the weights, the order within an epoch being that of the hash."""
    import random

    pick = random.Random(4)
    docs = [(i, "x" * pick.randint(0, 60), f"s{min(4, int(pick.expovariate(0.7)))}") for i in range(900)]
    docs += [(i, "x" * 40, None) for i in range(900, 905)]
    df = frame("doc_id long, text string, source string", docs)
    rows = mixing.mix(df, repetition=2.5, block_tokens=500, bucket_documents=20, seed=9).collect()
    held, tokens_of = Counter(), {}
    for d, text, source in docs:
        held[source] += len(text)
        tokens_of[d] = (len(text), source)
    epochs = {r.source: r.epochs for r in rows}
    weight = {r.source: r.weight for r in rows}
    assert max(epochs.values()) == pytest.approx(2.5, rel=1e-3) and min(epochs.values()) >= 1
    assert sum(weight.values()) == pytest.approx(1)
    a, b, c = sorted(held, key=held.get)[-3:]
    slope = math.log(weight[a] / weight[b]) / math.log(held[a] / held[b])
    assert slope == pytest.approx(math.log(weight[b] / weight[c]) / math.log(held[b] / held[c]), rel=1e-6)
    n_blocks = max(1, math.ceil(sum(epochs[s] * held[s] for s in held) / 500))
    keyed = df.withColumn("epoch", F.explode(F.lit([0, 1, 2]))).select(
        "doc_id", "epoch", F.xxhash64(F.lit(9), "epoch", "doc_id", F.xxhash64("text")).alias("k")
    )
    keyed = keyed.withColumn("place", F.xxhash64(F.lit(9), "k"))
    order = defaultdict(list)
    for r in keyed.collect():
        order[tokens_of[r.doc_id][1], r.epoch].append((r.k % 2**64 // 2, r.k, r.doc_id, r.place))
    want = set()
    for (source, epoch), uses in order.items():
        count = max(1, math.ceil(len(uses) / 20))
        spent = epoch * held[source]
        if epoch >= math.ceil(epochs[source]):
            continue
        # Buckets go by the leading bits of the hash, places within one by its signed value.
        for half, k, d, place in sorted(uses, key=lambda u: (min(count - 1, int(u[0] / 2**63 * count)), u[1], u[2])):
            if epoch == 0 or epoch < math.floor(epochs[source]) or spent < epochs[source] * held[source]:
                block = min(n_blocks - 1, math.floor(spent / (epochs[source] * held[source]) * n_blocks))
                want.add((d, source, epoch, block, place))
            spent += tokens_of[d][0]
    assert {(r.doc_id, r.source, r.epoch, r.block, r.place) for r in rows} == want


def test_sources_are_weighed_by_bytes_or_by_given_tokens(frame):
    chinese, english = "这是一个没有空格的句子。" * 10, "a sentence with blanks " * 10
    df = frame("doc_id long, text string, source string, mine int", [(1, chinese, "zh", 5), (2, english, "en", None), (3, None, "en", -4)])
    tokens = {r.doc_id: r.tokens for r in mixing.mix(df).collect()}
    assert tokens == {1: len(chinese.encode()), 2: len(english), 3: 0}
    assert {r.doc_id: r.tokens for r in mixing.mix(df, tokens_col="mine").collect()} == {1: 5, 2: 0, 3: 0}


def brute_top(vectors, k, scale):
    whole = [(i, n, [math.floor(scale * x) for x in v]) for n, (i, v) in enumerate(vectors)]
    out = []
    for q, n, v in whole:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, m, w in whole if m != n)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_scores_beyond_the_range_of_doubles(frame):
    schema = "vec_id long, embedding array<double>"
    near = [(0, [2.0**28, 1.0]), *[(i, [2.0**27, float(d)]) for i, d in enumerate((5, 0, -3, 4, 1), 1)]]
    for k in (1, 2, 10):
        for vectors in (near, [(i, [-x for x in v]) for i, v in near], [(i, [x / 2**4 for x in v]) for i, v in near]):
            found = topk_search.exact_top_k(frame(schema, vectors), "vec_id % 20 = 0", k=k, scale=1.0)
            assert sorted(tuple(r) for r in found.collect()) == brute_top(vectors, k, 1.0)
    above = [(0, [2.0**26, 3.0]), (1, [2.0**27 - 1, 5.0]), (2, [2.0**27, 0.0]), (3, [2.0**27 + 1, -7.0]), (4, [2.0**27, 1.0])]
    found = topk_search.exact_top_k(frame(schema, above), "vec_id % 20 = 0", k=2, scale=1.0, lists=3)
    assert sorted(tuple(r) for r in found.collect()) == brute_top(above, 2, 1.0)


def test_top_rows_with_repeated_ids_and_ties(frame):
    vectors = [(i % 30, [float(i % 4), float(-(i % 3)), 0.5]) for i in range(120)]
    df = frame("vec_id long, embedding array<float>, score int, rank int", [(*r, 1, 2) for r in vectors])
    found = topk_search.exact_top_k(df, "vec_id % 20 = 0", k=7, scale=2.0, block_rows=16, query_rows=2)
    assert sorted(tuple(r) for r in found.collect()) == brute_top(vectors, 7, 2.0)


def test_blocks_out_of_reach_are_passed_over():
    import numpy as np

    rows = np.array([[3.0, 4.0], [1.0, 0.0], [0.0, 0.0]])
    assert topk_search.in_reach(rows, 2.0, [10, 3, None]).tolist() == [True, False, True]
    assert topk_search.in_reach(rows, 2.0, [11, 2, 1]).tolist() == [False, True, False]


@pytest.mark.parametrize("hot_contexts", [20, 4096])
def test_a_passage_at_the_edge_of_which_a_third_of_the_rows_differ(frame, hot_contexts):
    import random

    from tests.llm.test_operators import removed

    pick = random.Random(2)
    passage = "a passage of more than fifty bytes that very many of the documents hold in their middle"
    docs = []
    for i in range(600):
        before, after = ("".join(pick.choices("abcdefgh ", k=70)) for _ in range(2))
        docs.append((i, before + passage + after if i % 3 == 0 else before + after))
    docs += [(700 + i, docs[0][1]) for i in range(30)]
    df = frame("doc_id long, text string", docs)
    found = suffix_dedup.repeated_passages(df, hot_contexts=hot_contexts, block_bytes=5_000, buckets=4).collect()
    assert sorted((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in found) == removed(docs)


def test_contexts_are_counted_across_blocks():
    import numpy as np

    # Anchor 0: one context, the same in three blocks; 1: one each, all different; 2: several in each of two blocks.
    number = np.array([0, 0, 0, 1, 1, 1, 2, 2])
    counts = np.array([1, 1, 1, 1, 1, 1, 40, 2], np.uint32)
    one = np.array([7, 7, 7, 7, 8, 9, 5, 5], np.uint32)
    assert suffix_dedup.all_surroundings(number, counts, one, 4).tolist() == [1, 3, 42, 0]


def test_surroundings_of_a_block():
    import numpy as np

    shared = b"the same fifty or more bytes of text are in each of these"
    texts = [b"left%d " % i + shared + b" right%d" % i for i in range(9)]
    anchors = suffix_dedup.Anchors(texts, 50, suffix_dedup.GRAM)
    distinct, _, place = suffix_dedup.in_buckets(anchors.hash, 4)
    counts, _ = suffix_dedup.surroundings(anchors, place, len(distinct))
    held = [{(anchors.raw[a : z + 50].tobytes(), p - a, p - z) for a, z, p, n in zip(anchors.low, anchors.high, anchors.at, place, strict=True) if n == i} for i in range(len(distinct))]
    assert counts.tolist() == [len(h) for h in held] and max(counts) > 1
    assert np.sum(counts) <= len(place)


@pytest.mark.parametrize("n", [20, 31, 32, 33, 64, 100, 126, 127, 130, 150, 200, 300, 330, 450, 700, 1000, 2000])
def test_copies_of_any_length_stay_alike(sample_texts, n):
    """One changed, lost or added character; and texts that have nothing in common."""
    import numpy as np

    ranks = fingerprints.rank_levels(np.ones(fingerprints.LEVELS + 1, np.int64))
    for text in sample_texts[:10]:
        text = text[100 : 100 + n]
        copies = [text[:at] + b"#" + text[at + 1 :] for at in range(0, n, max(1, n // 9))]
        copies += [text[: n // 2] + text[n // 2 + 1 :], text[: n // 3] + b"Q" + text[n // 3 :]]
        own, *made = fingerprints.digests([text, *copies], ranks)
        assert min(fingerprints.likeness(own, m) for m in made) > 0.3
    made = fingerprints.digests([t[300 : 300 + n] for t in sample_texts], ranks)
    assert max(fingerprints.likeness(a, b) for a, b in zip(made, made[1:], strict=False)) < 0.1


@pytest.fixture
def sample_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 2500").orderBy("doc_id")
    return [r.text.encode() for r in docs.limit(20).collect()]


def test_likeness_is_the_share_of_common_features(spark, sf_dir):
    """Fingerprints against the features they stand for, on pairs of copies cut to any share."""
    import numpy as np

    ranks = fingerprints.rank_levels(np.ones(fingerprints.LEVELS + 1, np.int64))
    rng = np.random.default_rng(11)
    whole = rng.integers(97, 123, 1500).astype(np.uint8).tobytes()
    other = rng.integers(97, 123, 1500).astype(np.uint8).tobytes()
    last = 1.1
    for share in (1.0, 0.75, 0.5, 0.25, 0.0):
        mixed = whole[: int(1500 * share)] + other[int(1500 * share) :]
        a, b = fingerprints.digests([whole, mixed], ranks)
        like = fingerprints.likeness(a, b)
        assert (like < last or like == 0) and like == fingerprints.likeness(b, a)
        last = like
    assert like < 0.1


def test_the_ranks_are_those_of_counting_every_window(spark, sf_dir):
    import numpy as np

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40")
    got = fingerprints.level_counts(docs, "text")
    for window, counts in zip((fingerprints.WINDOW, fingerprints.SMALL), got, strict=True):
        want = np.zeros(fingerprints.LEVELS + 1, np.int64)
        for (text,) in docs.select("text").collect():
            raw = np.frombuffer((text or "").encode(), np.uint8)
            np.add.at(want, fingerprints.entropy_levels(raw, window), 1)
        assert counts.tolist() == want.tolist()


LICENSE_LINES = {
    "This software is released under the Apache License.": "apache",
    "a film released under the rules of the license board": "",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": "gpl",
    "Licensed under CC BY 4.0": "cc-by-4.0",
    "Licensed under CC BY-NC 4.0": "cc-by-nc-4.0",
    "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa-4.0",
    "This work is licensed under the Creative Commons Attribution 4.0 International License.": "cc-by-4.0",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "lgpl",
    "Released under the MIT License": "mit",
    "Licensed under the Apache License, Version 2.0 (the License)": "apache,apache-2.0",
    "the terms of the lease were published by the foundation of the free city": "",
    "permission is hereby granted to enter the grounds free of charge": "",
    "this work is licensed for use under the international agreement of 4.0 hectares": "",
    "you may not use this door except in compliance with the house rules": "",
}


def test_license_lines_and_lines_that_mislead(frame):
    """Planted notices get their own label, and no other; so they do in the middle of other words."""
    filler = "some words of a text that is about nothing of the kind and goes on for a while "
    rows = [(i, text) for i, text in enumerate(LICENSE_LINES)]
    rows += [(100 + i, filler * 9 + text + " " + filler * 5) for i, text in enumerate(LICENSE_LINES)]
    found = license_scan.label_documents(frame("doc_id long, text string", rows + [(300, filler * 40)])).collect()
    got = {r.doc_id: r.labels for r in found}
    want = dict(enumerate(LICENSE_LINES.values())) | {100 + i: v for i, v in enumerate(LICENSE_LINES.values())}
    # In a sentence of its own the LGPL names the phrase of the GPL's base label only with a word between.
    for i, labels in want.items():
        assert set(filter(None, got[i].split(","))) - {"gpl"} == set(filter(None, labels.split(","))) - {"gpl"}, (i, got[i])
    assert got[300] == "" and got[2] == "gpl"


def test_weighted_containment_against_all_pairs(frame):
    import random

    pick = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    weights_of = [1 / (i + 1) for i in range(40)]
    templates = [(f"t{i}", " ".join(pick.sample(words, pick.randint(3, 30))), "") for i in range(12)]
    templates = [(a, t, t.split()[0] if i % 3 == 0 else "") for i, (a, t, _) in enumerate(templates)]
    docs = [(i, " ".join(pick.choices(words, weights_of, k=pick.randint(0, 120)))) for i in range(60)]
    docs += [(100 + i, t) for i, (_, t, _) in enumerate(templates)]
    df = frame("doc_id long, text string", docs)
    count = Counter(w for _, t in docs for w in t.split())
    vocabulary = {w for _, t, _ in templates for w in t.split()}
    for rarity in (False, True):
        weights = license_scan.word_weights({w: count[w] for w in vocabulary}, rarity)
        known = [license_scan.Template(i, *t) for i, t in enumerate(templates)]
        raw, within = set(), {}
        for d, text in docs:
            own = text.split()
            for t in known:
                t.weigh(weights, 0.7)
                for start in range(0, len(own), t.size):
                    block = set(own[start : start + 2 * t.size])
                    shared = sum(weights[w] for w in t.words if w in block)
                    if shared >= t.need and set(t.required) <= block:
                        raw.add((d, start, t.size, t.number))
                        within[d, start, t.size, t.number] = shared / t.total
        larger = license_scan.nested(known)
        def overlap(x, y):
            return x[0] == y[0] and x[1] // 8 <= (y[1] + 2 * y[2] - 1) // 8 and y[1] // 8 <= (x[1] + 2 * x[2] - 1) // 8
        want = {m for m in raw if not any((m[3], o[3]) in larger and overlap(m, o) for o in raw)}
        _, matches = license_scan.scan(df, templates=templates, threshold=0.7, rarity=rarity)
        got = {(r.doc_id, r.start, r.size, int(r.label[1:])): r.containment for r in matches.collect()}
        assert set(got) == want and want
        assert all(got[m] == pytest.approx(within[m]) for m in want)


def test_the_most_specific_of_nested_templates_stands(frame):
    templates = [("small", "a b c"), ("large", "a b c d e"), ("small", "x y")]
    rows = [(1, "a b c"), (2, "a b c d e"), (3, "a b c d e " + "z " * 200 + "a b c"), (None, "a b c d e"), (4, "x y a b c d e")]
    df = frame("doc_id long, text string", rows)
    _, matches = license_scan.scan(df, templates=templates, threshold=1.0)
    got = defaultdict(set)
    for r in matches.collect():
        got[r.doc_id].add(r.label)
    assert got == {1: {"small"}, 2: {"large"}, 3: {"small", "large"}, None: {"large"}, 4: {"small", "large"}}


def test_base_columns_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = {}
    for d, text in docs.collect():
        words, places, labels = words_of(text), [], set()
        for phrase, label in license_scan.PHRASES.items():
            size = len(phrase.split())
            found = [i for i in range(len(words)) if words[i : i + size] == phrase.split()]
            places += found
            labels |= {label} if found else set()
        ends = (min(places), max(places)) if places else (None, None)
        want[d] = (len(words), len(places), *ends, ",".join(sorted(labels)))
    got = QUERIES["op2_license_scan"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got} == want
    assert any(w[1] for w in want.values()) and all(0 <= r.score <= 1 for r in got)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


# Held-out rows of the contracts' folds


@pytest.fixture(scope="module")
def larger(sf_dir):
    import os

    return os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.1")


def test_toxicity_on_held_out_rows(spark, larger):
    labels = spark.read.parquet(f"{larger}/labels.parquet").select("doc_id", "toxic")
    found = QUERIES["op8_toxicity"](spark, larger)
    counts = Counter(
        (r.held_out, r.toxic, r.predicted) for r in found.join(labels, "doc_id").select("held_out", "toxic", "predicted").collect()
    )
    caught, missed = counts[True, 1, 1], counts[True, 1, 0]
    assert caught / (caught + missed) >= 0.88
    assert counts[True, 0, 1] <= 0.01 * counts[True, 0, 0]


def test_language_on_held_out_rows(spark, larger):
    docs = spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "lang", "text")
    found = QUERIES["op10_language_id"](spark, larger).select("doc_id", "held_out", "lang_pred")
    right, all_ = Counter(), Counter()
    for r in found.join(docs.where(F.col("text").rlike(r"\p{L}")), "doc_id").where("held_out and lang is not null").collect():
        all_[r.lang] += 1
        right[r.lang] += r.lang == r.lang_pred
    assert len(all_) == 4
    for lang, n in all_.items():
        assert right[lang] / n >= 0.95, (lang, right[lang], n)


def test_threats_are_known_in_their_forms():
    symbols = toxicity.classes()
    for word in "kill kills killed killing destroys strangled töten tötet schlägt matará destruir frappez stabbed".split():
        assert symbols.get(word) == "T" or word == "matará", word
    for word in "stable killjoy tuesday material blessed beatific".split():
        assert symbols.get(word) != "T", word
    model = toxicity.ToxicModel({}, {}, toxicity.BEFOREHAND)
    scanner = toxicity.Scanner(model)
    at = {o: i for i, o in enumerate(toxicity.OUTCOMES)}
    for text, outcome in (
        ("they killed him", "direct"), ("a killing storm", "threat"), ("nobody and never killed", "denied"),
        ("the paper says someone somewhere far away killed", "quoted"),
    ):
        got = scanner.features(text)
        assert got[at[outcome]] > 0 and sum(v > 0 for i, v in enumerate(got) if i != at["clauses"]) == 1, (text, got)


def test_what_labels_do_not_tell_keeps_its_weight():
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 2, 400), np.zeros(400)]).astype(float)
    y = x[:, 0]
    fitted = toxicity.fit_logistic(x, y, beforehand=np.array([0.0, 0.7, 0.0]))
    assert fitted[1] == pytest.approx(0.7) and fitted[0] > 3


def test_words_of_one_half_alone_are_not_learned(frame):
    """A chance word stands in many toxic texts of one half of the sample, and in other texts of the other half."""
    rows = [(i, f"text {i} {'w' if i % 2 else 'v'}{i % 7} idiot number {i}", 1) for i in range(60)]
    rows += [(100 + i, f"text {i} {'w' if i % 2 else 'v'}{i % 7} person number {i}", 0) for i in range(200)]
    base = frame("doc_id long, text string, toxic int", rows)
    draw = F.xxhash64(F.col("doc_id").cast("string"), "text")
    marked = base.withColumn("half", F.pmod(draw, F.lit(2)))
    chance = F.when((F.col("half") == 0) == (F.col("toxic") == 1), F.lit(" chancy")).otherwise(F.lit(""))
    known = toxicity.train(marked.select("doc_id", F.concat("text", chance).alias("text"), "toxic"))
    assert "idiot" in known.words
    assert "chancy" not in known.words or known.words["chancy"] < known.words["idiot"]


def test_marks_belong_to_words_and_alone_are_no_text():
    assert language_id.symbols("हिन्दी").tolist() == [0, *map(ord, "हिन्दी"), 0]
    assert language_id.symbols("ที่นี่ x").tolist() == [0, *map(ord, "ที่นี่"), 0, ord("x"), 0]
    assert len(language_id.symbols("́ ्")) == 0 and len(language_id.symbols("12 ...")) == 0


def test_anchors_are_the_same_when_unpacked():
    import numpy as np

    rng = np.random.default_rng(9)
    texts = [rng.integers(97, 101, n).astype(np.uint8).tobytes() for n in (0, 10, 49, 50, 51, 400, 200_000, 3, 70_000)]
    found = suffix_dedup.Anchors(texts, 50, suffix_dedup.GRAM)
    again = suffix_dedup.Anchors(texts, 50, suffix_dedup.GRAM, found.pack())
    for name in ("at", "low", "high", "doc", "hash", "first", "last"):
        assert (getattr(found, name) == getattr(again, name)).all(), name
    assert len(found.pack()) < 0.4 * len(found.raw)
    none = suffix_dedup.Anchors([b"short"], 50, suffix_dedup.GRAM)
    assert len(suffix_dedup.Anchors([b"short"], 50, suffix_dedup.GRAM, none.pack()).at) == 0


def test_labels_may_come_in_a_table_of_their_own(frame):
    rows = [(i, f"text {i} number {i % 9} {'idiot' if i % 3 == 0 else 'person'} here", int(i % 3 == 0)) for i in range(150)]
    rows += [(None, "no id", 1), (400, None, 1), (401, "no label", None)]
    both = frame("doc_id long, text string, toxic int", rows)
    apart = toxicity.train(both.select("doc_id", "text"), both.select("doc_id", "toxic"))
    joined = toxicity.train(both.where("doc_id IS NOT NULL"))
    assert apart.words == joined.words and apart.stems == joined.stems
    assert apart.coefficients == pytest.approx(joined.coefficients)


def test_blocks_hold_no_second_copy_of_the_text(spark, frame):
    """What is stored of texts that do not compress is about their size, and one Python step cuts them."""
    import random
    from pathlib import Path

    from panelwise import session

    pick = random.Random(8)
    letters = [chr(c) for c in range(32, 127)]
    rows = [(i, "".join(pick.choices(letters, k=60_000)), "a") for i in range(60)] + [(60, None, "b")]
    before = len(session.SCRATCH)
    cut = suffix_dedup.remove_repeats(frame("doc_id long, text string, source string", rows).coalesce(1))
    at = next(p for p in session.SCRATCH[before:] if "passage-blocks" in p)
    held = sum(f.stat().st_size for f in Path(at.removeprefix("file://")).glob("*.parquet"))
    assert held < 1.4 * 3_600_000
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow" not in plan.replace("FlatMapCoGroupsInArrow", "")
    assert {tuple(r) for r in cut.collect()} == set(rows)


def test_half_repeated_characters_stay(frame):
    """A character goes if all its bytes are repeated; the text stays valid, and null stays null."""
    passage = "".join(chr(97 + i * i % 26) for i in range(60))
    rows = [(1, passage + "\u00e9", 61), (2, "\u00e4" + passage + "\u00e8!", 63), (3, None, None), (4, "", 0)]
    cut = suffix_dedup.remove_repeats(frame("doc_id long, text string, n_chars int", rows))
    # The first byte of the last letters is the same, and so repeated; the second is not.
    assert {tuple(r) for r in cut.collect()} == {rows[0], (2, "\u00e4\u00e8!", 3), (3, None, 0), (4, "", 0)}


def test_new_pieces_are_encoded_in_one_pass():
    """A text is looked up once, new pieces or not, and its ids are the library's, whatever it holds."""
    import random

    from tokenizers import Tokenizer

    raw = vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_str(raw.decode())
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    cache = token_files.make_encoder(raw)
    asked, encode = [], cache.encode
    cache.encode = lambda texts: encode(asked.extend(texts) or texts)
    assert cache.encode_texts(["one twoish, threeish\x7fs it's 4th"]) and asked == ["one"]

    pick = random.Random(5)
    parts = ["a", "Wörter", "it's", "12", "\n", " ", "  ", "\t", "\x00", "\x7f", " ", "　", "漢字", "🙂", "é", "!?", "", *special]
    texts = [" ".join(pick.choices(parts, k=pick.randint(0, 12))) for _ in range(3_000)]
    texts += ["".join(pick.choices(parts, k=pick.randint(0, 12))) for _ in range(3_000)]
    for text, coded in zip(texts, cache.encode_texts(texts), strict=True):
        assert np.frombuffer(coded, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
