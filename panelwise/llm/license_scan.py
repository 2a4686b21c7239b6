"""License scans: an exact set-similarity join of text blocks with license templates.

A text's words are cut into overlapping blocks, for each template size class
blocks twice as long as its templates, so that every run of words as long as a
template lies within one block. A block matches a template if it holds at least
`threshold` of the weight of the template's distinct words, and all words the
template requires. A word weighs 1 or, by rarity, the more the fewer there are
of it in the whole corpus. Words are ordered by that frequency, rarest first:

- length filter: the block's words of templates weigh at least `need`;
- prefix and positional filter, on both sides: the first shared word of a match
  is one from which on at least `need` is left, in the template and the block.

So of either side only the words of that prefix meet. Candidates are verified
with the whole block. Of templates that hold one another's words, such as those
of related licenses, the largest that matches in a place stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import slices, stored, text_bytes

# Phrases and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Notices that public licenses ask to be put on a work and sentences
# of their texts, each with the words without which it would be another license.
TEMPLATES = [
    ("mit", "Released under the MIT License", "mit"),
    ("mit", "This project is licensed under the terms of the MIT license", "mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "hereby granted restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "substantial portions"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache 2"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache compliance"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", "general 2"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "general 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "general program"),
    ("lgpl", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lesser"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lesser"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "affero"),
    ("cc-by-4.0", "Licensed under CC BY 4.0", "cc by 4"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", "cc by sa 4"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc by nc 4"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", "cc by nd 4"),
    ("cc-by-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License", "creative commons attribution"),
    ("cc-by-sa-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License", "creative commons sharealike"),
    ("cc-by-nc-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License", "creative commons noncommercial"),
    ("cc-by-nd-4.0", "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License", "creative commons noderivatives"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived neighboring"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution binary permitted"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse contributors"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "fee purpose"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "eclipse"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "event liable arising"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", "boost"),
]

# Letters A-Z in lower case; digits, a-z and all bytes above ASCII; the rest blank.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)

SCANNED = """doc_id long, text_hash long, n_words long, n_base long, first_word long, last_word long,
    base_labels string, blocks array<struct<size: int, start: long, words: array<string>>>"""
CELL = pa.struct([("size", pa.int32()), ("start", pa.int64()), ("words", pa.list_(pa.string()))])


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text, A-Z in lower case."""
    return text.translate(WORD_BYTES).split()


def size_class(n: int) -> int:
    """The power of two that n words fill, 8 at least."""
    return max(8, 1 << (n - 1).bit_length())


class Template:
    """A template's distinct words, and what a block must hold of them."""

    def __init__(self, number: int, label: str, text: str, required: str = ""):
        words = [w.decode() for w in words_of(text.encode())]
        self.number, self.label, self.size = number, label, size_class(len(words))
        self.words = sorted(set(words))
        self.required = sorted(w.decode() for w in set(words_of(required.encode())))
        if not set(self.required) <= set(self.words):
            raise ValueError(f"{label}: a required word is not in the template")

    def weigh(self, weights: dict[str, int], threshold: float) -> None:
        self.total = sum(weights[w] for w in self.words)
        self.need = max(1, ceil(threshold * self.total - 1e-9))


def nested(known: list[Template]) -> list[tuple[int, int]]:
    """(smaller, larger) templates of other labels, the larger one's words being more than all of the smaller one's."""
    return [
        (a.number, b.number) for a in known for b in known if a.label != b.label and set(a.words) < set(b.words)
    ]


def word_weights(often: dict[str, int], rarity: bool) -> dict[str, int]:
    """A whole number per word: 1, or thousandths of the logarithm of how rare it is among the words of templates."""
    if not rarity:
        return dict.fromkeys(often, 1)
    total = sum(often.values()) + len(often)
    return {w: 1 + round(1000 * log(total / (n + 1))) for w, n in often.items()}


def phrase_places(words: list[bytes], phrases: dict[bytes, str]) -> tuple[list[int], set[str]]:
    """Where a phrase's words stand consecutively, one entry per phrase and place, and the labels."""
    line, places, labels = b" " + b" ".join(words) + b" ", [], set()
    for phrase, label in phrases.items():
        at, word, seen = line.find(phrase), 0, 0
        while at >= 0:
            word += line.count(b" ", seen, at)
            seen = at
            places.append(word)
            labels.add(label)
            at = line.find(phrase, at + 1)
    return places, labels


def blocks_of(words: list[bytes], needs: dict[int, int], weights: dict[bytes, tuple[str, int]]) -> list[dict]:
    """Blocks whose words weigh enough for the least demanding template of their size.

    A block of size s starts at each multiple of s and is 2 s words long.
    """
    there = [(i, weights[w]) for i, w in enumerate(words) if w in weights]
    out = []
    for size, need in needs.items():
        held: dict[int, dict[str, int]] = {}
        for i, (w, weight) in there:
            cell = i // size
            held.setdefault(cell, {})[w] = weight
            if cell:
                held.setdefault(cell - 1, {})[w] = weight
        out += [
            {"size": size, "start": cell * size, "words": sorted(own)}
            for cell, own in sorted(held.items())
            if sum(own.values()) >= need
        ]
    return out


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple] | None = None,
    phrases: dict[str, str] | None = None,
    threshold: float = 0.8,
    rarity: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Documents with their phrase counts, and all matching (document, block, template).

    Documents: doc_id, text_hash, n_words, n_base, first_word, last_word,
    base_labels; one row per row. Matches: doc_id, text_hash, start, size,
    label, containment; equal rows share them. A null text is empty and has no
    words; whole texts are read. `templates` are (label, text) or (label, text,
    required words). Templates are few and known, so their index is broadcast.
    """
    spark = docs.sparkSession
    known = [Template(i, *t) for i, t in enumerate(templates or TEMPLATES)]
    vocabulary = {w.encode(): w for t in known for w in t.words}
    sought = {b" " + p.encode() + b" ": label for p, label in (phrases or PHRASES).items()}
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for one in text_bytes(batch.column(0)):
                for w in words_of(one):
                    if w in counts:
                        counts[w] += 1
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in counts], "n": list(counts.values())})

    # As many counts as templates have words.
    counted = rows.select("text").mapInArrow(frequency, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    often = dict.fromkeys((w.decode() for w in vocabulary), 0) | {r["word"]: r["n"] for r in counted.collect()}
    rank = {w: i for i, w in enumerate(sorted(often, key=lambda w: (often[w], w)))}
    weights = word_weights(often, rarity)
    weighed = {w.encode(): (w, n) for w, n in weights.items()}
    needs: dict[int, int] = {}
    for t in known:
        t.weigh(weights, threshold)
        needs[t.size] = min(needs.get(t.size, t.need), t.need)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in slices(batch, 1, 8_000_000):
                out: list[tuple] = []
                for one in text_bytes(own.column(1)):
                    words = words_of(one)
                    places, labels = phrase_places(words, sought)
                    ends = (min(places), max(places)) if places else (None, None)
                    blocks = blocks_of(words, needs, weighed)
                    out.append((len(words), len(places), *ends, ",".join(sorted(labels)), blocks))
                n, base, first, last, names, blocks = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(2), pa.array(n, pa.int64()), pa.array(base, pa.int64()),
                     pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(names, pa.string()),
                     pa.array(blocks, pa.list_(CELL))],
                    ["doc_id", "text_hash", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks"],
                )

    def prefix(words: list[str], need: int) -> list[int]:
        """The ranks, rarest first, from which on words of that weight are left."""
        ordered, left = sorted(words, key=rank.__getitem__), sum(weights[w] for w in words)
        out = []
        for w in ordered:
            if left < need:
                break
            out.append(rank[w])
            left -= weights[w]
        return out

    index = [(r, t.number, t.size) for t in known for r in prefix(t.words, t.need)]
    prefixes = spark.createDataFrame(index, "word_rank int, template int, of_size int")
    facts = spark.createDataFrame(
        [(t.number, t.label, sorted(rank[w] for w in t.words), sorted(rank[w] for w in t.required), t.need, t.total) for t in known],
        "template int, label string, template_ranks array<int>, required array<int>, need long, total long",
    )
    ranks = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    weight_of = F.array(*[F.lit(weights[w]).cast("long") for w in sorted(rank, key=rank.__getitem__)])

    def weight(ranks_: Column) -> Column:
        return F.aggregate(ranks_, F.lit(0).cast("long"), lambda total, r: total + F.get(weight_of, r))

    scanned = stored(rows.select("doc_id", "text", "text_hash").mapInArrow(look, SCANNED), "license-scan")
    cell = F.explode("blocks").alias("cell")
    cells = scanned.select("doc_id", "text_hash", cell).distinct().select(
        "doc_id", "text_hash", "cell.size", "cell.start",
        F.array_sort(F.transform("cell.words", lambda w: ranks[w])).alias("block_ranks"),
    )
    least = F.create_map(*[F.lit(x).cast("long") for pair in needs.items() for x in pair])[F.col("size").cast("long")]
    # Words of the block with, each, what it and the rarer ones leave.
    spent = F.aggregate(
        "block_ranks",
        F.struct(weight(F.col("block_ranks")).alias("left"), F.array().cast("array<int>").alias("taken")),
        lambda at, r: F.struct(
            (at["left"] - F.get(weight_of, r)).alias("left"),
            F.when(at["left"] >= least, F.concat(at["taken"], F.array(r))).otherwise(at["taken"]).alias("taken"),
        ),
    )
    key = ["doc_id", "text_hash", "start", "size", "template"]
    probes = cells.withColumn("taken", spent["taken"]).select("*", F.explode("taken").alias("word_rank"))
    # A block's words come from the templates, so it is no longer than they are and travels with its candidates.
    met = probes.join(F.broadcast(prefixes), "word_rank").where("size = of_size").select(*key, "block_ranks").distinct()
    shared = weight(F.array_intersect("template_ranks", "block_ranks"))
    verified = (
        met.join(F.broadcast(facts), "template")
        .where(F.size(F.array_except("required", "block_ranks")) == 0)
        .withColumn("shared", shared)
        .where("shared >= need")
        .select(*key, "label", (F.col("shared") / F.col("total")).alias("containment"))
    )
    matches = largest(stored(verified, "license-matches"), nested(known))
    return scanned.drop("blocks"), matches.select("doc_id", "text_hash", "start", "size", "label", "containment")


def largest(matches: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """The matches without those of a smaller template where a larger one, with all its words, matches too."""
    if not pairs:
        return matches
    spark = matches.sparkSession
    inside = F.broadcast(spark.createDataFrame(pairs, "smaller int, larger int"))  # pairs of templates
    # Blocks overlap if they have a stretch of eight words in common, the least size.
    stretch = F.explode(F.sequence(F.expr("start div 8"), F.expr("(start + 2 * size - 1) div 8"))).alias("stretch")
    covered = (
        matches.join(inside, matches["template"] == inside["larger"])
        .select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.col("smaller"), stretch)
        .distinct()
    )
    place = ["doc_id", "text_hash", "start", "size", "template"]
    held = matches.join(inside, matches["template"] == inside["smaller"], "left_semi").select(*place, stretch)
    same = (
        held["doc_id"].eqNullSafe(covered["d"]) & held["text_hash"].eqNullSafe(covered["h"])
        & (held["template"] == covered["smaller"]) & (held["stretch"] == covered["stretch"])
    )
    gone = held.join(covered, same, "left_semi").select(*[F.col(c).alias(f"gone_{c}") for c in place]).distinct()
    of = [matches[c].eqNullSafe(gone[f"gone_{c}"]) for c in place]
    return matches.join(gone, of, "left_anti")


def label_documents(docs: DataFrame, **options) -> DataFrame:
    """Per row its phrase counts, all labels and a score.

    The score is 1 where a phrase stands, else the highest containment found, else 0.
    Words weigh by their rarity unless `rarity` is off.
    """
    scanned, matches = scan(docs, **{"rarity": True, **options})
    found = matches.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("containment")
    )
    same = scanned["doc_id"].eqNullSafe(found["d"]) & scanned["text_hash"].eqNullSafe(found["h"])
    base = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
    labels = F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0)))
    return scanned.join(found, same, "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )
