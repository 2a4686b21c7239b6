"""Exact top-k inner products by three phases with a uniform threshold.

A vector's components are cut into `lists`; a score is the sum of one partial
score per list. Vectors and queries are packed into blocks. A vector block goes
to one task and is unpacked there once; the query blocks come to it one after
the other.

1. Every list gives each query its local best by partial score, scored exactly;
   a block passes on the k best of them. The k-th best of all gathered is a
   safe cutoff: no result scores less.
2. Each query's cutoff goes back to the blocks. A block whose longest vector
   cannot reach the cutoff is done with that query. A score that reaches it has
   a partial score of at least its share, cutoff / lists, in some list; each
   list gives all such entries.
3. What was collected is scored exactly and ranked.

Scores and cutoffs are whole numbers throughout, of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.common import pack_arrays, stored, unpack_arrays

FOUND = "query_row string, query_id long, vec_id long, score long"
CUTOFFS = "array<struct<query_row: string, cutoff: bigint>>"
QUERIES_AT_ONCE = 64


def quantise(vector: list | None, scale: float) -> np.ndarray | None:
    """floor(scale * x) of every component, or None if the vector takes no part."""
    if vector is None or any(x is None for x in vector):
        return None
    scaled = np.floor(np.array(vector, np.float64) * scale)
    return scaled if np.isfinite(scaled).all() else None


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows as whole numbers, exact: longs while sums stay below 2**53, else of any size."""
    top = (np.abs(a).max(initial=0)) * (np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return whole(a) @ whole(b).T


def reaching(partial: list[np.ndarray], limits: list[int | None]) -> np.ndarray:
    """Where some list has at least its share of the limit; everywhere if there is no limit."""
    known = np.array([x is not None for x in limits])
    need = np.array([0 if x is None else x for x in limits], object)[:, None]
    out = np.zeros(partial[0].shape, bool)
    for scores in partial:
        if scores.dtype == object:
            out |= (scores * len(partial) >= need).astype(bool)
        else:  # below 2**53, so the product stays a long
            out |= scores * len(partial) >= np.clip(need, -(2**62), 2**62).astype(np.int64)
    return out | ~known[:, None]


def in_reach(rows: np.ndarray, longest: float, limits: list[int | None]) -> np.ndarray:
    """Queries whose limit an inner product with a vector of at most that length can reach."""
    lengths = np.sqrt((rows * rows).sum(axis=1))
    bound = lengths * longest * (1 + 1e-9)  # more than rounding can take away
    return np.array([x is None or not b < x for x, b in zip(limits, bound.tolist(), strict=True)], bool)


def partial_scores(queries: np.ndarray, vectors: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    return [multiply(queries[:, a:z], vectors[:, a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def exact_top_k(
    vectors: DataFrame,
    is_query: str,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    scale: float = 64.0,
    lists: int = 2,
    block_rows: int = 65_536,
    query_rows: int = 2048,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other rows by integer inner product.

    Queries are the rows whose id meets the SQL condition `is_query` on
    `vec_id`. Components become floor(scale * x). Ties go to the smaller id;
    with fewer other rows than k all are returned. Rows whose id or vector is
    null, or that hold a null or non-finite component, take no part. Shorter
    vectors count as filled up with zeros. Two rows with one id are two rows;
    only the query's own row is left out. Scores beyond a long raise. Other
    columns are not read. `block_rows` and `query_rows` bound what a task holds
    and change no result.
    """

    def pack(size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, ids, rows = 0, [], []

            def done() -> pa.RecordBatch:
                width = max(map(len, rows))
                matrix = np.zeros((len(rows), width))
                for i, row in enumerate(rows):
                    matrix[i, : len(row)] = row
                packed = pack_arrays(np.array(ids, np.int64), matrix.reshape(-1))
                name = f"{TaskContext.get().partitionId()}-{number}"
                return pa.RecordBatch.from_pydict({"block": [name], "packed": [packed]})

            for batch in batches:
                for row_id, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    scaled = quantise(vector, scale)
                    if row_id is None or scaled is None:
                        continue
                    ids.append(row_id)
                    rows.append(scaled)
                    if len(rows) == size:
                        yield done()
                        number, ids, rows = number + 1, [], []
            if rows:
                yield done()

        return run

    def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
        ids, flat = unpack_arrays(packed, "i8", "f8")
        return ids, flat.reshape(len(ids), -1)

    given = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("vector"))
    blocks = stored(given.mapInArrow(pack(block_rows), "block string, packed binary"), "vector-blocks")

    def pick_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, matrix = unpack(row["packed"])
                frame = pa.table({"vec_id": ids, "place": np.arange(len(ids))})
                yield from frame.add_column(0, "block", pa.array([row["block"]] * len(ids))).to_batches()

    # Which rows are queries is decided by Spark; their vectors come from the stored blocks.
    asked = blocks.mapInArrow(pick_queries, "block string, vec_id long, place long").where(is_query)
    places = asked.groupBy("block").agg(F.sort_array(F.collect_list("place")).alias("places"))
    chunk = F.expr(f"explode(transform(sequence(0, (size(places) - 1) div {query_rows}), i -> struct(i AS q, slice(places, i * {query_rows} + 1, {query_rows}) AS places)))")
    chunks = places.select("block", chunk.alias("c")).select("block", "c.q", "c.places")

    def cut_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, matrix = unpack(row["packed"])
                at = np.array(row["places"], np.int64)
                packed = pack_arrays(ids[at], at, matrix[at].reshape(-1))
                yield pa.RecordBatch.from_pydict({"query_block": [f"{row['block']}-{row['q']}"], "origin": [row["block"]], "packed": [packed]})

    queries = stored(
        chunks.join(blocks, "block").select("block", "q", "places", "packed")
        .mapInArrow(cut_queries, "query_block string, origin string, packed binary"),
        "query-blocks",
    )
    # The query set against all rows, in blocks: every query block comes to every vector block.
    names = blocks.select("block")
    asked_for = queries.select("query_block", "origin", F.col("packed").alias("asked"))

    def visits(told: DataFrame | None) -> DataFrame:
        """Per vector block its vectors, then the query blocks with their cutoffs, in that order."""
        coming = asked_for if told is None else asked_for.join(told, "query_block", "left")
        cutoffs = F.lit(None).cast(CUTOFFS) if told is None else F.col("cutoffs")
        coming = coming.select("origin", F.col("asked").alias("packed"), cutoffs.alias("cutoffs"))
        calls = names.join(coming, how="cross").select("block", F.lit(1).alias("kind"), "origin", "packed", "cutoffs")
        homes = blocks.select("block", F.lit(0).alias("kind"), F.col("block").alias("origin"), "packed", F.lit(None).cast(CUTOFFS).alias("cutoffs"))
        return homes.unionAll(calls).repartition("block").sortWithinPartitions("block", "kind")

    def emit(origin: str, found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
        named = [f"{origin}-{p}" for p in columns[0]]
        return pa.RecordBatch.from_arrays(
            [pa.array(named, pa.string()), *(pa.array([int(x) for x in c], pa.int64()) for c in columns[1:])],
            ["query_row", "query_id", "vec_id", "score"],
        )

    def candidates(partial: list[np.ndarray], i: int, limit: int | None, first: bool) -> np.ndarray:
        if first:  # one more than k, as the query's own row may be among them
            tops = [np.argpartition(s[i], max(0, s.shape[1] - k - 1))[-(k + 1) :] for s in partial]
            return np.unique(np.concatenate(tops))
        return np.flatnonzero(reaching([s[i : i + 1] for s in partial], [limit])[0])

    def score(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, ids, matrix, longest = None, None, None, 0.0
            for batch in batches:
                for row in batch.to_pylist():
                    if row["kind"] == 0:
                        block = row["block"]
                        ids, matrix = unpack(row["packed"])
                        longest = float(np.sqrt((matrix * matrix).sum(axis=1)).max(initial=0))
                        continue
                    assert block == row["block"], "a query block came before its vectors"
                    query_ids, places, flat = unpack_arrays(row["packed"], "i8", "i8", "f8")
                    rows = flat.reshape(len(query_ids), -1)
                    width = max(matrix.shape[1], rows.shape[1])
                    wide, rows = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (matrix, rows))
                    own = places if block == row["origin"] else np.full(len(places), -1)
                    told = {c["query_row"]: c["cutoff"] for c in row["cutoffs"] or []}
                    limits = [told.get(f"{row['origin']}-{p}") for p in places.tolist()]
                    cuts = [round(width * i / lists) for i in range(lists + 1)]
                    here = np.flatnonzero(in_reach(rows, longest, limits))
                    for at in range(0, len(here), QUERIES_AT_ONCE):
                        some = here[at : at + QUERIES_AT_ONCE]
                        partial = partial_scores(rows[some], wide, cuts)
                        totals = sum(partial[1:], partial[0])
                        found = []
                        for i, q in enumerate(some.tolist()):
                            taken = candidates(partial, i, limits[q], first)
                            taken = taken[taken != own[q]]
                            scores = totals[i][taken]
                            if limits[q] is not None:
                                taken, scores = taken[scores >= limits[q]], scores[scores >= limits[q]]
                            for t in best(scores, ids[taken], k).tolist():
                                found.append((places[q], query_ids[q], ids[taken[t]], scores[t]))
                        yield emit(row["origin"], found)

        return run

    ranked = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    gathered = visits(None).mapInArrow(score(first=True), FOUND)
    cutoffs = gathered.withColumn("rank", ranked).where(F.col("rank") <= k).groupBy("query_row").agg(
        F.min(F.when(F.col("rank") == k, F.col("score"))).alias("cutoff")
    )
    # The cutoffs of a query block travel with it.
    rows_of = queries.mapInArrow(lambda b: row_names(b), "query_block string, query_row string")
    told = rows_of.join(cutoffs, "query_row").groupBy("query_block").agg(
        F.collect_list(F.struct("query_row", "cutoff")).alias("cutoffs")
    )
    exact = visits(stored(told, "cutoffs")).mapInArrow(score(first=False), FOUND)
    return exact.withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def row_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The query rows of each query block."""
    for batch in batches:
        for row in batch.to_pylist():
            _, places, _ = unpack_arrays(row["packed"], "i8", "i8", "f8")
            yield pa.RecordBatch.from_pydict(
                {"query_block": [row["query_block"]] * len(places), "query_row": [f"{row['origin']}-{p}" for p in places]}
            )
