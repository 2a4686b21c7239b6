"""Clusters of integer vectors around centroids, in expressions alone.

Vectors become whole numbers first, so distances and sums are exact and every
run gives the same clusters. Centroids are few: they stand in the plan as
literal arrays. zip_with and aggregate give a vector's distance to each,
array_min of (distance, number) chooses, and plain column sums per cluster,
combined before the shuffle, give the next centroids. One row per cluster is
all that ever reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Components beyond this could overflow a squared distance of 2**10 of them.
LARGEST = 2**25
MOST_CENTROIDS = 1000


def whole_vectors(
    vectors: DataFrame, *, id_col: str, vector_col: str, size: int, scale: float
) -> DataFrame:
    """vec_id and v, the components floor(scale * x) as longs.

    Left out are vectors that are null, of another size, or hold a component
    that is null or not finite. A component beyond LARGEST fails the job, as
    its distances could not be kept in a long.
    """
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].cast("array<double>").alias("x"))
    usable = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))

    def whole(x: Column) -> Column:
        # Spark may evaluate this before the filter above, so what is not finite must not fail here.
        number = F.lit(scale) * x
        wrong = F.raise_error(F.concat(F.lit("component out of range: "), x.cast("string"))).cast("long")
        small, finite = F.abs(number) <= LARGEST, F.abs(x) < float("inf")
        return F.when(small, F.floor(number).cast("long")).when(finite, wrong)

    return rows.where(F.size("x") == size).where(usable).select("vec_id", F.transform("x", whole).alias("v"))


def hashed_order(prefix: str) -> Column:
    """The rank of a vector for the start: the sha256 of the prefix and its id."""
    return F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)


def first_centroids(whole: DataFrame, k: int, prefix: str) -> list[list[int]]:
    """The k vectors of smallest hash, ties by the vector itself; fewer vectors, fewer centroids."""
    if not 1 <= k <= MOST_CENTROIDS:
        raise ValueError(f"1 to {MOST_CENTROIDS} centroids can stand in a plan")
    top = whole.select(hashed_order(prefix).alias("h"), "v").orderBy("h", "v").limit(k)
    return [list(r.v) for r in top.orderBy("h", "v").collect()]


def literal(centroid: Sequence[int]) -> Column:
    return F.array(*[F.lit(c).cast("long") for c in centroid])


def distance(v: Column, centroid: Sequence[int]) -> Column:
    """Squared Euclidean distance."""
    squares = F.zip_with(v, literal(centroid), lambda x, c: (x - c) * (x - c))
    return F.aggregate(squares, F.lit(0).cast("long"), lambda total, s: total + s)


def assign(whole: DataFrame, centroids: Sequence[Sequence[int]]) -> DataFrame:
    """The rows with cluster and distance of the nearest centroid, ties to the smaller number."""
    options = [
        F.struct(distance(F.col("v"), c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids)
    ]
    nearest = F.array_min(F.array(*options))
    return whole.withColumn("nearest", nearest).select(*whole.columns, "nearest.cluster", "nearest.distance")


def _exact_sum(number: Column | str) -> Column:
    """A sum that cannot overflow, however many rows there are."""
    return F.sum((F.col(number) if isinstance(number, str) else number).cast("decimal(19,0)"))


def moved(assigned: DataFrame, centroids: Sequence[Sequence[int]]) -> list[list[int]]:
    """Per cluster floor(sum / count) of each component; an empty cluster keeps its centroid."""
    size = len(centroids[0])
    sums = [_exact_sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(size)]
    out = [list(c) for c in centroids]
    for row in assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        out[row.cluster] = [int(row[f"s{i}"]) // row.n for i in range(size)]
    return out


def cluster(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    size: int = 64,
    scale: float = 64.0,
    k: int = 16,
    rounds: int = 3,
    prefix: str = "1:",
) -> DataFrame:
    """Per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid (its components).

    `rounds` times the centroids move, then vectors are assigned once more.
    Inertia is the sum of the squared distances. Ids may be of any type, null
    or repeated; each row is a vector of its own. Other columns are not read.
    Without usable vectors there are no rows.
    """
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, id_col=id_col, vector_col=vector_col, size=size, scale=scale)
    centroids = first_centroids(whole, k, prefix)
    if not centroids:
        fields = "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<bigint>"
        return spark.createDataFrame([], f"vec_id {whole.schema['vec_id'].dataType.simpleString()}, {fields}")
    for _ in range(rounds):
        centroids = moved(assign(whole, centroids), centroids)
    assigned = assign(whole, centroids)
    own = {r.cluster: int(r.own) for r in assigned.groupBy("cluster").agg(_exact_sum("distance").alias("own")).collect()}
    inertia = sum(own.values())
    # One row per centroid, so it may be broadcast.
    ends = spark.createDataFrame(
        [(i, own.get(i, 0), inertia, c) for i, c in enumerate(centroids)],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>",
    )
    return assigned.join(F.broadcast(ends), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )


def centroid_digest(centroid: Column) -> Column:
    return F.sha2(F.array_join(centroid.cast("array<string>"), ","), 256)
