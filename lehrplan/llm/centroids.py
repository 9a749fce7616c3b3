"""Centroid clustering of integer vectors with column expressions alone.

Vectors are turned into integers once and written down. In every round the centroids are literal
arrays of the plan: ``zip_with`` and ``aggregate`` give the squared distances, ``array_min`` of
structs the cluster, and one grouped sum for each component the new centroids. What reaches the
driver is one row for each cluster, whatever the table holds, and all arithmetic is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lehrplan.sources.staging import stage

DIMENSIONS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
BOUND = 1 << 27  # of a component: squared distances of 64 of them stay below 2**63


def integers(rows: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id, vector, square``: floor(scale * x) of every component of the rows of ``rows`` (vec_id,
    embedding) that have exactly ``dimensions`` of them, none null, NaN or infinite; other rows
    and columns go.

    Integers beyond ``BOUND`` either way are set to it, as their distances would not fit a long.
    """
    vector = F.col("embedding").cast("array<double>")
    whole = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    limit = F.lit(float(BOUND))

    def scaled(x: Column) -> Column:
        return F.floor(F.greatest(-limit, F.least(limit, x * F.lit(float(scale)))))

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding")).where(
        (F.size("embedding") == dimensions) & whole).select(
        "vec_id", F.transform("embedding", scaled).alias("vector")).withColumn(
        "square", F.expr("aggregate(vector, 0L, (total, x) -> total + x * x)"))


def starting(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the least sha256 of ``seed:vec_id``; rows without an id come last, equal
    ones in the order of their components. At most ``clusters`` rows."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = vectors.select(name.alias("name"), "vector").orderBy(
        F.col("name").asc_nulls_last(), "vector").limit(clusters)
    return [list(r["vector"]) for r in first.collect()]


def _literal(centroid: Sequence[int]) -> str:
    return f"array({', '.join(f'{int(x)}L' for x in centroid)})"


def assign(vectors: DataFrame, centroids: Sequence[Sequence[int]]) -> DataFrame:
    """Add ``cluster`` and ``distance``: the nearest centroid, ties to the smaller number.

    A squared distance is the vector's square (``square``) plus the centroid's less twice their
    product; all three are exact integers.
    """
    nearness = [f"struct({sum(x * x for x in c)}L - 2L * aggregate(zip_with(vector, {_literal(c)}, "
                f"(a, b) -> a * b), 0L, (total, x) -> total + x) AS distance, {i} AS cluster)"
                for i, c in enumerate(centroids)]
    near = vectors.withColumn("_nearest", F.expr(f"array_min(array({', '.join(nearness)}))"))
    return near.select(*vectors.columns, "_nearest.cluster",
                       (F.col("square") + F.col("_nearest.distance")).alias("distance"))


def _moved(vectors: DataFrame, centroids: Sequence[Sequence[int]], sums: Sequence[Column],
           ) -> list[list[int]]:
    out = [list(c) for c in centroids]
    for r in assign(vectors, centroids).groupBy("cluster").agg(*sums).collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(len(centroids[0]))]
    return out


def cluster(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED,
            dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid`` of every vector kept by
    ``integers`` after ``rounds`` rounds and one more assignment.

    Repeated and null ids are rows like any other; fewer vectors than ``clusters`` start fewer
    centroids; a centroid without vectors stays where it is. Rounds end early when nothing moves,
    which changes no result. An empty table gives an empty result.
    """
    vectors = stage(integers(rows, dimensions, scale), "vectors")
    centroids = starting(vectors, clusters, seed)
    if not centroids:
        return vectors.select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"),
            ("inertia", "long"), ("centroid", "array<long>"))])
    # every centroid with vectors becomes floor(sum / count) of them, component by component
    sums = [F.expr(f"sum(vector[{i}]) AS s{i}") for i in range(dimensions)] + [F.expr("count(*) AS n")]
    for _ in range(rounds):
        before, centroids = centroids, _moved(vectors, centroids, sums)
        if before == centroids:
            break
    found = stage(assign(vectors, centroids).select("vec_id", "cluster", "distance"), "clusters")
    inertia = {r["cluster"]: r["s"] for r in
               found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}

    def by_cluster(values: Sequence[str]) -> Column:
        return F.expr(f"element_at(array({', '.join(values)}), cluster + 1)")

    return found.select(
        "vec_id", "cluster", "distance",
        by_cluster([f"{inertia.get(i, 0)}L" for i in range(len(centroids))]).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        by_cluster([_literal(c) for c in centroids]).alias("centroid"))
