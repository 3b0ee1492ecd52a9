"""Centroid clustering of integer vectors with Spark's own expressions: no Python runs on the executors.

Each component x of a vector becomes floor(scale * x). The first centroids are
the ``k`` vectors whose seeded hash is smallest. A round assigns each vector to
its nearest centroid and replaces each centroid that has vectors by their
componentwise mean, rounded down. All numbers are integers, so the order in
which rows are added does not matter and reruns agree.

Centroids (``k`` times ``dims`` numbers) are literals of the query. The squared
distance is |v|^2 + (|c|^2 - 2 vc): ``zip_with`` and ``aggregate`` give the
product with each literal, and ``array_min`` over structs of the part in brackets and
the centroid's number picks the nearest, the smaller number on ties. The new
centroids are one grouped sum with a column for each component, combined in each
task first: a cluster with a third of all vectors sends one row per task. The
driver gets ``k`` rows a round.

Cases: a vector that is null, has other than ``dims`` components, or one that is
null or not finite is left out, and a table without any other gives an empty
result; scaled components stop at ``BOUND`` either way, so that distances fit 64
bits; with fewer than ``k`` vectors there are fewer centroids; a null id hashes
as an empty text; rows that repeat an id are vectors of their own, and of start
vectors with one hash the smaller vector comes first; equal centroids stay, and
the smaller number takes all; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, prepare

K, ROUNDS, SEED, DIMS, SCALE = 16, 3, 1, 64, 64.0
#: 64 squares of differences of such numbers fit 64 bits.
BOUND = 2.0**27


def quantised(vectors: DataFrame, dims: int = DIMS, scale: float = SCALE) -> DataFrame:
    """vec_id, q (the scaled components, array<long>) and norm (their squares' sum) of the vectors that count."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    # a conditional, since conditions of one filter may be taken in any order
    kept = vectors.where(F.when(F.size("embedding") == dims, whole).otherwise(False))
    q = F.transform(x, lambda v: F.floor(F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), v * scale))))
    return kept.select("vec_id", q.alias("q")).withColumn("norm", F.aggregate("q", F.lit(0).cast("long"), lambda s, v: s + v * v))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The ``k`` vectors with the smallest hashes of ``seed:vec_id``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["q"]) for r in vectors.select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()]


def nearest(centroids: list[list[int]]) -> Column:
    """struct<part, cluster> of the nearest centroid; ``part`` is the squared distance less the vector's own square."""
    each = []
    for number, c in enumerate(centroids):
        # as text: a call for each component would take longer than the round
        literal = F.expr(f"array({', '.join(f'{x}L' for x in c)})")
        dot = F.aggregate(F.zip_with("q", literal, lambda a, b: a * b), F.lit(0).cast("long"), lambda s, v: s + v)
        each.append(F.struct((F.lit(sum(x * x for x in c)).cast("long") - 2 * dot).alias("part"), F.lit(number).alias("cluster")))
    return F.array_min(F.array(*each))


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round."""
    placed = vectors.select(nearest(centroids)["cluster"].alias("cluster"), "q")
    sums = [F.expr(f"sum(get(q, {i})) AS s{i}") for i in range(len(centroids[0]))]
    out = list(centroids)
    for r in placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # a row per centroid at most
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(len(sums))]
    return out


def clustered(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: float = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster and distance of each vector that counts, written; and the final centroids."""
    cores = prepare(vectors.sparkSession).sparkContext.defaultParallelism
    rows = quantised(vectors, dims, scale)
    if rows.rdd.getNumPartitions() < cores:  # a small table is one file; its rounds are work for all cores
        rows = rows.repartition(cores, F.xxhash64("vec_id", "q"))
    rows = materialise(rows, "centroids-vectors")
    centroids = first_centroids(rows, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = moved(rows, centroids)
    if not centroids:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.col("norm").alias("distance")), []
    best = rows.select("vec_id", "norm", nearest(centroids).alias("best"))
    return materialise(best.select("vec_id", "best.cluster", (F.col("norm") + F.col("best.part")).alias("distance")), "centroids-assigned"), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and centroid_sha256."""
    total = [0] * len(centroids)
    for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect():
        total[r["cluster"]] = int(r["total"])
    most = 2**63 - 1  # sums stop there
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values, kind: F.get(F.lit(values or [0]).cast(f"array<{kind}>"), F.col("cluster"))
    return assigned.select(
        "vec_id", F.col("cluster").cast("int").alias("cluster"), "distance", of([min(x, most) for x in total], "bigint").alias("cluster_inertia"),
        F.lit(min(sum(total), most)).cast("long").alias("inertia"), of(names, "string").alias("centroid_sha256"),
    )


def op11_centroids(spark, sf_dir) -> DataFrame:
    return with_inertia(*clustered(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet")))


def op11_sql(k: int = K, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS) -> str:
    """The query in SQL: a pair of tables for each round."""
    parts = [f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT r, unnest(generate_series(1, {dims})) AS i, unnest(q) AS x FROM v),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1 AS cluster, q
  FROM v ORDER BY sha256('{seed}:' || vec_id), q LIMIT {k})"""]  # fmt: skip
    for n in range(rounds + 1):
        parts.append(f"""
e{n} AS (SELECT cluster, unnest(generate_series(1, {dims})) AS i, unnest(q) AS c FROM c{n}),
d{n} AS (SELECT r, cluster, CAST(sum((x - c) * (x - c)) AS BIGINT) AS distance FROM x JOIN e{n} USING (i) GROUP BY r, cluster),
a{n} AS (SELECT r, min(distance) AS distance, arg_min(cluster, distance * {k} + cluster) AS cluster FROM d{n} GROUP BY r)""")
        if n < rounds:
            parts.append(f"""
s{n} AS (SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{n} USING (r) GROUP BY cluster, i),
m{n} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM s{n} GROUP BY cluster),
c{n + 1} AS (SELECT cluster, coalesce(m{n}.q, c{n}.q) AS q FROM c{n} LEFT JOIN m{n} USING (cluster))""")
    return ",".join(parts) + f"""
SELECT v.vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (cluster)
"""


OP11_SQL = op11_sql()
