import hashlib
import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from millrace.llm import centroids as C

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k, rounds, dims, scale=64.0):
    """Brute force over Python integers."""
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(max(-C.BOUND, min(C.BOUND, x * scale))) for x in v]))
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [q for _, q in sorted(kept, key=key)[:k]]

    def assign(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        placed = [(assign(q)[1], q) for _, q in kept]
        centres = [
            [sum(col) // len(own) for col in zip(*own)] if (own := [q for i, q in placed if i == n]) else c for n, c in enumerate(centres)
        ]
    return [(vec_id, *assign(q)[::-1]) for vec_id, q in kept], centres


def test_against_brute_force_with_copies_and_ties(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(120, 5)).round(1)
    vectors[40:80] = vectors[7]  # a third of all rows is one vector
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(5, vectors[9].tolist()), (5, vectors[9].tolist()), (5, vectors[10].tolist())]
    for k, rounds in ((6, 3), (1, 2), (9, 0)):
        found, centres = C.clustered(spark.createDataFrame(rows, SCHEMA).repartition(5), k=k, rounds=rounds, dims=5)
        want, want_centres = plain(rows, k, rounds, 5)
        assert centres == want_centres
        assert sorted(map(tuple, found.collect())) == sorted(want)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, -0.1]), (2, None), (3, []), (4, [1.0]), (5, [1.0, nan]), (6, [inf, 0.0]), (7, [None, 1.0]), (None, [1e300, -1e300]), (9, [1.0, 2.0, 3.0]), (10, [-0.0, 5e-324])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cluster", F.lit("x")).withColumn("q", F.lit(1))
    found, centres = C.clustered(df, k=16, dims=2)
    want, want_centres = plain(rows, 16, 3, 2)
    assert len(want) == 3 and centres == want_centres
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    out = C.with_inertia(found, centres).collect()
    assert {r["inertia"] for r in out} == {sum(w[2] for w in want)}
    assert all(r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest() for r in out)


def test_empty_tables(spark):
    for rows in ([], [(1, [1.0])]):
        out = C.with_inertia(*C.clustered(spark.createDataFrame(rows, SCHEMA)))
        assert out.collect() == []
        assert dict(out.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}


def test_sql_and_no_python_workers(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(scale=0.2, size=(90, 64)))]
    rows += [(200, rows[0][1]), (201, None), (202, rows[1][1][:63]), (203, [float("nan")] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = C.op11_centroids(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(C.OP11_SQL)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
    plan = C.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).select(C.nearest([[1] * 64, [2] * 64]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
