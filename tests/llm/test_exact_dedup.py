import hashlib
import re

import pytest
from pyspark.sql import functions as F
from support import oracle, rows

from millrace.llm import exact_dedup as X


def brute(found):
    groups = {}
    for r in found:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", r.text or ""), []).append(r)
    out = []
    for norm, g in groups.items():
        keep = min(g, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)).doc_id
        # of rows that repeat the id that stays, one is kept
        stays = next(r for r in g if r.doc_id == keep)
        out += [(r.doc_id, keep, len(g), r is stays, hashlib.sha256(norm.encode()).hexdigest()) for r in g]
    return sorted(map(str, out))


@pytest.mark.parametrize("bits", [64, 3])
def test_equals_brute_force_also_with_colliding_keys(odd, bits):
    got = X.exact_groups(odd, hash_bits=bits, capacity=2).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(odd.collect())


def test_equals_sql(spark, folder):
    assert rows(X.op8_exact_dedup(spark, folder).toPandas()) == rows(oracle(X.OP8_SQL, folder))


def test_buckets_double_until_they_fit(docs):
    rows = X.keyed(docs)
    cells = X.directory(rows, capacity=20)
    index = X.build_index(rows, cells)
    sizes = index.groupBy("depth", "bucket").count().collect()
    assert max(r["count"] for r in sizes) <= 20 and len({r.depth for r in sizes}) > 1
    # each key lies in the range of its bucket
    for r in index.select("bucket", "depth", "h").collect():
        assert (r.h % 2**64) >> 64 - r.depth == (r.bucket % 2**64) >> 64 - r.depth and r.bucket % 2 ** (64 - r.depth) == 0


def test_the_answer_comes_from_the_bucket_that_the_directory_names(docs):
    rows = X.keyed(docs)
    cells = X.directory(rows, capacity=20)
    index = X.build_index(rows, cells)
    assert X.look_up(rows, cells, index).where("link is null").count() == 0
    one = index.select("bucket").first()["bucket"]
    moved = index.withColumn("bucket", F.when(F.col("bucket") == one, F.col("bucket") + 1).otherwise(F.col("bucket")))
    lost = X.look_up(rows, cells, moved).where("link is null").count()
    assert 0 < lost < rows.count()
    wrong = cells.withColumn("bucket", F.when(F.col("bucket") == one, F.col("bucket") + 1).otherwise(F.col("bucket")))
    assert X.look_up(rows, wrong, index).where("link is null").count() == lost


def test_hot_groups_and_the_rest_are_answered_alike(docs, monkeypatch):
    rows = X.keyed(docs)
    cells = X.directory(rows)
    index = X.build_index(rows, cells)
    found = []
    for share in (1, 1000, 10**6):
        monkeypatch.setattr(X, "HOT_SHARE", share)
        found.append(sorted(map(str, X.look_up(rows, cells, index).collect())))
    assert found[0] == found[1] == found[2]


def test_keep_one_keeps_columns(odd, empty):
    kept = X.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, [2, 5, 6, 8, 9, 10, 11, None, 12]))
    assert X.keep_one(empty).count() == 0


def test_no_python_in_the_plan(docs):
    rows = X.keyed(docs)
    cells = X.directory(rows)
    plan = "".join(df._jdf.queryExecution().executedPlan().toString() for df in (X.exact_groups(docs), X.build_index(rows, cells), X.look_up(rows, cells, X.build_index(rows, cells))))
    assert "Python" not in plan and "Arrow" not in plan
