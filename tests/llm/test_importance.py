import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import importance as C
from support import oracle, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, buckets):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(docs, target, buckets=10_000, percent=5, least=20, seed=42):
    found = [(i, *features(t, buckets)) for i, t in docs]
    s, t = Counter(b for _, _, x in found for b in x), Counter(b for x in target for b in features(x, buckets)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for i, w, x in found:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x)
        rows.append([i, len(w), len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    long = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(long[: percent * len(long) // 100]):
        r[5] = k + 1
    return sorted(map(repr, map(tuple, rows)))


def got(frame):
    return sorted(map(repr, map(tuple, frame.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect())))


@pytest.mark.parametrize("words,pairs", [(0, 0), (5, 0), (60, 40), (C.HEAD_WORDS, C.HEAD_PAIRS)])
def test_every_head_gives_the_same(spark, docs, folder, words, pairs):
    target = spark.read.parquet(f"{folder}/benchmark.parquet")
    want = plain([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    assert got(C.resampled(docs.repartition(3), target, words=words, pairs=pairs)) == want


def test_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    target = odd.limit(2)
    texts = [r["text"] for r in target.collect()]
    assert got(C.resampled(odd, target, buckets=97, percent=50, least_words=2)) == plain(rows, texts, 97, 50, 2)
    assert got(C.resampled(odd, empty, percent=100, least_words=0)) == plain(rows, [], percent=100, least=0)
    assert C.resampled(empty, odd).collect() == []
    kept = C.select(odd, target, percent=100, least_words=3)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {i for i, t in rows if len(WORD.findall(t or "")) >= 3}


def test_ranks_over_many_partitions(spark):
    rows = [(i, "a b c " * 8 + f"w{i % 7}") for i in range(400)] + [(7, "a b c " * 8)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    target = df.limit(0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(C.resampled(df, target, percent=60)) == plain(rows, [], percent=60)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_states_of_joined_words():
    words = [b"a", b"zz", "été".encode(), b"x" * C.LONGEST]
    head = C.Head(words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert int(head.joined(head.alone[[i]], np.array([j]))[0]) == zlib.crc32(a + b" " + b)


def test_sql(spark, folder):
    whole = lambda df: df.assign(rank=df["rank"].astype("Int64"))
    assert rows(whole(C.op13_importance(spark, folder).toPandas())) == rows(whole(oracle(C.OP13_SQL, folder)))
