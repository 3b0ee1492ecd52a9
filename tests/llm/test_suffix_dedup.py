import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import suffix_dedup as S


def brute(found, length):
    texts = [(r.doc_id, (r.text or "").encode()) for r in found]
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for doc, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append(str((doc, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest())))
    return sorted(out)


def result(df, **how):
    got = S.remove_repeats(df, **how).select("doc_id", "n_bytes", F.col("n_bytes") - F.length("kept"), F.size("spans"), F.sha2("kept", 256))
    return sorted(str(tuple(r)) for r in got.collect())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=60).map(str.encode), min_size=1, max_size=6, unique=True), st.integers(1, 12))
def test_index_finds_all_repeats(parts, length):
    seen = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
    want = [[seen[p[i : i + length]] > 1 for i in range(len(p) - length + 1)] for p in parts]
    assert [f.tolist() for f in S.RunIndex(parts).repeats(length)] == want


def test_transform_of_a_known_text():
    # the transform of banana and its end mark is annb$aa: runs a, nn, b, $, aa
    index = S.RunIndex([b"banana"])
    assert [c - 1 for c in index.runs.tolist()] == [ord("a"), ord("n"), ord("b"), -1, ord("a")]
    assert index.matching_statistics().tolist()[:6] == [0, 3, 2, 3, 2, 1]


def test_repetitive_text_has_few_runs():
    index = S.RunIndex([b"0123456789abcdef" * 500])
    assert len(index.runs) < 40


@pytest.mark.parametrize("how", [{}, {"hot": 2, "batch_bytes": 3000}])
def test_documents(docs, how):
    assert result(docs, **how) == brute(docs.collect(), S.LENGTH)


def test_a_hot_anchor_is_split_by_longer_anchors(spark, docs):
    passage = " ".join(r.text for r in docs.orderBy("doc_id").limit(3).collect())[:700]
    rows = [(i, f"{'x' * (i % 5)} own words {i} {passage[: 420 + 13 * (i % 9)]} and {i * 7} ends {'y' * (i % 300)}") for i in range(60)] + [(100, passage), (101, passage), (102, "ab" * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (0, 3, 4000):
        assert result(df, hot=hot) == brute(df.collect(), S.LENGTH)


def test_shorter_strings_and_smaller_anchors(docs):
    few = docs.where("length(text) < 1500")
    assert result(few, length=60, gram=16) == brute(few.collect(), 60)


def test_odd_rows_and_periods(spark, odd, empty):
    assert result(odd) == brute(odd.collect(), S.LENGTH)
    assert S.remove_repeats(empty).count() == 0
    periods = spark.createDataFrame([(i, "ab" * i) for i in range(0, 500, 50)] + [(1000, "xyz " * 300), (1001, None)], "doc_id long, text string")
    assert result(periods) == brute(periods.collect(), S.LENGTH)


def test_longer_anchors_hold_every_window_once(docs):
    text = docs.first().text.encode() * 3 + b"ab" * 400
    first, n, anchor, _ = S.window_runs(text, 100, 16)
    windows = []
    for f, k, a in zip(first.tolist(), n.tolist(), anchor.tolist()):
        level = [(text[f : f + k + 99], a, None, f)]
        gram = 16
        while gram < 100:
            level = [(t, key, new, at + place) for piece, x, old, at in level for key, place, t, new in S.longer_anchors(piece, x, old, 100, gram)]
            gram += -(-(100 - gram) // 2)
        windows += [at for t, _, _, at in level for at in range(at, at + len(t) - 99)]
    assert sorted(windows) == list(range(len(text) - 99))


def test_hot_periods(spark):
    rows = [(i, f"{i} begins " + "xyz " * 40 + f" {i * 31} " + "abcdefghij" * (i % 7) + " ends") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (0, 2):
        assert result(df, length=60, gram=16, hot=hot) == brute(df.collect(), 60)


def most_in_a_partition(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes), sum(sizes)


def test_a_passage_in_many_documents_is_spread_over_tasks(spark, monkeypatch):
    passage = "".join(f"{i * 7919 % 10007:05d}" for i in range(80))  # one window, one piece
    rows = [(i, passage) for i in range(400)] + [(1000 + i, "".join(f"{i * 31 + j * j:07d}" for j in range(60))) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    runs, cut = [], S.cut_pieces
    monkeypatch.setattr(S, "cut_pieces", lambda docs, met, length: runs.append(met) or cut(docs, met, length))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for found in (S.repeated_spans(df), runs[0]):
            most, rows = most_in_a_partition(found)
            assert rows == 400 and most < 200
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("share", [1, 20, 10**9])
def test_hot_places_change_nothing(spark, docs, monkeypatch, share):
    monkeypatch.setattr(S, "HOT_SHARE", share)
    passage = " ".join(r.text for r in docs.orderBy("doc_id").limit(3).collect())[:700]
    rows = [(i % 50, f"{'x' * (i % 5)} own words {i} {passage[: 420 + 13 * (i % 9)]} and {i * 7} ends {'y' * (i % 300)}") for i in range(60)] + [(100 + i, passage) for i in range(9)] + [(200, "ab" * 500), (None, passage), (201, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (3, 4000):
        assert result(df, hot=hot) == brute(df.collect(), S.LENGTH)
