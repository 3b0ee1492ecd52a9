import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import mixing as M


def reshared(sizes: dict) -> dict:
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, live, left = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while left > 1e-9 and live:
        total, give, left = sum(weight[s] for s in live), left, 0.0
        for s in list(live):
            target[s] += give * weight[s] / total
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                live.discard(s)
    return target


def check(spark, df, folder=None):
    rows = M.sized(df, F.struct("doc_id", "source", "text"))
    got = M.mix(rows).select("row.*", "size", "source_size", "target", "copies").collect()
    sizes = {}
    for r in df.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want, taken = reshared(sizes), dict.fromkeys(sizes, 0)
    assert len(got) == df.count()
    for r in got:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source]) and r.copies in (0, 1, 2)
        taken[r.source] += r.size * r.copies
    return want, taken


def test_targets_and_sums(spark, docs):
    want, taken = check(spark, docs)
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 5


def test_odd_rows(spark, odd, empty):
    check(spark, odd)
    assert M.mix(M.sized(empty, F.struct("doc_id"))).count() == 0
    mixed = M.repeat_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0 and M.repeat_documents(empty).count() == 0


def test_quotas_that_are_not_broadcast(spark, docs, odd, monkeypatch):
    found = []
    for most in (M.HELD_LENGTHS, 0):
        monkeypatch.setattr(M, "HELD_LENGTHS", most)
        found.append([sorted(map(str, M.mix(M.sized(df, F.struct("doc_id"))).collect())) for df in (docs, odd)])
    assert found[0] == found[1]


def test_reruns_agree(spark, folder):
    one, two = (sorted(map(tuple, M.op3_mixing(spark, folder).collect())) for _ in range(2))
    assert one == two


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 5)), min_size=1, max_size=8, unique_by=lambda x: x[0]), st.integers(0, 200))
def test_knapsack_is_the_best_that_fits(items, budget):
    sizes, room = np.array([i[0] for i in items]), np.array([i[1] for i in items])
    reach = {0}
    for s, r in items:
        reach = {x + s * k for x in reach for k in range(r + 1) if x + s * k <= budget}
    taken = M.knapsack(sizes, room, budget)
    assert (taken <= room).all() and int((taken * sizes).sum()) == max(reach)


def test_fit_is_exact_on_a_large_histogram():
    rng = np.random.default_rng(0)
    sizes, counts = np.arange(1, 4000), rng.integers(1, 50, 3999)
    for budget in (1, 999, 1_234_567, int((sizes * counts).sum()) - 1):
        taken = M.fit(sizes, counts, budget)
        assert (taken <= counts).all() and int((taken * sizes).sum()) == budget


@pytest.mark.parametrize(
    "sizes, counts, budget, reached",
    [([100, 400_000], [4000, 1], 400_000, 400_000), ([100, 400_000], [4000, 1], 600_000, 600_000), ([7, 300_000, 900_000], [400_000, 2, 1], 1_500_003, 1_500_003), ([0, 100, 10**9], [5, 4000, 1], 399_950, 399_900),
     ([300_000, 200_000, 150_000], [1, 1, 1], 350_000, 350_000), ([300_000, 200_000, 150_000, 140_001], [1, 1, 1, 1], 340_001, 340_001), ([3, 700_000, 800_001], [2, 3, 3], 2_200_001, 2_200_001),
     ([100_000_000, 90_000_000, 70_000_000], [1, 2, 1], 160_000_000, 160_000_000)],
)
def test_a_very_long_document_leaves_no_gap(sizes, counts, budget, reached):
    sizes, counts = np.array(sizes), np.array(counts)
    taken = M.fit(sizes, counts, budget)
    assert (taken >= 0).all() and (taken <= counts).all() and (sizes * taken).sum() == reached


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 400_000), st.integers(1, 3)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.integers(0, 2_000_000))
def test_few_long_documents_are_fitted_exactly(items, budget):
    sizes, counts = np.array([i[0] for i in items]), np.array([i[1] for i in items])
    sums = {0}
    for s, r in items:
        sums = {x + s * k for x in sums for k in range(r + 1)}
    taken = M.fit(sizes, counts, budget)
    assert (taken >= 0).all() and (taken <= counts).all()
    budget = min(budget, max(sums))
    best = min(abs(x - budget) for x in sums)
    assert abs(int((sizes * taken).sum()) - budget) == best


def test_huge_documents_are_fitted_together():
    assert M.fit(np.array([729_596, 5_176_265]), np.array([2, 1]), 1_414_272).tolist() == [2, 0]
    draw = np.random.default_rng(0)
    for _ in range(60):
        sizes = np.unique(np.exp(draw.uniform(np.log(5e4), np.log(6e6), draw.integers(2, 7))).astype(np.int64))
        counts = draw.integers(1, 3, len(sizes))
        budget = int(draw.integers(1, (sizes * counts).sum()))
        best = min(abs(budget - int((sizes * np.array(c)).sum())) for c in itertools.product(*(range(x + 1) for x in counts)))
        taken = M.fit(sizes, counts, budget)
        # sums beyond RELEASE_WORDS are counted in larger units
        assert (taken <= counts).all() and abs(budget - int((sizes * taken).sum())) <= best + 16 * -(-int((sizes * counts).sum()) // M.RELEASE_WORDS)


def test_targets_of_many_sources(spark):
    draw = np.random.default_rng(2)
    for n, share, most in ((1, 1.5, 2.0), (7, 1.5, 2.0), (400, 1.5, 2.0), (50, 0.5, 1.0), (50, 2.0, 2.0), (20, 5.0, 2.0)):
        sizes = np.exp(draw.uniform(0, 12, n)).astype(int)
        rows = [(f"s{i:04d}" if i else None, f"={i}", int(x)) for i, x in enumerate(sizes)]
        got = {r.skey: r.target for r in M.targets(spark.createDataFrame(rows, "source string, skey string, source_size long"), share=share, most=most).collect()}
        order = [*range(1, n), 0]  # null comes last
        weight = {i: (3.0, 1.0, 2.0)[k % 3] for k, i in enumerate(order)}
        left, open_, want = share * sizes.sum(), set(order), {}
        while open_:
            level = left / sum(weight[i] for i in open_)
            full = {i for i in open_ if level * weight[i] >= most * sizes[i]}
            want |= {i: most * sizes[i] for i in full} if full else {i: level * weight[i] for i in open_}
            left -= sum(most * sizes[i] for i in full)
            open_ = open_ - full if full else set()
        assert all(abs(got[f"={i}"] - want[i]) <= 1e-6 * want[i] for i in order)
