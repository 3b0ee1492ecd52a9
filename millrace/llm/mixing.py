"""Mixing sources to target weights by fitting a subset sum over document lengths.

Each source has a target in words. Whole copies of the source come first; what
remains is a budget. Documents are counted by exact length, every length gives
its proportional share, and a bounded-knapsack program over the lengths left
fits the rest to the word where the lengths allow it; if a gap stays, some of
the documents taken are put back and fitted again. Which documents of a
length are taken follows a seeded hash: buckets of that hash below the quota go
whole and only the bucket at the quota is ranked, so a source with a third of
all rows, even all of one length, is spread over ``2**BUCKET_BITS`` groups.

Cases: null text has length 0 and is taken with 0 words; a null source is a
source of its own, after all others; a source without words has target 0; rows
that repeat are counted and drawn one by one (of rows with one id and text those
whose other columns come first); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, documents, materialise, numbered, prepare, session

WEIGHTS, SHARE, MOST, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 42
BUCKET_BITS = 10
#: Words that the knapsack program fits; proportional shares bring the rest down to this.
FIT_WORDS = 1 << 15
#: Words of taken documents that are fitted once more if those shares leave a gap, about.
RELEASE_WORDS = 1 << 22
#: Documents of one length that are fitted once more, of lengths of which an eighth of those words holds none.
HUGE_AGAIN = 16
#: Lengths of sources, about 50 bytes each, up to which their quotas are broadcast; more of them meet the rows in a shuffle.
HELD_LENGTHS = 200_000
#: A source of no more documents is fitted as a whole.
FEW_DOCUMENTS = 256


def sized(docs: DataFrame, row: Column, seed: int = SEED) -> DataFrame:
    """row (what to carry), source, skey (a key that tells null apart), size, order (seeded hash), bucket."""
    order = F.xxhash64(F.lit(seed), "doc_id", "text")
    return docs.select(
        row.alias("row"),
        "source",
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("skey"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        order.alias("order"),
        F.shiftrightunsigned(order, 64 - BUCKET_BITS).cast("int").alias("bucket"),
    )


def targets(totals: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """totals: source, skey, source_size. Adds target.

    Sources that reach ``most`` times their size stop there; the rest share what
    is left by weight. So a source gets its weight times one common level, or its
    cap if that is less. The level rises from an even share: what full sources
    leave is shared out among the others until no more of them are full. Each
    step is one sum over the sources, which lie in as many tasks as it takes.
    """
    placed = numbered(totals, [F.col("source").asc_nulls_last()], "place", "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    placed = placed.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    level, full, before = 0.0, F.lit(False), None
    while True:
        sums = placed.agg(F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))), F.sum(full.cast("long"))).first()
        if not sums[0] or not sums[2] or sums[3] == before:
            break
        level, before = (share * sums[0] - (sums[1] or 0.0)) / sums[2], sums[3]
        full = F.lit(level) * F.col("weight") >= F.col("cap")
    return placed.withColumn("target", F.when(full, F.col("cap")).otherwise(F.least(F.col("cap"), F.lit(level) * F.col("weight")))).select("skey", "source_size", "target")


def knapsack(sizes: np.ndarray, room: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size (at most ``room``) to take so that the sum is the largest that ``budget`` holds.

    Reachable sums are the bits of one integer. The first item that reaches a
    sum is remembered, so the way back needs one number per sum.
    """
    taken = np.zeros(len(sizes), np.int64)
    reach, first = 1, np.full(budget + 1, -1, np.int32)
    mask, items = (1 << (budget + 1)) - 1, []
    for i in np.argsort(sizes, kind="stable")[::-1].tolist():
        size, left, times = int(sizes[i]), int(min(room[i], budget // max(1, sizes[i]))), 1
        while left > 0 and size > 0 and not reach >> budget & 1:
            times = min(times, left)
            grown = (reach | reach << (size * times)) & mask
            fresh = grown & ~reach
            if fresh:
                bits = np.unpackbits(np.frombuffer(fresh.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(items)
                items.append((i, times))
            reach, left, times = grown, left - times, times * 2
    at = reach.bit_length() - 1
    while at > 0:
        i, times = items[first[at]]
        taken[i] += times
        at -= int(sizes[i]) * times
    return taken


def shares(counts: np.ndarray, budget: int, total: int) -> np.ndarray:
    """``counts`` times ``budget / total``, rounded down."""
    return counts * budget // total if int(counts.max()) * budget < 1 << 62 else np.array([int(c) * budget // total for c in counts])


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """How many documents of each size to take so that their words come nearest to ``budget``, in proportion to what there is."""
    total = int((sizes * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(sizes), np.int64)
    if budget >= total:
        return counts.copy()
    # what is taken or what stays out is fitted: the smaller first, since there is more room beside it
    best = None
    for inside in (2 * budget <= total, 2 * budget > total):
        taken = fit_below(sizes, counts, budget, seed) if inside else counts - fit_below(sizes, counts, total - budget, seed)
        gap = abs(budget - int((sizes * taken).sum()))
        if best is None or gap < best[0]:
            best = gap, taken
        if gap == 0:
            break
    return best[1]


def fit_below(sizes: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """At most ``budget`` words: proportional shares, then the knapsack over the rest, and over more if a gap is left."""
    taken = shares(counts, budget, int((sizes * counts).sum()))
    left = budget - int((sizes * taken).sum())
    order = np.random.default_rng(seed).permutation(len(sizes)).tolist()
    while left > FIT_WORDS:
        for i in order:
            if left <= FIT_WORDS:
                break
            if taken[i] < counts[i] and sizes[i] <= left:
                taken[i] += 1
                left -= int(sizes[i])
        # documents too long for what is left leave their share to the others
        room = np.where((sizes > 0) & (sizes <= left), counts - taken, 0)
        total = int((sizes * room).sum())
        if left <= FIT_WORDS or total == 0:
            break
        more = room if total <= left else shares(room, left, total)
        taken = taken + more
        left -= int((sizes * more).sum())
    taken = filled(sizes, counts, taken, left)
    left = budget - int((sizes * taken).sum())
    if left == 0:
        return taken
    # documents of each size in turn are put back and fitted together with the rest; of huge ones several, since no few others make up for one
    put_back, freed = np.zeros(len(sizes), np.int64), 0
    if counts.sum() <= FEW_DOCUMENTS:
        put_back, order = taken.copy(), []
    for i in order:
        huge = sizes[i] > RELEASE_WORDS // 8
        if sizes[i] > 0 and (huge or freed < RELEASE_WORDS):
            put_back[i] = min(taken[i], HUGE_AGAIN if huge else RELEASE_WORDS // (8 * sizes[i]))
            freed += 0 if huge else int(put_back[i] * sizes[i])
    again = taken - put_back
    room = budget - int((sizes * again).sum())
    while room > 0:
        again = filled(sizes, counts, again, room)
        now = budget - int((sizes * again).sum())
        if now == room:
            break
        room = now  # counted in smaller units than before
    return again if room < left else taken


def filled(sizes: np.ndarray, counts: np.ndarray, taken: np.ndarray, left: int) -> np.ndarray:
    """``taken`` and what the knapsack adds for ``left`` words. Beyond ``RELEASE_WORDS`` sums are counted in larger units, rounded up."""
    unit = max(1, -(-left // RELEASE_WORDS))
    return taken + knapsack(-(-sizes // unit), np.where(sizes > 0, counts - taken, 0), left // unit)


def quotas(rows: DataFrame, seed: int = SEED, **goal) -> DataFrame:
    """skey, size, upto (the buckets below go whole), part (how many go of that one), whole (copies of every document), source_size, target."""
    hist = materialise(rows.groupBy("source", "skey", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), "mix-lengths")
    totals = hist.groupBy("source", "skey").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    # one row per source
    goals = targets(totals, **goal)
    counted = hist.groupBy("skey", "size").agg(F.sum("n").alias("n")).join(goals, "skey")

    def fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
        # a group has one row per length, so it is bounded by the longest document
        pdf = pdf.sort_values("size", ignore_index=True)
        goal, have = float(pdf["target"].iloc[0]), int(pdf["source_size"].iloc[0])
        whole = int(goal // have) if have else 0
        budget = round(goal - whole * have)
        pdf["whole"], pdf["extra"] = whole, fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), budget, seed)
        return pdf[["skey", "size", "whole", "extra", "source_size", "target"]]

    fitted = counted.groupBy("skey").applyInPandas(fit_source, "skey string, size long, whole int, extra long, source_size long, target double")
    passed = F.coalesce(F.sum("n").over(Window.partitionBy("skey", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("passed")))
    ranges = hist.withColumn("passed", passed).join(fitted, ["skey", "size"]).withColumn("quota", quota)
    # buckets go whole up to one, of which a part goes, and none after that
    short = F.col("quota") < F.col("n")
    upto = F.coalesce(F.min(F.when(short, F.col("bucket"))), F.lit(1 << BUCKET_BITS))
    same = [F.first(c).alias(c) for c in ("whole", "source_size", "target")]
    by_length = ranges.groupBy("skey", "size").agg(upto.alias("upto"), F.coalesce(F.sum(F.when(short, F.col("quota"))), F.lit(0)).alias("part"), *same)
    return materialise(by_length, "mix-quotas")


def mix(rows: DataFrame, seed: int = SEED, **goal) -> DataFrame:
    """rows: from ``sized``. row, size, source_size, target, copies (0, 1 or 2 by default)."""
    prepare(session(rows))
    found = quotas(rows, seed, **goal)
    # so few lengths of sources are held by every task, and rows stay where they are
    drawn = rows.join(F.broadcast(found) if found.count() <= HELD_LENGTHS else found, ["skey", "size"])
    split = (F.col("bucket") == F.col("upto")) & (F.col("part") > 0)
    # only the rows of split buckets are ranked, those of one hash by all they carry
    rank = F.row_number().over(Window.partitionBy("skey", "size", "bucket").orderBy("order", F.to_json("row")))
    ranked = drawn.where(split).withColumn("extra", (rank <= F.col("part")).cast("int"))
    every = drawn.where(~split).withColumn("extra", (F.col("bucket") < F.col("upto")).cast("int")).unionByName(ranked)
    return every.select("row", "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies"))


def repeat_documents(docs: DataFrame, seed: int = SEED, **goal) -> DataFrame:
    """The mixed table: each row of ``docs`` as often as the mix takes it."""
    rows = materialise(sized(docs, F.struct(*[docs[f"`{c}`"] for c in docs.columns]), seed), "mix-rows")
    mixed = mix(rows, seed, **goal)
    return mixed.select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


def op3_mixing(spark, sf_dir) -> DataFrame:
    rows = materialise(sized(documents(spark, sf_dir), F.struct("doc_id")), "mix-sizes")
    return mix(rows).select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
