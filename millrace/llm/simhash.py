"""SimHash near-duplicates by tiled exact comparison.

Each text gets a 64-bit fingerprint. Equal fingerprints are one node. Cut into
``radius + k`` blocks of bits, two fingerprints within ``radius`` differing bits
agree in full on ``k`` blocks at least. A band is one choice of ``k`` blocks
(three of five for two bits: ten bands of about 38 bits each), and nodes are
dealt by (band, value): the comparison stays exact, needs no pass over all pairs
of the corpus, and a value holds few nodes that are not close. The nodes
of a band value are cut into tiles of one population count and at most about
``tile`` nodes, and only tile pairs whose counts differ by ``radius`` at most
meet, since each differing bit moves the count by one. A pair of tiles is
compared whole, with numpy's exclusive or and bit count, and gives a spanning
forest of its links, so a dense group of n nodes gives about n links, not n * n.
Components follow by star contraction with every round written to the shared
folder.

With ``similar``, texts whose sets of word shingles have that Jaccard similarity
are linked too, whatever their fingerprints, each link confirmed by the exact
sets (``similar_links``).

Cases: null text counts as empty; texts without words have fingerprint zero and
link like any other; a null doc_id takes part but is never a component's id
unless all its ids are null; repeated rows share a fingerprint; an empty table
gives an empty result; other columns are ignored. ``keep_one`` keeps rows that
repeat both id and text together.
"""

from __future__ import annotations

import math
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, join_hot, materialise, prepare, same, session, utf8_list

SEED, WORDS, RADIUS, TILE, HOT_SHARE = 42, 3, 2, 1024, 1000
#: Bands that a fingerprint is dealt to at most, if fewer blocks have to agree for that.
MOST_BANDS = 20
#: Near copies of the pipeline: similarity of the sets of shingles of so many words.
SIMILAR, SIMILAR_WORDS, FEW = 0.8, 5, 4


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The majority of each bit over the XXH64 values of all word shingles, repeats included."""
    found = text.lower().split()  # both know ASCII only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(found) - words + 1)
    last = (ends[words - 1 :] if len(found) >= words else ends[-1:]) - 1
    parts = map(joined.__getitem__, map(slice, starts[:n].tolist(), last.tolist()))
    digests = np.frombuffer(b"".join(map(xxhash.xxh64_digest, parts, repeat(seed))), np.uint8).reshape(n, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        counts += np.unpackbits(digests[at : at + 65536], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a long), and th, which tells texts of one id apart."""
    prepare(session(docs))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, th long, fp long"

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x, words, seed) for x in utf8_list(b.column(2))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "th", "fp"])

    return rows.mapInArrow(run, schema)


def forest(x: np.ndarray, y: np.ndarray | None, radius: int) -> np.ndarray:
    """Index pairs that span all links among x, or between x and y (whose indexes follow those of x)."""
    every = x if y is None else np.concatenate([x, y])
    label = np.arange(len(every))
    other = x if y is None else y
    shift = 0 if y is None else len(x)
    close = np.bitwise_count(x[:, None] ^ other[None, :]) <= radius
    if y is None:
        np.fill_diagonal(close, False)
    rows, cols = np.nonzero(close)
    cols = cols + shift
    picked = []
    while len(rows):
        # each component picks one link that leaves it; picked links join components
        first = np.unique(label[rows], return_index=True)[1]
        for i, j in zip(rows[first].tolist(), cols[first].tolist()):
            a, b = label[i], label[j]
            if a != b:
                picked.append((i, j))
                label[label == max(a, b)] = min(a, b)
        live = label[rows] != label[cols]
        rows, cols = rows[live], cols[live]
    return np.array(picked, np.int64).reshape(-1, 2)


def compare_tiles(tiles: DataFrame, radius: int) -> DataFrame:
    """tiles: place (long, odd if it has two sides), side (0 or 1), fp. Links a, b between the nodes of each place; sides are compared with each other."""

    def groups(batches):
        held: list[tuple] = []
        for batch in batches:
            place, side, fp = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero(np.diff(place)) + 1
            bounds = [0, *cuts.tolist(), len(place)]
            for a, b in zip(bounds[:-1], bounds[1:]):
                if held and held[0][0][0] != place[a]:
                    yield held
                    held = []
                held.append((place[a:b], side[a:b], fp[a:b]))
        if held:
            yield held

    def run(batches):
        found, n = [], 0
        for held in groups(batches):
            side, fp = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]).view(np.uint64)
            one, two = fp[side == 0], fp[side == 1]
            # the lowest bit of a place tells that it has two sides
            if held[0][0][0] & 1:
                if not len(one) or not len(two):
                    continue
            elif len(one) < 2:
                continue
            else:
                two = None
            pairs = forest(one, two, radius)
            every = one if two is None else np.concatenate([one, two])
            found.append(every[pairs].view(np.int64))
            n += len(pairs)
            if n > 50_000:
                both = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])
                found, n = [], 0
        if n:
            both = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return tiles.repartition("place").sortWithinPartitions("place").select("place", "side", "fp").mapInArrow(run, "a long, b long")


def band_masks(radius: int) -> list[int]:
    """The bits of each band, as signed 64-bit numbers: every choice of ``agree`` of ``radius + agree`` blocks."""
    agree = max(k for k in (1, 2, 3) if k == 1 or math.comb(radius + k, k) <= MOST_BANDS)
    cuts = [64 * i // (radius + agree) for i in range(radius + agree + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts[:-1], cuts[1:])]
    masks = [sum(chosen) for chosen in combinations(blocks, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """nodes: distinct fp. Pairs a < b that connect all nodes within ``radius`` bits, through others or directly."""
    bands = F.array(*(F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(mask)).alias("value")) for i, mask in enumerate(band_masks(radius))))
    banded = nodes.select("fp", F.bit_count("fp").alias("pop"), F.explode(bands).alias("b")).select("fp", "pop", "b.band", "b.value")
    # a band value has at most 65 population counts; tiles hold one count each, and only tiles of near counts are paired
    counted = banded.groupBy("band", "value", "pop").agg(F.count(F.lit(1)).alias("n"))
    total = counted.groupBy("band", "value").agg(F.sum("n").alias("total"), F.collect_list(F.struct("pop", "n")).alias("cells")).where("total > 1")
    cells = total.select("band", "value", F.explode("cells").alias("c")).select("band", "value", "c.pop", F.ceil(F.col("c.n") / tile).cast("int").alias("parts"))
    cells = materialise(cells, "simhash-cells")

    tiles = cells.select("band", "value", "pop", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    reached = tiles.select("band", "value", "pop", "part", F.explode(F.sequence(F.col("pop"), F.col("pop") + radius)).alias("pop2"))
    other = tiles.select("band", "value", F.col("pop").alias("pop2"), F.col("part").alias("part2"))
    pairs = materialise(reached.join(other, ["band", "value", "pop2"]).where((F.col("pop2") > F.col("pop")) | (F.col("part2") >= F.col("part"))), "simhash-pairs")
    two_sided = (F.col("pop") != F.col("pop2")) | (F.col("part") != F.col("part2"))
    # the lowest bit of a place tells comparisons within a side from those between two: should two places collide, no link is lost
    place = F.shiftleft(F.xxhash64("band", "value", "pop", "part", "pop2", "part2"), 1).bitwiseOR(two_sided.cast("long"))
    roles = pairs.select("band", "value", "pop", "part", place.alias("place"), F.lit(0).alias("side")).unionByName(
        pairs.where(two_sided).select("band", "value", F.col("pop2").alias("pop"), F.col("part2").alias("part"), place.alias("place"), F.lit(1).alias("side"))
    )
    parted = banded.join(cells, ["band", "value", "pop"]).withColumn("part", F.expr("cast(pmod(xxhash64(fp), parts) as int)"))
    met = parted.join(roles, ["band", "value", "pop", "part"]).select("place", "side", "fp")
    return compare_tiles(met, radius).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def stars(pairs: DataFrame, name: str = "stars") -> DataFrame:
    """node, root: the smallest node that each linked node reaches. Rounds of star contraction, each written."""

    def sized(edges):
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialise(pairs.select("a", "b"), name)
    before = sized(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(lows, "a").where("b > a").select(F.col("low").alias("a"), "b").distinct()
        lows = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(lows, "b").select(F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("a").alias("b")), F.struct(F.col("low").alias("a"), F.col("b").alias("b")))).alias("e"))
        # a round at most doubles the edges: few of them make few files
        edges = materialise(small.select("e.a", "e.b").where("a <> b").distinct().coalesce(1 + before[0] // 100_000), name)
        after = sized(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def least_shared(least: float, n: int) -> int:
    """How many of its n shingles a text shares at least with one of similarity ``least``."""
    return int(np.ceil(least * n - 1e-9))


#: Odd, so that multiplying loses nothing.
MIX = np.uint64(0x9E3779B97F4A7C15)


def hashed_shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles, ascending; a shorter text is one shingle, and one without words has none.

    Words are hashed once, and a shingle's hash is made of its words' in their order.
    """
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    words = min(words, len(h))
    n = len(h) - words + 1
    out = np.full(n, words, np.uint64)
    for i in range(words):
        out = (out ^ h[i : n + i]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def likely(texts: DataFrame, least: float, words: int) -> DataFrame:
    """th of all texts that can have a similar one, and of few others.

    Take the first ``n - shared + more`` of a text's n hashes, ``shared`` being
    what it shares with a similar text at least. Of two similar texts, the one
    whose last hash taken is the smaller has at least its ``more`` among what
    was taken of the other. So a text without so many hashes in common with
    others is like none. Hashes that recur within a chunk of texts are counted there and
    sent once, so a very common shingle gives few rows.
    """

    def more(n: int) -> int:
        return max(1, n // 10)

    def take(batches):
        held, size = [], 0

        def out():
            th = np.repeat([t for t, _, _ in held], [len(h) for _, h, _ in held]).astype(np.int64)
            seq = np.concatenate([h for _, h, _ in held])
            each, at, times = np.unique(seq, return_inverse=True, return_counts=True)
            alone = times[at] == 1
            where = np.repeat(np.arange(len(held)), [len(h) for _, h, _ in held])
            here = np.bincount(where[~alone], minlength=len(held))
            first, again = seq[alone], each[times > 1]
            n = len(held)
            shingle = pa.array(np.concatenate([first, again, np.zeros(n, np.uint64)]).view(np.int64), mask=np.arange(len(first) + len(again) + n) >= len(first) + len(again))
            of = pa.array(np.concatenate([th[alone], np.zeros(len(again), np.int64), [t for t, _, _ in held]]).astype(np.int64), mask=np.concatenate([np.zeros(len(first), bool), np.ones(len(again), bool), np.zeros(n, bool)]))
            rest = np.zeros(len(first) + len(again), np.int64)
            return pa.RecordBatch.from_arrays([shingle, of, pa.array(np.concatenate([rest, here])), pa.array(np.concatenate([rest, [k for _, _, k in held]]).astype(np.int64))], ["shingle", "th", "shared", "need"])

        for b in batches:
            for th, x in zip(b.column(0).to_pylist(), utf8_list(b.column(1))):
                h = hashed_shingles(x, words)
                if len(h):
                    taken = h[: len(h) - least_shared(least, len(h)) + more(len(h))]
                    # a similar text may be shorter and take less
                    held.append((th, taken, more(least_shared(least, len(h)))))
                    size += len(taken)
            if size > 500_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def meet(batches):
        def counted(shingle, th, valid):
            again = np.concatenate([[False], shingle[1:] == shingle[:-1]])
            again[:-1] |= again[1:].copy()
            ids, n = np.unique(th[again & valid], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64)), pa.array(np.zeros(len(ids), np.int64))], ["th", "shared", "need"])

        rest = None  # the rows of the last shingle, which may go on
        for b in batches:
            whole = b.column(0).is_null()
            yield b.filter(whole).select(["th", "shared", "need"])
            b = b.filter(pc.invert(whole))
            if not b.num_rows:
                continue
            new = b.column(0).to_numpy(), b.column(1).fill_null(0).to_numpy(), b.column(1).is_valid().to_numpy(zero_copy_only=False)
            shingle, th, valid = new if rest is None else (np.concatenate(x) for x in zip(rest, new))
            cut = int(np.searchsorted(shingle, shingle[-1]))
            if cut:
                yield counted(shingle[:cut], th[:cut], valid[:cut])
            rest = shingle[cut:], th[cut:], valid[cut:]
        if rest is not None:
            yield counted(*rest)

    taken = texts.mapInArrow(take, "shingle long, th long, shared long, need long")
    dealt = taken.repartition(F.coalesce("shingle", "th")).sortWithinPartitions("shingle")
    found = dealt.mapInArrow(meet, "th long, shared long, need long").groupBy("th").agg(F.sum("shared").alias("shared"), F.max("need").alias("need"))
    return found.where("shared >= need").select("th")


def size_class(n):
    """Sizes within about five per cent of each other share one."""
    return F.floor(F.log(n.cast("double")) / math.log(1.05)).cast("int")


def most_partner(rem, n, least: float):
    """The most shingles that a text may have to be similar to one of ``n``, if they share ``rem`` at most."""
    return F.floor(rem * ((1 + least) / least) - n + 1e-6).cast("int")


def meeting(rows: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The smaller and the larger texts of all pairs that a shingle can be the first one in common of, both with ``at``, the size class of the smaller.

    rows: shingle, n (a text's shingles), rem (how many of them, from this one
    on, others have). What two texts share is at most the lesser ``rem``. So a
    text that lacks too much for any partner of the sizes there are meets nothing.
    """
    most = most_partner(F.col("rem"), F.col("n"), least)
    small = rows.where(most >= F.col("n")).withColumn("at", size_class(F.col("n")))
    lo, hi = F.ceil(least * F.col("n") - 1e-9).cast("int"), F.least(F.col("n"), most)
    large = rows.where(hi >= lo).withColumn("at", F.explode(F.sequence(size_class(lo), size_class(hi))))
    return small, large


def similar_links(docs: DataFrame, least: float = SIMILAR, words: int = SIMILAR_WORDS) -> DataFrame:
    """Pairs a < b of the 64-bit keys of texts whose Jaccard similarity is at least ``least``; they connect all texts that such pairs connect.

    Only texts that can have a similar one go on, and of their shingles those
    that several of them have. In order of how many have them, two similar texts
    share one of the first shingles of each, so texts meet by those, and only if
    what is left of both in that order is enough for their sizes (``meeting``).
    Where a shingle has many pairs (more than ``FEW`` for each of its texts), all
    that meet in it are compared with one of them, the one that has most in
    common with others, and linked texts are one component; then again with the
    next four, sixteen and so on. Once such shingles have few pairs of different
    components left (one for each shingle of a text, over all), all pairs that
    are left are compared. So near copies of one text cost about one comparison
    each, however few of all texts they are, and texts that lack too much to be
    similar to any other of their size cost none.
    """
    prepare(session(docs))
    texts = docs.where("text is not null").select(F.xxhash64("text").alias("th"), "text")
    some = texts.join(likely(texts, least, words), "th", "left_semi").dropDuplicates(["th"])

    def make(batches):
        for b in batches:
            found = [hashed_shingles(x, words) for x in utf8_list(b.column(1))]
            ends = np.cumsum([0] + [len(h) for h in found]).astype(np.int32)
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["th", "shingles"])

    sets = materialise(some.mapInArrow(make, "th long, shingles array<long>"), "similar-sets")
    each = sets.select("th", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    common = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # a text's shingles are bounded by its length
    own = each.join(common, "shingle").groupBy("th", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("own"))
    least_own = F.ceil(least * F.col("n") - 1e-9).cast("int")
    alone = F.col("n") - F.size("own")  # shingles that no other text has come first in the order
    first = F.slice("own", 1, F.greatest(F.lit(0), F.col("n") - least_own + 1 - alone))
    entries = own.where(F.size("own") >= least_own).select("th", "n", F.size("own").alias("some"), F.posexplode(first).alias("i", "e"))
    entries = entries.select("th", "n", (F.col("some") / F.col("n")).alias("score"), F.col("e.shingle").alias("shingle"), (F.col("some") - F.col("i")).alias("rem"))
    entries = materialise(entries, "similar-entries")
    n_entries, used, links, roots, centres = entries.count(), None, None, None, 1
    of_pair = lambda k: [F.col(x).alias(f"{x}_{k}") for x in ("n", "rem", "root")]
    enough = (F.least("rem_a", "rem_b") * (1 + least) >= least * (F.col("n_a") + F.col("n_b")) - 1e-6) & (F.col("root_a") != F.col("root_b"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        one, two = (sets.select(F.col("th").alias(k), F.col("shingles").alias(f"of_{k}")) for k in "ab")
        both = pairs.join(one, "a").join(two, "b").withColumn("both", F.size(F.array_intersect("of_a", "of_b")))
        return both.where(F.col("both") >= least * (F.size("of_a") + F.size("of_b") - F.col("both")) - 1e-9).select("a", "b")

    while n_entries:
        placed = entries.withColumn("root", F.col("th")) if roots is None else entries.join(roots, "th", "left").select(*entries.columns, F.coalesce("root", "th").alias("root"))
        open_ = placed if used is None else placed.join(used, ["shingle", "th"], "left_anti")
        small, large = meeting(open_, least)
        sides = small.select("shingle", "at", "root", F.lit(1).alias("s"), F.lit(0).alias("l")).unionByName(large.select("shingle", "at", "root", F.lit(0).alias("s"), F.lit(1).alias("l")))
        by_root = sides.groupBy("shingle", "at", "root").agg(F.sum("s").alias("s"), F.sum("l").alias("l"))
        by_class = by_root.groupBy("shingle", "at").agg(F.sum("s").alias("s"), F.sum("l").alias("l"), F.sum(F.col("s") * F.col("l")).alias("same")).where("s * l > same")
        by_class = materialise(by_class, "similar-classes")
        left = by_class.groupBy("shingle").agg(F.sum(F.col("s").cast("double") * F.col("l") - F.col("same")).alias("pairs"), F.sum(F.col("s") + F.col("l")).alias("texts"))
        many = materialise(left.where(F.col("pairs") > FEW * F.col("texts")), "similar-many")
        last = (many.agg(F.sum("pairs")).first()[0] or 0) <= n_entries
        if last:
            mine = small.select("shingle", "at", F.col("th").alias("a"), *of_pair("a"))
            other = large.select("shingle", "at", F.col("th").alias("b"), *of_pair("b"))
            # of two of one size each is a smaller and a larger one
            met = mine.join(other, ["shingle", "at"]).where(enough & ((F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))))
        else:
            # the next ones of shingles that have many pairs of texts not known to be one component yet
            rank = F.row_number().over(Window.partitionBy("shingle").orderBy(F.desc("score"), F.hash("th"), "th"))
            best = open_.join(many, "shingle", "left_semi").withColumn("rank", rank).where(F.col("rank") <= centres)
            best = materialise(best.select("shingle", F.col("th").alias("a"), *of_pair("a")), "similar-centres")
            now = best.select("shingle", F.col("a").alias("th"))
            used = now if used is None else used.unionByName(now)
            met = best.join(open_.select("shingle", F.col("th").alias("b"), *of_pair("b")), "shingle").where(enough)
            centres *= 4
        new = confirmed(met.select("a", "b").distinct())
        links = materialise(new if links is None else links.unionByName(new), "similar-links")
        if last:
            break
        # a text goes with one it is linked to, and with the one that goes with
        one = links.groupBy("b").agg(F.min("a").alias("a"))
        roots = materialise(one.join(one.select(F.col("b").alias("a"), F.col("a").alias("further")), "a", "left").select(F.col("b").alias("th"), F.coalesce("further", "a").alias("root")), "similar-roots")
    if links is None:
        links = entries.select(F.col("th").alias("a"), F.col("th").alias("b")).where("false")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, tile: int = TILE, seed: int = SEED, similar: float | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, fp, th, component_id (the smallest doc_id that it reaches)."""
    found = materialise(fingerprints(docs, words, seed), "simhash-fingerprints")
    nodes = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    roots = stars(links(nodes.select("fp"), radius, tile), "simhash-stars")
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    if similar is not None:
        rooted = materialise(rooted, "simhash-rooted")
        places = materialise(found.join(rooted, "fp").select("th", "root").distinct(), "similar-places")
        pairs = similar_links(docs, similar).join(places.select(F.col("th").alias("a"), F.col("root").alias("x")), "a").join(places.select(F.col("th").alias("b"), F.col("root").alias("y")), "b")
        pairs = pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        joined = stars(pairs, "similar-stars").withColumnRenamed("root", "low")
        rooted = rooted.join(joined, rooted["root"] == joined["node"], "left").select("fp", "rep", "n", F.coalesce("low", "root").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = materialise(rooted.join(least, "root").select("fp", "component_id", "n"), "simhash-components")
    # fewer than HOT_SHARE fingerprints have more than a HOT_SHARE-th of all rows
    return join_hot(found, named, ["fp"], "component_id", F.col("n") * HOT_SHARE > found.count()).select("doc_id", "fp", "th", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, by fingerprint or by similarity, the one with the smallest id, with all its columns."""
    found = materialise(near_duplicates(docs, similar=SIMILAR), "near-duplicates")
    # most documents stay: the fewer others are looked for
    gone = found.where(~same(F.col("doc_id"), F.col("component_id"))).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    th = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(gone, same(docs["doc_id"], gone["__id"]) & (th == gone["__th"]), "left_anti")


def op5_simhash(spark, sf_dir) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
