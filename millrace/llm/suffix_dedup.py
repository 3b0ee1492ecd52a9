"""Removal of long repeated byte strings with a run-length index.

What is repeated is decided by run-compressed Burrows-Wheeler transforms. So
that equal strings meet in one task, every window of ``length`` bytes is dealt
by its anchor: the ``gram``-byte string in it with the smallest hash. Equal
windows have equal anchors, and consecutive windows of one anchor form one
piece. Only anchors that occur twice, or twice within a piece, can hold a
repeat; the different pieces of each are dealt by anchor, and each task indexes
them, a few MB at a time. Where a piece occurs is not dealt with it: places look
up the spans of their piece afterwards, so copies cost one piece for each task.

The index of a batch is the transform's runs with the text positions sampled at
both ends of each run. Only there can the nearest other suffix change: within a
run, the match of position i - 1 with its neighbour is one longer than that of
position i. So the statistics of all positions stream from the samples, and a
window is repeated if the match with one of its two neighbours reaches
``length``. All windows of a piece that occurs twice are repeats.

An anchor with more than ``hot`` different pieces does not fit one index. A
window holds its anchor at one place, so it goes on at one side of it at least
by half of what the window has beside its anchor; with that half the anchor
grows, and the piece's windows are dealt again by the longer anchors. What no
other piece has beside the anchor drops out; what many have is one piece once it
lies within what they share. Each level is indexed like the first.

Cases: null text counts as empty; texts shorter than ``length`` bytes are kept
whole; rows that repeat an id and text count as separate texts, hence as
repeats; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise, prepare, same, session, text_key, utf8_list

LENGTH = 400
#: Bytes of an anchor, at most LENGTH.
GRAM = 128
#: Bytes of different pieces that one index covers; those of a single anchor may exceed it.
BATCH_BYTES = 1 << 20
#: Different pieces of one anchor that go into one index; digests that a task keeps of what it has sent.
HOT, SENT = 4_000, 500_000
#: Every task holds the anchors and pieces that more than a HOT_SHARE-th of all places have (fewer than HOT_SHARE).
HOT_SHARE = 1000


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each position."""
    h, base, n = text.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while 2 * n <= gram:
        h = h[:-n] * np.uint64(base) + h[n:]
        base, n = base * base % 2**64, 2 * n
    if n < gram:  # two that overlap
        h = h[: n - gram] * np.uint64(base) + h[gram - n :]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive hashes, by prefix and suffix minima of blocks."""
    blocks = -(-len(h) // width)
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[: len(h)] = h
    rows = padded.reshape(blocks, width)
    prefix = np.minimum.accumulate(rows, 1).ravel()
    suffix = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(suffix[: len(h) - width + 1], prefix[width - 1 : len(h)])


def window_runs(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """first window, number of windows and anchor of each run of windows with one anchor, and whether its windows may repeat each other."""
    if len(text) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    h = gram_hashes(np.frombuffer(text, np.uint8), gram)
    low = window_minima(h, length - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    counts = np.diff(np.append(first, len(low)))
    # equal windows of one run have their first anchors at different places, so one of those lies before the last window
    leads = np.concatenate([[0], np.cumsum(h[: len(low)] == low)])
    periodic = leads[first + counts - 1] > leads[first]
    # a long run (one string over and over) is cut, so a piece stays short
    most = length - gram + 1
    times = -(-counts // most)
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    n = np.minimum(most, np.repeat(counts, times) - step * most)
    return np.repeat(first, times) + step * most, n, np.repeat(low[first], times).view(np.int64), np.repeat(periodic, times)


class RunIndex:
    """The run-compressed transform of several strings, with positions sampled at run ends."""

    def __init__(self, parts: list[bytes]):
        self.parts = parts
        lengths = np.array([len(p) for p in parts])
        # bytes are 1 .. 256; each string ends with a mark of its own that sorts before all bytes
        text = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.int32) + 1
        self.ends = np.cumsum(lengths + 1) - 1
        text[self.ends] = 0
        self.text, self.longest = text, int(lengths.max(initial=0)) + 1
        order = self._sort()
        before = text[order - 1]
        before[order == 0] = 0
        # a mark is never equal to another, so it is a run of its own
        heads = np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == 0)]))
        self.runs = before[heads]
        self.head, self.tail = order[heads], order[np.append(heads[1:], len(order)) - 1]

    def _sort(self) -> np.ndarray:
        """The suffix array by prefix doubling; only what is still tied is sorted again."""
        text, n = self.text, len(self.text)
        padded = np.concatenate([text, np.zeros(7, np.int32)])
        key, open_ = np.zeros(n, np.uint64), np.ones(n, bool)
        for i in range(7):  # seven symbols of nine bits; nothing counts after a mark
            key <<= np.uint64(9)
            key |= np.where(open_, padded[i : n + i], 0).astype(np.uint64)
            open_ &= padded[i : n + i] != 0
        order = np.argsort(key, kind="stable").astype(np.int32)
        sorted_key = key[order]
        new = np.concatenate([[True], (sorted_key[1:] != sorted_key[:-1]) | ~open_[order[1:]]])
        del key, sorted_key
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied).astype(np.int32)
        done = 7
        while len(slots):
            at = order[slots]
            key = rank[at].astype(np.uint64) << np.uint64(32) | rank[np.minimum(at + done, n - 1)].astype(np.uint64)
            by = np.argsort(key)
            at, key = at[by], key[by]
            order[slots] = at
            new = np.concatenate([[True], key[1:] != key[:-1]])
            rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
            tied = ~new
            tied[:-1] |= ~new[1:]
            slots, done = slots[tied], 2 * done
        return order

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The length of the common prefix of the suffixes at a and b, which differ."""
        out, live, step, n = np.zeros(len(a), np.int32), np.arange(len(a)), 16, len(self.text)
        while len(live):
            rest = []
            for part in np.array_split(live, max(1, len(live) * step >> 20)):
                reach = out[part][:, None] + np.arange(step)
                x, y = (self.text[np.minimum(p[part][:, None] + reach, n - 1)] for p in (a, b))
                stop = (x != y) | (x == 0) | (y == 0)
                hit = stop.any(1)
                out[part] += np.where(hit, stop.argmax(1), step).astype(np.int32)
                rest.append(part[~hit])
            live, step = np.concatenate(rest), min(128, step * 2)
        return out

    def _stream(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The value of every position: one less than the one before it, but for the sampled positions."""
        by = np.argsort(at)
        at, value = at[by], value[by]
        gap = np.diff(np.append(at, len(self.text)))
        out = np.repeat(value + at, gap) - np.arange(at[0], len(self.text))
        return np.concatenate([np.zeros(at[0], out.dtype), out])

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of its longest match with another position."""
        met = self._common(self.head[1:], self.tail[:-1])
        up = self._stream(self.head, np.concatenate([[0], met]))
        down = self._stream(self.tail, np.concatenate([met, [0]]))
        return np.maximum(up, down)

    def repeats(self, length: int) -> list[np.ndarray]:
        """For each string, whether each of its windows of ``length`` occurs elsewhere."""
        long = self.matching_statistics() >= length
        starts = np.concatenate([[0], self.ends[:-1] + 1])
        return [long[s : s + max(0, len(p) - length + 1)] for s, p in zip(starts.tolist(), self.parts)]


def flagged_spans(flags: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans, from and to, that the flagged windows cover, one for each run of flagged windows."""
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1 + length


def find_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, th, anchor, first, n, periodic of all runs of windows."""
    rows = docs.select("doc_id", text_key().alias("th"), "text").where(F.octet_length("text") >= length)

    def run(batches):
        for b in batches:
            found = [window_runs(t, length, gram) for t in utf8_list(b.column(2))]
            times = np.array([len(f[0]) for f in found])
            at = pa.array(np.repeat(np.arange(len(found)), times))
            first, n, anchor, periodic = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array(anchor), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(periodic.astype(bool))],
                ["doc_id", "th", "anchor", "first", "n", "periodic"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, th long, anchor long, first int, n int, periodic boolean")


def cut_pieces(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """doc_id, th, anchor, first and digest of the given runs; piece with one of the equal ones of a task, times 1 with that and a second one, else 0. A text's runs are bounded by its length."""
    by_text = runs.groupBy(F.col("doc_id").alias("id"), "th").agg(F.collect_list(F.struct("anchor", "first", "n")).alias("runs"))
    texts = docs.select("doc_id", text_key().alias("tk"), "text")
    met = texts.join(by_text, same(texts["doc_id"], by_text["id"]) & (texts["tk"] == by_text["th"])).select("doc_id", "th", "runs", "text")

    def run(batches):
        sent: dict[bytes, int] = {}  # how often this task has met a piece: its bytes go once, its repetition once
        for b in batches:
            lists = b.column(2)
            flat, times = lists.flatten(), np.diff(lists.offsets.to_numpy())
            at = np.repeat(np.arange(b.num_rows), times)
            anchor, first, n = (flat.field(i) for i in range(3))
            texts = utf8_list(b.column(3))
            firsts, ends = first.to_numpy(), first.to_numpy() + n.to_numpy() + length - 1
            for low in range(0, len(at), 8192):
                part = slice(low, low + 8192)
                pieces, digests, many = [], [], []
                for t, a, z in zip(at[part].tolist(), firsts[part].tolist(), ends[part].tolist()):
                    piece = texts[t][a:z]
                    digest = xxhash.xxh3_128_digest(piece)
                    met = sent.get(digest, 0)
                    digests.append(digest)
                    pieces.append(None if met else piece)
                    many.append(int(met < 2))
                    if met < 2:
                        sent[digest] = met + 1
                if len(sent) > SENT:
                    sent.clear()  # they are sent again
                took = pa.array(at[part])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(took), b.column(1).take(took), anchor[low : low + 8192], first[low : low + 8192], pa.array(digests, pa.binary()), pa.array(pieces, pa.binary()), pa.array(many, pa.int32())],
                    ["doc_id", "th", "anchor", "first", "digest", "piece", "times"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return met.mapInArrow(run, f"doc_id {kind}, th long, anchor long, first int, digest binary, piece binary, times int")


SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
SPAN_TYPE = "array<struct<lo: int, hi: int>>"


def index_pieces(pieces: DataFrame, length: int, batch_bytes: int) -> DataFrame:
    """pieces: anchor, digest, piece (null in rows that only count), times. anchor, digest and spans of repeated windows within the piece."""
    sorted_rows = pieces.select("anchor", "digest", "piece", "times").repartition("anchor").sortWithinPartitions("anchor")

    def run(batches):
        held: dict[tuple, list] = {}  # a piece and how often it occurs
        size, last = 0, None

        def out():
            flags = RunIndex([x[0] for x in held.values()]).repeats(length)
            found = []
            for (anchor, digest), (_, times), flag in zip(held, held.values(), flags):
                if times > 1:
                    flag[:] = True
                lo, hi = flagged_spans(flag, length)
                if len(lo):
                    found.append((anchor, digest, [{"lo": x, "hi": y} for x, y in zip(lo.tolist(), hi.tolist())]))
            anchors, digests, spans = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(digests, pa.binary()), pa.array(spans, SPANS)], ["anchor", "digest", "spans"])

        for b in batches:
            for anchor, digest, piece, times in zip(*(c.to_pylist() for c in b.columns)):
                if anchor != last and size >= batch_bytes:
                    yield out()
                    held, size = {}, 0
                last = anchor
                entry = held.setdefault((anchor, digest), [None, 0])
                entry[1] += times
                if entry[0] is None and piece is not None:
                    entry[0] = piece
                    size += len(piece)
        if held:
            yield out()

    return sorted_rows.mapInArrow(run, f"anchor long, digest binary, spans {SPAN_TYPE}")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batch_bytes: int = BATCH_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, th, lo, hi: byte spans covered by strings of ``length`` bytes that start elsewhere too; spans may overlap."""
    prepare(session(docs))
    runs = materialise(find_runs(docs, length, gram), "repeat-runs")
    counts = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("times"), F.max("periodic").alias("periodic")).where("times > 1 or periodic").select("anchor", "times")
    counts = materialise(counts, "repeat-anchors")
    total = runs.count()
    often = F.col("times") * HOT_SHARE > total
    pieces = materialise(cut_pieces(docs, join_often(runs, counts.select("anchor", often.alias("often")), ["anchor"]), length), "repeat-pieces")
    spans = indexed(pieces.where("times > 0").select("anchor", "digest", "piece", "times"), length, gram, batch_bytes, hot)
    places = pieces.select("doc_id", "th", "anchor", "digest", "first")
    # a piece that occurs often has an anchor that does
    of_often = places.join(F.broadcast(counts.where(often)), "anchor").groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n"))
    met = with_spans(places, spans, of_often.where(F.col("n") * HOT_SHARE > total)).select("doc_id", "th", "first", F.explode("spans").alias("s"))
    return met.select("doc_id", "th", (F.col("first") + F.col("s.lo")).alias("lo"), (F.col("first") + F.col("s.hi")).alias("hi"))


def join_often(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with ``table``, which has each key once. Its few keys that are marked ``often`` are broadcast, so that their rows stay where they are."""
    often, seldom = (table.where(x).drop("often") for x in (F.col("often"), ~F.col("often")))
    others = rows.join(F.broadcast(often.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(often), keys).unionByName(others.join(seldom, keys))


def with_spans(places: DataFrame, spans: DataFrame, often: DataFrame) -> DataFrame:
    """``places`` with the spans of their piece; those without are left out. ``often`` has the anchor and digest of the few pieces that very many places have."""
    marked = spans.join(F.broadcast(often.select("anchor", "digest", F.lit(True).alias("often"))), ["anchor", "digest"], "left")
    marked = marked.withColumn("often", F.col("often").isNotNull())
    return join_often(places, materialise(marked, "repeat-spans"), ["anchor", "digest"])


def indexed(pieces: DataFrame, length: int, gram: int, batch_bytes: int, hot: int) -> DataFrame:
    """``index_pieces``, but the anchors (of ``gram`` bytes) with more than ``hot`` different pieces are narrowed first."""
    if gram >= length:  # every piece is one window
        return index_pieces(pieces, length, batch_bytes)
    different = pieces.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("n")).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    large = materialise(different.where(F.col("n") > hot).select("anchor"), "repeat-hot")
    if large.isEmpty():
        return index_pieces(pieces, length, batch_bytes)
    spans = index_pieces(pieces.join(large, "anchor", "left_anti"), length, batch_bytes)
    return spans.unionByName(narrowed(pieces.join(large, "anchor", "left_semi"), length, gram, batch_bytes, hot))


def longer_anchors(piece: bytes, anchor: int, at: int | None, length: int, gram: int) -> list[tuple[int, int, bytes, int]]:
    """key, place, text and the anchor's place in it, of the parts of a piece that have one longer anchor each.

    ``at`` is the anchor's place if it is the only one that counts; at the top
    it is looked for, since a periodic piece has its anchor at several places.
    """
    n, grown = len(piece) - length + 1, -(-(length - gram) // 2)
    if at is None:
        places = np.flatnonzero(gram_hashes(np.frombuffer(piece, np.uint8), gram).view(np.int64) == anchor)
        of = places[np.searchsorted(places, np.arange(n))]  # the first in each window
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        groups = zip(first.tolist(), [*(first[1:] - 1).tolist(), n - 1], of[first].tolist())
    else:
        groups = [(0, n - 1, at)]
    out = []
    for low, high, place in groups:
        # windows that go on before the anchor by ``grown`` bytes, and those that go on behind it
        for a, z, new, side in ((low, min(high, place - grown), place - grown, b"<"), (max(low, place - grown + 1), high, place, b">")):
            if a <= z:
                out.append((xxhash.xxh3_64_intdigest(side + piece[new : new + gram + grown]) - (1 << 63), a, piece[a : z + length], new - a))
    return out


def narrowed(pieces: DataFrame, length: int, gram: int, batch_bytes: int, hot: int) -> DataFrame:
    """What ``index_pieces`` gives, of anchors with very many pieces: their windows are dealt by longer anchors."""
    at = F.first("at", ignorenulls=True) if "at" in pieces.columns else F.lit(None).cast("int")
    once = pieces.groupBy("anchor", "digest").agg(F.first("piece", ignorenulls=True).alias("piece"), at.alias("at"), F.sum("times").cast("int").alias("times"))
    once = materialise(once, "repeat-hot-pieces")

    def run(batches):
        for b in batches:
            rows = [
                (anchor, digest, place, key, xxhash.xxh3_128_digest(text), text, new, min(times, 2))
                for anchor, digest, piece, at, times in zip(*(c.to_pylist() for c in b.columns))
                for key, place, text, new in longer_anchors(piece, anchor, at, length, gram)
            ]
            kinds = pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32()
            names = ["up", "whole", "place", "anchor", "digest", "piece", "at", "times"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)

    parts = once.mapInArrow(run, "up long, whole binary, place int, anchor long, digest binary, piece binary, at int, times int")
    # what only one piece has beside its anchor is repeated nowhere
    shared = parts.groupBy("anchor").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("parts")).where("n > 1").select("anchor", "parts")
    shared = materialise(shared, "repeat-shared")
    total = shared.agg(F.sum("parts")).first()[0] or 0
    parts = materialise(join_often(parts, shared.select("anchor", (F.col("parts") * HOT_SHARE > total).alias("often")), ["anchor"]), "repeat-parts")
    different = parts.groupBy("anchor", "digest").agg(F.first("piece").alias("piece"), F.first("at").alias("at"), F.sum("times").cast("int").alias("times"), F.count(F.lit(1)).alias("parts"))
    different = materialise(different, "repeat-narrowed")
    spans = indexed(different.drop("parts"), length, gram + -(-(length - gram) // 2), batch_bytes, hot)
    places = parts.select("up", "whole", "place", "anchor", "digest")
    met = with_spans(places, spans, different.where(F.col("parts") * HOT_SHARE > total)).select("up", "whole", "place", F.explode("spans").alias("s"))
    own = F.struct((F.col("place") + F.col("s.lo")).alias("lo"), (F.col("place") + F.col("s.hi")).alias("hi"))
    return met.groupBy(F.col("up").alias("anchor"), F.col("whole").alias("digest")).agg(F.collect_list(own).alias("spans"))


def join_spans(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Maximal spans, in order."""
    out: list[list[int]] = []
    for a, z in sorted(zip(lo.tolist(), hi.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def remove_repeats(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_bytes, spans (array<struct<lo, hi>>, maximal, in bytes) and kept (binary) of every row of ``docs``."""
    spans = repeated_spans(docs, **how)
    # a text's spans are bounded by its length
    by_text = spans.groupBy(F.col("doc_id").alias("id"), "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    texts = docs.select("doc_id", text_key().alias("tk"), "text")
    met = texts.join(by_text, same(texts["doc_id"], by_text["id"]) & (texts["tk"] == by_text["th"]), "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts, found, kept = utf8_list(b.column(1)), [], []
            for text, spans in zip(texts, b.column(2).to_pylist()):
                joined = join_spans(np.array([s["lo"] for s in spans]), np.array([s["hi"] for s in spans])) if spans else []
                cuts = [0, *(x for s in joined for x in s), len(text)]
                kept.append(b"".join(text[a:z] for a, z in zip(cuts[::2], cuts[1::2])) if joined else text)
                found.append([{"lo": a, "hi": z} for a, z in joined])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(found, SPANS), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return met.mapInArrow(run, f"doc_id {kind}, n_bytes long, spans {SPAN_TYPE}, kept binary")


def op4_suffix_dedup(spark, sf_dir) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.length("kept").cast("long").alias("n_kept"),
    )
