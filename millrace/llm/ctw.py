"""Language-model scores by context-tree weighting over bytes.

A text is its words (A-Z lower-cased, split at ASCII white space), each with a
blank behind it, the last with a line feed instead: the end. An empty text is
the end alone. A byte is eight binary decisions, each decision (the bits of the
byte so far) having a context tree of its own over the ``DEPTH`` bytes before,
nearest byte first; line feeds stand before a text. A node with ``a`` zeros and
``b`` ones gives them the Krichevsky-Trofimov probability KT(a, b), and its
weighted probability is half of that plus half of the product of its children's;
at ``DEPTH`` it is KT alone. That is a function of counts, so the tree is built
from counted byte runs. A decision's probability is the mixture along its path,
each node weighing its own estimate (b + 1/2) / (a + b + 1) by its share. A node
never learned gives 1/2, as do all below it.

In Spark: documents are written in chunks of about ``CHUNK`` bytes. Each chunk
counts its distinct runs of DEPTH + 1 bytes and its distinct words, and sends
them, packed, to parts dealt by the nearest ``UPPER + 1`` context bytes (words:
by hash). Parts add up learning counts and write them; whole subtrees lie in one
part, and only the sums of the nodes of depth ``UPPER`` leave it. The tree above
(at most 2^24 nodes, in valid UTF-8 far fewer) is broadcast. Then each part
answers the chunks' messages, each distinct run once, and the answers meet the
chunks again. A run that every text has is one entry per chunk; no task holds
more than its part of the runs and one chunk's answers.

Logarithms of probabilities are kept in multiples of 1 / ``UNIT``, so that sums
do not depend on order and reruns agree.

Cases: null counts as empty; a null doc_id is neither held out nor learned from;
repeated rows are documents of their own and score alike; without any learning
text every decision is 1/2 and every word unknown; an empty table gives an empty
result; a very long text is a chunk of its own; other columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise, prepare, session, utf8_list

DEPTH, UPPER, CHUNK, UNIT = 5, 2, 16 << 20, 1 << 14
#: Parts: one for so many bytes of text, and no more than that, since distinct runs get few as texts get many.
PART_BYTES, MOST_PARTS = 24 << 20, 4096
#: What a part gathers before it answers.
AT_ONCE = 2_000_000
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
RUNS, WORDS = 0, 1


def normalised(text: bytes) -> bytes:
    return b" ".join(text.translate(LOWER).split()) + b"\n"


def tokens(data: bytes) -> list[bytes]:
    """The words of a normalised text, and its end."""
    found = data.split()
    found.append(b"\n")
    return found


def runs(texts: list[bytes], depth: int) -> np.ndarray:
    """For each byte of the texts the packed run: context bytes, nearest first, then the byte itself."""
    x = np.frombuffer(b"".join(b"\n" * depth + t for t in texts), np.uint8).astype(np.uint64)
    out = x.copy()
    for back in range(1, depth + 1):
        out[back:] |= x[:-back] << np.uint64(8 * (depth + 1 - back))
    real = np.ones(len(x), bool)
    starts = np.cumsum([0] + [len(t) + depth for t in texts])[:-1]
    for i in range(depth):
        real[starts + i] = False
    return out[real]


def part_of(key: np.ndarray, depth: int, parts: int) -> np.ndarray:
    """The part of each run, by its nearest UPPER + 1 context bytes."""
    near = key >> np.uint64(8 * (depth - UPPER))
    return ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(parts)


def packed(values: np.ndarray, ascending: bool = False) -> bytes:
    """64-bit numbers: differences if ascending, bytes of one rank together, compressed."""
    values = values.astype(np.uint64)
    if ascending and len(values):
        values = np.diff(values, prepend=np.uint64(0))
    shape = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(shape).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, ascending: bool = False) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    shape = np.frombuffer(pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    values = np.ascontiguousarray(shape.T).view(np.uint64).reshape(n)
    return np.cumsum(values, dtype=np.uint64) if ascending else values


def packed_words(words: list[bytes]) -> bytes:
    data = b" ".join(words)  # no word holds a blank
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked_words(data: bytes) -> list[bytes]:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True).split(b" ")


# ---- the tree


@lru_cache(maxsize=2)
def rising_table(offset: float) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(256) + offset))])


def log_rising(k: np.ndarray, offset: float) -> np.ndarray:
    """log of offset * (offset + 1) * ... * (offset + k - 1)."""
    table = rising_table(offset)
    out = table[np.minimum(k, 256)]
    far = k > 256
    if far.any():

        def log_gamma(x):
            return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)

        out[far] = table[256] + log_gamma(k[far] + offset) - log_gamma(np.float64(256 + offset))
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_rising(zeros, 0.5) + log_rising(ones, 0.5) - log_rising(zeros + ones, 1.0)


class Level:
    """The nodes of one depth. key: sorted (context, byte) runs; run[j]: the node of each at decision j; one[j] and own[j]: a node's estimate of a one, and its share."""

    def __init__(self, key: np.ndarray, count: np.ndarray, below: list[np.ndarray] | None):
        """below: for each decision the sums of the children's log probabilities, in the order of its nodes; None at the deepest level."""
        self.key, self.run, self.one, self.own, self.logp = key, [], [], [], []
        for j in range(8):
            node = key >> np.uint64(8 - j)
            first = np.ones(len(key), bool)
            first[1:] = node[1:] != node[:-1]
            starts = np.flatnonzero(first)
            bit = (key >> np.uint64(7 - j)) & np.uint64(1)
            total, ones = (np.add.reduceat(c, starts) if len(starts) else np.zeros(0, np.int64) for c in (count, count * bit.astype(np.int64)))
            kt = log_kt(total - ones, ones)
            if below is None:
                own, logp = np.ones(len(starts)), kt
            else:
                own = 1 / (1 + np.exp(np.clip(below[j] - kt, -700, 700)))
                logp = np.logaddexp(kt, below[j]) - np.log(2)
            self.run.append((np.cumsum(first) - 1).astype(np.int32))
            self.one.append((ones + 0.5) / (total + 1))
            self.own.append(own)
            self.logp.append(np.rint(logp * UNIT))

    def nodes(self, j: int) -> np.ndarray:
        """The nodes of decision j, each as its context and the bits so far."""
        return np.unique(self.key >> np.uint64(8 - j)) if len(self.key) else self.key

    def parents(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes one level up of decision j, and the sums of their children's log probabilities, in units."""
        node = self.nodes(j)
        context, bits = node >> np.uint64(j + 8), node & np.uint64((1 << j) - 1)
        up, at = np.unique(context << np.uint64(j) | bits, return_inverse=True)
        return up, np.bincount(at, self.logp[j], len(up))


def shorter(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs without their farthest byte, and their counts."""
    up, at = np.unique((key >> np.uint64(16)) << np.uint64(8) | key & np.uint64(255), return_inverse=True)
    return up, np.bincount(at, count, len(up)).astype(np.int64)


def levels(key: np.ndarray, count: np.ndarray, depth: int, least: int, below: list[np.ndarray] | None = None) -> dict[int, Level]:
    """Level by depth, from ``depth`` up to ``least``."""
    out = {}
    for d in range(depth, least - 1, -1):
        out[d] = Level(key, count, below)
        if d > least:
            below = [out[d].parents(j)[1] / UNIT for j in range(8)]
            key, count = shorter(key, count)
    return out


def log10_probabilities(key: np.ndarray, tree: dict[int, Level], depth: int) -> np.ndarray:
    """Of the last byte of each run behind its context."""
    p = np.full((8, len(key)), 0.5)
    bits = [((key >> np.uint64(7 - j)) & np.uint64(1)).astype(bool) for j in range(8)]
    for d in range(depth, -1, -1):
        level = tree.get(d)
        if level is None or not len(level.key):
            continue
        wanted = (key >> np.uint64(8 * (depth - d + 1))) << np.uint64(8) | key & np.uint64(255)
        at = np.searchsorted(level.key, wanted)
        right, left = np.minimum(at, len(level.key) - 1), np.maximum(at - 1, 0)
        # the neighbours on both sides share the most leading bits
        by_right, by_left = level.key[right] ^ wanted, level.key[left] ^ wanted
        place, differ = np.where(by_right < by_left, right, left), np.minimum(by_right, by_left)
        for j in range(8):
            hit = differ >> np.uint64(8 - j) == 0
            node = level.run[j][place]
            one, own = level.one[j][node], level.own[j][node]
            mixed = own * np.where(bits[j], one, 1 - one) + (1 - own) * p[j]
            p[j] = np.where(hit, mixed, p[j])
    return np.log10(p).sum(0)


# ---- the job


def in_chunks(docs: DataFrame, learns, held_out, chunk_bytes: int = CHUNK) -> DataFrame:
    """Written: chunk, doc_id, held_out, learns, data. A chunk is a stretch of consecutive rows of one task."""
    rows = docs.select("doc_id", held_out.alias("held_out"), learns.alias("learns"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        base, at, size = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            data = [normalised(t) for t in utf8_list(b.column(3))]
            chunk = []
            for d in data:
                if size > chunk_bytes:
                    at, size = at + 1, 0
                size += len(d)
                chunk.append(base + at)
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), *b.columns[:3], pa.array(data, pa.binary())], ["chunk", "doc_id", "held_out", "learns", "data"])

    return materialise(rows.mapInArrow(run, f"chunk long, doc_id {kind}, held_out boolean, learns boolean, data binary"), "ctw-chunks")


def messages(chunks: DataFrame, depth: int, parts: int) -> DataFrame:
    """kind, part, chunk, keys, counts: what each chunk has, each key once for each task that reads it, with its learning count."""

    def run(batches):
        now, held, size, words = None, [], 0, {}

        def merged():
            key, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return key, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        def out():
            key, n = merged()
            part = part_of(key, depth, parts)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            rows = [(RUNS, int(part[i[0]]), packed(key[i], True), packed(n[i])) for i in np.split(order, cuts)]
            by_part: list[list] = [[] for _ in range(parts)]
            for w in words:
                by_part[zlib.crc32(w) % parts].append(w)
            rows += [(WORDS, i, packed_words(own), packed(np.array([words[w] for w in own], np.int64))) for i, own in enumerate(by_part) if own]
            kind, part, keys, counts = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array([now] * len(rows), pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())],
                ["kind", "part", "chunk", "keys", "counts"],
            )

        for b in batches:
            chunk, learns, data = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_pylist()
            for c in np.unique(chunk).tolist():
                if c != now and now is not None:
                    yield out()
                    held, size, words = [], 0, {}
                now = c
                for learned in (True, False):
                    own = [d for d, x in zip(data, (chunk == c) & (learns == learned)) if x]
                    if own:
                        key, n = np.unique(runs(own, depth), return_counts=True)
                        held.append((key, n if learned else np.zeros(len(key), np.int64)))
                        size += len(key)
                        get = words.get
                        for d in own:
                            for w in tokens(d):
                                words[w] = get(w, 0) + learned
                if size > 4 * AT_ONCE:
                    held = [merged()]
                    size = len(held[0][0])
        if now is not None:
            yield out()

    return chunks.select("chunk", "learns", "data").mapInArrow(run, "kind int, part int, chunk long, keys binary, counts binary")


def grouped(batches):
    """Rows of Arrow batches one by one, as tuples."""
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


class Sum:
    """Counts of one part, added up as messages come."""

    def __init__(self):
        self.held, self.size, self.words = [], 0, {}

    def add(self, kind: int, keys: bytes, counts: bytes) -> None:
        n = unpacked(counts).astype(np.int64)
        if kind == WORDS:
            get = self.words.get
            for w, c in zip(unpacked_words(keys), n.tolist()):
                if c:
                    self.words[w] = get(w, 0) + c
        else:
            self.held.append((unpacked(keys, True)[n > 0], n[n > 0]))
            self.size += len(self.held[-1][1])
            if self.size > 2 * AT_ONCE:
                self.held = [self.runs()]
                self.size = 2 * len(self.held[0][0]) // 3  # so that merging stays in proportion

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        key, at = np.unique(np.concatenate([k for k, _ in self.held]), return_inverse=True)
        return key, np.bincount(at, np.concatenate([n for _, n in self.held])).astype(np.int64)


def add_up(sent: DataFrame) -> DataFrame:
    """Written: kind, part, keys, counts: the learning counts of each part."""

    def run(batches):
        now, total = None, None

        def out():
            kind, part = now
            if kind == WORDS:
                rows = [(packed_words(list(total.words)), packed(np.array(list(total.words.values()), np.int64)))] if total.words else []
            else:
                key, n = total.runs()
                rows = [(packed(key, True), packed(n))] if len(key) else []
            return pa.RecordBatch.from_pylist([{"kind": kind, "part": part, "keys": k, "counts": n} for k, n in rows], pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

        for kind, part, keys, counts in grouped(batches):
            if (kind, part) != now:
                if now is not None:
                    yield out()
                now, total = (kind, part), Sum()
            total.add(kind, keys, counts)
        if now is not None:
            yield out()

    dealt = sent.select("kind", "part", "keys", "counts").repartition("kind", "part").sortWithinPartitions("kind", "part")
    return materialise(dealt.mapInArrow(run, "kind int, part int, keys binary, counts binary"), "ctw-counts")


def upper_tree(counts: DataFrame, depth: int) -> dict[int, Level]:
    """Levels 0 to UPPER, from what the parts sum up: at most 2^24 nodes."""

    def run(batches):
        for _, _, keys, n in grouped(batches):
            key, count = unpacked(keys, True), unpacked(n).astype(np.int64)
            tree = levels(key, count, depth, UPPER + 1)
            lowest = tree[UPPER + 1]
            for d in range(depth, UPPER, -1):
                key, count = shorter(key, count)
            rows = [(8, key, count)] + [(j, *lowest.parents(j)) for j in range(8)]
            for j, node, n in rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), j, np.int32)), pa.array(node.view(np.int64)), pa.array(n.astype(np.int64))], ["decision", "node", "n"])

    found = counts.where(F.col("kind") == RUNS).mapInArrow(run, "decision int, node long, n long").groupBy("decision", "node").agg(F.sum("n").alias("n")).toArrow()
    decision, node, n = (found[c].to_numpy() for c in ("decision", "node", "n"))
    by = {}
    for j in range(9):
        own = np.flatnonzero(decision == j)
        order = np.argsort(node[own])
        by[j] = node[own][order].view(np.uint64), n[own][order]
    return levels(*by[8], UPPER, 0, [by[j][1] / UNIT for j in range(8)])


def answered(sent: DataFrame, counts: DataFrame, upper: dict[int, Level], depth: int) -> DataFrame:
    """chunk, kind, keys, answers: for runs log10 of their probability (float64), for words their learning count."""
    shared = session(sent).sparkContext.broadcast(upper)

    def run(batches):
        now, tree, words, held, size = None, {}, {}, [], 0

        def out():
            if now[0] == WORDS:
                for chunk, keys in held:
                    n = np.fromiter((words.get(w, 0) for w in unpacked_words(keys)), np.int64)
                    yield chunk, WORDS, keys, packed(n)
                return
            each = [unpacked(keys, True) for _, keys in held]
            every = np.unique(np.concatenate(each))
            p = np.concatenate([log10_probabilities(every[i : i + 200_000], tree, depth) for i in range(0, len(every), 200_000)])
            for (chunk, keys), key in zip(held, each):
                yield chunk, RUNS, keys, p[np.searchsorted(every, key)].astype(np.float32).tobytes()

        def sent_back():
            for chunk, kind, keys, answers in out():
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([kind], pa.int32()), pa.array([keys], pa.binary()), pa.array([answers], pa.binary())], ["chunk", "kind", "keys", "answers"])

        for kind, part, is_counts, chunk, keys, n in grouped(batches):
            if (kind, part) != now:
                if held:
                    yield from sent_back()
                now, held, size, words, tree = (kind, part), [], 0, {}, dict(shared.value)
            if is_counts == 0:
                count = unpacked(n).astype(np.int64)
                if kind == WORDS:
                    words = dict(zip(unpacked_words(keys), count.tolist()))
                else:
                    tree |= levels(unpacked(keys, True), count, depth, UPPER + 1)
                continue
            held.append((chunk, keys))
            size += int.from_bytes(keys[:8], "little")
            if size > AT_ONCE:
                yield from sent_back()
                held, size = [], 0
        if held:
            yield from sent_back()

    model = counts.select("kind", "part", F.lit(0).alias("asks"), F.lit(None).cast("long").alias("chunk"), "keys", "counts")
    asked = sent.select("kind", "part", F.lit(1).alias("asks"), "chunk", "keys", F.lit(None).cast("binary").alias("counts"))
    dealt = model.unionByName(asked).repartition("kind", "part").sortWithinPartitions("kind", "part", "asks")
    return dealt.mapInArrow(run, "chunk long, kind int, keys binary, answers binary")


def scored(docs: DataFrame, learns, held_out=None, depth: int = DEPTH, chunk_bytes: int = CHUNK, parts: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of every document.

    ``learns`` and ``held_out`` are conditions on rows.
    """
    spark = prepare(session(docs))
    assert UPPER < depth <= 7
    chunks = in_chunks(docs, learns, ~learns if held_out is None else held_out, chunk_bytes)
    size = chunks.agg(F.sum(F.length("data"))).first()[0] or 0
    parts = parts or max(1, min(MOST_PARTS, size // PART_BYTES))
    sent = materialise(messages(chunks, depth, parts), "ctw-messages")
    counts = add_up(sent)
    upper = upper_tree(counts, depth)

    def totals(batches):
        for _, _, _, n in grouped(batches):
            n = unpacked(n)
            yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())]), pa.array([len(n)])], ["tokens", "kinds"])

    whole = counts.where(F.col("kind") == WORDS).mapInArrow(totals, "tokens long, kinds long").agg(F.sum("tokens"), F.sum("kinds")).first()
    n_all, n_kinds = whole[0] or 0, whole[1] or 0
    below = np.log10(n_all + 0.5 * (n_kinds + 1))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        now, held, words, table = None, [], {}, None

        def judged(doc_id, out, data):
            nonlocal table
            if table is None:
                key, p = (np.concatenate(x) for x in zip(*held))
                order = np.argsort(key, kind="stable")
                table = key[order], p[order].astype(np.float64)
            key, at = np.unique(runs(data, depth), return_inverse=True)
            p = table[1][np.searchsorted(table[0], key)][at]
            sizes = np.array([len(d) for d in data], np.int64)
            score = np.add.reduceat(p, np.cumsum(sizes) - sizes)
            found = [np.array([words[w] for w in tokens(d)], np.float64) for d in data]
            base = [float(np.log10(c + 0.5).sum() - len(c) * below) for c in found]
            return pa.RecordBatch.from_arrays(
                [
                    doc_id, out, pa.array([len(c) for c in found], pa.int64()), pa.array([int((c > 0).sum()) for c in found], pa.int64()), pa.array([n_all] * len(data), pa.int64()),
                    pa.array(base), pa.array(score), pa.array(sizes), pa.array(-score * np.log2(10) / sizes),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"],
            )

        for b in batches:
            chunk, asks = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(chunk) != 0) | (np.diff(asks) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chunk)]):
                if chunk[lo] != now:
                    now, held, words, table = chunk[lo], [], {}, None
                part = b.slice(lo, hi - lo)
                if asks[lo]:
                    yield judged(part.column(2), part.column(3), part.column(4).to_pylist())
                    continue
                for what, keys, answers in zip(*(part.column(i).to_pylist() for i in (5, 4, 6))):
                    if what == WORDS:
                        words.update(zip(unpacked_words(keys), unpacked(answers).tolist()))
                    else:
                        held.append((unpacked(keys, True), np.frombuffer(answers, np.float32)))

    none = lambda kind: F.lit(None).cast(kind)
    answers = answered(sent, counts, upper, depth).select("chunk", F.lit(0).alias("asks"), none(kind).alias("doc_id"), none("boolean").alias("held_out"), F.col("keys").alias("data"), "kind", "answers")
    asked = chunks.select("chunk", F.lit(1).alias("asks"), "doc_id", "held_out", "data", none("int").alias("kind"), none("binary").alias("answers"))
    met = answers.unionByName(asked).repartition("chunk").sortWithinPartitions("chunk", "asks")
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return met.mapInArrow(run, schema)


def op12_ctw(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    return scored(docs, ~held_out & F.col("doc_id").isNotNull(), held_out)
