"""Importance resampling of documents towards a target by hashed word runs.

Features are all runs of one to three consecutive words; a feature's bucket is
the CRC-32 of its bytes. The source's and the target's bucket totals give each
bucket a gain, a document's weight is the sum over its features, and seeded
Gumbel noise makes the highest scores a draw without replacement.

CRC-32 is linear, so the state of ``a b`` follows from the state of ``a``, moved
on by the length of `` b``, and the state of `` b`` alone. ``Head`` holds these
for the most frequent words, and the states of the most frequent pairs of those;
both tables have a fixed size and are broadcast. A feature of head words takes
its bucket from there, without its bytes ever being joined. One that holds any
other word, the tail, takes the CRC-32 of its bytes directly. Both give the same
number, so the size of the head changes the time only. Bucket totals are exact:
each task sends one number per bucket.

Ranks come from range partitions of the scores, sorted on their own, and the
partitions' sizes: no task sees more than its range.

Cases: a null text has no words; a null doc_id is hashed as an empty text and
ranks after all others of its score; rows that repeat an id share their noise
and are drawn one by one; documents without features weigh 0; without target
texts (or source texts) totals are 0 and gains still finite; of fewer than
``100 / percent`` long documents none is drawn; other columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import chain
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise, numbered, prepare, session, utf8_list

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 42, 5, 20
#: Words and pairs in the head, and the bytes of its longest word.
HEAD_WORDS, HEAD_PAIRS, LONGEST = 1 << 16, 1 << 16, 32
#: Words, most frequent first, whose pairs are counted.
PAIR_WORDS = 2048
TAIL = -1

#: A-Z become a-z; every other ASCII character but digits and a-z is a blank.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def moves() -> np.ndarray:
    """[n, k, b]: what byte k of a CRC state, having the value b, becomes behind n further zero bytes."""
    poly, table = 0xEDB88320, np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(poly), table >> 1).astype(np.uint32)
    out = np.empty((LONGEST + 2, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, LONGEST + 2):
        out[n] = table[out[n - 1] & np.uint32(255)] ^ (out[n - 1] >> np.uint32(8))
    return out


MOVES = moves()


def moved_on(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part of crc(x + y) that x has, from crc(x) and the length of y; the other part is crc(y)."""
    return MOVES[n, 0, crc & 255] ^ MOVES[n, 1, crc >> 8 & 255] ^ MOVES[n, 2, crc >> 16 & 255] ^ MOVES[n, 3, crc >> 24]


class Head:
    """CRC states of frequent words, and of frequent pairs by the code ``first * len(words) + second``."""

    def __init__(self, words: list[bytes]):
        self.ids = {w: i for i, w in enumerate(words)}
        self.alone = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.after = np.array([zlib.crc32(b" " + w) for w in words], np.uint32)
        self.length = np.array([len(w) + 1 for w in words], np.int64)
        self.pairs, self.states = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def with_pairs(self, codes: np.ndarray) -> Head:
        self.pairs = np.sort(codes)
        self.states = self.joined(self.alone[self.pairs // max(1, len(self.alone))], self.pairs % max(1, len(self.alone)))
        return self

    def joined(self, crc: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states behind a blank and one more head word."""
        return moved_on(crc, self.length[word]) ^ self.after[word]

    def numbered(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.get, words, _tails), np.int64, len(words))

    def codes(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The codes of all pairs of head words; ``starts`` are the first words of documents."""
        whole = (ids[:-1] != TAIL) & (ids[1:] != TAIL)
        whole[starts[(starts > 0) & (starts < len(ids))] - 1] = False
        at = np.flatnonzero(whole)
        return ids[at] * len(self.alone) + ids[at + 1]

    def buckets(self, texts: list[list[bytes]], buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of every feature of the texts, and the text of each."""
        words = list(chain.from_iterable(texts))
        sizes = np.array([len(t) for t in texts], np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        ids = self.numbered(words)
        head = ids != TAIL
        crc = np.zeros(len(words), np.uint32)
        crc[head] = self.alone[ids[head]]
        for i in np.flatnonzero(~head).tolist():
            crc[i] = zlib.crc32(words[i])
        found, of, head_run = [crc], [owner], head
        for n in (2, 3):
            # runs of n words start where a run of n - 1 does, if one more word of the text follows
            starts = np.flatnonzero(owner[: max(0, len(words) - n + 1)] == owner[n - 1 :])
            known = head_run[starts] & head[starts + n - 1]
            state, at, last = np.empty(len(starts), np.uint32), starts[known], ids[starts[known] + n - 1]
            new = np.empty(len(at), np.uint32)
            rest = np.ones(len(at), bool)
            if n == 2 and len(self.pairs):
                code = ids[at] * len(self.alone) + last
                place = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
                rest = self.pairs[place] != code
                new[~rest] = self.states[place[~rest]]
            new[rest] = self.joined(crc[at[rest]], last[rest])
            state[known] = new
            tail = np.flatnonzero(~known)
            state[tail] = [zlib.crc32(b" ".join(words[i : i + n])) for i in starts[tail].tolist()]
            found.append(state)
            of.append(owner[starts])
            crc = np.zeros(len(words), np.uint32)
            crc[starts] = state
            head_run = np.zeros(len(words), bool)
            head_run[starts] = known
        return np.concatenate(found) % np.uint32(buckets), np.concatenate(of)


class _Tails:
    """Endless default for the lookup of words."""

    def __iter__(self):
        return self

    def __next__(self):
        return TAIL


_tails = _Tails()


def most_frequent(rows: DataFrame, key: str, n: int, name: str) -> list:
    """The most frequent keys of rows that hold key and n: at most ``n``, whole classes of counts only.

    Counts within ten per cent are one class, so the driver sees a few hundred
    classes and then no more than ``n`` keys.
    """
    counted = rows.groupBy(key).agg(F.sum("n").alias("n")).where("n > 1").withColumn("size", F.floor(F.log("n") / log(1.1)).cast("int"))
    counted = materialise(counted, name)
    least, found = None, 0
    for r in counted.groupBy("size").agg(F.count(F.lit(1)).alias("keys")).orderBy(F.desc("size")).collect():
        found += r["keys"]
        if found > n:
            break
        least = r["size"]
    if least is None:
        return []
    return [r[key] for r in sorted(counted.where(F.col("size") >= least).select(key, "n").collect(), key=lambda r: (-r["n"], r[key]))]


def learn_head(docs: DataFrame, words: int = HEAD_WORDS, pairs: int = HEAD_PAIRS) -> Head:
    """The head of the corpus: counted in all tasks, at most ``words`` and ``pairs`` entries reach the driver."""
    spark = prepare(session(docs))
    texts = docs.select("text")

    def counted(batches):
        held: dict[bytes, int] = {}
        get = held.get

        def out():
            some = [w for w in held if len(w) <= LONGEST]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([held[w] for w in some], pa.int64())], ["word", "n"])

        for b in batches:
            for text in utf8_list(b.column(0)):
                for w in words_of(text):
                    held[w] = get(w, 0) + 1
            if len(held) > 500_000:
                yield out()
                held.clear()
        yield out()

    # words and pairs seen once by a task are sent all the same: counts are exact
    head = Head([bytes(w) for w in most_frequent(texts.mapInArrow(counted, "word binary, n long"), "word", words, "importance-words")]) if words else Head([])
    if not pairs or not head.ids:
        return head
    # a frequent pair has two frequent words: a fixed table of counts holds all pairs of the first PAIR_WORDS
    shared = spark.sparkContext.broadcast(head)

    def paired(batches):
        head = shared.value
        width, near = len(head.alone), min(PAIR_WORDS, len(head.alone))
        total = np.zeros(near * near, np.int32)
        for b in batches:
            texts = [words_of(t) for t in utf8_list(b.column(0))]
            starts = np.cumsum([0] + [len(t) for t in texts])[:-1]
            code = head.codes(head.numbered(list(chain.from_iterable(texts))), starts)
            first, second = code // width, code % width
            few = (first < near) & (second < near)
            np.add.at(total, first[few] * near + second[few], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at // max(1, near) * width + at % max(1, near)), pa.array(total[at].astype(np.int64))], ["code", "n"])

    return head.with_pairs(np.array(most_frequent(texts.mapInArrow(paired, "code long, n long"), "code", pairs, "importance-pairs"), np.int64))


def bucket_totals(docs: DataFrame, head: Head, buckets: int = BUCKETS) -> list[int]:
    """How many features of all texts fall into each bucket."""
    shared = prepare(session(docs)).sparkContext.broadcast(head)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            found, _ = shared.value.buckets([words_of(t) for t in utf8_list(b.column(0))], buckets)
            total += np.bincount(found, minlength=buckets)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["bucket", "n"])

    out = [0] * buckets
    for r in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> np.ndarray:
    """Of each bucket, in thousandths: the logarithm of how much more often the target has it."""
    s_all, t_all, n = sum(source), sum(target), len(source)
    return np.array([floor(1000 * log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source, target)], np.int64)


def weighted(docs: DataFrame, head: Head, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    shared = prepare(session(docs)).sparkContext.broadcast((head, gain))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        head, gain = shared.value
        for b in batches:
            texts = [words_of(t) for t in utf8_list(b.column(1))]
            found, of = head.buckets(texts, len(gain))
            weight = np.zeros(len(texts), np.int64)
            np.add.at(weight, of, gain[found])
            words = np.array([len(t) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(np.bincount(of, minlength=len(texts)).astype(np.int64)), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, among, share: int) -> DataFrame:
    """``rows`` with rank: 1, 2, ... by descending score, then doc_id, for the first ``share`` percent of those that ``among`` holds for."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    placed = numbered(rows.where(among), order, "place", "importance-sorted")
    drawn = share * placed.count() // 100
    first = placed.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1)).drop("place")
    return first.unionByName(rows.where(~among).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, words: int = HEAD_WORDS, pairs: int = HEAD_PAIRS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of every row of ``docs``; ``target`` has the texts to come near to."""
    head = learn_head(docs, words, pairs)
    gain = gains(bucket_totals(docs, head, buckets), bucket_totals(target, head, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    rows = materialise(weighted(docs, head, gain).withColumn("score", F.col("weight") + noise), "importance-weights")
    return ranked(rows, F.col("n_words") >= least_words, percent)


def select(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns; of rows that repeat an id, all stay if one is drawn."""
    drawn = resampled(docs, target, **how).where("rank is not null").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(drawn, docs["doc_id"].eqNullSafe(drawn["__drawn"]), "left_semi")


def op13_importance(spark, sf_dir) -> DataFrame:
    target = prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return resampled(documents(spark, sf_dir), target).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op13_sql(buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> str:
    """The query in SQL. A run's CRC goes on from that of the run without its last word, byte by byte."""
    table = list(range(256))
    for _ in range(8):
        table = [n >> 1 ^ 0xEDB88320 * (n & 1) for n in table]
    upper = "".join(map(chr, range(65, 91)))

    def after(state: str, more: str) -> str:
        return f"list_reduce(list_concat([{state}], {more}), lambda c, x: xor({table}[(xor(c, x) & 255) + 1], c >> 8))"

    def bucket(state: str) -> str:
        return f"xor({state}, 4294967295) % {buckets} AS bucket"

    return f"""
WITH texts AS (SELECT doc_id, NULL AS item, text FROM documents UNION ALL SELECT NULL, item_id, text FROM benchmark),
w AS (
  SELECT row_number() OVER () AS r, doc_id, item,
         regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS a
  FROM texts),
i AS (SELECT r, a, unnest(range(1, len(a) + 1)) AS i FROM w),
f AS MATERIALIZED (SELECT r, a[i] AS w1, a[i + 1] AS w2, a[i + 2] AS w3 FROM i),
b AS MATERIALIZED (
  SELECT w1 AS word, list_transform(regexp_extract_all(hex(encode(w1)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes
  FROM (SELECT DISTINCT w1 FROM f)),
f1 AS MATERIALIZED (SELECT word AS w1, {after("4294967295", "bytes")} AS state FROM b),
f2 AS MATERIALIZED (
  SELECT w1, w2, {after("state", "list_concat([32], bytes)")} AS state
  FROM (SELECT DISTINCT w1, w2 FROM f WHERE w2 IS NOT NULL) JOIN f1 USING (w1) JOIN b ON word = w2),
f3 AS MATERIALIZED (
  SELECT w1, w2, w3, {after("state", "list_concat([32], bytes)")} AS state
  FROM (SELECT DISTINCT w1, w2, w3 FROM f WHERE w3 IS NOT NULL) JOIN f2 USING (w1, w2) JOIN b ON word = w3),
p AS MATERIALIZED (
  SELECT r, bucket, count(*) AS n FROM (
    SELECT r, {bucket("state")} FROM f JOIN f1 USING (w1)
    UNION ALL SELECT r, {bucket("state")} FROM f JOIN f2 USING (w1, w2)
    UNION ALL SELECT r, {bucket("state")} FROM f JOIN f3 USING (w1, w2, w3))
  GROUP BY r, bucket),
t AS (
  SELECT bucket, coalesce(sum(n) FILTER (item IS NULL), 0) AS s, coalesce(sum(n) FILTER (item IS NOT NULL), 0) AS t
  FROM p JOIN w USING (r) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * ((SELECT sum(s) FROM t) + {buckets}) AS DOUBLE) / CAST((s + 1) * ((SELECT sum(t) FROM t) + {buckets}) AS DOUBLE))) AS BIGINT) AS gain
  FROM t),
d AS (
  SELECT w.r, doc_id, len(a) AS n_words, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_features, CAST(coalesce(sum(n * gain), 0) AS BIGINT) AS weight
  FROM w LEFT JOIN p ON p.r = w.r LEFT JOIN g USING (bucket) WHERE item IS NULL GROUP BY w.r, doc_id, a),
s AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST, n_features, weight) AS rank FROM s WHERE n_words >= {least_words})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {percent} * (SELECT count(*) FROM k) // 100 THEN rank END AS rank, n_words
FROM s LEFT JOIN k USING (r)
"""


OP13_SQL = op13_sql()
