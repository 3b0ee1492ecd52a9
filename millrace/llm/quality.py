"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every whole text: good, bad or no
opinion. Spark counts the vote patterns (at most 3 ** labellers, whatever the
input), and expectation-maximisation over those counts estimates how often each
labeller is right in each class and how common the classes are. The posterior
of a pattern is the label of its texts. A bounded sample of texts, drawn by a
hash of the row, then trains a linear scorer over hashed words and word shapes
on those soft labels, and the scorer judges every whole text. The ``labels``
table is never read; tests hold the result against it.

Cases: null text counts as empty; a text without words gets no votes, score 0
and is not kept; repeated rows agree; an empty table gives an empty result; if
all texts look alike to the labellers, the scorer follows their prior; other
columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import re
import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, prepare, session, utf8_list

HASH_BITS = 16
#: Texts that train the scorer, about; they alone pass through the driver, as counts of hashed features.
SAMPLE_ROWS = 4000
MEMORY_WORDS = 400_000
GOOD, BAD, NONE = 1, 2, 0

#: Byte classes: 0 other sign, 1 lower case or non-ASCII letter, 2 upper case, 3 digit, 4 white space, 5 end of sentence, 6 bar, 7 exclamation
KIND = np.zeros(256, np.uint8)
KIND[[*range(97, 123), *range(128, 256)]], KIND[range(65, 91)], KIND[range(48, 58)], KIND[[32, *range(9, 14)]] = 1, 2, 3, 4
KIND[[ord("."), ord("?")]], KIND[ord("|")], KIND[ord("!")] = 5, 6, 7
MARKED = re.compile(rb"[#$%&*@~^=_+]{2,}(?=\s|$)")


def _vote(value: float, good: float, bad: float) -> int:
    """Good at or below one bound, bad at or above the other."""
    return GOOD if value <= good else BAD if value >= bad else NONE


def measures(text: bytes) -> dict[str, float]:
    """What the labellers look at, as shares, of a text with at least one word."""
    words = text.split()
    n = len(words)
    kinds = np.bincount(KIND[np.frombuffer(text, np.uint8)], minlength=8).tolist()
    letters = max(1, kinds[1] + kinds[2])
    return {
        "words": n,
        "marked": len(MARKED.findall(text)) / n,
        "bars": kinds[6] / n,
        "upper": kinds[2] / letters,
        "shouts": kinds[7] / n,
        "repeats": sum(map(eq, words, words[1:])) / n,
        "same": 1 - len(set(words)) / n,
        "signs": (kinds[0] + kinds[6] + kinds[7]) / max(1, len(text) - kinds[4]),
        "ends": kinds[5] / n,
    }


#: Each labeller sees the measures and votes.
LABELLERS = {
    "marked words": lambda m: _vote(m["marked"], 0.02, 0.15),
    "bars": lambda m: _vote(m["bars"], 0.0, 0.1),
    "capitals": lambda m: NONE if m["words"] < 8 else _vote(m["upper"], 0.15, 0.4),
    "shouting": lambda m: _vote(m["shouts"], 0.02, 0.15),
    "word repeated at once": lambda m: _vote(m["repeats"], 0.04, 0.15),
    "few different words": lambda m: NONE if m["words"] < 20 else _vote(m["same"] - min(0.25, m["words"] / 4000), 0.5, 0.7),
    "signs among letters": lambda m: _vote(m["signs"], 0.04, 0.07),
    "sentence ends": lambda m: NONE if m["words"] < 20 else _vote(-m["ends"], -0.05, -0.02),
}


def vote_pattern(text: bytes) -> int:
    """The votes as digits to base 3; -1 for a text without words."""
    if not text.split(None, 1):
        return -1
    m, pattern = measures(text), 0
    for labeller in LABELLERS.values():
        pattern = pattern * 3 + labeller(m)
    return pattern


def estimate(counts: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """Posterior of good for each pattern, by expectation-maximisation over two classes with independent labellers."""
    patterns = np.array(sorted(counts), np.int64)
    if not len(patterns):
        return {}
    n = np.array([counts[p] for p in patterns.tolist()], float)
    k = len(LABELLERS)
    votes = np.stack([patterns // 3 ** (k - 1 - i) % 3 for i in range(k)], 1)
    # to begin with, one bad vote makes a text likely bad
    good = np.where((votes == BAD).any(1), 0.2, 0.95)
    for _ in range(rounds):
        prior = (n * good).sum() / n.sum()
        odds = np.full(len(n), np.log(prior + 1e-9) - np.log(1 - prior + 1e-9))
        for i in range(k):
            # a labeller without an opinion says nothing
            share = np.stack([np.bincount(votes[:, i], n * w, 3) + 0.5 for w in (good, 1 - good)])
            share[:, NONE] = share[:, [GOOD, BAD]].sum(1)
            share /= share[:, [NONE]]
            odds += np.log(share[0] / share[1])[votes[:, i]]
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(new - good).max() < 1e-7:
            break
        good = new
    return dict(zip(patterns.tolist(), good.tolist()))


class Features(dict):
    """Two hashed features of each word, packed: the word in lower case and its shape. At most ``MEMORY_WORDS`` words."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        shape = re.sub(rb"(.)\1+", rb"\1", re.sub(rb"[a-z\x80-\xff]", b"a", re.sub(rb"[A-Z]", b"A", re.sub(rb"[0-9]", b"0", word))))
        mask = (1 << HASH_BITS) - 1
        made = self[word] = np.array([zlib.crc32(word.lower()) & mask, zlib.crc32(b"\0" + shape) & mask], "<u4").tobytes()
        return made


FEATURES = Features()
AGAIN, AFTER = zlib.crc32(b"again") & ((1 << HASH_BITS) - 1), zlib.crc32(b"after") & ((1 << HASH_BITS) - 1)


def hashed(text: bytes) -> np.ndarray:
    """The features of all words of a text, and of each word whether it repeats the one before it."""
    words = text.split()
    again = sum(map(eq, words, words[1:]))
    own = np.frombuffer(b"".join(map(FEATURES.__getitem__, words)), "<u4")
    return np.concatenate([own, np.full(again, AGAIN, np.uint32), np.full(len(words) - again, AFTER, np.uint32)])


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 300, rate: float = 30.0, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression of soft labels on shares of hashed features; the last weight is the intercept."""
    weights = np.zeros((1 << HASH_BITS) + 1)
    if not len(rows):
        return weights
    at = np.concatenate([np.asarray(r[0], np.int64) for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    share = np.concatenate([np.asarray(r[1], float) / max(1, sum(r[1])) * 3 for r in rows])
    speed = np.full(len(weights), 1e-3)
    for _ in range(rounds):
        z = np.bincount(owner, weights[at] * share, len(rows)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(rows)
        slope = np.append(np.bincount(at, error[owner] * share, len(weights) - 1), error.sum()) + decay * weights
        speed += slope**2
        weights -= rate / 30 * slope / np.sqrt(speed)
    return weights


class Scorer:
    def __init__(self, weights: np.ndarray, posterior: dict[int, float]):
        self.weights, self.posterior = weights.astype(np.float32), posterior

    def score(self, text: bytes) -> float:
        found = hashed(text)
        if not len(found):
            return 0.0
        z = float(self.weights[found].sum(dtype=np.float64)) * 3 / len(found) + float(self.weights[-1])
        return 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))


def count_patterns(docs: DataFrame, text: str = "text") -> DataFrame:
    """pattern, n over all texts."""
    rows = docs.select(text)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([vote_pattern(t) for t in utf8_list(b.column(0))], pa.int64())], ["pattern"])

    return rows.mapInArrow(run, "pattern long").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def train(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """Labellers' accuracies from all texts; the scorer's weights from about ``sample_rows`` of them."""
    prepare(session(docs))
    counts = {r["pattern"]: r["n"] for r in count_patterns(docs, text).collect()}  # at most 3 ** labellers + 1 rows
    total = sum(counts.values())
    counts.pop(-1, None)
    posterior = estimate(counts)
    share = min(1.0, sample_rows / max(1, total))
    drawn = docs.select(F.col(text).alias("text"), F.xxhash64(F.lit(7), text).alias("h")).where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches):
        for b in batches:
            out = []
            for t in utf8_list(b.column(0)):
                at, n = np.unique(hashed(t), return_counts=True)
                out.append((vote_pattern(t), at, n))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1].astype(np.int32) for o in out], pa.list_(pa.int32())), pa.array([o[2].astype(np.int32) for o in out], pa.list_(pa.int32()))], ["pattern", "at", "n"])

    # copies of one text are drawn together, so the sample takes each text once
    sample = drawn.select("text").distinct().mapInArrow(run, "pattern long, at array<int>, n array<int>").where("pattern >= 0")
    rows = sample.orderBy(F.xxhash64("at")).limit(2 * sample_rows).toArrow()  # numbers, at most a feature table's width for each row
    parts = [zip(*(np.split(c.values.to_numpy(), c.offsets.to_numpy()[1:-1]) for c in (b.column(1), b.column(2)))) for b in rows.to_batches() if b.num_rows]
    labels = np.array([posterior[x] for x in rows.column("pattern").to_pylist()])
    return Scorer(fit_scorer([x for part in parts for x in part], labels), posterior)


def judge(docs: DataFrame, scorer: Scorer, keep: tuple = ("doc_id",), text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``keep``, posterior (of the votes), score (of the scorer) and kept, for every whole text."""
    spark = prepare(session(docs))
    rows = docs.select(*keep, F.col(text).alias("__text"))
    shared = spark.sparkContext.broadcast(scorer)  # 2 ** HASH_BITS weights and at most 3 ** labellers posteriors
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        s = shared.value
        for b in batches:
            texts = utf8_list(b.column(b.num_columns - 1))
            posterior = [s.posterior.get(vote_pattern(t), 0.0) for t in texts]
            score = [s.score(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(posterior, pa.float64()), pa.array(score, pa.float64()), pa.array([x >= threshold for x in score], pa.bool_())], [*b.schema.names[:-1], "posterior", "score", "kept"])

    return rows.mapInArrow(run, f"{schema}, posterior double, score double, kept boolean")


def op1_quality(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge(docs, train(docs))
