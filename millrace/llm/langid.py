"""Language identification with interpolated Kneser-Ney character models.

Texts are lower-cased; everything but letters becomes a blank, and blanks are
joined. Four UTF-16 units pack into one 64-bit number, so the hash of a
character sequence is exact and its suffix and context are bit operations; a
letter beyond U+FFFF counts as its two units.
Spark counts the sequences of all training texts. From those counts each
language's model follows; it is stored in sorted arrays, one per language and
order, looked up by binary search. A text goes to the language with the lowest
cross-entropy per character.

Rejection and score are calibrated on texts that the judging model has not
learned (``calibrate``): learning rows are dealt into ``FOLDS`` folds by their
text, so equal texts share one, and each fold is judged with the counts of the
other folds. A language's limit is the median of the entropies of its own texts,
so judged, plus one deviation of their characters and ``SPREAD`` standard
errors; medians, so that wrong labels do not move it. The score is a softmax
over all of a text's characters, times the one of ``RATES`` under which the
learning rows' own languages are most likely: characters are not independent.
``keep_cross_fitted`` judges the learning rows themselves in the same way.

Distinct sequences (not their occurrences) are counted first. Up to
``MAX_ENTRIES`` of them the model is held by the driver and broadcast
(``Model``); beyond, the same model is built by joins of counted sequences
(``Tables``), each chunk of texts asks once for the distinct sequences it has,
parts of the sorted model answer, and the texts are judged by the answers. Both
hold all counts, read texts with the same code and give the same results.

Cases: text that is null or has no letter gives ``und`` with score 0 and is
rejected; a text none of whose letters was learned is rejected; ties go to the first language by name; rows are independent, so
repeated rows agree; without any training text all is ``und`` and only texts
without a letter are rejected; a null doc_id is not held out and not learned
from; other columns are ignored; a language with texts in one fold only has no
other text to vouch for them, so the remaining languages judge them.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from .common import documents, materialise, prepare, session

ORDER = 4
MAX_ENTRIES = 4_000_000
SPREAD = 6.0
FOLDS = 4
#: What a text's characters may count for in its score.
RATES = tuple(2.0**-k for k in range(9))
UNKNOWN = "und"


HAS_LETTER = regex.compile(r"\p{L}")


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters; half of a surrogate pair is none by itself."""
    found = np.zeros(0x110000, bool)
    for m in regex.finditer(r"\p{L}+", "".join(" " if 0xD800 <= c < 0xE000 else chr(c) for c in range(0x110000))):
        found[m.start() : m.end()] = True
    return found


def sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed sequences of ORDER units, one for each kept unit, and the index of the text of each."""
    gap = "\0" * (ORDER - 1)
    joined = "".join(gap + (t.replace("\0", " ") if "\0" in t else t) for t in texts).lower()
    units = np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), "<u2")
    border = units == 0
    is_letter = letters()[units]
    high = np.flatnonzero(units >> 10 == 0b110110)  # first halves of code points beyond U+FFFF
    if len(high):
        point = 0x10000 + ((units[high].astype(np.int64) & 1023) << 10) + (units[high + 1] & 1023)
        is_letter[high] = is_letter[high + 1] = letters()[point]
    blank = ~is_letter
    keep = border | is_letter
    keep[1:] |= blank[1:] & ~blank[:-1]
    units, border = np.where(blank, 32, units)[keep].astype(np.uint64), border[keep]
    where = (np.cumsum(border) - 1) // (ORDER - 1)  # each text stands behind ORDER - 1 border marks
    packed = np.zeros(len(units), np.uint64)
    for back in range(ORDER):
        packed[back:] |= units[: len(units) - back] << np.uint64(16 * back)
    return packed[~border], where[~border]


def fold_of(text: str = "text"):
    """The fold of a row; equal texts have the same."""
    return (F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")) % FOLDS).cast("int")


def count_sequences(docs: DataFrame, text: str = "text", lang: str = "lang", fold=None) -> DataFrame:
    """fold (0 unless a column is given), lang, seq (packed), n over all rows of ``docs`` that have a text and a language."""
    prepare(session(docs))
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), (F.lit(0) if fold is None else fold).alias("fold"))
    rows = rows.where("lang is not null and text is not null")

    def run(batches):
        held: dict[tuple, list] = {}
        size = 0

        def merged():
            for name, parts in held.items():
                seq, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                yield name, seq, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def out():
            for (name, fold), seq, n in merged():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([fold] * len(seq), pa.int32()), pa.array([name] * len(seq), pa.string()), pa.array(seq.view(np.int64)), pa.array(n)],
                    ["fold", "lang", "seq", "n"],
                )

        for batch in batches:
            names = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()))
            texts = batch.column(1).to_pylist()
            for name in set(names):
                seq, _ = sequences([t for t, o in zip(texts, names) if o == name])
                seq, n = np.unique(seq, return_counts=True)
                held.setdefault(name, []).append((seq, n))
                size += len(seq)
            if size > 2_000_000:
                held = {name: [(seq, n)] for name, seq, n in merged()}
                size = sum(len(p[0][0]) for p in held.values())
                if size > 1_000_000:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    return rows.mapInArrow(run, "fold int, lang string, seq long, n long").groupBy("fold", "lang", "seq").agg(F.sum("n").alias("n"))


def sorted_lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each wanted key in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Judge:
    """What judges texts: langs, mean and deviation of their own text, and the units learned. ``log_probabilities`` is a subclass's."""

    langs: list[str]
    mean: np.ndarray
    deviation: np.ndarray
    units: np.ndarray

    def log_probabilities(self, packed: np.ndarray) -> np.ndarray:
        """One row for each sequence, one column for each language."""
        raise NotImplementedError

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Per text: cross-entropy per unit and variance of its units' for each language, units, and whether a letter of it was learned."""
        packed, where = sequences(texts)
        chars = np.bincount(where, minlength=len(texts))
        h, variance = np.zeros((2, len(texts), len(self.langs)))
        seen = np.zeros(len(texts), bool)
        full = np.flatnonzero(chars)
        if len(full):
            starts, n = np.searchsorted(where, full), chars[full][:, None]
            logp = self.log_probabilities(packed)
            h[full] = -np.add.reduceat(logp, starts, axis=0, dtype=np.float64) / n
            variance[full] = np.maximum(np.add.reduceat(logp * logp, starts, axis=0, dtype=np.float64) / n - h[full] ** 2, 0)
            learned = np.zeros(65536, bool)
            learned[self.units] = True
            learned[32] = False
            seen[full] = np.logical_or.reduceat(learned[packed & np.uint64(65535)], starts)
        return h, variance, chars, seen

    def judge(self, texts: list[str], shown: Shown | None = None) -> list[tuple[str, float, float, bool]]:
        """Per text: language, score, cross-entropy per unit, rejected."""
        found = found_in(lambda _: self, [0] * len(texts), [None] * len(texts), texts, (shown or Shown()).rate)
        return [(f["lang"] or UNKNOWN, f["score"], f["h"] or 0.0, rejected_by(f, (shown or Shown()).limits)) for f in found]


#: How far a sequence's bits are spread to find its slot in a model's front.
SPREAD_BITS = np.uint64(0x9E3779B97F4A7C15)


class Model(Judge):
    """Log-probabilities in sorted arrays, for each language those of its own sequences and contexts."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        mask = [np.uint64((1 << 16 * n) - 1) for n in range(ORDER + 1)]
        self.units = np.unique(np.concatenate([counts[x][0] & mask[1] for x in self.langs])) if counts else np.zeros(0, np.uint64)
        self.floor = 1 / (len(self.units) + 1)  # the uniform model, for any character
        self.tables, self.mean, self.deviation = [], np.zeros(len(counts)), np.ones(len(counts))
        self.every = None
        for i, name in enumerate(self.langs):
            # counts by order: occurrences at the top; below, how many different characters stand before the sequence
            by_order = {ORDER: counts[name]}
            for n in range(ORDER - 1, 0, -1):
                by_order[n] = np.unique(by_order[n + 1][0] & mask[n], return_counts=True)
            table, below = {}, np.array([self.floor])
            for n in range(1, ORDER + 1):
                seq, c = by_order[n]
                once, twice = (c == 1).sum(), (c == 2).sum()
                d = min(0.95, max(0.05, once / (once + 2 * twice) if once else 0.5))
                contexts, own = np.unique(seq >> np.uint64(16), return_inverse=True)
                total, kinds = np.bincount(own, c, len(contexts)), np.bincount(own, minlength=len(contexts))
                back = d * kinds / np.maximum(total, 1)
                lower = below[0] if n == 1 else below[np.searchsorted(by_order[n - 1][0], seq & mask[n - 1])]
                p = (c - d) / total[own] + back[own] * lower
                table[n] = seq, np.log(p).astype(np.float32), contexts, np.log(back).astype(np.float32)
                below = p
            self.tables.append(table)
            seq, c = counts[name]
            if len(seq):
                h = -table[ORDER][1].astype(float)
                self.mean[i] = np.average(h, weights=c)
                self.deviation[i] = np.sqrt(np.average((h - self.mean[i]) ** 2, weights=c))

    def searched(self, every: np.ndarray) -> np.ndarray:
        """Log-probabilities of distinct sequences, by search in the arrays of each language and order."""
        out = np.zeros((len(every), len(self.langs)), np.float32)
        for i, table in enumerate(self.tables):
            rest = np.arange(len(every))
            for n in range(ORDER, 0, -1):
                if not len(rest):
                    break
                keys, logp, contexts, back = table[n]
                seq = every[rest] & np.uint64((1 << 16 * n) - 1)
                at, hit = sorted_lookup(keys, seq)
                out[rest[hit], i] += logp[at[hit]]
                rest, seq = rest[~hit], seq[~hit]
                at, known = sorted_lookup(contexts, seq >> np.uint64(16))
                out[rest[known], i] += back[at[known]]
            out[rest, i] += np.log(self.floor)
        return out

    def log_probabilities(self, packed: np.ndarray) -> np.ndarray:
        if self.every is None:
            # each worker has all learned sequences with the values of all languages, and slots that lead to most of them at once
            self.every = np.unique(np.concatenate([t[ORDER][0] for t in self.tables] + [np.zeros(1, np.uint64)]))
            self.values = self.searched(self.every)
            self.shift = np.uint64(64 - min(22, (8 * len(self.every)).bit_length()))
            self.front = np.zeros(1 << int(64 - self.shift), np.int32)
            self.front[(self.every * SPREAD_BITS) >> self.shift] = np.arange(len(self.every))
        at = self.front[(packed * SPREAD_BITS) >> self.shift]
        out = self.values[at]
        missed = np.flatnonzero(self.every[at] != packed)
        if len(missed):
            new, back = np.unique(packed[missed], return_inverse=True)
            at, hit = sorted_lookup(self.every, new)
            values = self.values[at]
            values[~hit] = self.searched(new[~hit])
            out[missed] = values[back]
        return out


class Answers(Judge):
    """The part of a model that a chunk of texts asked for."""

    def __init__(self, langs, mean, deviation, units, key, values):
        self.langs, self.mean, self.deviation, self.units, self.key, self.values = langs, mean, deviation, units, key, values

    def log_probabilities(self, packed: np.ndarray) -> np.ndarray:
        return self.values[np.searchsorted(self.key, packed)]


class Shown:
    """What texts that were not learned show: by language the middle of their entropies and the deviation of their characters', and the rate of the score."""

    def __init__(self, limits: dict[str, tuple[float, float]] | None = None, rate: float = 1.0):
        self.limits, self.rate = limits or {}, rate


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model in memory from all rows of ``docs`` that have a text and a language."""
    return Model(by_language(count_sequences(docs, text, lang).toPandas()))


def by_language(table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    counts = {}
    for name, part in table.groupby("lang"):
        seq, n = part["seq"].to_numpy(np.int64).view(np.uint64), part["n"].to_numpy(np.float64)
        order = np.argsort(seq)
        counts[name] = (seq[order], n[order])
    return counts


class Tables:
    """The models of ``Model`` as tables in the shared folder. The driver has one row per fold and language.

    counted: fold (whose texts the model judges), lang, seq, n.
    """

    def __init__(self, counted: DataFrame):
        by_order = {ORDER: counted.select("fold", "lang", "seq", F.col("n").alias("c"))}
        for n in range(ORDER - 1, 0, -1):
            kinds = by_order[n + 1].groupBy("fold", "lang", self.ending(n).alias("seq")).agg(F.count(F.lit(1)).alias("c"))
            by_order[n] = materialise(kinds, f"langid-counts-{n}")
        self.floor = materialise(by_order[1].groupBy("fold").agg((1 / (F.countDistinct("seq") + 1)).alias("floor")), "langid-floor")
        self.keys, self.contexts, p = {}, {}, None
        name = ["fold", "lang"]
        for n in range(1, ORDER + 1):
            once, twice = (F.sum((F.col("c") == k).cast("long")) for k in (1, 2))
            share = F.when(once > 0, once / (once + 2 * twice)).otherwise(0.5)
            discounts = by_order[n].groupBy(*name).agg(F.least(F.lit(0.95), F.greatest(F.lit(0.05), share)).alias("d"))
            own = by_order[n].groupBy(*name, self.context(n).alias("context")).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
            own = materialise(own.join(F.broadcast(discounts), name).withColumn("back", F.col("d") * F.col("kinds") / F.col("total")), f"langid-contexts-{n}")
            rows = by_order[n].withColumn("context", self.context(n)).join(own if n > 1 else F.broadcast(own), [*name, "context"])
            if n == 1:
                rows = rows.join(F.broadcast(self.floor), "fold").withColumnRenamed("floor", "below")
            else:
                rows = rows.withColumn("end", self.ending(n - 1)).join(p.select(*name, F.col("seq").alias("end"), F.col("p").alias("below")), [*name, "end"])
            p = materialise(rows.select(*name, "seq", "c", ((F.col("c") - F.col("d")) / F.col("total") + F.col("back") * F.col("below")).alias("p")), f"langid-p-{n}")
            self.keys[n] = self.by_name(p, "seq", "p", f"langid-keys-{n}")
            self.contexts[n] = self.by_name(own, "context", "back", f"langid-backoff-{n}")
        h = -F.log("p")
        mean = F.sum(F.col("c") * h) / F.sum("c")
        spread = F.sqrt(F.greatest(F.sum(F.col("c") * h * h) / F.sum("c") - mean * mean, F.lit(0.0)))
        self.shown = materialise(p.groupBy(*name).agg(mean.alias("mean"), spread.alias("deviation")), "langid-shown")
        self.folds: dict[str, list] = {}
        for r in self.shown.select("lang", "fold").orderBy("lang", "fold").collect():
            self.folds.setdefault(r["lang"], []).append(r["fold"])
        self.langs = list(self.folds)
        self.units: dict[int, np.ndarray] = {}  # at most 65,536 of each fold
        for r in by_order[1].groupBy("fold").agg(F.collect_set("seq").alias("seq")).collect():
            self.units[r["fold"]] = np.array(r["seq"], np.int64)

    @staticmethod
    def ending(n: int):
        return F.col("seq") if n == ORDER else F.col("seq").bitwiseAND(F.lit((1 << 16 * n) - 1))

    @classmethod
    def context(cls, n: int):
        return F.shiftrightunsigned(cls.ending(n), 16)

    @staticmethod
    def by_name(table: DataFrame, key: str, value: str, name: str) -> DataFrame:
        """Per fold and key the logarithms by language."""
        values = F.map_from_entries(F.collect_list(F.struct("lang", F.log(value).alias("v"))))
        return materialise(table.groupBy("fold", key).agg(values.alias("v")), name)

    def log_probabilities(self, wanted: DataFrame) -> DataFrame:
        """wanted: distinct fold, seq. Adds v, an array in the order of ``langs``."""
        for n in range(1, ORDER + 1):
            for key, place, table, to in (("seq", self.ending(n), self.keys[n], f"p{n}"), ("context", self.context(n), self.contexts[n], f"b{n}")):
                table = table.select("fold", F.col(key).alias("at"), F.col("v").alias(to))
                wanted = wanted.withColumn("at", place).join(F.broadcast(table) if n == 1 else table, ["fold", "at"], "left").drop("at")
        wanted = wanted.join(F.broadcast(self.floor), "fold", "left")

        def value(lang):
            v = F.log("floor")
            for n in range(1, ORDER + 1):
                v = F.coalesce(F.try_element_at(F.col(f"p{n}"), F.lit(lang)), F.coalesce(F.try_element_at(F.col(f"b{n}"), F.lit(lang)), F.lit(0.0)) + v)
            return v

        return wanted.select("fold", "seq", F.array(*map(value, self.langs)).alias("v"))

    def judged(self, rows: DataFrame, rate: float) -> DataFrame:
        """``judged_rows`` by tables: chunks of rows ask for the sequences they have."""
        rows = materialise(rows.withColumn("chunk", F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)), "langid-rows")  # chunks must not change
        parts = int(session(rows).conf.get("spark.sql.shuffle.partitions"))

        def ask(batches):
            held: dict[tuple, list] = {}

            def out():
                for (chunk, fold), each in held.items():
                    seq = np.unique(np.concatenate(each))
                    part = part_of(seq, parts)
                    order = np.argsort(part, kind="stable")
                    for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in ([int(part[own[0]])], [fold], [chunk])] + [pa.array([seq[own].tobytes()], pa.binary())], ["part", "fold", "chunk", "keys"])

            now = None
            for b in batches:
                chunk, fold, texts = (c.to_pylist() for c in b.columns)
                for key in sorted(set(zip(chunk, fold))):
                    if key[0] != now:
                        yield from out()
                        held, now = {}, key[0]
                    seq, _ = sequences([t or "" for c, f, t in zip(chunk, fold, texts) if (c, f) == key])
                    if len(seq):
                        held.setdefault(key, []).append(np.unique(seq))
            yield from out()

        def differ(batches):
            held: dict[int, list] = {}
            for b in batches:
                for fold, keys in zip(*(c.to_pylist() for c in b.columns)):
                    held.setdefault(fold, []).append(np.frombuffer(keys, np.uint64))
                    if sum(map(len, held[fold])) > 2_000_000:
                        held[fold] = [np.unique(np.concatenate(held[fold]))]
            for fold, each in held.items():
                seq = np.unique(np.concatenate(each)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seq), fold, np.int64)), pa.array(seq)], ["fold", "seq"])

        sent = materialise(rows.select("chunk", "fold", "text").mapInArrow(ask, "part long, fold long, chunk long, keys binary"), "langid-asked")
        # parts meet in one task or another, so what they ask for is made distinct once more
        wanted = sent.repartition("part").select("fold", "keys").mapInArrow(differ, "fold long, seq long").distinct()
        known = materialise(self.log_probabilities(wanted.select(F.col("fold").cast("int").alias("fold"), "seq")), "langid-scored")
        width = len(self.langs)

        def answer(batches):
            now, tables, held = None, {}, {}
            for b in batches:
                part, fold, asks = (b.column(i).to_numpy() for i in range(3))
                cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(asks) != 0) | (np.diff(fold) != 0)) + 1
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)]):
                    if lo == hi:
                        continue
                    if part[lo] != now:
                        now, tables, held = part[lo], {}, {}
                    rows, f = b.slice(lo, hi - lo), int(fold[lo])
                    if not asks[lo]:
                        held.setdefault(f, []).append((rows.column(3).to_numpy().view(np.uint64), rows.column(4).flatten().to_numpy().reshape(-1, width)))
                        continue
                    if f not in tables:
                        key, value = (np.concatenate(x) for x in zip(*held.pop(f)))
                        order = np.argsort(key)
                        tables[f] = key[order], value[order].astype(np.float32)
                    key, value = tables[f]
                    for chunk, keys in zip(rows.column(5).to_pylist(), rows.column(6).to_pylist()):
                        found = value[np.searchsorted(key, np.frombuffer(keys, np.uint64))]
                        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([f], pa.int32()), pa.array([keys], pa.binary()), pa.array([found.tobytes()], pa.binary())], ["chunk", "fold", "keys", "answers"])

        none = lambda kind: F.lit(None).cast(kind)
        table = known.select(part_of_column("seq", parts).alias("part"), F.col("fold").cast("long").alias("fold"), F.lit(0).alias("asks"), "seq", "v", none("long").alias("chunk"), none("binary").alias("keys"))
        asked = sent.select("part", "fold", F.lit(1).alias("asks"), none("long").alias("seq"), none("array<double>").alias("v"), "chunk", "keys")
        answers = table.unionByName(asked).repartition("part").sortWithinPartitions("part", "asks", "fold").mapInArrow(answer, "chunk long, fold int, keys binary, answers binary")

        every, of_fold, shown, units = self.langs, self.folds, {(r["fold"], r["lang"]): (r["mean"], r["deviation"]) for r in self.shown.collect()}, self.units
        row_type = rows.schema["row"].dataType

        def finish(batches):
            now, held, judges = None, {}, {}

            def judge(fold):
                if fold not in judges:
                    langs = [x for x in every if fold in of_fold[x]]
                    key, value = (np.concatenate(x) for x in zip(*held[fold])) if fold in held else (np.zeros(0, np.uint64), np.zeros((0, width), np.float32))
                    order = np.argsort(key, kind="stable")
                    mean, deviation = np.array([shown[fold, x] for x in langs]).reshape(-1, 2).T
                    judges[fold] = Answers(langs, mean, deviation, units.get(fold, np.zeros(0, np.int64)), key[order], value[order][:, [every.index(x) for x in langs]])
                return judges[fold]

            for b in batches:
                chunk, asks = b.column(0).to_numpy(), b.column(1).to_numpy()
                cuts = np.flatnonzero((np.diff(chunk) != 0) | (np.diff(asks) != 0)) + 1
                for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(chunk)]):
                    if lo == hi:
                        continue
                    if chunk[lo] != now:
                        now, held, judges = chunk[lo], {}, {}
                    rows = b.slice(lo, hi - lo)
                    fold = rows.column(2).to_pylist()
                    if not asks[lo]:
                        for f, keys, values in zip(fold, *(rows.column(i).to_pylist() for i in (3, 4))):
                            held.setdefault(f, []).append((np.frombuffer(keys, np.uint64), np.frombuffer(values, np.float32).reshape(-1, width)))
                        continue
                    found = found_in(judge, fold, *(rows.column(i).to_pylist() for i in (6, 7)), rate)
                    yield pa.RecordBatch.from_arrays([rows.column(5), pa.array(found, FOUND)], ["row", "found"])

        told = answers.select("chunk", F.lit(0).alias("asks"), "fold", "keys", "answers", none(row_type).alias("row"), none("string").alias("given"), none("string").alias("text"))
        judged = rows.select("chunk", F.lit(1).alias("asks"), "fold", none("binary").alias("keys"), none("binary").alias("answers"), "row", "given", "text")
        met = told.unionByName(judged).repartition("chunk").sortWithinPartitions("chunk", "asks")
        return met.mapInArrow(finish, judged_schema(rows))


#: Rows of a chunk that asks together, as a power of two.
CHUNK_BITS = 12


def part_of(seq: np.ndarray, parts: int) -> np.ndarray:
    return ((seq ^ seq >> np.uint64(21) ^ seq >> np.uint64(42)) & np.uint64(0x7FFFFFFF)) % np.uint64(parts)


def part_of_column(seq: str, parts: int):
    """``part_of`` of a column."""
    x = F.col(seq).bitwiseXOR(F.shiftrightunsigned(seq, 21)).bitwiseXOR(F.shiftrightunsigned(seq, 42))
    return x.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")) % F.lit(parts).cast("long")


def counted(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Written: fold, lang, seq, n over all learning texts. One count serves the whole model and those of the folds."""
    return materialise(count_sequences(docs, text, lang, fold_of(text)), "langid-counts")


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", max_entries: int = MAX_ENTRIES) -> Model | Tables:
    """The model of all counts: in memory up to ``max_entries`` of them, else as tables."""
    return whole_model(counted(docs, text, lang), max_entries)


def whole_model(counts: DataFrame, max_entries: int = MAX_ENTRIES) -> Model | Tables:
    every = materialise(counts.groupBy("lang", "seq").agg(F.sum("n").alias("n")).select(F.lit(0).alias("fold"), "lang", "seq", "n"), "langid-all")
    return Model(by_language(every.toPandas())) if every.count() <= max_entries else Tables(every)


def fold_models(counts: DataFrame, max_entries: int = MAX_ENTRIES) -> list[Model] | Tables:
    """For each fold a model from the rows of the other folds; together in memory up to ``max_entries`` counts, else as tables."""
    if counts.count() > max_entries // FOLDS:
        own = F.map_from_entries(F.collect_list(F.struct("fold", "n")))
        every = counts.groupBy("lang", "seq").agg(F.sum("n").alias("all"), own.alias("own")).withColumn("fold", F.explode(F.array(*map(F.lit, range(FOLDS)))))
        every = every.select("fold", "lang", "seq", (F.col("all") - F.coalesce(F.try_element_at("own", F.col("fold")), F.lit(0))).alias("n"))
        return Tables(materialise(every.where("n > 0"), "langid-others"))
    return [Model(counts) for counts in other_counts(counts)]


def other_counts(counted: DataFrame):
    """For each fold the counts of the other folds by language. Only numbers are held, and one fold's counts at a time."""
    table = counted.toArrow()
    names = table["lang"].combine_chunks().dictionary_encode()
    code, fold = names.indices.to_numpy(), table["fold"].to_numpy()
    seq, n = table["seq"].to_numpy().view(np.uint64), table["n"].to_numpy().astype(np.float64)
    del table
    order = np.lexsort((seq, code))
    code, fold, seq, n = code[order], fold[order], seq[order], n[order]
    for k in range(FOLDS):
        counts = {}
        for i, name in enumerate(names.dictionary.to_pylist()):
            at = np.flatnonzero((code == i) & (fold != k))
            if len(at):
                starts = np.flatnonzero(np.concatenate([[True], seq[at][1:] != seq[at][:-1]]))
                counts[name] = seq[at][starts], np.add.reduceat(n[at], starts)
        yield counts


#: What judging a text finds: language (``UNKNOWN`` without a model, null without a letter), its entropy, the units, whether a letter was learned;
#: what the model's own text shows; the row's own language, the text's entropy and variance of units by it, its log-probability by rate; the score.
FOUND = pa.struct(
    [("lang", pa.string()), ("h", pa.float64()), ("chars", pa.int64()), ("seen", pa.bool_()), ("mean", pa.float64()), ("deviation", pa.float64()), ("given", pa.string())]
    + [("own", pa.float64()), ("variance", pa.float64()), ("likely", pa.list_(pa.float64())), ("score", pa.float64())]
)
FOUND_TYPE = "struct<lang: string, h: double, chars: long, seen: boolean, mean: double, deviation: double, given: string, own: double, variance: double, likely: array<double>, score: double>"


def judged_schema(rows: DataFrame) -> StructType:
    return StructType().add("row", rows.schema["row"].dataType).add("found", DataType.fromDDL(FOUND_TYPE))


def likely_of(h: np.ndarray, own: int, chars: int) -> list[float]:
    """The log-probability of language ``own`` under each rate."""
    z = (h[own] - h)[None, :] * (chars * np.array(RATES))[:, None]
    return (-np.log(np.exp(np.minimum(z, 600.0)).sum(1))).tolist()


def found_in(judge, fold: list, given: list, texts: list, rate: float = 1.0) -> list[dict]:
    """What each text's judge finds; ``judge`` gives the one of a fold."""
    texts = [t or "" for t in texts]
    out = [dict.fromkeys((f.name for f in FOUND)) | {"given": g, "score": 0.0} for g in given]
    for k in set(fold):
        by, at = judge(k), [i for i, f in enumerate(fold) if f == k and HAS_LETTER.search(texts[i])]
        if not by.langs:
            for i in at:
                out[i]["lang"] = UNKNOWN
            continue
        h, variance, chars, seen = by.entropies([texts[i] for i in at])
        place = {x: j for j, x in enumerate(by.langs)}
        for r, i in enumerate(at):
            j, own = int(h[r].argmin()), place.get(given[i])
            score = 1 / np.exp((h[r, j] - h[r]) * chars[r] * rate).sum()
            out[i] |= {"lang": by.langs[j], "h": float(h[r, j]), "chars": int(chars[r]), "seen": bool(seen[r]), "mean": float(by.mean[j]), "deviation": float(by.deviation[j]), "score": float(score)}
            if own is not None:
                out[i] |= {"own": float(h[r, own]), "variance": float(variance[r, own]), "likely": likely_of(h[r], own, int(chars[r]))}
    return out


def rejected_by(found: dict, limits: dict) -> bool:
    """Without a letter, or judged and above the limit of its language, or without a learned letter."""
    if found["lang"] is None or found["h"] is None:
        return found["lang"] is None
    middle, wide = limits.get(found["lang"], (found["mean"], found["deviation"]))
    return not found["seen"] or found["h"] > middle + wide * (1 + SPREAD / max(1, found["chars"]) ** 0.5)


def judged_rows(rows: DataFrame, models: list[Model] | Tables, rate: float = 1.0) -> DataFrame:
    """rows: row (a struct of what to carry), given (a language or null), fold, text. row and found (``FOUND``), each text judged by the model of its fold."""
    if isinstance(models, Tables):
        return models.judged(rows, rate)
    shared = session(rows).sparkContext.broadcast(models)  # at most MAX_ENTRIES sequences and their endings

    def run(batches):
        for b in batches:
            given, fold, texts = (b.column(i).to_pylist() for i in (1, 2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found_in(shared.value.__getitem__, fold, given, texts, rate), FOUND)], ["row", "found"])

    return rows.select("row", "given", "fold", "text").mapInArrow(run, judged_schema(rows))


def carried(docs: DataFrame, columns, fold, text: str, lang: str | None) -> DataFrame:
    """What ``judged_rows`` takes; columns of any name lie within ``row``."""
    given = F.lit(None).cast("string") if lang is None else F.col(f"`{lang}`").cast("string")
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("row"), given.alias("given"), fold.alias("fold"), F.col(f"`{text}`").alias("text"))


def identify(docs: DataFrame, model: Model | Tables, keep: tuple = ("doc_id",), text: str = "text", shown: Shown | None = None) -> DataFrame:
    """``keep``, lang_pred, score, entropy and rejected for every whole text. Without ``shown`` the model's own text sets the limits."""
    spark, shown = prepare(session(docs)), shown or Shown()
    found = judged_rows(carried(docs, keep, F.lit(0), text, None), model if isinstance(model, Tables) else [model], shown.rate)
    limits = spark.createDataFrame([(k, *v) for k, v in shown.limits.items()], "limited string, middle double, wide double")  # one row per language
    return within(found, limits).select(
        *[F.col("row")[c].alias(c) for c in keep], F.coalesce("found.lang", F.lit(UNKNOWN)).alias("lang_pred"), F.col("found.score").alias("score"),
        F.coalesce("found.h", F.lit(0.0)).alias("entropy"), (~F.col("accepted")).alias("rejected"),
    )


def within(judged: DataFrame, limits: DataFrame) -> DataFrame:
    """``judged`` with accepted: the text has a letter, a learned one, and is within its language's limit; without a model any letter does."""
    met = judged.join(F.broadcast(limits), F.col("found.lang") == F.col("limited"), "left")
    limit = F.coalesce("middle", "found.mean") + F.coalesce("wide", "found.deviation") * (1 + SPREAD / F.sqrt(F.greatest("found.chars", F.lit(1))))
    near = F.coalesce(F.col("found.seen") & (F.col("found.h") <= limit), F.lit(True))
    return met.select("row", "found", (F.col("found.lang").isNotNull() & near).alias("accepted"))


def keep_identified(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text some language accepts, all columns unchanged."""
    spark = prepare(session(docs))
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches):
        for b in batches:
            found = shared.value.judge([t or "" for t in b.column(at).to_pylist()])
            yield b.filter(pa.array([not x[3] for x in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def limits_of(judged: DataFrame) -> DataFrame:
    """limited (a language), middle and wide, from what ``judged`` rows show of their own languages."""
    own = judged.where("found.own is not null").groupBy(F.col("found.given").alias("limited"))
    return own.agg(F.percentile_approx("found.own", 0.5, 10000).alias("middle"), F.sqrt(F.percentile_approx("found.variance", 0.5, 10000)).alias("wide"))


def calibrate(docs: DataFrame, text: str = "text", lang: str = "lang", max_entries: int = MAX_ENTRIES, counts: DataFrame | None = None) -> Shown:
    """Limits and rate from all learning rows, each judged by the other folds; ``counts`` from ``counted``, if there are."""
    prepare(session(docs))
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    models = fold_models(counted(docs, text, lang) if counts is None else counts, max_entries)
    judged = materialise(judged_rows(carried(rows, [lang], fold_of(text), text, lang), models).select("found"), "langid-shown")
    limits = {r["limited"]: (r["middle"], r["wide"]) for r in limits_of(judged).collect()}  # one row per language
    likely = judged.agg(*(F.sum(F.col("found.likely")[i]) for i in range(len(RATES)))).first()
    return Shown(limits, 1.0 if likely[0] is None else RATES[int(np.argmax(likely))])


def keep_cross_fitted(docs: DataFrame, text: str = "text", lang: str = "lang", max_entries: int = MAX_ENTRIES) -> DataFrame:
    """The rows of ``docs`` whose text some language accepts by what the other folds teach, all columns unchanged."""
    prepare(session(docs))
    judged = judged_rows(carried(docs, docs.columns, fold_of(text), text, lang), fold_models(counted(docs, text, lang), max_entries))
    judged = materialise(judged.withColumn("found", F.col("found").dropFields("likely", "score")), "langid-judged")
    return within(judged, limits_of(judged)).where("accepted").select("row.*")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out() & F.col("doc_id").isNotNull())


def op2_language_id(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = learning_rows(docs)
    counts = counted(rows)
    found = identify(docs, whole_model(counts), shown=calibrate(rows, counts=counts))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "entropy", "rejected")
