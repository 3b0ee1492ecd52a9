"""Transcript parsing: a hidden Markov model recovers who speaks, then turns are rendered in one form.

A transcript is a set of lines: conv (its key), pos (their order, of any type
that Spark sorts) and line. States are the roles, each as the first line of a
turn or a later one. A line shows three features: the marker word in front of
it, if any, hashed; how long it is; and how it ends. Probabilities are counted
from labelled transcripts by Spark and smoothed; their table has a fixed size.

Lines are range-partitioned and sorted, so a task holds a run of transcripts.
Those that lie within the run are decoded many at once, a line of each at a
time. The first and the last one of a task, and any of over ``BLOCK_LINES``
lines or ``BLOCK_BYTES`` bytes, are cut into blocks. Viterbi's recursion is a product of matrices over
(max, +): each block gives one matrix, and blocks of blocks are multiplied in
turn (``FAN`` at a time) until one matrix is left. Back down, each block gets
its first and last state and decodes its own lines. Scores are whole numbers, so
the path is as good as that of one pass over the whole transcript, and no task
holds a transcript.

Canonical form of a turn: ``<|role|>``, newline, its lines without the marker,
newline, ``<|end|>``, newline.

Cases: a null line counts as empty; lines with a null pos come first; lines with
equal pos are ordered by their text; lines with a null conv are one transcript;
a transcript of one line is one turn; between paths of equal probability any may
be taken; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, prepare, session

ROLES = ("system", "user", "assistant")
STATES = [(r, first) for r in ROLES for first in (True, False)]
#: The state before the first line, numbered after the others; scores are log-probabilities times SCALE, and that of what cannot be.
START, SCALE, NEVER = len(STATES), 1 << 24, -(1 << 60)
MARKERS, SIZES, ENDINGS = 256, 8, 5
#: Lines in one block, blocks in one block of blocks, and lines that a task decodes at once.
BLOCK_LINES, FAN, AT_ONCE = 4096, 64, 50_000
#: Bytes that close a block, and that a task decodes at once, however few the lines; a single line is never cut.
BLOCK_BYTES, BYTES_AT_ONCE = 4 << 20, 16 << 20

#: A word, perhaps in brackets or after signs of a heading, before a colon, closing bracket or angle.
MARKER = re.compile(r"\s*[#*<\[(]{0,4}\s*([A-Za-z]{1,12})\s*(?:[:>\])]|\*\*){1,3}\s*", re.ASCII)


def line_features(line: str) -> tuple[int, int, int]:
    """marker (0 for none, 1 for an empty line), size and ending."""
    if not line.strip():
        return 1, 0, 0
    found = MARKER.match(line)
    marker = 2 + zlib.crc32(found[1].lower().encode()) % (MARKERS - 2) if found else 0
    return marker, min(SIZES - 1, 1 + len(line).bit_length() // 2), 1 + min(ENDINGS - 2, ".?:".find(line.rstrip()[-1]) % 4)


def codes(lines: list[str]) -> np.ndarray:
    """The features of each line as one number."""
    found = np.array([line_features(x) for x in lines], np.int32).reshape(-1, 3)
    return (found[:, 0] * SIZES + found[:, 1]) * ENDINGS + found[:, 2]


class Speakers:
    """Scores of first states, transitions and features."""

    def __init__(self, start, step, marker, size, ending):
        smooth = lambda counts, by: np.log((counts + by) / (counts + by).sum(-1, keepdims=True))
        whole = lambda x: np.round(x * SCALE).astype(np.int64)
        self.step = np.full((START + 1, START + 1), NEVER)
        self.step[START, :START] = whole(smooth(np.asarray(start, float), 0.1))
        self.step[:START, :START] = whole(smooth(np.asarray(step, float), 0.1))
        marker, size, ending = (smooth(np.asarray(x, float), 0.05).T for x in (marker, size, ending))
        emit = (marker[:, None, None] + size[None, :, None] + ending[None, None]).reshape(-1, START)
        self.emit = np.pad(whole(emit), ((0, 0), (0, 1)))  # by code


def product(mats: np.ndarray) -> np.ndarray:
    """The product of matrices over (max, +), halving their number each time."""
    while len(mats) > 1:
        even = len(mats) // 2 * 2
        both = (mats[0:even:2, :, :, None] + mats[1:even:2, None, :, :]).max(2)
        mats = np.concatenate([np.maximum(both, NEVER), mats[even:]])
    return mats[0]


def path(mats: np.ndarray, before: int, last: int) -> np.ndarray:
    """The best state after each matrix, from the state before to a given last one (below 0: the best)."""
    best, back = np.where(np.arange(START + 1) == before, 0, NEVER), []
    for m in mats:
        scores = np.maximum(best[:, None] + m, NEVER)
        back.append(scores.argmax(0))
        best = scores.max(0)
    at = int(best.argmax()) if last < 0 else last
    out = [at]
    for b in back[:0:-1]:
        out.append(int(b[out[-1]]))
    return np.array(out[::-1])


def line_matrices(model: Speakers, code: np.ndarray) -> np.ndarray:
    return np.maximum(model.step[None] + model.emit[code][:, None, :], NEVER)


def decode_many(model: Speakers, code: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The states of all lines of several whole transcripts, which lie one after the other."""
    order = np.argsort(-lengths, kind="stable")
    n = lengths[order]
    first = (np.cumsum(lengths) - lengths)[order]
    step, emit = model.step[:START, :START], model.emit[code][:, :START]
    back = np.zeros((len(code), START), np.int8)
    best = model.step[START, :START] + emit[first]
    for t in range(1, int(n.max(initial=0))):
        k = int(np.searchsorted(-n, -t))  # transcripts with a line t
        scores = best[:k, :, None] + step[None]
        back[first[:k] + t] = scores.argmax(1)
        best[:k] = scores.max(1) + emit[first[:k] + t]
    out = np.zeros(len(code), np.int32)
    state = best.argmax(1)
    for t in range(int(n.max(initial=0)) - 1, -1, -1):
        k = int(np.searchsorted(-n, -t))
        at = first[:k] + t
        out[at] = state[:k]
        state[:k] = back[at, state[:k]]
    return out


def in_order(lines: DataFrame, *more) -> DataFrame:
    """conv, pos, line and more, sorted over all tasks."""
    rows = lines.select("conv", "pos", F.coalesce("line", F.lit("")).alias("line"), *more)
    return rows.repartitionByRange("conv", "pos", "line").sortWithinPartitions("conv", "pos", "line")


def pieces(batches):
    """Slices of one transcript each, in order, and whether the transcript begins in this task with it."""
    last = None
    for b in batches:
        keys = b.column(0).to_pylist()
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, z in zip(cuts[:-1], cuts[1:]):
            if a < z:
                yield b.slice(a, z - a), last is None or last[0] != keys[a]
                last = (keys[a],)


def decode(lines: DataFrame, model: Speakers) -> DataFrame:
    """conv, pos, line, part and seq (the order of all lines), block (within its part), role and first (whether the line begins a turn) of every line."""
    spark = prepare(session(lines))
    rows = in_order(lines)
    conv, pos = (rows.schema[c].dataType.simpleString() for c in ("conv", "pos"))
    shared = spark.sparkContext.broadcast(model)  # a fixed number of scores

    def run(batches):
        m, part = shared.value, TaskContext.get().partitionId()
        block, seq, ready, ready_lines, ready_bytes = 0, 0, [], 0, 0
        held, n, size, begun, is_open = [], 0, 0, 0, True  # the transcript at hand

        def rows_of(slices, starts, blocks, states=None):
            table = pa.Table.from_batches(slices).combine_chunks()
            sizes = [s.num_rows for s in slices]
            number = np.concatenate([np.arange(a, a + k) for a, k in zip(starts, sizes)])
            code = codes(table.column("line").to_pylist())
            state = pa.nulls(len(code), pa.int32()) if states is None else pa.array(decode_many(m, code, states))
            columns = [table.column(i).combine_chunks() for i in range(3)]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.full(len(code), part, np.int64)), pa.array(np.repeat(blocks, sizes).astype(np.int64)), pa.array(number.astype(np.int64)), pa.array(code.astype(np.int32)), state],
                ["conv", "pos", "line", "part", "block", "seq", "code", "state"],
            )

        def decoded():
            slices = [s for held, _, _ in ready for s in held]
            sizes = [s.num_rows for s in slices]
            starts = np.concatenate([begun + np.concatenate([[0], np.cumsum([s.num_rows for s in held])[:-1]]) for held, begun, _ in ready]).astype(int)
            blocks = np.concatenate([np.full(len(held), b) for held, _, b in ready])
            return rows_of(slices, starts.tolist(), blocks, np.array([sum(s.num_rows for s in held) for held, _, _ in ready])) if sizes else None

        def open_block():
            sizes = [s.num_rows for s in held]
            starts = (begun + np.concatenate([[0], np.cumsum(sizes)[:-1]])).astype(int)
            return rows_of(held, starts.tolist(), np.full(len(held), block))

        nothing = True
        for piece, new in pieces(batches):
            if new and not nothing:
                if is_open:
                    yield open_block()
                else:
                    ready.append((held, begun, block))
                    ready_lines, ready_bytes = ready_lines + n, ready_bytes + size
                    if ready_lines >= AT_ONCE or ready_bytes >= BYTES_AT_ONCE:
                        yield decoded()
                        ready, ready_lines, ready_bytes = [], 0, 0
                block += 1
                held, n, size, begun, is_open = [], 0, 0, seq, False
            nothing = False
            weight = np.cumsum(pc.binary_length(piece.column(2)).to_numpy())
            done = 0
            while done < piece.num_rows:
                if n == BLOCK_LINES or size >= BLOCK_BYTES:
                    is_open = True
                    yield open_block()
                    block += 1
                    held, n, size, begun = [], 0, 0, seq
                before = int(weight[done - 1]) if done else 0
                # up to the line that fills the block
                took = min(piece.num_rows - done, BLOCK_LINES - n, 1 + int(np.searchsorted(weight[done:], before + BLOCK_BYTES - size)))
                held.append(piece.slice(done, took))
                n, seq, done = n + took, seq + took, done + took
                size += int(weight[done - 1]) - before
        if ready:
            yield decoded()
        if held:
            yield open_block()  # it may go on in the next task

    found = materialise(rows.mapInArrow(run, f"conv {conv}, pos {pos}, line string, part long, block long, seq long, code int, state int"), "chat-lines")
    states = settle(found.where("state is null").select("conv", "part", "block", "seq", "code"), shared)
    rest = found.where("state is null").drop("state").join(states, ["part", "seq"])
    every = found.where("state is not null").unionByName(rest)
    role = F.element_at(F.array(*(F.lit(r) for r, _ in STATES)), F.col("state") + 1)
    return every.select("conv", "pos", "line", "part", "block", "seq", role.alias("role"), (F.col("state") % 2 == 0).alias("first"))


def settle(lines: DataFrame, shared) -> DataFrame:
    """lines: conv, part, block, seq and code of transcripts cut into blocks. part, seq and state."""
    n = START + 1
    conv = lines.schema["conv"].dataType.simpleString()

    def multiply_lines(pdf: pd.DataFrame) -> pd.DataFrame:
        m = product(line_matrices(shared.value, pdf.sort_values("seq")["code"].to_numpy()))
        return pdf[["conv", "part", "block"]].head(1).assign(m=[m.ravel()])

    def multiply_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        m = product(np.stack(pdf.sort_values("b")["m"].to_list()).reshape(-1, n, n))
        return pd.DataFrame({"cid": pdf["cid"].iloc[:1], "b": pdf["over"].iloc[:1], "m": [m.ravel()]})

    # a task gives two blocks, or one for every BLOCK_LINES lines of its long transcripts
    mats = materialise(lines.groupBy("part", "block").applyInPandas(multiply_lines, f"conv {conv}, part long, block long, m array<long>"), "chat-blocks")
    of_conv = Window.partitionBy("conv").orderBy("part", "block")
    # a transcript is named by its first block, so null is a name like any other
    cid = F.first(F.concat_ws("-", "part", "block")).over(of_conv)
    blocks = materialise(mats.withColumn("cid", cid).withColumn("b", (F.row_number().over(of_conv) - 1).cast("long")).drop("conv"), "chat-level")

    # up: each level has a FAN-th of the blocks of the one below, until every transcript is one block
    levels = [blocks.select("cid", "b", "m")]
    while levels[-1].where("b > 0").limit(1).count():
        over = levels[-1].withColumn("over", F.floor(F.col("b") / FAN))
        levels.append(materialise(over.groupBy("cid", "over").applyInPandas(multiply_blocks, f"cid string, b long, m array<long>"), "chat-level"))

    # down: the state before each block and its last state, below 0 where the end is free
    def settle_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("b")
        mats = np.stack(pdf["m"].to_list()).reshape(-1, n, n)
        before, last = int(pdf["before"].iloc[0]), int(pdf["last"].iloc[0])
        states = path(mats, before, last)
        return pd.DataFrame({"cid": pdf["cid"], "b": pdf["b"], "before": np.append([before], states[:-1]).astype(np.int32), "last": states.astype(np.int32)})

    settled = levels[-1].select("cid", "b", F.lit(START).alias("before"), F.lit(-1).alias("last"))
    for level in reversed(levels[:-1]):
        over = level.withColumn("over", F.floor(F.col("b") / FAN))
        joined = over.join(settled.withColumnRenamed("b", "over"), ["cid", "over"])
        settled = materialise(joined.groupBy("cid", "over").applyInPandas(settle_blocks, f"cid string, b long, before int, last int"), "chat-states")

    def read_lines(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        states = path(line_matrices(shared.value, pdf["code"].to_numpy()), int(pdf["before"].iloc[0]), int(pdf["last"].iloc[0]))
        return pd.DataFrame({"part": pdf["part"], "seq": pdf["seq"], "state": states.astype(np.int32)})

    placed = blocks.select("cid", "b", "part", "block").join(settled, ["cid", "b"]).select("part", "block", "before", "last")
    ready = lines.drop("conv").join(placed, ["part", "block"])
    return ready.groupBy("part", "block").applyInPandas(read_lines, "part long, seq long, state int")


def turns(decoded: DataFrame) -> DataFrame:
    """conv, turn (pos of its first line), role, n_lines and text of every turn."""
    decoded = materialise(decoded.withColumn("at", F.struct("part", "seq")), "chat-decoded")
    begins = F.when(F.col("first"), F.col("at"))
    # where a block begins within a turn, the turn is the last one begun in an earlier block
    blocks = decoded.groupBy("conv", "part", "block").agg(F.max(begins).alias("latest"), F.min("at").alias("low"))
    earlier = Window.partitionBy("conv").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("part", "block", F.coalesce(F.max("latest").over(earlier), F.min("low").over(earlier), "low").alias("open"))
    within = Window.partitionBy("part", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = decoded.withColumn("begun", F.max(begins).over(within)).join(blocks, ["part", "block"])
    # a turn's lines are bounded by its own length
    gathered = placed.groupBy("conv", F.coalesce("begun", "open").alias("turn")).agg(F.array_sort(F.collect_list(F.struct("at", "pos", "line", "role", "first"))).alias("lines"))
    top = F.col("lines")[0]
    marked = F.when(top["first"], F.regexp_replace(top["line"], "^" + MARKER.pattern, "")).otherwise(top["line"])
    body = F.concat(F.array(marked), F.transform(F.slice("lines", 2, F.size("lines")), lambda x: x["line"]))
    return gathered.select("conv", top["pos"].alias("turn"), top["role"].alias("role"), F.size("lines").cast("long").alias("n_lines"), F.array_join(body, "\n").alias("text"))


def rendered():
    return F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n"))


def learn(lines: DataFrame) -> Speakers:
    """lines: conv, pos, line, role and first. Counts by state; lines of another role are left out."""
    prepare(session(lines))
    state = F.expr("case role " + " ".join(f"when '{r}' then {2 * i}" for i, r in enumerate(ROLES)) + " end") + F.when(F.col("first"), 0).otherwise(1)
    rows = in_order(lines.withColumn("s", state).where("s is not null"), "s")
    conv = rows.schema["conv"].dataType.simpleString()
    n = len(STATES)
    shapes = {"start": (1, n), "step": (n, n), "marker": (n, MARKERS), "size": (n, SIZES), "ending": (n, ENDINGS)}

    def run(batches):
        part, type_ = TaskContext.get().partitionId(), None
        seen = {k: np.zeros(v, np.int64) for k, v in shapes.items()}
        ends, last = [], -1  # the state of the line before
        for piece, new in pieces(batches):
            type_ = piece.column(0).type
            s, code = piece.column(3).to_numpy(), codes(piece.column(2).to_pylist())
            np.add.at(seen["marker"], (s, code // (SIZES * ENDINGS)), 1)
            np.add.at(seen["size"], (s, code // ENDINGS % SIZES), 1)
            np.add.at(seen["ending"], (s, code % ENDINGS), 1)
            np.add.at(seen["step"], (s[:-1], s[1:]), 1)
            if not ends:
                ends = [(piece.column(0)[0], int(s[0]))]
            elif new:
                seen["start"][0, s[0]] += 1
            else:
                seen["step"][last, s[0]] += 1
            last, ends[1:] = int(s[-1]), [(piece.column(0)[0], int(s[-1]))]
        if not ends:
            return
        found = [(k, int(i), int(j), int(x[i, j])) for k, x in seen.items() for i, j in zip(*np.nonzero(x))]
        found += [("ends", part, i, s) for i, (_, s) in enumerate(ends)]
        keys = pa.array([None] * (len(found) - 2) + [k.as_py() for k, _ in ends], type_)
        yield pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), pa.int64(), pa.int64(), pa.int64()))), keys], ["kind", "i", "j", "n", "conv"])

    found = materialise(rows.mapInArrow(run, f"kind string, i long, j long, n long, conv {conv}"), "chat-counts")
    counts = {k: np.zeros(v, np.int64) for k, v in shapes.items()}
    # as many rows as the tables have cells, and two for each task
    for r in found.where("kind <> 'ends'").groupBy("kind", "i", "j").agg(F.sum("n").alias("n")).collect():
        counts[r["kind"]][r["i"], r["j"]] += r["n"]
    ends = found.where("kind = 'ends'").orderBy("i", "j").collect()
    before = None
    for top, bottom in zip(ends[::2], ends[1::2]):
        if before is not None and before["conv"] == top["conv"]:
            counts["step"][before["n"], top["n"]] += 1
        else:
            counts["start"][0, top["n"]] += 1
        before = bottom
    return Speakers(counts["start"][0], counts["step"], counts["marker"], counts["size"], counts["ending"])


#: How transcripts name the speakers, by style; every fifth turn has no marker but an empty line before it.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "### Context: ", "user": "### Human: ", "assistant": "### Bot: "},
    {"system": "[note] ", "user": "[q] ", "assistant": "[a] "},
    {"system": "**Setup:** ", "user": "**Customer:** ", "assistant": "**Agent:** "},
)


def transcripts(conversations: DataFrame) -> DataFrame:
    """Raw lines of conversations (conv_id, turn, role, text): conv, pos (struct of turn, row and line), line, and the true role and first.

    A null turn counts as 0; rows that repeat a conversation and turn follow
    each other, each with all its lines.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    marker = F.coalesce(*(F.when((style == i) & (F.col("role") == r), F.lit(m)) for i, s in enumerate(STYLES) for r, m in s.items()), F.lit(""))
    bare = (F.col("turn") > 0) & (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0)
    text = F.when(bare, F.concat(F.lit("\n"), F.coalesce("text", F.lit("")))).otherwise(F.concat(marker, F.coalesce("text", F.lit(""))))
    numbered = conversations.select(F.struct(F.xxhash64("role", "text").alias("hash"), F.monotonically_increasing_id().alias("number")).alias("row"), F.col("conv_id").alias("conv"), F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), "role", F.split(text, "\n").alias("lines"))
    lines = numbered.select("conv", "turn", "row", "role", F.posexplode("lines").alias("i", "line"))
    return lines.select("conv", F.struct("turn", "row", "i").alias("pos"), "line", "role", (F.col("i") == 0).alias("first"))


def op10_chat(spark, sf_dir) -> DataFrame:
    """Every conversation as a raw transcript, parsed again: one row per recovered turn."""
    lines = transcripts(prepare(spark).read.parquet(f"{sf_dir}/conversations.parquet"))
    learned = F.crc32(F.col("conv").cast("string").cast("binary")) % 3 != 1
    model = learn(lines.where(learned))
    found = turns(decode(lines.select("conv", "pos", "line"), model))
    return found.select(F.col("conv").alias("conv_id"), F.col("turn.turn").alias("turn"), F.col("turn.i").cast("long").alias("line"), "role", "n_lines", F.sha2(rendered(), 256).alias("rendered_sha256"))
