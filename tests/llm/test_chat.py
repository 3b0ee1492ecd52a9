import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat as C
from millrace.llm.common import BATCH_BYTES

SCHEMA = "conv long, pos long, line string"


@pytest.fixture(scope="module")
def lines(spark, docs):
    return C.transcripts(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))


@pytest.fixture(scope="module")
def model(lines):
    return C.learn(lines.where(F.crc32(F.col("conv").cast("string").cast("binary")) % 3 != 1))


def test_roles_of_transcripts_it_did_not_learn_from(lines, model):
    found = C.decode(lines.select("conv", "pos", "line"), model)
    truth = lines.where(F.crc32(F.col("conv").cast("string").cast("binary")) % 3 == 1).select("conv", "pos", F.col("role").alias("r"), F.col("first").alias("f"))
    got = found.join(truth, ["conv", "pos"]).collect()
    assert len(got) > 100 and np.mean([r.role == r.r and r["first"] == r.f for r in got]) > 0.97


def test_counts_equal_a_plain_count(lines, model):
    rows = sorted(lines.where(F.crc32(F.col("conv").cast("string").cast("binary")) % 3 != 1).collect(), key=lambda r: (r.conv, r.pos, r.line))
    index = {s: i for i, s in enumerate(C.STATES)}
    start, step, marker = np.zeros(6), np.zeros((6, 6)), np.zeros((6, C.MARKERS))
    size, ending = np.zeros((6, C.SIZES)), np.zeros((6, C.ENDINGS))
    before = None
    for r in rows:
        s, (m, z, e) = index[r.role, r["first"]], C.line_features(r.line)
        marker[s, m] += 1
        size[s, z] += 1
        ending[s, e] += 1
        if before and before[0] == r.conv:
            step[before[1], s] += 1
        else:
            start[s] += 1
        before = (r.conv, s)
    want = C.Speakers(start, step, marker, size, ending)
    assert np.array_equal(want.step, model.step) and np.array_equal(want.emit, model.emit)


def score(model, code, states):
    total, before = 0, C.START
    for c, s in zip(code, states):
        total += int(model.step[before, s]) + int(model.emit[c, s])
        before = s
    return total


def test_no_path_is_better(model):
    rng = np.random.default_rng(5)
    texts = ["User: hi", "### Bot: well.", "", "go on", "what?", "[a] yes:", "System: x", "**Agent:** ok"]
    code = [C.codes([texts[k] for k in rng.integers(0, len(texts), n)]) for n in (1, 2, 3, 4, 5, 5)]
    many = C.decode_many(model, np.concatenate(code), np.array([len(c) for c in code]))
    at = 0
    for c in code:
        best = max(score(model, c, p) for p in itertools.product(range(C.START), repeat=len(c)))
        one = C.path(C.line_matrices(model, c), C.START, -1)
        assert score(model, c, many[at : at + len(c)].tolist()) == best == score(model, c, one.tolist())
        assert C.product(C.line_matrices(model, c))[C.START, : C.START].max() == best
        at += len(c)


@pytest.mark.parametrize("size, fan", [(3, 2), (1, 3), (4096, 64)])
def test_blocks_give_paths_as_good_as_one_pass(lines, model, monkeypatch, size, fan):
    monkeypatch.setattr(C, "BLOCK_LINES", size)
    monkeypatch.setattr(C, "FAN", fan)
    monkeypatch.setattr(C, "AT_ONCE", 40)
    found = C.decode(lines.select("conv", "pos", "line"), model)
    index = {s: i for i, s in enumerate(C.STATES)}
    n = 0
    for _, g in found.toPandas().sort_values(["part", "seq"]).groupby("conv"):
        code = C.codes(list(g["line"]))
        assert score(model, code, [index[x] for x in zip(g["role"], g["first"])]) == score(model, code, C.path(C.line_matrices(model, code), C.START, -1).tolist())
        n += len(g)
    assert n == lines.count()


def plain_turns(lines):
    """Turns of decoded lines, one after the other."""
    out = []
    for _, r in lines.sort_values(["part", "seq"]).iterrows():
        conv = None if r["conv"] != r["conv"] else r["conv"]
        if r["first"] or not out or out[-1][0] != conv:
            text = C.MARKER.sub("", r["line"], count=1) if r["first"] and C.MARKER.match(r["line"]) else r["line"]
            out.append([conv, r["role"], 1, text])
        else:
            out[-1][2] += 1
            out[-1][3] += "\n" + r["line"]
    return sorted(map(str, out))


@pytest.mark.parametrize("size", [2, 4096])
def test_turns_across_blocks(lines, model, monkeypatch, size):
    monkeypatch.setattr(C, "BLOCK_LINES", size)
    found = C.decode(lines.select("conv", "pos", "line"), model)
    got = C.turns(found).collect()
    assert sorted(str([r.conv, r.role, r.n_lines, r.text]) for r in got) == plain_turns(found.toPandas())


def test_canonical_form(spark, model):
    talk = [(1, 0, "User: Hi."), (1, 1, "How are you?"), (1, 2, "Assistant: Well."), (1, 3, None), (2, None, "System: be brief"), (2, 5, "User: ok")]
    df = spark.createDataFrame([(*t, 1, 2) for t in talk], SCHEMA + ", role int, turn int")
    got = C.turns(C.decode(df, model)).withColumn("out", C.rendered()).orderBy("conv", "turn").collect()
    assert got[0].out == "<|user|>\nHi.\nHow are you?\n<|end|>\n"
    assert "".join(r.text for r in got).count("User:") == 0 and sum(r.n_lines for r in got) == len(talk)


def test_null_conversations_are_one(spark, model):
    talk = [(0, "User: How does this work, and why?"), (1, "Assistant: It works like that."), (3, "and there is more."), (2, "Then so.")]
    rows = [(None, *t) for t in talk] + [(7, *t) for t in talk] + [(3, 0, "User: c")]
    got = [(r.conv, r.turn, r.role, r.n_lines, r.text) for r in C.turns(C.decode(spark.createDataFrame(rows, SCHEMA), model)).collect()]
    assert sum(r[3] for r in got) == 9 and {r[0] for r in got} == {None, 3, 7}
    assert sorted(r[1:] for r in got if r[0] is None) == sorted(r[1:] for r in got if r[0] == 7)


def test_repeated_turns_follow_each_other(spark, model):
    rows = [(1, 0, "user", "a1\na2"), (1, 0, "assistant", "b1\nb2"), (1, None, "user", "c1"), (2, 1, "user", "d1\nd2"), (2, 1, "user", "d1\nd2"), (None, 0, None, None)]
    found = C.transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = [r.line.split()[-1] if r.line else "" for r in found.orderBy("conv", "pos").collect()]
    assert got[0] == "" and got[-4:] == ["d1", "d2", "d1", "d2"]
    text = "".join(got)
    assert "a1a2" in text and "b1b2" in text
    assert C.decode(found.select("conv", "pos", "line"), model).count() == len(got)


def test_a_text_of_very_many_lines(spark, model):
    df = spark.createDataFrame([(1, 0, "user", "x\n" * 9000 + "end"), (1, 1, "assistant", "y\nz")], "conv_id long, turn long, role string, text string")
    found = C.decode(C.transcripts(df).select("conv", "pos", "line"), model)
    assert found.count() == 9003 and found.select("part", "block").distinct().count() > 2
    assert [r.line for r in found.orderBy("part", "seq").collect()][-3:] == ["end", "### Bot: y", "z"] or found.orderBy(F.desc("part"), F.desc("seq")).first().line == "z"


def test_empty_and_repeated(spark, model, lines):
    assert C.turns(C.decode(spark.createDataFrame([], SCHEMA), model)).count() == 0
    twice = spark.createDataFrame([(1, 0, "User: a"), (1, 0, "User: a")], SCHEMA)
    assert C.decode(twice, model).count() == 2
    assert C.learn(lines.where("false")).step.shape == (C.START + 1, C.START + 1)


def test_long_lines_close_blocks_by_their_bytes(spark, lines, model, monkeypatch):
    """50 MB of lines of 100 kB: batches, blocks and what a task decodes at once hold a few MB."""
    long = spark.range(500).select((F.col("id") % 3).alias("conv"), F.col("id").alias("pos"), F.concat(F.lit("User: "), F.repeat(F.lit("long line "), 10_000), F.lit("?")).alias("line"))
    found = C.decode(long, model)
    blocks = found.groupBy("part", "block").agg(F.sum(F.octet_length("line")).alias("n"), F.countDistinct("conv").alias("convs")).collect()
    assert sum(r.n for r in blocks) > 50e6 and max(r.n for r in blocks) <= C.BLOCK_BYTES + 100_100 and {r.convs for r in blocks} == {1}

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    assert max(r.n for r in long.mapInArrow(sizes, "n long").collect()) < 2 * BATCH_BYTES
    # the same paths as without the bound
    want = sorted(map(str, C.turns(C.decode(lines.select("conv", "pos", "line"), model)).collect()))
    monkeypatch.setattr(C, "BLOCK_BYTES", 300)
    monkeypatch.setattr(C, "BYTES_AT_ONCE", 1000)
    small = C.decode(lines.select("conv", "pos", "line"), model)
    assert small.select("part", "block").distinct().count() > 536
    assert len(want) == len(got := sorted(map(str, C.turns(small).collect()))) and sum(a != b for a, b in zip(got, want)) < 0.02 * len(want)  # ties may go either way
