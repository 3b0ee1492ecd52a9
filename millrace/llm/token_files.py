"""Token-id files of directly addressable codes.

A file is cut into segments of whole documents. A segment splits each id into
8-bit chunks, lowest first. Level 0 holds the first chunk of every id; a bitmap
says which ids go on, and level 1 holds the next chunk of those only, and so
on. For each bitmap a rank directory holds the number of set bits before every
512-bit block, so id i is found by one rank per level, without decoding what
lies around it (``Segment.get``); whole segments decode with numpy.

The container is Parquet, written and read by Spark, so files may lie in any
store it reaches. Documents lie in ascending doc_id order over all files:
rows are range-partitioned and sorted, each task numbers its segments, and a
manifest with one row per task gives the number of ids before it.

Cases: null text counts as empty and holds the end id alone; null ids come
first; rows that repeat an id are ordered by a hash of their text; an empty
table gives files without segments; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import codec, vocabulary_path
from .common import documents, new_path, prepare, session, utf8_list

END_ID = 1
#: A segment ends with the document that brings it to so many ids.
SEGMENT_IDS = 1 << 16
BLOCK_BITS = 512

LEVEL = "struct<chunks: binary, more: binary, ranks: binary>"
LEVEL_ARROW = pa.list_(pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())]))


def split_levels(ids: np.ndarray) -> list[dict]:
    """The levels of a list of ids: chunks, continuation bitmap (lowest bit first) and rank directory (uint32)."""
    levels, rest = [], np.asarray(ids, np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        counts = np.bitwise_count(np.pad(bits, (0, -len(bits) % (BLOCK_BITS // 8))).reshape(-1, BLOCK_BITS // 8)).sum(1)
        ranks = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else counts
        levels.append({"chunks": (rest & 255).astype(np.uint8).tobytes(), "more": bits.tobytes(), "ranks": ranks.astype("<u4").tobytes()})
        if not more.any():
            return levels
        rest = rest[more] >> 8


class Segment:
    """Reads one segment's levels."""

    def __init__(self, levels: list[dict]):
        self.levels = [(np.frombuffer(x["chunks"], np.uint8), np.frombuffer(x["more"], np.uint8), np.frombuffer(x["ranks"], "<u4")) for x in levels]

    def get(self, i: int) -> int:
        """Id i, by a rank at each level."""
        value = 0
        for depth, (chunks, more, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * depth
            if not more[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK_BITS
            first = block * BLOCK_BITS // 8
            below = int(np.bitwise_count(more[first : i >> 3]).sum()) + int(more[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            i = int(ranks[block]) + below
        return value

    def all(self) -> np.ndarray:
        """All ids."""
        value = self.levels[0][0].astype(np.uint32)
        at = np.arange(len(value))
        for depth, (chunks, more, _) in enumerate(self.levels):
            if depth:
                value[at] |= chunks.astype(np.uint32) << 8 * depth
            at = at[np.unpackbits(more, count=len(chunks), bitorder="little").view(bool)]
        return value


def write_tokens(docs: DataFrame, to: str, path: str | None = None, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Write the token files of ``docs`` to ``to``: segments/ and manifest/."""
    spark = prepare(session(docs))
    path = path or vocabulary_path()
    # rows of one id, or of none, may lie in several parts too
    keys = "doc_id", F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange(*keys).sortWithinPartitions(*keys)
    kind = ordered.schema["doc_id"].dataType.simpleString()

    def run(batches):
        c, part, before = codec(path, library=True), TaskContext.get().partitionId(), 0
        end = np.array([end_id], c.kind)
        held_ids, held_docs, ends, n, id_type = [], [], [], 0, None

        def segment():
            levels = split_levels(np.concatenate(held_ids))
            values = [[part], [before], [n], [held_docs], [ends], [levels]]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), LEVEL_ARROW]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], ["part", "before", "n", "doc_ids", "ends", "levels"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), utf8_list(batch.column(1))):
                ids = c.encode(text)
                held_ids += [ids, end]
                n += len(ids) + 1
                held_docs.append(doc)
                ends.append(n)
                if n >= segment_ids:
                    yield segment()
                    before += n
                    held_ids, held_docs, ends, n = [], [], [], 0
        if n:
            yield segment()

    schema = f"part int, before long, n long, doc_ids array<{kind}>, ends array<long>, levels array<{LEVEL}>"
    ordered.mapInArrow(run, schema).write.parquet(f"{to}/segments")
    parts = spark.read.parquet(f"{to}/segments").groupBy("part").agg(F.sum("n").alias("n"))
    # one row per task of the writer
    start = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts.select("part", start.alias("start")).write.parquet(f"{to}/manifest")


def segments(spark: SparkSession, at: str) -> DataFrame:
    """The segments of written files with ``start``, the number of ids before each over all files."""
    manifest = spark.read.parquet(f"{at}/manifest")  # one row per task of the writer
    held = spark.read.parquet(f"{at}/segments").join(manifest, "part")
    return held.select((F.col("start") + F.col("before")).alias("start"), "n", "doc_ids", "ends", "levels")


def read_documents(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, ids (array<int>) of every document in written files."""
    held = segments(spark, at).select("start", "doc_ids", "ends", "levels")
    kind = held.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for start, docs, ends, levels in zip(*(c.to_pylist() for c in batch.columns)):
                ids = Segment(levels).all()
                bounds = np.concatenate([[0], ends]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, batch.schema.field(1).type.value_type), pa.array(start + bounds[:-1].astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.view(np.int32)))],
                    ["doc_id", "start", "ids"],
                )

    return held.mapInArrow(run, f"doc_id {kind}, start long, ids array<int>")


def document_checks(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers) from written files."""
    held = segments(spark, at).select("start", "doc_ids", "ends", "levels")
    kind = held.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for start, docs, ends, levels in zip(*(c.to_pylist() for c in batch.columns)):
                raw = memoryview(Segment(levels).all().astype("<u4").tobytes())
                bounds = [0, *ends]
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:])]
                bounds = np.array(bounds, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, batch.schema.field(1).type.value_type), pa.array(start + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return held.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def tokens_at(spark: SparkSession, at: str, positions: DataFrame, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """positions: pos (long, over all files). pos, id; positions outside the files give no row."""
    held = segments(spark, at)
    blocks = F.explode(F.sequence(F.expr(f"start div {segment_ids}"), F.expr(f"(start + n - 1) div {segment_ids}")))
    asked = positions.select("pos", F.expr(f"pos div {segment_ids}").alias("block"))
    spans = held.select("start", "n", blocks.alias("block"))
    placed = asked.join(spans, "block").where("pos >= start and pos < start + n")
    # each segment meets all that is asked of it, at most its ids, once
    wanted = placed.groupBy("start", "pos").agg(F.count(F.lit(1)).alias("times")).groupBy("start").agg(F.collect_list(F.struct("pos", "times")).alias("wanted"))
    met = wanted.join(held.select("start", "levels"), "start").select("start", "wanted", "levels")

    def run(batches):
        for batch in batches:
            for start, wanted, levels in zip(*(c.to_pylist() for c in batch.columns)):
                segment = Segment(levels)
                found = [(w["pos"], segment.get(w["pos"] - start), w["times"]) for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["pos", "id", "times"])

    found = met.mapInArrow(run, "pos long, id long, times long")
    return found.select(F.explode(F.array_repeat("pos", F.col("times").cast("int"))).alias("pos"), "id")


def op7_token_files(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir)
    to = new_path(spark, "token-files")
    write_tokens(docs, to)
    return document_checks(spark, to)
