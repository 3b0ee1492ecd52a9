"""Exact deduplication by an extendible-hash index on shared files. DataFrame functions only.

Keys are 64-bit hashes of normalised texts. A bucket is a range of keys, given
by a prefix of their bits. The directory starts with one bucket and doubles: a
bucket with more than ``capacity`` different keys is split by its next bit until
all fit. Every row finds its bucket in the directory. Within a bucket and key
the texts themselves are compared, copies being combined map-side first, so a
group with a third of all rows costs one row per task. Owner tasks, one for each
range of buckets, chain the texts that share a key and write the index. A row is
answered by the bucket that the directory names, the key's chain there, and the
link of the chain that holds its text.

The directory is small whatever the input: beyond ``capacity << DIRECTORY_BITS``
keys, buckets grow instead. Groups with more than a ``HOT_SHARE``-th of all rows
(so fewer than ``HOT_SHARE`` of them) are held by every task when rows look up
their chains; no other key has more rows than that.

Cases: null text counts as empty; all texts without a visible character form
one group; a null doc_id ranks after every other id; of rows that repeat an id
within a group exactly one is kept; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, documents, join_hot, materialise

CAPACITY = 4096
DIRECTORY_BITS = 16
HOT_SHARE = 1000


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), ASCII_SPACE, "")


def keyed(docs: DataFrame, hash_bits: int = 64, carry: Column | None = None) -> DataFrame:
    """Write and reread row (a number of its own), doc_id, cp (code points of the original), sha, h (its key of ``hash_bits`` leading bits) and norm, or instead of it what is carried."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).alias("cp"),
        normalised().alias("norm"),
        *(() if carry is None else (carry.alias("carried"),)),
    )
    h = F.xxhash64("norm")
    h = h if hash_bits == 64 else F.shiftleft(F.shiftright(h, 64 - hash_bits), 64 - hash_bits)
    rows = rows.withColumns({"h": h, "sha": F.sha2("norm", 256)})
    return materialise(rows if carry is None else rows.drop("norm"), "dedup-rows")


def cell_of(h: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.col(h), 64 - bits)


def directory(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cell, bits (of all cells), bucket (its lowest key) and depth (the bits it uses), for the cells of all keys there are.

    A cell is a prefix of ``bits`` bits, enough for the deepest bucket. Keys are
    hashes, so that is a few bits more than the average: about eight cells for a bucket.
    """
    keys = materialise(rows.select("h").distinct(), "dedup-keys")
    n = keys.count()
    capacity = max(capacity, n >> DIRECTORY_BITS)
    bits = (n // capacity).bit_length() + 2
    while True:
        cells = materialise(keys.groupBy(cell_of("h", bits).alias("cell")).agg(F.count(F.lit(1)).alias("n")), "dedup-cells")
        if bits >= 60 or not cells.where(F.col("n") > capacity).limit(1).count():
            break
        bits += 2
    # keys under each prefix; a bucket is a prefix that fits below one that does not
    prefix = F.expr(f"shiftright(cell, {bits} - depth)")
    held = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")).groupBy("depth", prefix.alias("prefix")).agg(F.sum("n").alias("held"))
    held = materialise(held, "dedup-prefixes")
    over = held.where(F.col("held") > capacity).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("half"))
    fits = (F.col("held") <= capacity) | (F.col("depth") == bits)
    leaves = held.where(fits).withColumn("half", F.expr("shiftright(prefix, 1)")).join(over, ["depth", "half"], "left_semi")
    leaves = leaves.unionByName(held.where((F.col("depth") == 0) & fits).withColumn("half", F.lit(0).cast("long"))).select("depth", "prefix")
    # shifts take their count modulo 64, and at depth 0 the prefix is 0
    bucket = F.expr("shiftleft(prefix, 64 - depth)")
    inside = F.explode(F.expr(f"sequence(shiftleft(prefix, {bits} - depth), shiftleft(prefix + 1, {bits} - depth) - 1)"))
    return materialise(leaves.select(inside.alias("cell"), F.lit(bits).alias("bits"), bucket.alias("bucket"), "depth"), "dedup-directory")


def place(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """``rows`` with the bucket and depth that the directory names for their key."""
    # about 8 << DIRECTORY_BITS cells at most; ``bits`` is the same in all, and read from the directory
    cells = F.broadcast(cells)
    bits = cells.select("bits").first()
    return rows.withColumn("cell", cell_of("h", bits["bits"] if bits else 1)).join(cells.drop("bits"), "cell").drop("cell")


def build_index(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Write and reread the index: bucket, depth, h and chain (array<struct<sha, keep_row, keep_id, n>>), in files of key ranges."""
    # the longest original wins, then the smallest id; a fixed-width rank keeps the aggregation in its hash map
    unit = F.lit(str(2**65)).cast("decimal(20,0)")
    rank = F.col("cp").cast("decimal(10,0)") * unit - F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(2**63)).cast("decimal(20,0)"))
    norm = F.col("norm") if "norm" in rows.columns else normalised("carried.text").alias("norm")
    compared = place(rows.select("row", "doc_id", "cp", norm, "h"), cells).groupBy("bucket", "depth", "h", "norm")
    entries = compared.agg(F.max_by("row", rank).alias("keep_row"), F.max_by("doc_id", rank).alias("keep_id"), F.count(F.lit(1)).alias("n"))
    links = entries.select("bucket", "depth", "h", F.struct(F.sha2("norm", 256).alias("sha"), "keep_row", "keep_id", "n").alias("link"))
    # a chain holds the different texts that share one 64-bit key
    owned = links.repartitionByRange("bucket", "h").groupBy("bucket", "h").agg(F.first("depth").alias("depth"), F.array_sort(F.collect_list("link")).alias("chain"))
    return materialise(owned.sortWithinPartitions("bucket", "h"), "dedup-index")


def look_up(rows: DataFrame, cells: DataFrame, index: DataFrame) -> DataFrame:
    """row, doc_id, sha and link: the entry of each row, by directory, bucket, key and chain."""
    total = index.agg(F.sum(F.aggregate("chain", F.lit(0).cast("long"), lambda s, x: s + x["n"]))).first()[0] or 0
    placed = place(rows.select("row", "doc_id", "sha", "h"), cells)
    met = join_hot(placed, index, ["bucket", "h"], "chain", F.exists("chain", lambda x: x["n"] * HOT_SHARE > total))
    link = F.filter("chain", lambda x: x["sha"] == F.col("sha"))
    return met.select("row", "doc_id", "sha", F.get(link, F.lit(0)).alias("link"))


def exact_groups(docs: DataFrame, hash_bits: int = 64, capacity: int = CAPACITY) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = keyed(docs, hash_bits)
    cells = directory(rows, capacity)
    found = look_up(rows, cells, build_index(rows, cells))
    return found.select(
        "doc_id", F.col("link.keep_id").alias("keep_id"), F.col("link.n").alias("group_size"), (F.col("row") == F.col("link.keep_row")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def keep_one(docs: DataFrame, hash_bits: int = 64, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    rows = keyed(docs, hash_bits, F.struct(*[docs[f"`{c}`"] for c in docs.columns]))
    index = build_index(rows, directory(rows, capacity))
    kept = index.select(F.explode("chain").alias("link")).select(F.col("link.keep_row").alias("row"))
    return rows.select("row", "carried").join(kept, "row", "left_semi").select("carried.*")


def op8_exact_dedup(spark, sf_dir) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY cp DESC, doc_id ASC NULLS LAST) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
