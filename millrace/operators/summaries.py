"""Extractive summaries: sentences are scored by their words, and the best few are kept in their order.

Scores are quotients of whole numbers, so they do not depend on the order in
which Spark adds them up. Word rows never carry their sentence: a text without
stops is one sentence, however long.

Cases: a null or empty text has no sentences and gives no row; ties go to the
earlier sentence; rows that repeat an id with different texts are documents of
their own, rows that repeat id and text give one summary (``lead`` gives one
for each); null ids are documents like any other, and equal to each other in
``overlap``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences, words

TOP = 3
#: The most frequent words, whose rarities every task holds. Any other word has at most a HOT_WORDS-th of all word rows.
HOT_WORDS = 10_000


def keyed(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, th (tells texts of one id apart), keep and text, dealt by document: later grouping by document keeps that dealing."""
    return docs.select("doc_id", F.xxhash64("text").alias("th"), *keep, "text").repartition("doc_id", "th")


def best(scored: DataFrame, top: int = TOP) -> DataFrame:
    """scored: doc_id, th, sent_no, sentence, score. doc_id, n_sentences (kept), summary."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "th").orderBy(F.desc("score"), "sent_no"))
    kept = scored.withColumn("rank", rank).where(F.col("rank") <= top)
    gathered = kept.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("sent_no", "sentence"))).alias("s"))
    return gathered.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_join(F.transform("s", lambda x: x["sentence"]), " ").alias("summary"))


def by_word_frequency(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Per document the sentences whose words are the most frequent ones of that document, on average."""
    split = keyed(docs).select("doc_id", "th", F.posexplode(sentences("text")).alias("sent_no", "sentence"))
    # the sentence itself is one more row beside its words, without a word
    each = F.transform(words("sentence"), lambda w: F.struct(w.alias("word"), F.lit(None).cast("string").alias("sentence")))
    own = F.array(F.struct(F.lit(None).cast("string").alias("word"), F.col("sentence").alias("sentence")))
    rows = split.select("doc_id", "th", "sent_no", F.explode(F.concat(each, own)).alias("r")).select("doc_id", "th", "sent_no", "r.word", "r.sentence")
    counted = rows.groupBy("doc_id", "th", "sent_no", "word").agg(F.count("word").alias("n"), F.max("sentence").alias("sentence"))
    freq = F.sum("n").over(Window.partitionBy("doc_id", "th", "word"))
    scored = counted.withColumn("freq", freq).groupBy("doc_id", "th", "sent_no").agg(
        F.max("sentence").alias("sentence"), F.sum("n").alias("words"), (F.sum(F.col("n") * F.col("freq")) / F.nullif(F.sum("n"), F.lit(0))).alias("score")
    )
    return best(scored.where("words > 0"), top)


def rarities(docs: DataFrame) -> DataFrame:
    """word, df, idf: ln(documents / documents with the word) in thousandths."""
    df = docs.select(F.explode(F.array_distinct(words("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    total = docs.agg(F.count(F.lit(1)).alias("total"))  # one row
    return df.crossJoin(F.broadcast(total)).select("word", "df", F.round(F.log(F.col("total") / F.col("df")) * 1000).cast("long").alias("idf"))


def tfidf_scores(docs: DataFrame, *keep: str, hot_words: int = HOT_WORDS) -> DataFrame:
    """doc_id, th, keep, sent_no, score: the mean rarity of a sentence's words.

    The most frequent words meet their rarity in the task that reads the text
    and leave one sum per sentence; only the others are shuffled by word.
    """
    idf = rarities(docs)
    hot = F.broadcast(idf.orderBy(F.desc("df"), "word").limit(hot_words).select("word", F.col("idf").alias("near")))
    names = ["doc_id", "th", *keep, "sent_no"]
    split = keyed(docs, *keep).select("doc_id", "th", *keep, F.posexplode(sentences("text")).alias("sent_no", "sentence"))
    each = split.select(*names, F.explode(words("sentence")).alias("word")).join(hot, "word", "left")
    # a key that is no word spreads the sums and meets nothing
    key = F.when(F.col("near").isNull(), F.col("word")).otherwise(F.concat(F.lit("."), (F.xxhash64("doc_id", "th", "sent_no") % 100_000).cast("string")))
    counted = each.groupBy(*names, key.alias("word")).agg(F.count(F.lit(1)).alias("n"), F.sum("near").alias("near"))
    met = counted.join(idf.select("word", "idf"), "word", "left")
    total = F.sum(F.coalesce("near", F.col("n") * F.col("idf")))
    return met.groupBy(*names).agg((total / F.sum("n")).alias("score"))


def by_tfidf(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Per document the sentences with the rarest words over all documents, on average."""
    rank = F.row_number().over(Window.partitionBy("doc_id", "th").orderBy(F.desc("score"), "sent_no"))
    kept = tfidf_scores(docs).withColumn("rank", rank).where(F.col("rank") <= top)
    gathered = kept.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list("sent_no")).alias("s"))
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("tk"), "text")
    met = gathered.join(texts, gathered["doc_id"].eqNullSafe(texts["id"]) & (gathered["th"] == texts["tk"]))
    summary = met.withColumn("a", sentences("text")).select("doc_id", "th", F.size("s").cast("long").alias("n_sentences"), F.array_join(F.transform("s", lambda i: F.get("a", i)), " ").alias("summary"))
    return summary.dropDuplicates(["doc_id", "th"]).drop("th")


def by_group(docs: DataFrame, group: str, top: int = TOP, salts: int = 64) -> DataFrame:
    """Per group of documents its ``top`` sentences of highest mean rarity: first within salted parts, then over all."""
    scored = tfidf_scores(docs, group).withColumn("salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(salts)))
    order = (F.desc("score"), F.asc("doc_id"), F.asc("sent_no"), F.asc("th"))
    part = F.row_number().over(Window.partitionBy(group, "salt").orderBy(*order))
    few = scored.withColumn("rank", part).where(F.col("rank") <= top)
    whole = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    chosen = few.withColumn("rank", whole).where(F.col("rank") <= top).select(group, F.col("rank").cast("long").alias("rank"), "doc_id", "th", "sent_no")
    # one text may be chosen in several groups
    texts = docs.select(F.col(group).alias("g"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tk"), "text")
    met = chosen.join(texts, chosen["doc_id"].eqNullSafe(texts["id"]) & (chosen["th"] == texts["tk"]) & chosen[group].eqNullSafe(texts["g"]))
    found = met.select(group, "rank", "doc_id", F.col("sent_no").cast("long").alias("sent_no"), F.get(sentences("text"), F.col("sent_no")).alias("sentence"))
    return found.dropDuplicates([group, "rank"])


def lead(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Per document its first sentences that have a word."""
    split = docs.select("doc_id", F.filter(sentences("text"), lambda s: F.size(words(s)) > 0).alias("s")).where(F.size("s") > 0)
    kept = split.withColumn("s", F.slice("s", 1, top))
    return kept.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_join("s", " ").alias("summary"))


def overlap(one: DataFrame, two: DataFrame) -> DataFrame:
    """one, two: doc_id, summary. Shared words (each as often as both have it) over the words of each: precision and recall of ``one`` against ``two``."""

    def counted(df: DataFrame, n: str) -> DataFrame:
        return df.select("doc_id", F.explode(words("summary")).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias(n))

    # no join: both sides' counts meet by grouping, where null ids are equal
    both = counted(one, "a").withColumn("b", F.lit(0)).unionByName(counted(two, "b").withColumn("a", F.lit(0)))
    both = both.groupBy("doc_id", "word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    shared = F.sum(F.least("a", "b"))
    return both.groupBy("doc_id").agg((shared / F.nullif(F.sum("a"), F.lit(0))).alias("precision"), (shared / F.nullif(F.sum("b"), F.lit(0))).alias("recall"))


def conversations(turns: DataFrame) -> DataFrame:
    """Per conversation its first and last turn, how many turns and words it has; null texts have no words."""
    order = F.struct("turn", "role", "text")
    size = F.coalesce(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")), F.lit(0))
    # no window: one row per task and conversation goes through the shuffle
    return turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum(size).alias("n_words"), F.min_by("text", order).alias("opening"), F.max_by("text", order).alias("closing")
    )
