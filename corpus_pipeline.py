"""From raw documents to token ids: five stages, each written as Parquet and read back for the next.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of
documents, whatever they are; the last returns one row per document taken. What
a stage keeps in the shared folder goes once its result is written: ``run`` knows
when, and clears the stage's input too. Where stages are called one by one, what
one kept goes when the same thread calls the next one with documents that were
written since then; otherwise it stays.

Cases, in every stage: a null text counts as empty, and a null id, language or
source is a value like any other; an empty table gives an empty result; further
columns of any name are kept, unread.
"""

from __future__ import annotations

import threading
import time
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, exact_dedup, langid, mixing, simhash
from millrace.llm.common import discard, documents, is_noted, materialise, noted, prepare, written_at

#: By thread: the last stage called on its own, what it kept, and when it ended.
_last = threading.local()


def stage(work):
    """A stage of the pipeline. Called on its own, it first clears what the one before it left."""

    @wraps(work)
    def started(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        if is_noted():  # ``run`` clears
            return work(spark, docs, sf_dir)
        names = [f.__name__ for _, f in STAGES]
        last, paths, ended = getattr(_last, "stage", (None, [], 0.0))
        if last in names[:-1] and names.index(last) + 1 == names.index(work.__name__):
            files = docs.inputFiles()
            if files and all(not f.startswith(p) for f in files for p in paths) and written_at(spark, files[0]) > ended - 1:
                discard(spark, paths)
        with noted() as paths:
            out = work(spark, docs, sf_dir)
        _last.stage = work.__name__, paths, time.time()
        return out

    return started


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all rows with a language, judges each by the others; drops texts without a letter and texts that no language accepts.

    Rows that repeat stand or fall together; without any language only texts without a letter go.
    """
    return langid.keep_cross_fitted(docs)


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the longest original of each group of equal texts, then the smallest id; one row, also of rows that repeat an id."""
    return exact_dedup.keep_one(docs)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of near fingerprints or of texts with a similarity of 0.8 on five words.

    All texts without a word are one component. Rows that repeat id and text stand or fall together; the stage before leaves none.
    """
    return simhash.keep_one(docs)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Rows that repeat are drawn one by one."""
    return mixing.repeat_documents(docs)


@stage
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; an empty text has no tokens."""
    return bpe.token_digests(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mixed), ("bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), []
    for name, work in STAGES[:-1]:
        with noted() as kept:
            out = work(spark, docs, sf_dir)
        with noted() as written:
            docs = materialise(out, f"pipeline-{name}")
        discard(spark, kept + before)
        before = written
    with noted():
        return STAGES[-1][1](spark, docs, sf_dir)


#: Language models, fingerprints, subset sums and merges are beyond SQL; tests/llm compares each with a brute-force version.
ORACLE_SQL = None
