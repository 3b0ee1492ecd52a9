"""Sentences and words as column expressions; the patterns mean the same to Spark and to DuckDB."""

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE = r"[^.!?\n]+[.!?]*"
WORD = r"[\p{L}\p{N}]+"


def sentences(text: str | Column) -> Column:
    """All sentences of a text, in order, without white space around them; null has none."""
    found = F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(SENTENCE), F.lit(0))
    return F.transform(found, lambda s: F.trim(s))


def words(text: str | Column) -> Column:
    """All words of a text in lower case, repeats included."""
    return F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(WORD), F.lit(0))
