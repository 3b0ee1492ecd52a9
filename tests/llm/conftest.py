import pytest

from millrace.llm.common import prepare

#: Null and empty texts, a null id, rows that repeat, a very long text, and columns whose names the operators use themselves.
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, fp long, keep_id long, size long, kept boolean, row string, rank int, h long, th long, copies int"


def odd_rows():
    long = "The quick brown fox jumps over the lazy dog. " * 3000
    texts = [
        (1, "Hello there, world. This is a text."), (2, "Hello  there,\tworld.\nThis is a text."), (3, None), (4, ""), (5, " \n\t"), (6, long), (7, long),
        (8, "Hello there, world. This is a text!"), (9, "ein zwei drei vier"), (9, "ein zwei drei vier"), (10, "été à la plage"), (11, "　<|endoftext|> 12 ’s İ Σ"), (None, "no id here"), (12, "12345 !!"), (13, "12345 !!"),
    ]
    langs = ["en", "de", None, "fr"]
    return [(i, t, langs[k % 4], ["a", None, "b"][k % 3], len(t or ""), "x", 7, 8, 9, True, "r", 1, 2, 3, 4) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return prepare(spark).createDataFrame(odd_rows(), ODD_SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return prepare(spark).createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, folder):
    return prepare(spark).read.parquet(f"{folder}/documents.parquet")
