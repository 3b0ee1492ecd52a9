import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import token_files as T
from millrace.llm.bpe import vocabulary_path
from millrace.llm.common import new_path


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=3000))
def test_round_trip_and_random_access(ids):
    segment = T.Segment(T.split_levels(np.array(ids, np.uint32)))
    assert segment.all().tolist() == ids
    for i in {0, len(ids) - 1, len(ids) // 2, *range(0, len(ids), 97)}:
        assert segment.get(i) == ids[i]


def expected(found):
    library = Tokenizer.from_file(vocabulary_path())
    flat, out = [], []
    for r in sorted(found, key=lambda r: (r.doc_id is not None, r.doc_id)):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        out.append((r.doc_id, len(flat), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        flat += ids
    return flat, out


def test_files(spark, docs):
    to = new_path(spark, "token-files")
    T.write_tokens(docs, to, segment_ids=5000)
    flat, want = expected(docs.collect())
    assert sorted(map(tuple, T.document_checks(spark, to).collect())) == want
    assert {r.doc_id: r.ids for r in T.read_documents(spark, to).collect()} == {d: flat[a : a + n] for d, a, n, _ in want}
    asked = [*range(0, len(flat), 997), len(flat) - 1, len(flat) - 1, len(flat) + 3]
    got = T.tokens_at(spark, to, spark.createDataFrame([(p,) for p in asked], "pos long"), segment_ids=5000).collect()
    assert sorted((r.pos, r.id) for r in got) == sorted((p, flat[p]) for p in asked if p < len(flat))


def test_odd_rows(spark, odd, empty):
    to = new_path(spark, "token-files")
    T.write_tokens(odd, to)
    key = lambda x: (x[0] is not None, x)
    assert sorted(map(tuple, T.document_checks(spark, to).collect()), key=key) == sorted(expected(odd.collect())[1], key=key)
    to = new_path(spark, "token-files")
    T.write_tokens(empty, to)
    assert T.document_checks(spark, to).count() == 0
