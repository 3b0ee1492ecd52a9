import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import ctw as C

FIELDS = "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"


def plain(docs, learned, depth):
    """Context-tree weighting by recursion over dictionaries; docs: (doc_id, text)."""
    lower = lambda t: (t or "").encode().translate(C.LOWER)
    texts = [b" ".join(lower(t).split()) + b"\n" for _, t in docs]
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)

    def decisions(text):
        whole = b"\n" * depth + text
        for i in range(depth, len(whole)):
            context = tuple(whole[i - 1 - k] for k in range(depth))
            for j in range(8):
                yield context, (j, whole[i] >> (8 - j)), whole[i] >> (7 - j) & 1

    for t, use in zip(texts, learned):
        for context, node, bit in decisions(t) if use else ():
            for d in range(depth + 1):
                counts[context[:d], node][bit] += 1
                if d < depth:
                    children[context[:d], node].add(context[: d + 1])

    def kt(a, b):
        g = math.lgamma
        return g(a + 0.5) + g(b + 0.5) - 2 * g(0.5) - g(a + b + 1)

    weighted = {}
    for d in range(depth, -1, -1):
        for (context, node), (a, b) in list(counts.items()):
            if len(context) == d:
                below = sum(weighted[c, node] for c in children[context, node]) if d < depth else None
                weighted[context, node] = kt(a, b) if d == depth else np.logaddexp(kt(a, b), below) - math.log(2)

    def probability(context, node, bit, d=0):
        if (context[:d], node) not in counts:
            return 0.5
        c = counts[context[:d], node]
        own = (c[bit] + 0.5) / (sum(c) + 1)
        if d == depth:
            return own
        share = 1 / (1 + math.exp(min(700, sum(weighted[x, node] for x in children[context[:d], node]) - kt(*c))))
        return share * own + (1 - share) * probability(context, node, bit, d + 1)

    words = [[*t.split(), b"\n"] for t in texts]
    known = Counter(w for ws, use in zip(words, learned) if use for w in ws)
    n = sum(known.values())
    return [
        (i, len(ws), sum(known[w] > 0 for w in ws), n, sum(math.log10((known[w] + 0.5) / (n + 0.5 * (len(known) + 1))) for w in ws), sum(math.log10(probability(*x)) for x in decisions(t)))
        for (i, _), t, ws in zip(docs, texts, words)
    ]


def compare(found, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[-1])
    found = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in found), key=key)
    want = sorted(want, key=key)
    assert len(found) == len(want)
    for a, b in zip(found, want):
        assert a[:4] == b[:4]
        assert math.isclose(a[4], b[4], abs_tol=1e-6) and math.isclose(a[5], b[5], rel_tol=1e-4, abs_tol=1e-3), (a, b)


def learned_by(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 != 1


def conditions():
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    return ~out & F.col("doc_id").isNotNull(), out


def test_against_recursion(spark, docs):
    rows = [(r["doc_id"], r["text"][:250]) for r in docs.limit(30).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for depth, size, parts in ((5, 3000, 4), (3, 1 << 20, 1), (7, 500, 3)):
        found = C.scored(df, *conditions(), depth=depth, chunk_bytes=size, parts=parts).collect()
        compare(found, plain(rows, [learned_by(i) for i, _ in rows], depth))


def test_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.where("n_chars < 1000").collect()]
    found = C.scored(odd.where("n_chars < 1000"), *conditions(), parts=2).collect()
    compare(found, plain(rows, [learned_by(i) for i, _ in rows], C.DEPTH))
    assert {r["held_out"] for r in found if r["doc_id"] is None} == {False}
    assert C.scored(odd, *conditions()).count() == odd.count()
    assert C.scored(empty, *conditions()).collect() == []
    # nothing learned: eight halves a byte
    for r in C.scored(odd, F.lit(False)).collect():
        assert r["train_tokens"] == r["n_known"] == 0 and r["held_out"] and math.isclose(r["bits_per_byte"], 8, rel_tol=1e-6)


def test_chunks_and_parts_do_not_matter(spark, docs):
    one = C.scored(docs, *conditions()).collect()
    many = C.scored(docs.repartition(5), *conditions(), chunk_bytes=20_000, parts=7).collect()
    assert sorted(r["doc_id"] for r in one) == sorted(r["doc_id"] for r in many)
    by = {r["doc_id"]: r for r in one}
    for r in many:
        assert [r[k] for k in ("n_tokens", "n_known", "train_tokens", "n_bytes")] == [by[r["doc_id"]][k] for k in ("n_tokens", "n_known", "train_tokens", "n_bytes")]
        assert math.isclose(r["score"], by[r["doc_id"]]["score"], rel_tol=1e-9)
    # learning helps: texts held out cost far less than a byte a byte
    held = [r["bits_per_byte"] for r in one if r["held_out"]]
    assert held and np.mean(held) < 4


def test_a_distribution(spark):
    """The probabilities of all next bytes add up to one."""
    texts = [b"the cat sat on the mat\n", b"the dog sat on the log\n"]
    key, n = np.unique(C.runs(texts, 4), return_counts=True)
    tree = C.levels(key, n, 4, 0)
    for context in (b"the ", b"xyzt", b"\n\n\n\n"):
        packed = sum(context[-1 - k] << 8 * (4 - k) for k in range(4))
        p = 10 ** C.log10_probabilities(np.arange(256, dtype=np.uint64) | np.uint64(packed), tree, 4)
        assert math.isclose(p.sum(), 1, rel_tol=1e-9)


def test_counts_beyond_the_table():
    for a, b in ((0, 0), (300, 2), (255, 256), (10**6, 10**9)):
        want = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
        assert math.isclose(float(C.log_kt(np.array([a]), np.array([b]))[0]), want, rel_tol=1e-9, abs_tol=1e-9)
