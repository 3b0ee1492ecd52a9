import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np

from millrace.llm import quality as Q


def test_agrees_with_labels_it_never_saw(spark):
    folder = "/root/testdata/sf0.01"
    got = Q.op1_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    right = [r.kept == (r.quality == 1) for r in got]
    clean = [r.kept for r in got if r.quality == 1]
    assert len(got) > 300 and sum(right) / len(right) > 0.97 and sum(clean) / len(clean) > 0.97


def test_estimation_recovers_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(40_000) < 0.7
    counts = {}
    for g in good:
        pattern = 0
        for _ in Q.LABELLERS:
            right = rng.random() < 0.85
            pattern = pattern * 3 + (Q.GOOD if g == right else Q.BAD)
        counts[pattern] = counts.get(pattern, 0) + 1
    posterior = Q.estimate(counts)
    prior = sum(n * posterior[p] for p, n in counts.items()) / len(good)
    assert abs(prior - 0.7) < 0.03


def test_estimate_of_one_pattern_and_of_none():
    assert Q.estimate({}) == {}
    assert all(0 <= v <= 1 for v in Q.estimate({0: 5}).values())


def test_votes():
    assert Q.vote_pattern(b"") == Q.vote_pattern(b" \n") == -1
    assert 0 <= Q.vote_pattern("Été à la plage. Oui.".encode()) < 3 ** len(Q.LABELLERS)
    digits = lambda p: list(itertools.islice((p // 3**k % 3 for k in itertools.count()), len(Q.LABELLERS)))[::-1]
    junk = digits(Q.vote_pattern(b"word$$$ other%%% third&&& " * 20))
    assert junk[list(Q.LABELLERS).index("marked words")] == Q.BAD


def test_odd_rows(odd, empty):
    got = {r.doc_id: r for r in Q.judge(odd, Q.train(odd)).collect()}
    assert got[3].score == got[4].score == got[5].score == 0 and not got[3].kept and len(got) == 14
    assert Q.judge(empty, Q.train(empty)).count() == 0


def plain_posteriors(rows, rounds=200):
    """Expectation-maximisation over single texts, one at a time."""
    k = len(Q.LABELLERS)
    votes = [[p // 3 ** (k - 1 - i) % 3 for i in range(k)] for p in rows]
    good = [0.2 if Q.BAD in v else 0.95 for v in votes]
    for _ in range(rounds):
        prior = sum(good) / len(good)
        right = {}
        for i in range(k):
            for c in (0, 1):
                said = [0.5, 0.5]  # of GOOD and of BAD
                for v, g in zip(votes, good):
                    if v[i] != Q.NONE:
                        said[v[i] == Q.BAD] += g if c else 1 - g
                right[i, c] = (said[0] / sum(said), said[1] / sum(said))
        new = []
        for v in votes:
            z = math.log(prior + 1e-9) - math.log(1 - prior + 1e-9)
            for i in range(k):
                if v[i] != Q.NONE:
                    z += math.log(right[i, 1][v[i] == Q.BAD] / right[i, 0][v[i] == Q.BAD])
            new.append(1 / (1 + math.exp(-max(-50.0, min(50.0, z)))))
        done = max(abs(a - b) for a, b in zip(new, good)) < 1e-7
        if done:
            break
        good = new
    return dict(zip(rows, good))


def test_estimate_equals_a_plain_version(docs, odd):
    for rows in ([p for p in (Q.vote_pattern((r.text or "").encode()) for r in docs.collect()) if p >= 0], [p for p in (Q.vote_pattern((r.text or "").encode()) for r in odd.collect()) if p >= 0]):
        got, want = Q.estimate(dict(Counter(rows))), plain_posteriors(rows)
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-5 for p in want)


def plain_features(text):
    mask, out, before = (1 << Q.HASH_BITS) - 1, [], None
    for word in text.split():
        shape = "".join("0" if c.isdigit() and c.isascii() else "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else c for c in word.decode("latin-1"))
        shape = re.sub(r"(.)\1+", r"\1", "".join("a" if ord(c) > 127 else c for c in shape))
        out += [zlib.crc32(word.lower()) & mask, zlib.crc32(b"\0" + shape.encode("latin-1")) & mask]
        out.append(zlib.crc32(b"again" if word == before else b"after") & mask)
        before = word
    return out


def test_scorer_equals_a_plain_version(spark, docs):
    scorer = Q.train(docs)
    got = {r.doc_id: r.score for r in Q.judge(docs, scorer).collect()}
    for r in docs.collect():
        found = plain_features(r.text.encode())
        z = 3 * sum(float(scorer.weights[f]) for f in found) / len(found) + float(scorer.weights[-1])
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-5


def test_fit_equals_plain_gradient_steps():
    texts = [b"good words here", b"bad $$$ words %%%", b"more good words", b"%%% $$$ %%%"]
    labels = [0.9, 0.1, 0.95, 0.02]
    shares = [{f: 3 * n / len(plain_features(t)) for f, n in Counter(plain_features(t)).items()} for t in texts]
    weights, speed = Counter(), {}
    for _ in range(40):
        slope = {f: 1e-5 * w for f, w in weights.items()}
        for share, y in zip(shares, labels):
            z = sum(weights[f] * x for f, x in share.items()) + weights[-1]
            error = (1 / (1 + math.exp(-z)) - y) / len(texts)
            for f, x in [*share.items(), (-1, 1.0)]:
                slope[f] = slope.get(f, 0.0) + error * x
        for f, g in slope.items():
            speed[f] = speed.get(f, 1e-3) + g * g
            weights[f] -= g / math.sqrt(speed[f])
    rows = [tuple(np.array(x) for x in zip(*sorted(Counter(plain_features(t)).items()))) for t in texts]
    got = Q.fit_scorer(rows, np.array(labels), rounds=40)
    assert all(abs(got[f] - w) < 1e-6 for f, w in weights.items())


def test_accuracy_on_labels_of_another_table(spark):
    # the bounds of the labellers were set on texts of sf0.01; these are others
    folder = "/root/testdata/sf0.1"
    seen = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(seen, "text", "left_anti").where("doc_id % 4 = 0")
    got = Q.judge(docs, Q.train(docs)).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    right = [r.kept == (r.quality == 1) for r in got]
    assert len(got) > 500 and sum(right) / len(right) > 0.98
