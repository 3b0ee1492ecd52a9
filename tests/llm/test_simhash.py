import re

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash as S


def brute(found, radius=S.RADIUS):
    fps = []
    for r in found:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                label[root(i)] = root(j)
    ids = {}
    for i, r in enumerate(found):
        ids.setdefault(root(i), []).append(r.doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted(str((r.doc_id, fps[i], least[root(i)])) for i, r in enumerate(found))


def result(df):
    return sorted(str((r.doc_id, r.fp % 2**64, r.component_id)) for r in df.collect())


@pytest.mark.parametrize("radius, tile", [(2, 1024), (2, 3), (18, 4)])
def test_equals_brute_force(docs, radius, tile):
    assert result(S.near_duplicates(docs, radius=radius, tile=tile)) == brute(docs.collect(), radius)


def test_odd_rows(odd, empty):
    assert result(S.near_duplicates(odd)) == brute(odd.collect())
    assert S.near_duplicates(empty).count() == 0 and S.keep_one(empty).count() == 0
    kept = S.keep_one(odd)
    assert kept.columns == odd.columns and 7 not in {r.doc_id for r in kept.collect()}


def test_a_chain_is_one_component(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in S.stars(pairs).collect()}
    assert got == {i: 1 for i in range(2, 201)} | {1001: 1000}


def test_single_nodes_of_a_large_band_value_meet(spark):
    # the lowest band is zero in all; the pair differs in both other bands and each is alone with its population count
    many = [((1 << 10 + i % 5) - 1) << 23 | ((1 << 8) - 1) << 44 + i // 5 for i in range(40)]
    nodes = spark.createDataFrame([(x,) for x in [0, 1 << 21 | 1 << 42, *many]], "fp long")
    for tile in (4, 16, 1024):
        assert (0, 1 << 21 | 1 << 42) in {(r.a, r.b) for r in S.links(nodes, tile=tile).collect()}


def test_bands_miss_no_close_pair_and_hold_few_others():
    draw = np.random.default_rng(1)
    for radius, n_bands in ((0, 1), (1, 4), (2, 10), (3, 20), (6, 7)):
        masks = np.array(S.band_masks(radius), np.int64).view(np.uint64)
        assert len(masks) == n_bands
        for _ in range(200):
            bits = draw.choice(64, radius, replace=False)
            differ = np.uint64(sum(1 << int(b) for b in bits))
            assert (differ & masks == 0).any()
    # pairs to compare per fingerprint, at two sizes: three bands of 21 bits have about 0.06 and 0.6
    per = []
    for n in (100_000, 1_000_000):
        fp = draw.integers(0, 1 << 64, n, dtype=np.uint64)
        shared = [np.unique(fp & m, return_counts=True)[1] for m in np.array(S.band_masks(2), np.int64).view(np.uint64)]
        per.append(sum(int((c * (c - 1) // 2).sum()) for c in shared) / n)
    assert max(per) < 0.001


def joined(pairs):
    """The groups that pairs connect."""
    groups = {}
    for a, b in pairs:
        both = groups.get(a, {a}) | groups.get(b, {b})
        groups |= dict.fromkeys(both, both)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("every", [40, 9])
def test_a_family_of_near_copies_is_linked_without_all_its_pairs(spark, docs, monkeypatch, every):
    words = " ".join(r.text for r in docs.where("lang = 'de'").orderBy("doc_id").limit(20).collect()).split()[:200]
    table = [" ".join(words)] + [" ".join(w + f"x{k}" if i % (every * 5) == k % (every * 5) else w for i, w in enumerate(words)) for k in range(60)] + ["one two three four five six"]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in table)]
    df = spark.createDataFrame([(t,) for t in table], "text string")
    key = {r.text: r.th for r in df.selectExpr("text", "xxhash64(text) as th").collect()}
    want = {tuple(sorted((key[table[i]], key[table[j]]))) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    seen = []
    monkeypatch.setattr(S, "FEW", 2)
    keep = S.materialise
    monkeypatch.setattr(S, "materialise", lambda d, name: (lambda x: (seen.append(x.count()) if name == "similar-links" else None, x)[1])(keep(d, name)))
    got = {(r.a, r.b) for r in S.similar_links(df).collect()}
    assert got <= want and joined(got) == joined(want) and len(want) > 20 and (every != 40 or seen[-1] < 4 * len(table) < len(want))


def test_a_large_family_among_many_small_ones_is_linked_without_all_its_pairs(spark, docs, monkeypatch):
    """Most texts have one near copy, so there are few pairs for each text; still the one large family is not compared pair by pair."""
    few = [r.text.split() for r in docs.where("length(text) > 1000").dropDuplicates(["text"]).orderBy("doc_id").limit(80).collect()]
    words = " ".join(r.text for r in docs.where("lang = 'de'").orderBy("doc_id").limit(20).collect()).split()[:200]
    family = [" ".join(w + f"x{k}" if i == k else w for i, w in enumerate(words)) for k in range(60)]
    table = [" ".join(w) for w in few] + [" ".join([*w, "indeed"]) for w in few] + family
    df = spark.createDataFrame([(t,) for t in table], "text string")
    key = {r.text: r.th for r in df.selectExpr("text", "xxhash64(text) as th").collect()}
    sets = {th: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for t, th in key.items() for w in [t.lower().split()]}
    want = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    seen = []
    keep = S.materialise
    monkeypatch.setattr(S, "materialise", lambda d, name: (lambda x: (seen.append((name, x.count())), x)[1])(keep(d, name)))
    got = {(r.a, r.b) for r in S.similar_links(df).collect()}
    assert got <= want and joined(got) == joined(want) and len(want) > 1770
    assert [n for name, n in seen if name == "similar-links"][-1] < 3 * len(table) < len(want)


def test_similar_pairs_equal_brute_force(spark, docs):
    words = " ".join(r.text for r in docs.where("lang = 'en'").orderBy("doc_id").limit(20).collect()).split()[:300]

    def edited(every):
        return " ".join(w + "q" if i % every == every // 2 else w for i, w in enumerate(words))

    texts = [" ".join(words), edited(60), edited(50), edited(25), edited(7), "a b c", "a B  c", "", " "]
    table = docs.select("text").unionByName(spark.createDataFrame([(t,) for t in texts], "text string"))
    rows = table.selectExpr("xxhash64(text) as th", "text").distinct().collect()
    sets = {r.th: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in rows if (w := re.sub("[A-Z]", lambda m: m[0].lower(), r.text).encode().split())}
    want = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    got = {(r.a, r.b) for r in S.similar_links(table).collect()}
    assert got <= want and joined(got) == joined(want) and len(want) > 3
    far = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts[:5])], docs.schema)
    assert len({r.component_id for r in S.near_duplicates(far).collect()}) > 2
    assert sorted(r.doc_id for r in S.keep_one(far).collect()) == [0, 3, 4]


def test_hot_fingerprints_and_the_rest_alike(docs, monkeypatch):
    found = []
    for share in (1, 10**9):
        monkeypatch.setattr(S, "HOT_SHARE", share)
        found.append(result(S.near_duplicates(docs)))
    assert found[0] == found[1] == brute(docs.collect())


def test_centreless_families_and_sizes(spark, docs, monkeypatch):
    """Edits, cuts and additions of one text of different lengths, some near the bound."""
    words = " ".join(r.text for r in docs.where("lang = 'fr'").orderBy("doc_id").limit(20).collect()).split()[:150]
    draw = np.random.default_rng(5)
    table = []
    for k in range(70):
        own = list(words)
        for i in draw.choice(len(own), 3 + k % 3, replace=False).tolist():
            own[i] = f"{own[i]}q{k}"
        at = int(draw.integers(0, 120))
        table.append(" ".join(own if k % 3 == 0 else own[:at] + own[at + k % 12 :] if k % 3 == 1 else own[:at] + [f"new{k}"] + own[at:]))
    table += table[:3] + [" ".join(words[:n]) for n in (5, 6, 120, 124, 125, 126, 130, 149)]
    df = spark.createDataFrame([(t,) for t in table], "text string")
    key = {r.text: r.th for r in df.selectExpr("text", "xxhash64(text) as th").collect()}
    sets = {key[t]: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for t in table for w in [t.split()]}
    want = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    for few in (20, 0):
        monkeypatch.setattr(S, "FEW", few)
        got = {(r.a, r.b) for r in S.similar_links(df).collect()}
        assert got <= want and joined(got) == joined(want) and len(want) > 10


def test_texts_that_lack_too_much_meet_nothing(spark, docs, monkeypatch):
    """Copies of one text with four edits each share 86 % of their shingles with it and are similar to nothing: no texts are compared."""
    words = " ".join(r.text for r in docs.where("lang = 'es'").orderBy("doc_id").limit(20).collect()).split()[:150]
    table = [" ".join(w + f"q{k}" if i % 36 == 2 + k % 34 else w for i, w in enumerate(words)) for k in range(120)]
    seen = []
    keep = S.materialise
    monkeypatch.setattr(S, "materialise", lambda d, name: (lambda x: (seen.append((name, x.count())), x)[1])(keep(d, name)))
    assert S.similar_links(spark.createDataFrame([(t,) for t in table], "text string")).collect() == []
    rows = dict(seen)
    assert rows["similar-sets"] == len(table) and rows.get("similar-classes", 0) == 0
