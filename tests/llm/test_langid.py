import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from millrace.llm import langid as L


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = L.op2_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert len(held) > 200 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98
    assert sum(r.rejected for r in got) == 0


def packed(text):
    seq, _ = L.sequences([text])
    return seq


def test_model_equals_the_textbook_formula():
    texts = {"x": ["abra cadabra abra", "a bar"], "y": ["ab cd ab cd"]}
    model = L.Model({k: (lambda s: (s[0], s[1].astype(float)))(np.unique(np.concatenate([packed(t) for t in v]), return_counts=True)) for k, v in texts.items()})
    letters = {c for v in texts.values() for t in v for c in t}
    for i, lang in enumerate(model.langs):
        tops = Counter()
        for t in texts[lang]:
            s = "   " + t  # blanks stand before a text
            tops.update(s[k - 3 : k + 1] for k in range(3, len(s)))
        counts = {4: tops}
        for n in (3, 2, 1):
            kinds = defaultdict(set)
            for g in counts[n + 1]:
                kinds[g[1:]].add(g[0])
            counts[n] = Counter({g: len(v) for g, v in kinds.items()})

        def p(g):
            if not g:
                return 1 / (len(letters) + 1)
            c = counts[len(g)]
            one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            d = min(0.95, max(0.05, one / (one + 2 * two) if one else 0.5))
            follow = {k: v for k, v in c.items() if k[:-1] == g[:-1]}
            total = sum(follow.values())
            return (max(c[g] - d, 0) + d * len(follow) * p(g[1:])) / total if total else p(g[1:])

        for probe in ("abra", "cad", "zzz a", "bar bar", "dab"):
            s = "   " + probe
            want = sum(math.log(p(s[k - 3 : k + 1])) for k in range(3, len(s)))
            got = model.log_probabilities(packed(probe))[:, i].sum()
            assert abs(got - want) < 1e-3


def test_odd_rows(odd, empty):
    assert L.train(odd).langs  # an empty text with a language gives no sequences
    model = L.train(L.learning_rows(odd))
    got = L.identify(odd, model).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 and by[k].rejected for k in (3, 4, 5, 12)) and by[10].lang_pred != "und"
    kept = L.keep_identified(odd, model)
    assert kept.columns == odd.columns and not {3, 4, 5, 12} & {r.doc_id for r in kept.collect()}
    none = L.train(empty)
    assert L.identify(empty, none).count() == 0 and {r.lang_pred for r in L.identify(odd, none).collect()} == {"und"}


def test_gibberish_is_rejected(spark, docs):
    model = L.train(docs)
    bad = spark.createDataFrame([(1, "xqzj kvwp qqxz jjzk wxvq " * 20), (2, "это совсем другой язык и другие буквы " * 10)], "doc_id long, text string")
    assert all(r.rejected for r in L.identify(bad, model).collect())
    assert L.keep_identified(docs, model).count() == docs.count()


def test_limits_and_rate_come_from_texts_that_were_not_learned(docs):
    rows = L.learning_rows(docs)
    shown, model = L.calibrate(rows), L.learn(rows)
    assert set(shown.limits) == set(model.langs) and shown.rate in L.RATES
    # texts that were learned look better than others
    assert all(shown.limits[x][0] > model.mean[i] for i, x in enumerate(model.langs))
    held = docs.where(L.held_out())
    got = L.identify(held, model, shown=shown).collect()
    assert len(got) > 40 and sum(r.rejected for r in got) == 0
    again = L.calibrate(rows, max_entries=10)
    assert again.rate == shown.rate and all(abs(a - b) < 1e-3 for x in shown.limits for a, b in zip(again.limits[x], shown.limits[x]))


def test_tables_hold_the_whole_model(docs, odd):
    for df in (docs, odd):
        rows = L.learning_rows(df)
        tables = L.learn(rows, max_entries=10)
        assert isinstance(tables, L.Tables)
        shown = L.calibrate(rows)
        want, got = (sorted(L.identify(df, m, shown=shown).collect(), key=lambda r: (str(r.doc_id), r.entropy)) for m in (L.learn(rows), tables))
        assert [(r.doc_id, r.lang_pred, r.rejected) for r in got] == [(r.doc_id, r.lang_pred, r.rejected) for r in want]
        assert all(abs(a.entropy - b.entropy) < 1e-4 and abs(a.score - b.score) < 1e-3 for a, b in zip(got, want))
        kept = [L.keep_cross_fitted(df, max_entries=m) for m in (10, L.MAX_ENTRIES)]
        assert kept[0].columns == df.columns and sorted(map(str, kept[0].collect())) == sorted(map(str, kept[1].collect()))


def test_rare_letters_count_alike_in_both_ways(spark, docs):
    """Letters of late Unicode versions and beyond U+FFFF: no language has learned them, so the text goes."""
    rows = [(10**6 + i, t, None, "a", len(t)) for i, t in enumerate(["\u0870\u0871", "\U00010570\U00010571", "\U00010570 the", "\U0001F600 1 \u0660", "𝒳", "the"])]
    df = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    learned = L.learning_rows(docs)
    found = []
    for most in (L.MAX_ENTRIES, 10):
        got = {r.doc_id - 10**6: r for r in L.identify(df, L.learn(learned, max_entries=most)).where("doc_id >= 1000000").collect()}
        assert [got[i].rejected for i in (0, 1, 3)] == [True] * 3 and got[3].lang_pred == "und" and got[0].lang_pred != "und" != got[1].lang_pred
        assert got[0].entropy > 1 and got[1].entropy > 1 and not got[5].rejected and got[2].entropy > got[5].entropy
        found.append([(got[i].lang_pred, round(got[i].entropy, 3), round(got[i].score, 3), got[i].rejected) for i in sorted(got)])
        kept = {r.doc_id - 10**6 for r in L.keep_cross_fitted(df, max_entries=most).where("doc_id >= 1000000").collect()}
        assert not kept & {0, 1, 3} and 5 in kept
    assert found[0] == found[1]


def test_the_front_finds_what_search_finds(docs):
    model = L.train(docs)
    seq, _ = L.sequences(["completely new wrds, żółć and \U00010400", docs.first().text])
    assert np.array_equal(model.log_probabilities(seq), model.searched(seq))
