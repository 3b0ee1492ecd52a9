import os
import random

import corpus_pipeline as P
from pyspark.sql import functions as F

from millrace.llm import bpe


def test_stages_in_turn(spark, folder, docs):
    table, columns = docs, docs.columns
    kept = {}
    for name, stage in P.STAGES[:-1]:
        table = spark.createDataFrame(stage(spark, table, folder).collect(), docs.schema)
        assert table.columns == columns
        kept[name] = sorted(r.doc_id for r in table.collect())
    assert len(kept["language_id"]) == docs.count()
    assert docs.count() > len(set(r.text for r in docs.collect())) >= len(kept["exact_dedup"]) >= len(kept["simhash_near_dedup"])
    assert set(kept["mixing"]) <= set(kept["simhash_near_dedup"]) and max(map(kept["mixing"].count, kept["mixing"])) <= 2
    got = sorted(map(tuple, P.run(spark, folder).collect()))
    assert got == sorted(map(tuple, bpe.token_digests(table).collect()))


def test_one_of_each_group_of_near_copies_stays(spark, docs):
    long = " ".join(r.text for r in docs.where("lang = 'en'").orderBy("doc_id").limit(20).collect())
    rows = [(7, long, "en", "a", 0), (5, long + " once more", "en", "b", 0), (9, long.replace("the", "teh", 1), "en", "a", 0), (1, "Something else entirely, said in a few words.", "en", "a", 0)]
    kept = P.near(spark, spark.createDataFrame(rows, docs.schema), None)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5]


def test_odd_rows(spark, odd, empty):
    for df in (odd, empty):
        table = df
        for _, stage in P.STAGES[:-1]:
            table = spark.createDataFrame(stage(spark, table, None).collect(), df.schema)
            assert table.columns == df.columns
        P.STAGES[-1][1](spark, table, None).collect()


def test_columns_of_any_name_are_kept(spark, docs):
    names = ["__fold", "__text", "__given", "__lang", "__h", "__limited", "__middle", "__id", "__th", "row", "found", "chunk", "accepted", "limited", "th", "root", "a.b", "given", "fold", "copies", "size", "carried"]
    table = docs.limit(30)
    for i, name in enumerate(names):
        table = table.withColumn(name, F.lit(i))
    columns = table.columns
    for _, stage in P.STAGES[:-1]:
        table = spark.createDataFrame(stage(spark, table, None).collect(), table.schema)
        assert table.columns == columns
    assert table.count() and all([r[c] for c in columns[5:]] == list(range(len(names))) for r in table.collect())
    assert P.STAGES[-1][1](spark, table, None).count() == table.count()


def test_a_labelled_text_does_not_vouch_for_itself(spark, folder, docs):
    draw = random.Random(3)
    noise = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(2000)) for _ in range(3)]
    italian = "Quando il sole scende dietro le colline, gli uomini tornano dai campi e le donne chiudono le finestre delle case; nessuno parla più del viaggio che doveva cominciare ieri mattina."
    bad = [noise[0], noise[0], noise[1], noise[2], italian, "это совсем другой язык и другие буквы, которых нигде больше нет в таблице"]
    rows = [(900000 + i, t, lang, "a", len(t)) for i, (t, lang) in enumerate(zip(bad, ["en", "en", "de", "fr", "es", "en"]))]
    kept = P.language_id(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), folder)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect())


def test_two_runs_in_one_session_do_not_meet(spark, folder, docs, tmp_path):
    one = P.run(spark, folder)  # not read yet
    # stage by stage, as another program would write them; a third chain begins in between
    table = docs
    for i, (_, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, table, folder)
        last = P._last.stage
        other = P.exact(spark, docs, folder) if i == 1 else None
        out.write.parquet(str(tmp_path / str(i)))
        if other is not None:
            assert other.count() > 0
            P._last.stage = last
        table = spark.read.parquet(str(tmp_path / str(i)))
    assert sorted(map(tuple, P.STAGES[-1][1](spark, table, folder).collect())) == sorted(map(tuple, one.collect()))


def test_what_a_stage_kept_goes_once_its_result_is_written(spark, docs, tmp_path):
    out = P.exact(spark, docs, None)
    kept = [p.removeprefix("file://") for p in P._last.stage[1]]
    assert kept and all(map(os.path.exists, kept))
    P.near(spark, docs, None)  # reads what was there before, so nothing goes
    assert all(map(os.path.exists, kept))
    out.write.parquet(str(tmp_path / "out"))
    P._last.stage = "exact", kept, P._last.stage[2] - 3600
    P.near(spark, spark.read.parquet(str(tmp_path / "out")), None)
    assert not any(map(os.path.exists, kept))
