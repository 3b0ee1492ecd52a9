import os
import re

from millrace.operators import events, summaries
from millrace.sources.tables import stream
from millrace.streaming.rollup import run_rollup

EMPTY = "doc_id long, text string, lang string, source string"


def test_nulls_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None, "en", "a"), (2, "", None, None), (3, "... !!", "en", "a"), (None, "One two. Two two three!", None, None)], EMPTY)
    got = summaries.by_word_frequency(docs, top=1).collect()
    assert [(r.doc_id, r.summary) for r in got] == [(None, "Two two three!")]
    assert {r.doc_id: r.summary for r in summaries.lead(docs).collect()} == {None: "One two. Two two three!"}
    assert summaries.by_group(docs, "source").count() == 2


def test_ties_go_to_the_earlier_sentence(spark):
    docs = spark.createDataFrame([(1, "b a. a b. c.", "en", "a")], EMPTY)
    assert summaries.by_word_frequency(docs, top=1).first().summary == "b a."


def test_empty_tables(spark):
    docs = spark.createDataFrame([], EMPTY)
    for df in (summaries.by_word_frequency(docs), summaries.by_tfidf(docs), summaries.by_group(docs, "lang"), summaries.overlap(summaries.lead(docs), summaries.lead(docs))):
        assert df.count() == 0
    assert summaries.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_overlap_of_a_summary_with_itself(spark, folder):
    from millrace.sources.tables import table

    lead = summaries.lead(table(spark, folder, "documents"))
    got = summaries.overlap(lead, lead)
    assert got.where("precision <> 1 or recall <> 1").count() == 0


def test_one_shuffle_of_texts(spark, folder):
    from millrace.sources.tables import table

    plan = summaries.by_word_frequency(table(spark, folder, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_late_events_are_left_out_of_closed_windows(spark, folder, tmp_path):
    rolled = run_rollup(spark, stream(spark, folder, "events"), f"file://{tmp_path}", late="10 minutes")
    batch = events.rollup(spark.read.parquet(f"{folder}/events.parquet"))
    assert rolled.exceptAll(batch).count() == 0 and 0 < rolled.count() <= batch.count()


def test_closed_windows_are_written_once(spark, folder, tmp_path):
    rolled = run_rollup(spark, stream(spark, folder, "events"), f"file://{tmp_path}", late="10 minutes", closed=True)
    batch = events.rollup(spark.read.parquet(f"{folder}/events.parquet"))
    assert rolled.exceptAll(batch).count() == 0 and 0 < rolled.count() < batch.count()


def test_stream_equals_batch_on_odd_rows(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "a", 1.5), (2, "2024-01-01 00:20:00", None, 2.0), (3, None, "a", 1.0), (4, "2024-01-01 00:30:00", None, None), (5, "2024-01-02 00:00:00", "b", -1.0)]
    schema = "event_id long, ts string, event_type string, value double"
    for i, part in enumerate((rows[:2], rows[2:], rows[1:2], [])):
        spark.createDataFrame(part, schema).selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "event_type", "value").coalesce(1).write.parquet(f"{tmp_path}/events.parquet/part{i}")
    table = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/events.parquet")
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/events.parquet")
    got = run_rollup(spark, source, f"file://{tmp_path}/out")
    want = events.rollup(table)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.where("start is not null").collect())) and got.where("event_type is null").count() == 1
    none = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/events.parquet/part3")
    assert run_rollup(spark, none, f"file://{tmp_path}/none").count() == 0


def test_sessions_of_odd_rows(spark):
    schema = "user_id long, ts string, event_type string"
    rows = [(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:29:59", None), (1, "2024-01-01 01:00:00", "b"), (None, "2024-01-01 00:00:00", "a"), (None, "2024-01-01 00:00:00", "a"), (2, None, "a")]
    df = spark.createDataFrame(rows, schema).selectExpr("user_id", "cast(ts as timestamp_ntz) as ts", "event_type")
    got = sorted((str(r.user_id), str(r.start), r.n, r.types) for r in events.sessions(df).collect())
    assert got == [("1", "2024-01-01 00:00:00", 2, 1), ("1", "2024-01-01 01:00:00", 1, 1), ("None", "2024-01-01 00:00:00", 2, 1)]
    assert events.sessions(df.where("false")).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(1, "aa bb. zz aa.", "en", "a"), (1, "cc dd. cc cc dd.", "en", "a"), (2, "ee ff.", "en", None), (2, "ee ff.", "en", None), (None, "gg. hh hh.", None, "a"), (None, "ii.", None, "a")]
    docs = spark.createDataFrame(rows, EMPTY)
    for summary in (summaries.by_word_frequency(docs), summaries.by_tfidf(docs)):
        assert sorted((str(r.doc_id), r.summary) for r in summary.collect()) == [("1", "aa bb. zz aa."), ("1", "cc dd. cc cc dd."), ("2", "ee ff."), ("None", "gg. hh hh."), ("None", "ii.")]
    lead = summaries.lead(docs)
    assert lead.count() == 6
    assert summaries.overlap(lead, lead).where("precision = 1 and recall = 1").count() == 3


def test_rarities_meet_rare_and_frequent_words_alike(spark, folder):
    from millrace.sources.tables import table

    docs = table(spark, folder, "documents")
    few, many, none = (sorted(map(tuple, summaries.tfidf_scores(docs, "source", hot_words=n).collect()), key=str) for n in (7, 10_000, 0))
    assert few == many == none and len(few) > 200


def test_word_rows_do_not_carry_a_long_sentence(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i % 50}" for i in range(30_000)), "en", "a")], EMPTY)
    for df in (summaries.by_word_frequency(docs), summaries.by_tfidf(docs), summaries.by_group(docs, "lang")):
        carried = re.findall(r"Generate explode\(.*?\), \[([^\]]*)\], (?:true|false)", df._jdf.queryExecution().executedPlan().toString())
        assert carried and not any("sentence" in x or "text" in x for x in carried)
        assert df.count() == 1


def parts_in_turn(spark, tmp_path, parts):
    """A stream that reads each part in a batch of its own, in order."""
    schema = "event_id long, ts string, event_type string, value double"
    for i, part in enumerate(parts):
        path = f"{tmp_path}/events.parquet/part{i}"
        spark.createDataFrame(part, schema).selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "event_type", "value").coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            os.utime(f"{path}/{f}", (1_700_000_000 + i, 1_700_000_000 + i))
    table = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/events.parquet")
    return table, spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/events.parquet")


def test_late_rows_over_batches(spark, tmp_path):
    first, second = [(1, "2024-01-01 00:10:00", "a", 1.0)], [(2, "2024-02-10 00:00:00", "a", 1.0)]
    late, in_time = (4, "2024-01-01 00:20:00", "a", 2.0), (5, "2024-01-20 00:20:00", "a", 3.0)
    # a watermark holds from the batch after the next one: the third batch still reaches the first window, the fourth does not
    table, source = parts_in_turn(spark, tmp_path, (first, second, [late, in_time], [(7, *late[1:]), (8, *in_time[1:])]))
    got = {(str(r.start), r.event_type): r.n for r in run_rollup(spark, source, f"file://{tmp_path}/out").collect()}
    assert got == {("2024-01-01 00:00:00", "a"): 2, ("2024-02-10 00:00:00", "a"): 1, ("2024-01-20 00:00:00", "a"): 2}
    batch = {(str(r.start), r.event_type): r.n for r in events.rollup(table).collect()}
    assert batch == got | {("2024-01-01 00:00:00", "a"): 3}


def test_a_stream_without_events(spark, tmp_path):
    table, source = parts_in_turn(spark, tmp_path, ([],))
    assert run_rollup(spark, source, f"file://{tmp_path}/out").count() == 0
