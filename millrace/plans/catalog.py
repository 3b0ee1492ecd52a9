"""The registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid

from ..operators import events, summaries
from ..sources.tables import stream, table
from ..streaming.rollup import run_rollup


def docs(spark, folder):
    return table(spark, folder, "documents")


def stream_rollup(spark, folder):
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-")
    return run_rollup(spark, stream(spark, folder, "events"), f"{root.rstrip('/')}/rollup-{uuid.uuid4().hex}")


QUERIES = {
    "summary_word_frequency": lambda s, d: summaries.by_word_frequency(docs(s, d)),
    "summary_tfidf": lambda s, d: summaries.by_tfidf(docs(s, d)),
    "summary_by_source": lambda s, d: summaries.by_group(docs(s, d), "source"),
    "summary_by_language": lambda s, d: summaries.by_group(docs(s, d), "lang"),
    "summary_lead": lambda s, d: summaries.lead(docs(s, d)),
    "summary_overlap": lambda s, d: summaries.overlap(summaries.lead(docs(s, d)), summaries.by_word_frequency(docs(s, d))),
    "conversation_summary": lambda s, d: summaries.conversations(table(s, d, "conversations")),
    "event_rollup": lambda s, d: events.rollup(table(s, d, "events")),
    "event_rollup_stream": stream_rollup,
    "event_sessions": lambda s, d: events.sessions(table(s, d, "events")),
}

SENTENCES = r"""
s0 AS (SELECT doc_id, lang, source, regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!?]*') AS a FROM documents),
s AS (SELECT doc_id, lang, source, trim(unnest(a), ' ') AS sentence, generate_subscripts(a, 1) - 1 AS sent_no FROM s0),
w AS (SELECT doc_id, lang, source, sent_no, sentence, unnest(regexp_extract_all(lower(sentence), '[\p{L}\p{N}]+')) AS word FROM s),
"""

BEST = """
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sent_no) AS rank FROM sc)
SELECT doc_id, count(*) AS n_sentences, string_agg(sentence, ' ' ORDER BY sent_no) AS summary FROM r WHERE rank <= 3 GROUP BY doc_id
"""

FREQUENCY = """
f AS (SELECT doc_id, word, count(*) AS freq FROM w GROUP BY doc_id, word),
sc AS (SELECT w.doc_id, sent_no, any_value(sentence) AS sentence, CAST(sum(freq) AS DOUBLE) / count(*) AS score
       FROM w JOIN f ON w.doc_id = f.doc_id AND w.word = f.word GROUP BY w.doc_id, sent_no),
"""

TFIDF = """
n AS (SELECT count(*) AS total FROM documents),
i AS (SELECT word, CAST(round(ln(total / count(DISTINCT doc_id)) * 1000) AS BIGINT) AS idf FROM w, n GROUP BY word, total),
sc AS (SELECT doc_id, lang, source, sent_no, sentence, CAST(sum(idf) AS DOUBLE) / count(*) AS score
       FROM w JOIN i USING (word) GROUP BY doc_id, lang, source, sent_no, sentence),
"""

LEAD = r"""
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_no) AS place FROM s WHERE regexp_matches(sentence, '[\p{L}\p{N}]')),
lead AS (SELECT doc_id, count(*) AS n_sentences, string_agg(sentence, ' ' ORDER BY sent_no) AS summary FROM q WHERE place <= 3 GROUP BY doc_id)
"""


def _by_group(group: str) -> str:
    return f"""WITH {SENTENCES} {TFIDF}
r AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, doc_id, sent_no) AS rank FROM sc)
SELECT {group}, rank, doc_id, sent_no, sentence FROM r WHERE rank <= 3"""


ROLLUP = """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n,
       CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS milli, max(value) AS highest
FROM events GROUP BY 1, 2
"""

ORACLE_SQL = {
    "summary_word_frequency": f"WITH {SENTENCES} {FREQUENCY} {BEST}",
    "summary_tfidf": f"WITH {SENTENCES} {TFIDF} {BEST}",
    "summary_by_source": _by_group("source"),
    "summary_by_language": _by_group("lang"),
    "summary_lead": f"WITH {SENTENCES} {LEAD} SELECT doc_id, n_sentences, summary FROM lead",
    "summary_overlap": f"""WITH {SENTENCES} {FREQUENCY} {LEAD},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sent_no) AS rank FROM sc),
best AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY sent_no) AS summary FROM r WHERE rank <= 3 GROUP BY doc_id),
a0 AS (SELECT doc_id, unnest(regexp_extract_all(lower(summary), '[\\p{{L}}\\p{{N}}]+')) AS word FROM lead),
b0 AS (SELECT doc_id, unnest(regexp_extract_all(lower(summary), '[\\p{{L}}\\p{{N}}]+')) AS word FROM best),
a AS (SELECT doc_id, word, count(*) AS n FROM a0 GROUP BY ALL),
b AS (SELECT doc_id, word, count(*) AS n FROM b0 GROUP BY ALL)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id,
       CAST(sum(CASE WHEN a.n IS NULL OR b.n IS NULL THEN 0 ELSE least(a.n, b.n) END) AS DOUBLE) / sum(a.n) AS precision,
       CAST(sum(CASE WHEN a.n IS NULL OR b.n IS NULL THEN 0 ELSE least(a.n, b.n) END) AS DOUBLE) / sum(b.n) AS recall
FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.word = b.word GROUP BY 1""",
    "conversation_summary": r"""
SELECT conv_id, count(*) AS n_turns, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'))) AS BIGINT) AS n_words,
       arg_min(text, turn) AS opening, arg_max(text, turn) AS closing
FROM conversations GROUP BY conv_id""",
    "event_rollup": ROLLUP,
    # the stream leaves out events that come 31 days late (rollup.LATE); the tables hold 30 days, so none does
    "event_rollup_stream": ROLLUP,
    "event_sessions": """
WITH e AS (SELECT user_id, ts, event_type, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
             OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n, count(DISTINCT event_type) AS types FROM g GROUP BY user_id, s""",
}
