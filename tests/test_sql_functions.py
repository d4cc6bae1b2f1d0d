"""SQL functions and the table function of events equal the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenreel.functions import queries as q
from lumenreel.functions import text as t
from lumenreel.functions.tables import split_events
from lumenreel.operators import hooks, ranking

TEXTS = [
    None, "", "  ", "one event only", "a man runs after he falls and before the end", "Order: E1: he sits\nEvent 2: she stands; step 3) they leave", "E1: lone event",
    "1. first thing\n2) second - thing\n 3: third", "he sits then she stands, finally they leave; done", "Đầu tiên mở cửa sau đó đi ra cuối cùng ngồi xuống", "- is walking. then -are running -",
    "\r\n1. a\r\n2. b\r\n", "x; y; z; 1; 2; 3; 4; 5; 6; 7", "A sau khi B và trước khi C", "a then b", "then",
]


def test_events_in_sql(spark):
    hooks.register(spark)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, x string")
    df.createOrReplaceTempView("event_inputs")
    want = {r.k: (r.e.source, r.e.events) for r in df.select("k", q.parse_events(F.col("x")).alias("e")).collect()}
    assert {k: split_events(x) for k, x in enumerate(TEXTS)} == want
    rows = spark.sql("SELECT k, e.* FROM event_inputs, LATERAL parse_events(x) e ORDER BY k, place").collect()
    found: dict = {}
    for r in rows:
        assert r.place == len(found.setdefault(r.k, (r.source, []))[1]) + 1
        found[r.k][1].append(r.event)
    assert found == {k: x for k, x in want.items() if x[1]}
    assert want[4] == ("context_relation", ["he falls", "a man runs", "the end"]) and want[9][0] == "soft_separators" and len(want[12][1]) == 8


def test_overlap_and_answers_in_sql(spark):
    hooks.register(spark)
    docs = [(1, "the cat sat on the mat"), (2, "a dog"), (3, None), (4, "THE the Cat été"), (5, "x")]
    asked = [(1, "the the cat"), (2, "été"), (3, ""), (4, None)]
    d, a = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(asked, "query_id int, query_text string")
    d.createOrReplaceTempView("d")
    a.createOrReplaceTempView("a")
    want = {(r.query_id, r.doc_id): round(r.score, 9) for r in ranking.overlap_scores(d, a, ["doc_id"]).collect()}
    got = spark.sql("SELECT query_id, doc_id, overlap_score(query_text, text) AS score FROM a CROSS JOIN d").collect()
    assert {(r.query_id, r.doc_id): round(r.score, 9) for r in got if r.score} == want and len(got) == 20 and len(want) == 3
    rows = [("  A b.\n C! ",), (None,), ("É_1  " + "y" * 200,)]
    spark.createDataFrame(rows, "x string").createOrReplaceTempView("answers_in")
    got = spark.sql("SELECT answer_display(x) AS a, answer_match(x) AS b, text_tokens(x) AS c, x FROM answers_in")
    same = got.select("a", "b", "c", t.answer_display(F.col("x")).alias("d"), t.answer_match(F.col("x")).alias("e"), t.tokenize(F.col("x")).alias("f")).collect()
    assert [(r.a, r.b, r.c) for r in same] == [(r.d, r.e, r.f) for r in same]
