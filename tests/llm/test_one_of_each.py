"""Which rows of near-duplicate groups stay: repeated and missing ids, and the stage against brute force."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from lumenreel.llm import shingle_join
from tests.conftest import SMALL
from tests.llm.test_shingle_join import brute

A = "one two three four five six seven eight nine ten"
B = "red orange yellow green blue indigo violet black white grey"


def test_repeated_and_missing_ids(spark):
    rows = [(1, A), (1, B), (1, A), (2, B + " "), (3, "a text of its own that nothing else is like"), (None, A), (None, "no id here but words enough to be a set"), (4, ""), (4, None), (4, " "), (5, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string")
    got = Counter((r.doc_id, (r.text or "").strip()) for r in shingle_join.one_of_each(docs).collect())
    assert got == Counter([(1, A), (1, B), (3, rows[4][1]), (None, A), (None, rows[6][1]), (4, ""), (5, "")])


def test_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = sorted({component for _, component in brute(rows).values()})
    assert sorted(r.doc_id for r in corpus_pipeline.no_copies(spark, docs, SMALL).collect()) == want


def test_extra_columns_of_any_name(spark):
    """Columns named as an operator might name its own come back as they were; of rows alike but for them one stays, always the same."""
    names = ["_text", "_first", "_key", "key", "row", "own", "other", "first", "component_id", "n_shingles", "group"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names) + ", tags map<string,int>"
    rows = [(i, t, *(f"{n}{i}{v}" for n in names), {"a": v}) for i, t, v in ((1, A, 0), (2, A, 0), (3, B, 0), (3, B, 1), (None, A, 0))]
    docs = spark.createDataFrame(rows, schema)
    got = sorted((tuple(r) for r in shingle_join.one_of_each(docs).collect()), key=str)
    again = sorted((tuple(r) for r in shingle_join.one_of_each(docs.repartition(3)).collect()), key=str)
    assert got == again and [r[0] for r in got] == [1, 3, None] and set(map(str, got)) <= set(map(str, rows))
    assert shingle_join.one_of_each(docs.limit(0)).collect() == []
