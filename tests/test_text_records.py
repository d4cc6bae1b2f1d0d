"""Text records of blank and missing texts."""

from __future__ import annotations

import duckdb

from lumenreel.plans import registry
from lumenreel.sources import files as s

TEXTS = ["a b", "", "  ", None, " x ", "\t", " \t ", " "]


def test_odd_documents_as_in_sql(spark, tmp_path):
    name = "s21_build_text_records"
    pairs = [(text, lang, source) for text in TEXTS for lang in ("en", "", " ", None, " de ") for source in ("src0", None)]
    documents = [(None if i == 9 else i, *pair) for i, pair in enumerate(pairs)]
    turns = [(conv, turn, "user", text) for text in TEXTS for conv in (1, None) for turn in (0, None)]
    for table, rows, schema in (("documents", documents, "doc_id long, text string, lang string, source string"), ("conversations", turns, "conv_id long, turn long, role string, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()[name]).fetchall()
    got = registry.queries()[name](spark, str(tmp_path)).select("id", "video_id", "doc_type", "text").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and sum(r.doc_type == "frame" for r in got) == len(documents)


def test_parts_of_a_frame_are_joined_without_blank_ones(spark):
    frames = spark.createDataFrame([(1, "v", [" a ", " ", None, "b"]), (2, "v", ["", None]), (3, "v", []), (4, "v", None)], "keyframe_id int, video_id string, texts array<string>")
    segments = spark.createDataFrame([(1, "v", " t "), (2, "v", " "), (3, "v", None)], "segment_id int, video_id string, text string")
    assert sorted(map(tuple, s.text_records(frames, segments).collect())) == [("frame:1", "v", "frame", "a b"), ("segment:v:1", "v", "transcript", "t")]
