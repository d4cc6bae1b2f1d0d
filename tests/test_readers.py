"""Readers and transcript checks on odd input, by hand."""

from __future__ import annotations

import json

import pytest

from lumenreel.operators import validation
from lumenreel.plans import checks
from lumenreel.sources import files as s
from tests.conftest import SMALL

TRANSCRIPT = "line long, video_id string, position long, segment_id string, segment_video_id string, text string, start_seconds double, end_seconds double"


def test_video_of_a_shot(spark, tmp_path):
    (tmp_path / "a.csv").write_text("video_id,video_name,image_path\nV1,b/W.mp4,c/x.jpg\n,b/W.1.mp4,c/x.jpg\n ,,a/c/x.jpg\n,,x.jpg\n")
    assert [(r.video_id, r.image_name) for r in s.read_shots(spark, str(tmp_path)).collect()] == [("V1", "x.jpg"), ("W.1", "x.jpg"), ("c", "x.jpg"), (None, "x.jpg")]


def test_pointers(spark):
    documents = [
        {"annotations_uri": " a.jsonl ", "gcs_annotations": "a.csv", "recommended_import_annotations_uri": None}, {"outputs": {"gcs_annotations": "b.jsonl"}, "artifacts": 3},
        {"outputs": [1], "artifacts": ["c.jsonl", None, 5, {"uri": "d.jsonl", "annotations_uri": "e.jsonl"}, "c.jsonl"]}, {"import_artifacts": [{"gcs_annotations": "f.jsonl"}, {"other": "g.jsonl"}], "artifacts": {}},
        ["h.jsonl"], "i.jsonl", {}, None,
    ]
    values = [json.dumps(d) for d in documents] + ["{broken", "", None]
    found = s.artifact_paths(spark.createDataFrame([(x,) for x in values], "value string"))
    assert sorted(r.path for r in found.collect()) == [f"{x}.jsonl" for x in "abcdef"]


def test_ground_truth_forms(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Original Query ID,Query Text,Task Type,GT Video ID,GT Frame ID\nx1,red car,kis,l21_v001,40\nx2,none,qa,,\n", encoding="utf-8")
    rows = s.read_ground_truth(spark, str(tmp_path / "a.csv")).orderBy("query_id").collect()
    assert [tuple(r) for r in rows] == [("x1", "KIS", 1, "L21_V001", 40), ("x2", "QA", None, None, None)]
    (tmp_path / "b.csv").write_text('query_id,answer\nq-qa,\nq-kis,"v1,2; v2, 3"\n')
    rows = s.read_ground_truth(spark, str(tmp_path / "b.csv")).orderBy("query_id", "target").collect()
    assert [tuple(r) for r in rows] == [("q-kis", "KIS", 1, "V1", 2), ("q-kis", "KIS", 2, "V2", 3), ("q-qa", "QA", None, None, None)]
    (tmp_path / "c.csv").write_text("query,answer\nq,v\n")
    with pytest.raises(ValueError, match="no query"):
        s.read_ground_truth(spark, str(tmp_path / "c.csv"))


def test_matrices(spark):
    one, two = [1.0], [1.0, 2.0]
    rows = [("a", 0, two), ("a", 1, two), ("b", 0, one), ("b", 1, two), ("c", 0, None), ("d", 0, []), ("e", 0, two), ("e", 2, two), ("f", 1, two), ("g", 0, two), ("g", 0, two), ("h", None, two)]
    good, bad = s.vector_matrices(spark.createDataFrame(rows, "video_id string, index long, embedding array<double>"))
    assert sorted((r["video_id"], r["index"]) for r in good.collect()) == [("a", 0), ("a", 1)]
    assert {r.video_id: r.reason for r in bad.collect()} == dict(b="lengths differ", c="vector missing", d="vector missing", e="index gaps", f="index gaps", g="index gaps", h="index gaps")


def test_transcripts(spark):
    ok = ("t", 0.0, 1.0)
    rows = [
        ((1, "v", 0, "s1", None, *ok), None), ((1, "v", 1, "s1", "v", *ok), "duplicate_segment"), ((1, "v", 2, " ", "v", *ok), "missing_segment"), ((1, "v", 3, "s2", "w", *ok), "other_video"),
        ((1, "v", 4, "s3", " v ", " ", 0.0, 1.0), "empty_text"), ((1, "v", 5, "s4", "v", None, 0.0, 1.0), "empty_text"), ((1, "v", 6, "s5", "v", "t", None, 1.0), "no_time"),
        ((1, "v", 7, "s6", "v", "t", -1.0, 1.0), "bad_range"), ((1, "v", 8, "s7", "v", "t", 2.0, 1.0), "bad_range"), ((1, "v", 9, "s8", "v", "t", 1.0, 1.0), None),
        ((2, "v", 0, "s9", "v", *ok), "duplicate_video"), ((3, None, 0, "s9", None, *ok), "missing_video"), ((4, "w", 0, "s9", None, *ok), None), ((4, "w", 1, "s3", None, *ok), "duplicate_segment"),
        ((5, "x", None, None, None, None, None, None), None),
    ]
    got = validation.check_transcripts(spark.createDataFrame([r for r, _ in rows], TRANSCRIPT)).collect()
    assert {(r.line, r.position): r.rule for r in got} == {(r[0], r[2]): rule for r, rule in rows} and len(got) == len(rows)
    assert validation.check_transcripts(spark.createDataFrame([], TRANSCRIPT)).count() == 0


def test_the_query_has_every_rule(spark):
    rules = {r.rule for r in checks.v10_validate_asr(spark, SMALL.replace("sf0.001", "sf0.01")).collect()}
    assert {"duplicate_video", "duplicate_segment", "other_video", "empty_text", "no_time", "bad_range", None} <= rules
