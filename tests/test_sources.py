"""Readers and text functions on small files and texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumenreel.functions import queries as fq
from lumenreel.functions import text as ft
from lumenreel.operators import evaluation, hooks
from lumenreel.plans import registry
from lumenreel.plans import views
from lumenreel.sources import files as s
from lumenreel.streaming import ingest


def test_shot_manifest_with_other_names_and_bad_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿video,start_frame,shot_end_frame,frame,image_path,fps\nV1,0,74.0,37,V1/x.jpg,25\nV2,bad,,5,y.jpg,\n", encoding="utf-8")
    rows = sorted(s.read_shots(spark, str(tmp_path)).collect())
    assert [tuple(r) for r in rows] == [("V1", 0, 74, 37, "x.jpg", 25.0), ("V2", None, None, 5, "y.jpg", None)]


def test_map_files(spark, tmp_path):
    (tmp_path / "V1.csv").write_text("n,pts_time,fps,frame_idx\n1,0.0,25,0\nx,1,25,9\n")
    good, bad = s.read_map_keyframes(spark, str(tmp_path))
    assert [(r.video_id, r.n, r.frame_idx) for r in good.collect()] == [("V1", 1, 0)] and bad.count() == 1


def test_shards_lie_whole_in_few_files(spark, tmp_path):
    rows = spark.range(2000, numPartitions=8).select(F.col("id").alias("event_id"), F.col("id").alias("global_index")).repartition(8)
    s.write_shards(rows, 10, f"{tmp_path}/shards")
    back = spark.read.schema("event_id long, local_index long, shard_index long").json(f"{tmp_path}/shards")
    assert len(back.inputFiles()) == 2  # 200 shards by hundreds; one file for each task and shard before
    assert sorted(tuple(x) for x in back.select("event_id", "local_index", "shard_index").collect()) == [(i, i % 10, i // 10) for i in range(2000)]
    per_file = back.select(F.input_file_name().alias("f"), "shard_index").groupBy("shard_index").agg(F.countDistinct("f").alias("n"))
    assert per_file.agg(F.max("n")).first()[0] == 1


def test_maps_lie_whole_in_few_files(spark):
    back = registry.queries()["s02_read_map_keyframes"](spark, "/root/testdata/sf0.001")
    videos = back.select("video_id", F.input_file_name().alias("f")).groupBy("video_id").agg(F.countDistinct("f").alias("n"))
    assert len(back.inputFiles()) <= 4 < videos.count() and videos.agg(F.max("n")).first()[0] == 1


def test_annotations_keep_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"keyframe_id": "k", "texts": ["a"], "object_counts": {"car": 2}}\n{broken\n\n')
    good, bad = s.read_annotations(spark, str(tmp_path))
    assert good.first().object_counts == {"car": 2} and bad.first().value == "{broken"


def test_vectors(spark, tmp_path):
    np.save(tmp_path / "V1.npy", np.eye(3, dtype=np.float32))
    np.save(tmp_path / "V2.npy", np.zeros(3, np.float32))
    rows = s.read_vectors(spark, str(tmp_path)).orderBy("index").collect()
    assert [(r["video_id"], r["index"], r["embedding"]) for r in rows] == [("V1", i, np.eye(3)[i].tolist()) for i in range(3)]


def test_ground_truth(spark, tmp_path):
    (tmp_path / "g.csv").write_text('query_id,answer\nq1-kis,"V1, 10\nV2,20"\nq2-trake,"V3,5"\n')
    rows = s.read_ground_truth(spark, str(tmp_path)).orderBy("query_id", "target").collect()
    assert [(r.kind, r.video, r.frame) for r in rows] == [("KIS", "V1", 10), ("KIS", "V2", 20), ("TRAKE", "V3", 5)]


def test_submission_cells_are_quoted(spark):
    rows = spark.createDataFrame([("q", "QA", 1, "V1", [3], 'a "b", c')], "query_name string, query_type string, rank int, video_code string, frame_indices array<int>, answer string")
    assert s.submission_lines(rows).first().line == 'V1,3,"a ""b"", c"'


def test_stream_takes_each_part_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "k long, part long, v string"
    for part, v in enumerate(("old", "new")):
        spark.createDataFrame([(1, part, v), (2 + part, part, v)], schema).write.mode("append").json(src)
        ingest.ingest_stream(spark, src, schema, "k", "part", out, ck).awaitTermination()
    assert sorted((r.k, r.v) for r in ingest.current(spark, out, "k", "part").collect()) == [(1, "new"), (2, "old"), (3, "new")]


def test_event_parsing(spark):
    cases = {
        "a dog after the rain and before the sun": ("context_relation", ["the rain", "a dog", "the sun"]), "E1: run E2: jump": ("event_labels", ["run", "jump"]), "1. run\n2. jump": ("numbered_lines", ["run", "jump"]),
        "run then jump; fall": ("soft_separators", ["run", "jump", "fall"]), " is running. ": ("single", ["running"]), "": ("empty", []),
        "E1: a man runs": ("single", ["a man runs"]), "một người sau   khi trời mưa và trước\tkhi nắng": ("context_relation", ["trời mưa", "một người", "nắng"]),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", fq.parse_events(F.col("t")).alias("e"))
    assert {r.t: (r.e.source, r.e.events) for r in df.collect()} == cases


def test_text_functions(spark):
    df = spark.createDataFrame([("Đường  phố Ñ-1", "go go go stop", "hÃ©llo", None)], "a string, b string, c string, d string")
    r = df.select(ft.fold_text("a").alias("f"), ft.collapse_repeats("b").alias("c"), ft.repair_mojibake("c").alias("m"), ft.tokenize(F.col("d")).alias("t")).first()
    assert r.f == "duong pho n 1" and tuple(r.c) == ("go stop", 1, 2, 4, 2) and r.m == "héllo" and r.t == []


def test_repeats_regardless_of_case_and_form(spark):
    cases = {"Go go GO stop": ("Go stop", 1, 2, 4, 2), "ﬁn fin FIN": ("ﬁn", 1, 2, 3, 1), "a b A B a b c": ("a b c", 1, 4, 7, 3), "a a b b": ("a a b b", 0, 0, 4, 4), "": ("", 0, 0, 0, 0)}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", ft.collapse_repeats("t").alias("c"))
    assert {r.t: tuple(r.c) for r in df.collect()} == cases


def test_lines_of_boxes(spark):
    """A box joins the first line that is near, not only the last, and the grown line's middle moves."""
    box = "array<struct<x:double,y:double,w:double,h:double,text:string>>"
    first = [(0.0, 0.0, 50.0, 20.0, "a"), (600.0, 5.0, 50.0, 20.0, "b"), (100.0, 10.0, 50.0, 20.0, "c"), (160.0, 38.0, 50.0, 20.0, "d")]
    df = spark.createDataFrame([(1, first), (2, []), (3, [(0.0, 0.0, 10.0, 10.0, "x"), (0.0, 50.0, 10.0, 10.0, "y")])], f"k int, b {box}").select("k", fq.merge_lines(F.col("b")).alias("lines"))
    got = {r.k: [tuple(x) for x in r.lines] for r in df.collect()}
    assert got[1] == [(0.0, 0.0, 210.0, 58.0, "a c d"), (600.0, 5.0, 650.0, 25.0, "b")] and got[2] == [] and [x[4] for x in got[3]] == ["x", "y"]


def test_model_answers(spark):
    cases = {
        '<think>{"scene": ["no"]}</think>```json\n{"subjects": ["a ", null, 5, " "], "scene": "street"}\n``` {"scene": "outside"}': (["a", "5"], ["street"], False),
        'text {"actions": 3, "scene": {"x": 1}} more': ([], [], False), '{"scene": ["x"]} <think>never closed {': ([], ["x"], False), "[1]": ([], [], True), "no object": ([], [], True), "{broken": ([], [], True),
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", fq.parse_model_json(F.col("t")).alias("f"))
    got = {r.t: (r.f.subjects, r.f.scene, r.f.failed) for r in df.collect()}
    assert got == cases | {None: ([], [], True)}


def test_refined_events(spark):
    long = "one goes in, then " + "two waits for a very long time at the old bridge " * 3 + "; finally three leaves"
    rows = [(1, k, long, 0.9) for k in range(1, 4)] + [(2, 1, "short then cut", 1.0), (2, 2, "x" * 200, 0.5), (2, 3, "then " + "y" * 200, 0.5)]
    got = {}
    for r in fq.refine_events(spark.createDataFrame(rows, "query_id int, event_index int, text string, weight double")).collect():
        got.setdefault((r.query_id, r.event_index), []).append((r.place, round(r.weight, 6), r.text))
    assert [len(got[1, k]) for k in (1, 2, 3)] == [3, 3, 2] and {w for _, w, _ in got[1, 1]} == {0.3} and {w for _, w, _ in got[1, 3]} == {0.45}
    assert sorted(got[1, 1])[0][2] == "one goes in" and sorted(got[1, 1])[2][2] == "three leaves"
    assert got[2, 1] == [(1, 1.0, "short then cut")] and got[2, 2] == [(2, 0.5, "x" * 200)] and got[2, 3] == [(3, 0.5, "then " + "y" * 200)]


def test_marks_of_misread_texts(spark):
    df = spark.createDataFrame([("Å¡",), ("trá»©ng",), ("plain",), ("Â",), (None,)], "t string").select(ft.repair_mojibake("t").alias("m"))
    assert [r.m for r in df.collect()] == ["š", "trứng", "plain", "Â", None]


def test_rerank_calls_the_model_in_batches_of_one_query(spark):
    rows = [(q, i, f"ask {q}" if q else None, None if i == 3 else f"ask {i} ask") for q in (0, 1, 2) for i in range(7)]
    pairs = spark.createDataFrame(rows, "query_id long, frame_id int, query string, passage string").coalesce(1)

    def make():
        def model(query, passages):
            assert len(passages) <= 3
            return [len(query) + len(p) for p in passages]

        return model

    got = {(r.query_id, r.frame_id): r.score for r in hooks.rerank(pairs, make, batch=3).collect()}
    assert got == {(q, i): len(a or "") + len(b or "") for q, i, a, b in rows}
    plain = {(r.query_id, r.frame_id): round(r.score, 6) for r in hooks.rerank(pairs).collect()}
    assert plain[1, 0] == round(1 / 2, 6) and plain[1, 3] == 0 and plain[0, 2] == 0
    assert hooks.overlap_reranker()("A dog, (a) dog!", ["dog dog", "cat"]) == [0.5, 0.0]


def test_submissions_read_back_as_written(spark, tmp_path):
    schema = "query_name string, query_type string, rank int, video_code string, frame_indices array<long>, answer string"
    rows = [
        ("a", "KIS", 1, "V1", [3], None), ("a", "KIS", 2, "V,2", [4], None), ("b", "QA", 1, "V1", [5], "42"), ("b", "QA", 2, "V1", [6], 'a "b", c'), ("b", "QA", 3, "V1", [7], ""), ("b", "QA", 4, "V2", [8], "two\nlines, \"x\ny\""),
        ("b", "QA", 5, "V3", [9], None), ("c", "TRAKE", 1, "V1", [1, 2, 3], None), ("c", "TRAKE", 2, "V9", [], None),
    ]
    df = spark.createDataFrame(rows, schema)
    s.write_submissions(df, str(tmp_path / "out"))
    got = s.read_submissions(spark, str(tmp_path / "out"), df.select("query_name", "query_type").distinct())
    want = [(n, r, v, f, "" if k == "QA" and a is None else a) for n, k, r, v, f, a in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_submissions_by_name_and_bad_cells(spark, tmp_path):
    for name, text in {"q1-qa": 'V1, 12 ,yes\r\n\r\nV2,x,"no, ""no"""\r\n', "q2-kis": "V1,7\nV2\n", "quality": "V1,1,2"}.items():
        (tmp_path / f"query_name={name}").mkdir()
        (tmp_path / f"query_name={name}" / "part.txt").write_text(text, newline="")
    got = sorted((tuple(r) for r in s.read_submissions(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(
        [("q1-qa", 1, "V1", [12], "yes"), ("q1-qa", 3, "V2", [None], 'no, "no"'), ("q2-kis", 1, "V1", [7], None), ("q2-kis", 2, "V2", [], None), ("quality", 1, "V1", [1, 2], None)], key=str
    )


def test_scores_of_answers_read_back(spark, tmp_path):
    """A QA submission that was written and read keeps its score."""
    rows = spark.createDataFrame([("q", "QA", 1, "V1", [5], "no"), ("q", "QA", 2, "V1", [5], "Yes, \"sir\"")], "query_name string, query_type string, rank int, video_code string, frame_indices array<long>, answer string")
    s.write_submissions(rows, str(tmp_path / "out"))
    got = s.read_submissions(spark, str(tmp_path / "out"), rows.select("query_name", "query_type").distinct())
    answers = got.select(F.col("query_name").alias("query_id"), "rank", F.col("video_code").alias("video"), F.col("frame_indices").alias("frames"), "answer")
    truth = spark.createDataFrame([("q", "QA", "V1", [(4, 6)], 'yes, "SIR"')], "query_id string, kind string, video string, ranges array<struct<start:long,end:long>>, answer string")
    assert [r.r for r in evaluation.r_scores(answers, truth).orderBy("rank").collect()] == [0.0, 1.0]


def test_large_tables_are_dealt_over_more_parts(spark, monkeypatch):
    rows = spark.range(1000).select((F.col("id") % 100).alias("k"), "id")
    assert views.dealt(rows, "k").rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    monkeypatch.setattr(views, "PART_ROWS", 50)
    more = views.dealt(rows, "k")
    assert more.rdd.getNumPartitions() == 20 and more.count() == 1000
    for name in ("w03_boundaries_to_shots", "p16_temporal_edges"):
        found = []
        for most in (10**9, 500):
            monkeypatch.setattr(views, "PART_ROWS", most)
            found.append(sorted(map(tuple, registry.queries()[name](spark, "/root/testdata/sf0.001").collect()), key=repr))
        assert found[0] == found[1]


def test_python_batches_are_bounded_by_bytes(spark):
    """Long texts come to Python some at a time, not ten thousand rows at once."""
    views.table(spark, "/root/testdata/sf0.001", "documents")

    @F.pandas_udf("long")
    def held(texts):
        return texts.map(lambda t: total) if (total := int(texts.str.len().sum())) else texts.str.len()

    long = spark.range(400, numPartitions=1).select(F.repeat(F.lit("x"), 50_000).alias("t"))
    assert long.select(held("t").alias("n")).agg(F.max("n")).first()[0] <= 5_000_000
