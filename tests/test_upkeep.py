"""Writes in place, preflight counts, the quality gate and promotions, on small tables worked out by hand."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from lumenreel.operators import aggregates, preflight
from lumenreel.sources import in_place

ROW = "k long, v string, part string"


def files(path: Path) -> dict[str, set[str]]:
    return {p.name: {f.name for f in p.glob("*.parquet")} for p in path.iterdir() if p.is_dir()}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upsert_touches_only_its_partitions(spark, tmp_path):
    path = tmp_path / "t"
    spark.createDataFrame([(1, "a", "x y"), (2, "b", "x y"), (3, "c", "z/1"), (4, "d", "w"), (5, "e", None), (6, "f", "u")], ROW).write.partitionBy("part").parquet(str(path))
    before = files(path)
    updates = spark.createDataFrame([(1, "A", "w", 1), (1, "AA", "w", 2), (3, "C", "w", 1), (9, "new", "n", 1), (None, "lost", "w", 1)], ROW + ", at int")
    counts = in_place.upsert_partitions(spark, str(path), updates, "k", "part", "at")
    assert rows(counts) == sorted([("w", "kept", 1), ("w", "updated", 2), ("x y", "kept", 1), ("n", "inserted", 1)], key=str)
    got = rows(spark.read.parquet(str(path)).select("k", "v", "part"))
    assert got == sorted([(1, "AA", "w"), (2, "b", "x y"), (3, "C", "w"), (4, "d", "w"), (5, "e", None), (6, "f", "u"), (9, "new", "n")], key=str)
    after = files(path)
    assert after["part=u"] == before["part=u"] and after["part=__HIVE_DEFAULT_PARTITION__"] == before["part=__HIVE_DEFAULT_PARTITION__"]
    assert not any(name.startswith("part=z") for name in after)  # its only key moved away
    again = in_place.upsert_partitions(spark, str(path), updates, "k", "part", "at")
    assert rows(again.where("state = 'inserted'")) == [] and rows(spark.read.parquet(str(path)).select("k", "v", "part")) == got


def test_insert_only_and_null_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", None), (2, "b", "x")], ROW).write.partitionBy("part").parquet(path)
    updates = spark.createDataFrame([(1, "A", "x", 1), (3, "c", None, 1)], ROW + ", at int")
    in_place.upsert_partitions(spark, path, updates, "k", "part", "at", insert_only=True)
    assert rows(spark.read.parquet(path).select("k", "v", "part")) == sorted([(1, "a", None), (2, "b", "x"), (3, "c", None)], key=str)


def test_replace_keeps_other_partitions(spark, tmp_path):
    path = tmp_path / "t"
    in_place.replace_partitions(spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], ROW), str(path), "part")
    before = files(path)
    in_place.replace_partitions(spark.createDataFrame([(7, "z", "y")], ROW), str(path), "part")
    assert rows(spark.read.parquet(str(path)).select("k", "v", "part")) == [(1, "a", "x"), (7, "z", "y")]
    assert files(path)["part=x"] == before["part=x"] and files(path)["part=y"] != before["part=y"]


def test_preflight(spark):
    t = spark.createDataFrame
    present = preflight.presence(
        t([("V1", 0, 5, True, "V1/5.jpg"), ("V1", 0, 5, True, "V1/5.jpg"), ("V1", 1, 9, False, "V1/9.jpg"), (" ", 2, 3, True, "?"), (None, 2, 3, True, "?")], "video_id string, shot int, frame int, saved boolean, image string"),
        t([("V2/1.jpg",), ("V2/2.jpg",)], "image string"), t([("a.jsonl", "{}"), ("a.jsonl", " "), ("b.jsonl", None)], "file string, line string"),
        t([("V1",), ("V2",), ("V3",), ("",)], "video_id string"), t([("V1", 1, 1), ("V1", 2, 3), ("V2", 1, 1), ("V9", 1, 2)], "video_id string, line int, n int"), t([("V1",), ("V1",), ("V9",)], "video_id string"),
        t([("E1",), ("E1",), ("E2",)], "name string"), t([("E1",), ("E1",), ("E3",)], "name string"),
    )
    assert preflight.preflight_metrics(present).first().asDict() == {
        "per_video_rows": 4, "shot_rows": 5, "saved_keyframe_rows": 2, "unique_shots": 2, "unique_keyframes": 2, "media_files": 2, "missing_media_count": 2, "annotations_rows": 1, "annotations_files_count": 2,
        "map_rows_total": 2, "vector_rows_total": 2, "map_n_sequential_mismatch_rows": 1, "missing_map_files_count": 1, "missing_feature_files_count": 1, "event_mapping_rows": 3, "event_embedding_rows": 2,
        "missing_event_feature_files_count": 1, "event_embedding_parity": False,
    }
    assert rows(preflight.preflight_samples(present)) == sorted(
        [("missing_media", "V1/5.jpg", 1), ("missing_map_files", "V3", 1), ("missing_feature_files", "V2", 1), ("missing_event_feature_files", "E2", 1)], key=str
    )
    assert preflight.preflight_metrics(present.limit(0)).first().event_embedding_parity is True


SHOT = "row_id int, video_id string, keyframe_id string, profile_version string, saved string, frame_idx string, shot_start string, shot_end string"


def test_quality_gate(spark):
    t = spark.createDataFrame
    planned, errors = t([("V1",), ("V2",), ("V3",)], "video_id string"), t([("V2",)], "video_id string")
    good = (1, "V1", "k1", "p", "True", "5", "0", "9")
    shots = t([good, (2, "V1", "k1", "p", "1", "10", "0", "9"), (3, "V1", "k3", "q", "no", "x", "0", "9"), (4, "V1", "k4", None, "1", "5", "0", "9"), (5, "V1", "k5", "p", None, None, "0", "9")], SHOT)
    found = preflight.quality_violations(planned, shots, errors, "p")
    want = [
        ("duplicate_keyframe", "V1", 2), ("outside_shot", "V1", 2), ("profile", "V1", 3), ("unsaved", "V1", 3), ("bad_integer", "V1", 3), ("profile", "V1", 4), ("duplicate_frame", "V1", 4),
        ("unsaved", "V1", 5), ("bad_integer", "V1", 5), ("missing_result", "V3", None), ("error_row", "V2", None),
    ]
    assert rows(found) == sorted(want, key=str)
    v = preflight.quality_verdict(planned, shots, errors, found).first()
    assert (v.passed, v.failures, v.warnings, v.planned_videos, v.succeeded_videos, v.failed_videos, v.shot_rows, v.unique_keyframes) == (False, 11, 0, 3, 1, 1, 5, 4)
    clean = t([good], SHOT), t([], "video_id string")
    found = preflight.quality_violations(planned.limit(1), *clean, "p")
    assert found.count() == 0 and preflight.quality_verdict(planned.limit(1), *clean, found).first().passed
    none = preflight.quality_violations(planned.limit(0), shots.limit(0), errors.limit(0), "p")
    assert [r.rule for r in none.collect()] == ["no_rows"]
    # Against the intervals of the video, overlapping and one inside another.
    spans = t([("V1", 0, 4), ("V1", 1, 2), ("V1", 8, 20), ("V1", 30, 25), ("V2", 5, 5)], "video_id string, start int, end int")
    lone = preflight.quality_violations(planned, shots, errors, "p", spans).where("rule = 'outside_shot'")
    assert rows(lone) == [("outside_shot", "V1", 1), ("outside_shot", "V1", 4)]


def test_promotions(spark):
    t = spark.createDataFrame
    count = "version string, metric string, key string, rows long"
    of = lambda v, n, *sources: [(v, "documents", "all", n), *((v, "source", s, 1) for s in sources)]
    three = ("ocr", "asr", "caption")
    actual = t([*of("good", 3, *three), *of("next", 3, *three), *of("less", 2, "ocr", "asr"), *of("other", 4, *three), *of("new", 3, *three), *of("zero", 0)], count)
    expected = t([*of("good", 3, *three), *of("next", 3, *three), *of("less", 2, "ocr", "asr"), *of("other", 3, *three), *of("lost", 3, *three), *of("zero", 0)], count)
    reviews = preflight.review_manifests(actual, expected)
    assert {r.version: r.verdict for r in reviews.collect()} == {"good": "ok", "next": "ok", "less": "no_coverage", "other": "changed", "new": "not_reviewed", "lost": "gone", "zero": "empty"}
    pointers = t([("read", "good", "next"), ("lone", "good", None)], "alias string, version string, previous string")
    requests = t(
        [(1, "read", "promote", "less", "good"), (2, "read", "promote", "next", "old"), (3, "read", "promote", "next", "good"), (4, "read", "promote", "next", "good"), (5, "fresh", "promote", "good", None),
         (6, "lone", "rollback", None, "good"), (7, "next", "promote", "good", None), (8, "fresh", "promote", "good", "good"), (9, "else", "promote", "unknown", None)],
        "request_id int, alias string, action string, version string, expected string",
    )
    decided = preflight.decide_promotions(pointers, requests, reviews)
    assert {r.request_id: r.decision for r in decided.collect()} == {
        1: "no_coverage", 2: "stale", 3: "apply", 4: "stale", 5: "apply", 6: "nothing_before", 7: "alias_is_version", 8: "stale", 9: "not_reviewed"
    }
    moved = preflight.move_pointers(pointers, decided)
    assert rows(moved) == sorted([("read", "next", "good"), ("lone", "good", None), ("fresh", "good", None)], key=str)
    back = t([(1, "read", "rollback", None, "next")], requests.schema)
    assert rows(preflight.move_pointers(moved, preflight.decide_promotions(moved, back, reviews)).where("alias = 'read'")) == [("read", "good", "next")]


def test_inventory(spark):
    keys = ["L21/a/1.JPG", "L21/a/2.jpg", "L3/b.txt", "x/L30/c", "top.jpg"]
    objects = spark.createDataFrame([(k, 10 * (i + 1)) for i, k in enumerate(keys)], "object_key string, size long")
    got = {(r.grouping, r.key): r for r in aggregates.inventory(objects).collect()}
    whole = got["overview", None]
    assert (whole.objects, whole.bytes, whole.folders, whole.extensions, whole.levels, whole.deepest) == (5, 150, 4, 3, 3, 3)
    assert (got["extension", "jpg"].objects, got["extension", "jpg"].folders, got["extension", ""].bytes) == (3, 2, 40)
    assert sorted((r.place, k) for (g, k), r in got.items() if g == "level") == [(3, "L3"), (21, "L21"), (30, "L30"), (9999, "<not_detected>")]
    assert got["depth", "3"].objects == 3 and got["folder", "L21/a"].mean_bytes == 15.0 and got["folder", ""].objects == 1
    rough = aggregates.inventory(objects, approximate=True)
    assert rows(rough.select("grouping", "key", "objects", "folders")) == sorted(((g, k, r.objects, r.folders) for (g, k), r in got.items()), key=str)
    assert aggregates.inventory(objects.where(F.lit(False))).where("objects > 0").count() == 0
