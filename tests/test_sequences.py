"""Small cases of ordered multi-event search with results worked out by hand."""

from __future__ import annotations

from lumenreel.operators import sequences as s
from lumenreel.operators import windows as w

SCHEMA = "query_id long, event_index int, keyframe_id long, video_id long, frame_idx long, timestamp_ms long, score double"


def cands(spark, rows):
    return spark.createDataFrame([(1, e, k, v, f, t, x) for e, k, v, f, t, x in rows], SCHEMA)


def test_beam_score_divides_by_matched_members(spark):
    c = cands(spark, [(1, 1, 1, 10, None, 0.2), (2, 2, 1, 20, None, 0.9), (1, 3, 2, 10, None, 0.9), (2, 4, 2, 20, None, 0.2)])
    got = {r.video_id: (round(r.score, 6), [m.keyframe_id for m in r.members]) for r in s.beam_search(c, [0.1, 0.9], 30, min_match=2).collect()}
    assert got == {1: (0.415, [1, 2]), 2: (0.135, [3, 4])}


def test_beam_respects_gap_and_skips(spark):
    c = cands(spark, [(1, 1, 1, 10, None, 0.5), (2, 2, 1, 90, None, 0.5), (3, 3, 1, 35, None, 0.5)])
    got = sorted([m.keyframe_id for m in r.members] for r in s.beam_search(c, [1.0, 1.0, 1.0], 30, min_match=2).collect())
    assert got == [[1, 3]]
    assert s.beam_search(c, [1.0, 1.0, 1.0], 30, min_match=3).count() == 0


def test_anchor_takes_the_best_neighbours(spark):
    c = cands(spark, [(1, 1, 1, 10, None, 0.6), (2, 2, 1, 30, None, 0.7), (3, 3, 1, 50, None, 0.8), (4, 4, 1, 70, None, 0.9)])
    r = s.anchor_search(c, [1.0] * 4, 2, 30).collect()
    assert len(r) == 1 and [m.keyframe_id for m in r[0].members] == [1, 2, 3, 4] and round(r[0].score, 9) == 3.0


def test_nms_bound_is_exclusive_and_per_group(spark):
    c = cands(spark, [(1, 1, 1, 1, 1000, 0.9), (1, 2, 1, 2, 1100, 0.8), (1, 3, 1, 3, 1500, 0.7), (1, 4, 2, 4, 1100, 0.6)])
    assert sorted(r.keyframe_id for r in s.nms(c, ["query_id", "event_index", "video_id"], 500).collect()) == [1, 3, 4]
    assert sorted(r.keyframe_id for r in s.nms(c, ["query_id", "event_index", "video_id"], 0, cap=2).collect()) == [1, 2, 4]


def test_missing_times_use_frames(spark):
    c = cands(spark, [(1, 1, 1, 10, 400, 0.9), (1, 2, 1, 11, None, 0.8), (1, 3, 1, 15, None, 0.7)])
    assert sorted(r.keyframe_id for r in s.nms(c, ["query_id", "event_index", "video_id"], 500, 3).collect()) == [1, 3]


def test_empty_input(spark):
    c = cands(spark, [])
    assert s.beam_search(c, [1.0], 30).count() == 0 and s.anchor_search(c, [1.0, 1.0], 1, 30).count() == 0 and s.nms(c, ["query_id"], 5).count() == 0


def test_result_does_not_depend_on_partitions(spark):
    rows = [(1 + i % 3, i, i % 4, i * 7 % 50, i * 7 % 50 * 1000, (i * 37 % 101) / 101) for i in range(120)]
    got = [sorted((r.video_id, [m.keyframe_id for m in r.members], round(r.score, 9)) for r in s.beam_search(cands(spark, rows).repartition(n), [1.0, 2.0, 1.0], 30, 20_000, 2, 5, 50).collect()) for n in (1, 7)]
    assert got[0] == got[1] and got[0]


def test_segmentation_limits(spark):
    def events(rows):
        k = spark.createDataFrame([(1, i, t, v) for i, (t, v) in enumerate(rows)], "video_id long, keyframe_id long, seconds double, embedding array<double>")
        return [r.n for r in w.segment_events(k).orderBy("event_no").collect()]

    a, b = [1.0, 0.0], [0.0, 1.0]
    assert events([(0.0, a), (6.0, a), (12.0, a)]) == [3]
    assert events([(0.0, a), (6.1, a)]) == [1, 1]
    assert events([(0.0, a), (1.0, b)]) == [1, 1]
    assert events([(5.0 * i, a) for i in range(11)]) == [10, 1]


def test_shots(spark):
    b = spark.createDataFrame([(1, 3), (1, 3), (1, 20), (2, 99)], "video_id long, boundary long")
    v = spark.createDataFrame([(1, 30), (2, 4), (3, 7)], "video_id long, n_frames long")
    got = sorted((r.video_id, r.start, r.end) for r in w.boundaries_to_shots(b, v).collect())
    assert got == [(1, 4, 20), (1, 21, 29), (2, 0, 3), (3, 0, 6)]
