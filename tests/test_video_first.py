"""The video-first search: what is asked for twice, how many events must match, and where results come from."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenreel.operators import sequences as s
from lumenreel.operators import video_first as vf

HIT = "query_id long, event_index int, keyframe_id long, video_id long, frame_idx long, timestamp_ms long, score double"
EVENT = "query_id long, event_index int, weight double, prior double, requested int"


def test_diverse_videos_keep_the_quota(spark):
    """One event may not take all places: two unseen videos each, in order of importance, then the best by total."""
    best = {1: [1, 2, 3, 4, 5], 2: [2, 1, 6, 7, 8], 3: [9, 1, 2]}
    hits = [(1, e, 0, v, 0, 0, 1 - k / 10) for e, own in best.items() for k, v in enumerate(own)]
    scores = spark.createDataFrame([(1, v, 1 - v / 100) for v in range(1, 10)], "query_id long, video_id long, total double")
    importance = spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.9), (1, 3, 0.0)], "query_id long, event_index int, weight double")
    got = lambda limit: [r.video_id for r in s.diverse_videos(spark.createDataFrame(hits, HIT), scores, importance, 2, limit).orderBy("place").collect()]
    assert got(8) == [2, 1, 3, 4, 9, 5, 6, 7] and got(3) == [2, 1, 3]


def test_only_short_queries_are_asked_again(spark):
    plan = vf.Plan(first_k=3, most_k=6, least_candidates=4, candidate_gap=1)
    hits = spark.createDataFrame([(q, e, 100 * q + 10 * e + k, v, 1000 * k, None, 1 - k / 100) for q, e, n in ((1, 1, 9), (1, 2, 2), (2, 1, 1)) for k in range(n) for v in [k % 2]], HIT)
    events = spark.createDataFrame([(1, 1, 1.0, 0.5, None), (1, 2, 1.0, 0.5, None), (2, 1, 1.0, 0.5, None), (2, 2, 1.0, 0.5, None)], EVENT)
    chosen = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "query_id long, video_id long")
    asked = []
    real = vf.table_retrieval(hits)

    def retrieve(allowed, k):
        asked.append((k, {(r.query_id, r.event_index) for r in allowed.collect()}))
        return real(allowed, k)

    kept, yields = vf.local_candidates(chosen, events, retrieve, plan)
    assert asked == [(3, {(1, 1), (1, 2), (2, 1), (2, 2)}), (6, {(1, 1), (1, 2), (2, 1), (2, 2)})]
    assert {(r.query_id, r.event_index): (r.kept, r.widened) for r in yields.collect()} == {(1, 1): (6, True), (1, 2): (2, True), (2, 1): (1, True), (2, 2): (0, True)}
    asked.clear()
    _, yields = vf.local_candidates(chosen, events, retrieve, vf.Plan(first_k=3, most_k=6, least_candidates=3, candidate_gap=1))
    assert asked[1] == (6, {(1, 2), (2, 1), (2, 2)}) and not next(r.widened for r in yields.collect() if (r.query_id, r.event_index) == (1, 1))
    assert kept.count() == 9


def test_required_matches(spark):
    plan = vf.Plan(least_candidates=5)
    rows = [(1, e, 1.0, 0.8, None) for e in (1, 2, 3, 4, 5)] + [(2, e, 1.0, 0.8, None) for e in (1, 2)] + [(3, 1, 1.0, 0.8, None)] + [(4, e, 1.0, 0.1, None) for e in (1, 2)] + [(5, e, 1.0, 0.1, 3) for e in (1, 2, 3)]
    events = spark.createDataFrame(rows, EVENT)
    yields = events.select("query_id", "event_index", F.when((F.col("query_id") == 2) & (F.col("event_index") == 2), 4).otherwise(9).alias("kept"))
    got = {r.query_id: r.min_match for r in vf.required_matches(events, yields, plan).collect()}
    assert got == {1: 2, 2: 1, 3: 1, 4: 1, 5: 3}


def test_stages_of_completion(spark):
    """The chosen videos are 1 (best of event 1) and 3 (best unseen one of event 2): a whole sequence and a partial one; 2 and 4 are of the probe only."""
    hit = lambda e, v, at, score: (1, e, 1000 * v + 10 * e + at // 1000, v, at // 40, at, score)
    rows = [hit(1, 1, 0, 0.9), hit(2, 1, 5_000, 0.9), hit(1, 2, 0, 0.8), hit(2, 3, 0, 0.3), hit(1, 4, 0, 0.2)]
    events = spark.createDataFrame([(1, 1, 1.0, 0.9, 2), (1, 2, 0.5, 0.9, 2)], EVENT)
    plan = vf.Plan(top_k=3, output_buffer=0, probe_k=10, videos=2, most_videos=2, videos_per_event=1, least_candidates=1, anchors=1)
    hits = spark.createDataFrame(rows, HIT)
    limited = vf.Plan(**(plan.__dict__ | {"top_k": 2, "videos": 2}))
    got = {r.video_id: (r.stage, r.matched, r.rank) for r in vf.video_first(hits, events, [1.0, 1.0], limited).collect()}
    assert got == {1: ("local", 2, 1), 3: ("partial", 1, 2)}
    wide = vf.Plan(**(plan.__dict__ | {"top_k": 4, "videos": 2, "output_buffer": -2}))
    got = {r.video_id: (r.stage, r.matched) for r in vf.video_first(hits, events, [1.0, 1.0], wide).collect()}
    assert got == {1: ("local", 2), 3: ("partial", 1), 2: ("global", 1), 4: ("global", 1)}
    anchored = vf.Plan(**(wide.__dict__ | {"anchor_event": 2}))
    assert {r.video_id: r.keyframe_id for r in vf.video_first(hits, events, [1.0, 1.0], anchored).collect()} == {1: 1025, 3: 3020}
    assert vf.video_first(hits.limit(0), events, [1.0, 1.0], plan).count() == 0
