"""Frames round a time, against a plain search, over bucket edges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lumenreel.operators import joins as j


@pytest.mark.parametrize("bucket", [7, 10_000])
def test_around(spark, bucket):
    rng = random.Random(bucket)
    frames = [(v, 1000 * v + i, rng.randrange(40), rng.randrange(120)) for v in range(3) for i in range(12)] + [(5, 9000, 1, None)]
    asked = [(i, rng.randrange(7), rng.randrange(-20, 140)) for i in range(200)] + [(500, 1, None)]
    f = spark.createDataFrame(frames, "video_id long, keyframe_id long, frame_idx long, timestamp_ms long")
    r = spark.createDataFrame(asked, "request_id long, video_id long, timestamp_ms long")
    want = {}
    for i, v, t in asked:
        own = [(x, n, k) for w, k, n, x in frames if w == v and x is not None]
        if own and t is not None:
            later, earlier = [x for x in own if x[0] > t], [x for x in own if x[0] < t]
            want[i] = (min(own, key=lambda x: (abs(x[0] - t), x[1], x[2]))[2], min(later)[2] if later else None, max(earlier)[2] if earlier else None)
    got = j.seek_frame(r, f, bucket).collect()
    assert {x.request_id: (x.nearest_id, x.next_id, x.previous_id) for x in got} == want and len(got) == len(want)
    gaps = r.where("timestamp_ms is not null").select("request_id", "video_id", F.col("timestamp_ms").alias("a"), (F.col("timestamp_ms") + F.col("request_id") % 30).alias("b"))
    between = {}
    for i, v, t in asked:
        own = [(abs(x - t - (i % 30) / 2), n, k) for w, k, n, x in frames if t is not None and w == v and x is not None and t < x < t + i % 30]
        if own:
            between[i] = min(own)[2]
    assert {x.request_id: x.keyframe_id for x in j.nearest_between(gaps, f, bucket).collect()} == between
    assert j.seek_frame(r, f.limit(0)).count() == 0 == j.seek_frame(r.limit(0), f).count()
