"""Runs of keyframes that are one event, against a plain fold, on odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lumenreel.operators.windows import segment_events

SCHEMA = "video_id long, keyframe_id long, seconds double, embedding array<float>"


def plain(rows, centroid):
    out = []
    for video in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == video), key=lambda r: (r[2] is None, r[2] or 0, r[1]))
        events, mean, before = [], None, None
        for _, k, t, x in own:
            z = np.array([np.nan if c is None else c for c in x or []], np.float32).astype(float)
            z = z / (np.sqrt(z @ z) or 1.0)
            near = bool(events) and t is not None and events[-1][4] is not None and len(z) == len(before) and len(z) > 0
            if near:
                m = mean / (np.sqrt(mean @ mean) or 1.0) if centroid else before
                near = t - events[-1][4] <= 6 and t - events[-1][3] <= 45 and bool(m @ z >= 0.72)
            if near:
                events[-1][2], events[-1][4], events[-1][5] = k, t, events[-1][5] + 1
                mean = mean + z
            else:
                events.append([video, k, k, t, t, 1])
                mean = z
            before = z
        out += [(e[0], i, *e[1:]) for i, e in enumerate(events)]
    return out


@pytest.mark.parametrize("centroid", [False, True])
def test_against_a_plain_fold(spark, centroid):
    rng = random.Random(7)
    rows, x = [], [1.0, 0.0, 0.0]
    for k in range(600):
        x = [c + rng.gauss(0, 0.35) for c in x]
        rows.append((k // 200, k, k * 1.5 + (9 if k % 50 == 0 else 0), x))
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 0.0], [1.0, 0.0], [float("nan"), 0.0, 0.0], [1.0, 0.0], [1.0, 0.1]]
    rows += [(9, 1000 + k, float(k), y) for k, y in enumerate(odd)]
    rows += [(9, 2000, None, [1.0, 0.0]), (9, 2001, None, [1.0, 0.0]), (8, 3000, 1.0, [1.0, 0.0]), (8, 3001, 7.0, [1.0, 0.0]), (8, 3002, 13.01, [1.0, 0.0])]
    rows += [(7, 4000 + k, 5.0 * k, [0.0, 2.0]) for k in range(12)]
    # small batches, so that events run over their edges
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted(tuple(r) for r in segment_events(spark.createDataFrame(rows, SCHEMA), centroid).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = sorted(plain(rows, centroid))
    assert got == want and max(r[-1] for r in got) > 3
    assert [r[-1] for r in got if r[0] == 7] == [10, 2] and [r[-1] for r in got if r[0] == 8] == [2, 1]
    assert segment_events(spark.createDataFrame([], SCHEMA), centroid).count() == 0
