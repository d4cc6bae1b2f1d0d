"""Queries on ordered multi-event search, and the same in SQL where it can be said."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenreel.operators import aggregates as a
from lumenreel.operators import sequences as s
from lumenreel.operators import video_first
from lumenreel.plans import views as v
from lumenreel.plans.common import register

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = register(QUERIES, SQL)

HOUR = 3_600_000
_PRUNED = f"""{v.CANDIDATES}, pr AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id, event_index ORDER BY score DESC, timestamp_ms, keyframe_id) AS n FROM candidates), p AS (SELECT * FROM pr WHERE n <= 12)"""
_CHAINS = f"""{_PRUNED}, chains AS (SELECT x.query_id, x.video_id, x.keyframe_id AS f1, y.keyframe_id AS f2, z.keyframe_id AS f3, x.score AS s1, y.score AS s2, z.score AS s3,
  x.timestamp_ms AS t1, y.timestamp_ms AS t2, z.timestamp_ms AS t3 FROM p x JOIN p y ON y.query_id = x.query_id AND y.video_id = x.video_id AND y.timestamp_ms > x.timestamp_ms AND y.timestamp_ms - x.timestamp_ms <= {12 * HOUR}
  JOIN p z ON z.query_id = y.query_id AND z.video_id = y.video_id AND z.timestamp_ms > y.timestamp_ms AND z.timestamp_ms - y.timestamp_ms <= {12 * HOUR} WHERE x.event_index = 1 AND y.event_index = 2 AND z.event_index = 3)"""


def ids(c: str = "members"):
    return F.transform(c, lambda m: m["keyframe_id"])


def full_chains(spark: SparkSession, sf_dir: str, compact: float = 0.0) -> DataFrame:
    return s.beam_search(v.candidates(spark, sf_dir), [0.2, 0.3, 0.5], 30, 12 * HOUR, min_match=3, per_event=12, compact=compact)


def partial_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.beam_search(v.candidates(spark, sf_dir), [0.2, 0.3, 0.5], 30, 12 * HOUR, min_match=2, per_event=12)


@query(f"WITH {_PRUNED} SELECT query_id, video_id, event_index, keyframe_id FROM p")
def q02_prune_per_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.prune(v.candidates(spark, sf_dir), 12).select("query_id", "video_id", "event_index", "keyframe_id")


@query(f"WITH {_CHAINS} SELECT query_id, video_id, [f1, f2, f3] AS frames, round((0.2 * s1 + 0.3 * s2 + 0.5 * s3) / 3, 6) AS score FROM chains")
def q03_beam_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 400 chains of each video of three events within twelve hours each; its SQL holds while no video has more."""
    return full_chains(spark, sf_dir).select("query_id", "video_id", ids().alias("frames"), F.round("score", 6).alias("score"))


@query()
def q03_beam_search_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partial_chains(spark, sf_dir).select("query_id", "video_id", ids().alias("frames"), "matched", F.round("score", 6).alias("score"))


@query(f"WITH {_CHAINS} SELECT query_id, video_id, [f1, f2, f3] AS frames, round((0.2 * s1 + 0.3 * s2 + 0.5 * s3) / 3 * (1 - 0.4 * least(1, (t3 - t1) / (2.0 * {12 * HOUR}))), 6) AS score FROM chains")
def q04_compactness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_chains(spark, sf_dir, 0.4).select("query_id", "video_id", ids().alias("frames"), F.round("score", 6).alias("score"))


@query(
    f"""WITH {_CHAINS}, pairs AS (SELECT x.query_id FROM p x JOIN p y ON y.query_id = x.query_id AND y.video_id = x.video_id AND y.event_index > x.event_index
      AND y.timestamp_ms > x.timestamp_ms AND y.timestamp_ms - x.timestamp_ms <= {12 * HOUR}), c AS (SELECT query_id, count(*) AS n FROM chains GROUP BY 1), w AS (SELECT query_id, count(*) AS n FROM pairs GROUP BY 1)
    SELECT query_id, coalesce(c.n, w.n) AS sequences FROM c FULL JOIN w USING (query_id)"""
)
def q05_prefer_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that have a full chain keep only full ones."""
    return s.prefer_full(partial_chains(spark, sf_dir), 3).groupBy("query_id").agg(F.count(F.lit(1)).alias("sequences"))


@query()
def q06_sequence_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.sequence_nms(partial_chains(spark, sf_dir), 6 * HOUR).select("query_id", "video_id", ids().alias("frames"), "matched", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_PRUNED}, an AS (SELECT * FROM p WHERE event_index = 2),
    b AS (SELECT an.keyframe_id AS k, x.keyframe_id AS f, x.score AS s, row_number() OVER (PARTITION BY an.keyframe_id ORDER BY x.score - 0.1 * (an.timestamp_ms - x.timestamp_ms) / {12 * HOUR} DESC, x.timestamp_ms DESC) AS n
      FROM an JOIN p x ON x.query_id = an.query_id AND x.video_id = an.video_id AND x.event_index = 1 AND x.timestamp_ms < an.timestamp_ms AND an.timestamp_ms - x.timestamp_ms <= {12 * HOUR}),
    c AS (SELECT an.keyframe_id AS k, x.keyframe_id AS f, x.score AS s, row_number() OVER (PARTITION BY an.keyframe_id ORDER BY x.score - 0.1 * (x.timestamp_ms - an.timestamp_ms) / {12 * HOUR} DESC, x.timestamp_ms) AS n
      FROM an JOIN p x ON x.query_id = an.query_id AND x.video_id = an.video_id AND x.event_index = 3 AND x.timestamp_ms > an.timestamp_ms AND x.timestamp_ms - an.timestamp_ms <= {12 * HOUR})
    SELECT query_id, video_id, keyframe_id AS anchor_id, list_filter([b.f, keyframe_id, c.f], lambda x: x IS NOT NULL) AS frames, round(score + 0.2 * coalesce(b.s, 0) + 0.5 * coalesce(c.s, 0), 6) AS score
    FROM an LEFT JOIN (SELECT * FROM b WHERE n = 1) b ON b.k = keyframe_id LEFT JOIN (SELECT * FROM c WHERE n = 1) c ON c.k = keyframe_id"""
)
def q07_anchor_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = s.anchor_search(v.candidates(spark, sf_dir), [0.2, 0.3, 0.5], 2, 30, 12 * HOUR, per_event=12, penalty=0.1)
    return f.select("query_id", "video_id", "anchor_id", ids().alias("frames"), F.round("score", 6).alias("score"))


@query()
def q08_anchor_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = s.anchor_search(v.candidates(spark, sf_dir), [0.2, 0.3, 0.5], 2, 30, 12 * HOUR, per_event=12, penalty=0.1, window_ms=3 * HOUR)
    return f.select("query_id", "video_id", "anchor_id", ids().alias("frames"), F.round("score", 6).alias("score"))


@query()
def q09_diversify_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = s.diversify(partial_chains(spark, sf_dir), 1, anchor=2, gap_ms=HOUR)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 8)), F.desc("matched"), "video_id", ids())
    return d.select("query_id", "video_id", ids().alias("frames"), F.round("score", 6).alias("score"), F.row_number().over(w).alias("rank"))


@query(
    f"""WITH {_CHAINS} SELECT query_id, video_id, [f1, f2, f3] AS frames, round(greatest(0, least(1, (0.55 * (s1 + s2 + s3) / 3 + 0.20 + 0.10 * (CAST(s1 >= 0.55 AS INT) + CAST(s2 >= 0.55 AS INT) + CAST(s3 >= 0.55 AS INT)) / 3.0
      + 0.05 - 0.10 * least(1, (t3 - t1) / 2.0 / {6 * HOUR})) / 1.10)), 6) AS score FROM chains"""
)
def q10_video_first_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.dev_score(full_chains(spark, sf_dir), 3, [2, 3], gap_ms=6 * HOUR).select("query_id", "video_id", ids().alias("frames"), F.round("score", 6).alias("score"))


@query()
def q11_beam_with_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A beam of 200 under a limit for each pair of events: twelve hours to a neighbour, a day across one."""

    def limit(a, b):
        return F.when(b["event_index"] - a["event_index"] == 1, F.lit(12 * HOUR)).otherwise(F.lit(24 * HOUR))

    f = s.beam_search(v.candidates(spark, sf_dir), [1.0, 1.0, 1.0], 30, 24 * HOUR, min_match=2, per_event=24, beam=200, edges=limit)
    return s.dev_score(f, 3, [3], gap_ms=6 * HOUR).select("query_id", "video_id", ids().alias("frames"), F.round("score", 6).alias("score"))


@query()
def q13_video_first_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe all events, choose videos, retrieve once more in them, and complete: every third query asks for all three events."""
    c = v.candidates(spark, sf_dir)
    asked = F.when(F.col("query_id") % 3 == 0, 3).cast("int")
    events = c.select("query_id", "event_index").distinct().select(
        "query_id", "event_index", F.lit(1.0).alias("weight"), (F.col("event_index") / 3.0).alias("prior"), asked.alias("requested")
    )
    plan = video_first.Plan(first_k=40, most_k=80, least_candidates=20, max_gap=24 * HOUR, probe_gap=HOUR, candidate_gap=HOUR)
    found = video_first.video_first(c, events, [1.0, 1.0, 1.0], plan)
    return found.select("query_id", "video_id", "keyframe_id", "frames", "matched", F.round("score", 6).alias("score"), "stage", "rank")


@query(
    """SELECT o_orderkey AS query_id, CAST(least(n, greatest(1, coalesce(requested, CASE WHEN kind = 'TRAKE' THEN n WHEN least_candidates < 24 OR confidence < 0.35 THEN 1 ELSE greatest(2, ceil(0.6 * n)) END))) AS INTEGER) AS min_match
    FROM (SELECT o_orderkey, 1 + o_custkey % 8 AS n, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 4 END AS requested, CASE WHEN o_orderstatus = 'P' THEN 'TRAKE' ELSE 'KIS' END AS kind, o_custkey % 60 AS least_candidates, (o_orderkey % 100) / 100.0 AS confidence FROM orders)"""
)
def q14_resolve_min_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = v.table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    q = o.select(
        k.alias("query_id"), (1 + c % 8).alias("n_events"), F.when(k % 5 == 0, k % 4).alias("requested"), F.when(F.col("o_orderstatus") == "P", "TRAKE").otherwise("KIS").alias("kind"),
        (c % 60).alias("least_candidates"), ((k % 100) / 100.0).alias("confidence"),
    )
    return s.resolve_min_match(q).select("query_id", "min_match")


@query(
    f"""WITH {_CHAINS}, pm AS (SELECT query_id, video_id, max((0.2 * s1 + 0.3 * s2 + 0.5 * s3) / 3) AS score FROM chains GROUP BY 1, 2), fb AS (SELECT query_id, video_id, max(score) * 0.1 AS score FROM candidates GROUP BY 1, 2),
    u AS (SELECT * FROM pm UNION ALL SELECT * FROM fb WHERE (query_id, video_id) NOT IN (SELECT (query_id, video_id) FROM pm)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, video_id) AS rank FROM u)
    SELECT query_id, video_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 30"""
)
def q15_complete_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    pm = full_chains(spark, sf_dir).groupBy("query_id", "video_id").agg(F.max("score").alias("score"))
    fb = v.candidates(spark, sf_dir).groupBy("query_id", "video_id").agg((F.max("score") * 0.1).alias("score"))
    return s.complete(pm, fb, 30).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {v.CANDIDATES}, pa AS (SELECT x.keyframe_id AS a, y.keyframe_id AS b, x.event_index AS i, y.event_index AS j, x.timestamp_ms AS s, y.timestamp_ms AS t FROM candidates x JOIN candidates y USING (query_id, video_id) WHERE x.event_index < y.event_index)
    SELECT a, b, t > s AND (CASE WHEN j - i = 1 THEN {6 * HOUR} END IS NULL OR t - s <= CASE WHEN j - i = 1 THEN {6 * HOUR} END) AS valid FROM pa"""
)
def q16_edge_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = v.candidates(spark, sf_dir).select("query_id", "video_id", "event_index", "keyframe_id", "timestamp_ms")
    side = lambda p, e: c.select("query_id", "video_id", F.col("event_index").alias(e), F.col("keyframe_id").alias(p), F.col("timestamp_ms").alias(f"{p}_ms"))
    pairs = side("from", "from_event").join(side("to", "to_event"), ["query_id", "video_id"]).where("from_event < to_event")
    limits = spark.createDataFrame([(1, 2, 6 * HOUR), (2, 3, 6 * HOUR), (1, 3, None)], "from_event int, to_event int, max_gap_ms long")
    return s.valid_edges(pairs, limits).select(F.col("from").alias("a"), F.col("to").alias("b"), "valid")


@query(f"WITH {_CHAINS} SELECT query_id, video_id, f2 AS keyframe_id, [f1, f2, f3] AS frames, round((s1 + s2 + s3) / 3, 6) AS mean_score FROM chains")
def q17_sequence_to_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = s.to_result(full_chains(spark, sf_dir), "TRAKE")
    return r.select("query_id", "video_id", "keyframe_id", "frames", F.round("mean_score", 6).alias("mean_score"))


@query()
def t13_diversify_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.diversify_frames(v.candidates(spark, sf_dir).drop("event_index"), 2, HOUR, 2).select("query_id", "keyframe_id", "place")


@query(
    f"""WITH {v.CANDIDATES}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, timestamp_ms, keyframe_id) AS n FROM candidates)
    SELECT query_id, keyframe_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n > 1, score DESC, frame_idx DESC, keyframe_id) AS INTEGER) AS place FROM b"""
)
def t13_diversify_frames_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one frame a video it is a plain ranking."""
    return s.diversify_frames(v.candidates(spark, sf_dir).drop("event_index"), 1, HOUR, 2).select("query_id", "keyframe_id", "place")


@query()
def t14_nms_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.nms(v.candidates(spark, sf_dir), ["query_id", "event_index", "video_id"], 4 * HOUR, 1, 12).select("query_id", "event_index", "keyframe_id")


@query()
def t15_diverse_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = v.candidates(spark, sf_dir)
    scores = c.groupBy("query_id", "video_id").agg(F.sum("score").alias("total"))
    importance = c.select("query_id", "event_index", (F.col("event_index") * 1.0).alias("weight")).distinct()
    return s.diverse_videos(c, scores, importance, 5, 40)
