"""Ordered multi-event search: one frame for each event of a query, in order, inside one video.

candidates: query_id, event_index (from 1), keyframe_id, video_id, frame_idx, timestamp_ms (may be null), score.
A sequence's members are an array of structs in order of events. Searches are joins and windows by query and video;
each step keeps a bounded number of partial sequences for each.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["query_id", "video_id"]
MEMBER = "struct<event_index:int,keyframe_id:bigint,frame_idx:bigint,timestamp_ms:bigint,score:double>"


def place(row: Column | None = None) -> Column:
    """Where a candidate lies: its time, or its index where it has none."""
    get = (lambda c: row[c]) if row is not None else F.col
    return F.coalesce(get("timestamp_ms"), get("frame_idx"))


def distance(a: Column, b: Column) -> Column:
    timed = a["timestamp_ms"].isNotNull() & b["timestamp_ms"].isNotNull()
    return F.when(timed, F.abs(a["timestamp_ms"] - b["timestamp_ms"])).otherwise(F.abs(a["frame_idx"] - b["frame_idx"]))


def is_after(a: Column, b: Column) -> Column:
    timed = a["timestamp_ms"].isNotNull() & b["timestamp_ms"].isNotNull()
    return F.when(timed, a["timestamp_ms"] > b["timestamp_ms"]).otherwise(a["frame_idx"] > b["frame_idx"])


def gap_limit(a: Column, b: Column, frames: int, ms: int | None) -> Column:
    """The limit in ms applies to pairs that both have times, the limit in frames to all others."""
    if ms is None:
        return F.lit(frames)
    return F.when(a["timestamp_ms"].isNotNull() & b["timestamp_ms"].isNotNull(), F.lit(ms)).otherwise(F.lit(frames))


def prune(candidates: DataFrame, n: int) -> DataFrame:
    """The n best of each query, video and event; of equal scores the earlier."""
    w = Window.partitionBy(*KEYS, "event_index").orderBy(F.desc("score"), place(), "keyframe_id")
    return candidates.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max(1, n)).drop("_n")


def options(candidates: DataFrame) -> DataFrame:
    """One row for each query and video: options, a map from event index to its candidates."""
    member = F.struct(F.col("event_index").cast("int").alias("event_index"), "keyframe_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("timestamp_ms").cast("long").alias("timestamp_ms"), F.col("score").cast("double").alias("score"))
    per = candidates.groupBy(*KEYS, F.col("event_index").cast("int").alias("e")).agg(F.sort_array(F.collect_list(member)).alias("list"))
    return per.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("e", "list"))).alias("options"))


def compactness(gaps: Column, steps: Column, limit: Column, weight: float) -> Column:
    """1 - weight * min(1, mean gap / limit); sequences of one member keep their score."""
    ratio = F.least(F.lit(1.0), gaps / (steps * limit))
    return F.when((steps < 1) | (limit <= 0) | F.lit(weight <= 0), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - min(1.0, weight) * ratio))


def _with_score(seqs: DataFrame, frames: int, ms: int | None, weight: float) -> DataFrame:
    limit = F.when(F.col("timed"), F.lit(ms if ms is not None else frames)).otherwise(F.lit(frames))
    return seqs.withColumn("score", F.when(F.col("n") > 0, F.col("total") / F.col("n") * compactness(F.col("gaps"), F.col("n") - 1, limit, weight)).otherwise(0.0))


def beam_search(candidates: DataFrame, weights: list[float], frame_gap: int, ms_gap: int | None = None, min_match: int = 1, per_event: int = 12, beam: int = 400, compact: float = 0.0, edges: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Sequences over the events 1..len(weights), events may be left out: score = weighted sum / matched members.

    At each event a partial sequence goes on with a later candidate within the gap, of a frame it hasn't used, or
    without one while enough events are left for min_match; the `beam` best of each query and video stay. `edges`
    gives the largest gap of a pair of members in place of the common one (null: none).
    """
    n_events = len(weights)
    pool = options(prune(candidates, per_event))
    seqs = pool.select(
        *KEYS, "options", F.array().cast(f"array<{MEMBER}>").alias("members"), F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("gaps"), F.lit(True).alias("timed")
    )
    for e in range(1, n_events + 1):
        skip = F.array(F.lit(None).cast(MEMBER))
        seqs = seqs.withColumn("next", F.explode(F.concat(skip, F.coalesce(F.try_element_at("options", F.lit(e)), F.array().cast(f"array<{MEMBER}>")))))
        last, nxt = F.try_element_at("members", F.lit(-1)), F.col("next")
        limit = edges(last, nxt) if edges else gap_limit(nxt, last, frame_gap, ms_gap)
        fits = F.col("n").eqNullSafe(0) | (is_after(nxt, last) & (limit.isNull() | (distance(nxt, last) <= limit)) & ~F.exists("members", lambda m: m["keyframe_id"] == F.col("next.keyframe_id")))
        seqs = seqs.where(F.when(nxt.isNull(), F.col("n") + (n_events - e) >= min_match).otherwise(fits))
        grown = nxt.isNotNull()
        seqs = seqs.select(
            *KEYS, "options",
            F.when(grown, F.concat("members", F.array("next"))).otherwise(F.col("members")).alias("members"),
            F.when(grown, F.col("total") + weights[e - 1] * F.col("next.score")).otherwise(F.col("total")).alias("total"),
            F.when(grown, F.col("n") + 1).otherwise(F.col("n")).alias("n"),
            F.when(grown & (F.col("n") > 0), F.col("gaps") + distance(nxt, last)).otherwise(F.col("gaps")).alias("gaps"),
            F.when(grown, F.col("timed") & nxt["timestamp_ms"].isNotNull()).otherwise(F.col("timed")).alias("timed"),
        )
        seqs = _with_score(seqs, frame_gap, ms_gap, compact)
        tail = place(F.try_element_at("members", F.lit(-1)))
        w = Window.partitionBy(*KEYS).orderBy(F.desc(F.round("score", 8)), F.desc("n"), F.coalesce(tail, F.lit(0)), F.transform("members", lambda m: m["keyframe_id"]))
        seqs = seqs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= beam).drop("_r", "score")
    return _with_score(seqs.where(F.col("n") >= max(1, min_match)), frame_gap, ms_gap, compact).select(*KEYS, "members", F.col("n").alias("matched"), "score")


def anchor_search(candidates: DataFrame, weights: list[float], anchor: int, frame_gap: int, ms_gap: int | None = None, per_event: int = 12, penalty: float = 0.0, compact: float = 0.0, window_ms: int = 0, window_frames: int = 0) -> DataFrame:
    """For each candidate of the anchor event the best of each event before and after it, one after the other outwards.

    Best is score - penalty * distance / limit, of equal ones the nearest; score = anchor + weighted sum of the rest.
    """
    pool = options(prune(candidates, per_event))
    anchors = pool.withColumn("anchor", F.explode(F.try_element_at("options", F.lit(anchor))))
    if window_ms > 0 or window_frames > 0:
        kept = nms(anchors.select(*KEYS, "anchor.*"), [*KEYS], window_ms, window_frames)
        anchors = anchors.withColumn("keyframe_id", F.col("anchor.keyframe_id")).join(kept.select(*KEYS, "keyframe_id"), [*KEYS, "keyframe_id"], "left_semi").drop("keyframe_id")
    chain = anchors.withColumns({"members": F.array("anchor"), "edge": F.col("anchor"), "total": F.col("anchor.score")})

    def grow(df: DataFrame, e: int, later: bool) -> DataFrame:
        edge = F.col("edge")
        fits = lambda c: (is_after(c, edge) if later else is_after(edge, c)) & (distance(c, edge) <= gap_limit(c, edge, frame_gap, ms_gap))
        worth = lambda c: c["score"] - penalty * distance(c, edge) / F.greatest(F.lit(1), gap_limit(c, edge, frame_gap, ms_gap))
        near = lambda c: -place(c) if later else place(c)
        ranked = F.transform(F.filter(F.try_element_at("options", F.lit(e)), fits), lambda c: F.struct(worth(c).alias("w"), near(c).alias("p"), c.alias("c")))
        df = df.withColumn("best", F.array_max(ranked)["c"])
        found = F.col("best").isNotNull()
        joined = F.concat("members", F.array("best")) if later else F.concat(F.array("best"), "members")
        return df.withColumns(
            {
                "members": F.when(found, joined).otherwise(F.col("members")),
                "edge": F.coalesce("best", "edge"),
                "total": F.when(found, F.col("total") + weights[e - 1] * F.col("best.score")).otherwise(F.col("total")),
            }
        ).drop("best")

    for e in range(anchor - 1, 0, -1):
        chain = grow(chain, e, later=False)
    chain = chain.withColumn("edge", F.col("anchor"))
    for e in range(anchor + 1, len(weights) + 1):
        chain = grow(chain, e, later=True)
    pairs = F.zip_with(F.expr("slice(members, 1, size(members) - 1)"), F.expr("slice(members, 2, size(members))"), lambda a, b: distance(a, b))
    gaps = F.aggregate(F.filter(pairs, lambda d: d.isNotNull()), F.lit(0).cast("long"), lambda s, d: s + d)
    limit = F.when(F.forall("members", lambda m: m["timestamp_ms"].isNotNull()), F.lit(ms_gap if ms_gap is not None else frame_gap)).otherwise(F.lit(frame_gap))
    n = F.size("members")
    return chain.select(*KEYS, F.col("anchor.keyframe_id").alias("anchor_id"), "members", n.alias("matched"), (F.col("total") * compactness(gaps, n - 1, limit, compact)).alias("score"))


def prefer_full(sequences: DataFrame, n_events: int) -> DataFrame:
    """If a query has any sequence with all events, only those."""
    most = F.max("matched").over(Window.partitionBy("query_id"))
    return sequences.withColumn("_m", most).where((F.col("_m") < n_events) | (F.col("matched") == n_events)).drop("_m")


def nms(candidates: DataFrame, keys: list[str], gap_ms: int, gap_frames: int = 1, cap: int | None = None) -> DataFrame:
    """By falling score, rows nearer than the gap to a kept row of their group go; at most `cap` of a group stay.

    Distances are in frames where either row has no time. A group, one query's candidates of one video, is folded as
    a sorted array.
    """
    row = F.struct(*candidates.columns)
    best_first = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), place().alias("p"), "keyframe_id", row.alias("r"))))

    def near(a: Column, b: Column) -> Column:
        timed = a["timestamp_ms"].isNotNull() & b["timestamp_ms"].isNotNull()
        return F.when(timed, F.abs(a["timestamp_ms"] - b["timestamp_ms"]) < gap_ms).otherwise(F.abs(a["frame_idx"] - b["frame_idx"]) < gap_frames)

    rows = candidates.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(best_first.alias("all"))
    full = (lambda kept: F.size(kept) >= cap) if cap is not None else (lambda kept: F.lit(False))
    kept = F.aggregate("all", F.expr("slice(all, 1, 0)"), lambda kept, c: F.when(full(kept) | F.exists(kept, lambda k: near(k["r"], c["r"])), kept).otherwise(F.concat(kept, F.array(c))))
    return rows.select(F.explode(kept).alias("k")).select("k.r.*")


def sequence_nms(sequences: DataFrame, window_ms: int, window_frames: int = 1) -> DataFrame:
    """Of sequences of the same video and events whose members all lie within the window, the best. A window that isn't
    positive never drops any."""
    frames = F.transform("members", lambda m: m["keyframe_id"])
    key = F.struct((-F.round("score", 8)).alias("s"), (-F.col("matched")).alias("m"), frames.alias("f"), F.struct(*sequences.columns).alias("r"))

    def close(a: Column, b: Column) -> Column:
        timed = a["timestamp_ms"].isNotNull() & b["timestamp_ms"].isNotNull()
        limit = F.when(timed, F.lit(window_ms)).otherwise(F.lit(window_frames))
        return (a["event_index"] == b["event_index"]) & (limit > 0) & (distance(a, b) <= limit)

    def same(a: Column, b: Column) -> Column:
        pairs = F.zip_with(a["members"], b["members"], lambda x, y: F.coalesce(close(x, y), F.lit(False)))
        return (F.size(a["members"]) == F.size(b["members"])) & F.forall(pairs, lambda p: p)

    rows = sequences.groupBy(*[F.col(k).alias(f"_{k}") for k in KEYS]).agg(F.sort_array(F.collect_list(key)).alias("all"))
    kept = F.aggregate("all", F.expr("slice(all, 1, 0)"), lambda kept, c: F.when(F.exists(kept, lambda k: same(k["r"], c["r"])), kept).otherwise(F.concat(kept, F.array(c))))
    return rows.select(F.explode(kept).alias("k")).select("k.r.*")


def dev_score(sequences: DataFrame, n_events: int, diagnostic: list[int], weights: dict[str, float] | None = None, strong: float = 0.55, gap_ms: int = 45_000) -> DataFrame:
    """Evidence, coverage, strong members and diagnostic events add, missing events and wide gaps take away; the sum is
    divided by the sum of all six weights and kept within 0 and 1."""
    w = {"evidence": 0.55, "coverage": 0.20, "strong": 0.10, "diagnostic": 0.05, "missing": 0.10, "gap": 0.10} if weights is None else weights
    n = F.size("members").cast("double")
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda s, m: s + f(m))
    pairs = F.zip_with(F.expr("slice(members, 1, size(members) - 1)"), F.expr("slice(members, 2, size(members))"), lambda a, b: distance(a, b))
    gap = F.when(n > 1, F.least(F.lit(1.0), total(F.filter(pairs, lambda d: d.isNotNull()), lambda d: d.cast("double")) / (n - 1) / gap_ms)).otherwise(0.0)
    told = total("members", lambda m: m["event_index"].isin(diagnostic).cast("double")) / max(len(diagnostic), 1) if diagnostic else F.lit(0.0)
    value = (
        w["evidence"] * total("members", lambda m: m["score"]) / n + w["coverage"] * n / n_events + w["strong"] * total("members", lambda m: (m["score"] >= strong).cast("double")) / n
        + w["diagnostic"] * told - w["missing"] * (n_events - n) / n_events - w["gap"] * gap
    )
    return sequences.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / sum(w.values()))))


def complete(primary: DataFrame, fallback: DataFrame, k: int) -> DataFrame:
    """Results of videos that the first list lacks are appended; all are ranked anew and cut to k. Columns: query_id, video_id, score."""
    more = fallback.join(primary.select(*KEYS).distinct(), KEYS, "left_anti")
    every = primary.unionByName(more)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "video_id")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def resolve_min_match(queries: DataFrame, ratio: float = 0.6) -> DataFrame:
    """queries: query_id, kind, n_events, requested, least_candidates, confidence. Requested, else by kind: TRAKE all
    events; adaptive 1 where an event has few candidates or confidence is low; else max(2, ceil(ratio * n))."""
    n = F.col("n_events")
    by_kind = F.when(F.col("kind") == "TRAKE", n).when((F.col("least_candidates") < 24) | (F.col("confidence") < 0.35), F.lit(1)).otherwise(F.greatest(F.lit(2), F.ceil(ratio * n)))
    return queries.withColumn("min_match", F.least(n, F.greatest(F.lit(1), F.coalesce("requested", by_kind))).cast("int"))


def valid_edges(pairs: DataFrame, limits: DataFrame) -> DataFrame:
    """pairs: from_event, to_event, from_ms, to_ms; limits: from_event, to_event, max_gap_ms (null: any). Strictly later, within the limit."""
    j = pairs.join(limits, ["from_event", "to_event"], "left")
    ok = (F.col("to_ms") > F.col("from_ms")) & (F.col("max_gap_ms").isNull() | (F.col("to_ms") - F.col("from_ms") <= F.col("max_gap_ms")))
    return j.withColumn("valid", ok)


def to_result(sequences: DataFrame, kind: str, anchor: int = 1) -> DataFrame:
    """The frame that stands for a sequence: the anchor event's (KIS), the best one's (DEV), the middle one's (TRAKE)."""
    m = F.col("members")
    best = F.array_max(F.transform(m, lambda x: F.struct(x["score"].alias("s"), (-place(x)).alias("p"), x.alias("m"))))["m"]
    own = F.try_element_at(F.filter(m, lambda x: x["event_index"] == anchor), F.lit(1))
    chosen = {"KIS": F.coalesce(own, best), "DEV": best, "TRAKE": F.element_at(m, F.floor(F.size(m) / 2).cast("int") + 1)}[kind]
    mean = F.aggregate(m, F.lit(0.0), lambda s, x: s + x["score"]) / F.size(m)
    return sequences.select(*KEYS, chosen["keyframe_id"].alias("keyframe_id"), F.transform(m, lambda x: x["keyframe_id"]).alias("frames"), mean.alias("mean_score"), "matched", "score")


def diversify(sequences: DataFrame, per_video: int, anchor: int | None = None, gap_ms: int = 0, window_ms: int = 1_500) -> DataFrame:
    """Sequence NMS, then at most per_video of a video whose representative frames aren't nearer than the gap."""
    kept = sequence_nms(sequences, window_ms)
    m = F.col("members")
    best = F.array_max(F.transform(m, lambda x: F.struct(x["score"].alias("s"), (-place(x)).alias("p"), x.alias("m"))))["m"]
    shown = F.coalesce(F.try_element_at(F.filter(m, lambda x: x["event_index"] == F.lit(anchor or 0)), F.lit(1)), best)
    flat = kept.withColumn("shown", shown).select("*", *(F.col(f"shown.{c}").alias(c) for c in ("keyframe_id", "frame_idx", "timestamp_ms"))).drop("shown")
    return nms(flat, KEYS, gap_ms, 0, per_video).select(*sequences.columns)


def diversify_frames(ranked: DataFrame, per_video: int, gap_ms: int, gap_frames: int) -> DataFrame:
    """ranked: query_id, video_id, keyframe_id, frame_idx, timestamp_ms, score. Videos take turns, each with its next frame
    that is far enough from those it showed, up to per_video; all other frames follow in their order. Adds place.

    The turn of a frame is its number among its video's chosen ones, so the order is (turn, score) without any loop
    over the whole list.
    """
    chosen = nms(ranked, KEYS, gap_ms, gap_frames, per_video).select(*KEYS, "keyframe_id", "score")
    turn = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("score"), "keyframe_id"))
    turns = chosen.withColumn("turn", turn).drop("score")
    w = Window.partitionBy("query_id").orderBy(F.coalesce("turn", F.lit(2**30)), F.desc("score"), F.desc("frame_idx"), "keyframe_id")
    return ranked.join(turns, [*KEYS, "keyframe_id"], "left").withColumn("place", F.row_number().over(w)).drop("turn")


def diverse_videos(candidates: DataFrame, scores: DataFrame, importance: DataFrame, quota: int, limit: int) -> DataFrame:
    """Up to quota unseen videos for each event in order of importance, then the best by total score, `limit` in all.

    The best score of each query, event and video is all that goes on; a query's part of it is one group.
    """
    best = candidates.groupBy("query_id", "event_index", "video_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id", "event_index").orderBy(F.desc("score"), "video_id")
    few = best.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).join(importance, ["query_id", "event_index"])
    total = Window.partitionBy("query_id").orderBy(F.desc("total"), "video_id")
    filler = scores.withColumn("n", F.row_number().over(total)).where(F.col("n") <= limit)
    rows = few.select("query_id", "video_id", "n", "weight", "event_index").unionByName(filler.select("query_id", "video_id", "n", F.lit(-1.0).alias("weight"), F.lit(0).alias("event_index")))

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        seen: dict[int, int] = {}
        for (_, event), own in group.assign(_w=-group["weight"]).groupby(["_w", "event_index"], sort=True):
            fresh = [v for v in own.sort_values("n")["video_id"] if v not in seen]
            for video in fresh[: quota if event > 0 else limit]:
                if len(seen) < limit:
                    seen[video] = len(seen) + 1
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "video_id": list(seen), "place": list(seen.values())})

    return rows.groupBy("query_id").applyInPandas(pick, "query_id long, video_id long, place int")
