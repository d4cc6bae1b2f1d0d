"""Search that finds videos first and sequences in them: a probe of all events, a second retrieval, and completion."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.operators import aggregates as a
from lumenreel.operators import ranking as r
from lumenreel.operators import sequences as s
from lumenreel.sources.scratch import shared_path

#: (allowed: query_id, event_index, video_id; k) -> the k best candidates of each query and event among the allowed videos.
Retrieve = Callable[[DataFrame, int], DataFrame]


@dataclass(frozen=True)
class Plan:
    """How a search goes on. The defaults are those surveyed (fixed values); gaps are in milliseconds."""

    top_k: int = 20
    probe_k: int = 40
    anchors: int = 2
    output_buffer: int = 10
    videos: int = 18
    most_videos: int = 100
    videos_per_event: int = 2
    first_k: int = 200
    most_k: int = 400
    least_candidates: int = 20
    probe_gap: int = 2_500
    candidate_gap: int = 1_500
    per_event: int = 12
    match_ratio: float = 0.5
    most_default_match: int = 2
    confidence_floor: float = 0.35
    frame_gap: int = 30
    max_gap: int = 45_000
    beam: int = 200
    anchor_event: int | None = None


def _stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder: later steps read it several times."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table_retrieval(hits: DataFrame) -> Retrieve:
    """Retrieval from a table of scored frames."""

    def retrieve(allowed: DataFrame, k: int) -> DataFrame:
        own = hits.join(allowed, ["query_id", "event_index", "video_id"], "left_semi")
        return r.top(own, ["query_id", "event_index"], [F.desc("score"), F.asc("keyframe_id")], k).drop("rank")

    return retrieve


def local_candidates(chosen: DataFrame, events: DataFrame, retrieve: Retrieve, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """Candidates of the chosen videos (query_id, video_id), and of each event their number and whether it was widened.

    What the first retrieval yields decides about the second: only queries and events with fewer than least_candidates are
    asked for once more, with most_k, and what they got first is replaced.
    """
    allowed = events.select("query_id", "event_index").join(chosen.select("query_id", "video_id"), "query_id")
    first = _stored(retrieve(allowed, plan.first_k), "first-retrieval")
    counts = first.groupBy("query_id", "event_index").agg(F.count(F.lit(1)).alias("n"))
    yielded = events.select("query_id", "event_index").join(counts, ["query_id", "event_index"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    short = yielded.where((F.col("n") < plan.least_candidates) & F.lit(plan.most_k > plan.first_k)).select("query_id", "event_index")
    second = retrieve(allowed.join(short, ["query_id", "event_index"], "left_semi"), plan.most_k)
    every = first.join(short, ["query_id", "event_index"], "left_anti").unionByName(second)
    kept = _stored(s.nms(every, ["query_id", "video_id", "event_index"], plan.candidate_gap, 1, plan.per_event), "local-candidates")
    after = kept.groupBy("query_id", "event_index").agg(F.count(F.lit(1)).alias("kept"))
    told = yielded.join(short.withColumn("widened", F.lit(True)), ["query_id", "event_index"], "left").join(after, ["query_id", "event_index"], "left")
    return kept, told.select("query_id", "event_index", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("widened", F.lit(False)).alias("widened"))


def required_matches(events: DataFrame, yields: DataFrame, plan: Plan) -> DataFrame:
    """query_id, n_events and min_match: requested, else the ratio of the events, two at least and most_default_match at most;
    one where an event has few candidates or the planner was unsure. events: query_id, event_index, prior, requested."""
    d = events.join(yields, ["query_id", "event_index"]).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.max("requested").alias("requested"), F.min("kept").alias("least"),
        F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prior")))).alias("sure"),
    )
    n = F.col("n_events")
    share = F.greatest(F.lit(1), F.ceil(n * plan.match_ratio))
    guarded = F.when(n > 1, F.greatest(F.lit(2), F.least(share, F.lit(max(2, plan.most_default_match))))).otherwise(share)
    weak = (F.col("least") < plan.least_candidates) | (F.col("sure") < plan.confidence_floor)
    default = F.when(weak, F.least(guarded, F.lit(1))).otherwise(guarded)
    return d.select("query_id", "n_events", F.coalesce("requested", default).cast("int").alias("min_match"))


def video_first(hits: DataFrame, events: DataFrame, weights: list[float], plan: Plan | None = None, retrieve: Retrieve | None = None) -> DataFrame:
    """The top_k sequences of each query, one a video: query_id, video_id, keyframe_id, frames, matched, score, stage, rank.

    hits: query_id, event_index, keyframe_id, video_id, frame_idx, timestamp_ms, score. events: query_id, event_index, weight, prior,
    requested (of the whole query, or null). weights: of the events, by number. stage tells where a sequence came from: local
    (enough events, in the chosen videos), partial (fewer, where a query has no more than top_k local ones), global (from the
    probe's candidates, where it still has fewer than top_k).
    """
    plan = plan or Plan()
    retrieve = retrieve or table_retrieval(hits)
    n = len(weights)
    probe_k = max(plan.probe_k, plan.top_k + plan.output_buffer)
    probes = _stored(r.top(hits, ["query_id", "event_index"], [F.desc("score"), F.asc("keyframe_id")], probe_k).drop("rank"), "probes")
    diagnostic = a.diagnostic_events(a.event_probe(probes, probe_k), events.select("query_id", "event_index", "prior"), plan.anchors).select("query_id", "event_index")
    diagnostic = _stored(diagnostic, "diagnostic-events")
    told = probes.join(diagnostic, ["query_id", "event_index"], "left_semi")
    apart = s.nms(told, ["query_id", "video_id", "event_index"], plan.probe_gap)
    seeds = _stored(probes.join(diagnostic, ["query_id", "event_index"], "left_anti").unionByName(apart), "seeds")
    importance = events.select("query_id", "event_index", "weight")
    scores = a.cross_event_scores(seeds, importance, diagnostic).withColumnRenamed("score", "total")
    limit = min(max(plan.videos, plan.most_videos), max(plan.videos, plan.top_k + plan.output_buffer))
    chosen = _stored(s.diverse_videos(seeds, scores, importance, plan.videos_per_event, limit), "chosen-videos")
    local, yields = local_candidates(chosen, events, retrieve, plan)
    need = _stored(required_matches(events, yields, plan), "required-matches")
    marks = diagnostic.groupBy("query_id").agg(F.collect_set("event_index").alias("told"))  # at most `anchors` of a query

    def found(candidates: DataFrame) -> DataFrame:
        every = s.beam_search(candidates, weights, plan.frame_gap, plan.max_gap, 1, plan.per_event, plan.beam)
        scored = s.dev_score(every.join(marks, "query_id", "left"), n, [], gap_ms=plan.max_gap)
        # The diagnostic events differ from query to query, so their part of the score is added here.
        hit = F.size(F.filter("members", lambda m: F.array_contains("told", m["event_index"]))) / F.greatest(F.lit(1), F.size("told"))
        scored = scored.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") + 0.05 / 1.1 * F.coalesce(hit, F.lit(0.0))))).drop("told")
        if plan.anchor_event is not None:
            scored = scored.where(F.exists("members", lambda m: m["event_index"] == plan.anchor_event))
        return scored

    def best_of_video(sequences: DataFrame) -> DataFrame:
        w = Window.partitionBy(*s.KEYS).orderBy(F.desc(F.round("score", 9)), F.desc("matched"), F.transform("members", lambda m: m["keyframe_id"]))
        return sequences.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    def counted(sequences: DataFrame) -> DataFrame:
        return need.join(sequences.groupBy("query_id").agg(F.count(F.lit(1)).alias("have")), "query_id", "left").withColumn("have", F.coalesce("have", F.lit(0)))

    def joined(sequences: DataFrame, more: DataFrame, stage: str) -> DataFrame:
        new = more.join(sequences.select(*s.KEYS), s.KEYS, "left_anti").withColumn("stage", F.lit(stage))
        return sequences.unionByName(new.select(*sequences.columns))

    in_chosen = _stored(found(local).join(need, "query_id"), "sequences")
    have = best_of_video(in_chosen.where("matched >= min_match")).withColumn("stage", F.lit("local")).drop("n_events", "min_match")
    few = counted(have).where((F.col("have") <= plan.top_k) & (F.col("min_match") > 1)).select("query_id")
    have = joined(have, best_of_video(in_chosen.drop("n_events", "min_match").join(few, "query_id", "left_semi")), "partial")
    have = _stored(have, "local-sequences")
    fewer = counted(have).where(F.col("have") < plan.top_k).select("query_id")
    have = joined(have, best_of_video(found(seeds.join(fewer, "query_id", "left_semi"))), "global")
    have = _stored(have, "all-sequences")
    events_of = F.transform("members", lambda m: m["event_index"])
    tiers = have.join(marks, "query_id", "left").withColumns(
        {"sequence_id": F.col("video_id"), "missing": -(F.lit(n) - F.size("members")) / n, "diagnostic": F.size(F.array_intersect(events_of, "told")) / F.greatest(F.lit(1), F.size("told"))}
    )
    ranked = r.two_tier_rank(tiers.withColumn("diagnostic", F.coalesce("diagnostic", F.lit(0.0))), plan.top_k).where(F.col("rank") <= plan.top_k)
    shown = s.to_result(ranked, "KIS" if plan.anchor_event is not None else "DEV", plan.anchor_event or 1)
    return shown.join(ranked.select(*s.KEYS, "stage", "rank"), s.KEYS).select(*s.KEYS, "keyframe_id", "frames", "matched", "score", "stage", "rank")
