"""Scores of ranked results against ground truth, and comparisons of methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 5, 20, 50, 100)


def _plain(answer: Column) -> Column:
    return F.lower(F.coalesce(answer, F.lit("")))


def r_scores(results: DataFrame, truth: DataFrame) -> DataFrame:
    """results: query_id, rank, video, frames (array), answer; truth: query_id, kind, video, ranges (array of start, end), answer.

    KIS: a frame within the range; QA: the answer agrees too, regardless of case; TRAKE: the share of positions within their ranges.
    Another video scores 0. Only the first 100 count.
    """
    t = truth.select("query_id", "kind", F.col("video").alias("t_video"), "ranges", F.col("answer").alias("t_answer"))
    j = results.where("rank <= 100").join(t, "query_id")
    inside = F.zip_with("frames", "ranges", lambda f, r: F.coalesce(f.between(r["start"], r["end"]), F.lit(False)).cast("int"))
    hits = F.aggregate(inside, F.lit(0), lambda s, x: s + x)
    first = F.coalesce(F.element_at(inside, 1), F.lit(0)).cast("double")
    score = F.when(F.col("video") != F.col("t_video"), 0.0).when(F.col("kind") == "TRAKE", hits / F.size("ranges")).when(F.col("kind") == "QA", first * (_plain(F.col("answer")) == _plain(F.col("t_answer"))).cast("int")).otherwise(first)
    return j.select("query_id", "kind", "rank", F.coalesce(score, F.lit(0.0)).alias("r"))


def final_scores(scores: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """The mean over the cuts of the best score among the first k of each query."""
    best = [F.coalesce(F.max(F.when(F.col("rank") <= k, F.col("r"))), F.lit(0.0)) for k in cuts]
    return scores.groupBy("query_id").agg((sum(best) / len(cuts)).alias("score"))


def first_ranks(results: DataFrame, truth: DataFrame) -> DataFrame:
    """results: query_id, rank, video, frame, frames; truth: query_id, video, frame. First ranks of the right video, the
    exact frame, the frame within a sequence, and how near the nearest frame of the video comes."""
    t = truth.select("query_id", F.col("video").alias("t_video"), F.col("frame").alias("t_frame"))
    j = t.join(results, "query_id", "left")
    right = F.col("video") == F.col("t_video")
    rank = lambda c: F.min(F.when(c, F.col("rank")))
    return j.groupBy("query_id").agg(
        rank(right).alias("video_rank"), rank(right & (F.col("frame") == F.col("t_frame"))).alias("frame_rank"), rank(right & F.array_contains("frames", F.col("t_frame"))).alias("sequence_rank"),
        F.min(F.when(right, F.abs(F.col("frame") - F.col("t_frame")))).alias("nearest"),
    )


def recall_at(ranks: DataFrame, cuts: tuple[int, ...], group: str) -> DataFrame:
    """ranks: query_id, group, rank (null: not found). Share of queries found within each cut, by group and in all (null)."""
    each = ranks.select(group, "rank", F.explode(F.array(*map(F.lit, cuts))).alias("k"))
    hit = F.sum((F.coalesce(F.col("rank"), F.lit(2**30)) <= F.col("k")).cast("long"))
    out = [each.groupBy("k", group), each.withColumn(group, F.lit(None).cast(dict(ranks.dtypes)[group])).groupBy("k", group)]
    parts = [g.agg(hit.alias("found"), F.count(F.lit(1)).alias("queries")) for g in out]
    return parts[0].unionByName(parts[1]).withColumn("recall", F.col("found") / F.col("queries"))


def recall_mrr(results: DataFrame, expected: DataFrame) -> DataFrame:
    """results: query_id, rank, id; expected: query_id, id. Share of expected ids found and 1 / rank of the first."""
    n = expected.groupBy("query_id").agg(F.countDistinct("id").alias("n"))
    hit = results.join(expected, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.countDistinct("id").alias("found"), (1 / F.min("rank")).alias("mrr"))
    return n.join(hit, "query_id", "left").select("query_id", (F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall"), F.coalesce("mrr", F.lit(0.0)).alias("mrr"))


def latency_summary(samples: DataFrame, by: str, value: str) -> DataFrame:
    """n, median, least, most, and the 95th percentile by both customs: nearest rank (p95) and the item at floor(0.95 n) (p95_item)."""
    w = Window.partitionBy(by)
    d = samples.withColumns({"_i": F.row_number().over(w.orderBy(value)) - 1, "_n": F.count(F.lit(1)).over(w)})
    at = lambda i: F.max(F.when(F.col("_i") == i, F.col(value)))
    return d.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.percentile(value, F.lit(0.5)).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"),
        at(F.ceil(0.95 * F.col("_n")) - 1).alias("p95"), at(F.least(F.col("_n") - 1, F.floor(0.95 * F.col("_n")))).alias("p95_item"),
    )


def before_after(a: DataFrame, b: DataFrame, by: str, column: str) -> DataFrame:
    x, y = a.select(by, F.col(column).alias("before")), b.select(by, F.col(column).alias("after"))
    return x.join(y, by).withColumn("change_percent", 100 * (F.col("after") - F.col("before")) / F.col("before"))


def rank_band(rank: Column) -> Column:
    return F.when(rank <= 5, "1-5").when(rank <= 10, "6-10").when(rank <= 20, "11-20").when(rank <= 100, "21-100").otherwise("not found")


def rank_bands(ranks: DataFrame, method: str) -> DataFrame:
    """How many queries of each method lie in each band."""
    bands = ["1-5", "6-10", "11-20", "21-100", "not found"]
    return ranks.withColumn("band", rank_band(F.col("rank"))).groupBy(method).pivot("band", bands).agg(F.count(F.lit(1))).na.fill(0)


def method_delta(metrics: DataFrame, base: str) -> DataFrame:
    """metrics: method, k, recall. Difference of each other method to the base, for each k."""
    b = metrics.where(F.col("method") == base).select("k", F.col("recall").alias("base"))
    return metrics.where(F.col("method") != base).join(b, "k").select("method", "k", (F.col("base") - F.col("recall")).alias("delta"))


def best_checkpoint(records: DataFrame, payload: str) -> DataFrame:
    """records: query_id, position, error. The last record of each query; an error never replaces a valid one."""
    return records.groupBy("query_id").agg(F.max_by(payload, F.struct(~F.col("error"), "position")).alias(payload), F.bool_and("error").alias("error"))


def _draw(*parts) -> Column:
    """A uniform number in [0, 1) from the hash of its parts: the same on every run and partitioning."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def bootstrap_ci(diffs: DataFrame, resamples: int = 10_000, seed: int = 1) -> DataFrame:
    """diffs: query_id, diff. The mean paired difference and its 95 % interval over resamples of the queries.

    Each query's number of copies in a resample is a Poisson(1) draw, so resamples need no shuffle of the queries.
    """
    u = _draw(F.lit(seed), "query_id", "replicate")
    # the first few terms of the Poisson(1) distribution
    cuts, p, total = [], 0.36787944117144233, 0.0
    for k in range(1, 8):
        total += p
        cuts.append(total)
        p /= k
    copies = sum((u >= c).cast("int") for c in cuts)
    many = diffs.select("query_id", "diff", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("replicate")).withColumn("n", copies)
    means = many.groupBy("replicate").agg((F.sum(F.col("n") * F.col("diff")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean"))
    interval = means.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))
    return diffs.agg(F.avg("diff").alias("mean"), F.count(F.lit(1)).alias("queries")).join(F.broadcast(interval))


def sign_flip_test(diffs: DataFrame, flips: int = 20_000, seed: int = 2) -> DataFrame:
    """The two-sided p-value of the mean difference under random signs."""
    sign = F.when(_draw(F.lit(seed), "query_id", "replicate") < 0.5, 1.0).otherwise(-1.0)
    many = diffs.select("query_id", "diff", F.explode(F.sequence(F.lit(1), F.lit(flips))).alias("replicate"))
    sums = many.groupBy("replicate").agg(F.abs(F.sum(sign * F.col("diff"))).alias("s"))
    own = diffs.agg(F.abs(F.sum("diff")).alias("own"))
    return sums.join(F.broadcast(own)).agg(((F.sum((F.col("s") >= F.col("own") - 1e-12).cast("long")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def recall_funnel(stages: DataFrame, truth: DataFrame) -> DataFrame:
    """stages: stage, query_id, frame; truth: query_id, frame. How many queries still have a right frame after each stage."""
    total = truth.select("query_id").distinct().agg(F.count(F.lit(1)).alias("queries"))
    right = truth.select("query_id", "frame").distinct().withColumn("_right", F.lit(True))
    found = stages.join(right, ["query_id", "frame"], "left").groupBy("stage").agg(F.countDistinct(F.when(F.col("_right"), F.col("query_id"))).alias("found"))
    return found.join(F.broadcast(total))


def diversity(results: DataFrame, cuts: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    """results: query_id, rank, video. Distinct videos within each cut and frames for each video."""
    return results.groupBy("query_id").agg(*(F.countDistinct(F.when(F.col("rank") <= k, F.col("video"))).alias(f"videos_{k}") for k in cuts), (F.count(F.lit(1)) / F.countDistinct("video")).alias("frames_per_video"))


def sequence_diagnostics(results: DataFrame, truth: DataFrame) -> DataFrame:
    """results: query_id, frames; truth: query_id, ranges. Share of matched positions, whether all match, whether frames
    rise, and the mean distance to the ranges."""
    j = results.join(truth, "query_id")
    off = F.zip_with("frames", "ranges", lambda f, r: F.greatest(F.lit(0), r["start"] - f, f - r["end"]))
    hit = F.size(F.filter(off, lambda x: x == 0)) / F.size("ranges")
    rising = F.forall(F.zip_with(F.expr("slice(frames, 1, greatest(size(frames) - 1, 0))"), F.expr("slice(frames, 2, size(frames))"), lambda a, b: b > a), lambda x: x)
    far = F.aggregate(off, F.lit(0.0), lambda s, x: s + x) / F.size(off)
    return j.select("query_id", hit.alias("matched"), (hit == 1).alias("full"), F.coalesce(rising, F.lit(True)).alias("rising"), far.alias("distance"))


def failure_taxonomy(labels: DataFrame, sample: int = 3) -> DataFrame:
    """labels: query_id, label. Count, share and first ids of each label."""
    n = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_set("query_id")), 1, sample).alias("sample"))
    total = labels.agg(F.count(F.lit(1)).alias("total"))
    return n.join(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("total")).alias("share"), "sample")
