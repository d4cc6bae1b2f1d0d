"""Queries on joins, roll-ups and time-ordered rows, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenreel.operators import aggregates as a
from lumenreel.operators import joins as j
from lumenreel.operators import windows as w
from lumenreel.plans import views as v
from lumenreel.plans.common import register

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = register(QUERIES, SQL)

# Joins


@query(f"WITH {v.CANDIDATES} SELECT c.query_id, c.keyframe_id, c.video_id, f.event_type, u.n FROM candidates c JOIN frames f USING (keyframe_id) JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 60) u ON u.user_id = c.video_id")
def j01_attach_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v.frames(spark, sf_dir)
    videos = f.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).where("n > 60")
    got = j.attach_frames(v.candidates(spark, sf_dir).select("query_id", "keyframe_id", "video_id"), f.select("keyframe_id", "event_type"), videos)
    return got.select("query_id", "keyframe_id", "video_id", "event_type", "n")


@query(f"WITH {v.FRAMES}, e AS (SELECT vec_id % 150 AS video_id, row_number() OVER (PARTITION BY vec_id % 150 ORDER BY vec_id) * 9 - 1 AS i FROM embeddings) SELECT e.video_id, i AS index, keyframe_id, CASE WHEN keyframe_id IS NULL THEN 'no map row for this vector' END AS reason FROM e LEFT JOIN frames f ON f.video_id = e.video_id AND f.frame_idx = i + 1")
def j04_join_map_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = v.table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 150).alias("video_id"), "vec_id")
    e = e.select("video_id", (F.row_number().over(Window.partitionBy("video_id").orderBy("vec_id")).cast("long") * 9 - 1).alias("index"))
    good, bad = j.ordinal_to_frame(e, v.frames(spark, sf_dir).select("video_id", F.col("frame_idx").alias("n"), "keyframe_id"))
    none = F.lit(None)
    return good.select("video_id", "index", "keyframe_id", none.cast("string").alias("reason")).unionByName(bad.select("video_id", "index", none.cast("long").alias("keyframe_id"), "reason"))


@query(
    f"""WITH {v.FRAMES}, vs AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS vn FROM events WHERE event_id % 3 = 0),
    fs AS (SELECT video_id, frame_idx, frame_idx - 1 AS position, count(*) OVER (PARTITION BY video_id) AS fn FROM frames),
    t AS (SELECT DISTINCT video_id, i, vn, fn FROM vs JOIN (SELECT DISTINCT video_id, fn FROM fs) USING (video_id))
    SELECT t.video_id, t.i AS index, frame_idx FROM t JOIN fs ON fs.video_id = t.video_id AND position = CASE WHEN vn <= 1 OR t.fn = 1 THEN 0 ELSE CAST(round_even(CAST(i AS DOUBLE) * (t.fn - 1) / (vn - 1), 0) AS BIGINT) END"""
)
def j05_bridge_ordinal_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v.frames(spark, sf_dir)
    some = f.where("keyframe_id % 3 = 0")
    vectors = some.select("video_id", (F.row_number().over(Window.partitionBy("video_id").orderBy("keyframe_id")).cast("long") - 1).alias("index"))
    return j.bridge_by_ratio(vectors, f.select("video_id", "frame_idx"))


#: Segments of about an hour a day for each user, from purchases.
_SEG = """seg AS (SELECT video_id, keyframe_id AS segment_id, timestamp_ms AS start_ms, timestamp_ms + CAST(value * 60000 AS BIGINT) AS end_ms FROM frames WHERE event_type = 'purchase')"""


def time_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v.frames(spark, sf_dir).where("event_type = 'purchase'")
    return f.select("video_id", F.col("keyframe_id").alias("segment_id"), F.col("timestamp_ms").alias("start_ms"), (F.col("timestamp_ms") + F.round(F.col("value") * 60000).cast("long")).alias("end_ms"))


@query(
    f"""WITH {v.FRAMES}, {_SEG}, t AS (SELECT * FROM frames WHERE event_type <> 'purchase'),
    i AS (SELECT seg.video_id, segment_id, keyframe_id, frame_idx, row_number() OVER (PARTITION BY seg.video_id, segment_id ORDER BY abs(timestamp_ms - (start_ms + end_ms) / 2), frame_idx) AS n
      FROM seg JOIN t ON t.video_id = seg.video_id AND timestamp_ms BETWEEN start_ms - 1000 AND end_ms + 1000),
    l AS (SELECT seg.video_id, segment_id, keyframe_id, frame_idx, row_number() OVER (PARTITION BY seg.video_id, segment_id ORDER BY abs(timestamp_ms - (start_ms + end_ms) / 2), frame_idx) AS n
      FROM seg JOIN t ON t.video_id = seg.video_id WHERE (seg.video_id, segment_id) NOT IN (SELECT (video_id, segment_id) FROM i))
    SELECT video_id, segment_id, keyframe_id, frame_idx, true AS covered FROM i WHERE n <= 8 UNION ALL SELECT video_id, segment_id, keyframe_id, frame_idx, false FROM l WHERE n = 1"""
)
def j06_align_segments_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v.frames(spark, sf_dir).where("event_type <> 'purchase'").select("video_id", "keyframe_id", "frame_idx", "timestamp_ms")
    return j.align_interval(time_segments(spark, sf_dir), f, bucket_ms=3_600_000)


@query(
    f"""WITH {v.FRAMES}, {_SEG}, t AS (SELECT * FROM frames WHERE event_type <> 'purchase')
    SELECT t.video_id, t.keyframe_id, segment_id, coalesce(t.timestamp_ms > end_ms, false) AS propagated FROM t ASOF LEFT JOIN seg ON t.video_id = seg.video_id AND t.timestamp_ms >= start_ms"""
)
def j07_align_asof_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.align_propagate(v.frames(spark, sf_dir).where("event_type <> 'purchase'"), time_segments(spark, sf_dir))


@query(
    f"""WITH {v.FRAMES}, a AS (SELECT * FROM frames)
    SELECT a.keyframe_id AS anchor_id, f.video_id, f.keyframe_id, f.frame_idx, CAST(f.frame_idx - a.frame_idx AS INTEGER) AS step FROM a JOIN frames f ON f.video_id = a.video_id AND abs(f.frame_idx - a.frame_idx) <= 3"""
)
def j09_frame_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v.frames(spark, sf_dir)
    return j.frame_context(f.select("video_id", "keyframe_id"), f, 3)


@query(
    f"""WITH {v.FRAMES}, q AS (SELECT o_orderkey AS request_id, o_custkey % 150 AS video_id, o_orderkey * 170000 AS asked FROM orders)
    SELECT request_id, arg_min(keyframe_id, struct_pack(d := abs(timestamp_ms - asked), i := frame_idx)) AS nearest_id,
    arg_min(keyframe_id, frame_idx) FILTER (timestamp_ms > asked) AS next_id, arg_max(keyframe_id, frame_idx) FILTER (timestamp_ms < asked) AS previous_id FROM q JOIN frames USING (video_id) GROUP BY 1"""
)
def j10_seek_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % 150).alias("video_id"), (F.col("o_orderkey") * 170000).alias("timestamp_ms"))
    return j.seek_frame(o, v.frames(spark, sf_dir).select("video_id", "keyframe_id", "frame_idx", F.col("timestamp_ms")))


@query("WITH a AS (SELECT o_custkey AS k, o_orderkey FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT c_custkey AS k, c_mktsegment FROM customer), u AS (SELECT k FROM a GROUP BY 1 HAVING count(*) = 1) SELECT k, o_orderkey, c_mktsegment FROM a JOIN u USING (k) LEFT JOIN b USING (k)")
def j12_merge_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = v.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return j.one_to_one(x, v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment"), ["k"])


@query("SELECT doc_id, source, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic, quality IS NOT NULL AS matched FROM documents LEFT JOIN labels USING (doc_id)")
def j13_coverage_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j.coverage(v.table(spark, sf_dir, "documents").select("doc_id", "source"), v.table(spark, sf_dir, "labels"), "doc_id", {"quality": F.lit(-1), "toxic": F.lit(0)})


@query("WITH f AS (SELECT o_orderkey AS key, o_orderstatus = 'F' AS present FROM orders), l AS (SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_quantity > 45), s AS (SELECT f.key, present, l.key IS NOT NULL AS found FROM f LEFT JOIN l ON f.key = l.key) SELECT key, present, found, CASE WHEN found AND NOT present THEN 'appeared' WHEN NOT found AND present THEN 'vanished' ELSE 'same' END AS change FROM s")
def j14_reconcile_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderstatus") == "F").alias("present"))
    return j.reconcile_presence(f, v.table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("key")))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j16_pending_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = v.table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, F.lit(None)).otherwise("low quality").alias("error"))
    return j.pending(v.table(spark, sf_dir, "documents").select("doc_id", "source"), done, ["doc_id"])


@query("WITH m AS (SELECT l_partkey AS k, l_orderkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber DESC, l_quantity) = 1) SELECT p_partkey AS k, p_name, l_orderkey FROM part LEFT JOIN m ON m.k = p_partkey")
def j17_enrich_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = v.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place")).agg(F.first("l_orderkey").alias("l_orderkey"))
    return j.enrich(v.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_name"), m, "k", "place").select("k", "p_name", "l_orderkey")


# Roll-ups


@query(
    """SELECT l_orderkey AS video_id, max(l_partkey) AS end_frame, arg_min(l_discount, l_linenumber) FILTER (l_discount > 0) AS fps, max(l_suppkey) AS total_frames, count(*) AS rows
    FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_discount) AS l_discount, max(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1, 2) GROUP BY 1"""
)
def a01_video_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = v.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("end_frame"), F.max("l_discount").alias("fps"), F.max("l_suppkey").alias("total_frames"))
    return a.video_rollup(li.select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("row_id"), "end_frame", "fps", "total_frames"))


@query(f"WITH {v.FRAMES} SELECT video_id, event_type, min(frame_idx) AS min_frame_idx, max(frame_idx) AS max_frame_idx, min(timestamp_ms) AS min_timestamp_ms, max(timestamp_ms) AS max_timestamp_ms FROM frames GROUP BY 1, 2")
def a02_shot_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.shot_rollup(v.frames(spark, sf_dir), ["video_id", "event_type"])


@query(
    f"""WITH {v.FRAMES}, x AS (SELECT video_id, frame_idx * 40000 / (timestamp_ms / 1000.0) AS r, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx, keyframe_id) AS n FROM frames WHERE frame_idx > 0 AND timestamp_ms > 0),
    m AS (SELECT video_id, quantile_cont(r, 0.5) AS fps FROM x WHERE n <= 24 GROUP BY 1) SELECT video_id, round(CASE WHEN fps BETWEEN 1 AND 240 THEN fps END, 6) AS fps FROM m"""
)
def a03_infer_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v.frames(spark, sf_dir).withColumn("frame_idx", F.col("frame_idx") * 40000)
    return a.infer_fps(f).select("video_id", F.round("fps", 6).alias("fps"))


#: Frames of a part that become annotations: each is four facts, sorted in the same task.
ANNOTATED_ROWS = 100_000


def annotation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A video's frames as annotations of one keyframe; every fourth has a blank caption."""
    f = v.frames(spark, sf_dir, ANNOTATED_ROWS)
    return f.select(
        F.col("video_id").alias("keyframe_id"), F.col("frame_idx").alias("row_id"), F.when(F.col("frame_idx") % 4 == 0, " ").otherwise(F.col("event_type")).alias("caption"),
        F.array("event_type").alias("labels"), F.create_map("event_type", F.col("frame_idx") % 5).alias("counts"),
    )


@query(
    f"""WITH {v.FRAMES}, c AS (SELECT video_id, event_type, max(frame_idx % 5) AS n FROM frames GROUP BY 1, 2),
    b AS (SELECT video_id, arg_max(event_type, frame_idx) FILTER (frame_idx % 4 <> 0) AS caption FROM frames GROUP BY 1),
    o AS (SELECT video_id, event_type, min(frame_idx) AS first FROM frames GROUP BY 1, 2)
    SELECT video_id AS keyframe_id, caption, list(event_type ORDER BY first) AS labels, list(n ORDER BY event_type) AS counts FROM b JOIN o USING (video_id) JOIN c USING (video_id, event_type) GROUP BY 1, 2"""
)
def a04_merge_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotation_rows(spark, sf_dir)
    return a.merge_annotations(rows).select("keyframe_id", "caption", "labels", F.map_values("counts").alias("counts"))


@query(f"WITH {v.FRAMES}, n AS (SELECT video_id, event_type, count(*) AS n FROM frames GROUP BY 1, 2) SELECT video_id AS keyframe_id, list(event_type ORDER BY event_type) AS labels, list(n ORDER BY event_type) AS counts FROM n GROUP BY 1")
def a05_object_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v.frames(spark, sf_dir).groupBy(F.col("video_id").alias("keyframe_id")).agg(F.collect_list("event_type").alias("labels"))
    return a.object_counts(f).select("keyframe_id", "labels", F.map_values("counts").alias("counts"))


@query(f"WITH {v.CANDIDATES}, x AS (SELECT *, row_number() OVER (PARTITION BY query_id, video_id ORDER BY score DESC, keyframe_id) AS n FROM candidates) SELECT query_id, video_id, round(max(score), 6) AS best, round(avg(score), 6) AS mean FROM x WHERE n <= 3 GROUP BY 1, 2")
def a10_video_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.top_mean(v.candidates(spark, sf_dir), 3).select("query_id", "video_id", F.round("best", 6).alias("best"), F.round("mean", 6).alias("mean"))


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Importance 1, 2, 3 of the three events; the third is diagnostic, and on even days the second too."""
    e = v.candidates(spark, sf_dir).select("query_id", "event_index").distinct()
    return e.withColumn("weight", F.col("event_index").cast("double")), e.where("event_index = 3 or event_index = 2 and query_id % 2 = 0")


@query(
    f"""WITH {v.CANDIDATES}, b AS (SELECT query_id, video_id, event_index, max(score) AS score FROM candidates GROUP BY ALL), e AS (SELECT DISTINCT query_id, event_index, event_index AS weight, event_index = 3 OR event_index = 2 AND query_id % 2 = 0 AS d FROM candidates),
    t AS (SELECT query_id, sum(weight) AS ws, count_if(d) AS ds, count(*) AS n FROM e GROUP BY 1),
    s AS (SELECT query_id, video_id, sum(score * weight) AS w, sum(CASE WHEN d THEN score ELSE 0 END) AS h, count(*) AS seen FROM b JOIN e USING (query_id, event_index) GROUP BY 1, 2)
    SELECT query_id, video_id, round(greatest(0, least(1, 0.55 * CASE WHEN ds > 0 THEN h / ds ELSE 0 END + 0.35 * w / ws + 0.10 * seen / n)), 6) AS score FROM s JOIN t USING (query_id)"""
)
def a11_video_scores_cross_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    importance, diagnostic = _events(spark, sf_dir)
    return a.cross_event_scores(v.candidates(spark, sf_dir), importance, diagnostic).withColumn("score", F.round("score", 6))


_PROBE = f"""{v.CANDIDATES}, x AS (SELECT *, row_number() OVER (PARTITION BY query_id, event_index ORDER BY score DESC, keyframe_id) AS n FROM candidates),
 probe AS (SELECT query_id, event_index, 1 - count(DISTINCT video_id) / count(*) AS selectivity, max(score) - coalesce(avg(score) FILTER (n BETWEEN 2 AND 6), 0) AS margin, max(score) AS top FROM x WHERE n <= 24 GROUP BY 1, 2)"""


@query(f"WITH {_PROBE} SELECT query_id, event_index, round(selectivity, 6) AS selectivity, round(margin, 6) AS margin, round(top, 6) AS top FROM probe")
def a12_event_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = a.event_probe(v.candidates(spark, sf_dir), 24)
    return p.withColumns({c: F.round(c, 6) for c in ("selectivity", "margin", "top")})


@query(
    f"""WITH {_PROBE}, s AS (SELECT query_id, event_index, 0.55 * event_index / 3.0 + 0.45 * (0.4 * selectivity + 0.3 * margin + 0.3 * top) AS score FROM probe),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, event_index) AS place FROM s) SELECT query_id, event_index, round(score, 6) AS score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 2"""
)
def a13_diagnostic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = a.event_probe(v.candidates(spark, sf_dir), 24)
    priors = p.select("query_id", "event_index", (F.col("event_index") / 3.0).alias("prior"))
    return a.diagnostic_events(p, priors, 2).withColumn("score", F.round("score", 6))


@query(f"WITH {v.OBJECTS}, p AS (SELECT string_split(object_key, '/') AS parts, size FROM objects), x AS (SELECT unnest(list_transform(range(1, len(parts)), lambda n: array_to_string(list_slice(parts, 1, n), '/'))) AS folder, size FROM p) SELECT folder, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM x GROUP BY 1")
def a15_recursive_folder_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.folder_rollup(v.objects(spark, sf_dir))


@query(f"WITH {v.OBJECTS}, k AS (SELECT unnest(['blog', 'example.org', 'html', '/de/', '9']) AS word) SELECT word, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes, min(object_key) AS sample FROM objects JOIN k ON contains(lower(object_key), word) GROUP BY 1")
def a16_keyword_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.keyword_audit(v.objects(spark, sf_dir), ["blog", "example.org", "html", "/de/", "9"])


@query(f"WITH {v.ANNOTATIONS} SELECT video_id, count(*) AS frames, CAST(sum(CAST(source_type = 'caption' AS BIGINT)) AS BIGINT) AS caption, CAST(sum(CAST(source_type = 'ocr' AS BIGINT)) AS BIGINT) AS ocr, CAST(sum(CAST(source_type = 'asr' AS BIGINT)) AS BIGINT) AS asr FROM annotations GROUP BY ROLLUP (video_id)")
def a17_coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = v.annotations(spark, sf_dir)
    return a.coverage_summary(n.select("video_id", *((F.col("source_type") == c).alias(c) for c in ("caption", "ocr", "asr"))))


@query("SELECT 'lang' AS metric, lang AS key, count(*) AS rows FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def a18_index_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.counts_by(v.table(spark, sf_dir, "documents"), ["lang", "source"])


@query(
    "SELECT count(DISTINCT conv_id) AS videos, count(*) AS segments, count_if(trim(text) = '')::BIGINT AS blank, CAST(sum(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS words, count(*) - count(DISTINCT text) AS repeated FROM conversations"
)
def a19_asr_load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = v.table(spark, sf_dir, "conversations")
    words = F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).cast("long")
    return c.agg(F.countDistinct("conv_id").alias("videos"), F.count(F.lit(1)).alias("segments"), F.count_if(F.trim("text") == "").alias("blank"), F.sum(words).alias("words"), (F.count(F.lit(1)) - F.countDistinct("text")).alias("repeated"))


@query(f"WITH {v.OBJECTS}, x AS (SELECT CASE WHEN size < 1500 THEN 'filtered' WHEN object_key LIKE 'm.%' THEN 'unmapped' ELSE 'planned' END AS state, size FROM objects) SELECT state, count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes FROM x GROUP BY 1")
def a20_upload_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("size") < 1500, "filtered").when(F.col("object_key").startswith("m."), "unmapped").otherwise("planned")
    return v.objects(spark, sf_dir).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("objects"), F.sum("size").alias("bytes"))


@query("WITH s AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'skipped' END AS status FROM orders) SELECT o_custkey, count_if(status = 'completed')::BIGINT AS completed, count_if(status = 'failed')::BIGINT AS failed, count_if(status = 'skipped')::BIGINT AS skipped, CASE WHEN count_if(status = 'failed') > 0 THEN 'failed' WHEN count_if(status = 'completed') > 0 THEN 'completed' ELSE 'skipped' END AS state FROM s GROUP BY 1")
def a21_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed").otherwise("skipped")
    return a.run_status(v.table(spark, sf_dir, "orders").select("o_custkey", status.alias("status")), ["o_custkey"])


@query(f"WITH {v.FRAMES}, p AS (SELECT *, row_number() OVER q AS n, count(*) OVER (PARTITION BY video_id, event_type) AS c FROM frames WINDOW q AS (PARTITION BY video_id, event_type ORDER BY frame_idx)) SELECT video_id, count(DISTINCT keyframe_id) AS frames, max(timestamp_ms) AS last_ms, count_if(n = 1)::BIGINT AS firsts, count_if(n > 1 AND n < c)::BIGINT AS middles FROM p GROUP BY 1")
def a22_media_archive_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct frames and last time of each video; frames of a shot (here an event type) are first, middle or last by order."""
    s = Window.partitionBy("video_id", "event_type")
    p = v.frames(spark, sf_dir).withColumns({"n": F.row_number().over(s.orderBy("frame_idx")), "c": F.count(F.lit(1)).over(s)})
    return p.groupBy("video_id").agg(F.countDistinct("keyframe_id").alias("frames"), F.max("timestamp_ms").alias("last_ms"), F.count_if(F.col("n") == 1).alias("firsts"), F.count_if((F.col("n") > 1) & (F.col("n") < F.col("c"))).alias("middles"))


@query("SELECT n_nationkey, n_name, count(c_custkey) AS videos FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1, 2")
def a23_dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos of each dataset, 0 when it has none."""
    n = v.table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("videos"))
    return v.table(spark, sf_dir, "nation").select("n_nationkey", "n_name").join(n, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("videos", F.lit(0).cast("long")).alias("videos"))


@query("SELECT event_type, count(*) AS items, round(sum(value), 6) AS seconds, round(count(*) / sum(value), 6) AS per_second, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def a24_throughput_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = a.throughput(v.table(spark, sf_dir, "events").select("event_type", F.lit(1).cast("long").alias("items"), F.col("value").alias("seconds")), ["event_type"])
    return t.withColumns({c: F.round(c, 6) for c in ("seconds", "per_second", "p50", "p95", "p99")})


# Rows in order of time


@query(
    f"""WITH {v.CANDIDATES}, h AS (SELECT query_id, event_index, keyframe_id, CASE WHEN keyframe_id % 3 <> 0 THEN 1.2 * score - 0.1 END AS semantic,
      score * (1 + keyframe_id % 4) / 4 AS hybrid FROM candidates),
    x AS (SELECT *, row_number() OVER (PARTITION BY query_id, event_index ORDER BY hybrid DESC, keyframe_id) AS n FROM h),
    y AS (SELECT *, (1 + ln(2)) / (1 + ln(1 + n)) AS rel, greatest(0, least(1, hybrid)) AS hy, CASE WHEN semantic IS NOT NULL THEN greatest(0, least(1, semantic)) END AS se FROM x)
    SELECT query_id, event_index, keyframe_id, round(greatest(0, least(1, coalesce(0.6 * rel + 0.2 * hy + 0.2 * se, (0.6 * rel + 0.2 * hy) / 0.8))), 6) AS calibrated FROM y"""
)
def w02_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked by the hybrid score; a third of the candidates have no semantic one."""
    k = F.col("keyframe_id")
    c = v.candidates(spark, sf_dir).withColumn("hybrid", F.col("score") * (1 + k % 4) / 4).withColumn("score", F.when(k % 3 != 0, 1.2 * F.col("score") - 0.1))
    return w.calibrate(c).select("query_id", "event_index", "keyframe_id", F.round("calibrated", 6).alias("calibrated"))


_SHOTS = """b AS (SELECT l_orderkey AS video_id, least(greatest(l_partkey, 0), 999) AS e FROM lineitem UNION SELECT l_orderkey, 999 FROM lineitem),
 rg AS (SELECT video_id, coalesce(lag(e) OVER (PARTITION BY video_id ORDER BY e) + 1, 0) AS s, e FROM b), shots AS (SELECT video_id, s, e FROM rg WHERE e - s + 1 >= 5)"""


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = v.dealt(v.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_partkey").alias("boundary")), "video_id")
    return w.boundaries_to_shots(li, li.select("video_id", F.lit(1000).alias("n_frames")).distinct())


@query(f"WITH {_SHOTS} SELECT video_id, CAST(s AS BIGINT) AS start, e AS \"end\" FROM shots")
def w03_boundaries_to_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shots(spark, sf_dir)


_HIST = "h AS (SELECT doc_id, source, [length(text) % 17, length(text) % 11, length(text) % 7, doc_id % 5]::DOUBLE[] AS hist FROM documents)"


@query(
    f"""WITH {_HIST}, p AS (SELECT source AS video_id, doc_id AS frame_idx, hist, lag(hist) OVER (PARTITION BY source ORDER BY doc_id) AS prev FROM h),
    d AS (SELECT *, list_transform(hist, lambda x: x - list_avg(hist)) AS a, list_transform(prev, lambda x: x - list_avg(prev)) AS b FROM p WHERE prev IS NOT NULL),
    c AS (SELECT video_id, frame_idx, 1 - CASE WHEN sqrt(list_dot_product(a, a) * list_dot_product(b, b)) > 0 THEN list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) ELSE 1 END AS change FROM d)
    SELECT video_id, frame_idx, round(change, 6) AS change FROM c WHERE change > 0.4"""
)
def w04_histogram_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = v.table(spark, sf_dir, "documents")
    n = F.length("text")
    hist = F.array(*(x.cast("double") for x in (n % 17, n % 11, n % 7, F.col("doc_id") % 5)))
    return w.histogram_boundaries(d.select(F.col("source").alias("video_id"), F.col("doc_id").alias("frame_idx"), hist.alias("histogram"))).withColumn("change", F.round("change", 6))


@query(
    """WITH s AS (SELECT DISTINCT l_orderkey AS video_id, l_partkey AS a, l_partkey + CAST(l_quantity AS BIGINT) AS b FROM lineitem WHERE CAST(l_quantity AS BIGINT) >= 3), f AS (SELECT *, CASE WHEN a - lag(b) OVER o <= 2 THEN 0 ELSE 1 END AS brk FROM s WINDOW o AS (PARTITION BY video_id ORDER BY a, b)),
    g AS (SELECT *, sum(brk) OVER (PARTITION BY video_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isl FROM f) SELECT video_id, min(a) AS start, max(b) AS "end" FROM g GROUP BY video_id, isl"""
)
def w05_merge_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = v.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end")).distinct()
    return w.merge_shots(li).select("video_id", "start", "end")


@query(
    f"""WITH {_SHOTS}, k AS (SELECT video_id, CAST(s AS BIGINT) AS s, e, unnest(['first', 'middle', 'last']) AS role FROM shots)
    SELECT video_id, s AS start, e AS "end", role, CASE role WHEN 'first' THEN s WHEN 'last' THEN e ELSE (s + e) // 2 END AS frame_idx FROM k"""
)
def w06_pick_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.pick_keyframes(shots(spark, sf_dir))


def _keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in order of their id, each the sum of a label's last four: neighbours overlap, as neighbouring frames do."""
    w = Window.partitionBy("label").orderBy("vec_id")
    e = v.table(spark, sf_dir, "embeddings").withColumn("x", F.transform("embedding", lambda x: x.cast("double")))
    total = F.col("x")
    for back in (1, 2, 3):
        older = F.lag("x", back).over(w)
        total = F.when(older.isNull(), total).otherwise(F.zip_with(total, older, lambda p, q: p + q))
    return e.select(F.col("label").cast("long").alias("video_id"), F.col("vec_id").alias("keyframe_id"), (F.col("vec_id") / 5.0).alias("seconds"), total.alias("embedding"))


def _events_sql(like: str, mean: str) -> str:
    """The fold as a recursion over the keyframes of a video in order; m is what the next keyframe is compared with."""
    return f"""WITH RECURSIVE e AS (SELECT label AS video_id, vec_id, CAST(embedding AS DOUBLE[]) AS x0, lag(CAST(embedding AS DOUBLE[])) OVER o AS x1,
      lag(CAST(embedding AS DOUBLE[]), 2) OVER o AS x2, lag(CAST(embedding AS DOUBLE[]), 3) OVER o AS x3, row_number() OVER o AS i FROM embeddings WINDOW o AS (PARTITION BY label ORDER BY vec_id)),
    s AS (SELECT video_id, vec_id, vec_id / 5.0 AS t, i, list_transform(range(1, len(x0) + 1), lambda k: x0[k] + coalesce(x1[k], 0) + coalesce(x2[k], 0) + coalesce(x3[k], 0)) AS z FROM e),
    f AS MATERIALIZED (SELECT video_id, vec_id, CAST(t AS DOUBLE) AS t, i, list_transform(z, lambda c: c / sqrt(list_dot_product(z, z))) AS z FROM s),
    r AS (SELECT video_id, i, vec_id, t, z AS m, t AS began, 0 AS event_no FROM f WHERE i = 1
      UNION ALL
      SELECT video_id, i, vec_id, t, CASE WHEN near THEN {mean} ELSE z END, CASE WHEN near THEN began ELSE t END, event_no + CASE WHEN near THEN 0 ELSE 1 END
      FROM (SELECT f.video_id, f.i, f.vec_id, f.t, f.z, r.m, r.began, r.event_no, f.t - r.t <= 6 AND f.t - r.began <= 45 AND {like} >= 0.72 AS near FROM r JOIN f ON f.video_id = r.video_id AND f.i = r.i + 1))
    SELECT CAST(video_id AS BIGINT) AS video_id, event_no, min(vec_id) AS first_keyframe, max(vec_id) AS last_keyframe, min(t) AS start_seconds, max(t) AS end_seconds, CAST(count(*) AS INTEGER) AS n FROM r GROUP BY video_id, event_no"""


@query(_events_sql("list_dot_product(r.m, f.z)", "z"))
def w07_segment_events_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.segment_events(_keyframes(spark, sf_dir))


@query(_events_sql("list_cosine_similarity(r.m, f.z)", "list_transform(range(1, len(z) + 1), lambda k: m[k] + z[k])"))
def w08_segment_events_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.segment_events(_keyframes(spark, sf_dir), centroid=True)


@query(
    """WITH c AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM c GROUP BY 1, 2),
    n AS (SELECT label, list(x ORDER BY i) AS mean, sqrt(sum(x * x)) AS norm FROM m GROUP BY 1) SELECT label, round(mean[1] / norm, 6) AS first, round(mean[64] / norm, 6) AS last, round(norm, 6) AS norm FROM n"""
)
def w10_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = w.mean_pool(v.table(spark, sf_dir, "embeddings"), "label")
    cells = v.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    norm = cells.groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("norm"))
    return m.join(norm, "label").select("label", F.round(F.element_at("mean", 1), 6).alias("first"), F.round(F.element_at("mean", 64), 6).alias("last"), "norm")


@query(f"WITH {v.SEGMENTS} SELECT video_id, segment_id, row_number() OVER (PARTITION BY video_id ORDER BY start_seconds, end_seconds, segment_id) - 1 AS place FROM segments")
def w11_segment_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = Window.partitionBy("video_id").orderBy("start_seconds", "end_seconds", "segment_id")
    return v.segments(spark, sf_dir).select("video_id", "segment_id", (F.row_number().over(o) - 1).cast("long").alias("place"))


@query(
    """WITH m AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p FROM lineitem GROUP BY 1, 2), d AS (SELECT l_orderkey, l_linenumber, p - lag(p) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS delta FROM m)
    SELECT l_orderkey, coalesce(list(delta ORDER BY l_linenumber) FILTER (delta IS NOT NULL), []) AS deltas, coalesce(bool_and(delta > 0), true) AS rising FROM d GROUP BY 1"""
)
def w12_sequence_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = v.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("position")).agg(F.max("l_partkey").alias("frame_idx"))
    return w.sequence_deltas(m, ["l_orderkey"])


@query(
    f"""WITH {v.FRAMES}, p AS (SELECT video_id, keyframe_id, frame_idx - 1 AS position, count(*) OVER (PARTITION BY video_id) AS n FROM frames)
    SELECT video_id, keyframe_id, CAST(position AS INTEGER) AS position FROM p WHERE n <= 6 OR list_contains(list_transform(range(0, 6), lambda i: i * (n - 1) // 5), position)"""
)
def w13_sample_evenly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.sample_evenly(v.frames(spark, sf_dir).select("video_id", "keyframe_id", "frame_idx"), "video_id", ["frame_idx"], 6).select("video_id", "keyframe_id", "position")


@query(f"WITH {v.FRAMES}, o AS (SELECT video_id, timestamp_ms >= lag(timestamp_ms) OVER q AS t, frame_idx >= lag(frame_idx) OVER q AS i FROM frames WINDOW q AS (PARTITION BY video_id ORDER BY keyframe_id)) SELECT video_id, bool_and(coalesce(t, true)) AS time_rises, bool_and(coalesce(i, true)) AS index_rises FROM o GROUP BY 1")
def w14_monotonic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w.monotonic(v.frames(spark, sf_dir).withColumn("n", F.col("keyframe_id")))
