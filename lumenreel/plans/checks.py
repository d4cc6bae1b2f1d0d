"""Queries on validation and evaluation, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenreel.operators import evaluation as e
from lumenreel.operators import ranking as r
from lumenreel.operators import validation as c
from lumenreel.plans import views as v
from lumenreel.plans.common import register
from lumenreel.plans.ranking import LISTS, OVERLAP, lexical, two_lists

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = register(QUERIES, SQL)


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def v01_candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = v.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return o.union(v.table(spark, sf_dir, "customer").where("c_acctbal > 5000").select("c_custkey")).distinct()


@query("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def v02_video_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = v.table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return o.intersect(v.table(spark, sf_dir, "customer").where("c_acctbal > 5000").select("c_custkey"))


@query(
    f"""WITH {v.FRAMES}, s AS (SELECT DISTINCT video_id, keyframe_id AS id FROM frames WHERE keyframe_id % 50 <> 1), x AS (SELECT DISTINCT video_id, keyframe_id AS id FROM frames WHERE keyframe_id % 60 <> 2),
    b AS (SELECT coalesce(s.video_id, x.video_id) AS video_id, coalesce(s.id, x.id) AS id, s.id IS NOT NULL AS hs, x.id IS NOT NULL AS hx FROM s FULL JOIN x ON s.video_id = x.video_id AND s.id = x.id),
    g AS (SELECT video_id, count_if(hs)::BIGINT AS stored, count_if(NOT hs)::BIGINT AS missing, count_if(NOT hx)::BIGINT AS extra, list_slice(coalesce(list(id ORDER BY id) FILTER (NOT hs), []), 1, 10) AS missing_sample FROM b GROUP BY 1)
    SELECT *, stored = 0 OR missing = 0 AND extra = 0 AS passed FROM g"""
)
def v03_id_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v.frames(spark, sf_dir).select("video_id", F.col("keyframe_id").alias("id"))
    return c.id_parity(f.where("id % 50 <> 1"), f.where("id % 60 <> 2")).drop("extra_sample")


@query("SELECT o_custkey, o_orderstatus, count(*) AS rows FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def v06_assert_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.duplicates(v.table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"])


@query("SELECT c_custkey, unnest(list_filter([CASE WHEN c_acctbal < 0 THEN 'non_negative' END, CASE WHEN c_nationkey > 20 THEN 'nation_range' END], lambda x: x IS NOT NULL)) AS rule FROM customer")
def v07_check_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.violations(v.table(spark, sf_dir, "customer"), ["c_custkey"], {"non_negative": F.col("c_acctbal") < 0, "nation_range": F.col("c_nationkey") > 20})


@query("SELECT o_orderkey, o_custkey, 'import' AS stage, 'no c_custkey for this o_custkey' AS reason FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def v08_check_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = v.table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'")
    return c.orphans(v.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), parent, "o_custkey", "c_custkey", "import")


@query(
    f"""WITH {v.FRAMES}, m AS (SELECT video_id, frame_idx AS n, timestamp_ms, frame_idx * 25 % 400 AS i, CASE WHEN video_id % 7 = 0 AND frame_idx > 3 THEN 30.0 ELSE 25.0 END AS fps FROM frames WHERE NOT (video_id % 5 = 0 AND frame_idx = 2)),
    k AS (SELECT video_id, count(*) AS frames FROM frames GROUP BY 1), d AS (SELECT *, i - lag(i) OVER (PARTITION BY video_id ORDER BY n) AS di FROM m),
    g AS (SELECT video_id, count(*) AS r, min(n) AS lo, max(n) AS hi, count(DISTINCT n) AS ns, min(di) AS di, min(fps) AS f0, max(fps) AS f1 FROM d GROUP BY 1),
    x AS (SELECT video_id, array_to_string(list_filter([CASE WHEN r <> frames THEN 'count' END, CASE WHEN lo <> 1 THEN 'n_start' END, CASE WHEN hi - lo + 1 <> ns THEN 'n_gap' END, CASE WHEN di < 0 THEN 'index_falls' END, CASE WHEN f0 <> f1 THEN 'fps_varies' END], lambda z: z IS NOT NULL), ',') AS issues FROM g JOIN k USING (video_id))
    SELECT video_id, issues, CASE WHEN issues = '' THEN 'PASS' ELSE 'FAIL' END AS status FROM x"""
)
def v09_validate_map_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v.frames(spark, sf_dir)
    fps = F.when((F.col("video_id") % 7 == 0) & (F.col("frame_idx") > 3), 30.0).otherwise(25.0)
    m = f.where("not (video_id % 5 = 0 and frame_idx = 2)").select("video_id", F.col("frame_idx").alias("n"), "timestamp_ms", (F.col("frame_idx") * 25 % 400).alias("frame_idx"), fps.alias("fps"))
    return c.map_table_issues(m, f.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames")))


_TURNS = """turns AS (SELECT conv_id AS line, CAST(conv_id % 97 AS VARCHAR) AS video_id, turn AS position,
      CASE WHEN turn % 7 <> 6 THEN concat(conv_id // 2, ':', turn % 5) END AS segment_id,
      CASE WHEN role = 'system' THEN 'x' WHEN turn % 2 = 1 THEN CAST(conv_id % 97 AS VARCHAR) END AS segment_video_id, CASE WHEN turn % 4 = 3 THEN ' ' ELSE text END AS text,
      CASE WHEN length(text) % 5 > 0 THEN CAST(turn * 10 - length(text) % 3 AS DOUBLE) END AS start_seconds, CAST(turn * 10 + length(text) % 4 - 1 AS DOUBLE) AS end_seconds FROM conversations)"""


@query(
    f"""WITH {_TURNS}, l AS (SELECT *, min(line) OVER (PARTITION BY video_id) AS first_line FROM turns),
    p AS (SELECT line, min(position) AS position, segment_id FROM l WHERE line = first_line AND segment_id IS NOT NULL GROUP BY line, segment_id),
    q AS (SELECT segment_id, min(struct_pack(l := line, p := position)) AS first_place FROM p GROUP BY 1)
    SELECT line, position, CASE WHEN line > first_line THEN 'duplicate_video' WHEN segment_id IS NULL THEN 'missing_segment'
      WHEN struct_pack(l := line, p := position) <> first_place THEN 'duplicate_segment' WHEN segment_video_id = 'x' THEN 'other_video' WHEN trim(text) = '' THEN 'empty_text'
      WHEN start_seconds IS NULL THEN 'no_time' WHEN start_seconds < 0 OR end_seconds < start_seconds THEN 'bad_range' END AS rule FROM l LEFT JOIN q USING (segment_id)"""
)
def v10_validate_asr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as records of 97 videos, with every fault; two records share segment ids."""
    turn, n, video = F.col("turn"), F.length("text"), (F.col("conv_id") % 97).cast("string")
    rows = v.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("line"), video.alias("video_id"), turn.alias("position"),
        F.when(turn % 7 != 6, F.concat(F.floor(F.col("conv_id") / 2), F.lit(":"), turn % 5)).alias("segment_id"), F.when(F.col("role") == "system", "x").when(turn % 2 == 1, video).alias("segment_video_id"),
        F.when(turn % 4 == 3, " ").otherwise(F.col("text")).alias("text"), F.when(n % 5 > 0, (turn * 10 - n % 3).cast("double")).alias("start_seconds"), (turn * 10 + n % 4 - 1).cast("double").alias("end_seconds"),
    )
    return c.check_transcripts(rows).select("line", "position", "rule")


_SUB = """sub AS (SELECT 'q' || CAST(l_suppkey AS VARCHAR) AS query_name, CASE l_suppkey % 3 WHEN 0 THEN 'KIS' WHEN 1 THEN 'QA' ELSE 'TRAKE' END AS query_type, l_orderkey % 120 AS rank,
 CASE WHEN l_partkey % 40 = 0 THEN 'v.mp4' ELSE 'v' || CAST(l_partkey AS VARCHAR) END AS video_code, CASE WHEN l_suppkey % 3 = 2 THEN [l_partkey, l_partkey + l_linenumber - 3] ELSE [l_partkey] END AS frames,
 CASE WHEN l_suppkey % 3 = 1 AND l_linenumber > 1 THEN l_returnflag END AS answer FROM lineitem)"""


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as submission rows: a supplier is a query, its kind by turns."""
    kind = F.col("l_suppkey") % 3
    return v.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("q"), F.col("l_suppkey")).alias("query_name"), F.when(kind == 0, "KIS").when(kind == 1, "QA").otherwise("TRAKE").alias("query_type"), (F.col("l_orderkey") % 120).alias("rank"),
        F.when(F.col("l_partkey") % 40 == 0, "v.mp4").otherwise(F.concat(F.lit("v"), F.col("l_partkey"))).alias("video_code"),
        F.when(kind == 2, F.array("l_partkey", F.col("l_partkey") + F.col("l_linenumber") - 3)).otherwise(F.array("l_partkey")).alias("frame_indices"),
        F.when((kind == 1) & (F.col("l_linenumber") > 1), F.col("l_returnflag")).alias("answer"),
    )


@query(
    f"""WITH {_SUB}, n AS (SELECT *, count(*) OVER (PARTITION BY query_name) AS c, count(*) OVER (PARTITION BY query_name, rank) AS s FROM sub),
    x AS (SELECT query_name, rank, unnest(list_filter([CASE WHEN c > 100 THEN 'too_many_rows' END, CASE WHEN rank NOT BETWEEN 1 AND 100 THEN 'rank_range' END, CASE WHEN s > 1 THEN 'rank_repeats' END, CASE WHEN video_code LIKE '%.mp4' THEN 'video_suffix' END,
      CASE WHEN query_type = 'QA' AND answer IS NULL THEN 'answer_missing' END, CASE WHEN query_type = 'TRAKE' AND frames[2] <= frames[1] THEN 'order' END, CASE WHEN list_min(frames) < 0 THEN 'frame_negative' END], lambda z: z IS NOT NULL)) AS rule FROM n)
    SELECT query_name, rank, rule FROM x"""
)
def v11_validate_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.submission_violations(submissions(spark, sf_dir))


@query(
    """WITH n AS (SELECT o_orderkey AS video_id, o_orderstatus AS dataset, o_orderpriority AS uri, o_custkey % 2 AS version FROM orders), e AS (SELECT o_orderkey AS video_id, CASE WHEN o_custkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS dataset, CASE WHEN o_custkey % 7 = 0 THEN 'X' ELSE o_orderpriority END AS uri, 1 AS version, o_totalprice > 200000 AS complete FROM orders WHERE o_orderkey % 3 = 0)
    SELECT n.video_id, CASE WHEN e.dataset IS NULL THEN 'create' WHEN e.dataset <> n.dataset THEN 'fail_dataset' WHEN e.uri <> n.uri THEN 'fail_uri' WHEN e.version <> n.version THEN 'fail_version' WHEN complete THEN 'skip' ELSE 'resume' END AS action FROM n LEFT JOIN e USING (video_id)"""
)
def v12_video_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = v.table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderkey": "video_id", "o_orderstatus": "dataset", "o_orderpriority": "uri"})
    n = o.select("video_id", "dataset", "uri", (F.col("o_custkey") % 2).alias("version"))
    e_ = o.where("video_id % 3 = 0").select(
        "video_id", F.when(F.col("o_custkey") % 5 == 0, "X").otherwise(F.col("dataset")).alias("dataset"), F.when(F.col("o_custkey") % 7 == 0, "X").otherwise(F.col("uri")).alias("uri"), F.lit(1).alias("version"), (F.col("o_totalprice") > 200000).alias("complete")
    )
    return c.collisions(n, e_)


@query("WITH s AS (SELECT doc_id FROM documents), t AS (SELECT doc_id FROM labels) SELECT (SELECT count(*) FROM s) AS source_rows, (SELECT count(*) FROM t) AS target_rows, (SELECT count(*) FROM s WHERE doc_id IN (SELECT doc_id FROM t)) AS existing, (SELECT count(*) FROM s WHERE doc_id NOT IN (SELECT doc_id FROM t)) AS missing")
def v15_sync_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.key_sync(v.table(spark, sf_dir, "documents"), v.table(spark, sf_dir, "labels"), "doc_id")


@query(
    LISTS
    + """, x AS (SELECT query_id, sha256(array_to_string(list(CAST(frame_id AS VARCHAR) ORDER BY rank, CAST(frame_id AS VARCHAR)), ',')) AS a FROM sem WHERE rank <= 10 GROUP BY 1),
    y AS (SELECT query_id, sha256(array_to_string(list(CAST(frame_id AS VARCHAR) ORDER BY rank, CAST(frame_id AS VARCHAR)), ',')) AS b FROM txt WHERE rank <= 10 GROUP BY 1)
    SELECT query_id, coalesce(a = b, false) AS same FROM x FULL JOIN y USING (query_id)"""
)
def v16_paired_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first ten of both lists agree."""
    s, t = (d.where("rank <= 10").select("query_id", F.col("frame_id").alias("id"), "rank") for d in two_lists(spark, sf_dir))
    return c.paired_parity(s, t, ["query_id"])


@query(
    """WITH x AS (SELECT label, vec_id, len(embedding) AS n, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings)
    SELECT label, count(*) AS rows, count_if(n <> 64)::BIGINT AS wrong_size, 0::BIGINT AS not_finite, count_if(norm = 0)::BIGINT AS zero, count_if(abs(norm - 1) > 0.001)::BIGINT AS off_unit, max(vec_id) - min(vec_id) + 1 = count(*) AS dense FROM x GROUP BY 1"""
)
def v18_validate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.vector_report(v.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "index"), "label", 64).drop("largest_error")


@query("WITH n AS (SELECT label AS video_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM embeddings), f AS (SELECT video_id, unnest(range(0, 50)) AS i FROM (SELECT DISTINCT label AS video_id FROM embeddings)) SELECT f.video_id, f.i AS index, coalesce(CAST(embedding[1] AS DOUBLE), 0) AS first, n.i IS NULL AS padded FROM f LEFT JOIN n ON n.video_id = f.video_id AND n.i = f.i")
def v19_pad_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty frames a video: some lack vectors, some vectors are beyond them."""
    n = v.table(spark, sf_dir, "embeddings").select(F.col("label").alias("video_id"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long") - 1).alias("index"), "embedding")
    f = n.select("video_id").distinct().select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("index"))
    return c.pad_vectors(n, f, 64).select("video_id", "index", F.element_at("embedding", 1).cast("double").alias("first"), F.forall("embedding", lambda x: x == 0).alias("padded"))


# Evaluation: the line items' suppliers answer one query each; the truth is a part of the supplier's own.

_TRUTH = "truth AS (SELECT 'q' || CAST(s_suppkey AS VARCHAR) AS query_name, CASE s_suppkey % 3 WHEN 0 THEN 'KIS' WHEN 1 THEN 'QA' ELSE 'TRAKE' END AS kind, s_suppkey * 17 % 2000 AS part, s_suppkey FROM supplier)"
_ANSWERS = """answers AS (SELECT 'q' || CAST(l_suppkey AS VARCHAR) AS query_name, l_partkey % 40 AS video, l_partkey AS frame, [l_partkey, l_partkey + l_linenumber] AS frames, l_returnflag AS answer,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem)"""


def answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = v.table(spark, sf_dir, "supplier")
    k, p = F.col("s_suppkey") % 3, F.col("s_suppkey") * 17 % 2000
    window = F.struct((p - 300).alias("start"), (p + 300).alias("end"))
    truth = s.select(
        F.concat(F.lit("q"), "s_suppkey").alias("query_id"), F.when(k == 0, "KIS").when(k == 1, "QA").otherwise("TRAKE").alias("kind"), (p % 40).alias("video"), p.alias("frame"),
        F.when(k == 2, F.array(window, window)).otherwise(F.array(window)).alias("ranges"), F.lit("a").alias("answer"),
    )
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    a = v.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("q"), "l_suppkey").alias("query_id"), (F.col("l_partkey") % 40).alias("video"), F.col("l_partkey").alias("frame"), F.array("l_partkey", F.col("l_partkey") + F.col("l_linenumber")).alias("frames"),
        F.col("l_returnflag").alias("answer"), F.row_number().over(w).alias("rank"),
    )
    return a, truth


_R = f"""{_TRUTH}, {_ANSWERS}, rs AS (SELECT query_name, kind, rank, CASE WHEN video <> part % 40 THEN 0.0 WHEN kind = 'TRAKE' THEN (CAST(abs(frames[1] - part) <= 300 AS INT) + CAST(abs(frames[2] - part) <= 300 AS INT)) / 2.0
  WHEN kind = 'QA' THEN CAST(abs(frame - part) <= 300 AND lower(answer) = 'a' AS DOUBLE) ELSE CAST(abs(frame - part) <= 300 AS DOUBLE) END AS r FROM answers JOIN truth USING (query_name) WHERE rank <= 100)"""


@query(f"WITH {_R} SELECT query_name AS query_id, CAST(rank AS INTEGER) AS rank, CAST(r AS DOUBLE) AS r FROM rs")
def e01_r_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.r_scores(*answers(spark, sf_dir)).select("query_id", "rank", "r")


@query(f"WITH {_R} SELECT query_name AS query_id, round((coalesce(max(r) FILTER (rank <= 1), 0) + coalesce(max(r) FILTER (rank <= 5), 0) + coalesce(max(r) FILTER (rank <= 20), 0) + coalesce(max(r) FILTER (rank <= 50), 0) + coalesce(max(r) FILTER (rank <= 100), 0)) / 5, 6) AS score FROM rs GROUP BY 1")
def e02_final_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.final_scores(e.r_scores(*answers(spark, sf_dir))).withColumn("score", F.round("score", 6))


_RANKS = f"""{_TRUTH}, {_ANSWERS}, ranks AS (SELECT query_name AS query_id, any_value(kind) AS kind, min(rank) FILTER (video = part % 40) AS video_rank, min(rank) FILTER (video = part % 40 AND frame = part) AS frame_rank,
  min(rank) FILTER (video = part % 40 AND list_contains(frames, part)) AS sequence_rank, min(abs(frame - part)) FILTER (video = part % 40) AS nearest FROM truth LEFT JOIN answers USING (query_name) GROUP BY 1)"""


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, t = answers(spark, sf_dir)
    return e.first_ranks(a, t).join(t.select("query_id", "kind"), "query_id")


@query(f"WITH {_RANKS} SELECT query_id, CAST(video_rank AS INTEGER) AS video_rank, CAST(frame_rank AS INTEGER) AS frame_rank, CAST(sequence_rank AS INTEGER) AS sequence_rank, nearest FROM ranks")
def e03_first_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks(spark, sf_dir).drop("kind")


_RECALL = f"""{_RANKS}, k AS (SELECT unnest([1, 5, 20, 50, 100]) AS k), rec AS (SELECT k, kind, count_if(video_rank <= k)::BIGINT AS found, count(*) AS queries FROM ranks, k GROUP BY GROUPING SETS ((k), (k, kind)))"""


@query(f"WITH {_RECALL} SELECT k, kind, found, queries, round(found / queries, 6) AS recall FROM rec")
def e04_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ranks(spark, sf_dir).select("kind", F.col("video_rank").alias("rank"))
    return e.recall_at(x, e.CUTS, "kind").select("k", "kind", "found", "queries", F.round("recall", 6).alias("recall"))


@query(f"WITH {_RANKS} SELECT query_id, video_rank IS NOT NULL AS in_video, coalesce(nearest <= 25, false) AS strict FROM ranks")
def e05_strict_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a frame of the right video comes within 25 of the right one."""
    return ranks(spark, sf_dir).select("query_id", F.col("video_rank").isNotNull().alias("in_video"), F.coalesce(F.col("nearest") <= 25, F.lit(False)).alias("strict"))


@query(
    f"""WITH {OVERLAP}, rk AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM pair_scores), x AS (SELECT query_id, doc_id FROM text_queries JOIN documents ON contains(text, query_text)),
    h AS (SELECT query_id, count(DISTINCT doc_id) AS found, 1.0 / min(rank) AS mrr FROM rk JOIN x USING (query_id, doc_id) WHERE rank <= 20 GROUP BY 1), n AS (SELECT query_id, count(DISTINCT doc_id) AS n FROM x GROUP BY 1)
    SELECT query_id, round(coalesce(found, 0) / n, 6) AS recall, round(CAST(coalesce(mrr, 0) AS DOUBLE), 6) AS mrr FROM n LEFT JOIN h USING (query_id)"""
)
def e06_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical ranking against the documents that hold the query's words as they stand."""
    found = r.top(lexical(spark, sf_dir), ["query_id"], [F.desc(F.round("score", 9)), F.asc("doc_id")], 20).withColumnRenamed("doc_id", "id")
    q, d = v.text_queries(spark, sf_dir), v.table(spark, sf_dir, "documents")
    phrase = r.phrase_bonus(d, q).select("query_id", "doc_id")
    expected = phrase.join(q, "query_id").join(d.select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("query_text"))).select("query_id", F.col("doc_id").alias("id"))
    return e.recall_mrr(found, expected).select("query_id", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


_LAT = "lat AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)"


@query(f"WITH {_LAT} SELECT event_type, count(*) AS n, round(median(value), 6) AS median, min(value) AS least, max(value) AS most, max(value) FILTER (i = ceil(0.95 * n) - 1) AS p95, max(value) FILTER (i = least(n - 1, floor(0.95 * n))) AS p95_item FROM lat GROUP BY 1")
def e07_latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.latency_summary(v.table(spark, sf_dir, "events"), "event_type", "value").withColumn("median", F.round("median", 6))


@query("WITH a AS (SELECT event_type, avg(value) AS x FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type, avg(value) AS x FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT event_type, round(a.x, 6) AS before, round(b.x, 6) AS after, round(100 * (b.x - a.x) / a.x, 6) AS change_percent FROM a JOIN b USING (event_type)")
def e08_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = v.table(spark, sf_dir, "events")
    half = lambda n: ev.where(F.col("event_id") % 2 == n).groupBy("event_type").agg(F.avg("value").alias("x"))
    d = e.before_after(half(0), half(1), "event_type", "x")
    return d.select("event_type", *(F.round(x, 6).alias(x) for x in ("before", "after", "change_percent")))


@query(f"WITH {_RANKS}, b AS (SELECT kind, CASE WHEN video_rank <= 5 THEN '1-5' WHEN video_rank <= 10 THEN '6-10' WHEN video_rank <= 20 THEN '11-20' WHEN video_rank <= 100 THEN '21-100' ELSE 'not found' END AS band FROM ranks) SELECT kind, count_if(band = '1-5')::BIGINT AS \"1-5\", count_if(band = '6-10')::BIGINT AS \"6-10\", count_if(band = '11-20')::BIGINT AS \"11-20\", count_if(band = '21-100')::BIGINT AS \"21-100\", count_if(band = 'not found')::BIGINT AS \"not found\" FROM b GROUP BY 1")
def e09_rank_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.rank_bands(ranks(spark, sf_dir).select("kind", F.col("video_rank").alias("rank")), "kind")


@query(f"WITH {_RECALL} SELECT x.kind AS method, x.k, round(y.found / y.queries - x.found / x.queries, 6) AS delta FROM rec x JOIN rec y ON y.k = x.k AND y.kind = 'KIS' WHERE x.kind <> 'KIS'")
def e10_method_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ranks(spark, sf_dir).select("kind", F.col("video_rank").alias("rank"))
    m = e.recall_at(x, e.CUTS, "kind").where("kind is not null").select(F.col("kind").alias("method"), "k", "recall")
    return e.method_delta(m, "KIS").withColumn("delta", F.round("delta", 6))


@query("WITH x AS (SELECT o_custkey AS query_id, o_orderkey AS position, o_orderstatus = 'F' AS error FROM orders) SELECT query_id, arg_max(position, struct_pack(a := NOT error, b := position)) AS position, bool_and(error) AS error FROM x GROUP BY 1")
def e11_best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = v.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("position"), (F.col("o_orderstatus") == "F").alias("error"))
    return e.best_checkpoint(o, "position")


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the mean value of views less that of clicks."""
    ev = v.table(spark, sf_dir, "events")
    mean = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    return ev.groupBy(F.col("user_id").alias("query_id")).agg((mean("view") - mean("click")).alias("diff")).where("diff is not null")


@query()
def e12_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.bootstrap_ci(_diffs(spark, sf_dir))


@query()
def e13_sign_flip_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.sign_flip_test(_diffs(spark, sf_dir))


@query(
    LISTS
    + """, tr AS (SELECT query_id, doc_id AS frame FROM text_queries JOIN documents ON contains(lower(text), lower(query_text))),
    st AS (SELECT 'semantic' AS stage, query_id, frame_id AS frame FROM sem UNION ALL SELECT 'text', query_id, frame_id FROM txt UNION ALL SELECT 'union', query_id, frame_id FROM sem UNION ALL SELECT 'union', query_id, frame_id FROM txt UNION ALL SELECT 'top', query_id, frame_id FROM sem WHERE rank <= 3)
    SELECT stage, count(DISTINCT CASE WHEN tr.frame IS NOT NULL THEN st.query_id END) AS found, (SELECT count(DISTINCT query_id) FROM tr) AS queries FROM st LEFT JOIN tr ON tr.query_id = st.query_id AND tr.frame = st.frame GROUP BY 1"""
)
def e14_candidate_recall_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = r.fuse_outer(*two_lists(spark, sf_dir))
    first, second = F.col("semantic_rank"), F.col("text_rank")
    named = F.array_compact(F.array(F.when(first.isNotNull(), "semantic"), F.when(second.isNotNull(), "text"), F.lit("union"), F.when(first <= 3, "top")))
    stages = f.select(F.explode(named).alias("stage"), "query_id", F.col("frame_id").alias("frame"))
    truth = r.phrase_bonus(v.table(spark, sf_dir, "documents"), v.text_queries(spark, sf_dir)).select("query_id", F.col("doc_id").alias("frame"))
    return e.recall_funnel(stages, truth)


@query(f"WITH {_ANSWERS} SELECT query_name AS query_id, count(DISTINCT video) FILTER (rank <= 20) AS videos_20, count(DISTINCT video) FILTER (rank <= 50) AS videos_50, count(DISTINCT video) FILTER (rank <= 100) AS videos_100, round(count(*) / count(DISTINCT video), 6) AS frames_per_video FROM answers GROUP BY 1")
def e15_diversity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.diversity(answers(spark, sf_dir)[0]).withColumn("frames_per_video", F.round("frames_per_video", 6))


@query(
    f"""WITH {_TRUTH}, {_ANSWERS}, x AS (SELECT query_name AS query_id, rank, list_transform(frames, lambda f: greatest(0, part - 300 - f, f - part - 300)) AS off, frames FROM answers JOIN truth USING (query_name) WHERE kind = 'TRAKE')
    SELECT query_id, CAST(rank AS INTEGER) AS rank, len(list_filter(off, lambda o: o = 0)) / 2 AS matched, frames[2] > frames[1] AS rising, list_sum(off) / 2 AS distance FROM x"""
)
def e16_sequence_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, t = answers(spark, sf_dir)
    d = a.select(F.concat_ws("#", "query_id", "rank").alias("key"), "query_id", "frames", "rank").join(t.where("kind = 'TRAKE'").select("query_id", "ranges"), "query_id")
    s = e.sequence_diagnostics(d.select(F.col("key").alias("query_id"), "frames"), d.select(F.col("key").alias("query_id"), "ranges"))
    return s.select(F.split_part("query_id", F.lit("#"), F.lit(1)).alias("query_id"), F.split_part("query_id", F.lit("#"), F.lit(2)).cast("int").alias("rank"), "matched", "rising", "distance")


@query("SELECT o_orderpriority AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share, list_slice(list_sort(list_distinct(list(o_orderkey))), 1, 3) AS sample FROM orders GROUP BY 1")
def e17_failure_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = e.failure_taxonomy(v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("label")))
    return t.withColumn("share", F.round("share", 6))
