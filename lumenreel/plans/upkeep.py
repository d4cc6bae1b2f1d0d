"""Queries that keep tables up: copies of related tables, writes in place, streams of parts; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenreel.operators import aggregates as a
from lumenreel.operators import preflight, sync
from lumenreel.plans import views as v
from lumenreel.plans.common import register
from lumenreel.plans.records import annotation_rows
from lumenreel.sources import in_place
from lumenreel.sources.scratch import shared_path
from lumenreel.streaming import ingest

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = register(QUERIES, SQL)


# Copies of related tables: the source lacks every tenth customer, the target has numbered a third of them itself.

SHOP = {
    "region": sync.Table("r_regionkey"),
    "lineitem": sync.Table("line", parents={"l_orderkey": "orders"}, order="l_quantity"),
    "orders": sync.Table("o_orderkey", parents={"o_custkey": "customer"}, times=("placed",)),
    "customer": sync.Table("c_custkey", parents={"c_nationkey": "nation"}, natural=(("c_name",),), json={"info": "{}"}, booleans=("active",)),
    "nation": sync.Table("n_nationkey", parents={"n_regionkey": "region"}),
}


def _shop(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    c, o, li = (v.table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    n, r = (v.table(spark, sf_dir, t) for t in ("nation", "region"))
    key = F.col("c_custkey")
    info = F.when(key % 4 == 0, F.concat(F.lit('{"segment": "'), "c_mktsegment", F.lit('"}'))).when(key % 4 == 1, "{broken").when(key % 4 == 3, " [1, 2]")
    active = F.when(key % 3 == 0, "Yes").when(key % 3 == 1, "off")
    placed = F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    line = F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("line")
    source = {
        "region": r, "nation": n, "customer": c.where(key % 10 != 9).select("c_custkey", "c_name", "c_nationkey", info.alias("info"), active.alias("active")),
        "orders": o.select("o_orderkey", "o_custkey", "o_orderstatus", placed.alias("placed")), "lineitem": li.select(line, "l_orderkey", "l_quantity"),
    }
    target = {
        "region": r.where("r_regionkey < 2"), "nation": n.where("n_nationkey < 10"),
        "customer": c.where(key % 3 == 0).select((key + 7).alias("c_custkey"), "c_name", "c_nationkey", F.lit("[]").alias("info"), F.lit(False).alias("active")),
        "orders": o.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit(-1).cast("long").alias("o_custkey"), F.lit("X").alias("o_orderstatus"), F.lit(None).cast("timestamp").alias("placed")),
        "lineitem": li.where("l_orderkey % 8 = 0").select(line, "l_orderkey", F.lit(0.0).alias("l_quantity")).dropDuplicates(["line"]),
    }
    return source, target


_SHOP = """WITH source_c AS (SELECT c_custkey AS old, c_name, c_nationkey,
    CASE c_custkey % 4 WHEN 0 THEN '{"segment":"' || c_mktsegment || '"}' WHEN 3 THEN '[1,2]' ELSE '{}' END AS info, c_custkey % 3 = 0 AS active FROM customer WHERE c_custkey % 10 <> 9),
  target_c AS (SELECT c_custkey + 7 AS c_custkey, c_name, c_nationkey, '[]' AS info, false AS active FROM customer WHERE c_custkey % 3 = 0),
  ends AS (SELECT min(k) AS low, max(k) AS high FROM (SELECT old AS k FROM source_c UNION ALL SELECT c_custkey FROM target_c)),
  numbers AS (SELECT s.old, coalesce(t.c_custkey, CASE WHEN s.old IN (SELECT c_custkey FROM target_c) THEN s.old + high - low + 1 ELSE s.old END) AS new
    FROM source_c s LEFT JOIN target_c t USING (c_name), ends),
  given_c AS (SELECT new AS c_custkey, c_nationkey, info, active FROM source_c JOIN numbers USING (old)),
  all_c AS (SELECT coalesce(g.c_custkey, t.c_custkey) AS k, CASE WHEN g.c_custkey IS NULL THEN t.c_nationkey ELSE g.c_nationkey END AS parent,
      CASE WHEN g.c_custkey IS NULL THEN t.info || '|' || t.active ELSE g.info || '|' || g.active END AS value,
      CASE WHEN t.c_custkey IS NULL THEN 'inserted' WHEN g.c_custkey IS NULL THEN 'kept' ELSE 'updated' END AS state
    FROM given_c g FULL JOIN target_c t ON g.c_custkey = t.c_custkey),
  given_o AS (SELECT o_orderkey, new, o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS placed FROM orders JOIN numbers ON o_custkey = old),
  target_o AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0),
  all_o AS (SELECT coalesce(g.o_orderkey, t.o_orderkey) AS k, coalesce(g.new, -1) AS parent, CASE WHEN g.o_orderkey IS NULL THEN 'X|' ELSE o_orderstatus || '|' || placed END AS value,
      CASE WHEN t.o_orderkey IS NULL THEN 'inserted' WHEN g.o_orderkey IS NULL THEN 'kept' ELSE 'updated' END AS state
    FROM given_o g FULL JOIN target_o t ON g.o_orderkey = t.o_orderkey),
  given_l AS (SELECT l_orderkey || '-' || l_linenumber AS line, l_orderkey, max(l_quantity) AS q FROM lineitem WHERE l_orderkey IN (SELECT k FROM all_o) GROUP BY ALL),
  target_l AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber AS line, l_orderkey FROM lineitem WHERE l_orderkey % 8 = 0),
  all_l AS (SELECT coalesce(g.line, t.line) AS k, coalesce(g.l_orderkey, t.l_orderkey) AS parent, CAST(CAST(coalesce(q, 0) AS BIGINT) AS VARCHAR) AS value,
      CASE WHEN t.line IS NULL THEN 'inserted' WHEN g.line IS NULL THEN 'kept' ELSE 'updated' END AS state
    FROM given_l g FULL JOIN target_l t ON g.line = t.line)
"""


@query(
    _SHOP
    + """SELECT 'customer' AS table_name, CAST(k AS VARCHAR) AS row_key, CAST(parent AS BIGINT) AS parent_key, value, state FROM all_c
    UNION ALL SELECT 'orders', CAST(k AS VARCHAR), parent, value, state FROM all_o UNION ALL SELECT 'lineitem', k, parent, value, state FROM all_l"""
)
def s20_sync_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five tables copied in the order of their foreign keys; customers get the target's numbers, and their orders follow."""
    t = sync.sync_tables(*_shop(spark, sf_dir), SHOP).tables
    rows = {
        "customer": ("c_custkey", "c_nationkey", F.concat("info", F.lit("|"), F.col("active").cast("string"))),
        "orders": ("o_orderkey", "o_custkey", F.concat("o_orderstatus", F.lit("|"), F.coalesce(F.date_format("placed", "yyyy-MM-dd"), F.lit("")))),
        "lineitem": ("line", "l_orderkey", F.col("l_quantity").cast("long").cast("string")),
    }
    parts = [
        t[n].select(F.lit(n).alias("table_name"), F.col(k).cast("string").alias("row_key"), F.col(p).cast("long").alias("parent_key"), x.alias("value"), "state")
        for n, (k, p, x) in rows.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    _SHOP
    + """, n AS (SELECT 'customer' AS table_name, (SELECT count(*) FROM source_c) AS source_rows, 0 AS rejected, state FROM all_c
      UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT old FROM numbers)), state FROM all_o
      UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem), (SELECT count(DISTINCT l_orderkey || '-' || l_linenumber) FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM all_o)), state FROM all_l
      UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), 0, CASE WHEN n_nationkey < 10 THEN 'updated' ELSE 'inserted' END FROM nation
      UNION ALL SELECT 'region', (SELECT count(*) FROM region), 0, CASE WHEN r_regionkey < 2 THEN 'updated' ELSE 'inserted' END FROM region)
    SELECT table_name, any_value(source_rows) AS source_rows, CAST(any_value(rejected) AS BIGINT) AS rejected, count(*) FILTER (state = 'inserted') AS inserted,
      count(*) FILTER (state = 'updated') AS updated, count(*) FILTER (state = 'kept') AS kept FROM n GROUP BY 1"""
)
def s20_sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each table's rows."""
    return sync.sync_tables(*_shop(spark, sf_dir), SHOP).counts


# Parts that arrive over time


def _parts(spark: SparkSession, sf_dir: str, stages: tuple[str, ...], compact_after: int = 16) -> str:
    """Annotations written as JSON parts and taken in as a stream, stage by stage; gives the target."""
    source, target, checkpoint = (shared_path(spark, n) for n in ("parts", "merged", "checkpoint"))
    rows = annotation_rows(spark, sf_dir).withColumn("keyframe_id", F.col("keyframe_id").cast("string"))
    rows = rows.withColumn("embedding", F.array(F.col("row_id").cast("double"), F.lit(1.0)))
    for stage in stages:
        rows.where(stage).repartition(4).write.mode("append").json(source)
        ingest.ingest_annotations(spark, source, target, checkpoint, files_per_trigger=2, compact_after=compact_after).awaitTermination()
    return target


@query(
    f"""WITH {v.FRAMES}, c AS (SELECT video_id, event_type, max(frame_idx % 5) AS n FROM frames GROUP BY 1, 2),
    b AS (SELECT video_id, arg_max(event_type, frame_idx) FILTER (frame_idx % 4 <> 0) AS caption, max(frame_idx) AS last FROM frames GROUP BY 1),
    o AS (SELECT video_id, event_type, min(frame_idx) AS first FROM frames GROUP BY 1, 2)
    SELECT CAST(video_id AS VARCHAR) AS keyframe_id, caption, list(event_type ORDER BY first) AS labels, list(n ORDER BY event_type) AS counts, last AS embedded
    FROM b JOIN o USING (video_id) JOIN c USING (video_id, event_type) GROUP BY 1, 2, 5"""
)
def r01_ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later rows arrive first, in two runs of the stream with snapshots in between; the table is that of one batch."""
    target = _parts(spark, sf_dir, ("row_id % 3 = 2", "row_id % 3 < 2"), compact_after=2)
    merged = ingest.merged_annotations(spark, target)
    return merged.select("keyframe_id", "caption", "labels", F.map_values("counts").alias("counts"), F.get("embedding", F.lit(0)).cast("long").alias("embedded"))


# Writes in place


@query(
    """WITH u AS (SELECT o_custkey + 100 AS k, o_orderstatus AS seg, o_orderkey % 5 AS nation FROM orders WHERE o_custkey % 7 = 0
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1), t AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_nationkey AS nation FROM customer)
    SELECT coalesce(t.k, u.k) AS k, coalesce(u.seg, t.seg) AS seg, coalesce(u.nation, t.nation) AS nation FROM t FULL JOIN u ON t.k = u.k"""
)
def s18_upsert_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stored by nation; the last orders of every seventh move customers between nations."""
    path = shared_path(spark, "customers")
    v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nation")).write.partitionBy("nation").parquet(path)
    o = v.table(spark, sf_dir, "orders").where("o_custkey % 7 = 0")
    updates = o.select((F.col("o_custkey") + 100).alias("k"), F.col("o_orderstatus").alias("seg"), (F.col("o_orderkey") % 5).alias("nation"), "o_orderkey")
    in_place.upsert_partitions(spark, path, updates, "k", "nation", "o_orderkey")
    return spark.read.parquet(path).select("k", "seg", F.col("nation").cast("long").alias("nation"))


@query("SELECT doc_id, lang, text FROM documents WHERE lang NOT IN ('fr', 'de') UNION ALL SELECT doc_id + 1000000, lang, source FROM documents WHERE lang IN ('fr', 'de')")
def s19_replace_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stored by language; two languages' partitions are replaced, the others keep their files."""
    path = shared_path(spark, "by-language")
    d = v.table(spark, sf_dir, "documents")
    in_place.replace_partitions(d.select("doc_id", "text", "lang"), path, "lang")
    in_place.replace_partitions(d.where("lang in ('fr', 'de')").select((F.col("doc_id") + 1000000).alias("doc_id"), F.col("source").alias("text"), "lang"), path, "lang")
    return spark.read.parquet(path).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")


# Preflight


def _present(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, o, d, c, li, x = (v.table(spark, sf_dir, t) for t in ("events", "orders", "documents", "customer", "lineitem", "embeddings"))
    frame = F.expr("event_id div 2") % 40
    shots = e.select(
        F.when(F.col("event_id") % 97 == 0, " ").otherwise(F.concat(F.lit("u"), "user_id")).alias("video_id"), (F.col("event_id") % 50).alias("shot"), frame.alias("frame"),
        (F.col("event_type") != "view").alias("saved"), F.concat("user_id", F.lit("/"), frame, F.lit(".jpg")).alias("image"),
    )
    media = o.select(F.concat(F.col("o_custkey") % 150, F.lit("/"), F.col("o_orderkey") % 40, F.lit(".jpg")).alias("image")).distinct()
    maps = li.select((F.col("l_orderkey") % 2000).alias("video_id"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber") + (F.col("l_quantity") == 50).cast("int")).alias("n"))
    return preflight.presence(
        shots, media, d.select(F.col("source").alias("file"), F.col("text").alias("line")), c.select(F.col("c_custkey").alias("video_id")), maps,
        o.where("o_orderkey % 7 <> 3").select((F.col("o_orderkey") % 1800).alias("video_id")), d.select((F.col("doc_id") % 60).alias("name")), x.select((F.col("vec_id") % 50).alias("name")),
    )


_PRESENT = """WITH shots AS (SELECT CASE WHEN event_id % 97 = 0 THEN ' ' ELSE 'u' || user_id END AS video_id, event_id % 50 AS shot, (event_id // 2) % 40 AS frame,
    event_type <> 'view' AS saved, user_id || '/' || ((event_id // 2) % 40) || '.jpg' AS image FROM events),
  named AS (SELECT * FROM shots WHERE trim(video_id) <> ''),
  media AS (SELECT DISTINCT (o_custkey % 150) || '/' || (o_orderkey % 40) || '.jpg' AS image FROM orders),
  videos AS (SELECT c_custkey AS video_id FROM customer),
  maps AS (SELECT l_orderkey % 2000 AS video_id, l_linenumber AS line, l_linenumber + CAST(l_quantity = 50 AS INTEGER) AS n FROM lineitem),
  vectors AS (SELECT o_orderkey % 1800 AS video_id FROM orders WHERE o_orderkey % 7 <> 3),
  complete AS (SELECT video_id FROM videos WHERE video_id IN (SELECT video_id FROM maps) AND video_id IN (SELECT video_id FROM vectors)),
  event_maps AS (SELECT doc_id % 60 AS name FROM documents), event_vectors AS (SELECT vec_id % 50 AS name FROM embeddings)
"""


@query(
    _PRESENT
    + """SELECT *, event_mapping_rows = event_embedding_rows AS event_embedding_parity FROM (SELECT (SELECT count(*) FROM videos) AS per_video_rows, (SELECT count(*) FROM shots) AS shot_rows,
    (SELECT count(*) FROM named WHERE saved) AS saved_keyframe_rows, (SELECT count(DISTINCT video_id || '|' || shot) FROM named) AS unique_shots,
    (SELECT count(DISTINCT video_id || '|' || frame) FROM named) AS unique_keyframes, (SELECT count(*) FROM media) AS media_files,
    (SELECT count(*) FROM named WHERE saved AND image NOT IN (SELECT image FROM media)) AS missing_media_count,
    (SELECT count(*) FROM documents WHERE trim(text, ' ') <> '') AS annotations_rows, (SELECT count(DISTINCT source) FROM documents) AS annotations_files_count,
    (SELECT count(*) FROM maps WHERE video_id IN (SELECT video_id FROM complete)) AS map_rows_total, (SELECT count(*) FROM vectors WHERE video_id IN (SELECT video_id FROM complete)) AS vector_rows_total,
    (SELECT count(*) FROM maps WHERE video_id IN (SELECT video_id FROM complete) AND n <> line) AS map_n_sequential_mismatch_rows,
    (SELECT count(*) FROM videos WHERE video_id NOT IN (SELECT video_id FROM maps)) AS missing_map_files_count,
    (SELECT count(*) FROM videos WHERE video_id IN (SELECT video_id FROM maps) AND video_id NOT IN (SELECT video_id FROM vectors)) AS missing_feature_files_count,
    (SELECT count(*) FROM event_maps) AS event_mapping_rows, (SELECT count(*) FROM event_vectors WHERE name IN (SELECT name FROM event_maps)) AS event_embedding_rows,
    (SELECT count(DISTINCT name) FROM event_maps WHERE name NOT IN (SELECT name FROM event_vectors)) AS missing_event_feature_files_count)"""
)
def v04_preflight_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighteen metrics of shots, media, annotations, maps and vectors from one tagged union."""
    return preflight.preflight_metrics(_present(spark, sf_dir))


@query(
    _PRESENT
    + """, gone AS (SELECT 'missing_media' AS what, image AS key FROM named WHERE saved AND image NOT IN (SELECT image FROM media)
      UNION SELECT 'missing_map_files', CAST(video_id AS VARCHAR) FROM videos WHERE video_id NOT IN (SELECT video_id FROM maps)
      UNION SELECT 'missing_feature_files', CAST(video_id AS VARCHAR) FROM videos WHERE video_id IN (SELECT video_id FROM maps) AND video_id NOT IN (SELECT video_id FROM vectors)
      UNION SELECT 'missing_event_feature_files', CAST(name AS VARCHAR) FROM event_maps WHERE name NOT IN (SELECT name FROM event_vectors))
    SELECT what, key, CAST(row_number() OVER (PARTITION BY what ORDER BY key) AS INTEGER) AS place FROM gone QUALIFY place <= 20"""
)
def v04_preflight_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty missing keys of each kind."""
    return preflight.preflight_samples(_present(spark, sf_dir))


# The quality gate


def _gate(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e, c, o = (v.table(spark, sf_dir, t) for t in ("events", "customer", "orders"))
    k = F.col("event_id")
    shots = e.select(
        k.alias("row_id"), F.concat(F.lit("u"), "user_id").alias("video_id"), F.concat("user_id", F.lit("-"), F.expr("event_id div 3")).alias("keyframe_id"),
        F.when(k % 53 == 0, "v0").otherwise("v1").alias("profile_version"), F.when(k % 41 == 0, "no").when(k % 2 == 0, "TRUE").otherwise("1").alias("saved"),
        F.when(k % 67 == 0, "x").otherwise(((k % 10) * 100 + k % 110).cast("string")).alias("frame_idx"), ((k % 10) * 100).cast("string").alias("shot_start"), ((k % 10) * 100 + 99).cast("string").alias("shot_end"),
    )
    planned = c.where("c_custkey < 200").select(F.concat(F.lit("u"), "c_custkey").alias("video_id"))
    errors = o.where("o_orderkey % 500 = 0").select(F.concat(F.lit("u"), "o_custkey").alias("video_id"))
    return planned, shots, errors


_GATE = """WITH shots AS (SELECT event_id AS row_id, 'u' || user_id AS video_id, user_id || '-' || event_id // 3 AS keyframe_id, CASE WHEN event_id % 53 = 0 THEN 'v0' ELSE 'v1' END AS profile_version,
    event_id % 41 <> 0 AS saved, CASE WHEN event_id % 67 <> 0 THEN (event_id % 10) * 100 + event_id % 110 END AS frame, (event_id % 10) * 100 AS s FROM events),
  planned AS (SELECT 'u' || c_custkey AS video_id FROM customer WHERE c_custkey < 200), errors AS (SELECT 'u' || o_custkey AS video_id FROM orders WHERE o_orderkey % 500 = 0),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY keyframe_id ORDER BY row_id) AS a, row_number() OVER (PARTITION BY video_id, frame ORDER BY row_id) AS b FROM shots),
  found AS (SELECT 'profile' AS rule, video_id, row_id FROM ranked WHERE profile_version <> 'v1' UNION ALL SELECT 'unsaved', video_id, row_id FROM ranked WHERE NOT saved
    UNION ALL SELECT 'duplicate_keyframe', video_id, row_id FROM ranked WHERE a > 1 UNION ALL SELECT 'bad_integer', video_id, row_id FROM ranked WHERE frame IS NULL
    UNION ALL SELECT 'duplicate_frame', video_id, row_id FROM ranked WHERE frame IS NOT NULL AND b > 1 UNION ALL SELECT 'outside_shot', video_id, row_id FROM ranked WHERE frame NOT BETWEEN s AND s + 99
    UNION ALL SELECT 'missing_result', video_id, NULL FROM planned WHERE video_id NOT IN (SELECT video_id FROM shots) AND video_id NOT IN (SELECT video_id FROM errors)
    UNION ALL SELECT 'error_row', video_id, NULL FROM errors)
"""


@query(_GATE + "SELECT rule, video_id, row_id FROM found")
def v05_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preflight.quality_violations(*_gate(spark, sf_dir), "v1")


@query(
    _GATE
    + """SELECT count(*) FILTER (rule NOT IN ('error_row', 'unsaved')) = 0 AS passed, count(*) FILTER (rule NOT IN ('error_row', 'unsaved')) AS failures, count(*) FILTER (rule IN ('error_row', 'unsaved')) AS warnings,
    count(*) FILTER (rule = 'missing_result') AS missing_result, count(*) FILTER (rule = 'error_row') AS error_row, count(*) FILTER (rule = 'no_rows') AS no_rows, count(*) FILTER (rule = 'profile') AS profile,
    count(*) FILTER (rule = 'unsaved') AS unsaved, count(*) FILTER (rule = 'duplicate_keyframe') AS duplicate_keyframe, count(*) FILTER (rule = 'bad_integer') AS bad_integer,
    count(*) FILTER (rule = 'duplicate_frame') AS duplicate_frame, count(*) FILTER (rule = 'outside_shot') AS outside_shot, (SELECT count(DISTINCT video_id) FROM planned) AS planned_videos,
    (SELECT count(DISTINCT video_id) FROM shots) AS succeeded_videos, (SELECT count(DISTINCT video_id) FROM errors) AS failed_videos, (SELECT count(*) FROM shots) AS shot_rows,
    (SELECT count(DISTINCT keyframe_id) FROM shots) AS unique_keyframes FROM found"""
)
def v05_quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict where failed videos and unsaved rows are only warnings."""
    planned, shots, errors = _gate(spark, sf_dir)
    fatal = tuple(r for r in preflight.FATAL if r not in ("error_row", "unsaved"))
    return preflight.quality_verdict(planned, shots, errors, preflight.quality_violations(planned, shots, errors, "v1"), fatal)


@query(
    f"""WITH {v.FRAMES}, shots AS (SELECT o_custkey % 150 AS video_id, o_orderkey % 300 AS s, o_orderkey % 300 + o_orderkey % 7 - 1 AS e FROM orders)
    SELECT video_id, frame_idx, keyframe_id FROM frames f WHERE NOT EXISTS (SELECT 1 FROM shots WHERE shots.video_id = f.video_id AND f.frame_idx BETWEEN s AND e)"""
)
def v05_outside_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that no shot of their video holds."""
    k = F.col("o_orderkey")
    shots = v.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 150).alias("video_id"), (k % 300).alias("start"), (k % 300 + k % 7 - 1).alias("end"))
    return preflight.outside_intervals(v.frames(spark, sf_dir).select("video_id", "frame_idx", "keyframe_id"), shots, "video_id", "frame_idx", "start", "end")


# Index versions


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of documents as stored and as reviewed; version 1 has changed since, 3 lacks a source, 4 was not reviewed."""
    k = F.col("doc_id")
    kind = F.when(F.col("lang") == "fr", "ocr").when(F.col("lang") == "de", "asr").otherwise("caption")
    d = v.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("v"), k % 5).alias("version"), kind.alias("kind")).where("version <> 'v3' or kind <> 'asr'")

    def manifest(df: DataFrame) -> DataFrame:
        by = df.groupBy("version", F.lit("source").alias("metric"), F.col("kind").alias("key")).agg(F.count(F.lit(1)).alias("rows"))
        return by.unionByName(by.groupBy("version", F.lit("documents").alias("metric"), F.lit("all").alias("key")).agg(F.sum("rows").alias("rows")))

    return preflight.review_manifests(manifest(d), manifest(d.where("version <> 'v4' and doc_id % 50 <> 1")))


_VERSIONS = """WITH d AS (SELECT doc_id, 'v' || (doc_id % 5) AS version, CASE lang WHEN 'fr' THEN 'ocr' WHEN 'de' THEN 'asr' ELSE 'caption' END AS kind FROM documents WHERE doc_id % 5 <> 3 OR lang <> 'de'),
  a AS (SELECT version, kind, count(*) AS n FROM d GROUP BY ALL), e AS (SELECT version, kind, count(*) AS n FROM d WHERE version <> 'v4' AND doc_id % 50 <> 1 GROUP BY ALL),
  b AS (SELECT version, kind, a.n AS an, e.n AS en FROM a FULL JOIN e USING (version, kind)
    UNION ALL SELECT version, 'all', a2.n, e2.n FROM (SELECT version, sum(n) AS n FROM a GROUP BY 1) a2 FULL JOIN (SELECT version, sum(n) AS n FROM e GROUP BY 1) e2 USING (version)),
  g AS (SELECT version, CAST(coalesce(max(an) FILTER (kind = 'all'), 0) AS BIGINT) AS documents, count(*) FILTER (coalesce(an = en, false) = false) AS different,
    3 - count(*) FILTER (kind <> 'all' AND an > 0) AS uncovered, count(en) AS asked, count(an) AS there FROM b GROUP BY 1),
  reviews AS (SELECT version, documents, different, uncovered, CASE WHEN asked = 0 THEN 'not_reviewed' WHEN there = 0 THEN 'gone' WHEN different > 0 THEN 'changed'
    WHEN documents <= 0 THEN 'empty' WHEN uncovered > 0 THEN 'no_coverage' ELSE 'ok' END AS verdict FROM g)
"""


@query(_VERSIONS + "SELECT * FROM reviews")
def v14_compare_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir)


def _pointers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n, s = v.table(spark, sf_dir, "nation"), v.table(spark, sf_dir, "supplier")
    even = F.col("n_nationkey") % 2 == 0
    pointers = n.where(even).select(F.col("n_name").alias("alias"), F.lit("v0").alias("version"), F.when(F.col("n_nationkey") % 4 == 0, "v2").alias("previous"))
    k = F.col("s_suppkey")
    asked = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    requests = asked.select(
        k.alias("request_id"), F.when(k % 17 == 0, "v2").otherwise(F.col("n_name")).alias("alias"), F.when(k % 4 == 0, "rollback").otherwise("promote").alias("action"),
        F.when(k % 4 != 0, F.concat(F.lit("v"), k % 5)).alias("version"), F.when(k % 3 == 0, "v9").when(even, "v0").alias("expected"),
    )
    return pointers, requests


_POINTERS = (
    _VERSIONS
    + """, pointers AS (SELECT n_name AS alias, 'v0' AS version, CASE WHEN n_nationkey % 4 = 0 THEN 'v2' END AS previous FROM nation WHERE n_nationkey % 2 = 0),
  requests AS (SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 17 = 0 THEN 'v2' ELSE n_name END AS alias, CASE WHEN s_suppkey % 4 = 0 THEN 'rollback' ELSE 'promote' END AS action,
    CASE WHEN s_suppkey % 4 <> 0 THEN 'v' || (s_suppkey % 5) END AS version, CASE WHEN s_suppkey % 3 = 0 THEN 'v9' WHEN n_nationkey % 2 = 0 THEN 'v0' END AS expected FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  aimed AS (SELECT r.request_id, r.alias, r.action, r.expected, p.version AS now, CASE r.action WHEN 'rollback' THEN p.previous ELSE r.version END AS version FROM requests r LEFT JOIN pointers p USING (alias)),
  judged AS (SELECT a.*, CASE WHEN alias = 'v2' THEN 'alias_is_version' WHEN now IS DISTINCT FROM expected THEN 'stale' WHEN a.version IS NULL THEN 'nothing_before'
    WHEN coalesce(verdict, 'not_reviewed') <> 'ok' THEN coalesce(verdict, 'not_reviewed') ELSE 'apply' END AS decision FROM aimed a LEFT JOIN reviews USING (version)),
  decided AS (SELECT request_id, alias, action, version, CASE WHEN decision = 'apply' AND request_id <> min(request_id) FILTER (decision = 'apply') OVER (PARTITION BY alias) THEN 'stale' ELSE decision END AS decision FROM judged)
"""
)


@query(_POINTERS + "SELECT * FROM decided")
def v14_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to move aliases to versions, each held against the version its requester saw."""
    return preflight.decide_promotions(*_pointers(spark, sf_dir), _versions(spark, sf_dir))


@query(
    _POINTERS
    + """SELECT coalesce(p.alias, m.alias) AS alias, coalesce(m.version, p.version) AS version, CASE WHEN m.version IS NOT NULL THEN p.version ELSE p.previous END AS previous
    FROM pointers p FULL JOIN (SELECT alias, version FROM decided WHERE decision = 'apply') m ON p.alias = m.alias"""
)
def v14_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aliases after the requests that apply."""
    pointers, requests = _pointers(spark, sf_dir)
    return preflight.move_pointers(pointers, preflight.decide_promotions(pointers, requests, _versions(spark, sf_dir)))


# Inventory

_LEVELS = rf"""WITH {v.OBJECTS}, o AS (SELECT CASE WHEN page_id % 9 = 0 THEN object_key ELSE 'set/L' || (18 + page_id % 14) || '/' || object_key END AS key, size FROM objects),
  d AS (SELECT size, regexp_extract(lower(split_part(key, '/', -1)), '\.([^.]+)$', 1) AS extension, coalesce(nullif(regexp_extract(key, '(?:^|/)(L\d+)/', 1), ''), '<not_detected>') AS level,
    regexp_extract(key, '^(.*)/[^/]*$', 1) AS folder, len(string_split(key, '/')) AS depth FROM o),
  x AS (SELECT size, extension, level, folder, depth, unnest(['overview', 'extension', 'level', 'folder', 'depth']) AS grouping FROM d)
"""


@query(
    _LEVELS
    + r"""SELECT grouping, CASE grouping WHEN 'extension' THEN extension WHEN 'level' THEN level WHEN 'folder' THEN folder WHEN 'depth' THEN CAST(depth AS VARCHAR) END AS key, count(*) AS objects,
    CAST(sum(size) AS BIGINT) AS bytes, sum(size) / count(*) AS mean_bytes, max(size) AS largest, count(DISTINCT folder) AS folders, count(DISTINCT extension) AS extensions,
    count(DISTINCT level) FILTER (level <> '<not_detected>') AS levels, max(depth) AS deepest,
    CASE grouping WHEN 'level' THEN coalesce(max(TRY_CAST(regexp_extract(level, '^L(\d+)$', 1) AS BIGINT)), 9999) WHEN 'depth' THEN max(depth) END AS place FROM x GROUP BY 1, 2"""
)
def a14_inventory_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as objects of the levels L18 to L31, every ninth without a level."""
    key = F.when(F.col("page_id") % 9 == 0, F.col("object_key")).otherwise(F.concat(F.lit("set/L"), F.col("page_id") % 14 + 18, F.lit("/"), "object_key"))
    return a.inventory(v.objects(spark, sf_dir).select(key.alias("object_key"), "size"))
