"""Queries on ranking, and the same in SQL."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenreel.functions import text as ft
from lumenreel.operators import ranking as r
from lumenreel.operators import hooks
from lumenreel.plans import views as v
from lumenreel.plans.common import register

QUERIES: dict = {}
SQL: dict[str, str] = {}


query = register(QUERIES, SQL)


#: Tokens in DuckDB, of column x.
def tokens_sql(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 1)"


Q_TOKENS = f"q_tokens AS (SELECT query_id, token, count(*) AS q_tf FROM (SELECT query_id, unnest({tokens_sql('query_text')}) AS token FROM text_queries) GROUP BY ALL)"
D_TOKENS = f"d_tokens AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS token FROM documents) GROUP BY ALL)"
OVERLAP = f"""{v.TEXT_QUERIES}, {Q_TOKENS}, {D_TOKENS},
 q_norm AS (SELECT query_id, sqrt(sum(q_tf * q_tf)) AS qn FROM q_tokens GROUP BY 1), d_norm AS (SELECT doc_id, sqrt(sum(tf * tf)) AS dn FROM d_tokens GROUP BY 1),
 pair_scores AS (SELECT query_id, doc_id, sum(least(tf, q_tf)) / (any_value(qn) * any_value(dn)) AS score FROM d_tokens JOIN q_tokens USING (token) JOIN q_norm USING (query_id) JOIN d_norm USING (doc_id) GROUP BY 1, 2)"""


def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.overlap_scores(v.table(spark, sf_dir, "documents"), v.text_queries(spark, sf_dir), ["doc_id"])


@query(
    f"""WITH {OVERLAP}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM pair_scores)
    SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, source FROM ranked JOIN documents USING (doc_id) WHERE rank <= 10"""
)
def t04_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = r.top(lexical(spark, sf_dir), ["query_id"], [F.desc(F.round("score", 9)), F.asc("doc_id")], 10)
    return best.join(v.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"), "source")


@query(
    f"""WITH {v.TEXT_QUERIES}, q AS (SELECT query_id, query_text FROM text_queries), d AS (SELECT doc_id AS k, text, source FROM documents),
    m AS (SELECT k, source, query_text, text FROM d JOIN q ON k = query_id),
    s AS (SELECT k, source, {tokens_sql("query_text")} AS a, {tokens_sql("text")} AS b FROM m),
    c AS (SELECT k, source, list_aggregate(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda u: u = t)), len(list_filter(b, lambda u: u = t)))), 'sum') AS shared,
      list_aggregate(list_transform(list_distinct(a), lambda t: len(list_filter(a, lambda u: u = t)) ** 2), 'sum') AS na, list_aggregate(list_transform(list_distinct(b), lambda t: len(list_filter(b, lambda u: u = t)) ** 2), 'sum') AS nb FROM s)
    SELECT k AS query_id, source, round(coalesce(shared / (sqrt(na) * sqrt(nb)), 0), 6) AS score FROM c"""
)
def t04_overlap_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlap score as a SQL function: each passage against the document of its number."""
    hooks.register(spark)
    v.text_queries(spark, sf_dir).createOrReplaceTempView("asked_passages")
    v.table(spark, sf_dir, "documents").createOrReplaceTempView("stored_documents")
    return spark.sql("SELECT query_id, source, round(overlap_score(query_text, text), 6) AS score FROM asked_passages JOIN stored_documents ON doc_id = query_id")


BOOSTS = {"asr": 2.5, "ocr": 3.0, "caption": 1.5}


@query(
    f"""WITH {OVERLAP}, {v.ANNOTATIONS}, boosted AS (SELECT query_id, doc_id, score + score * CASE source_type WHEN 'asr' THEN 2.5 WHEN 'ocr' THEN 3.0 ELSE 1.5 END AS score
      FROM pair_scores JOIN annotations ON keyframe_id = doc_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM boosted WHERE score > 0)
    SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM ranked WHERE rank <= 20"""
)
def t05_text_topk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap over all fields joined, plus the one field's overlap times its boost."""
    a = v.annotations(spark, sf_dir).withColumnRenamed("keyframe_id", "doc_id")
    scores = r.overlap_scores(a, v.text_queries(spark, sf_dir), ["doc_id", "source_type"])
    boost = F.element_at(F.create_map(*(F.lit(x) for kv in BOOSTS.items() for x in kv)), F.col("source_type"))
    total = scores.groupBy("query_id", "doc_id").agg(F.sum(F.col("score") * (1 + boost)).alias("score"))
    return r.top(total.where("score > 0"), ["query_id"], [F.desc(F.round("score", 9)), F.asc("doc_id")], 20).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


BEST_FIELDS = """field_p AS (SELECT d.doc_id, source_type AS field, token, tf FROM d_tokens d JOIN annotations ON keyframe_id = d.doc_id),
 field_len AS (SELECT doc_id, field, sum(tf) AS length FROM field_p GROUP BY 1, 2), field_stats AS (SELECT field, count(*) AS n_docs, avg(length) AS mean_length FROM field_len GROUP BY 1),
 field_df AS (SELECT field, token, count(*) AS df FROM field_p GROUP BY 1, 2),
 field_need AS (SELECT query_id, CASE WHEN count(*) <= 2 THEN count(*) WHEN count(*) <= 4 THEN floor(count(*) * 0.75) ELSE floor(count(*) * 0.5) END AS need FROM q_tokens GROUP BY 1),
 field_hits AS (SELECT query_id, doc_id, field, count(*) AS matched,
  CASE field WHEN 'asr' THEN 2.5 WHEN 'ocr' THEN 3.0 ELSE 1.5 END * sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))) AS s
  FROM field_p JOIN q_tokens USING (token) JOIN field_df USING (field, token) JOIN field_len USING (doc_id, field) JOIN field_stats USING (field) GROUP BY 1, 2, 3),
 field_best AS (SELECT query_id, doc_id, max(s) AS score FROM field_hits JOIN field_need USING (query_id) WHERE matched >= need GROUP BY 1, 2)"""


def bm25(spark: SparkSession, sf_dir: str, k: int | None) -> DataFrame:
    fields = v.annotations(spark, sf_dir).select(F.col("keyframe_id").alias("doc_id"), F.col("source_type").alias("field"), "text")
    return r.best_fields(fields, v.text_queries(spark, sf_dir), spark.createDataFrame(list(BOOSTS.items()), "field string, boost double"), k)


@query(
    f"""WITH {v.TEXT_QUERIES}, {v.ANNOTATIONS}, {Q_TOKENS}, {D_TOKENS}, {BEST_FIELDS},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM field_best)
    SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM ranked WHERE rank <= 20"""
)
def t06_text_topk_best_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(spark, sf_dir, 20).select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {v.TEXT_QUERIES} SELECT query_id, doc_id, CAST(0.5 AS DOUBLE) AS bonus FROM text_queries JOIN documents ON contains(lower(text), lower(query_text))")
def t07_phrase_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole passages as phrases."""
    return r.phrase_bonus(v.table(spark, sf_dir, "documents"), v.text_queries(spark, sf_dir))


VQ = "vq AS (SELECT vec_id AS query_id, embedding AS query, label AS q_label FROM embeddings WHERE vec_id % 100 = 0)"
COS = "list_cosine_similarity(CAST(query AS DOUBLE[]), CAST(embedding AS DOUBLE[]))"


def vector_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries every row whose id is divisible by 100."""
    e = v.table(spark, sf_dir, "embeddings")
    return e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "label")


def _best(found: DataFrame, k: int) -> DataFrame:
    best = r.top(found, ["query_id"], [F.desc(F.round("score", 9)), F.asc("vec_id")], k)
    return best.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(
    f"""WITH {VQ}, s AS (SELECT query_id, vec_id, {COS} AS score FROM vq, embeddings),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM ranked WHERE rank <= 10"""
)
def t01_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, asked = vector_tables(spark, sf_dir)
    return _best(r.cosine_blocks(e, asked, r.best_of_block(10), "query_id long, vec_id long, score double"), 10)


@query(
    f"""WITH {VQ}, s AS (SELECT query_id, vec_id, {COS} AS score FROM vq, embeddings WHERE label = q_label),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM ranked WHERE rank <= 10"""
)
def j03_restricted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only vectors of the query's own label may be hits."""
    e, asked = vector_tables(spark, sf_dir)
    return _best(r.cosine_blocks(e, asked, r.best_of_block(10), "query_id long, vec_id long, score double", ["label"]), 10)


@query(
    f"""WITH {VQ}, s AS (SELECT query_id, label AS video_id, vec_id, {COS} AS score FROM vq, embeddings WHERE vec_id <> query_id),
    best AS (SELECT query_id, video_id, max(score) AS score, arg_min(vec_id, struct_pack(a := -round(score, 9), b := vec_id)) AS vec_id FROM s GROUP BY 1, 2),
    t AS (SELECT query_id, score AS target_score FROM best JOIN vq USING (query_id) WHERE video_id = q_label)
    SELECT query_id, video_id, vec_id, round(score, 6) AS score, CAST(1 + (SELECT count(*) FROM best b2 WHERE b2.query_id = best.query_id AND round(b2.score, 9) > round(target_score, 9)) AS BIGINT) AS target_rank
    FROM best JOIN t USING (query_id)"""
)
def t03_scan_rank_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hit of each video, and the rank of the target video (the query's own label): 1 + strictly better ones."""
    e, asked = vector_tables(spark, sf_dir)

    def keep(asked: dict, rows: dict, scores: np.ndarray) -> list:
        code = pc.dictionary_encode(rows["label"], null_encoding="encode").indices.to_numpy()
        out = []
        for i, (own, one) in enumerate(zip(asked["id"], scores, strict=True)):
            order = np.lexsort((rows["id"], -np.round(one, 9), code))
            order = order[rows["id"][order] != own]
            first = order[np.flatnonzero(np.diff(code[order], prepend=-1))]
            out.append((np.full(len(first), i), first))
        of, place = (np.concatenate(c) for c in zip(*out, strict=True))
        return [asked["id"][of], asked["label"].take(of), rows["label"].take(place), rows["id"][place], scores[of, place]]

    s = r.cosine_blocks(e, asked, keep, "query_id long, target int, video_id int, vec_id long, score double")
    best = s.groupBy("query_id", "target", "video_id").agg(F.max("score").alias("score"), F.min_by("vec_id", F.struct((-F.round("score", 9)).alias("s"), "vec_id")).alias("vec_id"))
    w = Window.partitionBy("query_id")
    goal = F.max(F.when(F.col("video_id") == F.col("target"), F.round("score", 9))).over(w)
    ranked = best.withColumn("goal", goal).withColumn("target_rank", 1 + F.sum((F.round("score", 9) > F.col("goal")).cast("long")).over(w))
    return ranked.where("goal is not null").select("query_id", "video_id", "vec_id", F.round("score", 6).alias("score"), "target_rank")


#: All hits of two scorers: token overlap, and the best field by BM25.
LISTS = f"""WITH {OVERLAP}, {v.ANNOTATIONS}, {BEST_FIELDS},
 sem AS (SELECT query_id, doc_id AS frame_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM pair_scores),
 txt AS (SELECT query_id, doc_id AS frame_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM field_best)"""


def two_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All hits of two scorers with their ranks: token overlap, and the best field by BM25."""
    ranked = lexical(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc("doc_id"))))
    fields = bm25(spark, sf_dir, None).withColumn("score", F.round("score", 9))
    return ranked.withColumnRenamed("doc_id", "frame_id"), fields.withColumnRenamed("doc_id", "frame_id")


@query(
    LISTS
    + """ SELECT query_id, frame_id, round(coalesce(sem.score, 0), 6) AS semantic_score, round(coalesce(txt.score, 0), 6) AS text_score,
    CAST(sem.rank AS INTEGER) AS semantic_rank, CAST(txt.rank AS INTEGER) AS text_rank FROM sem FULL JOIN txt USING (query_id, frame_id)"""
)
def j02_fuse_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = r.fuse_outer(*two_lists(spark, sf_dir))
    return f.withColumns({c: F.round(c, 6) for c in ("semantic_score", "text_score")})


@query(
    LISTS
    + """, u AS (SELECT query_id, frame_id, 2 * rank AS turn FROM sem UNION ALL SELECT query_id, frame_id, 2 * rank + 1 FROM txt),
    f AS (SELECT query_id, frame_id, min(turn) AS turn FROM u GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn, frame_id) AS place FROM f)
    SELECT query_id, frame_id, CAST(place AS INTEGER) AS place FROM o WHERE place <= 100"""
)
def t10_candidate_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.candidate_cap(*two_lists(spark, sf_dir), 5).select("query_id", "frame_id", "place")


HYBRID = (
    LISTS
    + """, fu AS (SELECT query_id, frame_id, coalesce(sem.score, 0) AS ss, coalesce(txt.score, 0) AS ts, (frame_id % 10) / 10.0 AS quality FROM sem FULL JOIN txt USING (query_id, frame_id)),
    n AS (SELECT *, CASE WHEN max(ss) OVER q > 0 THEN ss / max(ss) OVER q ELSE 0 END AS s, CASE WHEN max(ts) OVER q > 0 THEN ts / max(ts) OVER q ELSE 0 END AS t,
      0.6 * CASE WHEN ss > 0 THEN 1.0 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY ss DESC, frame_id)) ELSE 0 END +
      0.3 * CASE WHEN ts > 0 THEN 1.0 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY ts DESC, frame_id)) ELSE 0 END AS r FROM fu WINDOW q AS (PARTITION BY query_id)),
    h AS (SELECT query_id, frame_id, 0.65 * (0.6 * s + 0.3 * t + 0.1 * quality) + 0.35 * CASE WHEN max(r) OVER q > 0 THEN r / max(r) OVER q ELSE 0 END AS score FROM n WINDOW q AS (PARTITION BY query_id)),
    hybrid AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, frame_id DESC) AS rank FROM h)"""
)


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = r.fuse_outer(*two_lists(spark, sf_dir)).withColumn("quality", (F.col("frame_id") % 10) / 10.0)
    scored = r.hybrid_fuse(fused, 0.6, 0.3, 0.1)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.desc("frame_id"))))


@query(HYBRID + " SELECT query_id, frame_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM hybrid")
def t11_hybrid_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(spark, sf_dir).select("query_id", "frame_id", F.round("score", 6).alias("score"), "rank")


@query(
    HYBRID
    + """, x AS (SELECT *, (frame_id % 7) / 7.0 AS cr, (frame_id % 5) / 5.0 AS al FROM hybrid), hd AS (SELECT *, max(cr) OVER q AS ch, min(cr) OVER q AS cl, max(al) OVER q AS ah, min(al) OVER q AS al0 FROM x WHERE rank <= 20 WINDOW q AS (PARTITION BY query_id)),
    m AS (SELECT query_id, frame_id, 0.7 * score + 0.3 * (0.8 * CASE WHEN ch > cl THEN (cr - cl) / (ch - cl) WHEN cr > 0 THEN 1 ELSE 0 END + 0.2 * CASE WHEN ah > al0 THEN (al - al0) / (ah - al0) WHEN al > 0 THEN 1 ELSE 0 END) AS score FROM hd
      UNION ALL SELECT query_id, frame_id, score FROM x WHERE rank > 20)
    SELECT query_id, frame_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, frame_id) AS INTEGER) AS rank FROM m"""
)
def t12_rerank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = hybrid(spark, sf_dir).select("query_id", "frame_id", "score", "rank", ((F.col("frame_id") % 7) / 7.0).alias("cross"), ((F.col("frame_id") % 5) / 5.0).alias("aligned"))
    return r.rerank_blend(ranked, 20, 0.3, 0.8, 0.2).select("query_id", "frame_id", F.round("score", 6).alias("score"), "rank")


@query(
    LISTS
    + """, ls AS (SELECT 'a' AS model, 0.6 AS w, query_id, frame_id, score FROM sem UNION ALL SELECT 'b', 0.4, query_id, frame_id, score FROM txt),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id, model ORDER BY score DESC, frame_id) AS rank FROM ls)
    SELECT query_id, frame_id, round(sum(w / (60 + rank)), 6) AS score FROM k GROUP BY 1, 2"""
)
def a07_rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = two_lists(spark, sf_dir)
    lists = s.select("query_id", F.lit("a").alias("model"), F.lit(0.6).alias("weight"), "frame_id", "score").unionByName(t.select("query_id", F.lit("b").alias("model"), F.lit(0.4).alias("weight"), "frame_id", "score"))
    return r.reciprocal_rank_fusion(lists).withColumn("score", F.round("score", 6))


@query(LISTS + """, ls AS (SELECT 0.6 * score AS x, query_id, frame_id FROM sem UNION ALL SELECT 0.4 * score, query_id, frame_id FROM txt) SELECT query_id, frame_id, round(max(x), 6) AS score FROM ls GROUP BY 1, 2""")
def a08_max_weighted_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = two_lists(spark, sf_dir)
    lists = s.withColumn("weight", F.lit(0.6)).unionByName(t.withColumn("weight", F.lit(0.4)))
    return r.max_weighted_fusion(lists).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {v.CANDIDATES} SELECT query_id, 'm' AS model, video_id AS frame_id, max(score) AS score,
    arg_min(event_index, struct_pack(a := -score, b := event_index)) AS variant FROM candidates WHERE score > 0 GROUP BY 1, 3"""
)
def a06_max_score_per_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hit of each video of a day, and the first event index with it."""
    c = v.candidates(spark, sf_dir)
    return r.best_hit(c.select("query_id", F.lit("m").alias("model"), F.col("video_id").alias("frame_id"), F.col("event_index").alias("variant"), "score"))


@query(
    f"""WITH {v.CANDIDATES}, b AS (SELECT query_id, event_index, video_id, max(score) AS score FROM candidates GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, event_index ORDER BY score DESC, video_id) AS rank FROM b), nv AS (SELECT query_id, count(DISTINCT event_index) AS views FROM rk GROUP BY 1),
    p AS (SELECT query_id, video_id, max(score) AS best, avg(score) AS mean, sum(1.0 / (60 + rank)) AS rrf, count(DISTINCT event_index) AS seen FROM rk GROUP BY 1, 2)
    SELECT query_id, video_id AS frame_id, round(CASE WHEN views = 1 THEN best ELSE 0.58 * best + 0.24 * mean + 0.13 * rrf / max(rrf) OVER (PARTITION BY query_id) + 0.05 * seen / views END, 6) AS score FROM p JOIN nv USING (query_id)"""
)
def a09_multiview_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = v.candidates(spark, sf_dir)
    best = c.groupBy("query_id", F.col("event_index").alias("view"), F.col("video_id").alias("frame_id")).agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "view").orderBy(F.desc("score"), "frame_id")))
    return r.merge_views(ranked).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {v.CANDIDATES}, x AS (SELECT query_id, keyframe_id AS sequence_id, score, keyframe_id % 3 AS missing, keyframe_id % 2 AS diagnostic, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, keyframe_id) AS n FROM candidates)
    SELECT query_id, sequence_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n > 10, round(CASE WHEN n > 10 THEN score + 0.65 * missing + 0.12 * diagnostic ELSE score END, 9) DESC, sequence_id) AS INTEGER) AS rank FROM x"""
)
def t16_two_tier_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = v.candidates(spark, sf_dir).select("query_id", F.col("keyframe_id").alias("sequence_id"), "score", (F.col("keyframe_id") % 3).alias("missing"), (F.col("keyframe_id") % 2).alias("diagnostic"))
    return r.two_tier_rank(s, 10).select("query_id", "sequence_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {v.CANDIDATES}, x AS (SELECT query_id, keyframe_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, keyframe_id) AS rank FROM candidates WHERE score > 0.05) SELECT query_id, keyframe_id, CAST(rank AS INTEGER) AS rank FROM x")
def w01_rank_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = v.candidates(spark, sf_dir).where("score > 0.05")
    return c.select("query_id", "keyframe_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "keyframe_id")).alias("rank"))


@query(f"WITH {v.OBJECTS}, x AS (SELECT split_part(object_key, '/', 2) AS folder, object_key, size, page_id, row_number() OVER (PARTITION BY split_part(object_key, '/', 2) ORDER BY size DESC, page_id) AS rank FROM objects) SELECT folder, object_key, size, CAST(rank AS INTEGER) AS rank FROM x WHERE rank <= 5")
def t19_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = v.objects(spark, sf_dir).withColumn("folder", F.split_part("object_key", F.lit("/"), F.lit(2)))
    return r.top(o, ["folder"], [F.desc("size"), F.asc("page_id")], 5).select("folder", "object_key", "size", "rank")


@query(f"WITH {v.FRAMES}, f AS (SELECT * FROM frames WHERE event_type = 'click') SELECT video_id, keyframe_id, frame_idx, (SELECT count(*) FROM f) AS matched FROM f ORDER BY abs(frame_idx - 10), video_id, frame_idx, keyframe_id LIMIT 50 OFFSET 50")
def t17_gallery_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of fifty of the click frames nearest to frame 10, with the number of all."""
    f = v.frames(spark, sf_dir).where("event_type = 'click'")
    page = f.orderBy(F.abs(F.col("frame_idx") - 10), "video_id", "frame_idx", "keyframe_id").offset(50).limit(50)
    return page.join(F.broadcast(f.agg(F.count(F.lit(1)).alias("matched")))).select("video_id", "keyframe_id", "frame_idx", "matched")


@query(f"WITH {v.FRAMES} SELECT video_id, keyframe_id FROM frames WHERE video_id IN (SELECT DISTINCT video_id FROM frames ORDER BY video_id LIMIT 7)")
def t18_limit_by_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = v.frames(spark, sf_dir)
    first = f.select("video_id").distinct().orderBy("video_id").limit(7)
    return f.join(first, "video_id", "left_semi").select("video_id", "keyframe_id")


@query(f"WITH {v.OBJECTS}, s AS (SELECT *, split_part(object_key, '/', 2) AS batch, CASE WHEN object_key LIKE '%.html' THEN 30 WHEN object_key LIKE 'm.%' THEN 25 WHEN object_key LIKE 'blog.%' THEN 10 WHEN size > 2000 THEN 0 ELSE -1 END AS tier FROM objects), m AS (SELECT *, max(tier) OVER (PARTITION BY batch) AS best FROM s) SELECT batch, object_key, page_id, tier FROM m WHERE tier = best AND tier >= 0")
def t20_source_tier_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per folder only the objects of the best kind of path."""
    o = v.objects(spark, sf_dir).withColumn("batch", F.split_part("object_key", F.lit("/"), F.lit(2)))
    k = F.col("object_key")
    tier = F.when(k.endswith(".html"), 30).when(k.startswith("m."), 25).when(k.startswith("blog."), 10).when(F.col("size") > 2000, 0).otherwise(-1)
    best = F.max("tier").over(Window.partitionBy("batch"))
    return o.withColumn("tier", tier).withColumn("best", best).where("tier = best and tier >= 0").select("batch", "object_key", "page_id", "tier")


@query(f"WITH {v.CANDIDATES} SELECT query_id, keyframe_id, round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) WHEN score > 0 THEN 1.0 ELSE 0.0 END, 6) AS signal FROM candidates WINDOW w AS (PARTITION BY query_id, event_index)")
def p22_normalize_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.candidates(spark, sf_dir).select("query_id", "keyframe_id", F.round(r.min_max("score", ["query_id", "event_index"]), 6).alias("signal"))


@query(
    f"""WITH {OVERLAP}, b AS (SELECT query_id, doc_id, least(1.0, score + CASE WHEN contains(query_text, source) THEN 0.25 ELSE 0 END) AS score FROM pair_scores JOIN text_queries USING (query_id) JOIN documents USING (doc_id))
    SELECT doc_id, round(max(score), 6) AS metadata_score FROM b GROUP BY 1"""
)
def t21_metadata_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of all views of a frame's text, a quarter more where the view names the video."""
    s = r.overlap_scores(v.table(spark, sf_dir, "documents"), v.text_queries(spark, sf_dir), ["doc_id", "source"]).join(v.text_queries(spark, sf_dir), "query_id")
    score = F.least(F.lit(1.0), F.col("score") + F.when(F.col("query_text").contains(F.col("source")), 0.25).otherwise(0.0))
    return s.groupBy("doc_id").agg(F.round(F.max(score), 6).alias("metadata_score"))


# Functions on texts


@query(f"SELECT doc_id, len({tokens_sql('text')}) AS n_tokens, {tokens_sql('text')}[1] AS first_token FROM documents")
def p05_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ft.tokenize(F.col("text"))
    return v.table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.try_element_at(t, F.lit(1)).alias("first_token"))


@query()
def p06_fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "documents").select("doc_id", ft.fold_text("text").alias("folded"))


_SIGNALS = ", ".join(f"'{t}'" for t in ft.SIGNAL_TOKENS)


@query(f"SELECT doc_id, regexp_matches(text, '[À-ỹ]') OR len(list_intersect(list_distinct(regexp_extract_all(text, '[a-z]+')), [{_SIGNALS}])) >= 2 AS vietnamese FROM documents")
def p07_looks_vietnamese(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "documents").select("doc_id", ft.looks_vietnamese(F.col("text")).alias("vietnamese"))


@query(
    """WITH l AS (SELECT conv_id, list_filter(list_transform(list(text ORDER BY turn), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS vs FROM conversations GROUP BY 1),
    u AS (SELECT conv_id, unnest(vs) AS val, generate_subscripts(vs, 1) AS i FROM l), f AS (SELECT conv_id, val, i FROM u QUALIFY row_number() OVER (PARTITION BY conv_id, lower(val) ORDER BY i) = 1),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS place FROM f)
    SELECT conv_id, CAST(place AS INTEGER) AS place, val AS variant FROM n WHERE place <= 4"""
)
def p08_dedupe_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = v.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("ts"))
    kept = c.select("conv_id", F.posexplode(ft.dedupe_variants(F.col("ts.text"), 4)).alias("place", "variant"))
    return kept.select("conv_id", (F.col("place") + 1).alias("place"), "variant")


@query(
    r"""WITH c AS (SELECT doc_id, list_transform(regexp_extract_all(text, '["''“”]([^"''“”]{1,80})["''“”]', 1), lambda x: trim(x)) || regexp_extract_all(t, '\b([A-Z0-9][A-Z0-9._:/-]+)\b', 1) AS c
      FROM (SELECT *, regexp_replace(regexp_replace(text, '[^\x00-\x7F\p{L}\p{N}]', ' ', 'g'), '[^\x00-\x7F]', 'a', 'g') AS t FROM documents))
    SELECT doc_id, list_filter(c, lambda x, i: x <> '' AND list_position(c, x) = i) AS cues FROM c"""
)
def p09_query_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "documents").select("doc_id", ft.query_cues(F.col("text")).alias("cues"))


@query(f"WITH {v.TEXT_QUERIES}, n AS (SELECT query_id, len(regexp_extract_all(query_text, '\\S+')) AS n FROM text_queries) SELECT query_id, CAST(CASE WHEN n <= 2 THEN n WHEN n <= 4 THEN floor(n * 0.75) ELSE floor(n * 0.5) END AS INTEGER) AS need FROM n")
def p21_minimum_should_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.text_queries(spark, sf_dir).select("query_id", ft.minimum_should_match(F.col("query_text")).alias("need"))


@query("SELECT doc_id, rtrim(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 100)) AS display, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS matched FROM documents")
def p23_normalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "documents").select("doc_id", ft.answer_display(F.col("text")).alias("display"), ft.answer_match(F.col("text")).alias("matched"))


@query()
def p26_collapse_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "documents").select("doc_id", ft.collapse_repeats("text").alias("c")).select("doc_id", "c.text", "c.runs", "c.removed", "c.raw_words", "c.clean_words")


@query()
def p27_repair_mojibake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "documents").select("doc_id", ft.repair_mojibake("text").alias("repaired"))
