"""How good the variants are that a query was expanded to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that don't count in vocabularies (fixed values).
STOPWORDS = (
    "a an the and or of to in on at by for with from into during showing scene video frame query search what is are"
).split()
#: Letters of Vietnamese that aren't ASCII (fixed values).
VIETNAMESE = "ăâêôơưĂÂÊÔƠƯÁáàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵđĐ"
#: Weights of the total (fixed values).
WEIGHTS = {
    "exact_k": 0.12, "unique_ratio": 0.10, "required_concept_coverage": 0.24, "forbidden_avoidance": 0.16, "reference_token_overlap": 0.10,
    "pairwise_lexical_diversity": 0.10, "distinct_2": 0.08, "englishish_score": 0.05, "length_score": 0.05,
}


def normalized(text: Column) -> Column:
    """Lower case, only a-z, 0-9, hyphens and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s-]", " "), r"\s+", " "))


def words(text: Column) -> Column:
    return F.regexp_extract_all(normalized(text), F.lit("([a-z0-9]+)"), F.lit(1))


def vocabulary(found: Column) -> Column:
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def bigrams(found: Column) -> Column:
    return F.zip_with(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), F.slice(found, 2, F.size(found)), lambda a, b: F.concat(a, F.lit(" "), b))


def english(text: Column) -> Column:
    """The share of ASCII characters less that of Vietnamese letters, within 0 and 1; blanks don't count."""
    solid = F.regexp_replace(text, r"\s", "")
    plain = F.length(F.regexp_replace(solid, r"[^\x00-\x7F]", ""))
    other = F.length(F.regexp_replace(solid, f"[^{VIETNAMESE}]", ""))
    return F.when(F.length(solid) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (plain - other) / F.length(solid))))


def fit_length(n: Column, least: int, most: int) -> Column:
    """1 within the range, falling in proportion outside."""
    return F.when(n < least, n / least).when(n > most, F.greatest(F.lit(0.0), 1 - (n - most) / most)).otherwise(1.0)


def found_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """terms: case_id, group, term; texts: case_id, joined. case_id, group and whether one of the group's terms is in the text."""
    met = terms.select("case_id", "group", normalized(F.col("term")).alias("term")).join(texts, "case_id", "left")
    return met.groupBy("case_id", "group").agg(F.max(F.contains(F.coalesce("joined", F.lit("")), F.col("term"))).alias("hit"))


def expansion_metrics(variants: DataFrame, references: DataFrame, concepts: DataFrame, forbidden: DataFrame, k: int, least: int = 5, most: int = 18) -> DataFrame:
    """Ten metrics of each case's variants, their weighted total and the risk of drift.

    variants: case_id, place, text; variants alike but for case and blanks count once, at their first place. references:
    case_id, text. concepts: case_id, concept, alias. forbidden: case_id, term. A case is what one model answer holds, so its
    few variants are compared within one row. Cases without variants are left out.
    """
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    once = variants.select("case_id", "place", text.alias("text")).where("text <> ''").groupBy("case_id", F.lower("text").alias("alike")).agg(F.min_by(F.struct("place", "text"), "place").alias("v"))
    listed = F.transform(F.sort_array(F.collect_list("v")), lambda v: v["text"])
    cases = once.groupBy("case_id").agg(listed.alias("texts"))
    cases = cases.withColumn("words", F.transform("texts", words)).withColumn("sets", F.transform("words", vocabulary)).withColumn("joined", normalized(F.array_join("texts", " ")))
    own = cases.select("case_id", "joined")
    needed = found_terms(own, concepts.select("case_id", F.col("concept").alias("group"), F.col("alias").alias("term")))
    needed = needed.groupBy("case_id").agg(F.avg(F.col("hit").cast("double")).alias("covered"))
    banned = found_terms(own, forbidden.select("case_id", F.col("term").alias("group"), "term")).groupBy("case_id").agg(F.avg(F.col("hit").cast("double")).alias("banned"))
    told = references.groupBy("case_id").agg(F.array_join(F.collect_list("text"), " ").alias("reference"))
    d = cases.join(needed, "case_id", "left").join(banned, "case_id", "left").join(told, "case_id", "left")
    n = F.size("texts")
    at = F.sequence(F.lit(0), n - 1)
    alike = F.aggregate(at, F.lit(0.0), lambda s, i: s + F.aggregate(F.slice("sets", i + 2, n), F.lit(0.0), lambda t, b: t + jaccard(F.get("sets", i), b)))
    distinct = lambda grams: F.when(F.size(grams) > 0, F.size(F.array_distinct(grams)) / F.size(grams)).otherwise(0.0)
    mean = lambda f, c: F.aggregate(c, F.lit(0.0), lambda s, x: s + f(x)) / n
    metrics = {
        "exact_k": (n == k).cast("double"), "unique_ratio": F.size(F.array_distinct(F.transform("texts", F.lower))) / n,
        "required_concept_coverage": F.coalesce("covered", F.lit(1.0)), "forbidden_avoidance": 1 - F.coalesce("banned", F.lit(0.0)),
        "reference_token_overlap": jaccard(vocabulary(words(F.array_join("texts", " "))), vocabulary(words(F.col("reference")))),
        "pairwise_lexical_diversity": F.when(n > 1, 1 - alike / (n * (n - 1) / 2)).otherwise(0.0),
        "distinct_1": distinct(F.flatten("words")), "distinct_2": distinct(F.flatten(F.transform("words", bigrams))),
        "englishish_score": mean(english, "texts"), "length_score": mean(lambda w: fit_length(F.size(w), least, most), "words"),
    }
    m = d.select("case_id", n.cast("long").alias("variants"), *(x.cast("double").alias(c) for c, x in metrics.items()))
    total = sum(F.col(c) * w for c, w in WEIGHTS.items()) / sum(WEIGHTS.values())
    return m.withColumns({"overall_score": total, "query_drift_risk": 1 - (F.col("required_concept_coverage") + F.col("forbidden_avoidance")) / 2})
