"""Column functions that plan queries: weights, events, ids, times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.functions.text import squash

#: Terms of folded queries that ask for words as evidence, for displayed text, and for speech; signs of a lexical query
#: (fixed values).
EVIDENCE_TERMS = (
    "hoi", "cau hoi", "ten", "la gi", "cau tho", "tieu de", "cong thuc", "loi noi", "phat bieu", "duoc san xuat", r"nam\s+\d{4}", "chuong trinh", "cau lac bo", "dai hoc", "tinh", "xa", "dia phuong",
    "nghien cuu", "mau tin", "gioi thieu", "nhiem vu", "thong tin", "noi dung", "chu", "hien thi", "man hinh", "logo", "so", "gia", "ma so", "ky tu", "written", "title", "sign", "number", "score",
)
DISPLAY_TERMS = (
    "chu", "van ban", "noi dung viet", "hien thi", "tren man hinh", "tren bang", "bang bieu", "bieu do", "ky hieu", "logo", "bien", "so", "ma so", "so hieu", "gia", "written", "on screen", "on-screen",
    "displayed", "table", "chart", "diagram", "symbol", "sign", "label",
)
SPEECH_TERMS = ("noi", "loi noi", "phat bieu", "hoi", "thuyet minh", "speech", "dialogue", "narrat")
LEXICAL_SIGNS = ("noi", "hoi", "ten", "cau tho", "tieu de", "cong thuc")
YEAR = r"\b(?:19|20)\d{2}\b"


def any_of(terms: tuple[str, ...]) -> str:
    return r"\b(?:" + "|".join(terms) + r")\b"


def text_evidence(query: Column, folded: Column) -> Column:
    """How much a query asks for words: evidence terms, a quotation, a year, and several words with a lexical sign."""
    several = folded.rlike(r"\b[a-z]{2,}(?:\s+[a-z]{2,})+\b") & folded.rlike("|".join(LEXICAL_SIGNS))
    flags = [F.coalesce(query, F.lit("")).rlike("[\"'“”]"), folded.rlike(YEAR), several]
    return (F.regexp_count(folded, F.lit(any_of(EVIDENCE_TERMS))) + sum((f.cast("int") for f in flags[1:]), flags[0].cast("int"))).cast("int")


def strategy(query: Column, folded: Column, kind: Column) -> Column:
    """Struct of the evidence count, of visual and text weights, and of the sources asr, caption and ocr."""
    n = text_evidence(query, folded)
    w = lambda v, t: F.struct(F.lit(v).alias("visual"), F.lit(t).alias("text"))
    s = lambda a, c, o: F.struct(F.lit(a).alias("asr"), F.lit(c).alias("caption"), F.lit(o).alias("ocr"))
    weights = F.when((kind == "TRAKE") & (n < 2), w(0.78, 0.22)).when(n >= 2, w(0.28, 0.72)).when(n == 1, w(0.45, 0.55)).otherwise(w(0.67, 0.33))
    sources = F.when(folded.rlike(any_of(SPEECH_TERMS)), s(0.7, 0.2, 0.1)).when(folded.rlike(any_of(DISPLAY_TERMS)), s(0.1, 0.2, 0.7)).otherwise(s(0.2, 0.8, 0.0))
    return F.struct(n.alias("evidence"), weights.alias("weights"), sources.alias("sources"))


def normalize_weights(*weights: Column) -> list[Column]:
    """Not below 0, divided by their sum; all null if the sum isn't positive."""
    clean = [F.greatest(F.coalesce(w, F.lit(0.0)), F.lit(0.0)) for w in weights]
    total = sum(clean[1:], clean[0])
    return [F.when(total > 0, c / total) for c in clean]


def gate_ocr(sources: Column, folded: Column) -> Column:
    """Without a term for displayed text the ocr weight is 0: for speech the others are scaled up, else they are .2 and .8."""
    a, c = (F.greatest(sources[x], F.lit(0.0)) for x in ("asr", "caption"))
    build = lambda x, y, z: F.struct(x.alias("asr"), y.alias("caption"), z.alias("ocr"))
    plain = build(F.lit(0.2), F.lit(0.8), F.lit(0.0))
    scaled = F.when(a + c > 0, build(F.round(a / (a + c), 6), F.round(c / (a + c), 6), F.lit(0.0))).otherwise(plain)
    same = build(sources["asr"], sources["caption"], sources["ocr"])
    return F.when(folded.rlike(any_of(DISPLAY_TERMS)), same).when(folded.rlike(any_of(SPEECH_TERMS)), scaled).otherwise(plain)


def event_importance(events: DataFrame) -> DataFrame:
    """events: query_id, event_index, weight. Scaled so that a query's weights sum to its number of events, else all 1."""
    w = Window.partitionBy("query_id")
    clean = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    total, n = F.sum(clean).over(w), F.count(F.lit(1)).over(w)
    return events.withColumn("weight", F.when(total > 0, clean * n / total).otherwise(1.0))


def anchor_index(requested: Column, planned: Column, n: Column) -> Column:
    return F.least(n, F.greatest(F.lit(1), F.coalesce(requested, planned, F.floor((n + 1) / 2)))).cast("int")


def temporal_edges(queries: DataFrame, edges: DataFrame, classes: dict[str, int | None]) -> DataFrame:
    """queries: query_id, n_events; edges: query_id, from_event, to_event, gap_class. Valid edges with the largest gap of
    their class; a query without any gets the chain of its events, without limits."""
    limit = F.create_map(*(F.lit(x) for k, ms in classes.items() if ms is not None for x in (k, ms)))
    e = edges.join(queries, "query_id").where("1 <= from_event and from_event < to_event and to_event <= n_events")
    good = e.select("query_id", "from_event", "to_event", F.try_element_at(limit, F.col("gap_class")).cast("long").alias("max_gap_ms"))
    bare = queries.where("n_events > 1").join(good.select("query_id").distinct(), "query_id", "left_anti")
    chain = bare.select("query_id", F.explode(F.sequence(F.lit(1), F.col("n_events").cast("int") - 1)).alias("from_event"))
    return good.unionByName(chain.select("query_id", "from_event", (F.col("from_event") + 1).alias("to_event"), F.lit(None).cast("long").alias("max_gap_ms")))


_EDGE = "^[\\s.:\\-]+|[\\s.:\\-]+$"


def _clean(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(squash(c), r"^[-*]\s*", ""), _EDGE, ""), r"(?i)^(?:là|is|are)\s+", "")


def _pieces(text: Column, cut: str) -> Column:
    """The text between and behind the matches of `cut`, cleaned, without empty ones."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, cut, "\u0001"), "\u0001"), _clean), lambda p: p != "")


#: How events are told apart, in order of precedence (fixed values).
CONTEXT = r"(?i)^(.+?)\s+(?:after|sau\s+khi)\s+(.+?)\s+(?:and|v(?:a|à))\s+(?:before|tr(?:uoc|ước)\s+khi)\s+(.+)$"
LABEL = r"(?im)(?:^|[\r\n;]|\s)\s*(?:\(?\s*e\s*\d{1,2}\s*\)?|event\s*\d{1,2}|step\s*\d{1,2})\s*[:.)-]\s*"
NUMBER = r"(?m)^\s*\d{1,2}\s*[:.)-]\s+"
SOFT = r"(?i)\s*(?:\bthen\b|\bafter that\b|\bnext\b|\bfinally\b|đầu\s+tiên|trước\s+hết|sau\s+đó|tiếp\s+đến|tiếp\s+theo|cuối\s+cùng|rồi|;)\s*"


def parse_events(text: Column, most: int = 8) -> Column:
    """Struct of source and events: X after A and before B (as A, X, B), labels, numbered lines, soft separators, one event."""
    # As in Python, blanks, word ends and case are those of all scripts.
    context_, label_, number_, soft_ = ("(?U)" + x for x in (CONTEXT, LABEL, NUMBER, SOFT))
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"))
    line = F.regexp_replace(t, "\n", " ")
    part = lambda n: _clean(F.regexp_extract(line, context_, n))
    context = F.filter(F.array(part(2), part(1), part(3)), lambda p: p != "")
    behind = lambda cut: _pieces(F.regexp_extract(F.regexp_replace(t, cut, "\u0001"), "(?s)\u0001(.*)$", 1), "\u0001")
    labels, numbers, soft = behind(label_), behind(number_), _pieces(line, soft_)
    # One label alone tells no events apart, but the event is what stands behind it.
    single = F.filter(F.array(F.coalesce(F.get(labels, F.lit(0)), _clean(line))), lambda p: p != "")
    found = lambda name, events: F.struct(F.lit(name).alias("source"), F.slice(events, 1, most).alias("events"))
    return (
        F.when(t == "", found("empty", F.array().cast("array<string>"))).when(line.rlike(context_), found("context_relation", context)).when(F.size(labels) > 1, found("event_labels", labels))
        .when(F.size(numbers) > 1, found("numbered_lines", numbers)).when(F.size(soft) > 1, found("soft_separators", soft)).otherwise(found("single", single))
    )


#: Where over-long events are cut (fixed values).
BOUNDARY = r"(?i)(?<=[.!?])\s+|\b(?:then|after\s+that|afterwards|next|finally|sau\s+đ[oó]|ti[eế]p\s+theo|cu[oố]i\s+c[uù]ng|r[oồ]i)\b"


_ENDS = "^[ ,;:-]+|[ ,;:-]+$"


def refine_events(events: DataFrame, longest: int = 120, most: int = 8) -> DataFrame:
    """events: query_id, event_index, text, weight. Longer ones are cut at sentences and connectors, if that gives more
    than one piece; at most `most` events of a query stay, and an event's weight is shared by its pieces that stay."""
    pieces = F.filter(F.transform(F.split(F.regexp_replace("text", BOUNDARY, "\u0001"), "\u0001"), lambda p: F.regexp_replace(p, _ENDS, "")), lambda p: p != "")
    d = events.withColumn("parts", pieces)
    d = d.withColumn("parts", F.when((F.length("text") > longest) & (F.size("parts") > 1), F.col("parts")).otherwise(F.array("text")))
    d = d.select("query_id", "event_index", "weight", F.posexplode("parts").alias("piece", "text"))
    w = Window.partitionBy("query_id").orderBy("event_index", "piece")
    stay = d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return stay.withColumn("weight", F.col("weight") / F.count(F.lit(1)).over(Window.partitionBy("query_id", "event_index")))


def keyframe_id(video: Column, frame: Column) -> Column:
    return F.format_string("%s_F%06d", video, frame)


def shot_id(video: Column, shot: Column) -> Column:
    return F.format_string("%s_S%04d", video, shot)


def event_id(video: Column, number: Column) -> Column:
    return F.format_string("%s_E%06d", video, number)


def resolve_id(canonical: Column, mapped: Column, listed: Column, raw: Column) -> Column:
    """The canonical id, else the mapped one, else the first listed that looks like a frame's, else as it is."""
    looks = F.try_element_at(F.filter(listed, lambda x: x.rlike(r".+_F\d+")), F.lit(1))
    return F.coalesce(canonical, mapped, looks, raw)


def task_type(answer: Column) -> Column:
    """QA if the third part of an answer isn't a number; TRAKE if events are named or it has more than two parts; else KIS."""
    parts = F.split(answer, ",")
    third = F.trim(F.try_element_at(parts, F.lit(3)))
    return F.when(third.isNotNull() & ~third.rlike(r"^-?\d+$"), "QA").when(F.lower(answer).contains("e1:") | (F.size(parts) > 2), "TRAKE").otherwise("KIS")


def public_url(bucket: Column, key: Column, host: str) -> Column:
    """Each part of the key escaped, the slashes kept."""
    return F.concat_ws("/", F.lit(host), bucket, F.replace(F.replace(F.url_encode(key), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")))


def frame_time(name: Column, fps: Column) -> tuple[Column, Column]:
    """Number (all digits of the name's stem) and time in ms, rounded down; 25 frames a second where fps is missing."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    n = F.regexp_replace(stem, r"[^0-9]", "").try_cast("long")
    return n, F.floor(n / F.coalesce(F.when(fps > 0, fps), F.lit(25.0)) * 1000)


def normalize_boxes(boxes: Column, width: Column, height: Column) -> Column:
    """Pixel boxes (x1, y1, x2, y2) as shares of the picture, within 0 and 1, six digits."""
    share = lambda v, of: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / of)), 6)
    return F.transform(boxes, lambda b: F.struct(share(b["x1"], width).alias("x1"), share(b["y1"], height).alias("y1"), share(b["x2"], width).alias("x2"), share(b["y2"], height).alias("y2")))


def merge_lines(boxes: Column, near_y: float = 35.0, near_x: float = 180.0) -> Column:
    """boxes: array of x, y, w, h, text. Read from top left, a box joins the first line whose middle and right edge are
    near, and the line grows to hold it. Lines have x1, y1, x2, y2 and their texts in the order in which they joined."""
    line = "array<struct<x1:double,y1:double,x2:double,y2:double,text:string>>"
    corners = lambda b: F.struct(b["y"].alias("y1"), b["x"].alias("x1"), (b["x"] + b["w"]).alias("x2"), (b["y"] + b["h"]).alias("y2"), b["text"].alias("text"))

    def joined(own: Column, b: Column) -> Column:
        low = [F.least(own[c], b[c]).alias(c) for c in ("x1", "y1")]
        return F.struct(*low, *(F.greatest(own[c], b[c]).alias(c) for c in ("x2", "y2")), F.concat_ws(" ", own["text"], b["text"]).alias("text"))

    def step(lines: Column, b: Column) -> Column:
        near = lambda own: (F.abs((b["y1"] + b["y2"]) / 2 - (own["y1"] + own["y2"]) / 2) < near_y) & (b["x1"] - own["x2"] < near_x)
        place = F.array_position(F.transform(lines, near), True)
        fresh = F.struct(*(b[c].alias(c) for c in ("x1", "y1", "x2", "y2", "text")))
        # Lines before the joined one stay, and so do those behind it.
        grown = F.concat(F.slice(lines, F.lit(1), F.greatest(place.cast("int") - 1, F.lit(0))), F.array(joined(F.get(lines, place.cast("int") - 1), b)), F.slice(lines, place.cast("int") + 1, F.size(lines)))
        return F.when(place > 0, grown).otherwise(F.concat(lines, F.array(fresh)))

    return F.aggregate(F.array_sort(F.transform(boxes, corners)), F.array().cast(line), step)


#: The fields of a model's answer (fixed values).
FACTORS = ("subjects", "actions", "objects", "attributes", "scene", "text_cues", "temporal_context")


def parse_model_json(text: Column) -> Column:
    """The object inside a model's answer, without thoughts (closed or not), of a fenced part only that: seven lists, and
    whether it could be read. A field that is a string is a list of one; anything but strings and lists is an empty list."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", "")
    fenced = F.regexp_extract(bare, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    body = F.regexp_extract(F.when(bare.rlike(r"(?is)```(?:json)?\s*(.*?)\s*```"), fenced).otherwise(bare), r"(?s)(\{.*\})", 1)
    parsed = F.try_parse_json(body)
    none = F.array().cast("array<string>")

    def field(name: str) -> Column:
        value = F.try_variant_get(parsed, f"$.{name}", "variant")
        one = F.when(F.schema_of_variant(value) == "STRING", F.array(F.try_variant_get(parsed, f"$.{name}", "string")))
        values = F.coalesce(one, F.try_variant_get(parsed, f"$.{name}", "array<string>"), none)
        return F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")

    return F.struct(*(field(f).alias(f) for f in FACTORS), F.coalesce(~F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(True)).alias("failed"))
