"""Where a user's own function runs at scale, and its deterministic stand-ins."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lumenreel.operators import sequences


def hash_embedder(dim: int) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for a model: token hashes with signs, of unit length; an empty text is the first axis."""

    def embed(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for token in text.lower().split():
                h = zlib.crc32(token.encode())
                row[h % dim] += 1 if h & (1 << 31) else -1
            if not row.any():
                row[0] = 1
        return out / np.linalg.norm(out, axis=1, keepdims=True)

    return embed


def embed_column(df: DataFrame, key: str, column: str, make: Callable[[], Callable], dim: int, batch: int = 256) -> DataFrame:
    """key and embedding; `make` loads the model once in each Python task. A vector of another size is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            for a in range(0, len(f), batch):
                part = f.iloc[a : a + batch]
                vectors = np.asarray(model(part[column].fillna("").tolist()), np.float32)
                if vectors.shape != (len(part), dim):
                    raise ValueError(f"{vectors.shape} instead of {(len(part), dim)}")
                yield pd.DataFrame({key: part[key], "embedding": list(vectors)})

    return df.select(key, column).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, embedding array<float>")


def extract_features(df: DataFrame, key: str, column: str, make: Callable[[], Callable]) -> DataFrame:
    """key, result (JSON text) and error of a function of one value; rows that fail are kept with their error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        extract = make()
        for f in frames:
            out = []
            for k, value in zip(f[key], f[column], strict=True):
                try:
                    out.append((k, json.dumps(extract(value), sort_keys=True), None))
                except Exception as e:  # the row's own failure is its result
                    out.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "result", "error"])

    return df.select(key, column).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, result string, error string")


#: Marks that don't belong to a word's ends (fixed value).
MARKS = ".,;:!?()[]{}\"'`"


def overlap_reranker() -> Callable[[str, list[str]], list[float]]:
    """A stand-in for a model: shared word counts over both lengths (L2); words of one character don't count."""

    def counts(text: str) -> Counter:
        return Counter(w for w in (raw.strip(MARKS) for raw in text.lower().split()) if len(w) > 1)

    def rerank(query: str, passages: list[str]) -> list[float]:
        asked = counts(query)
        length = math.sqrt(sum(n * n for n in asked.values()))
        out = []
        for own in map(counts, passages):
            both = sum(min(n, own[w]) for w, n in asked.items())
            out.append(both / (length * math.sqrt(sum(n * n for n in own.values()))) if both else 0.0)
        return out

    return rerank


def rerank(pairs: DataFrame, make: Callable[[], Callable] = overlap_reranker, batch: int = 64) -> DataFrame:
    """pairs: query_id, frame_id, query, passage. query_id, frame_id and the score of rerank(query, passages).

    `make` loads the model once in each Python task, which gets at most `batch` passages of one query at a time; null
    texts are empty. Another number of scores is an error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            f = f.fillna({"query": "", "passage": ""})
            for (key, query), own in f.groupby(["query_id", "query"], dropna=False, sort=False):
                for a in range(0, len(own), batch):
                    part = own.iloc[a : a + batch]
                    scores = np.asarray(model(query, part["passage"].tolist()), float)
                    if scores.shape != (len(part),):
                        raise ValueError(f"{scores.shape} instead of {(len(part),)}")
                    yield pd.DataFrame({"query_id": key, "frame_id": part["frame_id"], "score": scores})

    types = dict(pairs.dtypes)
    return pairs.select("query_id", "frame_id", "query", "passage").mapInPandas(run, f"query_id {types['query_id']}, frame_id {types['frame_id']}, score double")


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"beam": sequences.beam_search, "anchor": sequences.anchor_search}


def search_sequences(candidates: DataFrame, strategy: str, **options) -> DataFrame:
    """A sequence search by name, with one result schema: query_id, video_id, members, matched, score."""
    return STRATEGIES[strategy](candidates, **options).select("query_id", "video_id", "members", "matched", "score")


def register(spark: SparkSession) -> None:
    """The text functions and the table of events for SQL users; all but those of accents and repeats stay in the JVM.

    fold_text(x), collapse_repeats(x), repair_mojibake(x), text_tokens(x), answer_display(x), answer_match(x),
    overlap_score(query, text), and the table function parse_events(x): place, source, event.
    """
    from lumenreel.functions import text as t
    from lumenreel.functions.tables import ParseEvents

    for name, f in {"fold_text": t.fold_text, "collapse_repeats": t.collapse_repeats, "repair_mojibake": t.repair_mojibake}.items():
        spark.udf.register(name, f)
    spark.udtf.register("parse_events", ParseEvents)
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


_TOKENS = r"filter(regexp_extract_all(lower(coalesce({}, '')), '([\\p{{L}}\\p{{N}}_]+)', 1), t -> length(t) > 1)"
_SQUASHED = r"trim(regexp_replace(coalesce({}, ''), '\\s+', ' '))"
_COUNTS = "map_from_entries(transform(array_distinct({0}), t -> struct(t, cast(size(filter({0}, u -> u = t)) AS BIGINT))))"
_NORM = "sqrt(aggregate(map_values({}), 0D, (a, n) -> a + n * n))"
_Q, _T = (_COUNTS.format(_TOKENS.format(x)) for x in ("query", "x"))
#: SQL functions by signature. overlap_score: shared token counts over both lengths (L2), 0 without any.
SQL_FUNCTIONS = {
    "text_tokens(x STRING) RETURNS ARRAY<STRING>": _TOKENS.format("x"),
    "answer_display(x STRING) RETURNS STRING": f"rtrim(substring({_SQUASHED.format('x')}, 1, 100))",
    "answer_match(x STRING) RETURNS STRING": _SQUASHED.format(r"regexp_replace(lower(coalesce(x, '')), '[^\\p{L}\\p{N}_\\s]', '')"),
    "overlap_counts(a MAP<STRING, BIGINT>, b MAP<STRING, BIGINT>) RETURNS DOUBLE": "coalesce(try_divide(aggregate(map_keys(a), 0D, (s, t) -> s + least(a[t], coalesce(try_element_at(b, t), 0))), "
    + f"{_NORM.format('a')} * {_NORM.format('b')}), 0D)",
    "overlap_score(query STRING, x STRING) RETURNS DOUBLE": f"overlap_counts({_Q}, {_T})",
}
