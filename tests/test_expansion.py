"""Metrics of query expansion against a plain version."""

from __future__ import annotations

import re
from itertools import combinations

import pytest

from lumenreel.operators import expansion as x


def normal(t):
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s-]", " ", t.lower())).strip()


def words(t):
    return re.findall("[a-z0-9]+", normal(t))


def vocabulary(t):
    return {w for w in words(t) if w not in x.STOPWORDS}


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def plain(variants, references, concepts, forbidden, k):
    once = list({v.lower(): v for v in reversed([" ".join(v.split()) for v in variants]) if v}.values())[::-1]
    joined = normal(" ".join(once))
    pairs = [jaccard(vocabulary(a), vocabulary(b)) for a, b in combinations(once, 2)]
    ones = [w for v in once for w in words(v)]
    twos = [g for v in once for g in zip(words(v), words(v)[1:], strict=False)]

    def english(v):
        c = [y for y in v if not y.isspace()]
        return max(0.0, min(1.0, (sum(ord(y) < 128 for y in c) - sum(y in x.VIETNAMESE for y in c)) / len(c)))

    def fits(n):
        return n / 5 if n < 5 else max(0.0, 1 - (n - 18) / 18) if n > 18 else 1.0

    m = {
        "exact_k": float(len(once) == k), "unique_ratio": 1.0, "required_concept_coverage": sum(any(normal(a) in joined for a in s) for s in concepts.values()) / len(concepts) if concepts else 1.0,
        "forbidden_avoidance": 1 - sum(normal(t) in joined for t in forbidden) / len(forbidden) if forbidden else 1.0,
        "reference_token_overlap": jaccard(vocabulary(" ".join(once)), vocabulary(" ".join(references))), "pairwise_lexical_diversity": 1 - sum(pairs) / len(pairs) if pairs else 0.0,
        "distinct_1": len(set(ones)) / len(ones) if ones else 0.0, "distinct_2": len(set(twos)) / len(twos) if twos else 0.0, "englishish_score": sum(map(english, once)) / len(once),
        "length_score": sum(fits(len(words(v))) for v in once) / len(once),
    }
    m["overall_score"] = sum(m[c] * w for c, w in x.WEIGHTS.items()) / sum(x.WEIGHTS.values())
    m["query_drift_risk"] = 1 - (m["required_concept_coverage"] + m["forbidden_avoidance"]) / 2
    return m


CASES = {
    1: (["A red car  stops", "a RED car stops", "the blue bus leaves the old station at night", "Con mèo đen nhảy"], ["red car at night"], {"car": ["car", "automobile"], "dog": ["dog"]}, ["truck", "Blue bus"]),
    2: (["the of in", " "], [], {}, []),
    3: (["one", "one two three four five six", "x " * 40], ["nothing alike"], {"n": ["one-two", "two three"]}, ["seven"]),
    4: (["...", "!!!"], ["..."], {"a": ["zzz"]}, ["zzz"]),
}


def test_metrics(spark):
    t = spark.createDataFrame
    v = t([(c, k, s) for c, (vs, *_) in CASES.items() for k, s in enumerate(vs)] + [(9, 0, None)], "case_id int, place int, text string")
    r = t([(c, s) for c, (_, rs, *_) in CASES.items() for s in rs], "case_id int, text string")
    n = t([(c, g, a) for c, (_, _, cs, _) in CASES.items() for g, s in cs.items() for a in s], "case_id int, concept string, alias string")
    f = t([(c, s) for c, (*_, fs) in CASES.items() for s in fs], "case_id int, term string")
    got = {row.case_id: row.asDict() for row in x.expansion_metrics(v, r, n, f, k=3).collect()}
    assert set(got) == set(CASES)
    for c, case in CASES.items():
        for name, value in plain(*case, 3).items():
            assert got[c][name] == pytest.approx(value, abs=1e-9), (c, name)
