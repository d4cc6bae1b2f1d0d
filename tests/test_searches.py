"""The queries over the whole of their input against brute force, on fixtures that the parts would get wrong."""

from __future__ import annotations

import math
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenreel.operators import ranking as r
from lumenreel.operators import windows as w
from lumenreel.plans import registry


def run(spark, name, path):
    return [tuple(x) for x in registry.queries()[name](spark, str(path)).collect()]


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """450 vectors, a third of one label, some equal; query ids up to 400."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)], 1 if i % 3 == 0 else int(rng.integers(2, 6))) for i in range(450)]
    rows[407] = (407, rows[100][1], 1)
    path = tmp_path_factory.mktemp("vectors")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return path, x @ x.T, np.array([c for _, _, c in rows])


ASKED = (0, 100, 200, 300, 400)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(r, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(r, "QUERY_BLOCK", 2)


def ranked(scores, ids, k):
    return sorted(ids, key=lambda i: (-round(scores[i], 9), i))[:k]


def test_every_query_is_answered(spark, vectors):
    path, s, label = vectors
    for name, may in (("t01_cosine_topk", lambda q: range(450)), ("j03_restricted_topk", lambda q: np.flatnonzero(label == label[q]).tolist())):
        got = {(q, n): (i, c) for q, i, n, c in run(spark, name, path)}
        want = {(q, n): (i, s[q, i]) for q in ASKED for n, i in enumerate(ranked(s[q], may(q), 10), 1)}
        assert {k: g[0] for k, g in got.items()} == {k: g[0] for k, g in want.items()}
        assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
    assert {q for q, *_ in run(spark, "t02_cosine_topk_approx", path)} == set(ASKED)


def test_approximate_search(spark, vectors):
    """Its scores are cosines whatever the norms, and it finds nine tenths of the true ten."""
    path, s, _ = vectors
    got = registry.queries()["t02_cosine_topk_approx"](spark, str(path)).collect()
    assert all(abs(x["score"] - s[x["query_id"], x["vec_id"]]) < 1e-6 for x in got)
    found = {(x["query_id"], x["vec_id"]) for x in got}
    true = {(q, i) for q in ASKED for i in ranked(s[q], range(450), 10)}
    assert len(found) == len(true) and len(found & true) >= 0.9 * len(true)


def test_target_ranks(spark, vectors):
    path, s, label = vectors
    want = set()
    for q in ASKED:
        best = {c: ranked(s[q], [i for i in np.flatnonzero(label == c).tolist() if i != q], 1)[0] for c in set(label.tolist())}
        rank = 1 + sum(round(s[q, i], 9) > round(s[q, best[label[q]]], 9) for i in best.values())
        want |= {(q, c, i, rank) for c, i in best.items()}
    assert {(q, c, i, n) for q, c, i, _, n in run(spark, "t03_scan_rank_target", path)} == want


def test_two_models(spark, vectors):
    path, s, _ = vectors
    want = {}
    for q in ASKED:
        for weight, scores in ((0.6, s[q]), (0.4, s[q] * (np.arange(450) % 3))):
            for n, i in enumerate(ranked(scores, np.flatnonzero(scores > 0).tolist(), 30), 1):
                want[q, i] = want.get((q, i), 0) + weight / (60 + n)
    got = {(q, i): c for q, i, c in run(spark, "t09_semantic_scores", path)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_all_variants_of_a_label(spark, vectors):
    path, s, label = vectors
    got = {(c, i): (b, d) for c, i, b, d in run(spark, "e19_variant_similarity", path)}
    assert len(got) == 450
    for (c, i), (b, d) in got.items():
        others = [j for j in np.flatnonzero(label == c) if j != i]
        assert abs(b - s[i, others].max()) < 2e-6 and abs(d - (1 - s[i, others].mean())) < 2e-6


# Texts

KIND = {"fr": "ocr", "de": "asr", "es": "caption"}
BOOST = {"ocr": 3.0, "asr": 2.5, "caption": 1.5}


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Passages of 20 words; some documents share only words after the twelfth with one, some hold it whole."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(60)]
    passages = {q: " ".join([f"start{q}x{i}" for i in range(12)] + rng.choice(words, 8, False).tolist()) for q in (1, 2, 3, 4)}
    docs = []
    for i in range(90):
        body = rng.choice(words, 12).tolist()
        if i % 5 == 0:
            body += passages[1 + i % 4].split()[8:]
        if i % 9 == 0:
            body += [passages[1 + i % 4]]
        docs.append((i, " ".join(body), ["fr", "de", "es"][int(rng.integers(3))], f"s{i % 4}", 1))
    path = tmp_path_factory.mktemp("texts")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(passages.items()), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, passages, {i: t for i, t, *_ in docs}, {i: KIND[c] for i, _, c, *_ in docs}


def overlaps(passages, docs):
    out = {}
    for q, a in passages.items():
        for i, b in docs.items():
            x, y = Counter(a.split()), Counter(b.split())
            shared = sum((x & y).values())
            if shared:
                out.setdefault(q, {})[i] = shared / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))
    return out


def bm25(passages, docs, kinds):
    tf = {i: Counter(t.split()) for i, t in docs.items()}
    size = {i: sum(c.values()) for i, c in tf.items()}
    out = {}
    for q, a in passages.items():
        asked = set(a.split())
        for i in docs:
            field = [j for j in docs if kinds[j] == kinds[i]]
            mean = sum(size[j] for j in field) / len(field)
            hits = asked & set(tf[i])
            if len(hits) >= len(asked) // 2:
                df = {t: sum(t in tf[j] for j in field) for t in hits}
                idf = {t: math.log(1 + (len(field) - df[t] + 0.5) / (df[t] + 0.5)) for t in hits}
                out.setdefault(q, {})[i] = BOOST[kinds[i]] * sum(idf[t] * tf[i][t] * 2.2 / (tf[i][t] + 1.2 * (0.25 + 0.75 * size[i] / mean)) for t in hits)
    return out


def same(got, want):
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def firsts(scores, k):
    return {(q, i): (s[i], n) for q, s in scores.items() for n, i in enumerate(ranked(s, [i for i in s if s[i] > 0], k), 1)}


def test_whole_passages_are_searched(spark, texts):
    path, passages, docs, kinds = texts
    o = overlaps(passages, docs)
    for name, scores, k in (
        ("t04_lexical_rank", o, 10),
        ("t05_text_topk_overlap", {q: {i: c * (1 + BOOST[kinds[i]]) for i, c in s.items()} for q, s in o.items()}, 20),
        ("t06_text_topk_best_fields", bm25(passages, docs, kinds), 20),
        ("t08_text_scores", {q: {i: c * BOOST[kinds[i]] for i, c in s.items() if kinds[i] != "caption"} for q, s in o.items()}, 15),
    ):
        got = {(x["query_id"], x["doc_id"]): x for x in registry.queries()[name](spark, str(path)).collect()}
        want = firsts(scores, k)
        same({a: x["score"] for a, x in got.items()}, {a: c for a, (c, _) in want.items()})
        assert {a: x["rank"] for a, x in got.items()} == {a: n for a, (_, n) in want.items()}
    assert {(q, i) for q, i, _ in run(spark, "t07_phrase_bonus", path)} == {(q, i) for q, p in passages.items() for i, t in docs.items() if p in t}


def test_values_of_whole_passages(spark, texts):
    path, passages, docs, _ = texts
    o = overlaps(passages, docs)
    best = {i: max(min(1.0, s[i]) for s in o.values() if i in s) for i in docs if any(i in s for s in o.values())}
    same(dict(run(spark, "t21_metadata_score", path)), best)
    assert dict(run(spark, "p21_minimum_should_match", path)) == {q: 10 for q in passages}
    holds = {q: {i for i, t in docs.items() if p in t} for q, p in passages.items()}
    want = {}
    for q, own in holds.items():
        if own:
            places = [n for n, i in enumerate(ranked(o[q], o[q], 20), 1) if i in own]
            want[q] = (len(places) / len(own), 1 / places[0] if places else 0)
    got = {q: x for q, *x in run(spark, "e06_recall_mrr", path)}
    assert got.keys() == want.keys() and all(np.allclose(got[q], want[q], atol=2e-6) for q in want)


def test_all_hits_are_fused(spark, texts):
    path, passages, docs, kinds = texts
    s, t = overlaps(passages, docs), bm25(passages, docs, kinds)
    every = {q: sorted(set(s[q]) | set(t.get(q, {}))) for q in s}
    assert any(i % 6 == 3 for own in every.values() for i in own) and any(len(own) > 60 for own in every.values())
    place = [{(q, i): n for q, own in lists.items() for n, i in enumerate(ranked(own, own, len(own)), 1)} for lists in (s, t)]
    got = {(x["query_id"], x["frame_id"]): x for x in registry.queries()["j02_fuse_outer"](spark, str(path)).collect()}
    assert {k: (x["semantic_rank"], x["text_rank"]) for k, x in got.items()} == {(q, i): (place[0].get((q, i)), place[1].get((q, i))) for q in every for i in every[q]}
    weighted = {(q, i): (0.6 * s[q].get(i, 0), 0.4 * t.get(q, {}).get(i, 0)) for q in every for i in every[q]}
    same({(q, i): c for q, i, c in run(spark, "a08_max_weighted_fuse", path)}, {k: max(x) for k, x in weighted.items()})
    # equal scores keep the smaller id first in both scorers, so ranks are those of the lists
    same({(q, i): c for q, i, c in run(spark, "a07_rrf_fuse", path)}, {k: sum(w / (60 + p[k]) for w, p in zip((0.6, 0.4), place, strict=True) if k in p) for k in weighted})
    turns = {q: {i: -min([2 * place[0].get((q, i), 10**6), 2 * place[1].get((q, i), 10**6) + 1]) for i in own} for q, own in every.items()}
    assert set(run(spark, "t10_candidate_cap", path)) == {(q, i, n) for q in turns for n, i in enumerate(ranked(turns[q], turns[q], 100), 1)}
    for name in ("t11_hybrid_fuse", "t12_rerank_blend"):
        rows = run(spark, name, path)
        assert {(q, i) for q, i, *_ in rows} == set(weighted) and all(sorted(n for q, _, _, n in rows if q == p) == list(range(1, len(every[p]) + 1)) for p in every)


def test_all_orders_are_reconciled(spark, tmp_path):
    rows = [(k, k % 40, "F" if k == 7 else "O", "5-LOW") for k in range(7, 600, 7)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert run(spark, "v13_reconcile_run", tmp_path) == [("5-LOW", len(rows), 40, True)]


# Sequences


def test_twelve_candidates_of_an_event(spark, tmp_path):
    """One hot user with fifteen events of each kind on a day: full chains by brute force, the beam's 400 best of them."""
    rng = np.random.default_rng(10)
    kinds = ["view", "click", "purchase"]
    rows = [(i, 1, datetime(2024, 1, 1) + timedelta(minutes=30 * i + int(i % 3)), kinds[int(k)], float(x)) for i, (k, x) in enumerate(zip(rng.permutation(np.repeat([0, 1, 2], 15)), rng.permutation(45) + 1.0, strict=True))]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    pool = [sorted((r for r in rows if r[3] == k), key=lambda r: -r[4])[:12] for k in kinds]
    assert {f for *_, f in run(spark, "q02_prune_per_video", tmp_path)} == {r[0] for p in pool for r in p}
    limit = timedelta(hours=12)
    fits = lambda a, b: timedelta(0) < b[2] - a[2] <= limit
    chains = [(a[0], b[0], c[0]) for a in pool[0] for b in pool[1] if fits(a, b) for c in pool[2] if fits(b, c)]
    assert 64 < len(chains) <= 400
    assert {tuple(f) for _, _, f, _ in run(spark, "q03_beam_search", tmp_path)} == set(chains)
    ends = run(spark, "q03_beam_search_partial", tmp_path)
    assert {m for _, _, f, _, _ in ends for m in f} - {r[0] for p in pool for r in p[:4]}


def test_events_of_a_long_video(spark):
    """Runs between gaps are folded apart; numbers go on over the whole video."""
    rng = np.random.default_rng(12)
    at = np.cumsum(rng.choice([1.0, 5.0, 7.0, 30.0], 300, p=[0.4, 0.3, 0.2, 0.1]))
    rows = [(1 + i % 2, i, float(t), (np.array([1.0, 0.2]) + 0.5 * rng.normal(size=2)).tolist()) for i, t in enumerate(at)]
    frames = spark.createDataFrame(rows, "video_id long, keyframe_id long, seconds double, embedding array<double>").repartition(5)
    for centroid in (False, True):
        want = []
        for video in (1, 2):
            events = []
            for _, i, t, x in (r for r in rows if r[0] == video):
                x = np.array(x) / np.linalg.norm(x)
                e = events[-1] if events else None
                if e and t - e["end"] <= 6 and t - e["start"] <= 45 and (e["sum"] / np.linalg.norm(e["sum"]) if centroid else e["last"]) @ x >= 0.72:
                    e.update(end=t, ids=[*e["ids"], i], sum=e["sum"] + x, last=x)
                else:
                    events.append({"start": t, "end": t, "ids": [i], "sum": x, "last": x})
            want += [(video, n, e["ids"][0], e["ids"][-1], e["start"], e["end"], len(e["ids"])) for n, e in enumerate(events)]
        found = w.segment_events(frames, centroid)
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
        assert sorted(tuple(r) for r in found.collect()) == want


def test_scores_leave_a_task_once(spark):
    """A document meets all queries where it is read: no shuffle of pairs, whatever the slices, and long lists by token agree."""
    docs = spark.createDataFrame([(i, f"alpha w{i % 7} w{i % 11} beta beta" if i % 5 else None) for i in range(300)], "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame([(i, f"beta beta beta w{i} alpha") for i in range(9)], "query_id long, query_text string")
    boosts = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 0.0)], "field string, boost double")
    fields = docs.withColumn("field", F.element_at(F.array(*map(F.lit, "abc")), (F.col("doc_id") % 3 + 1).cast("int")))
    near = r.overlap_scores(docs, asked, ["doc_id"])
    assert "Exchange hashpartitioning(query_id" not in near._jdf.queryExecution().toString()

    def both():
        pairs = {(x["query_id"], x["doc_id"]): round(x["score"], 9) for x in r.overlap_scores(docs, asked, ["doc_id"]).collect()}
        best = {(x["query_id"], x["doc_id"]): (round(x["score"], 9), x["rank"]) for x in r.best_fields(fields, asked, boosts, 5).collect()}
        return pairs, best

    whole = both()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(r, "BROADCAST_ROWS", 0)
        assert both() == whole and len(whole[0]) == 9 * 240
