"""The shingle join against a brute-force version, and its odd cases."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenreel.llm import shingle_join as sj


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for j in range(len(rows)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {rows[k][0]: (len(sets[k]), rows[root(k)][0]) for k in range(len(rows))}


def corpus(seed, n=260):
    """Families of edits at every distance around the threshold, chains of small edits, and passages many texts share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    passages = [[rng.choice(vocabulary) for _ in range(60)] for _ in range(4)]
    texts = []
    while len(texts) < n:
        size = rng.choice([1, 3, 5, 7, 40, 120, 400, 1200])
        base = [rng.choice(vocabulary) for _ in range(size)]
        if rng.random() < 0.5:
            at = rng.randrange(size + 1)
            base[at:at] = rng.choice(passages)
        texts.append(base)
        chain = base
        for _ in range(rng.choice([0, 0, 1, 3, 6])):
            source = chain if rng.random() < 0.5 else base
            edited = list(source)
            for _ in range(rng.randrange(1, max(2, len(edited) // 35 + 2))):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                edited = edited[: max(1, int(len(edited) * rng.uniform(0.75, 1)))]
            texts.append(edited)
            chain = edited
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(sj, "TILE", 64)
    rows = sorted(corpus(seed))
    got = sj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_second_step_alone_finds_all_links(spark, monkeypatch):
    """Without any star the exact step must find every component."""
    monkeypatch.setattr(sj, "TILES", 2)
    monkeypatch.setattr(sj, "closer_pairs", lambda sets: sets.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).where("false"))
    monkeypatch.setattr(sj, "star_pairs", lambda sets: sets.select(*(F.col("doc_id").alias(c) for c in ("a", "b")), *(F.col("n").alias(c) for c in ("n_a", "n_b")), *(F.col("counts").alias(c) for c in ("counts_a", "counts_b"))).where("false"))
    rows = sorted(corpus(3, 200))
    got = sj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_tree_equals_scan():
    rng = np.random.default_rng(0)
    n_rows = 700
    base = rng.poisson(3, (20, sj.GROUPS))
    counts = np.clip(base[rng.integers(0, 20, n_rows)] + rng.integers(-1, 2, (n_rows, sj.GROUPS)), 0, 255).astype(np.uint8)
    n = counts.sum(1).astype(np.int64)
    order = np.argsort(n, kind="stable")
    points = sj.Points([counts[i].tobytes() for i in order], n[order])
    a, b = np.triu_indices(n_rows, 1)
    for cluster in (np.arange(n_rows), np.where(rng.random(n_rows) < 0.6, -1, np.arange(n_rows) // 2)):
        found = [(min(p), max(p)) for i, j in sj.Tree(points, cluster).pairs() for p in zip(i.tolist(), j.tolist(), strict=True)]
        ok = points.allow(a, b) & (cluster[a] != cluster[b])
        assert len(found) == len(set(found)) and ok.any()
        assert set(found) == set(zip(a[ok].tolist(), b[ok].tolist(), strict=True))


def test_shared_tokens_equal_sets():
    rng = np.random.default_rng(1)
    sets = [set(rng.integers(0, 60, rng.integers(1, 30)).tolist()) for _ in range(50)]
    place, token = (np.array(x) for x in zip(*[(k, t) for k, own in enumerate(sets) for t in own], strict=True))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(50), np.arange(50)))
    assert sj._Held(place, token, 50).shared(i, j).tolist() == [len(sets[a] & sets[b]) for a, b in zip(i, j, strict=True)]


def test_words_with_equal_polynomial_hashes_differ(spark):
    """Words of a and b in Thue-Morse order and its complement are equal to any polynomial hash of 64 bits."""
    one = "a"
    while len(one) < 1024:
        one += one.translate({97: "b", 98: "a"})
    rows = [(1, one), (2, one.translate({97: "b", 98: "a"}))]
    got = sj.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2)]


def test_large_group_of_near_copies_gives_few_pairs(spark):
    """A group whose members are like the base and often unlike each other: what the exact step finds grows with the group, not its square."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(400):
        own = list(base)
        for at in rng.sample(range(0, 150, 5), rng.choice([1, 2, 3])):
            own[at] = f"x{i}-{at}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    classes = sj.describe(docs, np.zeros(0, np.uint64)).withColumnRenamed("low", "_low").withColumn("rep", F.col("doc_id"))
    links = sj.verify(sj._bounded(sj.star_pairs(classes)).distinct(), docs)
    links = links.unionByName(sj.verify(sj.closer_pairs(sj._placed(classes, links)), docs))
    assert sj.missed_pairs(sj._placed(classes, links)).count() <= 2 * len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in sj.near_duplicates(docs).collect()} == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE two"), (6, long), (7, long + " end"), (7, long + " end"), (8, "one two three")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, n string, cluster int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in sj.near_duplicates(df).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 2996, 6), (7, 2997, 6), (7, 2997, 6), (8, 1, 8)]
    kept = sj.one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 8]
    assert sj.near_duplicates(df.limit(0)).count() == 0
