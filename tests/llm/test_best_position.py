"""Ranked search against plain scores of every document, and the stop of the Best Position Algorithm."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lumenreel.llm import best_position as bp

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """Rows (item_id, rank, doc_id, score); docs and items are lists of (id, text)."""
    own = [(d, Counter(terms_of(t))) for d, t in docs if terms_of(t)]
    n_docs, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked: dict = {}
    for i, text in items:
        asked.setdefault(i, Counter()).update(terms_of(text))
    out = []
    for i, times in asked.items():
        scores = []
        for d, c in own:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in times.items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r, None if no else d, -s) for r, (s, no, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=10, **options):
    d = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], "doc_id long, text string, score string, n int").repartition(3)
    q = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, rank double")
    got = bp.search(d, q, k, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def texts(seed, n, words):
    r = random.Random(seed)
    every = [w for k, w in enumerate(words) for _ in range(1 + 40 // (k + 1))]
    return [" ".join(r.choice(every) for _ in range(r.choice([1, 3, 8, 40]))) for _ in range(n)]


WORDS = ["the", "The", "a1", "straße", "ÉTÉ", "été", "x_y", "don't", "日本", "😀word", "longer-than-eight-bytes", "anotherlongword", "anotherlongwird", "q"]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(bp, "SHARD_DOCS", 37)
    monkeypatch.setattr(bp, "FIRST_READ", 1)
    docs = list(enumerate(texts(seed, 300, WORDS)))
    docs += [(None, "the été"), (None, "q q"), (5, "the été"), (5, "the été"), (900, None), (901, ""), (902, "... ---")]
    items = list(enumerate(texts(seed + 50, 12, WORDS))) + [(3, "the q"), (77, None), (78, "?!"), (79, "nowhere"), (None, "q")]
    assert run(spark, docs, items) == brute(docs, items, 10)


def test_ties_go_to_smaller_ids_and_blocks_agree(spark, monkeypatch):
    monkeypatch.setattr(bp, "SHARD_DOCS", 16)
    docs = [(k, "same words here" if k % 2 else "other text") for k in range(400, 0, -1)]
    items = [(k, t) for k, t in enumerate(["same here", "other", "words other", "same"])]
    assert run(spark, docs, items) == brute(docs, items, 10) == run(spark, docs, items, block_rows=2)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == [] == run(spark, [(1, "a b")], [])
    assert run(spark, [(1, None), (2, "!")], [(1, "a b")]) == []


def test_long_text(spark):
    docs = [(1, "word " * 300_000 + "needle"), (2, "needle"), (3, "w" * 400_000)]
    items = [(1, "needle word"), (2, "w" * 400_000)]
    assert run(spark, docs, items) == brute(docs, items, 10)


def test_stops_early_and_reads_all_ties():
    """One list falls steeply: few documents are looked up, and the rest cannot matter."""
    r = np.random.default_rng(2)
    n, n_terms = 5000, 4
    doc, term = np.tile(np.arange(n), n_terms), np.repeat(np.arange(n_terms), n)
    impact = np.concatenate([r.permutation((1_000_000 / np.arange(1, n + 1)).astype(np.int64)) for _ in range(n_terms)])
    shard = bp.Shard(doc, term, impact, n, n_terms)
    top: list = []
    looked = shard.best(np.arange(n_terms), np.array([1, 2, 1, 1]), 10, np.arange(n), top)
    total = (impact.reshape(n_terms, n) * np.array([[1], [2], [1], [1]])).sum(axis=0)
    want = sorted(((int(s), -d) for d, s in enumerate(total)), reverse=True)[:10]
    assert sorted(top, reverse=True) == want and looked < n / 4
    assert shard.best(np.arange(n_terms), np.ones(4, np.int64), 10, np.arange(n), [(10**9, -1)] * 10) == 0  # nothing here can be as good
    # All impacts equal: documents that tie with the kth are never cut off.
    shard = bp.Shard(doc, term, np.full(len(doc), 7), n, n_terms)
    top = []
    shard.best(np.arange(n_terms), np.ones(4, np.int64), 10, np.arange(n)[::-1].copy(), top)
    assert sorted(-d for _, d in top) == list(range(10))


def test_terms_with_equal_hashes_are_told_apart(monkeypatch):
    """A word that only has the hash of a term is no term."""
    vocabulary = bp.Vocabulary(["alpha", "a-much-longer-term".replace("-", ""), "beta"])
    words = bp.Words(["alpha gamma amuchlongerterm amuchlongertarm beta"], bp.TERM_BYTES)
    real, _ = vocabulary.find(words)
    assert real.tolist() == [0, 2, 4]
    words.hashes[1], words.hashes[3] = words.hashes[0], words.hashes[2]
    assert vocabulary.find(words)[0].tolist() == [0, 2, 4]
