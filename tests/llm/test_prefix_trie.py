"""The trie of conversation prefixes against a plain trie of tuples, and running combinations over blocks."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenreel.llm import ordered_scan, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, owner long"


@pytest.fixture(autouse=True)
def many_blocks(spark):
    """Small tables too are dealt to several blocks, so that groups go over their ends."""
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "6"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def modulo(c: int) -> int:
    return c % 5 if c >= 0 else -(-c % 5)


def brute(rows):
    """Rows are (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", (text or "").encode()))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - modulo(c), [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = {}
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = {p for p in below if len(p) == len(path) + 1}
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        told = ",".join(map(str, sorted(ends[path])))
        out[min(convs), len(path)] = (min(members[path[:-1]]) if path else None, len(convs), len(children), leaves, saved, hashlib.sha256(told.encode()).hexdigest())
    return out


def run(spark, rows, parts=3):
    table = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA).repartition(parts)
    got = prefix_trie.prefix_trie(table)
    assert got.columns == [x.split()[0] for x in prefix_trie.RESULT.split(", ")]
    got = got.collect()
    found = {(r.conv_id, r.depth): tuple(r)[2:] for r in got}
    assert len(found) == len(got)
    return found


def random_rows(seed, n_convs, texts):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-12, 40), n_convs):
        for turn in range(r.choice([1, 2, 5, 9, 14])):
            rows.append((c, r.choice([None, turn, turn, turn // 2]), r.choice(["user", "bot", None]), r.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = random_rows(seed, 24, ["a", "b", "é\n", None, ""])
    rows += rows[:5] + [(None, 1, "user", "lost")]
    assert run(spark, rows) == brute(rows)


def test_copies_and_long_conversations(spark):
    long = [(7, k, "user", f"t{k}") for k in range(700)]
    copies = [(c, k, "user", f"t{k}") for c in range(100, 140) for k in range(12)]
    tails = [(c, k, "user", f"t{k}" if k < 11 + c % 3 else f"own {c}") for c in range(200, 215) for k in range(14)]
    same = [(5, 1, "user", "again")] * 30
    rows = long + copies + tails + same
    assert run(spark, rows, 8) == brute(rows)


def test_turnless_and_empty(spark):
    # Own heads are left out and no base is there, so these may have no turn at all.
    rows = [(c, 0, "user", "x") for c in (1, 2, 3, 4, 6, 7, 8, 9)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(None, 0, "user", "x")]) == {}
    table = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(table).count() == 0


def test_many_ends_of_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 7)
    rows = [(c, 0, "user", "same") for c in range(0, 500, 5)]
    assert run(spark, rows) == brute(rows)


def test_like_hashes_are_not_trusted(spark, monkeypatch):
    real, calls = prefix_trie._stored_turns, []

    def poor(conversations, seed):
        calls.append(seed)
        turns = real(conversations, seed)
        return turns.withColumns({"h1": F.pmod("h1", F.lit(2)), "h2": F.pmod("h2", F.lit(2))}) if seed == 0 else turns

    monkeypatch.setattr(prefix_trie, "_stored_turns", poor)
    rows = random_rows(5, 12, list("abcdefgh"))
    assert run(spark, rows) == brute(rows) and calls == [0, 1]


def test_running_over_blocks(spark):
    r = random.Random(1)
    rows = [(g, k, r.randrange(-50, 50)) for g, n in ((1, 4000), (2, 1), (3, 700), (4, 3)) for k in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, k long, v long").repartition(5)
    got = ordered_scan.running(df, "g", [F.col("k")], ["v"], ["total"], ordered_scan.sums, ordered_scan.add, "test-running").collect()
    want, total = {}, defaultdict(int)
    for g, k, v in sorted(rows):
        total[g] += v
        want[g, k] = total[g]
    assert {(x.g, x.k): x.total for x in got} == want and len(got) == len(rows)


def test_maps_are_a_group():
    r = np.random.default_rng(3)
    a, b = r.integers(0, 2**63, 50, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, 50, dtype=np.uint64)
    one = prefix_trie.then((a, b), prefix_trie.undo((a, b)))
    assert (one[0] == 1).all() and (one[1] == 0).all()
