"""The vector operators against brute force, with copies, ties and unusable rows."""

from __future__ import annotations

import numpy as np
import pytest

from lumenreel.llm import nearest, queries, vector_links
from lumenreel.llm.components import components

NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    rows = []
    for i in range(900):
        x = base[rng.integers(60)] + rng.normal(size=16) * rng.choice([0, 0.05, 0.12, 0.18, 0.6])
        rows.append((i, [float(np.float32(v)) for v in x * rng.choice([0.5, 1, 3])], int(rng.integers(3))))
    rows += [(900 + i, rows[5][1], rows[5][2]) for i in range(40)]
    rows += [(950, None, 1), (951, [0.0] * 16, 1), (952, [NAN] * 16, 1), (953, [INF] * 16, 1), (954, rows[5][1], None), (955, [1.0, 2.0], 1), (956, [None] + [1.0] * 15, 1), (957, [-0.0] * 15 + [1.0], 0)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, block string").repartition(6)


def usable(rows, labels):
    return [r for r in rows if r[1] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) and (not labels or r[2] is not None)]


def test_links_equal_brute_force(table, monkeypatch):
    monkeypatch.setattr(vector_links, "TILE", 100)
    rows, df = table
    want = {r[0]: [0, r[0]] for r in rows}
    good = usable(rows, True)
    up = {r[0]: r[0] for r in good}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for label in {r[2] for r in good}:
        for dim in {len(r[1]) for r in good}:
            own = [r for r in good if r[2] == label and len(r[1]) == dim]
            x = np.array([r[1] for r in own], float).reshape(len(own), dim)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.93, 1)), strict=True):
                a, b = own[i][0], own[j][0]
                want[a][0] += 1
                want[b][0] += 1
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
    for i in up:
        want[i][1] = root(i)
    got = {r.vec_id: [r.n_links, r.component_id] for r in vector_links.vector_links(df).collect()}
    assert got == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in vector_links.vector_links(df).collect())


def test_search_recall_and_order(table):
    rows, df = table
    good = [r for r in usable(rows, False) if len(r[1]) == 16]
    ids, x = np.array([r[0] for r in good]), np.array([r[1] for r in good], float)
    got = {}
    for r in nearest.search(df, df.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        others = ids != q
        order = np.lexsort((ids[others], -s[others]))[:20]
        best = ids[others][order]
        own = sorted(got[q])
        assert [k for k, _, _ in own] == list(range(1, 21)) and q not in [v for _, v, _ in own]
        assert np.allclose([c for _, _, c in own], [s[ids == v][0] for _, v, _ in own])
        assert own == sorted(own, key=lambda o: (-round(o[2], 9), o[1])) or np.allclose(sorted([c for _, _, c in own], reverse=True), [c for _, _, c in own])
        hit += len({v for _, v, _ in own} & set(best.tolist()))
        total += 20
    assert len(got) == (ids % 20 == 0).sum() and hit / total >= 0.9


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 16, (500, 5)).astype(np.uint16)
    asked = codes[:40] ^ (rng.integers(0, 1 << 16, (40, 5)) & rng.integers(0, 1 << 16, (40, 5)) & rng.integers(0, 1 << 16, (40, 5))).astype(np.uint16)
    index = nearest.BlockIndex(codes)
    apart = nearest._ONES[asked[:, None] ^ codes[None]]
    for most in (0, 1, 3, 6):
        found = index.probed(asked, nearest._BY_ONES[: (nearest._ONES <= most).sum()].astype(np.int64))
        assert (found == (apart <= most).any(2)).all()
        assert found[apart.sum(2) <= 5 * (most + 1) - 1].all()


@pytest.mark.parametrize(("folder", "most"), [("sf0.01", 0.5), ("sf0.1", 0.45)])
def test_recall_and_share_on_the_given_tables(spark, folder, most):
    """The registered query against brute force, and how much of the table the fitted codes probe."""
    rows = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").select("vec_id", "embedding")
    told = rows.toPandas().sort_values("vec_id")
    ids, x = told["vec_id"].to_numpy(), np.array(told["embedding"].tolist(), float)
    got: dict = {}
    for r in queries.queries()["op3_nearest"](spark, f"/root/testdata/{folder}").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in ids[ids % 20 == 0]:
        s = np.where(ids == q, -np.inf, x @ x[ids == q][0])
        hit += len(got[q] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hit / (20 * len(got)) >= 0.9 and len(got) == (ids % 20 == 0).sum()
    code = nearest.fitted(rows, len(ids), 20)[x.shape[1]]
    own = code.of_queries(x[ids % 20 == 0])[:, : code.tables]
    assert nearest.BlockIndex(code.of(x)[:, : code.tables]).probed(own, code.flips).mean() < most


def test_repeated_ids_and_lengths(spark):
    """Of rows with the same vec_id one takes part; vectors of a rare length are compared with each other; norms count."""
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 20])).astype(np.float32).tolist()) for i in range(300)]
    rows += [rows[0], rows[0], rows[7], (20, [-9.0] * 8), (20, [5.0] * 8)]
    rows += [(400 + i, [float(i + 1), 1.0]) for i in range(5)] + [(500, [1.0] * 3)]
    least = {}
    for i, v in rows:
        least[i, len(v)] = min(v, least.get((i, len(v)), v))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got: dict = {}
    for r in nearest.search(df, df.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for (q, dim), v in least.items():
        if q % 20:
            continue
        others = sorted((-float(np.dot(np.array(v, float), np.array(w, float))), i) for (i, d), w in least.items() if i != q and d == dim)[:20]
        own = sorted(got.get(q, []))
        assert len({i for _, i, _ in own}) == len(own) == len(others)
        hit += len({i for _, i, _ in own} & {i for _, i in others})
        total += len(others)
        if dim < 8:
            assert [i for _, i, _ in own] == [i for _, i in others]
    assert hit / total >= 0.9 and 500 not in got and len(got[400]) == 4


def test_links_with_repeated_ids(spark):
    x, y, z = [1.0, 0.0], [1.0, 0.1], [0.0, 1.0]
    rows = [(1, x, 0), (1, x, 0), (2, y, 0), (3, z, 0), (3, x, 1), (4, z, 0), (4, None, 0), (5, x, 1), (6, x, 1), (6, z, 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vector_links.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    sixth = got[-1][1:]
    assert got[-2][1:] == sixth and sixth in ((1, 5), (0, 6))
    assert got[:-2] == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 3), (3, 1, 3), (4, 1, 3), (4, 1, 3), (5, sixth[0], 5)]


def test_small_and_empty(spark, table):
    _, df = table
    few = df.where("vec_id < 3")
    got = nearest.search(few, few, 20).groupBy("query_id").count().collect()
    assert sorted(r["count"] for r in got) == [2, 2, 2]
    none = df.limit(0)
    assert nearest.search(none, none).count() == 0 and vector_links.vector_links(none).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 103), (103, 101), (102, 101), (200, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 102, 103)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
