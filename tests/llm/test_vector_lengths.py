"""Vectors of many lengths in one table."""

from __future__ import annotations

import numpy as np

from lumenreel.llm import vector_links


def test_every_length_is_linked(spark):
    rng = np.random.default_rng(6)
    rows = []
    for dim in [*range(1, 25), 40]:
        base = rng.normal(size=dim)
        for k in range(6):
            rows.append((len(rows), (base + rng.normal(size=dim) * (0.1 if k < 4 else 1.0)).astype(np.float32).tolist(), k % 2))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_links.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    near = {i: {i} for i, _, _ in rows}
    for i, x, a in rows:
        for j, y, b in rows:
            if i != j and a == b and len(x) == len(y) and np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)) >= 0.93:
                near[i].add(j)

    def component(i):
        seen, todo = set(), [i]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                todo += near[k]
        return min(seen)

    assert any(len(near[i]) > 1 for i, x, _ in rows if len(x) == 40)
    assert got == {i: (len(near[i]) - 1, component(i)) for i, _, _ in rows}
