"""Connected components of link tables by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import stored


class Forest:
    """Union-find over any ids; the root of a set is its smallest id."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while up.get(r, r) != r:
            r = up[r]
        while up.get(x, x) != r:
            up[x], x = r, up[x]
        return r

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, self.root(x)) for x in list(self.up) if self.root(x) != x]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of some rows as links to the smallest id of each set in them; a set forgotten is only less contracted."""
    forest = Forest()

    def out() -> pa.RecordBatch:
        e = np.array(forest.edges(), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest.up) > 500_000:
            yield out()
            forest = Forest()
    yield out()


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """id and component (smallest id reachable) of every id in links (a, b); ids without links aren't in it."""
    pairs = links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    edges = stored(pairs.mapInArrow(_contract, "a long, b long").distinct(), "links")
    before = None
    for _ in range(most_rounds):
        # Large star: every larger neighbour of a node is linked to the smallest id around that node.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        large = large.where("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_least.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a <> b").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        # Stars whose centres are nobody's leaf are final.
        if edges.select("a").intersect(edges.select("b")).isEmpty() and edges.groupBy("a").count().where("count > 1").isEmpty() or now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
