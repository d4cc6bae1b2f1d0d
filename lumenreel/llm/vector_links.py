"""Operator 4: near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors are rotated by a fixed rotation and split into BLOCKS blocks of coordinates. Two vectors with cosine c
have a squared distance of 2 - 2c, so in at least one block their squared distance is within that block's share of
it. Each block is joined on its own by ranges: its leading coordinate is cut into slabs, a row is at home in its slab
and a guest in the slabs above that its block's radius reaches, and rows of a slab whose leading coordinates are
within the radius and whose block distance is within the share are candidates. Each is verified exactly with all
coordinates, and a pair found in several blocks counts in the first: turned coordinates are whole numbers, so that all
tasks agree exactly on which blocks find a pair. Equal vectors are one class; tasks return counts and a spanning forest
of their links, never the pairs of a group.

Defined results: a row without label, or with an unusable vector, links with nothing, and vectors of unlike lengths
don't link; all lengths are joined in one job. A vec_id is one vector: of its rows that can link the one with the
smallest label and then name of the vector takes part, and every row of the vec_id gets its result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import stored
from lumenreel.llm.components import Forest, components
from lumenreel.llm.vectors import fingerprint, matrix, usable

COSINE = 0.93
BLOCKS = 4
#: Rows of a tile; a slab with more is dealt over pairs of tiles.
TILE = 2_048
SLABS = 8
TASK = ["label", "dim", "block", "slab", "low", "high"]


#: Turned coordinates of unit vectors are whole numbers of this fraction of one.
SCALE = 1 << 24


@functools.lru_cache(maxsize=4)
def _rotation(dim: int, seed: int = 3) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return np.rint(q * (1 << 22))


def turned(x: np.ndarray) -> np.ndarray:
    """The unit vectors of x in turned coordinates, times SCALE and rounded.

    All products and sums are of whole numbers below 2**53 and so exact, in whatever order they are made; so are the
    squared distances of blocks.
    """
    unit = np.rint(x / np.sqrt((x**2).sum(1, keepdims=True)) * SCALE)
    return np.rint(unit @ _rotation(x.shape[1]) / (1 << 22))


def vector_links(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", "embedding", "label")
    able = rows.where(usable("embedding") & F.col("label").isNotNull())
    named = able.select("vec_id", "label", fingerprint("embedding").alias("name"), "embedding")
    own = named.groupBy("vec_id").agg(F.min(F.struct("label", "name")).alias("of")).select("vec_id", "of.label", "of.name")
    counts = own.groupBy("label", "name").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    each = named.groupBy("label", "name").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    classes = stored(counts.join(each, ["label", "name"]), "vector-classes")
    found = stored(class_links(classes, cosine, blocks), "vector-links")
    linked = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("more"))
    joined = components(found.where("b is not null and a <> b").select("a", "b"))
    whole = (
        classes.drop("embedding").join(linked, "rep", "left").join(joined, F.col("id") == F.col("rep"), "left")
        .select("label", "name", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    inside = own.join(whole, ["label", "name"]).select("vec_id", "n_links", "component_id")
    all_rows = rows.select("vec_id").join(inside, "vec_id", "left")
    told = all_rows.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return told.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def class_links(classes: DataFrame, cosine: float, blocks: int) -> DataFrame:
    """For classes (label, rep, copies, embedding): rows (a, null, n) that add n links to class a, and rows (a, b, 0)
    that are a spanning forest of each task's links."""
    share = (2 - 2 * cosine) / blocks * (1 + 1e-5) + 1e-9  # more than rounding takes away
    radius = share**0.5

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row once for each block, with the block's leading coordinate."""
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = batch.filter(pa.array(dims == dim))
                x = matrix(rows.column("embedding"))
                own = turned(x) / SCALE
                for k, part in enumerate(np.array_split(np.arange(x.shape[1]), blocks)):
                    place = pa.array(own[:, part[0]] if len(part) else np.zeros(len(x)))
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), pa.array([k] * len(x), pa.int32()), place], [*columns, "block", "place"])

    columns = ["label", "rep", "copies", "embedding", "dim"]
    schema = "label int, rep long, copies long, embedding array<float>, dim int, block int, place double"
    # Vectors of unlike lengths don't link: the length is part of every key.
    led = classes.select(F.col("label").cast("int").alias("label"), "rep", "copies", "embedding", F.size("embedding").alias("dim"))
    placed = led.mapInArrow(lead, schema)
    # Slabs as wide as the radius at least; how many of their neighbours a row visits is then bounded.
    wide = F.greatest(F.lit(radius), 2.0 / SLABS / F.sqrt("dim"))
    home = F.floor(F.col("place") / wide).cast("int")
    reach = F.floor((F.col("place") + radius) / wide).cast("int")
    dealt = placed.withColumn("slab", F.explode(F.sequence(home, reach))).withColumn("guest", F.col("slab") > home)
    sizes = dealt.groupBy("label", "dim", "block", "slab").agg(F.count(F.lit(1)).alias("rows"))
    tiles = F.ceil(F.col("rows") / TILE).cast("int")
    tiled = dealt.join(sizes, ["label", "dim", "block", "slab"]).withColumn("tiles", tiles).drop("rows").withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    pairs = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = pairs.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other")).drop("other", "tiles")
    return pairs.repartition(*TASK).sortWithinPartitions(*TASK).mapInArrow(_tile_links(cosine, blocks, share, radius), "a long, b long, n long")


def _tile_links(cosine: float, blocks: int, share: float, radius: float):
    def tile(rows: pa.Table) -> pa.RecordBatch:
        _, _, block, _, low, high = (rows.column(c)[0].as_py() for c in TASK)
        rep, copies = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
        guest, place = rows.column("guest").to_numpy(), rows.column("place").to_numpy()
        of = rows.column("tile").to_numpy()
        order = np.argsort(place, kind="stable")
        rep, copies, guest, place, of = rep[order], copies[order], guest[order], place[order], of[order]
        x = matrix(rows.column("embedding").combine_chunks())[order]
        squares = (x**2).sum(1)
        placed = turned(x)
        parts = np.array_split(np.arange(x.shape[1]), blocks)
        own = placed[:, parts[block]]
        most = share * SCALE**2
        square = (own**2).sum(1)
        gained = np.zeros(len(rep), np.int64)
        forest = Forest()
        root = np.arange(len(rep))
        # A guest's slab is above its home: the pair belongs to the slab where the upper of the two is at home, so a
        # pair of guests is left to a slab below.
        for a in range(0, len(rep), 256):
            b = min(a + 256, len(rep))
            end = int(np.searchsorted(place, place[b - 1] + radius, side="right"))
            near = square[a:b, None] + square[None, a:end] - 2 * own[a:b] @ own[a:end].T <= most
            near &= (np.arange(a, b)[:, None] < np.arange(a, end)[None, :]) & ~(guest[a:b, None] & guest[None, a:end])
            if low != high:
                near &= of[a:b, None] != of[None, a:end]
            i, j = np.nonzero(near)
            for s in range(0, len(i), 200_000):
                p, q = i[s : s + 200_000] + a, j[s : s + 200_000] + a
                exact = np.einsum("ij,ij->i", x[p], x[q]) / (np.sqrt(squares[p]) * np.sqrt(squares[q])) >= cosine
                p, q = p[exact], q[exact]
                for earlier in range(block):  # the pair counts in the first block that finds it
                    c = parts[earlier]
                    first = ((placed[p][:, c] - placed[q][:, c]) ** 2).sum(1) <= most
                    p, q = p[~first], q[~first]
                np.add.at(gained, p, copies[q])
                np.add.at(gained, q, copies[p])
                loose = root[p] != root[q]
                for u, v in zip(p[loose].tolist(), q[loose].tolist(), strict=True):
                    forest.join(u, v)
                    root[u] = root[v] = forest.root(u)
        links = np.array(forest.edges(), np.int64).reshape(-1, 2)
        some = np.flatnonzero(gained)
        a = np.concatenate((rep[some], rep[links[:, 0]]))
        b = pa.array(np.concatenate((np.zeros(len(some), np.int64), rep[links[:, 1]])), mask=np.arange(len(a)) < len(some))
        n = np.concatenate((gained[some], np.zeros(len(links), np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(n)], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in TASK], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                key = tuple(keys[a].tolist())
                if key != last and held:
                    yield tile(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = key
        if held:
            yield tile(pa.Table.from_batches(held))

    return run
