"""Operator 3: approximate nearest neighbours by multi-index hashing.

Vectors are turned by learned rotations (principal axes, then alternating sign fitting, from several angles) and their
signs are a binary code. The code is split into substrings of SUBSTRING bits, each with its own table of buckets. A
query probes the buckets within `most` bits of its own substring in each of `tables` tables: by the pigeonhole these
hold every code within a Hamming radius of tables * (most + 1) - 1, and all rows of the probed buckets, no others, are
ranked by their inner product in doubles. As inner products depend on norms, codes are made of vectors with one
coordinate more, which brings all rows to the same norm.

Rotations, `tables` and `most` are fitted on a bounded sample (SAMPLE_ROWS): of the choices that reach the share COVER
of true neighbours in the sample, the one whose buckets hold least of it. Every row is indexed. Queries that find fewer
than k candidates are compared with all rows. Queries and index are dealt in blocks of bounded size, each pair of
blocks one task's work.

Defined results: unusable vectors (null, zero, null or non-finite components) take no part. Only vectors of one length
are compared with each other; of lengths with fewer than LEAST rows in the sample all rows are candidates. Of rows with
the same vec_id the one with the smallest vector takes part. A query's own row is the one with its vec_id.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.llm.common import stored
from lumenreel.llm.vectors import matrix, usable

SAMPLE_ROWS = 4_000
COVER = 0.95
#: Rows of a length that the sample must hold for codes to be fitted.
LEAST = 50
INDEX_BLOCK = 8_192
QUERY_BLOCK = 8_192
SUBSTRING = 16
#: Numbers of tables to choose from.
TABLES = tuple(range(4, 49, 2))
#: Rotations that are fitted; further ones, which short vectors need, are random.
LEARNED = 12
#: Queries that probe a block's tables together.
ASKED = 128
RESULT = "query_id long, vec_id long, score double"
_ONES = np.array([bin(i).count("1") for i in range(1 << SUBSTRING)], np.uint8)
_BY_ONES = np.argsort(_ONES, kind="stable")


class Codes:
    """Learned rotations to sign codes, and how widely their tables are probed."""

    def __init__(self, sample: np.ndarray, norm: float, k: int = 20, rows: int = 0, cover: float = COVER, rounds: int = 15, seed: int = 11):
        """norm: the largest norm of all rows; rows: how many there are, of which the sample is a part."""
        rng = np.random.default_rng(seed)
        self.norm = max(norm, 1e-300)
        unit = self._lifted(sample)
        self.mean = unit.mean(0)
        centred = unit - self.mean
        _, _, axes = np.linalg.svd(centred, full_matrices=False)
        rotations = []
        for turned in range(-(-TABLES[-1] * SUBSTRING // len(axes))):
            flat = centred @ axes.T
            turn, _ = np.linalg.qr(rng.normal(size=(len(axes), len(axes))))
            for _ in range(rounds if turned < LEARNED else 0):
                u, _, vt = np.linalg.svd(np.sign(flat @ turn).T @ flat)
                turn = (u @ vt).T
            rotations.append(axes.T @ turn)
        self.rotation = np.concatenate(rotations, axis=1)[:, : TABLES[-1] * SUBSTRING]
        self._fit(sample, k, max(rows, len(sample)), cover)

    def _lifted(self, x: np.ndarray) -> np.ndarray:
        """Rows with one coordinate more, of norm 1."""
        more = np.sqrt(np.maximum(self.norm**2 - (x**2).sum(1), 0))
        return np.concatenate((x, more[:, None]), axis=1) / self.norm

    def _signs(self, lifted: np.ndarray) -> np.ndarray:
        bits = (lifted - self.mean) @ self.rotation > 0
        return np.packbits(bits, axis=1).view("<u2")

    def of(self, x: np.ndarray) -> np.ndarray:
        """The codes of rows, a number of SUBSTRING bits for each table."""
        return self._signs(self._lifted(x))

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        """The codes of queries, whose norm plays no part in the order of their neighbours."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return self._signs(np.concatenate((unit, np.zeros((len(x), 1))), axis=1))

    def _fit(self, sample: np.ndarray, k: int, rows: int, cover: float) -> None:
        """Choose tables and most. Of a query's k neighbours among all rows about k * sample / rows are in the sample."""
        asked = np.arange(0, len(sample), max(1, len(sample) // 200))
        near = sample[asked] @ sample.T
        near[np.arange(len(asked)), asked] = -np.inf
        true = np.argsort(-near, axis=1)[:, : max(1, min(round(k * len(sample) / rows), len(sample) - 1))]
        codes, own = self.of(sample), self.of_queries(sample[asked])
        least = np.full(near.shape, SUBSTRING, np.uint8)
        best = (2.0, 0, 0)
        for j in range(TABLES[-1]):
            least = np.minimum(least, _ONES[own[:, j, None] ^ codes[None, :, j]])
            if j + 1 in TABLES:
                hits = np.take_along_axis(least, true, 1)
                most = next(m for m in range(SUBSTRING + 1) if (hits <= m).mean() >= cover)
                best = min(best, (float((least <= most).mean()), j + 1, most))
        self.share, self.tables, self.most = best
        self.flips = _BY_ONES[: int((_ONES <= self.most).sum())].astype(np.int64)


class BlockIndex:
    """Tables of one block: for each substring the rows sorted by its value, and where each value's bucket starts."""

    def __init__(self, codes: np.ndarray):
        self.rows = len(codes)
        self.order = np.argsort(codes, axis=0, kind="stable").T
        self.starts = np.stack([np.searchsorted(codes[o, j], np.arange((1 << SUBSTRING) + 1)) for j, o in enumerate(self.order)])

    def probed(self, asked: np.ndarray, flips: np.ndarray) -> np.ndarray:
        """Whether each row lies in a bucket that each query probes: its own value in each table, with each of flips applied."""
        found = np.zeros((len(asked), self.rows), bool)
        for j, order in enumerate(self.order):
            value = asked[:, j, None].astype(np.int64) ^ flips
            begin = self.starts[j][value]
            size = self.starts[j][value + 1] - begin
            q, bucket = np.nonzero(size)
            begin, size = begin[q, bucket], size[q, bucket]
            total = np.cumsum(size)
            at = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(begin - (total - size), size)
            found[np.repeat(q, size), order[at]] = True
        return found


def _nearest(query: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k rows of x with the largest inner product, ties to smaller ids, and the products."""
    rough = x @ query
    if len(rough) > k:  # a product of matrices may differ from a row's own in the last bits
        least = np.partition(rough, len(rough) - k)[len(rough) - k]
        keep = np.flatnonzero(rough >= least - 1e-9 * (np.abs(rough).max() + 1e-300))
    else:
        keep = np.arange(len(rough))
    exact = np.einsum("ij,ij->i", x[keep], np.broadcast_to(query, (len(keep), len(query))))
    order = np.lexsort((ids[keep], -exact))[:k]
    return keep[order], exact[order]


def _one_each(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of each id, the one with the smallest vector."""
    if len(np.unique(ids)) < len(ids):
        order = np.lexsort((*x.T[::-1], ids))
        first = order[np.concatenate(([True], np.diff(ids[order]) != 0))]
        ids, x = ids[first], x[first]
    return ids, x


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, sample_rows: int = SAMPLE_ROWS, cover: float = COVER) -> DataFrame:
    """The k nearest found of each query among the other rows: query_id, rank, vec_id, score.

    vectors, queries: vec_id and embedding.
    """
    rows = vectors.select("vec_id", "embedding").where(usable("embedding"))
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).where(usable("query"))
    total, n_queries = rows.count(), asked.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total or not n_queries:
        return vectors.sparkSession.createDataFrame([], schema)
    codes = fitted(rows, total, k, sample_rows, cover)
    first = stored(_pairs(rows, asked, codes, k, total, n_queries), "nearest")
    short = asked.join(first.groupBy("query_id").count().where(F.col("count") >= k), "query_id", "left_anti")
    best = first
    if codes and not short.isEmpty():
        best = first.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(_pairs(rows, short, {}, k, total, n_queries))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def fitted(rows: DataFrame, total: int, k: int, sample_rows: int = SAMPLE_ROWS, cover: float = COVER) -> dict[int, Codes]:
    """Codes for each length of vectors of which the sample has enough rows."""
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(total)) < sample_rows) if total > sample_rows else rows
    taken = sample.limit(2 * sample_rows).toPandas().sort_values("vec_id")
    lengths = taken["embedding"].map(len)
    often = [int(d) for d, n in lengths.value_counts().items() if n >= LEAST]
    if not often:
        return {}
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    told = rows.where(F.size("embedding").isin(often)).groupBy(F.size("embedding").alias("dim")).agg(F.max(norm).alias("norm"), F.count(F.lit(1)).alias("rows")).collect()
    return {r.dim: Codes(np.array(taken["embedding"][lengths == r.dim].tolist(), np.float64), r.norm, k, r.rows, cover) for r in told}


def _pairs(rows: DataFrame, asked: DataFrame, codes: dict[int, Codes], k: int, total: int, n_queries: int) -> DataFrame:
    """The k best of each query in each index block; where a length has no codes all rows are candidates."""
    blocks, query_blocks = -(-total // INDEX_BLOCK), -(-n_queries // QUERY_BLOCK)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    # An index block is written to one group for each query block, and the reverse: a task has one of each.
    index = rows.select(block("vec_id", blocks).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"), F.lit(0).alias("asks"), "vec_id", "embedding")
    ask = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), block("query_id", query_blocks).alias("q"), F.lit(1).alias("asks"), F.col("query_id").alias("vec_id"), F.col("query").alias("embedding"))
    known = rows.sparkSession.sparkContext.broadcast(codes)  # lengths of the sample, at most 2 * SAMPLE_ROWS / LEAST

    def by_length(parts: list[pa.RecordBatch]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        out: dict[int, list] = {}
        for part in parts:
            lengths = part.column("dim").to_numpy()
            for dim in np.unique(lengths).tolist():
                own = part.filter(pa.array(lengths == dim))
                out.setdefault(dim, []).append((own.column("vec_id").to_numpy(), matrix(own.column("embedding"))))
        return {d: _one_each(np.concatenate([i for i, _ in own]), np.concatenate([x for _, x in own])) for d, own in out.items()}

    def answers(index: list[pa.RecordBatch], queries: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked = by_length(index), by_length(queries)
        for dim, (q_ids, q) in asked.items():
            if dim not in held:
                continue
            ids, x = held[dim]
            code = known.value.get(dim)
            table = BlockIndex(code.of(x)[:, : code.tables]) if code else None
            for a in range(0, len(q), ASKED):
                own, own_ids = q[a : a + ASKED], q_ids[a : a + ASKED]
                found = table.probed(code.of_queries(own)[:, : code.tables], code.flips) if code else np.ones((len(own), len(x)), bool)
                found &= own_ids[:, None] != ids[None, :]
                best = []
                for query, at in zip(own, map(np.flatnonzero, found), strict=True):
                    place, score = _nearest(query, x[at], ids[at], k)
                    best.append((ids[at[place]], score))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own_ids, [len(i) for i, _ in best])), pa.array(np.concatenate([i for i, _ in best])), pa.array(np.concatenate([c for _, c in best]))], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: tuple[list, list] = ([], [])
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in ("b", "q", "asks")]
            cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in keys], axis=0)) + 1
            for a, b in itertools.pairwise([0, *cuts, batch.num_rows]):
                key = keys[0][a], keys[1][a]
                if last is not None and key != last:
                    yield from answers(*parts)
                    parts = ([], [])
                last = key
                parts[keys[2][a]].append(batch.slice(a, b - a))
        if last is not None:
            yield from answers(*parts)

    dealt = index.unionByName(ask).withColumn("dim", F.size("embedding")).repartition("b", "q").sortWithinPartitions("b", "q", "asks")
    return dealt.mapInArrow(run, RESULT)
