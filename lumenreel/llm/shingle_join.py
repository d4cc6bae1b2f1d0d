"""Operator 1: n-gram Jaccard join by a count-vector R-tree.

A document's shingles are hashed into GROUPS groups; the counts by group are a point, and the sum over groups of the
smaller of two counts bounds the overlap of two sets from above. Equal sets are one class, so only classes are joined.

1. Each class meets the smallest class that shares one of its KEYS least hashes (a star, not all pairs of a group).
   Pairs whose points allow the threshold are verified; the components of these links are clusters. Where the classes
   of a key are still of several clusters, each class outside the largest one asks an R-tree of the key's points for
   its NEAREST classes of other clusters by the bound; these are verified and clusters grow.
2. What that may have missed is found exactly. Two sets at or above the threshold share a token among the first
   n - ceil(t n) + 1 of each in any common order; here frequent shingles come last, found by a count over all
   documents. Tokens that classes of several clusters have are dealt by their smallest class, and the classes that
   meet there are packed into an R-tree of their points, whose nodes hold the largest counts and smallest sizes below
   them. Pairs of different clusters that survive it, and whose prefixes can still share as many tokens as the
   threshold implies, leave the task; those that do share as many in all are verified.

Verification compares the whole sets of 64-bit shingle hashes, made anew from the whole texts. No pair of a cluster
is enumerated in step 2, as it changes no component.

Defined results: null and empty texts have no shingles and are alone; with fewer than five words the whole sequence
is one shingle; rows that repeat a doc_id are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenreel.llm.common import as_documents, mix, shingles, slices, stored
from lumenreel.llm.components import components

SIZE = 5
#: The threshold as a fraction: NUMERATOR * union <= DENOMINATOR * intersection.
NUMERATOR, DENOMINATOR = 4, 5
GROUPS = 64
#: Sets of at least LARGE shingles have points of FINE groups, as random counts of large sets tell less apart.
FINE, LARGE = 256, 800
KEYS = 4
#: A shingle is frequent if more than this share of documents has it; so there are at most 1/share times the mean
#: set size of them, which bounds what is broadcast.
FREQUENT = 0.001
FREQUENT_LEAST = 16
#: Tokens that a task counts at a time.
COUNTED = 800_000
NODE = 32
CHUNK = 32
BUCKETS = 1 << 20
#: Partners that a class outside the largest cluster of a key asks the key's tree for.
NEAREST = 3
#: Rows of a key that are asked together; a key with more is cut, as this step need not find all.
ASKED = 2_048
#: Rows of a task of the exact step. Groups of tokens with more are dealt over pairs of tiles of their classes.
TILE = 8_192
#: A group of tokens with more than TILES tiles is dealt by token too, so that rows are repeated TILES times at most.
TILES = 8
#: Pairs that are looked at together.
AT_ONCE = 8_192
_U = np.uint64


def frequent_shingles(docs: DataFrame, size: int = SIZE) -> np.ndarray:
    """The shingles that more than FREQUENT of all documents have, sorted.

    A shingle that frequent in all is that frequent in some part, so parts name candidates; the order of tokens they
    serve may be any, so counts of several parts need no second pass.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n_docs = n = 0

        def out() -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(held) if held else np.zeros(0, _U), return_counts=True)
            keep = times >= max(4, FREQUENT * n_docs)
            return pa.RecordBatch.from_arrays([pa.array(token[keep].view(np.int64)), pa.array(times[keep].astype(np.int64))], ["token", "times"])

        for part in slices(batches):
            for own in shingles(part.column("text").to_pylist(), size):
                held.append(own)
                n_docs += 1
                n += len(own)
            if n > COUNTED:
                yield out()
                held, n_docs, n = [], 0, 0
        yield out()

    least = max(FREQUENT_LEAST, FREQUENT * docs.count())
    found = as_documents(docs).mapInArrow(count, "token long, times long").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") > least).select("token").toArrow()
    return np.sort(found.column("token").to_numpy().view(_U)) if found.num_rows else np.zeros(0, _U)


#: `common` is the end of the prefix that holds frequent shingles.
SETS = "doc_id long, n long, high long, low long, counts binary, prefix array<long>, common array<long>, keys array<long>"


def describe(docs: DataFrame, frequent: np.ndarray, size: int = SIZE) -> DataFrame:
    """For each row: set size, 128-bit name of the set, point, prefix of tokens and keys."""
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = known.value
        for part in slices(batches):
            rows: dict[str, list] = {c: [] for c in ("n", "high", "low", "counts", "prefix", "common", "keys")}
            for own in shingles(part.column("text").to_pylist(), size):
                n = len(own)
                late = np.zeros(n, bool)
                if n and len(often):
                    late = often[np.minimum(np.searchsorted(often, own), len(often) - 1)] == own
                rare, late = own[~late], own[late]
                probe = n - -(-NUMERATOR * n // DENOMINATOR) + 1 if n else 0
                rows["n"].append(n)
                rows["high"].append(int(np.add.reduce(mix(own), dtype=_U).view(np.int64)) if n else 0)
                rows["low"].append(int(np.bitwise_xor.reduce(mix(own ^ _U(0x5BD1E995))).view(np.int64)) if n else 0)
                groups = FINE if n >= LARGE else GROUPS
                rows["counts"].append(np.bincount((own >> _U(17)) % _U(groups), minlength=groups).clip(max=255).astype(np.uint8).tobytes())
                rows["prefix"].append(rare[:probe].view(np.int64))
                rows["common"].append(late[: max(0, probe - len(rare))].view(np.int64))
                rows["keys"].append(np.array([mix(own ^ _U(k * 0x9E3779B97F4A7C15 & (2**64 - 1))).min() for k in range(KEYS)], _U).view(np.int64) if n else np.zeros(0, np.int64))
            lists = lambda c: pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) for x in rows[c]]))).astype(np.int32), np.concatenate(rows[c]))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array(rows["n"], pa.int64()), pa.array(rows["high"], pa.int64()), pa.array(rows["low"], pa.int64()),
                    pa.array(rows["counts"], pa.binary()), lists("prefix"), lists("common"), lists("keys"),
                ],
                ["doc_id", "n", "high", "low", "counts", "prefix", "common", "keys"],
            )

    return as_documents(docs).mapInArrow(run, SETS)


class Points:
    """The points of some sets: of GROUPS groups for all, of FINE groups for large ones. Fine groups fold into the others."""

    def __init__(self, blobs: list[bytes], n: np.ndarray):
        self.n = n
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
        fine = np.flatnonzero(sizes == FINE)
        self.coarse = np.zeros((len(blobs), GROUPS), np.uint16)
        own = np.flatnonzero(sizes == GROUPS)
        self.coarse[own] = np.frombuffer(b"".join(blobs[i] for i in own), np.uint8).reshape(-1, GROUPS)
        self.fine = np.frombuffer(b"".join(blobs[i] for i in fine), np.uint8).reshape(-1, FINE)
        self.coarse[fine] = self.fine.reshape(-1, FINE // GROUPS, GROUPS).sum(1)
        self.fine_at = np.full(len(blobs), -1)
        self.fine_at[fine] = np.arange(len(fine))
        #: Counts are cut at 255; such a point bounds nothing.
        self.cut = np.fromiter((255 in x for x in blobs), bool, len(blobs))

    def bound(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """By how much the bound on the overlap exceeds the threshold, for each token of the two sets."""
        n_i, n_j = self.n[i], self.n[j]
        bound = np.minimum(self.coarse[i], self.coarse[j]).sum(1, dtype=np.int64)
        fine = np.flatnonzero((self.fine_at[i] >= 0) & (self.fine_at[j] >= 0))
        bound[fine] = np.minimum(self.fine[self.fine_at[i[fine]]], self.fine[self.fine_at[j[fine]]]).sum(1, dtype=np.int64)
        return bound / (n_i + n_j)

    def allow(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the bound on the overlap of sets i and j reaches the threshold t = p / q: (p + q) * overlap >= p * (n_i + n_j)."""
        n_i, n_j = self.n[i], self.n[j]
        least = np.minimum(n_i, n_j)
        ok = NUMERATOR * np.maximum(n_i, n_j) <= DENOMINATOR * least
        free = self.cut[i] | self.cut[j]
        for points, at in ((self.coarse, None), (self.fine, self.fine_at)):
            k = np.flatnonzero(ok & ~free) if at is None else np.flatnonzero(ok & ~free & (at[i] >= 0) & (at[j] >= 0))
            for s in range(0, len(k), 8_192):
                c = k[s : s + 8_192]
                a, b = (i[c], j[c]) if at is None else (at[i[c]], at[j[c]])
                bound = np.minimum(points[a], points[b]).sum(1, dtype=np.int64)
                ok[c] = (NUMERATOR + DENOMINATOR) * np.minimum(bound, least[c]) >= NUMERATOR * (n_i[c] + n_j[c])
        return ok


def _bounded(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, n_a, counts_a, b, n_b, counts_b) those whose points allow the threshold, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if rows:
                n = np.concatenate([batch.column(c).to_numpy() for c in ("n_a", "n_b")])
                points = Points(batch.column("counts_a").to_pylist() + batch.column("counts_b").to_pylist(), n)
                yield batch.select(["a", "b"]).filter(pa.array(points.allow(np.arange(rows), np.arange(rows, 2 * rows))))

    return pairs.select("a", "b", "n_a", "n_b", "counts_a", "counts_b").mapInArrow(run, "a long, b long")


def star_pairs(sets: DataFrame) -> DataFrame:
    """Each class with the smallest class of each of its keys, as pairs with sizes and points."""
    keyed = sets.select("doc_id", F.posexplode("keys").alias("k", "key"))
    first = keyed.groupBy("k", "key").agg(F.min("doc_id").alias("a"))
    met = keyed.join(first, ["k", "key"]).where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("counts").alias(f"counts_{c}"))
    near = (NUMERATOR * F.greatest("n_a", "n_b")) <= (DENOMINATOR * F.least("n_a", "n_b"))
    return met.join(side("b"), "b").join(side("a"), "a").where(near)


def verify(pairs: DataFrame, docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Of pairs (a, b) of doc_ids those whose sets reach the threshold.

    A block has one a and about CHUNK of its b, so its text is sent once to each block. Texts that no pair needs are
    dropped before the shuffle by a table of hash buckets of doc_ids (at most BUCKETS rows, however many pairs).
    """
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("bs"))
    dealt = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("bs") / CHUNK)).alias("chunk"))
    need = dealt.select(F.col("b").alias("doc_id"), "a", "chunk", F.lit(1).alias("role")).unionByName(dealt.select(F.col("a").alias("doc_id"), "a", "chunk", F.lit(0).alias("role")).distinct())
    need = stored(need, "needed")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")
    wanted = F.broadcast(need.select(bucket.alias("_bucket")).distinct())
    texts = as_documents(docs).withColumn("_bucket", bucket).join(wanted, "_bucket", "left_semi").drop("_bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, heads = None, []
        for part in slices(batches):
            out = []
            own = shingles(part.column("text").to_pylist(), size)
            columns = [part.column(c).to_pylist() for c in ("a", "chunk", "role", "doc_id")]
            for a, chunk, role, b, tokens in zip(*columns, own, strict=True):
                if (a, chunk) != last:
                    last, heads = (a, chunk), []
                if role == 0:
                    heads.append(tokens)
                    continue
                for head in heads:
                    small, large = (head, tokens) if len(head) < len(tokens) else (tokens, head)
                    if not len(small):
                        continue
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[at] == small).sum())
                    if DENOMINATOR * both >= NUMERATOR * (len(small) + len(large) - both):
                        out.append((a, b))
                        break
            found = np.array(out, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    placed = need.join(texts, "doc_id").repartition("a", "chunk").sortWithinPartitions("a", "chunk", "role")
    return placed.mapInArrow(run, "a long, b long")


class Tree:
    """An R-tree over points in order of set size: leaves hold NODE points that follow each other, nodes NODE nodes.

    A node has the largest count of each group and the smallest size below it, so that the sum of minima of a point
    and a node bounds the overlap with every point below.
    """

    def __init__(self, points: Points, cluster: np.ndarray):
        self.points, self.cluster = points, cluster
        _, own, sizes = np.unique(cluster, return_inverse=True, return_counts=True)
        #: Points of the largest cluster don't ask; they are met by the others from either side.
        self.core = own == np.argmax(sizes)
        # a cut point bounds nothing, so in a box it counts as the largest possible
        self.levels = [(np.where(points.cut[:, None], np.uint16(65535), points.coarse), points.n, points.n, self.core)]
        while len(self.levels[-1][0]) > NODE:
            box, least, most, core = self.levels[-1]
            cuts = np.arange(0, len(box), NODE)
            self.levels.append((np.maximum.reduceat(box, cuts, axis=0), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts), np.logical_or.reduceat(core, cuts)))

    def reach(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j) of each asked point i and a point j that is before it or in the largest cluster, as far as the nodes' bounds allow."""
        n, base = self.points.n, self.levels[0][0]
        top = len(self.levels[-1][0])
        q, node = np.repeat(asked, top), np.tile(np.arange(top), len(asked))
        for depth in range(len(self.levels) - 1, 0, -1):
            box, least, most, core = self.levels[depth]
            keep = (core[node] | (node * NODE**depth < q)) & (DENOMINATOR * most[node] >= NUMERATOR * n[q]) & (NUMERATOR * least[node] <= DENOMINATOR * n[q])
            q, node = q[keep], node[keep]
            alive = np.zeros(len(q), bool)
            for s in range(0, len(q), AT_ONCE):
                a, b = q[s : s + AT_ONCE], node[s : s + AT_ONCE]
                bound = np.minimum(np.minimum(base[a], box[b]).sum(1, dtype=np.int64), n[a])
                alive[s : s + AT_ONCE] = (NUMERATOR + DENOMINATOR) * bound >= NUMERATOR * (n[a] + least[b])
            q, node = q[alive], node[alive]
            child = (node[:, None] * NODE + np.arange(NODE)).ravel()
            q = np.repeat(q, NODE)
            inside = child < len(self.levels[depth - 1][0])
            q, node = q[inside], child[inside]
        some = (self.core[node] | (node < q)) & (self.cluster[node] != self.cluster[q])
        return q[some], node[some]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each pair of points of different clusters that the bounds allow once, in parts; the first is outside the largest cluster."""
        asked = np.flatnonzero(~self.core)
        for first in range(0, len(asked), 128):
            i, j = self.reach(asked[first : first + 128])
            ok = self.points.allow(i, j)
            yield i[ok], j[ok]


def needed(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """How many tokens two prefixes must share at least.

    Of the overlap o that the threshold asks for, all but what lies behind the prefix that ends first is in both
    prefixes; behind a prefix of a set of n lie ceil(t n) - 1 tokens.
    """
    overlap = -(-NUMERATOR * (n_a + n_b) // (NUMERATOR + DENOMINATOR))
    return np.maximum(1, overlap + 1 - -(-NUMERATOR * np.maximum(n_a, n_b) // DENOMINATOR))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each value of the keys, from batches in their order."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            now = tuple(key[a].tolist())
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _of_several(keyed: DataFrame, keys: list[str], hot: bool) -> DataFrame:
    """The rows whose keys occur in more than one cluster, with `lead`, the smallest doc_id of the keys, and their number of rows.

    Keys that may hold a share of all rows (hot) are counted before the shuffle and joined back, which Spark can split.
    """
    least, most, lead, rows = F.min("cluster"), F.max("cluster"), F.min("doc_id"), F.count(F.lit(1))
    if hot:
        several = keyed.groupBy(*keys).agg(least.alias("_least"), most.alias("_most"), lead.alias("lead"), rows.alias("rows")).where("_least <> _most")
        return keyed.join(several.drop("_least", "_most"), keys)
    own = Window.partitionBy(*keys)
    told = keyed.withColumns({"_least": least.over(own), "_most": most.over(own), "lead": lead.over(own), "rows": rows.over(own)})
    return told.where("_least <> _most").drop("_least", "_most")


def _tiled(rows: DataFrame, tiles: Column) -> DataFrame:
    """Each row once for every pair of tiles (low, high) of its group that has the tile of its doc_id."""
    tiled = rows.withColumn("tile", F.pmod(F.xxhash64("doc_id"), tiles).cast("int"))
    tiled = tiled.withColumn("_other", F.explode(F.sequence(F.lit(0), (tiles - 1).cast("int"))))
    return tiled.withColumns({"low": F.least("tile", "_other"), "high": F.greatest("tile", "_other")}).drop("_other")


def closer_pairs(sets: DataFrame) -> DataFrame:
    """For keys whose classes are of several clusters: each class outside the largest of them with its NEAREST classes
    of other clusters by the bound, as pairs (a, b). A heavy key is cut into tiles of classes, each asked by itself."""
    keyed = sets.select(F.posexplode("keys").alias("k", "key"), "doc_id", "cluster")
    open_keys = _of_several(keyed, ["k", "key"], hot=True)
    tile = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("rows") / ASKED)).cast("int")
    task = ["k", "key", "tile"]
    placed = open_keys.withColumn("tile", tile).join(sets.select("doc_id", "n", "counts"), "doc_id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, task):
            ids, cluster, n = (table.column(c).to_numpy() for c in ("doc_id", "cluster", "n"))
            points = Points(table.column("counts").to_pylist(), n)
            tree = Tree(points, cluster)
            best: list[np.ndarray] = []
            for i, j in tree.pairs():
                back = ~tree.core[j]
                asks, given = np.concatenate((i, j[back])), np.concatenate((j, i[back]))
                slack = np.concatenate([points.bound(asks[s : s + AT_ONCE], given[s : s + AT_ONCE]) for s in range(0, len(asks), AT_ONCE)] or [np.zeros(0)])
                best.append(np.stack([asks, given, slack]))
                if sum(x.shape[1] for x in best) > AT_ONCE:
                    best = [_first_of(np.concatenate(best, axis=1))]
            found = _first_of(np.concatenate(best or [np.zeros((3, 0))], axis=1))[:2].astype(np.int64)
            a, b = ids[found[0]], ids[found[1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return placed.repartition(*task).sortWithinPartitions(*task, "n", "doc_id").select(*task, "doc_id", "cluster", "n", "counts").mapInArrow(search, "a long, b long").distinct()


def _first_of(found: np.ndarray) -> np.ndarray:
    """Of columns (asks, given, score) the NEAREST of each `asks` with the largest scores."""
    found = found[:, np.lexsort((found[1], -found[2], found[0]))]
    return found[:, np.arange(found.shape[1]) - np.searchsorted(found[0], found[0]) < NEAREST]


def missed_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes of different clusters whose prefixes share enough tokens and whose points allow the threshold."""
    columns = ["doc_id", "cluster", F.col("n").cast("int").alias("n")]
    rare = _of_several(sets.select(F.explode("prefix").alias("token"), *columns), ["token"], hot=False)
    common = _of_several(sets.select(F.explode("common").alias("token"), *columns), ["token"], hot=True)
    shared = stored(rare.unionByName(common), "shared-tokens")
    # All tokens with the same smallest class are one group, so what a pair shares there is known in one task.
    weights = shared.groupBy("lead").agg(F.count(F.lit(1)).alias("weight"), F.max("rows").alias("heaviest"))
    in_all = shared.groupBy("doc_id").agg(F.count(F.lit(1)).alias("in_all"))
    # Tiles enough for the heaviest token; beyond TILES of them the tokens of a group are dealt over salts.
    tiles = F.greatest(F.ceil(F.col("heaviest") / TILE), F.least(F.lit(TILES), F.ceil(F.col("weight") / TILE)))
    salts = F.ceil(F.col("weight") / (TILE * tiles))
    dealt = shared.join(weights, "lead").withColumn("salt", F.pmod(F.xxhash64("token"), salts).cast("int"))
    tiled = _tiled(dealt, tiles).drop("weight", "heaviest", "rows")
    task = ["lead", "salt", "low", "high"]
    facts = sets.select("doc_id", "counts").join(in_all, "doc_id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, task):
            table = table.combine_chunks()
            ids, first, place, here = np.unique(table.column("doc_id").to_numpy(), return_index=True, return_inverse=True, return_counts=True)
            n = table.column("n").to_numpy()[first].astype(np.int64)
            order = np.argsort(n, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            first, ids, n, here = first[order], ids[order], n[order], here[order]
            cluster, tile, in_all = (table.column(c).to_numpy()[first] for c in ("cluster", "tile", "in_all"))
            points = Points(table.column("counts").take(pa.array(first)).to_pylist(), n)
            held = _Held(rank[place], table.column("token").to_numpy(), len(ids))
            apart = table.column("low")[0].as_py() != table.column("high")[0].as_py()
            for i, j in Tree(points, cluster).pairs():
                if apart:
                    i, j = (x[tile[i] != tile[j]] for x in (i, j))
                shared, need = held.shared(i, j), needed(n[i], n[j])
                # What the pair can still share in other tasks is what either has there.
                ok = (shared > 0) & (shared + np.minimum(in_all[i] - here[i], in_all[j] - here[j]) >= need)
                i, j, shared, need = i[ok], j[ok], shared[ok], need[ok]
                a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, shared, need)], ["a", "b", "shared", "need"])

    placed = tiled.join(facts, "doc_id").repartition(*task).sortWithinPartitions(*task)
    found = placed.select(*task, "token", "tile", "doc_id", "cluster", "n", "counts", "in_all").mapInArrow(search, "a long, b long, shared long, need long")
    pairs = found.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("need").alias("need"))
    return pairs.where("shared >= need").select("a", "b")


class _Held:
    """Which tokens each of some sets holds, to count what pairs share."""

    def __init__(self, place: np.ndarray, token: np.ndarray, sets: int):
        _, number = np.unique(token, return_inverse=True)
        self.width = int(number.max()) + 1
        self.keys = np.sort(place * self.width + number)
        self.starts = np.searchsorted(self.keys, np.arange(sets + 1) * self.width)

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        sizes = np.diff(self.starts)
        i, j = np.where(sizes[i] <= sizes[j], i, j), np.where(sizes[i] <= sizes[j], j, i)
        ends = np.cumsum(sizes[i])
        out = np.zeros(len(i), np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // (64 * AT_ONCE))) + 1).tolist(), len(i)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own, per = i[a:b], sizes[i[a:b]]
            total = int(per.sum())
            if not total:
                continue
            at = np.repeat(self.starts[own] - (np.cumsum(per) - per), per) + np.arange(total)
            sought = self.keys[at] + np.repeat((j[a:b] - own) * self.width, per)
            spot = np.minimum(np.searchsorted(self.keys, sought), len(self.keys) - 1)
            hit = np.concatenate(([0], np.cumsum(self.keys[spot] == sought)))
            out[a:b] = np.diff(hit[np.concatenate(([0], np.cumsum(per)))])
        return out


def _placed(reps: DataFrame, links: DataFrame) -> DataFrame:
    """The classes with their cluster by these links."""
    clusters = stored(components(links), "clusters")
    return reps.join(clusters, F.col("id") == F.col("doc_id"), "left").withColumn("cluster", F.coalesce("component", "doc_id")).drop("id", "component")


def near_duplicates(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    described = stored(describe(docs, frequent_shingles(docs, size), size), "sets")
    name = ["n", "high", "low"]
    classes = described.where("n > 0").groupBy(*name).agg(F.min("doc_id").alias("rep"))
    own = described.select("doc_id", *name)
    reps = stored(described.where("n > 0").join(classes.select(*name, F.col("rep").alias("doc_id")), [*name, "doc_id"]).dropDuplicates([*name, "doc_id"]), "set-classes")
    stars = stored(_bounded(star_pairs(reps)).distinct(), "stars")
    links = stored(verify(stars, docs, size), "star-links")
    links = links.unionByName(stored(verify(stored(closer_pairs(_placed(reps, links)), "closer"), docs, size), "closer-links"))
    # Stored, as a task that verifies and contracts links in one would hold two Python workers.
    more = stored(verify(stored(missed_pairs(_placed(reps, links)), "missed"), docs, size), "missed-links")
    joined = components(links.unionByName(more))
    whole = classes.join(joined, F.col("id") == F.col("rep"), "left").select(*name, F.coalesce("component", "rep").alias("component_id"))
    alone = own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    found = own.where("n > 0").join(whole, name).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.unionByName(alone)


def one_of_each(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of docs, all columns, that have the smallest doc_id of their component.

    Rows without doc_id take no part and stay. Rows that repeat a doc_id with another text are documents of their own
    here: one goes only if its set equals or links (by way of others, as in a component) with one that stays. Rows that
    repeat both doc_id and text are one: that whose other columns have the smallest hash. Extra columns may have any
    name. An empty table stays empty; null and blank texts are no copies of each other.
    """
    others = [docs[f.name] for f in docs.schema.fields if f.name not in ("doc_id", "text") and f.dataType.typeName() not in ("map", "variant")]
    chosen = F.xxhash64(F.lit(0), *others)
    packed = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), F.struct(*(docs[c] for c in docs.columns)).alias("row"), chosen.alias("other"))
    named = packed.where("doc_id is not null").withColumn("own", F.struct(F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b")))
    repeats = stored(named.groupBy("doc_id").agg(F.min("own").alias("first"), F.max("own").alias("last")).where("first <> last").select("doc_id", "first"), "repeated-ids")
    # The first text of a doc_id keeps it as its key, others get a hash of 64 bits.
    again = F.coalesce(F.col("own") != F.col("first"), F.lit(False))
    keyed = named.join(repeats, "doc_id", "left").withColumn("key", F.when(again, F.xxhash64("doc_id", "own.a", "own.b")).otherwise(F.col("doc_id"))).drop("own", "first")
    found = near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text"), size).withColumnRenamed("doc_id", "key")
    ids = keyed.where("key <> doc_id").select("key", "doc_id").distinct()
    owned = found.join(ids, "key", "left").withColumn("doc_id", F.coalesce("doc_id", "key"))
    group = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    kept = owned.groupBy((F.col("n_shingles") > 0).alias("some"), group.alias("group")).agg(F.min_by("key", F.struct("doc_id", "key")).alias("key")).select("key")
    rows = keyed.select("key", "row", "other").join(kept.distinct(), "key", "left_semi").groupBy("key").agg(F.min_by("row", "other").alias("row"))
    return rows.select("row.*").unionByName(packed.where("doc_id is null").select("row.*"))
