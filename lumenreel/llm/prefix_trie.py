"""Operator 12: the trie of conversation prefixes, by composable monoid fingerprints.

A turn is an affine map x -> a x + b modulo 2**64 (a odd, a and b hashes of role and text), a run of turns the product of its
maps. Such maps form a group, so any run of a conversation is a quotient of two of its prefix products, and a
rebuilt prefix - the head of the base conversation and own turns behind it - has the fingerprint

    head product of the base * inverse of the own head's product * own prefix product,

of which the first two are one map a conversation. No rebuilt text is ever made: a rebuilt turn is a reference to a
stored turn, with its fingerprint.

Prefixes with equal depth and fingerprint are one group. Equality is then verified, not assumed. Stored turns that
share a hash are compared in their whole role and text; in each group the members' last turns must have the same
hash. As the fingerprint before the last turn follows from that turn and the fingerprint with it, equality of whole
sequences follows by induction over depth. If either check fails, all is done again with other hashes.

The trie is never walked level by level. The nodes of which c is the smallest member are a run of depths of c, its
path; a path hangs on a node of another one. What a path adds to a node above it is known from the owners of the
path's own prefixes, so subtree sums are sums by (owner, depth) and then running sums along each path. Order, prefix
products and running sums go over blocks of ordered rows, so a conversation may hold any share of all turns.

Defined results: rows without conv_id belong to no conversation; turns that share a number are ordered by role and
then text (UTF-8); rows that repeat stand behind each other; conversations whose rebuilt form has no turn end in the
root; an empty table has no nodes; only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import stored
from lumenreel.llm.ordered_scan import add, running, sums

#: Conversations are rebuilt from the one whose number is a multiple of GROUP; heads are shorter than HEAD.
GROUP, HEAD = 5, 9
#: Hashes of stored turns that occur more than once are broadcast up to so many, else joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Decimal numbers and commas of one chunk of a node's list of ends.
CHUNK_IDS = 4096
_TRIES = 4
_U = np.uint64


def inverse(a: np.ndarray) -> np.ndarray:
    """The inverse of odd numbers modulo 2**64; each step doubles the bits that are right, from three."""
    x = a.copy()
    with np.errstate(over="ignore"):
        for _ in range(5):
            x = x * (_U(2) - a * x)
    return x


def then(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The product of two maps (a, b), the first one applied first."""
    with np.errstate(over="ignore"):
        return first[0] * second[0], second[0] * first[1] + second[1]


def undo(m: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    back = inverse(m[0])
    with np.errstate(over="ignore"):
        return back, _U(0) - back * m[1]


def _unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.int64).view(_U)


def _products(columns: list[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
    """Running products of the maps of hashes (h1, h2), and the number of rows, from the first row of each group on."""
    a, b = _unsigned(columns[0]) | _U(1), _unsigned(columns[1])
    with np.errstate(over="ignore"):
        scale = np.multiply.accumulate(a)
        shift = scale * np.cumsum(b * inverse(scale), dtype=_U)
        # Whatever came before the group is divided out; the group's first turn belongs to it.
        scale_before, shift_before = np.append(_U(1), scale[:-1])[at], np.append(_U(0), shift[:-1])[at]
        out = then(undo((scale_before, shift_before)), (scale, shift))
    return [out[0].view(np.int64), out[1].view(np.int64), np.arange(len(a)) - at + 1]


def _go_on(state: list[np.ndarray], more: list[np.ndarray]) -> list[np.ndarray]:
    a, b = then((_unsigned(state[0]), _unsigned(state[1])), (_unsigned(more[0]), _unsigned(more[1])))
    return [a.view(np.int64), b.view(np.int64), state[2] + more[2]]


def _stored_turns(conversations: DataFrame, seed: int) -> DataFrame:
    """conv_id, turn, role, text (no nulls in role and text), the hashes h1 and h2 and the bytes of the text."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return turns.select(
        "*", F.xxhash64(F.lit(2 * seed), "role", "text").alias("h1"), F.xxhash64(F.lit(2 * seed + 1), "text", "role").alias("h2"),
        F.octet_length("text").cast("long").alias("bytes"),
    )


def _ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, h1, h2, bytes, and of each prefix of the stored conversation the product (a, b) and the length (pos)."""
    key = ("conv_id", F.col("turn").isNull().alias("no_turn"), F.coalesce("turn", F.lit(0)).alias("turn"))
    narrow = turns.select(*key, "h1", "h2", "bytes")
    tied = stored(narrow.groupBy("conv_id", "no_turn", "turn").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows"), "tied-turns")
    if tied.isEmpty():
        narrow = narrow.withColumns({"tied_role": F.lit(None).cast("string"), "tied_text": F.lit(None).cast("string")})
    else:  # texts are moved only where the order needs them
        marked = turns.select(*key, "h1", "h2", "bytes", "role", "text").join(tied.withColumn("tied", F.lit(True)), ["conv_id", "no_turn", "turn"], "left")
        narrow = marked.withColumns({"tied_role": F.when(F.col("tied"), F.col("role")), "tied_text": F.when(F.col("tied"), F.col("text"))}).drop("tied", "role", "text")
    order = [F.col("no_turn").desc(), F.col("turn"), F.col("tied_role"), F.col("tied_text")]
    placed = running(narrow, "conv_id", order, ["h1", "h2"], ["a", "b", "pos"], _products, _go_on, "ordered-turns")
    return placed.select("conv_id", "h1", "h2", "bytes", "a", "b", "pos")


def _head_length() -> Column:
    return (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")


def _rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, n_turns) and their rebuilt turns: conv_id, depth, a, b, h1, h2, bytes, is_end."""
    own = F.col("conv_id") % GROUP != 0
    n_head = F.when(own, _head_length()).otherwise(0)
    convs = placed.groupBy("conv_id").agg(F.max("pos").alias("n_own"), F.max(F.when(F.col("pos") == n_head, F.struct("a", "b"))).alias("skipped"))
    convs = convs.withColumn("head", n_head).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    heads = (
        placed.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEAD))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b", "h1", "h2", "bytes"))).alias("turns"))  # at most HEAD - 1 of them
    )
    taken = F.when(F.col("head") > 0, F.slice("turns", 1, F.greatest("head", F.lit(1)))).otherwise(F.slice("turns", 1, 0))
    convs = convs.join(heads, "base", "left").withColumn("turns", F.coalesce(taken, F.slice("turns", 1, 0)))
    convs = convs.select(
        "conv_id", "head", "skipped", "n_own", F.coalesce("turns", F.array().cast(heads.schema["turns"].dataType)).alias("turns")
    ).withColumn("n_taken", F.size("turns"))
    convs = stored(convs.withColumn("n_turns", F.col("n_taken") + F.greatest(F.col("n_own") - F.col("head"), F.lit(0))), "conversations")
    last_taken = F.try_element_at("turns", F.greatest("n_taken", F.lit(1)))
    ahead = convs.select(
        "conv_id", "head", "n_taken", "n_turns",
        *(F.when(F.col("n_taken") > 0, last_taken[c]).otherwise(F.lit(x)).alias(f"head_{c}") for c, x in (("a", 1), ("b", 0))),
        *(F.when(F.col("head") > 0, F.col("skipped")[c]).otherwise(F.lit(x)).alias(f"skipped_{c}") for c, x in (("a", 1), ("b", 0))),
    )
    rest = placed.join(ahead, "conv_id").where(F.col("pos") > F.col("head"))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, skipped, own = ([_unsigned(batch.column(p + c).to_numpy()) for c in "ab"] for p in ("head_", "skipped_", ""))
            a, b = then(then(tuple(head), undo(tuple(skipped))), tuple(own))
            depth = batch.column("pos").to_numpy() - batch.column("head").to_numpy() + batch.column("n_taken").to_numpy()
            kept = {c: batch.column(c) for c in ("conv_id", "h1", "h2", "bytes")}
            yield pa.RecordBatch.from_pydict(
                {"conv_id": kept["conv_id"], "depth": pa.array(depth), "a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64)), "h1": kept["h1"],
                 "h2": kept["h2"], "bytes": kept["bytes"], "is_end": pa.array(depth == batch.column("n_turns").to_numpy())}
            )

    kinds = "conv_id long, depth long, a long, b long, h1 long, h2 long, bytes long, is_end boolean"
    tails = rest.mapInArrow(compose, kinds)
    taken = convs.select("conv_id", "n_turns", F.explode("turns").alias("t")).select(
        "conv_id", F.col("t.pos").alias("depth"), "t.a", "t.b", "t.h1", "t.h2", "t.bytes", (F.col("t.pos") == F.col("n_turns")).alias("is_end")
    )
    return convs.select("conv_id", "n_turns"), stored(taken.unionByName(tails), "rebuilt-turns")


def _like_hashes_unlike_turns(turns: DataFrame) -> bool:
    """Whether stored turns share both hashes but not role and text."""
    shared = stored(turns.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows"), "shared-turns")
    rows = shared.count()
    if not rows:
        return False
    asked = F.broadcast(shared) if rows <= BROADCAST_ROWS else shared
    same = turns.select("h1", "h2", "role", "text").join(asked, ["h1", "h2"], "left_semi")
    ends = same.groupBy("h1", "h2").agg(F.min("role").alias("r0"), F.max("role").alias("r1"), F.min("text").alias("t0"), F.max("text").alias("t1"))
    return not ends.where("r0 <> r1 or t0 <> t1").isEmpty()


def _ends_digests(ends: DataFrame) -> DataFrame:
    """owner, depth and SHA-256 of the ascending decimal conv_ids, comma-joined, of ends (owner, depth, conv_id).

    Numbers are joined to chunks in many tasks; a task then hashes the chunks of a node in order, one at a time.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, depth, conv = (batch.column(c).to_numpy() for c in ("owner", "depth", "conv_id"))
            if not len(conv):
                continue
            cut = np.append(True, (owner[1:] != owner[:-1]) | (depth[1:] != depth[:-1]))
            cut[::CHUNK_IDS] = True
            at = np.flatnonzero(cut)
            text = [",".join(map(str, x.tolist())) for x in np.split(conv, at[1:])]
            yield pa.RecordBatch.from_pydict({"owner": owner[at], "depth": depth[at], "first_id": conv[at], "ids": text})

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[int, int] | None = None
        state = hashlib.sha256()
        for batch in batches:
            done = []
            for owner, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "ids")), strict=True):
                if (owner, depth) == now:
                    state.update(b",")
                else:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (owner, depth), hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_pydict(dict(zip(("owner", "depth", "sha"), _columns(done), strict=True)))
        if now is not None:
            yield pa.RecordBatch.from_pydict(dict(zip(("owner", "depth", "sha"), _columns([(*now, state.hexdigest())]), strict=True)))

    def _columns(rows: list[tuple]) -> list[pa.Array]:
        return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]

    keys = ["owner", "depth", "conv_id"]
    dealt = ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    pieces = dealt.mapInArrow(chunks, "owner long, depth long, first_id long, ids string")
    ordered = pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first_id")
    return ordered.mapInArrow(digests, "owner long, depth long, sha string")


def _attempt(conversations: DataFrame, seed: int) -> DataFrame | None:
    turns = _stored_turns(conversations, seed)
    convs, rebuilt = _rebuilt(_ordered_turns(turns))
    whole = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first")).first()
    if not whole["n"]:
        spark = conversations.sparkSession
        return spark.createDataFrame([], RESULT)
    key = ["depth", "a", "b"]
    groups = stored(
        rebuilt.groupBy(*key)
        .agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), *(f(c).alias(f"{c}_{n}") for c in ("h1", "h2") for n, f in (("least", F.min), ("most", F.max))))
        .where("n_convs > 1"),
        "prefix-groups",
    )  # a prefix of one conversation is its own node
    if not groups.where("h1_least <> h1_most or h2_least <> h2_most").isEmpty() or _like_hashes_unlike_turns(turns):
        return None

    # Every rebuilt prefix with the smallest conversation that has it; the root belongs to the smallest of all.
    found = rebuilt.join(groups.select(*key, "owner", "n_convs"), key, "left")
    found = found.select("conv_id", "depth", "bytes", "is_end", F.coalesce("owner", "conv_id").alias("owner"), F.coalesce("n_convs", F.lit(1)).alias("n_convs"))
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"), (F.col("n_turns") == 0).alias("is_end"),
                        F.lit(whole["first"]).alias("owner"), F.lit(whole["n"]).alias("n_convs"))
    found = stored(found.unionByName(root), "owned-prefixes")
    nodes = found.where("owner = conv_id").withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes"))

    # Paths: the run of depths a conversation owns, and the node they hang on.
    paths = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("depth").alias("last"), F.sum("saved").alias("saved"))
    above = found.where("owner <> conv_id").groupBy("conv_id", "owner").agg(F.max("depth").alias("at"))
    nearest = above.groupBy("conv_id").agg(F.max_by("owner", "at").alias("parent"))
    paths = stored(paths.join(nearest, "conv_id", "left"), "paths")
    hung = paths.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_hung"))
    hung = stored(hung, "hung-paths")
    bare = paths.join(hung.select("conv_id", F.col("depth").alias("last"), "n_hung"), ["conv_id", "last"], "left")
    bare = bare.select("conv_id", "last", "saved", F.when(F.col("n_hung").isNull(), 1).otherwise(0).cast("long").alias("leaf"))
    adds = above.join(bare, "conv_id").groupBy(F.col("owner").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("saved").alias("more_saved"), F.sum("leaf").alias("more_leaves"))

    # All that is known of a node, in one row; then sums from the end of each path up.
    none = F.lit(None).cast("long")
    names = ("n_convs", "saved", "more_saved", "leaf", "more_leaves", "n_hung", "is_last", "parent")

    def known(df: DataFrame, **columns: Column | str) -> DataFrame:
        values = [(F.col(c) if isinstance(c, str) else c).cast("long").alias(n) for n in names for c in [columns.get(n, none)]]
        return df.select("conv_id", "depth", *values, columns.get("sha", F.lit(None).cast("string")).alias("sha"))

    told = known(nodes, n_convs="n_convs", saved="saved")
    told = told.unionByName(known(bare.withColumnRenamed("last", "depth"), leaf="leaf", is_last=F.lit(1)))
    told = told.unionByName(known(paths.withColumnRenamed("top", "depth").where("parent is not null"), parent="parent"))
    told = told.unionByName(known(hung, n_hung="n_hung")).unionByName(known(adds, more_saved="more_saved", more_leaves="more_leaves"))
    digests = _ends_digests(found.where("is_end"))
    told = told.unionByName(known(digests.withColumnRenamed("owner", "conv_id"), sha=F.col("sha")))
    zero = F.lit(0).cast("long")
    one = told.groupBy("conv_id", "depth").agg(*(F.max(c).alias(c) for c in (*names, "sha")))
    one = one.select(
        "conv_id", "depth", "n_convs", "parent", "sha", (F.coalesce("n_hung", zero) + 1 - F.coalesce("is_last", zero)).alias("n_children"),
        (F.coalesce("leaf", zero) + F.coalesce("more_leaves", zero)).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", zero)).alias("saves"),
    )
    summed = running(one, "conv_id", [F.col("depth").desc()], ["leaves", "saves"], ["n_leaves", "saved_tokens"], sums, add, "trie-nodes")
    return summed.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations; the columns of RESULT."""
    for seed in range(_TRIES):
        out = _attempt(conversations, seed)
        if out is not None:
            return out
    raise RuntimeError(f"turns or prefixes shared a hash without being equal, with each of {_TRIES} pairs of hashes")
