"""Helpers that several operators share: reading, shared scratch tables and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text of one slice that a Python task holds as Python strings at a time.
SLICE_CHARS = 500_000
_U = np.uint64


#: Bytes of an Arrow batch, or one row if that is larger: bounds what Python workers hold, however long texts are.
BATCH_BYTES = str(4 << 20)

#: Python workers are used again and again: large arrays go back to the system when they are freed.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(1 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Only in local mode, where it may be unset, a temporary one."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        if checkpoint.isDefined():
            return checkpoint.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each has about SLICE_CHARS bytes of text; one long text may exceed it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + SLICE_CHARS, side="right")))
            yield batch.slice(start, end - start)
            start = end


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of a 64-bit hash: a bijection that spreads all bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: A-Z become a-z; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: What the k-th block of eight bytes is offset by before it is mixed.
_BLOCK_STEP = _U(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(1, 8)] + [2**64 - 1], _U)
#: Bytes that must lie behind the last run given to byte_blocks.
BLOCK_PAD = 8


def byte_blocks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of bytes data[start:end] as 64-bit blocks, the last one of each filled up with zeros.

    Gives the blocks, the number of the first block of each run (none is empty), and each block's number in its run.
    """
    lengths = ends - starts
    counts = (lengths + 7) >> 3
    first = np.cumsum(counts) - counts
    place = np.arange(int(counts.sum())) - np.repeat(first, counts)
    at = np.repeat(starts, counts) + 8 * place
    left = np.minimum(np.repeat(ends, counts) - at, 8)
    every = np.ndarray((max(len(data) - 7, 0),), "<u8", buffer=data, strides=(1,))  # the eight bytes from each place
    return every[at] & _MASKS[left - 1], first, place


def run_hashes(blocks: np.ndarray, first: np.ndarray, place: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes: every block is mixed with its place before blocks are added up."""
    if not len(first):
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        mixed = mix(mix(blocks + _BLOCK_STEP * (place.astype(_U) + _U(1))) + blocks)
        return mix(np.add.reduceat(mixed, first, dtype=_U) + lengths.astype(_U))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """The words of many texts: 64-bit hash of each, and where each text's words start.

    A word is a longest run of characters other than blank and U+0009-U+000D, with A-Z in lower case.
    """

    def __init__(self, texts: list[str | None], table: bytes = LOWER, drop: bytes = b""):
        """table maps bytes (not white space) and drop lists bytes to leave out, before words are cut."""
        raw = [(t or "").encode() for t in texts]
        if drop:
            raw = [r.translate(table, drop) for r in raw]
        data = np.frombuffer((b" ".join(raw) if drop else b" ".join(raw).translate(table)) + b" " * (1 + BLOCK_PAD), np.uint8)
        self.data = data
        space = _IS_SPACE[data]
        self.starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        self.ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
        ends_of_text = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, int)
        #: Text i has the words first[i] to first[i + 1].
        self.first = np.concatenate(([0], np.searchsorted(self.starts, ends_of_text))).astype(np.int64)
        self.hashes = run_hashes(*byte_blocks(data, self.starts, self.ends), self.ends - self.starts)


_STEP = [pow(0xD1342543DE82EF95, k, 1 << 64) for k in range(64)]


def shingles(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its runs of `size` words.

    A text of fewer words has one, of all its words; a text without words has none.
    """
    words = Words(texts)
    h, first = words.hashes, words.first
    out: list[np.ndarray] = []
    if len(h) >= size:
        rolled = np.zeros(len(h) - size + 1, _U)
        for k in range(size):
            rolled += h[k : len(h) - size + 1 + k] * _U(_STEP[k + 1])
        rolled = mix(rolled + _U(size))
    else:
        rolled = np.zeros(0, _U)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            own = np.sort(rolled[a : b - size + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            short = sum((int(x) * _STEP[k + 1] for k, x in enumerate(h[a:b])), int(b - a))
            out.append(mix(np.array([short & (2**64 - 1)], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def as_documents(df: DataFrame) -> DataFrame:
    """Only the two columns that text operators read; extra columns, whatever their names, are not touched."""
    return df.select(F.col("doc_id"), F.col("text"))


def bounded_sample(df: DataFrame, most: int) -> DataFrame:
    """About `most` rows chosen by the hash of doc_id (all of them if there are fewer), for fitting a model."""
    rows = df.count()
    if rows > most:
        df = df.where(F.pmod(F.xxhash64("doc_id"), F.lit(rows)) < most)
    return df.limit(2 * most)


def span_string(spans: list[tuple]) -> str:
    """kind:start:end of each span, joined by commas, in the order given."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def training_labels(docs: DataFrame, labels: DataFrame, column: str, most: int) -> DataFrame:
    """doc_id, text and label (0 or 1) of about `most` labelled documents that aren't held out.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out. A doc_id with several labels has the largest one, and one with
    several texts the smallest, so repeated rows don't pass the bound.
    """
    usable = labels.where(F.col(column).isin(0, 1) & ~held_out("doc_id")).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    chosen = bounded_sample(usable, most)
    labelled = as_documents(docs).join(F.broadcast(chosen), "doc_id")  # at most 2 * most rows are broadcast
    return labelled.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def held_out(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0
