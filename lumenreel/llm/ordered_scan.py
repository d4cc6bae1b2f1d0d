"""Running combinations over ordered rows of a group, however large the group is.

Rows are dealt to blocks by ranges of (group, order), so a group that holds a third of all rows lies in many blocks.
Each block combines its own rows in order; what the last group of a block has come to is carried into the next one,
one row a block, and the blocks' rows are then completed from the left. Nothing is ever gathered by group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenreel.llm.common import stored

#: Inclusive scan of columns within groups: (columns, number of the first row of each row's group) -> scanned columns.
Scan = Callable[[list[np.ndarray], np.ndarray], list[np.ndarray]]
#: What is reached by going on from one state (of one row) with others: (state, states) -> states.
Join = Callable[[list[np.ndarray], list[np.ndarray]], list[np.ndarray]]


def group_starts(first: np.ndarray) -> np.ndarray:
    """For each row the number of the first row of its group, from marks at first rows."""
    return np.maximum.accumulate(np.where(first, np.arange(len(first)), 0)) if len(first) else np.zeros(0, np.int64)


def sums(columns: list[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
    out = []
    for x in columns:
        total = np.cumsum(x)
        out.append(total - total[at] + x[at])
    return out


def add(state: list[np.ndarray], more: list[np.ndarray]) -> list[np.ndarray]:
    return [a + b for a, b in zip(state, more, strict=True)]


def running(df: DataFrame, group: str, order: list[str | Column], values: list[str], out: list[str], scan: Scan, join: Join, name: str) -> DataFrame:
    """df with the columns `out` (long): `values` (long) combined over the rows of `group` (long, not null) up to each row.

    Rows that are equal in all of `order` have any order among themselves. Columns of df named _block or _row would
    be lost. The driver sees one row a block: the first and the last group of it and what the last one has come to.
    """
    kinds, names = ", ".join(f"`{c}` {t}" for c, t in df.dtypes), df.columns
    added = ", ".join(f"`{c}` long" for c in out)
    keys = [F.col(group), *order]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, row = TaskContext.get().partitionId(), 0
        last: int | None = None
        state: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(group).to_numpy(zero_copy_only=False)
            first = np.append(True, own[1:] != own[:-1])
            scanned = scan([batch.column(c).to_numpy(zero_copy_only=False) for c in values], group_starts(first))
            if last == own[0]:
                same = int(np.argmax(np.append(first[1:], True))) + 1
                for x, y in zip(scanned, join(state, [x[:same] for x in scanned]), strict=True):
                    x[:same] = y
            last, state = own[-1], [x[-1:].copy() for x in scanned]
            numbers = [pa.array(np.full(batch.num_rows, block, np.int32)), pa.array(np.arange(row, row + batch.num_rows, dtype=np.int64))]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, scanned), *numbers], [*batch.schema.names, *out, "_block", "_row"])

    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    blocks = stored(dealt.mapInArrow(local, f"{kinds}, {added}, _block int, _row long"), name)
    ends = blocks.groupBy("_block").agg(F.min(group).alias("low"), F.max(group).alias("high"), F.max_by(F.struct(*out), "_row").alias("end"))
    carried: dict[int, tuple[int, list[int]]] = {}
    last, state = None, []
    for r in sorted(ends.collect(), key=lambda r: r["_block"]):
        end = list(r["end"])
        if last is not None and last == r["low"]:
            carried[r["_block"]] = (last, state)
            if r["low"] == r["high"]:
                end = [int(x[0]) for x in join([np.array([x], np.int64) for x in state], [np.array([x], np.int64) for x in end])]
        last, state = r["high"], end

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, own = batch.column("_block").to_numpy(), batch.column(group).to_numpy(zero_copy_only=False)
            scanned = [batch.column(c).to_numpy().copy() for c in out]
            for block in np.unique(numbers).tolist():
                if block in carried:
                    which, before = carried[block]
                    rows = np.flatnonzero((numbers == block) & (own == which))
                    for x, y in zip(scanned, join([np.array([x], np.int64) for x in before], [x[rows] for x in scanned]), strict=True):
                        x[rows] = y
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, scanned)], [*names, *out])

    if not carried:
        return blocks.select(*df.columns, *out)
    return blocks.mapInArrow(complete, f"{kinds}, {added}")
