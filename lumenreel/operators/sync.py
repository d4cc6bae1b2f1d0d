"""Copying related tables into a target: in the order of their foreign keys, with keys renumbered on the way."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as true in a text (fixed values).
TRUE = ("1", "true", "t", "yes", "y", "on")
#: Rows of a part, about, where a table's rows are dealt by a key.
PART_ROWS = 250_000


@dataclass(frozen=True)
class Table:
    """How a table is copied.

    key: its primary key. parents: foreign key columns and the tables whose keys they hold. natural: sets of columns,
    tried in order, by which the target knows a row whose key it has numbered itself. json: columns with JSON texts and
    what stands for a blank or broken one. prefix: the column by whose first letters rows are chosen. order: of
    several source rows of a key, the one of the largest value counts.
    """

    key: str
    parents: Mapping[str, str] = field(default_factory=dict)
    natural: tuple[tuple[str, ...], ...] = ()
    json: Mapping[str, str] = field(default_factory=dict)
    booleans: tuple[str, ...] = ()
    times: tuple[str, ...] = ()
    prefix: str | None = None
    order: str | None = None


def table_order(tables: Mapping[str, Table]) -> list[str]:
    """Parents before children, else in the order given; parents outside `tables` don't matter."""
    out: list[str] = []
    left = list(tables)
    while left:
        free = [t for t in left if not any(p in left for p in tables[t].parents.values())]
        if not free:
            raise ValueError(f"the foreign keys of {', '.join(left)} run in a circle")
        out += free
        left = [t for t in left if t not in free]
    return out


def as_json(text: Column, default: str) -> Column:
    """The JSON text in normal form; blank and broken ones are the default."""
    return F.coalesce(F.to_json(F.try_parse_json(F.nullif(F.trim(text.cast("string")), F.lit("")))), F.lit(default))


def as_boolean(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE), F.lit(False))


def normalized(rows: DataFrame, table: Table) -> DataFrame:
    """JSON, booleans and times of a table in one form; a time that is none is null."""
    changes = {c: as_json(F.col(c), d) for c, d in table.json.items()}
    changes |= {c: as_boolean(F.col(c)) for c in table.booleans}
    changes |= {c: F.trim(F.col(c).cast("string")).try_cast("timestamp") for c in table.times}
    return rows.withColumns({c: x for c, x in changes.items() if c in rows.columns}) if changes else rows


def last_of_key(rows: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row of each key: that of the largest `order`, ties by the largest row. Each task finds its own best first."""
    rest = [c for c in rows.columns if c != key]
    if not rest:
        return rows.distinct()
    by = F.struct(*([F.col(order)] if order else []), *rest)
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), by).alias("_last")).select(key, *(F.col("_last")[c].alias(c) for c in rest))


def key_map(source: DataFrame, target: DataFrame, table: Table) -> DataFrame:
    """old and new key of each source row: the target's own by the first natural key that is found there, else the source's;
    one that the target has given to another row is moved behind all keys of both (whole numbers) or is null."""
    key, found = table.key, source
    for n, names in enumerate(table.natural):
        known = target.where(F.col(names[0]).isNotNull()).groupBy(*names).agg(F.min(key).alias(f"_found{n}"))
        found = found.join(known, list(names), "left")
    found = found.select(F.col(key).alias("old"), F.coalesce(*(F.col(f"_found{n}") for n in range(len(table.natural)))).alias("match"))
    taken = target.select(F.col(key).alias("old"), F.lit(True).alias("taken"))
    if dict(source.dtypes)[key] in ("tinyint", "smallint", "int", "bigint"):
        ends = source.select(key).unionByName(target.select(key)).agg(F.min(key), F.max(key)).first()
        moved = F.col("old") + F.lit((ends[1] or 0) - (ends[0] or 0) + 1)
    else:
        moved = F.lit(None).cast(dict(source.dtypes)[key])
    return found.join(taken, "old", "left").select("old", F.coalesce("match", F.when(F.col("taken"), moved).otherwise(F.col("old"))).alias("new"))


def _dealt(rows: DataFrame, parts: int, column: str) -> DataFrame:
    """Rows dealt by a column over so many parts, or as they are where the session's number of parts is enough."""
    return rows.repartition(parts, column) if parts > _usual(rows) else rows


def _usual(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


@dataclass
class Synced:
    """tables: each with `state` (kept, updated, inserted). rejected: table_name, row_key and reason. counts: one row a table."""

    tables: dict[str, DataFrame]
    rejected: DataFrame
    counts: DataFrame


def sync_tables(source: Mapping[str, DataFrame], target: Mapping[str, DataFrame], tables: Mapping[str, Table], prefixes: tuple[str, ...] = (), insert_only: bool = False) -> Synced:
    """The target's tables after the source's rows have been put in, parents first.

    Columns that the target lacks are dropped. Foreign keys follow their parents' new keys; rows without key, rows whose
    parent is neither copied nor in the target, and rows without a free key are rejected, and so are their children.
    Running it again on what it gives changes nothing but states. A table's rows are counted first and dealt over as many
    parts as their number asks for, so that tasks don't grow with the table.
    """
    parts: dict[str, int] = {}
    out: dict[str, DataFrame] = {}
    maps: dict[str, DataFrame] = {}
    rejects, counts = [], []
    for name in table_order(tables):
        table, have = tables[name], target[name]
        key, columns = table.key, have.columns
        rows = source[name]
        if prefixes and table.prefix:
            rows = rows.where(F.upper(F.substring(table.prefix, 1, len(prefixes[0]))).isin(*prefixes))
        counted = [("source_rows", rows)]
        parts[name] = -(-(rows.count() + have.count()) // PART_ROWS)
        rows = normalized(rows.select(*columns, *([table.order] if table.order and table.order not in columns else [])), table)
        rows = last_of_key(_dealt(rows, parts[name], key), key, table.order)
        reason = F.when(F.col(key).isNull(), "no_key")
        for column, parent in table.parents.items():
            if parent not in out:
                continue
            known = maps.get(parent)
            if known is None:
                known = out[parent].select(F.col(tables[parent].key).alias("old"), F.col(tables[parent].key).alias("new"))
            known = known.select(F.col("old").alias(column), F.col("new").alias(f"_{column}"))
            # A small parent is sent to all tasks or has few keys, so its children stay where they are.
            rows = (_dealt(rows, parts[name], column) if parts[parent] > _usual(rows) else rows).join(known, column, "left")
            reason = F.coalesce(reason, F.when(F.col(column).isNotNull() & F.col(f"_{column}").isNull(), F.concat(F.lit("no_parent:"), F.lit(column))))
        remapped = [c for c, p in table.parents.items() if p in out]
        rows = rows.withColumn("_reason", reason)
        if table.natural:
            numbers = key_map(rows.where("_reason is null"), have, table)
            rows = rows.join(numbers.withColumnRenamed("old", key), key, "left").withColumn("_reason", F.coalesce("_reason", F.when(F.col("new").isNull(), "key_taken")))
            maps[name] = rows.where("_reason is null").select(F.col(key).alias("old"), "new")
            rows = rows.withColumn("_key", F.col("new"))
        else:
            rows = rows.withColumn("_key", F.col(key))
        rejected = rows.where("_reason is not null").select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.col("_reason").alias("reason"))
        good = rows.where("_reason is null").select(F.col("_key").alias(key), *(F.col(f"_{c}" if c in remapped else c).alias(c) for c in columns if c != key))
        kept = F.col("t._there").isNotNull() & (F.lit(insert_only) | F.col("u._given").isNull())
        both = _dealt(have, parts[name], key).withColumn("_there", F.lit(1)).alias("t").join(last_of_key(_dealt(good, parts[name], key), key, None).withColumn("_given", F.lit(1)).alias("u"), key, "full")
        state = F.when(F.col("t._there").isNull(), "inserted").when(kept, "kept").otherwise("updated")
        out[name] = both.select(key, *(F.when(kept, F.col(f"t.{c}")).otherwise(F.col(f"u.{c}")).alias(c) for c in columns if c != key), state.alias("state"))
        rejects.append(rejected)
        counted.append(("rejected", rejected))
        whats = [d.select(F.lit(name).alias("table_name"), F.lit(what).alias("what")) for what, d in counted]
        counts += [*whats, out[name].select(F.lit(name).alias("table_name"), F.col("state").alias("what"))]
    tally = reduce(DataFrame.unionByName, counts).groupBy("table_name")
    whats = ("source_rows", "rejected", "inserted", "updated", "kept")
    return Synced(out, reduce(DataFrame.unionByName, rejects), tally.agg(*(F.count(F.when(F.col("what") == w, 1)).alias(w) for w in whats)))
