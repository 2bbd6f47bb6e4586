"""Changes to tables as DataFrames: a change makes a new table from the old one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    """table with rows; columns that rows lack are null, types are the table's."""
    unknown = [c for c in rows.columns if c not in table.columns]
    if unknown:
        raise QueryError(f"no property {', '.join(unknown)}")
    cast = [(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema]
    return table.unionByName(rows.select(*cast))


def numbered(table: DataFrame) -> DataFrame:
    """table with _copy: 1 to n for n equal rows. Equal rows are counted before they are shuffled, and no row differs from
    its equals, so the numbers name the same rows however often and on however many tasks they are given."""
    names = [F.col(f"`{c}`") for c in table.columns]
    return table.groupBy(*names).agg(F.count("*").alias("_copies")).select(*names, F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy"))


def _split(table: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of table that equal a row of keys, numbered, and the others. keys: the columns of table, and _copy."""
    named = keys.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(table.columns)]).distinct()
    met = F.lit(True)
    for i, c in enumerate(table.columns):
        met &= F.col(f"`{c}`").eqNullSafe(F.col(f"_k{i}"))
    return numbered(table.join(named, met, "left_semi")), table.join(named, met, "left_anti")


def remove_rels(table: DataFrame, gone: DataFrame) -> DataFrame:
    """table without the rows that gone names by all columns and _copy; equal rows of other numbers stay."""
    hit, rest = _split(table, gone)
    return rest.unionByName(remove(hit, gone, [(c, c) for c in hit.columns]).drop("_copy"))


def update_rels(table: DataFrame, changes: DataFrame) -> DataFrame:
    """update of the rows that changes names by all columns and _copy."""
    hit, rest = _split(table, changes)
    return rest.unionByName(update(hit, changes, hit.columns).drop("_copy"))


def insert_nodes(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """append, for keys that are not null, not in the table and not twice in rows."""
    if not rows.where(F.col(key).isNull()).isEmpty():
        raise QueryError(f"the key {key} is null")
    keys = rows.groupBy(F.col(key).cast(table.schema[key].dataType).alias(key)).count()
    if not keys.where("count > 1").isEmpty() or not keys.join(table.select(key), key, "left_semi").isEmpty():
        raise QueryError(f"a node with this {key} exists")
    return append(table, rows)


def upsert(table: DataFrame, rows: DataFrame, key: str, on_create: dict | None = None, on_match: dict | None = None) -> DataFrame:
    """Merge rows by key: those that match get on_match, others are made of the row and on_create.

    on_create and on_match give a column of rows for each property to set; a property that only rows has is set in
    either case where it is not null. Rows of one key count once: the largest.
    """
    on_create, on_match = on_create or {}, on_match or {}
    plain = [c for c in rows.columns if c in table.columns and c != key]
    kind = {f.name: f.dataType for f in table.schema}
    one = rows.groupBy(F.col(key).cast(kind[key]).alias("_key")).agg(F.max(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("_new"))
    both = table.withColumn("_old", F.lit(True)).join(one.where("_key IS NOT NULL"), F.col(key) == F.col("_key"), "full_outer")
    out = []
    for c in table.columns:
        old, new = F.col(f"`{c}`"), F.col(f"_new.`{c}`") if c in plain else F.lit(None)
        made = F.col(f"_new.`{on_create[c]}`") if c in on_create else new
        met = F.col(f"_new.`{on_match[c]}`") if c in on_match else F.coalesce(new, old)
        value = F.col("_key") if c == key else made
        out.append(F.when(F.col("_old").isNull(), value.cast(kind[c])).when(F.col("_key").isNotNull() & F.lit(c != key), met.cast(kind[c])).otherwise(old).alias(c))
    return both.select(*out)


def update(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Set properties: changes has the keys and columns _set_<property>. Of several changes of a row the largest holds."""
    sets = [c for c in changes.columns if c.startswith("_set_")]
    one = changes.groupBy(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max(F.struct(*[F.col(f"`{c}`") for c in sets])).alias("_new"))
    met = F.lit(True)
    for i, k in enumerate(keys):
        met &= F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
    both = table.join(one, met, "left")
    kind = {f.name: f.dataType for f in table.schema}
    return both.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.`_set_{c}`").cast(kind[c])).otherwise(F.col(f"`{c}`")).alias(c) if f"_set_{c}" in sets else F.col(f"`{c}`") for c in table.columns])


def remove(table: DataFrame, keys: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """table without rows whose columns equal those of keys; on: pairs (column of table, column of keys)."""
    named = keys.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, (_, k) in enumerate(on)]).distinct()
    met = F.lit(True)
    for i, (c, _) in enumerate(on):
        met &= F.col(f"`{c}`").eqNullSafe(F.col(f"_k{i}"))
    return table.join(named, met, "left_anti")
