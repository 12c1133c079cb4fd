"""Snapshots, first rows, caps, upserts and ledgers."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_snapshot(rows: DataFrame, owner: list[str], date: str = "index_date") -> DataFrame:
    """All rows of each owner's latest date: the dates are aggregated and joined back, so no owner is sorted in one task."""
    last = rows.groupBy(*owner).agg(F.max(date).alias(date))
    return rows.join(last, [*owner, date], "left_semi")


def first_per(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in an explicit order, as an aggregate of one struct that combines on the map side."""
    names = [c for c in rows.columns if c not in keys]
    order = list(order)
    chosen = rows.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_row"))
    return chosen.select(*keys, *(F.col("_row")[c].alias(c) for c in names))


def newest(rows: DataFrame, keys: list[str], cap, *order) -> DataFrame:
    """The first rows of each key in an order, `cap` at most: a number, or a column that is the same for all rows of a key (null: all rows).

    The largest cap of a column is asked for first, so that a map task keeps no more rows of a key than that; keys without a cap aren't ordered at all.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if isinstance(cap, int):
        return rows.withColumn("_k", place).where(F.col("_k") <= cap).drop("_k")
    capped = rows.withColumn("_cap", cap)
    most = capped.agg(F.max("_cap")).first()[0]
    if most is None:
        return rows
    held = capped.where("_cap > 0").withColumn("_k", place).where(F.col("_k") <= most).where("_k <= _cap").drop("_k", "_cap")
    return held.unionByName(capped.where("_cap is null").drop("_cap"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace old ones; columns in keep_if_null keep the old value where the new one is null."""
    values = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*values).alias("_old"))
    b = new.select(*keys, F.struct(*values).alias("_new"))
    pick = lambda c: F.coalesce(F.col("_new")[c], F.col("_old")[c]) if c in keep_if_null else F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col("_old")[c])
    return a.join(b, keys, "full_outer").select(*keys, *(pick(c).alias(c) for c in values))


def ledger_add(ledger: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger with keys that it lacked."""
    return ledger.unionByName(done.join(ledger, keys, "left_anti").dropDuplicates(keys))


def graph_compose(base: DataFrame, delta: DataFrame, keys: list[str], undirected: bool = False) -> DataFrame:
    """Union of two node or edge tables; each attribute of the later one wins where it has a value. With undirected, the two keys are one pair in either order."""
    if undirected:
        a, b = keys
        base, delta = (x.withColumns({a: F.least(a, b), b: F.greatest(a, b)}) for x in (base, delta))
    return upsert(base, delta, keys, tuple(c for c in base.columns if c not in keys))
