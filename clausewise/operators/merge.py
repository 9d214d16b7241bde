"""Insert, update and keep by key, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewise.operators.durable import durable


def first_of_each(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key by `order`."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")


def only_new(rows: DataFrame, existing: DataFrame, key: list[str], order: str) -> DataFrame:
    """The rows whose key is not there yet, the first of each key."""
    return first_of_each(rows, key, order).join(existing.select(*key).distinct(), key, "left_anti")


def merge_actions(new: DataFrame, old: DataFrame, key: list[str], compared: str) -> DataFrame:
    """(key..., action, old value, new value): insert, update, keep, or absent for a key that only the old rows have.

    Keys must be unique on either side; a null compared value equals a null one.
    """
    n = new.select(*key, F.col(compared).alias("new_value"), F.lit(True).alias("_n"))
    o = old.select(*key, F.col(compared).alias("old_value"), F.lit(True).alias("_o"))
    action = (
        F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "absent").when(F.col("old_value").eqNullSafe(F.col("new_value")), "keep").otherwise("update")
    )
    return n.join(o, key, "full").select(*key, action.alias("action"), "old_value", "new_value")


def merged(new: DataFrame, old: DataFrame, key: list[str], keep_if_empty: tuple[str, ...] = (), touched: str | None = None) -> DataFrame:
    """The table after the merge: old rows with the new values where there are some, and the new rows.

    A column in `keep_if_empty` keeps its old value where the new one is null or empty. Both sides need the same columns. `touched` is a
    column that says when a row was last written: now, for rows that the new ones change.
    """
    cols = [c for c in old.columns if c not in key]
    o = old.select(*key, F.struct(*cols).alias("_o"))
    n = new.select(*key, F.struct(*cols).alias("_n"))
    pick = lambda c: F.when(F.col("_n").isNull(), F.col(f"_o.{c}")).when(F.lit(c in keep_if_empty) & F.coalesce(F.col(f"_n.{c}").cast("string") == "", F.lit(True)), F.col(f"_o.{c}")).otherwise(F.col(f"_n.{c}"))
    after = o.join(n, key, "full").select(*key, *[pick(c).alias(c) for c in cols], "_o", "_n")
    if touched is not None:
        rest = [c for c in cols if c != touched]
        old_rest = F.struct(*[F.col(f"_o.{c}").alias(c) for c in rest])
        same = F.col("_n").isNull() | (F.col("_o").isNotNull() & old_rest.eqNullSafe(F.struct(*rest)))
        after = after.withColumn(touched, F.when(same, F.col(f"_o.{touched}")).otherwise(F.current_timestamp().cast(dict(old.dtypes)[touched])))
    return after.drop("_o", "_n")


def numbered_after(rows: DataFrame, existing: DataFrame, number: str, order: list[str]) -> DataFrame:
    """`rows` with `number` going on after the largest one there is.

    Rows are counted in ranges of the order and shifted by the ranges before theirs, so no task sees all rows; of the ranges, only
    their sizes meet in one task.
    """
    base = existing.agg(F.coalesce(F.max(number), F.lit(0)).cast("bigint").alias("m")).first()["m"]
    parts = durable(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    # one row for each range
    told = inside.join(F.broadcast(shifts), "_p")
    return told.withColumn(number, (F.col("_i") + F.col("_shift") + base).cast("bigint")).drop("_p", "_i", "_shift")


def matched(new: DataFrame, old: DataFrame, first: list[str], second: list[str], number: str = "id") -> DataFrame:
    """`new` with `old_number` of the old row that has the same first key, else the same second one; the smallest of several; null if there is none.

    A key with a null in it matches nothing.
    """
    out = new
    for i, key in enumerate((first, second)):
        out = out.join(old.groupBy(*key).agg(F.min(number).alias(f"_{i}")), key, "left")
    return out.withColumn("old_number", F.coalesce("_0", "_1")).drop("_0", "_1")


def numbered_in_groups(rows: DataFrame, existing: DataFrame, group: str, number: str, order: str) -> DataFrame:
    """`rows` with `number` going on after the largest one of their group.

    Rows are counted in ranges of groups and order, each shifted by the rows of its group before it, so no task sees a whole group.
    """
    parts = durable(rows.repartitionByRange(group, order).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    base = existing.groupBy(F.col(group).alias("_h")).agg(F.max(number).alias("_base"))
    inside = parts.withColumn("_i", F.row_number().over(Window.partitionBy(group, "_p").orderBy(order)))
    told = inside.join(shifts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q"))).join(base, F.col(group).eqNullSafe(F.col("_h")), "left")
    return told.withColumn(number, (F.col("_i") + F.col("_shift") + F.coalesce("_base", F.lit(0))).cast("bigint")).select(*rows.columns, number)
