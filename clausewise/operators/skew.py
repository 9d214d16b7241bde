"""Keys that hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on; so there are at most 1 / HOT_SHARE hot keys, which bounds what is broadcast.
HOT_SHARE = 1 / 1000


def in_several(rows: DataFrame, key: str, owner: str, total: int) -> DataFrame:
    """The rows of `rows` whose `key` occurs under two or more values of `owner`.

    `total` is the number of rows or more.  Keys are counted with partial aggregation; the few hot
    ones come back by a broadcast join and never meet in one task, the others by a shuffled one.
    Rows with a null key are dropped; an empty table gives an empty one.
    """
    stats = rows.groupBy(key).agg(F.min(owner).alias("_lo"), F.max(owner).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    shared = stats.where(F.col("_lo") < F.col("_hi"))
    hot_from = max(2, int(total * HOT_SHARE))
    hot = shared.where(F.col("_n") >= hot_from).select(key, F.lit(True).alias("_hot"))
    cold = shared.where(F.col("_n") < hot_from).select(F.col(key).alias("_cold"))
    marked = rows.join(F.broadcast(hot), key, "left")
    # a hot row needs no partner any more: it is sent anywhere, and to the same place if a lost task is run again
    to = F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns))
    return (
        marked.withColumn("_to", to)
        .join(cold, F.col("_to") == F.col("_cold"), "left")
        .where(F.col("_hot") | F.col("_cold").isNotNull())
        .drop("_hot", "_to", "_cold")
    )


def salted(column: Column | str, parts: int) -> Column:
    """A number below `parts` that spreads the rows of one key over tasks, the same for the same value."""
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """`rows` over as many tasks as the cluster has cores, if a small input came in fewer; for work that keeps a core busy long.

    For tables as they are read: to count the tasks behind a shuffle, Spark would run it.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)
