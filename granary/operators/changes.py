"""Changes to keyed relations, as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.sources.storage import settle


def without(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false or null."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def append(rows: DataFrame, more: DataFrame) -> DataFrame:
    return rows.unionByName(more)


def newest(rows: DataFrame, key: list[str], arrival: list[Column]) -> DataFrame:
    """One row for each key: the one that arrived last. The aggregate combines before it shuffles, so a key with many versions costs one row of each task."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*arrival))
    return rows.groupBy(*key).agg(last.alias("_last")).select("_last.*")


def upsert(rows: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """rows with those of more in place of rows with their keys; keys of more are unique."""
    return rows.join(more.select(*key), key, "left_anti").select(rows.columns).unionByName(more.select(rows.columns))


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos, each row's place in a total order, without gathering the rows in one task: ranges are sorted on their own, and only their sizes are summed up."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    numbered = settle(numbered, "positions")  # the ranges must not be drawn anew
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return numbered.join(F.broadcast(before), "_part").withColumn("pos", F.col("_before") + F.col("_nth") + 1).drop("_part", "_nth", "_n", "_before")
