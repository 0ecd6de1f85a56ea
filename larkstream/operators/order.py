"""Global ranks without a single-task window: range partitions are numbered within, then shifted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with its rank from 1 in the given order, which should have no ties.

    The sort keys are computed once, beside the record, and the range-partitioned rows are checkpointed, so
    that both readings see the same partitions; the shift of each partition comes from one count per
    partition. The record travels as a struct, so no name of df can clash, but that a column called `name`
    is replaced.
    """
    from larkstream.session import cut

    keys = [f"k{i}" for i in range(len(order))]
    keyed = df.select(F.struct("*").alias("record"), *[c.alias(k) for c, k in zip(order, keys, strict=True)])
    ranged = cut(keyed.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    shift = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*keys))
    placed = ranged.withColumn("own", inside).join(F.broadcast(shift), "part")
    return placed.select(*[F.col("record")[c].alias(c) for c in df.columns if c != name], (F.col("own") + F.col("shift")).alias(name))
