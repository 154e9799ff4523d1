"""Running sums and row numbers over a global order without a window in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.plans.lineage import cut


def running_sum(df: DataFrame, order: list[Column], value: str, name: str, parts: int | None = None) -> DataFrame:
    """Running sum of `value` over the global order: range-partition, sum each partition, add the offsets.

    Only one row per partition goes through a single task. `order` should be total for a reproducible result.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part").agg(F.sum(value).alias("__s"))
    offs = sums.select("__part", (F.sum("__s").over(W.orderBy("__part")) - F.col("__s")).alias("__off"))
    w = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (ranged.withColumn(name, F.sum(value).over(w)).join(F.broadcast(offs), "__part")  # one row per partition
            .withColumn(name, F.col(name) + F.col("__off")).drop("__part", "__off"))


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """0-based position of each row in the global order."""
    out = running_sum(df.withColumn("__one", F.lit(1).cast("long")), order, "__one", name)
    return out.withColumn(name, F.col(name) - 1).drop("__one")


def with_next(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Add `value` of the next row of the global order (ascending, nulls last): null for the last row. One shuffle by range and one by part."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *[F.asc_nulls_last(c) for c in order]).withColumn("__part", F.spark_partition_id()))
    key = F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])
    firsts = ranged.groupBy("__part").agg(F.min_by(F.struct(value), key).alias("__f"))
    firsts = firsts.select("__part", F.lead("__f").over(W.orderBy("__part")).alias("__f"))  # one row per partition
    w = W.partitionBy("__part").orderBy(*[F.asc_nulls_last(c) for c in order])
    return (ranged.withColumn("__n", F.lead(F.struct(value)).over(w)).join(F.broadcast(firsts), "__part")
            .withColumn(name, F.coalesce("__n", "__f")[value]).drop("__part", "__n", "__f"))
