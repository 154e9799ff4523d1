"""Joins whose hot keys are dealt over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIRS = 20_000_000  # pairs of one key that one task makes, about


def spread_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join. A key with k * k * PAIRS pairs is dealt to a grid of k by k cells: rows of either side are in one of k strips and visit its
    k cells. Tasks are not merged for being small in bytes: it is pairs that take the time."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = [df.groupBy(*on).agg(F.count(F.lit(1)).alias(c)) for df, c in ((left, "__l"), (right, "__r"))]
    hot = sizes[0].join(sizes[1], on).where(F.col("__l") * F.col("__r") > PAIRS).select(*on, F.ceil(F.sqrt(F.col("__l") * F.col("__r") / PAIRS)).cast("int").alias("__k"))

    def deal(df: DataFrame, mine: str, other: str) -> DataFrame:
        k, cells = F.coalesce("__k", F.lit(1)), df.columns
        dealt = df.join(F.broadcast(hot), on, "left")  # few keys: each has thousands of rows
        return dealt.select(*cells, F.pmod(F.xxhash64(*cells), k).cast("int").alias(mine), F.explode(F.sequence(F.lit(0), k - 1)).alias(other))

    keys = [*on, "__i", "__j"]
    return deal(left, "__i", "__j").repartition(n, *keys).join(deal(right, "__j", "__i"), keys).drop("__i", "__j")
