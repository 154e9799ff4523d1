"""Ranked access to a score (0-based) and time-window leaderboards (1-based)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.plans.prefix import running_sum


class Rank:
    """By score, descending; equal scores by id, descending (the scan runs backwards)."""

    def __init__(self, df: DataFrame, score: str, id_col: str):
        self.df, self.score, self.id = df.where(F.col(score).isNotNull()), score, id_col

    def top(self, n: int) -> DataFrame:
        """Top-n needs no global window: the n rows are taken first (TakeOrdered), then numbered."""
        rows = self.df.orderBy(F.desc(self.score), F.desc(self.id)).limit(n)
        return rows.withColumn("rank", (F.row_number().over(W.orderBy(F.desc(self.score), F.desc(self.id))) - 1).cast("long"))

    def bottom(self, n: int) -> DataFrame:
        rows = self.df.orderBy(F.asc(self.score), F.asc(self.id)).limit(n)
        total = self.df.agg(F.count(F.lit(1)).alias("__n"))
        rows = rows.withColumn("__r", F.row_number().over(W.orderBy(F.asc(self.score), F.asc(self.id))))
        return rows.join(F.broadcast(total)).withColumn("rank", F.col("__n") - F.col("__r")).drop("__n", "__r")  # total is one row

    def range(self, start: int, stop: int) -> DataFrame:
        return self.top(stop).where(F.col("rank") >= start)

    def percentile(self, p: float) -> DataFrame:
        n = self.df.count()
        at = min(int(n * (1 - p)), n - 1)
        return self.range(at, at + 1) if n else self.df.limit(0).withColumn("rank", F.lit(0).cast("long"))

    def rank_of(self, value) -> DataFrame:
        greater = F.sum((F.col(self.score) > value).cast("long"))
        return self.df.agg(F.coalesce(greater, F.lit(0)).alias("rank"), F.count(F.lit(1)).alias("total"))

    def all_ranks(self) -> DataFrame:
        """Rank of every row as the number of greater scores: counted per distinct score and summed up by range partitions."""
        per = self.df.groupBy(self.score).agg(F.count(F.lit(1)).alias("__c"))
        ranks = running_sum(per, [F.desc(self.score)], "__c", "rank").withColumn("rank", F.col("rank") - F.col("__c")).drop("__c")
        return self.df.join(ranks, self.score)


HOURLY, DAILY, WEEKLY, MONTHLY = 3600, 86400, 604800, 2592000


class Leaderboard:
    """Per window (floor of epoch seconds) and group; by score descending, then id ascending. Windows partition the work."""

    def __init__(self, df: DataFrame, ts: str, score: str, id_col: str, seconds: int = DAILY, group: tuple[str, ...] = ()):
        self.df = df.withColumn("window_id", F.floor(F.unix_timestamp(ts) / seconds).cast("long"))
        self.score, self.id, self.group = score, id_col, list(group)

    def _w(self, down: bool = True):
        return W.partitionBy("window_id", *self.group).orderBy(F.desc(self.score) if down else F.asc(self.score), F.asc(self.id) if down else F.desc(self.id))

    def top(self, k: int) -> DataFrame:
        return self.df.withColumn("rank", F.row_number().over(self._w()).cast("long")).where(F.col("rank") <= k)

    def bottom(self, k: int) -> DataFrame:
        return self.df.withColumn("rank", F.row_number().over(self._w(False)).cast("long")).where(F.col("rank") <= k)

    def ranks(self, cond: Column | None = None) -> DataFrame:
        out = self.df.withColumn("rank", F.row_number().over(self._w()).cast("long")).withColumn(
            "dense_rank", F.dense_rank().over(W.partitionBy("window_id", *self.group).orderBy(F.desc(self.score))).cast("long"))
        return out if cond is None else out.where(cond)

    def percentile(self, p: float) -> DataFrame:
        n = F.count(F.lit(1)).over(W.partitionBy("window_id", *self.group))
        at = F.greatest(F.lit(1), F.ceil(F.lit(1 - p) * n))
        return self.df.withColumn("rank", F.row_number().over(self._w()).cast("long")).withColumn("__at", at).where("rank = __at").drop("__at")

    def windows(self) -> DataFrame:
        return self.df.select("window_id").distinct().orderBy(F.desc("window_id"))

    def keep_last(self, count: int, now_window: Column | None = None) -> Leaderboard:
        """Expire windows older than the newest `count`."""
        newest = self.df.agg(F.max("window_id").alias("__m"))
        self.df = self.df.join(F.broadcast(newest)).where(F.col("window_id") > F.col("__m") - count).drop("__m")  # one row
        return self
