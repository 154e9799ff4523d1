"""Aggregation builder, maintained aggregates and sketches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Aggregate:
    """group_by(...).count("n").sum("x", "s")....having(...).frame(); no group gives one row."""

    def __init__(self, df: DataFrame):
        self.df, self.keys, self.aggs, self.cond = df, [], [], None

    def group_by(self, *keys) -> Aggregate:
        self.keys += keys
        return self

    def _add(self, c: Column, name: str) -> Aggregate:
        self.aggs.append(c.alias(name))
        return self

    def count(self, name: str = "count") -> Aggregate:
        return self._add(F.count(F.lit(1)), name)

    def count_not_null(self, col: str, name: str) -> Aggregate:
        return self._add(F.count(col), name)

    def sum(self, col, name: str) -> Aggregate:
        return self._add(F.sum(col), name)

    def avg(self, col, name: str) -> Aggregate:
        return self._add(F.avg(col), name)

    def min(self, col, name: str) -> Aggregate:
        return self._add(F.min(col), name)

    def max(self, col, name: str) -> Aggregate:
        return self._add(F.max(col), name)

    def distinct(self, col, name: str, approximate: bool = False) -> Aggregate:
        return self._add(F.approx_count_distinct(col, 0.01) if approximate else F.count_distinct(F.col(col)), name)

    def percentile(self, col, p: float, name: str, approximate: bool = False) -> Aggregate:
        """Linear interpolation at p*(n-1); approximate: a bounded-size summary."""
        return self._add(F.percentile_approx(col, F.lit(p), F.lit(10_000)) if approximate else F.percentile(col, F.lit(p)), name)

    def having(self, cond: Column | str) -> Aggregate:
        self.cond = F.expr(cond) if isinstance(cond, str) else cond
        return self

    def frame(self) -> DataFrame:
        out = self.df.groupBy(*self.keys).agg(*self.aggs)
        return out if self.cond is None else out.where(self.cond)


# maintained aggregates: a state table of mergeable parts; a change is a small table of signed rows
def state(df: DataFrame, keys: list[str], col: str, sign: Column | None = None) -> DataFrame:
    """(keys, rows, not_null, total): parts that add up. With `sign` (+1/-1) rows are inserted and removed."""
    s = sign if sign is not None else F.lit(1)
    return df.groupBy(*keys).agg(F.sum(s.cast("long")).alias("rows"), F.sum(F.when(F.col(col).isNotNull(), s).otherwise(0).cast("long")).alias("not_null"),
                                 F.sum(F.col(col).cast("decimal(38,6)") * s).alias("total"))


def merge_states(*states: DataFrame, keys: list[str]) -> DataFrame:
    every = reduce(lambda a, b: a.unionByName(b), states)
    return every.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("rows", "not_null", "total")]).where("rows > 0")


def read_state(st: DataFrame, keys: list[str]) -> DataFrame:
    return st.select(*keys, F.col("rows").alias("count"), F.col("not_null").alias("count_not_null"), F.col("total").cast("double").alias("sum"),
                     (F.col("total").cast("double") / F.col("not_null")).alias("avg"))


def extreme_state(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """(keys, value, n): a multiset of values, from which min and max survive removals."""
    sign = F.col("sign") if "sign" in df.columns else F.lit(1)
    return df.groupBy(*keys, F.col(col).alias("value")).agg(F.sum(sign.cast("long")).alias("n"))


def distinct_state(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.hll_sketch_agg(col, F.lit(14)).alias("sketch"))


def merge_distinct(*states: DataFrame, keys: list[str]) -> DataFrame:
    every = reduce(lambda a, b: a.unionByName(b), states)
    return every.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch")).select(*keys, F.hll_sketch_estimate("sketch").alias("estimate"))


def percentile_state(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(col).alias("sketch"))


def update_counts(log: DataFrame, id_col: str, op_col: str, seq_col: str) -> DataFrame:
    """(id, updates): updates since the last insert; a deleted id has none. One pass of windows by id."""
    from pyspark.sql import Window as W

    w = W.partitionBy(id_col).orderBy(seq_col)
    life = log.withColumn("born", F.max(F.when(F.col(op_col) == "insert", F.col(seq_col))).over(W.partitionBy(id_col)))
    life = life.withColumn("last", F.last(op_col).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return (life.where((F.col("last") != "delete") & (F.col(seq_col) >= F.col("born")))
            .groupBy(id_col).agg(F.sum((F.col(op_col) == "update").cast("long")).alias("updates")))


def cdf(df: DataFrame, col: str, value) -> DataFrame:
    return df.agg((F.sum((F.col(col) <= value).cast("long")) / F.count(col)).alias("cdf"), F.count(col).alias("count"), F.min(col).alias("min"),
                  F.max(col).alias("max"), F.percentile(col, F.lit(0.5)).alias("median"))


def facets(df: DataFrame, col: str, top: int) -> DataFrame:
    """Values by how often they occur, the most frequent first; ties by value."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(top)
