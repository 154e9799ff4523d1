"""Joins that Spark has no single node for: as-of, range; and null-safe, natural and LATERAL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def natural(a: DataFrame, b: DataFrame, how: str = "inner", null_safe: bool = False) -> DataFrame:
    cols = [c for c in a.columns if c in b.columns]
    if not null_safe:
        return a.join(b, cols, how)
    r = b.select(*[F.col(c).alias(f"__{c}") if c in cols else F.col(c) for c in b.columns])
    on = F.lit(True)
    for c in cols:
        on = on & a[c].eqNullSafe(r[f"__{c}"])
    return a.join(r, on, how).drop(*[f"__{c}" for c in cols])


def as_of(left: DataFrame, right: DataFrame, by: list[str], ts: str, value_cols: list[str], tie: str | None = None) -> DataFrame:
    """Each left row with the newest right row at or before its time: one union, one window by key, no pairs."""
    vals = F.struct(*value_cols)
    l = left.select("*", F.lit(None).cast(right.select(vals.alias("v")).schema["v"].dataType).alias("__v"), F.lit(1).alias("__side"))
    r = right.select(*[F.col(c) if c in by or c == ts else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], vals.alias("__v"), F.lit(0).alias("__side"))
    w = W.partitionBy(*by).orderBy(ts, "__side", *([tie] if tie else [])).rowsBetween(W.unboundedPreceding, 0)
    out = l.unionByName(r).withColumn("__got", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    return out.select(*left.columns, *[F.col(f"__got.{c}").alias(f"asof_{c}") for c in value_cols])


def range_join(points: DataFrame, value: str, spans: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Points within spans (low <= value < high) by buckets of `width`: an equi-join on the bucket, then the exact test."""
    p = points.withColumn("__b", F.floor(F.col(value) / width))
    s = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(s, "__b").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("__b")
