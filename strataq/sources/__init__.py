"""Readers and writers; schemas are given, never inferred, on the production path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NTRIPLE = (r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:[^\s.]+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$')


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    r = spark.read.format(fmt).options(**options)
    return (r.schema(schema) if schema else r).load(path)


def read_partition(spark: SparkSession, path: str, column: str, value, fmt: str = "parquet") -> DataFrame:
    """One partition of a partitioned table: the filter prunes directories."""
    return spark.read.format(fmt).load(path).where(F.col(column) == value)


def write(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "error", **options) -> None:
    w = df.write.format(fmt).mode(mode).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def parse_ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    """N-Triples / N-Quads lines -> quads(g, s, p, o) as N-Triples terms, by regular expression in the JVM."""
    c = F.col(column)
    part = lambda i: F.regexp_extract(c, NTRIPLE, i)
    return (lines.where(c.rlike(NTRIPLE)).select(F.nullif(part(4), F.lit("")).alias("g"), part(1).alias("s"), part(2).alias("p"), part(3).alias("o")))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_ntriples(spark.read.text(path))


def values(spark: SparkSession, rows: list[tuple], names: list[str] | None = None, schema: str | None = None) -> DataFrame:
    if schema:
        return spark.createDataFrame(rows, schema)
    return spark.createDataFrame(rows, names or [f"column{i}" for i in range(len(rows[0]))])


def polymorphic(members: dict[str, DataFrame]) -> DataFrame:
    """One source over several record types: the union of their columns and __type."""
    out = None
    for name, df in members.items():
        df = df.withColumn("__type", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
