"""Cutting lineage in loops: a table in the folder all executors share (spark.checkpoint.dir; a temporary one if unset)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

WATCHERS: list[list[str]] = []  # each collects the tables that are made while it is entered


def made(path: str) -> str:
    for w in WATCHERS:
        w.append(path)
    return path


def delete(spark, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shared_folder(spark) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, which only a local session may use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="strataq-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Write df as a table and read it again; `old`, a table made by an earlier cut that nothing needs any more, is deleted."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made(path)
    if old is not None:
        for f in {p.rsplit("/", 1)[0] for p in old.inputFiles()}:
            if "/cut-" in f:
                delete(spark, f)
    return spark.read.schema(df.schema).parquet(path)


def bucket(df: DataFrame, by: str) -> DataFrame:
    """Write df as a table of buckets by one column: what joins it by that column moves, and the table stays where it is."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"cut_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name.replace('_', '-')}"
    df.repartition(n, by).write.bucketBy(n, by).option("path", path).saveAsTable(name, format="parquet")
    made(path)
    return spark.table(name)


class Growing:
    """A table that a loop adds rows to, one folder a round: nothing is rewritten. `mark` is a column with the round."""

    def __init__(self, first: DataFrame, mark: str):
        self.spark, self.mark, self.schema, self.parts = first.sparkSession, mark, first.schema, 0
        self.path = made(f"{shared_folder(self.spark)}/cut-{uuid.uuid4().hex}")
        self.last = self.add(first)

    def add(self, rows: DataFrame) -> DataFrame:
        """Write the rows of a round and return them as a table."""
        path = f"{self.path}/{self.mark}={self.parts}"
        rows.write.parquet(path)
        self.parts += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema), f"`{self.mark}` int"])
        return self.spark.read.schema(fields).parquet(self.path)
