"""Tables by name: where they lie and which columns identify, partition, rank or locate their rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Table:
    name: str
    id_col: str | None = None
    partition_cols: tuple[str, ...] = ()
    indexes: dict[str, tuple[str, ...]] = field(default_factory=dict)  # index name -> key columns
    references: dict[str, tuple[str, str]] = field(default_factory=dict)  # fk column -> (table, column)


TABLES = {t.name: t for t in [
    Table("region", "r_regionkey"),
    Table("nation", "n_nationkey", references={"n_regionkey": ("region", "r_regionkey")}),
    Table("customer", "c_custkey", indexes={"by_balance": ("c_acctbal",), "by_segment": ("c_mktsegment",)}, references={"c_nationkey": ("nation", "n_nationkey")}),
    Table("supplier", "s_suppkey", references={"s_nationkey": ("nation", "n_nationkey")}),
    Table("part", "p_partkey", indexes={"by_type_brand": ("p_type", "p_brand")}),
    Table("orders", "o_orderkey", indexes={"by_customer": ("o_custkey",), "by_date": ("o_orderdate",)}, references={"o_custkey": ("customer", "c_custkey")}),
    Table("lineitem", None, indexes={"by_order": ("l_orderkey",)}, references={"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey")}),
    Table("events", "event_id", indexes={"by_user": ("user_id", "ts")}),
    Table("documents", "doc_id"), Table("embeddings", "vec_id"), Table("pages", "page_id"), Table("benchmark", "item_id"),
    Table("labels", "doc_id"), Table("conversations", None),
]}


class Catalog:
    """Tables of one folder. DataFrames are lazy; Catalyst prunes columns and pushes filters into the scans."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Table] | None = None):
        self.spark, self.folder, self.tables = spark, folder, tables or TABLES
        self.graphs: dict[str, object] = {}

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def table(self, name: str) -> Table:
        return self.tables[name]

    def register_views(self, names=None) -> None:
        for n in names or self.tables:
            self.load(n).createOrReplaceTempView(n)
