"""Engine: the tables of a folder, SQL over them (with GRAPH_TABLE and SPARQL sources), fluent queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataq.catalog import Catalog
from strataq.plans.query import Query


class Engine:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.catalog = spark, Catalog(spark, folder)
        self.commands: dict = {}

    def table(self, name: str) -> DataFrame:
        return self.catalog.load(name)

    def query(self, name: str) -> Query:
        t = self.catalog.table(name)
        return Query(self.table(name), t.id_col, t)

    def sql(self, text: str, **params) -> DataFrame:
        """Spark SQL over the tables. CREATE/DROP PROPERTY GRAPH, GRAPH_TABLE(...) and SPARQL('...') are rewritten first;
        parameters are named (:name) or positional (args=[...])."""
        from strataq.graph.sqlpgq import rewrite_graph_sql

        self.catalog.register_views([t for t in self.catalog.tables if t in text])
        text = rewrite_graph_sql(self, text)
        if text is None:
            return self.spark.createDataFrame([], "status string")
        args = params.pop("args", None) or params or None
        return self.spark.sql(text, args=args) if args else self.spark.sql(text)

    def sparql(self, text: str, quads: DataFrame):
        from strataq.sparql.engine import run

        return run(quads, text)

    def register_source(self, name: str, make) -> None:
        """A logical source: make(engine) -> DataFrame, visible to SQL under its name."""
        make(self).createOrReplaceTempView(name)

    def register_command(self, name: str, f) -> None:
        """A named operation f(engine, **params), such as a custom operator or a write command."""
        self.commands[name] = f

    def run(self, name: str, **params):
        return self.commands[name](self, **params)

    def statistics(self, name: str, columns: list[str]) -> DataFrame:
        from strataq.operators.records import column_stats

        return column_stats(self.table(name), columns)
