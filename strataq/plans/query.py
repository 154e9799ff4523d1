"""The fluent query: filter, sort and window one table; joins and groups by delegation. Everything stays lazy."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.errors import UnsupportedQueryError
from strataq.plans.prefix import number_rows
from strataq.plans.semantics import order


class Query:
    def __init__(self, df: DataFrame, id_col: str | None = None, meta=None):
        self.df, self.id_col, self.meta = df, id_col, meta
        self._keys: list = []
        self._limit: int | None = None
        self._offset = 0

    def _with(self, **kw) -> Query:
        q = Query(self.df, self.id_col, self.meta)
        q.__dict__.update(self.__dict__)
        q.__dict__.update(kw)
        return q

    # a condition that is unknown drops the row, as a false one does; it goes to the scan as it is. For negations
    # that should hold for nulls see plans.semantics.not_two_valued
    def where(self, cond: Column | str) -> Query:
        return self._with(df=self.df.where(cond))

    def partition(self, column: str, value) -> Query:
        return self._with(df=self.df.where(F.col(column) == value))

    def use_index(self, name: str) -> Query:
        """A forced index must exist and its first key must be a column; the plan is Catalyst's either way."""
        if self.meta is None or name not in self.meta.indexes:
            raise UnsupportedQueryError(f"no index {name}")
        return self

    def by_ids(self, ids: DataFrame, column: str) -> Query:
        """Batch fetch: the rows whose id is in another frame (a semi join; Catalyst chooses how)."""
        return self._with(df=self.df.join(ids.select(F.col(column).alias(self.id_col)).distinct(), self.id_col, "left_semi"))

    def order_by(self, *keys) -> Query:
        return self._with(_keys=list(keys))

    def limit(self, n: int) -> Query:
        return self._with(_limit=n)

    def offset(self, n: int) -> Query:
        return self._with(_offset=n)

    def paginate(self, page: int, size: int) -> Query:
        if page < 1 or size < 1 or page * size > 2**63:
            raise ValueError("page and size must be positive and small enough")
        return self._with(_offset=(page - 1) * size, _limit=size)

    def _order(self) -> list[Column]:
        return order(self._keys, [self.id_col] if self.id_col else [])

    def frame(self) -> DataFrame:
        df = self.df.orderBy(*self._order()) if self._keys else self.df
        if self._offset:
            df = df.offset(self._offset)
        return df if self._limit is None else df.limit(self._limit)

    def after(self, **last) -> Query:
        """Keyset page: rows behind the given values of the sort keys and the id, in this query's order."""
        names = [k if isinstance(k, str) else k[0] for k in self._keys] + ([self.id_col] if self.id_col else [])
        ways = [("asc" if isinstance(k, str) else k[1]) for k in self._keys] + ["asc"]
        cond, equal = F.lit(False), F.lit(True)
        for n, way in zip(names, ways):
            c = F.col(n)
            cond = cond | (equal & ((c < last[n]) if way == "desc" else (c > last[n])))
            equal = equal & (c == last[n])
        return self._with(df=self.df.where(cond))

    def page(self, size: int, token: str | None = None) -> tuple[DataFrame, str]:
        """A page by position and the token of the next; a token of another query is refused."""
        mark = hashlib.sha256(self.df._jdf.queryExecution().analyzed().canonicalized().toString().encode()).hexdigest()[:16] + str(self._keys)
        start = 0
        if token:
            got = json.loads(base64.b64decode(token))
            if got["mark"] != mark:
                raise ValueError("the token belongs to another query")
            start = got["at"]
        rows = self._with(_offset=start, _limit=size).frame()
        return rows, base64.b64encode(json.dumps({"mark": mark, "at": start + size}).encode()).decode()

    def numbered(self, name: str = "position") -> DataFrame:
        """0-based position in the query's order, numbered by range partitions."""
        return number_rows(self.df, self._order(), name)

    def select(self, *cols) -> DataFrame:
        return self.frame().select(*cols)

    def first(self) -> DataFrame:
        return self._with(_limit=1).frame()

    def count(self) -> int:
        return self.frame().count()

    def exists(self) -> bool:
        return not self.frame().isEmpty()

    def stream(self):
        return self.frame().toLocalIterator()

    def capped(self, most: int) -> tuple[DataFrame, bool]:
        """At most `most` rows, and whether that is all of them."""
        df = self.frame().limit(most + 1)
        return df.limit(most), df.count() <= most

    def explain(self, mode: str = "formatted") -> str:
        """The plan as text, nothing run."""
        jdf = self.frame()._jdf
        return jdf.sparkSession().sessionState().executePlan(jdf.queryExecution().logical(), jdf.queryExecution().mode()).explainString(
            self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    def explain_analyze(self) -> dict:
        """Run it and tell rows, seconds and the plan that ran."""
        import time

        df = self.frame()
        began = time.time()
        rows = df.count()
        return {"rows": rows, "seconds": time.time() - began, "plan": df._jdf.queryExecution().executedPlan().toString()}

    def join(self, other: DataFrame, on, how: str = "inner") -> Query:
        return self._with(df=self.df.join(other, on, how))

    def aggregate(self):
        from strataq.operators.aggregate import Aggregate

        return Aggregate(self.df)
