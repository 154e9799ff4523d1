"""SPARQL algebra -> DataFrames. A solution table has one string column a variable (N-Triples terms, null: unbound)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.errors import UnsupportedQueryError
from strataq.plans.lineage import cut
from strataq.sparql import terms as T
from strataq.sparql.parser import Parser
from strataq.sparql.terms import XSD

#: Extension functions: IRI -> function of term columns.
FUNCTIONS: dict[str, Callable[..., Column]] = {}


class Table:
    """Solutions, and which variables every solution binds: only these can be plain join keys."""

    def __init__(self, df: DataFrame, certain: set[str]):
        self.df, self.certain = df, certain

    @property
    def vars(self) -> list[str]:
        return self.df.columns


class Val:
    """A compiled expression: kind term, num, bool or str, and whether a num is an integer."""

    def __init__(self, kind: str, col: Column, integer: Column | bool = False):
        self.kind, self.col, self.integer = kind, col, integer

    def num(self) -> Column:
        return self.col.cast("double") if self.kind == "num" else T.number(self.term())

    def str_(self) -> Column:
        return self.col if self.kind == "str" else T.lexical(self.term())

    def bool_(self) -> Column:
        return self.col if self.kind == "bool" else self.col != 0 if self.kind == "num" else F.length(self.col) > 0 if self.kind == "str" else T.boolean(self.col)

    def term(self) -> Column:
        return {"term": lambda: self.col, "num": lambda: T.make_number(self.col, self.integer), "str": lambda: T.make_string(self.col), "bool": lambda: T.make_boolean(self.col)}[self.kind]()

    def is_int(self) -> Column:
        if self.kind == "num":
            return F.lit(self.integer) if isinstance(self.integer, bool) else self.integer
        return T.datatype(self.term()) == XSD + "integer"


class Compiler:
    def __init__(self, quads: DataFrame, dataset: dict | None = None):
        self.spark = quads.sparkSession
        self.quads, self.dataset = quads, dataset or {"from": [], "named": []}
        self.n = 0

    # ---- patterns
    def unit(self) -> Table:
        return Table(self.spark.range(1).select(), set())

    def active(self, graph) -> DataFrame:
        q = self.quads
        if graph is None:
            d = self.dataset
            if d["from"] or d["named"]:
                return q.where(F.col("g").isin(*d["from"])) if d["from"] else q.limit(0)
            return q.where(F.col("g").isNull())
        q = q.where(F.col("g").isNotNull())
        return q.where(F.col("g").isin(*self.dataset["named"])) if self.dataset["named"] else q

    def eval(self, p: tuple, graph=None) -> Table:
        return getattr(self, "p_" + p[0])(*p[1:], graph=graph)

    def p_bgp(self, triples: list, graph=None) -> Table:
        """Joins in greedy order: most constants first, then whatever shares variables."""
        todo, done = [(t, self._names(t)) for t in triples], None
        bound: set[str] = set()
        while todo:
            best = max(todo, key=lambda x: (bool(x[1] & bound) or not bound, sum(y[0] == "term" for y in x[0][:3] if isinstance(y, tuple)), len(x[1] & bound)))
            todo.remove(best)
            t = self.triple(best[0], graph)
            done = t if done is None else self.join(done, t)
            bound |= best[1]
        return done if done is not None else self.unit()

    def _names(self, t) -> set[str]:
        out = set()
        for x in t:
            if x[0] == "var":
                out.add(x[1])
            elif x[0] == "triple":
                out |= self._names(x[1:])
        return out

    def triple(self, t: tuple, graph) -> Table:
        s, p, o = t
        if p[0] in ("term", "var"):
            return self.match(self.active(graph), s, p, o, graph)
        return self.bind_ends(self.path(p, graph, s, o), s, o, graph)

    def match(self, q: DataFrame, s, p, o, graph) -> Table:
        out, parts = {}, [("s", s), ("p", p), ("o", o)] + ([("g", graph)] if graph is not None else [])
        for c, x in parts:
            col = F.col(c)
            if x[0] == "term":
                q = q.where(col == x[1])
            elif x[0] == "var":
                if x[1] in out:
                    q = q.where(col == out[x[1]])
                else:
                    out[x[1]] = col
            else:  # a triple term: its parts are matched within
                q = q.where(T.is_triple(col))
                m = r"^<<\( (\S+) (\S+) (.*) \)>>$"
                for i, y in enumerate(x[1:], 1):
                    part = F.regexp_extract(col, m, i)
                    if y[0] == "term":
                        q = q.where(part == y[1])
                    elif y[1] in out:
                        q = q.where(part == out[y[1]])
                    else:
                        out[y[1]] = part
        return Table(q.select(*[c.alias(n) for n, c in out.items()]), set(out))

    # ---- property paths: tables (s, o) with, under a graph variable, g
    def path(self, p: tuple, graph, s=None, o=None) -> DataFrame:
        q = self.active(graph)
        if graph is not None and graph[0] == "term":
            q = q.where(F.col("g") == graph[1])
        return self._path(p, q, s, o)

    def _path(self, p, q: DataFrame, s=None, o=None) -> DataFrame:
        kind = p[0]
        if kind == "term":
            return q.where(F.col("p") == p[1]).select("s", "o")
        if kind == "inv":
            return self._path(p[1], q).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if kind == "seq":
            a, b = self._path(p[1], q), self._path(p[2], q)
            return a.withColumnRenamed("o", "m").join(b.withColumnRenamed("s", "m"), "m").select("s", "o")
        if kind == "alt":
            return self._path(p[1], q).union(self._path(p[2], q))
        if kind == "not":
            a = q.where(~F.col("p").isin(*p[1])).select("s", "o") if p[1] or not p[2] else None
            b = q.where(~F.col("p").isin(*p[2])).select(F.col("o").alias("s"), F.col("s").alias("o")) if p[2] else None
            return a if b is None else b if a is None else a.union(b)
        if kind == "rep":
            _, inner, low, high = p
            step = cut(self._path(inner, q).distinct())
            ident = q.select(F.col("s").alias("x")).union(q.select(F.col("o").alias("x")))
            for end in (s, o):
                if end is not None and end[0] == "term":
                    ident = ident.union(self.spark.createDataFrame([(end[1],)], "x string"))
            ident = ident.distinct().select(F.col("x").alias("s"), F.col("x").alias("o"))
            # a fixed end keeps the closure to what it reaches
            cur = ident
            if s is not None and s[0] == "term":
                cur = cur.where(F.col("s") == s[1])
            elif o is not None and o[0] == "term":
                back = self._path(("rep", ("inv", inner), low, high), q, o, None)
                return back.select(F.col("o").alias("s"), F.col("s").alias("o"))
            nxt = step.select(F.col("s").alias("o"), F.col("o").alias("n"))
            for _ in range(low):
                cur = cut(cur.join(nxt, "o").select("s", F.col("n").alias("o")).distinct())
            out, front, k = cut(cur), cur, low
            while high is None or k < high:
                k += 1
                new = cut(front.join(nxt, "o").select("s", F.col("n").alias("o")).distinct().join(out, ["s", "o"], "left_anti"))
                if new.isEmpty():
                    break
                out, front = cut(out.union(new)), new
            return out
        raise UnsupportedQueryError(f"path {kind}")

    def bind_ends(self, df: DataFrame, s, o, graph) -> Table:
        if graph is not None and graph[0] == "var":
            raise UnsupportedQueryError("a property path under a graph variable")
        out = {}
        for c, x in (("s", s), ("o", o)):
            if x[0] == "term":
                df = df.where(F.col(c) == x[1])
            elif x[1] in out:
                df = df.where(F.col(c) == out[x[1]])
            else:
                out[x[1]] = F.col(c)
        return Table(df.select(*[c.alias(n) for n, c in out.items()]), set(out))

    # ---- joins of compatible solutions
    def join(self, a: Table, b: Table, how: str = "inner", cond: tuple | None = None, graph=None) -> Table:
        """Variables that both sides always bind are equi-keys; the others also match when either is unbound."""
        shared = [v for v in a.vars if v in b.vars]
        sure = [v for v in shared if v in a.certain and v in b.certain]
        self.n += 1
        right = b.df.select(*[F.col(v).alias(f"__{self.n}_{v}") if v in shared else F.col(v) for v in b.vars])
        on = F.lit(True)
        for v in shared:
            x, y = F.col(v), F.col(f"__{self.n}_{v}")
            on = on & (x == y if v in sure else (x.isNull() | y.isNull() | (x == y)))
        if cond is not None:
            on = on & F.coalesce(self.boolean(cond, set(a.vars) | set(b.vars), graph), F.lit(False))
        df = a.df.join(right, on, how) if shared or cond is not None else (a.df.crossJoin(right) if how == "inner" else a.df.join(right, F.lit(True), how))
        cols = [F.coalesce(F.col(v), F.col(f"__{self.n}_{v}")).alias(v) if v in shared and v not in a.certain else F.col(v) for v in a.vars]
        df = df.select(*cols, *[F.col(v) for v in b.vars if v not in shared])
        return Table(df, a.certain | (b.certain if how == "inner" else set()))

    def p_join(self, a, b, graph=None) -> Table:
        return self.join(self.eval(a, graph), self.eval(b, graph))

    def p_left(self, a, b, cond, graph=None) -> Table:
        return self.join(self.eval(a, graph), self.eval(b, graph), "left", cond, graph)

    def p_lateral(self, a, b, graph=None) -> Table:
        """The right side is joined on what it shares; a limit inside holds per left solution."""
        left = self.eval(a, graph)
        if b[0] == "select" and (b[1]["limit"] is not None):
            from pyspark.sql import Window as W

            q = {**b[1], "limit": None}
            right = self.eval(("select", q), graph)
            out = self.join(left, right)
            w = W.partitionBy(*left.vars).orderBy(*[F.col(v) for v in out.vars])
            return Table(out.df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= b[1]["limit"]).drop("__r"), out.certain)
        return self.join(left, self.eval(b, graph))

    def p_union(self, a, b, graph=None) -> Table:
        x, y = self.eval(a, graph), self.eval(b, graph)
        return Table(x.df.unionByName(y.df, allowMissingColumns=True), x.certain & y.certain)

    def p_minus(self, a, b, graph=None) -> Table:
        x, y = self.eval(a, graph), self.eval(b, graph)
        shared = [v for v in x.vars if v in y.vars]
        if not shared:
            return x
        right = y.df.select(*[F.col(v).alias(f"__m_{v}") for v in shared]).distinct()
        on, some = F.lit(True), F.lit(False)
        for v in shared:
            l, r = F.col(v), F.col(f"__m_{v}")
            sure = v in x.certain and v in y.certain
            on = on & (l == r if sure else (l.isNull() | r.isNull() | (l == r)))
            some = some | (F.lit(True) if sure else l.isNotNull() & r.isNotNull())
        return Table(x.df.join(right, on & some, "left_anti"), x.certain)

    def p_filter(self, e, a, graph=None) -> Table:
        t = self.eval(a, graph)
        for part in _conjuncts(e):
            ex, neg = (part[1], True) if part[0] == "not" and part[1][0] == "exists" else (part, False)
            if ex[0] == "exists":
                t = self.exists(t, ex[1], neg, graph)
            else:
                t = Table(t.df.where(F.coalesce(self.boolean(part, set(t.vars), graph), F.lit(False))), t.certain)
        return t

    def exists(self, t: Table, pattern, negated: bool, graph) -> Table:
        """A semi or anti join on the shared variables; a filter inside may use outer variables."""
        cond = None
        if pattern[0] == "filter":
            cond, pattern = pattern[1], pattern[2]
        inner = self.eval(pattern, graph)
        shared = [v for v in t.vars if v in inner.vars]
        right = inner.df.select(*[F.col(v).alias(f"__e_{v}") if v in shared else F.col(v) for v in inner.vars])
        on = F.lit(True)
        for v in shared:
            l, r = F.col(v), F.col(f"__e_{v}")
            on = on & (l == r if v in t.certain and v in inner.certain else (l.isNull() | r.isNull() | (l == r)))
        if cond is not None:
            on = on & F.coalesce(self.boolean(cond, set(t.vars) | set(inner.vars), graph), F.lit(False))
        return Table(t.df.join(right, on, "left_anti" if negated else "left_semi"), t.certain)

    def p_extend(self, var, e, a, graph=None) -> Table:
        t = self.eval(a, graph)
        if var in t.vars:
            raise UnsupportedQueryError(f"?{var} is bound already")
        return Table(t.df.withColumn(var, self.expr(e, set(t.vars), graph).term()), t.certain)

    def p_values(self, names, rows, graph=None) -> Table:
        df = self.spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{n}` string" for n in names))
        return Table(df, {n for i, n in enumerate(names) if all(r[i] is not None for r in rows)})

    def p_graph(self, g, a, graph=None) -> Table:
        return self.eval(a, g)

    def p_select(self, q, graph=None) -> Table:
        return self.select(q, graph)

    # ---- expressions
    def boolean(self, e, scope, graph=None) -> Column:
        return self.expr(e, scope, graph).bool_()

    def expr(self, e: tuple, scope: set[str], graph=None) -> Val:
        k = e[0]
        go = lambda x: self.expr(x, scope, graph)
        if k == "var":
            return Val("term", F.col(e[1]) if e[1] in scope else F.lit(None).cast("string"))
        if k == "term":
            return Val("term", F.lit(e[1]))
        if k == "triple":
            a, b, c = (go(x).term() for x in e[1:])
            return Val("term", F.concat(F.lit("<<( "), a, F.lit(" "), b, F.lit(" "), c, F.lit(" )>>")))
        if k == "and":
            return Val("bool", go(e[1]).bool_() & go(e[2]).bool_())
        if k == "or":
            return Val("bool", go(e[1]).bool_() | go(e[2]).bool_())
        if k == "not":
            return Val("bool", ~go(e[1]).bool_())
        if k in ("=", "!=", "<", ">", "<=", ">="):
            return Val("bool", _compare(k, go(e[1]), go(e[2])))
        if k == "in":
            out = F.lit(False)
            for x in e[2]:
                out = out | _compare("=", go(e[1]), go(x))
            return Val("bool", out)
        if k in ("+", "-", "*", "/"):
            a, b = go(e[1]), go(e[2])
            x, y = a.num(), b.num()
            v = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.try_divide(x, y)}[k]()
            return Val("num", v, F.lit(False) if k == "/" else a.is_int() & b.is_int())
        if k == "neg":
            a = go(e[1])
            return Val("num", -a.num(), a.is_int())
        if k == "exists":
            raise UnsupportedQueryError("EXISTS below OR or in an expression")
        if k == "agg":
            raise UnsupportedQueryError("an aggregate outside of a grouped query")
        if k == "col":
            return Val("term", F.col(e[1]))
        if k == "call":
            return self.call(e[1], e[2], go)
        raise UnsupportedQueryError(str(k))

    def call(self, name: str, args: list, go) -> Val:
        if name in FUNCTIONS:
            return Val("term", FUNCTIONS[name](*[go(a).term() for a in args]))
        if name.startswith(XSD):
            return _cast(name[len(XSD):], go(args[0]))
        a = [go(x) for x in args]
        s = lambda i: a[i].str_()
        t = lambda i: a[i].term()
        like = lambda i, c: Val("term", T.make_string(c, _tail(t(i))))  # noqa: E731  keeps the language of argument i
        if name == "BOUND":
            return Val("bool", t(0).isNotNull())
        if name == "IF":
            return Val("term", F.when(a[0].bool_().isNull(), None).when(a[0].bool_(), t(1)).otherwise(t(2)))
        if name == "COALESCE":
            return Val("term", F.coalesce(*[x.term() for x in a]))
        table: dict[str, Callable[[], Val]] = {
            "STR": lambda: Val("str", s(0)), "STRLEN": lambda: Val("num", F.length(s(0)), True), "UCASE": lambda: like(0, F.upper(s(0))), "LCASE": lambda: like(0, F.lower(s(0))),
            "CONTAINS": lambda: Val("bool", F.contains(s(0), s(1))), "STRSTARTS": lambda: Val("bool", F.startswith(s(0), s(1))), "STRENDS": lambda: Val("bool", F.endswith(s(0), s(1))),
            "SUBSTR": lambda: like(0, F.substring(s(0), a[1].num().cast("int"), a[2].num().cast("int") if len(a) > 2 else F.length(s(0)))),
            "CONCAT": lambda: Val("str", F.concat(*[x.str_() for x in a])),
            "STRBEFORE": lambda: Val("str", _before(s(0), s(1))),
            "STRAFTER": lambda: Val("str", _after(s(0), s(1))),
            "ENCODE_FOR_URI": lambda: Val("str", F.replace(F.url_encode(s(0)), F.lit("+"), F.lit("%20"))),
            "REGEX": lambda: Val("bool", F.rlike(s(0), F.concat(_flags(s(2)), s(1)) if len(a) > 2 else s(1))),
            "REPLACE": lambda: Val("str", F.regexp_replace(s(0), F.concat(_flags(s(3)), s(1)) if len(a) > 3 else s(1), s(2))),
            "IRI": lambda: Val("term", T.make_iri(s(0))), "URI": lambda: Val("term", T.make_iri(s(0))),
            "LANG": lambda: Val("str", T.lang(t(0))), "LANGDIR": lambda: Val("str", T.direction(t(0))),
            "LANGMATCHES": lambda: Val("bool", F.when(s(1) == "*", s(0) != "").otherwise((F.lower(s(0)) == F.lower(s(1))) | F.startswith(F.lower(s(0)), F.concat(F.lower(s(1)), F.lit("-"))))),
            "HASLANG": lambda: Val("bool", F.coalesce(T.lang(t(0)), F.lit("")) != ""), "HASLANGDIR": lambda: Val("bool", F.coalesce(T.direction(t(0)), F.lit("")) != ""),
            "DATATYPE": lambda: Val("term", T.make_iri(T.datatype(t(0)))), "SAMETERM": lambda: Val("bool", t(0) == t(1)),
            "STRDT": lambda: Val("term", F.concat(T.make_string(s(0)), F.lit("^^"), t(1))), "STRLANG": lambda: Val("term", F.concat(T.make_string(s(0)), F.lit("@"), F.lower(s(1)))),
            "STRLANGDIR": lambda: Val("term", F.concat(T.make_string(s(0)), F.lit("@"), F.lower(s(1)), F.lit("--"), s(2))),
            "ISIRI": lambda: Val("bool", T.is_iri(t(0))), "ISURI": lambda: Val("bool", T.is_iri(t(0))), "ISBLANK": lambda: Val("bool", T.is_blank(t(0))),
            "ISLITERAL": lambda: Val("bool", T.is_literal(t(0))), "ISNUMERIC": lambda: Val("bool", T.is_numeric(t(0)) & T.number(t(0)).isNotNull()), "ISTRIPLE": lambda: Val("bool", T.is_triple(t(0))),
            "BNODE": lambda: Val("term", F.concat(F.lit("_:b"), F.md5(s(0)) if a else F.replace(F.uuid(), F.lit("-"), F.lit("")))),
            "ABS": lambda: Val("num", F.abs(a[0].num()), a[0].is_int()), "ROUND": lambda: Val("num", F.floor(a[0].num() + 0.5), a[0].is_int()),
            "CEIL": lambda: Val("num", F.ceil(a[0].num()), a[0].is_int()), "FLOOR": lambda: Val("num", F.floor(a[0].num()), a[0].is_int()), "RAND": lambda: Val("num", F.rand()),
            "MD5": lambda: Val("str", F.md5(s(0))), "SHA1": lambda: Val("str", F.sha1(s(0))), "SHA256": lambda: Val("str", F.sha2(s(0), 256)), "SHA384": lambda: Val("str", F.sha2(s(0), 384)),
            "SHA512": lambda: Val("str", F.sha2(s(0), 512)), "NOW": lambda: Val("term", T.make_typed(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), XSD + "dateTime")),
            "UUID": lambda: Val("term", T.make_iri(F.concat(F.lit("urn:uuid:"), F.uuid()))), "STRUUID": lambda: Val("str", F.uuid()),
            "TRIPLE": lambda: Val("term", F.concat(F.lit("<<( "), t(0), F.lit(" "), t(1), F.lit(" "), t(2), F.lit(" )>>"))),
            "SUBJECT": lambda: Val("term", F.regexp_extract(t(0), r"^<<\( (\S+) (\S+) (.*) \)>>$", 1)), "PREDICATE": lambda: Val("term", F.regexp_extract(t(0), r"^<<\( (\S+) (\S+) (.*) \)>>$", 2)),
            "OBJECT": lambda: Val("term", F.regexp_extract(t(0), r"^<<\( (\S+) (\S+) (.*) \)>>$", 3)),
            "TRIGRAM_SIM": lambda: Val("num", _trigram(s(0), s(1))),
        }
        for n, f in (("YEAR", F.year), ("MONTH", F.month), ("DAY", F.day), ("HOURS", F.hour), ("MINUTES", F.minute), ("SECONDS", F.second)):
            table[n] = lambda f=f: Val("num", f(T.timestamp(t(0))), True)
        zone = lambda: F.regexp_extract(s(0), r"(Z|[+-]\d\d:\d\d)$", 1)
        table["TZ"] = lambda: Val("str", zone())
        table["TIMEZONE"] = lambda: Val("term", F.when(zone() == "Z", F.lit(f'"PT0S"^^<{XSD}dayTimeDuration>')).when(zone() != "", T.make_typed(
            F.concat(F.when(F.startswith(zone(), F.lit("-")), "-").otherwise(""), F.lit("PT"), F.substring(zone(), 2, 2).cast("int").cast("string"), F.lit("H")), XSD + "dayTimeDuration")))
        if name not in table:
            raise UnsupportedQueryError(f"function {name}")
        return table[name]()

    # ---- solution modifiers
    def select(self, q: dict, graph=None) -> Table:
        t = self.eval(q["where"], graph)
        aggs: dict[tuple, str] = {}

        def lift(e):
            """Replace aggregates by columns of the grouped table."""
            if isinstance(e, tuple) and e and e[0] == "agg":
                key = repr(e)
                if key not in aggs:
                    aggs[key] = (f"__a{len(aggs)}", e)
                return ("col", aggs[key][0])
            if isinstance(e, tuple):
                return tuple(lift(x) for x in e)
            return [lift(x) for x in e] if isinstance(e, list) else e

        items = [(n, lift(e) if e else None) for n, e in q["items"]]
        having, order = [lift(h) for h in q["having"]], [(lift(e), d) for e, d in q["order"]]
        if q["group"] is not None or aggs:
            df, scope = t.df, set(t.vars)
            keys = []
            for n, e in q["group"] or []:
                if e is not None:
                    df = df.withColumn(n, self.expr(e, scope, graph).term())
                keys.append(n)
            scope |= set(keys)
            cols = [self.aggregate(e, scope, graph, df).alias(n) for n, e in aggs.values()]
            df = df.groupBy(*keys).agg(*cols) if cols else df.select(*keys).distinct()
            t = Table(df, t.certain & set(keys))
        for h in having:
            t = Table(t.df.where(F.coalesce(self.boolean(h, set(t.vars), graph), F.lit(False))), t.certain)
        certain = set(t.certain)
        for n, e in items:
            if e is not None:
                t = Table(t.df.withColumn(n, self.expr(e, set(t.vars), graph).term()), certain)
                if e[0] == "col" and any(v[0] == e[1] and v[1][1] == "COUNT" for v in aggs.values()):
                    certain.add(n)
        names = [n for n, _ in items] or [v for v in t.vars if not v.startswith("__")]
        df = t.df
        for n in names:
            if n not in df.columns:
                df = df.withColumn(n, F.lit(None).cast("string"))
        keys = [T.sort_key(self.expr(e, set(t.vars), graph).term()) for e, _ in order]
        keys = [k.desc() if d else k.asc() for k, (_, d) in zip(keys, order)]
        if q["distinct"]:
            if order:
                df = df.select(*names, *[k.alias(f"__o{i}") for i, k in enumerate(T.sort_key(self.expr(e, set(t.vars), graph).term()) for e, _ in order)])
                df = df.dropDuplicates(names)
                keys = [F.col(f"__o{i}").desc() if d else F.col(f"__o{i}").asc() for i, (_, d) in enumerate(order)]
            else:
                df = df.select(*names).distinct()
        if order or q["limit"] is not None or q["offset"]:
            df = df.orderBy(*keys, *[F.col(n) for n in names])  # total, so that slices are the same at every run
        if q["offset"]:
            df = df.offset(q["offset"])
        if q["limit"] is not None:
            df = df.limit(q["limit"])
        return Table(df.select(*names), certain & set(names))

    def aggregate(self, e: tuple, scope, graph, df: DataFrame) -> Column:
        """SUM, AVG, MIN and MAX of a group with an error are unbound; COUNT skips errors; sums of nothing are 0."""
        _, name, distinct, arg, sep = e
        if arg is None:
            n = F.count_distinct(F.struct(*[F.col(v) for v in sorted(scope)])) if distinct else F.count(F.lit(1))
            return T.make_number(n, True)
        v = self.expr(arg, scope, graph)
        t = v.term()
        if name == "COUNT":
            return T.make_number(F.count_distinct(t) if distinct else F.count(t), True)
        if name in ("SUM", "AVG"):
            x = v.num()
            errors = F.count(F.when(x.isNull(), 1))
            ints = F.coalesce(F.min(v.is_int().cast("int")), F.lit(1)) == 1
            total = F.sum_distinct(x) if distinct else F.sum(x)
            if name == "SUM":
                return F.when(errors == 0, T.make_number(F.coalesce(total, F.lit(0.0)), ints))
            mean = (F.sum_distinct(x) / F.count_distinct(x)) if distinct else F.avg(x)
            return F.when(errors == 0, F.coalesce(T.make_number(mean, False), T.make_number(F.lit(0), True)))
        if name in ("MIN", "MAX"):
            best = (F.min_by if name == "MIN" else F.max_by)(t, T.sort_key(t))
            return F.when(F.count(F.when(t.isNull(), 1)) == 0, best)
        if name == "SAMPLE":
            return F.min(t)
        parts = F.collect_set(v.str_()) if distinct else F.collect_list(v.str_())
        return T.make_string(F.array_join(F.array_sort(parts), sep))


def _trigram(a: Column, b: Column) -> Column:
    from strataq.functions.text import trigram_similarity

    return trigram_similarity(a, b)


def _before(s: Column, x: Column) -> Column:
    at = F.call_function("locate", x, s)
    return F.when(at > 0, F.left(s, at - 1)).otherwise(F.lit(""))


def _after(s: Column, x: Column) -> Column:
    at = F.call_function("locate", x, s)
    return F.when(at > 0, F.substring(s, at + F.length(x), F.length(s))).otherwise(F.lit(""))


def _flags(c: Column) -> Column:
    return F.when(c == "", F.lit("")).otherwise(F.concat(F.lit("(?"), c, F.lit(")")))


def _tail(t: Column) -> Column:
    return F.coalesce(F.regexp_extract(t, '(@[A-Za-z0-9-]+)$', 1), F.lit(""))


def _compare(op: str, a: Val, b: Val) -> Column:
    if a.kind == "str" and b.kind == "term" or a.kind == "term" and b.kind == "str" or a.kind == b.kind == "str":
        x, y = a.str_(), b.str_()
        text = {"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
        if a.kind == b.kind:
            return text
        t = a.term() if a.kind == "term" else b.term()
        plain = T.is_literal(t) & (T.datatype(t) == XSD + "string")
        return F.when(plain, text).when(t.isNotNull(), F.lit(op == "!=") if op in ("=", "!=") else F.lit(None).cast("boolean"))
    x, y = a.num(), b.num()
    cmp = lambda p, q: {"=": p == q, "!=": p != q, "<": p < q, ">": p > q, "<=": p <= q, ">=": p >= q}[op]
    if a.kind == "num" or b.kind == "num":
        return cmp(x, y)
    if a.kind == "bool" or b.kind == "bool":
        return cmp(a.bool_(), b.bool_())
    s, t = a.term(), b.term()
    u, v = T.timestamp(s), T.timestamp(t)
    rest = cmp(s, t) if op in ("=", "!=") else F.when(T.is_literal(s) & T.is_literal(t) & (T.datatype(s) == T.datatype(t)), cmp(T.lexical(s), T.lexical(t)))
    return F.when(x.isNotNull() & y.isNotNull(), cmp(x, y)).when(u.isNotNull() & v.isNotNull(), cmp(u, v)).otherwise(rest)


def _cast(kind: str, v: Val) -> Val:
    s = F.coalesce(v.str_(), v.num().cast("string"))
    if kind == "string":
        return Val("str", s)
    if kind == "boolean":
        return Val("bool", F.when(F.lower(s).isin("true", "1"), True).when(F.lower(s).isin("false", "0"), False).when(s.try_cast("double").isNotNull(), s.try_cast("double") != 0))
    if kind in ("integer", "int", "long"):
        return Val("num", s.try_cast("double").cast("long"), True)
    if kind in ("decimal", "float", "double"):
        return Val("term", T.make_typed(s.try_cast("double").cast("string"), XSD + kind))
    if kind in ("dateTime", "date"):
        return Val("term", F.when(s.try_cast("timestamp").isNotNull(), T.make_typed(s, XSD + kind)))
    raise UnsupportedQueryError(f"cast to {kind}")


def _conjuncts(e):
    return _conjuncts(e[1]) + _conjuncts(e[2]) if e[0] == "and" else [e]


# ---- query forms
def run(quads: DataFrame, text: str):
    """SELECT: a solution table. ASK: bool. CONSTRUCT and DESCRIBE: triples (s, p, o)."""
    q = Parser(text).query()
    c = Compiler(quads, q["dataset"])
    if q["form"] == "select":
        return c.select(q).df
    star = {"items": [], "distinct": False, **{k: q[k] for k in ("group", "having", "order", "limit", "offset", "where")}}
    t = c.select(star) if q["form"] == "ask" else _all_vars(c, star)
    if q["form"] == "ask":
        return not c.eval(q["where"]).df.isEmpty()
    if q["form"] == "construct":
        return instantiate(t.df, q["template"]).select("s", "p", "o").distinct()
    wanted = []
    for x in q["terms"] or [("var", v) for v in t.vars]:
        wanted.append(c.spark.createDataFrame([(x[1],)], "t string") if x[0] == "term" else t.df.select(F.col(x[1]).alias("t")))
    every = wanted[0]
    for w in wanted[1:]:
        every = every.union(w)
    every = every.distinct()
    base = c.active(None).select("s", "p", "o")
    a = base.join(every.withColumnRenamed("t", "s"), "s", "left_semi")
    b = base.join(every.withColumnRenamed("t", "o"), "o", "left_semi").select("s", "p", "o")
    return a.union(b).distinct()


def _all_vars(c: Compiler, q: dict) -> Table:
    t = c.eval(q["where"])
    return t if q["limit"] is None and not q["offset"] else c.select({**q, "items": [(v, None) for v in t.vars]})


def instantiate(df: DataFrame, template: list) -> DataFrame:
    """(g, s, p, o) for every solution and template triple that is complete and well formed; blank nodes are fresh per solution."""
    df = df.withColumn("__row", F.monotonically_increasing_id().cast("string"))

    def col(x) -> Column:
        if x[0] == "term":
            return F.lit(x[1])
        if x[0] == "triple":
            return F.concat(F.lit("<<( "), col(x[1]), F.lit(" "), col(x[2]), F.lit(" "), col(x[3]), F.lit(" )>>"))
        if x[1] in df.columns:
            return F.col(x[1])
        return F.concat(F.lit(f"_:{x[1].strip('_')}x"), F.col("__row")) if x[1].startswith("__") else F.lit(None).cast("string")

    rows = F.array(*[F.struct((col(t[3]) if len(t) > 3 else F.lit(None).cast("string")).alias("g"), col(t[0]).alias("s"), col(t[1]).alias("p"), col(t[2]).alias("o"),
                              F.lit(len(t) > 3).alias("named")) for t in template])
    out = df.select(F.explode(rows).alias("t")).select("t.*")
    return out.where(F.col("s").isNotNull() & T.is_iri(F.col("p")) & F.col("o").isNotNull() & ~T.is_literal(F.col("s")) & (~F.col("named") | F.col("g").isNotNull())).drop("named")


# ---- updates: quads -> quads
def update(quads: DataFrame, text: str, load: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """Apply update operations in order; the result is a new quads table (a set)."""
    order = ["g", "s", "p", "o"]
    quads = quads.select(*order).distinct()

    def minus(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(*[F.col(c).alias(f"__{c}") for c in order]).distinct()
        return a.join(b, F.col("g").eqNullSafe(F.col("__g")) & (F.col("s") == F.col("__s")) & (F.col("p") == F.col("__p")) & (F.col("o") == F.col("__o")), "left_anti")

    def of(ref) -> Column:
        if ref[0] == "which":
            return {"DEFAULT": F.col("g").isNull(), "NAMED": F.col("g").isNotNull(), "ALL": F.lit(True)}[ref[1]]
        return F.coalesce(F.col("g") == ref[1], F.lit(False))

    def name(ref) -> Column:
        return F.lit(None).cast("string") if ref[0] == "which" else F.lit(ref[1])

    for op in Parser(text).update():
        spark = quads.sparkSession
        if op[0] in ("insert", "delete"):
            rows = instantiate(spark.range(1).select(), op[1]).select(*order)
            quads = quads.union(rows).distinct() if op[0] == "insert" else minus(quads, rows)
        elif op[0] == "modify":
            t = Compiler(quads).eval(op[3]).df
            new = cut(instantiate(t, op[2]).select(*order)) if op[2] else None
            if op[1]:
                quads = minus(quads, instantiate(t, op[1]).select(*order))
            if new is not None:
                quads = quads.union(new).distinct()
        elif op[0] in ("clear", "drop"):
            quads = quads.where(~of(op[1]))
        elif op[0] in ("add", "copy", "move"):
            moved = quads.where(of(op[1])).withColumn("g", name(op[2]))
            rest = quads if op[0] == "add" else quads.where(~of(op[2])) if op[0] == "copy" else quads.where(~of(op[2]) & ~of(op[1]))
            quads = rest.union(moved).distinct()
        elif op[0] == "load":
            if load is None:
                raise UnsupportedQueryError("LOAD needs a loader")
            rows = load(op[1]).select("s", "p", "o").withColumn("g", name(op[2] or ("which", "DEFAULT"))).select(*order)
            quads = quads.union(rows).distinct()
    return quads


class Pattern:
    """A builder over the same algebra: Pattern().where("?s", "<p>", "?o").optional(...).filter("?x > 3").select("?s")."""

    def __init__(self, tree: tuple = ("bgp", []), prefixes: dict | None = None):
        self.tree, self.prefixes = tree, prefixes or {}

    def _parse(self, text: str, rule: str):
        p = Parser(text)
        p.prefixes = dict(self.prefixes)
        return getattr(p, rule)()

    def _with(self, tree) -> Pattern:
        return Pattern(tree, self.prefixes)

    def where(self, s: str, p: str, o: str) -> Pattern:
        t = (self._parse(s, "term"), self._parse(p, "path") if not p.startswith("?") else ("var", p[1:]), self._parse(o, "term"))
        return self._with(("bgp", self.tree[1] + [t]) if self.tree[0] == "bgp" else ("join", self.tree, ("bgp", [t])))

    where_path = where

    def optional(self, other: Pattern) -> Pattern:
        return self._with(("left", self.tree, other.tree, None))

    def union(self, other: Pattern) -> Pattern:
        return self._with(("union", self.tree, other.tree))

    def minus(self, other: Pattern) -> Pattern:
        return self._with(("minus", self.tree, other.tree))

    def filter(self, text: str) -> Pattern:
        return self._with(("filter", self._parse(text, "expr"), self.tree))

    def bind(self, var: str, text: str) -> Pattern:
        return self._with(("extend", var.lstrip("?"), self._parse(text, "expr"), self.tree))

    def values(self, var: str, items: list[str]) -> Pattern:
        return self._with(("join", self.tree, ("values", [var.lstrip("?")], [[self._parse(i, "term")[1]] for i in items])))

    def graph(self, name: str) -> Pattern:
        return self._with(("graph", self._parse(name, "term"), self.tree))

    def run(self, quads: DataFrame, *items: str, distinct: bool = False, group: list[str] | None = None, having: str | None = None, order: list[tuple[str, bool]] = (),
            limit: int | None = None, offset: int | None = None) -> DataFrame:
        """items: "?v" or "expression AS ?v"."""
        got = []
        for it in items:
            e, _, v = it.partition(" AS ")
            got.append((v.strip().lstrip("?"), self._parse(e, "expr")) if v else (it.lstrip("?"), None))
        q = {"form": "select", "distinct": distinct, "items": got, "where": self.tree, "group": [(g.lstrip("?"), None) for g in group] if group is not None else None,
             "having": [self._parse(having, "expr")] if having else [], "order": [(self._parse(o, "expr"), d) for o, d in order], "limit": limit, "offset": offset}
        return Compiler(quads).select(q).df
