"""Property graphs over tables: CREATE/DROP PROPERTY GRAPH and GRAPH_TABLE(g, MATCH ... WHERE ... COLUMNS ...), as chains of joins."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.errors import UnsupportedQueryError
from strataq.plans.spread import spread_join


@dataclass
class Vertex:
    name: str
    table: str
    key: list[str]
    labels: set[str]


@dataclass
class Edge:
    name: str
    table: str
    src: tuple[str, str]  # column, vertex name
    dst: tuple[str, str]
    labels: set[str]
    properties: list[str] | None = None  # None: all columns


@dataclass
class PropertyGraph:
    """Vertices and edges are views of tables; nothing is copied. Vertex ids are the key columns' text."""

    name: str
    vertices: dict[str, Vertex] = field(default_factory=dict)
    edges: list[Edge] = field(default_factory=list)

    def edge_frame(self, load, labels: set[str] | None, props: set[str]) -> DataFrame:
        parts = []
        for e in self.edges:
            if labels and not labels & e.labels:
                continue
            df = load(e.table)
            cols = [F.col(p).cast("string").alias(f"p_{p}") if p in df.columns and (e.properties is None or p in e.properties) else F.lit(None).cast("string").alias(f"p_{p}") for p in sorted(props)]
            for label in sorted(e.labels if not labels else e.labels & labels)[:1]:
                parts.append(df.select(F.col(e.src[0]).alias("src"), F.col(e.dst[0]).alias("dst"), F.lit(label).alias("label"), *cols))
        if not parts:
            raise UnsupportedQueryError("no edge table has the label")
        return reduce(lambda a, b: a.unionByName(b), parts)


# ---- label expressions: a | b, a & b, parentheses
def label_matches(expr: str, labels: set[str]) -> bool:
    toks, at = re.findall(r"\w+|[|&()]", expr), 0

    def alt():
        nonlocal at
        v = seq()
        while at < len(toks) and toks[at] == "|":
            at += 1
            v = seq() or v
        return v

    def seq():
        nonlocal at
        v = one()
        while at < len(toks) and toks[at] == "&":
            at += 1
            v = one() and v
        return v

    def one():
        nonlocal at
        t = toks[at]
        at += 1
        if t == "(":
            v = alt()
            at += 1
            return v
        return t in labels

    return alt()


def _balanced(text: str, at: int) -> int:
    """Position after the parenthesis that closes the one at `at`; quoted text is skipped."""
    depth, quote = 0, None
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return i + 1
    raise UnsupportedQueryError("unbalanced parentheses")


def _split(text: str) -> list[str]:
    out, depth, quote, cur = [], 0, None, ""
    for c in text:
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        if c == "," and not depth and not quote:
            out.append(cur)
            cur = ""
        else:
            cur += c
    return [x.strip() for x in [*out, cur] if x.strip()]


def create_graph(text: str) -> PropertyGraph:
    m = re.match(r"(?is)\s*CREATE\s+PROPERTY\s+GRAPH\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)\s+VERTEX\s+TABLES\s*", text)
    if not m:
        raise UnsupportedQueryError("CREATE PROPERTY GRAPH")
    end = _balanced(text, m.end())
    g = PropertyGraph(m[1])
    for item in _split(text[m.end() + 1: end - 1]):
        v = re.match(r"(?is)(\w+)(?:\s+AS\s+(\w+))?\s+KEY\s*\(([^)]*)\)(?:\s+LABEL\s+([\w|&() ]+?))?(?:\s+(?:NO\s+)?PROPERTIES.*)?$", item)
        if not v:
            raise UnsupportedQueryError(item)
        name = v[2] or v[1]
        g.vertices[name] = Vertex(name, v[1], [k.strip() for k in v[3].split(",")], set(re.findall(r"\w+", v[4] or name)))
    m = re.match(r"(?is)\s*EDGE\s+TABLES\s*", text[end:])
    if m and m.end():
        at = end + m.end()
        for item in _split(text[at + 1: _balanced(text, at) - 1]):
            e = re.match(r"(?is)(\w+)(?:\s+AS\s+(\w+))?\s+(?:KEY\s*\([^)]*\)\s+)?SOURCE\s+KEY\s*\(\s*(\w+)\s*\)\s+REFERENCES\s+(\w+)\s*\([^)]*\)\s+DESTINATION\s+KEY\s*\(\s*(\w+)\s*\)\s+REFERENCES\s+(\w+)\s*\([^)]*\)"
                         r"(?:\s+LABEL\s+([\w|&() ]+?))?(?:\s+(NO\s+PROPERTIES|PROPERTIES.*))?$", item)
            if not e:
                raise UnsupportedQueryError(item)
            props = None
            if e[8]:
                p = re.search(r"\(([^)]*)\)\s*$", e[8])
                props = [] if e[8].upper().startswith("NO") else None if re.match(r"(?i)PROPERTIES\s+ALL", e[8]) else [x.strip() for x in p[1].split(",")] if p else None
            g.edges.append(Edge(e[2] or e[1], e[1], (e[3], e[4]), (e[5], e[6]), set(re.findall(r"\w+", e[7] or e[2] or e[1])), props))
    return g


# ---- MATCH
_NODE = re.compile(r"\(\s*(\w+)?\s*(?::\s*([\w|&]+))?\s*(\{[^}]*\})?\s*\)")
_EDGE = re.compile(r"(<)?-(?:\[\s*(\w+)?\s*(?::\s*([\w|]+))?\s*(\{[^}]*\})?\s*\](?:\{(\d+),(\d+)\}|\{(\d+)\})?)?-?(>)?")


def parse_path(text: str) -> dict:
    m = re.match(r"(?is)\s*(?:(\w+)\s*=\s*)?(?:(WALK|TRAIL|ACYCLIC|SIMPLE)\b|((?:ALL|ANY)\s+SHORTEST|SHORTEST(?:\s+ALL)?)(?:\s+PATH)?\b)?\s*", text)
    out = {"name": m[1], "mode": (m[2] or "walk").lower(), "shortest": bool(m[3]), "all": bool(m[3] and "ALL" in m[3].upper()), "nodes": [], "edges": []}
    at = m.end()
    while True:
        n = _NODE.match(text, at)
        if not n:
            raise UnsupportedQueryError(f"MATCH: {text[at: at + 30]!r}")
        out["nodes"].append({"var": n[1], "label": n[2], "props": _props(n[3])})
        at = n.end()
        e = _EDGE.match(text, at) if text[at:].strip() else None
        if not e or not e.group().strip():
            space = len(text[at:]) - len(text[at:].lstrip())
            e = _EDGE.match(text, at + space) if text[at:].strip() else None
            if not e or not e.group():
                return out
        way = "any" if bool(e[1]) == bool(e[8]) else "in" if e[1] else "out"
        low, high = (int(e[5]), int(e[6])) if e[5] else (int(e[7]), int(e[7])) if e[7] else (1, 1)
        out["edges"].append({"var": e[2], "labels": set(e[3].split("|")) if e[3] else None, "props": _props(e[4]), "way": way, "low": low, "high": high})
        at = e.end()
        at += len(text[at:]) - len(text[at:].lstrip())


def _props(text: str | None) -> dict[str, str]:
    if not text:
        return {}
    out = {}
    for item in _split(text[1:-1]):
        k, v = item.split(":", 1)
        out[k.strip()] = v.strip().strip("'")
    return out


def match(load, graph: PropertyGraph, paths: list[dict], props: dict[str, set[str]], order: list[str] | None = None) -> DataFrame:
    """Rows of named bindings: v__id for nodes, e__label and e__<property> for edges. Bag semantics; anonymous elements are hidden
    variables of their own. Repeated variables agree. Path modes hold within a path; quantified edges are unrolled."""
    total, hidden = None, 0
    for path in paths:
        nodes = []
        for n in path["nodes"]:
            hidden += n["var"] is None
            nodes.append(n["var"] or f"_n{hidden}")
        cur, ids, steps = None, [f"{nodes[0]}__id"], []
        for i, e in enumerate(path["edges"]):
            if (e["low"], e["high"]) != (1, 1):
                variants = []
                for k in range(e["low"], e["high"] + 1):
                    alone = {"nodes": [path["nodes"][i]] + [{"var": None, "label": None, "props": {}} for _ in range(k - 1)] + [path["nodes"][i + 1]],
                             "edges": [{**e, "var": None, "low": 1, "high": 1}] * k, "mode": path["mode"], "shortest": False, "all": False, "name": None}
                    a, b = f"{nodes[i]}__id", f"{nodes[i + 1]}__id"
                    if path["nodes"][i]["var"] is None or path["nodes"][i + 1]["var"] is None:
                        alone["nodes"][0], alone["nodes"][-1] = {**alone["nodes"][0], "var": nodes[i]}, {**alone["nodes"][-1], "var": nodes[i + 1]}
                    variants.append(match(load, graph, [alone], {}).select(a, b, F.lit(k).alias(f"_len{i}")))
                step = reduce(lambda x, y: x.union(y), variants)
                if path["shortest"]:
                    ends = [f"{nodes[i]}__id", f"{nodes[i + 1]}__id"]
                    low = step.groupBy(*ends).agg(F.min(f"_len{i}").alias("_min"))
                    step = step.join(low, ends).where(F.col(f"_len{i}") == F.col("_min")).drop("_min")
                    if not path["all"]:
                        step = step.dropDuplicates(ends)
                step = step.drop(f"_len{i}")
            else:
                var = e["var"]
                want = set(props.get(var, set())) | set(e["props"])
                df = graph.edge_frame(load, e["labels"], want)
                for k, v in e["props"].items():
                    df = df.where(F.col(f"p_{k}") == v)
                a, b = f"{nodes[i]}__id", f"{nodes[i + 1]}__id"
                tail = [F.col("label").alias(f"{var}__label")] if var else []
                tail += [F.col(f"p_{p}").alias(f"{var}__{p}") for p in sorted(props.get(var, set()))] if var else []
                key = f"_e{i}_{len(ids)}_{hidden}"
                fwd = df.select(F.col("src").alias(a), F.col("dst").alias(b), *tail, F.struct("src", "dst", "label").alias(key)) if a != b else df.where("src = dst").select(F.col("src").alias(a), *tail, F.struct("src", "dst", "label").alias(key))
                if e["way"] == "out":
                    step = fwd
                else:
                    back = df.select(F.col("dst").alias(a), F.col("src").alias(b), *tail, F.struct("src", "dst", "label").alias(key)) if a != b else fwd
                    step = back if e["way"] == "in" else fwd.union(back)
                steps.append(key)
                if path["mode"] != "trail":
                    step = step.drop(key)
            for side, n in ((f"{nodes[i]}__id", path["nodes"][i]), (f"{nodes[i + 1]}__id", path["nodes"][i + 1])):
                for k, v in n["props"].items():
                    if k != "id":
                        raise UnsupportedQueryError("nodes are matched by id only")
                    step = step.where(F.col(side).cast("string") == v)
            cur = step if cur is None else cur.join(step, [c for c in cur.columns if c in step.columns])
            ids.append(f"{nodes[i + 1]}__id")
        distinct_ids = list(dict.fromkeys(ids))
        if path["mode"] == "acyclic" and len(distinct_ids) > 1:
            cur = cur.where(F.size(F.array_distinct(F.array(*[F.col(c).cast("string") for c in distinct_ids]))) == len(distinct_ids)) if len(distinct_ids) == len(ids) else cur.limit(0)
        if path["mode"] == "simple" and len(ids) > 2:
            inner = list(dict.fromkeys(ids[:-1]))
            cur = cur.where(F.size(F.array_distinct(F.array(*[F.col(c).cast("string") for c in inner]))) == len(ids) - 1)
            for c in inner[1:]:
                cur = cur.where(F.col(c) != F.col(ids[-1]))
        if path["mode"] == "trail" and steps:
            cur = cur.where(F.size(F.array_distinct(F.array(*steps))) == len(steps)).drop(*steps)
        total = cur if total is None else spread_join(total, cur, [c for c in total.columns if c in cur.columns]) if set(total.columns) & set(cur.columns) else total.crossJoin(cur)
    return total


def graph_table(engine, body: str) -> DataFrame:
    m = re.match(r"(?is)\s*(\w+)\s*,?\s*MATCH\s+", body)
    if not m or m[1] not in engine.catalog.graphs:
        raise UnsupportedQueryError("GRAPH_TABLE: unknown graph")
    graph, rest = engine.catalog.graphs[m[1]], body[m.end():]
    cols = re.search(r"(?is)\bCOLUMNS\s*\(", rest)
    columns = rest[cols.end(): _balanced(rest, cols.end() - 1) - 1] if cols else None
    rest = rest[: cols.start()] if cols else rest
    w = re.search(r"(?is)\bWHERE\b", rest)
    where = rest[w.end():].strip() if w else None
    paths = [parse_path(p) for p in _split(rest[: w.start()] if w else rest)]
    edge_vars = {e["var"] for p in paths for e in p["edges"] if e["var"]}
    refs = re.findall(r"\b(\w+)\.(\w+)\b", f"{columns or ''} {where or ''}")
    props = {v: {p for x, p in refs if x == v and p != "label"} for v in edge_vars}
    df = match(engine.catalog.load, graph, paths, props)
    fix = lambda t: re.sub(r"\b(\w+)\.(\w+)\b", r"\1__\2", t)
    if where:
        df = df.where(f"coalesce(({fix(where)}), false)")
    if columns:
        return df.selectExpr(*[fix(c) for c in _split(columns)])
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def rewrite_graph_sql(engine, text: str) -> str | None:
    """Graph DDL is executed (None); GRAPH_TABLE(...) and SPARQL('view', 'query') become temporary views in the text."""
    if re.match(r"(?is)\s*CREATE\s+PROPERTY\s+GRAPH", text):
        g = create_graph(text)
        if g.name in engine.catalog.graphs and not re.search(r"(?i)IF\s+NOT\s+EXISTS", text):
            raise UnsupportedQueryError(f"graph {g.name} exists")
        engine.catalog.graphs.setdefault(g.name, g)
        return None
    m = re.match(r"(?is)\s*DROP\s+PROPERTY\s+GRAPH\s+(?:IF\s+EXISTS\s+)?(\w+)", text)
    if m:
        engine.catalog.graphs.pop(m[1], None)
        return None
    while m := re.search(r"(?is)\bGRAPH_TABLE\s*\(", text):
        end = _balanced(text, m.end() - 1)
        name = f"gt_{uuid.uuid4().hex[:12]}"
        graph_table(engine, text[m.end(): end - 1]).createOrReplaceTempView(name)
        text = text[: m.start()] + name + text[end:]
    while m := re.search(r"(?is)\bSPARQL\s*\(\s*(\w+)\s*,\s*'((?:[^']|'')*)'\s*\)", text):
        name = f"sp_{uuid.uuid4().hex[:12]}"
        engine.sparql(m[2].replace("''", "'"), engine.spark.table(m[1])).createOrReplaceTempView(name)
        first = engine.spark.table(name).columns[0]
        text = text[: m.start()] + f"SELECT `{first}` FROM {name}" + text[m.end():]
    return text


class MatchBuilder:
    """MatchBuilder().node("a", id=1).out("KNOWS", "e").node("b") -> path text for GRAPH_TABLE."""

    def __init__(self, text: str = ""):
        self.text = text

    def node(self, var: str = "", label: str | None = None, **props) -> MatchBuilder:
        return MatchBuilder(self.text + f"({var}{':' + label if label else ''}{self._p(props)})")

    def _e(self, left: str, right: str, labels, var, times, props) -> MatchBuilder:
        label = ":" + (labels if isinstance(labels, str) else "|".join(labels)) if labels else ""
        count = "" if times is None else "{%d,%d}" % times
        return MatchBuilder(self.text + f"{left}[{var}{label}{self._p(props)}]{count}{right}")

    def out(self, labels=None, var: str = "", times: tuple[int, int] | None = None, **props) -> MatchBuilder:
        return self._e("-", "->", labels, var, times, props)

    def incoming(self, labels=None, var: str = "", times: tuple[int, int] | None = None, **props) -> MatchBuilder:
        return self._e("<-", "-", labels, var, times, props)

    def undirected(self, labels=None, var: str = "", times: tuple[int, int] | None = None, **props) -> MatchBuilder:
        return self._e("-", "-", labels, var, times, props)

    @staticmethod
    def _p(props) -> str:
        return " {" + ", ".join(f"{k}: '{v}'" for k, v in props.items()) + "}" if props else ""
