"""SHACL: each constraint is a frame of violations (focus, path, constraint, value); a report is their union."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.errors import UnsupportedQueryError
from strataq.reason.rules import SUBCLASS, TYPE, Facts, hierarchy
from strataq.sparql import terms as T


@dataclass
class Shape:
    """targets: {"class": iri, "node": [terms], "subjects_of": p, "objects_of": p}; constraints on the focus node itself;
    properties: path -> constraints. Logical parts (not, and, or, xone, node, qualified) hold shapes."""

    targets: dict = field(default_factory=dict)
    constraints: dict = field(default_factory=dict)
    properties: dict = field(default_factory=dict)


def targets(t: DataFrame, shape: Shape) -> DataFrame:
    """Focus nodes (focus); a class target covers subclasses."""
    f, parts = Facts(t), []
    for k, v in shape.targets.items():
        if k == "class":
            sub = hierarchy(t).where(F.col("dst") == v).select(F.col("src").alias("c")) if not f.p(SUBCLASS).isEmpty() else None
            own = t.where((F.col("p") == TYPE) & (F.col("o") == v)).select(F.col("s").alias("focus"))
            parts.append(own)
            if sub is not None:
                parts.append(f.type_("focus", "c").join(sub, "c", "left_semi").select("focus"))
        elif k == "node":
            parts.append(t.sparkSession.createDataFrame([(x,) for x in v], "focus string"))
        elif k == "subjects_of":
            parts.append(t.where(F.col("p") == v).select(F.col("s").alias("focus")))
        elif k == "objects_of":
            parts.append(t.where(F.col("p") == v).select(F.col("o").alias("focus")))
        else:
            raise UnsupportedQueryError(k)
    return reduce(lambda a, b: a.union(b), parts).distinct()


def _kind(v: Column, kinds: str) -> Column:
    out = F.lit(False)
    for name, test in (("IRI", T.is_iri), ("BlankNode", T.is_blank), ("Literal", T.is_literal)):
        if name in kinds:
            out = out | test(v)
    return out


def well_typed(v: Column, datatype: str) -> Column:
    """The datatype, and a text that is in its value space."""
    s, x = T.lexical(v), T.XSD
    checks = {x + "integer": s.rlike(r"^[+-]?\d+$"), x + "decimal": s.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), x + "double": s.rlike(r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)$"),
              x + "boolean": s.isin("true", "false", "0", "1"), x + "dateTime": s.try_cast("timestamp").isNotNull() & s.rlike("T"), x + "date": s.try_cast("date").isNotNull() & ~s.rlike("T")}
    return F.coalesce((T.datatype(v) == datatype) & checks.get(datatype, F.lit(True)), F.lit(False))


def _value_tests(c: dict) -> list[tuple[str, Column]]:
    """(name, violation) over column value."""
    v, out = F.col("value"), []
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    for k, x in c.items():
        if k == "datatype":
            out.append((k, ~well_typed(v, x)))
        elif k == "nodeKind":
            out.append((k, ~_kind(v, x)))
        elif k in ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive"):
            n = T.number(v)
            out.append((k, bad({"minInclusive": n >= x, "maxInclusive": n <= x, "minExclusive": n > x, "maxExclusive": n < x}[k])))
        elif k == "minLength":
            out.append((k, bad(F.length(T.lexical(v)) >= x)))
        elif k == "maxLength":
            out.append((k, bad(F.length(T.lexical(v)) <= x)))
        elif k == "pattern":
            out.append((k, bad(T.lexical(v).rlike(x))))
        elif k == "languageIn":
            l, ok = F.lower(T.lang(v)), F.lit(False)
            for tag in x:
                ok = ok | (l == tag.lower()) | l.startswith(tag.lower() + "-")
            out.append((k, bad(ok)))
        elif k == "in":
            out.append((k, ~v.isin(*x)))
    return out


def _report(df: DataFrame, path: str | None, name: str, value: str | None = "value") -> DataFrame:
    return df.select("focus", F.lit(path).cast("string").alias("path"), F.lit(name).alias("constraint"), (F.col(value) if value else F.lit(None)).cast("string").alias("value"))


def _constraints(t: DataFrame, focus: DataFrame, values: DataFrame, path: str | None, c: dict) -> list[DataFrame]:
    """values: (focus, value), one row a value; focus: all focus nodes."""
    out = []
    tests = _value_tests(c)
    if tests:  # one pass over the values for all simple tests
        names = F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in tests]))
        hit = values.select("focus", "value", F.explode(names).alias("constraint"))
        out.append(hit.select("focus", F.lit(path).cast("string").alias("path"), "constraint", "value"))
    counted = focus.join(values.groupBy("focus").agg(F.count(F.lit(1)).alias("n")), "focus", "left").select("focus", F.coalesce("n", F.lit(0)).alias("n"))
    for k, x in c.items():
        if k == "minCount":
            out.append(_report(counted.where(F.col("n") < x), path, k, None))
        elif k == "maxCount":
            out.append(_report(counted.where(F.col("n") > x), path, k, None))
        elif k == "class":
            ok = targets(t, Shape({"class": x})).withColumnRenamed("focus", "value")
            out.append(_report(values.join(ok, "value", "left_anti"), path, k))
        elif k == "hasValue":
            out.append(_report(focus.join(values.where(F.col("value") == x), "focus", "left_anti"), path, k, None))
        elif k == "uniqueLang" and x:
            out.append(_report(values.withColumn("l", T.lang(F.col("value"))).where("l <> ''").groupBy("focus", "l").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), path, k, None))
        elif k in ("equals", "disjoint", "lessThan", "lessThanOrEquals"):
            other = t.where(F.col("p") == x).select(F.col("s").alias("focus"), F.col("o").alias("other"))
            if k == "equals":
                a = values.join(other.withColumnRenamed("other", "value"), ["focus", "value"], "left_anti")
                b = focus.join(other, "focus").withColumnRenamed("other", "value").join(values, ["focus", "value"], "left_anti")
                out.append(_report(a.unionByName(b), path, k))
            elif k == "disjoint":
                out.append(_report(values.join(other.withColumnRenamed("other", "value"), ["focus", "value"], "left_semi"), path, k))
            else:
                a, b = F.col("value"), F.col("other")
                num, txt = (T.number(a), T.number(b)), (T.lexical(a), T.lexical(b))
                test = lambda p, q: p < q if k == "lessThan" else p <= q
                ok = F.coalesce(test(*num), test(*txt), F.lit(False))
                out.append(_report(values.join(other, "focus").where(~ok), path, k))
        elif k == "not":
            bad = conforming(t, values.select(F.col("value").alias("focus")).distinct(), x)
            out.append(_report(values.join(bad.withColumnRenamed("focus", "value"), "value", "left_semi"), path, k))
        elif k in ("and", "or", "xone", "node"):
            shapes = [x] if k == "node" else x
            nodes = values.select(F.col("value").alias("focus")).distinct()
            hits = reduce(lambda a, b: a.union(b), [conforming(t, nodes, s).withColumn("k", F.lit(i)) for i, s in enumerate(shapes)]).groupBy("focus").agg(F.count(F.lit(1)).alias("n"))
            want = {"and": F.col("n") == len(shapes), "node": F.col("n") == 1, "or": F.col("n") >= 1, "xone": F.col("n") == 1}[k]
            out.append(_report(values.join(hits.where(want).select(F.col("focus").alias("value")), "value", "left_anti"), path, k))
        elif k == "qualified":
            ok = conforming(t, values.select(F.col("value").alias("focus")).distinct(), x["shape"]).withColumnRenamed("focus", "value")
            n = focus.join(values.join(ok, "value", "left_semi").groupBy("focus").agg(F.count(F.lit(1)).alias("n")), "focus", "left").withColumn("n", F.coalesce("n", F.lit(0)))
            out.append(_report(n.where((F.col("n") < x.get("min", 0)) | (F.col("n") > x.get("max", 2**62))), path, k, None))
    return out


def validate(t: DataFrame, shape: Shape, focus: DataFrame | None = None) -> DataFrame:
    """(focus, path, constraint, value) of every violation. A path is a predicate IRI, or ^ and one for its inverse."""
    t = t.select("s", "p", "o")
    focus = targets(t, shape) if focus is None else focus
    own = {k: v for k, v in shape.constraints.items() if k not in ("closed", "ignored")}
    parts = _constraints(t, focus, focus.withColumn("value", F.col("focus")), None, own) if own else []
    for path, c in shape.properties.items():
        p, a, b = (path[1:], "o", "s") if path.startswith("^") else (path, "s", "o")
        values = t.where(F.col("p") == p).select(F.col(a).alias("focus"), F.col(b).alias("value")).distinct().join(focus, "focus", "left_semi")
        parts += _constraints(t, focus, values, path, c)
    if shape.constraints.get("closed"):
        allowed = [p for p in shape.properties if not p.startswith("^")] + list(shape.constraints.get("ignored", [TYPE]))
        extra = t.join(focus, t["s"] == focus["focus"]).where(~F.col("p").isin(*allowed))
        parts.append(extra.select("focus", F.col("p").alias("path"), F.lit("closed").alias("constraint"), F.col("o").alias("value")))
    empty = focus.select("focus", F.lit(None).cast("string").alias("path"), F.lit("").alias("constraint"), F.lit(None).cast("string").alias("value")).limit(0)
    return reduce(lambda a, b: a.unionByName(b), parts, empty)


def conforming(t: DataFrame, nodes: DataFrame, shape: Shape) -> DataFrame:
    return nodes.join(validate(t, shape, nodes).select("focus").distinct(), "focus", "left_anti")
