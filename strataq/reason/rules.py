"""Entailment: RDFS and OWL 2 RL rules as joins, semi-naive per round; sameAs classes; consistency checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.graph.algorithms import closure, components
from strataq.plans.lineage import cut

RDF, RDFS, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"


def iri(x: str) -> str:
    return f"<{x}>"


TYPE, SUBCLASS, SUBPROP, DOMAIN, RANGE = iri(RDF + "type"), iri(RDFS + "subClassOf"), iri(RDFS + "subPropertyOf"), iri(RDFS + "domain"), iri(RDFS + "range")
FIRST, REST, NIL = iri(RDF + "first"), iri(RDF + "rest"), iri(RDF + "nil")


def owl(x: str) -> str:
    return iri(OWL + x)


class Facts:
    """Triples (s, p, o) and shorthands for rule bodies."""

    def __init__(self, t: DataFrame):
        self.t = t

    def p(self, pred: str, s: str = "s", o: str = "o") -> DataFrame:
        return self.t.where(F.col("p") == pred).select(F.col("s").alias(s), F.col("o").alias(o))

    def types(self, cls: str, s: str) -> DataFrame:
        return self.t.where((F.col("p") == TYPE) & (F.col("o") == cls)).select(F.col("s").alias(s))

    def type_(self, s: str, c: str) -> DataFrame:
        return self.p(TYPE, s, c)

    def spo(self, s: str, p: str, o: str) -> DataFrame:
        return self.t.select(F.col("s").alias(s), F.col("p").alias(p), F.col("o").alias(o))


def _head(df: DataFrame, s, p, o) -> DataFrame:
    c = lambda x: F.lit(x) if x.startswith("<") else F.col(x)
    return df.select(c(s).alias("s"), c(p).alias("p"), c(o).alias("o"))


def members(t: DataFrame) -> DataFrame:
    """(list, item, pos) of RDF lists, by walking rest links."""
    f = Facts(t)
    first, rest = f.p(FIRST, "node", "item"), f.p(REST, "node", "next")
    heads = f.p(REST, "x", "node").select("node").distinct()
    cur = cut(first.select("node").distinct().join(heads, "node", "left_anti").select(F.col("node").alias("list"), "node"))
    out, k = None, 0
    while not cur.isEmpty():
        part = cur.join(first, "node").select("list", "item", F.lit(k).alias("pos"))
        out = part if out is None else out.union(part)
        cur, k = cut(cur.join(rest, "node").select("list", F.col("next").alias("node")).where(F.col("node") != NIL)), k + 1
    return out if out is not None else t.select(F.col("s").alias("list"), F.col("o").alias("item"), F.lit(0).alias("pos")).limit(0)


def _chain(f: Facts, lists: DataFrame) -> DataFrame | None:
    c = f.p(owl("propertyChainAxiom"), "p", "list").join(lists, "list")
    longest = c.agg(F.max("pos")).first()[0]
    if longest is None:
        return None
    cur = c.where("pos = 0").join(f.spo("a", "item", "b"), "item").select("p", "list", "a", "b", F.lit(0).alias("pos"))
    sizes = c.groupBy("p", "list").agg(F.max("pos").alias("last"))
    out = []
    for k in range(1, longest + 1):
        cur = cur.join(c.where(F.col("pos") == k).select("p", "list", "item"), ["p", "list"]).join(f.spo("b", "item", "z"), ["b", "item"]).select("p", "list", "a", F.col("z").alias("b"), F.lit(k).alias("pos"))
        out.append(cur.join(sizes, ["p", "list"]).where("pos = last").select("p", "a", "b"))
    return _head(reduce(lambda x, y: x.union(y), out), "a", "p", "b") if out else None


#: Rule name -> body and head over (facts, list members).
RULES = {
    # semantics of properties
    "prp-dom": lambda f, ls: _head(f.p(DOMAIN, "p", "c").join(f.spo("x", "p", "y"), "p"), "x", TYPE, "c"),
    "prp-rng": lambda f, ls: _head(f.p(RANGE, "p", "c").join(f.spo("x", "p", "y"), "p").where(~F.startswith("y", F.lit('"'))), "y", TYPE, "c"),
    "prp-fp": lambda f, ls: _head(f.types(owl("FunctionalProperty"), "p").join(f.spo("x", "p", "y"), "p").join(f.spo("x", "p", "z"), ["p", "x"]).where("y <> z"), "y", owl("sameAs"), "z"),
    "prp-ifp": lambda f, ls: _head(f.types(owl("InverseFunctionalProperty"), "p").join(f.spo("x", "p", "y"), "p").join(f.spo("z", "p", "y"), ["p", "y"]).where("x <> z"), "x", owl("sameAs"), "z"),
    "prp-symp": lambda f, ls: _head(f.types(owl("SymmetricProperty"), "p").join(f.spo("x", "p", "y"), "p"), "y", "p", "x"),
    "prp-trp": lambda f, ls: _head(f.types(owl("TransitiveProperty"), "p").join(f.spo("x", "p", "y"), "p").join(f.spo("y", "p", "z"), ["p", "y"]), "x", "p", "z"),
    "prp-spo1": lambda f, ls: _head(f.p(SUBPROP, "p", "q").join(f.spo("x", "p", "y"), "p"), "x", "q", "y"),
    "prp-spo2": lambda f, ls: _chain(f, ls),
    "prp-eqp1": lambda f, ls: _head(f.p(owl("equivalentProperty"), "p", "q").join(f.spo("x", "p", "y"), "p"), "x", "q", "y"),
    "prp-eqp2": lambda f, ls: _head(f.p(owl("equivalentProperty"), "q", "p").join(f.spo("x", "p", "y"), "p"), "x", "q", "y"),
    "prp-inv1": lambda f, ls: _head(f.p(owl("inverseOf"), "p", "q").join(f.spo("x", "p", "y"), "p"), "y", "q", "x"),
    "prp-inv2": lambda f, ls: _head(f.p(owl("inverseOf"), "q", "p").join(f.spo("x", "p", "y"), "p"), "y", "q", "x"),
    # classes
    "cls-int1": lambda f, ls: _intersection(f, ls),
    "cls-int2": lambda f, ls: _head(f.p(owl("intersectionOf"), "c", "list").join(ls, "list").join(f.type_("x", "c"), "c"), "x", TYPE, "item"),
    "cls-uni": lambda f, ls: _head(f.p(owl("unionOf"), "c", "list").join(ls, "list").join(f.type_("x", "item"), "item"), "x", TYPE, "c"),
    "cls-svf1": lambda f, ls: _head(f.p(owl("someValuesFrom"), "r", "y").join(f.p(owl("onProperty"), "r", "p"), "r").join(f.spo("u", "p", "v"), "p").join(f.type_("v", "y"), ["v", "y"]), "u", TYPE, "r"),
    "cls-svf2": lambda f, ls: _head(f.p(owl("someValuesFrom"), "r", "y").where(F.col("y") == owl("Thing")).join(f.p(owl("onProperty"), "r", "p"), "r").join(f.spo("u", "p", "v"), "p"), "u", TYPE, "r"),
    "cls-avf": lambda f, ls: _head(f.p(owl("allValuesFrom"), "r", "y").join(f.p(owl("onProperty"), "r", "p"), "r").join(f.type_("u", "r"), "r").join(f.spo("u", "p", "v"), ["u", "p"]), "v", TYPE, "y"),
    "cls-hv1": lambda f, ls: _head(f.p(owl("hasValue"), "r", "v").join(f.p(owl("onProperty"), "r", "p"), "r").join(f.type_("u", "r"), "r"), "u", "p", "v"),
    "cls-hv2": lambda f, ls: _head(f.p(owl("hasValue"), "r", "v").join(f.p(owl("onProperty"), "r", "p"), "r").join(f.spo("u", "p", "v"), ["p", "v"]), "u", TYPE, "r"),
    "cls-maxc2": lambda f, ls: _head(_maxone(f, "maxCardinality").join(f.type_("u", "r"), "r").join(f.spo("u", "p", "y"), ["u", "p"]).join(f.spo("u", "p", "z"), ["u", "p"]).where("y <> z"), "y", owl("sameAs"), "z"),
    "cls-maxqc2": lambda f, ls: _head(_maxone(f, "maxQualifiedCardinality").join(f.p(owl("onClass"), "r", "c"), "r").join(f.type_("u", "r"), "r").join(f.spo("u", "p", "y"), ["u", "p"])
                                      .join(f.type_("y", "c"), ["y", "c"]).join(f.spo("u", "p", "z"), ["u", "p"]).join(f.type_("z", "c"), ["z", "c"]).where("y <> z"), "y", owl("sameAs"), "z"),
    "cls-oo": lambda f, ls: _head(f.p(owl("oneOf"), "c", "list").join(ls, "list"), "item", TYPE, "c"),
    # class axioms
    "cax-sco": lambda f, ls: _head(f.p(SUBCLASS, "c", "d").join(f.type_("x", "c"), "c"), "x", TYPE, "d"),
    "cax-eqc1": lambda f, ls: _head(f.p(owl("equivalentClass"), "c", "d").join(f.type_("x", "c"), "c"), "x", TYPE, "d"),
    "cax-eqc2": lambda f, ls: _head(f.p(owl("equivalentClass"), "d", "c").join(f.type_("x", "c"), "c"), "x", TYPE, "d"),
    # schema vocabulary
    "scm-cls": lambda f, ls: _each(f.types(owl("Class"), "c"), [("c", SUBCLASS, "c"), ("c", owl("equivalentClass"), "c"), ("c", SUBCLASS, owl("Thing")), (owl("Nothing"), SUBCLASS, "c")]),
    "scm-sco": lambda f, ls: _head(f.p(SUBCLASS, "a", "b").join(f.p(SUBCLASS, "b", "c"), "b"), "a", SUBCLASS, "c"),
    "scm-eqc1": lambda f, ls: _each(f.p(owl("equivalentClass"), "a", "b"), [("a", SUBCLASS, "b"), ("b", SUBCLASS, "a")]),
    "scm-eqc2": lambda f, ls: _head(f.p(SUBCLASS, "a", "b").join(f.p(SUBCLASS, "b", "a"), ["a", "b"]), "a", owl("equivalentClass"), "b"),
    "scm-op": lambda f, ls: _each(f.types(owl("ObjectProperty"), "p"), [("p", SUBPROP, "p"), ("p", owl("equivalentProperty"), "p")]),
    "scm-dp": lambda f, ls: _each(f.types(owl("DatatypeProperty"), "p"), [("p", SUBPROP, "p"), ("p", owl("equivalentProperty"), "p")]),
    "scm-spo": lambda f, ls: _head(f.p(SUBPROP, "a", "b").join(f.p(SUBPROP, "b", "c"), "b"), "a", SUBPROP, "c"),
    "scm-eqp1": lambda f, ls: _each(f.p(owl("equivalentProperty"), "a", "b"), [("a", SUBPROP, "b"), ("b", SUBPROP, "a")]),
    "scm-eqp2": lambda f, ls: _head(f.p(SUBPROP, "a", "b").join(f.p(SUBPROP, "b", "a"), ["a", "b"]), "a", owl("equivalentProperty"), "b"),
    "scm-dom1": lambda f, ls: _head(f.p(DOMAIN, "p", "c").join(f.p(SUBCLASS, "c", "d"), "c"), "p", DOMAIN, "d"),
    "scm-dom2": lambda f, ls: _head(f.p(DOMAIN, "q", "c").join(f.p(SUBPROP, "p", "q"), "q"), "p", DOMAIN, "c"),
    "scm-rng1": lambda f, ls: _head(f.p(RANGE, "p", "c").join(f.p(SUBCLASS, "c", "d"), "c"), "p", RANGE, "d"),
    "scm-rng2": lambda f, ls: _head(f.p(RANGE, "q", "c").join(f.p(SUBPROP, "p", "q"), "q"), "p", RANGE, "c"),
    "scm-hv": lambda f, ls: _head(_restriction(f, "hasValue", "a", "i", "p").join(_restriction(f, "hasValue", "b", "i", "q"), "i").join(f.p(SUBPROP, "p", "q"), ["p", "q"]), "a", SUBCLASS, "b"),
    "scm-svf1": lambda f, ls: _head(_restriction(f, "someValuesFrom", "a", "y", "p").join(_restriction(f, "someValuesFrom", "b", "z", "p"), "p").join(f.p(SUBCLASS, "y", "z"), ["y", "z"]), "a", SUBCLASS, "b"),
    "scm-svf2": lambda f, ls: _head(_restriction(f, "someValuesFrom", "a", "y", "p").join(_restriction(f, "someValuesFrom", "b", "y", "q"), "y").join(f.p(SUBPROP, "p", "q"), ["p", "q"]), "a", SUBCLASS, "b"),
    "scm-avf1": lambda f, ls: _head(_restriction(f, "allValuesFrom", "a", "y", "p").join(_restriction(f, "allValuesFrom", "b", "z", "p"), "p").join(f.p(SUBCLASS, "y", "z"), ["y", "z"]), "a", SUBCLASS, "b"),
    "scm-avf2": lambda f, ls: _head(_restriction(f, "allValuesFrom", "a", "y", "p").join(_restriction(f, "allValuesFrom", "b", "y", "q"), "y").join(f.p(SUBPROP, "p", "q"), ["p", "q"]), "b", SUBCLASS, "a"),
    "scm-int": lambda f, ls: _head(f.p(owl("intersectionOf"), "c", "list").join(ls, "list"), "c", SUBCLASS, "item"),
    "scm-uni": lambda f, ls: _head(f.p(owl("unionOf"), "c", "list").join(ls, "list"), "item", SUBCLASS, "c"),
}


def _each(df: DataFrame, heads) -> DataFrame:
    return reduce(lambda a, b: a.union(b), [_head(df, *h) for h in heads])


def _restriction(f: Facts, kind: str, r: str, v: str, p: str) -> DataFrame:
    return f.p(owl(kind), r, v).join(f.p(owl("onProperty"), r, p), r)


def _maxone(f: Facts, kind: str) -> DataFrame:
    return f.p(owl(kind), "r", "n").where(F.startswith("n", F.lit('"1"'))).join(f.p(owl("onProperty"), "r", "p"), "r").select("r", "p")


def _intersection(f: Facts, ls: DataFrame) -> DataFrame:
    body = f.p(owl("intersectionOf"), "c", "list").join(ls, "list").select("c", "item").distinct()
    size = body.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    has = body.join(f.type_("x", "item").distinct(), "item").groupBy("c", "x").agg(F.count(F.lit(1)).alias("k")).join(size, "c").where("k = n")
    return _head(has, "x", TYPE, "c")


#: eq-*: handled by sameAs classes. The "false" rules: bodies of violations (s, rule).
CHECKS = {
    "eq-diff1": lambda f, ls: f.p(owl("sameAs"), "s", "o").join(f.p(owl("differentFrom"), "s", "o"), ["s", "o"]),
    "prp-irp": lambda f, ls: f.types(owl("IrreflexiveProperty"), "p").join(f.spo("s", "p", "o"), "p").where("s = o"),
    "prp-asyp": lambda f, ls: f.types(owl("AsymmetricProperty"), "p").join(f.spo("s", "p", "o"), "p").join(f.spo("o", "p", "s"), ["s", "p", "o"]),
    "prp-pdw": lambda f, ls: f.p(owl("propertyDisjointWith"), "p", "q").join(f.spo("s", "p", "o"), "p").join(f.spo("s", "q", "o"), ["s", "q", "o"]),
    "cls-nothing2": lambda f, ls: f.types(owl("Nothing"), "s"),
    "cls-com": lambda f, ls: f.p(owl("complementOf"), "c", "d").join(f.type_("s", "c"), "c").join(f.type_("s", "d"), ["s", "d"]),
    "cls-maxc1": lambda f, ls: _maxzero(f, "maxCardinality").join(f.type_("s", "r"), "r").join(f.spo("s", "p", "o"), ["s", "p"]),
    "cls-maxqc1": lambda f, ls: _maxzero(f, "maxQualifiedCardinality").join(f.p(owl("onClass"), "r", "c"), "r").join(f.type_("s", "r"), "r").join(f.spo("s", "p", "o"), ["s", "p"]).join(f.type_("o", "c"), ["o", "c"]),
    "cax-dw": lambda f, ls: f.p(owl("disjointWith"), "c", "d").join(f.type_("s", "c"), "c").join(f.type_("s", "d"), ["s", "d"]),
}
#: Axioms that hold of themselves.
AXIOMS = {"cls-thing": (owl("Thing"), TYPE, owl("Class")), "cls-nothing1": (owl("Nothing"), TYPE, owl("Class"))}
RDFS_RULES = ["prp-dom", "prp-rng", "prp-spo1", "cax-sco", "scm-sco", "scm-spo"]


def _maxzero(f: Facts, kind: str) -> DataFrame:
    return f.p(owl(kind), "r", "n").where(F.startswith("n", F.lit('"0"'))).join(f.p(owl("onProperty"), "r", "p"), "r").select("r", "p")


def same_as(t: DataFrame) -> DataFrame:
    """(id, component): sameAs classes, each by its smallest term (eq-sym, eq-trans)."""
    return components(Facts(t).p(owl("sameAs"), "src", "dst"))


def replace_equals(t: DataFrame) -> DataFrame:
    """eq-rep-s/p/o: every term by its class's representative; the classes themselves stay as sameAs triples."""
    c = cut(same_as(t))
    out = t.where(F.col("p") != owl("sameAs"))
    for col in ("s", "p", "o"):
        m = c.select(F.col("id").alias(col), F.col("component").alias("__r"))
        out = out.join(m, col, "left").withColumn(col, F.coalesce("__r", col)).drop("__r").select("s", "p", "o")
    return out.union(c.where("id <> component").select(F.col("id").alias("s"), F.lit(owl("sameAs")).alias("p"), F.col("component").alias("o"))).distinct()


def materialize(triples: DataFrame, rules: list[str] | None = None, max_rounds: int = 100) -> DataFrame:
    """All triples that the rules add, and the given ones; rounds until nothing is new. sameAs stays with its classes."""
    chosen = rules or list(RULES)
    t = cut(triples.select("s", "p", "o").distinct())
    ls = cut(members(t))
    for _ in range(max_rounds):
        f = Facts(t)
        heads = [h for r in chosen if (h := RULES[r](f, ls)) is not None]
        new = reduce(lambda a, b: a.union(b), heads).where(~F.startswith("s", F.lit('"'))).distinct().join(t, ["s", "p", "o"], "left_anti")
        new = cut(new)
        if new.isEmpty():
            return t
        t = cut(t.union(new), t)
    return t


def rdfs(triples: DataFrame, max_rounds: int = 100) -> DataFrame:
    """materialize(triples, RDFS_RULES), semi-naive: classes and properties are closed first, in a table of their own that is sent where it is small,
    and then every triple is followed once. A type that comes from a closed class needs no further look at its classes. Triples are written once."""
    schema = [SUBCLASS, SUBPROP, DOMAIN, RANGE]
    literal = lambda c: F.startswith(c, F.lit('"'))
    given = cut(triples.select("s", "p", "o").distinct())
    known, delta = [given], given.withColumn("closed", F.lit(0))
    told, changed = cut(given.where(F.col("p").isin(*schema))), True
    for _ in range(max_rounds):
        if changed:
            closed = materialize(told, ["scm-sco", "scm-spo"])
            more = cut(closed.join(told, ["s", "p", "o"], "left_anti"))
            known, delta = [*known, more], delta.union(more.withColumn("closed", F.lit(0)))
            told, present = closed, {r["p"] for r in closed.select("p").distinct().collect()}  # four at most
        f, zero = Facts(told), F.lit(0).alias("closed")
        heads = []
        if DOMAIN in present:
            heads.append(delta.join(f.p(DOMAIN, "p", "c"), "p").select("s", F.lit(TYPE).alias("p"), F.col("c").alias("o"), zero))
        if RANGE in present:
            heads.append(delta.join(f.p(RANGE, "p", "c"), "p").where(~literal("o")).select(F.col("o").alias("s"), F.lit(TYPE).alias("p"), F.col("c").alias("o"), zero))
        if SUBPROP in present:
            heads.append(delta.join(f.p(SUBPROP, "p", "q"), "p").select("s", F.col("q").alias("p"), "o", zero))
        if SUBCLASS in present:
            heads.append(delta.where((F.col("p") == TYPE) & (F.col("closed") == 0)).join(f.p(SUBCLASS, "o", "d"), "o").select("s", "p", F.col("d").alias("o"), (~literal("o")).cast("int").alias("closed")))
        if not heads:
            break
        every = reduce(lambda a, b: a.union(b), known)
        new = reduce(lambda a, b: a.union(b), heads).where(~literal("s")).groupBy("s", "p", "o").agg(F.min("closed").alias("closed"))
        delta = cut(new.join(every, ["s", "p", "o"], "left_anti"))
        if delta.isEmpty():
            break
        known.append(delta.select("s", "p", "o"))
        fresh = delta.where(F.col("p").isin(*schema)).select("s", "p", "o")
        changed = not fresh.isEmpty()
        if changed:  # then all triples are followed again
            told, delta = cut(told.union(fresh)), reduce(lambda a, b: a.union(b), known).withColumn("closed", F.lit(0))
    return reduce(lambda a, b: a.union(b), known)


def violations(triples: DataFrame) -> DataFrame:
    """(rule, s): what makes the triples inconsistent."""
    f, ls = Facts(triples.select("s", "p", "o")), members(triples)
    return reduce(lambda a, b: a.union(b), [body(f, ls).select(F.lit(name).alias("rule"), "s") for name, body in CHECKS.items()]).distinct()


def hierarchy(triples: DataFrame, pred: str = SUBCLASS) -> DataFrame:
    """(src, dst): strict ancestors, by transitive closure of the declared links."""
    return closure(Facts(triples).p(pred, "src", "dst"))


def satisfiable(triples: DataFrame) -> DataFrame:
    """(class, satisfiable) for named classes, by classification in the RL rules: a class under two disjoint ones, or under
    Nothing, or under a class and its complement, has no member. Full description logic tableaux are out of scope."""
    t = materialize(triples, ["scm-cls", "scm-sco", "scm-eqc1", "scm-int", "scm-uni"])
    f = Facts(t)
    sup = f.p(SUBCLASS, "c", "d")
    dis = f.p(owl("disjointWith"), "d", "e").union(f.p(owl("disjointWith"), "e", "d")).union(f.p(owl("complementOf"), "d", "e"))
    bad = sup.join(dis, "d").join(sup.select("c", F.col("d").alias("e")), ["c", "e"]).select("c").union(sup.where((F.col("d") == owl("Nothing")) & (F.col("c") != owl("Nothing"))).select("c")).distinct()
    return f.types(owl("Class"), "c").distinct().join(bad.withColumn("__bad", F.lit(True)), "c", "left").select("c", F.col("__bad").isNull().alias("satisfiable"))
