"""SPARQL text -> a tree of tuples. Recursive descent over regular-expression tokens.

Patterns: ("bgp", [(s, p, o)]) ("join", a, b) ("left", a, b, cond) ("union", a, b) ("minus", a, b) ("filter", e, a) ("extend", var, e, a)
("values", vars, rows) ("graph", term, a) ("select", query) ("lateral", a, b). Terms: ("var", n) ("term", text). Predicates may be paths:
("inv", p) ("seq", a, b) ("alt", a, b) ("rep", p, low, high) ("not", [iri], [inverse iri]).
"""

from __future__ import annotations

import re

from strataq.errors import UnsupportedQueryError
from strataq.sparql.terms import RDF, XSD

_TOKEN = re.compile(r"""
  (?P<ws>\s+|\#[^\n]*) | (?P<iri><[^<>"{}|^`\\\s]*>) | (?P<string>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  | (?P<var>[?$]\w+) | (?P<blank>_:[\w.-]*\w) | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*(?:--(?:ltr|rtl))?) | (?P<num>\d*\.?\d+(?:[eE][+-]?\d+)?)
  | (?P<pname>(?:[^\W\d_][\w.-]*)?:(?:[\w:%](?:[\w.:%-]*[\w:%-])?)?) | (?P<word>[A-Za-z_]\w*) | (?P<op>\^\^|&&|\|\||!=|<=|>=|<<\(|\)>>|<<|>>|[{}()\[\].,;=<>!|/^*+?:-])
""", re.X)


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise UnsupportedQueryError(f"SPARQL: unexpected {text[at: at + 20]!r}")
        if m.lastgroup != "ws":
            out.append((m.lastgroup, m.group()))
        at = m.end()
    return out + [("end", "")]


def quote(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


def _unquote(s: str) -> str:
    n = 3 if s[:3] in ('"""', "'''") else 1
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) > 1 else {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), s[n:-n])


class Parser:
    def __init__(self, text: str):
        self.toks, self.at, self.prefixes, self.base, self.fresh = tokenize(text), 0, {}, "", 0

    # tokens
    def peek(self, k: int = 0):
        return self.toks[min(self.at + k, len(self.toks) - 1)]

    def next(self):
        t = self.peek()
        self.at += 1
        return t

    def is_(self, *texts, k: int = 0) -> bool:
        kind, t = self.peek(k)
        return kind not in ("string", "iri", "end") and t.upper() in texts

    def take(self, *texts) -> bool:
        if self.is_(*texts):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise UnsupportedQueryError(f"SPARQL: expected {text}, found {self.peek()[1]!r}")

    # terms
    def new_var(self, hint: str = "b") -> tuple:
        self.fresh += 1
        return ("var", f"__{hint}{self.fresh}")

    def iri(self) -> str:
        kind, t = self.next()
        if kind == "iri":
            t = t[1:-1]
            return t if re.match(r"^[A-Za-z][\w+.-]*:", t) or not self.base else self.base + t
        if kind == "pname":
            p, _, local = t.partition(":")
            if p not in self.prefixes:
                raise UnsupportedQueryError(f"SPARQL: unknown prefix {p}")
            return self.prefixes[p] + local
        raise UnsupportedQueryError(f"SPARQL: expected an IRI, found {t!r}")

    def term(self) -> tuple:
        kind, t = self.peek()
        if kind == "var":
            self.next()
            return ("var", t[1:])
        if kind in ("iri", "pname"):
            return ("term", f"<{self.iri()}>")
        if kind == "string":
            self.next()
            body = quote(_unquote(t))
            if self.peek()[0] == "lang":
                return ("term", body + self.next()[1].lower())
            if self.take("^^"):
                return ("term", f"{body}^^<{self.iri()}>".replace(f"^^<{XSD}string>", ""))
            return ("term", body)
        if kind == "num" or (t in "+-" and t and self.peek(1)[0] == "num"):
            sign = self.next()[1] if t in "+-" else ""
            n = self.next()[1]
            dt = "double" if "e" in n.lower() else "decimal" if "." in n else "integer"
            return ("term", f'"{sign.replace("+", "")}{n}"^^<{XSD}{dt}>')
        if self.take("TRUE"):
            return ("term", f'"true"^^<{XSD}boolean>')
        if self.take("FALSE"):
            return ("term", f'"false"^^<{XSD}boolean>')
        if kind == "blank":
            self.next()
            return ("var", "__n_" + re.sub(r"\W", "_", t[2:]))
        if self.take("<<("):
            s, p, o = self.term(), self.verb(), self.term()
            self.need(")>>")
            return ("triple", s, p, o)
        raise UnsupportedQueryError(f"SPARQL: unexpected {t!r}")

    def node(self, out: list) -> tuple:
        """A subject or object; property lists, collections and reified triples add their triples to out."""
        if self.take("["):
            b = self.new_var()
            if not self.is_("]"):
                self.properties(b, out)
            self.need("]")
            return b
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.node(out))
            head = ("term", f"<{RDF}nil>")
            for it in reversed(items):
                b = self.new_var("l")
                out += [(b, ("term", f"<{RDF}first>"), it), (b, ("term", f"<{RDF}rest>"), head)]
                head = b
            return head
        if self.take("<<"):
            s, p, o = self.term(), self.verb(), self.term()
            self.need(">>")
            b = self.new_var("r")
            out.append((b, ("term", f"<{RDF}reifies>"), ("triple", s, p, o)))
            return b
        return self.term()

    def verb(self) -> tuple:
        return ("term", f"<{RDF}type>") if self.take("A") else self.term()

    # paths
    def path(self) -> tuple:
        p = self.path_seq()
        while self.take("|"):
            p = ("alt", p, self.path_seq())
        return p

    def path_seq(self) -> tuple:
        p = self.path_elt()
        while self.take("/"):
            p = ("seq", p, self.path_elt())
        return p

    def path_elt(self) -> tuple:
        if self.take("^"):
            return ("inv", self.path_elt())
        if self.take("!"):
            items = []
            if self.take("("):
                while not self.take(")"):
                    inv = self.take("^")
                    items.append((inv, self.verb()[1]))
                    self.take("|")
            else:
                inv = self.take("^")
                items.append((inv, self.verb()[1]))
            p = ("not", [t for i, t in items if not i], [t for i, t in items if i])
        elif self.take("("):
            p = self.path()
            self.need(")")
        else:
            p = self.verb()
        if self.is_("*", "+", "?"):
            t = self.next()[1]
            return ("rep", p, 1 if t == "+" else 0, 1 if t == "?" else None)
        if self.is_("{") and self.peek(1)[0] == "num":
            self.next()
            low = int(self.next()[1])
            high = low
            if self.take(","):
                high = int(self.next()[1]) if self.peek()[0] == "num" else None
            self.need("}")
            return ("rep", p, low, high)
        return p

    def properties(self, s: tuple, out: list) -> None:
        while True:
            p = self.term() if self.peek()[0] == "var" else self.path()
            while True:
                out.append((s, p, self.node(out)))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.is_(".", "]", "}"):
                return

    def triples(self, out: list) -> None:
        n = len(out)
        s = self.node(out)
        if not (len(out) > n and self.is_(".", "}")):
            self.properties(s, out)

    # groups
    def group(self) -> tuple:
        self.need("{")
        if self.is_("SELECT"):
            q = self.select()
            self.need("}")
            return ("select", q)
        pattern, filters = ("bgp", []), []

        def add(x):
            nonlocal pattern
            pattern = x if pattern == ("bgp", []) else ("join", pattern, x)

        while not self.take("}"):
            if self.take("."):
                continue
            if self.take("OPTIONAL"):
                g = self.group()
                cond = None
                if g[0] == "filter":
                    cond, g = g[1], g[2]
                pattern = ("left", pattern, g, cond)
            elif self.take("MINUS"):
                pattern = ("minus", pattern, self.group())
            elif self.take("LATERAL"):
                pattern = ("lateral", pattern, self.group())
            elif self.take("FILTER"):
                filters.append(self.constraint())
            elif self.take("BIND"):
                self.need("(")
                e = self.expr()
                self.need("AS")
                v = self.next()[1][1:]
                self.need(")")
                pattern = ("extend", v, e, pattern)
            elif self.take("VALUES"):
                add(self.values())
            elif self.take("GRAPH"):
                t = self.term()
                add(("graph", t, self.group()))
            elif self.is_("SERVICE"):
                raise UnsupportedQueryError("SERVICE")
            elif self.is_("{"):
                g = self.group()
                while self.take("UNION"):
                    g = ("union", g, self.group())
                add(g)
            else:
                out: list = []
                self.triples(out)
                if pattern[0] == "bgp":
                    pattern = ("bgp", pattern[1] + out)
                elif pattern[0] == "join" and pattern[2][0] == "bgp":
                    pattern = ("join", pattern[1], ("bgp", pattern[2][1] + out))
                else:
                    add(("bgp", out))
        for f in filters:
            pattern = ("filter", f, pattern) if pattern[0] != "filter" else ("filter", ("and", pattern[1], f), pattern[2])
        return pattern

    def values(self) -> tuple:
        names, many = [], self.take("(")
        while self.peek()[0] == "var":
            names.append(self.next()[1][1:])
            if not many:
                break
        if many:
            self.need(")")
        self.need("{")
        rows = []
        while not self.take("}"):
            row = []
            if many:
                self.need("(")
            while not (many and self.take(")")):
                row.append(None if self.take("UNDEF") else self.term()[1])
                if not many:
                    break
            rows.append(row)
        return ("values", names, rows)

    # expressions
    def constraint(self) -> tuple:
        if self.is_("("):
            self.next()
            e = self.expr()
            self.need(")")
            return e
        return self.primary()

    def expr(self) -> tuple:
        e = self.and_()
        while self.take("||"):
            e = ("or", e, self.and_())
        return e

    def and_(self) -> tuple:
        e = self.relation()
        while self.take("&&"):
            e = ("and", e, self.relation())
        return e

    def relation(self) -> tuple:
        e = self.sum_()
        for op in ("=", "!=", "<=", ">=", "<", ">"):
            if self.take(op):
                return (op, e, self.sum_())
        if self.take("IN"):
            return ("in", e, self.args())
        if self.is_("NOT") and self.is_("IN", k=1):
            self.at += 2
            return ("not", ("in", e, self.args()))
        return e

    def args(self) -> list:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.expr())
            self.take(",")
        return out

    def sum_(self) -> tuple:
        e = self.product()
        while self.is_("+", "-"):
            op = self.next()[1]
            e = (op, e, self.product())
        return e

    def product(self) -> tuple:
        e = self.unary()
        while self.is_("*", "/"):
            op = self.next()[1]
            e = (op, e, self.unary())
        return e

    def unary(self) -> tuple:
        if self.take("!"):
            return ("not", self.unary())
        if self.is_("-") and self.peek(1)[0] != "num":
            self.next()
            return ("neg", self.unary())
        return self.primary()

    def primary(self) -> tuple:
        kind, t = self.peek()
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        if self.take("EXISTS"):
            return ("exists", self.group())
        if self.is_("NOT") and self.is_("EXISTS", k=1):
            self.at += 2
            return ("not", ("exists", self.group()))
        if kind == "word" and t.upper() not in ("TRUE", "FALSE"):
            self.next()
            name = t.upper()
            self.need("(")
            if name in ("COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"):
                distinct = self.take("DISTINCT")
                arg = None if self.take("*") else self.expr()
                sep = " "
                if self.take(";"):
                    self.need("SEPARATOR")
                    self.need("=")
                    sep = _unquote(self.next()[1])
                self.need(")")
                return ("agg", name, distinct, arg, sep)
            self.at -= 1
            return ("call", name, self.args())
        if kind in ("iri", "pname"):
            name = self.iri()
            if self.is_("("):
                return ("call", name, self.args())
            return ("term", f"<{name}>")
        return self.term()

    # queries
    def prologue(self) -> None:
        while True:
            if self.take("PREFIX"):
                p = self.next()[1].rstrip(":")
                self.prefixes[p] = self.next()[1][1:-1]
            elif self.take("BASE"):
                self.base = self.next()[1][1:-1]
            elif self.take("VERSION"):
                self.next()
            else:
                return

    def dataset(self) -> dict:
        out: dict = {"from": [], "named": []}
        while self.take("FROM"):
            out["named" if self.take("NAMED") else "from"].append(f"<{self.iri()}>")
        return out

    def select(self) -> dict:
        self.need("SELECT")
        q: dict = {"form": "select", "distinct": self.take("DISTINCT"), "items": []}
        self.take("REDUCED")
        if not self.take("*"):
            while True:
                if self.peek()[0] == "var":
                    q["items"].append((self.next()[1][1:], None))
                elif self.take("("):
                    e = self.expr()
                    self.need("AS")
                    q["items"].append((self.next()[1][1:], e))
                    self.need(")")
                else:
                    break
        q["dataset"] = self.dataset()
        self.take("WHERE")
        q["where"] = self.group()
        self.modifiers(q)
        return q

    def modifiers(self, q: dict) -> None:
        q |= {"group": None, "having": [], "order": [], "limit": None, "offset": None}
        if self.is_("GROUP"):
            self.at += 1
            self.need("BY")
            q["group"] = []
            while True:
                if self.peek()[0] == "var":
                    q["group"].append((self.next()[1][1:], None))
                elif self.take("("):
                    e = self.expr()
                    name = self.next()[1][1:] if self.take("AS") else self.new_var("g")[1]
                    self.need(")")
                    q["group"].append((name, e))
                elif self.peek()[0] in ("word", "iri", "pname") and self.is_("(", k=1) and not self.is_("HAVING"):
                    q["group"].append((self.new_var("g")[1], self.primary()))
                else:
                    break
        if self.take("HAVING"):
            while self.is_("(") or (self.peek()[0] == "word" and self.is_("(", k=1)):
                q["having"].append(self.constraint())
        if self.is_("ORDER"):
            self.at += 1
            self.need("BY")
            while True:
                if self.is_("ASC", "DESC"):
                    down = self.next()[1].upper() == "DESC"
                    q["order"].append((self.constraint(), down))
                elif self.peek()[0] == "var" or self.is_("(") or (self.peek()[0] == "word" and self.is_("(", k=1)):
                    q["order"].append((self.constraint() if not self.peek()[0] == "var" else self.term(), False))
                else:
                    break
        while self.is_("LIMIT", "OFFSET"):
            which = self.next()[1].lower()
            q[which] = int(self.next()[1])
        if self.take("VALUES"):
            q["where"] = ("join", q["where"], self.values())

    def query(self) -> dict:
        self.prologue()
        if self.is_("SELECT"):
            q = self.select()
        elif self.take("ASK"):
            q = {"form": "ask", "dataset": self.dataset()}
            self.take("WHERE")
            q["where"] = self.group()
            self.modifiers(q)
        elif self.take("CONSTRUCT"):
            q = {"form": "construct"}
            out: list | None = None
            if self.is_("{"):
                out = self.template()
            q["dataset"] = self.dataset()
            self.take("WHERE")
            q["where"] = self.group()
            q["template"] = out if out is not None else q["where"][1]
            self.modifiers(q)
        elif self.take("DESCRIBE"):
            q = {"form": "describe", "terms": []}
            if not self.take("*"):
                while self.peek()[0] in ("var", "iri", "pname"):
                    q["terms"].append(self.term())
            q["dataset"] = self.dataset()
            self.take("WHERE")
            q["where"] = self.group() if self.is_("{") else ("bgp", [])
            self.modifiers(q)
        else:
            raise UnsupportedQueryError(f"SPARQL: {self.peek()[1]!r}")
        if self.peek()[0] != "end":
            raise UnsupportedQueryError(f"SPARQL: unexpected {self.peek()[1]!r}")
        return q

    def template(self) -> list:
        """Triples in braces; with GRAPH blocks the triples carry a graph as a fourth part."""
        self.need("{")
        out: list = []
        while not self.take("}"):
            if self.take("."):
                continue
            if self.take("GRAPH"):
                g = self.term()
                out += [(*t, g) for t in self.template()]
                continue
            part: list = []
            self.triples(part)
            out += part
        return out

    # updates
    def graph_ref(self) -> tuple:
        if self.is_("DEFAULT", "NAMED", "ALL"):
            return ("which", self.next()[1].upper())
        self.take("GRAPH")
        return ("term", f"<{self.iri()}>")

    def update(self) -> list[tuple]:
        out = []
        while True:
            self.prologue()
            if self.peek()[0] == "end":
                return out
            if self.is_("INSERT") and self.is_("DATA", k=1):
                self.at += 2
                out.append(("insert", self.template()))
            elif self.is_("DELETE") and self.is_("DATA", k=1):
                self.at += 2
                out.append(("delete", self.template()))
            elif self.is_("DELETE") and self.is_("WHERE", k=1):
                self.at += 2
                t = self.template()
                out.append(("modify", t, [], _pattern_of(t)))
            elif self.is_("WITH", "DELETE", "INSERT"):
                graph = ("term", f"<{self.iri()}>") if self.take("WITH") else None
                gone = self.template() if self.take("DELETE") else []
                new = self.template() if self.take("INSERT") else []
                while self.take("USING"):
                    self.take("NAMED")
                    self.iri()
                self.need("WHERE")
                where = self.group()
                if graph:
                    gone, new = ([t if len(t) == 4 else (*t, graph) for t in x] for x in (gone, new))
                    where = ("graph", graph, where)
                out.append(("modify", gone, new, where))
            elif self.is_("CLEAR", "DROP", "CREATE"):
                verb = self.next()[1].lower()
                self.take("SILENT")
                out.append((verb, self.graph_ref()))
            elif self.is_("ADD", "COPY", "MOVE"):
                verb = self.next()[1].lower()
                self.take("SILENT")
                a = self.graph_ref()
                self.need("TO")
                out.append((verb, a, self.graph_ref()))
            elif self.take("LOAD"):
                self.take("SILENT")
                src = self.iri()
                self.take("INTO")
                out.append(("load", src, self.graph_ref() if self.peek()[1] not in (";", "") else None))
            else:
                raise UnsupportedQueryError(f"SPARQL update: {self.peek()[1]!r}")
            self.take(";")


def _pattern_of(template: list) -> tuple:
    plain = [t for t in template if len(t) == 3]
    p = ("bgp", plain)
    for t in template:
        if len(t) == 4:
            p = ("join", p, ("graph", t[3], ("bgp", [t[:3]])))
    return p
