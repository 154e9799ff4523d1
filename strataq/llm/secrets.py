"""Operator 8 [native]: secret scans behind a trigram inverted index. DataFrame functions only."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import bit_filter, load, lookup, materialize, with_membership

#: (kind, regex, group whose length counts, least length). Spans are leftmost non-overlapping matches of each kind.
BASE_RULES = [
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # a run of 24 or more is the match of [0-9a-f]+ that is long enough
]
ADDED_RULES = [
    ("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1),
]
RULES = BASE_RULES + ADDED_RULES
_MOST = 64  # strings that one stretch of a regex may stand for


def trigram_query(pattern: str) -> list[set[str]]:
    """The Boolean trigram query of a regex in disjunctive form, over lower-cased text: a text with a match has all
    trigrams of at least one set. An empty list: no trigram is mandatory, the rule must scan."""
    parser = re._parser
    best: list[set[str]] = []

    def strings(items) -> list[str] | None:
        """All strings that items can match, if few."""
        out = [""]
        for op, arg in items:
            got = one(op, arg)
            if got is None or len(out) * len(got) > _MOST:
                return None
            out = [a + b for a, b in product(out, got)]
        return out

    def one(op, arg) -> list[str] | None:
        name = str(op)
        if name == "LITERAL":
            return [chr(arg).lower()]
        if name == "IN":
            chars: set[str] = set()
            for o, a in arg:
                if str(o) == "LITERAL":
                    chars.add(chr(a).lower())
                elif str(o) == "RANGE" and a[1] - a[0] < _MOST:
                    chars |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
                else:
                    return None
            return sorted(chars) if len(chars) <= 8 else None
        if name == "SUBPATTERN":
            return strings(arg[3])
        if name == "BRANCH":
            every = [strings(x) for x in arg[1]]
            return None if any(x is None for x in every) else sorted({s for x in every for s in x})
        if name == "MAX_REPEAT" and arg[1] != parser.MAXREPEAT and arg[1] <= 1:
            got = strings(arg[2])
            return None if got is None else sorted({*got, *([""] if arg[0] == 0 else [])})
        return None

    def offer(texts: list[str]) -> None:
        nonlocal best
        sets = [{t[i: i + 3] for i in range(len(t) - 2)} for t in texts]
        if all(sets) and (not best or min(map(len, sets)) > min(map(len, best))):
            best = sets

    def walk(items) -> None:
        run = [""]
        for op, arg in items:
            got = one(op, arg)
            if got is not None and len(run) * len(got) <= _MOST:
                run = [a + b for a, b in product(run, got)]
                continue
            offer(run)
            run = [""] if got is None else got
            if got is None and str(op) == "SUBPATTERN":
                walk(arg[3])
            if got is None and str(op) == "MAX_REPEAT" and arg[0] > 0:
                walk(arg[2])
        offer(run)

    walk(parser.parse(pattern))
    return [s for i, s in enumerate(best) if not any(t < s or (t == s and j < i) for j, t in enumerate(best))]


class TrigramIndex:
    """Postings (id, gram) of the trigrams that the rules' queries name, and what they select."""

    def __init__(self, rules=RULES):
        self.queries = {kind: trigram_query(pattern) for kind, pattern, *_ in rules}
        self.grams = sorted({g for q in self.queries.values() for s in q for g in s})
        self.place = {g: i for i, g in enumerate(self.grams)}

    def postings(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """One row (id, gram number) for each indexed trigram that a document's text has, in either case."""
        low = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("low"))
        hits = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(self.grams)]))
        return low.select("id", F.explode(hits).alias("gram"))

    def candidates(self, postings: DataFrame) -> DataFrame:
        """(id, postings __n, one boolean c_<kind> a rule with a query): intersections and unions of postings, as bit masks by id.

        Masks are combined on the map side, so a document costs one narrow row in the shuffle.
        """
        words = range(-(-len(self.grams) // 60))
        masks = postings.groupBy("id").agg(F.count(F.lit(1)).alias("__n"), *[
            F.bit_or(F.when(F.floor(F.col("gram") / 60) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("gram") % 60).cast("int")))
                     .otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in words])

        def has(grams: set[str]) -> Column:
            need = [sum(1 << (self.place[g] % 60) for g in grams if self.place[g] // 60 == w) for w in words]
            every = F.lit(True)
            for w, n in zip(words, need):
                if n:
                    every = every & (F.col(f"m{w}").bitwiseAND(F.lit(n)) == F.lit(n))
            return every

        def selects(query: list[set[str]]) -> Column:
            out = F.lit(False)
            for s in query:
                out = out | has(s)
            return out

        found = masks.select("id", "__n", *[selects(q).alias(f"c_{k}") for k, q in self.queries.items() if q])
        some = F.lit(False)
        for k, q in self.queries.items():
            if q:
                some = some | F.col(f"c_{k}")
        return found.where(some)


def find_spans(text: Column, number: int, pattern: str, group: int, least: int) -> Column:
    """array<struct<start,kind,end>> of a rule's matches in text, in code points.

    The pieces between matches and the matches themselves alternate, so their lengths give the positions.
    """
    rx = F.lit(pattern)
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    matches = F.transform(F.regexp_extract_all(text, rx, F.lit(0)), F.length)
    counted = F.transform(F.regexp_extract_all(text, rx, F.lit(group)), F.length)
    rows = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("p"), matches.alias("m"), counted.alias("c"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def add(acc, x):
        start = acc["at"] + x["0"]
        end = start + x["1"]
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["2"] >= least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    names = F.transform(rows, lambda x: F.struct(x["p"].alias("0"), x["m"].alias("1"), x["c"].alias("2")))
    found = F.aggregate(names, F.struct(F.lit(0).alias("at"), empty.alias("out")), add)["out"]
    return F.when(text.rlike(pattern), found).otherwise(empty)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per document: id and `found`, array<struct<start,kind,end>> by start, then by the rules' order.

    Rules with mandatory trigrams are matched only in documents that the index selects; the others scan every text.
    Null text is empty. The candidates' ids are unique, so a repeated id keeps its rows; a null id isn't indexed and
    is scanned by every rule. Matches that start at the same place are told apart by the rules' order. Extra columns, of
    whatever name, are ignored; an empty table gives an empty result; very long texts are scanned whole. Texts that a
    membership filter of the candidates' ids rules out stay in their scan; only the others are joined with the
    candidates' flags (a hot id by broadcast, see common.lookup).
    """
    index = TrigramIndex(rules)
    chosen = materialize(index.candidates(index.postings(docs, id_col, text_col)))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = with_membership(base, bit_filter(chosen, F.col("id"), chosen.count()), F.col("id"), "maybe")
    kinds = [k for k, q in index.queries.items() if q]
    picked = lookup(base.where("maybe"), chosen, "id", "__n", F.xxhash64("text")).drop("__n")
    rest = base.where("not maybe").select("*", *[F.col("id").isNull().alias(f"c_{k}") for k in kinds])

    def found(rows: DataFrame) -> DataFrame:
        spans = []
        for number, (kind, pattern, group, least) in enumerate(rules):
            at = find_spans(F.col("text"), number, pattern, group, least)
            if kind in kinds:
                none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
                at = F.when(F.coalesce(F.col(f"c_{kind}"), F.lit(False)), at).otherwise(none)
            spans.append(at)
        return rows.select(F.col("id").alias(id_col), F.array_sort(F.concat(*spans)).alias("found"))

    return found(picked).union(found(rest))


def joined(spans: Column, rules=RULES) -> Column:
    kinds = F.array(*[F.lit(r[0]) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secrets(spark, sf_dir):
    found = scan_secrets(load(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"] < len(BASE_RULES))

    def of(i):
        return F.size(F.filter("found", lambda s: s["kind"] == i)).cast("long")

    count = [of(i).alias(f"n_{r[0]}") for i, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _sql() -> str:
    parts = []
    for i, (kind, pattern, group, least) in enumerate(RULES):
        rx = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"SELECT doc_id, {i} AS no, '{kind}' AS kind, {least} AS least, string_split_regex(t, {rx}) AS ps, "
                     f"regexp_extract_all(t, {rx}) AS ms, regexp_extract_all(t, {rx}, {group}) AS cs FROM d")
    counts = ", ".join(f"count(*) FILTER (kind = '{r[0]}') AS n_{r[0]}" for r in BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0),
p AS (
  SELECT doc_id, no, kind, list_sum(list_transform(ps[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s, length(ms[i]) AS n
  FROM i WHERE length(cs[i]) >= least),
f AS (SELECT doc_id, no, kind, s, kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT AS span FROM p),
g AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY s, no) FILTER (no < {len(BASE_RULES)}) AS base, string_agg(span, ',' ORDER BY s, no) AS spans
      FROM f GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{r[0]}, 0) AS n_{r[0]}' for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""


SQL = _sql()
