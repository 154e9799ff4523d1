"""Full-text search: postings, match modes, BM25, facets, autocomplete, Boolean query trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.functions import text as T
from strataq.plans.prefix import number_rows


class FullText:
    """Search over one text column. tokens: a function text column -> array<string>."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, tokens=T.simple_tokens):
        self.df, self.id, self.text = df, id_col, text_col
        self.tokens = df.select(F.col(id_col), tokens(F.col(text_col)).alias("tokens"))

    @classmethod
    def over(cls, members: dict[str, DataFrame], id_col: str, text_col: str, tokens=T.simple_tokens) -> FullText:
        """One logical source over several record types."""
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("__type", F.lit(n)) for n, d in members.items()])
        return cls(every, id_col, text_col, tokens)

    def postings(self) -> DataFrame:
        return self.tokens.select(self.id, F.posexplode("tokens").alias("position", "term"))

    def matches(self, terms: list[str], mode: str = "all") -> Column:
        """The match as a condition on the token array: no shuffle, and it can be combined with other filters."""
        arr = F.array(*[F.lit(t) for t in terms])
        if mode == "all":
            return F.size(F.array_intersect(F.array_distinct("tokens"), F.array_distinct(arr))) == len(set(terms))
        if mode == "any":
            return F.arrays_overlap(F.col("tokens"), arr)
        if mode == "phrase":
            return phrase(F.col("tokens"), terms)
        raise ValueError(mode)

    def search(self, terms: list[str], mode: str = "all") -> DataFrame:
        return self.tokens.where(self.matches(terms, mode)).select(self.id)

    def bm25(self, terms: list[str], mode: str = "any", k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(id, score) of the matches. Idf is ln((N-df+.5)/(df+.5)) and may be negative. Corpus statistics are one row."""
        terms = list(dict.fromkeys(terms))
        dl = F.size("tokens").cast("double")
        hits = [count_of(F.col("tokens"), t) for t in terms]
        rows = self.tokens.select(self.id, "tokens", dl.alias("__dl"), *[h.cast("double").alias(f"__tf{i}") for i, h in enumerate(hits)])
        stats = rows.agg(F.count(F.lit(1)).cast("double").alias("__n"), F.avg("__dl").alias("__avg"),
                         *[F.sum((F.col(f"__tf{i}") > 0).cast("double")).alias(f"__df{i}") for i in range(len(terms))])
        cand = rows.where(self.matches(terms, mode)).drop("tokens").join(F.broadcast(stats))  # stats is one row
        score = F.lit(0.0)
        for i in range(len(terms)):
            df, tf = F.col(f"__df{i}"), F.col(f"__tf{i}")
            idf = F.log((F.col("__n") - df + 0.5) / (df + 0.5))
            part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("__dl") / F.col("__avg")))
            score = score + F.when(tf > 0, part).otherwise(0.0)
        return cand.select(self.id, score.alias("score"))

    def facet(self, terms: list[str], mode: str, column: str, top: int) -> DataFrame:
        from strataq.operators.aggregate import facets

        return facets(self.df.join(self.search(terms, mode), self.id, "left_semi"), column, top)

    def term_scores(self) -> DataFrame:
        """Documents per term; the score of suggestions."""
        return self.tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))

    def suggest(self, prefix: str, limit: int, least: int = 1) -> DataFrame:
        if len(prefix) < least:
            return self.term_scores().limit(0)
        return self.term_scores().where(F.col("term").startswith(prefix.lower())).orderBy(F.desc("n"), "term").limit(limit)

    def popular(self, limit: int) -> DataFrame:
        return self.term_scores().orderBy(F.desc("n"), "term").limit(limit)

    def query(self, tree: dict) -> DataFrame:
        return self.tokens.where(condition(tree)).select(self.id)


def count_of(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == term))


def phrase(tokens: Column, terms: list[str], slop: int = 0) -> Column:
    """Consecutive terms, or, with slop, terms in order with at most `slop` others between them in all."""
    n = len(terms)
    if slop == 0:
        # the array is bound once as `ts`: named in a lambda, it would be made anew (the text taken apart) at every position
        def within(ts: Column) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ts) - n + 1))
            return (F.size(ts) >= n) & F.exists(starts, lambda i: F.coalesce(reduce(lambda a, b: a & b, [F.get(ts, i - 1 + k) == t for k, t in enumerate(terms)], F.lit(True)), F.lit(False)))

        return F.exists(F.array(tokens), within)
    import re

    gap = "(?:\u001f[^\u001f]+){0,%d}?" % slop
    return F.concat(F.lit("\u001f"), F.array_join(tokens, "\u001f"), F.lit("\u001f")).rlike(gap.join("\u001f" + re.escape(t) for t in terms) + "(?=\u001f)")


def condition(q: dict) -> Column:
    """A Boolean query tree over the column `tokens`.

    {"term": t} {"prefix": p} {"wildcard": "a*b?"} {"fuzzy": t, "edits": 2, "prefix": 0} {"phrase": [...], "slop": 0} {"range": [low, high]}
    {"all": True} {"bool": {"must": [...], "should": [...], "must_not": [...], "filter": [...], "minimum": n}} {"boost": w, "query": q}
    """
    tokens = F.col("tokens")
    if "term" in q:
        return F.array_contains(tokens, q["term"])
    if "wildcard" in q:
        import re

        pattern = "^" + re.escape(q["wildcard"]).replace("\\*", ".*").replace("\\?", ".") + "$"
        return F.exists(tokens, lambda t: t.rlike(pattern))
    if "fuzzy" in q:
        return F.exists(tokens, lambda t: T.within_edits(t, F.lit(q["fuzzy"]), q.get("edits", 2), q.get("prefix", 0)))
    if "phrase" in q:
        return phrase(tokens, q["phrase"], q.get("slop", 0))
    if "range" in q:
        low, high = q["range"]
        return F.exists(tokens, lambda t: (t >= low if low is not None else F.lit(True)) & (t <= high if high is not None else F.lit(True)))
    if "prefix" in q:
        return F.exists(tokens, lambda t: t.startswith(q["prefix"]))
    if "query" in q:
        return condition(q["query"])
    if "bool" in q:
        b, out = q["bool"], F.lit(True)
        for x in [*b.get("must", []), *b.get("filter", [])]:
            out = out & condition(x)
        for x in b.get("must_not", []):
            out = out & ~condition(x)
        should = b.get("should", [])
        least = b.get("minimum", 0 if b.get("must") or b.get("filter") else 1)
        if should and least:
            out = out & (sum((condition(x).cast("int") for x in should), F.lit(0)) >= least)
        return out
    if q.get("all"):
        return F.lit(True)
    raise ValueError(q)


def boosted_score(tree: dict) -> Column:
    """Sum of the boosts of the leaves that match."""
    if "bool" in tree:
        b = tree["bool"]
        return sum((boosted_score(x) for k in ("must", "should") for x in b.get(k, [])), F.lit(0.0))
    return F.when(condition(tree), F.lit(float(tree.get("boost", 1.0)))).otherwise(0.0)


# fusion of ranked lists
def ranked(df: DataFrame, id_col: str, score: Column, source: str, best: str = "desc", top: int | None = None) -> DataFrame:
    """(id, source, score, rank0) of a list, or of its first `top` rows. The order is total: ties by id."""
    df = df.select(F.col(id_col).alias("id"), score.cast("double").alias("score"))
    order = [F.desc("score") if best == "desc" else F.asc("score"), F.asc("id")]
    if top is not None:
        df = df.orderBy(*order).limit(top).withColumn("rank0", F.row_number().over(W.orderBy(*order)) - 1)
    else:
        df = number_rows(df, order, "rank0")
    return df.withColumn("source", F.lit(source))


def fuse(lists: list[DataFrame], how: str = "rrf", k: int = 60, weights: list[float] | None = None, limit: int | None = None, intersect: bool = False) -> DataFrame:
    """rrf, sum, max or weighted over (id, source, score, rank0) lists; intersect keeps ids that all lists have."""
    if weights is not None and len(weights) != len(lists):
        raise ValueError("one weight a list")
    parts = []
    for i, d in enumerate(lists):
        s = {"rrf": 1.0 / (k + F.col("rank0") + 1), "weighted": F.col("score") * F.lit(float((weights or [1.0] * len(lists))[i]))}.get(how, F.col("score"))
        parts.append(d.select("id", s.alias("s")))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    out = every.groupBy("id").agg((F.max("s") if how == "max" else F.sum("s")).alias("score"), F.count(F.lit(1)).alias("__n"))
    if intersect:
        out = out.where(F.col("__n") == len(lists))
    out = out.drop("__n")
    return out if limit is None else out.orderBy(F.desc("score"), "id").limit(limit)


def min_max(df: DataFrame, distance: str) -> DataFrame:
    """Add score: the nearest 1, the farthest 0; all equal: 1. The bounds are one row."""
    d = F.col(distance)
    out = df.join(F.broadcast(df.agg(F.min(d).alias("__lo"), F.max(d).alias("__hi"))))
    return out.withColumn("score", F.when(F.col("__hi") == F.col("__lo"), 1.0).otherwise((F.col("__hi") - d) / (F.col("__hi") - F.col("__lo")))).drop("__lo", "__hi")


def by_farthest(df: DataFrame, distance: str) -> DataFrame:
    out = df.join(F.broadcast(df.agg(F.max(distance).alias("__hi"))))  # one row
    return out.withColumn("score", F.when(F.col("__hi") == 0, 1.0).otherwise(1 - F.col(distance) / F.col("__hi"))).drop("__hi")


def by_rank(df: DataFrame, order: list[Column]) -> DataFrame:
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    out = number_rows(df, order, "__i").join(F.broadcast(n))  # one row
    return out.withColumn("score", F.when(F.col("__n") == 1, 1.0).otherwise(1 - F.col("__i") / (F.col("__n") - 1))).drop("__i", "__n")
