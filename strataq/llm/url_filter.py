"""Operator 10: URL filter with path rules and a weighted vocabulary."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import load

#: (verdict, host, path prefix); a rule fits its host and all its subdomains.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: One strict term rejects; soft terms reject when SOFT_LIMIT different ones occur.
STRICT = ["porn", "xxx", "viagra", "cialis", "casino", "warez", "escort", "spam-farm", "cheap-pills", "free-bets", "adult-x"]
SOFT = ["adult", "sex", "bet", "bets", "betting", "poker", "slots", "win", "free", "cheap", "pills", "loan", "loans",
        "spam", "farm", "ads", "track", "click", "bonus", "dating", "hot", "nude", "crack", "torrent", "replica"]
SOFT_LIMIT = 2


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ://."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Rules of equal length: the later in code point order."""
    hits = []
    for verdict, h, p in rules:
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        hits.append(F.when(fits, F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("r"), F.lit(verdict).alias("v"))))
    best = F.array_max(F.array(*hits))
    return best["r"], best["v"]


def vocabulary_verdict(strict=STRICT, soft=SOFT, limit: int = SOFT_LIMIT):
    """A vectorised UDF url -> allow or block: one Aho-Corasick pass over the whole url, in lower case (A-Z only).

    A hit counts when no ASCII letter or digit touches it on either side. Only the vocabulary is held in memory.
    """
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    inner = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
    made: list = []

    @F.pandas_udf("string")
    def verdict(urls: pd.Series) -> pd.Series:
        import ahocorasick

        if not made:
            auto = ahocorasick.Automaton()
            for t in soft:
                auto.add_word(t, (len(t), t, False))
            for t in strict:
                auto.add_word(t, (len(t), t, True))
            auto.make_automaton()
            made.append(auto)

        def one(url) -> str:
            if url is None or url != url:
                return "allow"
            u, found = url.translate(lower), set()
            for end, (n, term, hard) in made[0].iter(u):
                start = end - n + 1
                if (start and u[start - 1] in inner) or (end + 1 < len(u) and u[end + 1] in inner):
                    continue
                if hard:
                    return "block"
                found.add(term)
                if len(found) >= limit:
                    return "block"
            return "allow"

        return urls.map(one)

    return verdict


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT,
                limit: int = SOFT_LIMIT) -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits) and verdict (the rule's, else the vocabulary's).

    A null url, or one without ://, has empty host and path; a null url is allowed, for it holds no term. Repeated
    rows are judged each; of rules of equal length the later in code point order wins; very long urls are read whole;
    extra columns, of whatever name, are ignored; an empty table gives an empty result. No shuffle. The vocabulary is only
    asked about urls that no rule decides.
    """
    host, path = url_parts(F.col(url_col))
    base = pages.select(F.col(id_col), F.col(url_col).alias("__u"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    own = vocabulary_verdict(strict, soft, limit)(F.when(F.col("__v").isNull(), F.col("__u")))
    return (base.select(id_col, "host", "path", "__u", rule.alias("rule"), verdict.alias("__v")).select("*", own.alias("__w"))
            .select(id_col, "host", "path", "rule", F.coalesce("__v", "__w").alias("verdict")))


def op10_url_filter(spark, sf_dir):
    return filter_urls(load(spark, sf_dir, "pages"))


def _sql() -> str:
    def hit(t: str) -> str:
        return f"regexp_matches(lu, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"

    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    soft = " + ".join(f"{hit(t)}::INT" for t in SOFT)
    return f"""
WITH a AS (
  SELECT page_id, coalesce(translate(url, {letters}), '') AS lu,
         CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
b AS (SELECT page_id, lu, regexp_extract(rest, '^([^/?#]*)', 1) AS h, rest FROM a),
c AS (SELECT page_id, lu, translate(h, {letters}) AS host, regexp_extract(substr(rest, length(h) + 1), '^([^?#]*)', 1) AS path FROM b),
r(v, h, p) AS (VALUES {rules}),
m AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM c JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN {' OR '.join(hit(t) for t in STRICT)} OR ({soft}) >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN m USING (page_id)
"""


SQL = _sql()
