"""Full text, vectors, space, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataq.functions import spatial as S
from strataq.functions import text as T
from strataq.functions import vector as V
from strataq.operators import ann
from strataq.operators import search as X
from strataq.operators.similar import IVF, PQ, HyperplaneIndex, Spatial, knn
from strataq.queries.registry import query

col = F.col
_TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_DOC = f"(SELECT doc_id, {_TOK} AS t FROM documents)"


def _ft(e):
    return X.FullText(e.table("documents"), "doc_id", "text")


query("t1_tokens", f"SELECT doc_id, len(t) AS n, list_count(t) AS c, t[1] AS first, t[len(t)] AS last FROM {_DOC}")(
    lambda e: _ft(e).tokens.select("doc_id", F.size("tokens").cast("long").alias("n"), F.size("tokens").cast("long").alias("c"), F.get("tokens", F.lit(0)).alias("first"), F.get("tokens", F.size("tokens") - 1).alias("last")))
query("t1_postings", f"SELECT term, count(*) AS n, max(position) AS last FROM (SELECT unnest(t) AS term, unnest(range(len(t))) AS position FROM {_DOC}) GROUP BY term")(
    lambda e: _ft(e).postings().groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.max("position").cast("long").alias("last")))
query("t2_stem", f"""SELECT s, count(*) AS n FROM (SELECT CASE WHEN ends_with(w, 'ing') AND length(w) > 5 THEN w[:-4] WHEN ends_with(w, 'ed') AND length(w) > 4 THEN w[:-3]
WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') AND length(w) > 3 THEN w[:-2] ELSE w END AS s FROM (SELECT unnest(t) AS w FROM {_DOC})) GROUP BY s""")(
    lambda e: e.table("documents").select(F.explode(T.stem_tokens("text")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")))
query("t3_ngrams", "SELECT n_nationkey, array_to_string(list_transform(range(1, length(n_name) - 1), lambda i: substr(lower(n_name), i, 3)), ' ') AS grams FROM nation")(
    lambda e: e.table("nation").select("n_nationkey", F.array_join(T.ngram_tokens("n_name", 3), " ").alias("grams")))
query("t4_keyword", "SELECT p_partkey, trim(lower(p_type)) AS k FROM part")(lambda e: e.table("part").select("p_partkey", T.keyword_token("p_type")[0].alias("k")))
query("t5_match_all", f"SELECT doc_id FROM {_DOC} WHERE list_contains(t, 'the') AND list_contains(t, 'and') AND list_contains(t, 'is')")(lambda e: _ft(e).search(["the", "and", "is"], "all"))
query("t5_match_any", f"SELECT doc_id FROM {_DOC} WHERE list_has_any(t, ['der', 'les', 'los'])")(lambda e: _ft(e).search(["der", "les", "los"], "any"))
query("t5_match_phrase", f"SELECT doc_id FROM {_DOC} WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')")(lambda e: _ft(e).search(["of", "the"], "phrase"))


def _bm25_sql(mode: str) -> str:
    cond = {"any": "tf1 > 0 OR tf2 > 0", "all": "tf1 > 0 AND tf2 > 0"}[mode]
    part = "CASE WHEN tf{i} > 0 THEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / av)) ELSE 0 END"
    return f"""WITH r AS (SELECT doc_id, len(t)::DOUBLE AS dl, len(list_filter(t, lambda x: x = 'the'))::DOUBLE AS tf1, len(list_filter(t, lambda x: x = 'der'))::DOUBLE AS tf2 FROM {_DOC}),
s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS av, count(*) FILTER (tf1 > 0)::DOUBLE AS df1, count(*) FILTER (tf2 > 0)::DOUBLE AS df2 FROM r)
SELECT doc_id, round({part.format(i=1)} + {part.format(i=2)}, 6) AS score FROM r, s WHERE {cond}"""


query("t6_bm25_any", _bm25_sql("any"))(lambda e: _ft(e).bm25(["the", "der"]).select("doc_id", F.round("score", 6).alias("score")))
query("t6_bm25_all", _bm25_sql("all"))(lambda e: _ft(e).bm25(["the", "der"], "all").select("doc_id", F.round("score", 6).alias("score")))
query("t7_facets", f"SELECT lang AS value, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM {_DOC} WHERE list_contains(t, 'the')) GROUP BY lang ORDER BY n DESC, lang LIMIT 5")(
    lambda e: _ft(e).facet(["the"], "any", "lang", 5))
_TERMS = f"(SELECT term, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(t) AS term FROM {_DOC}) GROUP BY term)"
query("t8_autocomplete", f"SELECT * FROM {_TERMS} WHERE starts_with(term, 'th') ORDER BY n DESC, term LIMIT 10")(lambda e: _ft(e).suggest("th", 10))
query("t8_popular_terms", f"SELECT * FROM {_TERMS} ORDER BY n DESC, term LIMIT 20")(lambda e: _ft(e).popular(20))
query("t9_polymorphic_text", "SELECT id FROM (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'b' || item_id, text FROM benchmark) WHERE list_contains(" + _TOK + ", 'with')")(
    lambda e: X.FullText.over({"documents": e.table("documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text"), "benchmark": e.table("benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), "text")}, "id", "text").search(["with"]))
query("t10_boolean_query", f"""SELECT doc_id FROM {_DOC} WHERE list_contains(t, 'the') AND NOT list_contains(t, 'der') AND (len(list_filter(t, lambda x: starts_with(x, 'tion'))) > 0)::INT
+ (len(list_filter(t, lambda x: regexp_matches(x, '^a.*t$'))) > 0)::INT + (len(list_filter(t, lambda x: levenshtein(x, 'there') <= 1)) > 0)::INT >= 2""")(
    lambda e: _ft(e).query({"bool": {"must": [{"term": "the"}], "must_not": [{"term": "der"}], "should": [{"prefix": "tion"}, {"wildcard": "a*t"}, {"fuzzy": "there", "edits": 1}], "minimum": 2}}))
query("t10_range_query", f"SELECT doc_id FROM {_DOC} WHERE len(list_filter(t, lambda x: x >= 'zu' AND x <= 'zz')) > 0")(lambda e: _ft(e).query({"range": ["zu", "zz"]}))
query("t11_levenshtein", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND levenshtein(a.n_name, b.n_name) <= 1 AND a.n_name[1:7] = b.n_name[1:7]")(
    lambda e: e.table("nation").select(col("n_nationkey").alias("x"), col("n_name").alias("a")).join(e.table("nation").select(col("n_nationkey").alias("y"), col("n_name").alias("b")),
                                                                                                 (col("x") < col("y")) & T.within_edits("a", "b", 1, 7)).select("x", "y"))
query("t11_damerau", "SELECT n_nationkey, damerau_levenshtein(n_name, 'NATOIN_1') AS d FROM nation")(lambda e: e.table("nation").select("n_nationkey", T.damerau_levenshtein("n_name", F.lit("NATOIN_1")).cast("long").alias("d")))
query("t12_jaro_winkler", "SELECT n_nationkey, round(jaro_similarity(n_name, 'NATION_12'), 6) AS j, round(jaro_winkler_similarity(n_name, 'NATION_12'), 6) AS jw FROM nation")(
    lambda e: e.table("nation").select("n_nationkey", F.round(T.jaro("n_name", F.lit("NATION_12")), 6).alias("j"), F.round(T.jaro_winkler("n_name", F.lit("NATION_12")), 6).alias("jw")))
query("t12_soundex")(lambda e: e.table("nation").select("n_nationkey", T.soundex("n_name").alias("s")))
query("t13_analyzer", "SELECT doc_id, len(list_filter(list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: lower(x)), lambda x: length(x) BETWEEN 2 AND 8), lambda x: x NOT IN ('the', 'and', 'of'))) AS n FROM documents")(
    lambda e: e.table("documents").select("doc_id", F.size(T.without(T.length_between(T.lowercase(T.whitespace_tokens("text")), 2, 8), ["the", "and", "of"])).cast("long").alias("n")))
query("t14_snowball")(lambda e: e.table("documents").select("doc_id", F.array_join(T.snowball_tokens(T.simple_tokens("text")), " ").alias("stems")))
query("t15_highlight", "SELECT item_id, regexp_replace(text, '(?i)\\b(the|of)\\b', '<em>\\1</em>', 'g') AS h FROM benchmark")(lambda e: e.table("benchmark").select("item_id", T.highlight("text", ["the", "of"]).alias("h")))
query("t15_fragments")(lambda e: e.table("benchmark").select("item_id", T.fragments("text", ["the"], 20, 2).alias("f")))
query("t16_ascii_folding", "SELECT doc_id, strip_accents(lang || text) AS s FROM documents WHERE lang IN ('fr', 'es')")(
    lambda e: e.table("documents").where(col("lang").isin("fr", "es")).select("doc_id", T.strip_accents(F.concat("lang", "text")).alias("s")))

# ---- vectors
_Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"


def _q(e):
    return list(e.table("embeddings").where("vec_id = 0").first()["embedding"])


for metric, sql in (("cosine", "1 - list_cosine_similarity(embedding::DOUBLE[], q)"), ("euclidean", "list_distance(embedding::DOUBLE[], q)"), ("dot", "-list_inner_product(embedding::DOUBLE[], q)"),
                    ("manhattan", "list_sum(list_transform(list_zip(embedding::DOUBLE[], q), lambda x: abs(x[1] - x[2])))")):
    query(f"v1_knn_{metric}", f"SELECT vec_id, round({sql}, 6) AS distance FROM embeddings, {_Q} ORDER BY {sql}, vec_id LIMIT 10")(
        lambda e, m=metric: knn(e.table("embeddings"), "vec_id", "embedding", _q(e), 10, m).select("vec_id", F.round("distance", 6).alias("distance")))
query("v2_zero_vector", "SELECT 1.0::DOUBLE AS d")(lambda e: e.spark.range(1).select(V.distance("cosine", V.literal([0.0, 0.0]), V.literal([1.0, 2.0])).alias("d")))
query("v6_filtered_knn", f"SELECT vec_id FROM embeddings, {_Q} WHERE label = 3 ORDER BY list_distance(embedding::DOUBLE[], q), vec_id LIMIT 5")(
    lambda e: knn(e.table("embeddings"), "vec_id", "embedding", _q(e), 5, "euclidean", col("label") == 3).select("vec_id"))


def _asked(e):
    """The queries of the index rows: every vector whose id is divisible by 20."""
    return e.table("embeddings").where("vec_id % 20 = 0 and embedding is not null").select(col("vec_id").alias("query"), col("embedding").alias("q"))


# No SQL: approximate by nature. tests/test_whole.py measures recall against brute force, over all queries: at least 0.9.
query("v3_hashed_ann")(lambda e: ann.search_hashed(HyperplaneIndex(e.table("embeddings"), "vec_id", "embedding", 64, 8, 5), _asked(e), 10).select("query", "id", "rank"))
query("v4_ivf")(lambda e: ann.search_ivf(IVF(e.table("embeddings"), "vec_id", "embedding", 16, 10, 2000), _asked(e), 10, 12).select("query", "id", "rank"))
query("v5_pq")(lambda e: ann.search_pq(PQ(e.table("embeddings"), "vec_id", "embedding", 16, 64, 8, 2000), _asked(e), 10, 20).select("query", "id", "rank"))
query("v8_polymorphic_knn", f"SELECT id FROM (SELECT 'a' || vec_id AS id, embedding FROM embeddings WHERE label = 1 UNION ALL SELECT 'b' || vec_id, embedding FROM embeddings WHERE label = 2), {_Q} ORDER BY list_distance(embedding::DOUBLE[], q), id LIMIT 6")(
    lambda e: knn(e.table("embeddings").where("label in (1, 2)").select(F.concat(F.when(col("label") == 1, "a").otherwise("b"), "vec_id").alias("id"), "embedding"), "id", "embedding", _q(e), 6, "euclidean").select("id"))

# ---- space
_GEO = "(SELECT c_custkey, ((c_custkey * 7919) % 17000) / 100.0::DOUBLE - 85 AS lat, ((c_custkey * 104729) % 36000) / 100.0::DOUBLE - 180 AS lon FROM customer)"
_HAV = "2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0, pow(sin(radians({a} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({a})) * pow(sin(radians({b} - lon) / 2), 2))))"


def _geo(e):
    k = col("c_custkey")
    return Spatial(e.table("customer").select(k, ((k * 7919) % 17000 / 100.0 - 85).alias("lat"), ((k * 104729) % 36000 / 100.0 - 180).alias("lon")), "c_custkey", "lat", "lon")


query("g1_radius", f"SELECT c_custkey, round({_HAV.format(a=10.0, b=20.0)}, 3) AS distance FROM {_GEO} WHERE {_HAV.format(a=10.0, b=20.0)} <= 2000000")(
    lambda e: _geo(e).within_radius((10.0, 20.0), 2_000_000).select("c_custkey", F.round("distance", 3).alias("distance")))
query("g2_box", f"SELECT c_custkey FROM {_GEO} WHERE lat BETWEEN -10 AND 30 AND lon BETWEEN -50 AND 40")(lambda e: _geo(e).within_box(-10, -50, 30, 40).select("c_custkey"))
query("g2_box_across_date_line", f"SELECT c_custkey FROM {_GEO} WHERE lat BETWEEN -10 AND 30 AND (lon >= 150 OR lon <= -150)")(lambda e: _geo(e).within_box(-10, 150, 30, -150).select("c_custkey"))
_RING = [(0.0, 0.0), (0.0, 60.0), (40.0, 60.0), (20.0, 30.0), (40.0, 0.0)]


def _ring_sql(ring):
    parts = [f"((({y1} > lat) <> ({y2} > lat)) AND lon < ({x2} - {x1}) * (lat - {y1}) / ({y2} - {y1}) + {x1})::INT" for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]]) if y1 != y2]
    return "(" + " + ".join(parts) + ") % 2 = 1"


query("g3_polygon_ray", f"SELECT c_custkey FROM {_GEO} WHERE {_ring_sql(_RING)}")(lambda e: _geo(e).within_polygon(_RING).select("c_custkey"))
query("g3_polygon_winding", f"SELECT c_custkey FROM {_GEO} WHERE {_ring_sql(_RING)}")(lambda e: _geo(e).within_polygon(_RING, how="winding").select("c_custkey"))
query("g3_polygon_convex", f"SELECT c_custkey FROM {_GEO} WHERE lat BETWEEN -20 AND 20 AND lon BETWEEN -30 AND 30")(
    lambda e: _geo(e).within_polygon([(-20.0, -30.0), (-20.0, 30.0), (20.0, 30.0), (20.0, -30.0)], how="convex").select("c_custkey"))
_HOLE = [(5.0, 20.0), (5.0, 40.0), (15.0, 40.0), (15.0, 20.0)]
query("g3_polygon_hole", f"SELECT c_custkey FROM {_GEO} WHERE {_ring_sql(_RING)} AND NOT ({_ring_sql(_HOLE)})")(lambda e: _geo(e).within_polygon(_RING, [_HOLE]).select("c_custkey"))
query("g4_g6_nearest", f"SELECT c_custkey FROM {_GEO} ORDER BY {_HAV.format(a=48.0, b=2.0)}, c_custkey LIMIT 7")(lambda e: _geo(e).nearest((48.0, 2.0), 7).select("c_custkey"))
query("g5_nearest_within", f"SELECT c_custkey FROM {_GEO} WHERE {_HAV.format(a=48.0, b=2.0)} <= 1500000 ORDER BY {_HAV.format(a=48.0, b=2.0)}, c_custkey LIMIT 7")(
    lambda e: _geo(e).nearest((48.0, 2.0), 7, 1_500_000).select("c_custkey"))


@query("g7_cells", f"SELECT true AS ok, count(*) AS n FROM {_GEO}")
def cells(e):
    """Parent of a cell is the cell of the coarser level; decoding gives the grid coordinates back."""
    g = _geo(e).df
    c8, c7 = S.cell(col("lat"), col("lon"), 8), S.cell(col("lat"), col("lon"), 7)
    y = F.floor((col("lat") + 90) / 180 * 256)
    return g.select(((S.cell_parent(c8) == c7) & (S.morton_decode(c8, 1, 2, 8) == y) & F.array_contains(S.cell_children(c7), c8)).alias("ok")).agg(F.min("ok").alias("ok"), F.count(F.lit(1)).alias("n"))


query("g8_morton", "SELECT n_nationkey AS k, sum(((n_nationkey >> i) & 1) << (2 * i)) + sum(((n_regionkey >> i) & 1) << (2 * i + 1)) AS code FROM nation, range(6) t(i) GROUP BY n_nationkey")(
    lambda e: e.table("nation").select(col("n_nationkey").alias("k"), S.morton2(col("n_nationkey"), col("n_regionkey")).alias("code")))
query("g9_signed_area", "SELECT 1800.0::DOUBLE AS area")(lambda e: e.spark.range(1).select(F.lit(float(S.signed_area(_RING))).alias("area")))

# ---- fusion
_LISTS = f"""WITH b AS ({_bm25_sql('any').replace('round(', '(').replace(', 6) AS score', ') AS score')}), l1 AS (SELECT doc_id AS id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM b),
l2 AS (SELECT doc_id AS id, n_chars::DOUBLE AS score, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents WHERE lang = 'de')"""


def _lists(e):
    a = X.ranked(_ft(e).bm25(["the", "der"]), "doc_id", col("score"), "text")
    b = X.ranked(e.table("documents").where("lang = 'de'"), "doc_id", col("n_chars"), "length")
    return [a, b]


def _out(df):
    return df.select("id", F.round("score", 6).alias("score"))


query("f1_rrf", f"{_LISTS} SELECT id, round(sum(1.0::DOUBLE / (61 + r)), 6) AS score FROM (SELECT id, r FROM l1 UNION ALL SELECT id, r FROM l2) GROUP BY id")(lambda e: _out(X.fuse(_lists(e))))
query("f2_sum", f"{_LISTS} SELECT id, round(sum(score), 6) AS score FROM (SELECT id, score FROM l1 UNION ALL SELECT id, score FROM l2) GROUP BY id")(lambda e: _out(X.fuse(_lists(e), "sum")))
query("f2_max", f"{_LISTS} SELECT id, round(max(score), 6) AS score FROM (SELECT id, score FROM l1 UNION ALL SELECT id, score FROM l2) GROUP BY id")(lambda e: _out(X.fuse(_lists(e), "max")))
query("f2_weighted", f"{_LISTS} SELECT id, round(sum(s), 6) AS score FROM (SELECT id, score * 0.7 AS s FROM l1 UNION ALL SELECT id, score * 0.001 FROM l2) GROUP BY id")(
    lambda e: _out(X.fuse(_lists(e), "weighted", weights=[0.7, 0.001])))
query("f_intersect_limit", f"{_LISTS} SELECT id FROM (SELECT l1.id, 1.0::DOUBLE / (61 + l1.r) + 1.0::DOUBLE / (61 + l2.r) AS s FROM l1 JOIN l2 USING (id)) ORDER BY s DESC, id LIMIT 10")(
    lambda e: X.fuse(_lists(e), limit=10, intersect=True).select("id"))
query("f4_similar_score", f"""WITH d AS (SELECT vec_id, list_distance(embedding::DOUBLE[], q) AS d FROM embeddings, {_Q} ORDER BY d, vec_id LIMIT 20)
SELECT vec_id, round(((SELECT max(d) FROM d) - d) / ((SELECT max(d) FROM d) - (SELECT min(d) FROM d)), 6) AS score FROM d""")(
    lambda e: X.min_max(knn(e.table("embeddings"), "vec_id", "embedding", _q(e), 20, "euclidean"), "distance").select("vec_id", F.round("score", 6).alias("score")))
query("f5_nearby_score", f"WITH d AS (SELECT c_custkey, {_HAV.format(a=10.0, b=20.0)} AS d FROM {_GEO} WHERE {_HAV.format(a=10.0, b=20.0)} <= 2000000) SELECT c_custkey, round(1 - d / (SELECT max(d) FROM d), 6) AS score FROM d")(
    lambda e: X.by_farthest(_geo(e).within_radius((10.0, 20.0), 2_000_000), "distance").select("c_custkey", F.round("score", 6).alias("score")))
query("f6_rank_score", "SELECT s_suppkey, round(1 - (row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1) / (count(*) OVER () - 1)::DOUBLE, 6) AS score FROM supplier")(
    lambda e: X.by_rank(e.table("supplier").select("s_suppkey", "s_acctbal"), [F.desc("s_acctbal"), F.asc("s_suppkey")]).select("s_suppkey", F.round("score", 6).alias("score")))
query("f7_filter_score", "SELECT s_suppkey, 1.0::DOUBLE AS score FROM supplier WHERE s_nationkey = 2")(lambda e: e.table("supplier").where("s_nationkey = 2").select("s_suppkey", F.lit(1.0).alias("score")))
