"""Small fixtures for the rules of null logic, order, ties, versions, graphs, SPARQL and validation."""

import pytest
from pyspark.sql import functions as F

from strataq.errors import UnsupportedQueryError
from strataq.functions import text as T
from strataq.functions import vector as V
from strataq.graph import algorithms as A
from strataq.graph.sqlpgq import create_graph, parse_path
from strataq.operators import records as R
from strataq.operators.aggregate import Aggregate
from strataq.operators.rank import Rank
from strataq.operators.search import FullText, fuse, phrase
from strataq.plans.query import Query
from strataq.sparql import engine as SE


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_null_comparisons_are_false_in_fluent_queries(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, s string")
    assert ids(Query(df, "id").where(F.col("s") != "a").frame()) == [3]


def test_keyset_and_token_pages_agree(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(20)], "id int, k int")
    q = Query(df, "id").order_by(("k", "desc"))
    first, token = q.page(5)
    last = first.collect()[-1]
    by_token = [r["id"] for r in q.page(5, token)[0].collect()]
    by_key = [r["id"] for r in q.after(k=last["k"], id=last["id"]).limit(5).frame().collect()]
    assert by_token == by_key
    with pytest.raises(ValueError):
        q.order_by("k").page(5, token)


def test_forced_index_must_exist(spark):
    with pytest.raises(UnsupportedQueryError):
        Query(spark.range(1).withColumnRenamed("id", "x")).use_index("nope")


def test_aggregates_of_nothing(spark):
    r = Aggregate(spark.createDataFrame([], "x double")).count("n").sum("x", "s").avg("x", "a").min("x", "m").frame().first()
    assert (r["n"], r["s"], r["a"], r["m"]) == (0, None, None, None)


def test_rank_is_zero_based_and_ties_go_by_id_descending(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 9.0), (4, None)], "id int, v double")
    assert [(r["id"], r["rank"]) for r in Rank(df, "v", "id").top(3).orderBy("rank").collect()] == [(3, 0), (2, 1), (1, 2)]
    assert Rank(df.limit(0), "v", "id").percentile(0.5).count() == 0


def test_bm25_idf_may_be_negative(spark):
    df = spark.createDataFrame([(1, "the cat"), (2, "the dog"), (3, "the the")], "id int, t string")
    assert all(r["score"] < 0 for r in FullText(df, "id", "t").bm25(["the"]).collect())


def test_phrase_and_slop(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a x b"), (3, "b a")], "id int, t string").select("id", T.simple_tokens("t").alias("tokens"))
    assert ids(df.where(phrase(F.col("tokens"), ["a", "b"]))) == [1]
    assert ids(df.where(phrase(F.col("tokens"), ["a", "b"], 1))) == [1, 2]


def test_zero_vector_has_distance_one(spark):
    assert spark.range(1).select(V.distance("cosine", V.literal([0.0]), V.literal([1.0]))).first()[0] == 1.0


def test_fusion_needs_a_weight_for_each_list(spark):
    with pytest.raises(ValueError):
        fuse([spark.range(1)], "weighted", weights=[1.0, 2.0])


def test_versions_diff_and_delete_rules(spark):
    df = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", 5), (1, 3, "b", None)], "id int, v int, s string, n int")
    got = {(r["v"], r["field"], r["change"]) for r in R.diff(df, "id", "v", ["s", "n"]).collect()}
    assert got == {(2, "s", "modified"), (2, "n", "added"), (3, "n", "removed")}
    parent, child = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(10, 1), (11, 2)], "c int, fk int")
    gone = parent.where("k = 1")
    assert ids(R.delete_with_rule(parent, "k", gone, child, "fk", "cascade")[1], "c") == [11]
    assert R.delete_with_rule(parent, "k", gone, child, "fk", "nullify")[1].where("fk is null").count() == 1
    with pytest.raises(ValueError):
        R.delete_with_rule(parent, "k", gone, child, "fk", "deny")


def test_insert_conflicts(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ValueError):
        R.insert(df, df, "k")
    assert R.insert(df, spark.createDataFrame([(1, "z")], "k int, v string"), "k", "replace").first()["v"] == "z"


def test_graph_errors_and_parsing(spark):
    e = spark.createDataFrame([(1, 2, -1.0)], "src int, dst int, weight double")
    with pytest.raises(UnsupportedQueryError):
        A.dijkstra(e, 1)
    with pytest.raises(UnsupportedQueryError):
        A.pagerank(e, personal=99)
    g = create_graph("CREATE PROPERTY GRAPH g VERTEX TABLES (a KEY (x) LABEL l1 | l2) EDGE TABLES (b SOURCE KEY (p) REFERENCES a (x) DESTINATION KEY (q) REFERENCES a (x) LABEL k)")
    assert g.vertices["a"].labels == {"l1", "l2"} and g.edges[0].src == ("p", "a")
    p = parse_path("TRAIL (a)-[e:x|y]->(b)<-[:z]-(c)-(d)")
    assert [x["way"] for x in p["edges"]] == ["out", "in", "any"] and p["mode"] == "trail"


@pytest.fixture(scope="module")
def quads(spark):
    base = spark.range(0).selectExpr("string(null) g", "string(null) s", "string(null) p", "string(null) o")
    return SE.update(base, 'PREFIX e: <urn:> INSERT DATA { e:a e:p 1, 2.0 ; e:n "x"@en . e:b e:p "3" ; e:q e:a . GRAPH e:g { e:c e:p 9 } e:l e:items (1 2) }')


def test_sparql_unbound_variables_join_with_anything(quads):
    got = SE.run(quads, "PREFIX e: <urn:> SELECT ?s ?x WHERE { ?s e:p ?v OPTIONAL { ?s e:q ?x } { ?x e:n ?n } }").collect()
    assert len(got) == 3 and all(r["x"] == "<urn:a>" for r in got)


def test_sparql_minus_without_shared_variables_keeps_all(quads):
    assert SE.run(quads, "PREFIX e: <urn:> SELECT ?s WHERE { ?s e:q ?o MINUS { ?x e:n ?y } }").count() == 1


def test_sparql_numbers_compare_by_value_and_errors_drop_rows(quads):
    assert SE.run(quads, "PREFIX e: <urn:> SELECT ?v WHERE { ?s e:p ?v FILTER(?v = 2) }").count() == 1
    assert SE.run(quads, "PREFIX e: <urn:> SELECT ?v WHERE { ?s e:p ?v FILTER(?v < 100) }").count() == 2


def test_sparql_collections_and_service(quads):
    q = "PREFIX e: <urn:> PREFIX r: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> SELECT ?i WHERE { e:l e:items/r:rest*/r:first ?i }"
    assert SE.run(quads, q).count() == 2
    with pytest.raises(UnsupportedQueryError):
        SE.run(quads, "SELECT * WHERE { SERVICE <urn:x> { ?s ?p ?o } }")


def test_text_utilities(spark):
    r = spark.range(1).select(T.ascii_fold(F.lit("Straße Éa")).alias("a"), T.damerau_levenshtein(F.lit("ab"), F.lit("ba")).alias("d"), F.round(T.jaro_winkler(F.lit("martha"), F.lit("marhta")), 3).alias("j"),
                              T.snowball_tokens(F.array(F.lit("running"), F.lit("happily"), F.lit("nationally"), F.lit("generously"))).alias("s")).first()
    assert (r["a"], r["d"], r["j"], r["s"]) == ("Strasse Ea", 1, 0.961, ["run", "happili", "nation", "generous"])


def test_engine_extensions_and_explain(spark, sf):
    from strataq.session import Engine

    e = Engine(spark, sf)
    e.register_source("big_nations", lambda x: x.table("nation").where("n_nationkey > 20"))
    assert e.spark.sql("SELECT count(*) AS n FROM big_nations").first()["n"] == 4
    e.register_command("count", lambda x, table: x.table(table).count())
    assert e.run("count", table="region") == 5
    q = e.query("orders").where("o_totalprice > 1000")
    assert "PushedFilters" in q.explain() and q.explain_analyze()["rows"] == q.count()
    assert e.statistics("nation", ["n_nationkey"]).first()["n_nationkey_distinct"] == 25
