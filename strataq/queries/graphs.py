"""Property graphs, traversal, graph algorithms."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataq.graph import algorithms as A
from strataq.graph.sqlpgq import MatchBuilder, label_matches
from strataq.plans.prefix import with_next
from strataq.queries.registry import query

col = F.col
_DDL = """CREATE PROPERTY GRAPH shop VERTEX TABLES (customer AS c KEY (c_custkey) LABEL person, orders AS o KEY (o_orderkey) LABEL purchase, nation AS n KEY (n_nationkey) LABEL place)
EDGE TABLES (orders AS placed KEY (o_orderkey) SOURCE KEY (o_custkey) REFERENCES c (c_custkey) DESTINATION KEY (o_orderkey) REFERENCES o (o_orderkey) LABEL placed PROPERTIES (o_totalprice, o_orderstatus),
customer AS lives KEY (c_custkey) SOURCE KEY (c_custkey) REFERENCES c (c_custkey) DESTINATION KEY (c_nationkey) REFERENCES n (n_nationkey) LABEL lives_in NO PROPERTIES)"""
# region -> nation -> customer -> order -> part and nation -> supplier -> part: acyclic, of depth 4, with hubs
_DAG = """(SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, (n_nationkey % 3 + 1)::DOUBLE AS weight FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, (c_custkey % 3 + 1)::DOUBLE FROM customer
UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, (s_suppkey % 5 + 1)::DOUBLE FROM supplier UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, (o_orderkey % 4 + 1)::DOUBLE FROM orders
UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey, ((l_suppkey + l_partkey) % 7 + 1)::DOUBLE FROM lineitem UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, ((l_orderkey + l_partkey) % 3 + 1)::DOUBLE FROM lineitem)"""
# from the user of an event to the user of the next one: cyclic, dense
_NEXT = "(SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL AND src <> dst)"
_REACH = "WITH RECURSIVE e AS (SELECT src, dst FROM {g}), r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) "


def _dag(e, once=True):
    """once=False: an edge comes as often as its line items do, which saves a shuffle where that changes nothing."""
    def edges(table, src, dst, weight):
        (a, k), (b, n) = src, dst
        df = e.table(table)
        df = df.select(k, n).distinct() if table == "lineitem" and once else df  # equal numbers are equal edges
        return df.select(F.concat(F.lit(a), k).alias("src"), F.concat(F.lit(b), n).alias("dst"), F.expr(weight).cast("double").alias("weight"))

    r, n, c, s, o, p = "rncsop"
    return (edges("nation", (r, "n_regionkey"), (n, "n_nationkey"), "n_nationkey % 3 + 1").union(edges("customer", (n, "c_nationkey"), (c, "c_custkey"), "c_custkey % 3 + 1"))
            .union(edges("supplier", (n, "s_nationkey"), (s, "s_suppkey"), "s_suppkey % 5 + 1")).union(edges("orders", (c, "o_custkey"), (o, "o_orderkey"), "o_orderkey % 4 + 1"))
            .union(edges("lineitem", (s, "l_suppkey"), (p, "l_partkey"), "(l_suppkey + l_partkey) % 7 + 1")).union(edges("lineitem", (o, "l_orderkey"), (p, "l_partkey"), "(l_orderkey + l_partkey) % 3 + 1")))


def _next(e):
    at = with_next(e.table("events").select("ts", "event_id", "user_id"), ["ts", "event_id"], "user_id", "dst")
    return at.select(col("user_id").alias("src"), "dst").where("src <> dst").distinct()


def _supply(e, once=True):
    """Supplier -> part edges of the line items."""
    df = e.table("lineitem").select("l_suppkey", "l_partkey")
    return (df.distinct() if once else df).select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))


query("x1_edge_scan", "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey = 3")(lambda e: e.table("lineitem").where("l_suppkey = 3").select("l_suppkey", "l_partkey").distinct())


@query("x2_graph_table_1hop", "SELECT o_custkey AS customer, o_orderkey AS purchase, o_orderstatus AS status FROM orders WHERE o_totalprice > 400000")
def hop1(e):
    e.sql(_DDL)
    return e.sql("SELECT customer, purchase, status FROM GRAPH_TABLE (shop, MATCH (a:person)-[b:placed]->(x) WHERE CAST(b.o_totalprice AS DOUBLE) > 400000 COLUMNS (a.id AS customer, x.id AS purchase, b.o_orderstatus AS status)) AS g")


@query("x2_graph_table_2hop", "SELECT o_orderkey AS purchase, c_nationkey AS nation, 'placed' AS l1, 'lives_in' AS l2 FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 5")
def hop2(e):
    e.sql(_DDL)
    return e.sql("SELECT * FROM GRAPH_TABLE (shop, MATCH (o)<-[p:placed]-(c)-[l:lives_in]->(n {id: 5}) COLUMNS (o.id AS purchase, n.id AS nation, p.label AS l1, l.label AS l2)) AS g")


@query("x2_graph_table_undirected", "SELECT c_custkey AS a, c_nationkey AS b FROM customer UNION ALL SELECT c_nationkey, c_custkey FROM customer")
def undirected(e):
    e.sql(_DDL)
    return e.sql("SELECT * FROM GRAPH_TABLE (shop, MATCH (x)-[l:lives_in]-(y) COLUMNS (x.id AS a, y.id AS b)) AS g")


@query("x2_edge_property_and_aggregate", "SELECT o_custkey AS a, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey")
def edge_property(e):
    e.sql(_DDL)
    return e.sql("SELECT a, count(*) AS n FROM GRAPH_TABLE (shop, MATCH (x)-[b:placed {o_orderstatus: 'P'}]->(y) COLUMNS (x.id AS a)) AS g GROUP BY a")


@query("x2_shared_variable", "SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey WHERE a.c_nationkey = 7")
def shared(e):
    e.sql(_DDL)
    return e.sql("SELECT x, y FROM GRAPH_TABLE (shop, MATCH (a)-[:lives_in]->(n {id: 7}), (b)-[:lives_in]->(n) WHERE a.id < b.id COLUMNS (a.id AS x, b.id AS y)) AS g")


@query("x3_label_expressions", "SELECT true AS a, true AS b, false AS c")
def labels(e):
    vals = [label_matches("person | place", {"place"}), label_matches("(person | place) & gold", {"gold", "place"}), label_matches("person & gold", {"person"})]
    return e.spark.createDataFrame([tuple(vals)], "a boolean, b boolean, c boolean")


@query("x4_path_modes", """WITH e AS (SELECT * FROM (VALUES (1,2),(2,3),(3,1),(3,4)) t(s,d)), w AS (SELECT a.s AS n1, a.d AS n2, b.d AS n3, c.d AS n4 FROM e a JOIN e b ON a.d = b.s JOIN e c ON b.d = c.s)
SELECT 'walk' AS mode, count(*) AS n FROM w UNION ALL SELECT 'acyclic', count(*) FROM w WHERE n1 NOT IN (n2, n3, n4) AND n2 NOT IN (n3, n4) AND n3 <> n4
UNION ALL SELECT 'trail', count(*) FROM w UNION ALL SELECT 'simple', count(*) FROM w WHERE n2 NOT IN (n1, n3, n4) AND n3 NOT IN (n1, n4)""")
def path_modes(e):
    g = e.spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    out = None
    for mode in ("walk", "acyclic", "trail", "simple"):
        row = A.path_pattern(g, None, 3, 3, mode).agg(F.count(F.lit(1)).alias("n")).select(F.lit(mode).alias("mode"), "n")
        out = row if out is None else out.union(row)
    return out


_FROM = "WITH RECURSIVE e AS (SELECT src, dst FROM {g}), r(id, depth) AS (SELECT {start}, 0 UNION SELECT e.dst, depth + 1 FROM r JOIN e ON r.id = e.src WHERE depth < {most}) "
query("x5_traverse", _FROM.format(g=_DAG, start="'s3'", most=3) + "SELECT id, min(depth) AS depth FROM r GROUP BY id")(lambda e: A.traverse(_dag(e, once=False), "s3", 3)[0])
query("x6_path_length_range", f"""WITH e AS (SELECT src, dst FROM {_DAG}) SELECT a.src AS a, b.dst AS z, 2 AS length FROM e a JOIN e b ON a.dst = b.src WHERE a.src[1] = 'r'
UNION ALL SELECT a.src, c.dst, 3 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src WHERE a.src[1] = 'r'""")(
    lambda e: A.path_pattern(_dag(e), e.table("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id")), 2, 3).select(F.get("path", F.lit(0)).alias("a"), F.element_at("path", -1).alias("z"), "length"))


@query("x7_match_builder", "SELECT c_custkey AS a, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def builder(e):
    e.sql(_DDL)
    path = MatchBuilder().node("a", "person").out("placed", "b").node("x").text
    return e.sql(f"SELECT a, count(*) AS n FROM GRAPH_TABLE (shop, MATCH {path} COLUMNS (a.id AS a)) AS g GROUP BY a")


# ---- algorithms
_LEAST = "(SELECT min(user_id) FROM events)"


def _least_user(e):
    return e.table("events").agg(F.min("user_id").alias("id"))


query("h8_bfs_levels", _FROM.format(g=_NEXT, start=_LEAST, most=12) + "SELECT id, min(depth) AS depth FROM r GROUP BY id")(lambda e: A.bfs(_next(e), _least_user(e)))
query("h8_all_shortest_paths", f"WITH e AS (SELECT src, dst FROM {_DAG}) SELECT concat_ws('-', a.src, b.src, c.src, c.dst) AS path FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src WHERE a.src = 'r0' AND c.dst = 'p1' ")(
    lambda e: A.shortest_paths(_dag(e, once=False), "r0", "p1", every=True).select(F.array_join("path", "-").alias("path")))
_FAR = f"WITH RECURSIVE e AS (SELECT * FROM {_DAG}), r(id, d) AS (SELECT 'r1', 0::DOUBLE UNION SELECT e.dst, d + weight FROM r JOIN e ON r.id = e.src) "
query("h9_dijkstra", _FAR + "SELECT id, min(d) AS distance FROM r GROUP BY id")(lambda e: A.dijkstra(_dag(e, once=False), "r1"))
query("h9_weighted_path", _FAR + "SELECT min(d) AS distance FROM r WHERE id = 'p2'")(lambda e: A.weighted_path(_dag(e, once=False), "r1", "p2").select("distance"))
query("transitive_closure", _REACH.format(g=_DAG) + "SELECT src, dst FROM r")(lambda e: A.closure(_dag(e, once=False)))


def _pr_sql(rounds: int, personal: str | None = None) -> str:
    tele = "1 / (SELECT n FROM c)" if personal is None else f"(n.id = {personal})::INT::DOUBLE"
    ctes = [f"e AS MATERIALIZED (SELECT * FROM {_NEXT}), n AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), c AS (SELECT count(*)::DOUBLE AS n FROM n), d AS (SELECT src, count(*)::DOUBLE AS k FROM e GROUP BY src), "
            f"s0 AS MATERIALIZED (SELECT id, {tele} AS s FROM n)"]
    for i in range(rounds):
        ctes.append(f"s{i + 1} AS MATERIALIZED (SELECT n.id, 0.15::DOUBLE * {tele} + 0.85::DOUBLE * (coalesce(g.g, 0) + {tele} * coalesce((SELECT sum(s) FROM s{i} WHERE id NOT IN (SELECT src FROM d)), 0)) AS s "
                    f"FROM n LEFT JOIN (SELECT e.dst, sum(s{i}.s / d.k) AS g FROM e JOIN s{i} ON s{i}.id = e.src JOIN d ON d.src = e.src GROUP BY e.dst) g ON g.dst = n.id)")
    return f"WITH {', '.join(ctes)} SELECT id, round(s, 9) AS score FROM s{rounds}"


query("h1_pagerank", _pr_sql(4))(lambda e: A.pagerank(_next(e), rounds=4, tolerance=0).select("id", F.round("score", 9).alias("score")))
query("h2_personalized_pagerank", _pr_sql(5, _LEAST))(
    lambda e: A.pagerank(_next(e), rounds=5, tolerance=0, personal=_least_user(e).first()["id"]).select("id", F.round("score", 9).alias("score")))


def _lp_sql(rounds: int) -> str:
    ctes = [f"b AS MATERIALIZED (SELECT src, dst FROM {_NEXT} UNION SELECT dst, src FROM {_NEXT}), l0 AS (SELECT DISTINCT src AS id, src AS label FROM b)"]
    for i in range(rounds):
        ctes.append(f"l{i + 1} AS MATERIALIZED (SELECT dst AS id, label FROM (SELECT dst, label, count(*) AS n FROM b JOIN l{i} ON id = src GROUP BY dst, label) QUALIFY row_number() OVER (PARTITION BY dst ORDER BY n DESC, label) = 1)")
    return f"WITH {', '.join(ctes)} SELECT id, label FROM l{rounds}"


query("h3_label_propagation", _lp_sql(3))(lambda e: A.label_propagation(_next(e), rounds=3))
query("h3_modularity", f"""WITH b AS (SELECT DISTINCT least(src, dst) AS s, greatest(src, dst) AS d FROM {_NEXT}), m AS (SELECT count(*)::DOUBLE AS m FROM b), k AS (SELECT l, count(*) AS k FROM (SELECT s % 5 AS l FROM b UNION ALL SELECT d % 5 FROM b) GROUP BY l)
SELECT round((SELECT count(*) FROM b WHERE s % 5 = d % 5) / (2 * m) - (SELECT sum(k * k) FROM k)::DOUBLE / (8 * m * m), 9) AS modularity FROM m""")(
    lambda e: (lambda g: A.modularity(g, A.nodes(g).withColumn("label", col("id") % 5)).select(F.round("modularity", 9).alias("modularity")))(_next(e)))
query("h4_local_community", f"WITH RECURSIVE e AS (SELECT src, dst FROM {_DAG} UNION SELECT dst, src FROM {_DAG}), r(id, depth) AS (SELECT 's3', 0 UNION SELECT e.dst, depth + 1 FROM r JOIN e ON r.id = e.src WHERE depth < 2) SELECT id, min(depth) AS depth FROM r GROUP BY id")(
    lambda e: A.local_community(_dag(e, once=False), "s3", 2))
query("h5_find_cycles", f"WITH e AS MATERIALIZED (SELECT * FROM {_NEXT}) SELECT a.src || '-' || a.dst AS c FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst UNION ALL "
      "SELECT a.src || '-' || a.dst || '-' || b.dst FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst")(
    lambda e: A.find_cycles(_next(e), max_length=3).select(F.array_join("path", "-").alias("c")))
query("h5_cycle_checks", f"""SELECT true AS dag, EXISTS (SELECT 1 FROM {_NEXT} a JOIN {_NEXT} b ON a.dst = b.src AND b.dst = a.src) AS cyclic,
EXISTS (SELECT 1 FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE n_regionkey = 0 AND l_partkey = 1)
OR EXISTS (SELECT 1 FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON l_suppkey = s_suppkey WHERE n_regionkey = 0 AND l_partkey = 1) AS would, false AS would_not""")(
    lambda e: (lambda d: e.spark.createDataFrame([(not A.has_cycle(d), A.has_cycle(_next(e)), A.would_create_cycle(d, "p1", "r0"), A.would_create_cycle(d, "r0", "p1"))],
                                                 "dag boolean, cyclic boolean, would boolean, would_not boolean"))(A.Links(_dag(e, once=False))))
_SCC = _REACH.format(g="{g}") + ", n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), m AS (SELECT a.src AS id, a.dst AS o FROM r a JOIN r b ON b.src = a.dst AND b.dst = a.src), c AS (SELECT n.id, least(n.id, coalesce(min(m.o), n.id)) AS c FROM n LEFT JOIN m ON m.id = n.id GROUP BY n.id) "
# the users' graph, with the way back to each user only where its number is even: strong components of different sizes
_ONEWAY = f"(SELECT src, dst FROM {_NEXT} WHERE src < dst OR (src % 2 = 0 AND dst % 2 = 0))"


def _oneway(e):
    return _next(e).where("src < dst or (src % 2 = 0 and dst % 2 = 0)")


query("h6_scc", _SCC.format(g=_ONEWAY) + "SELECT id, c AS component FROM c")(lambda e: A.scc(_oneway(e)))
query("h6_condensation", _SCC.format(g=_ONEWAY) + "SELECT DISTINCT x.c AS src, y.c AS dst FROM e JOIN c x ON x.id = e.src JOIN c y ON y.id = e.dst WHERE x.c <> y.c")(lambda e: A.condensation(_oneway(e)))
_LONG = f"WITH RECURSIVE e AS (SELECT src, dst FROM {_DAG}), r(id, l) AS (SELECT DISTINCT src, 0 FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, l + 1 FROM r JOIN e ON r.id = e.src) "
query("h7_topological_levels", _LONG + "SELECT id, max(l) AS level FROM r GROUP BY id")(lambda e: A.topological_levels(_dag(e, once=False))[0])
query("h7_critical_path", f"""WITH RECURSIVE e AS (SELECT * FROM {_DAG}), r(id, l) AS (SELECT DISTINCT src, 0::DOUBLE FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, l + weight FROM r JOIN e ON r.id = e.src)
SELECT id, max(l) AS distance FROM r GROUP BY id""")(lambda e: A.critical_path(_dag(e, once=False)))
query("h7_dependencies", _REACH.format(g=_DAG) + "SELECT dst AS id FROM r WHERE src = 'n5'")(lambda e: A.dependencies(_dag(e, once=False), "n5"))
query("h7_dependents", _REACH.format(g=_DAG) + "SELECT src AS id FROM r WHERE dst = 'p9'")(lambda e: A.dependents(_dag(e, once=False), "p9"))
#: No SQL: a recursion from every node is too slow on whole tables. tests/test_whole.py holds it against union-find.
query("h10_components")(lambda e: A.run_algorithm("components", _supply(e, once=False)))
query("h11_limited", "SELECT 10::BIGINT AS n, false AS complete, 'maxResults' AS reason")(
    lambda e: (lambda r: r[0].agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(r[1]).alias("complete"), F.lit(r[2]).alias("reason")))(A.limited(_supply(e).orderBy("src", "dst"), 10)))
query("f8_connected_score", _FROM.format(g=_DAG, start="'n2'", most=3) + "SELECT id, round(1.0::DOUBLE / min(depth), 6) AS score FROM r GROUP BY id HAVING min(depth) > 0")(
    lambda e: A.bfs(_dag(e, once=False), e.spark.sql("SELECT 'n2' AS id"), 3).where("depth > 0").select("id", F.round(1 / col("depth"), 6).alias("score")))
