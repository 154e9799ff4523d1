"""Sources, predicates, joins, set operations, ordering, DML."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq import sources
from strataq.operators import joins as J
from strataq.operators import records as R
from strataq.plans.query import Query
from strataq.plans.semantics import not_two_valued, order, two_valued
from strataq.queries.registry import both, query

col = F.col


@query("flagship_nation_orders", """
SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 1000
GROUP BY n_name HAVING count(*) >= 2 ORDER BY total DESC, n_name LIMIT 10""")
def flagship(e):
    """Filter, two joins, group, having, top-k: the dimension tables are broadcast by their measured size, if at all."""
    q = e.query("orders").where(col("o_totalprice") > 1000).join(e.table("customer"), col("o_custkey") == col("c_custkey")).join(e.table("nation"), col("c_nationkey") == col("n_nationkey"))
    a = q.aggregate().group_by("n_name").count("n_orders").sum("o_totalprice", "total").avg("o_totalprice", "mean").having("n_orders >= 2")
    return a.frame().select("n_name", "n_orders", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean")).orderBy(F.desc("total"), "n_name").limit(10)


# ---- sources
query("s1_full_scan", "SELECT * FROM nation")(lambda e: e.table("nation"))
query("s2_point_lookup", "SELECT * FROM orders WHERE o_orderkey = 42")(lambda e: e.query("orders").where(col("o_orderkey") == 42).frame())
query("s3_index_range_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 10 AND 20 AND o_orderstatus = 'F'")(
    lambda e: e.query("orders").use_index("by_customer").where(col("o_custkey").between(10, 20) & (col("o_orderstatus") == "F")).select("o_orderkey", "o_custkey"))
query("s4_covering_read", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000")(lambda e: e.query("customer").where(col("c_acctbal") > 9000).select("c_custkey", "c_acctbal"))
query("s5_batch_fetch", "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")(
    lambda e: e.query("customer").by_ids(e.table("orders").where("o_totalprice > 400000").select("o_custkey"), "o_custkey").frame())
query("s7_values", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS t(column0, column1)")(lambda e: sources.values(e.spark, [(1, "a"), (2, "b")], schema="column0 int, column1 string"))
both("s8_cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 300000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey")
both("s8_subquery_source", "SELECT t.k, t.n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) AS t WHERE t.n > 5")


@query("s9_polymorphic", """SELECT 'customer' AS __type, c_nationkey AS nationkey, c_name AS name FROM customer WHERE c_nationkey = 3
UNION ALL SELECT 'supplier', s_nationkey, s_name FROM supplier WHERE s_nationkey = 3""")
def polymorphic(e):
    c = e.table("customer").select(col("c_nationkey").alias("nationkey"), col("c_name").alias("name"))
    s = e.table("supplier").select(col("s_nationkey").alias("nationkey"), col("s_name").alias("name"))
    return sources.polymorphic({"customer": c, "supplier": s}).where("nationkey = 3")


query("s12_partition_scan", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")(lambda e: e.query("orders").partition("o_orderstatus", "P").select("o_orderkey"))


@query("s19_ntriples_ingest", """SELECT '<urn:n' || n_nationkey || '>' AS s, '<urn:name>' AS p, '"' || n_name || '"' AS o, NULL AS g FROM nation""")
def ntriples(e):
    lines = e.table("nation").select(F.concat(F.lit("<urn:n"), col("n_nationkey").cast("string"), F.lit('> <urn:name> "'), col("n_name"), F.lit('" .')).alias("value"))
    return sources.parse_ntriples(lines)


# ---- predicates and projection
both("p1_project_alias", "SELECT n.*, n_name AS label FROM nation AS n")
both("p2_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
both("p3_comparisons", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 49 AND l_discount < 0.03 AND l_returnflag <> 'N' AND l_tax <= 0.05 AND l_extendedprice > 1000 AND l_linenumber = 1")
both("p4_boolean", "SELECT p_partkey FROM part WHERE (p_size = 10 OR p_size = 20) AND NOT (p_brand = 'Brand#11')")
both("p5_is_null", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') IS NULL AS is_null FROM customer")
both("p6_in_list", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (1, 3, 5) AND s_suppkey NOT IN (1, 2)")
both("p7_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
both("p7_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
both("p7_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)")
both("p8_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1_' AND p_type NOT LIKE 'S%'")
both("p9_between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 110000")
query("p10_string_predicates", "SELECT p_partkey FROM part WHERE contains(p_name, '7') AND starts_with(p_brand, 'Brand') AND NOT ends_with(p_brand, '1')")(
    lambda e: e.query("part").where(col("p_name").contains("7") & col("p_brand").startswith("Brand") & ~col("p_brand").endswith("1")).select("p_partkey"))
query("p11_matches_any", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")(
    lambda e: e.query("orders").where(col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey"))
both("p12_case_when", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS class FROM customer")
query("p13_parameters", "SELECT c_custkey FROM customer WHERE c_nationkey = 7 AND c_acctbal > 100.5")(
    lambda e: e.sql("SELECT c_custkey FROM customer WHERE c_nationkey = :nation AND c_acctbal > :low", nation=7, low=100.5))
query("p14_row_filter", "SELECT n_nationkey FROM nation WHERE length(n_name) % 2 = 0")(lambda e: e.query("nation").where("length(n_name) % 2 = 0").select("n_nationkey"))


@query("p15_trigram_similarity", """
WITH g AS (SELECT n_nationkey, n_name, list_distinct(list_transform(range(1, length(n_name) - 1), lambda i: substr(lower(n_name), i, 3))) AS a FROM nation)
SELECT n_nationkey, round(2.0 * len(list_intersect(a, ['nat', 'ati', 'tio', 'ion', 'on_', 'n_1'])) / (len(a) + 6), 6) AS sim FROM g""")
def trigram(e):
    from strataq.functions.text import trigram_similarity

    return e.table("nation").select("n_nationkey", F.round(trigram_similarity("n_name", F.lit("NATION_1")), 6).alias("sim"))


query("n1_two_valued_logic", "SELECT c_custkey FROM customer WHERE NOT coalesce(nullif(c_mktsegment, 'BUILDING') = 'MACHINERY', false)")(
    lambda e: e.table("customer").where(not_two_valued(F.nullif("c_mktsegment", F.lit("BUILDING")) == "MACHINERY")).select("c_custkey"))
query("n3_null_is_false", "SELECT c_custkey FROM customer WHERE coalesce(nullif(c_mktsegment, 'BUILDING') <> 'MACHINERY', false)")(
    lambda e: e.table("customer").where(two_valued(F.nullif("c_mktsegment", F.lit("BUILDING")) != "MACHINERY")).select("c_custkey"))

# ---- scalar functions
both("f_arithmetic", "SELECT l_orderkey, l_linenumber, l_quantity + 1 AS a, l_quantity - l_tax AS b, l_extendedprice * (1 - l_discount) AS c, l_linenumber % 2 AS d, -l_linenumber AS e, l_extendedprice / l_quantity AS f FROM lineitem")
both("f_integer_division", "SELECT o_orderkey, o_custkey DIV 7 AS q FROM orders", "SELECT o_orderkey, o_custkey // 7 AS q FROM orders")
both("f_string", "SELECT n_nationkey, lower(n_name) AS a, upper(n_name) AS b, length(n_name) AS c FROM nation")
both("f_math", "SELECT c_custkey, abs(c_acctbal) AS a, floor(c_acctbal) AS b, ceil(c_acctbal) AS c FROM customer")
both("f_conditional", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS a FROM customer")
both("f_cast", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18, 2)) AS a, CAST(o_orderkey AS VARCHAR(20)) AS b, CAST(o_orderdate AS DATE) AS c FROM orders")

# ---- joins
both("j1_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
both("j1_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 350000")
both("j1_right", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'")
both("j1_full", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND s_acctbal > c_acctbal")
both("j1_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
both("j2_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
both("j3_using", "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y USING (k)")
query("j3_using_null_safe", "SELECT a, b FROM (SELECT nullif(n_regionkey, 0) AS k, n_name AS a FROM nation) x JOIN (SELECT nullif(r_regionkey, 0) AS k, r_name AS b FROM region) y ON x.k IS NOT DISTINCT FROM y.k")(
    lambda e: J.natural(e.table("nation").select(F.nullif("n_regionkey", F.lit(0)).alias("k"), col("n_name").alias("a")),
                        e.table("region").select(F.nullif("r_regionkey", F.lit(0)).alias("k"), col("r_name").alias("b")), null_safe=True).select("a", "b"))
both("j4_natural", "SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b")
both("j4_natural_left", "SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) a NATURAL LEFT JOIN (SELECT r_regionkey AS k, r_name FROM region) b")
both("j5_lateral", "SELECT r_regionkey, t.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) AS t")
query("j6_semi", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity = 50)")(
    lambda e: e.table("supplier").join(e.table("lineitem").where("l_quantity = 50"), col("s_suppkey") == col("l_suppkey"), "left_semi").select("s_suppkey"))
query("j6_anti", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")(
    lambda e: e.table("part").join(e.table("lineitem").where("l_quantity > 45"), col("p_partkey") == col("l_partkey"), "left_anti").select("p_partkey"))


@query("j13_as_of", """
SELECT a.event_id, b.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def as_of(e):
    ev = e.table("events")
    clicks = ev.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return J.as_of(ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, ["user_id"], "ts", ["value"]).select("event_id", "asof_value")


@query("j13_range", "SELECT o_orderkey, band FROM orders JOIN (SELECT n_nationkey AS band, n_nationkey * 20000 AS lo, n_nationkey * 20000 + 25000 AS hi FROM nation) ON o_totalprice >= lo AND o_totalprice < hi")
def range_join(e):
    spans = e.table("nation").select(col("n_nationkey").alias("band"), (col("n_nationkey") * 20000).alias("lo"), (col("n_nationkey") * 20000 + 25000).alias("hi"))
    return J.range_join(e.table("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", spans, "lo", "hi", 25000).select("o_orderkey", "band")


# ---- order, limits, pages
query("o1_order_nulls", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer ORDER BY seg DESC NULLS LAST, c_custkey LIMIT 50")(
    lambda e: e.table("customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg")).orderBy(*order([("seg", "desc", "last")], ["c_custkey"])).limit(50))
query("o2_multi_key_top", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 20")(
    lambda e: e.query("orders").order_by("o_orderpriority", ("o_totalprice", "desc")).limit(20).select("o_orderkey", "o_orderpriority", "o_totalprice"))
query("o4_limit_offset", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 25")(
    lambda e: e.query("customer").order_by(("c_acctbal", "desc")).offset(25).limit(10).select("c_custkey"))
query("o5_first", "SELECT * FROM supplier ORDER BY s_acctbal NULLS FIRST, s_suppkey LIMIT 1")(lambda e: e.query("supplier").order_by("s_acctbal").first())
query("o6_keyset_page", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 5000 OR (c_acctbal = 5000 AND c_custkey > 10) ORDER BY c_acctbal DESC, c_custkey LIMIT 15")(
    lambda e: e.query("customer").order_by(("c_acctbal", "desc")).after(c_acctbal=5000.0, c_custkey=10).limit(15).select("c_custkey", "c_acctbal"))


@query("o7_page_token", "SELECT o_orderkey FROM orders ORDER BY o_totalprice NULLS FIRST, o_orderkey LIMIT 10 OFFSET 10")
def page_token(e):
    q = e.query("orders").order_by("o_totalprice")
    _, token = q.page(10)
    return q.page(10, token)[0].select("o_orderkey")


query("o8_paginate", "SELECT p_partkey FROM part ORDER BY p_retailprice NULLS FIRST, p_partkey LIMIT 20 OFFSET 40")(lambda e: e.query("part").order_by("p_retailprice").paginate(3, 20).select("p_partkey"))
both("o9_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
both("o9_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
both("o10_intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
both("o11_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
query("o12_dedupe", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")(lambda e: e.table("lineitem").select("l_returnflag", "l_linestatus").dropDuplicates())
both("o13_window_functions", """SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS rk,
lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev,
round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving FROM orders""")
query("o14_row_budget", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 5")(lambda e: e.query("supplier").order_by("s_suppkey").capped(5)[0].select("s_suppkey"))

# ---- DML as final states
_NEW = "SELECT 3::INT AS r_regionkey, 'CHANGED' AS r_name UNION ALL SELECT 90::INT, 'NEW'"


def _new(e):
    return e.spark.createDataFrame([(3, "CHANGED"), (90, "NEW")], "r_regionkey int, r_name string")


query("s14_insert", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 91, 'X'")(
    lambda e: R.insert(e.table("region").select("r_regionkey", "r_name"), e.spark.createDataFrame([(91, "X")], "r_regionkey int, r_name string"), "r_regionkey"))
query("s14_on_conflict_nothing", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 90, 'NEW'")(lambda e: R.insert(e.table("region").select("r_regionkey", "r_name"), _new(e), "r_regionkey", "nothing"))
query("s14_on_conflict_update", "SELECT r_regionkey, CASE WHEN r_regionkey = 3 THEN r_name || '/CHANGED' ELSE r_name END AS r_name FROM region UNION ALL SELECT 90, 'NEW'")(
    lambda e: R.insert(e.table("region").select("r_regionkey", "r_name"), _new(e), "r_regionkey", "update", {"r_name": F.concat("r_name", F.lit("/"), "new.r_name")}))
query("s15_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")(
    lambda e: R.update(e.table("customer").select("c_custkey", "c_acctbal"), col("c_acctbal") < 0, {"c_acctbal": F.lit(0.0)}))
query("s16_delete", "SELECT n_nationkey FROM nation WHERE NOT (n_regionkey = 2)")(lambda e: R.delete(e.table("nation"), col("n_regionkey") == 2).select("n_nationkey"))


@query("s17_unit_of_work", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey NOT IN (1, 2) UNION ALL SELECT 2, 'two' UNION ALL SELECT 50, 'fifty'")
def unit_of_work(e):
    ch = e.spark.createDataFrame([(1, 2, "update", "gone"), (1, 5, "delete", None), (2, 3, "upsert", "two"), (50, 1, "insert", "fif"), (50, 4, "update", "fifty"), (77, 6, "update", "none")],
                                 "r_regionkey int, seq int, op string, r_name string")
    return R.apply_changes(e.table("region").select("r_regionkey", "r_name"), "r_regionkey", ch)


@query("s20_formats", "SELECT n_nationkey, n_name, 4::BIGINT AS copies FROM nation")
def formats(e):
    """The same rows through CSV, JSON, ORC and Parquet files."""
    import uuid

    from strataq.plans.lineage import shared_folder

    base = e.table("nation").select("n_nationkey", "n_name")
    root = f"{shared_folder(e.spark)}/formats-{uuid.uuid4().hex}"
    every = None
    for fmt in ("csv", "json", "orc", "parquet"):
        sources.write(base, f"{root}/{fmt}", fmt)
        got = sources.read(e.spark, f"{root}/{fmt}", fmt, schema="n_nationkey int, n_name string")
        every = got if every is None else every.union(got)
    return every.groupBy("n_nationkey", "n_name").agg(F.count(F.lit(1)).alias("copies"))


# ---- bitmaps, permuted keys, versions, relationships
query("b1_bitmap_equals_any", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#12', 'Brand#23')")(lambda e: R.bitmap_any(e.table("part"), "p_brand", ["Brand#12", "Brand#23"]).select("p_partkey"))
query("b1_bitmap_all", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#12', 'Brand#23', 'Brand#31') AND p_size IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)")(
    lambda e: R.bitmap_all(e.table("part"), {"p_brand": ["Brand#12", "Brand#23", "Brand#31"], "p_size": list(range(1, 11))}).select("p_partkey"))


@query("b1_bitmap_values", """SELECT (SELECT count(*) FROM part WHERE p_size IN (5, 7)) AS any_n, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_returnflag = 'A'
AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) AS both_n""")
def bitmap_values(e):
    """Bitmaps as values: union of two sizes; orders that have lines of both flags."""
    sizes = R.bitmaps(e.table("part"), "p_partkey", "p_size").where("key in (5, 7)")
    flags = R.bitmaps(e.table("lineitem"), "l_orderkey", "l_returnflag")
    a = R.bitmap_cardinality(R.bitmap_union(sizes)).withColumnRenamed("n", "any_n")
    return a.join(F.broadcast(R.bitmap_cardinality(R.bitmap_intersect(flags, ["A", "R"])).withColumnRenamed("n", "both_n")))


@query("b2_set_algebra", """
WITH a AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_quantity > 48), b AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_discount > 0.09)
SELECT 'and' AS op, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'or', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)
UNION ALL SELECT 'and_not', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'xor', count(*) FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION (SELECT * FROM b EXCEPT SELECT * FROM a))
UNION ALL SELECT 'not', count(*) FROM (SELECT s_suppkey FROM supplier EXCEPT SELECT * FROM a) UNION ALL SELECT 'range', count(*) FROM a WHERE id BETWEEN 5 AND 50""")
def set_algebra(e):
    li = e.table("lineitem").withColumnRenamed("l_suppkey", "id")
    a, b = R.Ids(li.where("l_quantity > 48")), R.Ids(li.where("l_discount > 0.09"))
    universe = e.table("supplier").withColumnRenamed("s_suppkey", "id")
    parts = {"and": a & b, "or": a | b, "and_not": a - b, "xor": a ^ b, "not": a.complement(universe), "range": a.between(5, 50)}
    out = None
    for k, v in parts.items():
        row = v.df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("op"), "n")
        out = row if out is None else out.union(row)
    return out


query("b3_distinct_values", "SELECT DISTINCT p_brand FROM part")(lambda e: e.table("part").select("p_brand").distinct())
query("m1_permuted_prefix", "SELECT p_partkey, p_type, p_brand FROM part WHERE p_type = (SELECT min(p_type) FROM part) ORDER BY p_type, p_brand, p_partkey")(
    lambda e: R.permuted(e.table("part").join(F.broadcast(e.table("part").agg(F.min("p_type").alias("p_type"))), "p_type"), ["p_type", "p_brand"], (), "p_partkey").select("p_partkey", "p_type", "p_brand"))

_V = "(SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v, ts, event_type, value, event_id FROM events)"


def _versions(e):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.table("events").select("user_id", F.row_number().over(w).cast("long").alias("v"), "ts", "event_type", "value", "event_id")


query("k1_history", f"SELECT user_id, v, event_id FROM {_V} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY v DESC) <= 3")(lambda e: R.history(_versions(e), "user_id", "v", 3).select("user_id", "v", "event_id"))
query("k1_latest", f"SELECT user_id, max(v) AS v, arg_max(event_id, v) AS event_id FROM {_V} GROUP BY user_id")(lambda e: R.latest(_versions(e), "user_id", "v").select("user_id", "v", "event_id"))
query("k1_at_version", f"SELECT user_id, max(v) AS v, arg_max(event_id, v) AS event_id FROM {_V} WHERE v <= 5 GROUP BY user_id")(lambda e: R.at_version(_versions(e), "user_id", "v", 5).select("user_id", "v", "event_id"))
query("k2_keep_last", f"SELECT user_id, v FROM {_V} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY v DESC) <= 2")(lambda e: R.keep_last(_versions(e), "user_id", "v", 2).select("user_id", "v"))


@query("k2_keep_for_duration", f"""SELECT user_id, v FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM {_V})
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY OR ts = m""")
def keep_for(e):
    now = e.table("events").agg(F.max("ts")).first()[0]
    return R.keep_for(_versions(e), "user_id", "ts", now, 5 * 86400).select("user_id", "v")


query("k3_deletion_markers", f"SELECT user_id FROM {_V} GROUP BY user_id HAVING arg_max(event_type, v) <> 'logout'")(
    lambda e: R.latest(_versions(e).withColumn("gone", col("event_type") == "logout"), "user_id", "v", "gone").select("user_id"))


@query("k4_diff_previous", f"""
WITH d AS (SELECT user_id, v, event_type AS n1, value AS n2, lag(event_type) OVER w AS o1, lag(value) OVER w AS o2, lag(v) OVER w AS pv FROM {_V} WINDOW w AS (PARTITION BY user_id ORDER BY v))
SELECT user_id, v, field, change FROM (
 SELECT user_id, v, 'event_type' AS field, CASE WHEN o1 IS NULL THEN 'added' WHEN n1 IS NULL THEN 'removed' ELSE 'modified' END AS change FROM d WHERE pv IS NOT NULL AND o1 IS DISTINCT FROM n1
 UNION ALL SELECT user_id, v, 'value', CASE WHEN o2 IS NULL THEN 'added' WHEN n2 IS NULL THEN 'removed' ELSE 'modified' END FROM d WHERE pv IS NOT NULL AND o2 IS DISTINCT FROM n2)""")
def diff_previous(e):
    return R.diff(_versions(e), "user_id", "v", ["event_type", "value"]).select("user_id", "v", "field", "change")


query("k4_diff_latest", f"""WITH d AS (SELECT user_id, v, event_type AS n, last_value(event_type) OVER (PARTITION BY user_id ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS o FROM {_V})
SELECT user_id, v, o AS old, n AS new FROM d WHERE o IS DISTINCT FROM n""")(lambda e: R.diff(_versions(e), "user_id", "v", ["event_type"], "latest").select("user_id", "v", "old", "new"))

query("e1_forward", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")(
    lambda e: R.forward(e.table("orders"), "o_custkey", e.table("customer"), "c_custkey").select("o_orderkey", "c_name"))
query("e1_inverse", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 4")(
    lambda e: R.forward(e.table("customer").where("c_nationkey = 4"), "c_custkey", e.table("orders"), "o_custkey", "inner").select("c_custkey", "o_orderkey"))
query("j11_to_many", "SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")(
    lambda e: R.to_many(e.table("customer").select("c_custkey"), "c_custkey", e.table("orders"), "o_custkey", ["o_orderkey"], "os")
    .select("c_custkey", F.array_join(F.transform("os", lambda s: s["o_orderkey"].cast("string")), ",").alias("orders")))


def _rule(e, rule):
    gone = e.table("customer").where("c_nationkey = 1").select("c_custkey")
    return R.delete_with_rule(e.table("customer"), "c_custkey", gone, e.table("orders").select("o_orderkey", "o_custkey"), "o_custkey", rule)


query("e2_delete_cascade", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 1)")(lambda e: _rule(e, "cascade")[1].select("o_orderkey", "o_custkey"))
query("e2_delete_nullify", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 1) THEN NULL ELSE o_custkey END AS o_custkey FROM orders")(lambda e: _rule(e, "nullify")[1])
query("u1_unique_violations", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")(lambda e: R.violations(e.table("orders"), ["o_custkey"]))

# ---- statistics, security, scrubbing
query("z1_most_common", "SELECT o_orderpriority AS value, count(*) AS n, count(*) / (SELECT count(*) FROM orders)::DOUBLE AS frequency FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3")(
    lambda e: R.most_common(e.table("orders"), "o_orderpriority", 3))
query("z1_selectivity", "SELECT count(*) FILTER (l_quantity < 10) / count(*)::DOUBLE AS selectivity FROM lineitem")(lambda e: R.selectivity(e.table("lineitem"), col("l_quantity") < 10))
query("z1_column_stats", "SELECT count(*) AS rows, count(c_nationkey) AS c_nationkey_count, count(DISTINCT c_nationkey) AS c_nationkey_distinct, min(c_nationkey) AS c_nationkey_min, max(c_nationkey) AS c_nationkey_max FROM customer")(
    lambda e: R.column_stats(e.table("customer"), ["c_nationkey"]))
query("z1_equi_depth_histogram", "SELECT true AS balanced, count(*) AS n FROM lineitem")(
    lambda e: R.equi_depth(e.table("lineitem"), "l_extendedprice", 10).agg((F.max("n") < 2 * F.min("n")).alias("balanced"), F.sum("n").alias("n")))
query("z1_reservoir", "SELECT 100::BIGINT AS n, 100::BIGINT AS d")(lambda e: R.reservoir(e.table("orders"), "o_orderkey", 100).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(col("o_orderkey")).alias("d")))
query("z3_scrub", "SELECT o_orderkey, 'missing' AS problem FROM orders WHERE o_orderkey % 100 = 0")(
    lambda e: R.scrub(e.table("orders"), e.table("orders").where("o_orderkey % 100 <> 0"), ["o_orderkey"]))
query("z4_security", "SELECT c_custkey, '***' AS c_name, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey = 6")(
    lambda e: R.secured(e.table("customer"), col("c_nationkey") == 6, {"c_name": F.lit("***")}, ["c_acctbal"]))
