"""SPARQL, entailment, SHACL over quads made of the tables: customers, nations and regions in the default graph, suppliers in a named one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from strataq.queries.registry import query
from strataq.reason import rules as RU
from strataq.reason import shacl as SH
from strataq.sparql import engine as SE

col = F.col
P = "PREFIX e: <urn:> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> PREFIX owl: <http://www.w3.org/2002/07/owl#> "
INT = f"^^<{SE.XSD}integer>"
DEC = f"^^<{SE.XSD}double>"


def quads(e):
    def iri(kind, c):
        return F.concat(F.lit(f"<urn:{kind}/"), col(c).cast("string"), F.lit(">"))

    def s(c):
        return F.concat(F.lit('"'), col(c).cast("string"), F.lit('"'))

    def n(c, t=INT):
        return F.concat(F.lit('"'), col(c).cast("string"), F.lit('"' + t))

    c, na, r, su = e.table("customer"), e.table("nation"), e.table("region"), e.table("supplier")

    def rows(df, subj, items, g=None):
        arr = F.array(*[F.struct(F.lit(f"<{p}>" if not p.startswith("<") else p).alias("p"), o.alias("o")) for p, o in items])
        return df.select(F.lit(g).cast("string").alias("g"), subj.alias("s"), F.explode(arr).alias("t")).select("g", "s", "t.p", "t.o").where("o is not null")

    typ = RU.TYPE
    return reduce(lambda a, b: a.union(b), [
        rows(c, iri("customer", "c_custkey"), [(typ, F.lit("<urn:Customer>")), ("urn:name", s("c_name")), ("urn:balance", n("c_acctbal", DEC)), ("urn:nation", iri("nation", "c_nationkey")),
                                               ("urn:segment", F.when(col("c_mktsegment") != "BUILDING", s("c_mktsegment")))]),
        rows(na, iri("nation", "n_nationkey"), [(typ, F.lit("<urn:Nation>")), ("urn:name", s("n_name")), ("urn:region", iri("region", "n_regionkey")), ("urn:key", n("n_nationkey"))]),
        rows(r, iri("region", "r_regionkey"), [(typ, F.lit("<urn:Region>")), ("urn:name", s("r_name"))]),
        rows(su, iri("supplier", "s_suppkey"), [(typ, F.lit("<urn:Supplier>")), ("urn:name", s("s_name")), ("urn:nation", iri("nation", "s_nationkey"))], "<urn:suppliers>")])


_C = "customer"
_I = "'<urn:{0}/' || {1} || '>'"


def _i(kind, c):
    return _I.format(kind, c)


def _s(c):
    return f"""'"' || {c} || '"'"""


def _n(c):
    return f"""'"' || {c} || '"{INT}'"""


def sparql(name: str, text: str, sql: str | None = None):
    query(name, sql)(lambda e: SE.run(quads(e), P + text))


sparql("q1_bgp", "SELECT ?c ?n WHERE { ?c a e:Customer ; e:nation ?x . ?x e:name ?n }", f"SELECT {_i('customer', 'c_custkey')} AS c, {_s('n_name')} AS n FROM {_C} JOIN nation ON n_nationkey = c_nationkey")
sparql("q2_join_three", "SELECT ?n ?r WHERE { ?c e:nation ?n . { ?n e:region ?r . ?r a e:Region } }", f"SELECT {_i('nation', 'c_nationkey')} AS n, {_i('region', 'n_regionkey')} AS r FROM {_C} JOIN nation ON n_nationkey = c_nationkey")
sparql("q3_optional", "SELECT ?c ?s WHERE { ?c a e:Customer OPTIONAL { ?c e:segment ?s } }", f"SELECT {_i('customer', 'c_custkey')} AS c, CASE WHEN c_mktsegment <> 'BUILDING' THEN {_s('c_mktsegment')} END AS s FROM {_C}")
sparql("q3_optional_filter", "SELECT ?c ?s WHERE { ?c a e:Customer OPTIONAL { ?c e:segment ?s FILTER(?s = \"MACHINERY\") } }",
       f"SELECT {_i('customer', 'c_custkey')} AS c, CASE WHEN c_mktsegment = 'MACHINERY' THEN {_s('c_mktsegment')} END AS s FROM {_C}")
sparql("q4_union", "SELECT ?x ?k ?b WHERE { { ?x e:key ?k } UNION { ?x e:balance ?b FILTER(?b > 9000) } }",
       f"SELECT {_i('nation', 'n_nationkey')} AS x, {_n('n_nationkey')} AS k, NULL AS b FROM nation UNION ALL SELECT {_i('customer', 'c_custkey')}, NULL, '\"' || c_acctbal || '\"{DEC}' FROM {_C} WHERE c_acctbal > 9000")
sparql("q5_filter", "SELECT ?c WHERE { ?c e:balance ?b ; e:segment ?s . FILTER(?b >= 1000 && (?b < 5000 || ?s = \"MACHINERY\") && ?s != \"HOUSEHOLD\") }",
       f"SELECT {_i('customer', 'c_custkey')} AS c FROM {_C} WHERE c_mktsegment <> 'BUILDING' AND c_acctbal >= 1000 AND (c_acctbal < 5000 OR c_mktsegment = 'MACHINERY') AND c_mktsegment <> 'HOUSEHOLD'")
sparql("q5_filter_error_is_false", "SELECT ?c WHERE { ?c e:name ?b FILTER(!(?b > 3)) }", "SELECT 'x' AS c WHERE false")
sparql("q6_bind", "SELECT ?n ?d WHERE { ?n e:key ?k BIND(?k * 2 + 1 AS ?d) }", f"SELECT {_i('nation', 'n_nationkey')} AS n, {_n('(n_nationkey * 2 + 1)')} AS d FROM nation")
sparql("q7_values", "SELECT ?n ?m WHERE { ?n e:name ?m VALUES ?m { \"NATION_1\" \"NATION_2\" \"X\" } }", f"SELECT {_i('nation', 'n_nationkey')} AS n, {_s('n_name')} AS m FROM nation WHERE n_name IN ('NATION_1', 'NATION_2', 'X')")
sparql("q7_values_undef", "SELECT ?n ?k ?m WHERE { ?n e:key ?k ; e:name ?m . VALUES (?k ?m) { (1 UNDEF) (UNDEF \"NATION_2\") } }",
       f"SELECT {_i('nation', 'n_nationkey')} AS n, {_n('n_nationkey')} AS k, {_s('n_name')} AS m FROM nation WHERE n_nationkey = 1 UNION ALL SELECT {_i('nation', 'n_nationkey')}, {_n('n_nationkey')}, {_s('n_name')} FROM nation WHERE n_name = 'NATION_2'")
sparql("q8_graph", "SELECT ?g ?s WHERE { GRAPH ?g { ?s a e:Supplier } }", f"SELECT '<urn:suppliers>' AS g, {_i('supplier', 's_suppkey')} AS s FROM supplier")
sparql("q8_named_graph_join", "SELECT ?s ?n WHERE { GRAPH e:suppliers { ?s e:nation ?x } ?x e:name ?n }", f"SELECT {_i('supplier', 's_suppkey')} AS s, {_s('n_name')} AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey")
sparql("q8_from", "SELECT ?s FROM <urn:suppliers> WHERE { ?s a e:Supplier }", f"SELECT {_i('supplier', 's_suppkey')} AS s FROM supplier")
sparql("q9_minus", "SELECT ?c WHERE { ?c a e:Customer MINUS { ?c e:segment ?s } }", f"SELECT {_i('customer', 'c_custkey')} AS c FROM {_C} WHERE c_mktsegment = 'BUILDING'")
sparql("q10_exists", "SELECT ?n WHERE { ?n a e:Nation FILTER EXISTS { ?c e:nation ?n ; e:balance ?b FILTER(?b > 8000) } }", f"SELECT {_i('nation', 'n_nationkey')} AS n FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM {_C} WHERE c_acctbal > 8000)")
sparql("q10_not_exists", "SELECT ?n WHERE { ?n a e:Nation FILTER NOT EXISTS { ?c e:nation ?n ; a e:Customer } }", f"SELECT {_i('nation', 'n_nationkey')} AS n FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM {_C})")
sparql("q11_group_having", "SELECT ?n (COUNT(*) AS ?k) WHERE { ?c e:nation ?n ; a e:Customer } GROUP BY ?n HAVING(COUNT(*) > 5)", f"SELECT {_i('nation', 'c_nationkey')} AS n, {_n('count(*)')} AS k FROM {_C} GROUP BY c_nationkey HAVING count(*) > 5")
sparql("q12_lateral", "SELECT ?n ?c WHERE { ?n a e:Nation LATERAL { SELECT ?n ?c WHERE { ?c e:nation ?n } LIMIT 1 } }",
       f"SELECT {_i('nation', 'c_nationkey')} AS n, min({_i('customer', 'c_custkey')}) AS c FROM {_C} GROUP BY c_nationkey")
sparql("q13_subselect", "SELECT ?m ?k WHERE { ?n e:name ?m { SELECT ?n (COUNT(?c) AS ?k) WHERE { ?c e:nation ?n } GROUP BY ?n } }", f"SELECT {_s('n_name')} AS m, {_n('count(*)')} AS k FROM {_C} JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
sparql("q14_path_sequence", "SELECT ?c ?r WHERE { ?c e:nation/e:region/e:name ?r }", f"SELECT {_i('customer', 'c_custkey')} AS c, {_s('r_name')} AS r FROM {_C} JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
sparql("q14_path_inverse_alternative", "SELECT ?x WHERE { e:region\\/1 ^e:region ?x }".replace("e:region\\/1", "<urn:region/1>"), f"SELECT {_i('nation', 'n_nationkey')} AS x FROM nation WHERE n_regionkey = 1")
sparql("q14_path_alternative", "SELECT ?x ?y WHERE { ?x e:key|e:segment ?y }", f"SELECT {_i('nation', 'n_nationkey')} AS x, {_n('n_nationkey')} AS y FROM nation UNION ALL SELECT {_i('customer', 'c_custkey')}, {_s('c_mktsegment')} FROM {_C} WHERE c_mktsegment <> 'BUILDING'")
sparql("q14_path_plus", "SELECT ?y WHERE { <urn:customer/7> (e:nation|e:region)+ ?y }", f"SELECT {_i('nation', 'c_nationkey')} AS y FROM customer WHERE c_custkey = 7 UNION ALL SELECT {_i('region', 'n_regionkey')} FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 7")
sparql("q14_path_star", "SELECT ?y WHERE { <urn:customer/7> (e:nation|e:region)* ?y }", f"SELECT '<urn:customer/7>' AS y UNION ALL SELECT {_i('nation', 'c_nationkey')} FROM customer WHERE c_custkey = 7 UNION ALL SELECT {_i('region', 'n_regionkey')} FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 7")
sparql("q14_path_optional_star_absent", "SELECT ?y WHERE { <urn:nobody> e:nation? ?y }", "SELECT '<urn:nobody>' AS y")
sparql("q14_path_range", "SELECT ?y WHERE { <urn:customer/7> (e:nation|e:region){2,3} ?y }", f"SELECT {_i('region', 'n_regionkey')} AS y FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 7")
sparql("q14_path_negated", "SELECT ?p ?y WHERE { <urn:nation/3> !(rdf:type|e:region) ?y . <urn:nation/3> ?p ?y }", f"SELECT '<urn:name>' AS p, {_s('n_name')} AS y FROM nation WHERE n_nationkey = 3 UNION ALL SELECT '<urn:key>', {_n('n_nationkey')} FROM nation WHERE n_nationkey = 3")
query("q15_ask", "SELECT true AS yes, false AS no")(lambda e: e.spark.createDataFrame([(SE.run(quads(e), P + "ASK { ?n e:name \"NATION_3\" }"), SE.run(quads(e), P + "ASK { ?n e:name \"NOWHERE\" }"))], "yes boolean, no boolean"))
sparql("q15_construct", "CONSTRUCT { ?r e:has ?n } WHERE { ?n e:region ?r }", f"SELECT {_i('region', 'n_regionkey')} AS s, '<urn:has>' AS p, {_i('nation', 'n_nationkey')} AS o FROM nation")
sparql("q15_describe", "DESCRIBE <urn:region/2>", f"SELECT '<urn:region/2>' AS s, '{RU.TYPE}' AS p, '<urn:Region>' AS o UNION ALL SELECT '<urn:region/2>', '<urn:name>', {_s('r_name')} FROM region WHERE r_regionkey = 2 UNION ALL SELECT {_i('nation', 'n_nationkey')}, '<urn:region>', '<urn:region/2>' FROM nation WHERE n_regionkey = 2")
sparql("q16_distinct_order_slice", "SELECT DISTINCT ?s WHERE { ?c e:segment ?s } ORDER BY DESC(?s) LIMIT 3 OFFSET 1", f"SELECT DISTINCT {_s('c_mktsegment')} AS s FROM {_C} WHERE c_mktsegment <> 'BUILDING' ORDER BY s DESC LIMIT 3 OFFSET 1")
sparql("q16_numeric_order", "SELECT ?n WHERE { ?n e:key ?k } ORDER BY DESC(?k) LIMIT 5", f"SELECT {_i('nation', 'n_nationkey')} AS n FROM nation ORDER BY n_nationkey DESC LIMIT 5")
sparql("q18_regex", "SELECT ?n WHERE { ?n e:name ?m FILTER(REGEX(?m, \"^nation_1\", \"i\")) }", f"SELECT {_i('nation', 'n_nationkey')} AS n FROM nation WHERE regexp_matches(n_name, '(?i)^nation_1')")


@query("q17_triple_terms", "SELECT '<urn:a>' AS s, '<urn:b>' AS o, true AS t, '\"0.9\"^^<http://www.w3.org/2001/XMLSchema#decimal>' AS c")
def triple_terms(e):
    base = e.spark.range(0).selectExpr("string(null) g", "string(null) s", "string(null) p", "string(null) o")
    q = SE.update(base, P + "INSERT DATA { <<e:a e:knows e:b>> e:certainty 0.9 }")
    return SE.run(q, P + "SELECT ?s ?o (ISTRIPLE(?t) AS ?i) ?c WHERE { ?r rdf:reifies ?t ; e:certainty ?c BIND(SUBJECT(?t) AS ?s) BIND(OBJECT(?t) AS ?o) }").select("s", "o", (col("i").contains("true")).alias("t"), "c")


query("q20_builder", f"SELECT {_i('nation', 'c_nationkey')} AS n, {_n('count(*)')} AS k FROM {_C} WHERE c_acctbal > 0 GROUP BY c_nationkey HAVING count(*) >= 3")(
    lambda e: SE.Pattern(prefixes={"e": "urn:"}).where("?c", "e:nation", "?n").where("?c", "e:balance", "?b").filter("?b > 0").run(quads(e), "?n", "COUNT(*) AS ?k", group=["?n"], having="COUNT(*) >= 3"))

# aggregates
_AG = "SELECT {x} FROM " + _C
sparql("a13_count_distinct", "SELECT (COUNT(DISTINCT ?n) AS ?k) (COUNT(?s) AS ?m) WHERE { ?c e:nation ?n OPTIONAL { ?c e:segment ?s } }", _AG.format(x=f"{_n('count(DISTINCT c_nationkey)')} AS k, {_n(chr(40) + 'count(*) FILTER (c_mktsegment <> ' + chr(39) + 'BUILDING' + chr(39) + '))')} AS m"))
sparql("a14_sum_avg", "SELECT (SUM(?k) AS ?s) (ROUND(AVG(?k) * 1000) AS ?m) WHERE { ?n e:key ?k }", f"SELECT {_n('sum(n_nationkey)')} AS s, '\"' || floor(avg(n_nationkey) * 1000 + 0.5)::BIGINT::DOUBLE::BIGINT || '\"^^<{SE.XSD}double>' AS m FROM nation")
sparql("a14_sum_of_nothing", "SELECT (SUM(?k) AS ?s) (AVG(?k) AS ?a) (COUNT(*) AS ?c) WHERE { ?n e:nothing ?k }", f"SELECT {_n('0')} AS s, {_n('0')} AS a, {_n('0')} AS c")
sparql("a14_sum_with_error", "SELECT (SUM(?m) AS ?s) WHERE { ?n e:region ?r ; e:name ?m }", "SELECT NULL AS s")
sparql("a15_min_max", "SELECT (MIN(?k) AS ?a) (MAX(?k) AS ?b) WHERE { ?n e:key ?k }", f"SELECT {_n('min(n_nationkey)')} AS a, {_n('max(n_nationkey)')} AS b FROM nation")
sparql("a16_sample", "SELECT ?r (SAMPLE(?x) AS ?v) WHERE { ?n e:region ?r BIND(1 AS ?x) } GROUP BY ?r", f"SELECT DISTINCT {_i('region', 'n_regionkey')} AS r, {_n('1')} AS v FROM nation")
sparql("a17_group_concat", "SELECT ?r (GROUP_CONCAT(?m; SEPARATOR=\"|\") AS ?v) WHERE { ?n e:region ?r ; e:name ?m } GROUP BY ?r", f"""SELECT {_i('region', 'n_regionkey')} AS r, '"' || string_agg(n_name, '|' ORDER BY n_name) || '"' AS v FROM nation GROUP BY n_regionkey""")
sparql("a18_group_by_expression", "SELECT ?h (COUNT(*) AS ?k) WHERE { ?n e:key ?x } GROUP BY (?x > 10 AS ?h)", f"""SELECT CASE WHEN n_nationkey > 10 THEN '"true"^^<{SE.XSD}boolean>' ELSE '"false"^^<{SE.XSD}boolean>' END AS h, {_n('count(*)')} AS k FROM nation GROUP BY 1""")

# functions
sparql("fn_strings", "SELECT ?m (UCASE(?m) AS ?a) (LCASE(?m) AS ?b) (STRLEN(?m) AS ?c) (SUBSTR(?m, 2, 3) AS ?d) (STRBEFORE(?m, \"_\") AS ?f) (STRAFTER(?m, \"_\") AS ?g) (CONCAT(?m, \"-\", ?m) AS ?h) (REPLACE(?m, \"N\", \"x\") AS ?i) (ENCODE_FOR_URI(\"a b/c\") AS ?j) WHERE { ?n e:region ?r ; e:name ?m }",
       f"SELECT {_s('n_name')} AS m, {_s('upper(n_name)')} AS a, {_s('lower(n_name)')} AS b, {_n('length(n_name)')} AS c, {_s('substr(n_name, 2, 3)')} AS d, {_s('split_part(n_name, chr(95), 1)')} AS f, {_s('substr(n_name, instr(n_name, chr(95)) + 1)')} AS g, {_s('n_name || chr(45) || n_name')} AS h, {_s('replace(n_name, chr(78), chr(120))')} AS i, '\"a%20b%2Fc\"' AS j FROM nation")
sparql("fn_predicates", "SELECT ?n WHERE { ?n e:name ?m FILTER(CONTAINS(?m, \"ATION\") && STRSTARTS(?m, \"NATION\") && STRENDS(?m, \"1\") && ISIRI(?n) && ISLITERAL(?m) && !ISBLANK(?n) && !ISNUMERIC(?m) && BOUND(?m)) }",
       f"SELECT {_i('nation', 'n_nationkey')} AS n FROM nation WHERE starts_with(n_name, 'NATION') AND ends_with(n_name, '1')")
sparql("fn_numbers", "SELECT ?k (ABS(-?k) AS ?a) (CEIL(?k / 2) AS ?b) (FLOOR(?k / 2) AS ?c) (ROUND(?k / 2) AS ?d) WHERE { ?n e:key ?k }",
       f"SELECT {_n('n_nationkey')} AS k, {_n('n_nationkey')} AS a, " + ", ".join(f"""'"' || {x}::BIGINT || '"^^<{SE.XSD}double>' AS {y}""" for x, y in (("ceil(n_nationkey / 2)", "b"), ("floor(n_nationkey / 2)", "c"), ("floor(n_nationkey / 2 + 0.5)", "d"))) + " FROM nation")
sparql("fn_terms", "SELECT (LANG(\"x\"@en) AS ?a) (DATATYPE(1) AS ?b) (STRDT(\"5\", xsd:integer) AS ?c) (STRLANG(\"x\", \"fr\") AS ?d) (STR(<urn:q>) AS ?f) (IRI(\"urn:z\") AS ?g) (SAMETERM(1, 1.0) AS ?h) (LANGMATCHES(\"en-GB\", \"en\") AS ?i) (IF(1 = 1.0, \"eq\", \"ne\") AS ?j) (COALESCE(1/0, \"none\") AS ?k) WHERE {}",
       f"""SELECT '"en"' AS a, '<{SE.XSD}integer>' AS b, {_n("'5'")} AS c, '"x"@fr' AS d, '"urn:q"' AS f, '<urn:z>' AS g, '"false"^^<{SE.XSD}boolean>' AS h, '"true"^^<{SE.XSD}boolean>' AS i, '"eq"' AS j, '"none"' AS k""")
sparql("fn_hashes", "SELECT (MD5(\"abc\") AS ?a) (SHA1(\"abc\") AS ?b) (SHA256(\"abc\") AS ?c) WHERE {}", """SELECT '"' || md5('abc') || '"' AS a, '"' || sha1('abc') || '"' AS b, '"' || sha256('abc') || '"' AS c""")
sparql("fn_dates", "SELECT (YEAR(?t) AS ?a) (MONTH(?t) AS ?b) (DAY(?t) AS ?c) (HOURS(?t) AS ?d) (MINUTES(?t) AS ?f) (TZ(?t) AS ?g) WHERE { BIND(\"2024-03-05T06:07:08Z\"^^xsd:dateTime AS ?t) }",
       f"SELECT {_n('2024')} AS a, {_n('3')} AS b, {_n('5')} AS c, {_n('6')} AS d, {_n('7')} AS f, '\"Z\"' AS g")
sparql("fn_casts", "SELECT (xsd:integer(\"42\") AS ?a) (xsd:string(7) AS ?b) (xsd:boolean(\"true\") AS ?c) (xsd:integer(\"x\") AS ?d) WHERE {}", f"""SELECT {_n("'42'")} AS a, '"7"' AS b, '"true"^^<{SE.XSD}boolean>' AS c, NULL AS d""")
sparql("fn_in", "SELECT ?n WHERE { ?n e:key ?k FILTER(?k IN (1, 2.0, 30) && ?k NOT IN (2)) }", "SELECT '<urn:nation/1>' AS n")
sparql("fn_trigram_sim", "SELECT ?n WHERE { ?n e:name ?m FILTER(TRIGRAM_SIM(?m, \"NATION_1\") >= 0.99) }", f"SELECT {_i('nation', 'n_nationkey')} AS n FROM nation WHERE n_name = 'NATION_1'")


@query("d1_extension_function", f"SELECT {_i('nation', 'n_nationkey')} AS n, '\"' || reverse(n_name) || '\"' AS r FROM nation")
def extension(e):
    SE.FUNCTIONS["urn:fn/reverse"] = lambda t: F.concat(F.lit('"'), F.reverse(SE.T.lexical(t)), F.lit('"'))
    return SE.run(quads(e), P + "SELECT ?n ?r WHERE { ?n e:region ?x ; e:name ?m BIND(<urn:fn/reverse>(?m) AS ?r) }")


@query("s11_sparql_in_sql", f"SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM {_C} WHERE c_acctbal > 9500)")
def sparql_in_sql(e):
    quads(e).createOrReplaceTempView("quads")
    return e.sql("SELECT n_nationkey FROM nation WHERE concat('<urn:nation/', n_nationkey, '>') IN (SPARQL(quads, 'SELECT ?n WHERE { ?c <urn:nation> ?n ; <urn:balance> ?b FILTER(?b > 9500) }'))")


# updates
def _upd(e, text):
    q = quads(e).where(col("s").startswith("<urn:nation/") | col("s").startswith("<urn:region/"))
    return SE.update(q, P + text)


_REG = f"SELECT NULL AS g, {_i('region', 'r_regionkey')} AS s, '{RU.TYPE}' AS p, '<urn:Region>' AS o FROM region UNION ALL SELECT NULL, {_i('region', 'r_regionkey')}, '<urn:name>', {_s('r_name')} FROM region"
query("s18_insert_delete_data", f"SELECT * FROM ({_REG}) WHERE NOT (s = '<urn:region/0>' AND p = '<urn:name>') UNION ALL SELECT NULL, '<urn:region/9>', '<urn:name>', '\"NEW\"'")(
    lambda e: _upd(e, "INSERT DATA { <urn:region/9> e:name \"NEW\" } ; DELETE WHERE { <urn:region/0> e:name ?m }").where(col("s").startswith("<urn:region/")))
query("s18_modify", f"SELECT {_i('nation', 'n_nationkey')} AS s, {_s('lower(n_name)')} AS o FROM nation")(
    lambda e: _upd(e, "DELETE { ?n e:name ?m } INSERT { ?n e:name ?l } WHERE { ?n a e:Nation ; e:name ?m BIND(LCASE(?m) AS ?l) }").where("p = '<urn:name>' and s like '<urn:nation/%'").select("s", "o"))
query("s18_copy_move_clear", "SELECT 'copy' AS k, count(*) * 2 AS n FROM region UNION ALL SELECT 'clear', 0")(
    lambda e: _upd(e, "COPY DEFAULT TO e:backup ; MOVE e:backup TO e:b2 ; CREATE GRAPH e:x").where("g = '<urn:b2>' and s like '<urn:region/%'").agg(F.count(F.lit(1)).alias("n")).select(F.lit("copy").alias("k"), "n")
    .union(_upd(e, "CLEAR ALL").agg(F.count(F.lit(1)).alias("n")).select(F.lit("clear").alias("k"), "n")))


# ---- entailment
def _ontology(e):
    """Part types under brands and a root; brands are classes, parts are members."""
    p = e.table("part")
    sub = lambda a, b: (a.alias("s"), F.lit(RU.SUBCLASS).alias("p"), b.alias("o"))
    brand, typ = F.concat(F.lit("<urn:"), F.translate("p_brand", " #", "__"), F.lit(">")), F.concat(F.lit("<urn:"), F.translate("p_type", " ", "_"), F.lit(">"))
    me = F.concat(F.lit("<urn:part/"), "p_partkey", F.lit(">"))
    root = F.lit("<urn:Item>")
    return p.select(*sub(typ, brand)).union(p.select(*sub(brand, root))).union(p.select(me.alias("s"), F.lit(RU.TYPE).alias("p"), typ.alias("o"))).distinct()


_ONT = """WITH p AS (SELECT DISTINCT p_partkey, '<urn:' || replace(p_type, ' ', '_') || '>' AS t, '<urn:' || replace(replace(p_brand, ' ', '_'), '#', '_') || '>' AS b FROM part), m AS (SELECT DISTINCT t, b FROM p)"""
query("w6_rdfs_types", _ONT + " SELECT DISTINCT s, o FROM (SELECT '<urn:part/' || p_partkey || '>' AS s, t AS o FROM p UNION ALL SELECT '<urn:part/' || p_partkey || '>', m.b FROM p JOIN m USING (t) UNION ALL SELECT '<urn:part/' || p_partkey || '>', '<urn:Item>' FROM p)")(
    lambda e: RU.rdfs(_ontology(e)).where(col("p") == RU.TYPE).select("s", "o"))
query("w4_class_hierarchy", _ONT + " SELECT DISTINCT src, dst FROM (SELECT t AS src, b AS dst FROM m UNION ALL SELECT b, '<urn:Item>' FROM m UNION ALL SELECT t, '<urn:Item>' FROM m)")(lambda e: RU.hierarchy(_ontology(e)))


def _small(e, text):
    base = e.spark.range(0).selectExpr("string(null) g", "string(null) s", "string(null) p", "string(null) o")
    return SE.update(base, P + "INSERT DATA {" + text + "}").select("s", "p", "o")


_RL = """e:p a owl:TransitiveProperty . e:q a owl:SymmetricProperty . e:r owl:inverseOf e:q . e:f a owl:FunctionalProperty . e:A rdfs:subClassOf e:B . e:B owl:equivalentClass e:C . e:p rdfs:domain e:D .
e:a e:p e:b . e:b e:p e:c . e:a e:q e:d . e:a e:f e:x . e:a e:f e:y . e:a a e:A . e:U owl:unionOf (e:A e:E) . e:z a e:E . e:H owl:hasValue e:b ; owl:onProperty e:p ."""
query("w1_w2_owl_rl", """SELECT * FROM (VALUES ('<urn:a>', '<urn:p>', '<urn:c>'), ('<urn:d>', '<urn:q>', '<urn:a>'), ('<urn:d>', '<urn:r>', '<urn:a>'), ('<urn:a>', '<urn:r>', '<urn:d>'), ('<urn:x>', 'same', '<urn:y>'), ('<urn:y>', 'same', '<urn:x>'),
('<urn:a>', 'type', '<urn:B>'), ('<urn:a>', 'type', '<urn:C>'), ('<urn:a>', 'type', '<urn:D>'), ('<urn:b>', 'type', '<urn:D>'), ('<urn:a>', 'type', '<urn:U>'), ('<urn:z>', 'type', '<urn:U>'), ('<urn:a>', 'type', '<urn:H>')) t(s, p, o)""")(
    lambda e: (lambda t: RU.materialize(t, [r for r in RU.RULES if not r.startswith("scm")]).join(t, ["s", "p", "o"], "left_anti"))(_small(e, _RL))
    .select("s", F.when(col("p") == RU.TYPE, "type").when(col("p") == RU.owl("sameAs"), "same").otherwise(col("p")).alias("p"), "o"))
query("w1_consistency", "SELECT * FROM (VALUES ('cax-dw', '<urn:a>'), ('prp-irp', '<urn:b>')) t(rule, s)")(
    lambda e: RU.violations(_small(e, "e:A owl:disjointWith e:B . e:a a e:A , e:B . e:n a owl:IrreflexiveProperty . e:b e:n e:b . e:c e:n e:a .")))
query("w3_same_as", "SELECT * FROM (VALUES ('<urn:a>', '<urn:a>'), ('<urn:b>', '<urn:a>'), ('<urn:c>', '<urn:a>'), ('<urn:x>', '<urn:x>'), ('<urn:y>', '<urn:x>')) t(id, component)")(
    lambda e: RU.same_as(_small(e, "e:a owl:sameAs e:b . e:c owl:sameAs e:b . e:y owl:sameAs e:x .")))
query("w5_satisfiable", "SELECT * FROM (VALUES ('<urn:A>', true), ('<urn:B>', true), ('<urn:C>', false), ('<urn:D>', false)) t(c, satisfiable)")(
    lambda e: RU.satisfiable(_small(e, "e:A a owl:Class . e:B a owl:Class . e:C a owl:Class . e:D a owl:Class . e:A owl:disjointWith e:B . e:C rdfs:subClassOf e:A , e:B . e:D rdfs:subClassOf e:C .")))
query("q19_inference_in_patterns", "SELECT '<urn:b>' AS x UNION ALL SELECT '<urn:c>'")(
    lambda e: SE.run(RU.materialize(_small(e, "e:p a owl:TransitiveProperty . e:a e:p e:b . e:b e:p e:c ."), ["prp-trp"]).withColumn("g", F.lit(None).cast("string")), P + "SELECT ?x WHERE { e:a e:p ?x }"))


# ---- SHACL
def _shape(e, constraints=None, target=None, **props):
    return SH.validate(quads(e).where("g is null"), SH.Shape(target or {"class": "<urn:Customer>"}, constraints or {}, {f"<urn:{k}>": v for k, v in props.items()})).select("focus", "constraint")


query("w8_min_count", f"SELECT {_i('customer', 'c_custkey')} AS focus, 'minCount' AS \"constraint\" FROM {_C} WHERE c_mktsegment = 'BUILDING'")(lambda e: _shape(e, segment={"minCount": 1}))
query("w8_max_count_pattern", f"SELECT {_i('customer', 'c_custkey')} AS focus, 'pattern' AS \"constraint\" FROM {_C} WHERE NOT regexp_matches(c_name, '[0-4]$')")(lambda e: _shape(e, name={"maxCount": 1, "pattern": "[0-4]$"}))
query("w8_range_datatype", f"SELECT {_i('customer', 'c_custkey')} AS focus, 'minInclusive' AS \"constraint\" FROM {_C} WHERE c_acctbal < 0")(lambda e: _shape(e, balance={"datatype": SE.XSD + "double", "minInclusive": 0}))
query("w8_in", f"SELECT {_i('customer', 'c_custkey')} AS focus, 'in' AS \"constraint\" FROM {_C} WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')")(lambda e: _shape(e, segment={"in": ['"MACHINERY"', '"HOUSEHOLD"']}))
query("w8_class", "SELECT 'x' AS focus, 'y' AS \"constraint\" WHERE false")(lambda e: _shape(e, nation={"class": "<urn:Nation>", "nodeKind": "IRI"}))
query("w8_has_value_closed", f"SELECT {_i('nation', 'n_nationkey')} AS focus, 'hasValue' AS \"constraint\" FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT {_i('nation', 'n_nationkey')}, 'closed' FROM nation")(
    lambda e: _shape(e, {"closed": True}, {"class": "<urn:Nation>"}, region={"hasValue": "<urn:region/1>"}, name={"minCount": 1}))
query("w8_logical", f"SELECT {_i('customer', 'c_custkey')} AS focus, 'or' AS \"constraint\" FROM {_C} WHERE c_acctbal < 9000 AND c_mktsegment = 'BUILDING'")(
    lambda e: _shape(e, {"or": [SH.Shape({}, {}, {"<urn:balance>": {"minInclusive": 9000}}), SH.Shape({}, {}, {"<urn:segment>": {"minCount": 1}})]}))
query("w8_not_qualified", f"SELECT {_i('region', 'r_regionkey')} AS focus, 'qualified' AS \"constraint\" FROM region WHERE (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey < 10) < 2")(
    lambda e: SH.validate(quads(e).where("g is null"), SH.Shape({"class": "<urn:Region>"}, {}, {"^<urn:region>": {"qualified": {"shape": SH.Shape({}, {}, {"<urn:key>": {"maxExclusive": 10}}), "min": 2}}})).select("focus", "constraint"))
query("w7_targets", f"SELECT {_i('nation', 'n_nationkey')} AS focus FROM nation")(lambda e: SH.targets(quads(e).where("g is null"), SH.Shape({"subjects_of": "<urn:region>"})))
query("w9_datatypes", "SELECT true AS a, false AS b, true AS c, false AS d")(
    lambda e: e.spark.range(1).select(*[SH.well_typed(F.lit(f'"{v}"^^<{SE.XSD}{t}>'), SE.XSD + t).alias(n) for n, v, t in (("a", "12", "integer"), ("b", "1.5", "integer"), ("c", "2020-01-02", "date"), ("d", "maybe", "boolean"))]))
