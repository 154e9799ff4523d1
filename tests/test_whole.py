"""Registered queries see every row of their tables, not an id subset."""

from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataq.graph import algorithms as A
from strataq.operators import ann
from strataq.operators.similar import IVF
from strataq.queries import graphs, rdf, registry
from strataq.sparql import engine as SE


@pytest.fixture(scope="module")
def tables(spark):
    """500 customers, 120 suppliers."""
    segment = F.when(F.col("c_custkey") % 3 == 0, "BUILDING").otherwise("MACHINERY")
    key = spark.range(1, 501).withColumnRenamed("id", "c_custkey")
    return {
        "customer": key.select("c_custkey", F.concat(F.lit("C"), "c_custkey").alias("c_name"), F.lit(1.5).alias("c_acctbal"), (F.col("c_custkey") % 7).alias("c_nationkey"), segment.alias("c_mktsegment")),
        "supplier": spark.range(1, 121).selectExpr("id as s_suppkey", "concat('S', id) as s_name", "id % 7 as s_nationkey"),
        "nation": spark.range(7).selectExpr("id as n_nationkey", "concat('N', id) as n_name", "id % 2 as n_regionkey"),
        "region": spark.range(2).selectExpr("id as r_regionkey", "concat('R', id) as r_name")}


def test_quads_hold_all_customers_and_suppliers(tables):
    e = SimpleNamespace(table=tables.__getitem__)
    run = lambda text: SE.run(rdf.quads(e), rdf.P + text).collect()
    got = {r["n"]: r["k"] for r in run("SELECT ?n (COUNT(*) AS ?k) WHERE { ?c e:nation ?n ; a e:Customer } GROUP BY ?n HAVING(COUNT(*) > 5)")}
    assert got == {f"<urn:nation/{n}>": f'"{k}"{rdf.INT}' for n, k in Counter(c % 7 for c in range(1, 501)).items()}
    assert {r["s"] for r in run("SELECT ?g ?s WHERE { GRAPH ?g { ?s a e:Supplier } }")} == {f"<urn:supplier/{s}>" for s in range(1, 121)}
    assert {r["focus"] for r in rdf._shape(e, segment={"minCount": 1}).collect()} == {f"<urn:customer/{c}>" for c in range(1, 501) if c % 3 == 0}


def test_snowball_stems_whole_texts(spark, tmp_path):
    registry.load_all()
    words = [f"w{k}" for k in range(300)]
    spark.createDataFrame([(1, " ".join(words) + " jumping")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    stems = registry.QUERIES["t14_snowball"](spark, str(tmp_path)).collect()[0]["stems"].split()
    assert len(stems) == 301 and stems[-1] == "jump"


def test_components_against_union_find(spark, sf):
    registry.load_all()
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in spark.read.parquet(f"{sf}/lineitem.parquet").where("l_suppkey % 3 <> 0").select("l_suppkey", "l_partkey").distinct().collect():
        a, b = find(f"s{r[0]}"), find(f"p{r[1]}")
        parent[max(a, b)] = min(a, b)
    edges = graphs._supply(SimpleNamespace(table=lambda t: spark.read.parquet(f"{sf}/{t}.parquet").where("l_suppkey % 3 <> 0")))
    assert {r["id"]: r["component"] for r in A.run_algorithm("components", edges).collect()} == {x: find(x) for x in parent}
    every = registry.QUERIES["h10_components"](spark, sf)
    assert every.count() == spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("count(distinct l_suppkey) + count(distinct l_partkey)").first()[0]


@pytest.mark.parametrize("name", ["v3_hashed_ann", "v4_ivf", "v5_pq"])
def test_indexes_find_nine_in_ten(spark, name):
    """Recall of the ten nearest, over every query of the 2000 vectors at sf0.1."""
    registry.load_all()
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found: dict = {}
    for r in registry.QUERIES[name](spark, folder).collect():
        found.setdefault(r["query"], {})[r["rank"]] = r["id"]
    assert set(found) == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for i, got in found.items():
        d = ((x - x[ids == i]) ** 2).sum(1)
        assert sorted(got) == list(range(1, 11)) and got[1] in ids[d < 1e-9]
        hits += len(set(got.values()) & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    print(name, hits / (10 * len(found)))
    assert hits >= 9 * len(found)


def test_stored_cells_give_the_same(spark, tmp_path):
    df = spark.range(300).selectExpr("id as vec_id", "transform(sequence(1, 8), k -> double(hash(id, k) % 1000)) as embedding")
    made = IVF(df, "vec_id", "embedding", 6, 5, 300)
    ann.save_ivf(made, str(tmp_path / "ivf"))
    again = ann.open_ivf(spark, str(tmp_path / "ivf"), "vec_id", "embedding")
    queries = df.where("vec_id % 20 = 0").selectExpr("vec_id as query", "embedding as q")
    want = sorted(map(tuple, ann.search_ivf(made, queries, 5, 6).select("query", "id", "rank").collect()))
    assert sorted(map(tuple, ann.search_ivf(again, queries, 5, 6).select("query", "id", "rank").collect())) == want and len(want) == 75
    one = df.where("vec_id = 40").first()["embedding"]
    assert [r["vec_id"] for r in again.search(list(one), 5, 6).collect()] == [i for q, i, _ in sorted(want, key=lambda r: r[2]) if q == 40]
