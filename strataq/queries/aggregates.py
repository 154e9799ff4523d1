"""Aggregates, maintained aggregates, sketches, ranks, leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataq.operators import aggregate as A
from strataq.operators import rank as K
from strataq.queries.registry import both, query

col = F.col


def _agg(e, t="lineitem"):
    return e.query(t).aggregate()


query("a1_count", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")(lambda e: _agg(e).group_by("l_returnflag").count("n").frame())
query("a2_count_not_null", "SELECT count(nullif(c_mktsegment, 'BUILDING')) AS n FROM customer")(
    lambda e: A.Aggregate(e.table("customer").select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("s"))).count_not_null("s", "n").frame())


@query("a3_count_updates", "SELECT user_id, count(*) - 1 AS updates FROM events GROUP BY user_id HAVING count(*) - 1 >= 5")
def count_updates(e):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    log = e.table("events").select("user_id", F.row_number().over(w).alias("seq")).withColumn("op", F.when(col("seq") == 1, "insert").otherwise("update"))
    return A.update_counts(log, "user_id", "op", "seq").where("updates >= 5")


query("a4_sum", "SELECT l_shipdate, sum(l_quantity) AS q FROM lineitem GROUP BY l_shipdate")(lambda e: _agg(e).group_by("l_shipdate").sum("l_quantity", "q").frame())
query("a5_avg", "SELECT l_linestatus, round(avg(l_extendedprice), 6) AS mean FROM lineitem GROUP BY l_linestatus")(
    lambda e: _agg(e).group_by("l_linestatus").avg("l_extendedprice", "m").frame().select("l_linestatus", F.round("m", 6).alias("mean")))
query("a6_min_max", "SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderdate) AS first, max(o_orderstatus) AS status FROM orders GROUP BY o_orderpriority")(
    lambda e: _agg(e, "orders").group_by("o_orderpriority").min("o_totalprice", "lo").max("o_totalprice", "hi").min("o_orderdate", "first").max("o_orderstatus", "status").frame())
query("a7_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_returnflag")(lambda e: _agg(e).group_by("l_returnflag").distinct("l_partkey", "n").frame())
query("a7_distinct_sketch", "SELECT true AS close FROM events LIMIT 1")(
    lambda e: e.table("events").agg(F.hll_sketch_estimate(F.hll_sketch_agg("user_id", F.lit(14))).alias("a"), F.count_distinct(col("user_id")).alias("n")).select((F.abs(col("a") - col("n")) <= 0.03 * col("n")).alias("close")))
query("a8_percentile", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag")(
    lambda e: _agg(e).group_by("l_returnflag").percentile("l_extendedprice", 0.9, "p").frame().select("l_returnflag", F.round("p", 4).alias("p90")))
query("a8_percentile_sketch", "SELECT true AS close FROM events LIMIT 1")(
    lambda e: A.percentile_state(e.table("events"), [], "value").select(F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias("a")).join(
        F.broadcast(e.table("events").agg(F.percentile("value", F.lit(0.47)).alias("lo"), F.percentile("value", F.lit(0.53)).alias("hi")))).select(col("a").between(col("lo"), col("hi")).alias("close")))
query("a9_cdf", "SELECT count(*) FILTER (value <= 50) / count(value)::DOUBLE AS cdf, count(value) AS count, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS median FROM events")(
    lambda e: A.cdf(e.table("events"), "value", 50).withColumn("median", F.round("median", 6)))
query("a10_null_group", "SELECT nullif(o_orderstatus, 'P') AS st, count(*) AS n FROM orders GROUP BY 1")(
    lambda e: A.Aggregate(e.table("orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("st"))).group_by("st").count("n").frame())
query("a10_global_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s FROM orders WHERE o_orderkey < 0")(lambda e: e.query("orders").where("o_orderkey < 0").aggregate().count("n").sum("o_totalprice", "s").frame())
query("a11_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")(lambda e: _agg(e, "orders").group_by("o_custkey").count("n").having(col("n") > 12).frame())


@query("a12_incremental", "SELECT event_type, count(*) AS count, count(value) AS count_not_null, round(sum(value)::DOUBLE, 4) AS sum, round(avg(value), 6) AS avg FROM events WHERE NOT (event_id % 10 = 3) GROUP BY event_type")
def incremental(e):
    """A state built from the first part, merged with later inserts and with removals."""
    ev, keys = e.table("events"), ["event_type"]
    old = A.state(ev.where("event_id % 2 = 0"), keys, "value")
    new = A.state(ev.where("event_id % 2 = 1"), keys, "value")
    gone = A.state(ev.where("event_id % 10 = 3"), keys, "value", F.lit(-1))
    return A.read_state(A.merge_states(old, new, gone, keys=keys), keys).withColumns({"sum": F.round("sum", 4), "avg": F.round("avg", 6)})


@query("a12_extremes_after_removal", "SELECT event_type, min(value) AS lo, max(value) AS hi FROM events WHERE value BETWEEN 5 AND 95 GROUP BY event_type")
def extremes(e):
    ev = e.table("events")
    parts = A.extreme_state(ev.withColumn("sign", F.lit(1)), ["event_type"], "value").union(A.extreme_state(ev.where("not (value between 5 and 95)").withColumn("sign", F.lit(-1)), ["event_type"], "value"))
    left = parts.groupBy("event_type", "value").agg(F.sum("n").alias("n")).where("n > 0")
    return left.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("a12_sketch_merge", "SELECT event_type, true AS close FROM events GROUP BY event_type")
def sketch_merge(e):
    ev = e.table("events")
    m = A.merge_distinct(A.distinct_state(ev.where("event_id % 2 = 0"), ["event_type"], "user_id"), A.distinct_state(ev.where("event_id % 2 = 1"), ["event_type"], "user_id"), keys=["event_type"])
    n = ev.groupBy("event_type").agg(F.count_distinct(col("user_id")).alias("n"))
    return m.join(n, "event_type").select("event_type", (F.abs(col("estimate") - col("n")) <= 0.03 * col("n") + 1).alias("close"))


both("a19_sql_group_by", "SELECT o_orderstatus, o_orderpriority, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus, o_orderpriority HAVING count(*) > 10")
query("a20_array_agg", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")(
    lambda e: e.table("nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "|").alias("names")))
both("a20_group_concat", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey",
     "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
query("a21_facets", "SELECT lang AS value, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 3")(lambda e: A.facets(e.table("documents"), "lang", 3))
both("a23_rollup_cube", """SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
UNION ALL SELECT o_orderstatus, o_orderpriority, count(*) FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")

# ---- ranks: 0-based, score descending, ties by id descending
_R = "(SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey DESC) - 1 AS rank, count(*) OVER () AS n FROM customer)"


def _rank(e):
    return K.Rank(e.table("customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


query("r1_top", f"SELECT c_custkey, c_acctbal, rank FROM {_R} WHERE rank < 10")(lambda e: _rank(e).top(10))
query("r2_bottom", f"SELECT c_custkey, c_acctbal, rank FROM {_R} WHERE rank >= n - 10")(lambda e: _rank(e).bottom(10))
query("r3_range", f"SELECT c_custkey, c_acctbal, rank FROM {_R} WHERE rank >= 20 AND rank < 35")(lambda e: _rank(e).range(20, 35))
query("r4_percentile", f"SELECT c_custkey, c_acctbal, rank FROM {_R} WHERE rank = least(floor(n * (1 - 0.95))::BIGINT, n - 1)")(lambda e: _rank(e).percentile(0.95))
query("r5_rank_of", "SELECT count(*) FILTER (c_acctbal > 5000) AS rank, count(*) AS total FROM customer")(lambda e: _rank(e).rank_of(5000))
query("r6_all_ranks", "SELECT c_custkey, rank() OVER (ORDER BY c_acctbal DESC) - 1 AS rank FROM customer")(lambda e: _rank(e).all_ranks().select("c_custkey", "rank"))

# ---- leaderboards
_L = "(SELECT event_id, event_type, value, floor(epoch(ts) / {s})::BIGINT AS window_id FROM events)"


def _board(e, seconds=K.DAILY, group=("event_type",)):
    return K.Leaderboard(e.table("events").select("event_id", "event_type", "value", "ts"), "ts", "value", "event_id", seconds, group)


for name, s in (("hourly", K.HOURLY), ("daily", K.DAILY), ("weekly", K.WEEKLY), ("monthly", K.MONTHLY)):
    query(f"l1_windows_{name}", f"SELECT window_id, count(*) AS n FROM {_L.format(s=s)} GROUP BY window_id")(lambda e, s=s: _board(e, s).df.groupBy("window_id").agg(F.count(F.lit(1)).alias("n")))
_D = _L.format(s=K.DAILY)
_C = ["event_id", "event_type", "window_id", "rank"]
query("l2_top", f"SELECT event_id, event_type, window_id, row_number() OVER w AS rank FROM {_D} WINDOW w AS (PARTITION BY window_id, event_type ORDER BY value DESC, event_id) QUALIFY row_number() OVER w <= 3")(
    lambda e: _board(e).top(3).select(*_C))
query("l3_bottom", f"SELECT event_id, event_type, window_id, row_number() OVER w AS rank FROM {_D} WINDOW w AS (PARTITION BY window_id, event_type ORDER BY value, event_id DESC) QUALIFY row_number() OVER w <= 3")(
    lambda e: _board(e).bottom(3).select(*_C))
query("l4_ungrouped_top", f"SELECT event_id, window_id, row_number() OVER w AS rank FROM {_D} WINDOW w AS (PARTITION BY window_id ORDER BY value DESC, event_id) QUALIFY row_number() OVER w <= 5")(
    lambda e: _board(e, group=()).top(5).select("event_id", "window_id", "rank"))
query("l5_l6_rank_dense_rank", f"""SELECT event_id, rank, dense_rank FROM (SELECT event_id, row_number() OVER (PARTITION BY window_id, event_type ORDER BY value DESC, event_id) AS rank,
dense_rank() OVER (PARTITION BY window_id, event_type ORDER BY value DESC) AS dense_rank FROM {_D})""")(lambda e: _board(e).ranks().select("event_id", "rank", "dense_rank"))
query("l7_percentile", f"""SELECT event_id, window_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY window_id, event_type ORDER BY value DESC, event_id) AS r, count(*) OVER (PARTITION BY window_id, event_type) AS n FROM {_D})
WHERE r = greatest(1, ceil(0.25 * n))""")(lambda e: _board(e).percentile(0.75).select("event_id", "window_id", "event_type"))
query("l8_windows", f"SELECT DISTINCT window_id FROM {_D} ORDER BY window_id DESC")(lambda e: _board(e).windows())
query("l9_expiry", f"SELECT event_id FROM {_D} WHERE window_id > (SELECT max(window_id) - 3 FROM {_D})")(lambda e: _board(e).keep_last(3).df.select("event_id"))
