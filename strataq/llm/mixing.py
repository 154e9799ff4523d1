"""Operator 1: mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataq.llm.common import NON_WS, load, lookup, materialize, running_sum

EPOCHS = 3  # no document is taken more often
SEED = "strataq:"


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(NON_WS)).cast("long")


def shuffle_key(doc_id: Column) -> Column:
    """The place of a document in its source's shuffled order: the same at every run and partitioning."""
    return F.md5(F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit(""))))


def source_key(source: Column) -> Column:
    """A non-null key that sorts as sources do: by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(rows: DataFrame, weights=(1, 2, 3), epochs: int = EPOCHS) -> DataFrame:
    """(sk, source_size, target): the shares of the total size, none above `epochs` times its source's size.

    rows: (sk, size). Weights go to the sources in order, repeating. A source is full when its share of what the
    fuller ones leave exceeds its cap; walking by cap/weight gives the fixed point of repeated resharing in one
    pass, in integers. The two windows run over one row per source, in one task.
    """
    s = rows.groupBy("sk").agg(F.sum("size").alias("source_size"))
    w = F.array(*[F.lit(x).cast("long") for x in weights])
    s = s.withColumn("w", F.element_at(w, ((F.row_number().over(W.orderBy("sk")) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * epochs)
    order = W.orderBy(F.col("cap") / F.col("w"), "sk")
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = (s.withColumn("total", F.sum("source_size").over(every))
         .withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("rest", F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))))
    full = F.col("w") * (F.col("total") - F.col("before")) > F.col("cap") * F.col("rest")
    s = (s.withColumn("full", full)
         .withColumn("left", F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0)))
         .withColumn("open", F.sum(F.when(~F.col("full"), F.col("w"))).over(every)))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        (F.col("w") * F.col("left")).cast("double") / F.col("open"))
    return s.select("sk", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_bounds(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights=(1, 2, 3)) -> DataFrame:
    """Per source (sk): source_size, target, and for each epoch the last shuffle position the mix takes.

    Every document copy gets a virtual finish time: its source's cumulative words, in shuffled order, over the
    source's target. Copies are range-sorted by it over all sources and truncated where the running total reaches
    the sum of all sizes. Because a source's copies are taken in its own order, the truncated sequence is told by
    three positions per source, so texts need not move.
    """
    rows = materialize(docs.select(source_key(F.col(source_col)).alias("sk"), shuffle_key(F.col(id_col)).alias("pos"),
                                   words(F.col(text_col)).alias("size")))
    targets = materialize(source_targets(rows, weights))
    live = rows.where("size > 0").withColumn("bucket", F.substring("pos", 1, 3))
    sums = live.groupBy("sk", "bucket").agg(F.sum("size").alias("bs"))
    offs = sums.select("sk", "bucket", (F.sum("bs").over(W.partitionBy("sk").orderBy("bucket")) - F.col("bs")).alias("off"))
    inside = W.partitionBy("sk", "bucket").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    cum = (live.withColumn("cum", F.sum("size").over(inside)).join(offs, ["sk", "bucket"])
           .select("sk", "pos", "size", (F.col("cum") + F.col("off")).alias("cum")))
    cum = lookup(cum, targets, "sk", "source_size", F.col("pos"), check=True)
    copies = (cum.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))))
              .where("epoch = 0 or epoch * source_size <= target")
              .where("target > 0")
              .select("sk", "pos", "size", "epoch",
                      ((F.col("cum") + F.col("epoch") * F.col("source_size")).cast("double") / F.col("target")).alias("finish")))
    order = [F.col("finish"), F.col("sk"), F.col("pos"), F.col("epoch")]
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    taken = running_sum(copies, order, "size", "running").where(F.col("running") <= budget)
    ends = taken.groupBy("sk").agg(*[F.max(F.when(F.col("epoch") == e, F.col("pos"))).alias(f"end{e}") for e in range(EPOCHS)])
    return materialize(targets.join(ends, "sk", "left"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3),
        keep: list[str] | None = None) -> DataFrame:
    """All documents with the words the mix takes of each: `keep` columns (default the id), size, source_size, target, taken.

    Whole documents are taken, up to three times (epochs). A source's taken words differ from its target by about one
    document. Null texts and texts without words have size 0 and are never taken; a null source is a source of its
    own, the last in order. Documents of equal id and source share their place and are taken together. Extra columns
    are ignored unless named in `keep`; an empty table gives an empty result. A hot source is split by shuffle
    position; only one row per source, and one per partition, ever meet in a task.
    """
    names = keep or [id_col]
    out = _with_plan(docs, names, id_col, text_col, source_col, weights)
    return out.select(*[F.col(f"k_{c}").alias(c) for c in names], "size", "source_size", "target", "taken")


def _with_plan(docs: DataFrame, names: list[str], id_col: str, text_col: str, source_col: str, weights) -> DataFrame:
    """k_<name> of every row with size, source_size, target and taken: one look-up of the source's bounds, no shuffle of texts."""
    bounds = mix_bounds(docs, id_col, text_col, source_col, weights)
    base = docs.select(*[F.col(c).alias(f"k_{c}") for c in names], source_key(F.col(source_col)).alias("sk"),
                       shuffle_key(F.col(id_col)).alias("pos"), words(F.col(text_col)).alias("size"))
    out = lookup(base, bounds, "sk", "source_size", F.col("pos"), check=True)
    n = sum((F.when(F.col("pos") <= F.col(f"end{e}"), 1).otherwise(0) for e in range(EPOCHS)), F.lit(0))
    return out.withColumn("times", F.when(F.col("size") > 0, n).otherwise(0).cast("int")).withColumn("taken", F.col("size") * F.col("times").cast("long"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3)) -> DataFrame:
    """The mix itself: the columns of docs, each document as often as it is taken."""
    out = _with_plan(docs, docs.columns, id_col, text_col, source_col, weights).where("times > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(*[F.col(f"k_{c}").alias(c) for c in docs.columns])


def op1_mixing(spark, sf_dir):
    return mix(load(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS sk, md5('strataq:' || doc_id) AS pos,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (SELECT sk, sum(size)::BIGINT AS source_size FROM d GROUP BY sk),
r AS (SELECT *, ((row_number() OVER (ORDER BY sk) - 1) % 3 + 1)::BIGINT AS w, source_size * 3 AS cap FROM s),
p AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
    coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bef,
    (sum(w) OVER (ORDER BY cap::DOUBLE / w, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest
  FROM r),
q AS (SELECT *, w * (total - bef) > cap * rest AS filled FROM p),
u AS (
  SELECT *, total - coalesce(sum(cap) FILTER (filled) OVER (), 0)::BIGINT AS lft, (sum(w) FILTER (NOT filled) OVER ())::BIGINT AS opn
  FROM q),
t AS (SELECT sk, source_size, total, CASE WHEN filled THEN cap::DOUBLE ELSE (w * lft)::DOUBLE / opn END AS target FROM u),
c AS (SELECT doc_id, sk, pos, size, (sum(size) OVER (PARTITION BY sk ORDER BY pos ROWS UNBOUNDED PRECEDING))::BIGINT AS cum
      FROM d WHERE size > 0),
e AS (SELECT c.*, n AS epoch, (cum + n * source_size)::DOUBLE / target AS finish, total
      FROM c JOIN t USING (sk), range(3) AS g(n) WHERE (n = 0 OR n * source_size <= target) AND target > 0),
k AS (SELECT *, sum(size) OVER (ORDER BY finish, sk, pos, epoch ROWS UNBOUNDED PRECEDING) AS running FROM e),
m AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM k WHERE running <= total GROUP BY doc_id)
SELECT d.doc_id, d.size, t.source_size, coalesce(t.target, 0) AS target, coalesce(m.taken, 0) AS taken
FROM d JOIN t USING (sk) LEFT JOIN m USING (doc_id)
"""
