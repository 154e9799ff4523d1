"""Operator 5: exact deduplication by progressive refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import WS, bit_filter, load, lookup, materialize, with_membership

PREFIX = 64


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS}+", "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                carry: dict[str, Column] | None = None) -> DataFrame:
    """Group documents whose normalised texts are identical and choose one of each group.

    Three refinements, each of which only sees what the last could not tell apart: length; length and hash of the
    first 64 characters; SHA-256 of the whole text. The first scan writes a narrow table of lengths and prefix hashes; what
    repeats in it becomes a membership filter of bounded size, and the second scan hashes whole texts only for rows that
    it lets through. Texts never pass a shuffle.

    Of a group the row with most code points in the original text stays, then the smallest id (null first), then the smallest
    hash of the text, then any one of rows that are equal in all of these. Returns one row per input row: id_col, keep_id,
    group_size, kept (true for exactly one row of a group), and the columns of `carry` (expressions over the input row).
    Null text is empty text; empty texts are equal to each other. Repeated ids are rows like any other. Very long texts are
    hashed whole. Extra columns are ignored; an empty table gives an empty result. A hot group is pre-aggregated on the map
    side and looked up by broadcast; rows without a group are spread at random (see common.lookup).
    """
    norm = normalised(F.col(text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), norm.alias("norm"), F.length(text).cast("long").alias("cp"), F.xxhash64(text).alias("x"),
                       *[e.alias(f"__c_{k}") for k, e in (carry or {}).items()])
    base = base.withColumn("n", F.length("norm"))
    prefix = F.xxhash64(F.col("n"), F.substring("norm", 1, PREFIX))
    slim = materialize(base.select("n", prefix.alias("p")))
    lengths = materialize(slim.groupBy("n").count().where("count > 1"))
    by_length = bit_filter(lengths, F.col("n"), lengths.count())
    prefixes = with_membership(slim, by_length, F.col("n"), "maybe").where("maybe").groupBy("p").count().where("count > 1")
    prefixes = materialize(prefixes)
    by_prefix = bit_filter(prefixes, F.col("p"), prefixes.count())
    level3 = with_membership(base.withColumn("p", prefix), by_prefix, F.col("p"), "maybe")
    extra = [f"__c_{k}" for k in carry or {}]
    rows = level3.select("id", "cp", "x", F.when(F.col("maybe"), F.sha2("norm", 256)).alias("h"),
                         F.when(F.col("maybe"), F.monotonically_increasing_id()).alias("r"), *extra)
    rows = materialize(rows)
    groups = (rows.where("h is not null").groupBy("h")
              .agg(F.count(F.lit(1)).alias("size"), F.min(F.struct((-F.col("cp")).alias("c"), F.col("id"), F.col("x"), F.col("r"))).alias("best"))
              .where("size > 1").select("h", "size", F.col("best.id").alias("best"), F.col("best.r").alias("best_r"), F.lit(True).alias("grouped")))
    out = lookup(rows, groups, "h", "size", F.xxhash64("id", "cp", "x"))
    grouped = F.coalesce("grouped", F.lit(False))
    return out.select(F.col("id").alias(id_col), F.when(grouped, F.col("best")).otherwise(F.col("id")).alias("keep_id"),
                      F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
                      (~grouped | (F.col("r") == F.col("best_r"))).alias("kept"), *[F.col(f"__c_{k}").alias(k) for k in carry or {}])


def op5_exact_dedup(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return exact_dedup(docs, carry={"text_sha256": F.sha2(normalised(F.col("text")), 256)})


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY t ORDER BY cp DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY t ORDER BY cp DESC, doc_id) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
