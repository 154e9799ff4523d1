"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, mixing, packing. Counted as part of strataq.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of its input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm import exact_dedup as _exact
from strataq.llm import mixing as _mixing
from strataq.llm import packing as _packing
from strataq.llm import simhash as _simhash
from strataq.llm import toxicity as _toxicity
from strataq.llm.common import keep_decided, load, materialize, remove, settled

THRESHOLD = 0.5


def _id(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("\u0000"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject. It is fitted on this stage's own input where labels cover it."""
    chain = _toxicity.train(docs, load(spark, sf_dir, "labels"))
    scored = _toxicity.score(docs, chain, keep=docs.columns, prefix="__p_")
    return scored.where(F.col("__p_toxic") < THRESHOLD).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts, whatever their ids: that with most code points, then the smallest
    id (null first). Null and empty texts are one group. Rows equal in id and text stay once. An empty table stays empty."""
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    found = _exact.exact_dedup(docs, carry={"__h": h}).where("group_size > 1")
    decided = materialize(found.select(_id(F.col("doc_id")).alias("i"), F.col("__h").alias("h"), "kept").groupBy("i", "h").agg(F.max("kept").alias("kept")))
    return keep_decided(docs, decided, {"i": _id(F.col("doc_id")), "h": h})


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, whatever their ids: the first by id (null last). Texts without words are not
    each other's copies. Rows equal in id and text stay once. An empty table stays empty."""
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    found = _simhash.simhash_dedup(docs, carry={"__h": h}).where("class_size > 1")
    decided = materialize(found.select(_id(F.col("doc_id")).alias("i"), F.col("__h").alias("h"), "kept").groupBy("i", "h").agg(F.max("kept").alias("kept")))
    return keep_decided(docs, decided, {"i": _id(F.col("doc_id")), "h": h})


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, up to three times."""
    return _mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents and their places in sequences of 2048 tokens."""
    return _packing.pack_documents(docs, together=1_000_000)  # the workers still hold memory of the stages before


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]

#: SimHash candidates, the classifier and the tokenizer have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each but the last is written; what it read is deleted then."""
    docs = load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, settled(spark, lambda: stage(spark, docs, sf_dir))  # noqa: B023  called at once
        if k:
            remove(before)
    return STAGES[-1][1](spark, docs, sf_dir)
