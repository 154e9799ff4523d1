"""The pipeline's stages, each against what its operator decides on its own input."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from strataq.llm import mixing, simhash
from strataq.llm.common import load


def test_stages_take_effect(spark, sf):
    docs = load(spark, sf, "documents")
    columns = docs.columns
    clean = P.materialize(P.drop_toxic(spark, docs, sf))
    assert clean.columns == columns and 0.8 * docs.count() < clean.count() < docs.count()
    once = P.materialize(P.drop_copies(spark, clean, sf))
    keys = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in once.collect()]
    before = {re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in clean.collect()}
    assert len(keys) == len(set(keys)) and set(keys) == before
    near = P.materialize(P.drop_near_copies(spark, once, sf))
    kept = {r["doc_id"] for r in simhash.simhash_dedup(once).where("kept").collect()}
    assert {r["doc_id"] for r in near.collect()} == kept and near.count() == len(kept)
    mixed = P.materialize(P.mix_sources(spark, near, sf))
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(near).collect()}
    assert mixed.columns == columns
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert all(copies[i] * s == t for i, (t, s) in taken.items())
    packed = P.pack(spark, mixed, sf).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == copies


def test_run_and_odd_rows(spark, sf):
    assert P.run(spark, sf).count() > 0
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, "a  b c", None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, "other words here", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("clash"))
    out = docs
    for name, stage in P.STAGES[:-1]:
        out = P.materialize(stage(spark, out, sf))
        assert out.columns == docs.columns, name
    assert P.pack(spark, out, sf).count() >= 1
    none = docs.limit(0)
    for _, stage in P.STAGES[:-1]:
        none = P.materialize(stage(spark, none, sf))
    assert none.count() == 0


def test_copies_under_one_id_do_not_stay(spark, sf):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3), (1, "ab", "en", "s", 2), (3, "ab", "en", "s", 2), (4, "c", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"], r["text"]) for r in P.drop_copies(spark, docs, sf).collect()) == [(1, "a b"), (4, "c")]


def test_run_leaves_only_what_its_result_reads(spark, sf):
    import os

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    P.run(spark, sf).count()
    assert len(set(os.listdir(folder)) - before) <= 2


def test_near_copies_under_one_id_do_not_stay(spark, sf):
    t = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, t, "en", "s", 3), (1, t + " end", "en", "s", 2), (3, "x " + t, "en", "s", 2), (4, "c", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in P.drop_near_copies(spark, docs, sf).collect()) == [1, 4]
