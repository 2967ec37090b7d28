"""The corpus queries and the pipeline on the smallest tables."""

import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spreadwatch.llm.common import BATCH_BYTES, SPARKS_BYTES, scratch
from spreadwatch.llm.decontaminate import find_items, normalised
from spreadwatch.llm.language_id import best_score
from spreadwatch.llm.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels conversations".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(result.fetchall(), names) == rows([tuple(r) for r in df.collect()], df.columns)


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 11))


def test_decontamination_finds_every_exact_item(spark, duck):
    docs, items = (duck.execute(f"SELECT * FROM (SELECT {c}, text FROM {t})").fetchall() for c, t in (("doc_id", "documents"), ("item_id", "benchmark")))
    want = {(d, i) for d, text in docs for i, item in items if text and item and normalised(item) in normalised(text)}
    got = find_items(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert want <= {(r.doc_id, r.item_id) for r in got.collect()}


def test_language_query_is_accurate_on_held_out_rows(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").where("lang is not null")
    found = QUERIES["op6_language_id"](spark, SF).where("held_out").join(truth, "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_stages_run_in_turn_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and 0 < out.count() <= docs.count()
            docs = spark.createDataFrame(out.collect(), out.schema)
        else:
            assert set(docs.columns) < set(out.columns)
            last = sorted((r.doc_id, r.copies) for r in out.collect())
    assert sorted((r.doc_id, r.copies) for r in corpus_pipeline.run(spark, SF).collect()) == last


def test_stages_on_odd_rows(spark):
    """Null ids, texts and labels, blank and repeated rows, and an empty table pass through every stage."""
    english = "this is a line of plain text about nothing in particular number"
    odd = [(1, None, None, None, None), (None, f"{english} one", "en", "src1", 5), (2, "", "en", "src0", 0), (3, f"{english} two", "en", None, 9), (3, f"{english} two", "en", None, 9), (4, "12 34", "en", "src2", 5)]
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, spark.createDataFrame(odd, SCHEMA), SF).collect()
        assert len(found) <= len(odd), name
        assert stage(spark, spark.createDataFrame([], SCHEMA), SF).count() == 0, name
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, spark.createDataFrame(odd, SCHEMA), SF).collect()}
    assert 3 in kept and not kept & {1, 2, 4}


def test_workers_get_texts_in_small_batches(spark):
    """However many long texts a partition holds, no batch of them is much over 4 MB; a bound that was set stays."""

    def largest(batches):
        yield pa.RecordBatch.from_arrays([pa.array([max(b.nbytes for b in batches)])], ["n"])

    before = spark.conf.get(BATCH_BYTES)
    try:
        spark.conf.set(BATCH_BYTES, SPARKS_BYTES)
        docs = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("text "), 1000).alias("text"))
        assert scratch(docs.mapInArrow(largest, "n long"), "sizes").first().n < 5_000_000
        spark.conf.set(BATCH_BYTES, SPARKS_BYTES)
        assert best_score(docs, [], np.zeros((0, 0))) and docs.mapInArrow(largest, "n long").first().n < 5_000_000
        spark.conf.set(BATCH_BYTES, "8m")
        assert scratch(docs.mapInArrow(largest, "n long"), "sizes").first().n > 5_000_000
    finally:
        spark.conf.set(BATCH_BYTES, before)
