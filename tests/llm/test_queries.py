"""The registered queries against DuckDB, and the pipeline's stages against their own definitions."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import mixing
from corpusloom.llm.queries import ORACLES, QUERIES
from tests.llm import cases

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name, columns", [("op1_order_minhash", 7), ("op2_html_extract", 4), ("op3_bpe", 4), ("op5_pii", 7), ("op9_language_id", 4)])
def test_whole_tables(spark, name, columns):
    df = QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/{'pages' if name.startswith('op2') else 'documents'}.parquet").count()
    assert df.count() == n and len(df.columns) == columns


def test_held_out_languages(spark):
    rows = QUERIES["op9_language_id"](spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.known_language(spark, docs, SF).cache()
    assert kept.columns == docs.columns and kept.count() >= 0.95 * docs.count()
    one = corpus_pipeline.near_duplicates(spark, kept, SF).cache()
    plain = cases.linked([(r["doc_id"], r["text"]) for r in kept.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({c for _, _, c in plain})
    clean = corpus_pipeline.without_personal_data(spark, one, SF).cache()
    assert clean.count() == one.count() and clean.columns == docs.columns
    assert not clean.where(F.col("text").rlike(r"[a-z0-9.]+@[a-z0-9]+\.example\.com")).count()
    mix = corpus_pipeline.mixed(spark, clean, SF).cache()
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(mixing.sized(clean.withColumn("doc_id", F.xxhash64("doc_id", "source", "text")))).collect()}
    got = {r["k"]: r["n"] for r in mixing.sized(mix).join(clean.select("doc_id", F.xxhash64("doc_id", "source", "text").alias("k")), "doc_id").groupBy("k").agg(F.sum("size").alias("n")).collect()}
    assert got == {k: n for k, n in want.items() if n}
    # rows come in the order of the mix
    keyed = clean.withColumn("k", F.xxhash64("doc_id", "source", "text"))
    _, turns = mixing.plan(mixing.sized(keyed.withColumn("doc_id", F.col("k"))))
    order = turns.join(keyed.select("k", "doc_id"), F.col("_d") == F.col("k")).orderBy("slot", "turn", "doc_id").select("doc_id").collect()
    assert [r["doc_id"] for r in corpus_pipeline.mixed(spark, clean, SF).collect()] == [r["doc_id"] for r in order]
    out = corpus_pipeline.encoded(spark, mix, SF).collect()
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in out) == sorted((r["doc_id"], cases.sha(r["text"])) for r in mix.collect())


def test_pipeline_keeps_unlike_texts_of_one_id(spark):
    a, b, c = (cases.sentence(60, seed) for seed in (1, 2, 3))
    near = a.rsplit(" ", 1)[0] + " changed"
    data = [(3, a), (5, a), (5, b), (5, b), (6, near), (7, b), (7, c), (8, ""), (8, None), (9, "alone"), (None, a)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, SF).select("doc_id", "text").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(3, a), (5, b), (7, c), (8, ""), (8, None), (9, "alone"), (None, a)], key=repr)


def test_pipeline_takes_awkward_rows(spark):
    for data in (None, []):
        docs = cases.documents(spark, data)
        n = docs.count()
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SF)
            if i < 4:
                assert docs.columns == list(corpus_pipeline.COLUMNS)
            docs = docs.cache()
            assert docs.count() <= 2 * max(n, 1)
