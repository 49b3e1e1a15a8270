"""The pipeline's stages against what plain Python keeps, and on tables with nulls and without rows."""

import hashlib
import os

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from factloom.llm import pretokens, queries, secrets, toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_are_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "benchmark_passages", "secret_scan", "token_ids"]
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.scored(docs, model).where("predicted = 1").collect()}
    one = corpus_pipeline.toxic(spark, docs, SF)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == set(texts) - bad
    one.write.parquet(str(tmp_path / "1"))
    one = spark.read.parquet(str(tmp_path / "1"))
    two = corpus_pipeline.near_copies(spark, one, SF)
    kept = {r.doc_id for r in two.collect()}
    assert len({texts[i].text for i in kept}) == len(kept)
    two.write.parquet(str(tmp_path / "2"))
    two = spark.read.parquet(str(tmp_path / "2"))
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    three = corpus_pipeline.benchmark_passages(spark, two, SF)
    assert {r.doc_id for r in three.collect()} == {i for i in kept if not any(t in texts[i].text for t in items)}
    four = corpus_pipeline.secret_scan(spark, three, SF)
    assert four.columns == docs.columns and four.dtypes == docs.dtypes
    rows = four.collect()
    for r in rows:
        assert r.text == secrets.redacted(texts[r.doc_id].text, secrets.spans(texts[r.doc_id].text))
        assert r.n_chars == (len(r.text) if secrets.MARK in r.text else texts[r.doc_id].n_chars)
    encode = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pretokens.ranks(public_tokenizers.path(queries.RANKS)), special_tokens={}).encode_ordinary
    last = {r.doc_id: r for r in corpus_pipeline.token_ids(spark, four, SF).collect()}
    assert set(last) == {r.doc_id for r in rows}
    for r in rows:
        assert last[r.doc_id].n_tokens == len(encode(r.text)) and last[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, last.values()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.sql(f"create view {table.removesuffix('.parquet')} as select * from '{SF}/{table}'")
    result = con.sql(queries.ORACLE_SQL[name])
    assert sorted(result.columns) == columns
    assert sorted(tuple(dict(zip(result.columns, r, strict=True))[c] for c in columns) for r in result.fetchall()) == sorted(map(tuple, frame.select(*columns).collect()))


@pytest.mark.parametrize("rows", [0, 3])
def test_nulls_and_no_rows(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    extra = spark.range(rows).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"), F.lit("x").alias("score"), F.lit("x").alias("blob"))
    now = docs.withColumns({"score": F.lit("x"), "blob": F.lit("x")}).unionByName(extra)
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        assert now.count() == rows, name
