"""A pipeline over documents: toxicity, near-duplicates, benchmark passages, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; all but the last return the columns of documents. Rows with a null doc_id
can't be told apart, so decisions on one of them hold for all; repeated rows of one
doc_id stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, decontaminate, secrets, simhash, toxicity
from factloom.llm.common import discard, scratch, shared_dir, table, written
from factloom.llm.queries import RANKS
from factloom.session import ready

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts toxic go."""
    path = shared_dir(spark, "toxic-ids")
    with scratch(spark):
        found = toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
        gone = written(found.where("predicted = 1").select("doc_id").distinct(), path)
    return _without(docs, gone)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (80 % of five-word shingles in common) the document with the smallest id stays."""
    path = shared_dir(spark, "copied-ids")
    with scratch(spark):
        gone = written(simhash.near_copies(docs).where("doc_id <> component_id").select("doc_id").distinct(), path)
    return _without(docs, gone)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    path = shared_dir(spark, "leaked-ids")
    with scratch(spark):
        gone = written(decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), path)
    return _without(docs, gone)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text. Documents without any stay as they are."""
    path = shared_dir(spark, "secret-spans")
    with scratch(spark):
        found = secrets.scan(docs, ["doc_id"], shared_dir(spark, "secret-ledger")).where(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
        written(found, path)
    found = spark.read.schema(found.schema).parquet(path)
    inner = docs.select(*COLUMNS).withColumn("blob", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    joined = inner.join(found, "blob", "left")
    new = secrets.redact(joined.select(*COLUMNS, "spans"))
    return new.select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the bytes that they decode to."""
    return bpe.encode_and_decode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows of these ids; Spark broadcasts the ids only where their measured size allows it."""
    return docs.select(*COLUMNS).join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")


STAGES = [(name, ready(f)) for name, f in (("toxicity", toxic), ("near_copies", near_copies), ("benchmark_passages", benchmark_passages), ("secret_scan", secret_scan), ("token_ids", token_ids))]
#: Neither the trained model nor the hashes can be written in SQL; the pipeline is tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's table goes when the next one's is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, path := shared_dir(spark, name))
            if last:
                discard(spark, last)
            last = path
    return docs
