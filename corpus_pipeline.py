"""A training-data pipeline over documents: each stage works on what the one before kept.

run(spark, sf_dir) applies all stages. Each writes its rows as Parquet in the shared folder of
spark.checkpoint.dir, which the next one reads, so that a lost executor costs no finished stage.
SQL can express neither the classifier nor the tokenizer, so ORACLE_SQL is None and tests compare each stage
with a brute-force version.

Defined cases, in every stage: a null text is an empty one; rows with null or repeated ids are judged by themselves, and
an id says nothing about another row with it; equal rows get equal verdicts, of which near-dedup keeps one; ties go to
the least id, then the least hash of the row; an empty table gives an empty one; texts of any length are read whole;
further columns of docs are dropped, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remembrix.llm import bpe, common, decontaminate, quality, secrets, simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled ones among docs."""
    score = quality.scorer(spark, quality.train(docs, common.table(spark, sf_dir, "labels")))
    return docs.filter(score(F.col("text")) >= quality.ACCEPT).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the least id, and of those that with the least hash of the row."""
    # a null leaves xxhash64 as it was, so that the places of nulls are hashed too
    row = F.xxhash64(*COLUMNS, *(F.isnull(c) for c in COLUMNS))
    keys = common.cut(docs.select("doc_id", row.alias("row"), simhash.fingerprint(F.col("text")).alias("fp")))
    found = keys.join(simhash.classes(keys).select("fp", "root"), "fp").groupBy("root", "doc_id", "row").agg(F.count("*").alias("n"))
    key = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")
    found = common.cut(found)
    # written out before the join, so that Spark can split the rows of a component that holds much of the table
    best = common.cut(found.groupBy("root").agg(F.min(key).alias("best")))
    found = common.cut(found.join(best, "root").select("doc_id", "row", "n", (key == F.col("best")).alias("kept")))
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("_doc_id"), F.col("row").alias("_row"))
    rest = docs.withColumn("_hash", row)
    rest = rest.join(gone, rest["doc_id"].eqNullSafe(gone["_doc_id"]) & (rest["_hash"] == gone["_row"]), "left_anti")
    copies = not found.filter("kept AND n > 1").isEmpty()
    return (rest.dropDuplicates(["doc_id", "_hash"]) if copies else rest).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without enough of the benchmark's passages to be contaminated."""
    return decontaminate.remove(docs, common.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in the text and n_chars to match."""
    found = secrets.find_secrets(docs, out="_secrets").withColumn("text", secrets.masked(F.col("text"), F.col("_secrets")))
    return found.withColumn("n_chars", F.when(F.size("_secrets") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, their number, and the text that the ids decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    made = bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), path)
    return made.select("doc_id", "lang", "source", "tokens.ids", F.size("tokens.ids").cast("bigint").alias("n_tokens"), "tokens.decoded")


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("BPE encoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
