"""Term and tag overlap of many queries with many memories, by joins on an inverted table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text


def postings(memories: DataFrame) -> DataFrame:
    """(word, id), each once."""
    return memories.select("id", F.explode(F.array_distinct(text.words(F.col("text")))).alias("word"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, word, times): the words that count, and how often each stands in the query."""
    return queries.select("query_id", F.explode(text.query_words(F.col("text"))).alias("word")).groupBy("query_id", "word").agg(F.count("*").alias("times"))


def term_hits(terms: DataFrame, words: DataFrame) -> DataFrame:
    """(word, id), each once: memories that hold a query word or a variant of it, whichever queries ask for it."""
    wide = terms.select("word").distinct().select("word", F.explode(text.variants(F.col("word"))).alias("variant"))
    return words.withColumnRenamed("word", "variant").join(wide, "variant").select("word", "id").distinct()


def term_idf(terms: DataFrame, hits: DataFrame, n: Column) -> DataFrame:
    """(query_id, word, times, df, idf) for n memories; a word that stands twice in its query counts its memories twice."""
    df = hits.groupBy("word").agg(F.count("*").alias("held"))
    joined = terms.join(df, "word", "left").withColumn("df", (F.coalesce("held", F.lit(0)) * F.col("times")).cast("bigint"))
    return joined.select("query_id", "word", "times", "df", scoring.idf(n, F.col("df")).alias("idf"))


def term_overlap(weights: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, id, term): the share of the query's idf that a memory's words hold."""
    total = F.sum(F.col("idf") * F.col("times")).over(Window.partitionBy("query_id"))
    parts = weights.select("query_id", "word", (F.col("idf") * F.col("times")).alias("part"), total.alias("total"))
    held = hits.join(parts, "word").groupBy("query_id", "id").agg(F.sum("part").alias("matched"), F.max("total").alias("total"))
    return held.select("query_id", "id", F.when(F.col("total") >= 1e-6, F.col("matched") / F.col("total")).otherwise(0.0).alias("term"))


def tag_words(memories: DataFrame, sources: str | None = None) -> DataFrame:
    """(id, word, weight): words of tags, twice the weight for the user's own than for extracted ones."""
    weight = F.when(F.coalesce(F.get(F.col(sources), F.col("k")), F.lit("user")) == "auto", 1.0).otherwise(2.0) if sources else F.lit(2.0)
    tags = memories.select("id", *([sources] if sources else []), F.posexplode("tags").alias("k", "tag")).withColumn("weight", weight)
    split = tags.select("id", "weight", F.explode(F.split("tag", r"[^\p{L}\p{N}_]+")).alias("word")).filter("word <> ''")
    return split.groupBy("id", F.lower("word").alias("word")).agg(F.max("weight").alias("weight"))


def tag_overlap(weights: DataFrame, tags: DataFrame) -> DataFrame:
    """(query_id, id, tag): idf of query words that are tags, times the tag's weight, as a share of the query's idf."""
    total = weights.groupBy("query_id").agg(F.sum(F.col("idf") * F.col("times")).alias("total"))
    wide = weights.select("query_id", "word", "times", "idf", F.posexplode(text.variants(F.col("word"))).alias("order", "variant"))
    found = wide.join(tags.withColumnRenamed("word", "variant"), "variant")
    # the word itself decides, else its first variant; a word in s that only its plural meets weighs 1
    found = found.withColumn("weight", F.when(F.col("order") == 2, 1.0).otherwise(F.col("weight")))
    best = found.groupBy("query_id", "id", "word").agg(F.min_by("weight", "order").alias("weight"), F.max("times").alias("times"), F.max("idf").alias("idf"))
    held = best.groupBy("query_id", "id").agg(F.sum(F.col("idf") * F.col("times") * F.col("weight")).alias("matched"))
    return held.join(total, "query_id").select("query_id", "id", F.when(F.col("total") >= 1e-6, F.col("matched") / F.col("total")).otherwise(0.0).alias("tag"))
