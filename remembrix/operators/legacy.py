"""The older engine's scores: text hits with global rank, and snapshots of the most important memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import graph, ranking

LINE_TOKENS = 4


def recall_score(is_hit: Column, ppr: Column, importance: Column) -> Column:
    return F.when(is_hit, 1.0).otherwise(0.3) * (1 + 10 * ppr) * (0.5 + 0.5 * importance)


def snapshot(nodes: DataFrame, edges: DataFrame, budget: int, seeds: int = 50, header: int = 10) -> DataFrame:
    """(id, score, place): the best by rank and importance, in order, that fit a budget of words plus LINE_TOKENS each.

    nodes: id, words, importance. A row that doesn't fit is skipped, and those after it are tried; place counts all rows.
    """
    top = nodes.orderBy(F.desc("importance"), "id").limit(seeds)
    ranks = graph.global_pagerank(edges, nodes, top.select("id"))
    scored = graph.kept(nodes.join(ranks, "id").select("id", "words", (F.col("ppr") * (0.5 + 0.5 * F.col("importance"))).alias("score")))
    order = F.struct((-F.col("score")).alias("low"), F.col("id"))
    chosen = ranking.knapsack(scored, order, F.col("words") + LINE_TOKENS, budget - header)
    kind = scored.schema["id"].dataType
    found = F.broadcast(nodes.sparkSession.createDataFrame([(r["id"], r["score"]) for r in chosen], StructType().add("id", kind).add("score", "double")))  # no more than fit the budget
    before = scored.select(order.alias("other")).join(found, F.col("other") < order).groupBy("id").agg(F.count("*").cast("int").alias("place"))
    return found.join(before, "id", "left").select("id", "score", F.coalesce("place", F.lit(0)).alias("place"))
