"""Rank fusion, floors, selection under a token budget, verdicts and truncation."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import scoring

RRF_K = 60
#: Rows that the driver looks at together in knapsack().
STRETCH = 4096
#: Values at or below which a signal gives no rank score.
THRESHOLD = {"fp": -1.0, "ppr": 0.0, "term": 0.0, "tag": 0.0, "decay": 0.0}
WEIGHT = {"fp": 1.0, "ppr": 1.0, "term": 1.0, "tag": 0.8, "decay": 1.0}


@dataclass(frozen=True)
class Knobs:
    """The settings of a recall."""

    budget: int = 2000
    spread: float = 0.7
    seeds: int = 8
    candidates: int = 32
    buffer_boost: float = 0.2
    score_floor: float = 0.04
    margin_floor: float = 0.005
    support_floor: float = 0.0
    confident: int = 0
    low: int = 0
    ambiguous: int = 0
    solo_score: float = 0.0
    solo_margin: float = 0.0
    seed_similarity: float = 0.12


def rrf(signal: str, partition: str = "query_id") -> Column:
    """1 / (60 + rank), ties sharing the rank before them; nothing at or below the signal's threshold."""
    x = F.col(signal)
    rank = F.rank().over(Window.partitionBy(partition).orderBy(x.desc())) - 1
    return F.when(x > THRESHOLD[signal], 1.0 / (RRF_K + rank)).otherwise(0.0)


def fused(df: DataFrame, signals: tuple[str, ...], partition: str = "query_id", out: str = "score") -> DataFrame:
    """df with the weighted sum of rank scores, and a little for any term at all."""
    df = df.withColumns({f"_{s}": rrf(s, partition) for s in signals})
    score = F.lit(0.0)
    for s in signals:
        score = score + WEIGHT[s] * F.col(f"_{s}")
    if "term" in signals:
        score = score + F.when(F.col("term") > 0, 0.02).otherwise(0.0)
    return df.withColumn(out, score).drop(*(f"_{s}" for s in signals))


def floored(df: DataFrame, partition: str = "query_id", score: str = "score") -> DataFrame:
    """Without what is below a quarter of the best score, if that is above 0.01."""
    top = F.max(score).over(Window.partitionBy(partition))
    return df.withColumn("_top", top).filter((F.col("_top") <= 0.01) | (F.col(score) >= 0.25 * F.col("_top"))).drop("_top")


def halved(df: DataFrame, partition: str = "query_id", score: str = "score", dense: str = "dense") -> DataFrame:
    """Half the score for rows whose dense similarity is below 0.4 of the upper median, if that is above 0.15 and there are over two rows."""
    w = Window.partitionBy(partition)
    n = F.count("*").over(w)
    ranked = df.withColumn("_at", F.row_number().over(w.orderBy(dense, "id"))).withColumn("_n", n)
    middle = F.max(F.when(F.col("_at") == F.floor(F.col("_n") / 2) + 1, F.col(dense))).over(w)
    low = (F.col("_n") > 2) & (F.col("_middle") > 0.15) & (F.col(dense) < F.col("_middle") * 0.4)
    return ranked.withColumn("_middle", middle).withColumn(score, F.when(low, F.col(score) * 0.5).otherwise(F.col(score))).drop("_at", "_n", "_middle")


def first_k(df: DataFrame, k: int, order: list[Column], partition: str = "query_id") -> DataFrame:
    """The first k of each partition; Spark prunes to k in each task before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(partition).orderBy(*order))).filter(F.col("_rn") <= k).drop("_rn")


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def recency_rank(created: str, partition: str = "query_id", tie: str = "id") -> Column:
    """From 0 for the oldest to 1 for the newest."""
    w = Window.partitionBy(partition)
    return (F.row_number().over(w.orderBy(created, tie)) - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1))


def select_diverse(rows: list[dict], budget: int, spread: float) -> list[int]:
    """Indices of the chosen rows, in order. rows: score, tags, tokens, recency (0 to 1), fresh (whether recency counts)."""
    if not rows:
        return []
    scores = [r["score"] for r in rows]
    low, span = min(scores), max(max(scores) - min(scores), 1e-6)
    tags = [frozenset(r["tags"] or ()) for r in rows]
    left, chosen, used = list(range(len(rows))), [], 0

    def alike(a: int, b: int) -> float:
        union = tags[a] | tags[b]
        return len(tags[a] & tags[b]) / len(union) if union else 0.0

    while left and used < budget:
        best, best_value = None, float("-inf")
        for i in left:
            value = spread * (scores[i] - low) / span - (1 - spread) * max((alike(i, j) for j in chosen), default=0.0) + (0.03 * rows[i]["recency"] if rows[i]["fresh"] else 0.0)
            if best is None or value > best_value + 1e-6:
                best, best_value = i, value
        left.remove(best)
        if chosen and used + rows[best]["tokens"] > budget:
            best = next((i for i in left if used + rows[i]["tokens"] <= budget), None)
            if best is None:
                break
            left.remove(best)
        chosen.append(best)
        used += rows[best]["tokens"]
    return chosen


def pack(df: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """Picks of each query in order (query_id, id, score, pick). df: at most knobs.candidates rows for each query."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "created_s", "id"], ascending=[False, False, True])
        rows = pdf.to_dict("records")
        chosen = select_diverse([{"score": r["score"], "tags": list(r["tags"]) if r["tags"] is not None else [], "tokens": r["token_count"], "recency": r["recency"], "fresh": r["fresh"]} for r in rows], knobs.budget, knobs.spread)
        return pd.DataFrame([{"query_id": rows[i]["query_id"], "id": rows[i]["id"], "score": rows[i]["score"], "pick": n} for n, i in enumerate(chosen)], columns=["query_id", "id", "score", "pick"])

    return df.select("query_id", "id", "score", "tags", "token_count", "created_s", "recency", "fresh").groupBy("query_id").applyInPandas(pick, "query_id bigint, id bigint, score double, pick int")


def verdict(hits: Column, top: Column, margin: Column, term: Column, dense: Column, intent: Column, knobs: Knobs = Knobs()) -> Column:
    floor = F.greatest(F.lit(knobs.margin_floor), scoring.margin_floor(intent))
    return (
        F.when(hits == 0, "abstained")
        .when(top < knobs.score_floor, "low_confidence")
        .when((hits > 1) & (margin < floor), "ambiguous_leader")
        .when(term < scoring.term_floor(intent), "unsupported_top")
        .when((term <= 0) & (dense < knobs.support_floor), "unsupported_top")
        .otherwise("confident")
    )


def keep_at_most(verdict: Column, top: Column, margin: Column, term: Column, knobs: Knobs = Knobs()) -> Column:
    """How many picks a verdict leaves; 0 for all."""
    solo = F.lit(knobs.solo_score > 0) & (top >= knobs.solo_score) & ((margin >= knobs.solo_margin) | (term >= 0.5))
    return F.when(verdict == "confident", F.when(solo, 1).otherwise(knobs.confident)).when(verdict == "low_confidence", knobs.low).when(verdict == "ambiguous_leader", knobs.ambiguous).otherwise(0)


def knapsack(df: DataFrame, key: Column, cost: Column, budget: int) -> list[Row]:
    """The rows that fit when taken in the order of key, skipping what doesn't; as rows of df and _key.

    key: a struct, different in each row and without nulls. What is left of the budget only falls, so that a row that
    doesn't fit never will: the driver takes STRETCH rows at a time, of those that come next and fit what is left by then.
    """
    rows = df.withColumns({"_key": key, "_cost": cost.cast("bigint")})
    kinds = rows.schema["_key"].dataType.fields
    left, part, out = budget, rows, []
    while True:
        got = part.filter(F.col("_cost") <= left).orderBy("_key").limit(STRETCH).collect()
        for r in got:
            if r["_cost"] <= left:
                left -= r["_cost"]
                out.append(r)
        if len(got) < STRETCH:
            return out
        part = rows.filter(F.col("_key") > F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(got[-1]["_key"], kinds, strict=True))))


__all__ = ["Knobs", "first_k", "floored", "fused", "keep_at_most", "keep_first", "knapsack", "pack", "recency_rank", "rrf", "select_diverse", "verdict"]
