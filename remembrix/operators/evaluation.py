"""Measures of retrieval quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def duplicate_stats(df: DataFrame, key: str, column: str) -> DataFrame:
    """Of each key: lines, different ones, repeats, and their share."""
    out = df.groupBy(key).agg(F.count(column).alias("lines"), F.countDistinct(column).alias("different"))
    return out.withColumn("repeats", F.col("lines") - F.col("different")).withColumn("rate", F.when(F.col("lines") > 0, F.col("repeats") / F.col("lines")).otherwise(0.0))


def by_category(df: DataFrame, category: str, hit: str, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """Totals, hits and percent of each category, and of all but those left out as OVERALL."""
    each = df.groupBy(category).agg(F.count("*").alias("total"), F.sum(F.col(hit).cast("bigint")).alias("hits"))
    whole = df.filter(~F.col(category).isin(*leave_out)) if leave_out else df
    total = whole.agg(F.lit("OVERALL").alias(category), F.count("*").alias("total"), F.coalesce(F.sum(F.col(hit).cast("bigint")), F.lit(0)).alias("hits"))
    return each.union(total).withColumn("percent", F.when(F.col("total") > 0, F.col("hits") * 100.0 / F.col("total")).otherwise(0.0))


def _values_at(df: DataFrame, key: str, value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Of each key the values at places (from 0, functions of the key's number of rows) in ascending order; nulls are left out.

    Equal values are counted first, and a sketch of each key cuts its range in stretches, so that only the stretches
    that hold a wanted place are ordered; no task gets the rows of a key together.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_c"))
    cuts = counts.groupBy(key).agg(F.percentile_approx(value, [k / 64 for k in range(1, 64)], 1000).alias("_cuts"))
    staged = counts.join(cuts, key).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    by_key = Window.partitionBy(key)
    parts = staged.groupBy(key, "_part").agg(F.sum("_c").alias("_s")).withColumn("_n", F.sum("_s").over(by_key))
    parts = parts.withColumn("_to", F.sum("_s").over(by_key.orderBy("_part"))).withColumn("_from", F.col("_to") - F.col("_s"))
    parts = parts.withColumns({f"_at_{name}": f(F.col("_n")).cast("bigint") for name, f in places.items()})
    wanted = F.lit(False)
    for name in places:
        wanted = wanted | ((F.col(f"_at_{name}") >= F.col("_from")) & (F.col(f"_at_{name}") < F.col("_to")))
    rows = staged.join(parts.filter(wanted).drop("_s", "_to"), [key, "_part"])
    end = F.col("_from") + F.sum("_c").over(Window.partitionBy(key, "_part").orderBy(value))
    rows = rows.withColumn("_end", end)
    held = lambda name: (F.col(f"_at_{name}") < F.col("_end")) & (F.col(f"_at_{name}") >= F.col("_end") - F.col("_c"))
    return rows.groupBy(key).agg(*(F.max(F.when(held(name), F.col(value))).alias(name) for name in places))


def index_percentiles(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Of each key the values at index int(n * share) of the sorted ones, at most the last; a share of 0.5 is the upper median."""
    return _values_at(df, key, value, {name: lambda n, p=p: F.least(F.floor(n * F.lit(p)), n - 1) for name, p in shares.items()})


def linear_percentile(df: DataFrame, key: str, value: str, share: float, out: str) -> DataFrame:
    """Of each key the value at (n - 1) * share of the sorted ones, in a straight line between neighbours."""
    place = lambda n: (n - 1) * F.lit(share)
    low = _values_at(df, key, value, {"_low": lambda n: F.floor(place(n)), "_high": lambda n: F.ceil(place(n))})
    count = df.filter(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    part = place(F.col("_n")) - F.floor(place(F.col("_n")))
    return low.join(count, key).select(key, (F.col("_low") + part * (F.col("_high") - F.col("_low"))).alias(out))


def judge_report(df: DataFrame, category: str, substring: str, judge: str) -> DataFrame:
    """Of each category: tasks, mean substring score, mean judge score over those judged, and the lift between the two."""
    out = df.groupBy(category).agg(F.count("*").alias("tasks"), F.count(judge).alias("judged"), F.avg(substring).alias("substring"), F.avg(judge).alias("judge"))
    return out.withColumn("lift", F.col("judge") - F.col("substring"))


def outcomes(picks: DataFrame, cases: DataFrame) -> DataFrame:
    """query_id, category, expect_abstain, hit (gold in any pick), top (gold in the first), tokens, and right: hit, or for a case without an answer a verdict that isn't confident.

    picks: query_id, pick, text, token_count, verdict. cases: query_id, category, gold, expect_abstain. A case without picks hits nothing.
    """
    found = cases.select("query_id", "gold").join(picks, "query_id")
    holds = text.holds(F.col("gold"), F.coalesce("text", F.lit(""))) > 0
    each = found.groupBy("query_id").agg(F.max(holds).alias("hit"), F.max(holds & (F.col("pick") == 0)).alias("top"), F.sum("token_count").alias("tokens"), F.max("verdict").alias("verdict"))
    no = F.lit(False)
    out = cases.join(each, "query_id", "left").withColumns({"hit": F.coalesce("hit", no), "top": F.coalesce("top", no), "tokens": F.coalesce("tokens", F.lit(0)).cast("bigint")})
    right = F.when(F.col("expect_abstain"), F.coalesce("verdict", F.lit("abstained")) != "confident").otherwise(F.col("hit"))
    return out.select("query_id", "category", "expect_abstain", "hit", "top", "tokens", right.alias("right"))


def outcome_report(judged: DataFrame) -> DataFrame:
    """Of each category and OVERALL: cases, hits, firsts, abstentions that are right, and tokens of a right first pick. OVERALL has the cases with an answer only."""
    number = lambda c, name: F.count_if(c).alias(name)
    asks = ~F.col("expect_abstain")
    made = [F.count("*").alias("cases"), number(asks & F.col("hit"), "hits"), number(asks & F.col("top"), "firsts"), number(F.col("expect_abstain") & F.col("right"), "abstained"), F.sum("tokens").cast("bigint").alias("tokens")]
    both = judged.groupBy("category").agg(*made).union(judged.filter(asks).agg(F.lit("OVERALL").alias("category"), *made).select("category", "cases", "hits", "firsts", "abstained", "tokens"))
    return both.withColumn("tokens_per_first", F.col("tokens") / F.nullif(F.col("firsts"), F.lit(0)))


def token_savings(picks: DataFrame, memories: DataFrame) -> DataFrame:
    """query_id, used, naive (all memories' tokens), and the share that is saved."""
    used = picks.groupBy("query_id").agg(F.coalesce(F.sum("token_count"), F.lit(0)).cast("bigint").alias("used"))
    whole = memories.agg(F.coalesce(F.sum("token_count"), F.lit(0)).cast("bigint")).scalar()
    return used.withColumn("naive", whole).withColumn("saved", F.when(F.col("naive") > 0, 1 - F.col("used") / F.col("naive")).otherwise(0.0))


def summary(df: DataFrame, score: str, tokens: str) -> DataFrame:
    """Tasks, mean score, total and mean tokens, and tokens for each correct answer (null without any)."""
    right = F.count_if(F.col(score) >= 1.0)
    return df.agg(F.count("*").alias("tasks"), F.avg(score).alias("average_score"), F.sum(tokens).alias("total_tokens"), F.avg(tokens).alias("average_tokens"), (F.sum(tokens) / F.nullif(right, F.lit(0))).alias("tokens_per_correct"))


def lift(df: DataFrame, position: str, mode: str, value: str, base: str, other: str) -> DataFrame:
    """Means of two modes at each position, and how far the other is above the base."""
    wide = df.groupBy(position).pivot(mode, [base, other]).agg(F.avg(value))
    return wide.withColumn("lift", F.col(other) - F.col(base))
