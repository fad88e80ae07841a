"""Scores on columns: decay, boosts, intents, vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import HALF_LIFE, HEBBIAN
from .text import TEMPORAL_MARKERS

RARE_IDF = 4.0


def half_life(kind: Column) -> Column:
    out = F.lit(HALF_LIFE["fact"])
    for name, days in HALF_LIFE.items():
        out = F.when(kind == name, days).otherwise(out)
    return out


def days(then: Column, as_of: Column) -> Column:
    return (as_of - then) / 86400.0


def decay_factor(kind: Column, age: Column) -> Column:
    return F.pow(F.lit(2.0), -age / half_life(kind))


def effective_importance(kind: Column, salience: Column, importance: Column, created: Column, accessed: Column, accesses: Column, as_of: Column) -> Column:
    """Importance after decay; critical memories don't decay, important ones at a third of the pace, accesses hold against it."""
    age = F.when(kind.isin(*HEBBIAN), days(accessed, as_of)).otherwise(days(created, as_of))
    life = half_life(kind) * F.when(salience == "important", 3.0).otherwise(1.0)
    faded = importance * F.pow(F.lit(2.0), -age / life) * (1 + 0.1 * F.log1p(accesses.cast("double")))
    return F.when(salience == "critical", importance + 1).otherwise(faded)


def recency_boost(age_ms: Column) -> Column:
    return F.least(F.lit(0.05), 0.05 / (1 + F.greatest(age_ms, F.lit(1)) / 3.6e6))


def idf(n: Column, df: Column) -> Column:
    return F.log((F.greatest(n, F.lit(1)) - df + 0.5) / (df + 0.5) + 1)


def intent(query: Column, top_idf: Column) -> Column:
    low = F.lower(query)
    temporal = F.lit(False)
    for marker in TEMPORAL_MARKERS:
        temporal = temporal | F.contains(low, F.lit(marker))
    return F.when(temporal, "temporal").when(top_idf >= RARE_IDF, "factual").otherwise("general")


def margin_floor(kind: Column) -> Column:
    return F.when(kind == "factual", 0.012).when(kind == "temporal", 0.003).otherwise(0.005)


def term_floor(kind: Column) -> Column:
    return F.when(kind == "factual", 0.30).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Zero for vectors of other lengths or without a norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm >= 1e-9), dot(a, b) / norm).otherwise(0.0)
