"""Filters on typed attributes, with three outcomes: MATCH, NO_MATCH, and MISMATCH of types.

An attribute is a struct of its type tag t ("bool", "number", "text", "list") and the fields b, n, s and l.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_MATCH, MATCH, MISMATCH = 0, 1, 2
VALUE = "struct<t:string,b:boolean,n:double,s:string,l:array<string>>"
NEAR = 1e-9


def value(t: str, **fields: Column) -> Column:
    return F.struct(F.lit(t).alias("t"), *(fields.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in (("b", "boolean"), ("n", "double"), ("s", "string"), ("l", "array<string>"))))


def from_json(text: Column) -> Column:
    """A map of attributes from JSON with plain values; an empty one for what is no JSON object."""
    held = F.coalesce(F.from_json(text, "map<string,variant>"), F.create_map().cast("map<string,variant>"))

    def one(_: Column, v: Column) -> Column:
        get = lambda kind: F.try_variant_get(v, "$", kind)
        kind = F.schema_of_variant(v)
        listed = kind.startswith("ARRAY")
        name = F.when(kind == "BOOLEAN", "bool").when(kind == "STRING", "text").when(listed, "list").when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), "number")
        return F.struct(name.alias("t"), F.when(kind == "BOOLEAN", get("boolean")).alias("b"), F.when(name == "number", get("double")).alias("n"), F.when(kind == "STRING", get("string")).alias("s"), F.when(listed, get("array<string>")).alias("l"))

    return F.transform_values(held, one)


def plain_json(attributes: Column) -> Column:
    """JSON with plain values from a map of attributes, keys in order."""
    value = lambda v: F.when(v["t"] == "bool", v["b"].cast("string")).when(v["t"] == "number", F.to_json(F.array(v["n"])).substr(F.lit(2), F.length(F.to_json(F.array(v["n"]))) - 2)).when(v["t"] == "text", _quoted(v["s"])).otherwise(F.to_json(v["l"]))
    pairs = F.array_sort(F.transform(F.map_keys(attributes), lambda k: F.concat(_quoted(k), F.lit(":"), value(F.element_at(attributes, k)))))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def _quoted(text: Column) -> Column:
    held = F.to_json(F.array(text))
    return held.substr(F.lit(2), F.length(held) - 2)


def _outcome(right_type: Column, holds: Column) -> Column:
    return F.when(~right_type, MISMATCH).when(holds, MATCH).otherwise(NO_MATCH)


class Filter:
    def on(self, v: Column) -> Column:
        """The outcome for an attribute that is there."""
        raise NotImplementedError


@dataclass(frozen=True)
class Eq(Filter):
    wanted: bool | float | str | tuple

    def on(self, v: Column) -> Column:
        w = self.wanted
        if isinstance(w, bool):
            return _outcome(v["t"] == "bool", v["b"] == w)
        if isinstance(w, (int, float)):
            return _outcome(v["t"] == "number", F.abs(v["n"] - float(w)) <= NEAR)
        if isinstance(w, str):
            return _outcome(v["t"] == "text", v["s"] == w)
        return _outcome(v["t"] == "list", v["l"] == F.array(*map(F.lit, w)))


@dataclass(frozen=True)
class Gt(Filter):
    than: float

    def on(self, v: Column) -> Column:
        return _outcome(v["t"] == "number", v["n"] > self.than)


@dataclass(frozen=True)
class Lt(Filter):
    than: float

    def on(self, v: Column) -> Column:
        return _outcome(v["t"] == "number", v["n"] < self.than)


@dataclass(frozen=True)
class Range(Filter):
    low: float
    high: float

    def on(self, v: Column) -> Column:
        return _outcome(v["t"] == "number", v["n"].between(self.low, self.high))


@dataclass(frozen=True)
class Contains(Filter):
    member: str

    def on(self, v: Column) -> Column:
        return _outcome(v["t"] == "list", F.coalesce(F.array_contains(v["l"], self.member), F.lit(False)))


@dataclass(frozen=True)
class Substring(Filter):
    part: str

    def on(self, v: Column) -> Column:
        return _outcome(v["t"] == "text", F.contains(v["s"], F.lit(self.part)))


@dataclass(frozen=True)
class All(Filter):
    """All of them: the first that doesn't match, from the left, decides."""

    of: tuple[Filter, ...]

    def on(self, v: Column) -> Column:
        out = F.lit(MATCH)
        for f in reversed(self.of):
            one = f.on(v)
            out = F.when(one != MATCH, one).otherwise(out)
        return out


@dataclass(frozen=True)
class Any(Filter):
    """Any of them: a mismatch only if every one is."""

    of: tuple[Filter, ...]

    def on(self, v: Column) -> Column:
        if not self.of:
            return F.lit(NO_MATCH)
        each = [f.on(v) for f in self.of]
        hit, off = F.lit(False), F.lit(True)
        for one in each:
            hit, off = hit | (one == MATCH), off & (one == MISMATCH)
        return F.when(hit, MATCH).when(off, MISMATCH).otherwise(NO_MATCH)


def outcome(attributes: Column, key: str, f: Filter) -> Column:
    """The outcome for a map of attributes; a missing key doesn't match."""
    v = F.try_element_at(attributes, F.lit(key))
    return F.when(v.isNull(), NO_MATCH).otherwise(f.on(v))


def matches(attributes: Column, filters: dict[str, Filter]) -> Column:
    """Whether every filter matches."""
    out = F.lit(True)
    for key, f in filters.items():
        out = out & (outcome(attributes, key, f) == MATCH)
    return out


def mismatched(attributes: Column, filters: dict[str, Filter]) -> Column:
    """The keys whose filter was of another type, as an array."""
    return F.filter(F.array(*(F.when(outcome(attributes, key, f) == MISMATCH, key) for key, f in sorted(filters.items()))), lambda k: k.isNotNull())
