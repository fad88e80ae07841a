"""From the buffer into long-term memory: redundant, reinforcing or novel; then links by shared tags."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.hyper import BITS
from ..functions.scope import row_can_read
from .graph import components, kept

REDUNDANT, REINFORCES, SURPRISE, GROWN = 0.85, 0.65, 0.05, 30
SHARED = 2

_PASS = "agent string, id bigint, verdict string, similarity double, neighbour bigint, salience string, importance double"


def verdict(similarity: Column, supersedes: Column) -> Column:
    return F.when(supersedes.isNotNull(), "novel").when(similarity >= REDUNDANT, "redundant").when(similarity >= REINFORCES, "reinforces").otherwise("novel")


def _tag_keys(tags: Column, least: int) -> Column:
    """What two sets that share least tags have in common: pairs of tags, or tags if one is enough."""
    if least < 2:
        return tags
    return F.flatten(F.transform(tags, lambda t, i: F.transform(F.slice(tags, i + 2, F.size(tags)), lambda u: F.concat_ws("\x00", t, u))))


def classes(memories: DataFrame) -> DataFrame:
    """memories with tags sorted and class_id, the least id with the same agent and tags."""
    rows = memories.withColumn("tags", F.array_sort(F.array_distinct("tags")))
    least = rows.groupBy(F.col("agent").alias("_agent"), F.col("tags").alias("_tags")).agg(F.min("id").alias("class_id"))
    return rows.join(least, F.col("agent").eqNullSafe(F.col("_agent")) & (F.col("tags") == F.col("_tags"))).drop("_agent", "_tags")


def class_pairs(classed: DataFrame, least: int = SHARED) -> DataFrame:
    """(class_id, other): classes of one agent that share least tags or more, themselves included. classed: class_id, agent, tags."""
    keyed = classed.select("class_id", "agent", "tags").dropDuplicates(["class_id"]).select("class_id", "agent", F.explode(_tag_keys(F.col("tags"), least)).alias("key"))
    other = keyed.select(F.col("class_id").alias("other"), F.col("agent").alias("_agent"), F.col("key").alias("_key"))
    return keyed.join(other, (F.col("key") == F.col("_key")) & F.col("agent").eqNullSafe(F.col("_agent"))).select("class_id", "other").distinct()


#: Seconds of a stretch in which events are ordered together.
_STRETCH = 86400


def linked(memories: DataFrame, least: int = SHARED) -> DataFrame:
    """id, class_id, and how many memories share least tags with it: linked, and of events those later (before) and earlier (after).

    Equal memories are a class; classes meet, not their members, so that copies give no pairs.
    """
    rows = kept(classes(memories.select("id", "agent", "tags", "kind", "created_s")))
    pairs = kept(class_pairs(rows, least))
    sizes = rows.groupBy(F.col("class_id").alias("other")).agg(F.count("*").alias("n"))
    links = pairs.join(sizes, "other").groupBy("class_id").agg((F.sum("n") - F.max((F.col("class_id") == F.col("other")).cast("int"))).alias("linked"))
    events = rows.filter("kind = 'event'").groupBy(F.col("class_id").alias("other"), "created_s").agg(F.count("*").alias("n"))
    times = pairs.join(events, "other").groupBy("class_id", "created_s").agg(F.sum("n").alias("n")).withColumn("part", F.floor(F.col("created_s") / _STRETCH))
    parts = times.groupBy("class_id", "part").agg(F.sum("n").alias("s"))
    by_class = Window.partitionBy("class_id")
    parts = parts.select("class_id", "part", F.sum("s").over(by_class).alias("all"), (F.sum("s").over(by_class.orderBy("part")) - F.col("s")).alias("base"))
    upto = F.col("base") + F.sum("n").over(Window.partitionBy("class_id", "part").orderBy("created_s"))
    times = times.join(parts, ["class_id", "part"]).select("class_id", "created_s", (F.col("all") - upto).alias("before"), (upto - F.col("n")).alias("after"))
    found = rows.join(links, "class_id", "left").join(times, ["class_id", "created_s"], "left")
    zero = F.lit(0).cast("bigint")
    count = lambda c: F.when(F.col("kind") == "event", F.coalesce(c, zero)).otherwise(zero).alias(c)
    return found.select("id", "class_id", F.coalesce("linked", zero).alias("linked"), count("before"), count("after"))


_SCOPE = {"user": "string", "session": "string", "shared_with": "array<string>"}


def _scoped(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in _SCOPE.items() if c not in df.columns})


def _groups(buffer: DataFrame, graph: DataFrame, total: Column) -> tuple[DataFrame, DataFrame]:
    """buffer and graph with a column _group: agents that share, directly or over others, are one group.

    Verdicts look across agents in one more way: whether the whole graph has GROWN memories yet. A smaller one is folded as one group.
    """
    shared = lambda df: df.select(F.col("agent").alias("a"), F.explode(F.concat(F.array("agent"), F.coalesce("shared_with", F.array().cast("array<string>")))).alias("b"))
    names = components(shared(buffer).union(shared(graph)).filter("a IS NOT NULL AND b IS NOT NULL").distinct())
    named = lambda df: df.join(names.select(F.col("name").alias("agent"), "least"), "agent", "left").withColumn("_group", F.when(total >= GROWN, F.col("least")).otherwise(F.lit(""))).drop("least")
    return kept(named(buffer)), kept(named(graph))  # apart from each other, wherever they came from


def consolidate(buffer: DataFrame, graph: DataFrame, total: Column | None = None) -> DataFrame:
    """A row for each buffered memory: verdict, similarity and neighbour, and the salience and importance it goes in with.

    Each verdict depends on those before it, so that a group of agents that share is folded in order of seq, in one task.
    graph and buffer have agent, id, vector, salience, importance, and user, session and shared_with if scopes matter;
    buffer also seq and supersedes. total: how many memories the whole graph has, active or not; by default graph's rows.
    """
    buffer, graph = _scoped(buffer), _scoped(graph)
    total = graph.agg(F.count("*")).scalar() if total is None else total
    # only what the fold reads, as both sides are written and shuffled
    read = ["agent", "id", "vector", *_SCOPE]
    buffer, graph = _groups(buffer.select(*read, "salience", "importance", "seq", "supersedes", total.alias("_total")), graph.select(read), total)

    def fold(key: tuple, new: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        names = ["agent", "id", "verdict", "similarity", "neighbour", "salience", "importance"]
        if not len(new):
            return pd.DataFrame({}, columns=names)
        unpacked = lambda column: np.stack([np.asarray(v, np.int64).view(np.uint64) for v in column]) if len(column) else np.zeros((0, BITS // 64), np.uint64)
        text = lambda v: v if isinstance(v, str) else None
        scope = lambda r: (text(r["agent"]), text(r["user"]), text(r["session"]), frozenset(r["shared_with"]) if r["shared_with"] is not None else frozenset())
        known = known.sort_values("id") if len(known) else known
        size = len(known)
        held = np.zeros((size + len(new), BITS // 64), np.uint64)
        held[:size] = unpacked(known["vector"] if size else [])  # an empty side has no columns
        ids = known["id"].tolist() if size else []
        scopes = [scope(r) for r in known.to_dict("records")] if size else []
        kinds = {}  # of each different scope a number, so that who may read it is asked once
        numbers = np.zeros(size + len(new), np.int64)
        numbers[:size] = [kinds.setdefault(s, len(kinds)) for s in scopes]
        may: dict[tuple, bool] = {}

        def can_read(reader: tuple, row: tuple) -> bool:
            if (reader, row) not in may:
                agent, user, session, shared = row
                own = user is None or (user == reader[1] and (session is None or session == reader[2]))
                may[reader, row] = reader[0] in shared if agent != reader[0] else own
            return may[reader, row]

        out, grown = [], 0
        ordered = new.sort_values(["seq", "id"])
        for row, vector in zip(ordered.to_dict("records"), unpacked(ordered["vector"]), strict=True):
            mine = scope(row)
            similarity, near = 0.0, None
            replaces = row["supersedes"] is not None and not pd.isna(row["supersedes"])
            if replaces:
                similarity = 1.0
            elif size:
                seen = np.array([can_read(mine, s) for s in kinds])[numbers[:size]]
                if seen.any():
                    distance = np.where(seen, np.bitwise_count(held[:size] ^ vector).sum(1), BITS + 1)
                    at = int(distance.argmin())
                    similarity, near = 1 - 2 * int(distance[at]) / BITS, ids[at]
            kind = "novel" if replaces or similarity < REINFORCES else "redundant" if similarity >= REDUNDANT else "reinforces"
            salience, importance = row["salience"], row["importance"]
            if kind == "novel":
                if similarity < SURPRISE and row["_total"] + grown >= GROWN:
                    salience, importance = "critical", 1.0
                held[size] = vector
                numbers[size] = kinds.setdefault(mine, len(kinds))
                ids.append(row["id"])
                size, grown = size + 1, grown + 1
            out.append((row["agent"], row["id"], kind, float(similarity), near, salience, float(importance)))
        return pd.DataFrame(out, columns=names).astype({"neighbour": "Int64"})

    # written out: what stands above must not prune the columns that the fold reads
    return kept(buffer.groupBy("_group").cogroup(graph.groupBy("_group")).applyInPandas(fold, _PASS))


_LINKED = ["id", "agent", "user", "session", "shared_with", "tags", "kind", "created_s"]


def _sides(novel: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What links() joins: the novel memories, and all that are there, the old ones without seq."""
    new = _scoped(novel).select("seq", *_LINKED)
    return new, _scoped(old).select(F.lit(None).cast("bigint").alias("seq"), *_LINKED).unionByName(new)


def _readable(new: DataFrame, there: DataFrame, least: int) -> DataFrame:
    """Rows of new, their columns as n_, with the rows of there that they may read and that share least tags with them; once for each key that they share."""
    tags = lambda df: df.withColumn("tags", F.array_sort(F.array_distinct("tags"))).withColumn("key", F.explode(_tag_keys(F.col("tags"), least)))
    new = tags(new).select("key", *(F.col(c).alias(f"n_{c}") for c in new.columns))
    # who may read a memory at all: its agent and those it is shared with
    there = tags(there).withColumn("reader", F.explode(F.array_distinct(F.concat(F.array("agent"), F.coalesce("shared_with", F.array().cast("array<string>"))))))
    met = new.join(there, (new["key"] == there["key"]) & (new["n_agent"] == there["reader"]))
    reader = {c: F.col(f"n_{c}") for c in ("agent", "user", "session")}
    return met.filter(row_can_read(reader, F.col("agent"), F.col("user"), F.col("session"), F.col("shared_with")))


def _links(new: DataFrame, there: DataFrame, least: int) -> DataFrame:
    met = _readable(new, there, least)
    before = F.col("seq").isNull() | (F.struct("seq", "id") < F.struct(F.col("n_seq").alias("seq"), F.col("n_id").alias("id")))
    seen = met.filter((F.col("n_id") != F.col("id")) & before)
    return seen.select(F.col("n_id").alias("a"), F.col("id").alias("b"), F.col("n_kind").alias("ka"), F.col("kind").alias("kb"), F.col("n_created_s").alias("ca"), F.col("created_s").alias("cb")).distinct()


def links(novel: DataFrame, old: DataFrame, least: int = SHARED) -> DataFrame:
    """(a, b, ka, kb, ca, cb): each novel memory with those that were there before it, that it may read and that share least tags with it.

    novel: the records, and seq, their order; old: the records. a is the novel one; k and c are kinds and times.
    """
    return _links(*_sides(novel, old), least)


#: Stretches of seq in which novel memories are ordered together.
_STRETCHES = 1024


def link_totals(novel: DataFrame, old: DataFrame, least: int = SHARED) -> DataFrame:
    """(links, timed) in one row: how many rows links() has, and how many of them are between events.

    Memories of the same scope, tags and kind are a class; classes meet, not their members. Of what is novel in a class
    that another one may read, that before each member of the other counts, by running counts in stretches of seq. Ids
    that stand in rows that differ are no members; their links are made one by one.
    """
    new, there = _sides(novel, old)
    scope = F.struct("agent", "user", "session", F.array_sort(F.array_distinct("shared_with")).alias("shared_with"), F.array_sort(F.array_distinct("tags")).alias("tags"), F.col("kind").eqNullSafe("event").alias("event"))
    rows = kept(there.filter("id IS NOT NULL").dropDuplicates().withColumn("class", F.to_json(scope)))
    own = kept(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"))
    single = rows.join(own, "id", "left_anti")
    # a novel memory without seq is there from the start, to itself too
    sizes = single.groupBy("class").agg(*(F.first(c).alias(c) for c in ("agent", "user", "session", "shared_with", "tags")), F.first(F.col("kind").eqNullSafe("event")).alias("event"), F.count_if(F.col("seq").isNull()).alias("old"), F.count("seq").alias("new"))
    asking = new.filter("id IS NOT NULL").dropDuplicates().join(own, "id", "left_anti").withColumn("class", F.to_json(scope))
    early = asking.groupBy("class").agg(F.count("*").alias("asking"), F.count_if(F.col("seq").isNull()).alias("early"))
    sizes = kept(sizes.join(early, "class", "left").fillna(0, ["asking", "early"]))
    pairs = _readable(sizes.filter("asking > 0"), sizes, least)
    pairs = kept(pairs.select(F.col("n_class").alias("a"), F.col("class").alias("b"), (F.col("n_event") & F.col("event")).alias("timed"), F.col("n_asking").alias("asking"), F.col("n_early").alias("early"), "old", "new").distinct())
    count = F.col("asking") * F.col("old") - F.when(F.col("a") == F.col("b"), F.col("early")).otherwise(0)
    found = pairs.select("timed", count.alias("n"))
    ordered = single.filter("seq IS NOT NULL").select("class", "seq", "id")
    ends = ordered.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    ordered = kept(ordered.join(F.broadcast(ends), F.lit(True)).withColumn("part", F.floor((F.col("seq") - F.col("lo")) / ((F.col("hi") - F.col("lo") + 1) / F.lit(float(_STRETCHES))))).drop("lo", "hi"))
    # 0 for what is read, 1 for a reader, who comes after all before itself and not after itself
    late = pairs.filter("new > 0 AND asking > early")
    marks = ordered.join(late.select(F.col("b").alias("class")).distinct(), "class", "left_semi").select(F.col("class").alias("b"), "part", "seq", "id", F.lit(1).alias("mark"), F.lit(False).alias("timed"))
    marks = marks.unionByName(ordered.join(late.select(F.col("a").alias("class"), "b", "timed"), "class").select("b", "part", "seq", "id", F.lit(0).alias("mark"), "timed"))
    parts = marks.groupBy("b", "part").agg(F.sum("mark").alias("read"), F.count_if(F.col("mark") == 0).alias("readers"), F.count_if((F.col("mark") == 0) & F.col("timed")).alias("timed"))
    base = F.sum("read").over(Window.partitionBy("b").orderBy("part")) - F.col("read")
    parts = parts.select((base * F.col("readers")).alias("links"), (base * F.col("timed")).alias("timed"))
    upto = F.sum("mark").over(Window.partitionBy("b", "part").orderBy("seq", "id", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = marks.withColumn("upto", upto).filter("mark = 0").select(F.col("upto").alias("links"), F.when(F.col("timed"), F.col("upto")).otherwise(0).alias("timed"))
    odd = new.join(own, "id", "left_semi"), there.join(own, "id", "left_semi")
    rest = _links(odd[0], there, least).union(_links(new, odd[1], least)).distinct().select(F.lit(1).alias("links"), ((F.col("ka") == "event") & (F.col("kb") == "event")).alias("_timed")).select("links", F.when(F.col("_timed"), 1).otherwise(0).alias("timed"))
    every = found.select(F.col("n").alias("links"), F.when(F.col("timed"), F.col("n")).otherwise(0).alias("timed")).union(parts).union(within).union(rest)
    zero = F.lit(0).cast("bigint")
    return every.agg(F.coalesce(F.sum("links"), zero).alias("links"), F.coalesce(F.sum("timed"), zero).alias("timed"))


def edges_of(met: DataFrame) -> DataFrame:
    """What links() gives as edges (src, dst, kind): relates_to both ways, and before and after between events of different times."""
    related = met.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("relates_to").alias("kind")).union(met.select("b", "a", F.lit("relates_to")))
    timed = met.filter("ka = 'event' AND kb = 'event' AND ca <> cb")
    first, last = F.when(F.col("ca") < F.col("cb"), F.col("a")).otherwise(F.col("b")), F.when(F.col("ca") < F.col("cb"), F.col("b")).otherwise(F.col("a"))
    return related.union(timed.select(first, last, F.lit("before"))).union(timed.select(last, first, F.lit("after"))).distinct()


def reinforced(memories: DataFrame, passed: DataFrame, buffer: DataFrame, now: int) -> DataFrame:
    """memories after the verdicts: a neighbour of a redundant or reinforcing entry is accessed; a reinforced one also takes tags, importance and a version."""
    hits = passed.filter("verdict <> 'novel'").select("id", "neighbour", (F.col("verdict") == "reinforces").alias("strong"))
    entries = hits.join(buffer.select("id", "seq", "importance", "tags"), "id")
    strong = F.col("strong")
    sums = entries.groupBy("neighbour").agg(F.count("*").alias("_times"), F.count_if(strong).alias("_versions"), F.max(F.when(strong, F.col("importance"))).alias("_importance"))
    tags = entries.filter("strong").select("neighbour", "seq", "id", F.posexplode("tags").alias("at", "tag"))
    # each tag once, so that a list is as long as there are different tags
    tags = tags.groupBy("neighbour", "tag").agg(F.min(F.struct("seq", "id", "at")).alias("first"))
    tags = tags.groupBy("neighbour").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "tag"))), lambda x: x["tag"]).alias("_tags"))
    joined = memories.join(sums.withColumnRenamed("neighbour", "id"), "id", "left").join(tags.withColumnRenamed("neighbour", "id"), "id", "left")
    hit = F.col("_times").isNotNull()
    return joined.withColumns(
        {
            "access_count": F.col("access_count") + F.coalesce("_times", F.lit(0)),
            "accessed_s": F.when(hit, F.lit(now).cast("bigint")).otherwise(F.col("accessed_s")),
            "version": F.col("version") + F.coalesce("_versions", F.lit(0)),
            "importance": F.greatest("importance", "_importance"),
            "tags": F.when(F.col("_tags").isNull(), F.col("tags")).otherwise(text.append_tags(F.col("tags"), F.col("_tags"))),
        }
    ).select(memories.columns)


def report(passed: DataFrame, met: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """processed, promoted, reinforced, dropped, and edges_created: two for each link, and two for each between events.

    The links come as links() gives them, or their totals as link_totals() does.
    """
    count = lambda v, name: F.count_if(F.col("verdict") == v).alias(name)
    out = passed.agg(F.count("*").alias("processed"), count("novel", "promoted"), count("reinforces", "reinforced"), count("redundant", "dropped"))
    if met is not None:
        totals = met.agg(F.count("*").alias("links"), F.count_if((F.col("ka") == "event") & (F.col("kb") == "event")).alias("timed"))
    if totals is None:
        return out
    return out.withColumn("edges_created", totals.select((2 * F.col("links") + 2 * F.col("timed")).cast("bigint").alias("made")).scalar())
