"""State changes as functions from tables to tables: a new version of each row, never an update in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .ranking import keep_first


def latest(log: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last row of each key in an append-only log."""
    return keep_first(log, [key], [F.desc(order)])


def supersede(memories: DataFrame, pairs: DataFrame) -> DataFrame:
    """memories with superseded_by set from pairs (old, new); the last new one of an old id by its number wins."""
    last = pairs.groupBy("old").agg(F.max("new").alias("new"))
    joined = memories.join(last, memories["id"] == last["old"], "left")
    return joined.withColumn("superseded_by", F.coalesce("new", "superseded_by")).drop("old", "new")


def supersede_edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("new").alias("src"), F.col("old").alias("dst"), F.lit("supersedes").alias("kind"))


def forget(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Superseded by themselves."""
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    return memories.join(gone, "id", "left").withColumn("superseded_by", F.when(F.col("_gone"), F.col("id")).otherwise(F.col("superseded_by"))).drop("_gone")


def forget_hard(memories: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return memories.join(gone, "id", "left_anti"), left


def merge(memories: DataFrame, new: DataFrame, old_ids: DataFrame) -> DataFrame:
    """new (one row, whose id the driver reads) added, and each of old_ids superseded by it."""
    pairs = old_ids.select(F.col("id").alias("old")).withColumn("new", F.lit(new.select("id").first()[0]).cast("bigint"))
    return supersede(memories, pairs).unionByName(new)


def reconsolidate(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """memories with the absent ones of changes (id, new_tags) appended to their tags."""
    joined = memories.join(changes.select("id", "new_tags"), "id", "left")
    return joined.withColumn("tags", F.when(F.col("new_tags").isNull(), F.col("tags")).otherwise(text.append_tags(F.col("tags"), F.col("new_tags")))).drop("new_tags")


def touch(memories: DataFrame, hits: DataFrame, as_of: int) -> DataFrame:
    """memories with one access more for each row of hits (id)."""
    times = hits.groupBy("id").agg(F.count("*").alias("_times"))
    joined = memories.join(times, "id", "left")
    return joined.withColumn("access_count", F.col("access_count") + F.coalesce("_times", F.lit(0))).withColumn("accessed_s", F.when(F.col("_times") > 0, F.lit(as_of)).otherwise(F.col("accessed_s"))).drop("_times")


def last_write_wins(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Each id's row of the highest version, then the latest access; the local one on ties."""
    both = local.withColumn("_local", F.lit(1)).unionByName(remote.withColumn("_local", F.lit(0)))
    return keep_first(both, ["id"], [F.desc("version"), F.desc("accessed_s"), F.desc("_local")]).drop("_local")


def bounded_buffer(entries: DataFrame, capacity: int, scope: str = "agent", order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """The last capacity entries of each scope, and what they pushed out."""
    ranked = entries.withColumn("_rn", F.row_number().over(Window.partitionBy(scope).orderBy(F.desc(order), F.desc("id"))))
    return ranked.filter(F.col("_rn") <= capacity).drop("_rn"), ranked.filter(F.col("_rn") > capacity).drop("_rn")


def drain(entries: DataFrame, taken: Column) -> tuple[DataFrame, DataFrame]:
    """What a predicate takes out of a buffer, and what stays; what it can't decide stays."""
    hit = F.coalesce(taken, F.lit(False))
    return entries.filter(hit), entries.filter(~hit)


def update_vectors(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """memories with the vectors of (id, vector) instead of their own; unknown ids are ignored."""
    new = vectors.select("id", F.col("vector").alias("_vector"))
    return memories.join(new, "id", "left").withColumn("vector", F.coalesce("_vector", "vector")).drop("_vector")


def with_accesses(memories: DataFrame, accesses: DataFrame) -> DataFrame:
    """memories with what accesses (id, at) add to access_count and accessed_s."""
    seen = accesses.groupBy("id").agg(F.count("*").alias("_times"), F.max("at").alias("_at"))
    joined = memories.join(seen, "id", "left")
    return joined.withColumn("access_count", F.col("access_count") + F.coalesce("_times", F.lit(0))).withColumn("accessed_s", F.coalesce("_at", "accessed_s")).drop("_times", "_at")


def _counted(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table."""
    names = list(tables)
    rows = None
    for name, df in tables.items():
        one = df.agg(*(F.count("*").alias(n) if n == name else F.lit(0).cast("bigint").alias(n) for n in names))
        rows = one if rows is None else rows.union(one)
    return rows.agg(*(F.sum(n).alias(n) for n in names))


def _with_counts(memories: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    own = memories.agg(F.count("*").alias("total"), F.count_if(F.col("superseded_by").isNotNull()).alias("superseded"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"), *(F.lit(0).cast("bigint").alias(n) for n in tables))
    zero = F.lit(0).cast("bigint")
    rest = _counted(tables).select(zero.alias("total"), zero.alias("superseded"), zero.alias("tokens"), *tables)
    both = own.union(rest)
    return both.agg(*(F.sum(c).alias(c) for c in both.columns)).withColumn("active", F.greatest(F.col("total") - F.col("superseded"), F.lit(0)))


def store_stats(memories: DataFrame, edges: DataFrame) -> DataFrame:
    return _with_counts(memories, {"edges": edges})


def engine_stats(memories: DataFrame, edges: DataFrame, buffer: DataFrame, capacity: int) -> DataFrame:
    return _with_counts(memories, {"edges": edges, "buffer_size": buffer}).withColumn("buffer_capacity", F.lit(capacity).cast("bigint"))
