"""The retrieval pipeline for many queries at once: candidates, signals, fusion, selection, verdict."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hyper, scoring
from ..operators import graph, lexical, ranking
from ..operators.ranking import Knobs
from ..schema import AS_OF


#: Queries that go to each task at a time: about half a megabyte of vectors.
MOST_QUERIES = 2048


def similarities(queries: DataFrame, memories: DataFrame) -> DataFrame:
    """(query_id, id, fp): every query with every memory; queries (query_id, vector) are MOST_QUERIES at most, or a few more, and go to each task."""
    lanes = [F.col(f"v{k}") for k in range(hyper.LANES)]
    q = queries.select("query_id", *(F.get("vector", F.lit(k)).alias(f"q{k}") for k in range(hyper.LANES)))
    m = memories.select("id", *(F.get("vector", F.lit(k)).alias(f"v{k}") for k in range(hyper.LANES)))
    distance = F.lit(0)
    for k, lane in enumerate(lanes):
        distance = distance + F.bit_count(lane.bitwiseXOR(F.col(f"q{k}")))
    return m.join(F.broadcast(q), F.lit(True)).select("query_id", "id", (1 - 2 * distance / hyper.BITS).alias("fp"))


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    return ranking.first_k(pairs, k, [F.desc("fp"), F.col("id")])


def seeds(pool: DataFrame, knobs: Knobs) -> DataFrame:
    """Of the nearest (place from 1): those similar enough, at most knobs.seeds, or else the first one."""
    similar = F.col("fp") >= knobs.seed_similarity
    at = F.row_number().over(Window.partitionBy("query_id", similar).orderBy("place"))
    ranked = pool.withColumn("_similar", similar).withColumn("_at", at).withColumn("_any", F.max(similar).over(Window.partitionBy("query_id")))
    return ranked.filter((F.col("_similar") & (F.col("_at") <= knobs.seeds)) | (~F.col("_any") & (F.col("place") == 1))).select("query_id", "id")


def blended(pool: DataFrame, queries: DataFrame, memories: DataFrame, knobs: Knobs) -> DataFrame:
    """The pool with the first 2 * knobs.seeds of each query put in the order of 0.4 * fp / max(fp) + 0.6 * dense."""
    head = 2 * knobs.seeds
    found = pool.join(memories.select("id", F.col("dense").alias("_v")), "id").join(queries.select("query_id", F.col("dense").alias("_q")), "query_id")
    found = found.withColumn("_dense", F.coalesce(scoring.cosine(F.col("_v"), F.col("_q")), F.lit(0.0)))
    first = F.col("place") <= head
    top = F.greatest(F.max(F.when(first, F.col("fp"))).over(Window.partitionBy("query_id")), F.lit(0.01))
    found = found.withColumn("_blend", F.when(first & F.col("_q").isNotNull(), 0.4 * F.col("fp") / top + 0.6 * F.col("_dense")))
    order = Window.partitionBy("query_id").orderBy(F.when(first, 0).otherwise(1), F.desc_nulls_last("_blend"), F.col("place"))
    return found.withColumn("place", F.row_number().over(order)).select("query_id", "id", "fp", "place")


def _complete(memories: DataFrame) -> DataFrame:
    """memories with the columns that callers may leave out."""
    absent = {"supersedes": "bigint", "tag_sources": "array<string>", "dense": "array<float>"}
    return memories.withColumns({c: F.lit(None).cast(kind) for c, kind in absent.items() if c not in memories.columns})


def signals(queries: DataFrame, memories: DataFrame, edges: DataFrame, knobs: Knobs = Knobs(), as_of: int = AS_OF, readable: Column | None = None, wanted: Column | None = None, buffer: DataFrame | None = None, activation: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A row for each candidate of each query with fp, ppr, term, tag, decay, dense and boost; the ranks (query_id, id, ppr); and each query's intent.

    queries: query_id, text, vector, and dense if there are vectors of an embedding; a block of them. memories: the
    record and vector, all there are. readable: which of them the reader may see. wanted: which it wants; both speak of
    the columns of memories. buffer: memories that haven't been consolidated, searched besides and first in ties.
    """
    readable, wanted = (F.lit(True) if c is None else c for c in (readable, wanted))
    queries, memories = graph.kept(_with_dense(queries)), _complete(memories)
    active = memories.filter("superseded_by IS NULL")
    visible = active.filter(readable)
    pairs = similarities(queries, visible)
    pool = nearest(pairs, max(knobs.candidates, 4 * knobs.seeds))
    pool = graph.kept(pool.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fp"), "id"))))
    scanned = pool.filter((F.col("place") <= knobs.candidates) & (F.col("fp") >= 0)).select("query_id", "id")
    near = pool.filter(F.col("place") <= 4 * knobs.seeds)
    start = graph.kept(seeds(blended(near, queries, memories, knobs), knobs))
    salient = active.filter((F.col("salience") == "critical") | (F.col("kind") == "goal")).select("id")
    ppr = graph.kept(graph.personalized_pagerank(graph.hydrate(edges, memories), start, activation=activation, salient=salient))
    found = ppr.select("query_id", "id").union(start).union(scanned).distinct()
    rows = found.join(visible.filter(wanted), "id").withColumn("from_buffer", F.lit(False))
    if buffer is not None:
        buffer = _complete(buffer)
        held = nearest(similarities(queries, buffer), knobs.candidates // 2).select("query_id", "id")
        fresh = held.join(buffer.filter("superseded_by IS NULL").filter(readable).filter(wanted), "id").withColumn("from_buffer", F.lit(True))
        rows = rows.unionByName(fresh.select(rows.columns))
    considered = F.count("*").over(Window.partitionBy("query_id"))
    first = F.row_number().over(Window.partitionBy("query_id", "id").orderBy(F.desc("from_buffer")))
    rows = graph.kept(rows.withColumn("considered", considered).withColumn("_first", first).filter("_first = 1").drop("_first"))
    # words: document frequencies over all active memories, matches for the candidates
    terms = lexical.query_terms(queries)
    hits = graph.kept(lexical.term_hits(terms, lexical.postings(active)))
    weights = graph.kept(lexical.term_idf(terms, hits, active.agg(F.count("*")).scalar()))
    # a memory may stand in the graph and, with another text, in the buffer
    own = rows.select(F.struct("id", "from_buffer").alias("id"), "text", "tags", "tag_sources").dropDuplicates(["id"])
    split = lambda df, c: df.select("query_id", "id.id", "id.from_buffer", c)
    term = split(lexical.term_overlap(weights, lexical.term_hits(terms, lexical.postings(own))), "term")
    tag = split(lexical.tag_overlap(weights, lexical.tag_words(own, "tag_sources")), "tag")
    intents = weights.groupBy("query_id").agg(F.max("idf").alias("top"))
    asked = queries.join(intents, "query_id", "left").select("query_id", F.col("vector").alias("_vector"), F.col("dense").alias("_dense"), scoring.intent(F.col("text"), F.coalesce("top", F.lit(0.0))).alias("intent"))
    c = F.col
    out = rows.join(F.broadcast(asked), "query_id").join(ppr, ["query_id", "id"], "left").join(term, ["query_id", "id", "from_buffer"], "left").join(tag, ["query_id", "id", "from_buffer"], "left")
    zero = {s: F.coalesce(s, F.lit(0.0)) for s in ("ppr", "term", "tag")}
    replaced = F.when(c("supersedes").isNotNull(), 0.3).otherwise(0.0)
    event = F.when((c("kind") == "event") & (c("intent") != "factual"), scoring.recency_boost((as_of - c("created_s")) * 1000)).otherwise(0.0)
    out = out.withColumns({**zero, "fp": hyper.similarity(c("vector"), c("_vector")), "dense": F.coalesce(scoring.cosine(c("dense"), c("_dense")), F.lit(0.0)), "with_dense": c("_dense").isNotNull()})
    decay = scoring.effective_importance(c("kind"), c("salience"), c("importance"), c("created_s"), c("accessed_s"), c("access_count"), F.lit(as_of))
    out = out.withColumns({"ppr": F.when(c("from_buffer"), 0.0).otherwise(c("ppr")), "decay": decay, "boost": replaced + F.when(c("from_buffer"), knobs.buffer_boost).otherwise(event)})
    return out.drop("vector", "text", "_vector", "_dense"), ppr, asked.select("query_id", "intent")


def _with_dense(queries: DataFrame) -> DataFrame:
    return queries if "dense" in queries.columns else queries.withColumn("dense", F.lit(None).cast("array<float>"))


def in_blocks(queries: DataFrame, answer: Callable[[DataFrame], DataFrame], most: int = MOST_QUERIES) -> DataFrame:
    """answer(queries), for most or so at a time, as a block goes to each task. queries: query_id and more."""
    blocks = -(-queries.count() // most)
    if blocks <= 1:
        return answer(queries)
    parts = [answer(queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)) for k in range(blocks)]
    return functools.reduce(DataFrame.union, parts)


def recall(queries: DataFrame, memories: DataFrame, edges: DataFrame, knobs: Knobs = Knobs(), as_of: int = AS_OF, **how) -> DataFrame:
    """The picks of each query in order (query_id, pick, id, score, verdict, intent, from_buffer, considered); a query without any has one row, whose verdict is abstained.

    how: readable, wanted, buffer and activation, as signals() has them.
    """
    return in_blocks(queries, lambda part: recall_block(part, memories, edges, knobs, as_of, **how)[0])


def recall_block(queries: DataFrame, memories: DataFrame, edges: DataFrame, knobs: Knobs, as_of: int, **how) -> tuple[DataFrame, DataFrame]:
    """recall() of a block of queries, and the ranks of nodes (query_id, id, ppr)."""
    found, ppr, intents = signals(queries, memories, edges, knobs, as_of, **how)
    signalled = graph.kept(found)
    scored = ranking.fused(signalled, ("fp", "ppr", "term", "tag", "decay"))
    scored = scored.withColumn("score", F.col("score") + F.when(F.col("with_dense"), 0.15 * F.col("dense")).otherwise(0.0) + 0.05 * F.col("boost"))
    floored = ranking.floored(scored)
    halved = ranking.halved(floored.filter("with_dense")).unionByName(floored.filter("NOT with_dense"))
    best = ranking.first_k(halved, knobs.candidates, [F.desc("score"), F.desc("created_s"), F.col("id")])
    best = best.withColumn("recency", ranking.recency_rank("created_s")).withColumn("fresh", (F.col("kind") == "event") | F.col("supersedes").isNotNull())
    best = graph.kept(best)
    picks = graph.kept(ranking.pack(best, knobs))
    w = Window.partitionBy("query_id").orderBy("pick")
    led = picks.withColumn("second", F.lead("score").over(w)).filter("pick = 0").select("query_id", F.col("id"), F.col("score").alias("top"), (F.col("score") - F.coalesce("second", F.lit(0.0))).alias("margin"))
    count = picks.groupBy("query_id").agg(F.count("*").alias("hits"))
    judged = led.join(count, "query_id").join(best.select("query_id", "id", "term", "dense", "intent", "considered"), ["query_id", "id"])
    judged = judged.withColumn("verdict", ranking.verdict(F.col("hits"), F.col("top"), F.col("margin"), F.col("term"), F.col("dense"), F.col("intent"), knobs))
    judged = judged.withColumn("keep", ranking.keep_at_most(F.col("verdict"), F.col("top"), F.col("margin"), F.col("term"), knobs)).select("query_id", "verdict", "intent", "considered", "keep")
    sources = best.select("query_id", "id", "from_buffer")
    out = picks.join(judged, "query_id").filter((F.col("keep") == 0) | (F.col("pick") < F.col("keep"))).join(sources, ["query_id", "id"])
    out = out.select("query_id", "pick", "id", "score", "verdict", "intent", "from_buffer", "considered")
    empty = intents.join(picks.select("query_id").distinct(), "query_id", "left_anti")
    nothing = {"pick": "int", "id": "bigint", "score": "double"}
    return out.unionByName(empty.select("query_id", *(F.lit(None).cast(kind).alias(c) for c, kind in nothing.items()), F.lit("abstained").alias("verdict"), "intent", F.lit(None).cast("boolean").alias("from_buffer"), F.lit(0).cast("bigint").alias("considered"))), ppr
