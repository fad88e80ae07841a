"""Graph operators over edges (src, dst, kind, seq): neighbourhoods, walks, ranks, clusters and upkeep."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import EDGE_WEIGHT

DAMPING, ROUNDS, HOPS = 0.85, 20, 3
ONWARD, BACKWARD = ("caused_by", "before", "derived_from"), ("after",)
CLUSTERING = ("relates_to", "supports", "derived_from", "caused_by")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "remembrix-checkpoints"))  # one process: tests
    return sc._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared checkpoint folder, without its lineage.

    A table knows its size; after checkpoint() Spark goes on with the size that it guessed for the plan, and in loops of
    joins these guesses multiply until planning doesn't end.
    """
    table = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(table)
    return df.sparkSession.read.schema(df.schema).parquet(table)


def weight(kind: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, w in EDGE_WEIGHT.items():
        out = F.when(kind == name, w).otherwise(out)
    return out


def unique_edges(edges: DataFrame) -> DataFrame:
    """One of each (src, dst, kind), the first by seq; unknown kinds go."""
    return edges.filter(F.col("kind").isin(*EDGE_WEIGHT)).groupBy("src", "dst", "kind").agg(F.min("seq").alias("seq"))


def hydrate(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, w): each edge, and each backwards at half the weight."""
    w = weight(F.col("kind"))
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), w.alias("w")).union(edges.select("dst", "src", w * 0.5))


#: Arcs of a graph that goes to each task as a whole, and queries of a task. Larger graphs are walked by joins.
MOST_ARCS, QUERIES = 1 << 22, 64


class Packed:
    """A graph as arrays: of node i, whose id is ids[i], the arcs stand from starts[i] to starts[i + 1]. The last node, without arcs, stands for null."""

    def __init__(self, a: np.ndarray, b: np.ndarray, null: np.ndarray, w: np.ndarray):
        self.ids = np.unique(np.concatenate([a, b[~null]]))
        a = np.searchsorted(self.ids, a)
        b = np.where(null, len(self.ids), np.searchsorted(self.ids, b))
        order = np.lexsort((b, a))
        self.ends, self.w = b[order].astype(np.int32), w[order]
        self.starts = np.searchsorted(a[order], np.arange(len(self.ids) + 2))
        self.null = len(self.ids)

    def arcs(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all arcs of nodes, and how many each has."""
        first, count = self.starts[nodes], self.starts[nodes + 1] - self.starts[nodes]
        upto = np.cumsum(count)
        return np.arange(upto[-1] if len(upto) else 0) + np.repeat(first - (upto - count), count), count

    def depths(self, seeds: np.ndarray, hops: int, depth: np.ndarray) -> np.ndarray:
        """The nodes within hops of seeds, in their order. depth: -1 for each node, which is filled in for these."""
        depth[seeds] = 0
        front, seen = seeds, [seeds]
        for hop in range(1, hops + 1):
            ends = self.ends[self.arcs(front)[0]]
            ends = ends[depth[ends] < 0]
            depth[ends] = hop
            front = np.nonzero(depth == hop)[0] if len(ends) * 16 > len(depth) else np.unique(ends)
            seen.append(front)
        return np.sort(np.concatenate(seen))

    def ranks(self, nodes: np.ndarray, seeds: np.ndarray, lost: int, place: np.ndarray, rounds: int, damping: float) -> np.ndarray:
        """The rank of each of nodes, which are sorted, and of lost seeds without edges; place: -1 for each node of the graph, as after the call."""
        place[nodes] = np.arange(len(nodes))
        at, count = self.arcs(nodes)
        ends = place[self.ends[at]]
        inside = (ends >= 0) & (self.w[at] > 0)
        row = np.repeat(np.arange(len(nodes)), count)[inside]
        ends, w = ends[inside], self.w[at][inside]
        size = len(nodes) + lost
        total = np.bincount(row, w, size)
        own = np.concatenate([place[seeds], np.arange(len(nodes), size)])
        place[nodes] = -1
        start = np.zeros(size)
        start[own] = 1.0 / len(own)
        w = w / total[row]
        # arcs sorted by where they go, so that each round adds up stretches
        order = np.argsort(ends, kind="stable")
        row, w, ends = row[order], w[order], ends[order]
        first = np.nonzero(np.diff(ends, prepend=-1))[0]
        reached = ends[first]
        loose = total == 0
        rank = start
        for _ in range(rounds):
            moved = np.zeros(size)
            if len(first):
                moved[reached] = np.add.reduceat(rank[row] * w, first)
            if loose.any():
                moved[own] += rank[loose].sum() / size
            rank = (1 - damping) * start + damping * moved
        return rank


def packed(edges: DataFrame) -> Packed | None:
    """Both ways of the edges, or nothing if they are too many to go to each task. Edges count once for each kind; those of unknown kinds are walked, but have no weight."""
    arcs = both_ways(edges.select("src", "dst", "kind").distinct()).filter("a IS NOT NULL").groupBy("a", "b").agg(F.sum("w").alias("w"))
    arcs = kept(arcs)
    if arcs.count() > MOST_ARCS:
        return None
    got = arcs.select("a", F.coalesce("b", F.lit(0)).alias("b"), F.col("b").isNull().alias("null"), F.coalesce("w", F.lit(0.0)).alias("w")).toArrow()
    return Packed(*(got[c].to_numpy() for c in ("a", "b", "null", "w")))


def _searched(graph: Packed, seeds: DataFrame, hops: int, answer: Callable[..., dict[str, np.ndarray]], schema: str) -> DataFrame:
    """(query_id, id, ...): for each query of seeds what answer(graph, nodes, own seeds, seeds without edges, depths, scratch) gives for its neighbourhood, without arcs or nodes between tasks."""
    grouped = seeds.select("query_id", "id").filter("query_id IS NOT NULL AND id IS NOT NULL").groupBy("query_id").agg(F.collect_set("id").alias("own"))
    grouped = kept(grouped)
    tasks = max(1, -(-grouped.count() // QUERIES))
    sent = seeds.sparkSession.sparkContext.broadcast(graph)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        depth, scratch = np.full(g.null + 1, -1, np.int8), np.full(g.null + 1, -1, np.int32)
        for batch in batches:
            for query, own in zip(batch.column("query_id").to_pylist(), batch.column("own").to_pylist(), strict=True):
                own = np.sort(np.array(own, np.int64))
                at = np.searchsorted(g.ids, own)
                known = at < len(g.ids)
                known[known] = g.ids[at[known]] == own[known]
                lost = own[~known]  # seeds without edges
                nodes = g.depths(at[known], hops, depth)
                found = answer(g, nodes, at[known], lost, depth, scratch)
                depth[nodes] = -1
                for lo in range(0, len(found["id"]), 1 << 18):
                    part = {c: v[lo : lo + (1 << 18)] for c, v in found.items()}
                    columns = {"query_id": pa.array(np.full(len(part["id"]), query, np.int64)), "id": pa.array(part["id"], mask=part.pop("null", None))} | {c: pa.array(v) for c, v in part.items() if c != "id"}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return grouped.repartition(tasks, "query_id").mapInArrow(search, schema)


def _named(g: Packed, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids of nodes, and which of them stand for null."""
    null = nodes == g.null
    return (g.ids[np.where(null, 0, nodes)] if len(g.ids) else nodes), null


def packed_neighbourhood(graph: Packed, seeds: DataFrame, hops: int = HOPS) -> DataFrame:
    """neighbourhood() over a packed graph; a null end of an edge is a node from which nothing goes on."""

    def answer(g, nodes, own, lost, depth, scratch):
        ids, null = _named(g, nodes)
        return {"id": np.concatenate([ids, lost]), "null": np.concatenate([null, np.zeros(len(lost), bool)]), "depth": np.concatenate([depth[nodes], np.zeros(len(lost), np.int8)]).astype(np.int32)}

    return _searched(graph, seeds, hops, answer, "query_id bigint, id bigint, depth int")


def packed_pagerank(graph: Packed, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, hops: int = HOPS, least: float = 1e-6) -> DataFrame:
    """personalized_pagerank() over a packed graph, of seeds alone."""

    def answer(g, nodes, own, lost, depth, scratch):
        nodes = nodes[nodes != g.null]
        ranks, ids = g.ranks(nodes, own, len(lost), scratch, rounds, damping), np.concatenate([g.ids[nodes], lost])
        high = ranks > least
        return {"id": ids[high], "ppr": ranks[high]}

    return _searched(graph, seeds, hops, answer, "query_id bigint, id bigint, ppr double")


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = HOPS) -> DataFrame:
    """(query_id, id, depth): what is within hops steps of the seeds (query_id, id) in any direction."""
    steps = both_ways(edges).select("a", "b").distinct()
    seen = seeds.select("query_id", "id").distinct().withColumn("depth", F.lit(0))
    front = seen
    for depth in range(1, hops + 1):
        new = front.select("query_id", F.col("id").alias("a")).join(steps, "a").select("query_id", F.col("b").alias("id")).distinct()
        front = kept(new.join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.union(front)
    return kept(seen)


def personalized_pagerank(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, hops: int | None = HOPS, activation: DataFrame | None = None, least: float = 1e-6, salient: DataFrame | None = None) -> DataFrame:
    """(query_id, id, ppr) over each query's neighbourhood.

    A node without edges inside hands its rank to the explicit seeds, 1/K to each of them for K nodes.
    seeds: query_id, id. salient: id, of nodes that are seeds of every query too, but get no such rank. activation: id,
    value, of which 0.15 goes into the seeds' distribution.
    """
    own = seeds.select("query_id", "id").distinct()
    every = own
    if salient is not None:
        # the queries of a block are few; they go to the salient nodes
        every = own.union(salient.select("id").join(F.broadcast(own.select("query_id").distinct()), F.lit(True)).select("query_id", "id")).distinct()
        every = kept(every)
    local = neighbourhood(edges, every, hops if hops is not None else HOPS).select("query_id", "id")
    counted = local.withColumn("k", F.count("*").over(Window.partitionBy("query_id")))
    marked = counted.join(own.withColumn("seed", F.lit(1)), ["query_id", "id"], "left")
    marked = marked.join(every.withColumn("mark", F.lit(1)), ["query_id", "id"], "left")
    start = F.when(F.col("mark").isNotNull(), 1.0 / F.col("k")).otherwise(0.0)
    if activation is not None:
        marked = marked.join(activation.select("id", "value"), "id", "left")
        start = start + 0.15 * F.coalesce("value", F.lit(0.0))
    marked = marked.withColumn("start", start)
    total = F.sum("start").over(Window.partitionBy("query_id"))
    nodes = kept(marked.select("query_id", "id", "k", F.coalesce("seed", F.lit(0)).alias("seed"), F.when(total > 0, F.col("start") / total).otherwise(0.0).alias("start")))
    arcs = local.withColumnRenamed("id", "a").join(both_ways(unique_edges(edges)), "a").join(local.withColumnRenamed("id", "b"), ["query_id", "b"])
    arcs = arcs.groupBy("query_id", "a", "b").agg(F.sum("w").alias("w"))
    arcs = arcs.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("query_id", "a")))
    # what a node without edges hands over is an arc to each explicit seed, of which a query has a few
    loose = nodes.join(arcs.select("query_id", F.col("a").alias("id")).distinct(), ["query_id", "id"], "left_anti").select("query_id", F.col("id").alias("a"), "k")
    hand = loose.join(nodes.filter("seed = 1").select("query_id", F.col("id").alias("b")), "query_id").select("query_id", "a", "b", (1.0 / F.col("k")).alias("w"))
    arcs = kept(arcs.select("query_id", "a", "b", "w").union(hand))
    rank = nodes.withColumn("r", F.col("start"))
    for turn in range(rounds):
        moved = rank.select("query_id", F.col("id").alias("a"), "r").join(arcs, ["query_id", "a"]).groupBy("query_id", F.col("b").alias("id")).agg(F.sum(F.col("r") * F.col("w")).alias("m"))
        rank = nodes.select("query_id", "id", "start").join(moved, ["query_id", "id"], "left").select("query_id", "id", ((1 - damping) * F.col("start") + damping * F.coalesce("m", F.lit(0.0))).alias("r"))
        if turn % 5 == 4:
            rank = kept(rank)
    return rank.filter(F.col("r") > least).select("query_id", "id", F.col("r").alias("ppr"))


def global_pagerank(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(id, ppr) over all nodes: edges count 1 onwards and 0.5 backwards, nodes without any hand their rank to the seeds evenly."""
    ends = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1.0).alias("w")).union(edges.select("dst", "src", F.lit(0.5)))
    arcs = ends.groupBy("a", "b").agg(F.sum("w").alias("w"))
    arcs = kept(arcs.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("a"))))
    n = max(1, seeds.select("id").distinct().count())
    base = kept(nodes.select("id").distinct().join(seeds.select("id").distinct().withColumn("s", F.lit(1.0 / n)), "id", "left").withColumn("s", F.coalesce("s", F.lit(0.0))))
    loose = kept(base.select("id").join(arcs.select(F.col("a").alias("id")).distinct(), "id", "left_anti"))
    rank = base.withColumn("r", F.col("s"))
    for turn in range(rounds):
        moved = rank.select(F.col("id").alias("a"), "r").join(arcs, "a").groupBy(F.col("b").alias("id")).agg(F.sum(F.col("r") * F.col("w")).alias("m"))
        lost = F.coalesce(rank.join(loose, "id").agg(F.sum("r")).scalar(), F.lit(0.0))
        rank = base.join(moved, "id", "left").select("id", "s", ((1 - damping) * F.col("s") + damping * (F.coalesce("m", F.lit(0.0)) + lost * F.col("s"))).alias("r"))
        if turn % 4 == 3:
            rank = kept(rank)
    return rank.select("id", F.col("r").alias("ppr"))


def trajectory(edges: DataFrame, nodes: DataFrame, starts: DataFrame, limit: int, active: str = "active") -> DataFrame:
    """(start, id, depth, position): a breadth-first walk along causes and befores, and afters backwards.

    Siblings follow their parents' order, then falling seq. nodes (id, active): inactive ones are walked but not
    given. The walk of a start stops at limit given nodes (one at least); unknown starts give none.
    """
    forward = edges.filter(F.col("kind").isin(*ONWARD)).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("seq"))
    backward = edges.filter(F.col("kind").isin(*BACKWARD)).select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("seq"))
    known = nodes.select("id", F.col(active).alias("active"))
    steps = kept(forward.union(backward).join(known.select(F.col("id").alias("b")), "b", "left_semi"))
    front = kept(starts.select(F.col("id").alias("start"), "id").distinct().join(known, "id").select("start", "id", F.lit(0).alias("depth"), F.lit(1).cast("bigint").alias("place"), "active"))
    seen = front
    while not front.isEmpty():
        new = front.select("start", F.col("id").alias("a"), "depth", F.col("place").alias("parent")).join(steps, "a")
        new = new.groupBy("start", F.col("b").alias("id")).agg(F.min(F.struct("parent", (-F.col("seq")).alias("late"))).alias("by"), (F.first("depth") + 1).alias("depth"))
        new = new.join(seen.select("start", "id"), ["start", "id"], "left_anti").join(known, "id")
        new = new.withColumn("place", F.row_number().over(Window.partitionBy("start").orderBy("by", "id")).cast("bigint"))
        found = seen.filter("active").groupBy("start").agg(F.count("*").alias("n"))
        new = new.join(found, "start", "left").filter(F.coalesce("n", F.lit(0)) < max(limit, 1)).select("start", "id", "depth", "place", "active")
        front = kept(new)
        seen = seen.union(front)
    given = seen.filter("active").withColumn("position", F.row_number().over(Window.partitionBy("start").orderBy("depth", "place")))
    return given.filter(F.col("position") <= max(limit, 1)).select("start", "id", "depth", "position")


def components(pairs: DataFrame) -> DataFrame:
    """(name, least) for every name in pairs (a, b): the least name of its component, by the least label around and that label's own label."""
    both = kept(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    labels = kept(both.select(F.col("a").alias("name")).distinct().withColumn("least", F.col("name")))
    while True:
        around = both.join(labels.select(F.col("name").alias("b"), "least"), "b").groupBy(F.col("a").alias("name")).agg(F.min("least").alias("near"))
        lower = labels.join(around, "name").select("name", F.least("least", "near").alias("least"), F.col("least").alias("was"))
        jump = lower.select(F.col("name").alias("least"), F.col("least").alias("next"))
        new = kept(lower.join(jump, "least").select("name", F.least("least", "next").alias("least"), "was"))
        labels = new.select("name", "least")
        if new.filter("least <> was").isEmpty():
            return labels


def degree(edges: DataFrame, kinds: tuple[str, ...] = CLUSTERING) -> DataFrame:
    return edges.filter(F.col("kind").isin(*kinds)).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def clusters(edges: DataFrame, nodes: DataFrame, limit: int) -> DataFrame:
    """(seed, members, score): each node of degree 2 or more, by falling degree, claims its unclaimed active neighbours.

    A claim holds even if the cluster is then too small to be given. Claims depend on all before them, so that they are settled in
    rounds: in each, the nodes that come before all unsettled ones they share a node with claim at the same time.
    """
    active = nodes.filter("active").select("id")
    out = edges.filter(F.col("kind").isin(*CLUSTERING))
    ranked = degree(edges).join(active, "id", "left_semi").filter("degree >= 2")
    arcs = out.select(F.col("src").alias("seed"), F.col("dst").alias("id"), "seq").join(active, "id", "left_semi")
    claims = arcs.groupBy("seed", "id").agg(F.max("seq").alias("seq")).join(ranked.select(F.col("id").alias("seed"), "degree"), "seed")
    claims = claims.select("seed", "id", "degree").union(ranked.select(F.col("id").alias("seed"), "id", "degree")).distinct()
    claims, done = kept(claims), None
    while not claims.isEmpty():
        order = F.struct((-F.col("degree")).alias("d"), F.col("seed"))
        first = claims.groupBy("id").agg(F.min(order).alias("first"))
        judged = claims.join(first, "id").withColumn("wins", F.col("first") == order)
        ready = judged.groupBy("seed").agg(F.min("wins").alias("all")).filter("all").select("seed")
        taken = kept(claims.join(ready, "seed", "left_semi"))
        done = taken if done is None else done.union(taken)
        gone = taken.select("id").distinct()
        # a claimed node is no seed any more, and nobody else's member
        claims = kept(claims.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "seed"), "seed", "left_anti"))
    if done is None:
        return edges.sparkSession.createDataFrame([], "seed bigint, members array<bigint>, score bigint")
    found = done.groupBy("seed").agg(F.sort_array(F.collect_list("id")).alias("members"), F.max("degree").alias("degree")).filter(F.size("members") >= 3)
    top = found.orderBy(F.desc("degree"), "seed").limit(limit)
    return top.select("seed", "members", (F.size("members") * F.col("degree")).cast("bigint").alias("score")).orderBy(F.desc("score"), "seed")


def vacuum(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active nodes, and edges between them."""
    live = nodes.filter("active")
    return live, hydrate(edges, live)


def decay_activation(activation: DataFrame, seconds: Column, nodes: DataFrame) -> DataFrame:
    """(id, value) after a while: halved, and halved again every 30 seconds down to a twentieth; goals stay at 1."""
    wall = F.when(seconds <= 0, 1.0).otherwise(F.pow(F.lit(0.5), seconds / 30.0))
    joined = activation.join(nodes.filter("active").select("id", "kind"), "id")
    value = F.when(F.col("kind") == "goal", 1.0).otherwise(F.col("value") * 0.5 * F.greatest(F.lit(0.05), wall))
    goals = nodes.filter("active AND kind = 'goal'").select("id", F.lit(1.0).alias("value"))
    faded = joined.filter("kind <> 'goal'").select("id", value.alias("value")).filter("value > 1e-4")
    return faded.union(goals)


def spread_activation(activation: DataFrame, ranks: DataFrame) -> DataFrame:
    """Activation after a recall: each rank above 1e-6 adds to it, up to 1."""
    added = ranks.filter("ppr > 1e-6").select("id", F.col("ppr").alias("value"))
    return activation.select("id", "value").union(added).groupBy("id").agg(F.least(F.sum("value"), F.lit(1.0)).alias("value"))


def contradictions(edges: DataFrame, hits: DataFrame) -> DataFrame:
    """Contradicting pairs with either end among hits (id)."""
    odd = edges.filter("kind = 'contradicts'").select("src", "dst")
    a = odd.join(hits.select(F.col("id").alias("src")), "src", "left_semi")
    b = odd.join(hits.select(F.col("id").alias("dst")), "dst", "left_semi")
    return a.unionByName(b).distinct()
