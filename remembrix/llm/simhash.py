"""Near-duplicates by SimHash: fingerprints, pigeonhole blocks, verified links, components.

A 64-bit fingerprint is cut into four blocks of 16 bits. Two fingerprints at BITS = 2 or fewer differing bits
agree on two blocks at least, so each of the six pairs of blocks is a 32-bit key, and close ones share a key.
Distinct fingerprints (copies collapse first) are joined on keys and their Hamming distance is verified. A key
with more than CROWD fingerprints would give too many pairs: there each fingerprint is listed under itself and
under the 32 fingerprints that differ in one of the free bits. Two of them meet in such a list just if they are
at two bits or fewer, and each is linked to the least of the list only: as many links as rows, the same
components.

Defined cases: null and empty texts have fingerprint zero and link to each other; fewer than three words make
one shingle; equal rows stay as many rows; a component's id is the least doc_id that is not null in it, else
null; only the id and text columns are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, text_udf

BITS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints of a key up to which its pairs are compared one by one.
CROWD = 24
_BLOCKS, _WIDTH = 4, 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _simhash(text: str | None, size: int = SHINGLE) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    hashed = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in shingles), np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashed), 1 << 15):
        total += np.unpackbits(hashed[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashed), bitorder="little").view("<u8")[0])


@text_udf("bigint")
def fingerprint(texts: list[str | None]) -> pa.Array:
    return pa.array([_signed(_simhash(t)) for t in texts], pa.int64())


def hexadecimal(column: Column) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def _masks() -> list[int]:
    block = (1 << _WIDTH) - 1
    return [sum(block << (_WIDTH * b) for b in pair) for pair in combinations(range(_BLOCKS), _BLOCKS - BITS)]


def links(nodes: DataFrame) -> DataFrame:
    """Verified links (a, b) that connect just what pairs at BITS or fewer bits connect. nodes: distinct fingerprints in fp."""
    masks = _masks()
    keyed = nodes.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("block", "key"))
    sizes = cut(keyed.groupBy("block", "key").count().filter("count > 1"))
    shared = cut(keyed.join(sizes, ["block", "key"]))
    few, crowd = shared.filter(F.col("count") <= CROWD), shared.filter(F.col("count") > CROWD)
    pairs = few.select("block", "key", F.col("fp").alias("a")).join(few.select("block", "key", F.col("fp").alias("b")), ["block", "key"])
    pairs = pairs.filter("a < b").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).select("a", "b")
    free = [[_signed(1 << bit) for bit in range(64) if not m >> bit & 1] for m in masks]
    flips = F.array(*(F.array(F.lit(0).cast("bigint"), *map(F.lit, f)) for f in free))
    near = crowd.select("fp", F.explode(F.transform(F.element_at(flips, F.col("block") + 1), lambda bit: F.col("fp").bitwiseXOR(bit))).alias("near")).distinct()
    least = near.groupBy("near").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("near", "a")
    stars = near.join(least, "near").filter("a < fp").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= BITS).select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b): the same root, one of its nodes, all over a component.

    In each round a vertex goes to the neighbour that comes first in an order that a hash deals anew, or stays if it comes
    first itself, and then to where that one goes; the edges between what is left are kept. A new order each time, as
    along a path that a fixed one sorts only its end would move: like this a constant part of the vertices goes in a
    round, so that rounds grow as the logarithm of a component's size.
    """
    edges = cut(edges)
    roots = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node"))
    turn = 0
    while not edges.isEmpty():
        turn += 1
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        first = both.groupBy("a").agg(F.min(order("b")).alias("near"))
        parent = cut(first.select(F.col("a").alias("v"), F.least(order("a"), F.col("near"))["v"].alias("p")))
        jump = cut(parent.join(parent.select(F.col("v").alias("p"), F.col("p").alias("pp")), "p").select("v", F.col("pp").alias("p")))
        roots = cut(roots.join(jump, roots["root"] == jump["v"], "left").select("node", F.coalesce("p", "root").alias("root")))
        a, b = jump.select(F.col("v").alias("a"), F.col("p").alias("pa")), jump.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = edges.join(a, "a").join(b, "b").filter("pa <> pb")
        edges = cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    return roots


def classes(rows: DataFrame) -> DataFrame:
    """fp, root (the component's name) and component_id of each fingerprint in rows (doc_id, fp)."""
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp")))
    named = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = cut(named)
    # written out before the join, so that Spark can split the rows of a component that holds much of the table
    least = cut(named.groupBy("root").agg(F.min("least").alias("component_id")))
    return named.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (fingerprint as a signed long) and component_id of each row."""
    rows = cut(df.select(F.col(id_column).alias("doc_id"), fingerprint(F.col(text)).alias("fp")))
    return rows.join(classes(rows).select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
