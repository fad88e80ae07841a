"""Memories and edges as Parquet tables: an append-only log, and its latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, lifecycle
from ..schema import EDGE, MEMORY


class ParquetStore:
    """Tables memories and edges below a folder; memories are partitioned by agent."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def append(self, memories: DataFrame, seq: int) -> None:
        memories.withColumn("seq", F.lit(seq).cast("bigint")).write.mode("append").partitionBy("agent").parquet(f"{self.path}/memories")

    def append_edges(self, edges: DataFrame) -> None:
        edges.write.mode("append").parquet(f"{self.path}/edges")

    def memories(self) -> DataFrame:
        log = self.spark.read.schema(f"{MEMORY}, seq bigint").parquet(f"{self.path}/memories")
        return lifecycle.latest(log).drop("seq")

    def edges(self) -> DataFrame:
        return graph.unique_edges(self.spark.read.schema(EDGE).parquet(f"{self.path}/edges"))

    def readable(self, scope) -> DataFrame:
        """What a scope may read. Rows of other agents that aren't shared go before the latest of each id is found: an id doesn't change its agent or sharing."""
        log = self.spark.read.schema(f"{MEMORY}, seq bigint").parquet(f"{self.path}/memories")
        return lifecycle.latest(log.filter(scope.can_read())).drop("seq")

    def hydrated(self) -> tuple[DataFrame, DataFrame]:
        """Active memories, and edges between them."""
        live = self.memories().filter("superseded_by IS NULL")
        return live, graph.hydrate(self.edges(), live)
