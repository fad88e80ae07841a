"""Streams into the bounded buffer: the latest entries of each scope, fading activation, and consolidation by batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import consolidation, graph

if TYPE_CHECKING:
    from ..engine import MemoryEngine

CAPACITY = 1024
COOLDOWN = "30 seconds"
#: Seconds in which activation halves, the least share that time leaves, what each recall leaves, and what is nothing.
HALF, LEAST, PULSE, NOTHING = 30.0, 0.05, 0.5, 1e-4


def evictions(stream: DataFrame, capacity: int = CAPACITY, scope: str = "user_id", key: str = "event_id") -> DataFrame:
    """(scope, evicted): what each arrival pushes out of its scope's buffer of that capacity, first in, first out."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        # the whole batch in order, however it is cut
        held += pd.concat([pdf[["ts", key]] for pdf in batches]).sort_values(["ts", key])[key].tolist()
        gone, held = held[: max(0, len(held) - capacity)], held[-capacity:]
        state.update((held,))
        yield pd.DataFrame({scope: [name[0]] * len(gone), "evicted": gone})

    return stream.groupBy(scope).applyInPandasWithState(step, f"{scope} bigint, evicted bigint", "held array<bigint>", "append", GroupStateTimeout.NoTimeout)


def activation(stream: DataFrame, node: str = "user_id", key: str = "event_id") -> DataFrame:
    """(node, key, value): a node's activation after each of its ranks. stream: node, key, ts and rank.

    What is there fades by PULSE and by time, which takes it down to LEAST at most; the rank is added, up to 1.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, at = state.get if state.exists else (0.0, None)
        rows = pd.concat([pdf[["ts", key, "rank"]] for pdf in batches]).sort_values(["ts", key])
        out = []
        for ts, i, rank in zip(rows["ts"], rows[key], rows["rank"], strict=True):
            now = ts.value // 1000  # microseconds
            if at is not None:
                seconds = (now - at) / 1e6
                value *= PULSE * max(LEAST, 1.0 if seconds <= 0 else 0.5 ** (seconds / HALF))
                value = value if value > NOTHING else 0.0
            value, at = min(1.0, value + rank), now
            out.append((name[0], i, value))
        state.update((value, at))
        yield pd.DataFrame(out, columns=[node, key, "value"])

    return stream.groupBy(node).applyInPandasWithState(step, f"{node} bigint, {key} bigint, value double", "value double, at bigint", "append", GroupStateTimeout.NoTimeout)


def consolidate_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Calls each(batch, number) for what came since the last time, every COOLDOWN."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=COOLDOWN)).start()


def into(engine: MemoryEngine, now: Callable[[], int]) -> Callable[[DataFrame, int], None]:
    """For consolidate_batches(): arrivals go into the engine's buffer, which consolidates it, links and orders them when its threshold and cooldown say so."""

    def each(batch: DataFrame, _: int) -> None:
        engine.ingest(graph.kept(batch), now())

    return each


def verdicts_into(known: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """For consolidate_batches(): the verdict of each arrival against a history that stays as it is, and those before it in its batch, as Parquet."""

    def each(batch: DataFrame, number: int) -> None:
        consolidation.consolidate(graph.kept(batch), known).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return each


def run_to_table(df: DataFrame) -> DataFrame:
    """All that a stream gives for what is there now, as Parquet in the shared checkpoint folder."""
    folder = f"{graph.shared_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")
