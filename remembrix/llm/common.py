"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Bytes of text that Python code holds in unpacked form at a time; a longer text is handled alone.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; only a session in one process (tests) gets a local folder without one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "remembrix-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared checkpoint folder: its lineage ends there, so that a lost executor costs no recomputation.

    A table knows its size; after checkpoint() Spark goes on with the size that it guessed for the plan, and in loops of
    joins these guesses multiply until planning doesn't end.
    """
    ensure_checkpoint_dir(df.sparkSession)
    folder = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: The same, for tables of the size of the input.
stored = cut


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of about limit bytes, one row at least."""
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield texts.slice(at, to - at)
        at = to


def text_udf(returns: str, limit: int = CHUNK_BYTES) -> Callable[[Callable[[list[str | None]], pa.Array | list]], Callable[[Column], Column]]:
    """A decorator: a function from a list of texts to as many values becomes an Arrow function on a column."""

    def wrap(f: Callable[[list[str | None]], pa.Array | list]) -> Callable[[Column], Column]:
        def column_function(column: Column) -> Column:
            kind = to_arrow_type(DataType.fromDDL(returns))

            def over(texts: pa.Array) -> pa.Array:
                parts = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x in (f(part.to_pylist()) for part in chunks(texts, limit))]
                return pa.concat_arrays(parts) if parts else pa.array([], kind)

            over.__name__ = f.__name__
            over.__annotations__ = {"texts": pa.Array, "return": pa.Array}
            return F.arrow_udf(over, returnType=returns)(column)

        return column_function

    return wrap


class Memo(dict):
    """A cache of two generations of at most size entries: the older one goes when the newer one is full."""

    def __init__(self, size: int = 150_000) -> None:
        super().__init__()
        self.size, self.older = size, {}

    def room(self) -> None:
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()

    def missing(self, keys: set) -> list:
        """Those of keys that must be computed; what the older generation has is moved here."""
        out = []
        for key in keys - self.keys():
            if (value := self.older.get(key)) is None:
                out.append(key)
            else:
                self[key] = value
        return out
