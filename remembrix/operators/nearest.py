"""Each query's nearest rows over all rows, by blocks of matrix products; pairs are never rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hyper import BITS

#: Queries that go to each task at a time: 8 MB of packed hypervectors, 134 MB unpacked.
MOST_QUERIES = 32768
#: Rows and queries of a block.
ROWS, COLUMNS = 1024, 2048
#: Two products in one: sums of 2048 signs times 1 + _SCALE are whole numbers below 2 ** 24, which float32 holds exactly.
_SCALE = 8000.0


class Best:
    """The k least (value, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.value, self.id = k, np.full((queries, k), np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def bound(self, lo: int, hi: int) -> np.ndarray:
        """What a value must not exceed to be taken."""
        return self.value[lo:hi, -1]

    def add(self, lo: int, values: np.ndarray, ids: np.ndarray, slack: float = 0.0, exact: Callable[[np.ndarray], np.ndarray] | None = None) -> None:
        """values: a row for each of ids, a column for each query from lo on. exact, which moves values by slack at most, is applied to those that may be taken."""
        bound = self.bound(lo, lo + values.shape[1])
        if np.isinf(bound).any() and len(ids) >= self.k:
            bound = np.minimum(bound, np.partition(values, self.k - 1, axis=0)[self.k - 1] + 2 * slack)
        row, column = np.nonzero(values <= (bound + slack).astype(values.dtype))
        self.take(column + lo, exact(values[row, column]) if exact else values[row, column], ids[row])

    def take(self, query: np.ndarray, value: np.ndarray, ids: np.ndarray) -> None:
        last = self.value[query, -1]
        fits = (value < last) | ((value == last) & (ids < self.id[query, -1]))
        query, value, ids = query[fits], value[fits], ids[fits]
        if not len(query):
            return
        met = np.unique(query)
        query = np.concatenate([query, np.repeat(met, self.k)])
        value, ids = np.concatenate([value, self.value[met].ravel()]), np.concatenate([ids, self.id[met].ravel()])
        order = np.lexsort((ids, value, query))
        query, value, ids = query[order], value[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.value[query[kept], place[kept]] = value[kept]
        self.id[query[kept], place[kept]] = ids[kept]

    def rows(self, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        query, place = np.nonzero(self.id < np.iinfo(np.int64).max)
        if len(query):
            yield pa.RecordBatch.from_arrays([pa.array(names[query]), pa.array(self.id[query, place]), pa.array(self.value[query, place])], ["query_id", "id", "value"])


def _signs(packed: np.ndarray) -> np.ndarray:
    """A row of -1 and 1 for each row of packed bits."""
    out = np.unpackbits(packed.reshape(len(packed), -1).view(np.uint8), axis=1).astype(np.float32)
    out *= 2
    out -= 1
    return out


def _dense(vectors: pa.Array, width: int, dtype: str) -> np.ndarray:
    """Lists of one width as a matrix."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, dtype).reshape(len(vectors), width)


def _collected(queries: DataFrame) -> tuple[np.ndarray, pa.Array]:
    got = queries.select("query_id", "vector").toArrow().combine_chunks()
    column = lambda c: got[c].combine_chunks() if len(got) else got[c].cast(got[c].type).combine_chunks()
    return column("query_id").to_numpy(zero_copy_only=False).astype(np.int64), column("vector")


def _each(rows: DataFrame, search: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], k: int) -> DataFrame:
    """What the tasks found: k rows of each query and task at most."""
    return rows.select("id", "vector").mapInArrow(search, "query_id bigint, id bigint, value double")


def by_hamming(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, id, value): among others each query's k rows of least distance, the least ids first. Both have hypervectors; ids are not null."""
    names, vectors = _collected(queries.filter("vector IS NOT NULL"))
    lanes = BITS // 64
    packed = _dense(vectors, lanes, "int64") if len(names) else np.zeros((0, lanes), np.int64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, blocks = Best(len(names), k), []
        for batch in batches:
            batch = batch.filter(batch.column("vector").is_valid())
            ids, bits = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64), _dense(batch.column("vector"), lanes, "int64")
            if len(ids) and not blocks:
                for lo in range(0, len(names), COLUMNS):
                    part = _signs(packed[lo : lo + COLUMNS])
                    half = (len(part) + 1) // 2
                    both = part[:half].copy()
                    both[: len(part) - half] += _SCALE * part[half:]
                    blocks.append((lo, half, len(part), np.ascontiguousarray(both.T)))
            for at in range(0, len(ids), ROWS):
                signs, part_ids = _signs(bits[at : at + ROWS]), ids[at : at + ROWS]
                for lo, half, count, both in blocks:
                    product = signs @ both
                    second = np.rint(product / np.float32(_SCALE))
                    product -= second * np.float32(_SCALE)
                    best.add(lo, (BITS - product) * np.float32(0.5), part_ids)
                    if count > half:
                        best.add(lo + half, (BITS - second[:, : count - half]) * np.float32(0.5), part_ids)
        yield from best.rows(names)

    return _each(rows, search, k)


def by_cosine(queries: DataFrame, rows: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """(query_id, id, value): among others each query's k rows of highest cosine, rounded to digits, the least ids first; value is minus the cosine.

    Zero for vectors of other lengths, without a norm, or with a null, as scoring.cosine() has it; not-a-number comes first.
    """
    names, vectors = _collected(queries)

    def matrices(v: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Width, places, vectors and norms of the vectors of each width."""
        lengths = np.array([-1 if x is None else x for x in v.value_lengths().to_pylist()], np.int64)
        if v.flatten().null_count:
            lengths[[i for i, x in enumerate(v.to_pylist()) if x is not None and None in x]] = -1
        out = []
        for width in np.unique(lengths[lengths > 0]).tolist():
            places = np.nonzero(lengths == width)[0]
            dense = _dense(v.take(pa.array(places)), width, "float64")
            out.append((width, places, dense, np.sqrt(np.einsum("ij,ij->i", dense, dense))))
        return out

    asked = matrices(vectors)

    def values(lo: int, hi: int, found: list, count: int) -> np.ndarray:
        out = np.zeros((count, hi - lo))
        for width, places, dense, norms in found:
            for other, columns, q, q_norms in asked:
                if other == width:
                    first, last = np.searchsorted(columns, (lo, hi))
                    with np.errstate(all="ignore"):
                        norm = norms[:, None] * q_norms[None, first:last]
                        cosine = (dense @ q[first:last].T) / norm
                        # not-a-number is above all, as a norm too
                        cosine = np.where(norm < 1e-9, 0.0, np.where(np.isnan(cosine), np.inf, cosine))
                    out[np.ix_(places, columns[first:last] - lo)] = -cosine
        return out

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(names), k)
        for batch in batches:
            ids, v = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("vector")
            for at in range(0, len(ids), ROWS):
                found, part = matrices(v.slice(at, ROWS)), ids[at : at + ROWS]
                for lo in range(0, len(names), COLUMNS):
                    hi = min(lo + COLUMNS, len(names))
                    best.add(lo, values(lo, hi, found, len(part)), part, 10.0**-digits, lambda x: np.round(x, digits))
        yield from best.rows(names)

    return _each(rows, search, k)
