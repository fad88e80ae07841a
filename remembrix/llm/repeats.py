"""Removal of long verbatim repeats with run-length indexes.

Any LENGTH = 200 bytes hold a least ANCHOR-byte gram by hash (the last one on ties), whichever text they lie in.
Each text is cut by it: the windows (starts of LENGTH bytes) that share an anchor form its context, the bytes
from the first window's start to the last one's end. Two equal windows have equal anchors, so that only contexts
of one anchor can share a window:

1. equal contexts collapse to one with a count; windows of a context that occurs twice are repeats;
2. contexts that occur once, and whose anchor no other context has, are done;
3. the others are gathered with all contexts of their anchors in shards of about SHARD_BYTES, each a run-length index
   whose matching statistics are streamed: a window whose longest match is LENGTH bytes or more is a repeat. Anchors
   with more than CROWD distinct contexts would not fit a shard; their windows are counted by a 128-bit hash;
4. windows become spans of their texts, and what they cover is cut out.

A passage that a third of all texts hold has one anchor with as many contexts. What is counted by anchor or window is
counted in each task first and written out before it is joined, so that Spark can split the rows of such an anchor.

Rows are matched by id and text hash, so that rows with equal ids keep their own results. Contexts that occur
once carry their place, so that only places of repeated ones are joined. Intermediate tables are written to the
shared folder in spark.checkpoint.dir.

Defined cases: null and empty texts are no bytes; texts of fewer than LENGTH bytes keep all; equal rows are
repeats of each other; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, stored, table, text_udf
from .hashing import mixed, powers
from .rindex import RunLengthIndex

LENGTH, ANCHOR = 200, 48
SHARD_BYTES = 1 << 17
CROWD = 1500
_PLACE_BITS = 24
_CHUNK = 1 << 19
_CONTEXT = pa.struct([("a", pa.int64()), ("c", pa.int64()), ("d", pa.int64()), ("i", pa.int32()), ("n", pa.int32())])


def _sums(data: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    power, inverse = powers(len(data), which)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return sums, inverse, power


def _hash(sums: tuple, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((sums[0][end] - sums[0][start]) * sums[1][start] + (end - start).astype(np.uint64))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of width grams the place of the least hash, the last one on ties. Fewer than 2**24 grams."""
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    key = (h & ~mask) | (mask - np.arange(len(h), dtype=np.uint64))
    size = 1
    while size * 2 <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < width:
        key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
    return (mask - (key & mask)).astype(np.int64)


def contexts(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one text: anchor hash, two hashes of the context, first window and number of windows."""
    parts, step = [], _CHUNK
    # a long text in stretches that overlap by a window; the windows of an anchor may be cut there: the hashes say so
    for at in range(0, max(0, len(data) - LENGTH + 1), step):
        parts.append((at, data[at : at + step + LENGTH - 1]))
    found = []
    for at, part in parts:
        sums, other = _sums(part), _sums(part, 1)
        grams = np.arange(len(part) - ANCHOR + 1)
        place = _least(_hash(sums, grams, grams + ANCHOR), LENGTH - ANCHOR + 1)
        found.append(_grouped(sums, other, place, np.zeros(len(place), np.int64), at))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, np.int64) for _ in range(5))


def _grouped(sums: tuple, other: tuple, place: np.ndarray, owner: np.ndarray, shift: int = 0, starts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Consecutive windows with one anchor. starts: of the windows, all places by default."""
    starts = np.arange(len(place)) if starts is None else starts
    first = np.nonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])[0]
    n = np.diff(np.r_[first, len(place)])
    start = starts[first]
    end = start + n - 1 + LENGTH
    anchor = _hash(sums, place[first], place[first] + ANCHOR)
    return anchor.view(np.int64), _hash(sums, start, end).view(np.int64), _hash(other, start, end).view(np.int64), start + shift, n


def contexts_of(texts: list[bytes]) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Of short texts at once: each context's text, and what contexts() gives, with places in their texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), tuple(np.zeros(0, np.int64) for _ in range(5))
    sums, other = _sums(data), _sums(data, 1)
    grams = np.arange(len(data) - ANCHOR + 1)
    place = _least(_hash(sums, grams, grams + ANCHOR), LENGTH - ANCHOR + 1)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(place)]
    whole = np.nonzero(np.arange(len(place)) + LENGTH <= (begins + sizes)[owner])[0]
    if not len(whole):
        return np.zeros(0, np.int64), tuple(np.zeros(0, np.int64) for _ in range(5))
    place, owner = place[whole], owner[whole]
    first = np.nonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])[0]
    a, c, d, i, n = _grouped(sums, other, place, owner, starts=whole)
    return owner[first], (a, c, d, i - begins[owner[first]], n)


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _scan(texts: pa.Array) -> pa.Array:
    sizes, columns = [], [[] for _ in range(5)]
    for part in chunks(texts, _CHUNK):
        rows = [_encoded(t) for t in part.to_pylist()]
        if len(rows) == 1:
            got = contexts(np.frombuffer(rows[0], np.uint8))
            sizes.append(np.array([len(got[0])]))
        else:
            owner, got = contexts_of(rows)
            sizes.append(np.bincount(owner, minlength=len(rows)))
        for column, x in zip(columns, got, strict=True):
            column.append(x)
    offsets = np.r_[0, np.cumsum(np.concatenate(sizes))] if sizes else np.zeros(1)
    flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
    rows_ = pa.StructArray.from_arrays([pa.array(x.astype(np.int32) if k > 2 else x) for k, x in enumerate(flat)], fields=list(_CONTEXT))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), rows_)


_scan.__annotations__ = {"texts": pa.Array, "return": pa.Array}


def anchored(text: Column) -> Column:
    """An array of contexts (anchor a, hashes c and d, first window i, number of windows n) of each text."""
    return F.arrow_udf(_scan, returnType="array<struct<a:bigint,c:bigint,d:bigint,i:int,n:int>>")(text)


@text_udf("binary")
def packed(texts: list[str | None]) -> list[bytes]:
    """Texts compressed for a shuffle."""
    press = zstandard.ZstdCompressor(level=1)
    return [press.compress(_encoded(t)) for t in texts]


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


_CUT = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("a", pa.int64()), ("times", pa.int64()), ("kinds", pa.int64()), ("i", pa.int32()), ("n", pa.int32()), ("bytes", pa.binary())])
_CUT_ROWS = 1000


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts that each compressed text holds, a row for each, in small batches."""
    rows: list[dict] = []
    for batch in batches:
        for k in range(len(batch)):
            doc_id, mark, pack, held = (x[0] for x in batch.slice(k, 1).to_pydict().values())
            data = _unpacked(pack)
            rows += [{"doc_id": doc_id, "mark": mark, "bytes": data[h["i"] : h["i"] + h["n"] - 1 + LENGTH], **h} for h in held]
            if len(rows) >= _CUT_ROWS:
                yield pa.RecordBatch.from_pylist(rows, _CUT)
                rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _CUT)


def _kept(packs: pa.Array, starts: pa.Array, sizes: pa.Array) -> pa.Array:
    out = []
    for pack, i, n in zip(packs.to_pylist(), starts.to_pylist(), sizes.to_pylist(), strict=True):
        data = _unpacked(pack)
        kept, removed, spans, at = hashlib.sha256(), 0, 0, 0
        for a, b in merged(i or (), n or ()):
            kept.update(data[at:a])
            removed, spans, at = removed + b - a, spans + 1, b
        kept.update(data[at:])
        out.append({"n_bytes": len(data), "n_removed": removed, "n_spans": spans, "kept_sha256": kept.hexdigest()})
    return pa.array(out, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))


_kept.__annotations__ = {"packs": pa.Array, "starts": pa.Array, "sizes": pa.Array, "return": pa.Array}


def merged(starts, sizes) -> Iterator[tuple[int, int]]:
    """Maximal byte spans that windows at these ranges of starts cover."""
    end = begin = -1
    for a, n in sorted(zip(starts, sizes, strict=True)):
        if a > end:
            if end > begin:
                yield begin, end
            begin = a
        end = max(end, a + n - 1 + LENGTH)
    if end > begin:
        yield begin, end


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by anchor: contexts of whole anchors fill a shard; the repeated windows of those that occur once."""
    held: list[tuple] = []
    size = 0

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        index = RunLengthIndex([r[5] for r in rows])
        long = np.r_[False, index.matching_statistics() >= LENGTH, False]
        out: list[list] = [[], [], [], []]
        for at, (_, doc, mark, i, n, _, times) in zip(index.starts.tolist(), rows, strict=True):
            if times > 1:
                continue
            own = long[at + 1 : at + 1 + n].astype(np.int8)
            edge = np.diff(np.r_[0, own, 0])
            for a, b in zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True):
                for column, x in zip(out, (doc, mark, i + a, b - a), strict=True):
                    column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], ["doc_id", "mark", "i", "n"])

    last = None
    for batch in batches:
        for row in zip(*(batch.column(name).to_pylist() for name in ("a", "doc_id", "mark", "i", "n", "bytes", "times")), strict=True):
            if size >= SHARD_BYTES and row[0] != last:
                yield shard(held)
                held, size = [], 0
            held.append(row)
            size += len(row[5])
            last = row[0]
    if held:
        yield shard(held)


def _windows(data: pa.Array) -> pa.Array:
    """Two hashes of each window of a context."""
    out = []
    for row in data.to_pylist():
        part = np.frombuffer(row, np.uint8)
        at = np.arange(len(part) - LENGTH + 1)
        x, y = (_hash(_sums(part, k), at, at + LENGTH).view(np.int64).tolist() for k in (0, 1))
        out.append([{"k": k, "x": p, "y": q} for k, (p, q) in enumerate(zip(x, y, strict=True))])
    return pa.array(out, pa.list_(pa.struct([("k", pa.int32()), ("x", pa.int64()), ("y", pa.int64())])))


_windows.__annotations__ = {"data": pa.Array, "return": pa.Array}


def repeated(df: DataFrame, id_column: str = "doc_id", text: str = "text", crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, mark, pack: the text compressed) and their repeated windows (doc_id, mark, i: first start, n: how many, way: found as whole contexts, by the index or by hashes)."""
    rows = df.select(F.col(id_column).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    found = stored(rows.select("doc_id", "mark", F.explode(anchored(F.col("text"))).alias("x")).select("doc_id", "mark", "x.*"))
    same = ["a", "c", "d"]
    groups = stored(found.groupBy(*same).agg(F.count("*").alias("times")))
    # anchors with several contexts, of which one occurs once
    mixed_ = stored(groups.groupBy("a").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).filter("kinds > 1 AND least = 1").select("a", "kinds"))
    wanted = stored(groups.join(mixed_, "a", "left").filter("times > 1 OR kinds IS NOT NULL"))
    met = stored(found.join(wanted, same))
    # of contexts that have to be compared one place each
    need = met.filter("kinds IS NOT NULL").groupBy(*same).agg(F.max("times").alias("times"), F.max("kinds").alias("kinds"), F.min(F.struct("doc_id", "mark", "i", "n")).alias("at")).select("a", "times", "kinds", "at.*")
    places = need.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("a", "times", "kinds", "i", "n")).alias("held"))
    packs = rows.select("doc_id", "mark", packed(F.col("text")).alias("pack"))
    one = packs.join(places, packs["doc_id"].eqNullSafe(places["doc_id"]) & (packs["mark"] == places["mark"])).select(places["doc_id"], places["mark"], "pack", "held")
    # equal rows give a context twice
    texts = one.mapInArrow(_slices, "doc_id bigint, mark bigint, a bigint, times bigint, kinds bigint, i int, n int, bytes binary").dropDuplicates(["doc_id", "mark", "i"])
    texts = stored(texts)
    few, many = texts.filter(F.col("kinds") <= crowd), texts.filter(F.col("kinds") > crowd)
    few = few.repartition("a").sortWithinPartitions("a", "doc_id", "mark", "i").select("a", "doc_id", "mark", "i", "n", "bytes", "times")
    by_index = few.mapInArrow(_indexed, "doc_id bigint, mark bigint, i int, n int")
    each = many.select("doc_id", "mark", "i", "times", F.explode(F.arrow_udf(_windows, returnType="array<struct<k:int,x:bigint,y:bigint>>")("bytes")).alias("w")).select("doc_id", "mark", "i", "times", "w.*")
    twice = stored(each.groupBy("x", "y").agg(F.sum("times").alias("all")).filter("all > 1").select("x", "y"))
    by_hash = each.filter("times = 1").join(twice, ["x", "y"], "left_semi").select("doc_id", "mark", (F.col("i") + F.col("k")).cast("int").alias("i"), F.lit(1).alias("n"))
    whole = met.filter("times > 1").select("doc_id", "mark", "i", "n")
    found_by = lambda df, way: df.withColumn("way", F.lit(way))
    return packs, found_by(whole, "whole").union(found_by(by_index, "index")).union(found_by(by_hash, "hash"))


def remove_repeats(df: DataFrame, id_column: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""
    packs, windows = repeated(df, id_column, text, crowd)
    # equal rows have the same windows, once
    spans = windows.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("i", "n")).alias("spans"))
    both = packs.join(spans, packs["doc_id"].eqNullSafe(spans["doc_id"]) & (packs["mark"] == spans["mark"]), "left").select(packs["doc_id"], "pack", "spans")
    made = F.arrow_udf(_kept, returnType="n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")("pack", "spans.i", "spans.n")
    return both.select("doc_id", made.alias("made")).select("doc_id", "made.*")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
