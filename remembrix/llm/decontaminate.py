"""Benchmark decontamination with suffix arrays over the training texts.

training_shards() cuts the documents in shards of about SHARD_BYTES of text and writes each one's words and the
array of its suffixes, in the order of their first WINDOW words, to the shared folder: once, whatever is searched.
search() binary-searches the suffixes of the benchmark's items in each shard's array. All places that share a window
of words with a suffix come out; neighbouring ones on the same diagonal join to the longest verbatim match at each
place, of any length, with its places in item and document. remove() drops the documents that are affected.

Only suffixes that can hold a window are searched, and of these only those whose first LEAD words stand somewhere in
the shard. That is looked up from the shard's side, so that a shard costs its own size times the logarithm of the
benchmark's, not the benchmark's size. The benchmark goes to the executors in blocks of at most BLOCK_BYTES of text
(by an aggregate of its size), as arrays of a few times that; each block is searched in the arrays that are there.
Nothing is shuffled but the blocks' results, if there are several. Words are compared by 64-bit hashes.

Defined cases: null or empty texts have no words, on either side; an item of fewer words than a window is one
window; items of equal words are searched once, repeated ids count once; null item ids are left out of the ids but
their words hit; equal rows give equal results; empty tables give no rows, or no hits; whole texts of any length; only
the id and text columns are read, so that further columns and their names don't matter.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, cut, stored, table
from .hashing import mixed, powers

WINDOW = 13
#: Words by which suffixes are looked up before the search.
LEAD = 3
#: A document is contaminated from one hit word in so many on.
SHARE = 20
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 1 << 20
#: Affected documents up to which their keys go to each executor.
FEW = 100_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: digits, letters, and all of characters beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated texts (bytes, and where each begins and the last ends): each word's hash, its text, its start and length."""
    low = _LOWER[data]
    inside = _WORD[low]
    # a word ends where a text does
    edge = np.zeros(len(low) + 1, bool)
    edge[bounds] = True
    starts = np.nonzero(inside & (~np.r_[False, inside[:-1]] | edge[:-1]))[0]
    ends = np.nonzero(inside & (~np.r_[inside[1:], False] | edge[1:]))[0] + 1
    power, inverse = powers(len(low))
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[: len(low)], out=sums[1:])
    # the sum of a word, as if it began where the data does
    hashed = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashed, np.searchsorted(bounds, starts, "right") - 1, starts, ends - starts


def suffix_array(words: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Suffixes of word ids in the order of their first depth words at least, by prefix doubling; id 0 ends each.

    The first order packs several words in a number; after that only suffixes that are like others are ordered anew.
    """
    n, bits = len(words), max(1, int(words.max(initial=0)).bit_length())
    if not n:
        return np.zeros(0, np.int64)
    key, alive, done = np.zeros(n, np.int64), np.ones(n, bool), 0
    while done < depth and (done + 1) * bits <= 62:
        word = np.zeros(n, np.int64)
        word[: max(n - done, 0)] = words[done:]
        word[~alive] = 0
        alive &= word > 0
        key = key << bits | word
        done += 1
    order = np.argsort(key, kind="stable")
    place, key = np.arange(n), key[order]
    rank = np.empty(n, np.int64)
    ends = np.nonzero(words == 0)[0]
    to_end = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) if len(ends) else n - np.arange(n)
    while True:
        head = np.r_[True, key[1:] != key[:-1]]
        first = np.nonzero(head)[0]
        own = np.cumsum(head) - 1
        rank[order[place]] = place[first][own]
        if done >= depth:
            return order
        again = (np.diff(np.r_[first, len(key)])[own] > 1) & (to_end[order[place]] >= done)
        place = place[again]
        if not len(place):
            return order
        suffix = order[place]
        key = rank[suffix] * n + rank[suffix + done]
        by = np.argsort(key, kind="stable")
        order[place], key = suffix[by], key[by]
        done *= 2


def _leads(hashed: np.ndarray, size: int) -> np.ndarray:
    """A hash of size words from each place where so many follow."""
    n = len(hashed) - size + 1
    out = np.full(max(n, 0), np.uint64(size))
    for k in range(size):
        out = mixed(out * np.uint64(31) + hashed[k : k + n]) if n > 0 else out
    return out


class Benchmark:
    """The suffixes of a block of items that can hold a window."""

    def __init__(self, items: list[tuple[object, str | None]], size: int = WINDOW) -> None:
        texts = [(i, t.encode("utf-8", "surrogatepass")) for i, t in items if t]
        bounds = np.cumsum([0, *(len(t) for _, t in texts)])
        hashed, owner, _, _ = word_hashes(np.frombuffer(b"".join(t for _, t in texts), np.uint8), bounds)
        ends = np.searchsorted(owner, np.arange(len(texts)), "right")
        named: dict[bytes, set] = {}
        for k, (i, _) in enumerate(texts):
            own = hashed[ends[k - 1] if k else 0 : ends[k]]
            if len(own):
                named.setdefault(own.tobytes(), set()).add(i)
        #: Ids of each different sequence of words.
        self.items = [sorted(map(str, ids - {None})) for ids in named.values()]
        sizes = np.array([len(x) // 8 for x in named], np.int64)
        self.words = np.frombuffer(b"".join(named), np.uint64)
        begins = np.cumsum(sizes) - sizes
        self.window = np.minimum(sizes, size)
        which, at = _ranges(begins, begins + np.maximum(sizes - size, 0) + 1)
        self.by_lead: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for lead in sorted(set(np.minimum(self.window, LEAD).tolist())):
            mine = np.minimum(self.window, LEAD)[which] == lead
            key = _leads(self.words, lead)[at[mine]]
            order = np.argsort(key, kind="stable")
            names, first = np.unique(key[order], return_index=True)
            self.by_lead.append((lead, names, np.r_[first, len(key)], which[mine][order], at[mine][order]))
        self.begins = begins

    def candidates(self, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
        """Item and place of the suffixes whose first words stand in the shard."""
        which, at = [], []
        for lead, names, first, items, places in self.by_lead:
            starts = np.nonzero(shard.follow >= lead)[0]
            key = _leads(shard.hashed, lead)[starts]
            found = np.searchsorted(names, key)
            found[found == len(names)] = 0
            held = np.unique(found[names[found] == key])
            _, rows = _ranges(first[held], first[held + 1])
            which.append(items[rows])
            at.append(places[rows])
        return (np.concatenate(which), np.concatenate(at)) if which else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the range and value, for all values of ranges low:high."""
    n = high - low
    which = np.repeat(np.arange(len(low)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]


class Shard:
    """Words of some texts, and the array of their suffixes. vocabulary: hashes in order; words: ids from 1 on, 0 after each text."""

    def __init__(self, vocabulary: np.ndarray, words: np.ndarray, array: np.ndarray | None = None) -> None:
        self.vocabulary, self.words = vocabulary, words
        self.array = suffix_array(words) if array is None else array
        ends = np.nonzero(words == 0)[0]
        self.begins = np.r_[0, ends[:-1] + 1] if len(ends) else np.zeros(0, np.int64)
        #: Words of its text from each place on.
        self.follow = ends[np.searchsorted(ends, np.arange(len(words)))] - np.arange(len(words))
        self.hashed = np.r_[np.uint64(0), vocabulary][words]

    @classmethod
    def of(cls, texts: pa.Array) -> Shard:
        data, bounds = _joined(texts.cast(pa.binary()).fill_null(b""))
        hashed, owner, _, _ = word_hashes(data, bounds)
        vocabulary, ids = np.unique(hashed, return_inverse=True)
        words = np.zeros(len(ids) + len(texts), np.int64)
        words[np.arange(len(ids)) + owner] = ids + 1  # a 0 after each text
        return cls(vocabulary, words)

    def _codes(self, hashed: np.ndarray) -> np.ndarray:
        """Twice the id of words, and what lies between for words that the shard doesn't have."""
        at = np.searchsorted(self.vocabulary, hashed)
        known = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == hashed if len(self.vocabulary) else np.zeros(len(hashed), bool)
        return 2 * at + 1 + known

    def find(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each slice of hashed words (sizes words from starts on) the range of the array whose suffixes begin with it, by binary search."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.array), np.int64)
        if not len(self.array) or not len(starts):
            return low, low
        codes = self._codes(words[np.minimum(starts[:, None] + np.arange(int(sizes.max())), len(words) - 1)].ravel()).reshape(len(starts), -1)
        bounds = []
        for upper in (False, True):
            lo, hi = low.copy(), high.copy()
            while (open_ := lo < hi).any():
                mid = (lo + hi) >> 1
                suffix = self.array[np.minimum(mid, len(self.array) - 1)]
                order = np.zeros(len(starts), np.int8)  # of the suffix against the slice
                for k in range(codes.shape[1]):
                    undecided = np.nonzero((order == 0) & (k < sizes) & open_ & (self.follow[suffix] >= k))[0]
                    if not len(undecided):
                        break
                    order[undecided] = np.sign(2 * self.words[suffix[undecided] + k] - codes[undecided, k])
                right = open_ & ((order < 0) | (upper & (order == 0)))
                lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
            bounds.append(lo)
        return bounds[0], bounds[1]

    def matches(self, bench: Benchmark) -> tuple[np.ndarray, ...]:
        """The longest verbatim matches of a window or more: text, place in it, item, place in that, and number of words."""
        item, at = bench.candidates(self)
        low, high = self.find(bench.words, at, bench.window[item])
        which, rows = _ranges(low, high)
        place, item, at = self.array[rows].astype(np.int64), item[which], at[which]
        order = np.lexsort((place, place - at, item))
        place, item, at = place[order], item[order], at[order]
        # windows one word on, on the same diagonal, are one match
        starts = np.nonzero(np.r_[True, (item[1:] != item[:-1]) | (place[1:] - at[1:] != place[:-1] - at[:-1]) | (place[1:] != place[:-1] + 1)])[0] if len(place) else np.zeros(0, np.int64)
        size = np.diff(np.r_[starts, len(place)]) - 1 + bench.window[item[starts]]
        place, item, at = place[starts], item[starts], at[starts]
        text = np.searchsorted(self.begins, place, "right") - 1
        return text, place - self.begins[text], item, at - bench.begins[item], size


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pa.concat_arrays([texts]) if texts.offset == 0 else pa.array(texts.to_pylist(), pa.binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of rows (id, mark, text)."""
    for batch in batches:
        at = 0
        for part in chunks(batch.column(2), SHARD_BYTES):
            shard = Shard.of(part)
            listed = lambda column: pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), column.slice(at, len(part)))  # noqa: B023, E731
            n_words = np.diff(np.r_[shard.begins, len(shard.words)]) - 1
            binary = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
            columns = [listed(batch.column(0)), listed(batch.column(1)), pa.array([n_words], pa.list_(pa.int32())), binary(shard.vocabulary, "<u8"), binary(shard.words, "<i4"), binary(shard.array, "<i4")]
            at += len(part)
            yield pa.RecordBatch.from_arrays(columns, ["ids", "marks", "n_words", "vocabulary", "words", "array"])


def training_shards(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The written shards of docs: ids, marks (a hash of the text) and n_words of their texts, vocabulary, words, array, and their number shard."""
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(_built, f"ids array<{kind}>, marks array<bigint>, n_words array<int>, vocabulary binary, words binary, array binary")
    return stored(made.withColumn("shard", F.monotonically_increasing_id()))


_MATCH = "struct<item:string,start:int,at:int,length:int>"
_MATCH_KIND = pa.struct([("item", pa.string()), ("start", pa.int32()), ("at", pa.int32()), ("length", pa.int32())])


def _searcher(held):
    """held: a broadcast Benchmark."""

    def search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = held.value
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                vocabulary, words, array = (np.frombuffer(row.column(name)[0].as_py(), kind) for name, kind in (("vocabulary", "<u8"), ("words", "<i4"), ("array", "<i4")))
                shard = Shard(vocabulary, words.astype(np.int64), array)
                ids, marks, n_words = (row.column(name).flatten() for name in ("ids", "marks", "n_words"))
                text, place, item, at, size = shard.matches(bench)
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, shard.begins[text] + place, 1)
                np.add.at(change, shard.begins[text] + place + size, -1)
                hit = np.nonzero(np.cumsum(change[:-1]) > 0)[0]
                owner = np.searchsorted(shard.begins, hit, "right") - 1
                hits = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(ids) + 1)).astype(np.int32)), pa.array((hit - shard.begins[owner]).astype(np.int32)))
                held_items: list[set] = [set() for _ in range(len(ids))]
                found: list[list] = [[] for _ in range(len(ids))]
                for t, p, i, a, n in sorted(zip(*(x.tolist() for x in (text, place, item, at, size)), strict=True)):
                    held_items[t].update(bench.items[i])
                    found[t] += [{"item": name, "start": a, "at": p, "length": n} for name in bench.items[i] or [None]]
                columns = [pa.array([row.column("shard")[0].as_py()] * len(ids), pa.int64()), pa.array(np.arange(len(ids)), pa.int32()), ids, marks, pa.array(n_words, pa.int64()) if not len(ids) else n_words.cast(pa.int64()), hits]
                columns += [pa.array([sorted(x) for x in held_items], pa.list_(pa.string())), pa.array(found, pa.list_(_MATCH_KIND))]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "k", "id", "mark", "n_words", "hit", "items", "matches"])

    return search_shards


def _blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> list[DataFrame]:
    """The benchmark in parts of about limit bytes by a hash of the items' texts."""
    size = benchmark.agg(F.sum(F.octet_length(text).cast("bigint") + 64)).first()[0] or 0
    n = -(-size // limit) or 1
    return [benchmark.select(item, text).filter(F.pmod(F.xxhash64(text), F.lit(n)) == k) for k in range(n)]


def search(shards: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text", limit: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document in shards: id, mark, n_words, hit (positions of hit words), items (ids found, as strings, sorted) and matches (item, start in it, place at in the document, length in words)."""
    sc, kind = shards.sparkSession.sparkContext, shards.schema["ids"].dataType.elementType.simpleString()
    found = []
    for part in _blocks(benchmark, item, text, limit):
        held = sc.broadcast(Benchmark([tuple(r) for r in part.collect()]))
        found.append(shards.mapInArrow(_searcher(held), f"shard bigint, k int, id {kind}, mark bigint, n_words bigint, hit array<int>, items array<string>, matches array<{_MATCH}>"))
    if len(found) == 1:
        return found[0].drop("shard", "k")
    rows = functools.reduce(DataFrame.union, (cut(f) for f in found))
    gathered = lambda c: F.flatten(F.collect_list(c))
    whole = rows.groupBy("shard", "k").agg(F.first("id").alias("id"), F.first("mark").alias("mark"), F.max("n_words").alias("n_words"), *(gathered(c).alias(c) for c in ("hit", "items", "matches")))
    return whole.select("id", "mark", "n_words", *(F.array_sort(F.array_distinct(c)).alias(c) for c in ("hit", "items")), F.array_sort("matches").alias("matches"))


def judged(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """A row for each of docs: its key, mark, n_words, n_hit, n_items, items_sha256, contaminated, matches, and longest, the words of its longest match."""
    found = search(training_shards(docs, key, text), benchmark, **how)
    n_hit = F.size("hit").cast("bigint")
    return found.select(
        F.col("id").alias(key),
        "mark",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
        "matches",
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["length"])), F.lit(0)).cast("bigint").alias("longest"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without contaminated rows."""
    gone = cut(judged(docs, benchmark, key, text, **how).filter("contaminated").select(F.col(key).alias("_key"), F.col("mark").alias("_mark")).distinct())
    if gone.count() <= FEW:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[key].eqNullSafe(gone["_key"]) & (F.xxhash64(docs[text]) == gone["_mark"]), "left_anti")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest")


_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS_SQL = f"coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOW}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), [])"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents), b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
win AS (SELECT item_id, n, j, array_to_string(list_slice(w, j, j + n - 1), ' ') AS g FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS j FROM b WHERE len(w) > 0)),
own AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT DISTINCT o.doc_id, o.n, o.k, v.item_id, v.j FROM own o JOIN win v ON v.n = o.n AND v.g = o.g),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY 1),
runs AS (SELECT doc_id, max(n) + count(*) - 1 AS size FROM (SELECT *, k - row_number() OVER (PARTITION BY doc_id, item_id, n, k - j ORDER BY k) AS run FROM hits) GROUP BY doc_id, item_id, n, k - j, run),
longest AS (SELECT doc_id, max(size) AS longest FROM runs GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN places p ON p.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id LEFT JOIN longest l ON l.doc_id = d.doc_id"""
