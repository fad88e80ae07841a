"""BPE encoding and decoding by tree concatenation.

A pre-token that nothing splits and that is longer than a leaf is encoded as a tree: its halves are encoded on
their own (they depend on nothing, so any order or place will do), and at each join a window of tokens around
the seam is encoded again. If the window's first and last token are those that were there before, both sides
agree and the splice is the exact encoding: a token sequence is what BPE gives just if each neighbouring pair
is, and all pairs outside the window are pairs of the halves. Else the window grows, up to both halves whole.

Defined cases: null or empty text has no tokens and decodes to the empty string; strings of the special tokens
inside a text become those tokens, as the library's default has it; whole texts of any length; equal texts,
equal values; only the text column is read, so that further columns and their names don't matter.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_udf
from .hashing import mixed, powers
from .ragged import Pairs, merge_ragged

#: White space of Unicode, as the normalizer's and the pattern's \s have it.
WHITE = "\t-\r \x85\xa0  -     　"
#: What a character is for pre-tokens, which are runs of letters, single numbers, or runs of the rest.
_WHITE, _LETTER, _NUMBER, _OTHER = range(4)
#: Symbols of a leaf; a longer pre-token is a tree.
LEAF = 16
#: Tokens on each side of a seam that are encoded again at first.
WINDOW = 2
#: Characters of a pre-token up to which its encoding is kept for the next batch, and ids that are kept at most.
SHORT, KEPT = 64, 1 << 20
#: Ids that are turned into text at a time.
DECODED = 1 << 18


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next of those from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    beyond = iter(range(256, 512))
    return [chr(b if b in printable else next(beyond)) for b in range(256)]


@functools.cache
def _kinds() -> np.ndarray:
    """The kind of each code point."""
    every, out = "".join(map(chr, range(0x110000))), np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_WHITE, f"[{WHITE}]+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def _normalized(text: str) -> str:
    """NFC, then lower case letter by letter (no final sigma)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def pre_token_bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens in code points that end with two white ones."""
    kind = _kinds()[codes]
    first = np.r_[True, kind[1:] != kind[:-1]] | (kind == _NUMBER)
    # an apostrophe that begins a run of its kind takes s, t, m, d, re, ve or ll with it
    at = np.nonzero((codes == 39) & first)[0]
    x, y = codes[np.minimum(at + 1, len(codes) - 1)], codes[np.minimum(at + 2, len(codes) - 1)]
    one = np.isin(x, list(map(ord, "stmd")))
    two = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
    size = np.where(one, 2, 3)[one | two]
    at = at[one | two]
    first[at + 1] = False
    first[at + size] = True
    begins = np.nonzero(first)[0]
    ends = np.r_[begins[1:], len(codes)]
    real = kind[begins] != _WHITE
    return begins[real], ends[real]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[k], starts[k] + 1, ... of each k, sizes[k] of them."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class WordBpe:
    """BPE whose words end in a suffix, from a tokenizers file of normalized, byte-level words."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.tokens = {i: token for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: token for token, i in self.special.items()}
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        letters, end = _byte_characters(), model["end_of_word_suffix"]
        self.inner, self.last = [vocab[c] for c in letters], [vocab[c + end] for c in letters]
        self.inner_of, self.last_of = np.array(self.inner), np.array(self.last)
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.look = Pairs(self.merges)
        self.named = pa.array([self.tokens.get(i) for i in range(max(self.tokens) + 1)], pa.string())
        #: The byte symbols that a token is made of.
        self.parts = {i: (i,) for i in (*self.inner, *self.last)}
        for (a, b), (_, new) in self.merges.items():
            self.parts[new] = self.parts[a] + self.parts[b]
        self._forget()

    def _forget(self) -> None:
        """Drop what is kept of encoded pre-tokens. By place: hash for checks, first of the ids, number of ids; the first places are the special tokens'."""
        ids = np.array(list(self.special.values()), np.int64)
        self.places: dict[int, int] = {}
        self.checks, self.firsts, self.sizes, self.flat = np.zeros(len(ids), np.uint64), np.arange(len(ids)), np.ones(len(ids), np.int64), ids

    def merge(self, symbols: list[int]) -> list[int]:
        """Plain BPE: the lowest-rank pair first, the leftmost one on ties."""
        if len(symbols) > 8 * LEAF:
            return self._merge_long(symbols)
        get = self.merges.get
        symbols = list(symbols)
        while len(symbols) > 1:
            best = min([hit for hit in map(get, zip(symbols, symbols[1:])) if hit], default=None)  # noqa: B905
            if best is None:
                break
            out, i, n = [], 0, len(symbols)
            while i < n:
                if i + 1 < n and get((symbols[i], symbols[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same by a priority queue over a linked list, for windows that had to grow."""
        symbols, get, n = list(symbols), self.merges.get, len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(*hit, i, *pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if (hit := get(pair))]  # noqa: B905
        queue = [(rank, i, left, right, new) for rank, new, i, left, right in queue]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (hit := get((symbols[x], symbols[y]))):
                    heapq.heappush(queue, (hit[0], x, symbols[x], symbols[y], hit[1]))
        return [s for s in symbols if s >= 0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenation of two encoded halves."""
        width = WINDOW
        while True:
            a, b = left[-width:], right[:width]
            got = self.merge([s for token in (*a, *b) for s in self.parts[token]])
            if (len(a) == len(left) or got[0] == a[0]) and (len(b) == len(right) or got[-1] == b[-1]):
                return left[: len(left) - len(a)] + got + right[len(b) :]
            width *= 2

    @staticmethod
    def leaves(symbols: list[int], leaf: int = LEAF) -> list[list[int]]:
        """The sequence cut in halves again and again, down to leaves."""
        if len(symbols) <= leaf:
            return [symbols]
        pieces = 1 << (-(-len(symbols) // leaf) - 1).bit_length()
        bounds = [len(symbols) * k // pieces for k in range(pieces + 1)]
        return [symbols[i:j] for i, j in zip(bounds, bounds[1:], strict=False) if i < j]

    def joined(self, level: list[list[int]]) -> list[int]:
        """Encoded leaves joined pairwise, level by level."""
        while len(level) > 1:
            level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def encode_pieces(self, pieces: list[str], leaf: int = LEAF) -> list[list[int]]:
        """The ids of each pre-token: all leaves are merged at the same time, then the trees are joined."""
        leaves: list[tuple[int, list[int]]] = []
        for k, piece in enumerate(pieces):
            data = piece.encode("utf-8", "surrogatepass")
            symbols = [self.inner[b] for b in data]
            symbols[-1] = self.last[data[-1]]
            leaves += [(k, part) for part in self.leaves(symbols, leaf)]
        sizes = [len(part) for _, part in leaves]
        owner = np.repeat(np.arange(len(leaves)), sizes)
        ids, place = merge_ragged(np.array([s for _, part in leaves for s in part], np.int64), owner, self.look)
        ends = np.searchsorted(owner[place], np.arange(len(leaves)), "right").tolist()
        ids = ids.tolist()
        out: list[list[list[int]]] = [[] for _ in pieces]
        at = 0
        for (k, _), end in zip(leaves, ends, strict=True):
            out[k].append(ids[at:end])
            at = end
        return [self.joined(parts) for parts in out]

    def _encode_slices(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens that are slices of UTF-8 bytes, one after the other, and how many each has."""
        sizes = ends - begins
        tree = sizes > LEAF
        small, at = np.nonzero(~tree)[0], _spread(begins[~tree], sizes[~tree])
        symbols = self.inner_of[data[at]]
        symbols[np.cumsum(sizes[~tree]) - 1] = self.last_of[data[ends[~tree] - 1]]
        owner = np.repeat(small, sizes[~tree])
        ids, place = merge_ragged(symbols, owner, self.look)
        counts = np.bincount(owner[place], minlength=len(sizes))
        if not tree.any():
            return ids, counts
        pieces = [data[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(begins[tree].tolist(), ends[tree].tolist(), strict=True)]
        made = self.encode_pieces(pieces)
        counts[tree] = list(map(len, made))
        out = np.zeros(counts.sum(), np.int64)
        starts = np.cumsum(counts) - counts
        out[_spread(starts[~tree], counts[~tree])] = ids
        out[_spread(starts[tree], counts[tree])] = np.concatenate(made)
        return out, counts

    def _segments(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Normalized stretches between special strings, each one's text, and after which stretches a special token stands, and which."""
        parts, owner, after, which = [], [], [], []
        order = list(self.special)
        for k, text in enumerate(texts):
            at = 0
            for m in self.split_special.finditer(text) if text and "<|" in text else ():
                parts.append(_normalized(text[at : m.start()]))
                owner.append(k)
                after.append(len(parts) - 1)
                which.append(order.index(m[0]))
                at = m.end()
            parts.append(_normalized((text or "")[at:]))
            owner.append(k)
        return parts, np.array(owner, np.int64), np.array(after, np.int64), np.array(which, np.int64)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and how many each has. Pre-tokens are told apart by two 64-bit hashes."""
        parts, owner, after, which = self._segments(texts)
        joined = "\n".join(parts) + "\n\n"  # nothing looks across white space
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        begins, ends = pre_token_bounds(codes)
        width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        byte = np.r_[0, np.cumsum(width)]
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        keys = []
        for k in range(2):
            power, inverse = powers(len(codes), k)
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], out=sums[1:])
            keys.append(mixed((sums[ends] - sums[begins]) * inverse[begins] + (ends - begins).astype(np.uint64)))
        if len(self.flat) > KEPT or len(self.places) > KEPT // 4:
            self._forget()
        short = np.nonzero(ends - begins <= SHORT)[0]
        names, one, same = np.unique(keys[0][short], return_index=True, return_inverse=True)
        get = self.places.get
        named = names.tolist()
        found = np.array([get(x, -1) for x in named], np.int64)
        new = np.nonzero(found < 0)[0]
        long = np.nonzero(ends - begins > SHORT)[0]
        fresh = np.r_[short[one[new]], long]
        ids, counts = self._encode_slices(data, byte[begins[fresh]], byte[ends[fresh]])
        base, kept = len(self.firsts), len(new)
        firsts = np.r_[self.firsts, len(self.flat) + np.cumsum(counts) - counts]
        sizes, flat, checks = np.r_[self.sizes, counts], np.r_[self.flat, ids], np.r_[self.checks, keys[1][fresh]]
        found[new] = base + np.arange(kept)
        place = np.zeros(len(begins), np.int64)
        place[short], place[long] = found[same], base + kept + np.arange(len(long))
        if (checks[place] != keys[1]).any():  # two pre-tokens with the same first hash
            self._forget()
            return self._encode_apart(texts)
        if kept:
            self.places.update(zip([named[i] for i in new.tolist()], range(base, base + kept), strict=True))
        end = base + kept
        self.firsts, self.sizes, self.checks, self.flat = firsts[:end], sizes[:end], checks[:end], flat[: firsts[end - 1] + sizes[end - 1]]
        # pre-tokens of each stretch, and the special tokens between stretches
        bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
        upto = np.searchsorted(begins, bounds)
        of = owner[np.searchsorted(bounds, begins, "right") - 1]
        place, of = np.insert(place, upto[after + 1], which), np.insert(of, upto[after + 1], owner[after])
        amount = sizes[place]
        return flat[_spread(firsts[place], amount)], np.bincount(of, weights=amount, minlength=len(texts)).astype(np.int64)

    def _encode_apart(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts whose pre-tokens' hashes collide: pre-token by pre-token."""
        ids, counts = [], []
        for text in texts:
            parts, _, after, which = self._segments([text])
            special, own = dict(zip(after.tolist(), which.tolist(), strict=True)), []
            for k, part in enumerate(parts):
                codes = np.frombuffer(f"{part}\n\n".encode("utf-32-le", "surrogatepass"), "<u4")
                pieces = [part[a:b] for a, b in zip(*(x.tolist() for x in pre_token_bounds(codes)), strict=True)]
                own += [i for found in (self.encode_pieces(pieces) if pieces else ()) for i in found]
                own += [list(self.special.values())[special[k]]] if k in special else []
            ids += own
            counts.append(len(own))
        return np.array(ids, np.int64), np.array(counts, np.int64)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode_batch(self, ids: pa.Array) -> pa.Array:
        """The text of each array of ids: the file names no decoder, so the tokens stand as they are, a space between them."""
        sizes = pc.fill_null(pc.list_value_length(ids), 0)
        offsets = np.r_[0, np.cumsum(sizes.to_numpy(zero_copy_only=False))].astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(offsets), self.named.take(ids.flatten()))
        return pc.binary_join(tokens, " ")

    def decode(self, ids: list[int]) -> str:
        return self.decode_batch(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


@functools.cache
def _model(path: str) -> WordBpe:
    return WordBpe(path)


def _ids(path: str, texts: list[str | None]) -> pa.ListArray:
    ids, counts = _model(path).encode_batch(texts)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids.astype(np.int32)))


def _decoded(path: str, ids: pa.Array) -> pa.Array:
    ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, at = [], 0
    while at < len(ids):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + DECODED, "right")))
        out.append(_model(path).decode_batch(ids.slice(at, to - at)))
        at = to
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def encoder(path: str):
    """A function on a text column: its ids under the tokenizers file at path (on each executor)."""

    @text_udf("array<int>")
    def encode(texts: list[str | None]) -> pa.Array:
        return _ids(path, texts)

    return encode


def decoder(path: str):
    """A function on a column of arrays of ids: the decoded text, empty for null."""

    def decode(ids: pa.Array) -> pa.Array:
        return _decoded(path, ids)

    decode.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    return F.arrow_udf(decode, returnType="string")


def both_ways(path: str):
    """A function on a text column: its ids, and the text that these decode to, in one pass."""

    @text_udf("ids array<int>, decoded string")
    def encode_and_decode(texts: list[str | None]) -> pa.Array:
        ids = _ids(path, texts)
        return pa.StructArray.from_arrays([ids, _decoded(path, ids)], ["ids", "decoded"])

    return encode_and_decode


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of each text; a column named out is replaced."""
    return df.withColumn(out, encoder(path)(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text that each array of ids decodes to; a column named out is replaced."""
    return df.withColumn(out, decoder(path)(F.col(ids)))


def encode_and_decode(df: DataFrame, path: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """df with a struct out of ids and decoded; a column of that name is replaced. As encode(), then decode(), but texts go to Python once."""
    return df.withColumn(out, both_ways(path)(F.col(text)))


def decimals(ids: Column) -> Column:
    """Ids in decimals with one space between them."""
    return F.array_join(ids.cast("array<string>"), " ")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and SHA-256 of the ids, and the SHA-256 of what these ids decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    both = encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    ids = F.col("tokens.ids")
    return both.select("doc_id", F.size(ids).cast("bigint").alias("n_tokens"), F.sha2(decimals(ids), 256).alias("ids_sha256"), F.sha2("tokens.decoded", 256).alias("decoded_sha256"))
