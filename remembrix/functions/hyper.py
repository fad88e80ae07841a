"""Hypervectors of 2048 bits as arrays of 32 longs."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import FINGERPRINT_STOPWORDS

LANES, BITS = 32, 2048
DIGESTS = LANES // 2


def of_token(token: Column) -> Column:
    """A token's vector: the two halves of the md5 of token#k, k from 0 on."""
    halves = []
    for k in range(DIGESTS):
        digest = F.md5(F.concat(token, F.lit(f"#{k}")))
        halves += [F.conv(F.substring(digest, 1, 16), 16, -10).cast("bigint"), F.conv(F.substring(digest, 17, 16), 16, -10).cast("bigint")]
    return F.array(*halves)


def bind(a: Column, b: Column) -> Column:
    """Its own inverse."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def permute(a: Column) -> Column:
    """Rotation by one bit towards the low end; the last lane is the highest."""
    up = F.concat(F.slice(a, 2, LANES - 1), F.slice(a, 1, 1))
    return F.zip_with(a, up, lambda x, y: F.shiftrightunsigned(x, 1).bitwiseOR(F.shiftleft(y, 63)))


def popcount(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + F.bit_count(x))


def hamming(a: Column, b: Column) -> Column:
    return popcount(bind(a, b))


def similarity(a: Column, b: Column) -> Column:
    return 1 - 2 * hamming(a, b) / BITS


@lru_cache(1 << 16)
def _packed(token: str) -> bytes:
    """A token's vector in 256 bytes, the lowest bit first."""
    data = b"".join(hashlib.md5(f"{token}#{k}".encode("utf-8", "surrogatepass")).digest() for k in range(DIGESTS))
    return np.frombuffer(data, ">u8").astype("<u8").tobytes()


def _bits(tokens: list[str]) -> np.ndarray:
    """A row of bits for each token."""
    return np.unpackbits(np.frombuffer(b"".join(map(_packed, tokens)), np.uint8).reshape(len(tokens), -1), axis=1, bitorder="little")


#: Tokens whose bits are unpacked at a time.
BLOCK = 512


def _lanes(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits.astype(bool), bitorder="little").view("<i8")


def majority(counts: np.ndarray, n: int) -> np.ndarray:
    """Bits set in more than half of n vectors; a tie sets odd bits."""
    return (2 * counts > n) | ((2 * counts == n) & (np.arange(BITS) % 2 == 1) & (n > 0))


def components(text: str, tags: list[str]) -> dict[object, int]:
    """What a fingerprint is made of, with the votes of each: tags, words, pairs of words, and character trigrams."""
    votes: dict[object, int] = {}

    def add(key: object, n: int) -> None:
        votes[key] = votes.get(key, 0) + n

    for tag in tags:
        add(f"tag::{tag}", 3)
    words = [w for w in ("".join(c for c in raw if c.isalnum() or c == "_").lower() for raw in text.split()) if len(w.encode("utf-8", "surrogatepass")) >= 2]
    for before, word in zip([None, *words], words, strict=False):
        if word not in FINGERPRINT_STOPWORDS:
            add(f"word::{word}", 2)
        if before is not None:
            add((f"word::{before}", f"word::{word}"), 2)
    low = text.lower()
    if len(low) >= 3:
        for i in range(len(low) - 2):
            add(f"tri::{low[i : i + 3]}", 1)
    elif low:
        add(low, 1)
    return votes or {text: 1}


def _summed(bits: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """votes @ bits: rows of equal votes are added as bytes, at most 255 at a time."""
    total = np.zeros(BITS, np.int64)
    order = np.argsort(votes, kind="stable")
    values, starts = np.unique(votes[order], return_index=True)
    for vote, lo, hi in zip(values.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
        for at in range(lo, hi, 255):
            total += vote * np.add.reduce(bits[order[at : min(at + 255, hi)]], axis=0, dtype=np.uint8).astype(np.int64)
    return total


def fingerprint_of(text: str | None, tags: list[str] | None) -> list[int]:
    votes = components(text or "", tags or [])
    total, keys = np.zeros(BITS, np.int64), list(votes)
    for at in range(0, len(keys), BLOCK):
        part = keys[at : at + BLOCK]
        bits = _bits([k[1] if isinstance(k, tuple) else k for k in part])
        if pairs := [i for i, k in enumerate(part) if isinstance(k, tuple)]:
            bits[pairs] ^= np.roll(_bits([part[i][0] for i in pairs]), -1, axis=1)
        total += _summed(bits, np.array([votes[k] for k in part], np.int64))
    return _lanes(majority(total, sum(votes.values()))).tolist()


def _fingerprints(texts: pa.Array, tags: pa.Array) -> pa.Array:
    return pa.array([fingerprint_of(t, g) for t, g in zip(texts.to_pylist(), tags.to_pylist(), strict=True)], pa.list_(pa.int64()))


_fingerprints.__annotations__ = {"texts": pa.Array, "tags": pa.Array, "return": pa.Array}


def fingerprint(text: Column, tags: Column) -> Column:
    return F.arrow_udf(_fingerprints, returnType="array<bigint>")(text, tags)


def bundle(groups, key: list[str], vector: str = "vector"):
    """The majority vote of each group's vectors, in partial sums: a row of 2048 counts for each group and task at most."""
    counted = groups.select(*key, F.posexplode(F.array(*(F.get(vector, F.lit(lane)) for lane in range(LANES)))).alias("lane", "x"))
    bits = [F.sum(F.shiftrightunsigned("x", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)]
    sums = counted.groupBy(*key, "lane").agg(F.count("*").alias("n"), *bits)
    value = F.lit(0).cast("bigint")
    for b in range(64):
        tie = F.lit(b % 2 == 1)
        on = (F.col(f"b{b}") * 2 > F.col("n")) | ((F.col(f"b{b}") * 2 == F.col("n")) & tie)
        value = value.bitwiseOR(F.when(on, F.lit(1 << b if b < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    lanes = sums.select(*key, "lane", value.alias("value"))
    return lanes.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("lane", "value"))), lambda s: s["value"]).alias("vector"))
