import random

import xxhash
from pyspark.sql import functions as F

from remembrix.llm import simhash as sh


def brute_fingerprint(text):
    out, word = [], ""
    for c in text or "":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c in " \t\n\v\f\r":
            out.append(word)
            word = ""
        else:
            word += c
    words = [w for w in [*out, word] if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {i: i for i in range(len(fps))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    fps = [brute_fingerprint(d.text) for d in docs]
    expected = {d.doc_id: (f"{f:016x}", docs[c].doc_id) for d, f, c in zip(docs, fps, brute_components(fps), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in sh.op7_simhash(spark, sf_dir).collect()} == expected


def test_crowded_keys_and_chains(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {b for b in base}
    for b in base[:3]:  # crowds and chains around a few
        at = b
        for _ in range(60):
            at ^= 1 << rng.randrange(64)
            fps.add(at)
            fps.add(b ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    fps = sorted(fps)
    nodes = spark.createDataFrame([(sh._signed(f),) for f in fps], "fp long")
    roots = {r.node: r.root for r in sh.components(sh.links(nodes)).collect()}
    groups = {}
    for f, c in zip(fps, brute_components(fps), strict=True):
        groups.setdefault(c, set()).add(sh._signed(f))
    got = {}
    for f in fps:
        got.setdefault(roots.get(sh._signed(f), sh._signed(f)), set()).add(sh._signed(f))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_nulls_repeats_and_clashes(spark):
    df = spark.createDataFrame([(3, "A b", 1), (3, "a B", 1), (None, "a\tb", 1), (9, None, 2), (8, " \n", 2), (None, "zz yy", 0)], "doc_id long, text string, fp int")
    got = sorted(str((r.doc_id, r.fp == 0, r.component_id)) for r in sh.near_duplicates(df).collect())
    assert got == ["(3, False, 3)", "(3, False, 3)", "(8, True, 8)", "(9, True, 8)", "(None, False, 3)", "(None, False, None)"]
    assert sh.near_duplicates(df.limit(0)).collect() == []
    assert df.select(sh.hexadecimal(F.lit(-1).cast("bigint")).alias("x")).first().x == "f" * 16


def test_very_long_texts(spark):
    texts = ["lorem ipsum dolor sit " * 100_000, "x" * 2_000_000, "lorem ipsum dolor sit " * 100_001, " \n" * 500_000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in sh.near_duplicates(df).collect()}
    assert [got[i].fp & (2**64 - 1) for i in range(5)] == [brute_fingerprint(t) for t in texts]
    assert [got[i].component_id for i in range(5)] == [0, 1, 0, 3, 3]


def test_rounds_of_a_long_chain(spark, monkeypatch):
    """Components of a path in the order of its names: rounds grow as the logarithm of its length, and planning stays quick."""
    written = []
    monkeypatch.setattr(sh, "cut", lambda df, cut=sh.cut: written.append(1) or cut(df))
    edges = spark.range(2000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    roots = sh.components(edges).collect()
    assert len(roots) == 2001 and len({r.root for r in roots}) == 1
    assert len(written) <= 1 + 4 * 14
