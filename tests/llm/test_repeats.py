import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from remembrix.llm import repeats as rp


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - 199):
            seen[d[i : i + 200]] = seen.get(d[i : i + 200], 0) + 1
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(d)))
        yield len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(50)
    texts = [prose(rng.randint(5, 200)) for _ in range(12)]
    texts += [f"{prose(rng.randint(1, 30))} {passage} {prose(rng.randint(1, 30))}" for _ in range(30)]  # a passage with all kinds of neighbours
    near = prose(150)
    texts += [near[: (c := rng.randrange(900))] + "#" + near[c:] for _ in range(6)]
    texts += [texts[0], texts[0], "a" * 1000, "ab" * 300, "x" * 199, "x" * 200, "é" * 150, None, None, "", prose(40) + passage[:199], passage[3:203] + "!", near + near]
    return texts


def test_against_brute_force(spark):
    texts = corpus()
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    rows += [(0, texts[5], 1), (None, texts[6], 1), (None, texts[6], 1), (3, texts[3], 1)]  # repeated and null ids
    df = spark.createDataFrame(rows, "doc_id long, text string, i int")
    expected = sorted(str((i, *x)) for (i, _, _), x in zip(rows, brute([r[1] for r in rows]), strict=True))
    for crowd in (rp.CROWD, 4):
        assert sorted(str(tuple(r)) for r in rp.remove_repeats(df, crowd=crowd).collect()) == expected
    assert rp.remove_repeats(df.limit(0)).collect() == []


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    expected = {d.doc_id: x for d, x in zip(docs, brute([d.text for d in docs]), strict=True)}
    assert {r.doc_id: tuple(r)[1:] for r in rp.op4_repeats(spark, sf_dir).collect()} == expected
    assert sum(x[1] for x in expected.values())


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 700), max_size=4))
def test_contexts_hold_every_window_once(sizes):
    rng = np.random.default_rng(len(sizes))
    texts = [bytes(rng.integers(97, 100, n, np.uint8)) for n in sizes]
    owner, (a, c, d, i, n) = rp.contexts_of(texts)
    for k, t in enumerate(texts):
        own = owner == k
        alone = rp.contexts(np.frombuffer(t, np.uint8))
        for x, y in zip((a, c, d, i, n), alone, strict=True):
            assert np.array_equal(x[own], y)
        starts = [s for p, m in zip(i[own].tolist(), n[own].tolist(), strict=True) for s in range(p, p + m)]
        assert starts == list(range(max(0, len(t) - 199)))


def test_long_text_in_stretches(monkeypatch):
    """A text over the size of a stretch is cut with overlaps: each window once, with the anchor that it has anywhere."""
    rng = np.random.default_rng(3)
    text = rng.integers(97, 100, 5000).astype(np.uint8)
    whole = rp.contexts(text)
    anchor = {s: x for x, i, n in zip(whole[0].tolist(), whole[3].tolist(), whole[4].tolist(), strict=True) for s in range(i, i + n)}
    for size in (200, 333, 1000, 4999):
        monkeypatch.setattr(rp, "_CHUNK", size)
        a, _, _, i, n = rp.contexts(text)
        got = [(s, x) for x, p, m in zip(a.tolist(), i.tolist(), n.tolist(), strict=True) for s in range(p, p + m)]
        assert got == sorted(anchor.items())


def test_very_long_texts(spark):
    rng = random.Random(8)
    long_ = "".join(rng.choices("abcdefghij ", k=1_200_000))
    other = "".join(rng.choices("abcdefghij ", k=700_000))
    texts = [long_, other[:300_000] + long_[600_000:600_400] + other[300_000:], "q" * 600_000, long_[5:5000]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in rp.remove_repeats(df).collect()}
    assert got == {0: (1_200_000, 400 + 4995, 2), 1: (700_400, 400, 1), 2: (600_000, 600_000, 1), 3: (4995, 4995, 1)}


def test_many_equal_rows(spark):
    text = "".join(random.Random(1).choices("abcdefghij ", k=900))
    df = spark.range(3000).selectExpr("7L AS doc_id", f"'{text}' AS text")
    rows = rp.remove_repeats(df).collect()
    assert len(rows) == 3000 and {(r.n_removed, r.n_spans) for r in rows} == {(900, 1)}
