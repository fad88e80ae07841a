import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from remembrix.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    sizes = {len(w) for w in windows}
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= {*range(k, k + n)}
                    found |= x - {None}
        ids = sorted(map(str, found))
        yield len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), 0 < len(hit) and 20 * len(hit) >= len(w)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    expected = dict(zip([d.doc_id for d in docs], brute([d.text for d in docs], items), strict=True))
    rows = dc.op6_decontaminate(spark, sf_dir).collect()
    got = {r.doc_id: tuple(r)[1:6] for r in rows}
    assert got == expected and len(rows) == len(docs)
    assert all((r.longest > 0) == (r.n_hit > 0) for r in rows)
    assert sum(x[4] for x in got.values())


EDGE = ["a b", None, "", "b", "x a B! c-a b", "A.b", "a b c d e f g h i j k l m n", "0 a b c d e f g h i j k l m 1", "é É b", "--"]


def test_blocks_nulls_repeats_and_clashes(spark):
    items = [(1, "a b"), (1, "c"), (None, "b"), (3, None), (4, "a b c d e f g h i j k l m n"), (5, ""), (6, "é b")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(EDGE + EDGE[:2])], "doc_id long, text string, items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = list(brute([r.text for r in docs.orderBy("doc_id").collect()], items))
    figures = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for limit in (dc.BLOCK_BYTES, 100):
        got = dc.judged(docs, bench, limit=limit).orderBy("doc_id").select(*figures).collect()
        assert list(map(tuple, got)) == expected
    assert dc.judged(docs.limit(0), bench).collect() == [] == dc.remove(docs.limit(0), bench).collect()
    assert [r.n_hit for r in dc.judged(docs, bench.limit(0)).collect()] == [0] * len(expected)
    odd = spark.createDataFrame([(None, "x b", 1), (None, "y z", 2), (3, None, 3), (3, "a b", 4), (3, "a b", 4), (3, "q", 5)], "doc_id long, text string, mark int")
    clean = sorted(r.mark for r in odd.collect() if not list(brute([r.text], items))[0][4])
    assert sorted(r.mark for r in dc.remove(odd, bench).collect()) == clean == [2, 3, 5]
    names = spark.createDataFrame([("k", "a b")], "doc_id string, text string")
    assert [r.doc_id for r in dc.judged(names, bench).collect()] == ["k"]


def brute_matches(texts, items):
    """Longest matches of a window or more that can't be longer on either side: text, place, item, place in it, words."""
    out = set()
    for d, t in enumerate(texts):
        w = words(t)
        for i, x in items:
            v = words(x)
            least = min(13, len(v))
            for p in range(len(w)):
                for a in range(len(v)):
                    if w[p] == v[a] and (not p or not a or w[p - 1] != v[a - 1]):
                        n = 0
                        while p + n < len(w) and a + n < len(v) and w[p + n] == v[a + n]:
                            n += 1
                        if n >= least:
                            out.add((d, p, i, a, n))
    return out


def found_matches(texts, items):
    import pyarrow as pa

    bench = dc.Benchmark(items)
    shard = dc.Shard.of(pa.array(texts, pa.string()))
    rows = zip(*(x.tolist() for x in shard.matches(bench)), strict=True)
    return {(d, p, name, a, n) for d, p, i, a, n in rows for name in bench.items[i]}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab .é", max_size=80), max_size=4), st.lists(st.text("ab .é", max_size=60), max_size=3))
def test_any(texts, items):
    items = [(str(i), t) for i, t in enumerate(items)]
    assert found_matches(texts, items) == brute_matches(texts, items)


def test_long_matches_and_copies():
    rng = np.random.default_rng(2)
    text = " ".join(f"w{i}" for i in rng.integers(0, 50, 400))
    items = [("one", text[300:900]), ("two", "w1 w2"), ("three", text[300:900])]
    texts = [text, None, text, "x " + text[500:800] + " y", " ".join(f"w{i}" for i in rng.integers(0, 50, 300))]
    got = found_matches(texts, items)
    assert got == brute_matches(texts, items)
    assert max(n for *_, n in got) > 100


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=40), max_size=4), st.integers(1, 20))
def test_suffix_array(rows, depth):
    flat = np.array([x for row in rows for x in (*row, 0)], np.int64)
    order = dc.suffix_array(flat, depth)
    upto = lambda i: flat[i : i + 1 + list(flat[i:]).index(0)][:depth].tolist()
    assert sorted(order.tolist()) == list(range(len(flat)))
    keys = [upto(i) for i in order.tolist()]
    assert keys == sorted(keys)


def test_very_long_text(spark):
    passage = " ".join(f"q{i}" for i in range(20))
    text = "a b c d e f g " * 300_000 + passage + " é" * 100_000
    docs = spark.createDataFrame([(1, text), (2, "x" * 3_000_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "z " + passage)], "item_id long, text string")
    rows = {r.doc_id: r for r in dc.judged(docs, bench).collect()}
    assert rows[1].n_hit == rows[1].longest == 20 and not rows[1].contaminated and rows[1].n_words == 2_100_020 + 100_000
    assert [tuple(m) for m in rows[1].matches] == [("7", 1, 2_100_000, 20)] and rows[2].n_words == 1
