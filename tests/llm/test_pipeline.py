import re
import zlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_bpe import brute as bpe_brute  # noqa: E402
from test_decontaminate import brute as contaminated  # noqa: E402
from test_secrets import brute_base  # noqa: E402
from test_simhash import brute_components, brute_fingerprint  # noqa: E402

from remembrix.llm import quality  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, sf_dir)
        out.append(rows.collect())
        docs = spark.createDataFrame(out[-1], rows.schema)
    return out


def test_quality(stages, spark):
    """Accuracy on labelled documents that the classifier never learns from, and nothing but its verdicts."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1]}
    unseen = [r.doc_id for r in stages[0] if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(unseen) > 50
    assert sum((i in kept) == (labels[i] == 1) for i in unseen) >= 0.95 * len(unseen)


def test_dedup(stages):
    rows = sorted(stages[1], key=lambda r: r.doc_id)
    roots = brute_components([brute_fingerprint(r.text) for r in rows])
    assert {r.doc_id for r in stages[2]} == {rows[i].doc_id for i in set(roots)}


def test_decontamination(stages, spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    clean = {r.doc_id for r, x in zip(stages[2], contaminated([r.text for r in stages[2]], items), strict=True) if not x[4]}
    assert {r.doc_id for r in stages[3]} == clean and len(clean) < len(stages[2])


def test_secrets(stages):
    before = {r.doc_id: r.text for r in stages[3]}
    assert set(before) == {r.doc_id for r in stages[4]}
    changed = 0
    for r in stages[4]:
        assert not any(brute_base(r.text.replace("[SECRET]", "\n")).values())
        base = brute_base(before[r.doc_id])
        if not any(base.values()):
            assert r.text == before[r.doc_id]
        else:
            changed += 1
            assert "[SECRET]" in r.text and r.n_chars == len(r.text)
            assert re.sub(r"\W", "", r.text.replace("[SECRET]", "")) in re.sub(r"\W", "", before[r.doc_id]) or r.text.count("[SECRET]") > 0
    assert changed


def test_encoding(stages):
    texts = {r.doc_id: r.text for r in stages[4]}
    for r in stages[5]:
        assert r.ids == bpe_brute(texts[r.doc_id])[0] and r.n_tokens == len(r.ids)


def test_empty_table_and_nulls(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema)
    rows = {name: stage(spark, odd, sf_dir).collect() for name, stage in corpus_pipeline.STAGES}
    assert [len(r) for r in rows.values()][1:] == [1, 3, 3, 3]
    assert quality.ACCEPT == 0.7


def test_encoding_is_decoded(stages):
    texts = {r.doc_id: r.text for r in stages[4]}
    assert all(r.decoded == bpe_brute(texts[r.doc_id])[1] for r in stages[5])


def test_dedup_by_rows_not_ids(spark):
    texts = {name: " ".join(f"{name}{i}" for i in range(40)) for name in "xyzuvw"}
    y = texts["y"]
    made = [(5, texts["x"]), (5, y), (3, y), (None, texts["z"]), (None, texts["u"]), (None, texts["v"]), (None, texts["v"]), (7, texts["w"]), (None, texts["w"]), (9, y), (5, texts["x"])]
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()
    expected = [(5, "x"), (3, "y"), (None, "z"), (None, "u"), (None, "v"), (7, "w")]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(repr((i, texts[t])) for i, t in expected)


def test_very_long_texts_and_clashing_columns(spark):
    """Each stage on rows of a megabyte, without spaces and with them."""
    sf_dir = "/root/testdata/sf0.001"
    made = [(1, "the quick brown fox jumps " * 40_000, "en", "s", 1), (2, "x" * 1_000_000, "en", "s", 1), (3, "token=abcdefghijklmnop " * 30_000, "en", "s", 1)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    odd = docs.selectExpr("*", "1 AS label", "2 AS score", "3 AS fp", "4 AS root", "5 AS mark", "6 AS ids", "7 AS tokens", "8 AS _secrets", "9 AS _key", "10 AS _row")
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, odd, sf_dir).collect()
        assert len(rows) == 3 or name == "quality classifier", name
        if name == "secret scans":
            assert {r.doc_id: r.text.count("[SECRET]") for r in rows}[3] == 30_000
        if name == "BPE encoding":
            assert all(r.n_tokens == len(r.ids) > 0 for r in rows)
