import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from remembrix.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
MODEL = bpe.WordBpe(PATH)
CASES = ["", " ", "Hello World's don't we'll!!'s", "<|endoftext|>a<|startoftext|>b <|ENDOFTEXT|>", "ΣΑΣ İx", "a\x1cb\x1f c", "é日本😀​ é", "x" * 500, "ab" * 400, "!" * 333, "1234567", "thequickbrownfox" * 40, " a　b\x85c", "ﬁ ½ ²", "a_b__c"]


def brute(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    ids = MODEL.encode(text)
    assert (ids, MODEL.decode(ids)) == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" abeinstr\n'.,!é0Σ<|"), st.characters(exclude_categories=["Cs", "Cn"], max_codepoint=0x2FFF)), max_size=60))
def test_any_text(text):
    assert MODEL.encode(text) == brute(text)[0]


@settings(max_examples=300, deadline=None)
@given(st.text("abeinorsthé", min_size=1, max_size=200), st.integers(1, 8))
def test_tree_is_exact_whatever_the_leaf(word, leaf):
    data = word.encode()
    symbols = [*(MODEL.inner[b] for b in data[:-1]), MODEL.last[data[-1]]]
    assert MODEL.encode_pieces([word], leaf)[0] == MODEL.merge(symbols) == MODEL._merge_long(symbols)


def test_long_unsplit_text():
    for text in ("the" * 20000, "a" * 30000):
        assert MODEL.encode(text) == brute(text)[0]


def test_query(spark, sf_dir):
    rows = bpe.op8_bpe(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids, decoded = brute(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))


def test_nulls_repeats_and_clashes(spark):
    df = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7), (None, None, None), (2, "", 0)], "doc_id long, text string, ids int")
    got = bpe.encode(df, PATH).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted([("1", brute("a b")[0])] * 2 + [("2", []), ("None", [])])
    assert bpe.encode(df.limit(0), PATH).collect() == []


def test_decoder(spark):
    texts = [None, "", "<|endoftext|>a<|startoftext|>b", "Hello World's", "é日本😀", "<|endoftext|>"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, decoded string")
    got = bpe.decode(bpe.encode(df, PATH), PATH).orderBy("doc_id").collect()
    assert [r.decoded for r in got] == [brute(t or "")[1] for t in texts]
    plain = spark.createDataFrame([(None,), ([],), (brute(texts[2])[0],)], "ids array<int>").coalesce(1)
    assert [r[0] for r in plain.select(bpe.decoder(PATH)("ids")).collect()] == ["", "", brute(texts[2])[1]]


def test_batch_and_what_is_kept(monkeypatch):
    texts = [*CASES, None, "x" * 70, "<|endoftext|><|endoftext|>", *CASES]
    expected = [brute(t or "")[0] for t in texts]

    def split(model):
        ids, counts = model.encode_batch(texts)
        ends = counts.cumsum()
        return [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)]

    model = bpe.WordBpe(PATH)
    assert split(model) == expected == split(model)
    monkeypatch.setattr(bpe, "KEPT", 8)  # forget before each batch
    assert split(model) == expected
    monkeypatch.undo()
    monkeypatch.setattr(bpe, "mixed", lambda x: x & bpe.np.uint64(15))  # hashes that collide
    assert split(bpe.WordBpe(PATH)) == expected
    assert bpe.WordBpe(PATH).encode_batch([])[1].tolist() == []


def test_decoding_of_slices():
    ids = [brute(t)[0] for t in CASES]
    array = bpe.pa.array([None, *ids], bpe.pa.list_(bpe.pa.int32()))
    model = bpe.WordBpe(PATH)
    assert [model.decode_batch(array.slice(i, 1))[0].as_py() or "" for i in range(len(array))] == ["", *(brute(t)[1] for t in CASES)]
