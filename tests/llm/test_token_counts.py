import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from remembrix.llm import token_counts as tc

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
CASES = ["", " ", "  a  b ", "Hello  world", "<s> x</s> <unk>", "\n\n", "a\n b\n\nc\t", "▁▁x ▁", "é日本😀​", "ｆｕｌｌ", "aaaa" * 300, " " * 3000, "ab" * 2000, "x\n" * 50, "<0x0A>", "tab\tname\r\n", "\x00a"]


def brute(text):
    return len(MODEL.encode(text)) if text else 0


def ours(texts):
    v, _ = tc._vocabulary(PATH)
    split = [tc.pre_tokens(t) if t else [] for t in texts]
    return [int(v.count(words).sum()) for words in split]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert ours([text]) == [brute(text)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" abeinstr\n▁.,'é0"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    assert ours([text]) == [brute(text)]


@given(st.text("ab ▁en", min_size=1, max_size=80))
@settings(max_examples=100, deadline=None)
def test_queue_agrees_with_rounds(text):
    v, _ = tc._vocabulary(PATH)
    assert [v.count_long(text)] == v.count([text]).tolist()


def test_query(spark, sf_dir):
    rows = tc.op10_token_counts(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), brute(texts[r.doc_id]), brute(texts[r.doc_id]) > 4096)


def test_nulls_repeats_and_clashes(spark):
    df = spark.createDataFrame([(1, "a b", 7), (1, "a b", 7), (None, None, None), (2, "", 0)], "doc_id long, text string, n_tokens int")
    assert sorted((str(r.doc_id), r.n_tokens) for r in tc.count_tokens(df, PATH).collect()) == [("1", 2), ("1", 2), ("2", 0), ("None", 0)]
    assert tc.count_tokens(df.limit(0), PATH).collect() == []


def test_very_long_texts(spark):
    texts = ["x" * 300_000, "hello world " * 100_000, "é😀" * 50_000 + " a", " " * 200_000, "\n" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tc.count_tokens(df, PATH).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
