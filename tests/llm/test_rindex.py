import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from remembrix.llm.rindex import RunLengthIndex


def brute(texts):
    suffixes = [(k, i, t[i:]) for k, t in enumerate(texts) for i in range(len(t))]

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    return {(k, i): max((common(s, z) for q, j, z in suffixes if (q, j) != (k, i)), default=0) for k, i, s in suffixes}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text("ab", max_size=25), st.sampled_from(["abcabcabcabcabc", "aaaaaaaaaaaaaaaaaaaa", "xabcabcabcabcabcy"])), max_size=6))
def test_matching_statistics(texts):
    texts = [t.encode() for t in texts]
    index = RunLengthIndex(texts)
    got = index.matching_statistics()
    for (k, i), length in brute(texts).items():
        assert got[index.starts[k] + i] == length, (texts, k, i)


def test_bytes_of_all_kinds():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(0, 256, 50, np.uint8)) for _ in range(5)]
    texts += [texts[0][10:40] + b"\x00\x00" + texts[3][:20], b"\x00" * 30, b""]
    index = RunLengthIndex(texts)
    got = index.matching_statistics()
    for (k, i), length in brute(texts).items():
        assert got[index.starts[k] + i] == length
