"""Token counts by rank-synchronous merging of ragged arrays.

A batch's distinct pre-tokens lie in one flat symbol array. In each round every sequence applies its own
lowest-rank pair (the leftmost one on ties) at the same time, by array operations over the whole batch;
sequences without a mergeable pair leave. What survives is counted: one for a vocabulary piece, a character
outside the vocabulary as its UTF-8 bytes.

Defined cases: a null or empty text has no tokens; texts of any length are counted whole, a pre-token of more
than LONG symbols (a run without any space) by a priority queue instead of rounds; equal texts count alike;
only the text column is read, so that further columns and their names don't matter.
"""

from __future__ import annotations

import functools
import heapq
import re

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, table, text_udf
from .ragged import Pairs, merge_ragged

SPACE = "▁"
#: Symbols from which on a pre-token is merged by a queue: rounds over it would cost its length squared.
LONG = 512
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]*")


class PieceVocabulary:
    """The pieces of a sentencepiece BPE model as arrays: symbol ids, and ranks of mergeable pairs."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                pieces[model.id_to_piece(i)] = model.get_score(i)
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece crosses a word boundary, so that words can't be counted alone")
        if any("\n" in p and len(p) > 1 for p in pieces):
            raise ValueError("a piece crosses a line feed, so that lines can't be counted alone")
        self.symbols = {s: i for i, s in enumerate(dict.fromkeys([*pieces, *(c for p in pieces for c in p)]))}
        #: Tokens that a symbol counts as when it survives.
        self.weight = np.array([1 if s in pieces else len(s.encode()) for s in self.symbols], np.int64)
        order = {score: rank for rank, score in enumerate(sorted(set(pieces.values()), reverse=True))}
        pairs = {}
        for piece, score in pieces.items():
            for cut in range(1, len(piece)):
                left, right = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = (order[score], self.symbols[piece])
        self.pairs, self.look = pairs, Pairs(pairs)

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        out = np.zeros(len(words), np.int64)
        short = []
        for i, word in enumerate(words):
            if len(word) > LONG:
                out[i] = self.count_long(word)
            elif word:
                short.append(i)
        if not short:
            return out
        flat = "".join(words[i] for i in short)
        get = self.symbols.get
        symbol = np.array([get(c, -1) for c in flat], np.int64)
        owner = np.repeat(np.array(short), [len(words[i]) for i in short])
        left, place = merge_ragged(symbol, owner, self.look)
        weight = self.weight[left]  # of a character that is in no piece, its bytes
        for j in np.nonzero(left < 0)[0].tolist():
            weight[j] = len(flat[place[j]].encode("utf-8", "surrogatepass"))
        out += np.bincount(owner[place], weights=weight, minlength=len(out)).astype(np.int64)
        return out

    def count_long(self, word: str) -> int:
        """The same by a priority queue over a linked list: for pre-tokens of any length."""
        symbol = [self.symbols.get(c, -1) for c in word]
        weight = [1 if s >= 0 and self.weight[s] == 1 else len(c.encode("utf-8", "surrogatepass")) for c, s in zip(word, symbol, strict=True)]
        before, after = list(range(-1, len(word) - 1)), [*range(1, len(word)), -1]
        queue: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and symbol[i] >= 0 and symbol[j] >= 0 and (hit := self.pairs.get((symbol[i], symbol[j]))):
                heapq.heappush(queue, (hit[0], i, symbol[i], symbol[j], hit[1]))

        for i in range(len(word) - 1):
            offer(i, i + 1)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if symbol[i] != left or j < 0 or symbol[j] != right:
                continue
            symbol[i], symbol[j], weight[i], weight[j] = new, -2, int(self.weight[new]), 0
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return sum(weight)


def pre_tokens(text: str) -> list[str]:
    """What sentencepiece would merge within: no piece holds a character before a space mark, or a line feed."""
    if "  " in text or SPACE in text or text[:1] == " ":
        text = SPACE + text.replace(" ", SPACE)
        return [part for line in re.split("(\n)", text) for part in _SEGMENT.findall(line) if part]
    return (SPACE + text.replace(" ", f" {SPACE}").replace("\n", " \n ")).split(" ")


@functools.cache
def _vocabulary(path: str) -> tuple[PieceVocabulary, Memo]:
    return PieceVocabulary(path), Memo()


def token_counter(path: str):
    """A function on a text column: its number of tokens under the sentencepiece BPE model at path (on each executor)."""

    @text_udf("bigint")
    def count_tokens(texts: list[str | None]) -> list[int]:
        vocabulary, memo = _vocabulary(path)
        split = [pre_tokens(text) if text else [] for text in texts]
        memo.room()
        new = memo.missing(set().union(*split))
        memo.update(zip(new, vocabulary.count(new).tolist(), strict=True))
        return [sum(map(memo.__getitem__, words)) for words in split]

    return count_tokens


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """df with the token count of each text; a column named out is replaced."""
    return df.withColumn(out, token_counter(path)(F.col(text)))


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


#: Tokens that a context of the usual size holds.
LIMIT = 4096


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", utf8_bytes(F.col("text")).alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
