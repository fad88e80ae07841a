"""Personal data: base patterns, and a semi-Markov conditional random field over segments.

The base patterns find what has a fixed form. The field scores whole candidate segments: their digit groups,
separators, check sums, ranges, surroundings and the word before; a segment of one of the kinds has at most
LONGEST tokens, anything else is a segment of one token. Boundaries and kinds are chosen jointly by dynamic
programming. What it adds overlaps no base span.

Only stretches of neighbouring words that hold a digit, an @ or a spelt-out "(at)" can hold a segment, so that
the rest of a text costs a pattern search. The field is trained on the driver on examples that training_rows()
makes from templates with a fixed seed, by stochastic gradient steps on the conditional likelihood; its weights
depend on no data.

Defined cases: null and empty texts have no spans; equal texts, equal values; whole texts of any length; only the
id and text columns are read.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_udf

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Tokens of a segment at most.
LONGEST = 16
BUCKETS = 1 << 13
_SIGN = re.compile(r"[0-9@]|\((?:at|AT)\)|\[(?:at|AT)\]")
_SPACE = re.compile(r"\s")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[\s\S]")
_CUES = {"call": "phone", "tel": "phone", "phone": "phone", "fax": "phone", "mobile": "phone", "card": "card", "visa": "card", "mastercard": "card", "credit": "card", "ip": "ip", "host": "ip", "server": "ip", "address": "ip", "mail": "email", "email": "email", "contact": "email", "order": "no", "isbn": "no", "version": "no", "page": "no", "section": "no", "invoice": "no", "hash": "no", "id": "no"}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the base patterns find, by start and kind."""
    out = []
    at = text.find("@")
    low = 0
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        low = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            low = m.end()
        at = text.find("@", low)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdecimal, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _bucket(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=4).digest(), "little") % BUCKETS


@cache
def _named(kind: int, name: object) -> int:
    return _bucket(kind, name)


def segment_features(tokens: list[str], i: int, j: int, cue: str) -> list[object]:
    """What the whole segment of tokens i to j is like, apart from its kind."""
    text = "".join(tokens[i:j])
    groups = [len(t) for t in tokens[i:j] if t[0].isdecimal()]
    digits = "".join(t for t in tokens[i:j] if t[0].isdecimal())
    marks = "".join(sorted({t for t in tokens[i:j] if not t[0].isalnum()}))
    n = len(digits)
    out: list[object] = [("marks", marks), ("groups", tuple(groups[:6])), ("digits", n), ("cue", cue), ("letters", any(t[0].isalpha() for t in tokens[i:j])), ("starts", text[0] if not text[0].isalnum() else text[0].isalpha())]
    before, after = tokens[i - 1] if i else " ", tokens[j] if j < len(tokens) else " "
    out += [("before", "a" if before[0].isalnum() else before[0]), ("after", "a" if after[0].isalnum() else after[0])]
    if "@" in text:
        local, _, domain = text.partition("@")
        out.append(("at", bool(local), "." in domain and domain.rpartition(".")[2].isalpha(), " " in text, text.count("@") == 1))
    if re.search(r"[(\[](?:at|AT)[)\]]", text):
        out.append(("spelt", "." in text.rpartition("]")[2] or "." in text.rpartition(")")[2]))
    if len(groups) == 4 and n <= 12:
        out.append(("octets", all(int(t) <= 255 for t in tokens[i:j] if t[0].isdecimal() and t.isascii())))
    if 12 <= n <= 19:
        out.append(("luhn", digits.isascii() and luhn(digits)))
    return out


def _may_start(token: str) -> bool:
    return token[0].isalnum() or token in "+("


class SegmentField:
    """Weights by (kind, feature); kind -1 is the outside."""

    def __init__(self) -> None:
        self.weights = np.zeros(BUCKETS)

    def candidates(self, tokens: list[str], cue: str) -> list[tuple[int, int, np.ndarray]]:
        """Segments (i, j, buckets by kind) that may be of a kind: they begin and end at a word, a number, + or (, and hold a digit or an at."""
        out = []
        for i, first in enumerate(tokens):
            if not _may_start(first) or (i and first[0].isalnum() and tokens[i - 1][0].isalnum()):
                continue
            for j in range(i + 3, min(len(tokens), i + LONGEST) + 1):
                if not tokens[j - 1][0].isalnum() or (j < len(tokens) and tokens[j][0].isalnum()):
                    continue
                names = segment_features(tokens, i, j, cue)
                out.append((i, j, np.array([[_named(k, f) for f in names] for k in range(len(KINDS))])))
        return out

    def best(self, tokens: list[str], cue: str) -> list[tuple[int, int, int]]:
        """Segments (i, kind, j) of the best segmentation."""
        score, came = [0.0] + [-math.inf] * len(tokens), [None] * (len(tokens) + 1)
        by_end: dict[int, list] = {}
        for i, j, buckets in self.candidates(tokens, cue):
            by_end.setdefault(j, []).append((i, buckets))
        for j in range(1, len(tokens) + 1):
            score[j] = score[j - 1]
            for i, buckets in by_end.get(j, ()):
                own = self.weights[buckets].sum(1)
                k = int(own.argmax())
                if score[i] + own[k] > score[j]:
                    score[j], came[j] = score[i] + float(own[k]), (i, k)
        out, j = [], len(tokens)
        while j:
            if came[j] is None:
                j -= 1
            else:
                i, k = came[j]
                out.append((i, k, j))
                j = i
        return out[::-1]

    def step(self, candidates: list, n: int, truth: set[tuple[int, int, int]], rate: float) -> None:
        """A gradient step on the likelihood of a segmentation, by the forward and backward sums."""
        by_end: dict[int, list] = {}
        by_start: dict[int, list] = {}
        for i, j, buckets in candidates:
            item = (i, j, buckets, self.weights[buckets].sum(1))
            by_end.setdefault(j, []).append(item)
            by_start.setdefault(i, []).append(item)
        ahead, back = np.zeros(n + 1), np.zeros(n + 1)
        for j in range(1, n + 1):
            ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[i] + s for i, _, _, own in by_end.get(j, ()) for s in own)])
        for i in range(n - 1, -1, -1):
            back[i] = np.logaddexp.reduce([back[i + 1], *(back[j] + s for _, j, _, own in by_start.get(i, ()) for s in own)])
        for items in by_end.values():
            for i, j, buckets, own in items:
                share = np.exp(np.minimum(0, ahead[i] + own + back[j] - ahead[n]))
                for k in range(len(KINDS)):
                    gradient = ((i, k, j) in truth) - share[k]
                    if abs(gradient) > 1e-4:
                        self.weights[buckets[k]] += rate * gradient


def training_rows(n: int = 700, seed: int = 17) -> Iterator[tuple[str, list[tuple[int, int, int]], str]]:
    """(stretch, segments (start, kind, end) in characters, cue): templates with random digits and names."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    w = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))
    octet = lambda: str(rng.randint(0, 255))

    def card(sep: str) -> str:
        body = d(15)
        whole = next(body + c for c in "0123456789" if luhn(body + c))
        return sep.join(whole[i : i + 4] for i in range(0, 16, 4))

    def bad_card(sep: str) -> str:
        body = d(15)
        whole = next(body + c for c in "0123456789" if not luhn(body + c))
        return sep.join(whole[i : i + 4] for i in range(0, 16, 4))

    made = {
        0: [lambda: f"{w()}.{d(2)}@{w()}{d(1)}.{w()}.com", lambda: f"{w()}@{w()}.org", lambda: f"{w()}{d(2)} (at) {w()}{d(1)}.com".replace(" (at) ", rng.choice(["(at)", "[at]"])), lambda: f"{w()}_{w()}@{w()}-{w()}.net"],
        1: [lambda: ".".join(octet() for _ in range(4)), lambda: " . ".join(octet() for _ in range(4)).replace(" . ", rng.choice([".", ".", ". "]))],
        2: [lambda: card(rng.choice(["", " ", "-", ".", "/"]))],
        3: [lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"+{d(2)} {d(3)} {d(4)} {d(3)}", lambda: f"{d(3)}.{d(3)}.{d(4)}"],
        -1: [lambda: d(rng.randint(1, 11)), lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: f"{rng.randint(1900, 2030)}-{d(2)}-{d(2)}", lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"${d(2)}.{d(2)}", lambda: bad_card(rng.choice([" ", "-", "", "."])), lambda: f"{w()}{d(2)}{w()}{d(3)}", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([18, 32, 40]))), lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"{w()}={d(3)}{w()}{d(2)}", lambda: f"{d(3)}.{d(3)}.{d(3)}.{d(3)}.{d(2)}", lambda: f"@{w()}", lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"AKIA{w().upper()}{d(2)}{w().upper()}"],
    }
    cues = {0: "email", 1: "ip", 2: "card", 3: "phone", -1: "no"}
    for _ in range(n):
        text, spans = "", []
        cue = ""
        for part in range(rng.choice([1, 1, 1, 2, 3])):
            kind = rng.choice([0, 1, 2, 3, -1, -1, -1])
            if not part:
                cue = cues[kind] if rng.random() < 0.3 else ""
            opening, closing = rng.choice([("", ""), ("", ""), ("", "."), ("<", ">"), ('"', '"'), ("", ",")])
            text += (" " if text else "") + opening
            piece = rng.choice(made[kind])()
            if kind >= 0:
                spans.append((len(text), kind, len(text) + len(piece)))
            text += piece + closing
        yield text, spans, cue


@cache
def trained(rounds: int = 6) -> SegmentField:
    field = SegmentField()
    rows = []
    for text, spans, cue in training_rows():
        tokens = _TOKEN.findall(text)
        starts = np.cumsum([0, *map(len, tokens)]).tolist()
        place = {s: i for i, s in enumerate(starts)}
        truth = {(place[a], k, place[b]) for a, k, b in spans if a in place and b in place}
        rows.append((field.candidates(tokens, cue), len(tokens), truth))
    rng = random.Random(1)
    for r in range(rounds):
        rng.shuffle(rows)
        for candidates, n, truth in rows:
            field.step(candidates, n, truth, 0.3 / (1 + r))
    field.weights = field.weights - 1e-9  # ties are outside
    return field


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of neighbouring words, one space between them, that hold a digit, an @ or a spelt-out at each.

    Each sign is widened to its word and the search goes on behind that, so that the whole is linear in the text.
    """
    begin = end = -1
    low = 0
    while m := _SIGN.search(text, low):
        a = m.start()
        while a > low and not text[a - 1].isspace():
            a -= 1
        space = _SPACE.search(text, m.end())
        low = space.start() if space else len(text)
        if begin >= 0 and a == end + 1 and text[end] == " ":
            end = low
        else:
            if begin >= 0:
                yield begin, end
            begin, end = a, low
    if begin >= 0:
        yield begin, end


def added_spans(text: str, base: list[tuple[int, int, int]], field: SegmentField) -> list[tuple[int, int, int]]:
    """What the field finds besides base spans."""
    out = []
    starts_taken = [a for a, _, _ in base]
    reach = list(itertools.accumulate((b for _, _, b in base), max))  # how far the spans up to each one go
    for a, b in stretches(text):
        stretch = text[a:b]
        if stretch.isalnum():  # one plain word or number has no inner boundary
            continue
        before = text[max(0, a - 24) : a].rstrip(" :#").rpartition(" ")[2].lower()
        tokens = _TOKEN.findall(stretch)
        starts = list(itertools.accumulate(map(len, tokens), initial=a))
        for i, k, j in field.best(tokens, _CUES.get(before, "")):
            n = bisect.bisect_left(starts_taken, starts[j])
            if not n or reach[n - 1] <= starts[i]:
                out.append((starts[i], k, starts[j]))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def finder(field: SegmentField):
    """A function on a text column: base and added spans (start, kind as an index of KINDS, end)."""
    weights = field.weights

    @text_udf("struct<base:array<struct<start:int,kind:int,end:int>>,added:array<struct<start:int,kind:int,end:int>>>")
    def find(texts: list[str | None]) -> list[dict]:
        own = SegmentField()
        own.weights = weights
        named = lambda spans: [{"start": a, "kind": k, "end": b} for a, k, b in spans]
        out = []
        for text in texts:
            base = base_spans(text) if text else []
            out.append({"base": named(base), "added": named(added_spans(text, base, own) if text else [])})
        return out

    return find


def find_personal_data(df: DataFrame, text: str = "text", out: str = "personal") -> DataFrame:
    """df with a struct out of base and added spans of each text; a column of that name is replaced."""
    return df.withColumn(out, finder(trained())(F.col(text)))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("personal.base", lambda s: s["kind"] == k)).cast("bigint")
    count = [number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    base, added = F.col("personal.base"), F.col("personal.added")
    return found.select("doc_id", *count, F.sha2(text(base), 256).alias("base_sha256"), text(F.concat(base, added)).alias("spans"), (F.size(base) + F.size(added)).cast("bigint").alias("n_spans"))
