"""Quality classifier: naive Bayes support vectors on hashed n-gram indicators.

Features of a text are the distinct hashes of its words, of pairs of neighbouring words, of one to three
neighbouring word shapes (letter case, digits, marks around it) and of repeats. An indicator is scaled by the
log ratio of its smoothed class counts; a linear hinge-loss model is fitted on them by dual coordinate descent,
and a logistic curve, fitted on folds of the training rows that their models haven't seen, turns margins into
scores.

At most SAMPLE labelled rows are used, those with the least hashes of their ids, and of these as many as have at most
SAMPLE_BYTES of features; this bounds what the driver holds. Rows whose crc32(doc_id) mod 4 is 2 are never learnt from. Labels, language, source and id are no inputs.

Defined cases: a null text is scored as an empty one, and an empty one by the intercept; repeated label rows
count once each, null labels or ids not at all; without both classes in the sample every score is the share of
label 1 (one half without rows); equal texts, equal scores; whole texts of any length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, text_udf
from .hashing import mixed, powers

BUCKETS = 1 << 18
#: Labelled rows that a fit takes at most, and bytes of their features.
SAMPLE, SAMPLE_BYTES = 4000, 256 << 20
ACCEPT = 0.7
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Classes of bytes in a word's shape: lower case, upper case, digit, mark, beyond ASCII.
_CLASS = np.full(256, 8, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 4, 16
_CLASS[_SPACE] = 0


def features(text: str | None) -> np.ndarray:
    """The distinct feature buckets of a text."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    inside = ~_SPACE[data]
    starts = np.nonzero(inside & ~np.r_[False, inside[:-1]])[0]
    if not len(starts):
        return np.zeros(0, np.int32)
    ends = np.nonzero(inside & ~np.r_[inside[1:], False])[0] + 1
    kept, owner = [], []
    step = 1 << 20
    words, shapes = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # words by about a million bytes, so that memory stays bounded
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + step, "right")))
        a, b = int(starts[at]), int(ends[to - 1])
        part = data[a:b]
        power, inverse = powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
        s, e = starts[at:to] - a, ends[at:to] - a
        words[at:to] = (sums[e] - sums[s]) * inverse[s]
        kinds = _CLASS[part]
        first, last = kinds[s], kinds[e - 1]
        shapes[at:to] = np.bitwise_or.reduceat(kinds, s).astype(np.uint64) | first.astype(np.uint64) << np.uint64(5) | last.astype(np.uint64) << np.uint64(10) | np.where(kinds[e - 1] == 8, part[e - 1], 0).astype(np.uint64) << np.uint64(16)
        at = to
    same = np.zeros(len(words), np.uint64)
    same[1:] = words[1:] == words[:-1]
    marks = shapes * np.uint64(2) + same
    for kind, grams in enumerate((words, _pairs(words), marks, _pairs(marks), _pairs(_pairs(marks), marks))):
        kept.append(mixed(grams * np.uint64(8) + np.uint64(kind)) & np.uint64(BUCKETS - 1))
        owner.append(kind)
    return np.unique(np.concatenate(kept)).astype(np.int32)


def _pairs(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    """Hashes of neighbours; with b, of a's pairs and the element of b after them."""
    after = a[1:] if b is None else b[2:]
    return mixed(a[: len(after)] * np.uint64(31)) + after


@dataclass(frozen=True)
class Model:
    """Weights by bucket, and the curve from margins to scores."""

    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> float:
        z = self.slope * self.margin(found) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum() / np.sqrt(max(1, len(found)))) + self.intercept


def log_ratios(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = []
    for label in (1, 0):
        held = [r for r, y in zip(rows, labels, strict=True) if y == label]
        c = np.bincount(np.concatenate(held), minlength=BUCKETS) if held else np.zeros(BUCKETS)
        counts.append((c + smooth) / (c.sum() + smooth * BUCKETS))
    return np.log(counts[0] / counts[1])


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = 1.0, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Weights and intercept of the L2-regularised hinge-loss model on the scaled indicators, classes weighted evenly."""
    if not len(rows):
        return np.zeros(BUCKETS), 0.0
    sign = np.where(labels == 1, 1.0, -1.0)
    limit = cost * np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    values = [scale[r] / np.sqrt(max(1, len(r))) for r in rows]
    norm = np.array([float(v @ v) + 1 for v in values])
    alpha, w, bias = np.zeros(len(rows)), np.zeros(BUCKETS), 0.0
    order = np.random.default_rng(7)
    for _ in range(rounds):
        change = 0.0
        for i in order.permutation(len(rows)):
            r, v = rows[i], values[i]
            gradient = sign[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), limit[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                w[r] += step * v
                bias += step
                alpha[i] = new
                change = max(change, abs(step))
        if change < 1e-3:
            break
    return w, bias


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """rows: feature buckets of each text; labels: 0 or 1."""
    share = float(labels.mean()) if len(labels) else 0.5
    if not 0 < share < 1:
        shift = np.log((share + 1e-6) / (1 - share + 1e-6))
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 1.0, float(shift))

    def one(train: np.ndarray) -> Model:
        sub, y = [rows[i] for i in train], labels[train]
        scale = log_ratios(sub, y)
        w, bias = dual_coordinate_descent(sub, y, scale)
        return Model((w * scale).astype(np.float32), bias, 1.0, 0.0)

    fold = np.arange(len(rows)) % 3
    margins = np.zeros(len(rows))
    for k in range(3):
        part = one(np.nonzero(fold != k)[0])
        for i in np.nonzero(fold == k)[0]:
            margins[i] = part.margin(rows[i])
    slope, shift = _logistic(margins, labels)
    whole = one(np.arange(len(rows)))
    return Model(whole.weights, whole.intercept, slope, shift)


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method, with targets that avoid 0 and 1."""
    n1 = labels.sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (len(labels) - n1 + 2))
    x = np.stack([margins, np.ones(len(margins))])
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(b @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (target - p) - 1e-6 * b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(b[0], 1e-3)), float(b[1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@text_udf("binary")
def packed_features(texts: list[str | None]) -> list[bytes]:
    return [features(t).tobytes() for t in texts]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most sample labelled rows that aren't held out."""
    chosen = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("label")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    # at most sample rows, so that any executor can hold them
    size = F.least(F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") * 10, F.lit(4 * BUCKETS))  # a word has two bytes at least, and five features of four
    found = docs.select("doc_id", F.xxhash64("text").alias("mark"), size.alias("size")).join(F.broadcast(chosen), "doc_id").distinct()
    order = [F.xxhash64("doc_id"), F.col("mark"), F.col("label"), F.col("doc_id")]
    kept = cut(found.orderBy(*order).limit(sample))
    # a window over sample rows of numbers at most
    kept = kept.withColumn("upto", F.sum("size").over(Window.orderBy(*order))).filter(F.col("upto") <= SAMPLE_BYTES).select("doc_id", "mark", "label")
    texts = docs.select("doc_id", "text").withColumn("mark", F.xxhash64("text")).join(F.broadcast(kept), ["doc_id", "mark"])
    got = texts.select("doc_id", "mark", "label", packed_features(F.col("text")).alias("f")).dropDuplicates(["doc_id", "mark", "label"]).collect()
    got = sorted(got, key=lambda r: (r.doc_id, r.mark, r.label))
    return fit([np.frombuffer(r.f, np.int32) for r in got], np.array([r.label for r in got], np.int64))


def scorer(spark: SparkSession, model: Model):
    """A function on a text column: its score under model, a fixed two megabytes that every executor gets."""
    held = spark.sparkContext.broadcast(model)

    @text_udf("double")
    def score(texts: list[str | None]) -> pa.Array:
        return pa.array([held.value.score(features(t)) for t in texts], pa.float64())

    return score


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = scorer(spark, train(docs, table(spark, sf_dir, "labels")))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))
