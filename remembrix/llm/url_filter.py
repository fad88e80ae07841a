"""URL filter: host and path rules, else logistic regression on hashed character n-grams.

The model is trained on the driver from a small labelled table, by default labelled_urls(), some 700 rows made from
lists of general words, so that its weights are the same at every size of the data. It knows the words of its table
and what looks like them; of other unwanted words it finds few, and what it doesn't know it allows.

Defined cases: a null url, or one without "://", has empty host and path and is scored like that; repeated rows
give repeated results; only the id and url columns are read. Rules are given as host and path in one string,
cut at the first slash; the longest that fits wins, and of equally long ones the first.
"""

from __future__ import annotations

import random
import string
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BUCKETS = 1 << 14
GRAMS = (3, 4, 5)
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Labelled rows that a model is trained from at most.
LABELLED = 10_000
#: Words of hosts for the default table, by what they stand for in general; none was taken from any table of this project.
UNWANTED = "poker roulette jackpot slots betting bookmaker lottery blackjack gambling viagra cialis pharmacy meds steroids weightloss slimming payday loans forex crypto mining doubler escort cams nude porn sexy hentai dating hookup replica rolex handbags outlet discount coupon giveaway prize warez torrent crack keygen serial hacked phishing malware popup banner adserver clicker affiliate leads backlinks seo traffic followers likes".split()
WANTED = "library museum news weather recipes university gardening theatre history football railway science school council hospital physics chemistry poetry novels maps travel hiking cycling painting music orchestra cinema astronomy geology biology language grammar translation archive journal magazine radio television bakery carpentry plumbing insurance bank post parliament court ministry embassy airport harbour bridge castle garden forest mountain river island village church monastery festival market kitchen furniture software compiler database network hardware robotics statistics algebra geometry medicine dentist nursing veterinary".split()
UNWANTED_PATHS = ("/buy-now", "/claim/prize", "/signup-bonus", "/xxx/1", "/go?aff=12", "/deal.php?id=3")
WANTED_PATHS = ("/en/12", "/fr/8", "/de/451.html", "/es/77/", "/about", "/en/930?page=2", "/", "/2019/05/report.pdf")
_SYLLABLES = "ba be do du fa go ha in jo ka le lo ma mi na no or pa pe ra ri sa so ta te ul va ve wo ze".split()


def labelled_urls(unwanted: Sequence[str] = UNWANTED, wanted: Sequence[str] = WANTED, seed: int = 11) -> list[tuple[str, int]]:
    """The default table of (url, 1 to block or 0): each word alone, with another one of its kind, or numbered, and invented names to allow.

    Domains, prefixes and half of the paths are the same for both kinds, so that it is the words that tell.
    """
    rng, out = random.Random(seed), []
    for words, paths, label in ((unwanted, UNWANTED_PATHS, 1), (wanted, WANTED_PATHS, 0)):
        for word in words:
            other = rng.choice(words)
            for name in (word, f"{word}-{other}", f"{other}{word}", f"{word}{rng.randint(1, 99)}"):
                path = rng.choice(paths if rng.random() < 0.5 else WANTED_PATHS)
                out.append((f"https://{rng.choice(('', 'www.', 'm.', 'blog.'))}{name}.{rng.choice(('com', 'org', 'net', 'info'))}{path}", label))
    for _ in range(2 * len(wanted)):
        name = rng.choice(("", "-")).join("".join(rng.choices(_SYLLABLES, k=rng.randint(2, 3))) for _ in range(rng.randint(1, 2)))
        out.append((f"https://{rng.choice(('', 'www.', 'm.', 'blog.'))}{name}.{rng.choice(('com', 'org', 'net', 'info'))}{rng.choice(WANTED_PATHS)}", 0))
    return out


def grams(host: str, path: str) -> np.ndarray:
    """Distinct buckets of the n-grams of host and of path."""
    found = set()
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            found.update(zlib.crc32(f"{kind}{text[i : i + n]}".encode("utf-8", "surrogatepass")) % BUCKETS for i in range(len(text) - n + 1))
    return np.fromiter(sorted(found), np.int64)


class UrlModel:
    """Weights of the logistic regression."""

    def __init__(self, rows: Sequence[tuple[str, int]], penalty: float = 1e-3, rounds: int = 300, rate: float = 2.0) -> None:
        found = [grams(*parts(url)) for url, _ in rows]
        y = np.array([label for _, label in rows], float)
        self.weights, self.shift = np.zeros(BUCKETS), 0.0
        if not rows:
            return
        flat, owner = np.concatenate(found), np.repeat(np.arange(len(found)), [len(f) for f in found])
        value = 1 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(found))))
        for _ in range(rounds):
            z = np.bincount(owner, weights=self.weights[flat], minlength=len(found)) * value + self.shift
            error = (1 / (1 + np.exp(-z)) - y) / len(y)
            self.weights -= rate * (np.bincount(flat, weights=(error * value)[owner], minlength=BUCKETS) * 10 + penalty * self.weights)
            self.shift -= rate * error.sum()

    def score(self, host: str, path: str) -> float:
        found = grams(host, path)
        z = self.weights[found].sum() / np.sqrt(max(1, len(found))) + self.shift
        return float(1 / (1 + np.exp(-z)))


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a url, as the columns have them."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    return host.translate({ord(c): c.lower() for c in string.ascii_uppercase}), rest[:end]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    which = verdict = F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: len(r[0])):
        of, slash, rest = text.partition("/")
        fits = ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(slash + rest))
        which, verdict = F.when(fits, text).otherwise(which), F.when(fits, decision).otherwise(verdict)
    return which, verdict


def _rows(labelled: DataFrame | Sequence[tuple[str, int]] | None) -> Sequence[tuple[str, int]]:
    if labelled is None:
        return labelled_urls()
    if not isinstance(labelled, DataFrame):
        return labelled
    rows = labelled.filter("url IS NOT NULL AND label IN (0, 1)").select("url", F.col("label").cast("int")).limit(LABELLED + 1).collect()
    if len(rows) > LABELLED:
        raise ValueError(f"the labelled table has more than {LABELLED} rows")
    return sorted(tuple(r) for r in rows)


def scorer(spark: SparkSession, model: UrlModel):
    held = spark.sparkContext.broadcast(model)  # a fixed number of weights

    def score_urls(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        keys = list(zip(hosts.to_pylist(), paths.to_pylist(), strict=True))
        scores = {k: held.value.score(*k) for k in set(keys)}
        return pa.array([scores[k] for k in keys], pa.float64())

    score_urls.__annotations__ = {"hosts": pa.Array, "paths": pa.Array, "return": pa.Array}
    return F.arrow_udf(score_urls, returnType="double")


def filter_urls(df: DataFrame, url: str = "url", key: str = "page_id", rules: Sequence[tuple[str, str]] = RULES, labelled: DataFrame | Sequence[tuple[str, int]] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score (to block) of each url. labelled: rows, or a table, of url and label (1 to block)."""
    score = scorer(df.sparkSession, UrlModel(_rows(labelled)))
    host, path = host_and_path(F.col(url))
    split = df.select(key, host.alias("host"), path.alias("path"))
    which, verdict = rule(F.col("host"), F.col("path"), rules)
    judged = split.withColumn("score", score("host", "path"))
    return judged.select(key, "host", "path", which.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
