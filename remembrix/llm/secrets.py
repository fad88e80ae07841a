"""Secret scans: base patterns, and a battery of randomness tests with false-discovery control.

Everything is an expression on the text column. Positions come from splitting a text at a pattern: the lengths
of pieces and matches add up to starts and ends in code points.

Candidates of the battery are runs of SHORTEST or more letters, digits and +/_=- that overlap no base span. A
run's encoding is inferred from its characters (hex, base 32, 36, 62 or 64), and four tests measure how far it
is from uniform random text in that encoding: chi-squared over the letters of the alphabet, chi-squared over PARTS
equal parts of it, runs above and below its middle, and serial correlation of neighbours. Fisher's method joins
their p-values into one surprise, minus the logarithm of the joint p-value: small for random strings, large for words.

Whether a small surprise is a discovery depends on how often ordinary words have it. Runs of letters of one case
(a capital first letter apart) are the reference. The surprise of a random run doesn't grow with its length, that of a
word does, so that surprises are compared by SHORTEST characters. They are counted in bins by length class over the
whole column, and a candidate's p-value is the share of reference runs, of its length class or a shorter one, that
look as random. A Benjamini-Hochberg step-up over the candidates of each length class, on the bin counts, keeps
the share of false discoveries below RATE; short runs, whose words look random more often, thereby need more.
Counts are a table of fixed size; of it, one threshold for each length class reaches the driver.

Work and memory are linear in a text, or nearly so: running sums go over blocks of BLOCK elements, and what is
cut out of a text is cut out of pieces of PIECE characters.

Runs of digits alone are no candidates. Defined cases: null and empty texts have no spans; equal texts, equal
values; whole texts of any length; without reference runs, or without candidates, none is added; only the id and
text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Base kinds, in their order: pattern, and what a match must have.
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{16,}",
}
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = (*PATTERNS, "random")
SHORTEST = 16
RUN = f"[A-Za-z0-9+/_=-]{{{SHORTEST},}}"
REFERENCE = "^[A-Za-z][a-z]+$|^[A-Z]+$"
#: Upper lengths of the length classes.
CLASSES = (19, 23, 31, 47, 95)
RATE = 0.05
BINS, WIDTH = 200, 0.1
PARTS = 8
#: Encodings, the narrowest first: a run belongs to the first that has all of its characters.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_=+/",
}
#: Elements of a block for running values, and characters of a piece of a text.
BLOCK, PIECE = 64, 1024
_SPAN = "array<struct<start:int,kind:int,end:int,text:string>>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _before(values: Column, first: int, join: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of ints the join of first and those before it."""

    def spread(blocks: Column) -> Column:
        start = F.struct(F.lit(first).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda s, t: F.struct(join(s["at"], t).alias("at"), F.array_append(s["out"], s["at"]).cast("array<int>").alias("out"))
        # appends copy what is there: one for each block
        begins = F.aggregate(F.transform(blocks, lambda block: F.aggregate(block, F.lit(first), join)), start, step)["out"]
        return F.flatten(F.zip_with(blocks, begins, lambda block, begin: F.transform(block, lambda _, i: F.aggregate(F.slice(block, F.lit(1), i), begin, join))))

    def cut(values: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda k: F.slice(values, k * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(values) > 0, _let(blocks, spread)).otherwise(F.array().cast("array<int>"))

    return _let(values, cut)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """All matches of a pattern, with their places."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(pairs: Column) -> Column:
        whole = _before(F.transform(pairs, lambda p: F.length(p["piece"]) + F.length(p["found"])), 0, _plus)

        def span(pair: Column, at: Column) -> Column:
            begin = at + F.length(pair["piece"])
            return F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (begin + F.length(pair["found"])).alias("end"), pair["found"].alias("text"))

        return F.zip_with(pairs, whole, span)

    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, f: F.struct(p.alias("piece"), f.alias("found")))
    return F.when(text.rlike(pattern), _let(pairs, placed).cast(_SPAN)).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column, kind: str) -> Column:
    """The kind's matches that hold, left to right."""
    size = (lambda s: F.length(F.regexp_extract(s["text"], PATTERNS[kind], 2))) if kind == "assign" else lambda s: F.length(s["text"])
    return F.filter(_matches(text, kind, PATTERNS[kind]), lambda s: size(s) >= LEAST[kind])


def _normal_tail(z: Column) -> Column:
    """Minus the logarithm of the two-sided tail of a normal value, by a logistic curve."""
    return _let(F.abs(z), lambda z: F.log1p(F.exp(F.least(1.5976 * z + 0.07056 * z * z * z, F.lit(700.0)))) - F.log(F.lit(2.0)))


def _total(array: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + of(x))


def surprise(run: Column) -> Column:
    """Minus the logarithm of the joint p-value of the four tests, of a run against random text in its encoding."""
    alphabet = F.coalesce(*(F.when(F.translate(run, letters, "") == "", F.lit(letters)) for letters in ALPHABETS.values()), F.lit(ALPHABETS["base64url"]))
    # places in the alphabet, as a share of its size
    shares = lambda letters: F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: (F.position(c, letters) - 0.5) / F.length(letters))
    return _let(alphabet, lambda letters: _let(shares(letters), lambda v: _joint(v, F.length(letters).cast("double"))))


def _squares(v: Column) -> Column:
    """The sum of squares of how often each value stands in v."""
    start = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("times"), F.lit(0.0).alias("sum"))

    def step(s: Column, x: Column) -> Column:
        times = F.when(s["last"] == x, s["times"] + 1).otherwise(F.lit(1.0))
        return F.struct(x.alias("last"), times.alias("times"), (s["sum"] + 2 * times - 1).alias("sum"))

    return F.aggregate(F.array_sort(v), start, step)["sum"]


def _joint(v: Column, k: Column) -> Column:
    """v: places as shares of an alphabet of k letters."""
    n = F.size(v).cast("double")
    pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    # over letters, whose expected counts are small: by the statistic's own mean and variance
    p_letters = _normal_tail(F.greatest((_squares(v) * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n), F.lit(0.0)))
    # over parts: as many degrees of freedom as parts, less one
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda j: _total(v, lambda x: (F.floor(x * PARTS) == j).cast("double")) - n / PARTS)
    chi = _total(parts, lambda d: d * d) / (n / PARTS)
    ninth = 2 / (9 * (PARTS - 1))
    cube = (F.pow(chi / (PARTS - 1), F.lit(1 / 3)) - (1 - ninth)) / ninth**0.5  # about normal
    p_parts = _normal_tail(F.greatest(cube, F.lit(0.0)))
    constant = (n - 1) * F.log(F.lit(2.0))  # of a run that never changes sides
    high = _total(v, lambda x: (x >= 0.5).cast("double"))
    runs = 1 + _total(pairs, lambda p: ((p["a"] >= 0.5) != (p["b"] >= 0.5)).cast("double"))

    def by_runs(expected: Column) -> Column:
        spread = (expected - 1) * (expected - 2) / (n - 1)
        return F.when(expected > 2, _normal_tail((runs - expected) / F.sqrt(spread))).otherwise(constant)

    def by_mean(mean: Column) -> Column:
        return _let(_total(v, lambda x: (x - mean) * (x - mean)), lambda var: F.when(var > 0, _normal_tail((_total(pairs, lambda p: (p["a"] - mean) * (p["b"] - mean)) / var + 1 / n) * F.sqrt(n))).otherwise(constant))

    p_runs, p_serial = _let(_let(high, lambda h: 2 * h * (n - h) / n + 1), by_runs), _let(_total(v) / n, by_mean)
    return _let(p_letters + p_parts + p_runs + p_serial, lambda half: half - F.log1p(half + half * half / 2 + half * half * half / 6))


def _bin(run: Column) -> Column:
    return F.least(F.floor(surprise(run) * SHORTEST / F.length(run) / WIDTH), F.lit(BINS - 1)).cast("int")


def _class(run: Column) -> Column:
    out = F.lit(len(CLASSES))
    for k, most in reversed(list(enumerate(CLASSES))):
        out = F.when(F.length(run) <= most, k).otherwise(out)
    return out


_FAR = 2**31 - 1


def _runs(text: Column, base: Column) -> Column:
    """Runs that overlap no base span: in the order of starts, none that stands before ends behind a run's start, and none that comes next starts before its end."""
    runs = _matches(text, "random", RUN)

    def apart(spans: Column) -> Column:
        reach = _before(F.transform(spans, lambda s: F.when(s["kind"] < len(PATTERNS), s["end"]).otherwise(0)), 0, _most)
        later = F.reverse(_before(F.reverse(F.transform(spans, lambda s: F.when(s["kind"] < len(PATTERNS), s["start"]).otherwise(_FAR))), _FAR, _least))
        bounds = F.zip_with(reach, later, lambda r, n: F.struct(r.alias("reach"), n.alias("next")))
        free = F.zip_with(spans, bounds, lambda s, b: F.struct(s.alias("span"), ((s["kind"] == len(PATTERNS)) & (b["reach"] <= s["start"]) & (b["next"] >= s["end"])).alias("free")))
        return F.transform(F.filter(free, lambda x: x["free"]), lambda x: x["span"])

    return _let(runs, lambda runs: F.when((F.size(base) == 0) | (F.size(runs) == 0), runs).otherwise(_let(F.array_sort(F.concat(base, runs)), apart).cast(_SPAN)))


def _is_candidate(run: Column) -> Column:
    return ~run.rlike(REFERENCE) & ~run.rlike("^[0-9]+$")


def _scanned(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with a struct out of base spans and of the other runs."""
    base = F.array_sort(F.concat(*(base_spans(F.col(text), kind) for kind in PATTERNS)))
    return df.withColumn(out, _let(base, lambda base: F.struct(base.alias("base"), _runs(F.col(text), base).alias("runs"))))


def thresholds(df: DataFrame, text: str = "text") -> dict[int, int]:
    """For each length class the last bin that is a discovery; no entry: none is."""
    runs = _scanned(df.select(F.col(text).alias("text")), "text", "found").select(F.explode("found.runs.text").alias("run"))
    runs = runs.filter(F.col("run").rlike(REFERENCE) | _is_candidate(F.col("run")))
    counts = runs.groupBy(_class(F.col("run")).alias("class"), _bin(F.col("run")).alias("bin")).agg(
        F.count_if(F.col("run").rlike(REFERENCE)).alias("words"), F.count_if(_is_candidate(F.col("run"))).alias("candidates")
    )
    # every class and bin, so that those without words of their own take the shorter ones'
    grid = df.sparkSession.range(len(CLASSES) + 1).select(F.col("id").cast("int").alias("class"), F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"))
    full = grid.join(counts, ["class", "bin"], "left").fillna(0)
    by_class, by_bin = Window.partitionBy("bin").orderBy("class"), Window.partitionBy("class").orderBy("bin")
    full = full.withColumn("words", F.sum("words").over(by_class))
    whole = Window.partitionBy("class")
    full = full.select("class", "bin", F.sum("words").over(by_bin).alias("w"), F.sum("words").over(whole).alias("n"), F.sum("candidates").over(by_bin).alias("c"), F.sum("candidates").over(whole).alias("m"))
    good = full.filter((F.col("n") > 0) & (F.col("c") > 0) & ((F.col("w") + 1) / (F.col("n") + 1) <= RATE * F.col("c") / F.col("m")))
    return {r["class"]: r["bin"] for r in good.groupBy("class").agg(F.max("bin").alias("bin")).collect()}  # a row for each class at most


def find_secrets(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """df with an array out of spans (start, kind, end, text), base ones and added ones, by start and kind.

    kind is an index of KINDS; a column named out is replaced.
    """
    limits = thresholds(df, text)
    found = _scanned(df, text, out)
    if limits:
        most = F.create_map(*(F.lit(x) for item in sorted(limits.items()) for x in item))
        limit = lambda run: F.coalesce(F.try_element_at(most, _class(run)), F.lit(-1))
        added = F.filter(F.col(out)["runs"], lambda r: _is_candidate(r["text"]) & (_bin(r["text"]) <= limit(r["text"])))
    else:
        added = F.array().cast(_SPAN)
    return found.withColumn(out, F.array_sort(F.concat(F.col(out)["base"], added)))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each stretch that spans cover replaced. spans: by start."""

    def made(pieces: Column, reach: Column) -> Column:
        def part(a: Column, b: Column) -> Column:
            """Characters a to b, from the pieces that hold them."""
            first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
            own = lambda k: F.get(pieces, k)
            inside = F.concat(F.substring(own(first), a % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(own(last), F.lit(1), (b - 1) % PIECE + 1))
            return F.when(a >= b, F.lit("")).when(first == last, F.substring(own(first), a % PIECE + 1, b - a)).otherwise(inside)

        kept = F.zip_with(spans, reach, lambda s, r: F.when(s["start"] >= r, F.concat(part(r, s["start"]), F.lit(mask))).otherwise(""))
        return F.concat(F.array_join(kept, ""), part(F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    reach = _before(F.transform(spans, lambda s: s["end"]), 0, _most)
    return F.when(F.size(spans) == 0, text).otherwise(_let(pieces, lambda pieces: _let(reach, lambda reach: made(pieces, reach))))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] < len(PATTERNS))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, PATTERNS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def _places_sql(kind: str, pattern: str, keep: str) -> str:
    """Rows (doc_id, start, kind, end, run) of a pattern's matches."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, s AS start, {KINDS.index(kind)} AS kind, s + length(run) AS "end", run FROM (
      SELECT doc_id, m[i] AS run, CAST(list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
      FROM (SELECT doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}') AS m, regexp_split_to_array(text, '{quoted}') AS p FROM documents WHERE regexp_matches(text, '{quoted}')))) WHERE {keep}"""


def _sql() -> str:
    base = " UNION ALL ".join(_places_sql(k, p, f"length({f'''regexp_extract(run, '{p.replace(chr(39), chr(39) * 2)}', 2)''' if k == 'assign' else 'run'}) >= {LEAST[k]}") for k, p in PATTERNS.items())
    alphabet = " ".join(f"WHEN translate(run, '{a}', '') = '' THEN '{a}'" for a in ALPHABETS.values())
    classes = " ".join(f"WHEN length(run) <= {most} THEN {k}" for k, most in enumerate(CLASSES))
    tail = lambda z: f"(ln(1 + exp(least(1.5976 * abs({z}) + 0.07056 * abs({z}) * abs({z}) * abs({z}), 700))) - ln(2))"
    ninth = 2 / (9 * (PARTS - 1))
    text = lambda where: f"coalesce((SELECT string_agg(['assign', 'access', 'hex', 'random'][kind + 1] || ':' || start || ':' || \"end\", ',' ORDER BY start, kind) FROM spans s WHERE s.doc_id = d.doc_id{where}), '')"
    count = lambda k: f"(SELECT count(*) FROM base b WHERE b.doc_id = d.doc_id AND kind = {k})"
    return f"""
WITH base AS MATERIALIZED ({base}),
runs AS MATERIALIZED (SELECT *, CASE {classes} ELSE {len(CLASSES)} END AS class, regexp_matches(run, '{REFERENCE}') AS word, NOT regexp_matches(run, '{REFERENCE}') AND NOT regexp_matches(run, '^[0-9]+$') AS candidate, CASE {alphabet} ELSE '{ALPHABETS['base64url']}' END AS a
  FROM ({_places_sql('random', RUN, 'true')}) r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.start < r."end" AND r.start < b."end")),
v AS (SELECT *, list_transform(range(1, length(run) + 1), lambda i: (strpos(a, run[i]) - 0.5::DOUBLE) / length(a)) AS v, CAST(length(run) AS DOUBLE) AS n FROM runs WHERE word OR candidate),
m AS (SELECT *, list_sum(list_transform(range(0, {PARTS}), lambda k: pow(len(list_filter(v, lambda x: floor(x * {PARTS}) = k)) - n / {PARTS}, 2))) / (n / {PARTS}) AS chi, CAST(length(a) AS DOUBLE) AS k, list_sum(list_transform(list_distinct(v), lambda x: pow(len(list_filter(v, lambda y: y = x)), 2))) AS squares, CAST(len(list_filter(v, lambda x: x >= 0.5)) AS DOUBLE) AS high,
  1 + len(list_filter(range(1, len(v)), lambda i: (v[i] >= 0.5) <> (v[i + 1] >= 0.5))) AS r, list_sum(v) / n AS mean FROM v),
t AS (SELECT *, greatest((pow(chi / {PARTS - 1}, 1.0::DOUBLE / 3) - {1 - ninth!r}) / {ninth**0.5!r}, 0) AS cube, greatest((squares * k / n - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n), 0) AS z, 2 * high * (n - high) / n + 1 AS expected, list_sum(list_transform(v, lambda x: (x - mean) * (x - mean))) AS var, list_sum(list_transform(range(1, len(v)), lambda i: (v[i] - mean) * (v[i + 1] - mean))) AS cross_ FROM m),
h AS (SELECT *, {tail('z')} + {tail('cube')} + CASE WHEN expected > 2 THEN {tail('((r - expected) / sqrt((expected - 1) * (expected - 2) / (n - 1)))')} ELSE (n - 1) * ln(2) END + CASE WHEN var > 0 THEN {tail('((cross_ / var + 1 / n) * sqrt(n))')} ELSE (n - 1) * ln(2) END AS half FROM t),
binned AS MATERIALIZED (SELECT *, least(CAST(floor((half - ln(1 + half + half * half / 2 + half * half * half / 6)) * {SHORTEST} / n / {WIDTH}) AS BIGINT), {BINS - 1}) AS bin FROM h),
grid AS (SELECT c AS class, b AS bin FROM range(0, {len(CLASSES) + 1}) x(c), range(0, {BINS}) y(b)),
cum AS (SELECT g.class, g.bin, (SELECT count(*) FROM binned z WHERE z.word AND z.class <= g.class AND z.bin <= g.bin) AS w, (SELECT count(*) FROM binned z WHERE z.word AND z.class <= g.class) AS n, (SELECT count(*) FROM binned z WHERE z.candidate AND z.class = g.class AND z.bin <= g.bin) AS c, (SELECT count(*) FROM binned z WHERE z.candidate AND z.class = g.class) AS m FROM grid g),
most AS (SELECT class, max(bin) AS bin FROM cum WHERE n > 0 AND c > 0 AND (w + 1) / (n + 1) <= {RATE} * c / m GROUP BY 1),
spans AS (SELECT doc_id, start, kind, "end" FROM base UNION ALL SELECT z.doc_id, z.start, z.kind, z."end" FROM binned z JOIN most o ON o.class = z.class AND z.bin <= o.bin WHERE z.candidate)
SELECT doc_id, {count(0)} AS n_assign, {count(1)} AS n_access, {count(2)} AS n_hex, sha256({text(f' AND kind < {len(PATTERNS)}')}) AS base_sha256, {text('')} AS spans FROM documents d"""


#: The same rows in SQL; a table with equal ids on several rows is beyond it.
SQL = _sql()
