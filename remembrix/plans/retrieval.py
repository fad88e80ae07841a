"""Queries over retrieval: overlap, fusion, vectors, graph walks, consolidation, measures, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hyper, scoring, text
from ..operators import consolidation, evaluation, graph, lexical, lifecycle, nearest, ranking
from ..schema import AS_OF, EDGES_SQL, MEMORIES_SQL, edges, memories, table
from .recall import in_blocks, recall
from .records import _EFFECTIVE, QUERY_WORDS_SQL, WORDS_SQL, _effective
from .registry import query

M, G = f"WITH RECURSIVE {MEMORIES_SQL}", f"WITH RECURSIVE {EDGES_SQL}"


#: The rows that vector searches and graph walks ask for.
_ASKED = "{} % 50 = 0"


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items of the benchmark are the queries, with their whole text."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_LEXICAL_SQL = f"""{M},
live AS (SELECT * FROM mem WHERE superseded_by IS NULL),
qry AS (SELECT item_id AS query_id, text FROM benchmark),
terms AS (SELECT query_id, word, count(*) AS times FROM (SELECT query_id, unnest({QUERY_WORDS_SQL.format('text')}) AS word FROM qry) GROUP BY 1, 2),
post AS (SELECT DISTINCT id, word FROM (SELECT id, unnest({WORDS_SQL.format('text')}) AS word FROM live)),
wide AS (SELECT query_id, word, times, word AS variant, 0 AS ord FROM terms
  UNION ALL SELECT query_id, word, times, word[:-2], 1 FROM terms WHERE strlen(word) > 1 AND word[-1] = 's'
  UNION ALL SELECT query_id, word, times, word || 's', 2 FROM terms),
hits AS (SELECT DISTINCT query_id, w.word, times, id FROM wide w JOIN post p ON p.word = w.variant),
dfs AS (SELECT t.query_id, t.word, t.times, CAST(coalesce(max(h.n), 0) * t.times AS BIGINT) AS df FROM terms t LEFT JOIN (SELECT query_id, word, count(*) AS n FROM hits GROUP BY 1, 2) h ON h.query_id = t.query_id AND h.word = t.word GROUP BY 1, 2, 3),
idfs AS (SELECT *, ln(((SELECT count(*) FROM live) - df + 0.5) / (df + 0.5) + 1) AS idf FROM dfs),
total AS (SELECT query_id, sum(idf * times) AS total FROM idfs GROUP BY 1),
term AS (SELECT h.query_id, h.id, CASE WHEN max(total) >= 1e-6 THEN sum(i.idf * i.times) / max(total) ELSE 0 END AS term FROM hits h JOIN idfs i ON i.query_id = h.query_id AND i.word = h.word JOIN total t ON t.query_id = h.query_id GROUP BY 1, 2),
tagw AS (SELECT DISTINCT id, lower(unnest(tags)) AS word FROM live),
tag AS (SELECT query_id, id, CASE WHEN max(total) >= 1e-6 THEN sum(idf * times * 2.0) / max(total) ELSE 0 END AS tag FROM (SELECT DISTINCT w.query_id, w.word, w.times, t.id, i.idf, tt.total FROM wide w JOIN tagw t ON t.word = w.variant JOIN idfs i ON i.query_id = w.query_id AND i.word = w.word JOIN total tt ON tt.query_id = w.query_id) GROUP BY 1, 2)
"""


def _lexical(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    live = memories(spark, sf_dir).filter("superseded_by IS NULL")
    terms = lexical.query_terms(_queries(spark, sf_dir))
    # written out, as frequencies and overlaps are both made of them and the texts are long
    hits = graph.kept(lexical.term_hits(terms, lexical.postings(live)))
    return live, terms, hits, graph.kept(lexical.term_idf(terms, hits, live.agg(F.count("*")).scalar()))


@query(f"{_LEXICAL_SQL} SELECT query_id, word, times, df FROM dfs")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir)[3].select("query_id", "word", "times", "df")


@query(f"{_LEXICAL_SQL} SELECT query_id, word, round(idf, 6) AS idf FROM idfs")
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir)[3].select("query_id", "word", F.round("idf", 6).alias("idf"))


@query(f"{_LEXICAL_SQL} SELECT query_id, id, round(term, 6) AS term FROM term")
def term_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, hits, weights = _lexical(spark, sf_dir)
    return lexical.term_overlap(weights, hits).withColumn("term", F.round("term", 6))


@query(f"{_LEXICAL_SQL} SELECT query_id, id, round(tag, 6) AS tag FROM tag")
def tag_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, _, _, weights = _lexical(spark, sf_dir)
    return lexical.tag_overlap(weights, lexical.tag_words(live)).withColumn("tag", F.round("tag", 6))


@query(f"{_LEXICAL_SQL} SELECT q.query_id, CASE WHEN regexp_matches(lower(q.text), '{'|'.join(text.TEMPORAL_MARKERS)}') THEN 'temporal' WHEN coalesce(max(idf), 0) >= 4 THEN 'factual' ELSE 'general' END AS intent FROM qry q LEFT JOIN idfs i ON i.query_id = q.query_id GROUP BY q.query_id, q.text")
def intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _lexical(spark, sf_dir)[3].groupBy("query_id").agg(F.max("idf").alias("top"))
    return _queries(spark, sf_dir).join(top, "query_id", "left").select("query_id", scoring.intent(F.col("text"), F.coalesce("top", F.lit(0.0))).alias("intent"))


def minimum_slice_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and decay signals of each query's matches, fused, floored and cut to ten."""
    live, _, hits, weights = _lexical(spark, sf_dir)
    term, tag = lexical.term_overlap(weights, hits), lexical.tag_overlap(weights, lexical.tag_words(live))
    rows = live.select("id", "created_s", "token_count", F.round(_effective(), 9).alias("decay"))
    joined = term.join(tag, ["query_id", "id"], "left").join(rows, "id")
    joined = joined.withColumns({"term": F.round("term", 9), "tag": F.round(F.coalesce("tag", F.lit(0.0)), 9)})
    scored = ranking.fused(joined, ("term", "tag", "decay")).withColumn("score", F.round("score", 9))
    return ranking.first_k(ranking.floored(scored), 10, [F.desc("score"), F.desc("created_s"), F.col("id")])


_RRF = "CASE WHEN {0} > 0 THEN 1.0 / (60 + rank() OVER (PARTITION BY query_id ORDER BY {0} DESC) - 1) ELSE 0 END"
_FUSED_SQL = f"""{_LEXICAL_SQL}, sig AS (SELECT t.query_id, t.id, round(t.term, 9) AS term, round(coalesce(g.tag, 0), 9) AS tag, round({_EFFECTIVE}, 9) AS decay, created_s, token_count FROM term t LEFT JOIN tag g ON g.query_id = t.query_id AND g.id = t.id JOIN live l ON l.id = t.id),
fused AS (SELECT *, round({_RRF.format('term')} + 0.8 * {_RRF.format('tag')} + {_RRF.format('decay')} + CASE WHEN term > 0 THEN 0.02 ELSE 0 END, 9) AS score FROM sig),
floored AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM fused) WHERE top <= 0.01 OR score >= 0.25 * top)"""


@query(f"{_FUSED_SQL} SELECT query_id, id, token_count, round(score, 6) AS score FROM floored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_s DESC, id) <= 10")
def minimum_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimum_slice_frame(spark, sf_dir).select("query_id", "id", "token_count", F.round("score", 6).alias("score"))


@query(f"{_FUSED_SQL} SELECT query_id, id, score FROM fused")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, _, hits, weights = _lexical(spark, sf_dir)
    term, tag = lexical.term_overlap(weights, hits), lexical.tag_overlap(weights, lexical.tag_words(live))
    joined = term.join(tag, ["query_id", "id"], "left").join(live.select("id", F.round(_effective(), 9).alias("decay")), "id")
    joined = joined.withColumns({"term": F.round("term", 9), "tag": F.round(F.coalesce("tag", F.lit(0.0)), 9)})
    return ranking.fused(joined, ("term", "tag", "decay")).select("query_id", "id", F.round("score", 9).alias("score"))


@query("SELECT user_id, event_id, round(value, 6) AS value FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS top FROM events) WHERE top <= 0.01 OR value >= 0.25 * top")
def score_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.floored(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "value").withColumn("value", F.round("value", 6))


@query("SELECT event_id, round((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / greatest(count(*) OVER (PARTITION BY user_id) - 1, 1), 6) AS recency FROM events")
def recency_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(ranking.recency_rank("ts", "user_id", "event_id"), 6).alias("recency"))


@query("SELECT user_id, round(value - coalesce(nxt, 0), 6) AS margin FROM (SELECT user_id, value, lead(value) OVER w AS nxt, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id)) WHERE rn = 1")
def top_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    ranked = table(spark, sf_dir, "events").select("user_id", "value", F.lead("value").over(w).alias("next"), F.row_number().over(w).alias("rn"))
    return ranked.filter("rn = 1").select("user_id", F.round(F.col("value") - F.coalesce("next", F.lit(0.0)), 6).alias("margin"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type FROM events) QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.keep_first(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("event_id")]).select("user_id", "event_id")


@query("SELECT doc_id AS id FROM labels UNION SELECT doc_id FROM documents WHERE n_chars > 3000 UNION SELECT doc_id FROM documents WHERE lang = 'es'")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).union(docs.filter("n_chars > 3000").select("doc_id")).union(docs.filter("lang = 'es'").select("doc_id")).distinct()


@query(f"{M} SELECT id, round(len(list_intersect(tags, ['en', 'src1'])) / len(list_distinct(list_concat(tags, ['en', 'src1']))), 6) AS jaccard FROM mem")
def tag_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).select("id", F.round(text.jaccard(F.col("tags"), text.literals(("en", "src1"))), 6).alias("jaccard"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0)
SELECT query_id, vec_id, round(sim, 6) AS cosine FROM (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])), 9) AS sim FROM embeddings, q) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) <= 5""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").filter("vec_id IS NOT NULL").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = vectors.filter(_ASKED.format("id")).withColumnRenamed("id", "query_id")

    def best(part: DataFrame) -> DataFrame:
        found = nearest.by_cosine(part, vectors, 5)
        # minus infinity stands for not-a-number
        cosine = F.when(F.col("value") == float("-inf"), F.lit(float("nan"))).otherwise(F.round(0.0 - F.col("value"), 6))
        return ranking.first_k(found, 5, [F.col("value"), F.col("id")]).select("query_id", F.col("id").alias("vec_id"), cosine.alias("cosine"))

    return in_blocks(asked, best, nearest.MOST_QUERIES)


def _lanes_sql(token: str) -> str:
    return "[" + ", ".join(f"CAST('0x' || substr(md5({token} || '#{k}'), {at}, 16) AS UBIGINT)" for k in range(hyper.DIGESTS) for at in (1, 17)) + "]"


_HAMMING = "list_sum(list_transform(range(1, 33), lambda i: bit_count(xor({0}[i], {1}[i]))))"


@query(f"""WITH v AS MATERIALIZED (SELECT c_custkey, {_lanes_sql('c_name')} AS x FROM customer), q AS (SELECT c_custkey AS query_id, x AS y FROM v WHERE c_custkey % 50 = 0)
SELECT query_id, c_custkey, CAST(d AS BIGINT) AS distance FROM (SELECT query_id, c_custkey, {_HAMMING.format('x', 'y')} AS d FROM v, q) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, c_custkey) <= 5""")
def hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt out by rows, as the table is small and the work on a row is not
    customers = table(spark, sf_dir, "customer").filter("c_custkey IS NOT NULL").select(F.col("c_custkey").alias("id"), "c_name")
    named = lambda df: df.filter("c_name IS NOT NULL").select("id", hyper.of_token(F.col("c_name")).alias("vector"))
    rows = named(customers.repartition(4 * spark.sparkContext.defaultParallelism))
    asked = customers.filter(_ASKED.format("id"))
    # without a name there is no distance, which comes last
    nothing, first = F.lit(None).cast("double").alias("value"), customers.orderBy("id").limit(5).select("id")
    nameless = asked.filter("c_name IS NULL").select(F.col("id").alias("query_id")).join(F.broadcast(first), F.lit(True)).select("query_id", "id", nothing)
    last = customers.filter("c_name IS NULL").orderBy("id").limit(5).select("id")
    nameless = nameless.union(asked.filter("c_name IS NOT NULL").select(F.col("id").alias("query_id")).join(F.broadcast(last), F.lit(True)).select("query_id", "id", nothing))

    found = in_blocks(named(asked).withColumnRenamed("id", "query_id"), lambda part: nearest.by_hamming(part, rows, 5), nearest.MOST_QUERIES)
    return ranking.first_k(found.union(nameless), 5, [F.asc_nulls_last("value"), F.col("id")]).select("query_id", F.col("id").alias("c_custkey"), F.col("value").cast("bigint").alias("distance"))


def _hex(vector: F.Column) -> F.Column:
    return F.array_join(F.transform(vector, F.hex), ",")


_HEX_SQL = "array_to_string(list_transform({0}, lambda l: hex(l)), ',')"


@query(f"""WITH v AS MATERIALIZED (SELECT n_nationkey, {_lanes_sql('n_name')} AS x, {_lanes_sql("('r' || n_regionkey)")} AS y FROM nation),
z AS MATERIALIZED (SELECT *, list_transform(range(1, 33), lambda i: xor(x[i], y[i])) AS z, list_transform(range(1, 33), lambda i: (x[i] >> 1) | ((x[i % 32 + 1] & 1::UBIGINT) << 63)) AS p FROM v)
SELECT n_nationkey, {_HEX_SQL.format('z')} AS bound, {_HEX_SQL.format('p')} AS turned, CAST({_HAMMING.format('x', 'y')} AS BIGINT) AS bound_bits, CAST(list_sum(list_transform(x, lambda l: bit_count(l))) AS BIGINT) AS bits, {_HEX_SQL.format('x')} AS unbound FROM z""")
def bind_permute_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "nation").select("n_nationkey", hyper.of_token(F.col("n_name")).alias("x"), hyper.of_token(F.concat(F.lit("r"), "n_regionkey")).alias("y"))
    bound = v.withColumn("z", hyper.bind(F.col("x"), F.col("y")))
    return bound.select("n_nationkey", _hex(F.col("z")).alias("bound"), _hex(hyper.permute(F.col("x"))).alias("turned"), hyper.popcount(F.col("z")).cast("bigint").alias("bound_bits"), hyper.popcount(F.col("x")).cast("bigint").alias("bits"), _hex(hyper.bind(F.col("z"), F.col("y"))).alias("unbound"))


_BITS_SQL = "list_transform(range(0, 2048), lambda i: CAST((x[i // 64 + 1] >> CAST(i % 64 AS UBIGINT)) & 1 AS BIGINT))"


@query(f"""WITH v AS MATERIALIZED (SELECT n_regionkey, {_lanes_sql('n_name')} AS x FROM nation), b AS (SELECT n_regionkey, i, sum(bit) AS s, count(*) AS n FROM (SELECT n_regionkey, unnest(range(0, 2048)) AS i, unnest({_BITS_SQL}) AS bit FROM v) GROUP BY 1, 2),
lanes AS (SELECT n_regionkey, i // 64 AS lane, bit_or(CASE WHEN 2 * s > n OR (2 * s = n AND i % 2 = 1) THEN 1::UBIGINT << CAST(i % 64 AS UBIGINT) ELSE 0::UBIGINT END) AS x FROM b GROUP BY 1, 2)
SELECT n_regionkey, string_agg(hex(x), ',' ORDER BY lane) AS vector FROM lanes GROUP BY 1""")
def bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "nation").select("n_regionkey", hyper.of_token(F.col("n_name")).alias("vector"))
    return hyper.bundle(v, ["n_regionkey"]).select("n_regionkey", _hex(F.col("vector")).alias("vector"))


@query()
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", hyper.fingerprint(F.col("text"), F.array(F.lit("benchmark"))).alias("vector"))


@query(f"{G} SELECT src AS id, count(*) AS degree FROM edg GROUP BY 1")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree(edges(spark, sf_dir))


_ASKED_SQL = "(SELECT src FROM edg UNION SELECT dst FROM edg) t(s) WHERE s % 50 = 0"
_KHOP_SQL = f"""{G}, steps AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM edg UNION SELECT dst, src FROM edg),
seen AS (SELECT s AS query_id, s AS id, 0 AS depth FROM {_ASKED_SQL} UNION SELECT query_id, b, depth + 1 FROM seen JOIN steps ON a = id WHERE depth < 3),
local_ AS MATERIALIZED (SELECT query_id, id, min(depth) AS depth FROM seen GROUP BY 1, 2)"""


def _asked_nodes(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().filter(_ASKED.format("id")).select(F.col("id").alias("query_id"), "id")


@query(f"{_KHOP_SQL} SELECT CAST(query_id AS BIGINT) AS query_id, CAST(id AS BIGINT) AS id, CAST(depth AS BIGINT) AS depth FROM local_")
def k_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    whole = graph.packed(e)
    found = graph.packed_neighbourhood(whole, _asked_nodes(e)) if whole else graph.neighbourhood(e, _asked_nodes(e))
    return found.withColumn("depth", F.col("depth").cast("bigint"))


def _ppr_sql(rounds: int) -> str:
    parts = [
        f"""{_KHOP_SQL}, nodes AS MATERIALIZED (SELECT query_id, id, count(*) OVER (PARTITION BY query_id) AS k, CASE WHEN id = query_id THEN 1.0::DOUBLE ELSE 0 END AS s FROM local_),
arcs0 AS (SELECT x.query_id, a, b, sum(w) AS w FROM (SELECT src AS a, dst AS b, CASE kind WHEN 'caused_by' THEN 5.0::DOUBLE WHEN 'derived_from' THEN 4 WHEN 'supports' THEN 3 ELSE 1 END AS w FROM edg UNION ALL SELECT dst, src, CASE kind WHEN 'caused_by' THEN 2.5 WHEN 'derived_from' THEN 2 WHEN 'supports' THEN 1.5 ELSE 0.5 END FROM edg) e JOIN local_ x ON x.id = e.a JOIN local_ y ON y.id = e.b AND y.query_id = x.query_id GROUP BY 1, 2, 3),
arcs AS MATERIALIZED (SELECT query_id, a, b, w / sum(w) OVER (PARTITION BY query_id, a) AS w FROM arcs0),
r0 AS (SELECT query_id, id, s AS r FROM nodes)"""
    ]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT n.query_id, n.id, 0.15 * n.s + 0.85 * coalesce(m.m, 0) AS r FROM nodes n LEFT JOIN (SELECT r.query_id, b AS id, sum(r * w) AS m FROM r{i} r JOIN arcs ON arcs.query_id = r.query_id AND a = r.id GROUP BY 1, 2) m ON m.query_id = n.query_id AND m.id = n.id)")
    return ", ".join(parts) + f" SELECT CAST(query_id AS BIGINT) AS query_id, CAST(id AS BIGINT) AS id, round(r, 6) AS ppr FROM r{rounds} WHERE r > 1e-5"


@query(_ppr_sql(20))
def ppr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    whole = graph.packed(e)
    found = graph.packed_pagerank(whole, _asked_nodes(e)) if whole else graph.personalized_pagerank(e, _asked_nodes(e))
    return found.filter("ppr > 1e-5").select("query_id", "id", F.round("ppr", 6).alias("ppr"))


def _global_sql(rounds: int) -> str:
    parts = [
        f"""{G}, ids AS (SELECT src AS id FROM edg UNION SELECT dst FROM edg), nodes AS MATERIALIZED (SELECT id, CASE WHEN id % 50 = 0 THEN 1.0::DOUBLE / (SELECT count(*) FROM ids WHERE id % 50 = 0) ELSE 0 END AS s FROM ids),
arcs0 AS (SELECT a, b, sum(w) AS w FROM (SELECT src AS a, dst AS b, 1.0::DOUBLE AS w FROM edg UNION ALL SELECT dst, src, 0.5 FROM edg) GROUP BY 1, 2), arcs AS MATERIALIZED (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS w FROM arcs0), r0 AS (SELECT id, s AS r FROM nodes)"""
    ]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT n.id, 0.15 * n.s + 0.85 * coalesce(m, 0) AS r FROM nodes n LEFT JOIN (SELECT b AS id, sum(r * w) AS m FROM r{i} r JOIN arcs ON a = r.id GROUP BY 1) m ON m.id = n.id)")
    return ", ".join(parts) + f" SELECT CAST(id AS BIGINT) AS id, round(r, 6) AS ppr FROM r{rounds} WHERE r > 1e-5"


@query(_global_sql(20))
def global_ppr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    ranks = graph.global_pagerank(e, nodes, _asked_nodes(e).select("id"))
    return ranks.filter("ppr > 1e-5").select("id", F.round("ppr", 6).alias("ppr"))


def _walk_nodes(e: DataFrame) -> DataFrame:
    ids = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return ids.withColumn("active", F.col("id") % 5 != 0)


#: Nodes that a trajectory gives at most.
_WALKED = 5


@query(f"""{G}, steps AS (SELECT src AS a, dst AS b, seq FROM edg WHERE kind IN ('caused_by', 'before', 'derived_from')),
walk AS (SELECT s AS start, s AS id, 0 AS depth, CAST([] AS BIGINT[]) AS path FROM {_ASKED_SQL} UNION ALL SELECT start, b, depth + 1, list_append(path, -seq) FROM walk JOIN steps ON a = id),
first AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY start, id ORDER BY depth, path) = 1)
SELECT CAST(start AS BIGINT) AS start, CAST(id AS BIGINT) AS id, depth, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth, path, id) AS position FROM first WHERE id % 5 <> 0) WHERE position <= {_WALKED}""")
def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return graph.trajectory(e, _walk_nodes(e), _asked_nodes(e).select("id"), _WALKED)


@query()
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return graph.clusters(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind", "seq"), _walk_nodes(e), 10)


@query(f"{G} SELECT src, dst, kind FROM edg WHERE src % 5 <> 0 AND dst % 5 <> 0")
def vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return graph.vacuum(_walk_nodes(e), e)[1].select("src", "dst", "kind")


@query(f"{M} SELECT id, round(CASE WHEN kind = 'goal' THEN 1.0 ELSE (id % 100) / 100.0 * 0.5 * greatest(0.05, pow(0.5, 45 / 30.0)) END, 6) AS value FROM mem WHERE superseded_by IS NULL AND (kind = 'goal' OR (id % 100) / 100.0 * 0.5 * greatest(0.05, pow(0.5, 45 / 30.0)) > 1e-4)")
def activation_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = memories(spark, sf_dir).select("id", "kind", F.col("superseded_by").isNull().alias("active"))
    state = nodes.select("id", (F.col("id") % 100 / 100.0).alias("value"))
    return graph.decay_activation(state, F.lit(45), nodes).select("id", F.round("value", 6).alias("value"))


@query(f"{M} SELECT id, least(round((id % 100) / 100.0 + CASE WHEN id % 3 = 0 THEN 0.25 ELSE 0 END, 6), 1.0) AS value FROM mem")
def activation_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir)
    state = m.select("id", (F.col("id") % 100 / 100.0).alias("value"))
    return graph.spread_activation(state, m.filter("id % 3 = 0").select("id", F.lit(0.25).alias("ppr"))).select("id", F.round("value", 6).alias("value"))


@query(f"{G} SELECT DISTINCT src, dst FROM edg WHERE kind = 'caused_by' AND (src % 9 = 0 OR dst % 9 = 0)")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).filter("kind = 'caused_by'").withColumn("kind", F.lit("contradicts"))
    hits = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().filter("id % 9 = 0")
    return graph.contradictions(e, hits)


_LINKED = f"{M}, linked AS (SELECT x.id, y.id AS other, x.kind AS ka, y.kind AS kb, x.created_s AS ca, y.created_s AS cb FROM mem x JOIN mem y ON x.agent = y.agent AND x.id <> y.id AND len(list_intersect(x.tags, y.tags)) >= 2)"


@query(f"{_LINKED} SELECT m.id, (SELECT min(o.id) FROM mem o WHERE o.agent = m.agent AND list_sort(list_distinct(o.tags)) = list_sort(list_distinct(m.tags))) AS class_id, (SELECT count(*) FROM linked l WHERE l.id = m.id) AS linked FROM mem m")
def auto_link_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each memory's class (same agent and tags) and the number of those that share two tags with it."""
    return consolidation.linked(memories(spark, sf_dir)).select("id", "class_id", "linked")


@query(f"{_LINKED} SELECT m.id, (SELECT count(*) FROM linked l WHERE l.id = m.id AND ka = 'event' AND kb = 'event' AND ca < cb) AS before, (SELECT count(*) FROM linked l WHERE l.id = m.id AND ka = 'event' AND kb = 'event' AND ca > cb) AS after FROM mem m")
def temporal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many linked events each event comes before, and after."""
    return consolidation.linked(memories(spark, sf_dir)).select("id", "before", "after")


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'novel' WHEN value / 100 >= 0.85 THEN 'redundant' WHEN value / 100 >= 0.65 THEN 'reinforces' ELSE 'novel' END AS verdict FROM events")
def predict_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", consolidation.verdict(F.col("value") / 100, F.when(F.col("event_id") % 10 == 0, 1)).alias("verdict"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat = table(spark, sf_dir, "conversations")
    tags = F.array(F.concat(F.lit("role:"), "role"), F.lit("conversation"))
    return chat.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat_ws(": ", "role", "text").alias("text"), tags.alias("tags"), F.lit("event").alias("kind"), F.lit("routine").alias("salience"),
        F.concat(F.lit("a"), F.col("conv_id") % 8).alias("agent"), F.when(F.col("role") == "user", 0.4).otherwise(0.3).alias("importance"), (F.lit(AS_OF) - F.col("conv_id") * 3600 - F.col("turn") * 60).alias("created_s"),
        (F.lit(AS_OF) - F.col("conv_id") * 3600).alias("accessed_s"), F.lit(0).cast("bigint").alias("access_count"), F.lit(None).cast("bigint").alias("superseded_by"), text.token_estimate(F.col("text")).alias("token_count"), hyper.fingerprint(F.col("text"), tags).alias("vector"),
    )


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns with odd ids as a buffer, in the order of their time, and the others as what is there."""
    v = graph.kept(_vectors(spark, sf_dir).drop("text"))
    return v.filter("id % 2 = 1").withColumn("seq", F.col("created_s")).withColumn("supersedes", F.lit(None).cast("bigint")), v.filter("id % 2 = 0")


@query()
def consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidation.consolidate(*_halves(spark, sf_dir))


@query()
def consolidation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, known = _halves(spark, sf_dir)
    passed = consolidation.consolidate(new, known)
    novel = new.join(passed.filter("verdict = 'novel'").select("id"), "id", "left_semi")
    return consolidation.report(passed, totals=consolidation.link_totals(novel, known))


def _turn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat = table(spark, sf_dir, "conversations")
    ids = F.col("conv_id") * 1000 + F.col("turn")
    return chat.filter("turn > 0").select((ids - 1).alias("src"), ids.alias("dst"), F.lit("before").alias("kind"), F.col("turn").alias("seq"))


@query()
def recall_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = graph.kept(_queries(spark, sf_dir).select("query_id", "text", text.extract_tags(F.col("text")).alias("tags")))
    asked = tagged.select("query_id", "text", hyper.fingerprint(F.col("text"), F.col("tags")).alias("vector"))
    return recall(asked, _vectors(spark, sf_dir), _turn_edges(spark, sf_dir))


@query()
def mmr_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = minimum_slice_frame(spark, sf_dir).join(memories(spark, sf_dir).select("id", "tags", "kind"), "id")
    ready = best.withColumn("recency", ranking.recency_rank("created_s")).withColumn("fresh", F.col("kind") == "event")
    return ranking.pack(ready, ranking.Knobs(budget=1500))


_VERDICT_SQL = "CASE WHEN event_id % 50 = 0 THEN 'abstained' WHEN value / 1000 < 0.04 THEN 'low_confidence' WHEN event_id % 50 > 1 AND (event_id % 20) / 1000.0 < greatest(0.005, CASE event_type WHEN 'view' THEN 0.012 WHEN 'click' THEN 0.003 ELSE 0.005 END) THEN 'ambiguous_leader' WHEN (event_id % 7) / 10.0 < CASE event_type WHEN 'view' THEN 0.30 ELSE 0.0 END THEN 'unsupported_top' WHEN event_id % 7 <= 0 AND 0.0 < 0.0 THEN 'unsupported_top' ELSE 'confident' END"


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "view", "factual").when(F.col("event_type") == "click", "temporal").otherwise("general")
    return table(spark, sf_dir, "events").select("event_id", ranking.verdict(i % 50, F.col("value") / 1000, i % 20 / 1000.0, i % 7 / 10.0, F.lit(0.0), kind).alias("verdict"))


@query(f"SELECT event_id, {_VERDICT_SQL} AS verdict FROM events")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir)


@query(f"SELECT {_VERDICT_SQL} AS verdict, count(*) AS n FROM events GROUP BY 1")
def verdict_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, CAST(CASE {_VERDICT_SQL} WHEN 'confident' THEN CASE WHEN value / 1000 >= 0.09 AND (event_id % 20 / 1000.0 >= 0.015 OR event_id % 7 / 10.0 >= 0.5) THEN 1 ELSE 2 END WHEN 'low_confidence' THEN 0 WHEN 'ambiguous_leader' THEN 3 ELSE 0 END AS BIGINT) AS keep FROM events")
def truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, knobs = F.col("event_id"), ranking.Knobs(confident=2, ambiguous=3, solo_score=0.09, solo_margin=0.015)
    joined = _verdicts(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "value"), "event_id")
    return joined.select("event_id", ranking.keep_at_most(F.col("verdict"), F.col("value") / 1000, i % 20 / 1000.0, i % 7 / 10.0, knobs).cast("bigint").alias("keep"))


@query("SELECT source, count(text) AS lines, count(DISTINCT text) AS different, count(text) - count(DISTINCT text) AS repeats, round((count(text) - count(DISTINCT text)) / count(text), 6) AS rate FROM documents GROUP BY 1")
def dup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.duplicate_stats(table(spark, sf_dir, "documents"), "source", "text").withColumn("rate", F.round("rate", 6))


@query("SELECT event_type AS category, count(*) AS total, CAST(sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS percent FROM events GROUP BY 1 UNION ALL SELECT 'OVERALL', count(*), CAST(sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) AS BIGINT), round(sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) * 100.0 / count(*), 6) FROM events WHERE event_type <> 'error'")
def hit_rate_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), (F.col("value") >= 50).alias("hit"))
    return evaluation.by_category(rows, "category", "hit", ("error",)).withColumn("percent", F.round("percent", 6))


@query("SELECT event_type, round(list_sort(list(value))[least(CAST(floor(count(*) * 0.5) AS BIGINT), count(*) - 1) + 1], 6) AS p50, round(list_sort(list(value))[least(CAST(floor(count(*) * 0.95) AS BIGINT), count(*) - 1) + 1], 6) AS p95 FROM events GROUP BY 1")
def percentile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.index_percentiles(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})
    return found.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query("SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, round(list_sort(list(value))[count(*) // 2 + 1], 6) AS upper_median FROM events GROUP BY 1")
def percentile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.linear_percentile(table(spark, sf_dir, "events"), "event_type", "value", 0.95, "p95")
    middle = evaluation.index_percentiles(table(spark, sf_dir, "events"), "event_type", "value", {"upper_median": 0.5})
    return found.join(middle, "event_type").select("event_type", F.round("p95", 6).alias("p95"), F.round("upper_median", 6).alias("upper_median"))


@query("SELECT count(*) AS tasks, round(avg(s), 6) AS average_score, CAST(sum(t) AS BIGINT) AS total_tokens, round(avg(t), 6) AS average_tokens, round(sum(t) / nullif(count(*) FILTER (s >= 1), 0), 6) AS tokens_per_correct FROM (SELECT CASE WHEN contains(lower(d.text), 'the') THEN 1.0::DOUBLE ELSE 0.0 END AS s, greatest(CAST(floor(strlen(text) / 4) AS BIGINT), 1) AS t FROM documents d)")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(text.holds(F.lit(" The "), F.col("text")).alias("score"), text.token_estimate(F.col("text")).alias("tokens"))
    made = evaluation.summary(rows, "score", "tokens")
    return made.select("tasks", *(F.round(c, 6).alias(c) if c != "total_tokens" else F.col(c) for c in made.columns[1:]))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS found FROM documents")
def substring_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.holds(F.lit("License "), F.col("text")).alias("found"))


@query("SELECT position, round(avg(value) FILTER (mode = 'cold'), 6) AS cold, round(avg(value) FILTER (mode = 'primed'), 6) AS primed, round(avg(value) FILTER (mode = 'primed') - avg(value) FILTER (mode = 'cold'), 6) AS lift FROM (SELECT event_id % 5 AS position, CASE WHEN event_id % 2 = 0 THEN 'cold' ELSE 'primed' END AS mode, value FROM events) GROUP BY 1")
def lift_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 5).alias("position"), F.when(F.col("event_id") % 2 == 0, "cold").otherwise("primed").alias("mode"), "value")
    return evaluation.lift(rows, "position", "mode", "value", "cold", "primed").select("position", *(F.round(c, 6).alias(c) for c in ("cold", "primed", "lift")))


_BM25_SQL = f"""{_LEXICAL_SQL}, len AS (SELECT id, len({WORDS_SQL.format('text')}) AS n FROM live), tf AS (SELECT id, word, count(*) AS tf FROM (SELECT id, unnest({WORDS_SQL.format('text')}) AS word FROM live) GROUP BY 1, 2),
d AS (SELECT t.query_id, t.word, count(*) AS df FROM (SELECT DISTINCT query_id, word FROM terms) t JOIN tf ON tf.word = t.word GROUP BY 1, 2),
s AS (SELECT d.query_id, tf.id, round(sum(ln(((SELECT count(*) FROM live) - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / (SELECT avg(n) FROM len)))), 9) AS bm25 FROM d JOIN tf ON tf.word = d.word JOIN len ON len.id = tf.id GROUP BY 1, 2)
SELECT query_id, id, round(bm25, 6) AS bm25 FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) <= 10"""


@query(_BM25_SQL)
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older full-text index: BM25 over an inverted table, the best ten."""
    live = memories(spark, sf_dir).filter("superseded_by IS NULL").select("id", text.words(F.col("text")).alias("words"))
    asked = lexical.query_terms(_queries(spark, sf_dir)).select("query_id", "word")
    # one pass over the texts: how often each asked word stands in a memory, and all other words together
    wanted = asked.select("word").distinct().withColumn("asked", F.col("word"))
    counts = graph.kept(live.select("id", F.explode_outer("words").alias("word")).join(wanted, "word", "left").groupBy("id", F.col("asked").alias("word")).agg(F.count("word").alias("tf")))
    size = counts.groupBy("id").agg(F.sum("tf").alias("n"))
    n, mean = size.agg(F.count("*")).scalar(), size.agg(F.avg("n")).scalar()
    hits = counts.filter("word IS NOT NULL").join(asked, "word")
    df = hits.groupBy("query_id", "word").agg(F.count("*").alias("df"))
    part = scoring.idf(n, F.col("df")) * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("n") / mean))
    scored = hits.join(df, ["query_id", "word"]).join(size, "id").groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("bm25"))
    return ranking.first_k(scored, 10, [F.desc("bm25"), F.col("id")]).select("query_id", "id", F.round("bm25", 6).alias("bm25"))


@query("SELECT user_id, event_id AS evicted FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) > 20")
def streaming_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream of events pushes out of each user's buffer of twenty."""
    from ..streaming.buffer import evictions, run_to_table

    return run_to_table(evictions(_event_stream(spark, sf_dir).select("user_id", "event_id", "ts"), 20))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the reader takes folders and patterns
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


_FADE = "0.5::DOUBLE * greatest(0.05::DOUBLE, CASE WHEN o.u <= w.u THEN 1.0::DOUBLE ELSE pow(0.5::DOUBLE, (o.u - w.u) / 1e6::DOUBLE / 30.0::DOUBLE) END)"


@query(f"""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS u, value / 777 AS r, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, event_id, u, k, least(1.0::DOUBLE, r) AS v FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_id, o.u, o.k, least(1.0::DOUBLE, r + CASE WHEN v * {_FADE} > 1e-4 THEN v * {_FADE} ELSE 0 END) FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)
SELECT user_id, event_id, round(v, 6) AS value FROM w""")
def streaming_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node's activation after each of its ranks, from a stream of ranks."""
    from ..streaming.buffer import activation, run_to_table

    ranks = _event_stream(spark, sf_dir).select("user_id", "event_id", "ts", (F.col("value") / 777).alias("rank"))
    return run_to_table(activation(ranks)).select("user_id", "event_id", F.round("value", 6).alias("value"))


@query()
def streaming_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on a stream of turns against a history that is there."""
    from ..streaming.buffer import consolidate_batches, verdicts_into

    new, known = _halves(spark, sf_dir)
    folder = f"{graph.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    new.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(new.schema).parquet(f"{folder}/in")
    consolidate_batches(stream, verdicts_into(known, f"{folder}/out"), f"{folder}/state", available_now=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


@query("SELECT event_type AS category, count(*) AS tasks, count(j) AS judged, round(avg(s), 6) AS substring, round(avg(j), 6) AS judge, round(avg(j) - avg(s), 6) AS lift FROM (SELECT event_type, CASE WHEN value >= 50 THEN 1.0::DOUBLE ELSE 0.0 END AS s, CASE WHEN event_id % 7 = 0 THEN NULL WHEN value / 100 >= 0.75 THEN 1.0::DOUBLE WHEN value / 100 >= 0.25 THEN 0.5 ELSE 0.0 END AS j FROM events) GROUP BY 1")
def judge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged answers by category: every seventh event stands for an answer that is no JSON."""
    answer = F.when(F.col("event_id") % 7 == 0, "sorry").otherwise(F.concat(F.lit('Here: {"score": '), F.col("value") / 100, F.lit(', "reason": "r"} ok')))
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), F.when(F.col("value") >= 50, 1.0).otherwise(0.0).alias("substring"), text.judge_answer(answer)["score"].alias("judge"))
    return evaluation.judge_report(rows, "category", "substring", "judge").select("category", "tasks", "judged", *(F.round(c, 6).alias(c) for c in ("substring", "judge", "lift")))


_PICKED_SQL = f"{_FUSED_SQL}, picked AS (SELECT query_id, id, token_count, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_s DESC, id) - 1 AS pick FROM floored QUALIFY pick < 10)"


def _picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = minimum_slice_frame(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("created_s"), "id")) - 1
    return best.withColumn("pick", place).join(memories(spark, sf_dir).select("id", "text"), "id").select("query_id", "id", "pick", "text", "token_count", F.lit("confident").alias("verdict"))


@query(f"""{_PICKED_SQL}, cases AS (SELECT item_id AS query_id, 'c' || (item_id % 4) AS category, substr(text, 5, 30) AS gold, item_id % 9 = 0 AS expect_abstain FROM benchmark),
judged AS (SELECT c.query_id, c.category, c.expect_abstain, coalesce(bool_or(contains(lower(m.text), lower(trim(c.gold)))), false) AS hit, coalesce(bool_or(contains(lower(m.text), lower(trim(c.gold))) AND p.pick = 0), false) AS top, CAST(coalesce(sum(p.token_count), 0) AS BIGINT) AS tokens, count(p.id) = 0 AS none
  FROM cases c LEFT JOIN picked p ON p.query_id = c.query_id LEFT JOIN mem m ON m.id = p.id GROUP BY 1, 2, 3),
both_ AS (SELECT category, * EXCLUDE (category, query_id) FROM judged UNION ALL SELECT 'OVERALL', * EXCLUDE (category, query_id) FROM judged WHERE NOT expect_abstain)
SELECT category, count(*) AS cases, count(*) FILTER (hit AND NOT expect_abstain) AS hits, count(*) FILTER (top AND NOT expect_abstain) AS firsts, count(*) FILTER (expect_abstain AND none) AS abstained, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens) / nullif(count(*) FILTER (top AND NOT expect_abstain), 0), 6) AS tokens_per_first FROM both_ GROUP BY 1""")
def hit_and_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, first places and abstentions by category, of the lexical picks for items whose own words are the gold."""
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("c"), F.col("item_id") % 4).alias("category"), F.substring("text", 5, 30).alias("gold"), (F.col("item_id") % 9 == 0).alias("expect_abstain"))
    return evaluation.outcome_report(evaluation.outcomes(_picked(spark, sf_dir), cases)).withColumn("tokens_per_first", F.round("tokens_per_first", 6))


@query(f"{_PICKED_SQL} SELECT query_id, CAST(sum(token_count) AS BIGINT) AS used, (SELECT CAST(sum(token_count) AS BIGINT) FROM mem) AS naive, round(1 - sum(token_count) / (SELECT sum(token_count) FROM mem), 6) AS saved FROM picked GROUP BY 1")
def token_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.token_savings(_picked(spark, sf_dir), memories(spark, sf_dir)).withColumn("saved", F.round("saved", 6))


@query("SELECT user_id, event_id, event_type = 'error' AS taken FROM events")
def drain_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, rest = lifecycle.drain(table(spark, sf_dir, "events"), F.col("event_type") == "error")
    both = taken.withColumn("taken", F.lit(True)).unionByName(rest.withColumn("taken", F.lit(False)))
    return both.select("user_id", "event_id", "taken")


@query("SELECT doc_id, array_to_string(list_transform(range(1, len(t) + 1), lambda i: t[i] || '/' || CASE WHEN i = 1 AND doc_id % 2 = 0 THEN 'auto' ELSE 'user' END), ',') AS tags FROM (SELECT doc_id, [lang, source] AS t FROM documents)")
def tag_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags with their sources; a tag without one is the user's own."""
    docs = table(spark, sf_dir, "documents")
    sources = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("auto"))).otherwise(F.array().cast("array<string>"))
    pairs = text.tags_with_sources(F.array("lang", "source"), sources)
    return docs.select("doc_id", F.array_join(F.transform(pairs, lambda p: F.concat_ws("/", p["tag"], p["source"])), ",").alias("tags"))


@query(f"{M} SELECT id, CASE WHEN id % 6 = 0 THEN hex(CAST(id AS BIGINT)) ELSE hex(CAST(id * 3 AS BIGINT)) END AS vector FROM mem")
def update_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors replaced for some ids; unknown ones are ignored."""
    own = memories(spark, sf_dir).select("id", F.array(F.col("id") * 3).alias("vector"))
    new = own.filter("id % 6 = 0").select("id", F.array("id").alias("vector")).union(spark.createDataFrame([(-5, [1])], "id bigint, vector array<bigint>"))
    return lifecycle.update_vectors(own, new).select("id", _hex(F.col("vector")).alias("vector"))


_LEGACY_SQL = _global_sql(20).replace("round(r, 6) AS ppr FROM r20 WHERE r > 1e-5", "round(CASE WHEN id % 7 = 0 THEN 1.0 ELSE 0.3 END * (1 + 10 * r) * (0.5 + 0.5 * (id % 10) / 10.0), 6) AS score FROM r20")


@query(_LEGACY_SQL)
def legacy_recall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import legacy

    e = edges(spark, sf_dir)
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    ranks = graph.global_pagerank(e, nodes, _asked_nodes(e).select("id"))
    i = F.col("id")
    return ranks.select("id", F.round(legacy.recall_score(i % 7 == 0, F.col("ppr"), i % 10 / 10.0), 6).alias("score"))


@query()
def legacy_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import legacy

    e = edges(spark, sf_dir)
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return legacy.snapshot(nodes.select("id", (F.col("id") % 9 + 3).alias("words"), (F.col("id") % 10 / 10.0).alias("importance")), e, 200)
