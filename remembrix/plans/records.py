"""Queries over records: scans, filters, scopes, attributes, text functions, state changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attrs, scope, scoring, text
from ..operators import graph, lifecycle, ranking
from ..schema import AS_OF, EDGES_SQL, MEMORIES_SQL, edges, memories, table
from .registry import query

M, G = f"WITH {MEMORIES_SQL}", f"WITH {EDGES_SQL}"
READER = scope.Scope("src1", "u2", "s1")
WORDS_SQL = r"list_filter(list_transform(regexp_split_to_array({0}, '\s+'), lambda w: lower(regexp_replace(w, '[^\p{{L}}\p{{N}}_]', '', 'g'))), lambda w: w <> '')"


def in_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


QUERY_WORDS_SQL = "list_filter(" + WORDS_SQL + f", lambda w: strlen(w) >= 2 AND NOT list_contains({in_list(text.QUERY_STOPWORDS)}, w))"


@query(f"{M} SELECT id, kind, salience, importance, created_s, token_count, version FROM mem WHERE superseded_by IS NULL")
def active_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).filter("superseded_by IS NULL").select("id", "kind", "salience", "importance", "created_s", "token_count", "version")


@query(f"{M} SELECT id, agent FROM mem WHERE CASE WHEN agent <> 'src1' THEN list_contains(shared_with, 'src1') ELSE usr IS NULL OR (usr = 'u2' AND (session IS NULL OR session = 's1')) END")
def scope_can_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).filter(READER.can_read()).select("id", "agent")


@query(f"{M} SELECT id, kind FROM mem WHERE kind IN ('event', 'goal')")
def kind_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).filter(F.col("kind").isin("event", "goal")).select("id", "kind")


@query(f"{M} SELECT id, text FROM mem WHERE id = 42")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).filter("id = 42").select("id", "text")


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with attributes of each type; n is a text for every seventh."""
    docs = table(spark, sf_dir, "documents")
    n = F.when(F.col("doc_id") % 7 == 0, attrs.value("text", s=F.col("n_chars").cast("string"))).otherwise(attrs.value("number", n=F.col("n_chars")))
    held = F.map_from_arrays(F.array(*map(F.lit, ("n", "lang", "labels", "even"))), F.array(n, attrs.value("text", s=F.col("lang")), attrs.value("list", l=F.array("lang", "source")), attrs.value("bool", b=F.col("doc_id") % 2 == 0)))
    return docs.select("doc_id", held.alias("attributes"))


def _by_outcome(spark: SparkSession, sf_dir: str, key: str, f: attrs.Filter) -> DataFrame:
    return _attributed(spark, sf_dir).select("doc_id", attrs.outcome(F.col("attributes"), key, f).cast("int").alias("outcome"))


def _outcome_sql(right: str, holds: str) -> str:
    return f"SELECT doc_id, CAST(CASE WHEN NOT ({right}) THEN 2 WHEN {holds} THEN 1 ELSE 0 END AS INT) AS outcome FROM documents"


NUMBER = "doc_id % 7 <> 0"


@query(_outcome_sql("true", "lang = 'de'"))
def attr_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_outcome(spark, sf_dir, "lang", attrs.Eq("de"))


@query(_outcome_sql("true", "doc_id % 2 = 0"))
def attr_eq_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_outcome(spark, sf_dir, "even", attrs.Eq(True))


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 7 = 0 THEN 2 WHEN n_chars > 1000 THEN 1 ELSE 0 END AS INT) AS above, CAST(CASE WHEN doc_id % 7 = 0 THEN 2 WHEN n_chars < 2000 THEN 1 ELSE 0 END AS INT) AS below FROM documents")
def attr_gt_lt(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("attributes")
    return _attributed(spark, sf_dir).select("doc_id", attrs.outcome(a, "n", attrs.Gt(1000)).cast("int").alias("above"), attrs.outcome(a, "n", attrs.Lt(2000)).cast("int").alias("below"))


@query(_outcome_sql(NUMBER, "n_chars BETWEEN 500 AND 2500"))
def attr_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_outcome(spark, sf_dir, "n", attrs.Range(500, 2500))


@query(_outcome_sql("true", "lang = 'src3' OR source = 'src3'"))
def attr_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_outcome(spark, sf_dir, "labels", attrs.Contains("src3"))


@query(_outcome_sql("doc_id % 7 = 0", "contains(CAST(n_chars AS VARCHAR), '12')"))
def attr_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_outcome(spark, sf_dir, "n", attrs.Substring("12"))


@query("""SELECT doc_id,
  CAST(CASE WHEN doc_id % 7 = 0 THEN 2 WHEN NOT n_chars > 500 THEN 0 WHEN NOT n_chars < 3000 THEN 0 ELSE 1 END AS INT) AS every,
  CAST(CASE WHEN doc_id % 7 = 0 THEN CASE WHEN contains(CAST(n_chars AS VARCHAR), '1') THEN 1 ELSE 0 END WHEN n_chars > 3000 THEN 1 ELSE 0 END AS INT) AS some,
  CAST(1 AS INT) AS nothing_asked, CAST(0 AS INT) AS nothing_offered, CAST(0 AS INT) AS missing FROM documents""")
def attr_all_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, out = F.col("attributes"), lambda f, key="n": attrs.outcome(F.col("attributes"), key, f).cast("int")
    return _attributed(spark, sf_dir).select("doc_id", out(attrs.All((attrs.Gt(500), attrs.Lt(3000)))).alias("every"), out(attrs.Any((attrs.Substring("1"), attrs.Gt(3000)))).alias("some"), out(attrs.All(())).alias("nothing_asked"), out(attrs.Any(())).alias("nothing_offered"), attrs.outcome(a, "absent", attrs.Eq(1)).cast("int").alias("missing"))


_WANTED = {"n": attrs.Gt(1000), "lang": attrs.Gt(3)}


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'lang,n' ELSE 'lang' END AS keys FROM documents")
def attr_type_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(spark, sf_dir).select("doc_id", F.array_join(attrs.mismatched(F.col("attributes"), _WANTED), ",").alias("keys"))


@query("SELECT 'lang' AS key UNION SELECT 'n' FROM documents WHERE doc_id % 7 = 0")
def mismatch_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(spark, sf_dir).select(F.explode(attrs.mismatched(F.col("attributes"), _WANTED)).alias("key")).distinct()


@query("SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 AND n_chars > 1000 AND lang = 'en'")
def attr_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(spark, sf_dir).filter(attrs.matches(F.col("attributes"), {"n": attrs.Gt(1000), "lang": attrs.Eq("en")})).select("doc_id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) BETWEEN 10 AND 20")
def json_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "events").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'double')").alias("k"))
    return parsed.filter(F.col("k").between(10, 20))


@query("SELECT doc_id, greatest(CAST(floor(strlen(text) / 4) AS BIGINT), 1) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query(r"SELECT doc_id, CAST(ceil(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) * 13 / 10) AS BIGINT) AS tokens FROM documents")
def word_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, array_to_string({WORDS_SQL.format('text')}, ' ') AS words FROM documents")
def normalize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.words(F.col("text")), " ").alias("words"))


@query(f"SELECT item_id, array_to_string({QUERY_WORDS_SQL.format('text')}, ' ') AS words FROM benchmark")
def query_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.query_words(F.col("text")), " ").alias("words"))


@query(f"SELECT doc_id, CAST(len(list_distinct({WORDS_SQL.format('text')})) AS BIGINT) AS different FROM documents")
def word_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(text.words(F.col("text")))).cast("bigint").alias("different"))


@query(f"SELECT doc_id, list_has_any({WORDS_SQL.format('text')}, ['things', 'thing', 'thingss']) AS things, list_has_any({WORDS_SQL.format('text')}, ['tion', 'tions']) AS tion FROM documents")
def plural_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.has_term(words, F.lit("things")).alias("things"), text.has_term(words, F.lit("tion")).alias("tion"))


@query("SELECT doc_id, array_to_string(list_concat([upper(lang), source], list_filter(['en', 'zz', 'src1'], lambda t: NOT list_contains([lang, lower(source)], t))), ',') AS tags FROM documents")
def tag_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.array(F.upper("lang"), "source")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.merge_tags(own, text.literals(("en", "zz", "src1"))), ",").alias("tags"))


_CHAT = "SELECT conv_id, turn, 'We are Deploying the API and tested ' || text || ' for GitHub. Redis cache running!' AS text FROM conversations"


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("We are Deploying the API and tested "), "text", F.lit(" for GitHub. Redis cache running!")).alias("text"))


_KEYWORDS_SQL = rf"list_sort(list_filter({in_list(text.DOMAIN_KEYWORDS)}, lambda k: list_contains(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), k)))"
_NOUNS_SQL = rf"""list_sort(list_distinct(list_filter(list_transform(list_filter(range(1, len(t) + 1), lambda i: regexp_matches(t[i], '^[A-Z]') AND strlen(t[i]) >= 2 AND (i > 1 OR regexp_matches(t[i][2:], '[A-Z]') OR regexp_matches(coalesce(t[2], ''), '^[A-Z]'))),
  lambda i: lower(regexp_replace(t[i], '[^\p{{L}}\p{{N}}]', '', 'g'))), lambda w: strlen(w) >= 2 AND NOT list_contains({in_list(text.TAG_STOPWORDS)}, w))))"""
_TOKENS_SQL = r"list_filter(regexp_split_to_array(text, '[\s.,!?;:]+'), lambda t: t <> '')"
_STEMS_SQL = rf"""list_sort(list_distinct(list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda w: lower(regexp_replace(w, '[^A-Za-z]', '', 'g'))), lambda w: length(w) >= 5 AND regexp_matches(w, '(ing|ed)$')),
  lambda w: CASE WHEN length(regexp_replace(w, '(ing|ed)$', '')) >= 4 AND regexp_matches(regexp_replace(w, '(ing|ed)$', ''), '[^aeiou]$') AND regexp_replace(w, '(ing|ed)$', '')[-1] = regexp_replace(w, '(ing|ed)$', '')[-2] THEN regexp_replace(w, '(ing|ed)$', '')[:-2] ELSE regexp_replace(w, '(ing|ed)$', '') END),
  lambda s: length(s) >= 3 AND NOT list_contains({in_list(text.TAG_STOPWORDS)}, s))))"""


@query(f"SELECT conv_id, turn, array_to_string({_KEYWORDS_SQL}, ',') AS keywords FROM ({_CHAT})")
def domain_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chat(spark, sf_dir).select("conv_id", "turn", F.array_join(text.domain_keywords(F.col("text")), ",").alias("keywords"))


@query(f"SELECT conv_id, turn, array_to_string({_NOUNS_SQL}, ',') AS nouns FROM (SELECT conv_id, turn, {_TOKENS_SQL} AS t FROM ({_CHAT}))")
def proper_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chat(spark, sf_dir).select("conv_id", "turn", F.array_join(text.proper_nouns(F.col("text")), ",").alias("nouns"))


@query(f"SELECT conv_id, turn, array_to_string({_STEMS_SQL}, ',') AS stems FROM ({_CHAT})")
def verb_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chat(spark, sf_dir).select("conv_id", "turn", F.array_join(text.verb_stems(F.col("text")), ",").alias("stems"))


@query(f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_concat({_NOUNS_SQL}, {_KEYWORDS_SQL}, {_STEMS_SQL}))), ',') AS tags FROM (SELECT conv_id, turn, text, {_TOKENS_SQL} AS t FROM ({_CHAT}))")
def extract_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chat(spark, sf_dir).select("conv_id", "turn", F.array_join(text.extract_tags(F.col("text")), ",").alias("tags"))


@query(f"{M} SELECT id, agent || '|' || coalesce(usr, '') || '|' || coalesce(session, '') || CASE WHEN len(shared_with) > 0 THEN '|' || array_to_string(shared_with, ',') ELSE '' END AS key FROM mem")
def scope_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).select("id", scope.to_key(F.col("agent"), F.col("user"), F.col("session"), F.col("shared_with")).alias("key"))


@query(f"{M} SELECT id, agent, usr AS \"user\", session, CAST(len(shared_with) AS BIGINT) AS n_shared FROM mem")
def scope_from_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = scope_key(spark, sf_dir).withColumn("s", scope.from_key(F.col("key")))
    return keyed.select("id", "s.agent", "s.user", "s.session", F.size("s.shared_with").cast("bigint").alias("n_shared"))


@query(f"{M} SELECT id, '- ' || text || ' [' || array_to_string(tags, ', ') || ']' || chr(10) AS line FROM mem")
def render_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).select("id", text.render(F.col("text"), F.col("tags")).alias("line"))


@query("SELECT event_id, CASE lower(event_type) WHEN 'event' THEN 'event' ELSE 'fact' END AS kind, 'routine' AS salience, CAST(NULL AS VARCHAR) AS edge, 'supports' AS known_edge, 'preference' AS short FROM events")
def parse_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    return table(spark, sf_dir, "events").select("event_id", text.parse_kind(t).alias("kind"), text.parse_salience(t).alias("salience"), text.parse_edge(t).alias("edge"), text.parse_edge(F.lit("SUPPORTS")).alias("known_edge"), text.parse_kind(F.lit("Pref")).alias("short"))


_LIFE = "CASE kind WHEN 'decision' THEN 365.0 WHEN 'event' THEN 14.0 WHEN 'preference' THEN 30.0 WHEN 'goal' THEN 365.0 ELSE 90.0 END"
_EFFECTIVE = f"CASE WHEN salience = 'critical' THEN importance + 1 ELSE importance * pow(2.0, -(({AS_OF} - CASE WHEN kind IN ('preference', 'decision') THEN accessed_s ELSE created_s END) / 86400.0) / (CAST({_LIFE} AS DOUBLE) * CASE WHEN salience = 'important' THEN 3.0 ELSE 1.0 END)) * (1 + 0.1 * ln(1 + access_count)) END"


def _effective() -> F.Column:
    c = F.col
    return scoring.effective_importance(c("kind"), c("salience"), c("importance"), c("created_s"), c("accessed_s"), c("access_count"), F.lit(AS_OF))


@query(f"{M} SELECT id, round({_EFFECTIVE}, 6) AS effective FROM mem")
def effective_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).select("id", F.round(_effective(), 6).alias("effective"))


@query(f"{M} SELECT id, round(pow(2.0, -(({AS_OF} - created_s) / 86400.0) / CAST({_LIFE} AS DOUBLE)), 6) AS factor FROM mem")
def decay_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).select("id", F.round(scoring.decay_factor(F.col("kind"), scoring.days(F.col("created_s"), F.lit(AS_OF))), 6).alias("factor"))


@query(f"{M} SELECT id FROM mem WHERE {_EFFECTIVE} < 0.05")
def eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).filter(_effective() < 0.05).select("id")


@query("SELECT event_id, round(least(0.05, 0.05 / (1 + greatest(event_id * 1000, 1) / 3.6e6)), 6) AS boost FROM events")
def recency_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(scoring.recency_boost(F.col("event_id") * 1000), 6).alias("boost"))


@query(f"{M} SELECT id, round(log2(CAST(strlen(text) + list_sum(list_transform(tags, lambda t: strlen(t))) + 1 AS DOUBLE)) * 8, 6) AS bits FROM mem")
def description_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(spark, sf_dir).select("id", F.round(text.description_length(F.col("text"), F.col("tags")), 6).alias("bits"))


@query("SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE left(text, 500) || chr(10) || '[...]' || chr(10) || right(text, 500) END AS short FROM documents")
def context_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.head_and_tail(F.col("text"), 1000).alias("short"))


@query("SELECT event_id, CASE WHEN value / 100 >= 0.75 THEN 1.0::DOUBLE WHEN value / 100 >= 0.25 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS judged FROM events")
def judge_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.judged(F.col("value") / 100).alias("judged"))


@query("SELECT conv_id, turn, 'x1' AS agent, CAST(conv_id AS VARCHAR) AS \"user\", CAST(turn + 5 AS BIGINT) AS budget, CAST(100 AS BIGINT) AS bad FROM conversations")
def header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.dialogues import headers

    request = F.concat(F.lit("RECALL\r\nScope: agent=x1;user="), "conv_id", F.lit("\r\nBUDGET: "), F.col("turn") + 5, F.lit("\r\nLimit: many\r\n\r\nbody: "), F.col("role"))
    parsed = table(spark, sf_dir, "conversations").select("conv_id", "turn", headers(request).alias("h"))
    parts = F.str_to_map(F.col("h")["scope"], F.lit(";"), F.lit("="))
    number = lambda name, default: F.coalesce(F.expr(f"try_cast(h['{name}'] AS bigint)"), F.lit(default)).cast("bigint")
    return parsed.select("conv_id", "turn", F.try_element_at(parts, F.lit("agent")).alias("agent"), F.try_element_at(parts, F.lit("user")).alias("user"), number("budget", 1).alias("budget"), number("limit", 100).alias("bad"))


@query(f"{M}, {EDGES_SQL} SELECT count(*) AS total, count(superseded_by) AS superseded, CAST(sum(token_count) AS BIGINT) AS tokens, (SELECT count(*) FROM edg) AS edges, count(*) - count(superseded_by) AS active FROM mem")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.store_stats(memories(spark, sf_dir), edges(spark, sf_dir))


@query(f"{M}, {EDGES_SQL} SELECT count(*) AS total, count(superseded_by) AS superseded, CAST(sum(token_count) AS BIGINT) AS tokens, (SELECT count(*) FROM edg) AS edges, count(*) - count(superseded_by) AS active, (SELECT count(*) FROM conversations) AS buffer_size, CAST(1024 AS BIGINT) AS buffer_capacity FROM mem")
def engine_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.engine_stats(memories(spark, sf_dir), edges(spark, sf_dir), table(spark, sf_dir, "conversations"), 1024)


def _log_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("doc_id % 10 = 3").select(F.col("doc_id").alias("old"), (F.col("doc_id") + 2).alias("new"))


@query(f"{M} SELECT id, coalesce(CASE WHEN id % 10 = 3 THEN id + 2 ELSE superseded_by END, -1) AS superseded_by FROM mem")
def supersede_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.supersede(memories(spark, sf_dir), _log_pairs(spark, sf_dir)).select("id", F.coalesce("superseded_by", F.lit(-1)).alias("superseded_by"))


@query("SELECT doc_id + 2 AS src, doc_id AS dst, 'supersedes' AS kind FROM documents WHERE doc_id % 10 = 3")
def supersede_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.supersede_edges(_log_pairs(spark, sf_dir))


@query(f"{M} SELECT id FROM mem WHERE superseded_by IS NULL AND id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def forget_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return lifecycle.forget(memories(spark, sf_dir), gone).filter("superseded_by IS NULL").select("id")


@query(f"{G} SELECT src, dst, kind FROM edg WHERE src % 10 <> 0 AND dst % 10 <> 0")
def forget_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    ids = e.select(F.col("src").alias("id")).union(e.select("dst"))
    return lifecycle.forget_hard(ids, e, ids.filter("id % 10 = 0"))[1].select("src", "dst", "kind")


@query(f"{M} SELECT id, coalesce(CASE WHEN id % 100 = 7 THEN (SELECT max(id) + 1 FROM mem) ELSE superseded_by END, -1) AS superseded_by FROM mem UNION ALL SELECT max(id) + 1, -1 FROM mem")
def merge_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir).select("id", "superseded_by")
    new = m.agg((F.max("id") + 1).alias("id"), F.lit(None).cast("bigint").alias("superseded_by"))
    return lifecycle.merge(m, new, m.filter("id % 100 = 7").select("id")).select("id", F.coalesce("superseded_by", F.lit(-1)).alias("superseded_by"))


@query(f"{M} SELECT id, array_to_string(CASE WHEN id % 4 = 1 THEN list_concat(tags, CASE WHEN tags[1] = 'en' THEN ['new'] ELSE ['en', 'new'] END) ELSE tags END, ',') AS tags FROM mem")
def reconsolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir)
    changes = m.filter("id % 4 = 1").select("id", F.array(F.lit("en"), F.lit("new")).alias("new_tags"))
    return lifecycle.reconsolidate(m, changes).select("id", F.array_join("tags", ",").alias("tags"))


@query(f"{M} SELECT id, access_count + CASE WHEN id % 5 = 0 THEN 2 ELSE 0 END AS access_count, CASE WHEN id % 5 = 0 THEN {AS_OF} ELSE accessed_s END AS accessed_s FROM mem")
def touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir)
    hits = m.filter("id % 5 = 0").select("id")
    return lifecycle.touch(m, hits.union(hits), AS_OF).select("id", "access_count", F.col("accessed_s").cast("bigint").alias("accessed_s"))


@query(f"""{M}, both_ AS (SELECT id, version, accessed_s, importance, 1 AS here FROM mem UNION ALL SELECT id, 1 + (id + 1) % 3, accessed_s + (id % 2) * 60, 9.0, 0 FROM mem WHERE id % 2 = 0 OR id % 3 = 0)
SELECT id, version, accessed_s, importance FROM both_ QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, accessed_s DESC, here DESC) = 1""")
def lww_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = memories(spark, sf_dir).select("id", "version", "accessed_s", "importance")
    remote = m.filter("id % 2 = 0 OR id % 3 = 0").select("id", (1 + (F.col("id") + 1) % 3).alias("version"), (F.col("accessed_s") + F.col("id") % 2 * 60).alias("accessed_s"), F.lit(9.0).alias("importance"))
    return lifecycle.last_write_wins(m, remote)


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def buffer_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("id"))
    return lifecycle.bounded_buffer(held, 5, "user_id", "ts")[0].select("user_id", F.col("id").alias("event_id"))


@query("SELECT user_id, max(event_id) AS event_id FROM (SELECT user_id, event_id, ts FROM events) WHERE false GROUP BY 1 UNION ALL SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.keep_first(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query("SELECT conv_id, turn, role || ': ' || text AS memory, 'role:' || role || ',conversation' AS tags, CASE WHEN role = 'user' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END AS importance, CAST(conv_id AS VARCHAR) AS \"user\" FROM conversations")
def conversation_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.dialogues import as_memories

    made = as_memories(table(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("role"), F.col("text"))
    return made.select("conv_id", "turn", "memory", F.array_join("tags", ",").alias("tags"), "importance", "user")


@query(f"{G} SELECT src, dst, kind FROM edg WHERE kind IN ('supports', 'relates_to', 'derived_from', 'caused_by')")
def edges_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.unique_edges(edges(spark, sf_dir)).select("src", "dst", "kind")


@query("SELECT l_orderkey AS src, l_partkey AS dst, 'supports' AS kind, CAST(min(l_linenumber) AS BIGINT) AS seq FROM lineitem GROUP BY 1, 2")
def edge_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("supports").alias("kind"), F.col("l_linenumber").cast("bigint").alias("seq"))
    return graph.unique_edges(raw)


@query(f"{G} SELECT src, dst, kind FROM edg WHERE src IN (SELECT 1000000 + c_custkey FROM customer WHERE c_acctbal > 0 UNION SELECT 3000000 + n_nationkey FROM nation) AND dst IN (SELECT 1000000 + c_custkey FROM customer WHERE c_acctbal > 0 UNION SELECT 3000000 + n_nationkey FROM nation)")
def hydrate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select((F.lit(1000000) + F.col("c_custkey")).alias("id")).union(table(spark, sf_dir, "nation").select((F.lit(3000000) + F.col("n_nationkey")).cast("bigint")))
    return graph.hydrate(edges(spark, sf_dir), nodes).select("src", "dst", "kind")


@query("""WITH RECURSIVE row_ AS (SELECT p_partkey, p_size + 8 AS cost, row_number() OVER (ORDER BY p_partkey) AS k FROM part),
fold AS (SELECT CAST(0 AS BIGINT) AS k, CAST(400 AS BIGINT) AS free, 0 AS fits UNION ALL SELECT r.k, CASE WHEN cost <= free THEN free - cost ELSE free END, CASE WHEN cost <= free THEN 1 ELSE 0 END FROM fold JOIN row_ r ON r.k = fold.k + 1)
SELECT p_partkey, fits FROM row_ JOIN fold USING (k)""")
def knapsack(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    kept = ranking.knapsack(parts, F.struct("p_partkey"), F.col("p_size") + 8, 400)
    found = F.broadcast(spark.createDataFrame([(r["p_partkey"], 1) for r in kept], "p_partkey bigint, fits int"))  # no more than fit the budget
    return parts.join(found, "p_partkey", "left").select("p_partkey", F.coalesce("fits", F.lit(0)).alias("fits"))
