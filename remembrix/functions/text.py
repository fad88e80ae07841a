"""Text functions on columns: words, tokens, tags and rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that queries ignore.
QUERY_STOPWORDS = "the and a an is in it of to for with on at by this that are we our you how what do does did was were be has have had can will would should about from not or but if so no up out me".split()
#: Words without a weight of their own in fingerprints.
FINGERPRINT_STOPWORDS = "the and a an is in it of to for with on at by this that are we our you".split()
#: Words that are never tags.
TAG_STOPWORDS = "a an the is are was were be been being i you he she it we they me him her us them my your his its our their of in on at to for with by from as and or but if then so this that these those have has had do does did will would should could can may might must shall what when where why how who which into about over after before during".split()
#: Words that are good tags.
DOMAIN_KEYWORDS = "auth authentication authorization session token jwt oauth saml sso password login logout api rest graphql rpc grpc endpoint webhook database db sql postgres mysql mongodb redis cache queue kafka rabbitmq deploy release rollout rollback ci cd test testing qa bug issue ticket frontend backend fullstack ui ux design performance latency throughput scaling scale security encryption tls ssl vulnerability audit monitoring logging metrics tracing observability kubernetes k8s docker container pod rust python typescript javascript java golang go refactor refactoring optimization rewrite user team lead engineer developer project milestone deadline sprint config configuration env environment memory recall remember forget supersede".split()
#: Words that make a query a temporal one.
TEMPORAL_MARKERS = ("yesterday", "today", "tomorrow", "last week", "last month", "last year", "last monday", "last tuesday", "last wednesday", "last thursday", "last friday", "last saturday", "last sunday", "ago", "recent", "recently", "earlier", "this morning", "this afternoon", "this evening")


def literals(values) -> Column:
    return F.array(*map(F.lit, values))


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, one at least."""
    return F.greatest(F.floor(F.octet_length(text) / 4), F.lit(1)).cast("bigint")


def word_count_tokens(text: Column) -> Column:
    """Words times 1.3, rounded up: the older estimate."""
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.ceil(n * F.lit(13) / F.lit(10)).cast("bigint")


def words(text: Column) -> Column:
    """Lower-cased words without marks, in order. Marks go from the text as a whole: a pattern for each word costs more."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", "")), r"\s+"), lambda w: w != "")


def query_words(text: Column) -> Column:
    return F.filter(words(text), lambda w: (F.octet_length(w) >= 2) & ~F.array_contains(literals(QUERY_STOPWORDS), w))


def variants(word: Column) -> Column:
    """What a query word matches: itself, without a final s, and with one."""
    return F.when((F.octet_length(word) > 1) & F.endswith(word, F.lit("s")), F.array(word, F.substring(word, F.lit(1), F.length(word) - 1), F.concat(word, F.lit("s")))).otherwise(F.array(word, F.concat(word, F.lit("s"))))


def has_term(word_list: Column, word: Column) -> Column:
    return F.arrays_overlap(word_list, variants(word))


def domain_keywords(text: Column) -> Column:
    """Keywords that stand alone in the text, sorted."""
    low = F.lower(text)
    held = F.array_distinct(F.split(low, r"[^\p{L}\p{N}]+"))
    return F.array_sort(F.array_intersect(literals(DOMAIN_KEYWORDS), held))


def proper_nouns(text: Column) -> Column:
    """Capitalised words: the first only with an inner capital or before another one."""
    tokens = F.filter(F.split(text, r"[\s.,!?;:]+"), lambda t: t != "")

    def kept(tokens: Column) -> Column:
        own = F.filter(
            F.transform(tokens, lambda t, i: F.struct(t.alias("t"), ((i > 0) | t.substr(2, 1 << 30).rlike("[A-Z]") | F.coalesce(F.get(tokens, F.lit(1)), F.lit("")).rlike("^[A-Z]")).alias("counts"))),
            lambda x: x["counts"] & x["t"].rlike("^[A-Z]") & (F.octet_length(x["t"]) >= 2),
        )
        cleaned = F.transform(own, lambda x: F.lower(F.regexp_replace(x["t"], r"[^\p{L}\p{N}]", "")))
        return F.array_sort(F.array_distinct(F.filter(cleaned, lambda w: (F.octet_length(w) >= 2) & ~F.array_contains(literals(TAG_STOPWORDS), w))))

    return F.element_at(F.transform(F.array(tokens), kept), 1)


def verb_stems(text: Column) -> Column:
    """Stems of words in -ing and -ed, of five ASCII letters or more, a doubled last consonant halved."""
    own = F.filter(F.transform(F.split(text, r"\s+"), lambda w: F.lower(F.regexp_replace(w, "[^A-Za-z]", ""))), lambda w: (F.length(w) >= 5) & w.rlike("(ing|ed)$"))
    stems = F.transform(own, lambda w: F.regexp_replace(w, "(ing|ed)$", ""))
    stems = F.transform(stems, lambda s: F.when(F.length(s) >= 4, F.regexp_replace(s, r"([^aeiou])\1$", "$1")).otherwise(s))
    return F.array_sort(F.array_distinct(F.filter(stems, lambda s: (F.length(s) >= 3) & ~F.array_contains(literals(TAG_STOPWORDS), s))))


def extract_tags(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(proper_nouns(text), domain_keywords(text), verb_stems(text))))


def merge_tags(own: Column, extracted: Column) -> Column:
    """own, then what was extracted and isn't among them whatever the case."""
    low = F.transform(own, F.lower)
    return F.concat(own, F.filter(extracted, lambda t: ~F.array_contains(low, t)))


def tags_with_sources(tags: Column, sources: Column) -> Column:
    """Structs of tag and source; a tag without a source is the user's own."""
    return F.transform(tags, lambda t, i: F.struct(t.alias("tag"), F.coalesce(F.get(sources, i), F.lit("user")).alias("source")))


def split_tags(pairs: Column) -> tuple[Column, Column]:
    """Tags and sources of what tags_with_sources() gives."""
    return F.transform(pairs, lambda p: p["tag"]), F.transform(pairs, lambda p: p["source"])


def append_tags(own: Column, new: Column) -> Column:
    """own, then each of new that is absent, once."""
    return F.concat(own, F.array_except(new, own))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def render(text: Column, tags: Column) -> Column:
    return F.concat(F.lit("- "), text, F.when(F.size(tags) > 0, F.concat(F.lit(" ["), F.array_join(tags, ", "), F.lit("]"))).otherwise(""), F.lit("\n"))


def description_length(text: Column, tags: Column) -> Column:
    size = F.octet_length(text) + F.aggregate(tags, F.lit(0), lambda a, t: a + F.octet_length(t)) + 1
    return F.log2(size.cast("double")) * 8


def parse_kind(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin("decision", "fact", "event", "preference", "goal"), low).when(low == "pref", "preference").otherwise("fact")


def parse_salience(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin("important", "critical"), low).otherwise("routine")


def parse_edge(text: Column) -> Column:
    """Null for an unknown kind."""
    low = F.lower(text)
    return F.when(low.isin("caused_by", "derived_from", "supports", "supersedes", "before", "after", "relates_to", "contradicts"), low)


def head_and_tail(text: Column, size: int, mark: str = "\n[...]\n") -> Column:
    """The text, or its first and last halves of size around a mark."""
    half = size // 2
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit(mark), F.right(text, F.lit(half))))


def holds(gold: Column, context: Column) -> Column:
    """1.0 if the context holds the gold text, whatever the case; 0.0 if either is empty."""
    g = F.lower(F.trim(gold))
    return F.when((F.length(g) > 0) & (F.length(context) > 0) & F.contains(F.lower(context), g), 1.0).otherwise(0.0)


def judged(score: Column) -> Column:
    return F.when(score >= 0.75, 1.0).when(score >= 0.25, 0.5).otherwise(0.0)


def judge_answer(answer: Column) -> Column:
    """A struct of score (0, 0.5 or 1) and reason from a model's answer: what lies from the first { to the last } as JSON; null and empty if it is none."""
    held = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    parsed = F.from_json(held, "score double, reason string")
    score = parsed["score"]
    return F.struct(F.when(score.isNotNull(), judged(score)).alias("score"), F.when(score.isNotNull(), F.coalesce(parsed["reason"], F.lit(""))).otherwise("").alias("reason"))
