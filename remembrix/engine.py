"""One entry point over a store: remember, recall, link, supersede, forget, consolidate, sync."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import attrs, hyper, text
from .functions.scope import Scope
from .operators import consolidation, graph, lifecycle
from .operators.ranking import Knobs
from .plans import recall as plan
from .schema import EDGE, EDGE_WEIGHT, KINDS, MEMORY, SALIENCES

#: Entries of the buffer, from how many on it is consolidated by itself, and how many seconds lie between two such times.
CAPACITY, TRIGGER, COOLDOWN = 1024, 512, 30


def attribute(value: bool | float | str | Sequence[str]) -> dict:
    """A value as the record stores it."""
    kind = "bool" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "text" if isinstance(value, str) else "list"
    out = dict.fromkeys("bnsl")
    out[{"bool": "b", "number": "n", "text": "s", "list": "l"}[kind]] = float(value) if kind == "number" else list(value) if kind == "list" else value
    return {"t": kind, **out}


@dataclass
class Draft:
    """A memory to be: what a caller sets, with the defaults of the rest."""

    id: int
    text: str
    kind: str = "fact"
    tags: Sequence[str] = ()
    scope: Scope = field(default_factory=lambda: Scope("default"))
    importance: float = 0.5
    salience: str = "routine"
    shared_with: Sequence[str] = ()
    supersedes: int | None = None
    attributes: dict[str, bool | float | str | Sequence[str]] = field(default_factory=dict)
    auto_tags: bool = False

    def row(self, now: int) -> tuple:
        if self.kind not in KINDS or self.salience not in SALIENCES:
            raise ValueError(f"unknown kind or salience: {self.kind}, {self.salience}")
        tokens = max(len(self.text.encode()) // 4, 1)
        own = (self.id, self.text, list(self.tags), self.kind, self.salience, self.scope.agent, self.scope.user, self.scope.session, list(dict.fromkeys(self.shared_with)), min(max(self.importance, 0.0), 1.0))
        return (*own, now, now, 0, None, tokens, 1, self.supersedes, ["user"] * len(self.tags), {k: attribute(v) for k, v in self.attributes.items()}, None, self.auto_tags)


class MemoryEngine:
    """Tables memories (the graph's nodes), buffer (what came since the last consolidation), edges and activation, replaced by each change.

    Time is always an argument. A vector of each memory is made when it comes in. Accesses are a log of their own that
    memories shows, so that a recall writes a few rows and not the table.
    """

    def __init__(self, spark: SparkSession, memories: DataFrame | None = None, edges: DataFrame | None = None, embed: Callable[[Column], Column] | None = None) -> None:
        """embed: a function from a text column to an array of floats, for the dense signal."""
        self.spark, self.embed = spark, embed
        self.memories = memories if memories is not None else spark.createDataFrame([], MEMORY)
        self.edges = edges if edges is not None else spark.createDataFrame([], EDGE)
        self.buffer = spark.createDataFrame([], f"{MEMORY}, seq bigint")
        self.clear_activation()
        self._seq, self._consolidated, self._decayed = 0, None, None

    @property
    def memories(self) -> DataFrame:
        return lifecycle.with_accesses(self._stored, self._accesses).select(self._stored.columns)

    @memories.setter
    def memories(self, df: DataFrame) -> None:
        self._stored, self._accesses = df, self.spark.createDataFrame([], "id bigint, at bigint")

    @staticmethod
    def _vector() -> Column:
        return hyper.fingerprint(F.col("text"), F.col("tags"))

    def remember(self, drafts: Sequence[Draft], now: int, auto_tags: bool = False) -> DataFrame | None:
        """Add memories to the buffer, with auto_tags (of all, or of a draft) their texts' tags too. A draft that supersedes another memory replaces it.

        A buffer of TRIGGER entries or more is consolidated, COOLDOWN seconds after the last time at the earliest. Returns what
        a full buffer had to let go, oldest first, if anything.
        """
        new = self.spark.createDataFrame([(*d.row(now), self._seq + i) for i, d in enumerate(drafts)], f"{MEMORY}, auto boolean, seq bigint")
        self._seq += len(drafts)
        wanted = F.lit(auto_tags) | F.col("auto")
        merged = F.when(wanted, text.merge_tags(F.col("tags"), text.extract_tags(F.col("text")))).otherwise(F.col("tags"))
        new = graph.kept(new.withColumn("_own", F.size("tags")).withColumn("tags", merged))
        sources = F.transform("tags", lambda _, i: F.when(i < F.col("_own"), "user").otherwise("auto"))
        new = new.withColumn("tag_sources", sources).withColumn("vector", self._vector()).drop("auto", "_own")
        self.buffer = graph.kept(self.buffer.unionByName(new))
        if pairs := [(d.supersedes, d.id) for d in drafts if d.supersedes is not None]:
            self.supersede(pairs)
        return self._after_arrivals(now)

    def ingest(self, df: DataFrame, now: int) -> None:
        """Add many memories at a time: df has id and text, and any other columns of the record; the rest gets the defaults of a draft."""
        defaults = {
            "tags": F.array().cast("array<string>"), "kind": F.lit("fact"), "salience": F.lit("routine"), "agent": F.lit("default"), "shared_with": F.array().cast("array<string>"), "importance": F.lit(0.5),
            "created_s": F.lit(now).cast("bigint"), "accessed_s": F.lit(now).cast("bigint"), "access_count": F.lit(0).cast("bigint"), "token_count": text.token_estimate(F.col("text")), "version": F.lit(1).cast("bigint"),
        }
        kinds = {f.name: f.dataType for f in self._stored.schema.fields} if "vector" in self._stored.columns else {f.name: f.dataType for f in self.buffer.schema.fields}
        full = df.withColumns({c: defaults.get(c, F.lit(None).cast(kinds[c])) for c in kinds if c not in df.columns and c != "seq"})
        full = full.withColumn("vector", F.coalesce("vector", self._vector()))
        # the order of arrival within a batch is that of time and id
        order = F.row_number().over(Window.orderBy("created_s", "id"))
        full = graph.kept(full.select(*(F.col(c).cast(kinds[c]).alias(c) for c in kinds if c != "seq"), (order - 1 + self._seq).cast("bigint").alias("seq")))
        self._seq += full.count()
        self.buffer = graph.kept(self.buffer.unionByName(full))
        self._after_arrivals(now)

    def _after_arrivals(self, now: int) -> DataFrame | None:
        """Consolidation when it is due, and what a buffer that is still full has to let go."""
        if self.buffer.count() >= TRIGGER and (self._consolidated is None or now - self._consolidated >= COOLDOWN):
            self.consolidate(now)
        if self.buffer.count() <= CAPACITY:
            return None
        held, gone = lifecycle.bounded_buffer(self.buffer.withColumn("_all", F.lit(0)), CAPACITY, "_all")
        gone, self.buffer = graph.kept(gone.drop("_all").orderBy("seq")), graph.kept(held.drop("_all"))
        return gone

    def link(self, edges: Sequence[tuple[int, int, str]]) -> None:
        """Edges stay in the table even if an end isn't there yet; readers drop loose ones."""
        if bad := [k for _, _, k in edges if k not in EDGE_WEIGHT]:
            raise ValueError(f"unknown edge kinds: {bad}")
        self._add_edges(self.spark.createDataFrame([(s, d, k, i) for i, (s, d, k) in enumerate(edges)], EDGE))

    def _add_edges(self, new: DataFrame) -> None:
        """new: src, dst, kind and seq among themselves; they come after all that are there."""
        base = self.edges.agg(F.coalesce(F.max("seq"), F.lit(-1)) + 1).scalar()
        self.edges = graph.kept(graph.unique_edges(self.edges.unionByName(new.withColumn("seq", F.col("seq") + base))))

    def _change(self, change: Callable[[DataFrame], DataFrame]) -> None:
        """Both tables after a change of rows."""
        self.memories = graph.kept(change(self.memories).select(self._stored.columns))
        self.buffer = graph.kept(change(self.buffer).select(self.buffer.columns))

    def supersede(self, pairs: Sequence[tuple[int, int]]) -> None:
        """pairs of an old id and the new one; the last old one is what the new memory supersedes."""
        frame = self.spark.createDataFrame(list(pairs), "old bigint, new bigint")
        last = self.spark.createDataFrame(list({new: old for old, new in pairs}.items()), "id bigint, _old bigint")
        self._change(lambda df: lifecycle.supersede(df, frame).join(last, "id", "left").withColumn("supersedes", F.coalesce("_old", "supersedes")))
        self.link([(new, old, "supersedes") for old, new in pairs])

    def _ids(self, ids: Sequence[int]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id bigint")

    def forget(self, ids: Sequence[int]) -> None:
        gone = self._ids(ids)
        self._change(lambda df: lifecycle.forget(df, gone))

    def forget_hard(self, ids: Sequence[int]) -> None:
        gone = self._ids(ids)
        edges = lifecycle.forget_hard(self.memories, self.edges, gone)[1]
        self._change(lambda df: df.join(gone, "id", "left_anti"))
        self.edges = graph.kept(edges.select(self.edges.columns))

    def reconsolidate(self, id_: int, tags: Sequence[str]) -> None:
        """Append the absent ones of tags, as the user's own, and make the vector anew."""
        changes = self.spark.createDataFrame([(id_, list(tags))], "id bigint, new_tags array<string>")

        def change(df: DataFrame) -> DataFrame:
            out = lifecycle.reconsolidate(df, changes)
            out = out.withColumn("tag_sources", F.transform("tags", lambda _, i: F.coalesce(F.get("tag_sources", i), F.lit("user"))))
            return out.withColumn("vector", F.when(F.col("id") == id_, self._vector()).otherwise(F.col("vector")))

        self._change(change)

    def update_vectors(self, vectors: DataFrame) -> None:
        """vectors: id, vector; unknown ids are ignored."""
        self._change(lambda df: lifecycle.update_vectors(df, vectors))

    def merge(self, old_ids: Sequence[int], draft: Draft, now: int) -> None:
        self.remember([draft], now)
        self.supersede([(old, draft.id) for old in old_ids])

    def get(self, id_: int) -> DataFrame:
        """The memory, from the graph or else the buffer."""
        both = self.memories.unionByName(self.buffer.drop("seq").join(self._stored.select("id"), "id", "left_anti"))
        return both.filter(F.col("id") == id_)

    def recall(self, queries: Sequence[tuple[int, str]], scope: Scope, now: int, knobs: Knobs = Knobs(), kinds: Sequence[str] = (), where: dict[str, attrs.Filter] | None = None, primed: bool = False, tags: Sequence[str] = ()) -> DataFrame:
        """Picks of each (query_id, text) among what scope may read, with texts and tags; hits are touched. A query without any has one row, abstained.

        tags: the queries' own; else those that their texts hold. where: filters on attributes. primed: what earlier recalls
        have activated counts, fades, and is added to.
        """
        own = F.array(*map(F.lit, tags)).cast("array<string>") if tags else text.extract_tags(F.col("text"))
        asked = graph.kept(self.spark.createDataFrame(list(queries), "query_id bigint, text string").withColumn("tags", own))
        asked = asked.select("query_id", "text", self._vector().alias("vector"), *([self.embed(F.col("text")).alias("dense")] if self.embed else []))
        wanted = F.col("kind").isin(*kinds) if kinds else F.lit(True)
        if where:
            wanted = wanted & attrs.matches(F.col("attributes"), where)
        dense = (lambda df: df.withColumn("dense", self.embed(F.col("text")))) if self.embed else (lambda df: df)
        activation = self.activation if primed else None
        picks, ranks = plan.recall_block(asked, dense(self.memories), self.edges, knobs, now, readable=scope.can_read(), wanted=wanted, buffer=dense(self.buffer.drop("seq")), activation=activation)
        picks = graph.kept(picks)
        self._accesses = graph.kept(self._accesses.union(picks.filter("id IS NOT NULL").select("id", F.lit(now).cast("bigint"))))
        if primed:
            grown = graph.spread_activation(self.activation, ranks)
            self.activation = graph.kept(self._faded(grown, 0 if self._decayed is None else now - self._decayed))
            self._decayed = now
        both = self.memories.unionByName(self.buffer.drop("seq").join(self._stored.select("id"), "id", "left_anti"))
        return picks.join(both.select("id", "text", "tags", "kind", "token_count"), "id", "left")

    def mismatched_attributes(self, where: dict[str, attrs.Filter]) -> list[str]:
        """Keys of filters that met a value of another type, sorted."""
        keys = self.memories.select(F.explode(attrs.mismatched(F.col("attributes"), where)).alias("key")).distinct()
        return sorted(r.key for r in keys.collect())  # one row for each filter at most

    def _faded(self, activation: DataFrame, seconds: int) -> DataFrame:
        return graph.decay_activation(activation, F.lit(seconds), self.memories.select("id", "kind", F.col("superseded_by").isNull().alias("active")))

    def context(self, picks: DataFrame) -> DataFrame:
        """(query_id, context): the picks of each query as lines of text."""
        lines = picks.filter("id IS NOT NULL").select("query_id", "pick", text.render(F.col("text"), F.col("tags")).alias("line"))
        return lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pick", "line"))), lambda s: s["line"]), "").alias("context"))

    def numbered_context(self, picks: DataFrame) -> DataFrame:
        """(query_id, context): the picks numbered from 1, with their kinds: the older engine's form."""
        line = F.concat(F.col("pick") + 1, F.lit(". ["), "kind", F.lit("] "), "text", F.lit("\n"))
        lines = picks.filter("id IS NOT NULL").select("query_id", "pick", line.alias("line"))
        return lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pick", "line"))), lambda s: s["line"]), "").alias("context"))

    def trajectory(self, start: int, limit: int) -> DataFrame:
        nodes = self.memories.select("id", F.col("superseded_by").isNull().alias("active"))
        return graph.trajectory(self.edges, nodes, self._ids([start]), limit)

    def think(self, query: str, best: int = 10) -> DataFrame:
        """Contradicting pairs (src, dst) with either end among the best text hits for a query."""
        from .operators import lexical

        live = self.memories.filter("superseded_by IS NULL")
        terms = lexical.query_terms(self.spark.createDataFrame([(0, query)], "query_id bigint, text string"))
        hits = lexical.term_hits(terms, lexical.postings(live))
        weights = lexical.term_idf(terms, hits, live.agg(F.count("*")).scalar())
        top = lexical.term_overlap(weights, hits).orderBy(F.desc("term"), "id").limit(best)
        return graph.contradictions(graph.hydrate(self.edges, self.memories), top.select("id"))

    def suggest_clusters(self, limit: int) -> DataFrame:
        return graph.clusters(self.edges, self.memories.select("id", F.col("superseded_by").isNull().alias("active")), limit)

    def consolidate(self, now: int) -> DataFrame:
        """Empties the buffer into the graph; one row with processed, promoted, reinforced, dropped and edges_created.

        Novel entries go in and are linked with what was there before them; redundant ones are an access of their neighbour;
        reinforcing ones add their tags and importance to it besides.
        """
        names = ["agent", "user", "session", "shared_with", "id", "vector", "salience", "importance"]
        entries, there = graph.kept(self.buffer), graph.kept(self.memories)
        live = there.filter("superseded_by IS NULL")
        passed = consolidation.consolidate(entries.select(*names, "seq", "supersedes"), live.select(names), there.agg(F.count("*")).scalar())
        novel = entries.drop("salience", "importance").join(passed.filter("verdict = 'novel'").select("id", "salience", "importance"), "id")
        novel = graph.kept(novel.select(entries.columns))
        met = graph.kept(consolidation.links(novel.filter("superseded_by IS NULL"), live))
        report = graph.kept(consolidation.report(passed, met))
        self.memories = graph.kept(consolidation.reinforced(there.unionByName(novel.drop("seq")), passed, entries, now))
        # the order of edges is that of the ids they join
        self._add_edges(consolidation.edges_of(met).withColumn("seq", F.lit(0).cast("bigint")))
        self.buffer = self.spark.createDataFrame([], self.buffer.schema)
        self._consolidated = now
        one = self._stored.agg(F.count("*").alias("n"), F.count("superseded_by").alias("gone")).first()
        if one.gone * 4 > one.n:
            self.vacuum()
        return report

    def drain(self, taken: Column) -> DataFrame:
        """Takes what a predicate holds for out of the buffer."""
        out, rest = lifecycle.drain(self.buffer, taken)
        out, self.buffer = graph.kept(out), graph.kept(rest)
        return out

    def vacuum(self) -> None:
        nodes, edges = graph.vacuum(self.memories.withColumn("active", F.col("superseded_by").isNull()), self.edges)
        self.memories, self.edges = graph.kept(nodes.drop("active")), graph.kept(edges.select(self.edges.columns))
        self.activation = graph.kept(self.activation.join(self._stored.select("id"), "id", "left_semi"))

    def clear_activation(self) -> None:
        self.activation = self.spark.createDataFrame([], "id bigint, value double")

    def reset(self) -> int:
        """Drops everything; the number of active memories that went."""
        both = self.memories.select("superseded_by").union(self.buffer.select("superseded_by"))
        gone = both.filter("superseded_by IS NULL").count()
        self.__init__(self.spark, embed=self.embed)
        return gone

    def stats(self) -> DataFrame:
        return lifecycle.engine_stats(self.memories, self.edges, self.buffer, CAPACITY)

    def export_state(self) -> tuple[DataFrame, DataFrame]:
        """All memories, buffered ones too, and edges."""
        return self.memories.unionByName(self.buffer.drop("seq").join(self._stored.select("id"), "id", "left_anti")), self.edges

    def import_state(self, memories: DataFrame, edges: DataFrame) -> None:
        """The later version of each memory wins, the own one on ties."""
        self.memories = graph.kept(lifecycle.last_write_wins(self.memories, memories))
        self._add_edges(edges)
