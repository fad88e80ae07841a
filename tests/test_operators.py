"""Invariants and brute-force comparisons of the operators."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from remembrix.engine import Draft, MemoryEngine
from remembrix.functions import attrs, hyper, scope, scoring, text
from remembrix.operators import consolidation, graph, lifecycle, ranking
from remembrix.schema import EDGE, EDGE_WEIGHT
from remembrix.sources import dialogues, store
from remembrix.streaming import buffer


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def effective(spark, kind="fact", salience="routine", importance=1.0, age=0, idle=0, accesses=0):
    lit, day = F.lit, 86400
    return value(spark, scoring.effective_importance(lit(kind), lit(salience), lit(importance), lit(-age * day), lit(-idle * day), lit(accesses), lit(0)))


def test_decay(spark):
    assert effective(spark, age=90) == pytest.approx(0.5)
    assert effective(spark, salience="critical", age=1000) == pytest.approx(2.0)
    assert effective(spark, kind="preference", age=100, idle=0) > 5 * effective(spark, kind="preference", age=100, idle=100)
    assert effective(spark, age=30, accesses=100) > effective(spark, age=30)
    assert effective(spark, salience="important", age=90) > effective(spark, age=90)


@pytest.mark.parametrize(
    "reader, memory, seen",
    [
        (("a",), ("a", None, None, []), True),
        (("a",), ("a", "u", None, []), False),
        (("a", "u"), ("a", "u", None, []), True),
        (("a", "v"), ("a", "u", None, []), False),
        (("a", "u"), ("a", "u", "s", []), False),
        (("a", "u", "s"), ("a", "u", "s", []), True),
        (("a",), ("a", None, "s", []), True),
        (("b",), ("a", None, None, []), False),
        (("b",), ("a", "u", "s", ["b"]), True),
    ],
)
def test_scope(spark, reader, memory, seen):
    row = spark.createDataFrame([memory], "agent string, user string, session string, shared_with array<string>")
    assert row.filter(scope.Scope(*reader).can_read()).count() == seen
    key = row.select(scope.from_key(scope.to_key(*(F.col(c) for c in row.columns))).alias("s")).first().s
    assert (key.agent, key.user, key.session, key.shared_with) == memory


def test_filters(spark):
    number, words, flag, many = attrs.value("number", n=F.lit(75.0)), attrs.value("text", s=F.lit("50")), attrs.value("bool", b=F.lit(True)), attrs.value("list", l=F.array(F.lit("x"), F.lit("y")))
    cases = [
        (number, attrs.Eq(75 + 1e-10), 1), (number, attrs.Eq("75"), 2), (number, attrs.Gt(75), 0), (number, attrs.Range(75, 80), 1), (words, attrs.Gt(10), 2), (words, attrs.Substring("5"), 1),
        (flag, attrs.Eq(True), 1), (flag, attrs.Eq(1.0), 2), (many, attrs.Contains("y"), 1), (many, attrs.Contains("z"), 0), (words, attrs.Contains("5"), 2), (many, attrs.Eq(("x", "y")), 1),
        (number, attrs.All(()), 1), (number, attrs.Any(()), 0), (number, attrs.All((attrs.Gt(100), attrs.Eq("a"))), 0), (number, attrs.All((attrs.Eq("a"), attrs.Gt(100))), 2), (number, attrs.Any((attrs.Eq("a"), attrs.Gt(100))), 0), (number, attrs.Any((attrs.Eq("a"), attrs.Substring("b"))), 2),
    ]
    got = spark.range(1).select(*(f.on(v).alias(f"c{i}") for i, (v, f, _) in enumerate(cases))).first()
    assert list(got) == [c[2] for c in cases]


def test_text(spark):
    assert value(spark, text.words(F.lit("Héllo, wor-ld  _x!"))) == ["héllo", "world", "_x"]
    assert value(spark, text.query_words(F.lit("What is the plan for APIs"))) == ["plan", "apis"]
    for held, word, hit in ((["plan"], "plans", True), (["plans"], "plan", True), (["plane"], "plan", False)):
        assert value(spark, text.has_term(text.literals(held), F.lit(word))) is hit
    assert value(spark, text.extract_tags(F.lit("We use GitHub for running tests, Deploy planned"))) == ["deploy", "github", "plan", "run"]
    assert value(spark, text.extract_tags(F.lit("Hello world"))) == []
    assert value(spark, text.token_estimate(F.lit("é"))) == 1


def test_hypervectors(spark):
    a, b = (hyper.of_token(F.lit(t)) for t in ("alpha", "beta"))
    got = spark.range(1).select(hyper.bind(hyper.bind(a, b), b).alias("back"), a.alias("a"), hyper.permute(a).alias("turned"), hyper.similarity(a, b).alias("far")).first()
    assert got.back == got.a and abs(got.far) < 0.15
    bits = hyper._bits(["alpha"])[0].astype(np.int32)
    assert hyper._lanes(bits).tolist() == got.a and hyper._lanes(np.roll(bits, -1)).tolist() == got.turned
    one, near, other = (hyper.fingerprint_of(t, []) for t in ("the database runs on postgres in production", "the database runs on postgres in the production", "completely unrelated cooking recipe with garlic"))
    same = lambda x, y: 1 - 2 * int(np.bitwise_count(np.array(x) ^ np.array(y)).sum()) / hyper.BITS
    assert same(one, one) == 1 and same(one, near) > 0.5 > same(one, other)
    votes = hyper._bits(list("abcd")).astype(np.int32)
    rows = spark.createDataFrame([(1, hyper._lanes(v).tolist()) for v in votes], "g int, vector array<bigint>")
    assert hyper.bundle(rows, ["g"]).first().vector == hyper._lanes(hyper.majority(votes.sum(0), 4)).tolist()


@pytest.mark.parametrize(("words", "tags"), [("", []), ("ab", ["x"]), ("The quick brown fox, the Fox!", ["a", "a"]), ("é ß_x 12 a", []), ("one two three " * 300, ["t"])])
def test_fingerprints_by_hand(words, tags):
    """Vote by vote: tags 3, words 2, pairs of words 2, trigrams 1; a tie sets odd bits."""
    bits = lambda t: hyper._bits([t])[0].astype(int)
    own = [w for w in ("".join(c for c in raw if c.isalnum() or c == "_").lower() for raw in words.split()) if len(w.encode()) >= 2]
    votes = [bits(f"tag::{t}") for t in tags for _ in range(3)]
    votes += [bits(f"word::{w}") for w in own if w not in hyper.FINGERPRINT_STOPWORDS for _ in range(2)]
    votes += [np.roll(bits(f"word::{a}"), -1) ^ bits(f"word::{b}") for a, b in zip(own, own[1:]) for _ in range(2)]  # noqa: B905
    low = words.lower()
    votes += [bits(f"tri::{low[i : i + 3]}") for i in range(len(low) - 2)] if len(low) >= 3 else [bits(low)] if low else []
    votes = votes or [bits(words)]
    total = np.sum(votes, axis=0)
    expected = [int(2 * t > len(votes) or (2 * t == len(votes) and i % 2 == 1)) for i, t in enumerate(total)]
    assert hyper.fingerprint_of(words, tags) == hyper._lanes(np.array(expected)).tolist()


def test_selection_and_verdict(spark):
    row = lambda s, tags=(), tokens=10: {"score": s, "tags": tags, "tokens": tokens, "recency": 0, "fresh": False}
    assert ranking.select_diverse([row(3, ("a",)), row(2.2, ("a",)), row(2.1, ("b",)), row(1, ("c",))], 100, 0.7) == [0, 2, 1, 3]
    assert ranking.select_diverse([row(3, tokens=500), row(2)], 100, 0.7) == [0]
    assert ranking.select_diverse([row(3), row(2, tokens=95), row(1, tokens=20)], 100, 1.0) == [0, 2]
    assert sum([10] * len(ranking.select_diverse([row(50 - i, (str(i),)) for i in range(50)], 100, 0.7))) <= 100
    v = lambda *x: value(spark, ranking.verdict(*map(F.lit, x)))
    assert v(0, 1.0, 1.0, 1.0, 0.0, "general") == "abstained"
    assert v(2, 0.01, 1.0, 1.0, 0.0, "general") == "low_confidence"
    assert v(2, 0.1, 0.01, 1.0, 0.0, "factual") == "ambiguous_leader"
    assert v(1, 0.1, 0.1, 0.1, 0.0, "factual") == "unsupported_top"
    assert v(1, 0.1, 0.1, 0.1, 0.0, "general") == "confident"


def random_graph(seed, n=14, m=30):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), rng.choice(list(EDGE_WEIGHT)), i) for i in range(m)]


def brute_ppr(edges, seed, hops=3):
    out = {}
    for s, d, k in {(s, d, k) for s, d, k, _ in edges}:
        out.setdefault(s, []).append((d, EDGE_WEIGHT[k]))
        out.setdefault(d, []).append((s, EDGE_WEIGHT[k] / 2))
    local, front = {seed}, {seed}
    for _ in range(hops):
        front = {d for x in front for d, _ in out.get(x, [])} - local
        local |= front
    rank = {x: float(x == seed) for x in local}
    for _ in range(20):
        new = {x: 0.0 for x in local}
        for x in local:
            arcs = [(d, w) for d, w in out.get(x, []) if d in local]
            total = sum(w for _, w in arcs)
            if not arcs:
                new[seed] += rank[x] / len(local)
            for d, w in arcs:
                new[d] += rank[x] * w / total
        rank = {x: 0.15 * (x == seed) + 0.85 * new[x] for x in local}
    return {x: r for x, r in rank.items() if r > 1e-6}


def test_pagerank(spark):
    edges = random_graph(1)
    frame = spark.createDataFrame(edges, EDGE)
    lonely = 99
    seeds = spark.createDataFrame([(0, edges[0][0]), (1, lonely)], "query_id bigint, id bigint")
    got = {}
    for r in graph.personalized_pagerank(frame, seeds).collect():
        got.setdefault(r.query_id, {})[r.id] = r.ppr
    for q, seed in ((0, edges[0][0]), (1, lonely)):
        assert got[q] == pytest.approx(brute_ppr(edges, seed))


def brute_clusters(edges, active, limit):
    out = {}
    for s, d, k, _ in edges:
        if k in graph.CLUSTERING:
            out.setdefault(s, []).append(d)
    seen, found = set(), []
    for s in sorted(out, key=lambda x: (-len(out[x]), x)):
        if len(out[s]) < 2 or s in seen or s not in active or len(found) == limit:
            continue
        members = ({s} | {d for d in out[s] if d in active}) - (seen - {s})
        seen |= members
        if len(members) >= 3:
            found.append((s, sorted(members), len(members) * len(out[s])))
    return sorted(found, key=lambda x: (-x[2], x[0]))


@pytest.mark.parametrize("seed", [2, 3])
def test_clusters(spark, seed):
    edges = random_graph(seed, 20, 60)
    nodes = spark.createDataFrame([(i, i % 7 != 0) for i in range(20)], "id bigint, active boolean")
    got = [tuple(r) for r in graph.clusters(spark.createDataFrame(edges, EDGE), nodes, 4).collect()]
    assert got == brute_clusters(edges, {i for i in range(20) if i % 7}, 4)


def brute_walk(edges, active, known, start, limit):
    if start not in known:
        return []
    queue, seen, out = [start], {start}, []
    while queue:
        x = queue.pop(0)
        if x in active:
            out.append(x)
            if len(out) >= max(limit, 1):
                break
        near = [(-q, d) for s, d, k, q in edges if s == x and k in graph.ONWARD] + [(-q, s) for s, d, k, q in edges if d == x and k in graph.BACKWARD]
        for _, y in sorted(near):
            if y in known and y not in seen:
                seen.add(y)
                queue.append(y)
    return out


@pytest.mark.parametrize("limit", [0, 3, 50])
def test_trajectory(spark, limit):
    edges = random_graph(7, 14, 40)
    known, active = set(range(12)), set(range(12)) - {3, 4}
    nodes = spark.createDataFrame([(i, i in active) for i in known], "id bigint, active boolean")
    starts = spark.createDataFrame([(0,), (5,), (77,)], "id bigint")
    got = {}
    for r in graph.trajectory(spark.createDataFrame(edges, EDGE), nodes, starts, limit).orderBy("position").collect():
        got.setdefault(r.start, []).append(r.id)
    for s in (0, 5, 77):
        assert got.get(s, []) == brute_walk(edges, active, known, s, limit)


def test_consolidation(spark):
    vector = lambda t, tags=(): hyper.fingerprint_of(t, list(tags))
    known = spark.createDataFrame([("a", 1, vector("the database runs on postgres in production"), "routine", 0.5)], "agent string, id bigint, vector array<bigint>, salience string, importance double")
    rows = [("a", 2, vector("the database runs on postgres in production"), 1, None), ("a", 3, vector("zebra crossing quietly"), 2, None), ("a", 4, vector("zebra crossing quietly"), 3, None), ("a", 5, vector("zebra crossing quietly"), 4, 3), ("b", 6, vector("the database runs on postgres in production"), 1, None)]
    new = spark.createDataFrame([(a, i, v, "routine", 0.5, s, p) for a, i, v, s, p in rows], "agent string, id bigint, vector array<bigint>, salience string, importance double, seq bigint, supersedes bigint")
    got = {r.id: (r.verdict, r.neighbour) for r in consolidation.consolidate(new, known).collect()}
    assert {i: v for i, (v, _) in got.items()} == {2: "redundant", 3: "novel", 4: "redundant", 5: "novel", 6: "novel"}
    assert got[2][1] == 1 and got[4][1] == 3
    assert consolidation.consolidate(new.limit(0), known).collect() == []


def test_last_write_wins(spark):
    cols = "id bigint, version bigint, accessed_s bigint, text string"
    own = spark.createDataFrame([(1, 1, 5, "own"), (2, 2, 5, "own"), (3, 1, 5, "own")], cols)
    far = spark.createDataFrame([(1, 2, 0, "far"), (2, 2, 6, "far"), (3, 1, 5, "far"), (4, 1, 1, "far")], cols)
    assert {r.id: r.text for r in lifecycle.last_write_wins(own, far).collect()} == {1: "far", 2: "far", 3: "own", 4: "far"}


def test_engine(spark):
    engine, me = MemoryEngine(spark), scope.Scope("a")
    engine.remember([Draft(1, "We chose Postgres for the billing database", "decision", ["db", "billing"], me), Draft(2, "The billing service deploys on Fridays", "fact", ["billing", "deploy"], me), Draft(3, "Secret of another agent about Postgres", "fact", ["db"], scope.Scope("b"))], now=1000)
    engine.link([(2, 1, "caused_by"), (2, 1, "caused_by"), (2, 9, "supports")])
    assert engine.edges.count() == 2
    hits = engine.recall([(0, "Which database did billing choose, Postgres?")], me, now=1500).collect()
    assert {h.id for h in hits} == {1, 2} and all(h.from_buffer for h in hits)
    assert engine.consolidate(1600).first().promoted == 3
    hits = engine.recall([(0, "Which database did billing choose, Postgres?")], me, now=2000).orderBy("pick").collect()
    assert hits[0].id == 1 and 3 not in [h.id for h in hits]
    assert (engine.get(1).first().access_count, engine.get(1).first().accessed_s) == (1, 2000)
    assert engine.context(spark.createDataFrame(hits)).first().context.startswith("- We chose")
    engine.remember([Draft(4, "We moved billing to MySQL", "decision", ["db", "billing"], me, supersedes=1)], now=3000)
    assert engine.get(1).first().superseded_by == 4 and engine.get(4).first().supersedes == 1
    engine.consolidate(3100)
    assert [r.id for r in engine.trajectory(2, 5).collect()] == [2]
    engine.forget([2])
    engine.vacuum()
    assert sorted(r.id for r in engine.memories.collect()) == [3, 4]
    other = MemoryEngine(spark)
    other.import_state(*engine.export_state())
    assert other.stats().first().active == 2
    engine.forget_hard([3])
    assert engine.memories.count() == 1
    with pytest.raises(ValueError):
        engine.link([(1, 2, "nonsense")])


def test_store(spark, tmp_path):
    s = store.ParquetStore(spark, str(tmp_path))
    row = lambda i, text_, superseded=None: (i, text_, [], "fact", "routine", "a", None, None, [], 0.5, 0, 0, 0, superseded, 1, 1, None, [], {}, None)
    from remembrix.schema import MEMORY

    s.append(spark.createDataFrame([row(1, "old"), row(2, "x")], MEMORY), 0)
    s.append(spark.createDataFrame([row(1, "new"), row(3, "gone", 3)], MEMORY), 1)
    s.append_edges(spark.createDataFrame([(1, 2, "supports", 0), (1, 2, "supports", 1), (1, 3, "supports", 2), (1, 2, "odd", 3)], EDGE))
    assert {r.id: r.text for r in s.memories().collect()} == {1: "new", 2: "x", 3: "gone"}
    memories, edges = s.hydrated()
    assert memories.count() == 2 and [(r.src, r.dst) for r in edges.collect()] == [(1, 2)]
    assert s.readable(scope.Scope("b")).count() == 0


def test_loaders(spark, tmp_path):
    sample = {"sample_id": "c1", "qa": [{"question": "q", "answer": "a", "evidence": ["D1:1"], "category": 2}, {"question": "no answer", "category": 5}], "conversation": {"speaker_a": "A", "session_2": [{"speaker": "B", "dia_id": "D2:1", "text": "two"}], "session_1": [{"speaker": "A", "dia_id": "D1:1", "text": "one"}], "session_1_date_time": "1 May"}}
    (tmp_path / "a.json").write_text(json.dumps([sample]))
    turns, asked = dialogues.sessions(spark, str(tmp_path / "a.json"))
    assert [(r.session, r.date, r.text) for r in turns.orderBy("session", "position").collect()] == [(1, "1 May", "one"), (2, None, "two")]
    assert [(r.question, r.category) for r in asked.collect()] == [("q", 2)]
    item = {"question_id": "x", "question_type": "t", "question": "q", "answer": "a", "haystack_dates": ["d"], "haystack_session_ids": ["s"], "haystack_sessions": [[{"role": "user", "content": "hi"}]]}
    (tmp_path / "b.json").write_text(json.dumps([item]))
    turns, asked = dialogues.haystacks(spark, str(tmp_path / "b.json"))
    assert tuple(turns.first()) == ("x", 0, "s", "d", 0, "user", "hi") and asked.first().answer == "a"
    dialogues.write_results(asked, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    seen = []
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")
    buffer.consolidate_batches(stream, lambda df, n: seen.append(df.count()), str(tmp_path), available_now=True).awaitTermination()
    assert sum(seen) == spark.read.parquet(f"{sf_dir}/events.parquet").count()
