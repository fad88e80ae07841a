"""The recall pipeline and consolidation against sequential versions of them in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from remembrix.engine import Draft, MemoryEngine
from remembrix.functions import attrs, hyper
from remembrix.functions.scope import Scope
from remembrix.functions.text import QUERY_STOPWORDS, TEMPORAL_MARKERS
from remembrix.operators import consolidation
from remembrix.operators.ranking import Knobs, select_diverse
from remembrix.plans.recall import recall, recall_block
from remembrix.schema import EDGE, EDGE_WEIGHT, HALF_LIFE, MEMORY

NOW = 1_700_000_000
WORDS = "redis postgres billing deploy cache queue token login release latency budget invoice oauth rust python cluster shard replica index vacuum alpha beta gamma delta".split()
SCHEMA = f"{MEMORY}, dense array<float>"


def words(text):
    return [w for w in ("".join(c for c in raw if c.isalnum() or c == "_").lower() for raw in text.split()) if w]


def has(held, w):
    return w in held or (w[:-1] in held if len(w) > 1 and w.endswith("s") else False) or w + "s" in held


def distance(a, b):
    return sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b, strict=True))


def can_read(reader, m):
    agent, user, session = reader
    if agent != m["agent"]:
        return agent in m["shared_with"]
    return m["user"] is None or (m["user"] == user and (m["session"] is None or m["session"] == session))


def brute_ppr(seeds, memories, edges, activation):
    nodes = {m["id"]: m for m in memories}
    arcs = {(s, d, k) for s, d, k in edges if s in nodes and d in nodes}
    salient = {i for i, m in nodes.items() if m["superseded_by"] is None and (m["salience"] == "critical" or m["kind"] == "goal")}
    local = front = set(seeds) | salient
    for _ in range(3):
        front = {d for s, d, _ in arcs if s in front} | {s for s, d, _ in arcs if d in front}
        local = local | front
    k = len(local)
    start = {i: (1 / k if i in seeds or i in salient else 0) + 0.15 * activation.get(i, 0) for i in local}
    total = sum(start.values())
    start = {i: v / total for i, v in start.items()}
    rank = dict(start)
    out = {i: [(d, EDGE_WEIGHT[kind]) for s, d, kind in arcs if s == i and d in local] + [(s, EDGE_WEIGHT[kind] / 2) for s, d, kind in arcs if d == i and s in local] for i in local}
    for _ in range(20):
        new = dict.fromkeys(local, 0.0)
        for i, r in rank.items():
            whole = sum(w for _, w in out[i])
            if not whole:
                for s in seeds:
                    new[s] += r / k
            for j, w in out[i]:
                new[j] += r * w / whole
        rank = {i: 0.15 * start[i] + 0.85 * new[i] for i in local}
    return {i: r for i, r in rank.items() if r > 1e-6}


def cosine(a, b):
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / norm if norm >= 1e-9 else 0.0


def brute_recall(query, vector, dense, memories, buffer, edges, knobs, reader, kinds, activation):
    active = [m for m in memories if m["superseded_by"] is None]
    own = [w for w in words(query) if len(w.encode()) >= 2 and w not in QUERY_STOPWORDS]
    idf = {}
    for w in own:
        df = sum(has(set(words(m["text"])), w) for m in active) * own.count(w)
        idf[w] = math.log((max(len(active), 1) - df + 0.5) / (df + 0.5) + 1)
    intent = "temporal" if any(x in query.lower() for x in TEMPORAL_MARKERS) else "factual" if any(v >= 4 for v in idf.values()) else "general"
    sim = lambda m: 1 - 2 * distance(m["vector"], vector) / 2048
    pool = sorted((m for m in active if can_read(reader, m)), key=lambda m: (-sim(m), m["id"]))
    near = pool[: 4 * knobs.seeds]
    if dense is not None and near:
        head = near[: 2 * knobs.seeds]
        top = max(0.01, max(sim(m) for m in head))
        near = sorted(head, key=lambda m: -(0.4 * sim(m) / top + 0.6 * cosine(m["dense"], dense))) + near[2 * knobs.seeds :]
    seeds = [m["id"] for m in near if sim(m) >= 0.12][: knobs.seeds] or [m["id"] for m in near[:1]]
    ppr = brute_ppr(seeds, memories, edges, activation) if seeds else {}
    ids = set(ppr) | set(seeds) | {m["id"] for m in pool[: knobs.candidates] if sim(m) >= 0}
    fine = lambda m: m["superseded_by"] is None and can_read(reader, m) and (not kinds or m["kind"] in kinds)
    fresh = [m for m in sorted(buffer, key=lambda m: (-sim(m), m["id"]))[: knobs.candidates // 2] if fine(m)]
    rows = [(m, True) for m in fresh] + [(m, False) for m in memories if m["id"] in ids and fine(m)]
    considered, seen, kept = len(rows), set(), []
    for m, new in rows:
        if m["id"] not in seen:
            seen.add(m["id"])
            kept.append((m, new))
    total = sum(idf[w] for w in own)
    scored = []
    for m, new in kept:
        held = set(words(m["text"]))
        term = sum(idf[w] for w in own if has(held, w)) / total if total >= 1e-6 else 0.0
        weight = {}
        for k, tag in enumerate(m["tags"]):
            source = m["tag_sources"][k] if k < len(m["tag_sources"]) else "user"
            for piece in "".join(c if c.isalnum() or c == "_" else " " for c in tag).split():
                weight[piece.lower()] = max(weight.get(piece.lower(), 0), 1.0 if source == "auto" else 2.0)
        tag = 0.0
        for w in own:
            if has(weight, w):
                tag += idf[w] * (weight.get(w) or weight.get(w[:-1] if w.endswith("s") else w + "s") or 1.0)
        tag = tag / total if total >= 1e-6 else 0.0
        age = (NOW - (m["accessed_s"] if m["kind"] in ("preference", "decision") else m["created_s"])) / 86400
        life = HALF_LIFE[m["kind"]] * (3 if m["salience"] == "important" else 1)
        decay = m["importance"] + 1 if m["salience"] == "critical" else m["importance"] * 2 ** (-age / life) * (1 + 0.1 * math.log(1 + m["access_count"]))
        boost = 0.3 if m["supersedes"] is not None else 0.0
        if new:
            boost += knobs.buffer_boost
        elif intent != "factual" and m["kind"] == "event":
            boost += min(0.05, 0.05 / (1 + max(1, (NOW - m["created_s"]) * 1000) / 3.6e6))
        scored.append({"m": m, "new": new, "fp": sim(m), "ppr": 0.0 if new else ppr.get(m["id"], 0.0), "term": term, "tag": tag, "decay": decay, "dense": cosine(m["dense"], dense) if dense is not None else 0.0, "boost": boost})
    if not scored:
        return intent, "abstained", [], 0
    for s in scored:
        s["score"] = 0.02 * (s["term"] > 0) + 0.15 * s["dense"] + 0.05 * s["boost"]
    for signal, floor, by in (("fp", -1.0, 1), ("ppr", 0, 1), ("term", 0, 1), ("tag", 0, 0.8), ("decay", 0, 1)):
        for s in scored:
            if s[signal] > floor:
                s["score"] += by / (60 + sum(o[signal] > s[signal] + 1e-12 for o in scored))
    top = max(s["score"] for s in scored)
    if top > 0.01:
        scored = [s for s in scored if s["score"] >= 0.25 * top]
    if dense is not None and len(scored) > 2:
        middle = sorted(s["dense"] for s in scored)[len(scored) // 2]
        for s in scored:
            if middle > 0.15 and s["dense"] < 0.4 * middle:
                s["score"] *= 0.5
    scored.sort(key=lambda s: (-s["score"], -s["m"]["created_s"], s["m"]["id"]))
    scored = scored[: knobs.candidates]
    by_age = sorted(range(len(scored)), key=lambda i: (scored[i]["m"]["created_s"], scored[i]["m"]["id"]))
    for place, i in enumerate(by_age):
        scored[i]["recency"] = place / max(len(scored) - 1, 1)
    picks = [scored[i] for i in select_diverse([{"score": s["score"], "tags": s["m"]["tags"], "tokens": s["m"]["token_count"], "recency": s["recency"], "fresh": s["m"]["kind"] == "event" or s["m"]["supersedes"] is not None} for s in scored], knobs.budget, knobs.spread)]
    first, margin = picks[0], picks[0]["score"] - (picks[1]["score"] if len(picks) > 1 else 0)
    floors = {"factual": (0.012, 0.3), "temporal": (0.003, 0.0), "general": (0.005, 0.0)}[intent]
    verdict = "low_confidence" if first["score"] < knobs.score_floor else "ambiguous_leader" if len(picks) > 1 and margin < max(knobs.margin_floor, floors[0]) else "unsupported_top" if first["term"] < floors[1] or (first["term"] <= 0 and first["dense"] < knobs.support_floor) else "confident"
    keep = {"confident": knobs.confident, "low_confidence": knobs.low, "ambiguous_leader": knobs.ambiguous}.get(verdict, 0)
    if verdict == "confident" and knobs.solo_score > 0 and first["score"] >= knobs.solo_score and (margin >= knobs.solo_margin or first["term"] >= 0.5):
        keep = 1
    return intent, verdict, [(s["m"]["id"], s["score"], s["new"]) for s in (picks[:keep] if keep else picks)], considered


NAMES = [c.split()[0] for c in "id,text,tags,kind,salience,agent,user,session,shared_with,importance,created_s,accessed_s,access_count,superseded_by,token_count,version,supersedes,tag_sources,attributes,vector,dense".split(",")]


def made(rng, i):
    text, tags = " ".join(rng.choices(WORDS, k=rng.randint(3, 9))), rng.sample(WORDS, rng.randint(0, 3))
    created = NOW - rng.randint(1, 200) * 43_200 - i
    user = rng.choice([None, "u"])
    row = (i, text, tags, rng.choice(["fact", "event", "decision", "preference", "goal"]), rng.choice(["routine"] * 6 + ["important", "critical"]), rng.choice(["a", "a", "b"]), user, rng.choice([None, "s"]) if user else None, rng.choice([[], [], ["a"]]), round(rng.random(), 3), created, created + rng.randint(0, 9999), rng.randint(0, 5), rng.choice([None] * 7 + [1]), max(len(text) // 4, 1), 1, rng.choice([None] * 6 + [3]), rng.choice([["auto"], [], ["user", "auto"]]), {}, hyper.fingerprint_of(text, tags), [round(rng.uniform(-1, 1), 3) for _ in range(4)])
    return dict(zip(NAMES, row, strict=True))


@pytest.mark.parametrize(("seed", "dense", "kinds", "knobs"), [(1, False, (), Knobs()), (2, True, (), Knobs(budget=20, confident=2, ambiguous=3, solo_score=0.05)), (3, False, ("fact", "event"), Knobs(seeds=2, candidates=8, budget=30))])
def test_recall(spark, seed, dense, kinds, knobs):
    rng = random.Random(seed)
    memories, buffer = [made(rng, i) for i in range(60)], [made(rng, i) for i in range(55, 75)]
    edges = [(rng.randrange(60), rng.randrange(70), rng.choice(list(EDGE_WEIGHT))) for _ in range(70)]
    edges = [*{(s, d, k): None for s, d, k in edges if s != d}]
    activation = {i: round(rng.random(), 2) for i in range(0, 60, 7)}
    queries = {0: "redis cache latency today", 1: "which postgres index for billing invoices", 2: "zebra", 3: "", 4: "tokens and login logins"}
    frame = lambda rows: spark.createDataFrame([tuple(r[c] for c in NAMES) for r in rows], SCHEMA)
    asked = {q: (hyper.fingerprint_of(t, []), [rng.uniform(-1, 1) for _ in range(4)] if dense else None) for q, t in queries.items()}
    df = spark.createDataFrame([(q, t, asked[q][0], asked[q][1]) for q, t in queries.items()], "query_id bigint, text string, vector array<bigint>, dense array<double>")
    reader = Scope("a", "u")
    wanted = F.col("kind").isin(*kinds) if kinds else None
    out = recall(df, frame(memories), spark.createDataFrame([(s, d, k, n) for n, (s, d, k) in enumerate(edges)], EDGE), knobs, NOW, readable=reader.can_read(), wanted=wanted, buffer=frame(buffer), activation=spark.createDataFrame(list(activation.items()), "id bigint, value double")).collect()
    for q, text in queries.items():
        intent, verdict, picks, considered = brute_recall(text, *asked[q], memories, buffer, edges, knobs, ("a", "u", None), kinds, activation)
        got = sorted((r for r in out if r.query_id == q), key=lambda r: r.pick)
        assert {(r.intent, r.verdict, r.considered) for r in got} == {(intent, verdict, considered)}
        assert [(r.id, r.from_buffer) for r in got] == [(i, new) for i, _, new in picks]
        assert [r.score for r in got] == pytest.approx([s for _, s, _ in picks], abs=1e-9)


def test_nothing_to_recall(spark):
    memories = spark.createDataFrame([], SCHEMA)
    asked = spark.createDataFrame([(1, "redis today", hyper.fingerprint_of("redis", []))], "query_id bigint, text string, vector array<bigint>")
    rows, ranks = recall_block(asked, memories, spark.createDataFrame([], EDGE), Knobs(), NOW)
    assert [(r.query_id, r.id, r.verdict, r.intent, r.considered) for r in rows.collect()] == [(1, None, "abstained", "temporal", 0)]
    assert ranks.collect() == []


def brute_consolidate(buffer, memories):
    """Entry by entry against a graph that grows: verdicts, the graph after it, edges and counters."""
    there = {m["id"]: dict(m, tags=list(m["tags"])) for m in memories}
    edges, report, verdicts = set(), dict.fromkeys(("processed", "promoted", "reinforced", "dropped", "edges_created"), 0), {}
    for e in buffer:
        report["processed"] += 1
        reader = (e["agent"], e["user"], e["session"])
        near = sorted((distance(m["vector"], e["vector"]), k) for k, m in enumerate(there.values()) if m["superseded_by"] is None and can_read(reader, m))
        order = list(there)
        best = 1 - 2 * near[0][0] / 2048 if near else 0.0
        if e["supersedes"] is not None or best < 0.65:
            best = 1.0 if e["supersedes"] is not None else best
            new = dict(e, tags=list(e["tags"]))
            if best < 0.05 and len(there) >= 30:
                new |= {"salience": "critical", "importance": 1.0}
            for o in there.values():
                if o["superseded_by"] is None and can_read(reader, o) and len({*o["tags"]} & {*e["tags"]}) >= 2:
                    edges |= {(e["id"], o["id"], "relates_to"), (o["id"], e["id"], "relates_to")}
                    report["edges_created"] += 2
                    if e["kind"] == o["kind"] == "event":
                        report["edges_created"] += 2
                        if e["created_s"] != o["created_s"]:
                            a, b = sorted((e, o), key=lambda m: m["created_s"])
                            edges |= {(a["id"], b["id"], "before"), (b["id"], a["id"], "after")}
            there[e["id"]] = new
            report["promoted"] += 1
            verdicts[e["id"]] = "novel"
        else:
            hit = there[order[near[0][1]]]
            hit["access_count"] += 1
            hit["accessed_s"] = NOW
            if best >= 0.85:
                report["dropped"] += 1
                verdicts[e["id"]] = "redundant"
            else:
                hit["tags"] += [t for t in dict.fromkeys(e["tags"]) if t not in hit["tags"]]
                hit["version"] += 1
                hit["importance"] = max(hit["importance"], e["importance"])
                report["reinforced"] += 1
                verdicts[e["id"]] = "reinforces"
    return there, edges, report, verdicts


@pytest.mark.parametrize(("seed", "size"), [(1, 40), (2, 40), (3, 5), (4, 29)])
def test_consolidation_through_the_engine(spark, seed, size):
    rng = random.Random(seed)
    memories = [made(rng, i) for i in range(size)]
    for m in memories:
        m["superseded_by"] = None
    drafts, buffer = [], []
    for i in range(100, 140):
        m = made(rng, i)
        if rng.random() < 0.5:  # like one that is there, or like an earlier entry
            source = rng.choice(memories + buffer)
            text = source["text"] if rng.random() < 0.5 else source["text"] + " " + rng.choice(WORDS)
            m |= {"text": text, "tags": list(dict.fromkeys([*source["tags"], *rng.sample(WORDS, 1)]))[: rng.randint(0, 4)], "agent": source["agent"], "user": source["user"], "session": source["session"]}
        m |= {"superseded_by": None, "supersedes": None, "vector": hyper.fingerprint_of(m["text"], m["tags"]), "created_s": NOW - 50, "accessed_s": NOW - 50, "access_count": 0, "version": 1}
        buffer.append(m)
        drafts.append(Draft(i, m["text"], m["kind"], m["tags"], Scope(m["agent"], m["user"], m["session"]), m["importance"], m["salience"], m["shared_with"]))
    columns = NAMES[:-1]
    engine = MemoryEngine(spark, spark.createDataFrame([tuple(m[c] for c in columns) for m in memories], MEMORY))
    engine.remember(drafts, NOW - 50)
    there, edges, report, verdicts = brute_consolidate(buffer, memories)
    assert len({*verdicts.values()}) == 3
    assert engine.consolidate(NOW).first().asDict() == report
    got = {r.id: r for r in engine.memories.collect()}
    assert set(got) == set(there)
    for i, m in there.items():
        for c in ("tags", "salience", "importance", "accessed_s", "access_count", "version"):
            assert got[i][c] == m[c], (i, c)
    assert {(r.src, r.dst, r.kind) for r in engine.edges.collect()} == edges
    assert engine.buffer.count() == 0


def test_engine_buffers_consolidates_and_resets(spark, monkeypatch):
    from remembrix import engine as module

    monkeypatch.setattr(module, "TRIGGER", 4)
    engine, me = MemoryEngine(spark), Scope("a")
    engine.remember([Draft(i, f"{WORDS[i]} note {WORDS[i + 8]}", scope=me) for i in range(3)], now=10)
    assert engine.memories.count() == 0 and engine.stats().first().buffer_size == 3
    engine.remember([Draft(3, "gamma delta", scope=me)], now=20)
    assert engine.memories.count() == 4 and engine.buffer.count() == 0
    engine.remember([Draft(i, f"{WORDS[i]} {WORDS[i + 9]} again", scope=me) for i in range(4, 8)], now=30)
    assert engine.buffer.count() == 4  # too soon
    assert [r.id for r in engine.drain(F.col("id") == 5).collect()] == [5] and engine.buffer.count() == 3
    monkeypatch.setattr(module, "CAPACITY", 2)
    monkeypatch.setattr(module, "TRIGGER", 100)
    assert [r.id for r in engine.remember([Draft(9, "rust", scope=me)], now=40).collect()] == [4, 6]
    engine.update_vectors(spark.createDataFrame([(3, [7] * 32), (77, [1] * 32)], "id bigint, vector array<bigint>"))
    assert engine.get(3).first().vector == [7] * 32 and engine.get(9).first().text == "rust"
    assert engine.reset() == 6 and engine.memories.count() == engine.buffer.count() == 0


def test_engine_attributes_sources_and_priming(spark):
    engine, me = MemoryEngine(spark), Scope("a")
    engine.remember([Draft(1, "flat in Seattle", attributes={"price": 75, "city": "Seattle", "tags": ["x"], "new": True}, scope=me), Draft(2, "flat in Portland", attributes={"price": "50"}, scope=me, tags=["flat"]), Draft(3, "We deployed Redis", auto_tags=True, scope=me, kind="goal")], now=100)
    engine.consolidate(110)
    found = engine.recall([(0, "flat")], me, 200, where={"price": attrs.Gt(60)}).collect()
    assert [r.id for r in found] == [1]
    assert engine.mismatched_attributes({"price": attrs.Gt(60), "city": attrs.Eq("Seattle")}) == ["price"]
    third = engine.get(3).first()
    assert third.tags and set(third.tag_sources) == {"auto"} and engine.get(2).first().tag_sources == ["user"]
    engine.reconsolidate(3, ["mine"])
    third = engine.get(3).first()
    assert third.tags[-1] == "mine" and third.tag_sources[-1] == "user" and third.vector == hyper.fingerprint_of(third.text, third.tags)
    engine.recall([(0, "flat")], me, 210, primed=True)
    first = {r.id: r.value for r in engine.activation.collect()}
    assert first[3] == 1.0 and 0 < first[1] < 1  # goals stay at 1
    engine.recall([(0, "flat")], me, 240, primed=True)
    assert engine.get(1).first().access_count >= 2
    engine.clear_activation()
    assert engine.activation.count() == 0
    assert consolidation.REDUNDANT == 0.85


def test_engine_with_vectors_of_an_embedding(spark):
    embed = lambda text: F.array(F.length(text).cast("float"), F.lit(1.0).cast("float"))
    engine, me = MemoryEngine(spark, embed=embed), Scope("a")
    engine.remember([Draft(1, "redis", scope=me), Draft(2, "postgres postgres postgres", scope=me)], now=100)
    rows = engine.recall([(0, "redis cache")], me, 200).orderBy("pick").collect()
    assert rows[0].id == 1 and rows[0].from_buffer and rows[0].score > 0.15


def test_think_and_contexts(spark):
    engine, me = MemoryEngine(spark), Scope("a")
    engine.remember([Draft(1, "redis is fast", scope=me), Draft(2, "redis is slow", scope=me, tags=["redis"]), Draft(3, "rust", scope=me)], now=100)
    engine.consolidate(110)
    engine.link([(1, 2, "contradicts"), (3, 9, "contradicts")])
    assert [tuple(r) for r in engine.think("how fast is redis").collect()] == [(1, 2)]
    picks = engine.recall([(0, "redis")], me, 200)
    assert engine.numbered_context(picks).first().context.startswith("1. [fact] redis is")
    assert engine.context(picks).first().context.startswith("- redis is")
