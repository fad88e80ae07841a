"""Operators over whole tables, against brute force."""

import random

import pytest
from pyspark.sql import functions as F
from test_catalogue import SF

from remembrix import plans
from remembrix.functions import hyper, scoring
from remembrix.operators import consolidation, graph, legacy, nearest, ranking
from remembrix.schema import EDGE, EDGE_WEIGHT, memories


def test_linked_classes_with_several_tags(spark):
    made = [(i, f"a{i % 2}", [t for k, t in enumerate("pqrst") if i >> k & 1], ("event", "fact")[i % 3 == 0], i // 2 * 50_000) for i in range(64)]
    made += [(100, None, ["p", "q"], "event", 5), (101, None, ["q", "p", "p"], "event", 6)]
    df = spark.createDataFrame(made, "id bigint, agent string, tags array<string>, kind string, created_s bigint")
    got = {r.id: tuple(r)[1:] for r in consolidation.linked(df).collect()}
    for i, agent, tags, kind, at in made:
        mine = [m for m in made if m[0] != i and m[1] == agent and len({*m[2]} & {*tags}) >= 2]
        timed = [m for m in mine if kind == m[3] == "event"]
        same = min(m[0] for m in made if m[1] == agent and {*m[2]} == {*tags})
        assert got[i] == (same, len(mine), sum(m[4] > at for m in timed), sum(m[4] < at for m in timed))


@pytest.mark.parametrize("name", ["mmr_pick", "recall_full"])
def test_items_beyond_the_first_are_answered(spark, name):
    assert plans.QUERIES[name](spark, SF).filter("query_id >= 10").count()


def test_knapsack_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(ranking, "STRETCH", 3)
    costs = [9, 40, 41, 42, 5, 30, 1, 7, 7, 2, 1, 8, 0]
    left, expected = 30, []
    for k, cost in enumerate(costs):
        if cost <= left:
            left -= cost
            expected.append(k)
    df = spark.createDataFrame(list(enumerate(costs)), "id bigint, cost bigint").repartition(3)
    assert [r.id for r in ranking.knapsack(df, F.struct("id"), F.col("cost"), 30)] == expected
    assert ranking.knapsack(df, F.struct("id"), F.col("cost"), -1) == []


def test_snapshot_goes_on_past_long_rows(spark):
    nodes = spark.createDataFrame([(i, 500 if i < 60 else 6, 1.0 if i < 60 else 0.1) for i in range(100)], "id bigint, words bigint, importance double")
    edges = spark.createDataFrame([(i, i + 1, "supports", i) for i in range(99)], "src bigint, dst bigint, kind string, seq bigint")
    got = legacy.snapshot(nodes, edges, 50).collect()
    ranks = {r.id: r.ppr for r in graph.global_pagerank(edges, nodes, nodes.filter("id < 50").select("id")).collect()}
    order = sorted(range(100), key=lambda i: (-ranks[i] * (1.0 if i < 60 else 0.55), i))
    expected = [(i, order.index(i)) for i in order if i >= 60][:4]
    assert sorted((r.place, r.id) for r in got) == sorted((p, i) for i, p in expected)


def test_link_totals_count_what_links_gives(spark):
    r = random.Random(1)

    def row(i):
        user = r.choice([None, None, "u0", "u1"])
        return i, r.choice(["a0", "a1", None]), user, user and r.choice([None, "s0"]), r.choice([None, [], ["a0"], ["a1", "a0", "a0"]]), r.sample("pqrs", r.randrange(1, 5)), r.choice(["event", "fact"]), (i or 0) // 3, r.choice([None, *[(i or 0) % 7 * 100] * 5])

    schema = "id bigint, agent string, user string, session string, shared_with array<string>, tags array<string>, kind string, created_s bigint, seq bigint"
    novel, old = [row(i) for i in [*range(60), 3, 4, None]], [row(i) for i in [*range(50, 150), 120]]
    novel, old = spark.createDataFrame([*novel, novel[9]], schema), spark.createDataFrame([*old, old[7]], schema).drop("seq")
    met = consolidation.links(novel, old)
    got = consolidation.link_totals(novel, old).first()
    assert (got.links, got.timed) == (met.count(), met.filter("ka = 'event' AND kb = 'event'").count()) and got.timed


def test_report_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(consolidation, "links", None)
    assert plans.QUERIES["consolidation_report"](spark, SF).first().edges_created > 0


def test_nearest_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ROWS", 7)
    monkeypatch.setattr(nearest, "COLUMNS", 5)
    r = random.Random(2)
    lanes = lambda: [r.randrange(-(1 << 63), 1 << 63) for _ in range(hyper.LANES)]
    some = [lanes() for _ in range(20)]
    made = [(i, r.choice([*some, lanes(), [~x for x in some[0]]])) for i in range(80)]
    far = lambda a, b: sum(bin((x ^ y) % (1 << 64)).count("1") for x, y in zip(a, b, strict=True))
    rows = spark.createDataFrame(made, "id bigint, vector array<bigint>").repartition(3)
    asked = rows.filter("id % 7 = 0").withColumnRenamed("id", "query_id")
    got = ranking.first_k(nearest.by_hamming(asked, rows, 5), 5, [F.col("value"), F.col("id")]).collect()
    assert sorted((x.query_id, x.value, x.id) for x in got) == sorted((q, *best) for q, v in made[::7] for best in sorted((far(v, w), i) for i, w in made)[:5])
    one = lambda: [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]
    odd = [(i, one()) for i in range(60)] + [(60, None), (61, []), (62, [1.0, None, 1.0]), (63, [1.0, 2.0]), (64, [2.0, 1.0]), (65, [0.0, 0.0, 0.0]), (66, [float("nan"), 1.0, 0.0])]
    rows = spark.createDataFrame(odd, "id bigint, vector array<float>").repartition(3)
    asked = rows.filter("id % 6 = 0 OR id > 59").withColumnRenamed("id", "query_id")
    got = ranking.first_k(nearest.by_cosine(asked, rows, 5), 5, [F.col("value"), F.col("id")]).collect()
    pairs = asked.withColumnRenamed("vector", "v").join(rows, F.lit(True)).select("query_id", "id", F.round(scoring.cosine(F.col("vector"), F.col("v")), 9).alias("sim"))
    expected = ranking.first_k(pairs, 5, [F.desc("sim"), F.col("id")]).collect()
    assert sorted((x.query_id, x.id) for x in got) == sorted((x.query_id, x.id) for x in expected)


def test_customers_without_a_name_come_last(spark, tmp_path):
    for name in ("few", "many"):
        spark.createDataFrame([(i, None if i in (50, 51, 3) else f"c{i}") for i in (range(49, 53) if name == "few" else range(200))], "c_custkey bigint, c_name string").write.parquet(str(tmp_path / name / "customer.parquet"))
        got = {}
        for x in plans.QUERIES["hamming_topk"](spark, str(tmp_path / name)).collect():
            got.setdefault(x.query_id, []).append((x.c_custkey, x.distance))
        if name == "few":
            assert sorted(got[50]) == [(i, None) for i in range(49, 53)]
        else:
            assert sorted(got[50]) == [(i, None) for i in range(5)] and (100, 0) in got[100] and not any(d is None for _, d in got[100])


def test_packed_walks_equal_joins(spark):
    r = random.Random(3)
    made = [(r.randrange(60), r.randrange(60), r.choice([*EDGE_WEIGHT, "other"]), i) for i in range(70)]
    made += made[:5] + [(7, None, "supports", 0), (None, 9, "supports", 0)]
    edges = spark.createDataFrame(made, EDGE)
    seeds = spark.createDataFrame([(q, i) for q in range(100, 112) for i in r.sample(range(70), 1 + q % 3)] + [(200, 999), (201, 7), (201, 998)], "query_id bigint, id bigint")
    whole = graph.packed(edges)
    got = sorted((x.query_id, x.id, x.depth) for x in graph.packed_neighbourhood(whole, seeds).filter("id IS NOT NULL").collect())
    assert got == sorted((x.query_id, x.id, x.depth) for x in graph.neighbourhood(edges, seeds).filter("id IS NOT NULL").collect())
    assert graph.packed_neighbourhood(whole, seeds).filter("id IS NULL AND query_id = 201").collect()[0].depth == 1
    full = edges.dropna()
    ranks = {(x.query_id, x.id): x.ppr for x in graph.packed_pagerank(graph.packed(full), seeds).collect()}
    assert ranks == pytest.approx({(x.query_id, x.id): x.ppr for x in graph.personalized_pagerank(full, seeds).collect()})


@pytest.mark.parametrize("name", ["k_hop", "ppr"])
def test_large_graphs_are_walked_by_joins(spark, monkeypatch, name):
    found = lambda: sorted(map(tuple, plans.QUERIES[name](spark, SF).collect()))
    by_arrays = found()
    monkeypatch.setattr(graph, "MOST_ARCS", 5)
    assert graph.packed(plans.retrieval.edges(spark, SF)) is None and found() == by_arrays
