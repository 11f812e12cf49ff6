"""Graph metrics, traversals and comparisons on small graphs with known answers, and both plans against each other."""

import math
import random

import pytest
from pyspark.sql import functions as F

from arbora.operators import centrality, diff, edges, structure, traversal


def graph(spark, ids, pairs):
    nodes = spark.createDataFrame([(x, x, i) for i, x in enumerate(ids)], "id string, label string, ordinal int")
    e = spark.createDataFrame([(a, b, "R", i) for i, (a, b) in enumerate(pairs)], "from_id string, to_id string, relation string, ordinal int")
    return nodes, e, edges.adjacency(e, nodes)


def values(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


CHAIN = (list("abcde"), [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")])


def test_invalid_edges_do_not_count(spark):
    nodes, _, adj = graph(spark, list("abc"), [("a", "b"), ("a", "b"), ("a", "a"), ("a", "x")])
    got = values(edges.degrees(nodes, adj), "fan_in", "fan_out", "degree_centrality")
    assert got == {"a": (0, 1, 0.25), "b": (1, 0, 0.25), "c": (0, 0, 0.0)}


def test_isolated_node(spark):
    nodes, _, adj = graph(spark, ["a"], [])
    assert values(centrality.pagerank(nodes, adj), "pagerank") == {"a": pytest.approx(1.0)}
    assert values(centrality.betweenness(nodes, adj), "betweenness_centrality") == {"a": 0.0}
    assert values(edges.degrees(nodes, adj), "degree_centrality") == {"a": 0.0}


def test_empty_graph(spark):
    nodes, _, adj = graph(spark, [], [])
    for local in (None, 0):
        assert centrality.pagerank(nodes, adj, local_edges=local).count() == 0
        assert centrality.hits(nodes, adj, local_edges=local).count() == 0


@pytest.mark.parametrize("local", [None, 0])
def test_betweenness_of_chains(spark, local):
    nodes, _, adj = graph(spark, list("abcd"), CHAIN[1][:3])
    got = values(centrality.betweenness(nodes, adj, local_edges=local), "betweenness_centrality")
    assert got["b"] == pytest.approx(1 / 3) and got["c"] == pytest.approx(1 / 3) and got["a"] == got["d"] == 0
    nodes, _, adj = graph(spark, *CHAIN)
    sources, strategy, k = centrality.sample_sources(nodes, 4, 2)
    assert (strategy, k, sorted(r[0] for r in sources.collect())) == ("deterministic_sampled", 2, ["a", "c"])
    got = values(centrality.betweenness(nodes, adj, sources, local_edges=local), "betweenness_centrality")
    assert [round(got[x], 6) for x in "abcde"] == [0, 0.333333, 0.333333, 0.5, 0] or [round(got[x], 6) for x in "abcde"] == [0, 0.5, 0.333333, 0.333333, 0]


@pytest.mark.parametrize("n,k", [(7, 3), (10, 10), (11, 4), (600, 100)])
def test_sampling_is_even(spark, n, k):
    ids = [f"n{i:04d}" for i in range(n)]
    nodes = spark.createDataFrame([(x,) for x in ids], "id string")
    got = sorted(r[0] for r in centrality.sample_sources(nodes, 0, k)[0].collect())
    assert got == sorted({ids[j * n // k] for j in range(k)})
    assert centrality.sample_sources(nodes, 0, 2, sampler=lambda ordered, size: [ordered[-1], "other", ordered[-1]])[2] == 1


def test_both_plans_agree(spark):
    rng = random.Random(5)
    ids = [f"n{i}" for i in range(25)]
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(60)]
    nodes, _, adj = graph(spark, ids, pairs)
    for f, columns, options in ((centrality.pagerank, ["pagerank"], dict(iterations=4, tolerance=None)), (centrality.hits, ["hub_score", "authority_score"], dict(iterations=3, tolerance=None)),
                                (centrality.betweenness, ["betweenness_centrality"], {})):
        a, b = values(f(nodes, adj, **options), *columns), values(f(nodes, adj, local_edges=0, **options), *columns)
        assert a.keys() == b.keys()
        for x in a:
            assert a[x] == pytest.approx(b[x], abs=1e-12)


def test_pagerank_against_plain_model(spark):
    ids, pairs = list("abcd"), [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")]
    nodes, _, adj = graph(spark, ids, pairs)
    out = {x: sorted({b for a, b in pairs if a == x}) for x in ids}
    score = dict.fromkeys(ids, 0.25)
    for _ in range(100):
        loose = sum(score[x] for x in ids if not out[x])
        new = {x: 0.15 / 4 + 0.85 * loose / 4 + sum(0.85 * score[y] / len(out[y]) for y in ids if x in out[y]) for x in ids}
        change, score = sum(abs(new[x] - score[x]) for x in ids), new
        if change <= 1e-10:
            break
    got = values(centrality.pagerank(nodes, adj), "pagerank")
    assert all(math.isclose(got[x], score[x], abs_tol=1e-12) for x in ids)


def test_neighbourhood(spark):
    nodes, _, adj = graph(spark, *CHAIN)
    costs = nodes.select("id", F.lit(2.0).alias("effective_token_cost"))
    got = values(centrality.neighbourhood_cost(costs, adj), "hop_2_node_count", "hop_3_node_count", "hop_3_token_cost")
    assert got["a"] == (2, 3, 6.0) and got["c"] == (4, 4, 8.0)


def test_all_metrics(spark):
    nodes, _, adj = graph(spark, *CHAIN)
    costs = nodes.select("id", F.lit(4).alias("token_cost"), F.lit(4.0).alias("effective_token_cost"))
    m = centrality.node_metrics(nodes, adj, costs)
    assert m.count() == 5 and {"hub_score", "hop_2_token_cost", "weighted_centrality_cost", "fan_in"} <= set(m.columns)
    top = edges.rankings(m, ["pagerank", "hop_3_token_cost"])
    assert {r["metric"] for r in top.collect()} == {"pagerank", "hop_3_token_cost"} and top.count() == 10


def test_rankings_keep_input_order_on_ties(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"n{i}", i, 1.0) for i in range(15)], "id string, label string, ordinal int, v double")
    assert [r["id"] for r in edges.top_ranked(nodes, "v").orderBy("rank").collect()] == [f"n{i}" for i in range(10)]


def test_merged_edges(spark):
    e = spark.createDataFrame([("a", "b", "R", 2, "x"), ("a", "b", "R", 1, "y"), ("a", "b", "S", 3, "z")], "from_id string, to_id string, relation string, ordinal int, confidence string")
    assert {(r["relation"], r["weight"], r["confidence"]) for r in edges.merge_edges(e).collect()} == {("R", 2.0, "y"), ("S", 1.0, "z")}


def test_closure_and_components(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")]
    nodes, _, adj = graph(spark, list("abcdef"), pairs)
    reach = {(r["seed"], r["node"]): r["depth"] for r in traversal.closure(adj, nodes.filter("id = 'a'")).collect()}
    assert reach == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2}
    assert values(traversal.components(nodes, adj), "component") == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}
    assert {r[0] for r in traversal.cyclic_nodes(adj).collect()} == {"a", "b", "c"}


def test_long_chain_component(spark):
    ids = [f"n{i:03d}" for i in range(60)]
    nodes, _, adj = graph(spark, ids, list(zip(ids, ids[1:])))
    assert set(values(traversal.components(nodes, adj), "component").values()) == {"n000"}


def test_cut_points(spark):
    nodes, _, adj = graph(spark, list("abcdef"), [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d")])
    cuts, bridges = structure.cut_points(adj)
    assert {r[0] for r in cuts.collect()} == {"c", "d"} and [tuple(r) for r in bridges.collect()] == [("c", "d")]


def _parts(nodes, near, skip=None, cut=None):
    """The number of connected parts, without a node or an edge."""
    seen, n = {skip}, 0
    for s in nodes:
        if s not in seen:
            n += 1
            stack = [s]
            seen.add(s)
            while stack:
                v = stack.pop()
                for w in near[v] - seen:
                    if {v, w} != cut:
                        seen.add(w)
                        stack.append(w)
    return n


@pytest.mark.parametrize("seed", [1, 2])
def test_structure_equals_a_walk(spark, seed):
    """Cut points, bridges, strong components and search growth of random graphs, with a path among them, against walks."""
    rng = random.Random(seed)
    ids = [f"v{i:02d}" for i in range(26)]
    pairs = {tuple(rng.sample(ids[:18], 2)) for _ in range(19)} | set(zip(ids[17:], ids[18:]))
    near = {v: {b for a, b in pairs if a == v} | {a for a, b in pairs if b == v} for v in ids}
    adj = spark.createDataFrame(sorted(pairs) + [("v00", "v00")], "src string, dst string")
    whole = _parts(ids, near)
    cuts, bridges = structure.cut_points(adj)
    assert {r[0] for r in cuts.collect()} == {v for v in ids if near[v] and _parts(ids, near, v) > whole}
    assert {(r["a"], r["b"]) for r in bridges.collect()} == {(min(p), max(p)) for p in pairs if _parts(ids, near, None, set(p)) > whole}
    reach = {v: {v} for v in ids}
    for _ in ids:
        reach = {v: r | {b for a, b in pairs if a in r} for v, r in reach.items()}
    groups = {v: {w for w in reach[v] if v in reach[w]} for v in ids}
    assert {r["id"]: r["component"] for r in structure.strong_components(adj).collect()} == {v: min(g) for v, g in groups.items() if len(g) > 1}
    assert {r[0] for r in traversal.cyclic_nodes(adj).collect()} == {v for v, g in groups.items() if len(g) > 1} | {"v00"}
    order = sorted(pairs, key=lambda _: rng.random())
    entered = dict.fromkeys(ids[3:5], -1)
    for i, (a, b) in enumerate(order):
        for x, y in ((a, b), (b, a)):
            if x in entered:
                entered.setdefault(y, i)
    rows = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(order)], "from_id string, to_id string, at long")
    assert {r["id"]: r["entered"] for r in structure.search_growth(rows, spark.createDataFrame([(x,) for x in ids[3:5]], "id string")).collect()} == entered


def test_structure_of_nothing(spark):
    none = spark.createDataFrame([], "src string, dst string")
    cuts, bridges = structure.cut_points(none)
    assert cuts.count() == bridges.count() == 0 and structure.strong_components(none).count() == 0
    loop = spark.createDataFrame([("a", "a")], "src string, dst string")
    assert [x.count() for x in structure.cut_points(loop)] == [0, 0] and traversal.cyclic_nodes(loop).count() == 1


def test_a_node_between_cycles_is_on_none(spark):
    _, _, adj = graph(spark, list("abcdx"), [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("b", "x"), ("x", "c")])
    assert {r[0] for r in traversal.cyclic_nodes(adj).collect()} == set("abcd")


def test_closure_paths(spark):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}", "x") for i in range(11)] + [("n00", "n05", "b"), ("n00", "n05", "a"), ("n11", "n00", "back")]
    got = {r["node"]: r for r in traversal.closure_paths(spark.createDataFrame(chain, "src string, dst string, label string"), spark.createDataFrame([("n00",)], "id string")).collect()}
    assert got["n00"]["path"] == [] and got["n11"]["depth"] == 7
    assert [(s["src"], s["label"], s["dst"]) for s in got["n11"]["path"]] == [("n00", "a", "n05")] + [(f"n{i:02d}", "x", f"n{i + 1:02d}") for i in range(5, 11)]
    assert [(s["src"], s["label"], s["dst"]) for s in got["n06"]["path"]] == [("n00", "a", "n05"), ("n05", "x", "n06")]


def test_prefixes(spark):
    roots = spark.createDataFrame([("app", "r0", "/api", ["x"])], "root string, router string, prefix string, tags array<string>")
    inc = spark.createDataFrame([("r0", "r1", "/v1", ["y"]), ("r1", "r2", "users/", ["x"]), ("r2", "r0", "/loop", [])], "parent string, child string, prefix string, tags array<string>")
    got = {r["router"]: (r["prefix"], r["tags"]) for r in traversal.path_prefixes(roots, inc).collect()}
    assert got == {"r0": ("/api", ["x"]), "r1": ("/api/v1", ["x", "y"]), "r2": ("/api/v1/users", ["x", "y"])}


def test_diff(spark):
    schema = "id string, n int, tags array<string>, c struct<t:int>"
    before = spark.createDataFrame([("a", 1, ["x"], (1,)), ("b", 1, None, (2,)), ("c", 1, ["x"], (3,))], schema)
    after = spark.createDataFrame([("a", 1, ["y"], (1,)), ("b", 1, None, (2,)), ("d", 1, ["x"], None)], schema)
    got = {r["id"]: (r["status"], [tuple(f) for f in r["fields"]]) for r in diff.diff(before, after, ("n", "tags", "c.t")).collect()}
    assert got == {"a": ("changed", [("tags", '["x"]', '["y"]')]), "c": ("removed", []), "d": ("added", [])}
