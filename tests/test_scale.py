"""Work of operators that must not grow with rounds, hot keys or repeats; each against its plain result."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import functions as F

from arbora.operators import centrality, edges
from .test_graph import graph, values


def test_pagerank_joins_no_more_once_walks_end(spark, monkeypatch):
    tables, own = [], centrality.staged
    monkeypatch.setattr(centrality, "staged", lambda df, name, **o: tables.append(name) or own(df, name, **o))
    ids = [f"n{i}" for i in range(12)]
    nodes, _, adj = graph(spark, ids, [(f"n{i}", f"n{9 + i % 3}") for i in range(9)] + [("n10", "n11")])
    got = values(centrality.pagerank(nodes, adj, tolerance=None, iterations=20, local_edges=0), "pagerank")
    assert len(tables) < 10
    want = values(centrality.pagerank(nodes, adj, tolerance=None, iterations=20), "pagerank")
    assert got == pytest.approx(want, abs=1e-14)


@pytest.mark.parametrize("tolerance", [None, 0.05, 1e-10])
def test_pagerank_goes_on_behind_its_powers(spark, monkeypatch, tolerance):
    monkeypatch.setattr(centrality, "POWERS", 3)
    rng = random.Random(3)
    ids = [f"n{i}" for i in range(20)]
    nodes, _, adj = graph(spark, ids, [(rng.choice(ids), rng.choice(ids)) for _ in range(40)])
    got = values(centrality.pagerank(nodes, adj, tolerance=tolerance, iterations=6, local_edges=0), "pagerank")
    assert got == pytest.approx(values(centrality.pagerank(nodes, adj, tolerance=tolerance, iterations=6), "pagerank"), abs=1e-14)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("limit", [0, 10])
def test_implementations_compare_pairs_only_where_they_can_repeat(spark, monkeypatch, limit):
    monkeypatch.setattr(edges, "BROADCAST_COMPONENTS", limit)
    left = [("a", 1, 1), ("a", 1, 1), ("a", 2, 1), ("b", 1, 1), ("c", 1, 1)]
    right = [("x", 1, 1), ("x", 2, 1), ("y", 1, 1), ("y", 1, 1)]
    made = lambda rows: spark.createDataFrame(rows, "id string, n int, g int")
    for one, two in ((left, right), (left, right[:1] + right[2:]), (left[:2] + left[3:], right)):
        got = edges.implemented_by(made(one), made(two), ["n", "g"], "exact")
        pairs = sorted((r["from_id"], r["to_id"]) for r in got.collect())
        assert pairs == sorted({(a[0], b[0]) for a in one for b in two if a[1:] == b[1:]})
        if (one, two) != (left, right):
            assert not plan(got).startswith("Aggregate")


def test_hits_shuffle_edges_once_a_side(spark, monkeypatch):
    tables, own = [], centrality.staged
    monkeypatch.setattr(centrality, "staged", lambda df, name, **o: tables.append(name) or own(df, name, **o))
    rng = random.Random(4)
    ids = [f"n{i}" for i in range(20)]
    nodes, _, adj = graph(spark, ids, [(rng.choice(ids), rng.choice(ids)) for _ in range(40)])
    for tolerance, rounds in ((None, 4), (0.2, 30)):
        tables.clear()
        got = values(centrality.hits(nodes, adj, tolerance, rounds, local_edges=0), "hub_score", "authority_score")
        want = values(centrality.hits(nodes, adj, tolerance, rounds), "hub_score", "authority_score")
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-12) for x in got)
        assert tables.count("edges") == 1
        assert tolerance is not None or tables.count("scores") == 2


def test_query_numbers_without_lists(spark):
    from arbora.operators import agentview, index
    from arbora.sources.profile import Profile

    files = spark.createDataFrame([(f"docs/{i}.txt", f"user {i % 3}\nthe user, the user\n{'' if i % 2 else 'seldom'}") for i in range(60)], "path string, content string")
    terms = spark.createDataFrame([("user",), ("the",), ("seldom",), ("absent",), ("the user",), ("user, the",)], "term string")
    none = F.array().cast("array<string>")
    clues = terms.select("term", none.alias("clue_kinds"), none.alias("origin_node_ids"), F.lit(None).cast("string").alias("rule_id"), none.alias("source_terms"))
    bare = spark.createDataFrame([], "id string, label string, kind string, span struct<file_path:string,start_line:int,end_line:int>")
    spans = spark.createDataFrame([(f"n{i}", "x", "f", (f"docs/{i}.txt", 1 + i % 2, 2)) for i in range(20)], bare.schema)
    for nodes in (bare, spans):
        readable = agentview.readable_nodes(nodes, files)
        want = agentview.query_nodes(index.occurrences(terms, files, readable), clues, "exact", Profile())
        got = agentview.query_counts(index.counts_by_node(terms, files, readable), clues, "exact", Profile())
        assert "collect" not in plan(got)
        columns = ["id", "term", "output_tokens", "excluded", "n_occurrences", "n_arrivals"]
        want = want.withColumns({"n_occurrences": F.size("occurrences"), "n_arrivals": F.size("arrival_node_ids")})
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_phrases_leave_no_line_to_a_join(spark):
    from arbora.operators import index

    files = spark.createDataFrame([("a.txt", "(x y) x y z\n(x y)\nx x x x\n((x y)), x  y"), ("b.txt", "é x y, (x y)")], "path string, content string")
    terms = spark.createDataFrame([("(x y)",), ("x y",), ("x x",), ("x y z",), ("y) x",), (", (x",)], "term string")
    found = index.find(terms, files)
    assert sorted((r["term"], r["path"], r["line"], r["col"]) for r in found.collect()) == sorted(
        [("x y", "a.txt", 1, 1), ("x y", "a.txt", 1, 6), ("x y", "a.txt", 2, 1), ("x y", "a.txt", 4, 2), ("x y", "b.txt", 1, 2), ("x y", "b.txt", 1, 8), ("(x y)", "a.txt", 1, 0), ("(x y)", "a.txt", 2, 0), ("(x y)", "a.txt", 4, 1),
         ("(x y)", "b.txt", 1, 7), ("x x", "a.txt", 3, 0), ("x x", "a.txt", 3, 5 - 1), ("x y z", "a.txt", 1, 6), ("y) x", "a.txt", 1, 3)])
    counted = {(r["term"], r["path"], r["line"]): r["n"] for r in index.counts(terms, files).collect()}
    assert counted == dict(Counter((r["term"], r["path"], r["line"]) for r in found.collect()))
    alone = index.find(terms.filter("term = 'x y'"), files)
    assert "hashpartitioning(path" not in alone._jdf.queryExecution().executedPlan().toString()


def test_a_common_term_is_capped_in_shares(spark):
    from arbora.operators import exploration

    rows = [(t, (f"f{i % 7}", i, 0)) for t, n in (("a", 400), ("b", 5), ("c", 6)) for i in range(n)] + [(None, ("f", 1, 0))]
    got = exploration.capped(spark.createDataFrame(rows, "term string, o struct<file_path:string,line:int,col:int>"), 5)
    want = [(t, *o, i + 1, n > 5) for t, n in (("a", 400), ("b", 5), ("c", 6), (None, 1)) for i, o in enumerate(sorted(r[1] for r in rows if r[0] == t)[:5])]
    assert sorted(map(str, got.select("term", "o.*", "rank", "truncated").collect())) == sorted(str(r) for r in spark.createDataFrame(want, "term string, file_path string, line int, col int, rank int, truncated boolean").collect())
    assert "share" in plan(got)


def plain_hops(ids, pairs, cost, seeds, hops):
    near = {x: set() for x in ids}
    for a, b in pairs:
        if a != b and a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    out = {}
    for s in seeds:
        seen, front, n, c = {s}, {s}, [0, 0], [0.0, 0.0]
        for depth in range(1, hops + 1):
            front = {y for x in front for y in near[x]} - seen
            seen |= front
            for i in range(2):
                if i or depth <= 2:
                    n[i] += len(front)
                    c[i] += sum(cost[x] for x in front)
        out[s] = (n[0], pytest.approx(c[0]), n[1], pytest.approx(c[1]))
    return out


HOPS = ("hop_2_node_count", "hop_2_token_cost", "hop_3_node_count", "hop_3_token_cost")


@pytest.mark.parametrize("rows", [1, 40_000_000])
def test_nodes_of_equal_neighbours_share_a_search(spark, monkeypatch, rows):
    monkeypatch.setattr(centrality, "WORDS", 1)
    monkeypatch.setattr(centrality, "ROWS", rows)
    seen, own = [], centrality._reached
    monkeypatch.setattr(centrality, "_reached", lambda both, places, *o: seen.append(places.count()) or own(both, places, *o))
    rng = random.Random(6)
    hubs = [f"h{i}" for i in range(4)]
    ids = hubs + [f"x{i}" for i in range(300)] + [f"y{i}" for i in range(90)] + ["alone"]
    pairs = [("h0", "h1"), ("h1", "h2"), ("h0", "h0")] + [(f"x{i}", hubs[i % 4]) for i in range(300)]
    cost = {x: (i % 7) / 10 for i, x in enumerate(ids)}
    for more in ([], [(f"y{i}", rng.choice(ids[:200])) for i in range(90)] + [(f"y{i}", f"y{(i + 1) % 90}") for i in range(90)]):
        nodes, _, adj = graph(spark, ids, pairs + more)
        costs = spark.createDataFrame(list(cost.items()), "id string, effective_token_cost double")
        seen.clear()
        for some in (None, ids[3:100], ids[:5]):
            seeds = None if some is None else nodes.filter(F.col("id").isin(some))
            got = values(centrality.neighbourhood_cost(costs, adj, seeds), *HOPS)
            assert got == plain_hops(ids, pairs + more, cost, some or ids, 3)
        if not more:
            assert seen[0] == 8


@pytest.mark.parametrize("hub", [3, 256])
def test_seeds_of_many_blocks_are_not_joined_with_edges(spark, monkeypatch, hub):
    monkeypatch.setattr(centrality, "WORDS", 1)
    monkeypatch.setattr(centrality, "HUB", hub)
    joined, own = [], centrality._reached
    monkeypatch.setattr(centrality, "_reached", lambda *o: joined.append(1) or own(*o))
    rng = random.Random(12)
    ids = [f"v{i}" for i in range(230)]
    pairs = [tuple(rng.sample(ids[:200], 2)) for _ in range(300)] + [("v0", x) for x in ids[1:60]] + [("v200", "v201"), ("v5", "v5")] + [(f"v{i}", "v7") for i in range(202, 220)]
    nodes, _, adj = graph(spark, ids, pairs)
    cost = {x: (i % 7) / 10 for i, x in enumerate(ids)}
    costs = spark.createDataFrame(list(cost.items()), "id string, effective_token_cost double")
    for some, hops, edges in ((None, 3, None), (None, 1, None), (ids[20:150], 3, None), (None, 3, 0)):
        joined.clear()
        monkeypatch.setattr(centrality, "SEARCH_EDGES", 20_000_000 if edges is None else edges)
        seeds = None if some is None else nodes.filter(F.col("id").isin(some))
        got = values(centrality.neighbourhood_cost(costs, adj, seeds, hops), *HOPS)
        assert got == plain_hops(ids, pairs, cost, some or ids, hops)
        assert bool(joined) == (edges == 0)


def walked(ids, pairs):
    label = {x: x for x in ids}
    for _ in ids:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components_contract(spark, monkeypatch):
    from arbora.operators import structure, traversal

    tables, own = [], structure.staged
    monkeypatch.setattr(structure, "staged", lambda df, name: tables.append(name) or own(df, name))
    rng = random.Random(9)
    ids = [f"n{i}" for i in range(64)]
    rng.shuffle(ids)
    star = [("n9", x) for x in ids if x != "n9"]
    path = list(zip(ids, ids[1:]))
    loose = [(rng.choice(ids), rng.choice(ids)) for _ in range(40)] + [("n1", "n1")]
    for pairs, most in ((star, 2), (path, 7), (loose, 7), ([], 1)):
        tables.clear()
        nodes, _, adj = graph(spark, ids, pairs)
        assert values(traversal.components(nodes, adj), "component") == walked(ids, pairs)
        assert tables.count("edges") <= most


def test_stored_rounds_are_not_broadcast(spark):
    from arbora.operators import structure

    one, two = (structure.staged(spark.range(20).withColumnRenamed("id", c), c) for c in ("x", "y"))
    met = one.withColumnRenamed("x", "y").join(two.groupBy("y").count(), "y")
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString() and met.count() == 20


def test_edges_pass_by_ids_unsorted(spark):
    nodes, e, _ = graph(spark, list("abc"), [("a", "b"), ("b", "c"), ("c", "c"), ("a", "x")])
    nodes = nodes.unionByName(nodes)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        valid = edges.valid_edges(e, nodes)
        assert "Sort" not in valid._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["from_id"], r["to_id"]) for r in valid.collect()) == [("a", "b"), ("b", "c")]
        both = edges.both_ends(valid)
        assert "Sort" not in both._jdf.queryExecution().executedPlan().toString() and [r["id"] for r in both.collect()] == ["b"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_marks_look_up_ends_only_of_unknown_starts(spark):
    from arbora.operators import enrich

    span = "struct<file_path:string,start_line:int,end_line:int,start_col:int,end_col:int>"
    nodes = spark.createDataFrame([("a", ("f", 3)), ("a", None), ("b", None), ("c", ("g", 5))], "id string, span struct<file_path:string,start_line:int>")
    e = spark.createDataFrame([(x, y, "R", "x", None, None, ("own", 1, 1, 0, 0) if y == "own" else None, None) for x in ("a", "b", "z", None) for y in ("c", "b", "y", "own")],
                              f"from_id string, to_id string, relation string, confidence string, resolution string, candidates array<string>, evidence {span}, metadata string")
    got = {(r["from_id"], r["to_id"]): (r["evidence"]["file_path"], r["evidence"]["end_line"]) for r in enrich.mark_edges(e, nodes).collect()}
    none = ("<framework-inference>", 1)
    starts = {"a": ("f", 3), "b": none}
    assert got == {(x, y): ("own", 1) if y == "own" else starts.get(x, ("g", 5) if y == "c" else none) for x in ("a", "b", "z", None) for y in ("c", "b", "y", "own")}
    assert plan(enrich.mark_edges(e, nodes)).count("Join LeftOuter") + plan(enrich.mark_edges(e, nodes)).count("Join Inner") == 3


def test_few_signs_are_counted_in_place(spark, monkeypatch):
    from arbora.operators import index

    files = spark.createDataFrame([("a", "<a><b>, <<<>>\n<<<<\n, , x,\n$ \\E <"), ("a", "<< >"), ("b", None)], "path string, content string")
    terms = spark.createDataFrame([("<",), ("><",), ("<<",), (", ",), ("\\E",), ("$",), ("(a",), ("a",)], "term string")
    want = dict(Counter((r["term"], r["path"], r["line"]) for r in index.find(terms, files).collect()))
    own = index._signs
    for limit in (32, 1):
        used = []
        monkeypatch.setattr(index, "FEW_SIGNS", limit)
        monkeypatch.setattr(index, "_signs", lambda *a: used.append(1) or own(*a))
        rows = index.counts(terms, files).groupBy("term", "path", "line").agg(F.sum("n").alias("n"))
        assert {(r["term"], r["path"], r["line"]): r["n"] for r in rows.collect()} == want
        assert bool(used) == (limit == 1)


@pytest.mark.parametrize("score", [centrality.pagerank, centrality.hits])
def test_edges_are_made_once(spark, monkeypatch, score):
    plans, own = [], centrality.staged
    monkeypatch.setattr(centrality, "staged", lambda df, name, **o: plans.append((name, plan(df))) or own(df, name, **o))
    nodes, _, adj = graph(spark, list("abcd"), [("a", "b"), ("b", "c"), ("a", "c")])
    for local in (None, 0):
        plans.clear()
        made = adj.filter("src <> 'once'")
        got = score(nodes, made, tolerance=0.01, iterations=5, local_edges=local)
        assert [p.count("once") for name, p in plans if "once" in p] == [plan(made).count("once")] and "once" not in plan(got)
        if local is None:  # the one task reads stored tables
            below = plan(got).split("MapInPandas")[1]
            assert "Relation" in below and not any(x in below for x in ("Join", "Aggregate"))


@pytest.mark.parametrize("tolerance", [None, 0.3])
def test_hits_rounds_move_a_number_a_slot(spark, monkeypatch, tolerance):
    kinds, own = {}, centrality.staged
    monkeypatch.setattr(centrality, "staged", lambda df, name, **o: kinds.setdefault(name, set()).add(tuple(df.columns)) or own(df, name, **o))
    monkeypatch.setattr(centrality, "GROUP_EDGES", 3)
    rng = random.Random(5)
    ids = [f"n{i}" for i in range(40)]
    for pairs in ([(rng.choice(ids[:30]), rng.choice(ids[:30])) for _ in range(70)], [("n0", x) for x in ids[1:]], []):
        nodes, _, adj = graph(spark, ids, pairs)
        kinds.clear()
        got = values(centrality.hits(nodes, adj, tolerance, 7, local_edges=0), "hub_score", "authority_score")
        assert kinds["a"] == kinds["h"] == {("part", "values", "square")}  # packed scores, no rows of edges
        want = values(centrality.hits(nodes, adj, tolerance, 7), "hub_score", "authority_score")
        assert got.keys() == want.keys() == set(ids) and all(got[x] == pytest.approx(want[x], abs=1e-12) for x in ids)
    none = values(centrality.hits(nodes, adj, tolerance, 0, local_edges=0), "hub_score", "authority_score")
    assert set(none.values()) == {(1.0, 1.0)}


def cut_by_walks(ids, pairs):
    from .test_graph import _parts

    near = {v: {b for a, b in pairs if a == v} | {a for a, b in pairs if b == v} for v in ids}
    whole = _parts(ids, near)
    return {v for v in ids if near[v] and _parts(ids, near, v) > whole}, {(min(p), max(p)) for p in pairs if _parts(ids, near, None, set(p)) > whole}


def test_cut_points_of_shallow_graphs_take_a_round_a_level(spark, monkeypatch):
    from arbora.operators import structure

    tables, own = [], structure._stored
    monkeypatch.setattr(structure, "_stored", lambda df, name: tables.append(name) or own(df, name))
    rng = random.Random(11)
    ids = [f"v{i:02d}" for i in range(60)]
    hub = [("v00", x) for x in ids[1:12]] + [(rng.choice(ids[1:12]), x) for x in ids[12:40]] + [(rng.choice(ids[:40]), rng.choice(ids[:40])) for _ in range(9)]
    apart = [tuple(rng.sample(ids[40:], 2)) for _ in range(16)]
    for pairs in (hub, hub + apart, [(b, a) for a, b in hub + apart] + hub):
        pairs = [p for p in pairs if p[0] != p[1]]
        adj = spark.createDataFrame(pairs + [("v00", "v00")], "src string, dst string")
        for most in (None, 1):
            tables.clear()
            cuts, bridges = structure.cut_points(adj, most=most)
            assert ({r[0] for r in cuts.collect()}, {tuple(r) for r in bridges.collect()}) == cut_by_walks(ids, pairs)
            assert ("tour" in tables) == (most == 1)


def test_codes_are_apart(spark, monkeypatch):
    from arbora.operators import structure

    class Clashing:
        def __getattr__(self, name):
            return getattr(F, name)

        def xxhash64(self, seed, c):  # under the first two seeds all ids clash
            return F.when(seed < 2, F.lit(7).cast("long")).otherwise(F.xxhash64(seed, c))
    monkeypatch.setattr(structure, "F", Clashing())
    ids, code = structure.coded(spark.createDataFrame([(x,) for x in "abc"], "id string"))
    assert ids.select("code").distinct().count() == 3 and ids.filter(ids["code"] == code("id")).count() == 3
