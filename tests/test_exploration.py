"""Operators of the search model's outline."""

from pyspark.sql import functions as F

from arbora.operators import exploration as X


def test_read_units(spark):
    rows = [("f", f"s{i}", i, t) for i, t in enumerate([3, 4, 5, 20, 1, 1])]
    got = {r["id"]: r["unit"] for r in X.read_units(spark.createDataFrame(rows, "file_path string, id string, start_line int, tokens int"), 8).collect()}
    assert got == {"s0": 0, "s1": 0, "s2": 1, "s3": 2, "s4": 3, "s5": 3}


def test_paths(spark):
    paths = spark.createDataFrame([("src/user_api/a.py",), ("src/b.py",), ("user.md",)], "path string")
    assert {r[0] for r in X.path_search(paths, "User").collect()} == {"src/user_api/a.py", "user.md"}
    assert {tuple(r) for r in X.directory_listing(paths, "src").collect()} == {("user_api", 1), ("b.py", 1)}
    docs = spark.createDataFrame([("x/README.md",), ("README.md",), ("a.md",)], "path string")
    assert [r["path"] for r in X.entry_documents(docs).collect()] == ["README.md", "x/README.md"]


def places(spark):
    rows = [("t", (f"d{i % 2}/f{i}.py", 1, 0, "t", "code", f"n{i % 3}"), "t one" if i % 2 else "t two") for i in range(6)]
    return spark.createDataFrame(rows, "term string, o struct<file_path:string,line:int,col:int,matched_text:string,context:string,enclosing_node_id:string>, text string")


def test_results(spark):
    o = places(spark)
    assert {(r["node_id"], r["n"]) for r in X.hints(o).collect()} == {("n0", 2), ("n1", 2), ("n2", 2)}
    cut = X.capped(o, 4).collect()
    assert len(cut) == 4 and all(r["truncated"] for r in cut) and not any(r["truncated"] for r in X.capped(o, 6).collect())
    assert {(r["kind"], r["value"], r["n"]) for r in X.refinements(o).collect()} == {("folder", "d0", 3), ("folder", "d1", 3), ("pair", "one", 3), ("pair", "two", 3)}


def test_signals(spark):
    terms = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y")], "path string, term string")
    got = {r["term"]: r["signals"] for r in X.read_signals(terms, spark.createDataFrame([("a", "y")], "path string, term string"), spark.createDataFrame([("x",)], "term string")).collect()}
    assert got == {"x": ["used_often"], "y": ["edge_target", "undeclared"]}


def test_exploration_costs(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 5.0), ("c", "d", 1.0), ("b", "e", 1.0)], "src string, dst string, score double")
    costs = spark.createDataFrame([(x, 1.0) for x in "abcde"], "id string, cost double")
    s = spark.createDataFrame([("1", "a", "d"), ("2", "e", "a")], "scenario string, start string, target string")
    best = {r["scenario"]: r for r in X.explore(s, edges, costs, "best").collect()}
    assert best["1"]["found"] and best["1"]["cost"] == 3.0 and not best["2"]["found"]
    r = X.cost_range(X.explore(s, edges, costs, "breadth", seeds=20)).filter("scenario = '1'").first()
    assert 4.0 <= r["least"] <= r["expected"] <= r["greatest"] <= 5.0 and r["found_share"] == 1.0


def test_effects(spark):
    e = spark.createDataFrame([("a", "b", "CALLS"), ("c", "a", "CALLS"), ("d", "b", "CONTAINS")], "from_id string, to_id string, relation string")
    zone = X.zone_of_effect(e, spark.createDataFrame([("b",)], "id string"))
    assert {(r["affected"], r["depth"]) for r in zone.collect()} == {("a", 1), ("c", 2)}
    ranked = X.accessibility(zone, spark.createDataFrame([("a", 9.0), ("c", 1.0)], "id string, cost double"))
    assert [r["affected"] for r in ranked.orderBy("rank").collect()] == ["a", "c"]
    n, left = X.without(spark.createDataFrame([("a",), ("b",)], "id string"), e, spark.createDataFrame([("a",)], "id string"))
    assert n.count() == 1 and left.select(F.col("from_id")).first()[0] == "d"
