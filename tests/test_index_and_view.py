"""Index lookups against a plain model, and the search view on a small repository."""

import re

import pytest
from pyspark.sql import functions as F

from arbora.operators import agentview, enrich, index
from arbora.sources.profile import Profile, Transform

FILES = {
    "src/a.py": 'def user(user_id):\n    """user doc"""\n    # user comment\n    raise Error("user not found")\n\nUser = user  # xuser\n',
    "docs/guide.md": "Call `user` and `a.b c`.\nuser user  user\n", "conf/app.yaml": "user: 1\napi.key: x\n", "src/b.ts": "const path = '/users/me'; // 0.0.0.0 0.0.0 ==> =>\n", "x/empty.py": "",
    "src/test_a.py": "def test_user():\n    assert user(1)\n"}


def plain(term):
    pattern = re.compile(r"(?<![A-Za-z0-9_])" + re.escape(term) + r"(?![A-Za-z0-9_])")
    out = set()
    for path, text in FILES.items():
        for m in pattern.finditer(text):
            line = text.count("\n", 0, m.start()) + 1
            out.add((term, path, line, m.start() - (text.rfind("\n", 0, m.start()) + 1)))
    return out


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(FILES.items()), "path string, content string").cache()


TERMS = ["user", "User", "user_id", "a.b", "a.b c", "user not found", "0.0.0", "0.0.0.0", "=>", "==>", ".", "nope", "user user", "(user", "//", "`", "'"]


def test_find_equals_a_scan(spark, files):
    got = {tuple(r) for r in index.find(spark.createDataFrame([(t,) for t in TERMS], "term string"), files).collect()}
    assert got == set().union(*map(plain, TERMS))


def test_contexts(spark, files):
    found = index.find(spark.createDataFrame([("user",)], "term string"), files)
    got = {(r["path"], r["line"]): r["context"] for r in index.with_context(found, files).collect()}
    assert got[("src/a.py", 1)] == "code" and got[("src/a.py", 2)] == "docstring" and got[("src/a.py", 3)] == "comment"
    assert got[("docs/guide.md", 2)] == "doc" and got[("conf/app.yaml", 1)] == "config"


def test_enclosing(spark):
    readable = spark.createDataFrame([("b", "f", 1, 9), ("a", "f", 2, 4), ("c", "f", 2, 4), ("file:g", "g", None, None), ("z", "h", 5, 6), ("y", "h", 5, 6)], "id string, file_path string, start_line int, end_line int")
    places = spark.createDataFrame([("f", 3), ("f", 8), ("f", 99), ("g", 1), ("h", 1), ("none", 1)], "path string, line int")
    got = {(r[0], r[1]): r[2] for r in index.enclosing(places, readable).collect()}
    assert got == {("f", 3): "a", ("f", 8): "b", ("f", 99): "a", ("g", 1): "file:g", ("h", 1): "y", ("none", 1): "file:none"}


NODES = "id string, label string, kind string, symbol_path string, span struct<file_path:string,start_line:int,end_line:int>, flags array<string>, metadata string, ordinal int"


def nodes(spark):
    return spark.createDataFrame([
        ("py:src.a#user", "user", "function", "src.a.user", ("src/a.py", 1, 4), [], None, 1), ("py:src.a#User", "User", "constant", "src.a.User", ("src/a.py", 6, 6), [], None, 2),
        ("py:src.test_a#test_user", "test_user", "function", "src.test_a.test_user", ("src/test_a.py", 1, 2), ["test"], None, 3), ("py:gone", "gone", "function", "gone", ("gone.py", 1, 1), [], None, 4)], NODES)


EDGES = "from_id string, to_id string, relation string, confidence string, resolution string, evidence struct<file_path:string,start_line:int>, candidates array<string>, metadata string, ordinal int"


def rule(name, kind):
    return f'{{"framework_rule":{{"id":"{name}","specificity":"{kind}"}}}}'


def test_whole_view(spark, files):
    e = spark.createDataFrame([
        ("x", "py:src.a#user", "R", "framework_inferred", "exact", ("src/a.py", 1), ["py:src.a#User"], rule("f.r", "narrowing"), 1), ("x", "py:src.a#User", "R", "framework_inferred", "exact", ("src/a.py", 6), [], rule("f.r", "narrowing"), 2),
        ("x", "py:src.a#user", "S", "framework_inferred", "exact", None, ["py:src.a#User", "nope"], rule("f.s", "unique"), 3), ("x", "py:gone", "S", "framework_inferred", "exact", None, [], rule("f.s", "unique"), 4),
        ("x", "py:src.a#user", "T", "framework_inferred", "exact", None, [], "{}", 5), ("x", "py:src.a#user", "CALLS", "static_certain", "exact", None, [], None, 6)], EDGES)
    view = agentview.build_agent_view(nodes(spark), e, files, Profile(transforms=(Transform("normalize-case"), Transform("split-case"))))
    readable = {r["id"]: r for r in view.readable_nodes.collect()}
    assert set(readable) == {"py:src.a#user", "py:src.a#User", "py:src.test_a#test_user", "file:docs/guide.md", "file:conf/app.yaml", "file:src/b.ts", "file:x/empty.py"}
    queries = {(r["kind"], r["term"]): r for r in view.query_nodes.collect()}
    exact = queries["exact", "user"]
    assert exact["source_terms"] == ["User", "test_user"] and set(exact["clue_kinds"]) == {"identifier", "config_key", "doc_mention"}
    assert exact["arrival_node_ids"] == sorted({o["enclosing_node_id"] for o in exact["occurrences"]}) and len(exact["occurrences"]) == len(plain("user"))
    assert exact["id"] == __import__("hashlib").sha256(b"exact|user|2").hexdigest()[:16]
    assert "error_message" in queries["exact", "user not found"]["clue_kinds"] and "route" in queries["exact", "/users/me"]["clue_kinds"]
    assert ("derived", "user") not in queries and ("exact", "api.key") in queries
    links = {r["id"]: r for r in view.framework_links.collect()}
    assert set(links) == {"x|f.r", "x|f.s|py:src.a#user"}
    assert links["x|f.r"]["to_node_ids"] == ["py:src.a#User", "py:src.a#user"] and links["x|f.r"]["query_id"] and links["x|f.s|py:src.a#user"]["query_id"] is None
    assert links["x|f.s|py:src.a#user"]["candidate_node_ids"] == ["py:src.a#User"] and links["x|f.s|py:src.a#user"]["evidence_file"] == "<framework-inference>"
    assert [r[0] for r in view.unknown_framework_edges.collect()] == ["x->py:src.a#user"]
    assert {r[0] for r in view.unreachable_node_ids.collect()} == {"file:x/empty.py"}


def test_too_many_arrivals(spark):
    made = spark.createDataFrame([(f"d/f{i:02d}.txt", "needle") for i in range(51)], "path string, content string")
    readable = agentview.readable_nodes(nodes(spark), made)
    terms = spark.createDataFrame([("needle",)], "term string")
    none = F.array().cast("array<string>")
    clues = terms.select("term", none.alias("clue_kinds"), none.alias("origin_node_ids"), F.lit(None).cast("string").alias("rule_id"), none.alias("source_terms"))
    got = agentview.query_nodes(index.occurrences(terms, made, readable), clues, "exact", Profile()).first()
    assert got["excluded"] and got["exclusion_reason"] == "too_many_arrival_nodes"
    assert got["output_tokens"] == -(-(51 * len("d/f00.txt:1:needle") + 50) // 4)


def test_tests_and_configuration(spark, files):
    e = spark.createDataFrame([("py:src.test_a#test_user", "py:src.a#User", "READS", "static_certain", "exact", ("src/test_a.py", 2), [], None, 1)], EDGES)
    got = {(r["from_id"], r["to_id"], r["confidence"]) for r in enrich.test_relations(nodes(spark), e, files).collect()}
    assert got == {("py:src.test_a#test_user", "py:src.a#User", "static_certain"), ("py:src.test_a#test_user", "py:src.a#user", "static_inferred")}
    used = spark.createDataFrame([("src/a.py", 'x = get("api.key")\n'), ("conf/app.yaml", FILES["conf/app.yaml"])], "path string, content string")
    made, edges = enrich.configuration(nodes(spark), used)
    assert {r["label"] for r in made.collect()} == {"user", "api.key"}
    assert [(r["from_id"], r["to_id"], r["line"]) for r in edges.collect()] == [("config:conf/app.yaml:2:1:api.key", "py:src.a#user", 1)]


def test_marked_edges(spark):
    e = spark.createDataFrame([("py:src.a#user", "q", "USES", None, "ambiguous", None, ["z"], None, 1), ("q", "py:src.a#user", "OTHER", None, None, None, [], None, 2)], EDGES.replace("evidence struct<file_path:string,start_line:int>", "evidence struct<file_path:string,start_line:int,end_line:int,start_col:int,end_col:int>"))
    got = {r["relation"]: r for r in enrich.mark_edges(e, nodes(spark), {"USES": "unique"}, "fw").collect()}
    assert got["USES"]["resolution"] == "ambiguous" and got["USES"]["evidence"]["file_path"] == "src/a.py" and "fw.uses" in got["USES"]["metadata"]
    assert got["OTHER"]["resolution"] == "unique_name" and got["OTHER"]["evidence"]["start_line"] == 1 and got["OTHER"]["metadata"] == "{}"


def test_interval_join_equals_all_pairs(spark):
    import random

    from arbora.operators.intervals import innermost, interval_join

    rng = random.Random(3)
    spans = [(f"s{i}", rng.choice("xy"), a := rng.randint(-40, 300), a + rng.choice([-1, 0, 0, 1, 2, 5, 17, 64, 255, 1000])) for i in range(120)] + [("wide", "x", -(1 << 40), 1 << 40), ("open", "y", None, 7)]
    points = [(rng.choice("xyz"), rng.randint(-60, 400)) for _ in range(150)] + [("x", None), ("x", 1 << 40)]
    ss, pp = spark.createDataFrame(spans, "id string, k string, a long, b long"), spark.createDataFrame(points, "k string, p long")
    want = sorted((k, p, s) for k, p in points for s, k2, a, b in spans if k == k2 and p is not None and a is not None and a <= p <= b)
    assert sorted((r["k"], r["p"], r["id"]) for r in interval_join(pp, ss, ["k"], "p", "a", "b").collect()) == want
    best = {(r["k"], r["p"]): r["best"]["id"] for r in innermost(pp, ss, ["k"], "p", "a", "b", F.struct((F.col("b") - F.col("a")).alias("w"), "id")).collect()}
    width = {s: b - a for s, _, a, b in spans if a is not None}
    assert best == {(k, p): min((width[s], s) for k2, p2, s in want if (k2, p2) == (k, p))[1] for k, p, _ in want}
    assert interval_join(pp, ss.limit(0), ["k"], "p", "a", "b").count() == 0 and interval_join(pp.limit(0), ss, ["k"], "p", "a", "b").count() == 0


def test_stored_index_reads_only_what_it_needs(spark, tmp_path):
    rows = [(f"d/{i}.txt", f"common word{i} rare{i % 3}\ncommon again phrase{i} of words") for i in range(300)]
    files = spark.createDataFrame(rows, "path string, content string")
    stored = index.StoredIndex.write(files, str(tmp_path / "index"))
    assert stored.postings.count() == index.postings(files).count()
    for terms in (["word7", "rare2"], ["common"], ["phrase9 of", "word1", "none"], ["of words", "++"]):
        asked = spark.createDataFrame([(t,) for t in terms], "term string")
        got, want = stored.find(asked, files), index.find(asked, files)
        assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.select(got.columns).collect())
    plan = stored.of(spark.createDataFrame([("word7",), ("rare2",)], "term string"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", text) and re.search(r"PushedFilters: \[[^]]*In\(token", text)
    folders = {re.search(r"bucket=(\d+)", f)[1] for f in plan.inputFiles()}
    assert plan.select(F.input_file_name()).distinct().count() <= 4 and len(folders) <= index.BUCKETS
    many = spark.range(1500).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("term"))  # more than the filters hold
    assert stored.find(many, files).count() == 300


def test_index_scans_texts_once_and_places_equal_a_plain_model(spark, tmp_path, monkeypatch):
    from arbora.functions import places

    rows = [("a", "x é_y zé\n\nword2 x\n"), ("b", None), ("c", ""), ("d", "x"), ("e", "x\U0001f600x x\nend"), ("f", "é"), (None, "x y"), ("g", "w " * 9)]
    want = sorted((m[0], p or "", n + 1, m.start()) for p, x in rows for n, line in enumerate((x or "").split("\n")) for m in re.finditer("[A-Za-z0-9_]+", line))
    files = spark.createDataFrame(rows, "path string, content string")
    flat = lambda df: sorted((r["token"], r["path"] or "", r["line"], r["col"]) for r in df.collect())
    assert flat(index.postings(files)) == want
    assert flat(index.StoredIndex.write(files, str(tmp_path / "i")).postings) == want
    import pyarrow as pa

    monkeypatch.setattr(places, "SLICE_BYTES", 3)
    monkeypatch.setattr(places, "LIST_PLACES", 4)
    batch = pa.RecordBatch.from_pylist([{"path": p, "content": x} for p, x in rows]).slice(1)
    want = [w for w in want if w[1] != "a"]
    assert sorted((r["token"], r["path"] or "", r["line"], r["col"]) for b in places.scan([batch]) for r in b.to_pylist()) == want
    lists = [r for b in places.scan_lists([batch]) for r in b.to_pylist()]
    assert sorted((r["token"], f["path"] or "", at >> 32, at & 0xFFFFFFFF) for r in lists for f in r["files"] for at in f["places"]) == want
    assert max(sum(len(f["places"]) for f in r["files"]) for r in lists) == 4
    seen = spark.sparkContext.accumulator(0)
    counted = files.mapInPandas(lambda parts: (seen.add(len(p)) or p for p in parts), files.schema)
    index.StoredIndex.write(counted, str(tmp_path / "once"))
    assert seen.value == len(rows)  # twice with a range partitioning, whose borders take a scan of their own
