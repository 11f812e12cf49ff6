"""Costs, metrics and rankings of analysed repositories, and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from arbora import cli
from arbora.functions.config import json_keys
from arbora.operators import analysis, centrality
from arbora.sources import profile
from arbora.sources.languages import python

FILES = "path string, content string"
SPAN = "struct<file_path:string,start_line:int,end_line:int,start_col:int,end_col:int>"
COST = "struct<token_estimate:bigint,char_count:bigint,line_count:bigint>"


def test_smallest_statement_at_a_line(spark):
    text = "class A:\n    x = 1\n\n    def f(self):\n        y = [\n            2,\n        ]\n        return y\né = 'ü'; z = 2\n"
    files = spark.createDataFrame([("a.py", text), ("bad.py", "def (\nx"), ("none.py", None)], FILES)
    asked = {"inner": ("a.py", 6, None), "method": ("a.py", 8, None), "class": ("a.py", 3, None), "lines": ("a.py", 2, 3), "all": ("a.py", None, None), "beyond": ("a.py", 99, None), "back": ("a.py", 2, 1), "bad": ("bad.py", 2, None), "first": ("a.py", 9, None), "gone": ("none.py", 1, None)}
    places = spark.createDataFrame([(k, *v) for k, v in asked.items()], "id string, path string, line int, end_line int")
    got = {r["id"]: r["source_text"] for r in python.source_slices(places, files).collect()}
    whole = text.split("\né")[0]
    assert got == {"inner": "y = [\n            2,\n        ]", "method": whole[whole.index("def f"):], "class": whole, "lines": "    x = 1\n", "all": text, "beyond": text, "back": "x = 1", "bad": "def (\nx", "first": "é = 'ü'"}


def test_words_of_annotations():
    words = lambda text: python.annotation_words(__import__("ast").parse(text, mode="eval").body)
    assert words("Optional[a.b.C]") == ["Optional", "a", "b", "C"] and words("dict[str, 'User'] | None") == ["dict", "str", "User"] and words('Literal["it\'s", 3]')[:2] == ["Literal", "it's"]


def test_costs_follow_the_policy(spark):
    rows = [("a", "A", (10, 0, 0), ("app/a.py", 1, 1, 0, 0), []), ("v", "V", (20, 0, 0), ("vendor/v.py", 1, 1, 0, 0), []), ("g", "G", (30, 0, 0), ("g.py", 1, 1, 0, 0), ["Generated"]), ("m", "M", (40, 0, 0), ("app/migrations/m.py", 1, 1, 0, 0), [])]
    nodes = spark.createDataFrame(rows, f"id string, label string, cost {COST}, span {SPAN}, flags array<string>").withColumn("metadata", F.lit("{}"))
    files = spark.createDataFrame([("s.py", "x = 1\nvalue = call(\n    1,\n    2)\n")], FILES)
    total = analysis.node_costs(nodes, files).agg(F.sum("token_cost").alias("raw"), F.sum("effective_token_cost").alias("effective")).first()
    assert (total["raw"], total["effective"]) == (100, 17.0)
    bare = spark.createDataFrame([("s", "S", None, ("s.py", 3, None, 0, 0), None), ("n", "Name", None, None, None)], f"id string, label string, cost {COST}, span {SPAN}, flags array<string>").withColumn("metadata", F.lit("{}"))
    got = {r["id"]: r["token_cost"] for r in analysis.node_costs(bare, files).collect()}
    assert got["s"] == -(-len("value = call(\n    1,\n    2)") // 4) and got["n"] == -(-len('{"label": "Name", "title": "", "metadata": {}}') // 4)


def test_first_candidate_is_the_least_path(spark):
    files = [(f"m{i}.py", "def shared_name():\n    return 1\n") for i in (3, 0, 2, 1)] + [("tests/test_it.py", "def test_it():\n    assert shared_name\n")]
    done = analysis.analyse_files(spark.createDataFrame(files, FILES), "python")
    tests = [r for r in done.edges.filter("relation = 'TESTS'").collect() if r["to_id"].endswith("#shared_name")]
    assert tests and all((r["to_id"], r["candidates"]) == ("py:m0#shared_name", ["py:m1#shared_name", "py:m2#shared_name", "py:m3#shared_name"]) for r in tests)


def test_metrics_of_a_repository(spark):
    files = [("a.py", "from b import f\n\ndef g():\n    return f()\n"), ("b.py", "def f():\n    return 1\n")]
    done = analysis.analyse_files(spark.createDataFrame(files, FILES), "python")
    metrics = done.metrics()
    rows = {r["id"]: r for r in metrics.collect()}
    assert set(rows) == {r["id"] for r in done.nodes.collect()} and abs(sum(r["pagerank"] for r in rows.values()) - 1) < 1e-9
    assert rows["py:b#f"]["fan_in"] >= 2 and rows["py:b#f"]["token_cost"] == -(-len("def f():\n    return 1") // 4)
    found = done.analysis(metrics)
    assert set(analysis.RANKINGS) <= set(found) and found["betweenness_strategy"] == "exact" and found["betweenness_sample_size"] == len(rows)
    values = [r["value"] for r in found["top_weighted_cost"]]
    assert values == sorted(values, reverse=True) and len(values) <= 10 and found["total_token_cost"] == sum(r["token_cost"] for r in rows.values())
    kept = {r["id"]: json.loads(r["metadata"]) for r in done.with_metrics(metrics).collect()}
    assert kept["py:b#f"]["analysis"]["fan_in"] == rows["py:b#f"]["fan_in"]


def test_sampled_sources_are_evenly_spaced(spark):
    ids = [f"n{i:04}" for i in range(777)]
    nodes = spark.createDataFrame([(x,) for x in ids], "id string").repartition(7)
    got, how, n = centrality.sample_sources(nodes, exact_limit=500, size=100)
    assert how == "deterministic_sampled" and n == 100 and sorted(r["id"] for r in got.collect()) == [ids[i * 777 // 100] for i in range(100)]


API = {"main.py": "from fastapi import FastAPI, Depends\nfrom routes import router\n\napp = FastAPI(title='T')\napp.include_router(router, prefix='/v1')\n",
       "routes.py": "from fastapi import APIRouter, Depends\nfrom models import Item\nfrom deps import current\n\nrouter = APIRouter(prefix='/items')\n\n\n@router.get('/{item}', response_model=Item)\ndef read(item: int, user=Depends(current)):\n    return item\n",
       "deps.py": "def current():\n    return 1\n", "models.py": "from pydantic import BaseModel\n\n\nclass Item(BaseModel):\n    name: str\n"}


def test_command_line(spark, tmp_path, capsys):
    for name, text in API.items():
        (tmp_path / name).write_text(text)
    out = tmp_path / "out"
    assert cli.main([str(tmp_path), "-f", "fastapi", "-o", str(out), "--json", "--title", "My page", "--entrypoint", "main.py"]) == 0
    assert "highest agent context cost: " in capsys.readouterr().out and "<title>My page</title>" in (out / "index.html").read_text()
    doc = json.loads((out / "architecture.json").read_text())
    kinds = {n["kind"] for n in doc["nodes"]}
    assert {"app", "router", "endpoint", "schema", "dependency", "module", "function"} <= kinds and doc["stats"]["analysis"]["top_pagerank"]
    endpoint = next(n for n in doc["nodes"] if n["kind"] == "endpoint")
    assert endpoint["label"] == "GET /v1/items/{item}" and endpoint["cost"]["token_estimate"] > 0 and endpoint["symbol_path"] and endpoint["metadata"]["analysis"]["fan_out"] > 0
    assert cli.main([str(tmp_path), "-f", "fastapi", "-o", str(out), "--json", "--no-models", "--no-deps", "--no-language-graph"]) == 0
    less = json.loads((out / "architecture.json").read_text())
    assert not any((n.get("span") or {}).get("file_path", "").startswith("out/") for n in less["nodes"])
    assert {n["kind"] for n in less["nodes"]} == {"app", "router", "endpoint"} and {e["relation"] for e in less["edges"]} <= {"INCLUDES", "ROUTES"}
    assert cli.main([str(tmp_path / "none")]) == 1
    with pytest.raises(SystemExit):
        cli.parse([str(tmp_path), "--app", "main:app"])


def test_profiles_that_can_and_cannot_be_used():
    def text(**more):
        return json.dumps({"id": "p", "version": 1, "limits": {"max_arrival_nodes": 1, "min_term_length": 1, "max_file_bytes": 1}, "transforms": [{"id": "split-case"}], **more}).encode()
    assert profile.parse_profile(text(id=7)).id == "7"
    assert profile.parse_profile(text(transforms=[{"id": "strip-affix", "prefixes": ["get", 1]}])).transforms[0].prefixes == ("get", "1")
    for bad in ({"transforms": []}, {"transforms": {}}, {"transforms": [{"id": "none"}]}, {"transforms": [{"id": "split-case"}, {"id": "split-case"}]}, {"transforms": [{"id": "strip-affix"}]}, {"transforms": [{"id": "split-case", "prefixes": []}]},
                {"version": True}, {"limits": {}}):
        with pytest.raises(profile.ProfileError):
            profile.parse_profile(text(**bad))


def test_json_keys_and_their_lines():
    assert json_keys('{"a": {"b": 1, "c": [{"d": 2},\n {"a": 3}]},\n "e\'x": 1, "z": {"z": 1}}') == [("a", 1), ("b", 1), ("c", 1), ("d", 1), ("a", 1), ("e'x", 3), ("z", 3), ("z", 3)]
    assert json_keys("[1, {\"k\":\n2}]") == [("k", 1)] and json_keys("{") == [] and json_keys("3") == [] and json_keys('{"\\u0041": 1}') == [("A", 1)]
    big = "{" + ",\n".join(f'"key{i}": "v"' for i in range(30_000)) + "}"
    assert json_keys(big)[-1] == ("key29999", 30_000)
