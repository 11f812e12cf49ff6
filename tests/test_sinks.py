"""Sinks and sources on disk."""

import json
import shutil
import subprocess

import pytest

from arbora import cli
from arbora.sources import files, page, sinks


def graph(spark):
    nodes = spark.createDataFrame([("a", "A </script>", "class", "k", "{}"), ("b", "B", "", "module", '{"x": 1}')], "id string, label string, kind string, category string, metadata string")
    edges = spark.createDataFrame([("a", "b", "CALLS", "static_inferred", ["c"])], "from string, to string, relation string, confidence string, candidates array<string>")
    return nodes, edges


def test_documents(spark, tmp_path):
    nodes, edges = graph(spark)
    doc = sinks.architecture_document(nodes, edges, "p")
    assert doc["schema_version"] == "5" and doc["nodes"][1]["kind"] == "module" and doc["nodes"][1]["metadata"] == {"x": 1} and doc["edges"][0]["from_id"] == "a" and doc["edges"][0]["weight"] == 1.0
    text = sinks.html_page(nodes, edges, "T<")
    assert "A \\u003c/script>" in text and text.count("T&lt;") == 2
    data = json.loads(text.split('type="application/json">')[1].split("</script>")[0])
    assert [n["group"] for n in data["nodes"]] and data["edges"][0]["confidence"] == "static_inferred"
    assert "a -->|CALLS| b" in sinks.mermaid(nodes, edges)
    styled = sinks.styled_edges(edges).first()
    assert json.loads(styled["dashes"]) == [6, 4] and "candidates: c" in styled["title"]
    sinks.write_graph(nodes, edges, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "nodes")).count() == 2


@pytest.mark.skipif(shutil.which("node") is None, reason="no JavaScript engine")
def test_page_logic():
    """Facets, growing search and neighbourhoods, and a script that parses."""
    check = page.LOGIC + """
    const graph = {nodes: ['a', 'b', 'c', 'd', 'e'].map(id => ({id, label: id.toUpperCase(), title: id === 'e' ? 'Alone' : '', group: 'ab'.includes(id) ? 'x' : 'y'})),
                   edges: [['c', 'd'], ['a', 'b'], ['b', 'c'], ['d', 'e']].map(([from, to], i) => ({from, to, confidence: i ? 'sure' : 'maybe'}))};
    const ids = s => [...s].sort().join(''), part = (text, focus, ...hidden) => { const v = visible(graph, {text, focus, hidden: new Set(hidden)}); return ids(v.nodes.map(n => n.id)) + ':' + v.edges.length; };
    new Function(LOGIC_AND_BINDING);
    console.log(JSON.stringify([ids(grown(graph, 'A')), ids(grown(graph, 'alone')), ids(around(graph, 'b')), part('', null), part('', null, 'group:x'), part('', null, 'level:maybe'), part('', 'c'), part('zzz', null), placed(graph.nodes).size, counts(graph.nodes, 'group')]));
    """.replace("LOGIC_AND_BINDING", json.dumps(page.LOGIC + page.BINDING.replace("</script></html>", "")))
    done = subprocess.run(["node", "-e", check], capture_output=True, text=True, timeout=60, check=True)
    assert json.loads(done.stdout) == ["abcde", "de", "abc", "abcde:4", "cde:2", "abcde:3", "bcd:2", ":0", 5, [["x", 2], ["y", 3]]]


def test_listing(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "node_modules" / "b.js").write_text("")
    assert files.list_files(str(tmp_path)) == ("static_fallback", ["src/a.py"])
    assert [tuple(r) for r in files.read_repository(spark, str(tmp_path)).collect()] == [("src/a.py", "x = 1\n")]
    assert [r["path"] for r in files.read_tree(spark, tmp_path.as_uri()).collect()] == ["src/a.py"]
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    subprocess.run(["git", "-C", str(tmp_path), "add", "-f", "node_modules/b.js"], check=True)
    assert files.list_files(str(tmp_path)) == ("git-tracked", ["node_modules/b.js"])
    frame = spark.createDataFrame([(p, "") for p in ("a.py", "venv/b.py", "c.ts", "build/d.kt", "generated/e.kt", "f.kt", "g.toml", ".x/h.py")], "path string, content string")
    names = lambda df: sorted(r["path"] for r in df.collect())
    assert (names(files.python_files(frame)), names(files.typescript_files(frame)), names(files.kotlin_files(frame)), names(files.android_files(frame)), names(files.config_files(frame))) == (["a.py"], ["c.ts"], ["f.kt", "generated/e.kt"], ["f.kt"], ["g.toml"])


def test_command_line_arguments():
    assert cli.parse(["x", "--agent-view", "--profile", "p"]).profile == "p"
    for bad in ([], ["x", "--profile", "p"]):
        try:
            cli.parse(bad)
        except SystemExit as e:
            assert e.code == 2
        else:
            raise AssertionError(bad)
