"""Python extraction and name resolution on small packages."""

import pytest

from arbora.operators.resolve import PythonGraph
from arbora.sources.languages import python

FILES = {
    "pkg/__init__.py": "from .models import User\nfrom .deep.util import helper as h\n", "pkg/models.py": '"""Models."""\nLIMIT: int = 3\n\nclass Base:\n    kind = "b"\n    def save(self):\n        return self.check()\n    def check(self):\n        return LIMIT\n\n@register\nclass User(Base):\n    def rename(self, name: str) -> "Base":\n        self.save()\n        other = name\n        return other\n\ndef register(c):\n    return c\n',
    "pkg/deep/util.py": "def helper():\n    return getattr(x, y)\n\ndef unique_one():\n    pass\n", "app.py": "import importlib\nimport pkg.models as m\nfrom pkg import User, h\n\ndef main(user: User):\n    u = User()\n    m.register(u)\n    h()\n    unique_one()\n    missing()\n    importlib.import_module('pkg.deep.util')\n    print(m.LIMIT)\n    def inner():\n        helper()\n    return inner\n", "bad.py": "def (:\n", "dup.py": "class User:\n    pass\n"}


@pytest.fixture(scope="module")
def built(spark):
    g = PythonGraph(spark.createDataFrame(list(FILES.items()), "path string, content string"))
    return {r["id"]: r for r in g.nodes().collect()}, {(r["from_id"], r["relation"], r["to_id"]): r for r in g.edges().collect()}, {(r["owner"], r["name"]) for r in g.unresolved().collect()}


def test_nodes(built):
    nodes, _, _ = built
    assert {"py:pkg", "py:pkg.models", "py:pkg.deep", "py:pkg.deep.util", "py:app", "py:dup", "py:pkg.models#User.rename", "py:app#main.<locals>.inner"} <= set(nodes)
    assert "py:bad" not in nodes and nodes["py:pkg.deep"]["kind"] == "package" and nodes["py:pkg.models#Base.kind"]["kind"] == "field"
    assert nodes["py:pkg"]["flags"] == ["reexport"] and "ambiguous_name" in nodes["py:dup#User"]["flags"] and "dynamic_attr" in nodes["py:pkg.deep.util#helper"]["flags"]
    assert nodes["py:pkg.models#User.rename"]["signature"] == "def rename(self, name: str) -> 'Base'" and nodes["py:pkg.models"]["docstring"] == "Models."
    assert nodes["py:app#main"]["symbol_path"] == "app.main" and nodes["py:app#main"]["exported"] and nodes["py:pkg.models#User.rename"]["exported"] is False


def test_edges(built):
    _, edges, unresolved = built
    want = [("py:pkg", "RE_EXPORTS", "py:pkg.models#User"), ("py:pkg", "RE_EXPORTS", "py:pkg.deep.util#helper"), ("py:app", "IMPORTS_SYMBOL", "py:pkg.models#User"), ("py:app", "IMPORTS", "py:pkg.models"),
            ("py:pkg.models#User", "INHERITS", "py:pkg.models#Base"), ("py:pkg.models#register", "DECORATES", "py:pkg.models#User"), ("py:pkg.models#User.rename", "TYPE_USES", "py:pkg.models#Base"),
            ("py:pkg.models#User.rename", "CALLS", "py:pkg.models#Base.save"), ("py:pkg.models#Base.save", "CALLS", "py:pkg.models#Base.check"), ("py:pkg.models#Base.check", "READS", "py:pkg.models#LIMIT"),
            ("py:app#main", "INSTANTIATES", "py:pkg.models#User"), ("py:app#main", "CALLS", "py:pkg.models#register"), ("py:app#main", "CALLS", "py:pkg.deep.util#helper"), ("py:app#main", "IMPORTS", "py:pkg.deep.util"),
            ("py:app#main.<locals>.inner", "CALLS", "py:pkg.deep.util#helper"), ("py:pkg", "CONTAINS", "py:pkg.models"), ("py:app#main", "CONTAINS", "py:app#main.<locals>.inner")]
    assert [w for w in want if w not in edges] == []
    assert edges["py:pkg.models", "CONTAINS", "py:pkg.models#User"]["weight"] == 2.0
    assert edges["py:app#main", "CALLS", "py:pkg.deep.util#unique_one"]["resolution"] == "unique_name"
    assert edges["py:app#main", "IMPORTS", "py:pkg.deep.util"]["confidence"] == "dynamic_required"
    assert ("py:app#main", "missing") in unresolved and ("py:app#main", "print") in unresolved


def test_relative_imports():
    assert [python.absolute("a.b", m, n) for m, n in (("x", 0), ("x", 1), ("x", 2), (None, 1), ("x", 9))] == ["x", "a.b.x", "a.x", "a.b", "x"]


def test_files_that_do_not_parse():
    assert python.module_facts("a.py", "x = (") == [] and python.module_facts("a.py", "a\0b") == []
