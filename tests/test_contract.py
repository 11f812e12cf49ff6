"""The engine stands without the training-data subpackage and the pipeline."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_engine_alone(tmp_path):
    for name in ("arbora", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "arbora").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"(from|import)\s+(arbora)?\.*llm", path.read_text()), path


def test_every_query_has_sql():
    from arbora.plans.graphs import SLOW_SQL
    from arbora.plans.queries import ORACLE_SQL, QUERIES

    assert set(QUERIES) == set(ORACLE_SQL) | set(SLOW_SQL)
