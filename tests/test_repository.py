"""The data source of repositories: contents, unreadable files, and what pushed filters leave out."""

from pyspark.sql import functions as F

from arbora.sources.repository import PathRange, RepositoryReader, repository

NAMES = [f"src/a/m{i:02d}.py" for i in range(20)] + [f"src/b/n{i:02d}.kt" for i in range(20)] + ["README.md", "docs/x.md", ".git/config", "node_modules/y.js", "out/made.json"]


def tree(root):
    for name in NAMES:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"text of " + name.encode() + b" \xff")


def test_repository_source(spark, tmp_path):
    tree(tmp_path)
    files = repository(spark, tmp_path.as_uri(), filesPerPartition=8, leaveOut="out")
    rows = {r["path"]: r["content"] for r in files.collect()}
    assert set(rows) == {n for n in NAMES if not n.startswith((".git", "node_modules", "out"))}
    assert rows["README.md"] == "text of README.md �"
    assert files.rdd.getNumPartitions() == 6
    some = files.filter(F.col("path").startswith("src/b/"))
    assert some.count() == 20 and some.rdd.getNumPartitions() == 3
    one = files.filter("path in ('docs/x.md', 'src/a/m03.py', 'none') and content like '%m03%'")
    assert [r["path"] for r in one.collect()] == ["src/a/m03.py"] and one.rdd.getNumPartitions() == 1
    assert files.filter("path = 'none'").count() == 0 and files.filter("path like '%.kt'").count() == 20


def test_folders_that_cannot_match_are_not_opened(tmp_path):
    tree(tmp_path)
    reader = RepositoryReader(str(tmp_path), 100, None)
    reader.prefixes = ["src/a/m1"]
    assert reader.may_hold("src") and reader.may_hold("src/a") and not reader.may_hold("src/b") and not reader.may_hold("docs")
    gone = [b.to_pylist()[0] for b in reader.read(PathRange(("src/a/m01.py", "src/a/gone.py")))]  # it went after it was listed
    assert gone[0]["content"].startswith("text of") and gone[1] == {"path": "src/a/gone.py", "content": None}
    assert reader.listed() == [n for n in NAMES if n.startswith("src/a/m1")]
