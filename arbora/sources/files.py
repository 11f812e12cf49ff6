"""Repository files as a frame (path, content), and their classification."""

from __future__ import annotations

import os
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import TYPESCRIPT_SUFFIXES, file_name, is_config_file, parts, suffix

#: Folders that a walk leaves out, files that tell agents how to work, and how far a NUL is looked for.
SKIPPED_FOLDERS = ("venv", "env", "node_modules", "__pycache__", "build", "dist")
AGENT_DOCS = ("AGENTS.md", "CLAUDE.md", "README.md")
SNIFF = 8192


def tracked_files(root: str) -> list[str] | None:
    """Paths that git tracks below ``root``; null if git doesn't answer or tracks none."""
    try:
        done = subprocess.run(["git", "-C", root, "ls-files", "-z"], capture_output=True, check=False)
    except OSError:
        return None
    names = [x for x in done.stdout.decode("utf-8", "replace").split("\0") if x] if done.returncode == 0 else []
    return sorted(names) or None


def walked_files(root: str) -> list[str]:
    """All files below ``root``, without hidden and skipped folders."""
    out = []
    for at, folders, names in os.walk(root):
        folders[:] = sorted(x for x in folders if not x.startswith(".") and x not in SKIPPED_FOLDERS)
        out += [Path(at, x).relative_to(root).as_posix() for x in names]
    return sorted(out)


def list_files(root: str, tracked_only: bool = True, leave_out: str | None = None) -> tuple[str, list[str]]:
    """(where the list comes from, paths), without those in the folder ``leave_out``."""
    tracked = tracked_files(root) if tracked_only else None
    kind, paths = ("git-tracked", tracked) if tracked else ("static_fallback", walked_files(root))
    if leave_out:
        at, gone = Path(root).resolve(), Path(leave_out).resolve()
        if gone != at and gone.is_relative_to(at):
            paths = [p for p in paths if not (at / p).is_relative_to(gone)]
    return kind, paths


def read_repository(spark: SparkSession, root: str, tracked_only: bool = True, partitions: int | None = None, leave_out: str | None = None) -> DataFrame:
    """Files of a local checkout but those in ``leave_out``; tasks read the contents. A file that can't be read
    has null content."""
    _, paths = list_files(root, tracked_only, leave_out)
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(partitions or max(1, min(len(paths) // 64 + 1, 1000)))

    def read(frames):
        for frame in frames:
            def content(path):
                try:
                    return Path(root, path).read_bytes().decode("utf-8", "replace")
                except OSError:
                    return None
            yield frame.assign(content=[content(p) for p in frame["path"]])
    return rows.mapInPandas(read, "path string, content string")


def read_tree(spark: SparkSession, url: str) -> DataFrame:
    """Files of a folder in any store that Spark reads, with paths below it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(url)
    base = url.rstrip("/")
    path = F.regexp_replace("path", "^.*" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in base.split("://")[-1].removeprefix("file:")) + "/", "")
    p = parts(path)
    seen = ~F.exists(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: x.startswith(".") | x.isin(*SKIPPED_FOLDERS))
    return raw.select(path.alias("path"), F.decode(F.col("content"), "UTF-8").alias("content")).filter(seen)


def scan_files(files: DataFrame, max_file_bytes: int, include_agent_docs: bool = True) -> tuple[DataFrame, DataFrame]:
    """(included files, excluded paths with reason): unreadable, then too large in bytes, then binary."""
    once = files.groupBy("path").agg(F.first("content", ignorenulls=True).alias("content"))
    if not include_agent_docs:
        once = once.filter(~file_name(F.col("path")).isin(*AGENT_DOCS))
    reason = F.when(F.col("content").isNull(), "unreadable").when(F.octet_length("content") > max_file_bytes, "too_large").when(
        F.instr(F.substring("content", 1, SNIFF), "\0") > 0, "binary")
    sorted_out = once.withColumn("reason", reason)
    return sorted_out.filter("reason is null").drop("reason"), sorted_out.filter("reason is not null").select("path", "reason")


def _outside(path, folders):
    p = parts(path)
    return ~F.exists(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: x.isin(*folders))


def python_files(files: DataFrame) -> DataFrame:
    p = parts(F.col("path"))
    return files.filter(F.col("path").endswith(".py") & ~F.exists(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: x.startswith(".") | x.isin(*SKIPPED_FOLDERS)))


def typescript_files(files: DataFrame) -> DataFrame:
    p = parts(F.col("path"))
    return files.filter(suffix(F.col("path")).isin(*TYPESCRIPT_SUFFIXES) & ~F.exists(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: x.startswith(".") | x.isin(*SKIPPED_FOLDERS)))


def kotlin_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("path").endswith(".kt") & _outside(F.col("path"), (".git", ".gradle", ".idea", "build")))


def android_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("path").endswith(".kt") & _outside(F.col("path"), (".git", ".gradle", ".idea", "build", "generated")))


def config_files(files: DataFrame) -> DataFrame:
    return files.filter(is_config_file(F.col("path")))
