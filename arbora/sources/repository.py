"""A repository below a URL as a data source: ``spark.read.format("repository").load(url)`` gives path and content.

The driver only lists names. Paths, sorted, are cut into ranges of files, one a partition; tasks read the contents
through the URL's own file system, so executors need the store, not a checkout. Filters on ``path`` (equal, in a list,
prefix) are pushed: what they rule out is neither listed below its folder nor read, and partitions go with it.

Options: ``filesPerPartition`` (256), ``leaveOut`` (a folder below the URL). A file that can't be read has null
content; hidden and skipped folders are left out, as in a walk of a checkout.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from .files import SKIPPED_FOLDERS

FILES_PER_PARTITION = 256
#: Names the setting that lets Spark push filters to sources written in Python.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def open_url(url: str):
    """(file system, its root) of a URL; a plain path is local."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(url) if "://" in url or url.startswith("file:") else (fs.LocalFileSystem(), url)
    return store, root.rstrip("/")


@dataclass
class PathRange(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]):
        super().__init__(paths)
        self.paths = paths


class RepositoryReader(DataSourceReader):
    def __init__(self, url: str, size: int, leave_out: str | None):
        self.url, self.size, self.leave_out = url, size, leave_out
        self.prefixes: list[str] = []
        self.names: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            match f:
                case EqualTo(("path",), value) if isinstance(value, str):
                    self._only({value})
                case In(("path",), values) if all(isinstance(v, str) for v in values):
                    self._only(set(values))
                case StringStartsWith(("path",), value):
                    self.prefixes.append(value)
                case _:
                    yield f

    def _only(self, names: set[str]) -> None:
        self.names = names if self.names is None else self.names & names

    def wanted(self, path: str) -> bool:
        return (self.names is None or path in self.names) and all(map(path.startswith, self.prefixes)) and not (self.leave_out and f"{path}/".startswith(f"{self.leave_out.strip('/')}/"))

    def may_hold(self, folder: str) -> bool:
        """Whether a wanted path can lie below a folder."""
        at = f"{folder}/"
        fits = all(p.startswith(at) or at.startswith(p) for p in self.prefixes)
        return fits and (self.names is None or any(n.startswith(at) for n in self.names)) and not (self.leave_out and at.startswith(f"{self.leave_out.strip('/')}/"))

    def listed(self) -> list[str]:
        """Wanted paths below the root, sorted; folders that can't hold any are not opened."""
        from pyarrow import fs

        store, root = open_url(self.url)
        out, rest = [], [""]
        while rest:
            folder = rest.pop()
            for info in store.get_file_info(fs.FileSelector(f"{root}/{folder}".rstrip("/"))):
                path = f"{folder}/{info.base_name}".lstrip("/")
                if info.type == fs.FileType.Directory:
                    if not info.base_name.startswith(".") and info.base_name not in SKIPPED_FOLDERS and self.may_hold(path):
                        rest.append(path)
                elif self.wanted(path):
                    out.append(path)
        return sorted(out)

    def partitions(self) -> list[PathRange]:
        paths = self.listed()
        return [PathRange(tuple(paths[i:i + self.size])) for i in range(0, len(paths), self.size)] or [PathRange(())]

    def read(self, partition: PathRange) -> Iterator[pa.RecordBatch]:
        store, root = open_url(self.url)
        for path in partition.paths:
            try:
                with store.open_input_stream(f"{root}/{path}") as f:
                    content = f.read().decode("utf-8", "replace")
            except OSError:
                content = None
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.string())], ["path", "content"])


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return "path string, content string"

    def reader(self, schema) -> DataSourceReader:
        return RepositoryReader(self.options["path"], int(self.options.get("filesPerPartition", FILES_PER_PARTITION)), self.options.get("leaveOut"))


def repository(spark: SparkSession, url: str, **options) -> DataFrame:
    """path, content of every file below ``url``; registers the source and lets filters be pushed to it."""
    spark.dataSource.register(RepositorySource)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("repository").options(**options).load(url)
