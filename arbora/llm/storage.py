"""Shard files in the shared folder, written and read by tasks through pyarrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_fs(uri: str):
    """(file system, path) of an URI; plain paths are local."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class Shard:
    """One output file of a task. The name is new for each attempt, so a retried task never meets its own
    remains; rows name the file of the attempt that was committed."""

    def __init__(self, folder: str, suffix: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
        self.fs, path = open_fs(self.uri)
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.at = self.fs.open_output_stream(path, compression=None), 0

    def write(self, data: bytes) -> int:
        """Append; returns where the data starts."""
        start = self.at
        self.out.write(data)
        self.at += len(data)
        return start

    def close(self) -> None:
        self.out.close()
