"""Comment, docstring and string regions of source text: a scan with state, so it runs over Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

#: What starts a region, or what a scan must skip; the first alternative that fits counts.
_OPEN = re.compile(r"\"\"\"|'''|\#|//|/\*|[\"']")
_STRING_END = {q: re.compile(r"(?:[^\\\n" + q + r"]|\\[\s\S])*" + q + "?") for q in "\"'"}


def regions(text: str, triple: bool) -> list[tuple[int, int, str]]:
    """(start, end, kind) of comments and, where triple quotes count, docstrings; strings hide both."""
    out, at = [], 0
    while m := _OPEN.search(text, at):
        mark, start = m[0], m.start()
        if len(mark) == 3 and not triple:
            mark = mark[0]
        if len(mark) == 3:
            end = text.find(mark, start + 3)
            end = len(text) if end < 0 else end + 3
            out.append((start, end, "docstring"))
        elif mark in ("#", "//"):
            end = text.find("\n", start)
            end = len(text) if end < 0 else end
            out.append((start, end, "comment"))
        elif mark == "/*":
            end = text.find("*/", start + 2)
            end = len(text) if end < 0 else end + 2
            out.append((start, end, "comment"))
        else:
            end = _STRING_END[mark].match(text, start + 1).end()
            if end <= start + 1 or text[end - 1] != mark or end == start + 1:
                end = min(len(text), end + (end < len(text) and text[end] == "\n"))
        at = max(end, start + 1)
    return out


def by_line(text: str, triple: bool) -> list[tuple[int, int, int, str]]:
    """Regions cut at lines: (line from 1, first column, end column, kind)."""
    out, line, base, at = [], 1, 0, 0
    for start, end, kind in regions(text, triple):
        line += text.count("\n", at, start)
        base = text.rfind("\n", 0, start) + 1
        at = start
        while at < end:
            stop = text.find("\n", at, end)
            stop = end if stop < 0 else stop + 1
            out.append((line, at - base, stop - base, kind))
            if stop <= end and text[stop - 1:stop] == "\n":
                line, base = line + 1, stop
            at = stop
    return out


def line_regions(files: DataFrame) -> DataFrame:
    """path, line, start_col, end_col, kind of all regions of ``files`` (path, content)."""
    def scan(frames):
        for frame in frames:
            rows = [(p, *r) for p, c in zip(frame["path"], frame["content"]) for r in by_line(c, p.lower().endswith((".py", ".pyi")))]
            yield pd.DataFrame(rows, columns=["path", "line", "start_col", "end_col", "kind"])
    return files.select("path", "content").mapInPandas(scan, "path string, line int, start_col int, end_col int, kind string")
