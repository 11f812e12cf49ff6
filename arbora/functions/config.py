"""Keys of configuration files: nested JSON keys, anchored key lines, Gradle field calls."""

from __future__ import annotations

import json
import re
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .costs import split_lines
from .paths import file_name, suffix

#: Forms of a key line and of a Gradle field.
KEY = r"(?U)^\s*([A-Za-z_][\w.-]*)\s*[:=]"
EQUALS_KEY = r"(?U)^\s*([A-Za-z_][\w.-]*)\s*="
GRADLE = r"\b(?:buildConfigField|resValue)\s*\(\s*['\"][^'\"]+['\"]\s*,\s*['\"]([^'\"]+)['\"]"


class _Pairs(list):
    """The members of a JSON object in the order of the text, with keys that repeat."""


def _keys(parsed) -> list[str]:
    """Keys of all objects in the order of the text, outer before inner."""
    found, todo = [], deque([parsed])
    while todo:
        value = todo.popleft()
        if isinstance(value, _Pairs):
            last = dict(value)  # of members that repeat a key the last one's value counts, at the first one's place
            for key in reversed(last):
                todo.appendleft((key, last[key]))
        elif isinstance(value, tuple):
            found.append(value[0])
            todo.appendleft(value[1])
        elif isinstance(value, list):
            todo.extendleft(reversed(value))
    return found


#: A quoted word and a colon: a place where a key may stand.
_KEY_PLACE = re.compile(r"""["']([^"'\n]*)(?=["']\s*:)""")


def json_keys(text: str) -> list[tuple[str, int]]:
    """All keys of a JSON text, outer before inner, with the line of the key's first place; none if it is no JSON."""
    try:
        parsed = json.loads(text, object_pairs_hook=_Pairs)
    except (ValueError, RecursionError):
        return []
    keys = _keys(parsed)
    # One pass over the text gives every quoted word before a colon its first line.
    first: dict[str, int] = {}
    at, line = 0, 1
    for place in _KEY_PLACE.finditer(text):
        line += text.count("\n", at, place.start())
        at = place.start()
        first.setdefault(place[1], line)
    for key in {k for k in keys if "'" in k or '"' in k}:
        place = re.search(f"[\"']{re.escape(key)}[\"']\\s*:", text)
        first[key] = text.count("\n", 0, place.start()) + 1 if place else 1
    return [(key, first.get(key, 1)) for key in keys]


def config_keys(files: DataFrame) -> DataFrame:
    """path, index, key, line of every key of the configuration files among ``files`` (path, content)."""
    def parse(frames):
        for frame in frames:
            rows = [(p, i, k, n) for p, c in zip(frame["path"], frame["content"]) for i, (k, n) in enumerate(json_keys(c))]
            yield pd.DataFrame(rows, columns=["path", "index", "key", "line"])
    of_json = files.filter(suffix(F.col("path")) == ".json").select("path", "content").mapInPandas(parse, "path string, index int, key string, line int")

    plain = files.filter(suffix(F.col("path")) != ".json").select("path", F.posexplode(split_lines(F.col("content"))).alias("at", "text"))
    name = file_name(F.col("path"))
    strict = (name == ".env") | (suffix(F.col("path")) == ".properties")
    own = F.when(strict, F.regexp_extract("text", EQUALS_KEY, 1)).otherwise(F.regexp_extract("text", KEY, 1))
    own = F.when(~F.ltrim("text").rlike("^(#|//)"), F.nullif(own, F.lit("")))
    gradle = F.when(F.lower(name).rlike(r"\.gradle(\.kts)?$"), F.nullif(F.regexp_extract("text", GRADLE, 1), F.lit("")))
    found = plain.select("path", "at", F.posexplode(F.filter(F.array(own, gradle), lambda k: k.isNotNull())).alias("n", "key"))
    grouped = found.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "n", "key"))).alias("keys"))
    of_lines = grouped.select("path", F.posexplode("keys").alias("index", "k")).select("path", "index", "k.key", (F.col("k.at") + 1).alias("line"))
    return of_json.unionByName(of_lines)
