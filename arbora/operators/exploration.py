"""Operators of the search model's outline: read units, path search, hints, output caps, refinements, read
signals, entry documents, exploration cost, zones of effect and what-if removals. Built from its description."""

from __future__ import annotations

import heapq
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import parts, suffix
from ..functions.terms import WORD
from .traversal import closure, closure_paths


def read_units(symbols: DataFrame, limit: int) -> DataFrame:
    """Symbols of a file packed in order into units of at most ``limit`` tokens; a larger symbol is alone.
    ``symbols``: file_path, id, start_line, tokens. Gives unit numbers from 0."""
    grouped = symbols.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("start_line", "id", "tokens"))).alias("s"))
    zero = F.struct(F.lit(-1).alias("unit"), F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<unit:int,id:string,tokens:bigint>>").alias("out"))

    def step(acc, x):
        new = (acc["unit"] < 0) | (acc["used"] + x["tokens"] > limit)
        unit = F.when(new, acc["unit"] + 1).otherwise(acc["unit"])
        row = F.struct(unit.alias("unit"), x["id"].alias("id"), x["tokens"].cast("bigint").alias("tokens"))
        return F.struct(unit.alias("unit"), F.when(new, x["tokens"]).otherwise(acc["used"] + x["tokens"]).cast("bigint").alias("used"), F.concat(acc["out"], F.array(row)).alias("out"))
    return grouped.select("file_path", F.explode(F.aggregate("s", zero, step, lambda acc: acc["out"])).alias("u")).select("file_path", "u.unit", "u.id", "u.tokens")


def path_search(paths: DataFrame, term: str) -> DataFrame:
    """Paths with a name part equal to the term, any case, or holding it as a word."""
    low = term.lower()
    return paths.filter(F.exists(parts(F.col("path")), lambda p: (F.lower(p) == low) | F.array_contains(F.regexp_extract_all(F.lower(p), F.lit("[a-z0-9]+"), F.lit(0)), low)))


def directory_listing(paths: DataFrame, folder: str) -> DataFrame:
    """Names right below a folder, with how many files each holds."""
    base = folder.rstrip("/") + "/" if folder else ""
    inside = paths.filter(F.col("path").startswith(base))
    return inside.groupBy(F.split(F.substring("path", len(base) + 1, 1 << 30), "/")[0].alias("name")).agg(F.count(F.lit(1)).alias("files"))


def hints(occurrences: DataFrame) -> DataFrame:
    """What a result shows without reading: the node around each place, by term, with how often."""
    return occurrences.groupBy("term", F.col("o.enclosing_node_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"), F.min("o.line").alias("first_line"))


def capped(occurrences: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` places of each term in order, and whether the term had more. Shares of a term give their own
    first places, so a common term is never sorted in one task; its places are counted, not held."""
    order = ["o.file_path", "o.line", "o.col"]
    shares = occurrences.withColumn("share", F.pmod(F.xxhash64("o"), F.lit(256)))
    first = shares.withColumn("rank", F.row_number().over(Window.partitionBy("term", "share").orderBy(*order))).filter(F.col("rank") <= cap).drop("share", "rank")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(*order))).filter(F.col("rank") <= cap)
    more = occurrences.groupBy("term").agg((F.count(F.lit(1)) > cap).alias("truncated"))
    return ranked.withColumnRenamed("term", "t").join(more, F.col("t").eqNullSafe(F.col("term"))).select(*occurrences.columns, "rank", "truncated")


def refinements(occurrences: DataFrame) -> DataFrame:
    """Narrower queries of a term's result: by top folder, by suffix, by the word right after the term.
    ``occurrences`` also has ``text``, the line. term, kind, value, n, share."""
    path = F.col("o.file_path")
    after = F.regexp_extract(F.expr("substring(text, o.col + length(term) + 1)"), f"^[^A-Za-z0-9_]+({WORD})", 1)
    facets = F.array(F.struct(F.lit("folder").alias("kind"), F.when(F.size(parts(path)) > 1, F.get(parts(path), 0)).alias("value")), F.struct(F.lit("suffix").alias("kind"), suffix(path).alias("value")), F.struct(F.lit("pair").alias("kind"), after.alias("value")))
    rows = occurrences.select("term", F.explode(facets).alias("f")).filter("f.value <> ''")
    counts = rows.groupBy("term", "f.kind", "f.value").agg(F.count(F.lit(1)).alias("n"))
    total = occurrences.groupBy("term").agg(F.count(F.lit(1)).alias("total"))
    return counts.join(total, "term").filter("n < total").select("term", "kind", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def read_signals(files_terms: DataFrame, edges: DataFrame, declared: DataFrame) -> DataFrame:
    """Terms of a file worth following: what its edges lead to, what it uses twice or more, what it uses but no
    file declares. ``files_terms``: path, term; ``edges``: path, term (targets' names); ``declared``: term."""
    led = edges.select("path", "term", F.lit("edge_target").alias("signal"))
    often = files_terms.groupBy("path", "term").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("path", "term", F.lit("used_often").alias("signal"))
    strange = files_terms.distinct().join(declared.select("term").distinct(), "term", "left_anti").select("path", "term", F.lit("undeclared").alias("signal"))
    return led.unionByName(often).unionByName(strange).groupBy("path", "term").agg(F.array_sort(F.collect_set("signal")).alias("signals"))


def entry_documents(files: DataFrame, names=("README.md", "AGENTS.md", "CLAUDE.md")) -> DataFrame:
    """Documents that a reader starts from: by name, the ones nearest to the root first."""
    depth = F.size(parts(F.col("path")))
    return files.filter(F.element_at(parts(F.col("path")), -1).isin(*names)).select("path", depth.alias("depth")).orderBy("depth", "path")


SCENARIO = "scenario string, policy string, found boolean, cost double, steps int"


def explore(scenarios: DataFrame, edges: DataFrame, costs: DataFrame, policy: str = "breadth", seeds: int = 1, limit: int = 1_000_000) -> DataFrame:
    """Cost of reaching a target: scenario, policy, found, cost, steps, a row for each random seed.

    ``scenarios``: scenario, start, target; ``edges``: src, dst, score; ``costs``: id, cost. ``breadth`` reads
    level by level in random order, ``best`` always the best-scored known node. The graph goes to the tasks as a
    broadcast, after its size is checked."""
    n = edges.count() + costs.count()
    if n > limit:
        raise ValueError(f"a graph of {n} rows; a simulation takes {limit}")
    near: dict[str, list[tuple[float, str]]] = {}
    for r in edges.select("src", "dst", "score").collect():
        near.setdefault(r["src"], []).append((r["score"] or 0.0, r["dst"]))
    shared = scenarios.sparkSession.sparkContext.broadcast((near, {r["id"]: r["cost"] for r in costs.select("id", "cost").collect()}))

    def run(frames):
        after, price = shared.value
        for frame in frames:
            out = []
            for scenario, start, target, seed in zip(frame["scenario"], frame["start"], frame["target"], frame["seed"]):
                rng = random.Random(f"{scenario}:{seed}")
                seen, total, steps, found = {start}, 0.0, 0, False
                queue = [(0.0, 0.0, start)]
                while queue:
                    level, _, node = heapq.heappop(queue)
                    total, steps = total + price.get(node, 0.0), steps + 1
                    if node == target:
                        found = True
                        break
                    for score, other in after.get(node, ()):
                        if other not in seen:
                            seen.add(other)
                            heapq.heappush(queue, (level + 1 if policy == "breadth" else -score, rng.random(), other))
                out.append((scenario, policy, found, total, steps))
            yield pd.DataFrame(out, columns=["scenario", "policy", "found", "cost", "steps"]).astype({"found": bool, "cost": float, "steps": "int32"})
    rows = scenarios.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    return rows.select("scenario", "start", "target", "seed").mapInPandas(run, SCENARIO)


def cost_range(runs: DataFrame) -> DataFrame:
    """Least, expected and greatest cost of each scenario over its runs that found the target."""
    return runs.groupBy("scenario", "policy").agg(F.min(F.when(F.col("found"), F.col("cost"))).alias("least"), F.avg(F.when(F.col("found"), F.col("cost"))).alias("expected"), F.max(F.when(F.col("found"), F.col("cost"))).alias("greatest"),
                                                  F.avg(F.col("found").cast("double")).alias("found_share"))


def zone_of_effect(edges: DataFrame, changed: DataFrame, relations=("CALLS", "INHERITS", "IMPLEMENTS", "READS", "INSTANTIATES", "TYPE_USES", "IMPORTS")) -> DataFrame:
    """Nodes that may notice a change: everything from which a changed node is reached along typed edges."""
    back = edges.filter(F.col("relation").isin(*relations)).select(F.col("to_id").alias("src"), F.col("from_id").alias("dst")).distinct()
    return closure(back, changed).filter("depth > 0").select(F.col("seed").alias("changed"), F.col("node").alias("affected"), "depth")


def zone_paths(edges: DataFrame, changed: DataFrame, relations=("CALLS", "INHERITS", "IMPLEMENTS", "READS", "INSTANTIATES", "TYPE_USES", "IMPORTS")) -> DataFrame:
    """The zone of effect with its evidence: for each affected node the typed steps by which it depends on the
    change, from the node to the changed one, each (from_id, relation, to_id)."""
    back = edges.filter(F.col("relation").isin(*relations)).select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"), F.col("relation").alias("label")).distinct()
    found = closure_paths(back, changed).filter("depth > 0")
    steps = F.transform(F.reverse("path"), lambda s: F.struct(s["dst"].alias("from_id"), s["label"].alias("relation"), s["src"].alias("to_id")))
    return found.select(F.col("seed").alias("changed"), F.col("node").alias("affected"), "depth", steps.alias("evidence"))


def accessibility(zone: DataFrame, costs: DataFrame) -> DataFrame:
    """Affected nodes by how cheaply they are reached: rank by depth, then cost, within each change."""
    return zone.join(costs.withColumnRenamed("id", "affected"), "affected").withColumn("rank", F.row_number().over(Window.partitionBy("changed").orderBy("depth", "cost", "affected")))


def without(nodes: DataFrame, edges: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without some nodes, for a second run."""
    ids = removed.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    return nodes.join(ids, "id", "left_anti"), kept.select(edges.columns)
