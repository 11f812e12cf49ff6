"""Traversals: closure, path accumulation, reachability, neighbourhood and filtered subgraphs, structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import join_url
from ..session import staged
from .structure import least_labels, numbered, search_growth, strong_components


def closure(edges: DataFrame, seeds: DataFrame, rounds: int = 1000) -> DataFrame:
    """(seed, node, depth) of everything that seeds reach along (src, dst), seeds at depth 0. Each level is written
    once and read again only to tell what is new."""
    level = staged(seeds.select(F.col("id").alias("seed"), F.col("id").alias("node")).distinct().withColumn("depth", F.lit(0)), "reached")
    seen = level
    edges = staged(edges.select("src", "dst"), "edges")
    for depth in range(1, rounds + 1):
        step = level.select("seed", "node").join(edges.select(F.col("src").alias("node"), "dst"), "node").select("seed", F.col("dst").alias("node")).distinct()
        level = staged(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)), "reached")
        if level.isEmpty():
            return seen
        seen = seen.unionByName(level)
    raise RuntimeError(f"not closed after {rounds} rounds")


def closure_paths(edges: DataFrame, seeds: DataFrame, rounds: int = 1000) -> DataFrame:
    """(seed, node, depth, path) of everything that seeds reach along ``edges`` (src, dst, label): path is the
    labelled steps of a shortest way, the one whose last step has the least (src, label), then likewise before it.

    Levels keep one step for each (seed, node); whole paths come from these by pointer doubling, so a path of d
    steps takes log d joins."""
    level = staged(seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("label")).distinct().withColumn("depth", F.lit(0)), "witness")
    seen = level
    edges = staged(edges.select("src", "dst", "label"), "edges")
    for depth in range(1, rounds + 1):
        step = level.select("seed", F.col("node").alias("src")).join(edges.select("src", "dst", "label"), "src").groupBy("seed", F.col("dst").alias("node")).agg(F.min(F.struct(F.col("src").alias("via"), "label")).alias("w"))
        step = step.select("seed", "node", "w.via", "w.label")
        level = staged(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)), "witness")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    else:
        raise RuntimeError(f"not closed after {rounds} rounds")
    one = F.struct(F.col("via").alias("src"), "label", F.col("node").alias("dst"))
    way = staged(seen.select("seed", "node", "depth", F.col("via").alias("back"), F.when(F.col("via").isNotNull(), F.array(one)).otherwise(F.array().cast("array<struct<src:string,label:string,dst:string>>")).alias("path")), "ways")
    reach = 1
    while reach < depth:
        before = way.select("seed", F.col("node").alias("back"), F.col("back").alias("further"), F.col("path").alias("start"))
        way = staged(way.join(before, ["seed", "back"], "left").select("seed", "node", "depth", F.col("further").alias("back"), F.when(F.col("start").isNull(), F.col("path")).otherwise(F.concat("start", "path")).alias("path")), "ways")
        reach *= 2
    return way.select("seed", "node", "depth", "path")


def path_prefixes(roots: DataFrame, includes: DataFrame, rounds: int = 100) -> DataFrame:
    """Prefixes and tags that reach each router: root, router, prefix, tags, depth.

    ``roots``: root, router, prefix, tags. ``includes``: parent, child, prefix, tags, where prefix is the
    child's own one behind the inclusion's. A router counts once a root, by its shallowest, least path."""
    level = roots.select("root", "router", "prefix", "tags").withColumn("depth", F.lit(0))
    seen = staged(level, "prefixes")
    level = seen
    for depth in range(1, rounds + 1):
        step = level.join(includes.select(F.col("parent").alias("router"), "child", F.col("prefix").alias("more"), F.col("tags").alias("own")), "router").select(
            "root", F.col("child").alias("router"), join_url(F.col("prefix"), F.col("more")).alias("prefix"), F.array_distinct(F.concat("tags", "own")).alias("tags"), F.lit(depth).alias("depth"))
        first = step.groupBy("root", "router").agg(F.min(F.struct("prefix", "tags")).alias("p")).select("root", "router", "p.prefix", "p.tags", F.lit(depth).alias("depth"))
        level = staged(first.join(seen.select("root", "router"), ["root", "router"], "left_anti"), "prefixes")
        if level.isEmpty():
            return seen
        seen = staged(seen.unionByName(level), "prefixes")
    raise RuntimeError(f"inclusions nest deeper than {rounds}")


def unreachable(readable: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Readable nodes of files in which no arrival lies: reading one symbol reads its file. ``arrivals``: node_id."""
    reached = readable.join(arrivals.select(F.col("node_id").alias("id")).distinct(), "id", "left_semi").select("file_path").distinct()
    return readable.join(reached, "file_path", "left_anti").select("id", "file_path")


def neighbourhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seeds with all nodes one edge away, and the edges at the seeds."""
    ids = seeds.select("id").distinct()
    at = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select(edges.columns).unionByName(
        edges.join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(edges.columns)).distinct()
    near = at.select(F.explode(F.array("from_id", "to_id")).alias("id")).unionByName(ids).distinct()
    return nodes.join(near, "id", "left_semi"), at


def search_subgraph(nodes: DataFrame, edges: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """What a search for a text shows: nodes whose label or metadata holds it, any case, those that one pass over the
    edges in their order (``ordinal``, then ends and relation) adds, as an edge with one end found adds the other, and
    the edges among all of them."""
    low = text.lower()
    hits = nodes.filter(F.lower("label").contains(low) | F.lower(F.coalesce("metadata", F.lit(""))).contains(low))
    found = search_growth(numbered(edges.select("from_id", "to_id", "relation", "ordinal"), "ordinal", "from_id", "to_id", "relation"), hits)
    return facet_filter(nodes.join(found.select("id"), "id", "left_semi"), edges)


def facet_filter(nodes: DataFrame, edges: DataFrame, node_filter: Column | None = None, edge_filter: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes that pass, and edges that pass and have both ends among them."""
    kept = nodes if node_filter is None else nodes.filter(node_filter)
    ids = kept.select("id")
    e = edges if edge_filter is None else edges.filter(edge_filter)
    e = e.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return kept, e.select(edges.columns)


def components(nodes: DataFrame, adjacent: DataFrame, rounds: int = 200) -> DataFrame:
    """id, component (least id) of the undirected graph of valid edges, by contraction."""
    return least_labels(nodes, adjacent, rounds)


def cyclic_nodes(adjacent: DataFrame) -> DataFrame:
    """Nodes that lie on a cycle: in a strong component of more than one node, or with an edge to themselves."""
    loops = adjacent.filter("src = dst").select(F.col("src").alias("id"))
    return strong_components(adjacent).select("id").unionByName(loops).distinct()
