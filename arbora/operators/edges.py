"""Edge algebra: validity, adjacency, degrees, merging of repeats, breakdowns, collisions and set operations.

Tables: nodes (id, ...), edges (from_id, to_id, relation, ...). Nothing here is collected; skewed endpoints are
handled by partial aggregation and AQE's skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between two different known nodes. The last join leaves them dealt by their start, so what groups or joins
    by start next, as :func:`adjacency` and degrees do, needs no further shuffle. Tasks hold their share of the ids; edges,
    many more, pass by and are not sorted."""
    ids = nodes.select("id").distinct().hint("shuffle_hash")
    known = edges.filter("from_id <> to_id").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return known.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select(edges.columns)


def adjacency(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (src, dst) of valid edges; relation and weight don't count."""
    return valid_edges(edges, nodes).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")).distinct()


def undirected(adjacent: DataFrame) -> DataFrame:
    """Both directions of an adjacency, once each."""
    return adjacent.unionByName(adjacent.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(nodes: DataFrame, adjacent: DataFrame) -> DataFrame:
    """id, fan_in, fan_out and degree_centrality of every node: one pass over the adjacency, one shuffle."""
    ends = adjacent.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    every = ends.unionByName(nodes.select("id", F.lit(0).alias("o"), F.lit(0).alias("i")))
    out = every.groupBy("id").agg(F.sum("i").cast("long").alias("fan_in"), F.sum("o").cast("long").alias("fan_out"))
    n = nodes.select(F.countDistinct("id").alias("n")).scalar()
    return out.withColumn("degree_centrality", (F.col("fan_in") + F.col("fan_out")) / F.greatest(F.lit(1), 2 * (n - 1)))


def merge_edges(edges: DataFrame, order: str = "ordinal") -> DataFrame:
    """One edge for each (from_id, to_id, relation): repeats add to the weight, the first one's evidence stays."""
    first = [c for c in ("confidence", "resolution", "evidence", "candidates", "metadata") if c in edges.columns]
    return edges.groupBy("from_id", "to_id", "relation").agg(
        F.count(F.lit(1)).cast("double").alias("weight"), F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in first])


def breakdown(df: DataFrame, *columns: str) -> DataFrame:
    """Counts by each column alone, in one pass: dimension, value, n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))


def name_collisions(symbols: DataFrame, name: str = "label", scope: str = "file_path") -> DataFrame:
    """Names that occur in more than one scope, with the number of scopes."""
    return symbols.groupBy(F.col(name).alias("name")).agg(F.countDistinct(scope).alias("scopes")).filter("scopes > 1")


def top_values(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The k commonest values, ties by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def unresolved_calls(calls: DataFrame, k: int = 20, order: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """The k commonest unresolved names, and the first k calls themselves."""
    return top_values(calls, "name", k), calls.orderBy(order).limit(k)


def token_totals(costs: DataFrame) -> DataFrame:
    """Sums of raw and effective token costs."""
    return costs.agg(F.coalesce(F.sum("token_cost"), F.lit(0)).alias("total_token_cost"), F.coalesce(F.sum("effective_token_cost"), F.lit(0.0)).alias("total_effective_token_cost"))


def top_ranked(metrics: DataFrame, metric: str, k: int = 10, order: str = "ordinal") -> DataFrame:
    """The k largest by a metric; equal values in input order. rank, id, label, value."""
    top = metrics.orderBy(F.desc(metric), order).limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc(metric), order))  # over k rows
    return top.select(rank.alias("rank"), "id", "label", F.col(metric).alias("value"))


def rankings(metrics: DataFrame, names: list[str], k: int = 10, order: str = "ordinal") -> DataFrame:
    """All top-k lists as (metric, rank, id, label, value)."""
    out = None
    for name in names:
        one = top_ranked(metrics, name, k, order).select(F.lit(name).alias("metric"), "rank", "id", "label", F.col("value").cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def only_in(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def in_both(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_semi")


def both_ends(edges: DataFrame) -> DataFrame:
    """Ids that some edge starts from and some edge leads to, in one pass over the edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("from_id").alias("id"), F.lit(1).alias("side")), F.struct(F.col("to_id").alias("id"), F.lit(2).alias("side")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.bit_or("side").alias("side")).filter("side = 3").select("id")


def language_nodes_added(known: DataFrame, more: DataFrame) -> DataFrame:
    """``known`` and those rows of ``more`` whose id is new."""
    return known.unionByName(more.join(known.select("id"), "id", "left_anti"), allowMissingColumns=True)


#: Components up to so many go to all tasks; beyond, symbols of a key are dealt over SPREAD tasks.
BROADCAST_COMPONENTS, SPREAD = 100_000, 64


def implemented_by(components: DataFrame, symbols: DataFrame, keys: list[str], resolution: str) -> DataFrame:
    """IMPLEMENTED_BY edges from components to the language symbol of the same keys. Repeats go before the join: pairs
    can only repeat if ids on both sides stand under several keys, and only then are pairs themselves compared."""
    left, right = components.select(F.col("id").alias("from_id"), *keys).distinct(), symbols.select(F.col("id").alias("to_id"), *keys).distinct()
    several = lambda df, c: not df.groupBy(c).count().filter("count > 1").isEmpty()
    repeats = several(left, "from_id") and several(right, "to_id")
    if left.limit(BROADCAST_COMPONENTS + 1).count() <= BROADCAST_COMPONENTS:
        pairs = right.join(F.broadcast(left), keys)
    else:
        share = F.pmod(F.xxhash64("to_id"), F.lit(SPREAD)).cast("int")
        pairs = right.withColumn("share", share).join(left.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))), [*keys, "share"])
    pairs = pairs.select("from_id", "to_id", F.lit("IMPLEMENTED_BY").alias("relation"), F.lit(resolution).alias("resolution"))
    return pairs.distinct() if repeats else pairs


def label_of(row: Column) -> Column:
    return F.coalesce(F.nullif(row["display_label"], F.lit("")), F.nullif(row["label"], F.lit("")), row["id"])
