"""Joins of points and spans by dyadic ranges.

A span is the disjoint union of at most two power-of-two ranges a level, and a point lies in one range of each
level. So a span stands under O(log length) keys, a point under as many as there are levels in use (64 at most),
and they meet by equality, each pair once: no file, line or long span draws all of one side to itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ranges(start: Column, end: Column, levels: int) -> Column:
    """Disjoint ranges (level, slot) that cover start to end, both included: slot s of level k is s * 2^k and the
    2^k - 1 numbers after it."""
    start, end = start.cast("long"), end.cast("long")

    def of_level(k):
        halved = lambda x: F.call_function("shiftright", x, k)  # noqa: E731  rounds down
        low, high = -halved(-start), halved(end + 1)
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        piece = lambda slot: F.struct(k.cast("int").alias("level"), slot.alias("slot"))
        return F.filter(F.array(F.when((low < high) & odd(low), piece(low)), F.when((low < high) & odd(high), piece(high - 1))), lambda x: x.isNotNull())
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of_level))


def cut(spans: DataFrame, start: str, end: str) -> tuple[DataFrame, list[int]]:
    """``spans`` once for each of their ranges, with ``level`` and ``slot``, and the levels in use. Spans that end
    before they start have none."""
    widest = spans.agg(F.max(F.col(end).cast("long") - F.col(start).cast("long"))).first()[0]
    if widest is None or widest < 0:
        return spans.limit(0).withColumns({"level": F.lit(0), "slot": F.lit(0).cast("long")}), []
    pieces = spans.filter(F.col(start) <= F.col(end)).withColumn("piece", F.explode(_ranges(F.col(start), F.col(end), (widest + 1).bit_length())))
    pieces = pieces.select("*", "piece.level", "piece.slot").drop("piece")
    return pieces, sorted(r[0] for r in pieces.select("level").distinct().collect())  # at most 64


def climb(points: DataFrame, at: str, levels: list[int]) -> DataFrame:
    """``points`` once for each level, with the range that holds them."""
    place = F.col(at).cast("long")
    if not levels:
        return points.limit(0).withColumns({"level": F.lit(0), "slot": F.lit(0).cast("long")})
    return points.withColumn("up", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(place, k).alias("slot")) for k in levels)))).select("*", "up.level", "up.slot").drop("up")


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Every pair of a point and a span of equal keys that holds it, both ends included."""
    pieces, levels = cut(spans, start, end)
    return climb(points, at, levels).join(pieces, [*keys, "level", "slot"]).drop("level", "slot")


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, rank: Column) -> DataFrame:
    """keys, ``at`` and ``best``, the least ``rank`` (of columns of ``spans``) among the spans that hold the point, for
    each distinct point that any span holds. Of the spans of one range only the least is kept before the join."""
    pieces, levels = cut(spans, start, end)
    least = pieces.groupBy(*keys, "level", "slot").agg(F.min(rank).alias("best"))
    met = climb(points.select(*keys, at).distinct(), at, levels).join(least, [*keys, "level", "slot"])
    return met.groupBy(*keys, at).agg(F.min("best").alias("best"))
