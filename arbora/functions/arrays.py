"""Array helpers that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def fold_runs(values: Column, block: int = 16, outer: int = 128) -> Column:
    """Exclusive running sums of an array of longs. Appending to an array copies it, so sums run within blocks, then
    over the totals of blocks, and of blocks of these."""
    def scan(a: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("o"))
        return F.aggregate(a, zero, lambda acc, x: F.struct(
            (acc["s"] + x).alias("s"), F.concat(acc["o"], F.array(acc["s"])).alias("o")), lambda acc: acc["o"])

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def in_blocks(a: Column, size: int, over) -> Column:
        cut = F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int")), lambda b: F.slice(a, b * size + 1, F.lit(size)))).otherwise(
            F.array().cast("array<array<bigint>>"))
        return let(cut, lambda blocks: F.flatten(F.zip_with(F.transform(blocks, scan), over(F.transform(blocks, total)), lambda sums, base: F.transform(sums, lambda x: x + base))))
    return let(values, lambda a: F.when(F.size(a) <= block, scan(a)).otherwise(in_blocks(a, block, lambda t: in_blocks(t, outer, scan))))


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern with their starts: array of (start, value), starts in code points from 0."""
    def with_found(found):
        def with_pieces(pieces):
            gaps = F.zip_with(found, pieces, lambda m, p: (F.length(p) + F.length(m)).cast("bigint"))
            starts = F.zip_with(fold_runs(gaps), pieces, lambda s, p: s + F.length(p))
            return F.zip_with(starts, found, lambda s, m: F.struct(s.cast("int").alias("start"), m.alias("value")))
        return let(F.slice(F.split(text, pattern, -1), 1, F.size(found)), with_pieces)
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), with_found)
