"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Every row gets a hash-random key from its id. Rows are dealt into ``buckets`` ranges of that key, so a range
sort within a source is a sort inside (source, bucket) plus a prefix over at most ``buckets`` subtotals of the
source; no task holds a whole source. A source's target may need several epochs: each full epoch takes all
its rows, the last one takes rows in key order up to the exact word budget, cutting the row at the border.

Defined cases: null text has size 0 and null source is a source of its own that sorts last; rows that repeat
an id share a key and are ordered by size and text; an empty table gives an empty mix; sources without words get
target 0; extra columns are ignored by :func:`mix_sizes` and kept by :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, fresh, row_hash, staged

#: Weights of sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source is repeated at most so many times.
MAX_EPOCHS = 3
BUCKETS = 1024
#: Borders, a row a source, are broadcast up to so many; beyond, they are joined by shuffle.
BROADCAST_SOURCES = 100_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of runs without space or tab to carriage return."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]*+[^ \t\n\x0B\f\r]++", "x")
    return F.length(F.rtrim(marks, F.lit(SPACES))).cast("long")


def mix_key(doc_id: Column, seed: str = SEED) -> Column:
    """Hash-random order: hexadecimal MD5 of seed and id."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def targets(totals: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``totals`` (source, source_size), one row a source, with column ``target``.

    The targets are min(cap, level * weight) with one common level: sources sorted by cap / weight fill up
    first, and the level of the others shares what these leave. That is the fixed point of resharing.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    fill = Window.orderBy("ratio", F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    t = totals.withColumn("rank", F.row_number().over(order)).withColumn("weight", w)
    t = t.withColumn("cap", (F.col("source_size") * max_epochs).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    every = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("total", F.sum("source_size").over(every).cast("double"))
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # The first row, in filling order, whose own cap is not reached sets the level for itself and all after it.
    t = t.withColumn("open", F.col("ratio") >= F.col("level"))
    level = F.min(F.when(F.col("open"), F.struct("ratio", "rank", "level"))).over(every)["level"]
    t = t.withColumn("common", level)
    capped = F.col("common").isNull() | (F.col("ratio") < F.col("common"))
    return t.select("source", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("common") * F.col("weight")).alias("target"))


def _source_key(source: Column) -> Column:
    """A source as a string that joins: null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def _ordered(docs: DataFrame, buckets: int, seed: str) -> DataFrame:
    """The narrow columns of every row, stored: source, size, and its place (part, key, id, size, text hash) in the mix."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), mix_key(F.col("doc_id"), seed).alias("key"), row_hash(F.col("text")).alias("rk"))
    part = F.floor(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * buckets / float(1 << 28)).cast("int")
    return staged(sized.withColumn("source0", _source_key(F.col("source"))).withColumn("part", part), "sizes")


def _taken(sized: DataFrame, weights, max_epochs: int) -> DataFrame:
    """``sized`` with source_size, target, epochs (whole ones), left (words of the last epoch) and before (words of
    the source ahead of the row)."""
    sums = sized.groupBy("source0", "part").agg(F.first("source").alias("source"), F.sum("size").alias("part_size"))
    ahead = Window.partitionBy("source0").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.withColumn("ahead", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)))
    totals = sums.groupBy("source0").agg(F.first("source").alias("source"), F.sum("part_size").alias("source_size"))
    goal = targets(totals.select("source", "source_size"), weights, max_epochs).withColumn("source0", _source_key(F.col("source")))
    borders = parts.select("source0", "part", "ahead").join(goal.select("source0", "source_size", "target"), "source0")
    inside = Window.partitionBy("source0", "part").orderBy("key", "doc_id", "size", "rk").rowsBetween(Window.unboundedPreceding, -1)
    run = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(borders, ["source0", "part"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return run.withColumn("epochs", epochs).withColumn("left", budget - F.col("epochs") * F.col("source_size")).withColumn("before", F.col("ahead") + F.col("inside"))


def _last(size: Column, left: Column, before: Column) -> Column:
    """Words that the last, partial epoch takes of a row."""
    return F.greatest(F.lit(0).cast("long"), F.least(size, left - before))


def mix_sizes(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target and taken (words that the mix takes, repeats counted)."""
    out = _taken(_ordered(docs, buckets, seed), weights, max_epochs)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + _last(F.col("size"), F.col("left"), F.col("before"))).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """Rows of ``docs`` that the mix takes, with ``mix_taken`` words each (a column of that name is replaced); the row
    at a budget's border is taken in part, its first words.

    A row's share follows from its place beside its source's border, so texts stay where they are; only rows equal in
    id and text that stand at a border themselves are numbered, over their partitions, and share it out.
    """
    run = _taken(_ordered(docs, buckets, seed), weights, max_epochs)
    place = ("key", "doc_id", "size", "rk")
    reached = F.when(F.col("before") < F.col("left"), F.struct(*place))
    cut = run.groupBy("source0").agg(F.max("epochs").alias("epochs"), F.max("left").alias("left"), F.max(reached).alias("cut"))
    same = run.join(cut.select("source0", "cut"), "source0").filter(F.struct(*place) == F.col("cut"))
    tied = same.groupBy("source0").agg(F.min("before").alias("before"), F.count(F.lit(1)).alias("ties"))
    cut = staged(cut.join(tied, "source0", "left"), "cuts")
    side = cut.select(F.col("source0").alias("of"), F.struct("epochs", "left", "cut", "before", "ties").alias("at"))
    side = F.broadcast(side) if cut.count() <= BROADCAST_SOURCES else side

    names = {c: fresh(docs, c) for c in ("size", "key", "rk", "of", "at", "here", "task", "n", "first", "of2", "task2")}
    size, of, at, here, task, n, first = (names[c] for c in ("size", "of", "at", "here", "task", "n", "first"))
    columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "mix_taken"]
    keyed = docs.withColumns({size: word_count(F.col("text")), names["key"]: mix_key(F.col("doc_id"), seed), names["rk"]: row_hash(F.col("text"))})
    side = side.select(F.col("of").alias(of), F.col("at").alias(at))
    keyed = keyed.join(side, _source_key(F.col("source")) == F.col(of))
    own = F.struct(F.col(names["key"]).alias("key"), F.col("doc_id").alias("doc_id"), F.col(size).alias("size"), F.col(names["rk"]).alias("rk"))
    cut_at = F.col(f"{at}.cut")
    keyed = keyed.withColumn(here, F.when(cut_at.isNull() | (own > cut_at), 1).when(own < cut_at, -1).otherwise(0))
    whole = F.col(f"{at}.epochs") * F.col(size)

    def result(rows, last):
        return rows.withColumn(n, whole + last).filter(F.col(n) > 0).select(*columns, F.col(n).alias("mix_taken"))
    alone = F.col(f"{at}.ties") <= 1
    plain = keyed.filter((F.col(here) != 0) | alone)
    out = result(plain, F.when(F.col(here) < 0, F.col(size)).when(F.col(here) > 0, 0).otherwise(_last(F.col(size), F.col(f"{at}.left"), F.col(f"{at}.before"))))
    if not cut.filter("ties > 1").limit(1).count():
        return out
    equal = staged(keyed.filter((F.col(here) == 0) & ~alone).withColumn(task, F.spark_partition_id()), "ties")
    tasks = equal.groupBy(of, task).agg(F.count(F.lit(1)).alias(n))
    ahead = Window.partitionBy(of).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select(F.col(of).alias(names["of2"]), F.col(task).alias(names["task2"]), F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(first))
    numbered = equal.withColumn(n, F.row_number().over(Window.partitionBy(of, task).orderBy(F.xxhash64(at))) - 1)
    numbered = numbered.join(tasks, (F.col(of) == F.col(names["of2"])) & (F.col(task) == F.col(names["task2"])))
    before = F.col(f"{at}.before") + (F.col(first) + F.col(n)) * F.col(size)
    return out.unionByName(result(numbered, _last(F.col(size), F.col(f"{at}.left"), before)))
