"""What the operators share: staged tables, row keys, bounded bit filters and native text helpers.

Scratch data goes to the folder that ``spark.checkpoint.dir`` names (shared by driver and executors);
only where it is unset, as in local tests, a temporary folder is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import fold_runs, let  # noqa: F401
from ..session import discard, release, scratch_path  # noqa: F401
from ..session import staged as _staged

#: Keys with more than 1 / SHARE of the rows (so fewer than SHARE keys) are joined by a broadcast.
SHARE = 1024

#: White space of the word contracts: space and the control characters tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"


def staged(df: DataFrame, name: str, dictionary: int = 1 << 20) -> DataFrame:
    """``df`` written to the shared folder and read back; shuffle files of finished steps are released.
    ``dictionary`` bounds the bytes of the dictionary of a column chunk."""
    return _staged(df, name, free=True, dictionary=dictionary)


def fresh(df: DataFrame, name: str) -> str:
    """``name`` behind as many underscores as it takes that no column of ``df`` has it, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_hash(text: Column) -> Column:
    """Tells rows of one id apart by their text (null: as empty)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def byte_table(spark: SparkSession, table: bytes | bytearray) -> Column:
    """A literal array of tinyint in Spark's packed form; for tables of bounded size only."""
    jvm = spark.sparkContext._jvm
    packed = jvm.org.apache.spark.sql.catalyst.expressions.UnsafeArrayData.fromPrimitiveArray(bytearray(table))
    kind = jvm.org.apache.spark.sql.types.DataType.fromDDL("array<tinyint>")
    literal = jvm.org.apache.spark.sql.catalyst.expressions.Literal(packed, kind)
    return Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal))


def bit_filter(keys: Column, of: DataFrame, bits: int = 1 << 20):
    """A predicate maker for a cheap test that a hashed key may occur in ``of[keys]``.

    The table has ``bits`` / 8 bytes, whatever the number of keys; false positives pass, no key is lost. It
    only thins a side before an exact join, which must follow.
    """
    size = bits // 8
    bucket = F.pmod(F.xxhash64(keys), F.lit(bits).cast("long")).cast("int")
    rows = of.select(bucket.alias("b")).groupBy(F.shiftright("b", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, b & 7)")).alias("m"))
    packed = rows.groupBy(F.shiftright("at", 10).alias("hi")).agg(F.collect_list(F.shiftleft("at", 8).bitwiseOR(F.col("m"))).alias("x"))
    table = bytearray(size)
    for row in packed.collect():  # at most size / 1024 rows of 1024 numbers
        for x in row["x"]:
            table[x >> 8] = x & 255
    literal = byte_table(of.sparkSession, table)

    def test(key: Column) -> Column:
        at = F.pmod(F.xxhash64(key), F.lit(bits).cast("long")).cast("int")
        return F.call_function("shiftright", F.get(literal, F.shiftright(at, 3)).cast("int"), at.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1)) == 1
    return test


def drop_rows(docs: DataFrame, doomed: DataFrame, bits: int = 1 << 22) -> DataFrame:
    """``docs`` without the rows whose doc_id and text hash are in ``doomed`` (stored; doc_id, doc_hash).

    Only rows that the bit filter can't clear take part in the join; the others, with their texts, stay where
    they are."""
    row, maybe, gone_id, gone_row = (fresh(docs, c) for c in ("row", "maybe", "gone_id", "gone_row"))
    test = bit_filter(F.col("doc_hash"), doomed, bits)
    out = doomed.select(F.col("doc_id").alias(gone_id), F.col("doc_hash").alias(gone_row))
    keyed = docs.withColumn(row, row_hash(F.col("text"))).withColumn(maybe, test(F.col(row)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    same = F.col(row).eqNullSafe(F.col(gone_row)) & F.col("doc_id").eqNullSafe(F.col(gone_id))
    rest = keyed.filter(F.col(maybe)).join(out, same, "left_anti").select(*columns)
    return keyed.filter(~F.col(maybe)).select(*columns).unionByName(rest)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, for scans of ASCII words: other letters may be lowered too, but none becomes an ASCII letter
    (two would, and texts with them take the slow way)."""
    odd = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    return F.when(odd, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def attach(rows: DataFrame, table: DataFrame, keys: list[str], total: int, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` left-joined with ``table``, in which ``keys`` are unique; a row with a null key finds nothing.
    A key with a large share of the ``total`` rows must not meet in one task: such keys are fewer than SHARE, and
    their rows join by a broadcast; the rest is shuffled. ``counts``: rows by key in a column ``count``, if known."""
    counts = rows.dropna(subset=keys).groupBy(*keys).count() if counts is None else counts
    hot = table.join(counts.filter(F.col("count") * SHARE > total).select(*keys), keys, "left_semi").withColumn("hot", F.lit(True))
    keyed = rows.join(F.broadcast(hot), keys, "left")
    values = [c for c in table.columns if c not in keys]
    rest = keyed.filter("hot is null").drop("hot", *values)
    blank = F.greatest(*(F.col(k).isNull() for k in keys)) if len(keys) > 1 else F.col(keys[0]).isNull()
    none = rest.filter(blank).withColumns({c: F.lit(None).cast(table.schema[c].dataType) for c in values})
    return keyed.filter("hot").drop("hot").unionByName(none).unionByName(rest.filter(~blank).join(table, keys, "left"))
