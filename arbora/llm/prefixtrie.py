"""The trie of rebuilt conversations: one row per distinct prefix, with its members, children and shared bytes.

Turns are numbered by a range sort and prefix sums of block sizes, so a conversation of any length is spread
over tasks. Each prefix has a 128-bit key: the exclusive-or of digests of its (depth, role, text). Ownership
replaces walks of the trie. A node belongs to its smallest member; since members only get fewer with depth,
each conversation owns a suffix of its own path. A window along each conversation then gives, at every depth, the
bytes from there to its end less the bytes of the nodes it owns there, and whether it owns a leaf. One group-by of
the prefixes sums these over the members: that is the sum over the subtree, as every node below has one owner.

No node's members are ever gathered: the root and other hot prefixes are sums, kept partially by each task. The
ids that end at a node are hashed as a stream, in order, from strings that tasks pack beforehand.

Results for odd input: turns are ordered by turn (null first), then role, then text; null role or text is empty;
rows of a null conv_id belong to no conversation and are left out; repeated rows are turns like others; a
conversation whose base is absent has nothing ahead of its own later turns, and may be left without turns: it is a
member of the root only; an empty table has no members, so no rows, not even the root; other columns are not read.
``%`` keeps the sign of a negative conv_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, staged

#: Every FAMILY conv_ids share the first turns of the first of them; a prefix is shorter than SPLITS turns.
FAMILY, SPLITS = 5, 9
#: Depths of a conversation that one window sees, and ids that one packed string holds.
BLOCK, PACK = 1 << 12, 1 << 12

_KEY = ["depth", "a", "b"]


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, block, at, turn_key, bytes): turns in order of ``at``; a block is a task's share of the order."""
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    key = F.unhex(F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256), 1, 32))
    return staged(ranged.select("conv_id", F.monotonically_increasing_id().alias("at"), key.alias("turn_key"), F.octet_length("text").cast("long").alias("bytes")).withColumn("block", F.shiftright("at", 33)), "turns")


def _plan(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per (conversation, block): where it starts and how its positions move; per conversation: what it borrows."""
    blocks = turns.groupBy("conv_id", "block").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    by_block = Window.partitionBy("conv_id").orderBy("block")  # a row a task that holds turns of the conversation
    blocks = blocks.withColumn("ahead", F.sum("n").over(by_block) - F.col("n")).withColumn("n_turns", F.sum("n").over(Window.partitionBy("conv_id")))
    convs = blocks.groupBy("conv_id").agg(F.max("n_turns").alias("n"))
    convs = convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % SPLITS).cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    lent = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(lent, "base", "left").withColumn("kept", F.least("h", F.coalesce("n_base", F.lit(0).cast("long"))))
    convs = convs.withColumn("length", F.col("kept") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long")))
    convs = staged(convs.select("conv_id", "base", "h", "kept", "length"), "convs")
    return blocks.join(convs.select("conv_id", "h", "kept"), "conv_id").select("conv_id", "block", "start", "ahead", "h", "kept"), convs


def running(rows: DataFrame, descending: bool, sums: dict) -> DataFrame:
    """Running values along each ``conv`` by ``depth``, rows of one depth together: ``sums`` maps a new column to
    (aggregate, column, how two values join). A window sees BLOCK depths; later blocks of a longer conversation
    (``length``) add the total of the blocks before them."""
    block = F.floor(F.col("depth") / BLOCK)
    rows = rows.withColumn("part", -block if descending else block)
    within = Window.partitionBy("conv", "part").orderBy(F.col("depth").desc() if descending else F.col("depth").asc()).rangeBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({new: f(F.col(c)).over(within) for new, (f, c, _) in sums.items()})
    totals = rows.filter(F.col("length") >= BLOCK).groupBy("conv", "part").agg(*(f(F.col(c)).alias(f"{new}_block") for new, (f, c, _) in sums.items()))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    ahead = totals.select("conv", "part", *(f(F.col(f"{new}_block")).over(before).alias(f"{new}_ahead") for new, (f, _, _) in sums.items()))
    out = out.join(ahead, ["conv", "part"], "left")
    values = {new: F.when(F.col(f"{new}_ahead").isNull(), F.col(new)).otherwise(join(F.col(new), F.col(f"{new}_ahead"))) for new, (_, _, join) in sums.items()}
    return out.withColumns(values).drop("part", *(f"{new}_ahead" for new in sums))


def occurrences(conversations: DataFrame) -> DataFrame:
    """(conv, depth, length, bytes, a, b, pa, pb) of every prefix of every rebuilt conversation, the root's at
    depth 0: length in turns, bytes of the last text, the keys of the prefix and of the one before it."""
    turns = _turns(conversations)
    blocks, convs = _plan(turns)
    placed = turns.join(blocks, ["conv_id", "block"]).withColumn("pos", F.col("at") - F.col("start") + F.col("ahead") + 1)
    own = placed.filter("pos > h").select(F.col("conv_id").alias("conv"), (F.col("kept") + F.col("pos") - F.col("h")).alias("depth"), "turn_key", "bytes")
    lent = placed.filter(F.col("pos") < SPLITS).select(F.col("conv_id").alias("base"), "pos", "turn_key", "bytes")
    borrowed = lent.join(convs, "base").filter("pos <= h").select(F.col("conv_id").alias("conv"), F.col("pos").alias("depth"), "turn_key", "bytes")
    zero = F.lit(0).cast("long")
    rows = own.unionByName(borrowed).join(convs.select(F.col("conv_id").alias("conv"), "length"), "conv")
    rows = rows.withColumns({"x": F.xxhash64("turn_key", "depth"), "y": F.xxhash64("depth", "turn_key", F.lit("second"))})
    keyed = running(rows, False, {"a": (F.bit_xor, "x", lambda p, q: p.bitwiseXOR(q)), "b": (F.bit_xor, "y", lambda p, q: p.bitwiseXOR(q))})
    keyed = keyed.select("conv", "depth", "length", "bytes", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"))
    root = convs.select(F.col("conv_id").alias("conv"), zero.alias("depth"), "length", zero.alias("bytes"), zero.alias("a"), zero.alias("b"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"))
    return staged(keyed.unionByName(root), "prefixes")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, a, b, conv): ids of one node side by side become strings of at most PACK ids."""
    names, key, ids = [*_KEY, "first", "ids"], None, []
    rows: list[tuple] = []
    for batch in batches:
        for *at, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if ids and (at != key or len(ids) >= PACK):
                rows.append((*key, ids[0], ",".join(map(str, ids))))
                ids = []
            key = at
            ids.append(conv)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
            rows = []
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, ids[0], ",".join(map(str, ids)))], names)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted packs: one SHA-256 a node over its packs in order; only the running digest is kept."""
    names, key, digest = [*_KEY, "ends_sha256"], None, None
    for batch in batches:
        rows = []
        for *at, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if at != key:
                if digest:
                    rows.append((*key, digest.hexdigest()))
                key, digest = at, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, digest.hexdigest())], names)


def ends(prefixes: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the nodes at which conversations end."""
    n = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = prefixes.filter("depth = length").select(*_KEY, "conv")
    packs = last.repartitionByRange(n, *_KEY, "conv").sortWithinPartitions(*_KEY, "conv").mapInArrow(_pack, "depth long, a long, b long, first long, ids string")
    return packs.repartition(n, *_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_hash, "depth long, a long, b long, ends_sha256 string")


def nodes(prefixes: DataFrame) -> DataFrame:
    """(depth, a, b, pa, pb, conv_id, n_convs, n_leaves, saved_tokens) of every node."""
    owners = prefixes.groupBy(*_KEY).agg(F.min("conv").alias("conv"), F.max("length").alias("deepest"), F.max("bytes").alias("bytes"))
    no_key = {c: F.lit(None).cast("long") for c in ("a", "b", "pa", "pb")}
    owned = owners.select("conv", "depth", F.col("deepest").alias("length"), (-F.col("bytes")).alias("tokens"), (F.col("deepest") == F.col("depth")).cast("long").alias("leaf"), F.lit(True).alias("own")).withColumns(no_key)
    seen = prefixes.select("conv", "depth", "length", F.col("bytes").alias("tokens"), F.lit(0).cast("long").alias("leaf"), F.lit(False).alias("own"), "a", "b", "pa", "pb")
    plus = lambda p, q: p + q
    below = running(seen.unionByName(owned), True, {"tokens_below": (F.sum, "tokens", plus), "leaves_below": (F.sum, "leaf", plus)}).filter("not own")
    return below.groupBy(*_KEY).agg(F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("leaves_below").alias("n_leaves"), F.sum("tokens_below").alias("saved_tokens"))


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    prefixes = occurrences(conversations)
    found = staged(nodes(prefixes), "nodes")
    parent = {"p_depth": F.col("depth"), "pa": F.col("a"), "pb": F.col("b")}
    children = found.filter("depth > 0").groupBy((F.col("depth") - 1).alias("p_depth"), "pa", "pb").count()
    table = found.select(*(c.alias(k) for k, c in parent.items()), F.col("conv_id").alias("parent_conv_id"))
    rows = found.withColumn("p_depth", F.when(F.col("depth") > 0, F.col("depth") - 1))
    out = attach(rows, table, list(parent), found.count(), children)
    n_children = children.select(F.col("p_depth").alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"), F.col("count").alias("n_children"))
    out = out.drop(*parent).join(n_children, _KEY, "left").join(ends(prefixes), _KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
