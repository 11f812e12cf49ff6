"""Line dedup: exact set-similarity self-join over the lines of all documents, later matches removed.

A line is its set of words, between white space. Tokens are ordered by rarity; a line's prefix, its n - ceil(t * n) + 1
rarest tokens, must share a token with every line of Jaccard similarity t or more. Lines meet by (token, size band),
a line in its own band and the next, which holds all sizes that the length filter lets through. Pairs pass the length
filter, the positional filter (how much can still overlap after the first shared position) and a bound from parity
bits, then exact Jaccard over the whole sets. A line goes when any earlier line of the corpus matches it, in the order
of (doc_id, text hash, line number); so of a group of equal lines the first stays.

Rarity is counted over all words into a table of BUCKETS hash buckets, and the order is (level of the bucket's count,
hash). Any fixed order makes the join exact. Words are not stored: texts are cut for the counts, for the sets and, of the
lines in pairs only, for the checks, which costs no more than storing their hashes and takes no disk.

Equal sets, told by two 64-bit hashes, collapse first, so copies cost one row each. Prefix tokens of few lines have
short posting lists and join directly. Heavy ones, by count, might be shared by a third of all lines: there every line
first meets only the earliest line of its (token, band), which settles large groups of near copies in linear work;
lines still unsettled then meet the whole posting list, so no match is lost.

Defined cases: null text gives a null text back; an empty text is one empty line, and blank lines are kept,
never matched; rows that repeat id and text count as one document and get the same result; a document whose
lines all go has an empty text; extra columns are kept by :func:`dedup_lines`, whatever their names, but for one
named ``line_dedup``, which the result replaces.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, byte_table, discard, fresh, let, release, row_hash, staged

THRESHOLD = 0.8
#: Buckets of the token counts, one byte each.
BUCKETS = 1 << 20
#: A token in the prefixes of more lines is heavy.
LIGHT = 512
#: Shares in which tokens meet, one after the other.
PASSES = 4
#: Shares in which the sets to check are cut from the texts, one after the other; each reads all texts.
SET_SHARES = 1
#: Sets of so many words or more carry no parity bits: with 64 bits these could hardly tell them apart.
BITLESS = 160
#: Heavy tokens (8 bytes each) are broadcast up to so many; beyond, they are shuffled.
BROADCAST_TOKENS = 200_000
#: Parts that a heavy token's lines of one band are dealt into when they meet their earliest line.
SALTS = 16
WHITE = "\t\x0b\x0c\r"


def _spaced(text: Column) -> Column:
    """White space but line feeds as spaces. Most texts have no other, which is cheap to see."""
    odd = F.contains(text, F.lit(WHITE[0])) | F.contains(text, F.lit(WHITE[1])) | F.contains(text, F.lit(WHITE[2])) | F.contains(text, F.lit(WHITE[3]))
    return F.when(odd, F.translate(text, WHITE, " " * len(WHITE))).otherwise(text)


def _level(count: Column) -> Column:
    """Counts on a logarithmic scale, 0 to 127."""
    return F.least(F.lit(127), F.floor(4 * F.log2(count + 1)).cast("int"))


def _lines(docs: DataFrame) -> DataFrame:
    """The lines with words: doc_id, rk, pos, line. Nothing is stored."""
    # The text is hashed and cut before its lines become rows, so once a document; a plain posexplode would cut it a second
    # time, for a filter that Spark infers.
    texts = docs.select("doc_id", row_hash(F.col("text")).alias("rk"), F.split(_spaced(F.col("text")), "\n").alias("lines"))
    return texts.select("doc_id", "rk", F.posexplode_outer("lines").alias("pos", "line")).filter(F.trim("line") != "")


def _n_lines(x: Column) -> Column:
    """The number of lines with words of a text after _spaced(). Texts without blank lines, as most are, need not be cut for it."""
    blank = (x == "") | F.startswith(x, F.lit("\n")) | F.startswith(x, F.lit(" ")) | F.endswith(x, F.lit("\n")) | F.contains(x, F.lit("\n\n")) | F.contains(x, F.lit("\n "))
    return F.when(blank, F.size(F.filter(F.split(x, "\n"), lambda line: F.trim(line) != ""))).otherwise(F.octet_length(x) - F.octet_length(F.replace(x, F.lit("\n"))) + 1)


def _hashes(line: Column) -> Column:
    """64-bit hashes of a line's distinct words."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def rarity_table(docs: DataFrame, buckets: int) -> Column:
    """A literal array: for each hash bucket the level of the number of its words in all texts."""
    every = docs.select(F.explode_outer(F.split(F.replace(_spaced(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("w")).filter(F.col("w") != "")
    counts = every.groupBy(F.xxhash64("w").bitwiseAND(F.lit(buckets - 1)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    # At most a number for each bucket reaches the driver.
    packed = counts.select(F.shiftleft(F.col("b"), 7).bitwiseOR(_level(F.col("n"))).alias("x")).toArrow()["x"].to_numpy()
    table = np.zeros(buckets, np.uint8)
    table[packed >> 7] = packed & 127
    return byte_table(docs.sparkSession, table.tobytes())


def _codes(words: Column, levels: Column, buckets: int) -> Column:
    """The set as sorted longs: level of rarity in the upper bits, the hash's lower bits, bucket included, in the others."""
    def code(h):
        level = F.get(levels, h.bitwiseAND(F.lit(buckets - 1)).cast("int")).cast("bigint")
        # An array that can't have nulls is sorted as plain numbers.
        return F.coalesce(F.shiftleft(level, 56).bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1))), F.lit(0).cast("bigint"))
    return F.sort_array(F.transform(words, code))


def _least_overlap(n: Column, m: Column, t: float) -> Column:
    """Smallest overlap of two sets of these sizes at similarity t."""
    return F.ceil((n + m) * (t / (1 + t)) - 1e-9)


def kept_lines(docs: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, light: int = LIGHT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rk, n) of all rows, n their lines with words, and (doc_id, rk, pos) of the lines that stay."""
    t = threshold
    levels = rarity_table(docs, buckets)
    release(docs.sparkSession)  # the counts' shuffle
    lines = _lines(docs)
    coded = lines.select("doc_id", "rk", "pos", _codes(_hashes(F.col("line")), levels, buckets).alias("codes"))
    n = F.size("codes")
    keep = n - F.ceil(n * t - 1e-9).cast("int") + 1
    partners = F.ceil((n + 1) * t - 1e-9) <= n  # else only an equal set can match
    one = F.lit(1).cast("bigint")
    parity = F.aggregate("codes", F.lit(0).cast("bigint"), lambda acc, c: acc.bitwiseXOR(F.call_function("shiftleft", one, c.bitwiseAND(F.lit(63)).cast("int"))))
    bits = F.when(partners & (n < BITLESS), parity).otherwise(F.lit(0).cast("bigint"))
    # Lines may meet by 32 bits of a token: all pairs are checked, and a shared token is shared in these too.
    token = lambda c: F.shiftright(F.shiftleft(c, 32), 32).cast("int")
    prefix = F.when(partners, F.transform(F.slice("codes", F.lit(1), keep), token)).otherwise(F.array().cast("array<int>"))
    rows = coded.select(F.xxhash64("codes").alias("sid"), F.xxhash64(F.lit(1), "codes").alias("sid2"), F.struct("doc_id", "rk", "pos").alias("ord"), F.struct(n.alias("n"), bits.alias("bits"), prefix.alias("prefix")).alias("set"))
    # Copies are grouped where they are before they are dealt, so a line that is everywhere is a row of each task.
    firsts = staged(rows.groupBy("sid", "sid2").agg(F.min("ord").alias("ord"), F.first("set").alias("set")).select(F.monotonically_increasing_id().alias("id"), "ord.*", "set.*"), "lines")

    def band(size):
        return F.floor(F.log(size) / -math.log(t)).cast("int")
    posting = firsts.select("id", "doc_id", "rk", "pos", "n", "bits", F.posexplode("prefix").alias("i", "token"))
    top = band(F.floor(F.col("n") / t + 1e-9))

    def side(df, key, tag):
        """Rows of a (token, band) key, which may collide as all pairs are checked; size and place share a long."""
        return df.select(F.xxhash64("token", key).alias("key"), F.col("id").alias(f"id_{tag}"), F.col("bits").alias(f"bits_{tag}"), F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.col("i").cast("bigint")).alias(f"at_{tag}"))

    def fields(tag):
        at = F.col(f"at_{tag}")
        return {"n": F.shiftright(at, 32), "i": at.bitwiseAND(F.lit((1 << 32) - 1)), "bits": F.col(f"bits_{tag}")}

    def passes(a, b):
        """Length, positional and parity-bit filter of a pair."""
        small, large = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
        need = _least_overlap(a["n"], b["n"], t)
        return (small >= large * t - 1e-9) & (F.least(a["n"] - a["i"], b["n"] - b["i"]) >= need) & (
            (large >= BITLESS) | (a["n"] + b["n"] - F.bit_count(a["bits"].bitwiseXOR(b["bits"])) >= 2 * need))

    def meet(some, every, least):
        """Pairs of lines of ``some`` (a) with lines of ``every`` (b) in the bands from ``least`` to the last that can match."""
        low = some.withColumn("to", F.explode(F.sequence(least, top)))
        return side(low, F.col("to"), "a").join(side(every, band(F.col("n")), "b"), "key").filter((F.col("id_a") != F.col("id_b")) & passes(fields("a"), fields("b")))

    def unordered(pairs):
        return pairs.select(F.least("id_a", "id_b").alias("x"), F.greatest("id_a", "id_b").alias("y"))

    # A token is in no more lines than its bucket counts, so only tokens of full buckets need counting.
    full = posting.filter(F.get(levels, F.col("token").bitwiseAND(F.lit(buckets - 1))) >= math.floor(4 * math.log2(light + 2)))
    heavy = staged(full.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > light).select("token"), "heavy")
    some = F.broadcast(heavy) if heavy.count() <= BROADCAST_TOKENS else heavy
    hot = staged(full.join(some, "token", "left_semi"), "hot")
    direct = None
    for turn in range(PASSES):  # a share of the tokens at a time, so that a share of the shuffle files is there
        cold = posting.filter(F.pmod("token", F.lit(PASSES)) == turn).join(some, "token", "left_anti")
        # The smaller line of a pair, or either of equal ones, has a shared token among its n - ceil(2t / (1 + t) * n) + 1 first.
        small = cold.filter(F.col("i") <= F.col("n") - F.ceil(F.col("n") * (2 * t / (1 + t)) - 1e-9))
        a, b = F.shiftright("at_a", 32), F.shiftright("at_b", 32)
        pairs = staged(unordered(meet(small, cold, band(F.col("n"))).filter((a < b) | ((a == b) & (F.col("id_a") < F.col("id_b"))))), "pairs")
        direct = pairs if direct is None else direct.unionByName(pairs)
    banded = hot.withColumn("band", band(F.col("n"))).withColumn("salt", F.pmod("id", F.lit(SALTS)))
    lead = banded.groupBy("token", "band").agg(F.min(F.struct("doc_id", "rk", "pos", "id", "n", "i", "bits")).alias("lead")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    star = banded.join(lead, ["token", "band", "salt"]).filter((F.col("id") != F.col("lead.id")) & passes({c: F.col(c) for c in ("n", "i", "bits")}, {c: F.col(f"lead.{c}") for c in ("n", "i", "bits")}))
    first_pairs = staged(direct.unionByName(unordered(star.select(F.col("id").alias("id_a"), F.col("lead.id").alias("id_b")))).distinct(), "pairs")
    places = staged(firsts.select("id", "doc_id", "rk", "pos"), "firsts")
    discard(firsts)  # checks take the room of the prefixes
    settled = _later(lines, first_pairs, places, t)

    # Heavy tokens again, whole: every unsettled line against all others.
    mine = hot.join(settled, "id", "left_anti")
    whole = unordered(meet(mine, hot, band(F.greatest(F.lit(1), F.ceil(F.col("n") * t - 1e-9)))))
    gone = settled.unionByName(_later(lines, staged(whole.distinct().join(first_pairs, ["x", "y"], "left_anti"), "pairs"), places, t))
    spaced = docs.select("doc_id", row_hash(F.col("text")).alias("rk"), _spaced(F.col("text")).alias("x"))
    every = spaced.select("doc_id", "rk", _n_lines(F.col("x")).alias("n"))
    stay = staged(places.join(gone, "id", "left_anti").drop("id"), "places")
    discard(places, hot)  # texts are dealt next
    return every, stay


def _later(lines: DataFrame, pairs: DataFrame, firsts: DataFrame, t: float) -> DataFrame:
    """id of the later line of each pair (x, y) whose exact Jaccard similarity reaches t.

    Parity bits of two longs bound the overlap from above; then each later line meets its earliest candidate, and only
    lines that this leaves open meet the others."""
    if pairs.isEmpty():
        return pairs.select(F.col("x").alias("id"))
    ids = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    need = firsts.select("id", "doc_id", "rk", "pos").join(ids, "id").repartitionByRange("doc_id", "rk", "pos").sortWithinPartitions("doc_id", "rk", "pos")
    place, place2 = F.xxhash64("doc_id", "rk", "pos"), F.xxhash64(F.lit(1), "doc_id", "rk", "pos")
    need = staged(need.select("id", F.monotonically_increasing_id().alias("rank"), place.alias("place"), place2.alias("place2"), "rk"), "needed")
    # Texts without a line to check are not cut.
    in_text, in_place = bit_filter(F.col("rk"), need, 1 << 22), bit_filter(F.col("place"), need, 1 << 22)
    one = F.lit(1).cast("bigint")

    def parity(j):
        own = F.filter("words", lambda w: F.shiftright(w, 6).bitwiseAND(F.lit(1)) == j)
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda acc, w: acc.bitwiseXOR(F.call_function("shiftleft", one, w.bitwiseAND(F.lit(63)).cast("int"))))
    parts = []
    for turn in range(SET_SHARES):
        mine = F.pmod(F.col("place"), F.lit(SET_SHARES)) == turn
        cut = lines.filter(in_text(F.col("rk"))).select(place.alias("place"), place2.alias("place2"), "line").filter(mine & in_place(F.col("place")))
        # Rows that repeat id and text give a line several times.
        met = cut.join(need.filter(mine).drop("rk"), ["place", "place2"]).dropDuplicates(["place", "place2", "id", "rank"])
        some = met.select("id", "rank", _hashes(F.col("line")).alias("words"))
        parts.append(staged(some.select("id", "rank", "words", F.size("words").alias("n"), *[parity(j).alias(f"m{j}") for j in range(2)]), "sets"))
    sets = reduce(DataFrame.unionByName, parts)
    maps = ["rank", "n", "m0", "m1"]
    both = pairs
    for side, key in (("a", "x"), ("b", "y")):
        both = both.join(sets.select(F.col("id").alias(key), *[F.col(c).alias(f"{c}_{side}") for c in maps]), key)
    differ = F.bit_count(F.col("m0_a").bitwiseXOR(F.col("m0_b"))) + F.bit_count(F.col("m1_a").bitwiseXOR(F.col("m1_b")))
    both = both.filter(F.col("n_a") + F.col("n_b") - differ >= 2 * _least_overlap(F.col("n_a"), F.col("n_b"), t))
    ordered = staged(both.select(F.greatest("rank_a", "rank_b").alias("late"), F.least("rank_a", "rank_b").alias("early")), "bounded")

    def verified(some_pairs):
        met = some_pairs.join(sets.select(F.col("rank").alias("early"), F.col("words").alias("words_b")), "early").join(sets.select(F.col("rank").alias("late"), F.col("words").alias("words_a")), "late")
        common = F.size(F.array_intersect("words_a", "words_b"))
        return met.filter(common >= (F.size("words_a") + F.size("words_b") - common) * t - 1e-9).select("late")
    earliest = ordered.groupBy("late").agg(F.min("early").alias("early"), F.count(F.lit(1)).alias("c"))
    first = staged(verified(earliest.select("late", "early")), "settled")
    rest = ordered.join(earliest.filter("c > 1").select("late", F.col("early").alias("least")), "late").filter("early <> least").join(first, "late", "left_anti").select("late", "early")
    found = first.unionByName(verified(rest)).distinct()
    out = staged(found.join(need, found["late"] == need["rank"]).select("id"), "settled")
    discard(*parts, need, first, ordered)
    return out


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` with the lines that stay in ``text``, and struct ``line_dedup`` (n_lines, n_kept).

    Documents that keep all their lines, told by counts, stay where they are; only the others are joined."""
    every, stay = kept_lines(docs, threshold, **options)
    both = every.unionByName(stay, allowMissingColumns=True)
    by_doc = both.groupBy(F.col("doc_id").alias("of_id"), F.col("rk").alias("of_rk")).agg(F.max("n").alias("n"), F.collect_list("pos").alias("keep"))
    less = staged(by_doc.filter(F.col("n") > F.size("keep")).drop("n"), "less")

    lines = F.split(F.col("text"), "\n")
    row, joins = fresh(docs, "row"), fresh(docs, "joins")
    others = [c for c in docs.columns if c.lower() != "line_dedup"]
    columns = [F.col(f"`{c}`") for c in others]
    keyed = docs.select(*columns, row_hash(F.col("text")).alias(row))
    keyed = keyed.withColumn(joins, bit_filter(F.col("of_rk"), less, 1 << 22)(F.col(row)) & F.col("text").isNotNull())
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    same = keyed.filter(~F.col(joins)).select(*columns, F.struct(n_lines.alias("n_lines"), n_lines.alias("n_kept")).alias("line_dedup"))

    of_id, of_rk, kept, picked = (fresh(docs, c) for c in ("of_id", "of_rk", "kept", "picked"))
    side = less.select(F.col("of_id").alias(of_id), F.col("of_rk").alias(of_rk), F.col("keep").alias(kept))
    some = keyed.filter(F.col(joins))
    # Positions of a part's documents are hashed; their texts need no sort.
    joined = some.join(side.hint("shuffle_hash"), some["doc_id"].eqNullSafe(side[of_id]) & (some[row] == side[of_rk]), "left")
    blank = F.filter(F.transform(lines, lambda line, i: F.when(F.trim(_spaced(line)) == "", i)), lambda i: i.isNotNull())
    chosen = let(lines, lambda every: F.transform(F.sort_array(F.concat(F.col(kept), blank)), lambda i: F.get(every, i)))
    out = joined.withColumn(picked, F.when(F.col(kept).isNull(), lines).otherwise(chosen))
    changed = out.select(*[F.col(f"`{c}`") if c != "text" else F.array_join(picked, "\n").alias("text") for c in others],
                         F.struct(n_lines.alias("n_lines"), F.size(picked).alias("n_kept")).alias("line_dedup"))
    return same.unionByName(changed)
