"""n-gram Jaccard join: size-banded tiles, parity bitmaps that bound overlap, exact sorted intersection.

A document is its set of distinct word n-grams (64-bit hashes). Documents of equal sets collapse to one node.
Nodes meet in tiles: a tile is a prefix n-gram (by rarity, so that every linked pair shares one) within
sizes that can still reach the threshold. In a tile the bitmaps' differing bits bound the overlap from above;
pairs that survive are verified by intersecting their sorted arrays. Links then form components.

Light tiles emit their pairs directly. A heavy tile, which may hold a third of all documents, first links
every member to the first of its size band; only members that are still in different components meet again,
so groups of near copies cost linear work there and no link between components is lost. These links span the
components but are not all links within them.

Degrees count all links. A component whose known links join all its nodes is counted as it stands; the nodes of
any other meet within it, block by block, where a matrix product gives the overlaps of all pairs and only counts
leave the task. No table holds the pairs.

Defined cases: null and empty texts have an empty set and link with nothing; texts of fewer words than n are
one n-gram; rows that repeat an id are nodes by their text, and a component's id is the least id of its rows;
a null id is never a component's id unless all its rows have none; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .common import bit_filter, discard, drop_rows, fresh, row_hash, staged
from .components import components

#: Bits of a node's bitmap, and of its fold, which tiles carry.
BITMAP, FOLD = 1024, 256
RARITY_BUCKETS = 1 << 16
LIGHT = 8
#: Shares in which tokens meet, one after the other.
PASSES = 4
#: A member of heavy tiles meets up to so many different leaders.
LEADERS = 4
#: Sets of fewer n-grams meet leaders in all their tiles.
FEW = 64
#: Tokens of open tiles (8 bytes each) are broadcast up to so many; beyond, they are shuffled.
BROADCAST_TOKENS = 200_000
#: A component is dealt into blocks of so many nodes and n-grams at most; each block is sent to all others.
BLOCK, BLOCK_GRAMS = 4096, 1 << 21
#: n-grams of two blocks that are multiplied at a time: cells of a slice.
SLICE_CELLS = 1 << 22


def _sets(batch, k):
    """(row, sorted distinct hashes) of a record batch's column ``text``."""
    column = batch.column(batch.schema.get_field_index("text"))
    for first, borders, raw in bytescan.slices(column):
        starts, ends, rows = bytescan.words(borders, raw)
        h, r = bytescan.runs(bytescan.word_hashes(raw, starts, ends), rows, k)
        cut = np.searchsorted(r, np.arange(len(borders)))
        for i in range(len(borders) - 1):
            yield first + i, np.unique(h[cut[i]:cut[i + 1]])


def _rarity(docs: DataFrame, k: int) -> np.ndarray:
    """Counts of all n-grams in a table of bounded size."""
    def count(batches):
        total = np.zeros(RARITY_BUCKETS, np.int64)
        for batch in batches:
            for _, s in _sets(batch, k):
                total += np.bincount((s & np.uint64(RARITY_BUCKETS - 1)).astype(np.int64), minlength=RARITY_BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["b", "n"])
    rows = docs.select("text").mapInArrow(count, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(RARITY_BUCKETS, np.int64)
    for r in rows:
        out[r["b"]] = r["n"]
    return out


def _ranks(counts: np.ndarray) -> np.ndarray:
    """A bucket's place in the order of its count."""
    ranks = np.empty(len(counts), np.uint64)
    ranks[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts), dtype=np.uint64)
    return ranks


def _codes(s: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The set in order of rarity, as sortable 63-bit codes: rank of the bucket, then the other hash bits."""
    return np.sort((ranks[(s & np.uint64(RARITY_BUCKETS - 1)).astype(np.int64)] << np.uint64(47)) | (s >> np.uint64(17)))


def _node(codes: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(codes.tobytes()).digest()[:8], "little", signed=True)


def _least_overlap(n, m, t):
    return F.ceil((n + m) * (t / (1 + t)) - 1e-9)


def signatures(docs: DataFrame, k: int, t: float, ranks) -> DataFrame:
    """doc_id, doc_hash, n, sid (node of the set; null if empty), prefix codes, bitmap and its fold of every row."""
    def sign(batches):
        for batch in batches:
            size, sid, prefix, bitmap, fold = [], [], [], [], []
            for _, s in _sets(batch, k):
                n = len(s)
                size.append(n)
                if not n:
                    sid.append(None), prefix.append(None), bitmap.append(None), fold.append(None)
                    continue
                codes = _codes(s, ranks.value)
                keep = n - math.ceil(n * t - 1e-9) + 1
                sid.append(_node(codes))
                prefix.append(codes[:keep].view(np.int64))
                odd = np.bincount((codes & np.uint64(BITMAP - 1)).astype(np.int64), minlength=BITMAP) & 1
                bitmap.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                fold.append(np.bitwise_xor.reduce(bitmap[-1].reshape(-1, FOLD // 64), 0))
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([
                batch.column(names.index("doc_id")), batch.column(names.index("doc_hash")), pa.array(size, pa.int32()), pa.array(sid, pa.int64()),
                pa.array(prefix, pa.list_(pa.int64())), pa.array(bitmap, pa.list_(pa.int64())), pa.array(fold, pa.list_(pa.int64()))],
                names=["doc_id", "doc_hash", "n", "sid", "prefix", "bitmap", "fold"])
    rows = docs.select("doc_id", row_hash(F.col("text")).alias("doc_hash"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(sign, f"doc_id {kind}, doc_hash long, n int, sid long, prefix array<long>, bitmap array<long>, fold array<long>")


def _verified(docs, signed, pairs, k, t, ranks) -> DataFrame:
    """The pairs whose exact similarity reaches t. Arrays are made only for documents in a pair."""
    if pairs.isEmpty():
        return pairs
    ids = pairs.select(F.explode(F.array("sid_a", "sid_b")).alias("sid")).distinct()
    # One row of each node stands for it: the least by id and hash.
    place = staged(signed.filter("sid is not null").select("sid", "doc_id", "doc_hash").join(ids, "sid").groupBy("sid").agg(
        F.min("doc_hash").alias("doc_hash")), "needed")
    test = bit_filter(F.col("doc_hash"), place, 1 << 22)
    base = docs.select("text", row_hash(F.col("text")).alias("doc_hash")).filter(test(F.col("doc_hash")))
    some = base.join(place.select("doc_hash"), "doc_hash", "left_semi")

    def arrays(batches):
        for batch in batches:
            sid, codes = [], []
            for _, s in _sets(batch, k):
                if len(s):
                    c = _codes(s, ranks.value)
                    sid.append(_node(c)), codes.append(c.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(sid, pa.int64()), pa.array(codes, pa.list_(pa.int64()))], names=["sid", "codes"])
    made = some.dropDuplicates(["doc_hash"]).select("text").mapInArrow(arrays, "sid long, codes array<long>")
    # One row a node. Both joins read one exchange of the sets, which are long, so no stored copy lies beside it.
    both = pairs.join(made.select(F.col("sid").alias("sid_b"), F.col("codes").alias("codes_b")), "sid_b").join(
        made.select(F.col("sid").alias("sid_a"), F.col("codes").alias("codes_a")), "sid_a").select("sid_a", "sid_b", "codes_a", "codes_b")

    def verify(batches):
        for batch in batches:
            a, b, ca, cb = (batch.column(i) for i in range(4))
            keep = []
            fa, fb, oa, ob = ca.flatten().to_numpy(), cb.flatten().to_numpy(), ca.offsets.to_numpy(), cb.offsets.to_numpy()
            oa, ob = oa - oa[0], ob - ob[0]
            for i in range(batch.num_rows):
                x, y = fa[oa[i]:oa[i + 1]], fb[ob[i]:ob[i + 1]]
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= t * (len(x) + len(y) - common) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["sid_a", "sid_b"])
    out = staged(both.mapInArrow(verify, "sid_a long, sid_b long"), "links")
    discard(place)
    return out


FIELDS = ("sid", "n", "i", "f0", "f1", "f2", "f3")


def _side(df: DataFrame, tag: str, *more: str) -> DataFrame:
    return df.select("token", *[F.col(c).alias(f"{c}_{tag}") for c in (*FIELDS, *more)])


def _fit(t: float):
    """Size, position and folded bitmap of a pair in a tile allow a link."""
    small, large, need = F.least("n_a", "n_b"), F.greatest("n_a", "n_b"), _least_overlap(F.col("n_a"), F.col("n_b"), t)
    differ = sum((F.bit_count(F.col(f"f{j}_a").bitwiseXOR(F.col(f"f{j}_b"))) for j in range(1, 4)), F.bit_count(F.col("f0_a").bitwiseXOR(F.col("f0_b"))))
    return (small >= large * t - 1e-9) & (F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b")) >= need) & (F.col("n_a") + F.col("n_b") - differ >= 2 * need)


def _ordered(df: DataFrame) -> DataFrame:
    return df.select(F.least("sid_a", "sid_b").alias("sid_a"), F.greatest("sid_a", "sid_b").alias("sid_b"))


def _bounded(pairs: DataFrame, maps: DataFrame, t: float) -> DataFrame:
    """Drop pairs whose bitmaps (sid, n, bitmap) differ in more bits than linked sets may."""
    both = pairs.join(maps.select(F.col("sid").alias("sid_a"), F.col("n").alias("n_a"), F.col("bitmap").alias("m_a")), "sid_a").join(
        maps.select(F.col("sid").alias("sid_b"), F.col("n").alias("n_b"), F.col("bitmap").alias("m_b")), "sid_b")
    differ = F.aggregate(F.zip_with("m_a", "m_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return both.filter(F.col("n_a") + F.col("n_b") - differ >= 2 * _least_overlap(F.col("n_a"), F.col("n_b"), t)).select("sid_a", "sid_b")


def link(docs: DataFrame, k: int = 5, threshold: float = 0.8, light: int = LIGHT):
    """(signed rows, verified links between nodes as sid_a, sid_b). The links span every component; within a
    component pairs that only heavy tiles hold may be missing, see ``degrees``."""
    t = threshold
    ranks = docs.sparkSession.sparkContext.broadcast(_ranks(_rarity(docs, k)))
    wide = staged(signatures(docs, k, t, ranks), "signed")
    nodes = wide.filter("sid is not null").groupBy("sid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bitmap").alias("bitmap"), F.first("fold").alias("fold"))
    nodes = staged(nodes, "nodes")
    signed = staged(wide.select("doc_id", "doc_hash", "n", "sid"), "signed")
    discard(wide)
    posting = nodes.select("sid", F.posexplode("prefix").alias("i", "token"))
    shares = []
    for turn in range(PASSES):  # a share of the tokens at a time, so that a share of the shuffle files is there
        part = posting.filter(F.pmod(F.shiftright("token", 8), F.lit(PASSES)) == turn)
        counts = staged(part.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "counts")
        shares.append(staged(part.join(counts, "token"), "tiles"))  # n-grams of one node link nothing
        discard(counts)
    folds = nodes.select("sid", "n", *[F.get("fold", j).alias(f"f{j}") for j in range(4)])
    tiles = staged(reduce(DataFrame.unionByName, shares).join(folds, "sid"), "tiles")
    maps = staged(nodes.select("sid", "n", "bitmap"), "maps")  # what checks need; prefixes are in the tiles
    discard(nodes, *shares)

    cold, hot = tiles.filter(F.col("c") <= light), tiles.filter(F.col("c") > light)
    direct = _ordered(_side(cold, "a").join(_side(cold, "b"), "token").filter((F.col("sid_a") < F.col("sid_b")) & _fit(t)))
    # In a heavy tile members meet the leader of their band: the one with fewest rarer n-grams before this one,
    # as it has least of its own. Ties fall by a hash of the token, so a member meets several leaders.
    # A quarter of a large set's tiles is enough to meet leaders: what they leave open is settled below.
    banded = hot.filter((F.col("n") < FEW) | (F.pmod("token", F.lit(4)) == 0)).withColumn("band", F.floor(F.log("n") / -math.log(t)).cast("int"))
    turn = F.xxhash64("sid", F.pmod("token", F.lit(LEADERS)))
    lead = banded.groupBy("token", "band").agg(F.min(F.struct(F.col("i").alias("before"), turn.alias("turn"), *FIELDS)).alias("lead"))
    star = banded.select("token", "band", *[F.col(c).alias(f"{c}_a") for c in FIELDS]).join(lead.select("token", "band", *[F.col(f"lead.{c}").alias(f"{c}_b") for c in FIELDS]), ["token", "band"])
    star = _ordered(star.filter((F.col("sid_a") != F.col("sid_b")) & _fit(t)))
    first = staged(_bounded(direct.unionByName(star).distinct(), maps, t), "pairs")
    links = _verified(docs, signed, first, k, t, ranks)
    parts = components(links, "sid_a", "sid_b")

    # Heavy tiles that still hold more than one component meet whole, across components.
    own = parts.select(F.col("node").alias("sid"), "component")
    label = hot.select("token", "sid").join(own, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    mixed = staged(label.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token"), "open")
    open_side = F.broadcast(mixed) if mixed.count() <= BROADCAST_TOKENS else mixed
    open_tiles = hot.join(open_side, "token", "left_semi").join(own, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    open_tiles = staged(open_tiles, "open-tiles")
    across = _side(open_tiles, "a", "component").join(_side(open_tiles, "b", "component"), "token").filter((F.col("component_a") < F.col("component_b")) & _fit(t))
    second = staged(_bounded(_ordered(across).distinct(), maps, t).join(first, ["sid_a", "sid_b"], "left_anti"), "pairs")
    more = _verified(docs, signed, second, k, t, ranks)
    discard(tiles, mixed, open_tiles, maps)
    return signed, staged(links.unionByName(more), "links")


def _counts(left: list, right: list | None, t: float):
    """How many sets of the other list (without ``right``: how many others of the same) each set reaches t with."""
    sets = left + (right or [])
    n, n_left = np.array([len(x) for x in sets]), len(left)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), n)
    shared = times[at] > 1  # an n-gram of one set is in no overlap
    at, owner = (np.cumsum(times > 1) - 1)[at[shared]], owner[shared]
    order = np.argsort(at, kind="stable")
    at, owner, total = at[order], owner[order], int((times > 1).sum())
    n_a, n_b = n[:n_left], n[:n_left] if right is None else n[n_left:]
    common = np.zeros((len(n_a), len(n_b)))
    step = max(1, SLICE_CELLS // len(sets))
    for lo in range(0, total, step):
        i, j = np.searchsorted(at, (lo, lo + step))
        x = np.zeros((len(sets), min(step, total - lo)), np.float32)
        x[owner[i:j], at[i:j] - lo] = 1
        common += x[:n_left] @ (x[:n_left] if right is None else x[n_left:]).T
    linked = common >= t * (n_a[:, None] + n_b[None, :] - common) - 1e-9
    if right is None:
        np.fill_diagonal(linked, False)
        return linked.sum(1)
    return np.concatenate((linked.sum(1), linked.sum(0)))


def degrees(docs: DataFrame, signed: DataFrame, links: DataFrame, parts: DataFrame, k: int, t: float) -> DataFrame:
    """sid and n_links: how many other nodes each node of ``parts`` is linked with, all pairs of it counted."""
    nodes = parts.withColumnRenamed("node", "sid")
    known = links.join(nodes.withColumnRenamed("sid", "sid_a"), "sid_a").groupBy("component").agg(F.count(F.lit(1)).alias("known"))
    sizes = nodes.join(signed.filter("sid is not null").groupBy("sid").agg(F.first("n").alias("n"), F.min("doc_hash").alias("doc_hash")), "sid")
    sizes = staged(sizes, "sizes")
    whole = sizes.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("grams")).join(known, "component")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    unsure = staged(whole.filter("known < m * (m - 1) / 2").select("component", blocks.alias("blocks")), "unsure")
    sure = nodes.join(unsure, "component", "left_anti").select("sid")
    plain = links.select(F.explode(F.array("sid_a", "sid_b")).alias("sid")).groupBy("sid").agg(F.count(F.lit(1)).alias("n_links")).join(sure, "sid", "left_semi")
    place = staged(sizes.join(unsure, "component").select("sid", "component", "doc_hash", "blocks", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("part")), "place")
    discard(sizes)
    if place.isEmpty():
        return plain

    def grams(batches):
        for batch in batches:
            sets = [s.view(np.int64) for _, s in _sets(batch, k)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_hash")), pa.array(sets, pa.list_(pa.int64()))], names=["doc_hash", "grams"])
    test = bit_filter(F.col("doc_hash"), place, 1 << 22)
    texts = docs.select("text", row_hash(F.col("text")).alias("doc_hash")).filter(test(F.col("doc_hash"))).join(place.select("doc_hash"), "doc_hash", "left_semi")
    made = texts.dropDuplicates(["doc_hash"]).select("doc_hash", "text").mapInArrow(grams, "doc_hash long, grams array<long>")
    packed = made.join(place, "doc_hash").groupBy("component", "part", "blocks").agg(F.collect_list(F.struct("sid", "grams")).alias("members"))
    other = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = other.groupBy("component", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")).agg(F.collect_list("members").alias("sides")).select(
        (F.col("lo") == F.col("hi")).alias("one"), "sides")

    def count(batches):
        for batch in batches:
            one, sides = batch.column(0).to_pylist(), batch.column(1)
            sid, n = [], []
            for i, alone in enumerate(one):
                found = [side.values for side in sides[i].values]
                if not alone and len(found) < 2:
                    continue  # no node fell into the other block
                sets = []
                for side in found:
                    flat, at = side.field("grams").flatten().to_numpy(zero_copy_only=False), side.field("grams").offsets.to_numpy()
                    sets.append([flat[x - at[0]:y - at[0]] for x, y in zip(at[:-1], at[1:])])
                sid.append(np.concatenate([side.field("sid").to_numpy(zero_copy_only=False) for side in found]))
                n.append(_counts(sets[0], None if alone else sets[1], t))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sid) if sid else [], pa.int64()), pa.array(np.concatenate(n) if n else [], pa.int64())], names=["sid", "n"])
    counted = met.mapInArrow(count, "sid long, n long").groupBy("sid").agg(F.sum("n").alias("n_links"))
    return staged(plain.unionByName(counted), "degrees")


def _named(signed: DataFrame, parts: DataFrame) -> DataFrame:
    """sid and component_id of every node."""
    ids = signed.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"))
    known = staged(ids.join(parts.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid")), "members")
    names = known.groupBy("component").agg(F.min("least").alias("component_id"))
    return known.join(names, "component").select("sid", "component_id")


def _components(signed: DataFrame, final: DataFrame, *more) -> DataFrame:
    out = signed.select("doc_id", "doc_hash", F.col("n").cast("long").alias("n_shingles"), "sid").join(final, "sid", "left")
    return out.select("doc_id", "doc_hash", "n_shingles", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *more)


def join_components(docs: DataFrame, k: int = 5, threshold: float = 0.8, **options) -> DataFrame:
    """Every row's doc_id, doc_hash, n_shingles, component_id and n_links: to how many other sets its set is
    linked, all of them counted."""
    signed, links = link(docs, k, threshold, **options)
    parts = staged(components(links, "sid_a", "sid_b"), "parts")
    final = _named(signed, parts).join(degrees(docs, signed, links, parts, k, threshold), "sid", "left")
    return _components(signed, final, F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, k: int = 5, threshold: float = 0.8, **options) -> DataFrame:
    """Rows of ``docs`` without near copies: of each component the row of the least id stays; of rows that
    share that id, that of the least text hash. Of rows equal in id and text one stays, the least by a hash of its columns."""
    signed, links = link(docs, k, threshold, **options)
    found = staged(_components(signed, _named(signed, components(links, "sid_a", "sid_b"))), "components")
    first = found.filter("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("doc_id", "doc_hash")).alias("stay"))
    doomed = found.filter("n_shingles > 0").join(first, found["component_id"].eqNullSafe(first["component_id"])).filter(
        ~(F.col("doc_id").eqNullSafe(F.col("stay.doc_id")) & (F.col("doc_hash") == F.col("stay.doc_hash")))).select(
        "doc_id", "doc_hash").distinct()
    kept = drop_rows(docs, staged(doomed, "copies"))
    repeated = staged(found.groupBy("doc_id", "doc_hash").count().filter("count > 1"), "repeated")
    if repeated.isEmpty():
        return kept
    # Rows that the bit filter can't clear are grouped; those among them that are not repeated are groups of one.
    test = bit_filter(F.col("doc_hash"), repeated, 1 << 22)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row, maybe, same_id, same = (fresh(docs, c) for c in ("row", "maybe", "same_id", "same"))
    keyed = kept.withColumn(row, row_hash(F.col("text"))).withColumn(maybe, test(F.col(row)))
    whole = F.struct(*columns)
    one = keyed.filter(F.col(maybe)).groupBy(F.col("doc_id").alias(same_id), row).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias(same))
    return keyed.filter(~F.col(maybe)).select(*columns).unionByName(one.select(*[F.col(f"{same}.`{c}`") for c in docs.columns]))
