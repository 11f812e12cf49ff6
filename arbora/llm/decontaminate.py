"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact containment.

Items are partitioned by their number of distinct shingles into bands of powers of two. A band's items keep their
``r`` smallest shingle hashes (a bottom-r MinHash sketch), r = 2 * floor((1 - t) * band limit) + 1. A document that
contains an item to the threshold t lacks at most m = floor((1 - t) * n) of its n shingles, so it has r - m of the
sketch at least: the search loses nothing, whatever the document's length, and a document with fewer is no candidate.
Shingles of documents pass a bit filter of all sketch hashes before they are joined. Candidates are then verified by
counting all distinct shingles that item and document share.

Words are runs of letters and digits, in lower case; shingles are of five words, and an item with fewer words
is one shingle of all of them, looked for as that run of words in a document.

Defined cases: null or empty texts, on either side, match nothing; rows that repeat an id are told apart by
their text and reported once per id and item; repeated items with one id and the same words count once, items
that share an id (or have none) but not their words are items of their own, reported by that id; empty tables
give an empty result; extra columns are ignored; a long text is one row's array of hashes, never a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, drop_rows, let, row_hash, staged

SHINGLE = 5
THRESHOLD = 0.8
#: The sketch side of the search is broadcast up to so many rows (16 bytes each); beyond, it is shuffled.
BROADCAST_ROWS = 500_000


def word_hashes(text: Column) -> Column:
    """Hashes of the words in order."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]++", " "))
    return F.array_remove(F.transform(F.split(spaced, " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def shingles(hashes: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words, in order, with repeats."""
    def runs(h):
        n = F.size(h)
        all_runs = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
        return F.when(n >= k, all_runs).otherwise(F.array().cast("array<bigint>"))
    return let(hashes, runs)


def item_shingles(items: DataFrame, k: int = SHINGLE) -> DataFrame:
    """item (key of id and words), item_id, width (words of a shingle) and hash, one row a distinct shingle."""
    words = items.select("item_id", word_hashes(F.col("text")).alias("w")).filter(F.size("w") > 0)
    words = words.withColumn("item", F.xxhash64(F.col("item_id").isNull(), "item_id", "w"))
    width = F.least(F.lit(k), F.size("w"))
    short = F.array(*[F.struct(F.lit(j).alias("width"), F.array_distinct(shingles(F.col("w"), j)).alias("s")) for j in range(1, k + 1)])
    chosen = words.select("item", "item_id", F.get(short, width - 1).alias("x")).select("item", "item_id", "x.width", F.col("x.s").alias("s"))
    return chosen.select("item", "item_id", "width", F.explode("s").alias("hash")).distinct()


def sketches(shingled: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """item, item_id, width, n, band, the band's bottom-r sketch hashes of each item and how many a match needs."""
    sized = shingled.groupBy("item", "item_id", "width").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("hash")).alias("hashes"))
    band, lacks = F.ceil(F.log2("n")).cast("int"), F.lit(round(1 - threshold, 9))
    r = F.least(2 * F.floor(lacks * F.pow(F.lit(2.0), band) + 1e-9).cast("int") + 1, F.size("hashes"))
    return sized.select("item", "item_id", "width", "n", band.alias("band"), F.slice("hashes", F.lit(1), r).alias("sketch"), (r - F.floor(lacks * F.col("n") + 1e-9)).cast("long").alias("needs"))


def _doc_shingles(text: Column, widths: list[int]) -> Column:
    """Distinct (width, hash) of a text, as one array. Hashes are made distinct as longs, which is a hash set; as
    structs it would compare all pairs."""
    def tagged(h, width):
        return F.transform(F.array_distinct(shingles(h, width)), lambda x: F.struct(F.lit(width).alias("width"), x.alias("hash")))
    return let(word_hashes(text), lambda h: F.flatten(F.array(*[tagged(h, w) for w in widths])))


def find_contained(docs: DataFrame, items: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, doc_hash, item_id, n_item, n_common, containment of every pair at or over the threshold."""
    spark = docs.sparkSession
    shingled = staged(item_shingles(items, k), "item-shingles")
    sketch = staged(sketches(shingled, threshold), "item-sketches")
    widths = sorted(r["width"] for r in sketch.select("width").distinct().collect())  # at most k rows
    if not widths:
        return spark.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, doc_hash long, item_id {dict(items.dtypes)['item_id']}, n_item long, n_common long, containment double")
    small = shingled.count() <= BROADCAST_ROWS

    def sized(df):
        return F.broadcast(df) if small else df
    probe = sketch.select("item", "width", F.explode("sketch").alias("hash"))
    known = bit_filter(F.col("hash"), probe, 1 << 22)
    base = docs.select("doc_id", row_hash(F.col("text")).alias("doc_hash"), "text")
    hashes = base.select("doc_id", "doc_hash", word_hashes(F.col("text")).alias("w"))
    hits = None
    for w in widths:
        runs = hashes.select("doc_id", "doc_hash", F.explode(shingles(F.col("w"), w)).alias("hash")).filter(known(F.col("hash")))
        one = runs.join(sized(probe.filter(F.col("width") == w).select("item", "hash")), "hash").select("doc_id", "doc_hash", "item", "hash")
        hits = one if hits is None else hits.unionByName(one)
    found = hits.distinct().groupBy("doc_id", "doc_hash", "item").agg(F.count(F.lit(1)).alias("hits")).join(sized(sketch.select("item", "needs")), "item")
    pairs = staged(found.filter("hits >= needs").select("doc_id", "doc_hash", "item"), "candidates")
    test = bit_filter(F.col("doc_hash"), pairs)
    rows = pairs.select("doc_hash", F.col("doc_id").alias("_id")).distinct()
    again = base.filter(test(F.col("doc_hash"))).join(rows, (base["doc_hash"] == rows["doc_hash"]) & base["doc_id"].eqNullSafe(rows["_id"]), "left_semi")
    again = again.dropDuplicates(["doc_id", "doc_hash"])
    full = again.select("doc_id", "doc_hash", F.explode(_doc_shingles(F.col("text"), widths)).alias("x")).select("doc_id", "doc_hash", "x.width", "x.hash")
    shared = full.join(sized(shingled.select("item", "width", "hash")), ["width", "hash"])
    counted = shared.groupBy("doc_id", "doc_hash", "item").agg(F.count(F.lit(1)).alias("n_common"))
    out = counted.join(sized(sketch.select("item", "item_id", F.col("n").alias("n_item"))), "item")
    ratio = F.col("n_common") / F.col("n_item")
    return out.filter(ratio >= threshold - 1e-9).select("doc_id", "doc_hash", "item_id", "n_item", "n_common", F.round(ratio, 6).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that contain no item."""
    found = find_contained(docs, items, **options).select("doc_id", "doc_hash").distinct()
    return drop_rows(docs, staged(found, "leaks"), 1 << 20)
