"""How five filters interact: for every order of the filters, what each step removes that no earlier one did.

One scan of the texts gives each document four filter bits and a digest of its text. The fifth filter, exact
copies, compares the document with the least doc_id of its digest. The bits then become a packed bitmap index:
each task lays its rows out by part, every part on whole bytes, with one NumPy bit set a filter and label, and
AND-NOTs them for each of the 32 sets of filters. Population counts by part are summed over tasks; every order
and step is arithmetic on those 32 sums, so its cost does not depend on the number of documents.

Filters: A under 200 words, B distinct words under half of the words, C capitals A-Z over 3 % of the
characters, D any of ``#$%&*|``, E the text of a smaller doc_id. Words are runs of other bytes than space and
tab to carriage return.

Results for odd input: a null text counts as empty (no words: it fails A; all empty texts are copies of the
smallest doc_id among them); a null doc_id is neither smaller nor larger than another, so such a row never
fails E, nor makes another one fail it, and has no label; rows that repeat a doc_id count each, and do not make
each other fail E; a null part counts with the empty string; a document is good (toxic) if any of its labels is;
empty documents give no rows; empty labels give zeros; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, staged

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SIGNS = 200, 50, 3, b"#$%&*|"
#: A task's sums leave it when they cover so many parts.
PARTS = 4096

_CAPITALS, _CONTINUED = bytes(range(65, 91)), bytes(range(128, 192))
_SETS = 1 << len(FILTERS)


def text_bits(raw: bytes) -> int:
    """Bits of the filters A to D that a text in UTF-8 fails."""
    words = raw.split()
    n, points = len(words), len(raw.translate(None, _CONTINUED))
    return ((n < MIN_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * n) << 1
            | (100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > CAPITALS_PERCENT * points) << 2 | (len(raw.translate(None, SIGNS)) < len(raw)) << 3)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(2)
        raw = texts.cast(pa.binary() if texts.type == pa.string() else pa.large_binary())
        rows = [(text_bits(x), hashlib.sha256(x).digest()[:16]) for x in (y.as_py() for y in raw)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.binary())], ["doc_id", "part", "bits", "digest"])


def text_flags(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, bits, digest) of every document; one pass over the texts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(_scan, "doc_id long, part string, bits int, digest binary")


def document_bits(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, bits, good, toxic) of every document, with all five filter bits."""
    flags = staged(text_flags(docs, part), "flags")
    total = flags.count()
    first = flags.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    marked = attach(flags, first, ["digest"], total)
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)
    marked = staged(marked.select("doc_id", "part", F.col("bits").bitwiseOR(copy).alias("bits")), "marked")
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    out = attach(marked, known, ["doc_id"], total)
    return out.select("part", "bits", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def survivors(codes: np.ndarray, n_parts: int, bits: np.ndarray, labels: list[np.ndarray]) -> np.ndarray:
    """For each part (each has a row), set of filters and label (the first is "any document"): rows that fail no
    filter of the set."""
    count = np.bincount(codes, minlength=n_parts)
    room = (count + 7) // 8 * 8  # each part fills whole bytes
    order = np.argsort(codes, kind="stable")
    ends, starts = np.cumsum(count), np.cumsum(room) - room
    place = np.empty(len(codes), np.int64)
    place[order] = np.arange(len(codes)) + np.repeat(starts - (ends - count), count)

    def packed(flags: np.ndarray) -> np.ndarray:
        out = np.zeros(room.sum(), bool)
        out[place] = flags
        return np.packbits(out)

    fails = [packed(bits >> i & 1) for i in range(len(FILTERS))]
    marks = [packed(np.ones(len(codes), bool)), *map(packed, labels)]
    alive = [marks[0]]
    out = np.zeros((n_parts, _SETS, len(marks)), np.int64)
    for s in range(_SETS):
        if s:
            low = (s & -s).bit_length() - 1
            alive.append(alive[s & (s - 1)] & ~fails[low])
        for k, mark in enumerate(marks):
            out[:, s, k] = np.add.reduceat(np.bitwise_count(alive[s] & mark).astype(np.int64), starts // 8)
    return out


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}

    def rows() -> pa.RecordBatch:
        names, n = list(sums), _SETS * len(sums)
        values = np.concatenate([sums[x] for x in names]).reshape(n, 3)
        columns = [pa.array([x for x in names for _ in range(_SETS)], pa.string()), pa.array(np.tile(np.arange(_SETS, dtype=np.int32), len(names))), *(pa.array(values[:, k]) for k in range(3))]
        return pa.RecordBatch.from_arrays(columns, ["part", "filters", "docs", "good", "toxic"])

    for b in batches:
        if not b.num_rows:
            continue
        part = b.column(0).dictionary_encode()
        found = survivors(part.indices.to_numpy(), len(part.dictionary), b.column(1).to_numpy(), [b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3)])
        for name, x in zip(part.dictionary.to_pylist(), found):
            sums[name] = sums[name] + x if name in sums else x
        if len(sums) > PARTS:
            yield rows()
            sums.clear()
    if sums:
        yield rows()


def subset_counts(bits: DataFrame) -> DataFrame:
    """(part, filters, docs, good, toxic): documents that fail no filter of each of the 32 sets."""
    return bits.mapInArrow(_index, "part string, filters int, docs long, good long, toxic long").groupBy("part", "filters").agg(*(F.sum(c).alias(c) for c in ("docs", "good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley (the filter's removals summed over all orders)."""
    counts = subset_counts(document_bits(docs, labels, part))
    table = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("filters", "docs", "good", "toxic"))).alias("t"))  # 32 entries
    steps = table.withColumn("filter_order", F.explode(F.array(*(F.lit("".join(p)) for p in permutations(FILTERS))))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    steps = steps.withColumn("own", sum((F.when(letter == x, 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0)))
    steps = steps.withColumn("before", sum((F.when(F.locate(x, F.col("filter_order")) < F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0)))

    def alive(filters: Column, what: str = "docs") -> Column:
        return F.get("t", filters)[what]

    own, before = F.col("own"), F.col("before")
    after, others = before.bitwiseOR(own), F.lit(_SETS - 1) - own
    orders = F.array(*(F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS))))  # with the filter right after a given set of k
    rounds = F.transform(F.filter(F.sequence(F.lit(0), F.lit(_SETS - 1)), lambda s: s.bitwiseAND(own) == 0), lambda s: F.get(orders, F.bit_count(s)) * (alive(s) - alive(s.bitwiseOR(own))))
    removed = alive(before) - alive(after)
    return steps.select(
        "part", "filter_order", "step", alive(after).alias("kept"), removed.alias("removed"), (alive(F.lit(0)) - alive(own) - removed).alias("redundant"), (alive(others) - alive(F.lit(_SETS - 1))).alias("unique_fails"),
        (alive(before, "good") - alive(after, "good")).alias("good_lost"), (alive(before, "toxic") - alive(after, "toxic")).alias("toxic_lost"), F.aggregate(rounds, F.lit(0).cast("long"), lambda a, x: a + x).alias("shapley"))
