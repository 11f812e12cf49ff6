"""Quality classifier by importance resampling.

Two hashed n-gram models are fitted: the raw model on every document, the target model on the good documents of
a labelled sample (bounded by ``sample``). A document's log importance weight is the sum, over its n-grams,
of log p_target - log p_raw. Gumbel noise from a hash of the row turns weights into keys, and the k largest keys
are the sample. k is a share of the documents with words: that of good ones among the labelled, unless the caller
names another. N-grams are words, word pairs and one to three word shapes (case, digits, punctuation, length,
repetition), so the models see layout and repetition in any language.

The k-th key is found by counting keys in 4096 bins, again within a bin, until few rows are left: no global
sort, nothing unbounded on the driver.

Defined cases: null and empty texts have no n-grams, weight 0, and are rejected; rows equal in id and text
share a key and their fate, as do rows of equal keys (all that tie with the k-th key are kept); without a good
label every document with words is kept; extra columns are kept by :func:`keep_good`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .common import drop_rows, row_hash, staged

BUCKETS = 1 << 14
#: Labelled rows that the target model and the share of good ones are taken from, at most.
SAMPLE = 8000
#: Weights are divided by this before the noise is added.
TEMPERATURE = 1.0
_UPPER = np.zeros(256, np.int32)
_UPPER[65:91] = 1
_LOW = np.zeros(256, np.int32)
_LOW[97:123] = 1
_LOW[128:] = 1
_DIGIT = np.zeros(256, np.int32)
_DIGIT[48:58] = 1
_PUNCT = 1 - _UPPER - _LOW - _DIGIT


def features(column, k_buckets: int = BUCKETS):
    """(row, bucket of every n-gram) of each row of a string column."""
    for first, borders, raw in bytescan.slices(column):
        starts, ends, rows = bytescan.words(borders, raw)
        hashes = bytescan.word_hashes(raw, starts, ends)
        n = len(starts)
        if n:
            def total(table):
                sums = np.zeros(len(raw) + 1, np.int32)
                np.cumsum(table[raw], out=sums[1:])
                return sums[ends] - sums[starts]
            up, low, digit, punct, size = total(_UPPER), total(_LOW), total(_DIGIT), total(_PUNCT), ends - starts
            last = _PUNCT[raw[ends - 1]] * (1 + np.isin(raw[ends - 1], [33, 63]) + 2 * np.isin(raw[ends - 1], [35, 36, 37, 38, 42, 124]))
            case = np.where(up + low == 0, 0, np.where(up == 0, 1, np.where((up == 1) & (_UPPER[raw[starts]] == 1), 2, np.where(low == 0, 3, 4))))
            same = np.zeros(n, np.int64)
            same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
            wide = np.searchsorted([2, 4, 7, 11, 17], size)
            shape = ((((case * 2 + (digit > 0)) * 5 + last) * 3 + np.minimum(punct, 2)) * 2 + same).astype(np.uint64)
            long_shape = shape * np.uint64(8) + wide.astype(np.uint64)
            grams, at = [bytescan.mix(hashes + np.uint64(1)), bytescan.mix(long_shape + np.uint64(1 << 20))], [rows, rows]
            for k, base in ((2, shape), (3, shape), (2, hashes)):
                if n >= k:
                    h = np.full(n - k + 1, k, np.uint64)
                    for j in range(k):
                        h = bytescan.mix(h * np.uint64(31) + base[j:n - k + 1 + j])
                    whole = rows[:n - k + 1] == rows[k - 1:]
                    grams.append(h[whole])
                    at.append(rows[:n - k + 1][whole])
            grams, at = np.concatenate(grams), np.concatenate(at)
            order = np.argsort(at, kind="stable")
            buckets = (grams[order] % np.uint64(k_buckets)).astype(np.int64)
            cut = np.searchsorted(at[order], np.arange(len(borders)))
        for i in range(len(borders) - 1):
            yield first + i, buckets[cut[i]:cut[i + 1]] if n else np.zeros(0, np.int64)


def _counts(texts: DataFrame, buckets: int) -> np.ndarray:
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, f in features(batch.column(0), buckets):
                total += np.bincount(f, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["b", "n"])
    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(count, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["b"]] = r["n"]
    return out


def _scored(rows: DataFrame, ratio, buckets: int, schema: str) -> DataFrame:
    """``rows`` (text last) without text, with total (sum of log ratios) and n_grams."""
    def score(batches):
        for batch in batches:
            total, n = [], []
            for _, f in features(batch.column(batch.num_columns - 1), buckets):
                total.append(float(ratio.value[f].sum())), n.append(len(f))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(total, pa.float64()), pa.array(n, pa.int64())],
                                             names=[*batch.schema.names[:-1], "total", "n_grams"])
    return rows.mapInArrow(score, schema + ", total double, n_grams long")


def weigh(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS) -> tuple[DataFrame, float]:
    """doc_id, doc_hash, n_grams and log_weight of every row; and the share of good ones among the labelled rows
    with words, 1 without any."""
    spark = docs.sparkSession
    chosen = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn(
        "at", F.xxhash64("doc_id", F.lit(7))).orderBy("at", "doc_id").limit(sample)
    known = staged(docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "quality")), "doc_id").select("quality", "text"), "labelled")
    worded = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    n, good = known.filter(worded).agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("quality") == 1).cast("int")), F.lit(0))).first()
    raw = _counts(docs, buckets)
    target = _counts(known.filter("quality = 1"), buckets)
    if not target.sum():
        target = raw
    log = np.log((target + 0.5) / (target.sum() + 0.5 * buckets)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * buckets))
    ratio = spark.sparkContext.broadcast(log)
    kind = dict(docs.dtypes)["doc_id"]
    scored = _scored(docs.select("doc_id", row_hash(F.col("text")).alias("doc_hash"), "text"), ratio, buckets, f"doc_id {kind}, doc_hash long")
    return scored.select("doc_id", "doc_hash", "n_grams", F.col("total").alias("log_weight")), good / n if good else 1.0


def _kth(keys: DataFrame, k: int, few: int = 4096) -> float:
    """The k-th largest of column ``key``."""
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    while True:
        inside = keys.filter(F.col("key").between(lo, hi))
        if hi <= lo or inside.count() <= few:
            break
        step = (hi - lo) / 4096
        place = F.least(F.lit(4095), F.floor((F.col("key") - lo) / step)).cast("int")
        bins = sorted(((r["p"], r["n"], r["lo"], r["hi"]) for r in inside.groupBy(place.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()), reverse=True)
        above = keys.filter(F.col("key") > hi).count()
        for _, n, low, high in bins:
            if above + n >= k:
                lo, hi = low, high
                break
            above += n
    above = keys.filter(F.col("key") > hi).count()
    rest = inside.groupBy("key").count().orderBy(F.desc("key")).limit(few).collect()
    for r in rest:
        above += r["count"]
        if above >= k:
            return r["key"]
    return lo


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, temperature: float = TEMPERATURE, **options) -> DataFrame:
    """doc_id, doc_hash, n_grams, log_weight, gumbel_key and kept of every row. ``share``: the size of the sample, as a
    part of the rows with words; by default the share of good rows among the labelled ones."""
    u = (F.pmod(F.xxhash64("doc_hash", "doc_id", F.lit(11)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weighed, good = weigh(docs, labels, **options)
    keys = staged(weighed.withColumn("key", F.col("log_weight") / temperature - F.log(-F.log(u))), "keys")
    words = keys.filter("n_grams > 0")
    k = round(words.count() * (good if share is None else share))
    cut = _kth(words.select("key"), k) if k else float("inf")
    return keys.select("doc_id", "doc_hash", "n_grams", "log_weight", F.col("key").alias("gumbel_key"), ((F.col("n_grams") > 0) & (F.col("key") >= cut)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that the resampling keeps."""
    bad = resample(docs, labels, **options).filter("not kept").select("doc_id", "doc_hash").distinct()
    return drop_rows(docs, staged(bad, "rejected"))
