"""Registered queries of the operators, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, filteraudit, htmltext, licenses, linededup, media, mixing, ngramjoin, pii, prefixtrie, quality, tokencount, warc
from .oracles import ORACLES


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark, sf_dir):
    found = decontaminate.find_contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_common", "containment").distinct()


def op2_pii(spark, sf_dir):
    return pii.digest(pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_line_dedup(spark, sf_dir):
    out = linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("line_dedup.n_lines").cast("long").alias("n_lines"), F.col("line_dedup.n_kept").cast("long").alias("n_kept"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op4_licenses(spark, sf_dir):
    return licenses.digest(licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_mixing(spark, sf_dir):
    return mixing.mix_sizes(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_ngram_jaccard(spark, sf_dir):
    out = ngramjoin.join_components(_table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, threshold=0.85)
    return out.select("doc_id", "n_shingles", "component_id", "n_links")


def op7_quality(spark, sf_dir):
    out = quality.resample(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_grams", F.round("log_weight", 4).alias("log_weight"), F.round("gumbel_key", 4).alias("gumbel_key"), "kept")


def op8_warc(spark, sf_dir):
    return warc.digest(warc.captures(_table(spark, sf_dir, "pages")))


def op9_media(spark, sf_dir):
    return media.digest(media.media_columns(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_html(spark, sf_dir):
    return htmltext.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")


def op11_token_counts(spark, sf_dir):
    return tokencount.token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "tokens.*")


def op12_filter_audit(spark, sf_dir):
    return filteraudit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark, sf_dir):
    return prefixtrie.trie(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_pii, op3_line_dedup, op4_licenses, op5_mixing, op6_ngram_jaccard, op7_quality, op8_warc, op9_media, op10_html, op11_token_counts, op12_filter_audit, op13_prefix_trie)}
ORACLE_SQL = {k: v for k, v in ORACLES.items() if k in QUERIES}
