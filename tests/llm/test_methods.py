"""That results come by the methods named, and that columns of any name and rows that repeat pass."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.llm import common, htmltext, licenses, linededup, mixing, ngramjoin, quality, warc

SCHEMA = "doc_id long, text string"
SF = "/root/testdata/sf0.01"


def plain_tags(page):
    """A page whose structure says nothing: tags and classes that name a part become plain ones."""
    return re.sub(r"<(/?)(article|nav|footer|aside|header|main|section)\b[^>]*>", r"<\1div>", re.sub(r"<div class=\"[^\"]*\">", "<div>", page))


def test_tree_alone_on_pages_without_structure(spark):
    right = total = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        named, bare = htmltext.blocks(r["html"]), htmltext.blocks(plain_tags(r["html"]))
        assert [b[0] for b in named] == [b[0] for b in bare] and not any(b[4] for b in bare)
        got = htmltext.kept(bare, check=False)
        assert htmltext.kept(bare) == got
        right += sum(g == (b[4] > 0) for g, b in zip(got, named))
        total += len(bare)
    assert right / total >= 0.97


LONG = "A paragraph of the article that tells at some length what has happened, where, and to whom. " * 3
PARTS = ['<nav><ul><li><a href="x">Home</a></li><li>About this site</li></ul></nav>', '<div role="navigation">' + LONG + "</div>", "<header><p>" + LONG + "</p></header>", '<div id="site-footer"><p>' + LONG + "</p></div>", "<aside><p>" + LONG + "</p></aside>",
         '<div class="left sidebar"><p>' + LONG + "</p></div>", '<div class="cookie-notice"><p>' + LONG + "</p></div>", '<div class="ad"><p>' + LONG + "</p></div>", "<form><p>" + LONG + "</p><input></form>", "<script>var a = '" + LONG + "';</script>",
         "<style>p { content: '" + LONG + "' }</style>", '<section id="comments"><p>' + LONG + "</p></section>", "<!-- " + LONG + " -->", '<ol class="comment-list"><li>' + LONG + "</li></ol>"]


@pytest.mark.parametrize("part", PARTS)
def test_what_is_no_article(part):
    body = "<h1>A title of some words</h1>" + "".join(f"<p>{i} {LONG}</p>" for i in range(4))
    want = ["A title of some words"] + [f"{i} {LONG}".strip() for i in range(4)]
    inside = "" if part.startswith("<header") else part  # a header inside the main part may be the article's own
    for page in (part + "<div>" + body + "</div>", "<div>" + body + "</div>" + part, "<article>" + body + "<p>Six words at the end.</p></article>" + part, "<main>" + body + inside + "</main>"):
        assert htmltext.main_text(page).split("\n\n") == want + ["Six words at the end."] * ("article>" in page)


def plain_weights(texts, labels):
    found = [np.bincount(f, minlength=quality.BUCKETS) for _, f in quality.features(__import__("pyarrow").array(texts, "string"))]
    raw = sum(found)
    target = sum((f for f, x in zip(found, labels) if x == 1), np.zeros(quality.BUCKETS))
    n = quality.BUCKETS
    ratio = np.log((target + 0.5) / (target.sum() + 0.5 * n)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * n))
    return [float((f * ratio).sum()) for f in found]


def test_gumbel_top_k_equals_a_plain_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(400).cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    every = docs.collect()
    weights = dict(zip((r["doc_id"] for r in every), plain_weights([r["text"] for r in every], [good.get(r["doc_id"]) for r in every])))
    u = (F.pmod(F.xxhash64(common.row_hash(F.col("text")), "doc_id", F.lit(11)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    noise = {r["doc_id"]: -math.log(-math.log(r["u"])) for r in docs.select("doc_id", u.alias("u")).collect()}
    for share, temperature in ((None, 1.0), (0.3, 1.0), (0.5, 1000.0)):
        got = {r["doc_id"]: r for r in quality.resample(docs, labels, share=share, temperature=temperature).collect()}
        keys = {d: weights[d] / temperature + noise[d] for d in weights}
        assert all(abs(got[d]["gumbel_key"] - keys[d]) < 1e-6 * max(1, abs(keys[d])) for d in keys)
        worded = [d for d in keys if got[d]["n_grams"] > 0]
        known = [good[d] for d in worded if d in good]
        k = round(len(worded) * (share if share is not None else sum(x == 1 for x in known) / len(known)))
        assert {d for d in got if got[d]["kept"]} == set(sorted(worded, key=lambda d: -keys[d])[:k])


def test_likeness_to_the_target_rises(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    part = F.pmod(F.xxhash64("doc_id", F.lit("split")), F.lit(3))
    rows = quality.resample(docs, labels.filter(part > 0)).join(labels.filter(part == 0), "doc_id").collect()
    before, after = np.mean([r["quality"] == 1 for r in rows]), np.mean([r["quality"] == 1 for r in rows if r["kept"]])
    assert after > before and after >= 0.97


def test_mix_shares_out_equal_rows(spark):
    rows = [(7, "a b c d e f g h i j", "x")] * 5 + [(8, "a b c", "y")] * 40 + [(9, "other words", "y"), (None, "n o", "y"), (None, "n o", "y"), (None, "p q", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    for weights in ((5.0, 2.0, 1.0), (1.0, 1.0, 1.0), (1.0, 9.0, 1.0), (1.0, 30.0, 1.0)):
        sizes = [r for r in mixing.mix_sizes(docs, weights=weights).collect() if r["taken"] > 0]
        mixed = mixing.mix(docs, weights=weights).collect()
        assert sorted((r["doc_id"] or 0, r["source"], r["taken"]) for r in sizes) == sorted((r["doc_id"] or 0, r["source"], r["mix_taken"]) for r in mixed)


def test_revisits_name_records_that_exist(spark, tmp_path):
    pages = [(i, f"http://h/{i}", f"payload {i % 4}" if i % 3 else "one payload of many") for i in range(60)] + [(59, "http://again", "payload 3"), (57, "http://again", "one payload of many")]
    folder = tmp_path.as_uri()
    records = warc.read_archives(warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5), folder)).collect()
    ids = [r["id"] for r in records if r["id"]]
    assert len(ids) == len(set(ids)) and sum(r["kind"] == "metadata" for r in records) == len(pages)
    responses = {r["id"]: r for r in records if r["kind"] == "response"}
    revisits = [r for r in records if r["kind"] == "revisit"]
    assert len(revisits) > 30 and all(r["digest"] == responses[r["refers_to"]]["digest"] and int(r["page"]) < int(responses[r["refers_to"]]["page"]) for r in revisits)
    assert all(r["concurrent_to"] in set(ids) for r in records if r["kind"] in ("request", "metadata"))


CLASHES = ["row", "maybe", "gone_id", "gone_row", "joins", "of_id", "of_rk", "stay", "picked", "keep", "size", "key", "rk", "of", "at", "here", "task", "n", "first", "of2", "task2", "sid", "id", "pos", "line", "codes", "token", "band", "doc_hash", "hash", "Rest", "component", "leak_id", "leak_row", "same_row", "same_maybe", "same_id"]


def test_columns_of_any_name_pass(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long + "\nanother line that stands here", "a"), (2, long + " x\na line of its own entirely", "a"), (3, "few words", "b"), (3, "few words", "b"), (4, None, None), (5, "", "b"), (6, long, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit(f"mine {c}"))
    items = spark.createDataFrame([(1, "a line of its own entirely")], "item_id long, text string")
    from arbora.llm import decontaminate
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    outs = {"lines": linededup.dedup_lines(docs), "join": ngramjoin.keep_one(docs), "leaks": decontaminate.decontaminate(docs, items), "mix": mixing.mix(docs), "quality": quality.keep_good(docs, labels)}
    for name, out in outs.items():
        assert out.columns[:len(docs.columns)] == docs.columns, name
        got = out.collect()
        assert got and all(r[c] == f"mine {c}" for r in got for c in CLASHES), name
    assert sorted(r["doc_id"] for r in outs["leaks"].collect()) == [1, 3, 3, 4, 5, 6]
    texts = sorted((r["doc_id"], r["text"]) for r in outs["lines"].collect() if r["doc_id"] in (2, 6))
    assert texts == [(2, "a line of its own entirely"), (6, "")]
    again = linededup.dedup_lines(outs["lines"])
    assert again.columns == outs["lines"].columns and mixing.mix(outs["mix"]).columns == outs["mix"].columns


def sample(parts, rng):
    """A text that a parsed expression matches."""
    out = ""
    for op, x in parts:
        match str(op):
            case "LITERAL":
                out += chr(x)
            case "NOT_LITERAL":
                out += "q" if chr(x) != "q" else "z"
            case "IN":
                kind, value = rng.choice(x)
                out += chr(value) if str(kind) == "LITERAL" else chr(rng.randint(*value))
            case "MAX_REPEAT":
                out += "".join(sample(x[2], rng) for _ in range(rng.randint(x[0], min(int(x[1]), x[0] + 2))))
            case "SUBPATTERN":
                out += sample(x[-1], rng)
            case "BRANCH":
                out += sample(rng.choice(x[1]), rng)
            case "ASSERT":
                pass
            case _:
                raise AssertionError(op)
    return out


def test_every_rule_holds_its_keyword_and_matches_alone(spark):
    rng, texts = random.Random(5), []
    assert len({e[2] for e in licenses.NAMES + licenses.SENTENCES + licenses.NOTICES}) > 250 and len(licenses.rules()) > 500
    for _, keyword, expr, _, _ in licenses.rules():
        for i in range(25):
            text = sample(re._parser.parse(expr), rng) + " "
            assert f" {keyword}" in text and re.search(expr, text), (keyword, expr, text)
        texts.append(text)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(8)
    for r in licenses.digest(licenses.scan_licenses(docs)).collect():
        model = licenses.brute_force(texts[r["doc_id"]])
        labels = {*model["labels"], *r["base_labels"].split(",")} - {""}
        assert r["labels"] == ",".join(sorted(labels)) and model["labels"] and r["n_detections"] == model["n"], texts[r["doc_id"]]


def test_licenses_on_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in licenses.digest(licenses.scan_licenses(docs)).collect():
        model = licenses.brute_force(texts[r["doc_id"]])
        assert r["labels"] == ",".join(sorted({*model["labels"], *r["base_labels"].split(",")} - {""})) and r["n_detections"] == model["n"]
