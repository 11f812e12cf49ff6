"""Results that hold the whole job, against plain models without the operators' shortcuts."""

import random

import pytest

from arbora.llm import decontaminate, htmltext, licenses, ngramjoin

SCHEMA = "doc_id long, text string"


def plain_degrees(rows, k, t):
    """n_links of every row, by all pairs of distinct sets."""
    def grams(text):
        w = (text or "").split()
        n = min(k, len(w))
        return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if n else frozenset()
    sets = {d: grams(text) for d, text in rows}
    nodes = set(sets.values()) - {frozenset()}
    reach = {a: sum(len(a & b) >= t * len(a | b) - 1e-9 for b in nodes if b != a) for a in nodes}
    return {d: reach.get(s, 0) for d, s in sets.items()}


@pytest.mark.parametrize("block", [4096, 7])
def test_degrees_count_all_links(spark, monkeypatch, block):
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    rng = random.Random(2)
    rows = []
    for base, copies, changes in ((0, 90, 1), (1000, 25, 3), (2000, 3, 1)):
        text = [f"b{base}w{i}" for i in range(90)]
        for j in range(copies):
            w = list(text)
            for _ in range(changes):
                w[rng.randrange(len(w))] = f"x{base}-{j}-{rng.random()}"
            rows.append((base + j, " ".join(w)))
    rows += [(3000, rows[0][1]), (3001, None), (3002, "alone in the world here")]
    got = {r["doc_id"]: r["n_links"] for r in ngramjoin.join_components(spark.createDataFrame(rows, SCHEMA), 4, 0.85).collect()}
    want = plain_degrees(rows, 4, 0.85)
    assert got == want and max(want.values()) > 64


FUSED = ["This program is distributed under the GPLv3", "Released under the LGPLv3.", "Code published under the AGPLv3 or later", "Made available under GPLv2", "Licensed under the MPLv2", "released under the OpenSSL",
         "Distributed under the PostgreSQL", "available under zlib", "provided under the FreeBSD terms", "Governed by 0BSD", "subject to the terms of FreeBSD",
         "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee", "mitigate the gplx and the bsds"]


def test_licenses_need_no_other_words(spark):
    got = {r["doc_id"]: r for r in licenses.digest(licenses.scan_licenses(spark.createDataFrame(list(enumerate(FUSED)), SCHEMA))).collect()}
    for i, text in enumerate(FUSED):
        model = licenses.brute_force(text)
        assert got[i]["labels"] == ",".join(model["labels"]) and got[i]["n_detections"] == model["n"], text
        assert bool(got[i]["labels"]) == (i < len(FUSED) - 1), text


def test_head_without_end_tag():
    body = "<article><p>" + "word " * 40 + "</p></article>"
    want = " ".join(["word"] * 40)
    for head in ("<head><title>T</title><body>", "<head><title>T</title>", "<head><meta charset=utf-8><script>x</script><link rel=x><body class=a>", "<head><title>T</title></head><body>", "<title>T</title><body>"):
        assert htmltext.main_text("<html>" + head + body) == want, head
    assert htmltext.main_text("<head><title>T</title>" + "word " * 40) == want
    assert htmltext.main_text("<head><template><p>" + "word " * 40 + "</template></head>") == ""


def test_items_of_one_id_stay_apart(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(20)) for x in "abcd")
    items = spark.createDataFrame([(1, a), (1, b), (1, a), (None, c), (None, d)], "item_id long, text string")
    docs = spark.createDataFrame([(10, "x " + a + " y"), (11, b), (12, c), (13, "z z z z z z")], SCHEMA)
    found = decontaminate.find_contained(docs, items)
    assert sorted((r["doc_id"], r["item_id"] or 0, r["n_item"], r["n_common"]) for r in found.collect()) == [(10, 1, 16, 16), (11, 1, 16, 16), (12, 0, 16, 16)]
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()] == [13]


def test_one_of_equal_rows_stays(spark):
    rows = [(1, "a b c d e f g")] * 3 + [(2, "a b c d e f g"), (3, "other words of its own"), (None, "no id here at all"), (None, "no id here at all"), (4, None), (5, None)]
    kept = ngramjoin.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, rows[5][1]), (1, rows[0][1]), (3, rows[4][1]), (4, ""), (5, "")]
