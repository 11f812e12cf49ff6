"""PII, licenses, media, WARC and HTML against plain models, with edge cases."""

import base64
import hashlib
import io
import re
import tarfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arbora.llm import bytescan, htmltext, licenses, media, pii, queries, warc

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


TEXTS = [None, "", "a@b.c_d@e.f x@@y.z a@b @c.d a.b+c@d-e.f.g.h.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 999999999999999999999.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 5500005555555559 7",
         "+1 (234) 555-1234 +12 3 +++1234567890 +1234567890123456", "é😀 mail: é.x@y.zz, 😀 10.0.0.1", "x" * 50_000 + "@" + "y" * 50_000, "1" * 60_000, "1.1." * 20_000, "+" + "1 " * 30_000, "a@b.c " * 3_000,
         "IBAN GB82 WEST 1234 5698 7654 32 and DE89370400440532013000 and DE89370400440532013001", 'token = "0123456789abcdef0123"']


def test_pii_equals_a_plain_scan(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "a@b.c"), (3, TEXTS[3])], SCHEMA)
    rows = pii.digest(pii.find_pii(docs)).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        want = base_spans("a@b.c" if r["doc_id"] is None else TEXTS[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), r["doc_id"]
        assert set(want) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in BASE] == [sum(w.startswith(k) for w in want) for k in BASE]
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[12]["n_iban"] == 2 and by_id[13]["n_secret"] == 1


def test_pii_on_all_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op2_pii(spark, DATA).collect():
        assert r["base_sha256"] == hashlib.sha256(",".join(base_spans(texts[r["doc_id"]])).encode()).hexdigest()


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "to a@b.cc or 10.0.0.1, card 4111111111111111"), (2, "none")], "doc_id long, text string")
    assert [r["text"] for r in pii.redact(docs).orderBy("doc_id").collect()] == ["to <email> or <ip>, card <card>", "none"]


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
LICENSE_TEXTS = [None, "", "...", "Under the MIT License, under the mit license. UNDER THE MIT  LICENSE", "Licensed under the Apache License, Version 2.0.", "CC BY-NC-SA 4.0", "cc by nc cc by nc x",
                 "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: BSD-3-Clause or MIT", "das Wort İ Kelvin under the mit license", "unlicensed mitten", "mit license " * 3000,
                 "Permission is hereby granted, free of charge, to any person obtaining a copy"]


def test_licenses_equal_a_plain_scan(spark):
    docs = spark.createDataFrame(list(enumerate(LICENSE_TEXTS)) + [(None, "x")], SCHEMA)
    assert len(licenses.rules()) > 300
    for r in licenses.digest(licenses.scan_licenses(docs)).collect():
        text = "x" if r["doc_id"] is None else LICENSE_TEXTS[r["doc_id"]]
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
        assert r["n_words"] == len(words) and r["n_base"] == len(places)
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        base = sorted({x for _, x in places})
        assert r["base_labels"] == ",".join(base)
        if (r["doc_id"] or 0) != 11:
            model = licenses.brute_force(text)
            assert r["labels"] == ",".join(sorted({*base, *model["labels"]})) and r["n_detections"] == model["n"]
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


@given(st.binary(max_size=3000))
@settings(max_examples=40, deadline=None)
def test_images_round_trip(data):
    payload = media.padded(data)
    image = media.encode(payload)
    assert media.decode(image) == payload and len(payload) % 576 == 0 and payload and media.header(image[:33])[:2] == (576, len(payload) // 576)


def test_media_columns(spark, tmp_path):
    texts = [None, "", "é" * 300, "same", "same", "x" * 576, "y" * 100_000]
    docs = spark.createDataFrame([(i if i != 2 else None, t) for i, t in enumerate(texts)], SCHEMA).withColumn("shard", F.lit("clash")).repartition(3)
    full = media.media_columns(docs, tmp_path.as_uri())
    rows = {r["doc_id"]: r for r in full.collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r, payload = rows[i if i != 2 else None], media.padded((t or "").encode())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["width"], r["height"]) == (576, len(payload) // 576) and r["digest"] == r["payload_sha256"]
    assert rows[3]["feature"] == rows[4]["feature"] and rows[3]["media_sha256"] == rows[4]["media_sha256"] and rows[0]["feature"] == rows[1]["feature"]
    for shard in {r["shard"] for r in rows.values()}:
        with tarfile.open(shard.removeprefix("file://")) as t:
            for m in t.getmembers():
                assert hashlib.sha256(media.decode(t.extractfile(m).read())).hexdigest() + ".png" == m.name
    assert media.media_columns(docs.limit(0), (tmp_path / "none").as_uri()).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/x?y", "same"), (2, None, "same"), (5, "http://a/\nb", "same"), (3, "u", "other\r\n\r\nWARC/1.1"), (None, "u", "same"), (None, "v", "only null"), (4, "u", None), (6, "u", ""), (9, "u", "twice"), (9, "u", "twice"), (7, "u", "é😀")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    nested = warc.captures(frame, tmp_path.as_uri())
    rows = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.digest(nested).collect())
    want = []
    for i, _, h in pages:
        data = (h or "").encode()
        same = [j for j, _, x in pages if (x or "") == (h or "") and j is not None]
        top = max(same) if same else None
        revisit = top is not None and i != top
        want.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    assert rows == sorted(want, key=lambda x: tuple(map(str, x))) or sorted(rows, key=str) == sorted(want, key=str)
    first = nested.first()
    assert first["request"]["fields"].startswith("GET /") and first["metadata"]["fields"].startswith("payload-bytes")
    assert warc.digest(warc.captures(frame, (tmp_path / "b").as_uri(), min_bytes=5)).filter("record_type = 'revisit'").count() == 0
    assert warc.captures(frame.limit(0), (tmp_path / "c").as_uri()).count() == 0


def test_warc_members_across_reads():
    data = b"".join(warc.record("response", f"n{i}", [], b"x" * i * 977) for i in range(200))
    got = list(warc.members(io.BytesIO(data)))
    assert len(got) == 200 and all(len(warc.parse(d)[1]) == i * 977 for i, (_, d) in enumerate(got)) and got[0][0] == 0 and data[got[7][0]:][:2] == b"\x1f\x8b"


PAGE = """<html><head><title>No</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><!-- <p>no --><nav><ul><li><a href=x>Menu</a><li><a href=y>Item</a></ul></nav>
<header><h2>Site name</h2></header><div class="cookie-notice">We use cookies to improve your visit, please accept them all.</div><div class="ad">Buy this now</div>
<article><header><h1>A title &amp; more</h1></header><p>First <b>bold</b>
 text &eacute;&#233; &lt;b&gt;<br>next<p>Short.<div class="ad">Buy that</div><ul><li>One point</li></ul><form><input value=x>Write <button>Go</button></form></article>
<section id="comments"><p>A reader says a lot of words here that are not of the article at all, really.</p></section><aside>Related words</aside><footer>&copy; Someone</footer></body></html>"""


def test_main_text():
    assert htmltext.main_text(PAGE) == "A title & more\n\nFirst bold text éé <b> next\n\nShort.\n\nOne point"
    for nothing in (None, "", "<", "<!-- x", "<script>a", "<p", "   ", "<nav>a</nav>"):
        assert htmltext.main_text(nothing) == ""
    assert htmltext.main_text("<div>" + "word " * 60 + "</div>").startswith("word word") and htmltext.main_text("a < b and " + "word " * 60).startswith("a < b")
    assert htmltext.main_text("<article>" * 3000 + "<p>" + "deep " * 30) != ""


def test_tree_fits_its_table():
    rows = [list(map(float, x.split())) for x in htmltext.LABELLED.split("\n") if x.strip()]
    assert sum(htmltext.classify(htmltext.tree(), r[:-1]) == r[-1] for r in rows) / len(rows) >= 0.9


def test_html_on_all_pages(spark):
    rows = {r["page_id"]: r for r in queries.op10_html(spark, DATA).collect()}
    for p in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", p["html"], re.S)[1]
        want = [" ".join(__import__("html").unescape(re.sub(r"<(?!p>|/p>|h1>|/h1>)[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        got = rows[p["page_id"]]
        assert re.sub(r"\s+", "", got["text"]) == re.sub(r"\s+", "", "".join(want)) and got["n_chars"] == len(got["text"])


@given(st.lists(st.text(alphabet="abAB \n\té😀", max_size=40), max_size=8), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_word_scan(texts, k):
    import numpy as np
    import pyarrow as pa
    seen = {}
    for first, borders, raw in bytescan.slices(pa.array([None, *texts], pa.string())):
        starts, ends, rows = bytescan.words(borders, raw)
        h = bytescan.word_hashes(raw, starts, ends)
        runs, at = bytescan.runs(h, rows, k)
        for i in range(len(borders) - 1):
            seen[first + i] = h[rows == i], runs[at == i]
    want = [[]] + [[w for w in re.split(r"[ \n\t]+", "".join(c.lower() if c in "AB" else c for c in t)) if w] for t in texts]
    ids = {}
    for i, w in enumerate(want):
        h, runs = seen[i]
        assert len(h) == len(w) and all(ids.setdefault(x, y) == y for x, y in zip(w, h))
        assert len(runs) == (max(1, len(w) - k + 1) if w else 0)
    assert len(set(ids.values())) == len(ids) and np.all(np.array(list(ids.values()) or [1]) >= 0)
