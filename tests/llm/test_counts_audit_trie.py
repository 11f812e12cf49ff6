"""Token counts, filter audit and prefix trie against the library and plain models."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arbora.llm import filteraudit, oracles, prefixtrie, queries, tokencount

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    with open(tokencount.default_model(), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def counts(model):
    return tokencount.PieceCounts(model, tokencount.whole_tokens(model), tokencount.piece_pattern(tokencount.vocabulary(model)))


TEXTS = [None, "", " ", "a", "\n", "  two  spaces ", "<s></s><unk><0x0A> ▁ ▁▁x", "x" * 30_000, " " * 5_000, "Straße, naïve — 漢字かな交じり文 😀👍🏽 ‍́", "tab\tnew\r\nline\x00\x01", "1234567.89 0x1F (a+b)*c; //}{", "ab c" * 400_000, "Ω≈ç√ İ K ﬁ"]


def test_tokens_equal_the_library(spark, counts):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "no id"), (3, "again")], "doc_id long, text string").withColumn("tokens", F.lit("taken over")).withColumn("n_tokens", F.lit(0))
    rows = tokencount.token_counts(docs, limit=100).collect()
    assert len(rows) == len(TEXTS) + 2 and rows[0].asDict().keys() == {"doc_id", "text", "tokens", "n_tokens"}
    for r in rows:
        n = len(counts.sp.encode(r["text"] or ""))
        assert (r["tokens"]["n_bytes"], r["tokens"]["n_tokens"], r["tokens"]["over_limit"]) == (len((r["text"] or "").encode()), n, n > 100)
    assert tokencount.token_counts(docs.limit(0)).count() == 0


def test_tokens_of_all_documents(spark, counts):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want = dict(zip(texts, map(len, counts.sp.encode(list(texts.values())))))
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op11_token_counts(spark, DATA).collect()} == {d: (len(texts[d].encode()), n, n > 4096) for d, n in want.items()}


def test_cuts_and_whole_tokens_are_proved(model, counts):
    strings = tokencount.vocabulary(model)
    pattern = re.compile(tokencount.piece_pattern(strings))
    assert all(pattern.match(s).end() == len(s) for s in strings)  # no vocabulary string spans two pieces
    whole = set(tokencount.whole_tokens(model))
    rng = random.Random(1)
    for s in rng.sample(strings, 2000):
        ids = counts.sp.encode(tokencount.GUARD + s)[counts.ahead:]
        assert (len(ids) == 1) == (s in whole)
    with pytest.raises(ValueError):
        tokencount.piece_pattern(["a▁b"])


def test_memory_of_pieces_is_bounded(monkeypatch, model, counts):
    monkeypatch.setattr(tokencount, "REMEMBERED", len(counts.whole) + 20)
    monkeypatch.setattr(tokencount, "STEP", 64)
    small = tokencount.PieceCounts(model, counts.whole, counts.pieces.pattern)
    texts = [f"word{i} other{i * 7} zzz" * 3 for i in range(50)] + ["qq\nww " * 200]
    assert small.counts(texts) == [len(x) for x in counts.sp.encode(texts)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  ▁ab\n<>s/.,0129éЖ漢")), max_size=40), max_size=5))
def test_tokens_of_any_text(texts):
    global _COUNTS
    if "_COUNTS" not in globals():
        with open(tokencount.default_model(), "rb") as f:
            data = f.read()
        _COUNTS = tokencount.PieceCounts(data, tokencount.whole_tokens(data), tokencount.piece_pattern(tokencount.vocabulary(data)))
    assert _COUNTS.counts(texts) == [len(x) for x in _COUNTS.sp.encode(texts)]


# Filter audit.
def plain_audit(docs, labels):
    """Rows of (part, order, step) by applying each order to every document."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    out = {}
    failing = []
    for d, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {x for x, bad in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), re.search("[#$%&*|]", text), d is not None and d > first[text])) if bad}
        failing.append((part or "", fails, d in good, d in toxic))
    for part in {p for p, *_ in failing}:
        mine = [x for x in failing if x[0] == part]
        removed = defaultdict(int)
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[:step - 1])
                gone = [x for x in mine if f in x[1] and not x[1] & before]
                out[part, order, step] = [sum(not x[1] & (before | {f}) for x in mine), len(gone), sum(f in x[1] and bool(x[1] & before) for x in mine), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                removed[f] += len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed[order[step - 1]])
    return out


AUDIT = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def odd_documents():
    rng = random.Random(4)
    words = lambda n, m: " ".join(f"w{rng.randrange(m)}" for _ in range(n))
    texts = [None, "", " \t\n", words(199, 999), words(200, 999), words(250, 60), "A" * 3 + "é" * 97, "AB" + "é" * 64, "ABCD " + words(300, 900), "a#b", words(220, 800) + " 50%", "x\x1cy z ", words(5000, 4000)]
    rows = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    rows += [(100 + i, rng.choice(texts), rng.choice(["en", "de"])) for i in range(40)] + [(2, " \t\n", "en"), (2, " \t\n", "en"), (None, "a#b", "de"), (None, None, None), (7, "same id, other text", "fr")]
    return rows, [(0, 1, 0), (0, 0, 1), (2, 1, 1), (5, None, 1), (None, 1, 1), (104, 1, 0), (104, 1, 0), (999, 1, 1), (110, 0, 0)]


def test_audit_equals_a_plain_model(spark):
    rows, labels = odd_documents()
    docs = spark.createDataFrame([(p, t, d, 1) for d, t, p in rows], "lang string, text string, doc_id long, hot int").withColumnRenamed("hot", "bits")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in AUDIT] for r in filteraudit.audit(docs, known).collect()}
    assert got == plain_audit(rows, labels)
    none = filteraudit.audit(docs, known.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(none) == (0, 0) and filteraudit.audit(docs.limit(0), known).count() == 0


def test_packed_sets_of_many_parts():
    import numpy as np

    rng = np.random.default_rng(1)
    codes, bits, good = rng.integers(0, 37, 500), rng.integers(0, 32, 500), rng.integers(0, 2, 500).astype(bool)
    found = filteraudit.survivors(codes, 37, bits, [good, ~good])
    for p in range(37):
        for s in range(32):
            alive = (codes == p) & (bits & s == 0)
            assert tuple(found[p, s]) == (alive.sum(), (alive & good).sum(), (alive & ~good).sum())


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_prefix_trie"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    want = con.sql(oracles.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    text = lambda rows: sorted(tuple(str(v) for v in r) for r in rows)
    assert text(tuple(r[c] for c in order) for r in got.collect()) == text(con.sql(f"select {', '.join(order)} from ({oracles.ORACLES[name]})").fetchall())


# Prefix trie.
def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [t[1:] for t in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
    members = defaultdict(set)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    out = {}
    for node, inside in members.items():
        below = [n for n in members if n[:len(node)] == node]
        ends = sorted(c for c in inside if rebuilt[c] == node)
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in below)]
        out[min(inside), len(node)] = (min(members[node[:-1]]) if node else None, len(inside), len(children), len(leaves), sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    assert len(out) == len(members)
    return out


def odd_conversations():
    rng = random.Random(6)
    rows = [(c, t, "user" if t % 2 else "assistant", rng.choice(["hi", "", "long é 漢 " * 3, "b"])) for c in range(40) for t in range(rng.randint(1, 12)) if c not in (10, 20)]
    rows += [(50 + i, t, "user", f"same {t}") for i in range(8) for t in range(9)]  # copies
    rows += [(70, None, None, None), (70, None, "x", "null turn"), (70, 3, "a", "tie"), (70, 3, "a", "tie"), (70, 3, "A", "tie"), (70, -5, "n", "early"), (None, 1, "user", "no conversation"), (71, 1, None, "q"), (71, 1, None, "q"), (10**12, 0, "u", "far")]
    rows += [(80, t, "user", f"turn {t}") for t in range(60)] + [(81, t, "user", f"turn {t}") for t in range(45)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1 << 12, 4])
def test_trie_equals_a_plain_model(spark, monkeypatch, block):
    monkeypatch.setattr(prefixtrie, "BLOCK", block)
    rows = odd_conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit(7)).withColumn("block", F.lit("x"))
    got = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in prefixtrie.trie(frame).collect()}
    assert got == plain_trie(rows)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixtrie.trie(none).count() == 0
    assert prefixtrie.trie(spark.createDataFrame([(None, 1, "a", "b")], none.schema)).count() == 0


def test_packs_join_to_one_hash(monkeypatch):
    monkeypatch.setattr(prefixtrie, "PACK", 3)
    keys = [(1, 5, 5, c) for c in range(10)] + [(1, 5, 6, 3)] + [(2, 0, 0, c) for c in range(95, 102)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*keys[i:i + 4])], ["depth", "a", "b", "conv"]) for i in range(0, len(keys), 4)]
    packs = sorted(tuple(r.values()) for b in prefixtrie._pack(iter(batches)) for r in b.to_pylist())
    assert max(p[4].count(",") for p in packs) == 2
    columns = [pa.array(c) for c in zip(*packs)]
    got = {(r["depth"], r["a"], r["b"]): r["ends_sha256"] for b in prefixtrie._hash(iter([pa.RecordBatch.from_arrays(columns, ["depth", "a", "b", "first", "ids"])])) for r in b.to_pylist()}
    want = {k: hashlib.sha256(",".join(str(x[3]) for x in keys if x[:3] == k).encode()).hexdigest() for k in {x[:3] for x in keys}}
    assert got == want
