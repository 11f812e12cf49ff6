"""Scalar functions: costs, paths, terms, configuration keys, regions."""

import pytest
from pyspark.sql import functions as F

from arbora.functions import arrays, config, costs, paths, regions, terms
from arbora.sources.files import scan_files
from arbora.sources.profile import Profile, ProfileError, parse_profile


def one(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_tokens_and_lines(spark):
    texts = [("",), ("abcd",), ("abcde",), ("x" * 401,), ("가나다라마",), ("a\nb\n",)]
    got = one(spark, texts, "t string", costs.cost_for_text(F.col("t")))
    assert [(r["token_estimate"], r["line_count"]) for r in got] == [(1, 0), (1, 1), (2, 1), (101, 1), (2, 1), (1, 3)]


def test_span_text_takes_whole_lines(spark):
    text = "one\ntwo\r\nthree\x0bfour\n"
    assert one(spark, [(text, 2, 3)], "t string, a int, b int", costs.text_for_span(F.col("t"), F.col("a"), F.col("b"))) == ["two\nthree"]
    assert one(spark, [(text, 4, 9)], "t string, a int, b int", costs.text_for_span(F.col("t"), F.col("a"), F.col("b"))) == ["four"]
    assert one(spark, [(text, 3, 2)], "t string, a int, b int", costs.text_for_span(F.col("t"), F.col("a"), F.col("b"))) == [""]


@pytest.mark.parametrize("path,flags", [
    ("alembic/versions/1.py", ["generated"]), ("migrations/versions/a.py", ["generated"]), ("api/versions/a.py", []), ("x/user_pb2.py", ["generated"]), ("app/schemas/12.json", ["generated"]), ("app/schemas/a.json", []),
    ("app/contest.py", []), ("vendor/a.py", ["vendored"]), ("tests/test_a.py", ["test"]), ("src/a.spec.ts", ["test"]), ("node_modules/x/generated/a_test.py", ["generated", "vendored", "test"]), ("", [])])
def test_path_flags(spark, path, flags):
    assert one(spark, [(path,)], "p string", paths.path_flags(F.col("p"))) == [flags]


def test_context_and_suffix(spark):
    names = ["README.md", "a/b.gradle.kts", ".env", "conf.yaml", "a.py", "Makefile", "x.tar.gz", "docs/.md"]
    assert one(spark, [(n,) for n in names], "p string", paths.context_kind(F.col("p"))) == ["doc", "config", "config", "config", "code", "code", "code", "code"]
    assert one(spark, [("a/b.c/d.tar.gz",)], "p string", paths.without_suffix(F.col("p"))) == ["a/b.c/d.tar"]


def test_relative_imports_and_urls(spark):
    rows = [("a.b", 0, "x"), ("a.b", 1, "x"), ("a.b", 2, "x"), ("a.b", 1, None), ("a.b", 3, "x")]
    assert one(spark, rows, "p string, l int, m string", paths.relative_import(F.col("p"), F.col("l"), F.col("m"))) == ["x", "a.b.x", "a.x", "a.b", "x"]
    assert one(spark, [("/api/v1/", "users", "/me")], "a string, b string, c string", paths.join_url(F.col("a"), F.col("b"), F.col("c"))) == ["/api/v1/users/me"]
    assert one(spark, [("a/b/__init__.py",), ("a/c.py",)], "p string", paths.module_name(F.col("p"))) == ["a.b", "a.c"]


def test_tokens_of_identifiers(spark):
    names = ["getHTTPServer2Name", "snake_case_word", "XMLParser", "a1b"]
    got = one(spark, [(n,) for n in names], "t string", terms.split_tokens(F.col("t")))
    assert got == [["get", "HTTP", "Server", "2", "Name"], ["snake", "case", "word"], ["XML", "Parser"], ["a", "1", "b"]]


def test_other_number(spark):
    words = ["categories", "users", "class", "city", "day", "user", "y"]
    assert one(spark, [(w,) for w in words], "t string", terms.other_number(F.col("t"))) == ["category", "user", "classs", "cities", "days", "users", "ys"]


def test_derived_terms_have_one_owner(spark):
    p = Profile()
    got = one(spark, [("getUserService",)], "t string", terms.derive_terms(F.col("t"), p.transforms, p.min_term_length))[0]
    assert [(r["term"], r["rule"]) for r in got] == [
        ("get", "split-case"), ("User", "split-case"), ("Service", "split-case"), ("getUser", "token-adjacent-pairs"), ("UserService", "token-adjacent-pairs"),
        ("getuserservice", "normalize-case"), ("getUserServices", "plural-singular"), ("userService", "strip-affix")]


def test_clue_terms(spark):
    assert one(spark, [("  ab c ",), ("ab",), ("a\nbc",), ("   ",)], "t string", terms.clue_term(F.col("t"), 3)) == ["ab c", None, None, None]


def test_located_and_running_sums(spark):
    got = one(spark, [("é ab  cd",), ("",), ("x" * 3,)], "t string", arrays.located(F.col("t"), "[a-z]+"))
    assert [[(m["start"], m["value"]) for m in r] for r in got] == [[(2, "ab"), (6, "cd")], [], [(0, "xxx")]]
    values = list(range(1000))
    assert one(spark, [(values,)], "v array<bigint>", arrays.fold_runs(F.col("v")))[0] == [sum(values[:i]) for i in range(1000)]


def test_config_keys(spark):
    files = [("a.json", '{"x": {"y": 1},\n "z": [{"w": 2}]}'), (".env", "A_KEY=1\n# B=2\n"), ("b.yaml", "name: v\n  inner.key: 2\n- item\n"), ("c.properties", "k.a = 1\nno: 2\n"),
             ("build.gradle.kts", 'buildConfigField("String", "API_URL", "x")\nversion = 1\n'), ("bad.json", "{")]
    got = {(r["path"], r["key"], r["line"]) for r in config.config_keys(spark.createDataFrame(files, "path string, content string")).collect()}
    assert got == {("a.json", "x", 1), ("a.json", "y", 1), ("a.json", "z", 2), ("a.json", "w", 2), (".env", "A_KEY", 1), ("b.yaml", "name", 1), ("b.yaml", "inner.key", 2), ("c.properties", "k.a", 1),
                   ("build.gradle.kts", "API_URL", 1), ("build.gradle.kts", "version", 2)}


def test_regions():
    text = 'a = "# no" # yes\n"""doc\nmore"""\n/* c */ b // d\n\'x\\\'#\' # e\n'
    found = [(text[s:e], k) for s, e, k in regions.regions(text, True)]
    assert found == [("# yes", "comment"), ('"""doc\nmore"""', "docstring"), ("/* c */", "comment"), ("// d", "comment"), ("# e", "comment")]
    assert regions.by_line(text, True)[:3] == [(1, 11, 16, "comment"), (2, 0, 7, "docstring"), (3, 0, 7, "docstring")]
    assert regions.regions("'open\n# c", True) == [(6, 9, "comment")]


def test_scan_order(spark):
    files = [("a", None), ("big", "x" * 20), ("bin", "a\0"), ("late", "x" * 8192 + "\0"), ("edge", "x" * 8191 + "\0"), ("README.md", "r"), ("ok", "fine")]
    frame = spark.createDataFrame(files, "path string, content string")
    kept, out = scan_files(frame, 10_000, False)
    assert {r[0] for r in kept.collect()} == {"big", "late", "ok"}
    assert {tuple(r) for r in out.collect()} == {("a", "unreadable"), ("bin", "binary"), ("edge", "binary")}
    assert ("big", "too_large") in {tuple(r) for r in scan_files(frame, 10)[1].collect()}


def test_profiles():
    good = b"id: p\nversion: 3\nlimits: {max_arrival_nodes: 5, min_term_length: 2, max_file_bytes: 10}\ntransforms: [{id: split-case}, {id: strip-affix, prefixes: [get]}]\n"
    p = parse_profile(good)
    assert (p.version, p.max_arrival_nodes, [t.id for t in p.transforms]) == (3, 5, ["split-case", "strip-affix"]) and len(p.sha256) == 64
    for old, new in ((b"version: 3\n", b""), (b"max_arrival_nodes: 5", b"max_arrival_nodes: 0"), (b"split-case", b"other"), (b", prefixes: [get]", b"")):
        with pytest.raises(ProfileError):
            parse_profile(good.replace(old, new))
