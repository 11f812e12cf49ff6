"""Repository enrichment: node annotation, edge marking, tests of production code, configuration and its users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.config import config_keys
from ..functions.costs import cost_for_span, cost_for_text, text_for_span
from ..functions.paths import CODE_SUFFIXES, file_name, is_config_file, is_test, relative_to, suffix
from ..functions.terms import literals
from . import index
from .intervals import innermost

#: Kinds of production nodes that a test may mean.
TESTED_KINDS = ("class", "function", "method", "file", "module")
_NONE = "array<string>"


def annotate_nodes(nodes: DataFrame, files: DataFrame, root: str, provenance: str, language: str) -> DataFrame:
    """Fill provenance, language and kind where empty; lift file_path and line_number of the metadata to span,
    cost and symbol_path."""
    def meta(name):
        return F.get_json_object("metadata", f"$.{name}")
    path = relative_to(meta("file_path"), root)
    start = meta("line_number").cast("int")
    lifted = nodes.withColumn("_path", F.when(start > 0, path)).withColumn("_start", start).withColumn("_end", F.coalesce(F.nullif(meta("end_line_number").cast("int"), F.lit(0)), start))
    lifted = lifted.join(files.select(F.col("path").alias("_path"), F.col("content").alias("_content")), "_path", "left")
    found = F.col("_path").isNotNull()
    span = F.struct(F.col("_path").alias("file_path"), F.col("_start").alias("start_line"), F.col("_end").alias("end_line"), F.lit(0).alias("start_col"), F.lit(0).alias("end_col"))
    name = F.coalesce(F.nullif(meta("function_name"), F.lit("")), F.nullif(meta("name"), F.lit("")), F.col("label"))
    symbol = F.when(F.coalesce(meta("module"), F.lit("")) != "", F.concat_ws(".", meta("module"), name)).otherwise(name)

    def keep(column, value):
        return F.coalesce(F.nullif(F.col(column), F.lit("")), value)
    return lifted.withColumns({
        "provenance": keep("provenance", F.lit(provenance)), "language": keep("language", F.lit(language)), "kind": keep("kind", F.col("category")),
        "span": F.when(found, span).otherwise(F.col("span")), "cost": F.when(F.col("_content").isNotNull(), cost_for_span(F.col("_content"), F.col("_start"), F.col("_end"))).otherwise(F.col("cost")),
        "symbol_path": F.when(found, keep("symbol_path", symbol)).otherwise(F.col("symbol_path"))}).drop("_path", "_start", "_end", "_content")


def mark_edges(edges: DataFrame, nodes: DataFrame, rules: dict[str, str] | None = None, namespace: str = "", confidence: str = "framework_inferred", resolution: str = "unique_name") -> DataFrame:
    """Set confidence; set resolution where there are no candidates; declare the framework rule of known
    relations; give every edge an evidence: its start's line, else its end's, else a mark."""
    known = nodes.groupBy("id").agg(F.first(F.when(F.col("span").isNotNull(), F.struct("span.file_path", "span.start_line")), True).alias("_at"))
    at = lambda c: known.select(F.col("id").alias(c), "_at", F.lit(True).alias("_k"))
    # A known start without a span doesn't pass the question on to the end; so only edges of unknown starts go on to theirs.
    first = edges.join(at("from_id"), "from_id", "left")
    out = first.filter("_k").select(*edges.columns, "_at").unionByName(first.filter("_k is null").select(*edges.columns).join(at("to_id").drop("_k"), "to_id", "left").select(*edges.columns, "_at"))
    place = lambda path, line: F.struct(path.alias("file_path"), line.alias("start_line"), line.alias("end_line"), F.lit(0).alias("start_col"), F.lit(0).alias("end_col"))
    evidence = F.coalesce("evidence", F.when(F.col("_at").isNotNull(), place(F.col("_at.file_path"), F.col("_at.start_line"))), place(F.lit("<framework-inference>"), F.lit(1)))
    metadata = F.coalesce("metadata", F.lit("{}"))
    if rules:
        known_rules = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
        rule = F.concat(F.lit(f'"framework_rule":{{"id":"{namespace}.'), F.lower("relation"), F.lit('","specificity":"'), F.get(F.array(known_rules[F.col("relation")]), 0), F.lit('"}'))
        added = F.when(F.trim(metadata) == "{}", F.concat(F.lit("{"), rule, F.lit("}"))).otherwise(F.concat(F.regexp_replace(metadata, r"\}\s*$", ""), F.lit(","), rule, F.lit("}")))
        metadata = F.when(F.col("relation").isin(*rules) & F.get_json_object(metadata, "$.framework_rule").isNull(), added).otherwise(metadata)
    return out.withColumns({"confidence": F.lit(confidence), "resolution": F.when(F.size(F.coalesce("candidates", F.array().cast(_NONE))) > 0, F.col("resolution")).otherwise(F.lit(resolution)),
                            "evidence": evidence, "metadata": metadata}).select(edges.columns)


def _place(nodes: DataFrame) -> DataFrame:
    path = F.coalesce("span.file_path", F.get_json_object("metadata", "$.file_path"), F.lit(""))
    return nodes.withColumn("_path", path).withColumn("_test", F.array_contains(F.coalesce("flags", F.array().cast(_NONE)), "test") | is_test(path))


def test_relations(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """TESTS edges: from edges of tests to production, from names in the test's text, and, for tests without
    such names, from the file's name. The first producer of a pair counts."""
    placed = _place(nodes)
    tests, production = placed.filter("_test"), placed.filter("not _test")
    none = F.array().cast(_NONE)
    promoted = edges.join(tests.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(production.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(
        "from_id", "to_id", "confidence", "resolution", F.col("evidence.file_path").alias("file"), F.col("evidence.start_line").alias("line"), F.coalesce("candidates", none).alias("candidates"), F.lit(1).alias("step"))

    code = tests.filter(suffix(F.col("_path")).isin(*CODE_SUFFIXES)).join(files.filter("content <> ''").select(F.col("path").alias("_path"), "content"), "_path")
    start = F.coalesce("span.start_line", F.lit(1))
    body = code.select("id", "_path", start.alias("start"), text_for_span(F.col("content"), start, F.coalesce("span.end_line", F.lit(1 << 30))).alias("text"))
    targets = production.filter(F.col("kind").isin(*TESTED_KINDS) & (F.length("label") > 2))
    by_label = targets.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id"))), lambda x: x["id"]).alias("ids"))
    # Labels are looked up as terms of the test's lines: an equi-join on words, phrases by their rarest word.
    texts = body.select(F.col("id").alias("path"), F.col("text").alias("content"))
    found = index.find(by_label.select(F.col("label").alias("term")), texts).groupBy("path", "term").agg(F.min("line").alias("at"))
    named = found.join(by_label, found["term"] == by_label["label"]).join(body.select(F.col("id").alias("path"), "_path", "start"), "path").select(
        F.col("path").alias("from_id"), F.get("ids", 0).alias("to_id"), F.lit("static_inferred").alias("confidence"), F.when(F.size("ids") == 1, "unique_name").otherwise("ambiguous").alias("resolution"),
        F.col("_path").alias("file"), (F.col("start") + F.col("at") - 1).alias("line"), F.slice("ids", 2, 1 << 30).alias("candidates"), F.lit(2).alias("step"))

    silent = code.join(found.select(F.col("path").alias("id")).distinct(), "id", "left_anti")
    stem = F.regexp_replace(file_name(F.col("_path")), r"(?<=.)\.[^.]+$", "")
    silent = silent.select("id", "_path", F.lower(F.regexp_replace(stem, r"(?i)(^test_|_test$|Test$|\.(test|spec)$)", "")).alias("low"))
    homes = production.filter(F.col("kind").isin("class", "file", "module")).groupBy(F.lower("label").alias("low")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("target")).filter("n = 1")
    by_file = silent.join(homes, "low").select(F.col("id").alias("from_id"), F.col("target").alias("to_id"), F.lit("static_inferred").alias("confidence"), F.lit("unique_name").alias("resolution"),
                                              F.col("_path").alias("file"), F.lit(1).alias("line"), none.alias("candidates"), F.lit(3).alias("step"))
    every = promoted.unionByName(named).unionByName(by_file).filter("from_id <> to_id")
    known = edges.filter("relation = 'TESTS'").select("from_id", "to_id")
    first = every.groupBy("from_id", "to_id").agg(F.min(F.struct("step", "confidence", "resolution", "file", "line", "candidates")).alias("e"))
    return first.join(known, ["from_id", "to_id"], "left_anti").select("from_id", "to_id", F.lit("TESTS").alias("relation"), "e.confidence", "e.resolution", F.col("e.file").alias("file_path"), "e.line", "e.candidates")


def configuration(nodes: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(configuration nodes, CONFIGURES edges): a key configures the smallest node around each equal literal."""
    keys = config_keys(files.filter(is_config_file(F.col("path"))))
    ids = F.concat_ws(":", F.lit("config"), "path", F.col("line").cast("string"), F.col("index").cast("string"), "key")
    made = keys.select(ids.alias("id"), F.col("key").alias("label"), F.lit("configuration").alias("kind"), F.col("path").alias("file_path"), "line", cost_for_text(F.col("key")).alias("cost"), F.concat_ws(":", "path", "key").alias("symbol_path")).dropDuplicates(["id"])
    placed = _place(nodes).filter((F.col("kind") != "configuration") & suffix(F.col("_path")).isin(*CODE_SUFFIXES))
    with_code = files.join(placed.select(F.col("_path").alias("path")).distinct(), "path", "left_semi")
    used = index.lines(with_code).select(F.col("path").alias("_path"), "line", F.explode(literals(F.col("text"))).alias("label")).distinct()
    used = used.join(made.select("id", "label"), "label")
    spans = placed.filter("span is not null").select("_path", F.col("id").alias("node"), F.col("span.start_line").alias("s"), F.col("span.end_line").alias("e"), "ordinal")
    nearest = innermost(used, spans, ["_path"], "line", "s", "e", F.struct((F.col("e") - F.col("s")).alias("w"), "ordinal", "node"))
    edges = used.join(nearest, ["_path", "line"]).groupBy(F.col("id").alias("from_id"), F.col("best.node").alias("to_id")).agg(F.min(F.struct("_path", "line")).alias("at"))
    return made, edges.select("from_id", "to_id", F.lit("CONFIGURES").alias("relation"), F.lit("static_certain").alias("confidence"), F.lit("exact").alias("resolution"), F.col("at._path").alias("file_path"), "at.line")
