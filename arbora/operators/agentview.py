"""The search view of a repository: readable nodes, clues, exact and derived queries, framework links.

``files`` (path, content), ``nodes`` and ``edges`` as in :mod:`arbora.schema`. Everything is a frame until a
sink; lists inside a row are those of one term or one link.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.arrays import located
from ..functions.config import config_keys
from ..functions.costs import cost_for_text, estimate_tokens
from ..functions.paths import context_kind, is_generated, path_flags, suffix, without_suffix
from ..session import staged
from ..sources.profile import Profile
from . import index
from .traversal import unreachable


def readable_nodes(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes with a span in a scanned file, the first of each id, and a file node for every other file. Reading
    costs the whole file."""
    sized = files.select("path", cost_for_text(F.col("content")).alias("read_cost"), F.array_sort(path_flags(F.col("path"))).alias("flags"))
    placed = nodes.filter("span is not null").select("id", F.col("span.file_path").alias("file_path"), "label", "kind", F.col("span.start_line").alias("start_line"), F.col("span.end_line").alias("end_line"))
    placed = placed.join(sized.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    first = placed.groupBy("id").agg(F.min(F.struct("file_path", "start_line", "end_line", "label", "kind")).alias("n"))
    own = first.select("id", "n.file_path", F.col("id").alias("symbol_id"), "n.label", "n.kind", "n.start_line", "n.end_line")
    rest = sized.join(own.select(F.col("file_path").alias("path")).distinct(), "path", "left_anti")
    as_file = rest.select(F.concat(F.lit("file:"), F.col("path")).alias("id"), F.col("path").alias("file_path"), F.lit(None).cast("string").alias("symbol_id"),
                          F.col("path").alias("label"), F.lit("file").alias("kind"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    return own.unionByName(as_file).join(sized.withColumnRenamed("path", "file_path"), "file_path").select(
        "id", "file_path", "symbol_id", "label", "kind", "start_line", "end_line", "read_cost", "flags")


def extract_clues(nodes: DataFrame, readable: DataFrame, files: DataFrame, profile: Profile) -> DataFrame:
    """term, clue_kinds, origin_node_ids: what a search could start from."""
    known = readable.select("id").withColumn("origin", F.col("id"))
    named = nodes.join(known, "id", "left")
    own = named.select(F.explode(F.array(
        F.struct(F.lit("identifier").alias("kind"), F.col("label").alias("term")),
        F.struct(F.lit("qualified_name").alias("kind"), F.when((F.col("symbol_path") != "") & (F.col("symbol_path") != F.col("label")), F.col("symbol_path")).alias("term")))).alias("c"), "origin").select("c.kind", "c.term", "origin")

    kind = context_kind(F.col("path"))
    paths = files.select("path", F.lit(1).alias("line"), F.explode(F.array_distinct(F.array("path", without_suffix(F.col("path"))))).alias("term")).withColumn("kind", F.lit("path"))
    keys = config_keys(files.filter(kind == "config")).select("path", "line", F.col("key").alias("term"), F.lit("config_key").alias("kind"))
    by_line = index.lines(files.filter(kind == "code"))
    mentions = index.lines(files.filter((kind == "doc") & (suffix(F.col("path")) == ".md"))).select("path", "line", F.explode(F.regexp_extract_all("text", F.lit(T.MENTION), F.lit(1))).alias("term"), F.lit("doc_mention").alias("kind"))
    quoted = by_line.select("path", "line", "text", F.explode(T.literals(F.col("text"))).alias("term"))
    tags = F.filter(F.array(F.lit("literal"), F.when(F.trim("term").startswith("/"), F.lit("route")), F.when(F.col("text").rlike(T.RAISES), F.lit("error_message"))), lambda k: k.isNotNull())
    quoted = quoted.select("path", "line", "term", F.explode(tags).alias("kind"))
    placed = paths.select("path", "line", "term", "kind").unionByName(keys).unionByName(mentions).unionByName(quoted)
    placed = placed.join(index.enclosing(placed, readable), ["path", "line"]).select("kind", "term", F.col("enclosing_node_id").alias("origin"))
    every = own.unionByName(placed).withColumn("term", T.clue_term(F.col("term"), profile.min_term_length)).filter("term is not null")
    return every.groupBy("term").agg(F.array_sort(F.collect_set("kind")).alias("clue_kinds"), F.array_sort(F.collect_set("origin")).alias("origin_node_ids"))


def query_nodes(found: DataFrame, clues: DataFrame, kind: str, profile: Profile) -> DataFrame:
    """One query a term that occurs. ``clues`` also carry rule_id and source_terms."""
    grouped = found.groupBy("term").agg(F.array_sort(F.collect_list("o")).alias("occurrences"))
    return _finish(grouped.join(clues, "term"), F.lit(kind), T.short_hash(F.lit(kind), F.col("term"), F.lit(str(profile.version))), profile)


def _finish(df: DataFrame, kind: Column, identity: Column, profile: Profile) -> DataFrame:
    arrivals = F.array_sort(F.array_distinct(F.transform("occurrences", lambda o: o["enclosing_node_id"])))
    out = df.withColumn("arrival_node_ids", arrivals).withColumn("excluded", F.size("arrival_node_ids") > profile.max_arrival_nodes)
    return out.select(identity.alias("id"), "term", kind.alias("kind"), "clue_kinds", "origin_node_ids", "rule_id", "source_terms", "occurrences",
                      T.occurrence_digest(F.col("occurrences")).alias("occurrence_digest"), "arrival_node_ids", estimate_tokens(T.render_occurrences(F.col("occurrences"))).alias("output_tokens"),
                      "excluded", F.when(F.col("excluded"), F.lit("too_many_arrival_nodes")).alias("exclusion_reason"))


def query_counts(counted: DataFrame, clues: DataFrame, kind: str, profile: Profile) -> DataFrame:
    """As :func:`query_nodes`, but with numbers in place of the lists of occurrences and arrivals, which for a common word
    are as long as the corpus. ``counted``: as :func:`index.counts_by_node` gives it."""
    sums = counted.groupBy("term").agg(F.sum("n").alias("n_occurrences"), F.count(F.lit(1)).alias("n_arrivals"), F.sum("chars").alias("chars"))
    out = sums.join(clues, "term").withColumn("excluded", F.col("n_arrivals") > profile.max_arrival_nodes)
    tokens = F.greatest(F.lit(1), F.ceil((F.col("chars") + F.col("n_occurrences") - 1) / 4)).cast("long")  # a line break between lines
    return out.select(T.short_hash(F.lit(kind), F.col("term"), F.lit(str(profile.version))).alias("id"), "term", F.lit(kind).alias("kind"), "clue_kinds", "origin_node_ids", "rule_id", "source_terms",
                      "n_occurrences", "n_arrivals", tokens.alias("output_tokens"), "excluded")


def derived_terms(clues: DataFrame, profile: Profile) -> DataFrame:
    """derived, rule_id, term, origin_node_ids for each term that an identifier clue gives rise to."""
    named = clues.filter(F.array_contains("clue_kinds", "identifier"))
    return named.select("term", "origin_node_ids", F.explode(T.derive_terms(F.col("term"), profile.transforms, profile.min_term_length)).alias("d")).select(
        F.col("d.term").alias("derived"), F.col("d.rule").alias("rule_id"), "term", "origin_node_ids")


def _merged(clues: DataFrame, derived: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clues of exact queries, with sources merged in from derived terms equal to them, and of the other derived terms.
    ``live``: the terms that occur."""
    none = F.array().cast("array<string>")
    sources = derived.groupBy("derived").agg(F.min_by("rule_id", "term").alias("rule"), F.array_sort(F.collect_set("term")).alias("sources"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("origin_node_ids")))).alias("origins"))
    exact_terms = clues.join(live, "term", "left_semi")
    merged = exact_terms.join(sources, exact_terms["term"] == sources["derived"], "left").select(
        exact_terms["term"], "clue_kinds", F.array_sort(F.array_union("origin_node_ids", F.coalesce("origins", none))).alias("origin_node_ids"),
        F.lit(None).cast("string").alias("rule_id"), F.coalesce("sources", none).alias("source_terms"))
    fresh = sources.join(exact_terms.select(F.col("term").alias("derived")), "derived", "left_anti").select(
        F.col("derived").alias("term"), none.alias("clue_kinds"), F.col("origins").alias("origin_node_ids"), F.col("rule").alias("rule_id"), F.col("sources").alias("source_terms"))
    return merged, fresh


def _wanted(clues: DataFrame, derived: DataFrame) -> DataFrame:
    return clues.select("term").unionByName(derived.select(F.col("derived").alias("term"))).distinct()


def exact_and_derived(clues: DataFrame, files: DataFrame, readable: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """Exact queries, with sources merged in from derived terms equal to them, and queries of the other derived terms."""
    posted = staged(index.postings(files), "postings")
    derived = staged(derived_terms(clues, profile), "derived")
    found = staged(index.occurrences(_wanted(clues, derived), files, readable, posted), "occurrences")
    merged, fresh = _merged(clues, derived, found.select("term").distinct())
    return query_nodes(found, merged, "exact", profile), query_nodes(found, fresh, "derived", profile)


def exact_and_derived_counts(clues: DataFrame, files: DataFrame, readable: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """The queries of :func:`exact_and_derived` with numbers in place of lists."""
    derived = staged(derived_terms(clues, profile), "derived")
    counted = staged(index.counts_by_node(_wanted(clues, derived), files, readable), "counts")
    merged, fresh = _merged(clues, derived, counted.select("term").distinct())
    return query_counts(counted, merged, "exact", profile), query_counts(counted, fresh, "derived", profile)


def framework_links(edges: DataFrame, readable: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, queries of narrowing links, unknown edges) of the framework-inferred edges. A unique rule gives a
    link for each target, a narrowing rule one link and one query for all of them; an edge without a declared
    rule is only reported."""
    own = edges.filter("confidence = 'framework_inferred'").withColumn("rule_id", F.get_json_object("metadata", "$.framework_rule.id")).withColumn(
        "specificity", F.get_json_object("metadata", "$.framework_rule.specificity"))
    declared = F.col("rule_id").isNotNull() & F.coalesce(F.col("specificity").isin("unique", "narrowing"), F.lit(False))
    unknown = own.filter(~declared).select(F.concat("from_id", F.lit("->"), "to_id").alias("edge")).distinct()
    ids = readable.select("id")
    known = own.filter(declared).join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    key = ["from_id", "rule_id", "specificity", "split"]
    known = known.withColumn("split", F.when(F.col("specificity") == "unique", F.col("to_id")).otherwise(F.lit("")))
    allowed = known.select(*key, F.explode("candidates").alias("id")).join(ids, "id", "left_semi").groupBy(key).agg(F.collect_set("id").alias("allowed"))
    line = F.coalesce("evidence.start_line", F.lit(1))
    groups = known.groupBy(key).agg(F.array_sort(F.collect_set("to_id")).alias("to_node_ids"), F.min_by("resolution", "ordinal").alias("resolution"),
                                    F.min_by(F.struct(F.coalesce("evidence.file_path", F.lit("<framework-inference>")).alias("file"), line.alias("line")), "ordinal").alias("evidence")).join(allowed, key, "left")
    narrow = F.col("specificity") == "narrowing"
    query_id = F.when(narrow, T.short_hash(F.lit("framework"), F.col("from_id"), F.col("rule_id"), F.lit(str(profile.version))))
    links = groups.select(
        F.when(narrow, F.concat_ws("|", "from_id", "rule_id")).otherwise(F.concat_ws("|", "from_id", "rule_id", "split")).alias("id"), F.col("from_id").alias("from_node_id"), "rule_id", "specificity", "resolution",
        "to_node_ids", F.array_sort(F.array_except(F.coalesce("allowed", F.array().cast("array<string>")), "to_node_ids")).alias("candidate_node_ids"), query_id.alias("query_id"),
        F.col("evidence.file").alias("evidence_file"), F.col("evidence.line").alias("evidence_line"))
    targets = groups.filter(narrow).select("from_id", "rule_id", query_id.alias("query"), F.explode("to_node_ids").alias("id")).join(readable.select("id", "file_path", "start_line"), "id")
    one = F.struct("file_path", F.coalesce("start_line", F.lit(1)).alias("line"), F.lit(0).alias("col"), F.col("rule_id").alias("matched_text"), F.lit("code").alias("context"), F.col("id").alias("enclosing_node_id"))
    rows = targets.groupBy("query", "from_id", "rule_id").agg(F.array_sort(F.collect_list(one)).alias("occurrences"))
    none = F.array().cast("array<string>")
    rows = rows.select("query", F.col("rule_id").alias("term"), none.alias("clue_kinds"), F.array("from_id").alias("origin_node_ids"), "rule_id", none.alias("source_terms"), "occurrences")
    return links, _finish(rows, F.lit("framework"), F.col("query"), profile), unknown


@dataclass
class AgentView:
    """All frames of a view."""
    readable_nodes: DataFrame
    query_nodes: DataFrame
    framework_links: DataFrame
    unreachable_node_ids: DataFrame
    unknown_framework_edges: DataFrame
    excluded_files: DataFrame
    scan: DataFrame
    profile: Profile


def build_agent_view(nodes: DataFrame, edges: DataFrame, files: DataFrame, profile: Profile) -> AgentView:
    """The whole view. ``files`` may hold null contents: unreadable ones."""
    from ..sources.files import scan_files

    included, excluded = scan_files(files, profile.max_file_bytes, profile.include_agent_docs)
    included = staged(included, "files")
    readable = staged(readable_nodes(nodes, included), "readable")
    clues = staged(extract_clues(nodes, readable, included, profile), "clues")
    exact, derived = exact_and_derived(clues, included, readable, profile)
    links, framework, unknown = framework_links(edges, readable, profile)
    queries = staged(exact.unionByName(derived).unionByName(framework), "queries")
    links = staged(links, "links")
    arrivals = queries.filter("not excluded").select(F.explode("arrival_node_ids").alias("node_id")).unionByName(links.select(F.explode("to_node_ids").alias("node_id")))
    counts = included.agg(F.count(F.lit(1)).alias("scanned_file_count"), F.count_if(is_generated(F.col("path"))).alias("generated_file_count"))
    marked = readable.agg(F.count_if(F.array_contains("flags", "generated")).alias("generated_node_count"))
    scan = counts.withColumn("generated_node_count", marked.scalar())
    return AgentView(readable, queries, links, unreachable(readable, arrivals).select("id"), unknown, excluded, scan, profile)
