"""Analysis of a checkout: extraction, resolution, framework components and enrichment in one graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.costs import cost_multiplier, display_name, node_token_cost
from ..session import staged
from ..sources import files as source_files
from . import centrality, enrich
from . import edges as algebra
from .resolve import PythonGraph

#: The ranked lists of a report and their metrics, and the shares of a node's cost that count.
RANKINGS = {"top_pagerank": "pagerank", "top_hubs": "hub_score", "top_betweenness": "betweenness_centrality", "top_weighted_cost": "weighted_centrality_cost", "top_hop_2_cost": "hop_2_token_cost", "top_hop_3_cost": "hop_3_token_cost"}
COST_POLICY = {"vendored": 0.0, "generated": 0.1, "migration": 0.1, "default": 1.0}
#: Kinds that are models, and kinds that are wiring of dependencies.
MODELS, WIRING = ("schema", "entity"), ("dependency", "module", "binding", "component")


@dataclass
class Analysis:
    """Nodes and edges of a repository, and the files they come from."""
    files: DataFrame
    nodes: DataFrame
    edges: DataFrame

    def stats(self) -> dict:
        out: dict[str, dict] = {}
        for name, df, column in (("nodes_by_kind", self.nodes, "kind"), ("edges_by_relation", self.edges, "relation"), ("edges_by_confidence", self.edges, "confidence")):
            out[name] = {r["value"]: r["n"] for r in algebra.breakdown(df, column).collect()}
        return out

    def costs(self) -> DataFrame:
        """id, label, token_cost and effective_token_cost of every node."""
        return node_costs(self.nodes, self.files)

    def metrics(self, **options) -> DataFrame:
        """All metrics of every node, in one row; ordinal keeps the order of the sources."""
        costs = staged(self.costs(), "costs")
        nodes = staged(self.nodes.select("id", "ordinal").groupBy("id").agg(F.min("ordinal").alias("ordinal")).join(costs.select("id", "label"), "id"), "metric-nodes")
        adjacent = staged(algebra.adjacency(self.edges, nodes), "adjacency")
        return staged(centrality.node_metrics(nodes, adjacent, costs.drop("label"), **options), "metrics")

    def analysis(self, metrics: DataFrame | None = None) -> dict:
        """Ranked lists, totals and how they were found, of bounded size."""
        metrics = self.metrics() if metrics is None else metrics
        _, strategy, size = centrality.sample_sources(metrics)
        out = {name: [{"id": r["id"], "label": r["label"], "value": r["value"]} for r in sorted(algebra.top_ranked(metrics, metric).collect(), key=lambda r: r["rank"])] for name, metric in RANKINGS.items()}
        return {**out, **algebra.token_totals(metrics).first().asDict(), "cost_policy": COST_POLICY, "betweenness_strategy": strategy, "betweenness_sample_size": size, "neighborhood_strategy": "single_bfs_to_3_hops"}

    def with_metrics(self, metrics: DataFrame) -> DataFrame:
        """Nodes with their metrics under ``analysis`` in the metadata."""
        own = metrics.select("id", F.to_json(F.struct(*[c for c in metrics.columns if c not in ("id", "label", "ordinal")])).alias("json"))
        old = F.coalesce("metadata", F.lit("{}"))
        head = F.when(F.trim(old) == "{}", F.lit("{")).otherwise(F.concat(F.regexp_replace(old, r"\}\s*$", ""), F.lit(",")))
        return self.nodes.join(own, "id", "left").withColumn("metadata", F.when(F.col("json").isNull(), old).otherwise(F.concat(head, F.lit('"analysis":'), "json", F.lit("}")))).drop("json")

    def without(self, *kinds: str) -> Analysis:
        """The graph less the components of some kinds and their edges."""
        nodes = self.nodes.filter(~(F.col("kind").isin(*kinds) & F.coalesce(F.col("provenance").startswith("framework:"), F.lit(False))))
        return Analysis(self.files, nodes, algebra.valid_edges(self.edges, nodes))

    def symbols(self) -> DataFrame:
        """The symbol tab of a report."""
        return self.nodes.select("id", F.coalesce(F.nullif("symbol_path", F.lit("")), "label").alias("symbol_path"), "kind", F.coalesce("span.file_path", F.lit("")).alias("file_path"), F.col("span.start_line").alias("line_number"),
                                 F.col("cost.token_estimate").alias("token_cost"), "flags")


_NODES = ("id", "label", "kind", "category", "language", "span", "cost", "symbol_path", "flags", "provenance", "metadata", "ordinal")
_EDGES = ("from_id", "to_id", "relation", "confidence", "resolution", "evidence", "candidates", "weight", "metadata", "ordinal")


def _shape(df: DataFrame, columns, defaults: dict) -> DataFrame:
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else defaults.get(c, F.lit(None).cast("string"))).alias(c) for c in columns])


def _order(df: DataFrame, place: str, *names: str):
    """Rows in the order of the sources: by path and line of ``place``, then by the number of the fact, then by names."""
    path, line = (F.col(f"{place}.file_path"), F.col(f"{place}.start_line")) if place in df.columns else (F.lit(None).cast("string"), F.lit(None).cast("int"))
    seq = F.col("seq").cast("long") if "seq" in df.columns else F.lit(0).cast("long")
    return F.struct(F.coalesce(path, F.lit("")).alias("path"), F.coalesce(line, F.lit(0)).alias("line"), F.coalesce(seq, F.lit(0).cast("long")).alias("seq"), F.concat_ws(" ", *names).alias("name"))


def node_costs(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """id, label, token_cost, effective_token_cost of each node: its own estimate, else that of its source text (its
    lines, else the smallest statement at its line), else that of what is known of it."""
    from ..sources.languages.python import source_slices

    first = nodes.dropDuplicates(["id"])
    have = set(first.columns)
    label = display_name(F.col("display_label") if "display_label" in have else F.lit(""), F.col("label"), F.col("id"))
    bare = first.filter(~(F.coalesce("cost.token_estimate", F.lit(0)) > 0) & F.col("span.file_path").isNotNull())
    slices = source_slices(bare.select("id", F.col("span.file_path").alias("path"), F.col("span.start_line").alias("line"), F.col("span.end_line").alias("end_line")), files)
    cost = node_token_cost(F.col("cost"), F.col("source_text"), label, F.col("title") if "title" in have else F.lit(""), F.col("metadata"))
    out = first.join(slices, "id", "left").select("id", label.alias("label"), cost.alias("token_cost"), cost_multiplier(F.col("flags"), F.col("span.file_path")).alias("share"))
    return out.select("id", "label", "token_cost", (F.col("token_cost") * F.col("share")).alias("effective_token_cost"))


def _nodes(df: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    df = df.withColumn("ordinal", _order(df, "span", "id"))
    return _shape(df, _NODES, {"category": F.col("kind"), "flags": none, "metadata": F.lit("{}"), "symbol_path": F.lit(""), "cost": F.lit(None).cast("struct<token_estimate:bigint,char_count:bigint,line_count:bigint>")})


def _edges(df: DataFrame) -> DataFrame:
    span = "struct<file_path:string,start_line:int,end_line:int,start_col:int,end_col:int>"
    df = df.drop("seq").withColumn("ordinal", _order(df, "evidence", "from_id", "to_id", "relation"))
    return _shape(df, _EDGES, {"weight": F.lit(1.0), "metadata": F.lit("{}"), "evidence": F.lit(None).cast(span), "candidates": F.array().cast("array<string>"), "confidence": F.lit("static_certain"), "resolution": F.lit("exact")})


def _located(components: DataFrame, files: DataFrame, language: str, provenance: str) -> DataFrame:
    """Components with their place in the metadata, and annotated: language, kind, span, cost and symbol path."""
    have = set(components.columns)
    known = [("file_path", "span.file_path"), ("line_number", "span.start_line"), ("end_line_number", "span.end_line"), ("module", "module"), ("name", "name")]
    metadata = F.to_json(F.struct(*[F.col(c).cast("string").alias(k) for k, c in known if c.partition(".")[0] in have]))
    shaped = components.withColumn("metadata", metadata).withColumn("symbol_path", F.lit("")).withColumn("cost", F.lit(None).cast("struct<token_estimate:bigint,char_count:bigint,line_count:bigint>"))
    return enrich.annotate_nodes(shaped, files, "", provenance, language)


def analyse_files(files: DataFrame, what: str, language_graph: bool = True) -> Analysis:
    """The graph of ``files`` (path, content): python, typescript, kotlin, fastapi or android; of a framework also
    without the graph of its language."""
    from ..sources.languages import android, braces, fastapi

    files = files.filter("content is not null")
    if what in ("python", "fastapi"):
        own = PythonGraph(source_files.python_files(files))
    elif what == "typescript":
        own = braces.BraceGraph(source_files.typescript_files(files))
    else:
        own = braces.BraceGraph(source_files.kotlin_files(files))
    nodes, edges = _nodes(own.nodes()), _edges(own.edges())
    if what in ("fastapi", "android"):
        part = fastapi.FastApiGraph(source_files.python_files(files)) if what == "fastapi" else android.AndroidGraph(source_files.android_files(files))
        rules = (fastapi if what == "fastapi" else android).RULES
        components = staged(_nodes(_located(part.nodes(), files, "python" if what == "fastapi" else "kotlin", f"framework:{what}")), "components")
        marked = enrich.mark_edges(_edges(part.edges()), components, rules, what)
        if language_graph:
            known = part.implemented_by().join(own.nodes().select(F.col("id").alias("to_id")), "to_id", "left_semi")
            nodes = algebra.language_nodes_added(components, nodes)
            edges = edges.unionByName(marked).unionByName(_edges(known))
        else:
            nodes, edges = components, marked
    nodes, edges = staged(nodes, "nodes"), staged(edges, "edges")
    tests = enrich.test_relations(nodes, edges, files)
    keys, configures = enrich.configuration(nodes, files)
    place = F.struct("file_path", F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.lit(0).alias("start_col"), F.lit(0).alias("end_col"))
    more = [_edges(df.withColumn("evidence", place)) for df in (tests, configures)]
    keys = _nodes(keys.withColumn("span", place).withColumn("language", F.lit("configuration")).withColumn("provenance", F.lit("repository-enrichment")))
    return Analysis(files, staged(nodes.unionByName(keys.join(nodes.select("id"), "id", "left_anti").select(*_NODES)), "nodes"), staged(edges.unionByName(more[0]).unionByName(more[1]), "edges"))


def analyse(spark: SparkSession, root: str, what: str, language_graph: bool = True, leave_out: str | None = None) -> Analysis:
    """The graph of a local checkout, without the files in ``leave_out``."""
    return analyse_files(staged(source_files.read_repository(spark, root, leave_out=leave_out), "files"), what, language_graph)
