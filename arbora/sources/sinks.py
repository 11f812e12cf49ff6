"""Sinks: JSON of views and graphs, an HTML page, Mermaid diagrams, a summary.

JSON of unbounded tables is written by Spark, a row a line; the single documents collect, so they are for graphs
that a person looks at, and refuse more than ``limit`` rows of a table.
"""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ARCHITECTURE_VERSION, VIEW_VERSION
from . import page

#: How an edge of a confidence looks.
EDGE_STYLES = {"static_certain": (False, "#2f6f4f"), "static_inferred": ([6, 4], "#8a6d1d"), "framework_inferred": ([2, 4], "#3b5b92"), "dynamic_required": ([10, 6], "#a23b3b")}
LIMIT = 200_000


def rows(df: DataFrame, limit: int = LIMIT, order: str | None = "id") -> list[dict]:
    """All rows as dictionaries; raises if there are more than ``limit``."""
    out = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    if len(out) > limit:
        raise ValueError(f"more than {limit} rows; write the table instead")
    return sorted(out, key=lambda r: r[order]) if order and out and order in out[0] else out


def _dump(value) -> str:
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def view_document(view, project_name: str = "", ignore_source: str = "") -> dict:
    """The whole view as one document."""
    p = view.profile
    scan = rows(view.scan, order=None)[0]
    return {
        "schema_version": VIEW_VERSION, "project_name": project_name, "profile": {"id": p.id, "version": p.version, "sha256": p.sha256},
        "readable_nodes": rows(view.readable_nodes), "query_nodes": rows(view.query_nodes), "framework_links": rows(view.framework_links),
        "unreachable_node_ids": [r["id"] for r in rows(view.unreachable_node_ids)],
        "scan": {**scan, "ignore_source": ignore_source, "excluded_files": [{"file_path": r["path"], "reason": r["reason"]} for r in rows(view.excluded_files, order="path")],
                 "unknown_framework_edges": [r["edge"] for r in rows(view.unknown_framework_edges, order="edge")]}}


def view_json(view, **names) -> str:
    return _dump(view_document(view, **names))


def node_rows(nodes: DataFrame) -> DataFrame:
    """Nodes with a default for whatever a source left out."""
    have = set(nodes.columns)

    def get(name, default, kind="string"):
        return (F.coalesce(F.col(name), default) if name in have else default.cast(kind)).alias(name)
    empty, none = F.lit(""), F.array().cast("array<string>")
    kind = F.coalesce(F.nullif(F.col("kind"), empty), F.col("category")) if {"kind", "category"} <= have else F.col("kind" if "kind" in have else "category")
    return nodes.select("id", "label", get("group", empty), get("category", empty), get("title", empty), get("shape", F.lit("box")), get("size", F.lit(25), "int"), kind.alias("kind"), get("language", empty),
                        *[(F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in ("span", "cost", "signature", "docstring", "exported")],
                        get("symbol_path", empty), get("display_label", empty), get("flags", none, "array<string>"), get("provenance", empty), get("metadata", F.lit("{}")))


def edge_rows(edges: DataFrame) -> DataFrame:
    """Edges under the names from_id and to_id, with defaults."""
    have = set(edges.columns)
    start, end = ("from_id" if "from_id" in have else "from"), ("to_id" if "to_id" in have else "to")

    def get(name, default):
        return (F.coalesce(F.col(name), default) if name in have else default).alias(name)
    return edges.select(F.col(f"`{start}`").alias("from_id"), F.col(f"`{end}`").alias("to_id"), get("relation", F.lit("")), get("label", F.lit("")), get("arrows", F.lit("to")), get("confidence", F.lit("static_certain")),
                        get("resolution", F.lit("exact")), (F.col("evidence") if "evidence" in have else F.lit(None).cast("string")).alias("evidence"), get("candidates", F.array().cast("array<string>")), get("weight", F.lit(1.0)), get("metadata", F.lit("{}")))


def architecture_document(nodes: DataFrame, edges: DataFrame, project_name: str, stats: dict | None = None, collections: dict | None = None) -> dict:
    """A graph as one document; metadata strings become objects."""
    def opened(r):
        return {**r, "metadata": json.loads(r["metadata"] or "{}")}
    return {"schema_version": ARCHITECTURE_VERSION, "project_name": project_name, "stats": stats or {}, "nodes": [opened(r) for r in rows(node_rows(nodes))],
            "edges": [opened(r) for r in sorted(rows(edge_rows(edges), order=None), key=lambda r: (r["from_id"], r["to_id"], r["relation"]))],
            "collections": collections or {}}


def collection(df: DataFrame, label: str, columns: list[tuple[str, str, str]], icon: str = "box", view: str = "table", node_category: str | None = None) -> dict:
    """A report tab: columns as (key, label, kind) and its rows."""
    return {"label": label, "icon": icon, "view": view, "node_category": node_category, "columns": [{"key": k, "label": n, "kind": t} for k, n, t in columns], "rows": rows(df)}


def write_graph(nodes: DataFrame, edges: DataFrame, url: str) -> None:
    """Tables of any size as JSON lines below ``url``."""
    node_rows(nodes).write.mode("overwrite").json(f"{url}/nodes")
    edge_rows(edges).write.mode("overwrite").json(f"{url}/edges")


def styled_nodes(nodes: DataFrame) -> DataFrame:
    """id, label, title for a drawing: the display label where there is one."""
    n = node_rows(nodes)
    label = F.coalesce(F.nullif("display_label", F.lit("")), F.nullif("label", F.lit("")), "id")
    title = F.concat_ws("\n", label, F.nullif("kind", F.lit("")), F.nullif("symbol_path", F.lit("")), F.nullif(F.array_join("flags", ", "), F.lit("")))
    return n.select("id", label.alias("label"), "group", "shape", "size", title.alias("title"))


def styled_edges(edges: DataFrame) -> DataFrame:
    """Edges with dashes, colour and a tooltip by confidence."""
    e = edge_rows(edges)
    plain = json.dumps(EDGE_STYLES["static_certain"][0]), EDGE_STYLES["static_certain"][1]
    dashes, colour = F.lit(plain[0]), F.lit(plain[1])
    for name, (dash, tint) in EDGE_STYLES.items():
        dashes, colour = F.when(F.col("confidence") == name, json.dumps(dash)).otherwise(dashes), F.when(F.col("confidence") == name, tint).otherwise(colour)
    tip = F.concat_ws("\n", "relation", F.concat(F.lit("confidence: "), "confidence"), F.concat(F.lit("resolution: "), "resolution"),
                      F.when(F.size("candidates") > 0, F.concat(F.lit("candidates: "), F.array_join("candidates", ", "))))
    return e.select(F.col("from_id").alias("from"), F.col("to_id").alias("to"), F.coalesce(F.nullif("label", F.lit("")), "relation").alias("label"), "arrows", dashes.alias("dashes"), colour.alias("color"), tip.alias("title"), "confidence")


def html_page(nodes: DataFrame, edges: DataFrame, title: str) -> str:
    """A page that lists, filters, searches and draws the graph; data can't close the script that holds it."""
    data = json.dumps({"nodes": rows(styled_nodes(nodes)), "edges": rows(styled_edges(edges), order=None)}, ensure_ascii=False).replace("<", "\\u003c")
    name = html.escape(title)
    return "".join((page.OPENING, name, page.HEADING.replace("<label>Find", f"<h1>{name}</h1><label>Find", 1), data, page.MIDDLE, page.LOGIC, page.BINDING))


def write_html(nodes: DataFrame, edges: DataFrame, title: str, folder: str) -> str:
    path = Path(folder, "index.html")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(html_page(nodes, edges, title), encoding="utf-8")
    return str(path)


def _name(ident: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in ident)


def mermaid(nodes: DataFrame, edges: DataFrame, groups: tuple[str, ...] = (), provenance: str | None = None) -> str:
    """A flowchart: nodes of the kinds in ``groups`` become subgraphs, and edges need both ends of ``provenance``."""
    kept = node_rows(nodes)
    kept = kept if provenance is None else kept.filter(F.col("provenance").startswith(provenance))
    n, e = rows(kept), rows(edge_rows(edges), order=None)
    known = {r["id"]: r for r in n}
    lines = ["flowchart LR"]
    for kind in groups:
        inside = [r for r in n if r["kind"] == kind]
        lines += [f"  subgraph {kind}", *[f'    {_name(r["id"])}["{r["label"]}"]' for r in inside], "  end"] if inside else []
    lines += [f'  {_name(r["id"])}["{r["label"]}"]' for r in n if r["kind"] not in groups]
    lines += sorted(f"  {_name(r['from_id'])} -->|{r['relation']}| {_name(r['to_id'])}" for r in e if r["from_id"] in known and r["to_id"] in known)
    return "\n".join(lines) + "\n"


def summary(collections: dict[str, DataFrame], heaviest: list[dict] | None = None) -> str:
    """Row counts of report tabs and the node of the highest weighted cost."""
    out = [f"{name}: {df.count()}" for name, df in collections.items()]
    if heaviest:
        out.append(f"highest agent context cost: {heaviest[0]['label']} ({heaviest[0]['value']:.4f})")
    return "\n".join(out) + "\n"


def read_view(spark, url: str) -> dict[str, DataFrame]:
    """The three sections of a view document, as frames for a comparison."""
    doc = spark.read.option("multiLine", "true").json(url)
    return {name: doc.select(F.explode(name).alias("r")).select("r.*") for name in ("readable_nodes", "query_nodes", "framework_links")}
