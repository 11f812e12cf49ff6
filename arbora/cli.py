"""Command line: analyse a checkout, build its search view, or compare two view documents."""

from __future__ import annotations

import argparse
import json
import sys
import webbrowser
from pathlib import Path


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="arbora", description=__doc__)
    p.add_argument("path", nargs="?", help="folder of the checkout")
    p.add_argument("-l", "--language", choices=("python", "typescript", "kotlin"), default="python")
    p.add_argument("-f", "--framework", choices=("fastapi", "android"))
    p.add_argument("-o", "--output", default="artifacts")
    p.add_argument("-e", "--entrypoint", help="file of a FastAPI application; discovery covers all files either way")
    p.add_argument("--app", help="import string of a FastAPI application; it is never run, the static analysis covers it")
    p.add_argument("--title", help="title of the page")
    p.add_argument("--no-models", action="store_true", help="leave out schemas and entities")
    p.add_argument("--no-deps", action="store_true", help="leave out dependencies, modules and bindings")
    p.add_argument("--no-language-graph", action="store_true", help="components of the framework only")
    p.add_argument("--open", action="store_true", help="open the page in a browser")
    p.add_argument("--json", action="store_true", help="write the graph as one JSON document")
    p.add_argument("--mermaid", action="store_true")
    p.add_argument("--agent-view", action="store_true", help="write the search view")
    p.add_argument("--profile", help="profile of derived queries, YAML")
    p.add_argument("--agent-view-diff", nargs=2, metavar=("BEFORE", "AFTER"))
    a = p.parse_args(argv)
    if a.profile and not a.agent_view:
        p.error("--profile needs --agent-view")
    if a.framework != "fastapi" and (a.entrypoint or a.app):
        p.error("--entrypoint and --app need --framework fastapi")
    if not a.agent_view_diff and not a.path:
        p.error("a path is needed")
    return a


def main(argv: list[str] | None = None) -> int:
    a = parse(argv)
    from pyspark.sql import SparkSession

    from .operators import diff
    from .sources import sinks

    spark = SparkSession.builder.appName("arbora").getOrCreate()
    if a.agent_view_diff:
        before, after = (sinks.read_view(spark, url) for url in a.agent_view_diff)
        print(json.dumps({name: sinks.rows(df) for name, df in diff.diff_views(before, after).items()}, indent=2, sort_keys=True, ensure_ascii=False))
        return 0
    from .operators.analysis import MODELS, WIRING, analyse

    if not Path(a.path).is_dir():
        print(f"no such folder: {a.path}", file=sys.stderr)
        return 1
    if a.app:
        print(f"{a.app} is not run; its sources are analysed")
    done = analyse(spark, a.path, a.framework or a.language, not a.no_language_graph, leave_out=a.output)  # what an earlier run wrote is no source
    left_out = (MODELS if a.no_models else ()) + (WIRING if a.no_deps else ())
    done = done.without(*left_out) if left_out else done
    metrics = done.metrics()
    found = done.analysis(metrics)
    name, out = Path(a.path).resolve().name, Path(a.output)
    out.mkdir(parents=True, exist_ok=True)
    page = sinks.write_html(done.nodes, done.edges, a.title or name, a.output)
    if a.json:
        (out / "architecture.json").write_text(json.dumps(sinks.architecture_document(done.with_metrics(metrics), done.edges, name, {**done.stats(), "analysis": found}), indent=2, sort_keys=True, ensure_ascii=False), encoding="utf-8")
    if a.mermaid:
        (out / "architecture.mmd").write_text(sinks.mermaid(done.nodes, done.edges), encoding="utf-8")
    if a.agent_view:
        from .operators.agentview import build_agent_view
        from .sources.profile import Profile, load_profile

        view = build_agent_view(done.nodes, done.edges, done.files, load_profile(a.profile) if a.profile else Profile())
        (out / "agent_view.json").write_text(sinks.view_json(view, project_name=name), encoding="utf-8")
    print(sinks.summary({"nodes": done.nodes, "edges": done.edges}, found["top_weighted_cost"]))
    if a.open:
        webbrowser.open(Path(page).resolve().as_uri())
    return 0


if __name__ == "__main__":
    sys.exit(main())
