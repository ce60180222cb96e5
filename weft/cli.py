"""python -m weft.cli scan PATH | graph PATH [--json|--mermaid|--html] | impact NODE [--depth N] [--json]"""

from __future__ import annotations

import argparse
import json
import os
import sys

from weft.engine import Engine
from weft.errors import AmbiguousNode, NodeNotFound, WeftError
from weft.operators import render, views
from weft.session import local_session
from weft.sources import store
from weft.sources.repository import load_config, repository_files


def _arguments(args: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="weft", description="Lineage and impact of a repository.")
    commands = parser.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan", help="read a repository and store its graph")
    scan.add_argument("path")
    scan.add_argument("--verbose", action="store_true")
    graph = commands.add_parser("graph", help="show the stored graph")
    graph.add_argument("path", nargs="?", default=".")
    form = graph.add_mutually_exclusive_group()
    for name in ("json", "mermaid", "html"):
        form.add_argument(f"--{name}", action="store_true")
    graph.add_argument("--open", action="store_true")
    graph.add_argument("--include-source", action="store_true")
    impact = commands.add_parser("impact", help="what depends on a node")
    impact.add_argument("node")
    impact.add_argument("--depth", type=int)
    impact.add_argument("--json", action="store_true")
    for p in (graph, impact):
        p.add_argument("--root")
    for p in (scan, graph, impact):
        p.add_argument("--config")
    return parser.parse_args(args)


def _fail(message: str) -> int:
    print(message, file=sys.stderr)
    return 1


def _not_one(error: AmbiguousNode | NodeNotFound, as_json: bool) -> int:
    """Tells why a text means no single node: a JSON document on the standard output, or a text on the error output."""
    ambiguous = isinstance(error, AmbiguousNode)
    others = error.candidates if ambiguous else error.suggestions
    if as_json:
        document = {"error": "ambiguous_node" if ambiguous else "node_not_found", "query": error.query, "candidates" if ambiguous else "suggestions": others}
        print(json.dumps(document, indent=2))
        return 1
    lines = [str(error)]
    if ambiguous:
        lines += ["", "Choose one:", "", *(f'  weft impact "{n["id"].split(":", 1)[-1]}"' for n in others), "", "Stable IDs:", "", *(f"  {n['id']}" for n in others)]
    elif others:
        lines += ["Did you mean:", *(f"  {render.shown_name(n)} ({n['id']})" for n in others)]
    return _fail("\n".join(lines))


def main(args: list[str] | None = None) -> int:
    try:
        given = _arguments(sys.argv[1:] if args is None else args)
    except SystemExit as e:
        return int(bool(e.code))
    root = getattr(given, "root", None) or getattr(given, "path", ".") or "."
    if given.command == "graph" and (given.open or given.include_source) and not given.html:
        return _fail("--open and --include-source need --html")
    if given.command == "impact" and given.depth is not None and given.depth < 1:
        return _fail("--depth must be at least 1")
    try:
        config = load_config(root, given.config)
    except WeftError as e:
        return _fail(str(e))
    stored = config.output if os.path.isabs(config.output) else os.path.join(root, config.output)
    if given.command == "scan" and not os.path.isdir(root):
        return _fail(f"no directory at {root}")
    if given.command != "scan" and not os.path.exists(stored):
        return _fail(f"no graph at {stored}; run a scan first")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark)
    try:
        if given.command == "scan":
            found = engine.scan(root, config=config)
            document = found.document()
            store.write_text(stored, store.render_json(document))
            for w in document["scan"]["warnings"] if given.verbose else []:
                print(w)
            kinds: dict[str, int] = {}
            for n in document["nodes"]:
                kinds[n["type"]] = kinds.get(n["type"], 0) + 1
            python_files = sum(bool(n["metadata"].get("python_file")) for n in document["nodes"]) or kinds.get("python_module", 0)
            print(f"{found.files_scanned} files, {python_files} in Python, {len(document['nodes'])} nodes, {len(document['edges'])} edges, {len(document['scan']['warnings'])} warnings")
            for kind in sorted(kinds):
                print(f"  {kind}: {kinds[kind]}")
            return 0
        graph = engine.load(stored)
        if given.command == "impact":
            resolved = graph.resolve(given.node)
            document = render.impact_document(graph.impact(resolved, given.depth), given.node, resolved)
            print(json.dumps(document, indent=2) if given.json else render.impact_text(document, graph.node(resolved)))
        elif given.json:
            print(graph.to_json(), end="")
        elif given.mermaid:
            print(graph.to_mermaid(), end="")
        elif given.html:
            excerpts = None
            if given.include_source:
                cited = graph.nodes.filter("file_path is not null and line_number > 0").select("file_path", "line_number")
                files = repository_files(spark, root, config).filter("content is not null").select(views.F.col("path").alias("file_path"), "content")
                excerpts = views.excerpts(cited, files)
            page = render.write_html(os.path.splitext(stored)[0] + ".html", render.viewer_payload(graph.graph, excerpts), graph.name or "Lineage")
            print(page)
            if given.open:
                import pathlib
                import webbrowser

                webbrowser.open(pathlib.Path(page).resolve().as_uri())
        else:
            print(graph.to_chains(), end="")
        return 0
    except (AmbiguousNode, NodeNotFound) as e:
        return _not_one(e, getattr(given, "json", False))
    except (WeftError, OSError) as e:
        return _fail(str(e))
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
