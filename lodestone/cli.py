"""Command line: version, init, doctor, discover, analyze, report, export.

Exit codes: 0 all right, 1 error, 2 bad path, 3 no artifacts, 4 done with errors, 10 a plugin failed to load.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

import lodestone
from lodestone.config import load
from lodestone.plugins import Registry


def _say(args, data: dict, text: str) -> None:
    print(json.dumps(data, indent=2, default=str) if args.json else text)


def _engine(args):
    from lodestone.engine import Engine
    from lodestone.session import local_session

    config = load(args.path)
    registry = Registry()
    registry.load_all(config.plugin_dirs)
    return Engine(local_session(partitions=4), config, registry), registry


def doctor(args) -> int:
    root = Path(args.path)
    config = load(root) if root.is_dir() else None
    checks = {
        "python": sys.version_info >= (3, 10), "root exists": root.exists(), "root is a directory": root.is_dir(), "root is writable": os.access(root, os.W_OK),
        "workspace": config is not None and (root / config.workspace_dir / "workspace.json").exists(), "plugin folders": config is not None and all(Path(p).expanduser().exists() for p in config.plugin_dirs),
    }
    _say(args, checks, "\n".join(f"{'ok  ' if v else 'FAIL'} {k}" for k, v in checks.items()))
    return 0 if all(v for k, v in checks.items() if k != "workspace") else 1


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone", description=__doc__.splitlines()[0])
    verbs = parser.add_subparsers(dest="verb", required=True)
    for name in ("version", "init", "doctor", "discover", "analyze"):
        p = verbs.add_parser(name)
        p.add_argument("path", nargs="?", default=".")
        p.add_argument("--json", action="store_true")
        p.add_argument("--force", action="store_true")
    for name, kinds in (("report", ("summary", "structure", "graph")), ("export", ("jsonl", "dot", "cypher"))):
        p = verbs.add_parser(name)
        p.add_argument("kind", choices=kinds)
        p.add_argument("path", nargs="?", default=".")
        p.add_argument("--json", action="store_true")
        p.add_argument("-o", "--output")
    args = parser.parse_args(argv)
    if args.verb == "version":
        _say(args, {"version": lodestone.__version__}, lodestone.__version__)
        return 0
    if args.verb == "doctor":
        return doctor(args)
    root = Path(args.path)
    if not root.is_dir():
        print(f"{root} is no directory", file=sys.stderr)
        return 2
    if args.verb in ("report", "export"):
        return _show(args, root)
    from lodestone.sources.workspace import Workspace

    if args.verb == "init":
        try:
            Workspace(root / load(root).workspace_dir).init(root.resolve().name, args.force)
        except FileExistsError as e:
            print(e, file=sys.stderr)
            return 1
        _say(args, {"workspace": str(root / load(root).workspace_dir)}, "workspace ready")
        return 0
    engine, registry = _engine(args)
    if registry.errors:
        print("\n".join(f"{a}: {b}" for a, b in registry.errors), file=sys.stderr)
        return 10
    if args.verb == "discover":
        found = engine.discover(root)
        data = {"artifact_count": found.artifacts.count(), **{k: found.tallies.get(k, 0) for k in ("new", "modified", "deleted", "renamed", "unchanged")}}
        _say(args, data, "\n".join(f"{k}: {v}" for k, v in data.items()))
        return 0
    result = engine.analyze(root, args.force)
    data = {"artifact_count": result.artifacts.count(), "object_count": result.statistics["node_count"], "relationship_count": result.statistics["edge_count"], "ok": result.ok}
    _say(args, data, "\n".join(f"{k}: {v}" for k, v in data.items()))
    return 3 if not data["artifact_count"] else 0 if data["ok"] else 4


def _show(args, root: Path) -> int:
    space = root / load(root).workspace_dir
    if not (space / "reports/summary.json").exists():
        print("no analysis in this workspace", file=sys.stderr)
        return 1
    if args.verb == "export":
        text = (space / f"graph/graph.{args.kind}").read_text("utf-8")
    else:
        summary = json.loads((space / "reports/summary.json").read_text("utf-8"))
        parts = {
            "summary": summary, "structure": {"node_type_counts": dict(sorted(summary["node_type_counts"].items()))},
            "graph": {k: summary[k] for k in ("object_count", "relationship_count", "graph_density", "edge_type_counts")},
        }
        if args.json:
            text = json.dumps(parts[args.kind], indent=2)
        elif args.kind == "summary":
            text = (space / "reports/summary.md").read_text("utf-8")
        else:
            text = "\n".join(f"{k}: {v}" for part in parts[args.kind].values() for k, v in (part.items() if isinstance(part, dict) else [("", part)]))
    if args.output:
        Path(args.output).write_text(text, "utf-8")
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
