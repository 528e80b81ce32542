"""Command line: scan, analyse, candidates, report, candidate show and export. Exit codes: 0, 1 (scan errors), 2 (refused)."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
from pathlib import Path

from . import __version__
from .operators.mining import Options
from .plans import wording
from .plans.store import Store
from .session import local_session
from .sources.files import default_roots


def write_private(path: str, text: str) -> None:
    """A new file that only its owner can read; an existing one is never touched."""
    place = Path(path).expanduser()
    place.parent.mkdir(parents=True, exist_ok=True)
    with os.fdopen(os.open(place, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w", encoding="utf-8") as f:
        f.write(text.rstrip("\n") + "\n")


def arguments() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--store", default=argparse.SUPPRESS, help="folder of the store")
    top = argparse.ArgumentParser(prog="tallyloom", parents=[shared])
    top.add_argument("--version", action="version", version=__version__)
    commands = top.add_subparsers(dest="task", required=True)
    p = commands.add_parser("scan", parents=[shared])
    p.add_argument("paths", nargs="*")
    for name in ("--claude", "--codex", "--json"):
        p.add_argument(name, action="store_true")
    p.add_argument("--source", choices=["claude", "codex"])
    p.add_argument("--matchers")
    p.add_argument("--workers", type=int, default=1)
    p = commands.add_parser("analyse", aliases=["analyze"], parents=[shared])
    for name, value in (("--min-length", 2), ("--max-length", 10), ("--min-occurrences", 2), ("--min-sessions", 2), ("--result-budget", 200)):
        p.add_argument(name, type=int, default=value)
    for name in ("--model-usage", "--include-exploratory"):
        p.add_argument(name, action="store_true")
    p.add_argument("--keep-nested", action="store_true", help="taken and ignored: variants always belong to a family")
    p = commands.add_parser("candidates", parents=[shared])
    p.add_argument("--json", action="store_true")
    p.add_argument("--limit", type=int, default=20)
    p = commands.add_parser("report", parents=[shared])
    p.add_argument("--format", choices=["markdown", "json"], default="markdown")
    p.add_argument("--output", "-o")
    p = commands.add_parser("candidate", parents=[shared])
    for name in ("show", "export"):
        q = p.add_subparsers(dest="act", required=True) if name == "show" else q  # noqa: F821
        one = q.add_parser(name, parents=[shared])
        one.add_argument("id")
        one.add_argument("--format", choices=["markdown", "json"], default="markdown")
        one.add_argument("--include-sensitive", action="store_true")
        if name == "export":
            one.add_argument("--output", "-o")
    return top


def run(a: argparse.Namespace, store: Store) -> int:
    if a.task == "scan":
        if not 1 <= a.workers <= 8:
            raise ValueError("--workers must be between 1 and 8")
        paths = a.paths or default_roots(a.claude, a.codex)
        if not paths:
            raise ValueError("no transcripts found; name a file or folder")
        s = store.scan(paths, a.source, Path(a.matchers).read_text() if a.matchers else None)
        if a.json:
            print(json.dumps(s, indent=2))
        else:
            print(f"Imported {s['imported']} files, {s['actions']} actions; {s['unchanged']} unchanged, {s['duplicates']} duplicate, {s['unsupported']} without supported actions.")
            for x in (*s["warnings"], *s["errors"]):
                print(x, file=sys.stderr)
        return 1 if s["errors"] else 0
    if a.task in ("analyse", "analyze"):
        found = store.analyse(Options(a.min_length, a.max_length, a.min_occurrences, a.min_sessions, a.result_budget, a.include_exploratory))
        if a.model_usage:
            print(f"Audited {store.audit()['gross_historical_call_exposure']['model_calls']} eligible model calls.")
        print(f"Found {len(found)} candidates.")
        return 0
    if a.task == "candidates":
        if a.limit < 1:
            raise ValueError("--limit must be positive")
        rows = store.candidates("list", a.limit)
        if a.json:
            print(json.dumps([wording.package(r)["candidate"] for r in rows], indent=2))
        for c in [] if a.json else rows:
            print(f"{c['id']}  {c['occurrences']:>11}  {c['project_count']:>8}  {c['modeled_tool_output_reduction_tokens']:>11,}  {c['score']:>12,.0f}  {c['name']}")
        return 0
    if a.task == "report":
        r = store.report()
        text = json.dumps(r, indent=2) if a.format == "json" else wording.report_text(r)
    else:
        bundle = wording.package(store.candidate(a.id), a.include_sensitive)
        text = json.dumps(bundle, indent=2) if a.format == "json" else wording.package_text(bundle)
    if getattr(a, "output", None):
        write_private(a.output, text)
        print(f"Written to {a.output}")
    else:
        print(text)
    return 0


def main(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    state = os.environ.get("XDG_STATE_HOME", str(Path.home() / ".local/state"))
    place = getattr(a, "store", os.environ.get("TALLYLOOM_STORE", f"{state}/tallyloom/store"))
    try:
        return run(a, Store(local_session(), place))
    except (ValueError, OSError, re.error, KeyError, TypeError) as e:
        print(f"tallyloom: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    raise SystemExit(main())
