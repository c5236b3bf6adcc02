"""Command line. Exit code 2 for wrong usage, 1 for other failures."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import SparkSession

from codeloom import terminal
from codeloom.api import VERSION, Project
from codeloom.serve import serve
from codeloom.sources.scan import load_config
from codeloom.streaming import watch


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="codeloom")
    top.add_argument("-R", "--root", default=".")
    top.add_argument("-q", "--quiet", action="store_true")
    top.add_argument("-j", "--json", action="store_true", help="JSON on standard output and nothing else")
    top.add_argument("-v", "--verbose", action="store_true", help="say on standard error what is done and how long it took")
    top.add_argument("--no-color", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [sub.add_parser(name)] and [sub.choices[name].add_argument(*a, **k) for a, k in args]
    flag = lambda *names: (names, {"action": "store_true"})
    text = lambda name, **k: ((name,), k)
    add("init", flag("--force"))
    add("search", text("term"), text("--kind"), text("--limit", type=int, default=50), flag("--files"))
    add("symbol", text("name"))
    add("deps", text("file"), flag("--external"))
    add("impact", text("target"), text("--depth", type=int, default=3))
    add("context", text("task"), text("--max-tokens", type=int), flag("--bodies"))
    add("skeleton", text("path"))
    add("changed", text("ref", nargs="?"))
    add("diff", text("base", nargs="?"), text("head", nargs="?"))
    add("sync")
    for name in ("schema", "benchmark", "doctor", "stats", "version", "mcp"):
        add(name)
    add("watch", text("events", nargs="?"))
    return top


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "version":
        print(json.dumps({"version": VERSION}))
        return 0
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("codeloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    p = Project(spark, args.root)
    try:
        if args.command == "mcp":
            serve(p, sys.stdin, lambda line: (sys.stdout.write(line), sys.stdout.flush()))
            return 0
        if args.command == "watch":  # the tree itself, or a folder in which JSON lines with paths arrive
            settings = load_config(p.root)["watch"]
            if not settings["enabled"]:
                print("watch is disabled in .ctx/config.toml ([watch].enabled = true)", file=sys.stderr)
                return 0
            events = spark.readStream.schema("path string").json(args.events) if args.events else watch.tree(spark, p.root)
            watch.watch(events, watch.index_changes(spark, p.root, p.store), f"{settings['debounce_ms']} milliseconds").awaitTermination()
            return 0
        began = time.perf_counter()
        out = {
            "init": lambda: p.init(args.force),
            "search": lambda: p.search(args.term, args.kind, args.limit, args.files),
            "symbol": lambda: p.symbol(args.name),
            "deps": lambda: p.deps(args.file, args.external),
            "impact": lambda: p.impact(args.target, args.depth),
            "context": lambda: p.context(args.task, args.max_tokens, args.bodies),
            "skeleton": lambda: p.skeleton(args.path),
            "changed": lambda: p.changed(args.ref),
            "sync": lambda: p.sync() or {},
            "diff": lambda: p.diff(args.base, args.head),
            "schema": lambda: {"schema": p.schema()},
            "benchmark": p.benchmark,
            "doctor": p.doctor,
            "stats": p.stats,
        }[args.command]()
    except ValueError as error:
        print(f"error: {error}", file=sys.stderr)
        return 2 if "unknown kind" in str(error) else 1
    if args.verbose:
        print(f"{args.command}: {time.perf_counter() - began:.2f} s", file=sys.stderr)
    if args.json or (not args.quiet and not sys.stdout.isatty()):
        print(json.dumps(out, indent=2, default=str))
    elif not args.quiet:
        print("\n".join(terminal.lines(out, not args.no_color and "NO_COLOR" not in os.environ)))
    return 1 if args.command == "doctor" and out["status"] != "READY" else 0


if __name__ == "__main__":
    sys.exit(main())
