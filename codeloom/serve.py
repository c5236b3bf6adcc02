"""A tool server: JSON-RPC 2.0, one message a line."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from codeloom.api import VERSION, Project
from codeloom.operators.lookup import KINDS

PROTOCOL = "2025-06-18"


def _text(name: str, what: str, required: bool = True, **more) -> tuple:
    return name, {"type": "string", "description": what, **more}, required


def _number(name: str, what: str, low: int, high: int) -> tuple:
    return name, {"type": "integer", "description": what, "minimum": low, "maximum": high}, False


def _flag(name: str, what: str) -> tuple:
    return name, {"type": "boolean", "description": what}, False


def _search(p: Project, a: dict) -> list[dict]:
    limit = int(a.get("limit", 50))
    if a.get("files"):
        return [{k: f[k] for k in ("path", "language", "size")} for f in p.search(a["query"], limit=limit, files=True)]
    return [{"name": s["name"], "parent": s["parent"], "kind": s["kind"], "path": s["path"], "line": s["start_line"], "signature": s["signature"]} for s in p.search(a["query"], a.get("kind"), limit)]


def _skeleton(p: Project, a: dict) -> dict:
    out = p.skeleton(a["path"])
    return out if a.get("with_stats") else {k: out[k] for k in ("path", "language", "skeleton")}


def _impact(p: Project, a: dict) -> dict:
    target = a.get("symbol") or (p.inside(a["path"]) if a.get("path") else None)
    if target is None:
        raise ValueError("give a `symbol` or a `path`")
    try:
        return p.impact(target, int(a.get("depth", 3)))
    except ValueError as error:
        return {"error": str(error), "hint": "init brings the index up to date"}


def _versioned(run: Callable[[Project, dict], object]) -> Callable[[Project, dict], object]:
    return lambda p, a: run(p, a) if p.repository() else {"error": "not a git repository"}


TOOLS: dict[str, tuple[str, list, Callable[[Project, dict], object]]] = {
    "ctx_project": ("Root, version control, counts and languages of the project", [], lambda p, a: p.summary()),
    "ctx_stats": ("Counts and size of the index", [], lambda p, a: p.stats()),
    "ctx_search": ("Symbols or files by name", [_text("query", "part of a name"), _text("kind", "symbol kind", False, enum=sorted(set(KINDS.values()))), _flag("files", "search file paths instead of symbols"), _number("limit", "most results", 1, 500)], _search),
    "ctx_skeleton": ("A file without function bodies", [_text("path", "project path"), _flag("with_stats", "sizes and what was saved, too")], _skeleton),
    "ctx_symbol": ("A symbol, its methods, references and dependencies", [_text("name", "name or Parent.member")], lambda p, a: p.symbol(a["name"])),
    "ctx_dependencies": ("What a file depends on", [_text("path", "project path")], lambda p, a: [{"target": d["path"], "imported_symbol": d["imported_symbol"]} for d in p.deps(p.inside(a["path"]))["dependencies"]]),
    "ctx_dependents": ("What depends on a file", [_text("path", "project path")], lambda p, a: [{"source": d["path"], "imported_symbol": d["imported_symbol"]} for d in p.deps(p.inside(a["path"]))["dependents"]]),
    "ctx_impact": ("What a change of a symbol or file reaches", [_text("symbol", "symbol name", False), _text("path", "project path, instead of a symbol", False), _number("depth", "levels", 1, 20)], _impact),
    "ctx_context": ("Files for a task within a token budget", [_text("task", "what is to be done"), _flag("include_bodies", "whole files instead of skeletons"), _number("max_tokens", "budget", 128, 100_000)], lambda p, a: p.context(a["task"], a.get("max_tokens"), bool(a.get("include_bodies")))),
    "ctx_changed": ("Changed files and symbols since a revision (by default of the working tree)", [_text("ref", "revision", False)], _versioned(lambda p, a: p.changed(a.get("ref")))),
    "ctx_diff": ("Symbols that differ between revisions; one revision means its merge base with the last commit", [_text("base", "revision, by default HEAD", False), _text("head", "revision", False)], _versioned(lambda p, a: p.diff(a.get("base"), a.get("head")))),
}


def _listing() -> list[dict]:
    return [{"name": n, "description": what, "inputSchema": {"type": "object", "properties": {k: t for k, t, _ in args}, "required": [k for k, _, must in args if must]}} for n, (what, args, _) in TOOLS.items()]


def _call(project: Project, params: dict) -> dict:
    try:
        _, args, run = TOOLS[params["name"]]
        given = params.get("arguments") or {}
        missing = [k for k, _, must in args if must and k not in given]
        if missing:
            raise ValueError(f"missing argument: {', '.join(missing)}")
        return {"content": [{"type": "text", "text": json.dumps(run(project, given))}], "isError": False}
    except Exception as error:  # a tool's failure is its answer
        return {"content": [{"type": "text", "text": str(error)[:2000]}], "isError": True}


def answer(project: Project, line: str) -> dict | None:
    try:
        message = json.loads(line)
        method, number, params = message.get("method"), message.get("id"), message.get("params") or {}
    except (ValueError, AttributeError):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "parse error"}}
    if number is None:
        return None  # a notification
    simple = {"initialize": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "codeloom", "version": VERSION}}, "ping": {}, "tools/list": {"tools": _listing()}, "prompts/list": {"prompts": []}, "resources/list": {"resources": []}}
    if method == "tools/call":
        return {"jsonrpc": "2.0", "id": number, "result": _call(project, params)}
    if method in simple:
        return {"jsonrpc": "2.0", "id": number, "result": simple[method]}
    return {"jsonrpc": "2.0", "id": number, "error": {"code": -32601, "message": f"unknown method: {method}"}}


def serve(project: Project, lines: Iterable[str], write: Callable[[str], object]) -> None:
    for line in lines:
        if line.strip() and (reply := answer(project, line)) is not None:
            write(json.dumps(reply) + "\n")
