"""Imports of a source text as (raw, imported symbol, type, candidates, mode, fallback).

Candidates are project paths without a probed ending, best first; ``mode`` says which endings may follow and ``fallback``
what an import is if no file fits: external or unresolved. Files are looked up by a join, in operators.resolution."""

from __future__ import annotations

import re
from collections.abc import Iterator

from codeloom.parsers.masking import Outline

_SCRIPT_FROM = re.compile(r"(?:^|(?<=[;{}\n]))[ \t]*(?P<kw>import|export)\b(?P<clause>[^;\"'()=]*?)\"(?P<spec> *)\"", re.M)
_SCRIPT_CALL = re.compile(r"(?<![\w$.])(?:require|import)\s*\(\s*(?P<string>\"(?P<spec> *)\")")
_PY_IMPORT = re.compile(r"^[ \t]*import[ \t]+(?P<names>[^\n;#]+)", re.M)
_PY_FROM = re.compile(r"^[ \t]*from[ \t]+(?P<dots>[. \t]*)(?P<module>[\w.]*)[ \t]*\bimport\b[ \t]*(?:\((?P<many>[^()]*)\)|(?P<few>(?:[^\n;\\]|\\\n)+))", re.M)
_RUST_USE = re.compile(r"(?:^|(?<=[;{}\n]))[ \t]*(?P<pub>pub(?:\s*\([^)]*\))?\s+)?use\s+(?P<body>[^;]+);", re.M)
_GO_IMPORT = re.compile(r"^import\b[ \t]*(?:\((?P<many>[^()]*)\)|(?P<one>[^\n]*))", re.M)
#: Crates that are never part of a project.
EXTERNAL_CRATES = {"std", "core", "alloc", "proc_macro", "test"}


def directory(path: str) -> str:
    return path.rpartition("/")[0]


def collapsed(path: str) -> str:
    """Without . and .. segments; a .. with nothing before it is dropped."""
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            del out[-1:]
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def _under(base: str, *parts: str) -> str:
    return collapsed("/".join([base, *parts]))


def general(spec: str, path: str) -> tuple[list[str], str, str]:
    """Candidates for a specifier as scripts write it; Python's absolute modules use it, too."""
    spec = spec.strip()
    forms = lambda base, s: [_under(base, s)] if s.endswith("/") else [_under(base, s, x) for x in ("", "index", "mod")]
    if not spec or spec.startswith(("./", "../")):
        return forms(directory(path), spec) if spec else [], "any", "unresolved"
    if spec.startswith("/"):
        return forms("", spec), "any", "unresolved"
    if spec.startswith("@/"):
        return [c for base in ("", "src") for c in forms(base, spec[2:])], "any", "unresolved"
    return forms("", spec), "any", "external"


def _names(clause: str) -> list[str]:
    clause = re.sub(r"^\s*type\b(?!\s*(?:,|from))", "", clause)
    clause = re.sub(r"\bfrom\s*$", "", clause).strip()
    group = re.search(r"\{([^}]*)\}", clause)
    out = [x for x in re.sub(r"\{[^}]*\}", "", clause).replace(" ", "").split(",") if x and "*" not in x]
    out += ["*"] if "*" in re.sub(r"\{[^}]*\}", "", clause) else []
    for item in group[1].split(",") if group else []:
        name = re.sub(r"^type\s+", "", item.strip()).split(" as ")[0].strip()
        out += [name] if name else []
    return out


def _script(o: Outline, path: str) -> Iterator[tuple]:
    for m in _SCRIPT_FROM.finditer(o.masked):
        spec = o.text[m.start("spec") : m.end("spec")]
        if not spec or (m["kw"] == "export" and not re.search(r"\bfrom\s*$", m["clause"])):
            continue
        names = _names(o.text[m.start("clause") : m.end("clause")]) if m["kw"] == "import" else []
        for name in names or [None]:
            yield spec, name, m["kw"], *general(spec, path)
    for m in _SCRIPT_CALL.finditer(o.masked):
        spec = o.text[m.start("spec") : m.end("spec")]
        if spec and o.text[m.start("string")] != "`":
            yield spec, None, "require", *general(spec, path)


def _python(o: Outline, path: str) -> Iterator[tuple]:
    for m in _PY_IMPORT.finditer(o.masked):
        for item in m["names"].split(","):
            module = item.split(" as ")[0].strip()
            if module:
                yield module, None, "import", *general(module.replace(".", "/"), path)
    for m in _PY_FROM.finditer(o.masked):
        dots, module = m["dots"].count("."), m["module"]
        while module.startswith("."):
            dots, module = dots + 1, module[1:]
        listed = m["many"] if m["many"] is not None else m["few"].replace("\\\n", " ")
        names = [n for n in (x.split(" as ")[0].strip() for x in listed.split(",")) if n and n != "*"]
        base = "/".join([directory(path)] + [".."] * (dots - 1))
        for name in names or [None]:
            if dots and not module:
                if name:
                    yield name, name, "from", [_under(base, name)], "any", "unresolved"
            elif dots:
                yield module, name, "from", [_under(base, module.replace(".", "/"))], "any", "unresolved"
            else:
                yield module, name, "from", *general(module.replace(".", "/"), path)


def rust_candidates(spec: str, path: str) -> list[str]:
    parts = [p for p in spec.replace(" ", "").split("::") if p]
    if not parts or parts[0] in EXTERNAL_CRATES:
        return []
    here, first = directory(path), parts[0]
    if first == "super":
        ups = next((k for k, p in enumerate(parts) if p != "super"), len(parts))
        base = "/".join(here.split("/")[: max(len(here.split("/")) - ups + 1, 0)])
        parts, bases = parts[ups:], [base]
    elif first == "self":
        parts, bases = parts[1:], [here]
    elif first == "crate":
        parts, bases = parts[1:], ["", here]
    else:
        bases = ["", here]
    tails = [parts, parts[:-1]] if len(parts) > 1 else [parts]
    out = [c for base in bases for tail in tails if (c := _under(base, *tail))]
    if first not in ("super", "self", "crate") and here and len(parts) > 1:
        out.pop()  # a foreign path is tried whole beside the importing file
    return list(dict.fromkeys(out + [_under("src", c) for c in out]))


def _rust(o: Outline, path: str) -> Iterator[tuple]:
    for m in _RUST_USE.finditer(o.masked):
        body = " ".join(o.text[m.start("body") : m.end("body")].split())
        base, _, group = body.partition("::{")
        base = base.split(" as ")[0].strip()
        local = base.startswith(("crate::", "self", "super"))
        # a re-export under pub counts as external, and a group ends at its first closing brace
        found = rust_candidates(base, path) if not m["pub"] else []
        rest = found, "rust", "unresolved" if local and not m["pub"] else "external"
        if group:
            for member in group.partition("}")[0].split(","):
                name = member.split(" as ")[0].strip()
                if name and name not in ("*", "self"):
                    yield f"{base}::{member.strip()}", name, "use", *rest
        else:
            last = base.rpartition("::")[2].strip()
            yield base, last if last not in ("", "*", "self") else None, "use", *rest


def _go(o: Outline, path: str, module: str | None) -> Iterator[tuple]:
    for m in _GO_IMPORT.finditer(o.masked):
        part = "many" if m["many"] is not None else "one"
        for s in re.finditer(r'"( *)"', o.masked[m.start(part) : m.end(part)]):
            spec = o.text[m.start(part) + s.start(1) : m.start(part) + s.end(1)].strip()
            if not spec or spec == "C":
                continue
            if spec.startswith(("./", "../")):
                yield spec, None, "import", *general(spec, "")
            elif module and spec.startswith(module + "/"):
                yield spec, None, "import", [collapsed(spec[len(module) + 1 :])], "go", "unresolved"
            else:
                yield spec, None, "import", [], "go", "external"


def imports(o: Outline, path: str, go_module: str | None = None, packages: dict[str, list[str]] | None = None) -> list[tuple]:
    """packages: entry candidates of the workspace packages, by name."""
    if o.language == "go":
        return list(_go(o, path, go_module))
    found = {"typescript": _script, "javascript": _script, "python": _python, "rust": _rust}[o.language](o, path)
    return [(raw, name, kind, list(dict.fromkeys(c + (packages or {}).get(raw, []))), mode, other) for raw, name, kind, c, mode, other in found]
