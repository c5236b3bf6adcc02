"""Symbols of a source text: what is declared at the top of a file and in its classes, without function bodies.

A symbol is (name, kind, signature, parent, visibility, exported, start, end), with offsets in characters."""

from __future__ import annotations

import re
from collections.abc import Iterator

from codeloom.parsers.masking import Outline

SIGNATURE_CHARS = 240
_BEGIN = r"(?:^|(?<=[;{}\]\n]))[ \t]*"
_SCRIPT_HEAD = re.compile(_BEGIN + r"(?P<head>(?P<mods>(?:(?:export|default|declare|abstract|async)\s+)*)(?P<kw>class|interface|const\s+enum|enum|namespace|module|type|function\b\s*\*?|const|let|var)\b\s*(?P<name>[\w$]+(?:\.[\w$]+)*))", re.M)
_SCRIPT_MEMBER = re.compile(
    _BEGIN + r"(?P<head>(?:@[\w$.]+(?:\([^()]*\))?\s*)*(?P<mods>(?:(?:public|private|protected|static|readonly|abstract|override|async|declare|get|set|accessor)\s+)*)\*?[ \t]*(?P<name>#?[\w$]+))[?!]?\s*(?P<next>[<(:=;}]|$)", re.M
)
_MORE_NAMES = re.compile(r",\s*([\w$]+)\s*(?::[^=,;]+)?=(?![=>])")
_FUNCTION_VALUE = re.compile(r"\s*(?::[^=]*(?:=>[^=]*)?)?=\s*(?:async\b\s*)?(?:function\b|[\w$]+\s*=>|(?:<[^<>]*>\s*)?(?P<open>\())")
_CLASS_VALUE = re.compile(r"\s*(?::[^=]*)?=\s*class\b")
_RUST_HEAD = re.compile(_BEGIN + r"(?P<head>(?P<vis>pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|async|unsafe|const|extern(?:\s*\"[^\"]*\")?)\s+)*(?P<kw>fn|struct|enum|trait|impl|const|static|type|mod)\b\s*(?:mut\s+)?(?P<name>\w*))", re.M)
_RUST_FIELD = re.compile(r"(?:^|(?<=[,{\]\n]))[ \t]*(?P<head>(?P<vis>pub(?:\s*\([^)]*\))?\s+)?(?P<name>[a-z_A-Z]\w*))\s*:(?!:)", re.M)
_RUST_KIND = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "impl": "impl", "const": "constant", "static": "constant", "type": "type", "mod": "module"}
_GO_HEAD = re.compile(r"^(?P<head>(?P<kw>func|type|const|var)\b[ \t]*(?:\((?P<recv>[^()]*)\)[ \t]*(?=\w))?(?P<name>\w*))", re.M)
_GO_NAMES = re.compile(r"[ \t]*(?P<names>[A-Za-z_]\w*(?:[ \t]*,[ \t]*[A-Za-z_]\w*)*)(?P<rest>[^\n]*)")
_GO_FIELD = re.compile(r"(?:^|(?<=[{;]))[ \t]*(?P<names>[A-Za-z_]\w*(?:[ \t]*,[ \t]*\w+)*)[ \t]+(?=[\w*\[(<{])", re.M)
_PY_ASSIGN = re.compile(r"(?P<name>[^\W\d]\w*)[ \t]*(?::[ \t]*\S|(?:[-+*/%@&|^]|//|\*\*|<<|>>)?=(?!=))")
_PY_HEAD = re.compile(r"(?:async[ \t]+)?(?P<kw>def|class)[ \t]+(?P<name>\w+)")
_PY_BLOCK = frozenset("if elif else for while with try except finally match case lambda return async".split())


def one_line(text: str) -> str:
    text = " ".join(text.split())
    return text[:SIGNATURE_CHARS] + "..." if len(text) > SIGNATURE_CHARS else text


def _visibility(signature: str) -> str | None:
    m = re.match(r"private(?= |$)|protected|public", signature)
    return m.group() if m else None


def symbols(o: Outline) -> list[tuple]:
    found = {"typescript": _script, "javascript": _script, "rust": _rust, "go": _go, "python": _python}[o.language](o)
    return sorted(found, key=lambda s: (s[6], -s[7], s[0]))


def _script(o: Outline) -> Iterator[tuple]:
    size = len(o.text)
    for m in _SCRIPT_HEAD.finditer(o.masked):
        at, name, kw = m.start("head"), m["name"], " ".join(m["kw"].split())
        if o.depth(at) or name in ("extends", "implements", "from"):
            continue
        exported = "export" in m["mods"].split()
        kind = {"class": "class", "interface": "interface", "enum": "enum", "const enum": "enum", "namespace": "module", "module": "module", "type": "type"}.get(kw, "function" if kw.startswith("function") else None)
        if kind in ("class", "interface", "enum", "module", "function"):
            stop = o.find("{;" if kind == "function" else "{", m.end(), size, 0)
            while stop >= 0 and kind == "class" and o.masked[o.close[stop] + 1 :].lstrip()[:1] in tuple(">,&|"):
                stop = o.find("{", o.close[stop] + 1, size, 0)  # that was a type of the heritage
            if stop < 0 or o.masked[stop] == ";":
                continue  # a declaration without a body
            end = o.close[stop] + 1
            yield name, kind, one_line(o.text[at:stop]), None, None, exported, at, end
            if kind == "class":
                yield from _script_members(o, name, stop, end - 1)
        elif kind == "type":
            if o.masked[m.end() :].lstrip()[:1] not in ("=", "<"):
                continue
            end = o.statement_end(m.end(), size, 0)
            yield name, kind, one_line(o.text[at:end]), None, None, exported, at, end
        else:
            end = o.statement_end(m.end(), size, 0)
            names = [(name, at, m.end())] + [(x[1], x.start(1), x.end(1)) for x in _MORE_NAMES.finditer(o.masked, m.end(), end) if not o.depth(x.start())]
            for name, begin, behind in names:
                value = _FUNCTION_VALUE.match(o.masked, behind, end)
                arrow = value and (value["open"] is None or re.match(r"\s*(?::[^;={]+)?=>", o.masked[o.close.get(value.start("open"), end) + 1 : end]))
                kind = "function" if arrow else "class" if _CLASS_VALUE.match(o.masked, behind, end) else "constant" if kw == "const" else "variable"
                yield name, kind, one_line(o.text[begin:end].split("{")[0] if arrow else o.text[begin:end]), None, None, exported, begin, end


def _script_members(o: Outline, parent: str, start: int, end: int) -> Iterator[tuple]:
    inside, k = o.depth(start) + 1, start + 1
    while m := _SCRIPT_MEMBER.search(o.masked, k, end):
        k = max(m.end("head"), k + 1)
        at = m.start("head")
        if o.depth(at) != inside:
            continue
        if m["next"] in ("(", "<"):
            opened = o.find("(", m.end("name"), end, inside)
            body = o.find("{;", o.close.get(opened, end) + 1, end, inside) if opened >= 0 else -1
            if body < 0 or o.masked[body] == ";":
                continue  # a signature without a body
            k = o.close[body]
            head = one_line(o.text[at:body])
            yield m["name"], "method", head, parent, _visibility(head), False, at, k + 1
        else:
            k = stop = o.statement_end(m.end("name"), end, inside)
            head = one_line(o.text[at:stop])
            yield m["name"], "field", head, parent, _visibility(head), False, at, stop


def _rust(o: Outline) -> Iterator[tuple]:
    size, owner, until = len(o.text), None, 0
    for m in _RUST_HEAD.finditer(o.masked):
        at, kw, name = m.start("head"), m["kw"], m["name"]
        depth, within = o.depth(at), at < until
        if depth and not (within and kw in ("fn", "const", "type")):
            continue
        stop = o.find("{;", m.end("kw"), size, depth)
        end = size if stop < 0 else stop + 1 if o.masked[stop] == ";" else o.close[stop] + 1
        opened = stop >= 0 and o.masked[stop] == "{"
        head = one_line(o.text[at : stop if stop >= 0 else size])
        if kw == "impl":
            target = re.sub(r"^\s*<(?:[^<>]|<[^<>]*>)*>", "", o.masked[m.end("kw") : stop if stop >= 0 else size])
            name = re.split(r"\bwhere\b|<", re.split(r"\bfor\b", target)[-1])[0].strip(" &\n\t")
        if not name:
            continue
        kind = "method" if kw == "fn" and within else _RUST_KIND[kw]
        yield name, kind, head, owner if within else None, "public" if m["vis"] else None, True, at, end
        if within or not opened:
            continue
        if kw in ("impl", "trait"):
            owner, until = name, end
        elif kw == "struct":
            for f in _RUST_FIELD.finditer(o.masked, stop + 1, end - 1):
                if o.depth(f.start("head")) == 1:
                    edge = o.find(",", f.end(), end - 1, 1)
                    edge = end - 1 if edge < 0 else edge
                    yield f["name"], "field", one_line(o.text[f.start("head") : edge]), name, "public" if f["vis"] else None, True, f.start("head"), edge


def _go(o: Outline) -> Iterator[tuple]:
    size = len(o.text)
    for m in _GO_HEAD.finditer(o.masked):
        at, kw = m.start("head"), m["kw"]
        if o.depth(at):
            continue
        if kw == "func":
            if not m["name"]:
                continue
            args = o.find("(", m.end(), size, 0)
            body = o.find("{\n", o.close.get(args, m.end()), size, 0)
            end = o.close[body] + 1 if body >= 0 and o.masked[body] == "{" else o.statement_end(m.end(), size, 0)
            base = re.search(r"(\w+)\s*(?:\[[^\]]*\])?\s*$", m["recv"] or "")
            yield m["name"], "method" if base else "function", one_line(o.text[at : body if body >= 0 else end]), base[1] if base else None, None, m["name"][:1].isupper(), at, end
            continue
        group = re.compile(r"[ \t]*\(").match(o.masked, m.end("kw"))
        depth, k, edge = (1, group.end(), o.close[group.end() - 1]) if group else (0, m.start("name"), size)
        while k < edge:
            spec = _GO_NAMES.match(o.masked, k)
            if spec and o.depth(spec.start("names")) == depth:
                end = o.statement_end(spec.start("names"), edge, depth)
                yield from _go_spec(o, kw, spec, end, depth)
                k = max(end, k)
            if not group:
                break
            behind = o.masked.find("\n", k, edge)
            k = edge if behind < 0 else behind + 1


def _go_spec(o: Outline, kw: str, m: re.Match, end: int, depth: int) -> Iterator[tuple]:
    at = m.start("names")
    if kw != "type":
        for name in re.split(r"\s*,\s*", m["names"].strip()):
            yield name, "constant" if kw == "const" else "variable", one_line(o.text[at:end]), None, None, name[:1].isupper(), at, end
        return
    name, rest = m["names"].strip(), m["rest"].lstrip(" \t=")
    rest = re.sub(r"^\[[^\]]*\]\s*", "", rest) if re.match(r"\[\w+ ", rest) else rest
    kind = "struct" if rest.startswith("struct") else "interface" if rest.startswith("interface") else "type"
    stop = o.find("{", at, end, depth) if kind != "type" else -1
    yield name, kind, one_line(o.text[at : stop if stop >= 0 else end]), None, None, name[:1].isupper(), at, end
    if kind == "struct" and stop >= 0:
        for f in _GO_FIELD.finditer(o.masked, stop + 1, o.close[stop]):
            if o.depth(f.start("names")) == depth + 1:
                line = o.statement_end(f.end(), o.close[stop], depth + 1)
                for field in re.split(r"\s*,\s*", f["names"].strip()):
                    yield field, "field", one_line(o.text[f.start("names") : line]), name, None, field[:1].isupper(), f.start("names"), line


def logical_lines(o: Outline) -> list[tuple[int, int, int]]:
    """(indent, start, end) of Python's logical lines; blank ones are left out."""
    out, begin = [], 0
    for m in re.finditer(r"\n|\Z", o.masked):
        k = m.start()
        if (o.depth(k) and k < len(o.masked)) or o.masked[begin:k].endswith("\\"):
            continue
        if HIDDEN_STRING.search(o.masked, begin, k) and o.masked.count('"', begin, k) % 2:
            continue  # within a string of several lines
        line = o.masked[begin:k]
        if line.strip():
            indent = len(line) - len(line.lstrip())
            out.append((len(line[:indent].expandtabs(8)), begin + indent, k))
        begin = k + 1
    return out


HIDDEN_STRING = re.compile('"')


def _python(o: Outline) -> Iterator[tuple]:
    lines = logical_lines(o)

    def block(first: int, last: int, container: str | None) -> Iterator[tuple]:
        if first >= last:
            return
        level, k = lines[first][0], first
        while k < last:
            _, at, end = lines[k]
            inner = k + 1
            while inner < last and lines[inner][0] > level:
                inner += 1
            stop = lines[inner - 1][2]
            head = _PY_HEAD.match(o.masked, at, end)
            if head:
                colon = o.find(":", head.end(), end, o.depth(at))
                name, is_class = head["name"], head["kw"] == "class"
                kind = "class" if is_class else "method" if container else "function"
                yield name, kind, one_line(o.text[at : colon if colon >= 0 else end]), container, None, is_class or not name.startswith("_"), at, stop
                if is_class:
                    yield from block(k + 1, inner, name)
            elif (m := _PY_ASSIGN.match(o.masked, at, end)) and m["name"] not in _PY_BLOCK:
                name = m["name"]
                constant = name == name.upper() and name != name.lower()
                yield name, "field" if container else "constant" if constant else "variable", one_line(o.text[at:end]), container, None, not name.startswith("_"), at, end
            k = inner

    yield from block(0, len(lines), None)
