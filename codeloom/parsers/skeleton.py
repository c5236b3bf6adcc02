"""A source text without its function bodies."""

from __future__ import annotations

import re

from codeloom.parsers.declarations import logical_lines
from codeloom.parsers.masking import Outline

HIDDEN_BODY = " /* ... implementation hidden ... */ "
#: What a declaration may begin with, and the bounds of a fallback skeleton.
DECLARATION_WORDS = tuple(w + " " for w in "function class interface type enum const let var async export import from def impl fn struct trait pub private protected static package func use".split())
MOST_LINES, MOST_BYTES = 80, 12_000
_NOT_FUNCTIONS = re.compile(r"(?:^|[;{}\n])\s*(?:\}\s*)?(?:else\s+)?(?:if|for|while|switch|catch|with|match|loop|select)\b[^;{}]*$")
_RUST_FN = re.compile(r"\bfn\s+\w+[^;{}]*$")
_GO_FUNC = re.compile(r"\bfunc\b[^;\n]*$")
_MAIN = re.compile(r"""if\s*\(?\s*(?:__name__\s*==\s*['"]__main__['"]|['"]__main__['"]\s*==\s*__name__)\s*\)?\s*:""")
_PY_DEF = re.compile(r"(?:async[ \t]+)?def\b")


def fallback(text: str) -> str:
    """Of a text that doesn't parse: lines that look like declarations, within bounds."""
    kept: list[str] = []
    lines = text.splitlines()
    for line in lines:
        bare = line.lstrip()
        if bare.startswith(DECLARATION_WORDS) or bare.endswith("{") or (not bare and not (kept and not kept[-1].strip())):
            kept.append(line)
    out = "\n".join(kept[:MOST_LINES])
    if len(out.encode()) > MOST_BYTES:
        out = out.encode()[:MOST_BYTES].decode("utf-8", "ignore") + "\n// ... (skeleton truncated)"
    return out + (f"\n// ... (skeleton truncated: {len(lines)} lines)" if len(lines) > MOST_LINES else "")


def _is_body(o: Outline, brace: int) -> bool:
    before = o.masked[max(0, brace - 2000) : brace]
    if o.language == "rust":
        return bool(_RUST_FN.search(before)) or bool(re.search(r"\basync\s+(?:move\s+)?$|(?:^|[=(,\s])(?:move\s+)?\|[^|;{}]*\|\s*(?:->\s*[^;{}]+)?$", before))
    if o.language == "go":
        found = _GO_FUNC.search(before)
        return bool(found) and not re.search(r"(?:struct|interface)\s*$", before)
    tail = before.rstrip()
    if tail.endswith("=>"):
        return True
    if tail[-1:] in tuple(":|&<,") or not re.search(r"\)\s*(?::(?:[^;{}=]|\{[^{}]*\})+)?$", before):
        return False
    return not _NOT_FUNCTIONS.search(before)


def skeleton(o: Outline) -> str:
    if not o.balanced:
        return fallback(o.text)
    if o.language == "python":
        return _python(o)
    out, done = [], 0
    for brace in sorted(k for k in o.close if o.masked[k] == "{"):
        end = o.close[brace]
        if brace < done or end - brace + 1 <= 2 or not _is_body(o, brace):
            continue
        out += [o.text[done : brace + 1], HIDDEN_BODY]
        done = end
    return "".join(out) + o.text[done:]


def _python(o: Outline) -> str:
    lines, out, done, k = logical_lines(o), [], 0, 0
    while k < len(lines):
        level, at, end = lines[k]
        inner = k + 1
        while inner < len(lines) and lines[inner][0] > level:
            inner += 1
        function = _PY_DEF.match(o.masked, at)
        if inner == k + 1 or not (function or _MAIN.match(o.text, at, end)):
            k += 1
            continue
        _, first, behind = lines[k + 1]
        indent = o.text[o.text.rfind("\n", 0, first) + 1 : first]
        documented = function and re.match(r"""[rRuU]?['"]""", o.text[first : first + 2]) and not o.masked[first:behind].strip('" \n\trRuU')
        out += [o.text[done : behind if documented else end], f"\n{indent}..."]
        done, k = lines[inner - 1][2], inner
    return "".join(out) + o.text[done:]


def tokens(text: str) -> int:
    return max(1, len(text.encode("utf-8", "surrogatepass")) // 4)


def stats(text: str, short: str) -> dict:
    before, after = tokens(text), tokens(short)
    size = lambda t: len(t.encode("utf-8", "surrogatepass"))
    return {"original_bytes": size(text), "skeleton_bytes": size(short), "original_tokens": before, "skeleton_tokens": after, "reduction_pct": max(0.0, (1 - after / before) * 100), "estimate": True}
