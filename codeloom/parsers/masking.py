"""Source text with comments and the insides of strings blanked, and its bracket structure.

All declaration and import patterns run over the masked text: what they match has the same offsets in the source."""

from __future__ import annotations

import re
from bisect import bisect_left

_C_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTED = r'"(?:\\.|[^"\\\n])*"'
_REGEX = r"(?<=[=(,:\[!&|?{};])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/"
_SCRIPT = rf"{_C_COMMENT}|{_REGEX}|{_QUOTED}|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*(?:`|\Z)"
HIDDEN = {
    "typescript": _SCRIPT,
    "javascript": _SCRIPT,
    "python": r"""#[^\n]*|(?P<q>\"{3}|'{3})(?:\\.|.)*?(?:(?P=q)|\Z)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""",
    "rust": rf"""{_C_COMMENT}|r(?P<h>\#*)".*?"(?P=h)|"(?:\\.|[^"\\])*"|'(?:\\u\{{\w+\}}|\\x\w\w|\\.|[^'\\\n])'""",
    "go": rf"{_C_COMMENT}|{_QUOTED}|`[^`]*`|'(?:\\.|[^'\\\n])+'",
}
HIDDEN = {k: re.compile(v, re.S) for k, v in HIDDEN.items()}
_BRACKET = re.compile(r"[()\[\]{}]")
_OPENER = {")": "(", "]": "[", "}": "{"}


def _blank(m: re.Match) -> str:
    got = m.group()
    inside = re.sub(r"[^\n]", " ", got)
    if got.lstrip()[:2] in ("//", "/*") or got[0] == "#":
        return inside
    return '"' + inside[1:-1] + '"' if len(got) > 1 else inside


class Outline:
    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.masked = HIDDEN[language].sub(_blank, text)
        self.at, self.after, self.close = [], [], {}
        stack, self.balanced = [], True
        for m in _BRACKET.finditer(self.masked):
            c, k = m.group(), m.start()
            if c in "([{":
                stack.append(k)
            elif stack and self.masked[stack[-1]] == _OPENER[c]:
                self.close[stack.pop()] = k
            else:
                self.balanced = False
            self.at.append(k)
            self.after.append(len(stack))
        for k in stack:  # unclosed: to the end of the file
            self.balanced = False
            self.close[k] = len(text)
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self.plain = text.isascii()

    def depth(self, k: int) -> int:
        """Brackets open before the character at k."""
        i = bisect_left(self.at, k)
        return self.after[i - 1] if i else 0

    def line(self, k: int) -> int:
        return bisect_left(self.lines, k) + 1

    def byte(self, k: int) -> int:
        return k if self.plain else len(self.text[:k].encode("utf-8", "surrogatepass"))

    def find(self, chars: str, start: int, end: int, depth: int) -> int:
        """First of the characters at that depth, or -1."""
        for m in re.compile(f"[{re.escape(chars)}]").finditer(self.masked, start, end):
            if self.depth(m.start()) == depth:
                return m.start()
        return -1

    def statement_end(self, start: int, limit: int, depth: int) -> int:
        """End of a statement without a body: a semicolon, or a line end that continues nowhere."""
        k = start
        while (k := self.find(";\n", k, limit, depth)) >= 0:
            if self.masked[k] == ";":
                return k
            before, behind = self.masked[start:k].rstrip()[-1:], self.masked[k:limit].lstrip()[:1]
            if before not in "=,+-*/&|?:<(" and behind not in tuple(".?:=+*/&|,"):
                return k
            k += 1
        return limit
