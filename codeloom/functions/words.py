"""The token rules of functions.text for the few strings that the driver holds: a task and its keywords."""

from __future__ import annotations

import re

from codeloom.functions.fixed import MOST_KEYWORDS, STOP_WORDS, SYNONYMS

_APART = re.compile(r"[^\w]|_")


def _split(text: str) -> list[str]:
    return [w for w in _APART.split(text) if w]


def without_runs(items: list[str]) -> list[str]:
    """Consecutive repeats count once."""
    return [x for k, x in enumerate(items) if not k or x != items[k - 1]]


def tokenize(task: str) -> list[str]:
    return without_runs([w for w in _split(task.lower()) if len(w.encode()) > 1 and w not in STOP_WORDS])


def words_of(name: str) -> list[str]:
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    return _split(re.sub(r"([a-z])([0-9])", r"\1 \2", name).lower())


def level(words: list[str], keyword: str) -> int:
    if keyword in words:
        return 3
    size = len(keyword.encode())
    if size >= 4 and any(len(w.encode()) > size and (w.startswith(keyword) or w.endswith(keyword)) for w in words):
        return 2
    return int(len(keyword) >= 5 and any(w[:5] == keyword[:5] for w in words))


def expand(keywords: list[str]) -> list[str]:
    """Keywords, then the members of all synonym groups that they touch, up to the limit."""
    out = list(keywords)
    for k in keywords:
        for group in SYNONYMS:
            if any(m == k or level(words_of(m), k) or level(words_of(k), m) for m in group):
                out += [m for m in group if m not in out]
    return out[:MOST_KEYWORDS]


def file_reasons(path: str, keywords: list[str], framework: bool, hub: int | None, recent: bool = False, changed: bool = False) -> list[str]:
    out = [f"path matches keyword `{k}`" for k in keywords if level(words_of(path), k)]
    out += ["framework-relevant directory"] * framework + ["modified recently"] * recent
    out += [f"imported by {hub} files (hub)"] if (hub or 0) >= 2 else []
    return without_runs(out + ["modified in working tree"] * changed)


def symbol_reasons(name: str, signature: str, path: str, keywords: list[str]) -> list[str]:
    out = []
    for k in keywords:
        own = level(words_of(name), k)
        if own:
            out.append({3: f"exact symbol match `{name}`", 2: f"symbol contains keyword `{k}`", 1: f"symbol matches `{k}` by prefix"}[own])
            continue
        out += [f"signature mentions `{k}`"] * bool(level(words_of(signature), k)) + [f"path matches keyword `{k}`"] * bool(level(words_of(path), k))
    return without_runs(out)
