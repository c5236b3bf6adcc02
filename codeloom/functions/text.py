"""Tokens, matches and path predicates as columns; all of them stay in generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.fixed import FRAMEWORK_DIRECTORIES, LANGUAGE_OF, STOP_WORDS


def like_any(column: Column, needle: str) -> Column:
    """Case-insensitive literal substring."""
    for c in "\\%_":
        needle = needle.replace(c, "\\" + c)
    return column.ilike(f"%{needle}%")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often use refers to it: inside a lambda it is a variable, which
    the optimizer cannot replace by its expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def task_words(text: Column) -> Column:
    """Lower-case words of two bytes and more without stop words; consecutive repeats count once."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (F.octet_length(w) > 1) & ~w.isin(*STOP_WORDS))
    return bound(words, lambda ws: F.filter(ws, lambda w, i: (i == 0) | (w != F.get(ws, i - 1))))


def name_words(text: Column) -> Column:
    """Lower-case words of an identifier or path, split at case and digit changes; runs of capitals stay together."""
    split = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([a-z])([0-9])", "$1 $2")
    return F.filter(F.split(F.lower(split), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def match_level(words: Column, keyword: str) -> Column:
    """3 equal, 2 at the start or end of a longer word, 1 with a common stem of five characters, 0 none."""
    level = F.when(F.array_contains(words, keyword), 3)
    if len(keyword.encode()) >= 4:
        level = level.when(F.exists(words, lambda w: (F.octet_length(w) > len(keyword.encode())) & (w.startswith(keyword) | w.endswith(keyword))), 2)
    if len(keyword) >= 5:
        level = level.when(F.exists(words, lambda w: F.substring(w, 1, 5) == keyword[:5]), 1)
    return level.otherwise(0)


def is_test(path: Column) -> Column:
    base = F.element_at(F.split(path, "/"), -1)
    return F.exists(F.split(path, "/"), lambda s: s.isin("test", "tests", "__tests__")) | base.rlike(r"(\.test\.(ts|tsx|js|jsx)|\.spec\.(ts|js)|_test\.(py|go))$") | base.startswith("test_")


def is_excluded(path: Column, excludes: list[str]) -> Column:
    names = F.array(*(F.lit(x.rstrip("/")) for x in excludes))
    hit = F.exists(F.split(path, "/"), lambda s: F.array_contains(names, s))
    for x in excludes:
        hit = hit | (path == x) | path.endswith("/" + x)
    return hit


def framework_bonus(path: Column) -> Column:
    known = F.array(*map(F.lit, FRAMEWORK_DIRECTORIES))
    return F.size(F.filter(F.split(F.lower(path), "/"), lambda s: F.array_contains(known, s))) * F.lit(0.5)


def language(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in LANGUAGE_OF.items() for x in pair))
    return known[F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))]


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.octet_length(text) / 4)).cast("long")


def hub_bonus(rows: Column) -> Column:
    return F.log(rows + 1) * F.lit(0.25)
