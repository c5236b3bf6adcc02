"""Source trees: a scan that honours ignore files, contents read by executors, and project manifests."""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.fixed import EXCLUDED, LANGUAGE_OF, MAX_FILE_SIZE, MAX_FILES, MAX_TOKENS, PROBED_ENDINGS

LISTING = "path string, language string, size long, mtime long"
DEFAULTS = {"index": {"exclude": EXCLUDED, "max_file_size": MAX_FILE_SIZE, "follow_symlinks": False}, "context": {"max_tokens": MAX_TOKENS, "max_files": MAX_FILES, "include_bodies": False}, "watch": {"enabled": True, "debounce_ms": 200}}


def load_config(root: str) -> dict:
    """Settings of .ctx/config.toml over the defaults; a missing file gives the defaults, an invalid one an error."""
    out = {k: dict(v) for k, v in DEFAULTS.items()}
    try:
        with open(f"{root}/.ctx/config.toml", "rb") as f:
            for section, values in tomllib.load(f).items():
                out.setdefault(section, {}).update(values)
    except FileNotFoundError:
        pass
    return out


def language_of(path: str) -> str | None:
    return LANGUAGE_OF.get(path.rpartition(".")[2].lower()) if "." in os.path.basename(path) else None


def _pattern(line: str, folder: str) -> tuple[re.Pattern, bool, bool] | None:
    """(regex over project paths, negated, folders only) of one ignore line in a folder."""
    line = line.rstrip("\n").rstrip() if not line.rstrip("\n").endswith("\\ ") else line.rstrip("\n")
    if not line or line.startswith("#"):
        return None
    negated, line = line.startswith("!"), line.removeprefix("!")
    only, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.lstrip("/")
    out = ""
    for part in re.findall(r"\*\*/|/\*\*|\*\*|\*|\?|\[!?[^\]]*\]|\\.|.", line):
        out += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part.replace("[!", "[^", 1) if part[0] == "[" and len(part) > 1 else re.escape(part[-1]))
    base = re.escape(folder + "/") if folder else ""
    return re.compile(base + ("" if anchored else "(?:.*/)?") + out + r"\Z"), negated, only


def _rules(file: str, folder: str) -> list:
    try:
        with open(file, encoding="utf-8", errors="replace") as f:
            return [p for p in (_pattern(line, folder) for line in f) if p]
    except OSError:
        return []


def excluded(path: str, excludes: list[str]) -> bool:
    parts = path.split("/")
    return any(e in parts or path == e or path.endswith("/" + e) or (e.endswith("/") and parts[-1] == e[:-1]) for e in excludes)


def walk(root: str, excludes: list[str] | None = None, follow: bool = False) -> Iterator[tuple[str, str, int, int]]:
    """(path, language, size, mtime) of the sources under a root. Hidden files, ignored ones and excluded ones are left
    out; the last rule that matches decides, and an ignored folder isn't entered."""
    excludes = EXCLUDED if excludes is None else excludes

    def visit(folder: str, rules: list) -> Iterator[tuple[str, str, int, int]]:
        at = os.path.join(root, folder)
        rules = rules + _rules(os.path.join(at, ".ignore"), folder) + _rules(os.path.join(at, ".gitignore"), folder)
        for entry in sorted(os.scandir(at), key=lambda x: x.name):
            path = f"{folder}/{entry.name}" if folder else entry.name
            is_dir = entry.is_dir(follow_symlinks=follow)
            if entry.name.startswith(".") or excluded(path, excludes):
                continue
            verdict = next((not negated for p, negated, only in reversed(rules) if (is_dir or not only) and p.match(path)), False)
            if verdict:
                continue
            if is_dir:
                yield from visit(path, rules)
            elif entry.is_file(follow_symlinks=follow) and (language := language_of(path)):
                s = entry.stat()
                yield path, language, s.st_size, int(s.st_mtime)

    yield from visit("", _rules(os.path.join(root, ".git/info/exclude"), ""))


def entry(root: str, path: str, excludes: list[str] | None = None, follow: bool = False) -> tuple[str, str, int, int] | None:
    """What walk would give for one path, or None; only the folders above it are looked at."""
    excludes, rules, parts = EXCLUDED if excludes is None else excludes, _rules(os.path.join(root, ".git/info/exclude"), ""), path.split("/")
    for k, name in enumerate(parts):
        folder, sub = "/".join(parts[:k]), "/".join(parts[: k + 1])
        rules = rules + _rules(os.path.join(root, folder, ".ignore"), folder) + _rules(os.path.join(root, folder, ".gitignore"), folder)
        is_dir = k < len(parts) - 1
        if name.startswith(".") or excluded(sub, excludes) or (not follow and os.path.islink(os.path.join(root, sub))):
            return None
        if next((not negated for p, negated, only in reversed(rules) if (is_dir or not only) and p.match(sub)), False):
            return None
    full = os.path.join(root, path)
    language = language_of(path)
    if language is None or not os.path.isfile(full):
        return None
    s = os.stat(full)
    return path, language, s.st_size, int(s.st_mtime)


def scan(spark: SparkSession, root: str, config: dict | None = None) -> DataFrame:
    """The listing of a tree. The driver lists one project; a table of many projects comes as a relation instead."""
    index = (config or DEFAULTS)["index"]
    return spark.createDataFrame(list(walk(root, index["exclude"], index["follow_symlinks"])), LISTING)


def contents(listing: DataFrame, root: str) -> DataFrame:
    """Adds content, read by the executors from the shared path; a file that can't be read is left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, keep = [], []
            for k, path in enumerate(batch["path"].to_pylist()):
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        got.append(f.read())
                    keep.append(k)
                except OSError:
                    continue
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(got, pa.binary())], names=[*kept.schema.names, "content"])

    return listing.select("path", "language", "size", "mtime").mapInArrow(read, LISTING + ", content binary").withColumn("hash", F.sha2("content", 256))


def go_module(root: str) -> str | None:
    try:
        with open(f"{root}/go.mod", encoding="utf-8") as f:
            return next((line.split()[1] for line in f if line.startswith("module ") and len(line.split()) > 1), None)
    except OSError:
        return None


def _json(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
        return got if isinstance(got, dict) else {}
    except (OSError, ValueError):
        return {}


def workspace_packages(root: str) -> dict[str, list[str]]:
    """Entry candidates of each workspace package, by its name; the first folder with a name has it."""
    spaces = _json(f"{root}/package.json").get("workspaces")
    spaces = spaces.get("packages") if isinstance(spaces, dict) else spaces
    out: dict[str, list[str]] = {}
    for space in spaces if isinstance(spaces, list) else []:
        base = str(space).rstrip("*").rstrip("/")
        if not base or not os.path.isdir(f"{root}/{base}"):
            continue
        for member in sorted(os.listdir(f"{root}/{base}")):
            package = _json(f"{root}/{base}/{member}/package.json")
            if not package.get("name"):
                continue
            ways = [package.get(k) for k in ("main", "module", "types")]
            exports = package.get("exports")
            ways += [exports.get(k) for k in ("import", "require", ".")] if isinstance(exports, dict) else [exports]
            ways = [w for w in ways if isinstance(w, str)] + [f"src/index.{e}" for e in ("ts", "tsx", "js", "jsx")]
            paths = [p for w in ways for p in ([w] if "." in w.removeprefix("./") else [w] + [f"{w}.{e}" for e in PROBED_ENDINGS])]
            out.setdefault(package["name"], [os.path.normpath(f"{base}/{member}/{p}") for p in paths])
    return out
