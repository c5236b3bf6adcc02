"""A project and the questions that the command line and the tool server ask of it; answers are plain JSON values."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import parsers
from codeloom.functions.fixed import CARGO_FRAMEWORKS, FRAMEWORKS, LANGUAGE_NAMES, MAX_TOKENS, PACKAGE_MANAGERS
from codeloom.operators import history, indexing, lookup
from codeloom.parsers.skeleton import stats as skeleton_stats
from codeloom.plans import package
from codeloom.sources import scan
from codeloom.sources.git import Repository
from codeloom.sources.store import Store, ddl

VERSION = "0.1.0"
FOLDER = ".ctx"


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def human_bytes(n: int) -> str:
    size, units = float(n), ["B", "KB", "MB", "GB", "TB"]
    while size >= 1024 and len(units) > 1:
        size, units = size / 1024, units[1:]
    return f"{n} B" if units[0] == "B" else f"{size:.1f} {units[0]}"


class Project:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.root = spark, os.path.realpath(folder)
        at = self.root
        while at != os.path.dirname(at):
            if os.path.isdir(f"{at}/{FOLDER}"):
                self.root = at
                break
            at = os.path.dirname(at)
        self.store = Store(spark, f"file://{self.root}/{FOLDER}/index")

    def inside(self, path: str) -> str:
        """The project path of a file; an error if it leaves the root."""
        full = os.path.realpath(os.path.join(self.root, path))
        if full != self.root and not full.startswith(self.root + os.sep):
            raise ValueError(f"outside the project: {path}")
        return os.path.relpath(full, self.root)

    def graph(self):
        if not self.store.versions():
            raise ValueError("no index: run init first")
        return self.store.graph()

    def init(self, force: bool = False) -> dict:
        os.makedirs(f"{self.root}/{FOLDER}", exist_ok=True)
        if not os.path.exists(path := f"{self.root}/{FOLDER}/config.toml"):
            d = scan.DEFAULTS
            with open(path, "w", encoding="utf-8") as f:
                f.write(f"[index]\nexclude = {d['index']['exclude']!r}\nmax_file_size = {d['index']['max_file_size']}\nfollow_symlinks = false\n\n[context]\nmax_tokens = {MAX_TOKENS}\nmax_files = {d['context']['max_files']}\ninclude_bodies = false\n\n[watch]\nenabled = true\ndebounce_ms = 200\n")
        ignore = f"{self.root}/.gitignore"
        text = open(ignore, encoding="utf-8").read() if os.path.exists(ignore) else ""
        if f"{FOLDER}/" not in text.split():
            with open(ignore, "a", encoding="utf-8") as f:
                f.write(("" if not text or text.endswith("\n") else "\n") + f"{FOLDER}/\n")
        return indexing.run_index(self.spark, self.root, self.store, force=force)

    def search(self, term: str, kind: str | None = None, limit: int = 50, files: bool = False) -> list[dict]:
        g = self.graph()
        return rows(lookup.files_like(g, term, max(1, min(500, limit))) if files else lookup.search(g, term, kind, limit))

    def symbol(self, name: str) -> list[dict]:
        """All symbols that a name means (at most 200), each with its members, references and dependencies."""
        g = self.graph()
        found = rows(lookup.resolve_symbol(g, name))
        out = [{"name": s["name"], "kind": s["kind"], "signature": s["signature"], "file": s["path"], "line": s["start_line"], "methods": [], "references": [], "dependencies": []} for s in found]
        place = {s["id"]: k for k, s in enumerate(found)}
        if found:
            wanted = self.spark.createDataFrame([(s["id"], s["file_id"], s["name"], s["parent"]) for s in found], "id long, file_id long, name string, parent string")
            order = {"methods": ("start_line", "member"), "references": ("path", "imported_symbol"), "dependencies": ("path", "imported_symbol")}
            for kind, df in lookup.details(g, wanted).items():
                for r in rows(df.orderBy(*order[kind])):
                    out[place[r.pop("id")]][kind].append(r if kind == "methods" else [r["path"], r["imported_symbol"]])
        return out

    def _file(self, name: str):
        found = lookup.resolve_file(self.graph(), name).first()
        if found is None:
            raise ValueError(f"no such file in the index: {name}")
        return found

    def deps(self, name: str, external: bool = False) -> dict:
        file, g = self._file(name), self.graph()
        return {"file": file.path, "dependencies": rows(lookup.outgoing(g, file.id, external).orderBy("path")), "dependents": rows(lookup.incoming(g, file.id).orderBy("path"))}

    def impact(self, target: str, depth: int = 3) -> dict:
        g = self.graph()
        found = lookup.resolve_target(g, target).first()
        if found is None:
            raise ValueError(f"nothing is called {target}")
        depth = max(1, min(20, depth))
        hit = rows(lookup.impact(g, found.id, depth).orderBy("distance", "path"))
        out = {b: [h for h in hit if h["bucket"] == b] for b in ("direct", "indirect", "tests")}
        names = g.files.select(F.col("id").alias("source_file_id"), "path")
        return {"target": found.path, "symbol": found.symbol, "depth": depth, **out, "unknown": rows(lookup.unknown(g, found.id, depth).join(names, "source_file_id").select("path", "unresolved").orderBy("path")),
                "total_files": len(hit), "total_symbols": sum(h["symbols"] for h in hit)}

    def context(self, task: str, max_tokens: int | None = None, bodies: bool = False) -> dict:
        g, config = self.graph(), scan.load_config(self.root)["context"]
        sources = g.files.select("path", F.col("skeleton").alias("text"))
        if bodies:
            sources = scan.contents(g.files, self.root).select("path", F.decode("content", "UTF-8").alias("text"))
        try:
            changed = [(c.path,) for c in Repository(self.root).changes()]
        except Exception:  # not a repository, or no git: no file counts as changed
            changed = []
        recent = [(path,) for path, _, _, mtime in scan.walk(self.root, scan.load_config(self.root)["index"]["exclude"]) if mtime > int(self.store.built())]
        changes, late = (self.spark.createDataFrame(x, "path string") if x else None for x in (changed, recent))
        return package.build_context(g, task, sources, max_tokens or config["max_tokens"], config["max_files"], changes, late)

    def skeleton(self, path: str) -> dict:
        path = self.inside(path)
        language = scan.language_of(path)
        if language is None:
            raise ValueError(f"unknown language: {path}")
        with open(f"{self.root}/{path}", encoding="utf-8", errors="replace") as f:
            text = f.read()
        short = parsers.parse(path, text, language)["skeleton"]
        return {"path": path, "language": language, "skeleton": short, "stats": skeleton_stats(text, short)}

    def repository(self) -> Repository | None:
        try:
            return Repository(self.root)
        except Exception:  # not a repository, or no git
            return None

    def sync(self) -> dict | None:
        """Brings an index up to date with the files that version control calls changed."""
        repository = self.repository()
        return indexing.sync_changed(self.spark, repository, self.root, self.store) if repository and self.store.versions() else None

    def changed(self, ref: str | None = None) -> list[dict]:
        self.sync()
        return rows(history.symbol_diff(self.spark, Repository(self.root), ref)[1].orderBy("path", "line"))

    def diff(self, base: str | None = "HEAD", head: str | None = None) -> dict:
        base = base or "HEAD"
        changes, symbols, large = history.symbol_diff(self.spark, Repository(self.root), base, head)
        found = rows(symbols)
        touched = {s["path"] for s in found} | {c.path for c in changes if c.status in "AD"}
        impact = rows(lookup.diff_impact(self.graph(), self.spark.createDataFrame([(p,) for p in sorted(touched)], "path string"))) if touched and self.store.versions() else []
        count = {s: sum(x["status"] == s for x in found) for s in ("Added", "Modified", "Removed")}
        return {"files": [vars(c) for c in changes], "symbols": found, "counts": count, "potential_impact": [i["path"] for i in impact], "large_changes": large}

    def stats(self) -> dict:
        g = self.graph()
        languages = [r.language for r in g.files.select("language").distinct().orderBy("language").collect()]
        size = self.store.size()
        return {"root": self.root, "files": g.files.count(), "symbols": g.symbols.count(), "dependencies": g.dependencies.count(), "index_bytes": size, "index_size": human_bytes(size), "languages": languages}

    def summary(self) -> dict:
        """Root, version control and counts."""
        repository, out = self.repository(), self.stats()
        return {"root": self.root, "git": repository is not None, "git_root": repository.root if repository else None, **{k: out[k] for k in ("files", "symbols", "dependencies", "languages")}}

    def doctor(self) -> dict:
        """Status (NOT_INITIALIZED, CORRUPT, CONFIG, STALE or READY) with what it rests on, and warnings."""
        warnings, config_ok, repository = [], True, self.repository()
        try:
            scan.load_config(self.root)
        except Exception as error:
            config_ok = False
            warnings.append(f"could not read {FOLDER}/config.toml: {error}; using defaults")
        begun = bool(self.store.versions())
        if begun and not os.path.exists(f"{self.root}/{FOLDER}/config.toml"):
            warnings.append(f"{FOLDER}/config.toml missing; using defaults - run init to rewrite it")
        index, database, languages = {"initialized": begun, "fresh": not begun}, None, []
        if begun:
            try:
                database = indexing.integrity(self.store)
                found = indexing.freshness(self.spark, self.root, self.store, None if config_ok else scan.DEFAULTS)
                g = self.store.graph()
                index |= {"fresh": found["status"] == "READY", "files": g.files.count(), "symbols": g.symbols.count(), "dependencies": g.dependencies.count(), "stale_files": found["check"] + found["deleted"], "unindexed_files": found["new"]}
                languages = [r.language for r in g.files.select("language").distinct().collect()]
                if not database["healthy"]:
                    warnings.append("the index has rows without their files; run init --force to rebuild it")
            except Exception as error:
                database = {"healthy": False, "schema_version": 0}
                warnings.append(f"could not read the index: {str(error)[:300]}; run init --force to rebuild it")
        else:
            languages = [LANGUAGE_NAMES[x] for x in {language for _, language, _, _ in scan.walk(self.root)}]
        corrupt = database is not None and database["schema_version"] == 0
        status = "NOT_INITIALIZED" if not begun else "CORRUPT" if corrupt else "CONFIG" if not config_ok else "READY" if index["fresh"] else "STALE"
        if status == "STALE":
            warnings.append("run init to bring the index up to date")
        return {"root": self.root, "git": repository is not None, "git_root": repository.root if repository else None, "languages": sorted(languages), "framework": self.framework(), "package_manager": next((v for k, v in PACKAGE_MANAGERS.items() if os.path.isfile(f"{self.root}/{k}")), None),
                "index": index, "database": database, "parser_support": [{"language": x, "supported": True} for x in LANGUAGE_NAMES.values()], "status": status, "warnings": warnings}

    def framework(self) -> str | None:
        """Named by package.json, or else by Cargo.toml."""
        if os.path.isfile(f"{self.root}/package.json"):
            try:
                with open(f"{self.root}/package.json", encoding="utf-8") as f:
                    found = json.load(f)
                names = {n for k in ("dependencies", "devDependencies") if isinstance(found.get(k), dict) for n in found[k]}
            except (OSError, ValueError, AttributeError):
                return None
            return next((v for k, v in FRAMEWORKS.items() if k in names), None)
        try:
            with open(f"{self.root}/Cargo.toml", encoding="utf-8", errors="replace") as f:
                text = f.read()
        except OSError:
            return None
        return next((v for k, v in CARGO_FRAMEWORKS.items() if f"{k} " in text or f"\n{k}=" in text), None)

    def schema(self) -> str:
        return ddl()

    def benchmark(self) -> dict:
        """Seconds of the main steps; the upper median of three for opening."""
        def clock(f) -> float:
            began = time.perf_counter()
            f()
            return time.perf_counter() - began

        opened = sorted(clock(self.store.graph) for _ in range(3))
        return {"open": opened[len(opened) // 2], "index": clock(lambda: self.init(True)), "stats": clock(self.stats), "search": clock(lambda: self.search("main", limit=10)), "context": clock(lambda: self.context("main entry point")),
                "skeletons": sum(clock(lambda path=r.path: self.skeleton(path)) for r in self.graph().files.orderBy("path").limit(5).collect())}
