"""Parsers, resolution, the store and context packages over small source trees."""

import json
import os

import pytest
from pyspark.sql import functions as F

from codeloom.functions import words
from codeloom.operators import indexing, lookup
from codeloom.parsers import parse
from codeloom.plans import package
from codeloom.sources import scan
from codeloom.sources.store import Store

TREE = {
    "src/store/models.py": "from datetime import date\nfrom src.store.format import as_text\n\nclass Customer:\n    kind = 'x'\n\n    def label(self):\n        return as_text(self)\n\ndef make_customer(n):\n    return Customer(n)\n",
    "src/store/format.py": "def as_text(v):\n    return str(v)\n",
    "src/store/__init__.py": "",
    "src/main.py": "from .store import models\nimport src.store\nimport os\n",
    "web/app.ts": 'import { Page } from "./page";\nimport * as lib from "@/web/lib";\nimport tools from "@acme/tools";\nexport function start(): void { lib.go(); }\n',
    "web/page.tsx": "export class Page { private open = 1; draw() { return this.open; } }\n",
    "web/lib/index.js": "export const go = () => { return require('../page'); };\n",
    "packages/tools/package.json": json.dumps({"name": "@acme/tools", "main": "lib/entry.js"}),
    "packages/tools/lib/entry.js": "module.exports = 1;\n",
    "package.json": json.dumps({"workspaces": ["packages/*"]}),
    "src/graph.rs": "use crate::shape::{Point, Line as L};\nuse std::fmt;\npub fn run() -> i32 { 1 }\n",
    "src/shape/mod.rs": "pub struct Point { pub x: f64 }\nimpl Point { fn len(&self) -> f64 { self.x } }\n",
    "go.mod": "module example.org/m\n",
    "cmd/run.go": 'package main\nimport (\n\t"fmt"\n\tu "example.org/m/util"\n)\nfunc main() { fmt.Println(u.X) }\n',
    "util/b.go": "package util\nconst X = 1\n",
    "util/a.go": "package util\ntype T struct { A, B int }\nfunc (t *T) Sum() int { return t.A }\n",
    "notes.txt": "no language",
    ".gitignore": "skipped/\n*.gen.py\n!keep.gen.py\n",
    "skipped/a.py": "x = 1\n",
    "b.gen.py": "x = 1\n",
    "keep.gen.py": "y = 1\n",
    "node_modules/m/i.js": "var a = 1\n",
    "broken.js": "function broken() {\n  if (true) {\n    return 1;",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def indexed(spark, tree):
    store = Store(spark, tree + "/.ctx/index")
    return store, indexing.run_index(spark, tree, store)


def test_scan_honours_ignore_files(tree):
    found = {p for p, *_ in scan.walk(tree)}
    assert {"src/main.py", "keep.gen.py", "web/page.tsx"} <= found
    assert not {p for p in found if p.startswith(("skipped", "node_modules")) or p in ("b.gen.py", "notes.txt")}


def test_index_and_resolution(indexed):
    store, report = indexed
    assert report["parsed_files"] == report["total_files"] == report["new_files"] and report["parse_errors"] == 1
    g = store.graph()
    names = {r.id: r.path for r in g.files.collect()}
    edges = {(names[r.source_file_id], r.source_raw, r.imported_symbol): (names.get(r.target_file_id), r.resolution) for r in g.dependencies.collect()}
    want = {
        ("src/store/models.py", "src.store.format", "as_text"): "src/store/format.py",
        ("src/main.py", "store", "models"): "src/store/__init__.py",
        ("src/main.py", "src.store", None): "src/store/__init__.py",
        ("web/app.ts", "./page", "Page"): "web/page.tsx",
        ("web/app.ts", "@/web/lib", "*"): "web/lib/index.js",
        ("web/app.ts", "@acme/tools", "tools"): "packages/tools/lib/entry.js",
        ("web/lib/index.js", "../page", None): "web/page.tsx",
        ("src/graph.rs", "crate::shape::Point", "Point"): "src/shape/mod.rs",
        ("cmd/run.go", "example.org/m/util", None): "util/a.go",
    }
    for key, target in want.items():
        assert edges[key] == (target, "internal"), key
    for key in [("src/main.py", "os", None), ("src/graph.rs", "std::fmt", "fmt"), ("cmd/run.go", "fmt", None), ("src/store/models.py", "datetime", "date")]:
        assert edges[key] == (None, "external")
    kinds = {(r.name, r.kind, r.parent) for r in g.symbols.collect()}
    assert {("Customer", "class", None), ("kind", "field", "Customer"), ("label", "method", "Customer"), ("open", "field", "Page"), ("draw", "method", "Page"), ("go", "function", None), ("Point", "impl", None),
            ("len", "method", "Point"), ("x", "field", "Point"), ("Sum", "method", "T"), ("B", "field", "T"), ("X", "constant", None), ("broken", "function", None)} <= kinds


def test_incremental_run(spark, tree, indexed):
    store, _ = indexed
    again = indexing.run_index(spark, tree, store)
    assert again["parsed_files"] == 0 and again["unchanged_files"] == again["total_files"]
    open(tree + "/extra.py", "w").write("from src.main import f\nEXTRA = 1\n")
    os.utime(tree + "/web/page.tsx", (1, 1))
    more = indexing.run_index(spark, tree, store)
    assert more["parsed_files"] == 1 and more["metadata_only"] == 1
    assert indexing.freshness(spark, tree, store)["status"] == "READY"
    os.remove(tree + "/extra.py")
    assert indexing.freshness(spark, tree, store)["status"] == "STALE"
    gone = indexing.index_paths(spark, tree, store, spark.createDataFrame([("extra.py",)], "path string"))
    assert gone["deleted_files"] == 1 and not store.table("symbols").filter("name = 'EXTRA'").count()
    assert store.table("files").count() == again["total_files"]


def test_context_package(indexed):
    store, _ = indexed
    g = store.graph()
    sources = g.files.select("path", F.col("skeleton").alias("text"))
    got = package.build_context(g, "Add a label to the customer", sources)
    paths = [f["path"] for f in got["relevant_files"]]
    assert paths[0] == "src/store/models.py" and "src/store/format.py" in paths and not got["budget_exceeded"]
    assert "src/store/format.py" in got["relevant_dependencies"] and got["architecture"][-1] == "..."
    assert "return as_text" not in got["suggested_context"]
    small = package.build_context(g, "customer label", sources, max_tokens=1)
    assert len(small["relevant_files"]) >= 1 and small["budget_exceeded"]


def test_targets(indexed):
    g = indexed[0].graph()
    assert [r.path for r in lookup.resolve_file(g, "shape").collect()] == ["src/shape/mod.rs"]
    assert lookup.resolve_target(g, "Page.draw").first().path == "web/page.tsx"
    assert lookup.resolve_target(g, "as_text").first().symbol == "as_text"
    assert [(r.name, r.parent) for r in lookup.resolve_symbol(g, "Customer.label").collect()] == [("label", "Customer")]


def test_words():
    assert words.tokenize("Fix the Login login of user_a!") == ["fix", "login", "user"]
    assert words.words_of("parseHTTPServer2.x") == ["parse", "httpserver", "2", "x"]
    assert "authenticate" in words.expand(["login"]) and len(words.expand(["login", "user", "config", "test", "error", "plan", "export"])) <= 40


@pytest.mark.parametrize("language,text,hidden,kept", [
    ("python", 'def f(x):\n    """Say."""\n    return x + 41\n\nif __name__ == "__main__":\n    f(77)\n', ["41", "77"], ['"""Say."""', "def f(x):", "..."]),
    ("typescript", "class A { b(): {x: string} { return {x: 'q41'}; } }\nif (1) { keep(); }\n", ["q41"], ["keep()"]),
    ("rust", "impl A { fn b(&self) -> i32 { 41 } }\nstruct S { x: i32 }\n", ["41"], ["x: i32"]),
    ("go", "type S struct { X int }\nfunc (s S) F() int { return 41 }\n", ["41"], ["X int"]),
])
def test_skeleton(language, text, hidden, kept):
    out = parse("a", text, language)["skeleton"]
    assert all(k in out for k in kept) and not any(h in out for h in hidden)


def test_empty_and_broken():
    for language in ("python", "typescript", "javascript", "rust", "go"):
        for text in ("", "\n", "}", "{{{", '"', "'''", "class", "def", "fn", "func (", "type (", "import (", "use a::{", "/*", "`"):
            parse("a/b", text, language)


def test_registered_language(spark):
    """A language that is added to the registry is found, parsed by the tasks, and can be taken away again."""
    from codeloom import parsers
    from codeloom.functions.fixed import LANGUAGE_OF

    def ini(path, text, go_module, packages):
        rows = [(line[1:-1], n) for n, line in enumerate(text.split("\n"), 1) if line.startswith("[")]
        fields = {k: None for k in ("signature", "parent", "visibility", "exported", "start_byte", "end_byte")}
        return {"symbols": [{**fields, "name": name, "kind": "module", "start_line": n, "end_line": n} for name, n in rows]}

    parsers.register("ini", [".ini"], ini)
    try:
        assert scan.language_of("a/b.INI") == "ini"
        sources = spark.createDataFrame([("b.ini", "ini", bytearray(b"[one]\nx = 1\n[two]\n")), ("c.x", "none", bytearray(b""))], "path string, language string, content binary")
        found = parsers.parse_sources(sources).collect()
        assert [(s.name, s.start_line) for s in found[0].symbols] == [("one", 1), ("two", 3)] and len(found) == 1 and found[0].imports == []
    finally:
        del parsers.PARSERS["ini"], LANGUAGE_OF["ini"]
