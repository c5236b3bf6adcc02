"""A project from the outside: git states, the command line, the tool server and the watcher."""

import json
import os
import shutil
import subprocess
import time

import pytest

from codeloom import __main__ as command
from codeloom import terminal
from codeloom.api import Project
from codeloom.serve import answer
from codeloom.sources import scan
from codeloom.sources.git import Repository
from codeloom.streaming import watch


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / "src").mkdir()
    (root / "src/base.ts").write_text("export function one() { return 1; }\nexport function two() { return 2; }\n")
    (root / "src/user.ts").write_text('import { one } from "./base";\nexport class User { show() { return one(); } }\n')
    (root / "src/old.ts").write_text("export const gone = 1;\n")
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=root, check=True, capture_output=True)
    git("init", "-q"), git("add", "."), git("commit", "-qm", "first")
    p = Project(spark, str(root))
    p.init()
    return p


def write(project, path, text):
    with open(f"{project.root}/{path}", "w") as f:
        f.write(text)


def test_questions(project):
    assert {s["name"] for s in project.search("o")} >= {"one", "two", "show"}
    with pytest.raises(ValueError):
        project.search("o", "nothing")
    assert [d["path"] for d in project.deps("src/user.ts")["dependencies"]] == ["src/base.ts"]
    assert [d["path"] for d in project.impact("src/base.ts")["direct"]] == ["src/user.ts"]
    found = project.symbol("User")
    assert [m["name"] for m in found[0]["methods"]] == ["show"] and found[0]["dependencies"] == [["src/base.ts", "one"]]
    assert project.symbol("one")[0]["references"] == [["src/user.ts", "one"]] and project.symbol("nothing") == []
    assert project.stats()["languages"] == ["typescript"] and project.doctor()["status"] == "READY"
    assert "return 1" not in project.skeleton("src/base.ts")["skeleton"]
    with pytest.raises(ValueError):
        project.skeleton("../../etc/passwd.py")
    assert project.context("show the user")["relevant_files"][0]["path"] == "src/user.ts"


def test_git_states(project):
    write(project, "src/base.ts", "export function one() { return 1; }\nexport function two(x) { return x; }\nexport function three() { return 3; }\n")
    write(project, "src/new.ts", "export const fresh = 1;\n")
    subprocess.run(["rm", f"{project.root}/src/old.ts"], check=True)
    found = {(c.path, c.status) for c in Repository(project.root).changes()}
    assert {("src/base.ts", "M"), ("src/new.ts", "A"), ("src/old.ts", "D")} <= found
    got = {(s["path"], s["symbol"], s["status"]) for s in project.changed()}
    assert got == {("src/base.ts", "two", "Modified"), ("src/base.ts", "three", "Added"), ("src/new.ts", "fresh", "Added"), ("src/old.ts", "gone", "Removed")}
    out = project.diff()  # one revision leaves untracked files out
    assert out["counts"] == {"Added": 1, "Modified": 1, "Removed": 1} and out["potential_impact"] == ["src/user.ts"]
    assert not any(c["path"] == "src/new.ts" for c in out["files"])
    assert Repository(project.root).changes(untracked=False) == [c for c in Repository(project.root).changes() if c.path not in ("src/new.ts", ".gitignore")]
    with pytest.raises(ValueError):
        project.diff("--output=x")


def test_sync(spark, project):
    """Asking for changes has brought the index up to date with them; putting the tree back does so again."""
    assert project.search("three") and project.search("fresh") and not project.search("gone")
    subprocess.run(["git", "stash", "-uq"], cwd=project.root, check=True, env={"GIT_AUTHOR_NAME": "t", "GIT_AUTHOR_EMAIL": "t@t", "GIT_COMMITTER_NAME": "t", "GIT_COMMITTER_EMAIL": "t@t", "PATH": "/usr/bin:/bin:/usr/local/bin"})
    project.init()
    assert project.search("gone") and not project.search("fresh")
    os.remove(f"{project.root}/.gitignore")  # init has written it again
    subprocess.run(["git", "stash", "pop", "-q"], cwd=project.root, check=True)


def test_context_signals(spark, project):
    """A file that was changed after the index was built says so, and its score has both points."""
    before = {f["path"]: f for f in project.context("show the user")["relevant_files"]}
    os.utime(f"{project.root}/src/user.ts", (time.time() + 60,) * 2)
    after = {f["path"]: f for f in project.context("show the user")["relevant_files"]}
    assert after["src/user.ts"]["score"] == pytest.approx(before["src/user.ts"]["score"] + 2.0)
    assert "modified recently" in after["src/user.ts"]["reasons"]
    assert "imported by a relevant file (dependency)" in after["src/base.ts"]["reasons"] and "modified in working tree" not in after["src/user.ts"]["reasons"]
    os.utime(f"{project.root}/src/user.ts", (0, 0))


def test_one_path(project):
    """One path is judged as the walk over the tree judges it."""
    for path, text in ((".gitignore", ".ctx/\nskip/\n*.gen.ts\n"), ("skip/a.ts", "x"), ("src/b.gen.ts", "x"), ("src/.hidden.ts", "x"), ("notes.txt", "x")):
        os.makedirs(os.path.dirname(f"{project.root}/{path}"), exist_ok=True)
        write(project, path, text)
    listed = {x[0]: x for x in scan.walk(project.root)}
    for path in ("src/base.ts", "src/user.ts", "skip/a.ts", "src/b.gen.ts", "src/.hidden.ts", "notes.txt", "src/none.ts", ".ctx/config.toml"):
        assert scan.entry(project.root, path) == listed.get(path), path
    for path in ("skip/a.ts", "src/b.gen.ts", "src/.hidden.ts", "notes.txt"):
        os.remove(f"{project.root}/{path}")


def test_doctor(spark, project, tmp_path):
    (tmp_path / "package.json").write_text('{"devDependencies": {"jest": "1"}, "dependencies": {"express": "1", "vue": "3"}}')
    (tmp_path / "yarn.lock").write_text("")
    (tmp_path / "a.py").write_text("def f():\n    return 1\n")
    p = Project(spark, str(tmp_path))
    out = p.doctor()
    assert (out["status"], out["framework"], out["package_manager"], out["languages"]) == ("NOT_INITIALIZED", "Vue", "yarn", ["Python"])
    p.init()
    out = p.doctor()
    assert out["status"] == "READY" and out["database"]["healthy"] and out["index"]["files"] == 1 and not out["git"]
    os.remove(tmp_path / ".ctx/config.toml")
    assert any("missing" in w for w in p.doctor()["warnings"])
    (tmp_path / ".ctx/config.toml").write_text("not toml [")
    assert p.doctor()["status"] == "CONFIG"
    (tmp_path / ".ctx/config.toml").write_text("")
    (tmp_path / "b.py").write_text("x = 1\n")
    assert p.doctor()["status"] == "STALE" and p.doctor()["index"]["unindexed_files"] == 1
    version = p.store.versions()[-1]
    for name in os.listdir(folder := p.store.at(version).removeprefix("file://") + "/symbols"):
        if name.endswith(".parquet"):
            (tmp_path / "x").write_text("broken")
            shutil.copy(tmp_path / "x", f"{folder}/{name}")
            if os.path.exists(crc := f"{folder}/.{name}.crc"):
                os.remove(crc)
    assert p.doctor()["status"] == "CORRUPT"


def test_watch_tree(spark, tmp_path):
    (tmp_path / "a.py").write_text("def first():\n    return 1\n")
    p = Project(spark, str(tmp_path))
    p.init()
    said = []
    query = watch.watch(watch.tree(spark, p.root), watch.index_changes(spark, p.root, p.store, said.append), interval="100 milliseconds")
    try:
        (tmp_path / "b.py").write_text("def second():\n    return 2\n")
        limit = time.time() + 90
        while time.time() < limit and not any("b.py" in s for s in said):
            time.sleep(0.2)
        (tmp_path / "a.py").unlink()
        while time.time() < limit and not any("deleted" in s for s in said):
            time.sleep(0.2)
    finally:
        query.stop()
    assert [tuple(json.loads(s).values()) for s in said] == [("changed", "b.py"), ("deleted", "a.py")]
    assert p.search("second") and not p.search("first")


def test_watch(spark, project, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"path": p} for p in ("src/base.ts", "src/base.ts", "src/old.ts", "src/new.ts", "src/user.ts", ".ctx/x", "a.txt")]
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, lines)))
    said = []
    stream = spark.readStream.schema("path string").json(str(tmp_path / "in"))
    watch.watch(stream, watch.index_changes(spark, project.root, project.store, said.append), checkpoint=str(tmp_path / "state"), once=True).awaitTermination(120)
    assert {tuple(json.loads(s).values()) for s in said} == {("changed", "src/base.ts"), ("changed", "src/new.ts"), ("deleted", "src/old.ts")}
    assert project.search("fresh") and not project.search("gone")


def test_server(project):
    ask = lambda method, **params: answer(project, json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}))
    assert ask("initialize")["result"]["protocolVersion"] and len(ask("tools/list")["result"]["tools"]) == 11
    got = ask("tools/call", name="ctx_search", arguments={"query": "User"})["result"]
    assert not got["isError"] and json.loads(got["content"][0]["text"])[0]["name"] == "User"
    tool = lambda name, /, **given: json.loads(ask("tools/call", name=name, arguments=given)["result"]["content"][0]["text"])
    assert tool("ctx_search", query="base", files=True)[0].keys() == {"path", "language", "size"}
    assert tool("ctx_symbol", name="one")[0].keys() == {"name", "kind", "signature", "file", "line", "methods", "references", "dependencies"}
    assert tool("ctx_dependencies", path="src/user.ts") == [{"target": "src/base.ts", "imported_symbol": "one"}]
    assert tool("ctx_dependents", path="src/base.ts") == [{"source": "src/user.ts", "imported_symbol": "one"}]
    assert tool("ctx_impact", path="src/base.ts")["direct"][0]["path"] == tool("ctx_impact", symbol="one")["direct"][0]["path"] == "src/user.ts"
    assert "error" in tool("ctx_impact", symbol="nothing") and tool("ctx_project")["git"]
    assert "stats" not in tool("ctx_skeleton", path="src/base.ts") and "stats" in tool("ctx_skeleton", path="src/base.ts", with_stats=True)
    assert tool("ctx_diff")["counts"]["Added"] == 1
    assert ask("tools/call", name="ctx_search")["result"]["isError"] and ask("none")["error"]["code"] == -32601
    assert answer(project, "{")["error"]["code"] == -32700 and answer(project, '{"method": "x"}') is None


def test_command_line(project, capsys):
    assert command.main(["-R", project.root, "stats"]) == 0
    assert json.loads(capsys.readouterr().out)["files"] == 3
    assert command.main(["-R", project.root, "search", "x", "--kind", "nothing"]) == 2
    assert command.main(["-R", project.root, "deps", "nowhere.ts"]) == 1
    capsys.readouterr()
    assert command.main(["-R", project.root, "-v", "-j", "search", "one"]) == 0
    said = capsys.readouterr()
    assert json.loads(said.out)[0]["path"] == json.loads(said.out)[0]["file"] == "src/base.ts" and "search:" in said.err


def test_terminal():
    shown = list(terminal.lines({"status": "READY", "files": [{"path": "a.ts", "score": 1.5, "note": None}], "names": ["x"], "none": []}, color=False))
    assert shown == ["status: READY", "files:", "  a.ts  1.500", "names:", "  x", "none: none"]
    assert "\x1b[32mREADY" in next(terminal.lines({"status": "READY"}))
