"""Version control as a source: changed files and their contents at a revision, by the git command on the driver."""

from __future__ import annotations

import os
import subprocess
from dataclasses import dataclass

from codeloom.sources.scan import language_of


@dataclass(frozen=True)
class Change:
    path: str
    status: str  # A, D, M or R
    old_path: str | None = None


class Repository:
    def __init__(self, folder: str):
        self.root = subprocess.run(["git", "rev-parse", "--show-toplevel"], cwd=folder, capture_output=True, text=True, check=True).stdout.strip()

    def run(self, *args: str) -> str:
        out = subprocess.run(["git", *args], cwd=self.root, capture_output=True)
        if out.returncode:
            raise ValueError(out.stderr.decode("utf-8", "replace").strip() or f"git {args[0]} failed")
        return out.stdout.decode("utf-8", "replace")

    def show(self, rev: str, path: str) -> bytes:
        """A file at a revision; empty where it isn't there."""
        out = subprocess.run(["git", "cat-file", "-p", f"{rev}:{path}"], cwd=self.root, capture_output=True)
        return out.stdout if out.returncode == 0 else b""

    def read(self, path: str) -> bytes:
        try:
            with open(os.path.join(self.root, path), "rb") as f:
                return f.read()
        except OSError:
            return b""

    def merge_base(self, rev: str) -> str:
        return self.run("merge-base", rev, "HEAD").strip()

    def changes(self, base: str | None = None, head: str | None = None, untracked: bool = True) -> list[Change]:
        """By path: of the working tree against the last commit, or against a revision, with untracked files or without;
        or between two revisions. The engine's and git's own folders are left out."""
        for rev in (base, head):
            if rev is not None and rev.startswith("-"):
                raise ValueError(f"not a revision: {rev}")
        found: list[Change] = []
        rest = iter(self.run("diff", "--name-status", "-z", "-M", base or "HEAD", *([head] if head else []), "--").split("\0"))
        for code in rest:
            if not code:
                break
            kind = {"A": "A", "D": "D", "R": "R", "C": "R"}.get(code[0], "M")
            old = next(rest) if code[0] in "RC" else None
            found.append(Change(next(rest), kind, old))
        if head is None and untracked:
            found += [Change(p, "A") for p in self.run("ls-files", "--others", "--exclude-standard", "-z").split("\0") if p]
        return sorted({c.path: c for c in found if c.path.split("/")[0] not in (".ctx", ".git")}.values(), key=lambda c: c.path)


def supported(changes: list[Change]) -> list[Change]:
    return [c for c in changes if language_of(c.path)]
