"""A context package for a task: ranked files with their neighbours, filled into a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import words
from codeloom.functions.fixed import MAX_FILES, MAX_TOKENS, MOST_DEPENDENCIES, MOST_FOLLOWED
from codeloom.functions.text import framework_bonus, token_estimate
from codeloom.operators.lookup import in_degree
from codeloom.plans import context
from codeloom.sources.bindings import Graph
from codeloom.sources.scratch import cut


def _ways(g: Graph, w: dict[str, float], changed: DataFrame | None, recent: DataFrame | None) -> DataFrame:
    """file_id, score and way (0 direct, 1 dependency, 2 dependent) of direct matches and files one hop from a root.
    Scores are computed once; what is changed or recent counts before the roots are chosen."""
    direct = cut(context.file_scores(g, w, changed, recent).select("file_id", "score"))
    hops = [context.follow(g, direct, reverse, recent).withColumn("way", F.lit(1 + reverse)) for reverse in (False, True)]
    return direct.withColumn("way", F.lit(0)).union(hops[0]).union(hops[1])


def ranked(g: Graph, w: dict[str, float], changed: DataFrame | None = None, recent: DataFrame | None = None) -> DataFrame:
    """file_id, path, score, follow_only, before the cap. changed: paths of the working tree that differ from the last
    commit; recent: paths written after the index."""
    best = _ways(g, w, changed, recent).groupBy("file_id").agg(F.max("score").alias("score"), (F.min("way") > 0).alias("follow_only"))
    return best.join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id")


def _with_ways(g: Graph, w: dict[str, float], changed: DataFrame | None, recent: DataFrame | None) -> DataFrame:
    best = _ways(g, w, changed, recent).groupBy("file_id").agg(F.max("score").alias("score"), (F.min("way") > 0).alias("follow_only"), F.collect_set("way").alias("ways"))
    return best.join(g.files.select(F.col("id").alias("file_id"), "path"), "file_id")


def capped(rows: DataFrame) -> DataFrame:
    """All direct matches and the best of the files that are only followed."""
    follow = rows.filter("follow_only").orderBy(F.desc("score"), "path").limit(MOST_FOLLOWED)
    return rows.filter("NOT follow_only").unionByName(follow)


def filled(rows: DataFrame, max_tokens: int = MAX_TOKENS, max_files: int = MAX_FILES) -> tuple[list, int, int]:
    """rows: path, score, tokens. (chosen rows, tokens, files left out), best first. A file over what is left is passed
    over, but the first is taken whatever its size and then costs nothing. Rows reach the driver one partition at a time
    and only until the package is full."""
    chosen, left, total = [], max(1, max_tokens), 0
    rows = cut(rows)
    ordered = rows.orderBy(F.desc("score"), "path")
    for row in ordered.toLocalIterator():
        if len(chosen) >= max_files or (chosen and left < 1):
            break
        if row.tokens <= left:
            left -= row.tokens
        elif chosen:
            continue
        total += row.tokens
        chosen.append(row)
    return chosen, total, rows.count() - len(chosen)


def architecture(paths: list[str]) -> list[str]:
    """Folders of the files, indented by depth, in the order of the indented lines."""
    folders = sorted({p.rpartition("/")[0] for p in paths if "/" in p})
    return [*sorted("  " * f.count("/") + f.rpartition("/")[2] + "/" for f in folders), "..."] if paths else []


def package_dependencies(g: Graph, paths: list[str]) -> list[str]:
    """The first distinct paths and outside specifiers that the files depend on, in the files' order."""
    if not paths:
        return []
    order = F.array_position(F.array(*map(F.lit, paths)), F.col("path"))
    own = g.files.filter(F.col("path").isin(paths)).select(F.col("id").alias("source_file_id"), order.alias("place"))
    target = g.files.select(F.col("id").alias("target_file_id"), F.col("path").alias("target"))
    raw = F.trim("source_raw") if "source_raw" in g.dependencies.columns else F.lit(None).cast("string")
    outside = F.when(F.col("target_file_id").isNull() & ~raw.startswith("./") & ~raw.startswith("../") & (raw != ""), raw)
    rows = g.dependencies.join(F.broadcast(own), "source_file_id")  # at most max_files rows
    rows = rows.join(target, "target_file_id", "left").withColumn("name", F.coalesce("target", outside)).filter("name IS NOT NULL")
    n = F.col("id") if "id" in g.dependencies.columns else F.col("name")
    return [r.name for r in rows.groupBy("name").agg(F.min(F.struct("place", n.alias("n"))).alias("first")).orderBy("first", "name").limit(MOST_DEPENDENCIES).collect()]


def _reasons(row, symbols: list[str], file: list[str], changed: bool) -> list[str]:
    """Of a direct match those of its symbols and its file; then, for each way that it was followed, the way and those
    of the file."""
    out = words.without_runs(symbols + file + ["modified in working tree"] * changed) if 0 in row.ways else []
    for way, text in ((1, "imported by a relevant file (dependency)"), (2, "imports a relevant file (dependent)")):
        if way in row.ways:
            out = words.without_runs([*out, text, *file])
    return out


def build_context(g: Graph, task: str, sources: DataFrame, max_tokens: int = MAX_TOKENS, max_files: int = MAX_FILES, changed: DataFrame | None = None, recent: DataFrame | None = None) -> dict:
    """sources: path, text (the skeleton, or the whole text with bodies). Files without a source are passed over."""
    keywords = words.expand(words.tokenize(task))
    if not keywords:
        return {"task": task, "keywords": [], "relevant_files": [], "relevant_symbols": [], "relevant_dependencies": [], "architecture": [], "suggested_context": "", "total_tokens": 0, "omitted_files": 0, "budget_exceeded": False, "is_estimate": True}
    w = context.weights(g, keywords)
    found = capped(_with_ways(g, w, changed, recent)).join(sources.select("path", token_estimate(F.col("text")).alias("tokens")), "path")
    chosen, total, omitted = filled(found.select("file_id", "path", "score", "tokens", "ways"), max_tokens, max_files)
    paths, ids = [r.path for r in chosen], [r.file_id for r in chosen]
    texts = {r.path: r.text for r in sources.filter(F.col("path").isin(paths)).select("path", "text").collect()} if paths else {}
    hubs = {r.file_id: r.rows for r in in_degree(g).filter(F.col("file_id").isin(ids)).collect()} if ids else {}
    frames = {r.path: r.bonus > 0 for r in g.files.filter(F.col("path").isin(paths)).select("path", framework_bonus(F.col("path")).alias("bonus")).collect()} if paths else {}
    late, touched = ({r.path for r in df.filter(F.col("path").isin(paths)).select("path").collect()} if df is not None and paths else set() for df in (recent, changed))
    scored = context.symbol_scores(g, w)
    hits: dict[str, list] = {}
    if ids:  # of at most max_files files
        for s in scored.filter(F.col("file_id").isin(ids)).select("id", "name", "path").join(g.symbols.select("id", "signature"), "id").orderBy("id").toLocalIterator():
            hits[s.path] = words.without_runs(hits.get(s.path, []) + words.symbol_reasons(s.name, s.signature or "", s.path, keywords))
    top = scored.orderBy(F.desc("score"), "path", "id").limit(30).join(g.symbols.select("id", "kind", "signature"), "id").orderBy(F.desc("score"), "path", "id").collect()
    files = [{"path": r.path, "score": r.score, "tokens": r.tokens, "skeleton": texts.get(r.path, ""), "reasons": _reasons(r, hits.get(r.path, []), words.file_reasons(r.path, keywords, frames.get(r.path, False), hubs.get(r.file_id), r.path in late), r.path in touched)} for r in chosen]
    tree, deps = architecture(paths), package_dependencies(g, paths)
    text = "\n".join([f"# Context: {task}", "", "## Architecture", *tree, "", "## Files", *(f"\n### {f['path']}\n```\n{f['skeleton']}\n```" for f in files), "", "## Dependencies", *(f"- {d}" for d in deps)])
    return {
        "task": task,
        "keywords": keywords,
        "relevant_files": files,
        "relevant_symbols": [{"name": s.name, "kind": s.kind, "path": s.path, "score": s.score, "reasons": words.symbol_reasons(s.name, s.signature or "", s.path, keywords)} for s in top],
        "relevant_dependencies": deps,
        "architecture": tree,
        "suggested_context": text,
        "total_tokens": total,
        "omitted_files": omitted,
        "budget_exceeded": total > max(1, max_tokens),
        "is_estimate": True,
    }
