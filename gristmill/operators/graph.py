"""The dependency graph of repositories: symbols, resolved imports, folders, typed nodes and edges.

The order in which a sequential builder would write is carried as a key, (phase, file_ord, path, position of the import),
so that first and last writers are aggregates and nothing is sorted; file_ord is the order of files where they have one, else
that of their paths.  Everything is keyed by repository, and
repositories share the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import paths

PYTHON_LIKE, JAVA_LIKE, GO, C_LIKE = (".py", ".js", ".ts"), (".java", ".kt"), (".go",), (".c", ".cpp", ".h", ".hpp")


def _ordered(info: DataFrame) -> DataFrame:
    """With a file_ord; a null one comes after all others."""
    return info.withColumn("file_ord", F.coalesce(F.col("file_ord").cast("int"), F.lit(2**31 - 1)) if "file_ord" in info.columns else F.lit(0))


def symbols(info: DataFrame) -> DataFrame:
    """(repo_id, name, file): the last file that defines a name."""
    empty = F.array().cast("array<string>")
    names = F.explode(F.concat(F.coalesce("functions", empty), F.coalesce("classes", empty)))
    return _ordered(info).select("repo_id", "path", "file_ord", names.alias("name")).groupBy("repo_id", "name").agg(F.max_by("path", F.struct("file_ord", "path")).alias("file"))


def imports(info: DataFrame) -> DataFrame:
    """(repo_id, path, file_ord, ord, imp, kind, module, symbol): every import with the rule for its file's extension."""
    ext = paths.extension(F.col("path"))
    kind = F.when(ext.isin(*PYTHON_LIKE), "python").when(ext.isin(*JAVA_LIKE), "java").when(ext.isin(*GO), "go").when(ext.isin(*C_LIKE), "c").otherwise("other")
    rows = _ordered(info).select("repo_id", "path", "file_ord", F.posexplode("imports").alias("ord", "imp")).filter(F.col("imp").isNotNull()).withColumn("kind", kind)
    dotted = (F.col("kind") == "python") & F.col("imp").contains(".")
    last = r"(?s)^(.*)\.([^.]*)$"
    return rows.withColumn("module", F.when(dotted, F.regexp_extract("imp", last, 1))).withColumn("symbol", F.when(dotted, F.regexp_extract("imp", last, 2)))


def suffix_matches(info: DataFrame, keys: DataFrame) -> DataFrame:
    """(repo_id, key, src): for each key the shortest, then first, path that ends with it.

    A key with a slash fixes the whole last segment, so an equality join on it and a check of the rest are exact.
    A key without one may match inside a segment: the endings of each file's name are aggregated to their best path
    first, and that is joined, so neither form compares all keys with all files.
    """
    py = info.filter(F.col("path").endswith(".py")).select("repo_id", "path", paths.basename(F.col("path")).alias("base"))
    best = F.min(F.struct(F.length("path").alias("n"), F.col("path").alias("p"))).alias("best")
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.length("base")), lambda i: F.substring(F.col("base"), i, F.length("base"))))
    single = py.select("repo_id", "path", ends.alias("key")).groupBy("repo_id", "key").agg(best)
    one = keys.filter(~F.col("key").contains("/")).join(single, ["repo_id", "key"])
    many = keys.filter(F.col("key").contains("/")).withColumn("base", paths.basename(F.col("key"))).join(py, ["repo_id", "base"]).filter(F.col("path").endswith(F.col("key"))).groupBy("repo_id", "key").agg(best)
    return one.unionByName(many).select("repo_id", "key", F.col("best.p").alias("src"))


def resolved_imports(info: DataFrame, strict: bool = False) -> DataFrame:
    """Imports with ``key`` and ``src``, the file that provides a dotted module or an undotted symbol; null if none does.

    ``strict`` leaves an empty module, as relative script imports have, unresolved.
    """
    imp = imports(info).withColumn("key", F.concat(F.replace("module", F.lit("."), F.lit("/")), F.lit(".py")))
    keys = imp.filter(F.col("key").isNotNull() & ((F.col("module") != "") | F.lit(not strict))).select("repo_id", "key").distinct()
    found = suffix_matches(info, keys)
    syms = symbols(info).select("repo_id", F.col("name").alias("imp"), F.col("file").alias("sym_file"))
    undotted = (F.col("kind") == "python") & F.col("module").isNull()
    return (
        imp.join(found, ["repo_id", "key"], "left").join(syms, ["repo_id", "imp"], "left")
        .withColumn("src", F.when(undotted, F.col("sym_file")).otherwise(F.col("src"))).withColumn("undotted", undotted).drop("sym_file")
    )


def export_events(resolved: DataFrame) -> DataFrame:
    """(repo_id, path, file_ord, ord, name, src): imports of a symbol that a file of the repository provides."""
    ok = F.col("src").isNotNull() & (F.col("kind") == "python") & (~F.col("undotted") | (F.col("src") != F.col("path")))
    return resolved.filter(ok).select("repo_id", "path", "file_ord", "ord", F.when(F.col("undotted"), F.col("imp")).otherwise(F.col("symbol")).alias("name"), "src")


def midpoints(events: DataFrame, strict: bool = False) -> DataFrame:
    """(repo_id, name, src, path, file_ord, ord): the first event of each symbol decides where all its importers attach; ``strict`` tells symbols of one name by their files."""
    first = F.min(F.struct("file_ord", "path", "ord", "src")).alias("m")
    return events.groupBy("repo_id", "name", *([F.col("src").alias("of")] if strict else [])).agg(first).select("repo_id", "name", "m.src", "m.path", "m.file_ord", "m.ord")


def unresolved(resolved: DataFrame) -> DataFrame:
    """(repo_id, path, file_ord, ord, id, level, type, label): packages and headers that stand for what no file provides."""
    k, imp = F.col("kind"), F.col("imp")
    dotted = (k == "python") & ~F.col("undotted")
    rows = resolved.filter((k != "python") | F.col("src").isNull())
    java = F.regexp_replace(imp, r"\.[^.]*$", "")
    pid = F.when(dotted, F.col("module")).when(k == "java", java).otherwise(imp)
    level = F.when(k.isin("go", "c"), paths.occurrences(pid, "/") + 1).when(F.col("undotted"), 1).otherwise(paths.occurrences(pid, ".") + 1)
    return rows.select("repo_id", "path", "file_ord", "ord", pid.alias("id"), level.alias("level"), F.when(k == "c", "header").otherwise("package").alias("type"), F.when(dotted, F.col("symbol")).alias("label"))


def directories(info: DataFrame) -> DataFrame:
    """(repo_id, id): every folder above a file."""
    return info.select("repo_id", F.explode(paths.ancestors(F.col("path"))).alias("id")).distinct()


def file_label(info_path: Column) -> Column:
    names = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ", ")
    return F.concat(paths.basename(info_path), F.lit("\nFunctions: "), names("functions"), F.lit("\nClasses: "), names("classes"))


def graph(info: DataFrame, strict: bool = False, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Nodes (repo_id, id, type, label, shape, level) and edges (repo_id, src, dst, relation, label), at most one edge for each pair.

    ``keep`` is given what several branches read, the resolved imports, to materialise it.
    """
    info = _ordered(info)
    res = keep(resolved_imports(info, strict))
    events = export_events(res)
    mid = midpoints(events, strict)
    loose = unresolved(res)
    dirs = directories(info)
    p = F.col("path")
    lit = lambda x, n: F.lit(x).alias(n)
    files = info.select("repo_id", p.alias("id"), lit("file", "type"), file_label(p).alias("label"), lit("ellipse", "shape"), (paths.depth(p) + 1).alias("level"), lit(0, "phase"), "file_ord", "path", lit(-1, "ord"))
    mids = mid.select("repo_id", F.concat("src", F.lit("::"), "name").alias("id"), lit("import", "type"), F.col("name").alias("label"), lit("box", "shape"), (paths.depth(F.col("src")) + 2).alias("level"), lit(0, "phase"), "file_ord", "path", "ord")
    packs = loose.select("repo_id", "id", "type", F.col("id").alias("label"), F.when(F.col("type") == "header", "diamond").otherwise("star").alias("shape"), "level", lit(0, "phase"), "file_ord", "path", "ord")
    folders = dirs.select("repo_id", "id", lit("directory", "type"), paths.basename(F.col("id")).alias("label"), lit("box", "shape"), paths.depth(F.col("id")).alias("level"), lit(1, "phase"), lit(0, "file_ord"), F.col("id").alias("path"), lit(0, "ord"))
    seq = F.struct("phase", "file_ord", "path", "ord")
    writes = files.unionByName(mids).unionByName(packs).unionByName(folders)
    nodes = writes.groupBy("repo_id", "id").agg(F.max_by(F.struct("type", "label", "shape", F.col("level").cast("int").alias("level")), seq).alias("n")).select("repo_id", "id", "n.*")

    none = F.lit(None).cast("string").alias("label")
    at = ["phase", "file_ord", "path", "ord"]
    exports = mid.select("repo_id", "src", F.concat("src", F.lit("::"), "name").alias("dst"), lit("exports", "relation"), none, lit(0, "phase"), "file_ord", "path", "ord")
    by = ["repo_id", "name", "src"] if strict else ["repo_id", "name"]
    uses = (events if strict else events.drop("src")).join(mid.select("repo_id", "name", "src"), by).select("repo_id", F.concat("src", F.lit("::"), "name").alias("src"), F.col("path").alias("dst"), lit("imports", "relation"), none, lit(0, "phase"), "file_ord", "path", "ord")
    outer = loose.select("repo_id", F.col("id").alias("src"), F.col("path").alias("dst"), F.when(F.col("type") == "header", "includes").otherwise("imports").alias("relation"), "label", lit(0, "phase"), "file_ord", "path", "ord")
    inside = F.col("src") != ""
    holds = info.select("repo_id", paths.dirname(p).alias("src"), p.alias("dst")).unionByName(dirs.select("repo_id", paths.dirname(F.col("id")).alias("src"), F.col("id").alias("dst"))).filter(inside)
    holds = holds.select("repo_id", "src", "dst", lit("contains", "relation"), none, lit(1, "phase"), lit(0, "file_ord"), F.col("src").alias("path"), lit(0, "ord"))
    all_edges = exports.unionByName(uses).unionByName(outer).unionByName(holds).select("repo_id", "src", "dst", "relation", "label", *at)
    edges = all_edges.groupBy("repo_id", "src", "dst").agg(F.max_by("relation", seq).alias("relation"), F.max_by("label", F.when(F.col("label").isNotNull(), seq)).alias("label"))
    return nodes, edges


def clustered_edges(edges: DataFrame) -> DataFrame:
    """Pairs written more than once, as one edge with their count; for edges before they are merged."""
    return edges.groupBy("repo_id", "src", "dst").agg(F.count("*").alias("count")).filter("count > 1").withColumn("relation", F.lit("multiple"))


def scaled(df: DataFrame, value: str, keys: list[str], out: str = "scaled", top: float = 1000.0) -> DataFrame:
    """value brought to 0..top within its keys, null where it does not vary; extents are aggregated, not collected by key."""
    ext = [F.min(value).alias("__lo"), F.max(value).alias("__hi")]
    if keys:
        j = df.join(df.groupBy(*keys).agg(*ext), keys)
    else:
        lo, hi = df.agg(*ext).first()
        j = df.withColumn("__lo", F.lit(lo)).withColumn("__hi", F.lit(hi))
    return j.withColumn(out, F.try_divide(F.col(value) - F.col("__lo"), F.when(F.col("__hi") != F.col("__lo"), F.col("__hi") - F.col("__lo"))) * top).drop("__lo", "__hi")


#: Nodes beyond which what is far from a node in a graph is felt by cells, not by nodes: all pairs are quadratic.
LAYOUT_LIMIT = 5_000


def _gridded(pos, k: float):
    """Repulsion of each node: by the nodes of its cell, and by the centres of all others. Cells hold about equally many, so that clumps cost no more."""
    import numpy as np

    g = max(1, round(len(pos) ** 0.25))
    strips = np.array_split(np.argsort(pos[:, 0], kind="stable"), g)
    cells = [c for s in strips for c in np.array_split(s[np.argsort(pos[s, 1], kind="stable")], g) if len(c)]
    centre, count = np.array([pos[c].mean(0) for c in cells]), np.array([len(c) for c in cells], dtype=float)
    move = np.empty_like(pos)
    for i, c in enumerate(cells):
        far = np.arange(len(cells)) != i
        weight = np.concatenate([np.ones(len(c)), count[far]])
        d = pos[c][:, None, :] - np.concatenate([pos[c], centre[far]])[None, :, :]
        dist = np.maximum(np.sqrt((d**2).sum(-1)), 0.01)
        move[c] = (d * (k * k * weight / dist**2)[..., None]).sum(1)
    return move


def layout(nodes: DataFrame, edges: DataFrame, iterations: int = 50, k: float = 0.5, seed: int = 7, limit: int = LAYOUT_LIMIT) -> DataFrame:
    """(repo_id, id, x, y): a seeded spring layout of each graph, scaled to 0..1000; null where it cannot be. Beyond ``limit`` nodes, far ones repel by cells."""
    import numpy as np
    import pandas as pd

    n = nodes.select("repo_id", F.col("id").alias("a"), F.lit(None).cast("string").alias("b"))
    e = edges.select("repo_id", F.col("src").alias("a"), F.col("dst").alias("b"))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf.loc[pdf.b.isna(), "a"])
        at = {x: i for i, x in enumerate(ids)}
        m = len(ids)
        pos = np.random.default_rng(seed).random((m, 2))
        pairs = pdf.loc[pdf.b.notna()]
        link = np.array([(at[a], at[b]) for a, b in zip(pairs.a, pairs.b) if a in at and b in at and a != b], dtype=int).reshape(-1, 2)
        heat = 0.1
        for _ in range(iterations):
            if m > limit:
                move = _gridded(pos, k)
            else:
                d = pos[:, None, :] - pos[None, :, :]
                dist = np.maximum(np.sqrt((d**2).sum(-1)), 0.01)
                move = (d * (k * k / dist**2)[..., None]).sum(1)
            if len(link):
                v = pos[link[:, 0]] - pos[link[:, 1]]
                pull = v * (np.maximum(np.sqrt((v**2).sum(1)), 0.01) / k)[:, None]
                np.add.at(move, link[:, 0], -pull)
                np.add.at(move, link[:, 1], pull)
            size = np.maximum(np.sqrt((move**2).sum(1)), 0.01)
            pos = pos + move * (heat / size)[:, None]
            heat -= 0.1 / (iterations + 1)
        lo, hi = (pos.min(0), pos.max(0)) if m else (0, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (pos - lo) / np.where(hi > lo, hi - lo, np.nan) * 1000
        return pd.DataFrame({"repo_id": pdf.repo_id.iloc[0], "id": ids, "x": out[:, 0], "y": out[:, 1]})

    return n.unionByName(e).groupBy("repo_id").applyInPandas(place, "repo_id long, id string, x double, y double")
