"""Queries of dependency graphs; every one works on all repositories at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import paths
from gristmill.session import checkpointed

#: Node types that the graph view shows unless told otherwise (fixed values).
SHOWN = ("directory", "file", "import", "package")


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges both of whose ends are kept."""
    k = keep.select("repo_id", "id")
    return edges.join(k.withColumnRenamed("id", "src"), ["repo_id", "src"], "left_semi").join(k.withColumnRenamed("id", "dst"), ["repo_id", "dst"], "left_semi")


def level_subgraph(nodes: DataFrame, edges: DataFrame, level: int, types: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes up to a level, of given types, and the edges among them."""
    keep = nodes.filter(F.col("level") <= level)
    if types is not None:
        keep = keep.filter(F.col("type").isin(*types))
    return keep, induced(edges, keep)


def top_by_type(nodes: DataFrame, score: DataFrame, keys: tuple[str, ...] = ("repo_id", "type")) -> DataFrame:
    """The node of the highest score for each key; the first id where scores are equal."""
    j = nodes.join(score, ["repo_id", "id"])
    best = F.min_by(F.struct("id", "score"), F.struct((-F.col("score")).alias("s"), F.col("id"))).alias("b")
    return j.groupBy(*keys).agg(best).select(*keys, "b.*")


def neighbours(edges: DataFrame) -> DataFrame:
    """(repo_id, id, other, direction): one row for each end of each edge."""
    out = edges.select("repo_id", F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("out").alias("direction"), "relation")
    return out.unionByName(edges.select("repo_id", F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("in").alias("direction"), "relation"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, id, successors, predecessors, importers, folders): what a hover shows as counts; hubs of any size are aggregated, not collected."""
    n = neighbours(edges)
    count = lambda c: F.count_if(c)
    agg = n.groupBy("repo_id", "id").agg(
        count(F.col("direction") == "out").alias("successors"), count(F.col("direction") == "in").alias("predecessors"),
        count((F.col("direction") == "in") & (F.col("relation") == "imports")).alias("importers"), count(F.col("relation") == "contains").alias("folders"),
    )
    return nodes.select("repo_id", "id").join(agg, ["repo_id", "id"], "left").fillna(0)


def in_order(nodes: DataFrame) -> DataFrame:
    """(repo_id, id, position): nodes in the order in which a builder that goes file by file writes them: each file, then folders, then the rest, by path."""
    phase = F.when(F.col("type") == "file", 0).when(F.col("type") == "directory", 2).otherwise(1)
    return nodes.select("repo_id", "id", F.struct(phase.alias("phase"), "id").alias("position"))


def neighbour_labels(nodes: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """(repo_id, id, importers, folders): labels of a node's neighbours, as a hover shows them: those that import it and those that hold it or that it holds.

    A hover shows the first ``most`` of each by id; the counts of all are those of ``degrees``.  Lists are cut in each
    salted part before they meet, so that no hub is collected.
    """
    n = neighbours(edges).withColumn("kind", F.when((F.col("direction") == "in") & (F.col("relation") == "imports"), "importers").when(F.col("relation") == "contains", "folders")).filter("kind IS NOT NULL")
    named = n.join(nodes.select("repo_id", F.col("id").alias("other"), F.substring_index("label", "\n", 1).alias("label")), ["repo_id", "other"])
    first = F.slice(F.array_sort(F.collect_list(F.struct("other", "label"))), 1, most).alias("b")
    part = named.withColumn("salt", F.pmod(F.xxhash64("other"), F.lit(64))).groupBy("repo_id", "id", "kind", "salt").agg(first)
    met = part.select("repo_id", "id", "kind", F.explode("b").alias("x")).select("repo_id", "id", "kind", "x.*").groupBy("repo_id", "id", "kind").agg(first)
    text = F.array_join(F.transform("b", lambda x: x["label"]), ", ")
    lists = met.groupBy("repo_id", "id").agg(F.max(F.when(F.col("kind") == "importers", text)).alias("importers"), F.max(F.when(F.col("kind") == "folders", text)).alias("folders"))
    return nodes.select("repo_id", "id").join(lists, ["repo_id", "id"], "left").fillna("", ["importers", "folders"])


def level_after(level: int, step: int) -> int:
    """The level of the view after a step up or down; never below 1."""
    return max(1, level + step)


def toggled(types: tuple[str, ...], kind: str) -> tuple[str, ...]:
    """The shown types with one switched on or off."""
    return tuple(t for t in types if t != kind) if kind in types else (*types, kind)


def ego(edges: DataFrame, seeds: DataFrame, direction: str = "both") -> DataFrame:
    """(repo_id, id): seeds and their neighbours one step out, in or both ways."""
    n = neighbours(edges)
    if direction != "both":
        n = n.filter(F.col("direction") == direction)
    s = seeds.select("repo_id", "id")
    return s.unionByName(n.join(s, ["repo_id", "id"], "left_semi").select("repo_id", F.col("other").alias("id"))).distinct()


def _fixpoint(seeds: DataFrame, step, compact: int = 8) -> DataFrame:
    """All that ``step`` reaches from the seeds, however far; each round joins the frontier alone, and lineage is cut by checkpoints of the frontiers."""
    frontier = checkpointed(seeds.select("repo_id", "id").distinct())
    seen = frontier
    rounds = 0
    while not frontier.isEmpty():
        new = step(frontier).select("repo_id", "id").distinct().join(seen, ["repo_id", "id"], "left_anti")
        frontier = checkpointed(new)
        seen = seen.unionByName(frontier)
        rounds += 1
        if rounds % compact == 0:
            seen = checkpointed(seen)
    return seen


def descendants(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes reached along edges from the seeds, which are left out unless a cycle returns to them; cycles end by themselves."""
    e = checkpointed(edges.select("repo_id", F.col("src").alias("id"), F.col("dst").alias("next")))
    step = lambda f: f.join(e, ["repo_id", "id"]).select("repo_id", F.col("next").alias("id"))
    return _fixpoint(seeds, step).join(seeds.select("repo_id", "id"), ["repo_id", "id"], "left_anti")


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, iterations: int = 100, tol: float | None = 1e-6, checkpoint_every: int = 4) -> DataFrame:
    """(repo_id, id, score) by power iteration within each repository; mass of nodes without successors is spread evenly.

    With ``tol`` it ends when no repository changes by more than its nodes times ``tol`` in sum; without, after ``iterations`` rounds.
    """
    n = nodes.groupBy("repo_id").agg(F.count("*").alias("n"))
    out = edges.groupBy("repo_id", F.col("src").alias("id")).agg(F.count("*").alias("outs"))
    base = checkpointed(nodes.select("repo_id", "id").join(n, "repo_id").join(out, ["repo_id", "id"], "left"))
    e = checkpointed(edges.select("repo_id", F.col("src").alias("id"), F.col("dst")))
    rank = base.withColumn("score", 1.0 / F.col("n"))
    for i in range(iterations):
        flow = rank.filter("outs IS NOT NULL").select("repo_id", "id", (F.col("score") / F.col("outs")).alias("part")).join(e, ["repo_id", "id"]).groupBy("repo_id", F.col("dst").alias("id")).agg(F.sum("part").alias("got"))
        idle = rank.filter("outs IS NULL").groupBy("repo_id").agg(F.sum("score").alias("idle"))
        new = rank.withColumnRenamed("score", "old").join(flow, ["repo_id", "id"], "left").join(idle, "repo_id", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        new = new.select("repo_id", "id", "n", "outs", (F.lit(alpha) * (zero("got") + zero("idle") / F.col("n")) + (1 - alpha) / F.col("n")).alias("score"), "old")
        if tol is not None or (i + 1) % checkpoint_every == 0:
            new = checkpointed(new)
        if tol is not None:
            left = new.groupBy("repo_id").agg((F.sum(F.abs(F.col("score") - F.col("old"))) - F.first("n") * tol).alias("d")).agg(F.max("d")).first()[0]
            if left is None or left < 0:
                rank = new.drop("old")
                break
        rank = new.drop("old")
    return rank.select("repo_id", "id", "score")


def search_seeds(nodes: DataFrame, edges: DataFrame, term: str) -> DataFrame:
    """Nodes whose label contains the term in any case, and targets of edges that leave such nodes; all nodes for an empty term."""
    if not term:
        return nodes.select("repo_id", "id")
    hit = nodes.filter(F.contains(F.lower("label"), F.lit(term.lower()))).select("repo_id", "id")
    to = edges.select("repo_id", F.col("src").alias("id"), "dst").join(hit, ["repo_id", "id"], "left_semi").select("repo_id", F.col("dst").alias("id"))
    return hit.unionByName(to).distinct()


def search_closure(nodes: DataFrame, edges: DataFrame, term: str) -> tuple[DataFrame, DataFrame]:
    """The closure of the seeds (files to their folders, consumers to what they import, files to what they export) and its edges."""
    up = nodes.filter("type = 'file'").select("repo_id", "id", F.explode(paths.ancestors(F.col("id"))).alias("next"))
    back = edges.filter("relation = 'imports'").select("repo_id", F.col("dst").alias("id"), F.col("src").alias("next"))
    out = edges.filter("relation = 'exports'").select("repo_id", F.col("src").alias("id"), F.col("dst").alias("next"))
    moves = checkpointed(up.unionByName(back).unionByName(out))
    step = lambda f: f.join(moves, ["repo_id", "id"]).select("repo_id", F.col("next").alias("id"))
    keep = _fixpoint(search_seeds(nodes, edges, term).join(nodes.select("repo_id", "id"), ["repo_id", "id"], "left_semi"), step)
    return nodes.join(keep, ["repo_id", "id"], "left_semi"), induced(edges, keep)


def node_style(nodes: DataFrame) -> DataFrame:
    """Size by label length, a fixed one for symbols and packages, and a colour by type."""
    n = F.length("label")
    size = F.when(F.col("type").isin("import", "package"), F.lit(15)).otherwise(F.greatest(F.lit(30), F.least(n * 5, F.lit(150))))
    colour = F.when(F.col("type") == "directory", "amber").when(F.col("type") == "file", "blue").when(F.col("type") == "import", "green").when(F.col("type") == "package", "violet").otherwise("grey")
    return nodes.select("repo_id", "id", "shape", size.cast("int").alias("size"), colour.alias("colour"))


def edge_style(edges: DataFrame) -> DataFrame:
    """A colour by relation."""
    r = F.col("relation")
    colour = F.when(r == "contains", "amber").when(r == "imports", "blue").when(r == "exports", "green").when(r == "includes", "violet").otherwise("grey")
    return edges.select("repo_id", "src", "dst", colour.alias("colour"))


def edge_width(count: Column) -> Column:
    """Width of an edge that stands for several."""
    return F.ln(count) + 1
