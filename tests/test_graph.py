import random

import numpy as np
import pytest

from gristmill.operators import graph, graphops, retrieve
from gristmill.sources import store

FILES = [
    ("app/main.py", ["main"], [], ["os.path", "app.utils.helper", "json"]),
    ("app/utils.py", ["helper", "log"], [], ["os.getcwd", "os.path", "logging"]),
    ("app/core/engine.py", ["run"], ["Engine"], ["app.utils.helper", "log", "Engine"]),
    ("web/index.js", ["render"], [], ["react"]),
    ("web/View.jsx", ["View"], [], ["react-dom", "./api"]),
    ("svc/Main.java", ["go"], ["Main"], ["java.util.List", "java.util.Map"]),
    ("svc/main.go", ["main"], None, ["fmt", "net/http"]),
    ("native/a.c", ["f"], [], ["sys/stdio.h"]),
    ("README.md", None, None, None),
]
DDL = "repo_id long, path string, functions array<string>, classes array<string>, imports array<string>"


def info(spark, rows, repo=1):
    return spark.createDataFrame([(repo, *r) for r in rows], DDL)


@pytest.fixture(scope="module")
def g(spark):
    n, e = graph.graph(info(spark, FILES))
    return n.cache(), e.cache()


def test_nodes(g):
    rows = {r.id: (r.type, r.level) for r in g[0].collect()}
    assert len(rows) == 26
    kinds = [t for t, _ in rows.values()]
    assert {k: kinds.count(k) for k in set(kinds)} == {"file": 9, "package": 9, "directory": 5, "import": 2, "header": 1}
    assert rows["app/core"] == ("directory", 1) and rows["README.md"] == ("file", 1) and rows["app/core/engine.py"] == ("file", 3)
    assert rows["app/utils.py::log"] == ("import", 3) and rows["./api"] == ("package", 2) and rows["java.util"] == ("package", 2) and rows["net/http"] == ("package", 2)
    assert rows["sys/stdio.h"] == ("header", 2) and rows["os"] == ("package", 1)


def test_edges(g):
    rows = {(r.src, r.dst): (r.relation, r.label) for r in g[1].collect()}
    assert len(rows) == 25
    kinds = [t for t, _ in rows.values()]
    assert {k: kinds.count(k) for k in set(kinds)} == {"imports": 13, "contains": 9, "exports": 2, "includes": 1}
    assert rows["os", "app/utils.py"] == ("imports", "path") and rows["app/utils.py::log", "app/core/engine.py"] == ("imports", None)
    assert rows["java.util", "svc/Main.java"][0] == "imports" and rows["sys/stdio.h", "native/a.c"][0] == "includes"


def test_label(g):
    assert g[0].filter("id = 'app/utils.py'").first().label == "utils.py\nFunctions: helper, log\nClasses: "


@pytest.mark.parametrize(("level", "nodes", "edges"), [(1, 12, 1), (2, 23, 19), (3, 26, 25)])
def test_levels(g, level, nodes, edges):
    n, e = graphops.level_subgraph(*g, level)
    assert (n.count(), e.count()) == (nodes, edges)


def test_descendants(g, spark):
    seeds = spark.createDataFrame([(1, "app")], "repo_id long, id string")
    got = {r.id for r in graphops.descendants(g[1], seeds).collect()}
    assert got == {"app/core", "app/core/engine.py", "app/main.py", "app/utils.py", "app/utils.py::helper", "app/utils.py::log"}


def test_descendants_of_a_cycle(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (1, "b", "c")], "repo_id long, src string, dst string")
    assert {r.id for r in graphops.descendants(e, spark.createDataFrame([(1, "a")], "repo_id long, id string")).collect()} == {"b", "c"}


def test_pagerank(g):
    r = {x.id: x.score for x in graphops.pagerank(*g).collect()}
    assert abs(sum(r.values()) - 1) < 1e-9
    want = {"app/core/engine.py": 0.106278, "app/main.py": 0.077055, "svc/main.go": 0.069889, "web/View.jsx": 0.069889, "native/a.c": 0.060384, "app/utils.py": 0.057215}
    assert all(abs(r[k] - v) < 2e-6 for k, v in want.items())


def test_search(g):
    n, e = graphops.search_closure(*g, "engine")
    ids = {r.id for r in n.collect()}
    assert ids == {"app/core/engine.py", "app/core", "app", "app/utils.py::helper", "app/utils.py::log"}
    assert all(r.src in ids and r.dst in ids for r in e.collect())
    assert graphops.search_closure(*g, "")[0].count() == 26


def test_ego_and_counts(g, spark):
    s = spark.createDataFrame([(1, "app/utils.py::helper")], "repo_id long, id string")
    assert {r.id for r in graphops.ego(g[1], s).collect()} == {"app/utils.py::helper", "app/utils.py", "app/main.py", "app/core/engine.py"}
    d = {r.id: r for r in graphops.degrees(*g).collect()}
    assert d["app/main.py"].importers == 3 and d["app/main.py"].folders == 1 and d["README.md"].successors == 0


def test_order_of_rows_does_not_matter(spark):
    rows = list(FILES)
    random.Random(3).shuffle(rows)
    a, b = graph.graph(info(spark, FILES)), graph.graph(info(spark, rows).repartition(7))
    for x, y in zip(a, b):
        assert sorted(map(str, x.collect())) == sorted(map(str, y.collect()))


def test_relative_script_import_matches_any_python_file(spark):
    rows = [("a.js", [], [], ["./foo"]), ("lib/z.py", [], [], []), ("b.py", [], [], [])]
    e = {(r.src, r.dst) for r in graph.graph(info(spark, rows))[1].collect()}
    assert ("b.py", "b.py::/foo") in e and ("b.py::/foo", "a.js") in e
    strict = {(r.src, r.dst) for r in graph.graph(info(spark, rows), strict=True)[1].collect()}
    assert ("", "a.js") in strict and ("b.py", "b.py::/foo") not in strict


def test_levels_of_relative_imports_without_a_match(spark):
    n = {r.id: r for r in graph.graph(info(spark, [("a.js", [], [], ["../foo", "./foo.js"])]))[0].collect()}
    assert n["."].level == 2 and n["./foo"].level == 2


def test_same_symbol_of_two_modules(spark):
    rows = [("a/one.py", ["f"], [], []), ("b/two.py", ["f"], [], []), ("c.py", [], [], ["one.f"]), ("d.py", [], [], ["two.f"])]
    n, e = graph.graph(info(spark, rows))
    assert [r.id for r in n.filter("type = 'import'").collect()] == ["a/one.py::f"]
    assert {(r.src, r.dst) for r in e.filter("relation = 'imports'").collect()} == {("a/one.py::f", "c.py"), ("a/one.py::f", "d.py")}


def test_folder_wins_over_package_of_its_name(spark):
    n, e = graph.graph(info(spark, [("app/x.py", [], [], ["app"])]))
    assert n.filter("id = 'app'").first().type == "directory" and e.filter("src = 'app'").first().relation == "contains"


def test_ambiguous_suffix(spark):
    rows = [("myutils.py", ["f"], [], []), ("utils.py", ["f"], [], []), ("m.py", [], [], ["utils.f"])]
    assert graph.graph(info(spark, rows))[0].filter("type = 'import'").first().id == "utils.py::f"


def test_cluster_and_scale(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "a", "b"), (1, "a", "c")], "repo_id long, src string, dst string")
    assert [(r.src, r.dst, r["count"]) for r in graph.clustered_edges(e).collect()] == [("a", "b", 2)]
    v = spark.createDataFrame([(1, 5.0), (2, 10.0), (3, 7.5)], "k long, v double")
    assert sorted(r.scaled for r in graph.scaled(v, "v", []).collect()) == [0.0, 500.0, 1000.0]
    assert graph.scaled(v.filter("k = 1"), "v", []).first().scaled is None
    assert graph.scaled(v.limit(0), "v", []).count() == 0


def test_layout_is_seeded_and_in_range(g):
    a, b = (sorted(map(tuple, graph.layout(*g).collect())) for _ in range(2))
    assert a == b and len(a) == 26 and all(0 <= r[2] <= 1000 and 0 <= r[3] <= 1000 for r in a)


def test_node_link_round_trip(g):
    docs = store.to_node_link(*g)
    n, e = store.from_node_link(docs)
    assert sorted(map(tuple, n.select("repo_id", "id", "type", "label", "shape", "level").collect())) == sorted(map(tuple, g[0].select("repo_id", "id", "type", "label", "shape", "level").collect()))
    assert {(r.src, r.dst, r.relation) for r in e.collect()} == {(r.src, r.dst, r.relation) for r in g[1].collect()}


def test_empty(spark):
    n, e = graph.graph(info(spark, FILES).limit(0))
    assert n.count() == 0 and e.count() == 0 and graphops.pagerank(n, e).count() == 0 and graphops.search_closure(n, e, "x")[0].count() == 0


def test_best_of_type(g):
    best = {r.type: r.id for r in graphops.top_by_type(g[0], graphops.pagerank(*g)).collect()}
    assert best["file"] == "app/core/engine.py" and best["import"] == "app/utils.py::helper" or best["import"] == "app/utils.py::log"


def test_ranks_after_the_surveyed_rounds(spark, tmp_path):
    import json

    from gristmill import catalog

    rows = [(i, 1, f"m{i:02}.py", json.dumps({"functions": [f"f{i}"], "classes": [], "imports": [f"m{i - 1:02}.f{i - 1}"] if i else []})) for i in range(12)]
    spark.createDataFrame(rows, "id long, repo_id long, file_path string, ast_info string").write.parquet(f"{tmp_path}/ast_data.parquet")
    q, d = catalog.queries(), str(tmp_path)
    n, e = catalog._graph(spark, d)
    ids = sorted(r.id for r in n.collect())
    m = np.zeros((len(ids), len(ids)))
    for r in e.collect():
        m[ids.index(r.dst), ids.index(r.src)] = 1
    m = np.where(m.sum(0) > 0, m / np.maximum(m.sum(0), 1), 1 / len(ids))
    v = np.full(len(ids), 1 / len(ids))
    for _ in range(20):
        v = 0.85 * m @ v + 0.15 / len(ids)
    want = dict(zip(ids, v))
    got = {r.id: r.score for r in q["pagerank_surveyed"](spark, d).collect()}
    few = {r.id: r.score for r in q["pagerank_top20"](spark, d).collect()}
    assert len(got) == 20 and all(abs(want[k] - v) < 1e-6 for k, v in got.items()) and any(abs(want[k] - v) > 1e-4 for k, v in few.items())
    assert set(got) == {r.id for r in q["general_union_surveyed"](spark, d).collect()}
    rel = {r.id: r.score for r in q["hybrid_relevance_cosine"](spark, d).collect()}
    asked = np.array(retrieve.hashed_embedding(catalog.QUESTION))
    assert set(rel) == set(want) and all(abs(v - 0.7 * float(asked @ np.array(retrieve.hashed_embedding(k))) - 0.3 * want[k]) < 1e-6 for k, v in rel.items())


def test_layout_of_a_large_graph(spark):
    m = graph.LAYOUT_LIMIT + 1000
    n = spark.range(m).selectExpr("1L repo_id", "concat('f', id) id").unionByName(spark.createDataFrame([(2, "a"), (2, "b")], "repo_id long, id string"))
    e = spark.range(m - 1).selectExpr("1L repo_id", "concat('f', id) src", "concat('f', id + 1) dst")
    got = graph.layout(n, e).collect()
    assert len({(r.repo_id, r.id) for r in got}) == len(got) == m + 2 and all(0 <= r.x <= 1000 and 0 <= r.y <= 1000 for r in got)


def test_far_nodes_by_cells_repel_as_all_do():
    pos = np.random.default_rng(1).random((900, 2))
    d = pos[:, None, :] - pos[None, :, :]
    want = (d * (0.25 / np.maximum(np.sqrt((d**2).sum(-1)), 0.01) ** 2)[..., None]).sum(1)
    assert np.linalg.norm(graph._gridded(pos, 0.5) - want) < 0.15 * np.linalg.norm(want)
