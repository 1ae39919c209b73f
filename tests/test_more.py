import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators import chat, graph, graphops, retrieve
from gristmill.session import checkpointed
from gristmill.sources import hosting, store

INFO = "repo_id long, path string, file_ord int, functions array<string>, classes array<string>, imports array<string>"


def test_order_of_files_decides(spark):
    rows = [(1, "a.py", 2, ["go"], [], []), (1, "b.py", 1, ["go"], [], []), (1, "c.py", 3, [], [], ["b.x", "go"]), (1, "d.py", 0, [], [], ["a.x"]), (1, "e.py", None, ["late"], [], [])]
    info = spark.createDataFrame(rows, INFO)
    assert {r.name: r.file for r in graph.symbols(info).collect()} == {"go": "a.py", "late": "e.py"}  # b.py is the last path, a.py the last file
    got = {(r.name, r.src) for r in graph.midpoints(graph.export_events(graph.resolved_imports(info))).collect()}
    assert got == {("x", "a.py"), ("go", "a.py")}  # d.py comes first
    assert ("x", "b.py") in {(r.name, r.src) for r in graph.midpoints(graph.export_events(graph.resolved_imports(info.drop("file_ord")))).collect()}


def test_strict_symbols_are_told_by_their_files(spark):
    rows = [(1, "a.py", 0, [], [], []), (1, "b.py", 1, [], [], []), (1, "c.py", 2, [], [], ["a.x", "b.x"])]
    info = spark.createDataFrame(rows, INFO)
    edges = lambda strict: {(r.src, r.dst) for r in graph.graph(info, strict)[1].filter("relation = 'imports'").collect()}
    assert edges(False) == {("a.py::x", "c.py")} and edges(True) == {("a.py::x", "c.py"), ("b.py::x", "c.py")}


def test_view(spark):
    assert graphops.level_after(1, -1) == 1 and graphops.level_after(1, 1) == 2 and graphops.toggled(("file", "import"), "file") == ("import",) and graphops.toggled(("import",), "file") == ("import", "file")
    nodes = spark.createDataFrame([(1, "a", "directory", "a"), (1, "a/b.py", "file", "b.py\nFunctions: "), (1, "os", "package", "os")], "repo_id long, id string, type string, label string")
    edges = spark.createDataFrame([(1, "a", "a/b.py", "contains"), (1, "os", "a/b.py", "imports")], "repo_id long, src string, dst string, relation string")
    assert {(r.id, r.importers, r.folders) for r in graphops.neighbour_labels(nodes, edges).collect()} == {("a", "", "b.py"), ("a/b.py", "os", "a"), ("os", "", "")}
    assert {r.colour for r in graphops.edge_style(edges).collect()} == {"amber", "blue"}
    assert [r.id for r in graphops.in_order(nodes).orderBy("position").collect()] == ["a/b.py", "os", "a"]


def test_addresses(spark):
    df = spark.createDataFrame([("/x/", "/y"), (None, "/y/z"), ("", None)], "s string, r string")
    assert [r.e for r in df.select(text.endpoint(F.col("s"), F.col("r")).alias("e")).collect()] == ["x", "y/z", ""]
    bad = spark.createDataFrame([("http://x/y",)], "u string")
    with pytest.raises(Exception, match="no repository address"):
        bad.select(text.repo_url(F.col("u"), strict=True)[0]).collect()


def test_document_of_other_languages(spark):
    none = F.lit(None).cast("array<string>")
    more = {"tags": F.array(F.lit("p"), F.lit("b")), "queries": none, "type": F.lit("non-code"), "name": F.lit(None).cast("string"), "size": F.lit(3)}
    assert spark.range(1).select(retrieve.document_text(F.lit("a.html"), F.lit("x"), none, none, none, more).alias("t")).first().t == "File: a.html\n\nx\n\ntags: p, b\ntype: non-code\nsize: 3\n"


def test_default_retriever(spark):
    chunks = retrieve.embedded(spark.createDataFrame([(i, w) for i, w in enumerate("red green blue red black white".split())], "vec_id long, chunk string"), "chunk")
    q = retrieve.embedded(spark.createDataFrame([(7, "red")], "query_id long, t string"), "t")
    got = retrieve.stuffed(chunks, q).first().context.split("\n\n")
    assert len(got) == retrieve.DEFAULT_NEIGHBOURS and got[:2] == ["red", "red"]


def test_buffer(spark):
    rows = [("s", 1, "human", "a"), ("s", 2, "ai", "b"), ("s", 2, "ai", "b"), ("s", 3, "human", " "), ("s", 4, "human", "c"), ("t", 1, "human", None)]
    got = {r.turn: r.buffer for r in chat.buffer(spark.createDataFrame(rows, "session_id string, turn int, role string, text string")).collect()}
    assert got == {1: "", 2: "human: a", 4: "human: a\nai: b"}


def test_tables_and_snapshots(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS gm LOCATION '{tmp_path}/db'")
    for _ in range(2):
        store.create_tables(spark, "gm")
    assert spark.table("gm.repositories").columns == ["id", "repo_name", "metadata"] and "file_path" in spark.table("gm.ast_data").columns
    spark.sql("DROP DATABASE gm CASCADE")
    for paths in (["a", "b"], ["c"]):
        store.save_context(spark.createDataFrame([(1, p) for p in paths], "repo_id long, path string"), f"{tmp_path}/context")
    assert [r.path for r in store.read_context(spark, f"{tmp_path}/context").collect()] == ["c"]


def test_packing_joins_the_texts_back(spark):
    rows = spark.createDataFrame([("g", i, "w " * 3, i * 10) for i in range(5)], "g string, o int, t string, more int")
    assert sorted((r.o, r.more, r.running) for r in retrieve.packed(rows, "g", "o", "t", F.lit(7)).collect()) == [(0, 0, 3), (1, 10, 6)]


def test_checkpoints_need_a_shared_folder(spark, monkeypatch):
    class Remote:
        master = "spark://x:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    class Frame:
        sparkSession = type("P", (), {"sparkContext": Remote(), "conf": type("C", (), {"get": staticmethod(lambda k, d=None: d)})()})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpointed(Frame())


TREE = {"": [{"path": "a", "type": "dir"}, {"path": "r.md", "type": "file"}], "a": [{"path": "a/b.py", "type": "file"}, {"path": "a/c", "type": "dir"}], "a/c": [{"path": "a/c/d.py", "type": "file"}]}


class Service(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        p = self.path.removeprefix("/repos/o/n").removeprefix("/contents").strip("/")
        got = {"full_name": "o/n"} if "contents" not in self.path else TREE.get(p, {"path": p, "type": "file", "content": "aGk="})
        self.send_response(404 if p == "gone" else 200)
        self.end_headers()
        self.wfile.write(json.dumps(got).encode())

    def log_message(self, *args):
        pass


def test_hosting(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/repos/o/n"
    spark.dataSource.register(hosting.HostingSource)
    read = lambda **o: spark.read.format("hosting").options(base=base, **o).load()
    assert sorted((r.path, r.content) for r in read().collect()) == [("a/b.py", "aGk="), ("a/c/d.py", "aGk="), ("r.md", "aGk=")]
    assert [r.path for r in read(folder="a/c").collect()] == ["a/c/d.py"] and json.loads(read(kind="metadata").first().json) == {"full_name": "o/n"}
    with pytest.raises(RuntimeError, match="could not read"):
        hosting.fetched(base + "/contents/gone")
    server.shutdown()
