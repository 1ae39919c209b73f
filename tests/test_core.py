import base64

import pytest
from pyspark.sql import functions as F

from gristmill.functions import paths, text, vectors
from gristmill.operators import chat, extract, retrieve
from gristmill.plans.engine import Engine, register_llm
from gristmill.sources import repository, store
from gristmill.streaming import ingest


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(("p", "ext"), [("A.PY", ".py"), (".bashrc", ""), ("x.", "."), ("a/...py", ""), ("..a.py", ".py"), ("a/b", ""), ("a.b/c", "")])
def test_extension(spark, p, ext):
    assert one(spark, paths.extension(F.col("p")), p=p) == ext


def test_paths(spark):
    assert one(spark, paths.ancestors(F.col("p")), p="a/b/c.py") == ["a", "a/b"] and one(spark, paths.ancestors(F.col("p")), p="c.py") == []
    assert [one(spark, paths.is_safe(F.col("p")), p=p) for p in ("a/b", "/a", "a/../b", "..")] == [True, False, False, False]


@pytest.mark.parametrize(("q", "c"), [("install it", "codebase"), ("which folder", "directory"), ("profile", "file"), ("subclass", "function"), ("hello", "general")])
def test_query_class(spark, q, c):
    assert one(spark, text.query_class(F.col("q")), q=q) == c


def test_url(spark):
    df = spark.createDataFrame([("https://github.com/o/r/",), ("https://github.com/o/r/sub/dir",), ("http://x/y",), (None,)], "u string")
    b, r = text.repo_url(F.col("u"))
    assert [tuple(x) for x in df.select(b, r).collect()] == [("https://github.com/o/r", None), ("https://github.com/o/r", "/sub/dir"), (None, None), (None, None)]


def test_listing(spark):
    rows = [(1, "file", "a.txt", base64.b64encode("hallo ü".encode()).decode()), (1, "file", "bad", "/w=="), (1, "dir", "d", None), (1, "file", "none", None), (1, "file", "/abs", "")]
    got = {r.path: r.content for r in repository.from_listing(spark.createDataFrame(rows, "repo_id long, type string, path string, content string")).collect()}
    assert got == {"a.txt": "hallo ü", "none": ""}


def test_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_bytes(b"def f():\r\n    pass\r")
    (tmp_path / "y.bin").write_bytes(b"\xff\xfe")
    rows = {r.path: r for r in repository.from_folder(spark, str(tmp_path), 3).collect()}
    assert rows["y.bin"].content is None and rows["a/x.py"].content == "def f():\r\n    pass\r"
    p = repository.prepared(repository.from_folder(spark, str(tmp_path), 3)).collect()
    assert [(r.path, r.content, r.size) for r in p] == [("a/x.py", "def f():\n    pass\n", 19)]


def test_latest(spark):
    df = spark.createDataFrame([(1, "a", "old", 1), (1, "a", "new", 2), (2, "a", None, 1)], "repo_id long, path string, content string, n int")
    assert {(r.repo_id, r.content) for r in repository.latest(df, "n").collect()} == {(1, "new"), (2, None)}


PY = "from . import y\nfrom .x import z\nfrom m import *\nimport a.b as c\nasync def s():\n    def h(): pass\nclass C:\n    def m(self): pass\ndef q(): pass\n"


def test_python_info():
    i = extract.python_info(PY)
    assert i == {"functions": ["q", "h", "m"], "classes": ["C"], "imports": ["None.y", "x.z", "m.*", "a.b"]}


def test_script_info():
    i = extract.script_info("import a from 'a';\nimport {b} from \"./b\";\nimport 'c';\nfunction f() { function g() {} }\nexport function e() {}\nclass K { m() {} }\nconst w = () => {};\nconst r = require('d');\nasync function s() {}\n")
    assert i["functions"] == ["f", "s"] and i["classes"] == ["K"] and i["imports"] == ["a", "./b", "c"]


def test_java_info():
    i = extract.java_info("import java.util.List;\nimport static a.b.*;\nclass A { A() {} int f(int x) { return g(x); } @X String h() throws E { if (x) { } return new B() { void k() {} }; } interface I { void p(); } }\n")
    assert i == {"functions": ["f", "h", "k", "p"], "classes": ["A"], "imports": ["java.util.List", "a.b"]}


def test_c_info():
    i = extract.c_info('#include <stdio.h>\n#include "a/b.h"\nint f(int x) { return g(x); }\nstatic char *h(void);\nstruct S { int a; };\n')
    assert i == {"functions": ["f", "h"], "classes": [], "imports": ["stdio.h", "a/b.h"]}


def test_file_info(spark):
    rows = [(1, "a.py", "def f(: pass"), (1, "b.go", 'package p\nimport (\n "fmt"\n "os"\n)\nimport x "net/http"\nfunc (r *T) M() {}\nfunc F() {}\n'), (1, "c.html", "<P><b>x</b></P>"), (1, "d.sql", "a;b;"), (1, "e.txt", "ü"), (1, "f.py", None), (1, "g.py", "x = 1")]
    got = {r.path: r for r in extract.file_info(spark.createDataFrame(rows, "repo_id long, path string, content string")).collect()}
    assert got["a.py"].error.startswith("SyntaxError") and got["a.py"].functions is None
    assert got["b.go"].functions == ["F"] and got["b.go"].imports == ["fmt", "os", "net/http"] and got["b.go"].classes is None
    assert got["c.html"].tags == ["p", "b"] and got["d.sql"].queries == ["a", "b", ""]
    assert (got["e.txt"].type, got["e.txt"].name, got["e.txt"].size) == ("non-code", "e.txt", 2) and "f.py" not in got
    assert got["g.py"].functions == [] and got["g.py"].error is None


def test_register_extractor(spark):
    extract.register_extractor(".foo", lambda t: {"functions": t.split()})
    try:
        df = spark.createDataFrame([(1, "a.foo", "x y")], "repo_id long, path string, content string")
        assert extract.file_info(df).first().functions == ["x", "y"]
    finally:
        del extract.PARSERS[".foo"]


def test_stored_info(spark):
    rows = [(1, 1, "a.py", '{"functions": ["f"]}'), (2, 1, "a.py", '{"functions": ["g"], "imports": []}'), (3, 1, "a.py", '{"functions": ["h"'), (4, 1, "/x", "{}"), (5, 1, "b", None)]
    got = extract.stored_info(spark.createDataFrame(rows, "id long, repo_id long, file_path string, ast_info string")).collect()
    assert [(r.path, r.functions, r.classes, r.imports) for r in got] == [("a.py", ["g"], None, [])]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.l2(F.col("a"), F.col("b")).alias("l")).collect()
    assert abs(got[0].c - 0.70710678) < 1e-6 and got[0].l == 1.0 and got[1].c == 0.0


def test_knn_in_blocks_with_ties_and_nulls(spark):
    v = spark.createDataFrame([(i, [float(i % 5), 0.0]) for i in range(40)] + [(98, None), (99, [1.0])], "vec_id long, embedding array<float>").repartition(5)
    q = v.filter("vec_id < 3").withColumnRenamed("vec_id", "query_id")
    a = sorted(map(tuple, retrieve.knn(v, q, k=7).collect()))
    b = sorted(map(tuple, retrieve.knn(v, q, k=7, block=1).collect()))
    assert a == b and [r[1] for r in a if r[0] == 0] and len(a) == 21
    assert [x[1] for x in sorted((r for r in a if r[0] == 1), key=lambda r: r[3])] == [1, 6, 11, 16, 21, 26, 31]
    assert retrieve.knn(v, q.limit(0)).count() == 0 and retrieve.knn(v.limit(0), q).count() == 0


def test_packing_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, 1, "a " * 5), (1, 2, "b " * 10), (1, 3, "c"), (2, 1, "d " * 11)], "g long, o int, t string")
    assert [(r.g, r.o) for r in retrieve.packed(df, "g", "o", "t", F.lit(10)).collect()] == [(1, 1)]


def test_running_sum_over_ranges(spark):
    df = spark.range(500).select(F.lit(1).alias("g"), F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
    got = {r.o: r.running for r in retrieve.running_sum(df, "g", "o", "v", partitions=6).collect()}
    s = 0
    for i in range(500):
        s += i % 7
        assert got[i] == s


def test_chunks(spark):
    t = "x" * 5000
    got = spark.createDataFrame([(t,), ("",), ("y" * 2000,)], "t string").select(retrieve.fixed_chunks(F.col("t")).alias("c")).collect()
    assert [len(c.chunk) for c in got[0].c] == [2000, 2000, 1800] and len(got[1].c) == 1 and len(got[2].c) == 1
    parts = retrieve.split_recursively("aa bb\n\ncc dd ee ff\n\ngg", 8, 3)
    assert all(len(p) <= 8 for p in parts) and "".join(parts).replace(" ", "").startswith("aabb") and parts[-1].endswith("gg")


def test_session_does_not_depend_on_order(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", None), (2, "a", "x"), (2, "b", "")], "repo_id long, path string, content string")
    got = {r.session_id for r in chat.session_of(df).collect()} | {r.session_id for r in chat.session_of(df.orderBy(F.desc("path"))).collect()}
    assert len(got) == 1
    s = chat.session_of(df)
    assert chat.new_sessions(s, s.limit(0)).count() == 1 and chat.new_sessions(s, s).count() == 0


def test_history(spark):
    rows = [("s", 1, "human", "q"), ("s", 1, "human", "q"), ("s", 2, "ai", "aa"), ("s", 3, "human", None), ("s", 4, "human", "z"), ("s", 5, "ai", " ")]
    got = [(r.turn, r.history_turns, r.history_chars, r.previous) for r in chat.history(spark.createDataFrame(rows, "session_id string, turn int, role string, text string")).orderBy("turn").collect()]
    assert got == [(1, 0, 0, None), (2, 1, 1, "q"), (4, 2, 3, "aa")]


def test_lines(spark):
    df = spark.createDataFrame([("s", 1, "ai", "hi\n1. one\n```py\n2. x\n```\n\nend")], "session_id string, turn int, role string, text string")
    assert [(r.line_no, r.kind) for r in chat.message_lines(df).orderBy("line_no").collect()] == [(0, "paragraph"), (1, "item"), (2, "fence"), (3, "code"), (4, "fence"), (6, "paragraph")]


def test_engine(spark):
    files = [(1, "app/main.py", "import json\nfrom app.utils import helper\n\ndef main():\n    helper()\n", 1), (1, "app/utils.py", "def helper():\n    pass\n", 1), (1, "README.md", "# A tool\n", 1)]
    e = Engine(spark).load(spark.createDataFrame(files, "repo_id long, path string, content string, file_ord int"))
    assert e.graph()[0].count() == 6  # 3 files, 1 folder, 1 symbol, 1 package
    seen = []
    register_llm(lambda p: seen.append(p) or "answer")
    try:
        assert e.ask("which file has helper") == "answer" and "Question: which file has helper" in seen[0] and "app/utils.py" in seen[0]
        assert e.ask("describe the whole codebase") == "answer" and "# A tool" in seen[1]
        for q in ("what does it do", "the main directory", "explain the function helper"):
            assert e.ask(q) == "answer"
        with pytest.raises(ValueError):
            e.ask(" ")
    finally:
        register_llm(lambda p: p)
    with pytest.raises(ValueError):
        Engine(spark).ask("x")


def test_store(spark, tmp_path):
    repos = spark.createDataFrame([(2, "a/b", '{"x": 2}'), (1, "a/b", '{"x": 1}')], "id long, repo_name string, metadata string")
    assert store.repository_metadata(repos).first().id == 1 and store.repository_metadata(repos, latest=True).first().id == 2
    info = extract.file_info(spark.createDataFrame([(7, "a.py", "x=1")], "repo_id long, path string, content string"))
    store.save_tables(repos, info, str(tmp_path))
    store.save_tables(repos, info, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "ast_data")).filter("repo_id = 7").count() == 2


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a.py", "def f(): pass")], "repo_id long, path string, content string").write.parquet(src)
    q = ingest.extract_stream(ingest.file_stream(spark, src, "repo_id long, path string, content string"), out, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [r.functions for r in spark.read.parquet(out).collect()] == [["f"]]
    m = spark.sql("SELECT 's' AS session_id, 1 AS turn, 'ai' AS role, 'x' AS text, timestamp'2024-01-01 10:00:00' AS sent_at UNION ALL SELECT 's', 1, 'ai', 'x', timestamp'2024-01-01 10:00:00' UNION ALL SELECT 's', 2, 'ai', 'yy', timestamp'2024-01-01 12:00:00'")
    assert sorted((r.messages, r.chars) for r in ingest.session_activity(m).collect()) == [(1, 1), (1, 2)]
