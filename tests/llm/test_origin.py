import random

import pytest

from gristmill.llm import origin

LIB = "def load_{n}(a, b):\n    total = {n}\n    for i in range(a):\n        total += i * b\n        print(total, {n})\n    return total\n\n"


def module(seed, k=12):
    """Functions as written by hand: no two of one form."""
    rng = random.Random(seed)
    n = lambda: rng.randrange(10**6)
    forms = [
        lambda: f"    c_{n()} = g_{n()}(a, {n()})\n", lambda: f"    if a > {n()}:\n        b += [x_{n()}]\n", lambda: f"    for i_{n()} in range({n()}):\n        print(i, b)\n", lambda: f"    a.f_{n()}(b, key='k{n()}')\n", lambda: f"    d_{n()} = {{'x{n()}': b, 'y': [a, {n()}]}}\n",
        lambda: f"    e_{n()} = [q for q in b if q != {n()}]\n", lambda: f"    assert isinstance(a, T_{n()})\n", lambda: f"    while h_{n()}(a):\n        a -= {n()}\n", lambda: f"    with open('p{n()}') as f:\n        b = f.read({n()})\n", lambda: f"    w_{n()} = a[{n()}:] + b\n",
    ]
    return "".join(f"def f_{n()}({', '.join(['a', 'b', 'c', 'd'][: rng.randint(1, 4)])}):\n" + "".join(rng.choice(forms)() for _ in range(rng.randint(1, 4))) + f"    return b_{n()}[{n()}]\n\n" for _ in range(k))


def template(seed, k=9):
    rng = random.Random(seed)
    return "".join(f"class Part{rng.randrange(99)}(Base):\n" + "".join(f"    F_{rng.randrange(999)} = {j}\n" for j in range(rng.randint(4, 7))) + "\n" for _ in range(k))


@pytest.mark.parametrize(
    ("path", "text", "kind"),
    [
        ("a.py", "# Code generated by x 1.2; DO NOT EDIT.\nx = 1\n", "generated"), ("a.go", "/*\n * Copyright X\n */\n// AUTOGENERATED FILE - changes will be lost\npackage a\n", "generated"), ("a.js", "// Diese Datei wird automatisch erzeugt (q 1.2). Nicht bearbeiten.\nlet a = 1\n", "generated"), ("a.java", "/* Machine-made by x; edit y.tmpl instead */\nclass A {}\n", "generated"), ("a.js", "/* @generated from x.schema */\na()\n", "generated"),
        ("a.py", '# the tables here are not generated, edit them freely\nBANNER = "# DO NOT EDIT: written by render"\nx = f(1)\n', ""), ("a.c", "// Auto-generated method stub\nint f(void) { return 1; }\n", ""), ("a.py", "x = 1\n# Code generated by x; DO NOT EDIT.\n", ""), ("a.py", "# Renaming x broke 12 callers, most of them in generated code.\nx = f(1)\n", ""),
        ("a.py", template(3), "generated"), ("a.py", template(3) + module(5), ""),
        ("a.go", "package a\n" + "".join(f"func (m *T{i}) Get{i}() int32 {{\n\tif m == nil {{\n\t\treturn 0\n\t}}\n\treturn m.f{i}\n}}\n\n" for i in range(9)), "generated"), ("a.js", "!function(){" + "".join(f"function a{i}(b){{for(var c=0;c<{i};c++)if(b[c]=={i})return!0;return!1}}" for i in range(20)) + "}();", "minified"),
        ("a.ts", 'const data = "' + "Ab3/" * 400 + '";\n', "data"), ("a.py", "T = [\n" + "".join("    " + ", ".join(str((i * 7919 + j) % 251) for j in range(12)) + ",\n" for i in range(40)) + "]\n", "data"), ("a.py", "HELP = '" + "some words " * 60 + "'\n" + module(1), ""), ("a.py", module(2), ""), ("a.py", "\n# only a comment\n", ""),
    ],
)
def test_kinds(path, text, kind):
    assert origin.made_kind(text, origin.language(path))[0] == kind


def test_broken_text_has_no_kind():
    assert origin.made_kind("x = (", "python") is None and origin.made_kind("f( {", "js") is None


def test_fingerprints_do_not_see_layout_or_comments():
    a = module(3)
    b = "# a header\n" + a.replace("\n", "  # c\r\n").replace("    ", "\t")
    fa, fb = (set(origin.fingerprints(origin.made_kind(t, "python")[1])) for t in (a, b))
    assert fa == fb and len(fa) > 5
    c = set(origin.fingerprints(origin.made_kind(module(4), "python")[1]))
    assert len(fa & c) == 0


def test_rows(spark):
    lib, own = module(7), module(8)
    rows = [(i, i % 5, f"src/lib{i}.py", ("# v1\n" if i % 2 else "") + lib) for i in range(10)]  # five repositories hold copies
    rows += [(100 + i, 7, f"a/own{i}.py", own) for i in range(40)]  # copies within one repository alone
    rows += [(200, 5, "vendor/x/y.py", module(9)), (201, 6, "b/y.py", module(9)), (202, 6, "c.py", lib + "("), (203, 6, "d.py", ""), (204, 6, "e.txt", lib), (205, 6, "f.py", None), (206, None, "g.py", lib + module(10, 2)), (207, 6, "h.py", lib[: len(lib) // 2].rsplit("def", 1)[0] + module(11, 30)), (208, 99, "i.py", "x = 1\n")]
    df = spark.createDataFrame([(*r, "clash", [1]) for r in rows], "file_id long, repo_id long, path string, content string, kind string, prints array<int>").repartition(6)
    repos = spark.createDataFrame([(i, f"o/r{i}", None) for i in range(7)] + [(7, "o/r7", None), (7, "o/r7", None)], "id long, repo_name string, metadata string")
    got = {r.file_id: r.origin for r in origin.origins(df, repos).collect()}
    assert {got[i] for i in range(10)} == {"vendored"} and {got[100 + i] for i in range(40)} == {"hand"}
    assert got[200] == "vendored" and got[201] == "hand"  # two repositories are enough only in a vendor folder
    assert got[206] == "vendored" and got[207] == "hand" and got[208] == "hand" and not {202, 203, 204, 205} & set(got)
    assert origin.origins(df.limit(0), repos).count() == 0


def test_edited_copies_keep_their_share():
    for seed in range(20):
        rng = random.Random(seed)
        a = [f"t{rng.randrange(400)}" for _ in range(1200)]
        b = [f"edited{i}" if i % 80 == 40 else t for i, t in enumerate(a)]
        fa, fb = set(origin.fingerprints(a)), set(origin.fingerprints(b))
        assert len(fa & fb) >= origin.LEAST_SHARE * len(fb)
    assert origin.fingerprints([f"t{i}" for i in range(32)])


def test_edited_renamed_and_short_copies(spark):
    lib, short = module(21, 40), module(22, 2)[: -len("\n\n")] + "\n"
    local = "\n\n".join(x.replace("return ", f"return own{i} + ", 1) if i % 4 == 2 else x for i, x in enumerate(lib.split("\n\n")))  # two tokens more in 84
    renamed = lib.replace(lib.split("def ")[3].split("(")[0], "load_own")
    rows = [(i, i, f"lib{i}.py", lib) for i in range(3)] + [(10 + i, i, f"s{i}.py", short) for i in range(3)]
    rows += [(20, 3, "local.py", local), (21, 3, "renamed.py", renamed), (22, 3, "own.py", module(23, 40)), (23, 4, "a.py", lib), (23, 4, "b.py", module(24, 40) + lib)]
    repos = spark.createDataFrame([(i, f"o/r{i}") for i in range(5)], "id long, repo_name string")
    got = sorted((r.file_id, r.origin) for r in origin.origins(spark.createDataFrame(rows, "file_id long, repo_id long, path string, content string"), repos).collect())
    assert got == [*((i, "vendored") for i in (0, 1, 2, 10, 11, 12, 20, 21)), (22, "hand"), (23, "hand"), (23, "vendored")]
