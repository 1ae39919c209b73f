import random

import pytest

from gristmill.llm import grammar, parsing
from gristmill.llm.shapes import shape

GOOD = {
    "js": [
        "", "// only\n", "const f = async (a = 1, {b, ...c}, [d]) => { return a ? b : c }\nexport default class A extends B.C { static x = 1; #p; get y() { return this.#p } async *z() {} }\n", "for (const x of xs) if (x) break\nelse continue\n",
        "!function(){var a=/[/'\"]+/g,b=a/2/3;for(var i=0;i<9;i++)if(a[i]==1)return!0;do x--;while(x>0)}();", "import a, {b as c, default as d} from 'x'\nimport * as e from './e'\nexport {c, d as q}\nexport * from 'y'\n", "const t = `a ${x + `${y}`} }{ <<<<<<< `;\n",
        "/* <<<<<<< */ label: while (1) { switch (a) { case 1: case 'b': f(); break; default: } }\ntry { a() } catch { b() } finally { c() }\n", "x = {a, 'b': 1, [c]: 2, d() {}, async *e() {}, get f() { return 1 }, ...g}\n", "let a\nlet b = 1\n++b\nreturn_(a)\n", "a = b\n  .c()\n  ?.d?.[0]\n", "new Foo(...xs)\ndelete a.b, typeof c\n",
        "const re = x => /a[/]b/.test(x) && !(y instanceof Z)\n", "if (a) b; else if (c) d; else { e }\n", "yieldy(function* () { const z = yield x; yield* y })\n",
    ],
    "ts": [
        "interface A<T> extends B, C<D> { x?: number; readonly y: string[]; f(a: number): void; [k: string]: any }\ntype U = 'a' | 'b' | { c: number }\nenum E { A, B = 2 }\n", "export async function f<T>(a: Map<string, T[]>, b?: number, ...c: string[]): Promise<void> { const x = a as unknown as T; return y!.z }\n",
        "class A<T> extends B<T> implements C { private x: number = 1; constructor(private readonly y: string, public z?: number) { super() } static async g(): Promise<number[]> { return [] } declare w: string; }\n", "const f = (x: number): string => String(x);\nlet m: Record<string, number> = {};\n", "export abstract class Q { abstract a(): void; protected b(): void {} }\n", "declare module 'x' { }\n",
    ],
    "java": [
        "", "package a.b;\nimport java.util.*;\nimport static a.B.c;\n@X(y = {1, 2}) public final class A<T extends B & C> extends D<T> implements E, F<G> { private static final int[] X = {1, 2}; A(int a) throws E1, E2 { this.a = a; } static { f(); } <U> U g(List<? super U> x, int... y) { return (U) x.get(0); } }\n",
        "interface I { void a(); default int b() { return 1; } int C = 2; }\nenum E { A(1) { void f() {} }, B; E() {} }\n@interface N { int v() default 1; }\nrecord R(int a, String b) { R { } }\n",
        'class A { void f() { for (int i = 0, j = 1; i < n; i++) { if (a) continue; else break; } for (String s : xs) {} do { x--; } while (x > 0); try (R r = g()) { } catch (A | B e) { throw new X("a" + e); } finally { } switch (k) { case 1: case 2: h(); break; default: } int y = switch (k) { case 1 -> 2; default -> 3; }; Runnable q = () -> { }; xs.forEach(A::b); int[][] z = new int[3][]; Object o = new T() { int w; }; String t = """\n  a "b" \\""" c\n  """; synchronized (this) { } label: while (true) { break label; } if (o instanceof String s) { } a = b > c ? d : e; } }\n',
    ],
    "go": [
        'package a\n\nimport (\n\t"fmt"\n\tx "y/z"\n)\n\ntype T struct {\n\ta, b int `json:"a"`\n\t*E\n}\n\ntype I interface {\n\tF(a int) (int, error)\n}\n\nfunc (t *T) M(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[k]; ok && v > 1 {\n\t\treturn v, nil\n\t} else if x {\n\t}\n\tfor i := range xs {\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor {\n\t}\n\tswitch y := z.(type) {\n\tcase int, string:\n\t\tf()\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\tcase ch <- 1:\n\t}\n\tgo func() { x() }()\n\tdefer u()\n\ta := []T{{1, 2}, {a: 3}}\n\tm := map[string][]int{\n\t\t"a": {1},\n\t}\n\tvar s = &T{a: 1}\n\treturn\n}\n',
        'package a\n\nvar x, y = 1, 2\n\nconst (\n\tA = iota\n\tB\n)\n\nfunc F[K comparable, V int | string](m map[K]V) chan<- int { return nil }\n\nvar raw = `\n=======\nfunc ( {\n`\n',
    ],
    "c": [
        "", "#include <a.h>\n#define X(a) \\\n  ((a) {\nstatic const char *const s[] = {\"a\" \"b\", 0};\nstruct S { int a : 3; union { int b; } u; } x = { .a = 1 };\nenum E { A = 1, B };\ntypedef int (*fn)(int, char *);\nunsigned long\nf(const void *p, int n, ...)\n{\n  int i, *q = &n, a[3][4];\n  for (i = 0; i < n; i++) { if (!p) continue; else goto end; }\n  do { n--; } while (n);\n  switch (n) { case 1: case A: return (int)sizeof(struct S) * -1; default: break; }\n  q->a.b[1](2)++;\nend:\n  return n ? *q : ~1u;\n}\n",
        "int f(void);\n#if 0\nstray ' notes ( here\n#endif\n#ifdef __cplusplus\nextern \"C\" {\n#endif\n#ifdef A\nint g(int a) {\n#else\nint g(void) {\n#endif\n  return 1; }\n#ifdef __cplusplus\n}\n#endif\n", "/* <<<<<<< */ char c = '\\''; char *s = \"<<<<<<< x\";\n",
    ],
    "python": ["", "def f():\n    '''x'''\n", 'S = """\n<<<<<<< a\ndef f( :\n"""\n', "match x:\n    case [1, *_]: pass\n"],
}
BAD = {
    "js": ["function f( {", "a b c\n", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x\n", "404: Not Found", "const x = ;", "x = 'abc\n", "x = `abc", "function f() {\n  a(\n...", "f(a: number)", "interface A { x: number }", "def f(self):\n  pass\n", '{"a": 1, "b": [2]}', "rate limit exceeded", "int x = 5;", "if (a { b }", "x = [1, 2", "/* open", "#include <a.h>\n", "class A { public x() {} }", "return }"],
    "ts": ["function f(a: number {", "package a;\nclass B {}", "let x: = 1", "<html><body></body></html>", "class {{ }"],
    "java": ["class A { void f() { }", "void f() { }", "class A { void f() { int x = ; } }", "class A { } }", "class A { String s = \"a; }", "import a.b\nclass A {}", '{"a": 1}', "function f() {}", "class A { void f() { void g() { } } }", "package a\nclass A {}"],
    "go": ["", "func f() {}\n", "package a\nfunc f( {\n}\n", "package a\nfunc f() {\n", "package a\n\nfoo bar baz\n", "package a\nvar x = `abc\n", "package a\nfunc f() {\n\tx := \n}\n", "package a\nfunc f()\n{\n\tx(1\n\t)\n}\n"],
    "c": ["int f( {", "int f() { return 1 }", "import a from 'b';\nexport function f() {}\n", "class A { };", "char *s = \"a;\n", "404: Not Found", "int a[3;", "def f(self):\n  pass\n", "#if 0\nx\n#endif\n}\n"],
    "python": ["def f(:", "x = (1", "  x", "print 'a'", '"""open', "<<<<<<< HEAD\n", "a\x00b"],
}


@pytest.mark.parametrize("lang", GOOD)
def test_good(lang):
    assert [t for t in GOOD[lang] if not parsing.parses(t, lang)] == []


@pytest.mark.parametrize("lang", BAD)
def test_bad(lang):
    assert [t for t in BAD[lang] if parsing.parses(t, lang)] == []


def long_text(lang: str, rng: random.Random) -> str:
    units = {
        "js": ["function f{i}(a, b) {{\n  if (a) {{\n    g(b, {i});\n  }}\n  return a;\n}}\n", "/* a ( comment\n   over lines */\n", "const t{i} = `raw ( text\n over {{ lines`;\n"],
        "java": ["class A{i} {{\n  int f(int x) {{\n    return x + {i};\n  }}\n}}\n", "/* a ( comment\n over lines */\n"],
        "go": ["func f{i}(a int) int {{\n\tif a > {i} {{\n\t\treturn 1\n\t}}\n\treturn a\n}}\n\n", "/* a (\n comment */\n", "var s{i} = `raw ( text\n over {{ lines`\n"],
        "c": ["int f{i}(int a)\n{{\n  if (a) {{\n    g({i});\n  }}\n  return a;\n}}\n", "/* a ( comment\n over lines */\n"],
        "python": ["def f{i}(a,\n       b=({i},)):\n    '''doc ( over\n    lines'''\n    return [a,\n        b]\n\n", "# comment (\n"],
    }[lang]
    head = "package a\n" if lang == "go" else ""
    return head + "".join(rng.choice(units).format(i=i) for i in range(40))


@pytest.mark.parametrize("lang", ["js", "java", "go", "c", "python"])
def test_chunks_agree_with_the_whole(lang):
    rng = random.Random(5)
    for _ in range(25):
        text = long_text(lang, rng)
        if rng.random() < 0.7:  # damage
            k = rng.randrange(len(text))
            text = rng.choice([text[:k], text[:k] + text[k + 1 :], text[:k] + rng.choice("(){}\"'`*/") + text[k:]])
        maps = [parsing.chunk_states(c, lang) for c in parsing.cut_lines(parsing.plain(text, lang), rng.choice([40, 90, 200]), lang)]
        whole = parsing.parses(text, lang)
        left = maps[0]
        for m in maps[1:]:
            left = parsing.joined(left, m, lang)
        tree = list(maps)
        while len(tree) > 1:
            tree = [parsing.joined(tree[i], tree[i + 1], lang) if i + 1 < len(tree) else tree[i] for i in range(0, len(tree), 2)]
        assert parsing.accepted_map(left, lang) == parsing.accepted_map(tree[0], lang)  # associative
        assert parsing.accepted_map(tree[0], lang) == whole, text


# Every text is judged as CPython's parser judges it.
PYTHON = [
    "x = yield\n", "async def f(a, /, b: int = 1, *c, d, e=2, **g) -> x[1]:\n    async with a as b, c() as (d, e):\n        pass\n    async for x, *y in z: await x\n    return [i async for i in a if b if c]\n", "with (open(a) as b, c):\n  pass\n", "@a.b(c)\n@d\nclass A[T: int](B, metaclass=C): x: int = 1; y = 2\n",
    "try:\n    a\nexcept* (A, B) as c:\n    b\nelse:\n    c\nfinally:\n    d\n", "if a:\n\tb\nelif c: d\nelse:\n\te\n", "x = lambda *a, b=1, **c: (y := a) if b else lambda: 0\n", "a, *b = c = d[1:2, ::3, ...]\n", "f(a, *b, c=1, **d)\nf(x for x in y)\nprint(*a, sep='')\n",
    "match = case = 1\nmatch x, y:\n    case A(b=1) | {'k': v, **r} if z: pass\n    case [1, *_] as q: pass\n    case (a as b): pass\n", "x = f'{a!r:>{w}} {b=} {{}} {c[\"d\"]:%Y}'\n", "x = 'C:\\\\Users' rb'\\x' if 0 else 1_0.5e-3j\n", "from . import (a as b,\n  c,)\nfrom .. import d\nfrom ...e.f import *\nimport g.h as i, j\n",
    "del a.b, c[0], (d, e)\nassert a, b\nraise A from b\nglobal q\n", "type X[T] = list[T]\n", "for x in a, b:\n  continue\nelse:\n  pass\nwhile a: break\n", "x = a \\\n  + b\nif a: \\\n  b\n", "not a not in b is not c\n", "class A:\n\n  def f(self): ...\n# c\n      # d\n  x = 1\n", "print >>f, x\n",
    "f(a=1, b)\n", "f(**a, *b)\n", "def f(a=1, b): pass\n", "f() = 1\n", "None = 1\n", "a + 1 += 2\n", "x = 01\n", "try:\n  a\nb\n", "if a:\nb\n", "  a\n", "if a:\n    b\n  c\n", "if a:\n\tb\n        c\n", "else:\n  a\n", "@a\nx = 1\n", "x = 'C:\\Users'\n", "f'{a'\n", "f'{}'\n", "x = (y = 1)\n", "import a.b as c.d\n",
    "class A(: pass\n", "lambda x: = 1\n", "return return\n", "x = 1 if 2\n", "match x:\n  a\n", "b'\u00e9'\n", "a b\n", "x = [1 2]\n", "del f()\n", "for f() in x: pass\n", "def f(x) -> : pass\n",
]


@pytest.mark.parametrize("text", PYTHON)
def test_python_agrees_with_cpython(text):
    assert parsing.parses(text, "python") == (parsing.python_tree(text) is not None)


def test_python_sources_and_damaged_ones():
    import inspect
    import json.decoder
    import textwrap

    rng = random.Random(3)
    for mod in (textwrap, json.decoder, random):
        text = inspect.getsource(mod)
        assert parsing.parses(text, "python")
        for _ in range(30):
            k = rng.randrange(len(text))
            bad = rng.choice([text[:k], text[:k] + text[k + 1 :], text[:k] + rng.choice("(){}\"'`:=,. \n") + text[k:]])
            assert parsing.parses(bad, "python") == (parsing.python_tree(bad) is not None), bad[k - 40 : k + 40]


def test_nesting_is_never_too_deep():
    deep = "def f(a):\n    '''d'''\n    x = " + "- " * 100_000 + "1\n    return " + "(" * 3000 + "a" + ")" * 3000 + "\n"
    assert parsing.parses(deep, "python") and not parsing.parses(deep[:-2], "python")
    assert [type(x).__name__ for x in parsing.python_tree(deep).body[0].body] == ["Expr", "Pass", "Pass"]
    assert parsing.parses("x = " + "[" * 3000 + "]" * 3000 + ";", "js") and not parsing.parses("x = " + "[" * 3000 + "]" * 2999 + ";", "js")


def test_summary_of_a_chunk():
    assert grammar.owed(grammar.reduced(shape("} else { f(", "js"), "js")) == "}{("


def test_rows(spark):
    rows = [(1, 1, "a.py", "x = 1"), (2, 1, "b.JS", "x = ("), (2, 1, "b.JS", "x = ("), (3, 1, "c.go", None), (4, 2, "d.txt", "("), (5, 2, "e.c", ""), (6, None, "f.ts", "let x"), (7, 2, None, "x")]
    df = spark.createDataFrame([(*r, "zz", True) for r in rows], "file_id long, repo_id long, path string, content string, language string, parses boolean")
    v = parsing.syntax_verdicts(df, keep=("repo_id",))
    got = sorted((r.file_id, r.language, r.parses) for r in v.collect())
    assert got == [(1, "python", True), (2, "js", False), (2, "js", False), (5, "c", True), (6, "ts", True)]
    rates = {(r.repo_id, r.language): (r.files, r.broken_files, r.broken_rate) for r in parsing.parse_rates(v).collect()}
    assert rates[1, "js"] == (2, 2, 1.0) and rates[None, "ts"] == (1, 0, 0.0)
    assert parsing.syntax_verdicts(df.limit(0)).count() == 0


def test_long_files_in_chunks(spark):
    rng = random.Random(9)
    texts = []
    for lang, ext in (("js", "js"), ("java", "java"), ("go", "go"), ("c", "c"), ("python", "py")):
        t = long_text(lang, rng)
        texts += [(f"a.{ext}", t), (f"b.{ext}", t[: len(t) * 2 // 3].rstrip("}\n \t") + "("), (f"a.{ext}", t)]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(texts)], "file_id long, path string, content string")
    whole = {r.file_id: r.parses for r in parsing.syntax_verdicts(df).collect()}
    cut = {r.file_id: r.parses for r in parsing.syntax_verdicts(df, chunk_chars=150).collect()}
    assert whole == cut and set(whole.values()) == {True, False} and len(cut) == len(texts)
