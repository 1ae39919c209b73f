import pytest

from gristmill.llm import docpairs

PY = '''
class A:
    def __init__(self):
        """Makes a thing of some kind."""
    @deco(
        1)
    async def load_all(self, x=(1,
            2)):
        r"""Loads every row that is asked for.

        Args:
            x: how many
        """
    def todo(self):
        """TODO write this down some day please"""
    def load_rows(self): "Load rows function."
    def code(self):
        x = 1
        """Not a docstring, it comes too late."""
def outer():
    f"""Not {1} a docstring either, really."""
    def inner():
        "Inner ones count as any other."
        return 1
def tagged():
    """:param a: the first of them
    :return: words that are after a tag"""
'''
JS = """/** Licence of it all */

/**
 * Adds two of them up.
 * @param {number} a the first
 */
export async function add(a, b = {}) { return a }

// Runs over lines, and
// goes on here for long.
const run = async (x) => {
  return x;
};

/* Too far away from it */

function far() {}

x(); // trailing words do not count
function trail() {}

class K {
  /** Makes a new thing of it. */
  constructor() {}
  /** Gives back what was put in. */
  static async get() { if (x) { y() } }
  /** Reads the size in bytes now. */
  @deco()
  get size() { return 1 }
  // TODO: something to say here
  nope() {}
}
/** A let is not counted here. */
let z = () => { }
/** Expressions are bodies just as well. */
const inc = x => x + 1;
"""
TS = """/** Says what is in there. */
function over(a: string): void;
/** Says it with a body now. */
function over(a: any): { x: number } { return a }
interface I {
  /** A method without a body there. */
  m(): void;
}
"""
JAVA = """package a;
/** The class itself is not one. */
public class A {
    /** Builds the thing from its parts. */
    public A() { }
    /**
     * Walks over all of the rows.
     */
    @Override @X(y = {1, 2})
    public <T> List<T> walkRows(Map<String, int[]> m, final int... n) throws E, F { if (a) { b(); } return null; }
    /** An abstract one has no body. */
    abstract void none();
    @Deprecated
    // Between the marker and its method, still fine.
    void between() { }
    /** {@inheritDoc} and more words after it */
    void inherited() { }
    // ( { " a stray
    void stray() { }
}
"""
GO = """package a

// Rotate turns the whole thing over once.
func (r *T) Rotate(a int, f func(int) bool) (int, error) {
	return 1, nil
}

/*
Deprecated.
*/
func Old() {
}

// Maps keys to what they hold.
func Keys[K comparable](m map[K]struct{}) []K { return nil }

// A prototype has no body here.
func asm(x int)
"""
C = """#include <a.h>
/** @brief Frees what was held before. */
static unsigned long
free_it(const void *p, int (*f)(int))
{
    if (p) { g(p); }
}
/* Only declared in this place. */
int declared(int x);
#define M 1
// Comes after a macro, but is fine.
int after(void) { return 1; }
"""


@pytest.mark.parametrize(
    ("text", "lang", "want"),
    [
        (PY, "python", {("load_all", 7), ("inner", 22)}),
        (JS, "js", {("add", 7), ("run", 11), ("get", 26), ("size", 29), ("inc", 36)}),
        (TS, "ts", {("over", 4)}),
        (JAVA, "java", {("walkRows", 10), ("between", 15)}),
        (GO, "go", {("Rotate", 4), ("Keys", 15)}),
        (C, "c", {("free_it", 4), ("after", 12)}),
    ],
)
def test_pairs(text, lang, want):
    assert {(n, line) for n, line, *_ in docpairs.documented(text, lang)} == want
    crlf = text.replace("\n", "\r\n")
    assert {(n, line) for n, line, *_ in docpairs.documented(crlf, lang)} == want


def test_lone_returns_are_no_lines():
    text = "x = 1\ry = 2\n\ndef f():\r    'Gives back what it was given.'\n    return 1\n"
    assert [(n, line) for n, line, *_ in docpairs.documented(text, "python")] == [("f", 3)]
    text = "int a;\rint b;\n// Gives back what it was given.\nint f(void) { return 1; }\n"
    assert [(n, line) for n, line, *_ in docpairs.documented(text, "c")] == [("f", 3)]


@pytest.mark.parametrize(
    ("doc", "name", "trivial"),
    [
        ("", "f", True), ("...", "f", True), ("FIXME add docs here right now", "f", True), ("xxx - who owns this thing here", "f", True), ("tbd by the team of it", "f", True), ("Auto-generated method stub of a tool", "f", True), ("{@inheritDoc} of all of it", "f", True),
        ("Expand shared budget", "expandSharedBudget", True), ("Expand shared budget now", "expand_shared_budget", True), ("Expands the shared budget", "expand_shared_budget", True), ("Expands the shared budget by half", "expand_shared_budget", False),
        ("@brief Frees what was held", "f", False), ("@param x the first of all", "f", True), ("Args:\n x: the first of all", "f", True), ("Prüft den Weg", "f", False), ("One two\n@return three four", "f", True), ("Todos are listed one by one", "f", False),
    ],
)
def test_trivial(doc, name, trivial):
    assert docpairs.trivial(doc, name) is trivial


def test_rows(spark):
    rows = [(1, "a.py", PY), (1, "a.py", PY), (2, "b.py", PY + "("), (3, "c.txt", PY), (4, "d.js", None), (5, "e.go", ""), (6, None, PY)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "file_id long, path string, content string, line_no int, code string")
    got = docpairs.function_pairs(df).collect()
    assert sorted((r.file_id, r.func_name) for r in got) == [(1, "inner"), (1, "inner"), (1, "load_all"), (1, "load_all")]
    one = next(r for r in got if r.func_name == "load_all")
    assert one.code.startswith("    @deco(") and one.code.rstrip().endswith('"""') and one.description.startswith("Loads every row")
    assert docpairs.function_pairs(df.limit(0)).count() == 0


def test_listed(spark):
    files = spark.createDataFrame([(1, 9, "a.py", PY)], "file_id long, repo_id long, path string, content string")
    info = spark.createDataFrame([(9, "a.py", '{"functions": ["inner"]}'), (9, "a.py", '{"functions": ["inn'), (9, "b.py", None)], "repo_id long, file_path string, ast_info string")
    r = docpairs.listed_share(docpairs.function_pairs(files, with_text=False), info, files).first()
    assert (r.pairs, r.listed_pairs) == (2, 1)
