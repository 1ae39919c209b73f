"""Problem 1: functions paired with their documentation.

Function spans and comment spans of a file are extracted apart; then each function takes, by
an as-of join on lines, the nearest comment before it (in Python the nearest string statement after
its header), and the pair stands only if nothing else lies between.

Defined results: null content, other extensions and files that do not parse yield nothing; a function
whose documentation is missing, empty or trivial yields nothing; equal rows each yield their pairs.
"""

from __future__ import annotations

import ast
import inspect
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import grammar
from gristmill.llm.parsing import language, python_tree, source_files
from gristmill.llm.shapes import BAD, CLASSES, TOKENS, flat_templates, preprocessed, records

# How a placeholder starts, and the names of sections: fixed values.
_PLACEHOLDER = re.compile(
    r"\W*(?:[@\\]brief\s+)?(?:(?:todo|fixme|xxx|tbd|tba)\b|\{?@inherit|inherit(?:ed|s|doc)?\b|auto[- ]?generated\b|generated (?:by|method|constructor|stub|code)\b|\(?non-javadoc|(?:method|function|class) stub\b|placeholder\b|not documented|no documentation|undocumented)",
    re.I,
)
_SECTIONS = "Args|Arguments|Parameters|Params|Keyword Args|Keyword Arguments|Other Parameters|Returns?|Raises|Throws|Yields?|Attributes|Examples?|Usage|References|See Also|Notes?|Warnings?|Todo"
_TAG = re.compile(
    rf"(?:^|(?<=\s))[@\\](?!brief\b)[A-Za-z]|^[ \t]*:[A-Za-z][^:\n]*:|^[ \t]*(?:{_SECTIONS})[ \t]*::?[ \t]*$|^[ \t]*(?:Args|Arguments|Parameters|Params|Returns?|Raises|Throws|Yields?)[ \t]*:|^[ \t]*(?:{_SECTIONS})[ \t]*\n[ \t]*[-=~]{{3,}}",
    re.M,
)
_BRIEF = re.compile(r"[@\\]brief\b")
_WORD = re.compile(r"[^\W\d_]+")
_PART = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[^\W\d_A-Z]+|[A-Z]+")


@lru_cache(maxsize=50_000)
def name_words(name: str) -> frozenset[str]:
    return frozenset(w.lower() for w in [*_WORD.findall(name), *_PART.findall(name)])


def trivial(doc: str, name: str) -> bool:
    """Whether documentation says nothing: a placeholder, or fewer than three words beyond the name before the first tag."""
    if _PLACEHOLDER.match(doc):
        return True
    m = _TAG.search(doc)
    said = _BRIEF.sub(" ", doc[: m.start()] if m else doc)
    own = name_words(name)
    return sum(w.lower() not in own for w in _WORD.findall(said)) < 3


def cleaned(comment: str) -> str:
    """Comment text without its marks."""
    if comment.startswith("/*"):
        body = re.sub(r"^/\*+!?", "", comment[:-2] if comment.endswith("*/") and len(comment) >= 4 else comment)
        lines = [re.sub(r"^\s*\*+(?!/) ?", "", x) if i else x for i, x in enumerate(body.split("\n"))]
    else:
        lines = [re.sub(r"^\s*//+!? ?", "", x) for x in comment.split("\n")]
    return "\n".join(x.rstrip() for x in lines).strip()


# ---------------------------------------------------------------- Python
def python_pairs(text: str) -> list[tuple[str, int, int, int, str]] | None:
    """(name, line, first line, last line, documentation) of functions with documentation; None if the text does not parse."""
    tree = python_tree(text)
    if tree is None:
        return None
    functions, strings, others = [], [], []
    stack: list[tuple[ast.AST, bool]] = [(tree, False)]
    while stack:
        node, _ = stack.pop()
        for field in ("body", "orelse", "finalbody", "handlers", "cases"):
            for x in getattr(node, field, None) or ():
                if not isinstance(x, ast.stmt | ast.ExceptHandler | ast.match_case):
                    continue
                if isinstance(x, ast.Expr):
                    if isinstance(x.value, ast.Constant) and isinstance(x.value.value, str):
                        strings.append((x.lineno, x.col_offset, x.value.value))
                    else:
                        others.append((x.lineno, x.col_offset))
                elif isinstance(x, ast.stmt):
                    others.append((x.lineno, x.col_offset))
                if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef):
                    functions.append(x)
                if hasattr(x, "body") or hasattr(x, "handlers") or hasattr(x, "cases"):
                    stack.append((x, True))
    strings.sort(key=lambda s: s[:2])
    others.sort()
    at = [s[:2] for s in strings]
    out = []
    for f in functions:
        if f.name == "__init__" or f.name == "__new__":
            continue
        head = (f.body[0].lineno, f.body[0].col_offset)
        i = bisect_left(at, head)  # the nearest string statement at or after the end of the header
        if i == len(at) or at[i] > (f.end_lineno, f.end_col_offset):
            continue
        k = bisect_left(others, head)
        if k < len(others) and others[k] < at[i]:  # a statement stands between
            continue
        out.append((f.name, f.lineno, min([f.lineno, *(d.lineno for d in f.decorator_list)]), f.end_lineno, inspect.cleandoc(strings[i][2])))
    return out


# ---------------------------------------------------------------- languages with braces
_BRACKETS = re.compile(r"[()\[\]{}]")


class Lexed:
    """Tokens without comments, as a shape with offsets, and the comments as spans."""

    def __init__(self, text: str, lang: str):
        text = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
        if text[:1] == "﻿":
            text = " " + text[1:]
        self.original = text
        if lang == "c":
            text = preprocessed(text)
        elif lang == "java":
            text = records(text)
        elif lang in ("js", "ts"):
            if "${" in text:
                text = flat_templates(text)
            if text.startswith("#!"):
                text = "//" + text[2:]
        self.text, self.lang = text, lang
        cls = CLASSES[lang]
        sh, pos, comments = [], [], []
        for m in TOKENS[lang].finditer(text):
            t = m[0]
            c = cls[t]
            if t[:2] == "//" or t[:2] == "/*":
                comments.append((m.start(), m.end()))
            if len(c) == 1:
                sh.append(c)
                pos.append(m.start())
            else:
                for x in c:
                    sh.append(x)
                    pos.append(m.start())
        self.shape, self.pos, self.comments = "".join(sh), pos, comments
        self._lines: list[int] | None = None
        self._match: dict[int, int] | None = None

    def parses(self) -> bool:
        return grammar.accepted(grammar.reduced(self.shape, self.lang), self.lang)

    def line(self, offset: int) -> int:
        if self._lines is None:
            self._lines = [m.start() for m in re.finditer("\n", self.text)]
        return bisect_left(self._lines, offset) + 1

    @property
    def match(self) -> dict[int, int]:
        if self._match is None:
            self._match, stack = {}, []
            for m in _BRACKETS.finditer(self.shape):
                i = m.start()
                if m[0] in "([{":
                    stack.append(i)
                elif stack:
                    j = stack.pop()
                    self._match[j], self._match[i] = i, j
        return self._match

    def token(self, i: int) -> str:
        m = re.compile(r"#?[\w$]+").match(self.text, self.pos[i])
        return m[0] if m else ""

    def after(self, i: int) -> str:
        return self.shape[i : i + 1]


def _java_functions(x: Lexed):
    s, match = x.shape, x.match
    for m in re.finditer(r"(?<=[a>\]v])a\(", s):
        i = m.start()
        j = match.get(i + 1, -1) + 1
        if not j:
            continue
        while x.after(j) == "[":
            j = match[j] + 1
        if x.after(j) == "h":
            j += 1
            while x.after(j) in ("a", ".", ",", "@"):
                j += 1
        if x.after(j) != "{":
            continue
        k = i - 1
        while s[k] == "a" and k and s[k - 1] == ".":
            k -= 2
        if s[k - 1 : k] == "@":  # an annotation and then a name is a constructor
            continue
        a = i
        while a and s[a - 1] not in ";{}":
            a = match[a - 1] if s[a - 1] == ")" else a - 1
        d = a
        while s[d] == "@":  # behind the annotations
            d += 2
            while x.after(d) == ".":
                d += 2
            if x.after(d) == "(":
                d = match[d] + 1
        yield x.token(i), i, a, d, match[j]


def _c_functions(x: Lexed):
    s, match = x.shape, x.match
    for m in re.finditer(r"(?<=[av*m])a\(", s):
        i = m.start()
        j = match.get(i + 1, -1) + 1
        while x.after(j) == "a":
            j = match[j + 1] + 1 if x.after(j + 1) == "(" else j + 1
        if not j or x.after(j) != "{":
            continue
        a = i
        while a and s[a - 1] not in ";{}#":
            a = match[a - 1] if s[a - 1] in ")]" else a - 1
        yield x.token(i), i, a, a, match[j]


def _go_functions(x: Lexed):
    s, match = x.shape, x.match
    for m in re.finditer("F", s):
        i = m.start()
        k = i + 1
        if x.after(k) == "(":
            k = match[k] + 1
        if x.after(k) != "a":
            continue
        j = k + 1
        if x.after(j) == "[":
            j = match[j] + 1
        if x.after(j) != "(":
            continue
        j = match[j] + 1
        while x.after(j) and x.after(j) not in "{n;":
            if s[j] == "C" and x.after(j + 1) == "{":
                j = match[j + 1] + 1
            elif s[j] in "([":
                j = match[j] + 1
            else:
                j += 1
        if x.after(j) == "{":
            yield x.token(k), k, i, i, match[j]


def _script_body(x: Lexed, j: int) -> int:
    """Index of the brace of a body at j, behind a return type if there is one; -1 if none."""
    s, match = x.shape, x.match
    if x.after(j) == ":":
        j += 1
        fresh = True  # a brace here would belong to the type
        while x.after(j) and x.after(j) not in ";w=":
            if s[j] == "{" and not fresh:
                break
            if s[j] in "([{":
                j, fresh = match[j] + 1, False
                continue
            fresh = s[j] in ":|&n" and (fresh or s[j] != "n")
            j += 1
    while x.after(j) == "n":
        j += 1
    return j


def _script_functions(x: Lexed):
    s, match = x.shape, x.match
    taken = set()

    def back(i: int, over: str) -> tuple[int, int]:
        d = i
        while d and s[d - 1] in over and s[d - 1] != "n":
            d -= 1
        a = d
        while True:  # decorators on lines before
            k = a
            while k and s[k - 1] == "n":
                k -= 1
            if k and s[k - 1] == ")":
                k = match[k - 1]
            while k and s[k - 1] in "a.":
                k -= 1
            if not (k and s[k - 1] == "@"):
                return a, d
            a = k - 1

    for m in re.finditer(r"Ln*(?=[aA])", s):
        i = m.start()
        if x.token(i) != "const":
            continue
        k = m.end()
        j = k + 1
        if x.after(j) == ":":
            while x.after(j) and s[j] not in "=;":
                j = match[j] + 1 if s[j] in "([{" else j + 1
        if x.after(j) != "=":
            continue
        j += 1
        while x.after(j) == "n":
            j += 1
        f = j + 1 if x.after(j) == "A" and x.after(j + 1) in ("F", "(", "a", "<") else j
        end = -1
        if x.after(f) == "F":
            taken.add(f)
            p = s.find("(", f)
            b = _script_body(x, match[p] + 1) if p >= 0 else -1
            if x.after(b) == "{":
                end = match[b]
        else:
            p = f
            if x.after(p) == "<":
                p = s.find("(", p)
            w = match[p] + 1 if x.after(p) == "(" else p + 1 if x.after(p) in ("a", "A") else -1
            if w > 0 and x.after(w) == ":":
                while x.after(w) and s[w] not in "w;=":
                    w = match[w] + 1 if s[w] in "([{" else w + 1
            if w > 0 and x.after(w) == "w":
                b = w + 1
                while x.after(b) == "n":
                    b += 1
                if x.after(b) == "{":
                    end = match[b]
                else:  # an expression is the body
                    end = b
                    while end + 1 < len(s) and s[end + 1] not in ";n,":
                        end = match[end + 1] if s[end + 1] in "([{" else end + 1
        if end >= 0:
            a, d = back(i, "x")
            yield x.token(k), k, a, d, end
    for m in re.finditer(r"F[n*]*(?=[aAtCXLIHEDTcfSkdRByYNbixgrJ])", s):
        if m.start() in taken:
            continue
        k = m.end()
        p = k + 1
        if x.after(p) == "<":
            p = s.find("(", p)
        if p < 0 or x.after(p) != "(":
            continue
        b = _script_body(x, match[p] + 1)
        if x.after(b) == "{":
            a, d = back(m.start(), "Axd")
            yield x.token(k), k, a, d, match[b]
    for m in re.finditer(r"(?<=[{};n,)*aA])[aAtCXLEDTfkdByYNixgrJ](?=[(<])", s):
        i = m.start()
        if i and s[i - 1] in "*a" and re.search(r"F[n*]*\Z", s[max(0, i - 4) : i]):
            continue
        p = i + 1
        if s[p] == "<":
            q = re.compile(r"<[^(){};]*>(?=\()").match(s, p)
            if not q:
                continue
            p = q.end()
        if p not in match:
            continue
        b = match[p] + 1
        if x.after(b) == ":" and x.lang == "ts":
            b = _script_body(x, b)
        if x.after(b) != "{":
            continue
        if s[i] != "a" and x.token(i) in ("if", "for", "while", "with", "switch", "catch", "function", "super", "typeof", "return"):
            continue
        name = x.token(i)
        if name == "constructor" or (s[i - 1] == "a" and x.token(i - 1) in ("new",)):
            continue
        a, d = back(i, "aA*")
        yield name.lstrip("#"), i, a, d, match[b]


_FUNCTIONS = {"java": _java_functions, "c": _c_functions, "go": _go_functions, "js": _script_functions, "ts": _script_functions}


def comment_spans(x: Lexed) -> list[tuple[int, int, int, int]]:
    """(first line, last line, start, end) of comments that begin their line; runs of line comments are one."""
    out: list[tuple[int, int, int, int]] = []
    run = False
    for a, b in x.comments:
        first = x.line(a)
        own = not x.text[x._lines[first - 2] + 1 if first > 1 else 0 : a].strip()
        is_line = x.text[a + 1] == "/"
        if not own:
            run = False
            continue
        if is_line and run and out and out[-1][1] == first - 1:
            out[-1] = (out[-1][0], first, out[-1][2], b)
        else:
            out.append((first, first if is_line else x.line(b - 1), a, b))
        run = is_line
    return out


def brace_pairs(text: str, lang: str) -> list[tuple[str, int, int, int, str]] | None:
    """As ``python_pairs``, for the languages with braces."""
    x = Lexed(text, lang)
    if BAD in x.shape or not x.parses():
        return None
    if not x.comments:
        return []
    comments = comment_spans(x)
    if not comments:
        return []
    ends = [c[1] for c in comments]
    out = []
    for name, i, a, d, end in _FUNCTIONS[lang](x):
        for anchor in (d, a) if a != d else (a,):
            line = x.line(x.pos[anchor])
            k = bisect_right(ends, line - 1) - 1  # as of the line above
            if k < 0 or ends[k] != line - 1:
                continue
            p = anchor - 1
            while p >= 0 and x.shape[p] == "n":
                p -= 1
            if p >= 0 and x.pos[p] > comments[k][2]:  # code stands behind the comment
                continue
            out.append((name, x.line(x.pos[i]), x.line(x.pos[a]), x.line(x.pos[end]), cleaned(x.text[comments[k][2] : comments[k][3]])))
            break
    return out


def documented(text: str, lang: str) -> list[tuple[str, int, int, int, str]]:
    """Functions with documentation that says something, as ``python_pairs``; lines of names are counted by ``\\n`` alone."""
    pairs = python_pairs(text) if lang == "python" else brace_pairs(text, lang)
    out = [p for p in pairs or () if p[4] and not trivial(p[4], p[0])]
    if out and "\r" in text and re.search(r"\r(?!\n)", text):  # a lone return ends a line for the languages, but not for the numbering
        before = [0, *accumulate(e != "\r" for e in re.findall(r"\r\n|\n|\r", text))]
        out = [(n, before[line - 1] + 1, *rest) for n, line, *rest in out]
    return out


# ---------------------------------------------------------------- Spark
def function_pairs(files: DataFrame, id_col: str = "file_id", path_col: str = "path", content_col: str = "content", with_text: bool = True) -> DataFrame:
    """(``id_col``, language, func_name, line_no[, code, description]): one row per documented function.

    A narrow map over the files: no shuffle, so a repository with a third of all files needs no care.
    """
    rows = source_files(files, id_col, path_col, content_col)
    schema = pa.schema([("__id", pa.int64()), ("language", pa.string()), ("func_name", pa.string()), ("line_no", pa.int64())] + ([("code", pa.string()), ("description", pa.string())] if with_text else []))

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in schema.names]
            for i, path, text in zip(b.column("__id").to_pylist(), b.column("__path").to_pylist(), b.column("__text").to_pylist()):
                lang = language(path)
                found = documented(text, lang)
                lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if found and with_text else []
                for name, line, first, last, doc in found:
                    for c, v in zip(cols, (i, lang, name, line, "\n".join(lines[first - 1 : last]), doc)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    ddl = f"__id long, language string, func_name string, line_no long{', code string, description string' if with_text else ''}"
    return rows.mapInArrow(run, ddl).withColumnRenamed("__id", id_col)


def listed_share(pairs: DataFrame, ast_data: DataFrame, files: DataFrame) -> DataFrame:
    """Documented functions per language and how many of their names the file's stored list (``ast_info``) has.

    The list of a file is the union over its rows; ``ast_info`` that is cut short counts as no list.
    """
    listed = (
        ast_data.select("repo_id", F.col("file_path").alias("path"), F.explode(F.from_json(F.get_json_object("ast_info", "$.functions"), "array<string>")).alias("func_name")).distinct().withColumn("listed", F.lit(True))
    )
    where = files.select("file_id", "repo_id", "path")
    return (
        pairs.select("file_id", "language", "func_name").join(where, "file_id").join(listed, ["repo_id", "path", "func_name"], "left")
        .groupBy("language").agg(F.count("*").alias("pairs"), F.count("listed").alias("listed_pairs"))
    )
