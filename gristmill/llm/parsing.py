"""Problem 2: source files that do not parse.

``parses`` judges one text: its shape, brackets reduced, then its statements by the local grammar of its language.
``syntax_verdicts`` judges every row of a DataFrame: a text of one chunk where it lies, a longer one in chunks that are
lexed and reduced apart (see ``chunk_states``), spread over the cluster, then joined in order.  Python is judged like
the other languages; no parser of a compiler takes part, and no depth of nesting is too deep.

Defined results: null content gives no row; empty content is a valid file except in Go, which
asks for a package clause; text of an extension that is no language here gives no row; columns
beside those named are ignored; rows repeated are judged each by itself.
"""

from __future__ import annotations

import ast
import re
import warnings

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import grammar, pygrammar, shapes
from gristmill.llm.shapes import BAD
from gristmill.session import spread

LANGUAGES = {".py": "python", ".js": "js", ".ts": "ts", ".java": "java", ".go": "go", ".c": "c", ".h": "c"}
SOURCE = r"(?i)\.(?:py|js|ts|java|go|c|h)$"
#: Characters of a chunk, about: what is lexed at once.
CHUNK_CHARS = 1 << 13

def shape(text: str, lang: str) -> str:
    """The shape of a text or chunk that begins outside strings and comments."""
    return pygrammar.shape(text) if lang == "python" else shapes.shape(text, lang)


def python_tree(text: str) -> ast.Module | None:
    """The tree of a Python text, None if it breaks the grammar; of a text nested too deep for CPython's parser, the tree without its plain statements."""
    text = text[1:] if text[:1] == "\ufeff" else text
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(text)
        except (SyntaxError, ValueError):
            return None
        except (RecursionError, MemoryError):
            pass
        if not parses(text, "python"):
            return None
        try:
            return ast.parse(pygrammar.outline(text.replace("\r\n", "\n").replace("\r", "\n")))
        except (SyntaxError, RecursionError, MemoryError):  # too deep in a header itself
            return ast.Module(body=[], type_ignores=[])


def language(path: str | None) -> str | None:
    dot = (path or "").rfind(".")
    return LANGUAGES.get(path[dot:].lower()) if dot >= 0 else None


def plain(text: str, lang: str) -> str:
    """Text with line ends made one and without a byte order mark; a Python text begins with a line end, which carries the first indentation."""
    text = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    text = text[1:] if text[:1] == "\ufeff" else text
    return "\n" + text if lang == "python" else text


def parses(text: str, lang: str) -> bool:
    return grammar.accepted(grammar.reduced(shape(plain(text, lang), lang), lang), lang)


# ---------------------------------------------------------------- chunks of large files
#: Lexer states in which a chunk cut at a line end may begin, with what ends each.
STATES = {
    "python": {"code": "", '"""': r'(?:[^"\\]|\\[\s\S]|"(?!""))*+"""', "'''": r"(?:[^'\\]|\\[\s\S]|'(?!''))*+'''"},
    "go": {"code": "", "/*": r"(?:[^*]|\*(?!/))*+\*/", "`": r"[^`]*+`"},
    "java": {"code": "", "/*": r"(?:[^*]|\*(?!/))*+\*/", '"""': r'(?:[^"\\]|\\[\s\S]|"(?!""))*+"""'},
    "js": {"code": "", "/*": r"(?:[^*]|\*(?!/))*+\*/", "`": r"(?:[^`\\]|\\[\s\S])*+`"},
    "c": {"code": "", "/*": r"(?:[^*]|\*(?!/))*+\*/"},
}
STATES["ts"] = STATES["js"]
_OPENED = {
    "python": re.compile(r'#[^\n]*|[rRbBuUfF]{0,2}(?:"""(?:[^"\\]|\\[\s\S]|"(?!""))*+"""|\'\'\'(?:[^\'\\]|\\[\s\S]|\'(?!\'\'))*+\'\'\'|(?!"""|\'\'\')(?:"(?:[^"\\\n]|\\[\s\S])*+"|\'(?:[^\'\\\n]|\\[\s\S])*+\'))|[rRbBuUfF]{0,2}(?P<o>"""|\'\'\')'),
    "go": re.compile(r'//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/|"(?:[^"\\\n]|\\[^\n])*+"|\'(?:[^\'\\\n]|\\[^\n])*+\'|`[^`]*+`|(?P<o>/\*|`)'),
    "java": re.compile(r'//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/|"""(?:[^"\\]|\\[\s\S]|"(?!""))*+"""|(?!""")"(?:[^"\\\n]|\\[^\n])*+"|\'(?:[^\'\\\n]|\\[^\n])*+\'|(?P<o>/\*|""")'),
    "js": re.compile(r'//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/|"(?:[^"\\\n]|\\[\s\S])*+"|\'(?:[^\'\\\n]|\\[\s\S])*+\'|`(?:[^`\\]|\\[\s\S])*+`|[=(,:\[!&|?;+]\s*/(?![*/])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/|(?P<o>/\*|`)'),
    "c": re.compile(r'//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/|"(?:[^"\\\n]|\\[\s\S])*+"|\'(?:[^\'\\\n]|\\[\s\S])*+\'|(?P<o>/\*)'),
}
_OPENED["ts"] = _OPENED["js"]


def cut_lines(text: str, size: int, lang: str = "") -> list[str]:
    """Cut text into chunks of about ``size`` characters at line ends that no backslash continues; a line end of Python begins the next chunk, as it carries its indentation."""
    out, at, own = [], 0, 0 if lang == "python" else 1
    while len(text) - at > size:
        end = text.find("\n", at + size - 1)
        while end > 0 and text[end - 1] == "\\":
            end = text.find("\n", end + 1)
        if end < 0:
            break
        out.append(text[at : end + own])
        at = end + own
    return [*out, text[at:]]


def divisible(text: str, lang: str) -> bool:
    """Whether chunks can be lexed apart: state is then one of ``STATES``.  Template holes nest, and C branches depend on those before."""
    if lang in ("js", "ts"):
        return "${" not in text
    return lang != "c" or not re.search(r"(?m)^[ \t]*#[ \t]*(?:else|elif|if[ \t]+0|ifdef[ \t]+__cplusplus)", text)


def chunk_states(text: str, lang: str) -> dict[str, tuple[str, str]]:
    """Lexer-state map of a chunk: for each state it may begin in, its reduced shape and the state it ends in."""
    out = {}
    for state, close in STATES[lang].items():
        body, lead = text, ""
        if close:
            m = re.match(close, text)
            if not m:
                out[state] = ("", state)
                continue
            body, lead = text[m.end() :], "" if state == "/*" else "s"
        end = "code"
        for m in _OPENED[lang].finditer(body):
            if m.lastgroup == "o":
                end, body = m["o"], body[: m.start()]
                break
        out[state] = (grammar.reduced(lead + shape(body, lang), lang), end)
    return out


def joined(a: dict[str, tuple[str, str]], b: dict[str, tuple[str, str]], lang: str) -> dict[str, tuple[str, str]]:
    """The map of two neighbouring chunks; associative."""
    out = {}
    for state, (s, mid) in a.items():
        t, end = b[mid]
        out[state] = (BAD if BAD in (s, t) else grammar.reduced(s + t, lang), end)
    return out


def accepted_map(m: dict[str, tuple[str, str]], lang: str) -> bool:
    s, end = m["code"]
    return end == "code" and grammar.accepted(s, lang)


# ---------------------------------------------------------------- Spark
def source_files(files: DataFrame, id_col: str = "file_id", path_col: str = "path", content_col: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows with content and an extension of ``LANGUAGES``, as (id, path, content) and the columns to keep; only these columns are read."""
    cols = [F.col(id_col).cast("long").alias("__id"), F.col(path_col).alias("__path"), F.col(content_col).alias("__text"), *keep]
    return spread(files.select(*cols)).filter(F.col("__text").isNotNull() & F.col("__path").rlike(SOURCE))


def _small(batches):
    for b in batches:
        paths, texts = b.column("__path").to_pylist(), b.column("__text").to_pylist()
        langs = [language(p) for p in paths]
        ok = [parses(t, g) for t, g in zip(texts, langs)]
        keep = [i for i, n in enumerate(b.schema.names) if n not in ("__path", "__text")]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(langs, pa.string()), pa.array(ok, pa.bool_())], names=[*(b.schema.names[i] for i in keep), "language", "parses"])


_MAP = pa.schema([("states", pa.list_(pa.string())), ("shapes", pa.list_(pa.string())), ("ends", pa.list_(pa.string()))])


def _cut(size: int):
    """Rows of (kept columns, __n, language, __chunk) for each chunk of a row."""

    def run(batches):
        for b in batches:
            at, ns, langs, chunks = [], [], [], []
            for i, (path, text) in enumerate(zip(b.column("__path").to_pylist(), b.column("__text").to_pylist())):
                lang = language(path)
                text = plain(text, lang)
                for n, t in enumerate(cut_lines(text, size, lang) if divisible(text, lang) else [text]):
                    at.append(i)
                    ns.append(n)
                    langs.append(lang)
                    chunks.append(t)
            kept = b.drop_columns(["__path", "__text"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(ns, pa.int32()), pa.array(langs, pa.string()), pa.array(chunks, pa.string())], names=[*kept.schema.names, "__n", "language", "__chunk"])

    return run


def _maps(batches):
    """Chunks as their lexer-state maps."""
    for b in batches:
        got = [chunk_states(t, g) for t, g in zip(b.column("__chunk").to_pylist(), b.column("language").to_pylist())]
        cols = [[list(m) for m in got], [[x[0] for x in m.values()] for m in got], [[x[1] for x in m.values()] for m in got]]
        kept = b.drop_columns(["__chunk"])
        yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, t) for c, t in zip(cols, _MAP.types))], names=[*kept.schema.names, *_MAP.names])


def _join_maps(t: pa.Table) -> pa.Table:
    """Equal rows have equal chunks: one of each is joined, and each row gets the verdict."""
    first = {n: i for i, n in reversed(list(enumerate(t.column("__n").to_pylist())))}
    states, shapes_, ends = (t.column(c).to_pylist() for c in _MAP.names)
    lang = t.column("language")[0].as_py()
    maps = [dict(zip(states[i], zip(shapes_[i], ends[i]))) for _, i in sorted(first.items())]
    while len(maps) > 1:  # a balanced tree keeps what is reduced again short
        maps = [joined(maps[i], maps[i + 1], lang) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    rows = t.filter(pc.equal(t.column("__n"), 0)).drop_columns(["__row", "__n", *_MAP.names])
    return rows.append_column("parses", pa.array([accepted_map(maps[0], lang)] * len(rows), pa.bool_()))


def syntax_verdicts(files: DataFrame, id_col: str = "file_id", path_col: str = "path", content_col: str = "content", keep: tuple[str, ...] = (), chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(``id_col``, *keep*, language, parses): one row for each source file with content.

    Texts above ``chunk_chars`` are cut, their chunks spread over the cluster and only the lexer-state maps shuffled back by file.
    """
    rows = source_files(files, id_col, path_col, content_col, keep)
    types = dict(rows.dtypes)
    head = [f"__id {types['__id']}", *(f"`{k}` {types[k]}" for k in keep)]
    schema = ", ".join([*head, "language string", "parses boolean"])
    size = F.length("__text")
    small = rows.filter(size <= chunk_chars).mapInArrow(_small, schema)
    # rows that are equal in all that is judged share a key and one set of maps, so that no id need be made up
    big = rows.filter(size > chunk_chars).withColumn("__row", F.xxhash64("__id", "__path", "__text"))
    chunk = ", ".join([*head, "__row long, __n int, language string"])
    chunks = big.mapInArrow(_cut(chunk_chars), f"{chunk}, __chunk string").repartition("__row", "__n")
    maps = chunks.mapInArrow(_maps, f"{chunk}, states array<string>, shapes array<string>, ends array<string>")
    large = maps.groupBy("__id", "__row").applyInArrow(_join_maps, schema)
    return small.unionByName(large).withColumnRenamed("__id", id_col)


def parse_rates(verdicts: DataFrame, repo_col: str = "repo_id") -> DataFrame:
    """Files, files that do not parse and their rate per repository and language; partial sums are made before the shuffle."""
    bad = F.sum(F.when(F.col("parses"), 0).otherwise(1))
    return verdicts.groupBy(repo_col, "language").agg(F.count("*").alias("files"), bad.alias("broken_files"), F.round(bad / F.count("*"), 6).alias("broken_rate"))
