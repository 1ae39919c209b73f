"""Problem 4: generated, minified or vendored source files.

A file is not written by hand if its leading comment says that a tool made it, if it is minified, if it
holds little but literal data, if it is one template filled in again and again, or if it is a copy of a library file.
All but the first two are told from the token stream without comments and layout, hashed in runs of ``RUN`` tokens.
Copies are told by winnowing: the least hash of every ``PICK`` neighbouring runs is a fingerprint, and a file is
vendored if at least ``LEAST_SHARE`` of its fingerprints lie in ``LEAST_REPOS`` or more repositories of different
names.  Templates are told by the runs of token classes (each name, number and string alike): a file is generated
if at least ``LEAST_RECUR`` of its runs stand in it three times or more.

Defined results: null and empty content, other extensions and files that do not parse are no cases; rows
whose repository is unknown count as one repository; repeated rows are judged each.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import grammar
from gristmill.llm.parsing import language, plain, source_files
from gristmill.llm.shapes import BAD, CLASSES, TOKENS, flat_templates, preprocessed, records

#: Runs are short, as every edited token spoils all runs that hold it.
RUN, PICK = 12, 12
LEAST_SHARE, LEAST_REPOS = 0.7, 3
#: Tokens below which a stream is too short to tell a copy from a coincidence.
LEAST_TOKENS = 30
#: Share of runs of token classes that recur within a text of a tool (of written texts it is a quarter at most, as a rule), and tokens below which a few like lines have it too.
LEAST_RECUR, LEAST_TEMPLATE = 0.75, 90

# What leading comments of made files say: fixed wordings.
_MADE = re.compile(
    r"(?ix)(?<!not\s)(?<!n't\s)(?:@generated\b|<auto-?generated|\bauto(?:matically|matic)?[- ]?(?:generated|produced|created|written|built)\b(?!\s+(?:method|constructor|function|class|catch|getter|setter)\s*(?:stub|block)?)"
    r"|\bcode\s+generated\b|\bmachine[- ](?:made|generated|written|produced)\b|\bgenerated\s+(?:automatically|by|from|with|using|on|at)\b(?!\s+hand)|\bthis\s+(?:file|code|class|module|source)\s+(?:is|was|has\s+been)\s+(?:generated|produced|created|written)\s+by\s+(?:the\s+)?\w*(?:gen|c|tool|compiler|script|build)\b"
    r"|\b(?:do\s+not|don't|never)\s+(?:edit|modify|change|alter|touch)\b|\bnot\s+to\s+be\s+edited\b|\bchanges\s+(?:will|would)\s+be\s+(?:lost|overwritten)\b|\bany\s+(?:manual\s+)?(?:changes|edits)\s+will\s+be"
    r"|\bautomatisch\s+(?:erzeugt|erstellt|generiert)\b|\bnicht\s+(?:von\s+hand\s+)?(?:bearbeiten|ändern|editieren)\b|\bg[ée]n[ée]r[ée]e?\s+(?:automatiquement|par)\b|\bautomatiquement\s+g[ée]n[ée]r|\bne\s+pas\s+(?:modifier|[ée]diter)\b|\bgenerad[oa]\s+(?:autom[aá]ticamente|por)\b|\bautom[aá]ticamente\s+generad|\bno\s+(?:editar|modificar)\b)"
)
_VENDOR_DIR = re.compile(r"(?i)(?:^|/)(?:vendor|vendored|node_modules|bower_components|third[_-]?party|3rd[_-]?party|external|externals|extern|deps|jspm_packages|site-packages)/")


class CRC(dict):
    """Number of a token, the same in every process."""

    def __missing__(self, t: str) -> int:
        v = zlib.crc32(t.encode("utf-8", "surrogatepass"))
        if len(self) < 500_000 and len(t) < 40:
            self[t] = v
        return v


_CRC = CRC()


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _runs(one: np.ndarray) -> np.ndarray:
    """Hashes of the runs of twelve neighbours."""
    two = _mixed(one[:-1], one[1:])
    four = _mixed(two[:-2], two[2:])
    eight = _mixed(four[:-4], four[4:])
    return _mixed(eight[:-4], four[8:])


def fingerprints(stream: list[str]) -> list[int]:
    """Winnowed fingerprints of a token stream."""
    if len(stream) < LEAST_TOKENS:
        return []
    h = _runs(np.fromiter(map(_CRC.__getitem__, stream), dtype=np.uint64, count=len(stream)))
    n = len(h)
    if n > PICK:
        for step in (1, 2, 4, 4):  # the least of twelve neighbours
            h = np.minimum(h[:-step], h[step:])
    else:
        h = h.min(keepdims=True)
    return np.unique(h).view(np.int64).tolist()


def recurring(kinds: str) -> float:
    """Share of the runs of token classes that stand three times or more in the text."""
    if len(kinds) < LEAST_TEMPLATE:
        return 0.0
    h = np.sort(_runs(np.frombuffer(kinds.encode("utf-32-le"), np.uint32).astype(np.uint64)))
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True])
    n = np.diff(at)
    return float(n[n >= 3].sum() / len(h))


def leading(comments: list[str]) -> bool:
    return any(_MADE.search(re.sub(r"\s*\n\s*(?:\*|//+|#+)?\s*", " ", c)) for c in comments)


_LINE_ENDS = re.compile("n|[\U000f0000-\U0010fffd]+")
_COMMENT_LINE = re.compile(r"\s*(?://|#|\*|/\*)")


def made_kind(text: str, lang: str) -> tuple[str, list[str]] | None:
    """(generated, minified, data or '', token stream without comments) of a text; None if it does not parse."""
    text = plain(text, lang)
    src = preprocessed(text) if lang == "c" else records(text) if lang == "java" else flat_templates(text) if lang in ("js", "ts") and "${" in text else text
    if lang in ("js", "ts") and src.startswith("#!"):
        src = "//" + src[2:]
    toks = TOKENS[lang].findall(src)
    kinds = list(map(CLASSES[lang].__getitem__, toks))
    s = "".join(kinds)
    if BAD in s or not grammar.accepted(grammar.reduced(s, lang), lang):
        return None
    python = lang == "python"
    # comments and line ends are left out; a line end of Python is two characters
    pairs = [(t, k) for t, k in zip(toks, kinds) if k and k != "n" and t[0] != "\n"] if python else [(t, k) for t, k in zip(toks, kinds) if k and k != "n"]
    stream = [t for t, _ in pairs]
    lead = [t for t in takewhile(lambda t: t[0] == "#" or t.isspace(), toks)] if python else [t for t in takewhile(lambda t: t[:2] in ("//", "/*") or t.isspace(), toks)]
    if leading([t for t in lead if not t.isspace()]):
        return "generated", stream
    if not stream:
        return "", stream
    code = sum(map(len, stream))
    literal = sum(len(t) for t, k in pairs if k in "sB0")
    numbers, names = kinds.count("0"), kinds.count("a")
    if python:  # keywords are words as well
        names = sum(map(str.isidentifier, stream))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    body = [x for x in lines if not _COMMENT_LINE.match(x)] or lines
    dense = len(stream) / len(body)
    share = literal / max(1, code)
    words = (len(stream) - names) / len(stream)
    if code > 200 and dense >= 40 and share < 0.6 and sum(map(len, body)) / len(body) >= 120 and sum(map(text.count, " \t\n")) < 0.15 * len(text):
        return "minified", stream
    if code >= 300 and ((share >= 0.72 and names <= 0.12 * len(stream) + 8) or (numbers >= 40 and numbers >= 0.36 * len(stream) and words > 0.85)):
        return "data", stream
    return "generated" if recurring(_LINE_ENDS.sub("", s)) >= LEAST_RECUR else "", stream


# ---------------------------------------------------------------- Spark
def _profiles(files: DataFrame) -> DataFrame:
    rows = source_files(files, keep=("repo_id",)).filter(F.length("__text") > 0)
    schema = pa.schema([("file_id", pa.int64()), ("repo_id", pa.int64()), ("path", pa.string()), ("kind", pa.string()), ("prints", pa.list_(pa.int64())), ("print_id", pa.binary())])

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in schema.names]
            for i, path, text, repo in zip(*(b.column(c).to_pylist() for c in ("__id", "__path", "__text", "repo_id"))):
                got = made_kind(text, language(path))
                if got is None or not text.strip():
                    continue
                prints = fingerprints(got[1])
                same = hashlib.blake2b(np.array(prints, np.int64).tobytes(), digest_size=16).digest()
                for c, v in zip(out, (i, repo, path, got[0], prints, same)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    return rows.mapInArrow(run, "file_id long, repo_id long, path string, kind string, prints array<long>, print_id binary")


def origins(files: DataFrame, repositories: DataFrame, least_share: float = LEAST_SHARE, least_repos: int = LEAST_REPOS) -> DataFrame:
    """(file_id, origin): origin is generated, minified, data, vendored or hand for each source file that parses.

    Fingerprints are counted once for files of equal ones and once per project, so that a file copied a million times
    within one repository counts once; files with an origin told by themselves are counted too, as they may be copies.
    """
    prof = _profiles(files).persist(StorageLevel.MEMORY_AND_DISK)
    prof.count()  # the plan below reads it several times at once, and would make it as often were it not there
    name = repositories.select(F.col("id").alias("repo_id"), F.coalesce("repo_name", F.col("id").cast("string")).alias("project")).dropDuplicates(["repo_id"])
    owner = name.join(name.groupBy("project").agg(F.min("repo_id").alias("owner")), "project").select("repo_id", "owner")
    n = F.size("prints")
    printed = prof.filter(n > 0)
    each = printed.groupBy("print_id").agg(F.first("prints").alias("prints")).select("print_id", F.explode("prints").alias("fp"))
    owners = printed.select("print_id", "repo_id").distinct().join(owner, "repo_id", "left").select("print_id", "owner").distinct()
    # rows of one fingerprint meet once, and are then told apart and counted where they are
    spread = each.join(owners, "print_id").select("fp", "owner").repartition("fp").distinct().groupBy("fp").agg(F.count("*").alias("projects")).filter("projects >= 2")
    shared = (
        each.join(spread, "fp").groupBy("print_id")
        .agg(F.sum(F.when(F.col("projects") >= least_repos, 1).otherwise(0)).alias("many"), F.count("*").alias("some"))
    )
    in_vendor = F.col("path").rlike(_VENDOR_DIR.pattern)
    copied = (F.col("many") >= least_share * n) | (in_vendor & (F.col("some") >= least_share * n))
    return prof.join(shared, "print_id", "left").select(
        "file_id", F.when(F.col("kind") != "", F.col("kind")).when((n > 0) & copied, "vendored").otherwise("hand").alias("origin")
    )
