"""Problem 6: the licence of each code file and repository.

A multinomial logistic regression on word n-grams (one to three words) is trained on variants of the
catalogue's identifiers, titles, notices and bodies: reworded, cut, respelt, in headers, manifests and
prose.  A further class holds what states nothing: pointers to a licence file, lists of identifiers,
copyright lines, terms of licences outside the catalogue.  A passage whose best class is that one, whose
probability is low, or that covers too little of the licence's wording is rejected (open set).

Passages are the surroundings of an identifier, of a title with version, or of wording of a notice.
After the classifier an exact check compares an identifier or version that is spelt out.  A file's
statements, those of licence files on the way up its path and the repository's metadata are then
reconciled by ``effective_licenses``.

Defined results: null or empty content states nothing; metadata that is null, cut short or without a licence
entry names none; a repository without any is UNKNOWN, one with several CONFLICT.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.session import spread

#: Licences of a catalogue that are fetched, characters of their texts, and bytes of the weights: bounds on the model, checked; beyond them it is refused.
CATALOG_LIMIT, CHARS_LIMIT, MODEL_BYTES = 5_000, 50_000_000, 512 << 20
LEAST_PROBABILITY, LEAST_COVER, LEAST_RUN = 0.5, 0.62, 5
NONE = ""

_TOKEN = re.compile(r"\d+(?:\.\d+)+|[^\W\d_]+|\d+|[\[\]=:,|]")
_LETTERS = re.compile(r"[^\W\d_]+")
_ROOT = r"(?i)^(?:LICEN[SC]E|COPYING)[^/]*$"
_SPELL = {"licence": "license", "licenced": "licensed", "licences": "licenses", "sublicence": "sublicense"}


def tokens(text: str) -> list[str]:
    """Lower-case words, version numbers and a few signs; British and American spelling, ``v2`` and ``2.0`` come out alike."""
    out: list[str] = []
    for t in _TOKEN.findall(text.lower()):
        if t in ("v", "ver", "version"):
            continue
        if t[0].isdigit() and "." not in t and len(t) < 3:
            t += ".0"
        out.append(_SPELL.get(t, t))
    return out


def plain(toks: list[str]) -> list[str]:
    return [t for t in toks if t[0].isalnum()]


def ngrams(w: list[str]) -> list[tuple[str, ...]]:
    return [(a,) for a in w] + list(zip(w, w[1:])) + list(zip(w, w[1:], w[2:]))


@dataclass
class Model:
    """A trained classifier with what finds its passages; small, and sent to tasks as it is."""

    ids: list[str]
    weights: dict[tuple[str, ...], np.ndarray] = field(default_factory=dict)
    bias: np.ndarray | None = None
    id_pattern: str = ""
    id_of: dict[str, str] = field(default_factory=dict)
    title_pattern: str = ""
    titles: dict[str, dict[str, str]] = field(default_factory=dict)
    trigrams: frozenset = frozenset()
    notice: dict[str, list[str]] = field(default_factory=dict)
    notice_tri: dict[str, frozenset] = field(default_factory=dict)
    start: str = ""

    def probabilities(self, toks: list[str]) -> np.ndarray:
        z = self.bias.copy()
        n = 0
        for g in ngrams(toks):
            w = self.weights.get(g)
            if w is not None:
                z += w
                n += 1
        if n:
            z = self.bias + (z - self.bias) / np.sqrt(n)
        e = np.exp(z - z.max())
        return e / e.sum()

    def classify(self, toks: list[str]) -> tuple[str, float]:
        p = self.probabilities(toks)
        k = int(p.argmax())
        return (self.ids[k] if k < len(self.ids) else NONE), float(p[k])


def _squash(s: str) -> str:
    return re.sub(r"[^a-z0-9.]", "", s.lower())


def _id_regex(license_id: str, version: str) -> str:
    """An identifier however joined: hyphens, blanks or nothing between its parts, with or without a v."""
    stem = license_id[: -len(version)].rstrip("-_ ") if license_id.endswith(version) else license_id
    parts = [q for p in re.split(r"[-_ ]+", stem) for q in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", p)]
    name = r"[-_ ]?".join(map(re.escape, parts))
    v = re.escape(version)
    if version.endswith(".0"):
        v = re.escape(version[:-2]) + r"(?:\.0)?"
    return rf"{name}(?:[-_ ]{{0,2}}v?|[-_ ]?version[-_ ]?){v}(?:-only|-or-later|\+)?"


def _perturbed(words: list[str], rng: random.Random, drop: float, swap: float, pool: list[str]) -> list[str]:
    out = []
    for w in words:
        r = rng.random()
        if r < drop:
            continue
        out.append(rng.choice(pool) if r < drop + swap else w)
    return out


def _samples(catalog: list[dict], rng: random.Random, per: int) -> list[tuple[list[str], int]]:
    """Training passages: template variants of every licence, and of texts that state none."""
    out: list[tuple[list[str], int]] = []
    none = len(catalog)
    common = "the of and to a in that is it for with as on be at by this which or from but not are all code file part may any".split()
    lead_id = ["spdx license identifier :", "license :", "license", "license =", ": license", "terms of use :", "license = ", "licensed under", "this project uses the", "released under", "spdx license identifier", "license identifier :", "", "license :", "package version , license :"]
    lead_title = ["distributed under", "licensed under the", "released under the", "this project uses the", "is released under the terms of the", "is free to use on the conditions of the", "under the", "", "made available under the", "covered by the", "license :", "published under"]
    tail_title = ["see the license file that comes with", ", as published with the sources", "the license you may not use this file except as the license allows", "", "see license for details", "all rights reserved", ", import", "package"]
    sentences = [s for c in catalog for s in re.split(r"(?<=[.;:])\s+", c["body"] or "")]
    shared = [s for s in dict.fromkeys(sentences) if sentences.count(s) > 1]
    for k, c in enumerate(catalog):
        idt = tokens(c["license_id"])
        title = tokens(c["title"] or "") + tokens(c["license_version"] or "")
        notice = plain(tokens(c["notice"] or ""))
        body = plain(tokens(c["body"] or ""))
        for _ in range(per):
            out.append((tokens(rng.choice(lead_id)) + idt + rng.choice([[], tokens(", " + rng.choice(["import", "author :", "name", "def", "class", "package", "description :"]))]), k))
            other = tokens(rng.choice(catalog)["license_id"])
            out.append((tokens(rng.choice(lead_id[:6])) + (other + [rng.choice(["or", "and"])] + idt if rng.random() < 0.5 else idt + ["or"] + other), k if rng.random() < 1 else none))
            out.append((tokens(rng.choice(lead_title)) + title + tokens(rng.choice(tail_title)), k))
            if notice:
                out.append((_perturbed(notice, rng, 0.08 * rng.random(), 0.1 * rng.random(), common), k))
                cut = rng.randint(max(4, len(notice) * 6 // 10), len(notice))
                out.append((notice[:cut] if rng.random() < 0.5 else notice[-cut:], k))
            if body:
                out.append((_perturbed(body, rng, 0.05, 0.05, common), k))
    for _ in range(per * max(2, len(catalog) // 2)):
        ids = [rng.choice(catalog)["license_id"] for _ in range(rng.randint(2, 6))]
        out.append((tokens(rng.choice(["allowed terms = [", "const allowed terms = [", "known licenses = [", "permitted : [", "allowed = [", "ids = ["]) + ",".join(ids) + "]"), none))
        out.append((tokens(rng.choice(["see license for the terms of use", "terms : ask the team", "see the license file", "license", "all rights reserved", "copyright the authors", "see copying", "use is subject to the terms of the agreement", "you can do what you like with it except on tuesdays"])), none))
        if shared:
            out.append((plain(tokens(" ".join(rng.sample(shared, min(len(shared), rng.randint(1, 3)))))), none))
        mix = [w for c in rng.sample(catalog, min(3, len(catalog))) for w in rng.sample(plain(tokens(c["notice"] or "a")), min(4, len(plain(tokens(c["notice"] or "a")))))]
        rng.shuffle(mix)
        out.append((mix + rng.choices(common, k=12), none))
        out.append((rng.choices(common, k=rng.randint(4, 20)), none))
    return out


def train(catalog: list[dict], per: int = 16, epochs: int = 100, seed: int = 7) -> Model:
    """Fit the regression by full-batch gradient descent; the same catalogue always gives the same model."""
    if len(catalog) > CATALOG_LIMIT:
        raise ValueError("the catalogue is larger than the model's bound")
    catalog = sorted(catalog, key=lambda c: c["license_id"])
    rng = random.Random(seed)
    samples = _samples(catalog, rng, per)
    vocab: dict[tuple[str, ...], int] = {}
    rows, cols, vals = [], [], []
    for i, (toks, _) in enumerate(samples):
        gs = [vocab.setdefault(g, len(vocab)) for g in ngrams(toks)]
        if gs:
            rows += [i] * len(gs)
            cols += gs
            vals += [1 / np.sqrt(len(gs))] * len(gs)
    r, c, v = np.array(rows), np.array(cols), np.array(vals)
    y = np.array([k for _, k in samples])
    n, m, classes = len(samples), len(vocab), len(catalog) + 1
    if m * classes * 8 > MODEL_BYTES:
        raise ValueError("the catalogue's model would be larger than its bound")
    W, b = np.zeros((m, classes)), np.zeros(classes)
    onehot = np.eye(classes)[y]
    share = onehot / np.maximum(1, onehot.sum(0))[None, :]
    weight = share.sum(1) / classes  # classes count alike
    order = np.argsort(c, kind="stable")
    rc, cc, vc = r[order], c[order], v[order]
    starts = np.flatnonzero(np.r_[True, cc[1:] != cc[:-1]])
    present = cc[starts]
    step = 60.0
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    who = r[first]
    for e in range(epochs):
        z = np.zeros((n, classes))
        z[who] = np.add.reduceat(W[c] * v[:, None], first, axis=0)
        z += b
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        g = (p - onehot) * weight[:, None]
        G = np.zeros_like(W)
        G[present] = np.add.reduceat(g[rc] * vc[:, None], starts, axis=0)
        W -= step * (G + 1e-6 * W)
        b -= step * 0.05 * g.sum(0)
    model = Model(ids=[x["license_id"] for x in catalog])
    model.weights = {g: W[i].astype(np.float32) for g, i in vocab.items() if np.abs(W[i]).max() > 1e-3}
    model.bias = b.astype(np.float32)
    pats = []
    for x in catalog:
        pats.append(_id_regex(x["license_id"], x["license_version"] or ""))
        title = plain(tokens(x["title"] or ""))
        if title:
            model.titles.setdefault(" ".join(title), {})[(x["license_version"] or "").strip()] = x["license_id"]
        model.notice[x["license_id"]] = [_SPELL.get(w, w) for w in _LETTERS.findall((x["notice"] or "").lower())]
        w = model.notice[x["license_id"]]
        model.notice_tri[x["license_id"]] = frozenset(zip(w, w[1:], w[2:]))
    pats.sort(key=len, reverse=True)
    model.id_pattern = r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(f"(?P<i{k}>{p})" for k, p in enumerate(pats)) + r")(?![A-Za-z0-9_]|\.\d|-\d)"
    byp = {_id_regex(x["license_id"], x["license_version"] or ""): x["license_id"] for x in catalog}
    model.id_of = {f"i{k}": byp[p] for k, p in enumerate(pats)}
    gap = r"(?:[^\w]|\b(?:the)\b){1,12}"
    words = lambda t: gap.join("licen[sc]e" if w == "license" else re.escape(w) for w in t.split())
    model.title_pattern = r"(?i)(?<![A-Za-z0-9])(?:" + "|".join(f"(?P<t{k}>{words(t)})" for k, t in enumerate(sorted(model.titles, key=len, reverse=True))) + r")(?:[\s(,#*/\-]|(?:version|ver\.?|v)(?=[\s.\d])){0,16}?(?P<v>\d+(?:\.\d+)*)(?!\w)"
    model.trigrams = frozenset().union(*model.notice_tri.values())
    return model


class Reader:
    """Finds the statements of a text with a model; holds what a process compiles once."""

    def __init__(self, model: Model):
        self.m = model
        self.ids = re.compile(model.id_pattern)
        self.titles = re.compile(model.title_pattern)
        self.title_of = {f"t{k}": t for k, t in enumerate(sorted(model.titles, key=len, reverse=True))}
        # where an identifier may begin, and where a title may end: looked for in the lower-case text, without trying each pattern everywhere
        heads = sorted({re.match(r"[a-z]+|\d+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", i).lower())[0] for i in model.ids}, key=len, reverse=True)
        self.heads = re.compile("|".join(map(re.escape, heads)))
        ends = sorted({t.split()[-1] for t in model.titles} - {"license"})
        self.ends = re.compile("|".join([r"licen[sc]e", *map(re.escape, ends)]))
        self.longest = max([len(t) for t in model.titles], default=0) + 40

    def window(self, text: str, a: int, b: int) -> list[str]:
        before = tokens(text[max(0, a - 70) : a])[-7:]
        return before + tokens(text[a:b]) + tokens(text[b : b + 60].partition("\n")[0])[:6]

    def statements(self, text: str, titles_alone: bool = False) -> set[str]:
        m, out = self.m, set()
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        for h in self.heads.finditer(low):
            x = self.ids.match(text, h.start())
            if not x:
                continue
            lic = m.id_of[x.lastgroup]
            line = text[text.rfind("\n", 0, x.start()) + 1 : x.start()]
            got, p = m.classify(self.window(text, x.start(), x.end()))
            if got == NONE and p > LEAST_PROBABILITY:
                continue
            # exact check: an identifier in a list is data, one after words of licensing or in an expression is a statement
            if re.search(r"[\[{(]\s*[\"'](?:[^\"':]*[\"']\s*,\s*[\"'])*\Z", line) and not re.search(r"(?i)licen[sc]e[\"']?\s*[:=]\s*[\[{(]", line):
                continue
            if not titles_alone and not re.search(r"(?i)licen[sc]|spdx|terms|copying|\b(?:or|and|with)\s*\(?\s*\Z|under\s+(?:the\s+)?\Z", line[-80:]):
                continue
            out.add(lic)
        done = -1
        for h in self.ends.finditer(low):
            for x in self.titles.finditer(text, max(done, h.start() - self.longest, 0), min(len(text), h.end() + 40)):
                done = max(done, x.end())
                named = next(k for k in self.title_of if x[k] is not None)
                v = x["v"] if "." in x["v"] else x["v"] + ".0"
                lic = m.titles[self.title_of[named]].get(v)
                if lic is None:
                    continue  # a version that the catalogue has not
                got, p = m.classify(self.window(text, x.start(), x.end()))
                if got == NONE and p > LEAST_PROBABILITY:
                    continue
                out.add(lic)
        out |= self.notices(low)
        return out

    def notices(self, text: str) -> set[str]:
        """Licences of whose notice a passage holds most of the wording."""
        m, out = self.m, set()
        w = _LETTERS.findall(text)
        if "licence" in text:
            w = [_SPELL.get(x, x) for x in w]
        tri = m.trigrams
        hits = [i for i, g in enumerate(zip(w, w[1:], w[2:])) if g in tri]
        if len(hits) < LEAST_RUN:
            return out
        runs, at = [], [hits[0]]
        for h in hits[1:]:
            if h - at[-1] > 12:
                runs.append(at)
                at = []
            at.append(h)
        runs.append(at)
        for r in runs:
            if len(r) < LEAST_RUN:
                continue
            passage = w[max(0, r[0] - 2) : r[-1] + 6]
            got, p = m.classify(passage)
            if got == NONE or p < LEAST_PROBABILITY:
                continue
            own = m.notice[got]
            have: dict[str, int] = {}
            for x in passage:
                have[x] = have.get(x, 0) + 1
            cover = 0
            for x in own:
                if have.get(x, 0):
                    have[x] -= 1
                    cover += 1
            if cover >= LEAST_COVER * len(own):
                out.add(got)
        return out


_READER: dict[int, Reader] = {}


def reader(model: Model) -> Reader:
    k = id(model)
    if k not in _READER:
        _READER.clear()
        _READER[k] = Reader(model)
    return _READER[k]


def metadata_statements(metadata: str | None, r: Reader) -> set[str]:
    """Licences named by the licence entry of a repository's metadata, in any of its shapes."""
    try:
        d = json.loads(metadata) if metadata else None
    except ValueError:
        return set()
    if not isinstance(d, dict):
        return set()
    found: set[str] = set()
    stack = [d[k] for k in ("license", "licence", "licenses", "license_info") if d.get(k) is not None]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            stack += [v for k, v in x.items() if k in ("key", "spdx_id", "name", "id", "title", "type", "license") and v is not None]
        elif isinstance(x, list):
            stack += x
        elif isinstance(x, str):
            found |= r.statements("License: " + x, True)
    return found


# ---------------------------------------------------------------- Spark
def trained(catalog: DataFrame) -> Model:
    """The model of a catalogue table; at most ``CATALOG_LIMIT`` licences are fetched."""
    held = catalog.select("license_id", "title", "license_version", "notice", "body").filter(F.col("license_id").isNotNull())
    chars = held.agg(F.sum(F.coalesce(F.length("notice"), F.lit(0)) + F.coalesce(F.length("body"), F.lit(0)))).first()[0]
    if (chars or 0) > CHARS_LIMIT:
        raise ValueError("the catalogue's texts are longer than the model's bound")
    rows = held.limit(CATALOG_LIMIT + 1).collect()
    return train([r.asDict() for r in rows])


_OUT = pa.schema([("subject_kind", pa.string()), ("key_id", pa.int64()), ("license_id", pa.string())])


def _raw_statements(files: DataFrame, model: Model) -> DataFrame:
    rows = spread(files.select("file_id", "repo_id", "path", "content")).filter(F.col("content").isNotNull())
    root = re.compile(_ROOT)

    def run(batches):
        r = reader(model)
        for b in batches:
            kind, key, lic = [], [], []
            for f, repo, path, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                got = r.statements(text)
                top = bool(path and root.match(path))
                for x in got:
                    kind.append("file")
                    key.append(f)
                    lic.append(x)
                    if top and repo is not None:
                        kind.append("repo")
                        key.append(repo)
                        lic.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(key, pa.int64()), pa.array(lic, pa.string())], schema=_OUT)

    return rows.mapInArrow(run, "subject_kind string, key_id long, license_id string")


def license_rows(files: DataFrame, repositories: DataFrame, catalog: DataFrame) -> DataFrame:
    """(subject_kind, key_id, license_id) of every file that states a licence and of every repository.

    One pass over the contents; only (kind, key, licence) rows are shuffled, at most a set of the catalogue per key.
    """
    model = trained(catalog)
    said = _raw_statements(files, model)

    def meta(batches):
        r = reader(model)
        for b in batches:
            key, lic = [], []
            for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = metadata_statements(m, r)
                for x in got or [None]:
                    key.append(i)
                    lic.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(["repo"] * len(key), pa.string()), pa.array(key, pa.int64()), pa.array(lic, pa.string())], schema=_OUT)

    repos = repositories.select(F.col("id").cast("long").alias("id"), "metadata").filter("id IS NOT NULL")
    named = repos.mapInArrow(meta, "subject_kind string, key_id long, license_id string").withColumn("known", F.lit(True))
    both = said.withColumn("known", F.lit(False)).unionByName(named)
    sets = both.groupBy("subject_kind", "key_id").agg(F.collect_set("license_id").alias("s"), F.max("known").alias("known"))
    one = F.when(F.size("s") == 0, F.lit("UNKNOWN")).when(F.size("s") == 1, F.element_at("s", 1)).otherwise(F.lit("CONFLICT"))
    out = F.when(F.col("subject_kind") == "file", F.col("s")).otherwise(F.array(one))
    return sets.filter((F.col("subject_kind") == "file") | F.col("known")).select("subject_kind", "key_id", F.explode(out).alias("license_id"))


def effective_licenses(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(file_id, license_id, source): the licence that applies to each file.

    Its own statement, else that of the nearest licence file on the way up its path, else its repository's;
    several at the deciding place are a CONFLICT.  Only ids and paths are shuffled.
    """
    own = rows.filter("subject_kind = 'file'").select(F.col("key_id").alias("file_id"), "license_id")
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    meta = files.select("file_id", "repo_id", "path")
    at = (
        meta.filter(F.col("path").rlike(r"(?i)(?:^|/)(?:LICEN[SC]E|COPYING)[^/]*$")).join(own, "file_id").select("repo_id", folder.alias("folder"), "license_id")
        .groupBy("repo_id", "folder").agg(F.collect_set("license_id").alias("s"))
        .select("repo_id", "folder", F.when(F.size("s") == 1, F.element_at("s", 1)).otherwise("CONFLICT").alias("near"))
    )
    parts = F.split(folder, "/")
    ups = F.array_union(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, 1, i))), F.array(F.lit("")))
    near = (
        meta.filter(F.col("path").isNotNull()).select("file_id", "repo_id", F.explode(ups).alias("folder")).join(at, ["repo_id", "folder"])
        .groupBy("file_id").agg(F.max_by("near", F.length("folder")).alias("near"))
    )
    stated = own.groupBy("file_id").agg(F.collect_set("license_id").alias("s")).select("file_id", F.when(F.size("s") == 1, F.element_at("s", 1)).otherwise("CONFLICT").alias("stated"))
    repo = rows.filter("subject_kind = 'repo'").select(F.col("key_id").alias("repo_id"), F.col("license_id").alias("of_repo"))
    j = meta.select("file_id", "repo_id").join(stated, "file_id", "left").join(near, "file_id", "left").join(repo, "repo_id", "left")
    return j.select(
        "file_id", F.coalesce("stated", "near", "of_repo", F.lit("UNKNOWN")).alias("license_id"),
        F.when(F.col("stated").isNotNull(), "file").when(F.col("near").isNotNull(), "folder").when(F.col("of_repo").isNotNull(), "repository").otherwise("none").alias("source"),
    )
