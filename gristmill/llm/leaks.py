"""Problem 7: evaluation texts leaking into training text.

A document leaks an item if they share at least ``window`` consecutive words.  Every run of
``window`` words of the items is a pattern of a Wu-Manber search over words: a shift table on blocks
of ``BLOCK`` words says how far the window may move on, a bucket by the hash of the window's last
words names the patterns that may end there, and a direct comparison of the words confirms them.

Defined results: null or empty text leaks nothing, as does an item of fewer than ``window`` words;
repeated documents and items each count by themselves.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, BLOCK = 12, 3
#: Items, and characters of their texts, whose patterns are sent to the tasks at once, about; what is more is searched in further passes.
ITEMS_AT_ONCE, CHARS_AT_ONCE = 20_000, 8_000_000

_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb\U000e0000-\U000e007f]")
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_INLINE = re.compile(r"</?(?:a|abbr|b|bdi|bdo|big|cite|code|del|dfn|em|font|i|ins|kbd|mark|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<![A-Za-z][^<>]*>")
_WORDS = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The words of a text as comparison sees them: runs of letters or digits, without case, markup, entities and invisible characters."""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", _COMMENT.sub(" ", text)))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)).casefold()
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return _WORDS.findall(text)
    return _WORDS.findall(text.lower())


class Tables:
    """Shift table, buckets and patterns of a set of items."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, block: int = BLOCK):
        self.window, self.block = window, block
        self.texts: list[list[str]] = []
        self.shift: dict[tuple[str, ...], int] = {}
        self.bucket: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.ids = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            w = words(text or "")
            self.texts.append(w)
            for at in range(len(w) - window + 1):
                for j in range(window - block + 1):
                    b = tuple(w[at + j : at + j + block])
                    d = window - block - j
                    if self.shift.get(b, window) > d:
                        self.shift[b] = d
                self.bucket[hash(tuple(w[at + window - block : at + window]))].append((k, at))

    def find(self, text: str) -> set[int]:
        """The ids of the items that share a window with the text."""
        m, b = self.window, self.block
        w = words(text)
        found: set[int] = set()
        get, far, n = self.shift.get, m - b + 1, len(w)
        i = m  # end of the window
        while i <= n:
            tail = tuple(w[i - b : i])
            d = get(tail, far)
            if d:
                i += d
                continue
            here = None
            for k, at in self.bucket.get(hash(tail), ()):
                if self.ids[k] not in found:
                    here = here or w[i - m : i]
                    if self.texts[k][at : at + m] == here:
                        found.add(self.ids[k])
            i += 1
        return found


def leaks(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """(``doc_col``, ``item_col``): one row per document and item that share ``window`` words.

    Documents are mapped where they lie, without a shuffle.  Tasks get the tables of at most
    ``items_at_once`` items; a larger set of items is searched in that many more passes.
    """
    rows = documents.select(F.col(doc_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).filter(F.col("__text").isNotNull())
    wanted = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).filter("t IS NOT NULL")
    many, chars = wanted.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    passes = max(1, -(-many // items_at_once), -(-chars // CHARS_AT_ONCE))
    parts = []
    schema = pa.schema([("__id", pa.int64()), ("__item", pa.int64())])
    for p in range(passes):
        block = wanted if passes == 1 else wanted.filter(F.pmod(F.xxhash64("i"), F.lit(passes)) == p)
        held = [(r.i, r.t) for r in block.collect()]  # bounded by items_at_once and CHARS_AT_ONCE, about
        tables: list[Tables] = []

        def run(batches, held=held, tables=tables):
            if not tables:
                tables.append(Tables(held, window))
            for b in batches:
                ids, out = [], []
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for x in tables[0].find(text):
                        ids.append(i)
                        out.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.int64())], schema=schema)

        parts.append(rows.mapInArrow(run, "__id long, __item long"))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out.select(F.col("__id").alias(doc_col), F.col("__item").alias(item_col))


def leaked_items(found: DataFrame, items: DataFrame, item_col: str = "item_id") -> DataFrame:
    """Every item with the number of documents that hold wording of it; counted before the join."""
    n = found.groupBy(item_col).agg(F.count("*").alias("documents"))
    return items.select(item_col, "suite", "eval_split").join(n, item_col, "left").fillna(0, ["documents"])
