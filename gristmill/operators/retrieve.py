"""Text and vector retrieval: document text, chunks, exact neighbours, relevance, and packing under a token budget."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gristmill.functions.text import token_count
from gristmill.session import checkpointed

NEIGHBOURS, CENTRAL = 200, 20
CHUNK, OVERLAP = 2_000, 400
WEIGHT_SIMILARITY, WEIGHT_CENTRALITY = 0.7, 0.3
PREVIEW = 100
#: Query vectors that are held by each task at once.
QUERY_BLOCK = 4_096


# ---------------------------------------------------------------- text of a file
def _line(head: str, c: Column, there: Column | None = None) -> Column:
    return F.when((c if there is None else there).isNotNull(), F.concat(F.lit(head), F.array_join(c, ", "), F.lit("\n"))).otherwise("")


# The wordings of these texts are fixed values.
def document_text(path: Column, content: Column, functions: Column, classes: Column, imports: Column, more: dict[str, Column] | None = None) -> Column:
    """A file as a document: path, content, then what is known of it, a line for each key that is there; ``more`` are the keys of other languages, lists or values."""
    body = F.when(content.isNotNull(), F.concat(content, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("File: "), path, F.lit("\n\n"), body, _line("functions: ", functions), _line("classes: ", classes), _line("imports: ", imports), *(_line(f"{k}: ", F.array(c.cast("string")) if k in ("type", "name", "size", "error") else c, c) for k, c in (more or {}).items()))


def context_entry(path: Column, content: Column, functions: Column, classes: Column, imports: Column) -> Column:
    """A file as an entry of the context that a question gets."""
    body = F.when(content.isNotNull(), F.concat(content, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("File: "), path, F.lit("\n\n"), body, _line("Functions: ", functions), _line("Classes: ", classes), _line("Imports: ", imports))


def short_document(path: Column, functions: Column, classes: Column, imports: Column) -> Column:
    return F.concat(F.lit("File: "), path, F.lit("\n"), _line("Functions: ", functions), _line("Classes: ", classes), _line("Imports: ", imports))


def overview_entry(path: Column, kind: Column, functions: Column, classes: Column, content: Column) -> Column:
    """A file's part of a repository's overview, with the beginning of its content."""
    head = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"  {name}: "), c, F.lit("\n"))).otherwise("")
    return F.concat(
        F.lit("- "), path, F.lit("\n"), head("Type", kind), head("Functions", F.array_join(functions, ", ")), head("Classes", F.array_join(classes, ", ")),
        head("Content Preview", F.concat(F.substring(content, 1, PREVIEW), F.lit("..."))),
    )


# ---------------------------------------------------------------- chunks
def fixed_chunks(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """array<struct<chunk_idx, chunk>>: windows of a fixed width and step."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / F.lit(step)), F.lit(1)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("chunk_idx"), F.substring(text, i * step + 1, F.lit(size)).alias("chunk")))


def split_recursively(text: str, size: int = CHUNK, overlap: int = OVERLAP, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Split at the first separator that occurs, split what is still too long at the next ones, and merge neighbours up to ``size`` with up to ``overlap`` repeated."""
    sep = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(sep) + 1 :]
    parts = [p for p in (text.split(sep) if sep else list(text)) if p]
    out: list[str] = []
    good: list[str] = []

    def merge() -> None:
        cur: list[str] = []
        total = 0
        for p in good:
            extra = len(p) + (len(sep) if cur else 0)
            if total + extra > size and cur:
                joined = sep.join(cur).strip()
                if joined:
                    out.append(joined)
                while total > overlap or (total + len(p) + (len(sep) if cur else 0) > size and total > 0):
                    total -= len(cur[0]) + (len(sep) if len(cur) > 1 else 0)
                    cur = cur[1:]
            total += len(p) + (len(sep) if cur else 0)
            cur.append(p)
        joined = sep.join(cur).strip()
        if joined:
            out.append(joined)
        good.clear()

    for p in parts:
        if len(p) < size:
            good.append(p)
            continue
        if good:
            merge()
        out.extend(split_recursively(p, size, overlap, rest) if rest else [p])
    if good:
        merge()
    return out


def recursive_chunks(rows: DataFrame, key: str, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(``key``, chunk_idx, chunk) by ``split_recursively``."""
    schema = pa.schema([("__k", pa.string()), ("chunk_idx", pa.int32()), ("chunk", pa.string())])

    def run(batches):
        for b in batches:
            k, i, c = [], [], []
            for key_, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for n, x in enumerate(split_recursively(t, size, overlap)):
                    k.append(key_)
                    i.append(n)
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(i, pa.int32()), pa.array(c, pa.string())], schema=schema)

    kind = dict(rows.dtypes)[key]
    held = rows.filter(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("__k"), text)
    return held.mapInArrow(run, "__k string, chunk_idx int, chunk string").select(F.col("__k").cast(kind).alias(key), "chunk_idx", "chunk")


# ---------------------------------------------------------------- vectors
Embedder = Callable[[str], list[float]]


def hashed_embedding(text: str, dim: int = 64) -> list[float]:
    """The offline embedder: words hashed into a vector of unit length."""
    v = np.zeros(dim)
    for w in re.findall(r"\w+", text.lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        v[h % dim] += 1.0 if h >> 63 else -1.0
    n = np.linalg.norm(v)
    return (v / n if n else v).astype(np.float32).tolist()


_EMBEDDER: list[Embedder] = [hashed_embedding]


def register_embedder(fn: Embedder) -> None:
    _EMBEDDER[0] = fn


def embedded(rows: DataFrame, text: str, out: str = "embedding") -> DataFrame:
    fn = _EMBEDDER[0]
    names = rows.columns

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([fn(t or "") for t in b.column(text).to_pylist()], pa.list_(pa.float32()))], names=[*names, out])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), f"`{out}` array<float>"]))


def _by_block(vectors: DataFrame, queries: DataFrame, task: Callable, ddl: str, id_col: str, vec_col: str, query_id: str, query_vec: str, block: int) -> DataFrame:
    """``task(batches of (id, v), held queries)`` over all vectors, for blocks of at most ``block`` queries, about, at a time."""
    q = queries.select(F.col(query_id).cast("long").alias("q"), F.col(query_vec).alias("v")).filter("v IS NOT NULL")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).filter("v IS NOT NULL")
    passes = max(1, -(-q.count() // block))
    out = None
    for p in range(passes):
        mine = q if passes == 1 else q.filter(F.pmod(F.xxhash64("q"), F.lit(passes)) == p)
        held = [(r.q, np.asarray(r.v, dtype=np.float64)) for r in mine.collect()]
        part = rows.mapInArrow(lambda batches, held=held: task(batches, held), ddl)
        out = part if out is None else out.unionByName(part)
    return out


def _matrices(b: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a batch, by the length of the vectors."""
    ids = np.asarray(b.column(0).to_pylist(), dtype=np.int64)
    lists = b.column(1).to_pylist()
    by_len: dict[int, list[int]] = {}
    for i, x in enumerate(lists):
        by_len.setdefault(len(x), []).append(i)
    return {n: (ids[ix], np.asarray([lists[i] for i in ix], dtype=np.float64)) for n, ix in by_len.items()}


def knn(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, id_col: str = "vec_id", vec_col: str = "embedding", query_id: str = "query_id", query_vec: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, ``id_col``, dist, rank): exact nearest neighbours by Euclidean distance, ties by id.

    Each task keeps its k best of each query, and only those are shuffled.  Null vectors, and those of another
    length than the query, have no distance and are no hits.
    """
    schema = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("dist", pa.float64())])

    def task(batches, held):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            mats = _matrices(b)
            for qid, v in held:
                if len(v) not in mats:
                    continue
                these, m = mats[len(v)]
                d = np.sqrt(((m - v) ** 2).sum(axis=1))
                if qid in best:
                    these, d = np.concatenate([best[qid][0], these]), np.concatenate([best[qid][1], d])
                if len(d) > k:
                    o = np.lexsort((these, d))[:k]
                    these, d = these[o], d[o]
                best[qid] = (these, d)
        for qid, (these, d) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(these), qid)), pa.array(these), pa.array(d)], schema=schema)

    near = _by_block(vectors, queries, task, "q long, id long, dist double", id_col, vec_col, query_id, query_vec, block)
    w = Window.partitionBy("q").orderBy("dist", "id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col("q").alias("query_id"), F.col("id").alias(id_col), "dist", "rank")


def cosine_above(vectors: DataFrame, queries: DataFrame, least: float, id_col: str = "vec_id", vec_col: str = "embedding", query_id: str = "query_id", query_vec: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, ``id_col``, cosine): all vectors whose cosine with a query is at least ``least``; a zero vector has cosine 0."""
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("cosine", pa.float64())])

    def task(batches, held):
        for b in batches:
            mats = _matrices(b)
            for qid, v in held:
                if len(v) not in mats:
                    continue
                these, m = mats[len(v)]
                n = np.sqrt((m**2).sum(axis=1)) * np.sqrt((v**2).sum())
                c = np.divide((m * v).sum(axis=1), n, out=np.zeros(len(these)), where=n > 0)
                hit = c >= least
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(hit.sum(), qid)), pa.array(these[hit]), pa.array(c[hit])], schema=schema)

    return _by_block(vectors, queries, task, "query_id long, id long, cosine double", id_col, vec_col, query_id, query_vec, block).withColumnRenamed("id", id_col)


DEFAULT_NEIGHBOURS = 4


def stuffed(chunks: DataFrame, queries: DataFrame, k: int = DEFAULT_NEIGHBOURS) -> DataFrame:
    """(query_id, context): the ``k`` nearest chunks of each query, in order of distance, put into one text; of chunks (vec_id, chunk, embedding)."""
    near = knn(chunks, queries, k).join(chunks.select("vec_id", "chunk"), "vec_id")
    got = F.array_sort(F.collect_list(F.struct("rank", "chunk")))  # k rows of each query
    return near.groupBy("query_id").agg(F.array_join(F.transform(got, lambda x: x["chunk"]), "\n\n").alias("context"))


def relevance(similarity: Column, rank: Column) -> Column:
    """Similarity and centrality weighed; 0 for what is missing."""
    return WEIGHT_SIMILARITY * F.coalesce(similarity, F.lit(0.0)) + WEIGHT_CENTRALITY * F.coalesce(rank, F.lit(0.0))


# ---------------------------------------------------------------- packing
def running_sum(df: DataFrame, group: str, order: str, value: str, out: str = "running", partitions: int | None = None) -> DataFrame:
    """The sum of ``value`` up to each row in ``order`` within ``group``, for groups of any size.

    Rows are laid out in ranges of (group, order); each range sums its own rows, the sums of ranges, one row for each
    group and range, give the offsets.  A plain window would bring a whole group into one task.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ranges are sampled, so they are made once and kept
    laid = checkpointed(df.repartitionByRange(n, group, order).withColumn("__p", F.spark_partition_id()))
    sums = laid.groupBy(group, "__p").agg(F.sum(value).alias("__s"))
    before = F.coalesce(F.sum("__s").over(Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(group, "__p", before.alias("__o"))
    w = Window.partitionBy(group, "__p").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return laid.join(offsets, [group, "__p"]).withColumn(out, F.sum(value).over(w) + F.col("__o")).drop("__p", "__o")


def packed(entries: DataFrame, group: str, order: str, text: str, budget: Column) -> DataFrame:
    """Entries in order until the first that would exceed the budget of their group; later ones are not tried.

    Only (group, order, tokens) is laid out and summed; texts are joined to the few keys that are kept.  ``order`` is unique within a group.
    """
    kept = running_sum(entries.select(group, order, token_count(F.col(text)).alias("tokens")), group, order, "tokens").filter(F.col("running") <= budget)
    return entries.join(kept, [group, order])
