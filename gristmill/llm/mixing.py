"""Problem 8: mixing sources to target weights.

Sizes are tokens of a public tokenizer whose file is a parameter.  Weights follow from temperature mixing: a
source's weight is target^t * share^(1 - t), normalised, share being its share of all tokens.  At t = 1 the
targets are met exactly, at t = 0 the corpus is taken as it is; t is found by bisection as the
greatest exponent whose weights no source exceeds with ``max_repeats`` copies, or the one that meets a target
entropy.  Without a budget the total is the greatest for which t = 1 holds.  With ``uniform`` targets the weight is
share^(1 - t) alone, the temperature mixing of the sources' own shares: from as they are to all alike.

A weight is realised by a budgeted block permutation: the documents of a source are spread by hash over
blocks, whole blocks are taken in order until the source's budget is met, and only the block in which it is met is
ordered by document, so no task ever sorts a whole source.

Defined results: null text, null or unlisted sources take no part; sources are compared without case and outer
blanks; a source without documents reaches 0, and its share is spread over the rest in proportion.
"""

from __future__ import annotations

import base64
import math
import os

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenizer of the public byte-level BPE of 50,257 entries (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Sources are planned on the driver, one row each; more than this many are refused.
SOURCES_LIMIT = 100_000
#: Documents of a block, about: what one task orders.
BLOCK_DOCS = 20_000

_ENCODING: dict[str, object] = {}


def _encoding(path: str):
    if path not in _ENCODING:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODING[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODING[path]


def token_counts(rows: DataFrame, text_col: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """The kept columns and n_tokens, the tokens of the whole text."""
    types = dict(rows.dtypes)

    def run(batches):
        enc = _encoding(tokenizer)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return rows.select(*keep, text_col).mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keep), "n_tokens long"]))


def entropy(w: dict[str, float]) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def tempered(target: dict[str, float], share: dict[str, float], t: float) -> dict[str, float]:
    """target^t * share^(1 - t) over the sources that have both, normalised."""
    logs = {s: t * math.log(target[s]) + (1 - t) * math.log(share[s]) for s in target if target[s] > 0 and share.get(s, 0) > 0}
    if not logs:
        return {}
    top = max(logs.values())
    e = {s: math.exp(v - top) for s, v in logs.items()}
    z = sum(e.values())
    return {s: v / z for s, v in e.items()}


def plan(target: dict[str, float], tokens: dict[str, int], repeats: dict[str, int], budget: int | None = None, target_entropy: float | None = None) -> tuple[dict[str, float], float, float]:
    """(weights, total tokens, exponent) by bisection of the exponent."""
    tokens = {s: n for s, n in tokens.items() if n > 0 and target.get(s, 0) > 0 and repeats.get(s, 0) > 0}
    total = sum(tokens.values())
    if not total:
        return {}, 0.0, 1.0
    share = {s: n / total for s, n in tokens.items()}
    want = {s: target[s] for s in tokens}
    most = lambda w: min(repeats[s] * tokens[s] / w[s] for s in w)
    t = 1.0
    if target_entropy is not None:
        lo, hi = 0.0, 1.0
        rising = entropy(tempered(want, share, 1.0)) >= entropy(tempered(want, share, 0.0))
        for _ in range(60):
            t = (lo + hi) / 2
            if (entropy(tempered(want, share, t)) < target_entropy) == rising:
                lo = t
            else:
                hi = t
    w = tempered(want, share, t)
    if budget is None:
        return w, most(w), t
    if most(w) < budget:
        lo, hi = 0.0, t
        for _ in range(60):
            mid = (lo + hi) / 2
            if most(tempered(want, share, mid)) >= budget:
                lo = mid
            else:
                hi = mid
        t = lo
        w = tempered(want, share, t)
    return w, min(float(budget), most(w)), t


def _prepared(documents: DataFrame, targets: DataFrame, tokenizer: str, seed: int, uniform: bool = False):
    """Counted documents of listed sources with their block, and what is known of each source."""
    wanted = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").filter("source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    rows = wanted.limit(SOURCES_LIMIT + 1).collect()
    if len(rows) > SOURCES_LIMIT:
        raise ValueError("too many sources to plan")
    target = {r.source: 1.0 if uniform else float(r.target_share or 0) for r in rows}
    repeats = {r.source: int(r.max_repeats or 0) for r in rows}
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.trim("source")).alias("source"), F.col("text").alias("__text")).filter(F.col("__text").isNotNull() & F.col("source").isin(list(target)))
    counted = token_counts(docs, "__text", ["doc_id", "source"], tokenizer).withColumn("mix_key", F.xxhash64("doc_id", F.lit(seed)))
    counted = counted.persist(StorageLevel.MEMORY_AND_DISK)
    held = {r.source: (r.n, r.t) for r in counted.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}
    return counted, target, repeats, held


def mixture(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, budget: int | None = None, target_entropy: float | None = None, seed: int = 17, block_docs: int = BLOCK_DOCS, uniform: bool = False, epochs: float | None = None) -> DataFrame:
    """(source, doc_id, copy_no, n_tokens, mix_block, mix_key, exponent): one row for each time a document is taken; exponent is t.

    ``epochs`` is a budget in multiples of all tokens of the listed sources.

    Read in the order of mix_block and mix_key it is mixed: every block holds every source in its share.
    """
    spark = documents.sparkSession
    counted, target, repeats, held = _prepared(documents, targets, tokenizer, seed, uniform)
    if epochs is not None:
        budget = round(epochs * sum(t for s, (_, t) in held.items() if target.get(s, 0) > 0 and repeats.get(s, 0) > 0))
    w, total, exponent = plan(target, {s: t for s, (_, t) in held.items()}, repeats, budget, target_entropy)
    rows = []
    for s, x in w.items():
        n, t = held[s]
        quota = min(x * total, float(repeats[s] * t))
        full = min(int(quota // t + 1e-9), repeats[s])
        rows.append((s, full, max(0.0, quota - full * t) if full < repeats[s] else 0.0, max(1, -(-n // block_docs))))
    plans = spark.createDataFrame(rows, "source string, passes int, rest double, blocks long")
    # the number of blocks is a matter of the source's size; plans has one row per source and is bounded by SOURCES_LIMIT
    placed = counted.join(F.broadcast(plans), "source").withColumn("block", F.pmod(F.shiftright("mix_key", 8), F.col("blocks")))
    sums = placed.filter("rest > 0").groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"))
    before = sums.withColumn("before", F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("source", "block", "tokens", "before")
    at = placed.join(before, ["source", "block"], "left")
    whole = F.col("before") + F.col("tokens") <= F.col("rest")
    cut = at.filter((F.col("rest") > 0) & (F.col("before") < F.col("rest")) & ~whole)
    upto = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("mix_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    part = cut.withColumn("upto", F.col("before") + F.coalesce(upto, F.lit(0))).filter(F.col("upto") + F.col("n_tokens") / 2 <= F.col("rest")).withColumn("copies", F.col("passes") + 1)
    left = cut.withColumn("upto", F.col("before") + F.coalesce(upto, F.lit(0))).filter(F.col("upto") + F.col("n_tokens") / 2 > F.col("rest")).withColumn("copies", F.col("passes"))
    plainly = at.filter(F.col("before").isNull() | whole | (F.col("before") >= F.col("rest"))).withColumn("copies", F.col("passes") + F.when(F.col("before").isNotNull() & whole, 1).otherwise(0))
    cols = ["source", "doc_id", "n_tokens", "mix_key", "copies"]
    taken = plainly.select(cols).unionByName(part.select(cols)).unionByName(left.select(cols)).filter("copies > 0")
    out = taken.select("source", "doc_id", F.explode(F.sequence(F.lit(1), "copies")).alias("copy_no"), "n_tokens", "mix_key")
    blocks = max(1, int(sum(n for n, _ in held.values()) // block_docs))
    key = F.xxhash64("mix_key", "copy_no")
    return out.select("source", "doc_id", F.col("copy_no").cast("int").alias("copy_no"), "n_tokens", F.pmod(key, F.lit(blocks)).alias("mix_block"), key.alias("mix_key"), F.lit(exponent).alias("exponent"))


def tempered_shares(documents: DataFrame, targets: DataFrame, epochs: float = 1.0, tokenizer: str = TOKENIZER) -> DataFrame:
    """(source, n_tokens, share, exponent, weight, tokens_taken, share_reached, most_repeats) of a mixture of ``epochs`` times all tokens, tempered by the sources' own shares alone.

    The exponent of the shares, 1 - t, is the least, and the mixture the flattest, for which no source needs more than its ``max_repeats`` copies.
    """
    mixed = mixture(documents, targets, tokenizer, uniform=True, epochs=epochs)
    got = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("k"), F.max("n_tokens").alias("n"), F.max("exponent").alias("t"))
    # a document that is not taken counts for its source's share all the same
    listed = targets.select(F.lower(F.trim("source")).alias("source")).filter("source IS NOT NULL AND max_repeats > 0").distinct()
    docs = documents.select(F.lower(F.trim("source")).alias("source"), F.col("text").alias("__text")).filter(F.col("__text").isNotNull()).join(F.broadcast(listed.limit(SOURCES_LIMIT)), "source")
    held = token_counts(docs, "__text", ["source"], tokenizer).groupBy("source").agg(F.sum("n_tokens").alias("n_tokens")).filter("n_tokens > 0")
    took = got.groupBy("source").agg(F.sum(F.col("k") * F.col("n")).alias("tokens_taken"), F.max("k").cast("long").alias("most_repeats"), F.max("t").alias("t"))
    every = Window.partitionBy(F.lit(1))  # one row per source by now
    j = held.join(took, "source").withColumn("share", F.col("n_tokens") / F.sum("n_tokens").over(every)).withColumn("exponent", 1 - F.col("t"))
    j = j.withColumn("raw", F.pow("share", "exponent"))
    r = lambda c, n: F.round(c, 6).alias(n)
    return j.select("source", "n_tokens", r(F.col("share"), "share"), r(F.col("exponent"), "exponent"), r(F.col("raw") / F.sum("raw").over(every), "weight"), "tokens_taken", r(F.col("tokens_taken") / F.sum("tokens_taken").over(every), "share_reached"), "most_repeats")


def mixture_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, rows_taken, tokens_taken, share_reached, most_repeats) of every source of the targets."""
    got = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("t")).groupBy("source").agg(F.sum("k").alias("rows_taken"), F.sum("t").alias("tokens_taken"), F.max("k").alias("most_repeats"))
    # one row per source by now, so a frame over all of them is small
    got = got.withColumn("all_tokens", F.sum("tokens_taken").over(Window.partitionBy(F.lit(1))))
    t = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").join(got, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return t.select("source", "target_share", "max_repeats", zero("rows_taken"), zero("tokens_taken"), F.round(F.coalesce(F.col("tokens_taken") / F.col("all_tokens"), F.lit(0.0)), 6).alias("share_reached"), zero("most_repeats"))
