"""Questions, prompts and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SYSTEM = "You answer questions about a source repository. Rely on the context that is given, cite files by path, say so where the context is silent, and keep to the point."
STEPS = "Answer from the relevant files first and from the overview second; where neither says it, name what is missing."


def session_of(context: DataFrame, key: str = "repo_id", path: str = "path", content: str = "content") -> DataFrame:
    """(``key``, session_id): a hash of a repository's files that does not depend on their order.

    Hashes of files are summed as two 64-bit halves, so a repository of any size is a partial aggregate; equal
    contexts have equal sessions.
    """
    h = F.md5(F.concat_ws("\x1f", path, F.md5(F.coalesce(F.col(content), F.lit("")))))
    half = lambda a: F.sum(F.conv(F.substring(h, a, 15), 16, 10).cast("decimal(38,0)"))
    s = context.groupBy(key).agg(half(1).alias("a"), half(17).alias("b"), F.count("*").alias("n"))
    return s.select(key, F.md5(F.concat_ws(":", F.col("a").cast("string"), F.col("b").cast("string"), F.col("n").cast("string"))).alias("session_id"))


def new_sessions(sessions: DataFrame, known: DataFrame) -> DataFrame:
    """Sessions that are not there yet, each once."""
    return sessions.dropDuplicates(["session_id"]).join(known.select("session_id"), "session_id", "left_anti")


def history(messages: DataFrame) -> DataFrame:
    """(session_id, turn, role, text, history_turns, history_chars, previous): what stands before each message; equal rows count once, as do blank ones not at all.

    Frames run along the sorted session and hold one row at a time, however long it is.
    """
    m = messages.filter(F.trim("text") != "").select("session_id", "turn", "role", "text").distinct()
    w = Window.partitionBy("session_id").orderBy("turn", "role", "text")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return m.select("*", F.count("*").over(before).alias("history_turns"), F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).alias("history_chars"), F.lag("text").over(w).alias("previous"))


def buffer(messages: DataFrame) -> DataFrame:
    """(session_id, turn, role, text, buffer): each message with the whole conversation before it, a line for each message; blank and equal rows as in ``history``.

    The buffer of a message is what a model is given with it, so that each row holds one; only the rows of one session meet.
    """
    m = messages.filter(F.trim("text") != "").select("session_id", "turn", "role", "text").distinct()
    before = Window.partitionBy("session_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    return m.withColumn("buffer", F.array_join(F.collect_list(F.concat("role", F.lit(": "), "text")).over(before), "\n"))


def prompt(overview: Column, context: Column, question: Column) -> Column:
    """The text that a model gets: overview of the repository, relevant files, the question, and how to answer."""
    none = F.lit("")
    return F.concat(F.lit("Repository:\n"), F.coalesce(overview, none), F.lit("\n\nRelevant files:\n"), F.coalesce(context, none), F.lit("\n\nQuestion: "), question, F.lit("\n\n" + STEPS))


def message_lines(messages: DataFrame) -> DataFrame:
    """(session_id, turn, line_no, kind, line): a message as it is shown: fences and what they hold, numbered items, paragraphs; blank lines are left out."""
    lines = messages.filter("text IS NOT NULL").select("session_id", "turn", "role", F.split("text", "\n").alias("l"))
    fence = lambda x: F.startswith(F.ltrim(x), F.lit("```")).cast("int")
    # fences before a line, summed along the array of one message
    sums = F.aggregate("l", F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + fence(x))))
    e = lines.select("session_id", "turn", "role", F.posexplode(F.arrays_zip(F.col("l").alias("line"), sums.alias("n"))).alias("line_no", "x"))
    line, n = F.col("x.line"), F.col("x.n")
    kind = F.when(fence(line) == 1, "fence").when(n % 2 == 1, "code").when(line.rlike(r"^\d+\.\s"), "item").otherwise("paragraph")
    return e.filter(F.trim(line) != "").select("session_id", "turn", "role", "line_no", kind.alias("kind"), line.alias("line"))
