"""Sources of repository files: folders, listings of a hosting API already fetched, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import paths
from gristmill.functions.text import decoded, newline_normalized


def from_folder(spark: SparkSession, folder: str, repo_id: int = 0, glob: str = "*") -> DataFrame:
    """Files below a folder, recursively, as (repo_id, path, content, size); content is null where the bytes are no UTF-8."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    root = F.regexp_replace(F.lit("file:" + folder.rstrip("/") + "/" if "://" not in folder else folder.rstrip("/") + "/"), r"^file:/+", "file:/")
    path = F.regexp_replace(F.col("path"), r"^file:/+", "file:/")
    return raw.select(F.lit(repo_id).cast("long").alias("repo_id"), F.expr("1").alias("__one"), path.substr(F.length(root) + 1, F.length(path)).alias("path"), decoded(F.base64("content")).alias("content"), F.col("length").alias("size")).drop("__one")


def from_listing(listing: DataFrame) -> DataFrame:
    """Files of (repo_id, type, path, content as base64): folders and what does not decode are left out."""
    return listing.filter(F.coalesce("type", F.lit("file")) != "dir").withColumn("content", decoded(F.regexp_replace("content", r"\s", ""))).filter(F.col("content").isNotNull() & paths.is_safe(F.col("path")))


def latest(files: DataFrame, *order: str) -> DataFrame:
    """One row per (repo_id, path): the last in the given order; a partial aggregate, not a sort."""
    rest = [c for c in files.columns if c not in ("repo_id", "path")]
    best = F.max_by(F.struct(*rest), F.struct(*[F.col(o) for o in order])).alias("b")
    return files.groupBy("repo_id", "path").agg(best).select("repo_id", "path", *[F.col(f"b.{c}").alias(c) for c in rest])


def prepared(files: DataFrame) -> DataFrame:
    """Line ends made ``\\n``; size stays that of the bytes as they came; rows without content left out."""
    return files.filter(F.col("content").isNotNull()).withColumn("size", F.octet_length("content")).withColumn("content", newline_normalized(F.col("content")))
