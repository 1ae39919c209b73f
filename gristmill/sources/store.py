"""Stored tables and the node-link form of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill import schema


def create_tables(spark: SparkSession, database: str = "default") -> None:
    """The two tables, where they are not there yet."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.repositories (id BIGINT, repo_name STRING, metadata STRING) USING parquet")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.ast_data (id BIGINT, file_path STRING, ast_info STRING, repo_id BIGINT) USING parquet PARTITIONED BY (repo_id)")


def save_context(context: DataFrame, folder: str) -> None:
    """The snapshot of what is known of files; the last one stays, laid out by repository."""
    context.write.mode("overwrite").partitionBy("repo_id").parquet(folder)


def read_context(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def save_tables(repositories: DataFrame, file_info: DataFrame, folder: str) -> None:
    """Both tables in bulk; what is known of files is laid out by repository, so that a read of one touches only its part."""
    repositories.write.mode("append").parquet(f"{folder}/repositories")
    file_info.write.mode("append").partitionBy("repo_id").parquet(f"{folder}/ast_data")


def repository_metadata(repositories: DataFrame, latest: bool = False) -> DataFrame:
    """(repo_name, id, metadata): the first stored row of each name, or the last."""
    pick = F.max_by if latest else F.min_by
    return repositories.groupBy("repo_name").agg(pick(F.struct("id", "metadata"), "id").alias("r")).select("repo_name", "r.id", "r.metadata")


def with_ids(rows: DataFrame, start: int = 0) -> DataFrame:
    """Unique ids for a bulk append: not dense, and without a sort."""
    return rows.withColumn("id", F.monotonically_increasing_id() + F.lit(start + 1))


def to_node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, json): one document per repository, nodes and links in order of their ids.

    A document holds its repository's whole graph, as its readers expect; graphs of any size are kept as the two tables.
    """
    n = nodes.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("id", "type", "label", "shape", "level"))).alias("nodes"))
    e = edges.groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "relation", "label"))).alias("links"))
    doc = F.struct(F.lit(True).alias("directed"), F.lit(False).alias("multigraph"), F.create_map().cast("map<string,string>").alias("graph"), "nodes", F.coalesce("links", F.array().cast("array<struct<source:string,target:string,relation:string,label:string>>")).alias("links"))
    return n.join(e, "repo_id", "left").select("repo_id", F.to_json(doc).alias("json"))


def from_node_link(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    g = docs.select("repo_id", F.from_json("json", schema.NODE_LINK).alias("g"))
    nodes = g.select("repo_id", F.explode("g.nodes").alias("n")).select("repo_id", "n.*")
    edges = g.select("repo_id", F.explode("g.links").alias("l")).select("repo_id", F.col("l.source").alias("src"), F.col("l.target").alias("dst"), "l.relation", "l.label")
    return nodes, edges


def read_node_link(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.lit(0).cast("long").alias("repo_id"), F.col("value").alias("json"))
