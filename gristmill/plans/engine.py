"""One object that composes the operators as an application does: load, look at the graph, ask."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.text import BUDGETS, query_class
from gristmill.functions.vectors import cosine
from gristmill.operators import chat, extract, graph, graphops, retrieve
from gristmill.sources import repository

Model = Callable[[str], str]
_MODEL: list[Model] = [lambda prompt: prompt]


def register_llm(fn: Model) -> None:
    """Set the model that answers prompts; without one the prompt itself is the answer."""
    _MODEL[0] = fn


class Engine:
    """Repositories in, graph and answers out.  DataFrames are lazy and cached where several questions use them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.files: DataFrame | None = None

    def load(self, files: DataFrame) -> Engine:
        """Take (repo_id, path, content) rows; of rows with the same path the last by ``file_ord`` counts."""
        order = [c for c in ("file_ord", "file_id") if c in files.columns] or ["content"]
        self.files = repository.prepared(repository.latest(files, *order)).cache()
        self.info = extract.file_info(self.files).cache()
        self.nodes, self.edges = (d.cache() for d in graph.graph(self.info))
        self.rank = graphops.pagerank(self.nodes, self.edges).cache()
        return self

    def file_info(self) -> DataFrame:
        return self.info

    def graph(self) -> tuple[DataFrame, DataFrame]:
        return self.nodes, self.edges

    def _most_relevant(self, question: str, node_type: str) -> DataFrame:
        q = F.array(*[F.lit(float(x)) for x in retrieve._EMBEDDER[0](question)])
        both = retrieve.embedded(self.nodes.filter(F.col("type") == node_type), "id", "a")
        s = both.select("repo_id", "id", cosine(F.col("a"), q).alias("sim")).join(self.rank, ["repo_id", "id"], "left")
        return s.select("repo_id", "id", retrieve.relevance(F.col("sim"), F.col("score")).alias("score")).orderBy(F.desc("score"), "repo_id", "id").limit(1)

    def relevant(self, question: str) -> DataFrame:
        """(repo_id, id, pos): the nodes that matter to a question, by its class."""
        kind = self.spark.range(1).select(query_class(F.lit(question))).first()[0]
        nodes = self.nodes
        if kind == "codebase":
            got = nodes.select("repo_id", "id")
        elif kind == "directory":
            got = graphops.descendants(self.edges, self._most_relevant(question, "directory"))
        elif kind == "file":
            got = graphops.ego(self.edges, self._most_relevant(question, "file"), "out")
        elif kind == "function":
            got = graphops.ego(self.edges, self._most_relevant(question, "import"), "both")
        else:
            q = retrieve.embedded(self.spark.createDataFrame([(0, question)], "query_id long, text string"), "text")
            docs = self.files.join(self.info.drop("size"), ["repo_id", "path"], "left")
            text = retrieve.document_text(F.col("path"), F.col("content"), F.col("functions"), F.col("classes"), F.col("imports"), {k: F.col(k) for k in ("tags", "queries", "type", "name", "error")})
            keyed = docs.select(F.concat_ws("\x1f", "repo_id", "path").alias("k"), text.alias("text"))
            chunks = retrieve.embedded(retrieve.recursive_chunks(keyed, "k", "text").withColumn("vec_id", F.xxhash64("k", "chunk_idx")), "chunk")
            hits = retrieve.knn(chunks, q).join(chunks.select("vec_id", "k"), "vec_id")
            near = hits.select(F.split("k", "\x1f")[0].cast("long").alias("repo_id"), F.split("k", "\x1f")[1].alias("id"))
            central = self.rank.orderBy(F.desc("score"), "repo_id", "id").limit(retrieve.CENTRAL).select("repo_id", "id")
            got = near.unionByName(central).distinct()
        return got

    def context(self, question: str) -> DataFrame:
        """(repo_id, path, entry): the files packed under the budget of the question's class."""
        kind = self.spark.range(1).select(query_class(F.lit(question))).first()[0]
        rows = self.files.select("repo_id", "path", "content").join(self.info.select("repo_id", "path", "functions", "classes", "imports"), ["repo_id", "path"], "left")
        rows = rows.join(self.relevant(question).withColumnRenamed("id", "path"), ["repo_id", "path"], "left_semi").join(self.rank.withColumnRenamed("id", "path"), ["repo_id", "path"], "left")
        c = F.col
        entries = rows.select("repo_id", "path", F.lit(1).alias("q"), F.struct((-F.coalesce("score", F.lit(0.0))).alias("s"), "repo_id", "path").alias("pos"), retrieve.context_entry(c("path"), c("content"), c("functions"), c("classes"), c("imports")).alias("entry"))
        return retrieve.packed(entries, "q", "pos", "entry", F.lit(BUDGETS[kind])).select("repo_id", "path", "entry", "tokens", "pos")

    def overview(self) -> DataFrame:
        rows = self.files.select("repo_id", "path", "content").join(self.info.select("repo_id", "path", "type", "functions", "classes"), ["repo_id", "path"], "left")
        c = F.col
        return rows.select("repo_id", "path", retrieve.overview_entry(c("path"), c("type"), c("functions"), c("classes"), c("content")).alias("entry"))

    def ask(self, question: str) -> str:
        """The answer of the model to the assembled prompt; its context is bounded by the budget, its overview lists every file."""
        if self.files is None:
            raise ValueError("load files first")
        if not question.strip():
            raise ValueError("the question is blank")
        context = "\n\n".join(r.entry for r in self.context(question).orderBy("pos").collect())
        overview = "".join(r.entry for r in self.overview().orderBy("repo_id", "path").toLocalIterator())
        text = self.spark.range(1).select(chat.prompt(F.lit(overview), F.lit(context), F.lit(question))).first()[0]
        return _MODEL[0](chat.SYSTEM + "\n\n" + text)
