"""Queries of the core operators over whole tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import paths, vectors
from gristmill.functions import text as tx
from gristmill.operators import chat, extract, graph, graphops, retrieve
from gristmill.session import checkpointed
from gristmill.sources import repository, store
from gristmill.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PAGERANK_ROUNDS = 8
#: Rounds of the queries without SQL, as the survey has them.
SURVEYED_ROUNDS = 20
TERM = "parser"
QUESTION = "which parser reads the settings"
LEVEL = 2


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


# ---------------------------------------------------------------- sources and stored tables
@query(
    r"""SELECT id, base, CASE WHEN rest <> '' THEN rest END AS rest FROM (
          SELECT id, 'https://github.com/' || regexp_extract(u, p, 1) || '/' || regexp_extract(u, p, 2) AS base, regexp_extract(u, p, 3) AS rest
          FROM (SELECT id, regexp_replace(u, '/+$', '') AS u, '^https://github\.com/([^/]+)/([^/]+)(/.*)?$' AS p
                FROM (SELECT id, 'https://github.com/' || repo_name || CASE WHEN id % 3 = 0 THEN '/src/main/' WHEN id % 3 = 1 THEN '/' ELSE '' END AS u FROM repositories))
          WHERE regexp_matches(u, p))"""
)
def url_normalize(spark, d):
    """A1-A3: addresses of repositories, taken apart."""
    url = F.concat(F.lit("https://github.com/"), F.col("repo_name"), F.when(F.col("id") % 3 == 0, "/src/main/").when(F.col("id") % 3 == 1, "/").otherwise(""))
    base, rest = tx.repo_url(url)
    return _t(spark, d, "repositories").select("id", base.alias("base"), rest.alias("rest")).filter("base IS NOT NULL")


@query("SELECT file_id, md5(content) AS content_md5, CAST(strlen(content) AS BIGINT) AS bytes FROM repo_files WHERE content IS NOT NULL")
def content_decode_filter(spark, d):
    """base64 payloads decoded; what is not UTF-8 is left out."""
    payload = F.coalesce(F.base64(F.encode("content", "utf-8")), F.lit("/w=="))
    rows = _t(spark, d, "repo_files").select("file_id", payload.alias("payload")).withColumn("content", tx.decoded(F.col("payload"))).filter("content IS NOT NULL")
    return rows.select("file_id", F.md5("content").alias("content_md5"), F.octet_length("content").cast("long").alias("bytes"))


@query("SELECT repo_id, file_path AS path, arg_max(md5(ast_info), id) AS info_md5, max(id) AS id FROM ast_data WHERE ast_info IS NOT NULL GROUP BY ALL")
def dedup_last_wins(spark, d):
    """The last stored row of each path."""
    rows = _t(spark, d, "ast_data").filter("ast_info IS NOT NULL").withColumnRenamed("file_path", "path")
    return repository.latest(rows, "id").select("repo_id", "path", F.md5("ast_info").alias("info_md5"), "id")


@query(r"SELECT file_id, md5(regexp_replace(content, '\r\n?', chr(10), 'g')) AS content_md5, CAST(strlen(content) AS BIGINT) AS size FROM repo_files WHERE content IS NOT NULL")
def newline_normalize(spark, d):
    """Line ends made one, size of the bytes as they came."""
    return repository.prepared(_t(spark, d, "repo_files")).select("file_id", F.md5("content").alias("content_md5"), F.col("size").cast("long").alias("size"))


@query("SELECT repo_name, min(id) AS id, arg_min(md5(metadata), id) AS metadata_md5 FROM repositories GROUP BY repo_name")
def point_lookup_first(spark, d):
    """The first stored row of a name."""
    return store.repository_metadata(_t(spark, d, "repositories")).select("repo_name", "id", F.md5("metadata").alias("metadata_md5"))


@query(
    """SELECT id, json_extract_string(metadata, '$.name') AS name, TRY_CAST(json_extract_string(metadata, '$.stargazers_count') AS BIGINT) AS stars, json_extract_string(metadata, '$.owner.login') AS owner
       FROM repositories WHERE json_valid(metadata)"""
)
def json_payload_roundtrip(spark, d):
    """Payloads decoded and encoded."""
    s = "name string, stargazers_count long, owner struct<login: string>"
    once = _t(spark, d, "repositories").filter(tx.valid_json(F.col("metadata"))).select("id", F.to_json(F.from_json("metadata", s)).alias("j"))
    return once.select("id", F.from_json("j", s).alias("m")).select("id", F.col("m.name").alias("name"), F.col("m.stargazers_count").alias("stars"), F.col("m.owner.login").alias("owner"))


# ---------------------------------------------------------------- paths and extraction
_BASE = "regexp_extract({p}, '([^/]*)$', 1)"
_EXT = r"lower(regexp_extract({p}, '(?:^|/)\.*[^/.][^/]*?(\.[^./]*)$', 1))"


@query(f"SELECT file_id, {_BASE.format(p='path')} AS base, regexp_replace(path, '/?[^/]*$', '') AS dir, {_EXT.format(p='path')} AS ext, CAST(length(path) - length(replace(path, '/', '')) AS INT) AS depth FROM repo_files")
def path_parts(spark, d):
    """B2 B23."""
    p = F.col("path")
    return _t(spark, d, "repo_files").select("file_id", paths.basename(p).alias("base"), paths.dirname(p).alias("dir"), paths.extension(p).alias("ext"), paths.depth(p).alias("depth"))


def _with_ext(spark, d, *exts):
    return _t(spark, d, "repo_files").filter(F.col("content").isNotNull() & paths.extension(F.col("path")).isin(*exts))


def _sql_ext(*exts):
    return f"content IS NOT NULL AND {_EXT.format(p='path')} IN ({', '.join(repr(e) for e in exts)})"


@query(f"SELECT tag, count(*) AS n, count(DISTINCT file_id) AS files FROM (SELECT file_id, lower(unnest(regexp_extract_all(content, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM repo_files WHERE {_sql_ext('.html', '.htm')}) GROUP BY tag")
def html_tags(spark, d):
    """B20."""
    rows = _with_ext(spark, d, ".html", ".htm").select("file_id", F.explode(extract.html_tags(F.col("content"))).alias("tag"))
    return rows.groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("files"))


@query(f"SELECT file_id, CAST(len(q) AS INT) AS parts, md5(array_to_string(q, '|')) AS parts_md5 FROM (SELECT file_id, string_split(content, ';') AS q FROM repo_files WHERE {_sql_ext('.sql')})")
def sql_split(spark, d):
    """B21."""
    q = extract.sql_queries(F.col("content"))
    return _with_ext(spark, d, ".sql").select("file_id", F.size(q).alias("parts"), F.md5(F.array_join(q, "|")).alias("parts_md5"))


@query(
    rf"""SELECT file_id, array_to_string(regexp_extract_all(content, 'func\s+(\w+)', 1), ',') AS functions,
         array_to_string(flatten(list_transform(list_zip(regexp_extract_all(content, 'import\s*\(([\s\S]*?)\)|import\s*([^\n]+)', 1), regexp_extract_all(content, 'import\s*\(([\s\S]*?)\)|import\s*([^\n]+)', 2)),
           lambda z: CASE WHEN coalesce(z[1], '') <> '' THEN regexp_extract_all(z[1], '"([^"]+)"', 1) ELSE regexp_extract_all(coalesce(z[2], ''), '"([^"]+)"', 1)[1:1] END)), ',') AS imports
         FROM repo_files WHERE {_sql_ext('.go')}"""
)
def go_extract(spark, d):
    """B15 B16."""
    c = F.col("content")
    return _with_ext(spark, d, ".go").select("file_id", F.array_join(extract.go_functions(c), ",").alias("functions"), F.array_join(extract.go_imports(c), ",").alias("imports"))


@query(rf"SELECT file_id, array_to_string(regexp_extract_all(content, '(?m)^\s*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;', 1), ',') AS imports FROM repo_files WHERE {_sql_ext('.java')}")
def java_imports(spark, d):
    """B14."""
    return _with_ext(spark, d, ".java").select("file_id", F.array_join(extract.java_imports(F.col("content")), ",").alias("imports"))


@query(rf"""SELECT file_id, array_to_string(regexp_extract_all(content, '(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]', 1), ',') AS headers FROM repo_files WHERE {_sql_ext('.c', '.h')}""")
def c_includes(spark, d):
    """B19."""
    return _with_ext(spark, d, ".c", ".h").select("file_id", F.array_join(extract.c_includes(F.col("content")), ",").alias("headers"))


_KNOWN = ".py .js .jsx .ts .tsx .java .c .cpp .h .hpp .go .html .htm .sql".split()


@query(f"SELECT file_id, 'non-code' AS type, {_BASE.format(p='path')} AS name, CAST(strlen(content) AS BIGINT) AS size FROM repo_files WHERE content IS NOT NULL AND {_EXT.format(p='path')} NOT IN ({', '.join(repr(e) for e in _KNOWN)})")
def noncode_meta(spark, d):
    """B22."""
    rows = _t(spark, d, "repo_files").filter(F.col("content").isNotNull() & ~paths.extension(F.col("path")).isin(_KNOWN))
    return rows.select("file_id", F.lit("non-code").alias("type"), paths.basename(F.col("path")).alias("name"), F.octet_length("content").cast("long").alias("size"))


def _info_from_files(spark, d):
    files = _t(spark, d, "repo_files").filter("content IS NOT NULL").select("repo_id", "path", "content", "file_id")
    return extract.file_info(repository.prepared(repository.latest(files, "file_id")))


@query()
def file_info(spark, d):
    """What every file defines and imports, by its language's extractor."""
    return _info_from_files(spark, d)


@query()
def language_summary(spark, d):
    """Definitions by extension, and files whose parser failed."""
    n = lambda c: F.sum(F.coalesce(F.size(c), F.lit(0))).alias(c)
    return _info_from_files(spark, d).groupBy("ext").agg(F.count("*").alias("files"), n("functions"), n("classes"), n("imports"), F.count("error").alias("errors"))


# ---------------------------------------------------------------- the graph, on stored lists
_SAFE = r"file_path NOT LIKE '/%' AND NOT regexp_matches(file_path, '(?:^|/)\.\.(?:/|$)')"
_INFO = f"""info AS (
  SELECT repo_id, path, CAST(json_extract(j, '$.functions') AS VARCHAR[]) AS functions, CAST(json_extract(j, '$.classes') AS VARCHAR[]) AS classes, CAST(json_extract(j, '$.imports') AS VARCHAR[]) AS imports
  FROM (SELECT repo_id, file_path AS path, arg_max(ast_info, id) AS j FROM ast_data WHERE json_valid(ast_info) AND {_SAFE} GROUP BY ALL)),
sym AS (SELECT repo_id, name, max(path) AS file FROM (SELECT repo_id, path, unnest(list_concat(coalesce(functions, []), coalesce(classes, []))) AS name FROM info) GROUP BY ALL),
imp0 AS (SELECT repo_id, path, unnest(imports) AS imp, unnest(range(len(imports))) AS ord, {_EXT.format(p='path')} AS ext FROM info),
imp1 AS (SELECT repo_id, path, imp, ord, CASE WHEN ext IN ('.py', '.js', '.ts') THEN 'python' WHEN ext IN ('.java', '.kt') THEN 'java' WHEN ext = '.go' THEN 'go' WHEN ext IN ('.c', '.cpp', '.h', '.hpp') THEN 'c' ELSE 'other' END AS kind FROM imp0 WHERE imp IS NOT NULL),
imp AS (SELECT *, CASE WHEN kind = 'python' AND contains(imp, '.') THEN regexp_extract(imp, '(?s)^(.*)\\.([^.]*)$', 1) END AS module, CASE WHEN kind = 'python' AND contains(imp, '.') THEN regexp_extract(imp, '(?s)^(.*)\\.([^.]*)$', 2) END AS symbol FROM imp1),
keys AS (SELECT DISTINCT repo_id, replace(module, '.', '/') || '.py' AS key FROM imp WHERE module IS NOT NULL),
hit AS (SELECT repo_id, key, arg_min(path, n) AS src FROM (SELECT k.repo_id, k.key, i.path, row_number() OVER (PARTITION BY k.repo_id, k.key ORDER BY length(i.path), i.path) AS n FROM keys k JOIN info i ON i.repo_id = k.repo_id AND suffix(i.path, k.key)) WHERE n = 1 GROUP BY ALL),
res AS (SELECT p.*, p.kind = 'python' AND p.module IS NULL AS undotted, CASE WHEN p.kind = 'python' AND p.module IS NULL THEN s.file ELSE h.src END AS src
        FROM imp p LEFT JOIN hit h ON h.repo_id = p.repo_id AND h.key = replace(p.module, '.', '/') || '.py' LEFT JOIN sym s ON s.repo_id = p.repo_id AND s.name = p.imp),
ev AS (SELECT repo_id, path, ord, CASE WHEN undotted THEN imp ELSE symbol END AS name, src FROM res WHERE kind = 'python' AND src IS NOT NULL AND (NOT undotted OR src <> path)),
mid AS (SELECT repo_id, name, src, path, ord FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, name ORDER BY path, ord) AS n FROM ev) WHERE n = 1),
loose AS (SELECT repo_id, path, ord, id, CASE WHEN kind IN ('go', 'c') THEN length(id) - length(replace(id, '/', '')) + 1 WHEN undotted THEN 1 ELSE length(id) - length(replace(id, '.', '')) + 1 END AS level,
            CASE WHEN kind = 'c' THEN 'header' ELSE 'package' END AS type, CASE WHEN kind = 'python' AND NOT undotted THEN symbol END AS label
          FROM (SELECT *, CASE WHEN kind = 'python' AND NOT undotted THEN module WHEN kind = 'java' THEN regexp_replace(imp, '\\.[^.]*$', '') ELSE imp END AS id FROM res WHERE kind <> 'python' OR src IS NULL)),
dirs AS (SELECT DISTINCT repo_id, array_to_string(parts[1:i], '/') AS id FROM (SELECT repo_id, string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')))) AS i FROM info)),
nodes AS (SELECT repo_id, id, type, label, shape, CAST(level AS INT) AS level FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id, id ORDER BY phase DESC, path DESC, ord DESC) AS n FROM (
    SELECT repo_id, path AS id, 'file' AS type, regexp_extract(path, '([^/]*)$', 1) || chr(10) || 'Functions: ' || array_to_string(coalesce(functions, []), ', ') || chr(10) || 'Classes: ' || array_to_string(coalesce(classes, []), ', ') AS label, 'ellipse' AS shape, length(path) - length(replace(path, '/', '')) + 1 AS level, 0 AS phase, path, -1 AS ord FROM info
    UNION ALL SELECT repo_id, src || '::' || name, 'import', name, 'box', length(src) - length(replace(src, '/', '')) + 2, 0, path, ord FROM mid
    UNION ALL SELECT repo_id, id, type, id, CASE WHEN type = 'header' THEN 'diamond' ELSE 'star' END, level, 0, path, ord FROM loose
    UNION ALL SELECT repo_id, id, 'directory', regexp_extract(id, '([^/]*)$', 1), 'box', length(id) - length(replace(id, '/', '')), 1, id, 0 FROM dirs)) WHERE n = 1),
writes AS (
    SELECT repo_id, src, src || '::' || name AS dst, 'exports' AS relation, CAST(NULL AS VARCHAR) AS label, 0 AS phase, path, ord FROM mid
    UNION ALL SELECT e.repo_id, m.src || '::' || e.name, e.path, 'imports', NULL, 0, e.path, e.ord FROM ev e JOIN mid m ON m.repo_id = e.repo_id AND m.name = e.name
    UNION ALL SELECT repo_id, id, path, CASE WHEN type = 'header' THEN 'includes' ELSE 'imports' END, label, 0, path, ord FROM loose
    UNION ALL SELECT repo_id, p, c, 'contains', NULL, 1, p, 0 FROM (SELECT repo_id, regexp_replace(path, '/?[^/]*$', '') AS p, path AS c FROM info UNION ALL SELECT repo_id, regexp_replace(id, '/?[^/]*$', ''), id FROM dirs) WHERE p <> ''),
edges AS (SELECT w.repo_id, w.src, w.dst, w.relation, l.label FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, src, dst ORDER BY phase DESC, path DESC, ord DESC) AS n FROM writes) w
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY repo_id, src, dst ORDER BY phase DESC, path DESC, ord DESC) AS n FROM writes WHERE label IS NOT NULL) l ON l.n = 1 AND l.repo_id = w.repo_id AND l.src = w.src AND l.dst = w.dst WHERE w.n = 1)"""


def _with(body: str, recursive: bool = False, more: str = "") -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{_INFO}{more} {body}"


def _info(spark, d):
    return extract.stored_info(_t(spark, d, "ast_data"))


_GRAPHS: dict[tuple[str, str], tuple[DataFrame, DataFrame, DataFrame]] = {}


def _built(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resolved imports, nodes, edges) of the tables of a folder, built once in a session and kept in its checkpoint folder, which all queries on graphs read."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _GRAPHS:
        kept: list[DataFrame] = []

        def keep(df: DataFrame) -> DataFrame:
            kept.append(checkpointed(df))
            return kept[-1]

        nodes, edges = graph.graph(keep(_info(spark, d)), keep=keep)
        _GRAPHS[key] = kept[1], keep(nodes), keep(edges)
    return _GRAPHS[key]


def _graph(spark, d):
    return _built(spark, d)[1:]


@query(_with("SELECT * FROM sym"))
def symbol_last_wins(spark, d):
    """D1."""
    return graph.symbols(_info(spark, d))


@query(_with("SELECT repo_id, id, CAST(length(id) - length(replace(id, '/', '')) AS INT) AS level FROM dirs"))
def ancestors_distinct(spark, d):
    """D3 D4."""
    return graph.directories(_info(spark, d)).withColumn("level", paths.depth(F.col("id")))


@query(_with("SELECT repo_id, src, dst FROM edges WHERE relation = 'contains'"))
def contains_edges(spark, d):
    """D5 D6."""
    return _graph(spark, d)[1].filter("relation = 'contains'").select("repo_id", "src", "dst")


@query(_with("SELECT repo_id, path, CAST(ord AS INT) AS ord, imp, kind, module, symbol FROM imp"))
def import_split(spark, d):
    """D7 D8 D14."""
    return graph.imports(_info(spark, d)).select("repo_id", "path", "ord", "imp", "kind", "module", "symbol")


@query(_with("SELECT * FROM hit"))
def suffix_resolve(spark, d):
    """D9."""
    imp = graph.imports(_info(spark, d)).filter("module IS NOT NULL")
    return graph.suffix_matches(_info(spark, d), imp.select("repo_id", F.concat(F.replace("module", F.lit("."), F.lit("/")), F.lit(".py")).alias("key")).distinct())


@query(_with("SELECT repo_id, name, src, path, CAST(ord AS INT) AS ord FROM mid"))
def midpoint_first_wins(spark, d):
    """D10 D12."""
    return graph.midpoints(graph.export_events(_built(spark, d)[0])).drop("file_ord")


@query(_with("SELECT repo_id, path, CAST(ord AS INT) AS ord, id, CAST(level AS INT) AS level, type, label FROM loose"))
def unresolved_anti(spark, d):
    """D11 D13 D14-D17."""
    u = graph.unresolved(_built(spark, d)[0]).drop("file_ord")
    return u.withColumn("level", F.col("level").cast("int"))


@query(_with("SELECT repo_id, src, dst, label FROM edges WHERE label IS NOT NULL"))
def edge_attr_merge(spark, d):
    """The last label of an edge that has one."""
    return _graph(spark, d)[1].filter("label IS NOT NULL").select("repo_id", "src", "dst", "label")


@query(_with("SELECT repo_id, id AS src, path AS dst, count(*) AS count, 'multiple' AS relation FROM loose GROUP BY ALL HAVING count(*) > 1"))
def edge_cluster_count(spark, d):
    """Edges that are written more than once."""
    return graph.clustered_edges(graph.unresolved(_built(spark, d)[0]).select("repo_id", F.col("id").alias("src"), F.col("path").alias("dst")))


@query("SELECT c_custkey, round((c_acctbal - lo) / nullif(hi - lo, 0) * 1000, 6) AS scaled FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)")
def minmax_scale(spark, d):
    """D21."""
    return graph.scaled(_t(spark, d, "customer"), "c_acctbal", []).select("c_custkey", F.round("scaled", 6).alias("scaled"))


@query(_with("SELECT * FROM nodes"))
def graph_nodes(spark, d):
    """D2 D4 D18 D22."""
    return _graph(spark, d)[0]


@query(_with("SELECT * FROM edges"))
def graph_edges(spark, d):
    """D5-D18 D22."""
    return _graph(spark, d)[1]


@query()
def graph_layout(spark, d):
    """A seeded layout; sequential by nature."""
    n, e = _graph(spark, d)
    return graph.layout(n, e)


@query(_with("SELECT repo_id, type, count(*) AS n FROM nodes GROUP BY ALL"))
def node_link_json(spark, d):
    """Graphs written as node-link documents and read back."""
    docs = store.to_node_link(*_graph(spark, d))
    return store.from_node_link(docs)[0].groupBy("repo_id", "type").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- graph queries
@query(_with(f"SELECT e.* FROM edges e SEMI JOIN (SELECT * FROM nodes WHERE level <= {LEVEL} AND type IN ('directory', 'file', 'import', 'package')) a ON a.repo_id = e.repo_id AND a.id = e.src SEMI JOIN (SELECT * FROM nodes WHERE level <= {LEVEL} AND type IN ('directory', 'file', 'import', 'package')) b ON b.repo_id = e.repo_id AND b.id = e.dst"))
def level_subgraph(spark, d):
    """E1 E11 E12."""
    return graphops.level_subgraph(*_graph(spark, d), LEVEL, graphops.SHOWN)[1]


_DEGREE = """, deg AS (SELECT n.repo_id, n.id, CAST(coalesce(o.k, 0) AS BIGINT) AS successors, CAST(coalesce(i.k, 0) AS BIGINT) AS predecessors, CAST(coalesce(i.imp, 0) AS BIGINT) AS importers, CAST(coalesce(o.con, 0) + coalesce(i.con, 0) AS BIGINT) AS folders
   FROM nodes n LEFT JOIN (SELECT repo_id, src AS id, count(*) AS k, count(*) FILTER (relation = 'contains') AS con FROM edges GROUP BY ALL) o ON o.repo_id = n.repo_id AND o.id = n.id
   LEFT JOIN (SELECT repo_id, dst AS id, count(*) AS k, count(*) FILTER (relation = 'imports') AS imp, count(*) FILTER (relation = 'contains') AS con FROM edges GROUP BY ALL) i ON i.repo_id = n.repo_id AND i.id = n.id)"""


@query(_with("SELECT * FROM deg", more=_DEGREE))
def neighbour_counts(spark, d):
    """What stands around a node."""
    n, e = _graph(spark, d)
    return graphops.degrees(n, e)


@query(_with("SELECT DISTINCT repo_id, other AS id FROM (SELECT repo_id, id AS other FROM nodes WHERE type = 'header' UNION ALL SELECT e.repo_id, e.dst FROM edges e SEMI JOIN nodes h ON h.repo_id = e.repo_id AND h.id = e.src AND h.type = 'header' UNION ALL SELECT e.repo_id, e.src FROM edges e SEMI JOIN nodes h ON h.repo_id = e.repo_id AND h.id = e.dst AND h.type = 'header')"))
def ego_network(spark, d):
    """Headers and their neighbours."""
    n, e = _graph(spark, d)
    return graphops.ego(e, n.filter("type = 'header'"))


@query(_with("SELECT repo_id, type, id, CAST(score AS DOUBLE) AS score FROM (SELECT n.repo_id, n.type, n.id, g.predecessors AS score, row_number() OVER (PARTITION BY n.repo_id, n.type ORDER BY g.predecessors DESC, n.id) AS k FROM nodes n JOIN deg g ON g.repo_id = n.repo_id AND g.id = n.id) WHERE k = 1", more=_DEGREE))
def argmax_type(spark, d):
    """The node of each type that most edges lead to."""
    n, e = _graph(spark, d)
    score = graphops.degrees(n, e).select("repo_id", "id", F.col("predecessors").cast("double").alias("score"))
    return graphops.top_by_type(n, score)


@query(
    _with(
        "SELECT repo_id, id FROM reach ANTI JOIN (SELECT repo_id AS r, min(id) AS i FROM dirs WHERE NOT contains(id, '/') GROUP BY ALL) s ON s.r = reach.repo_id AND s.i = reach.id",
        True,
        ", reach AS (SELECT repo_id, min(id) AS id FROM dirs WHERE NOT contains(id, '/') GROUP BY repo_id UNION SELECT e.repo_id, e.dst FROM reach r JOIN edges e ON e.repo_id = r.repo_id AND e.src = r.id)",
    )
)
def reachable(spark, d):
    """E5: all that is reached from each repository's first folder."""
    n, e = _graph(spark, d)
    seeds = n.filter("type = 'directory' AND level = 0").groupBy("repo_id").agg(F.min("id").alias("id"))
    return graphops.descendants(e, seeds)


def _pagerank_sql(rounds: int) -> str:
    parts = [", base AS MATERIALIZED (SELECT n.repo_id, n.id, c.n, o.outs FROM nodes n JOIN (SELECT repo_id, CAST(count(*) AS DOUBLE) AS n FROM nodes GROUP BY ALL) c ON c.repo_id = n.repo_id LEFT JOIN (SELECT repo_id, src AS id, count(*) AS outs FROM edges GROUP BY ALL) o ON o.repo_id = n.repo_id AND o.id = n.id)", "ed AS MATERIALIZED (SELECT repo_id, src, dst FROM edges)", "r0 AS MATERIALIZED (SELECT repo_id, id, n, outs, 1.0::DOUBLE / n AS score FROM base)"]
    for i in range(rounds):
        parts.append(
            f"r{i + 1} AS MATERIALIZED (SELECT b.repo_id, b.id, b.n, b.outs, 0.85 * (coalesce(f.got, 0) + coalesce(z.idle, 0) / b.n) + 0.15 / b.n AS score FROM base b LEFT JOIN (SELECT e.repo_id, e.dst AS id, sum(r.score / r.outs) AS got FROM r{i} r JOIN ed e ON e.repo_id = r.repo_id AND e.src = r.id WHERE r.outs IS NOT NULL GROUP BY ALL) f ON f.repo_id = b.repo_id AND f.id = b.id LEFT JOIN (SELECT repo_id, sum(score) AS idle FROM r{i} WHERE outs IS NULL GROUP BY ALL) z ON z.repo_id = b.repo_id)"
        )
    return ", ".join(parts)


def _central(rank: DataFrame) -> DataFrame:
    r = rank.withColumn("score", F.round("score", 8))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, retrieve.CENTRAL)
    # ranks of one repository are cut to the best of each salted part before they meet
    part = r.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).groupBy("repo_id", "salt").agg(best.alias("b"))
    top = part.select("repo_id", F.explode("b").alias("x")).select("repo_id", "x.*").groupBy("repo_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("s", "id"))), 1, retrieve.CENTRAL).alias("b"))
    return top.select("repo_id", F.explode("b").alias("x")).select("repo_id", F.col("x.id").alias("id"), (-F.col("x.s")).alias("score"))


@query(_with(f"SELECT repo_id, id, round(score, 8) AS score FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY round(score, 8) DESC, id) AS k FROM r{PAGERANK_ROUNDS}) WHERE k <= 20", more=_pagerank_sql(PAGERANK_ROUNDS)))
def pagerank_top20(spark, d):
    """The central nodes of each repository; a fixed number of rounds."""
    n, e = _graph(spark, d)
    return _central(graphops.pagerank(n, e, iterations=PAGERANK_ROUNDS, tol=None))


@query()
def pagerank_surveyed(spark, d):
    """The central nodes of each repository after the rounds of the survey."""
    return _central(graphops.pagerank(*_graph(spark, d), iterations=SURVEYED_ROUNDS, tol=None))


@query(
    _with(
        "SELECT n.repo_id, n.id, n.type FROM nodes n SEMI JOIN clo c ON c.repo_id = n.repo_id AND c.id = n.id",
        True,
        f""", hits AS (SELECT repo_id, id FROM nodes WHERE contains(lower(label), '{TERM}')),
        moves AS (SELECT repo_id, path AS id, array_to_string(string_split(path, '/')[1:i], '/') AS next FROM (SELECT i.repo_id, i.path, unnest(range(1, len(string_split(i.path, '/')))) AS i FROM info i SEMI JOIN nodes n ON n.repo_id = i.repo_id AND n.id = i.path AND n.type = 'file')
          UNION ALL SELECT repo_id, dst, src FROM edges WHERE relation = 'imports' UNION ALL SELECT repo_id, src, dst FROM edges WHERE relation = 'exports'),
        clo AS (SELECT repo_id, id FROM (SELECT repo_id, id FROM hits UNION SELECT e.repo_id, e.dst FROM edges e SEMI JOIN hits h ON h.repo_id = e.repo_id AND h.id = e.src) UNION SELECT m.repo_id, m.next FROM clo c JOIN moves m ON m.repo_id = c.repo_id AND m.id = c.id)""",
    )
)
def search_closure(spark, d):
    """E13-E16."""
    n, e = _graph(spark, d)
    return graphops.search_closure(n, e, TERM)[0].select("repo_id", "id", "type")


@query(_with("SELECT repo_id, id, shape, CAST(CASE WHEN type IN ('import', 'package') THEN 15 ELSE greatest(30, least(length(label) * 5, 150)) END AS INT) AS size, CASE type WHEN 'directory' THEN 'amber' WHEN 'file' THEN 'blue' WHEN 'import' THEN 'green' WHEN 'package' THEN 'violet' ELSE 'grey' END AS colour FROM nodes"))
def node_style(spark, d):
    """E20."""
    return graphops.node_style(_graph(spark, d)[0])


# ---------------------------------------------------------------- text and vectors
@query(
    f"""SELECT doc_id, CAST(i AS INT) AS chunk_idx, md5(substring(text, i * {retrieve.CHUNK - retrieve.OVERLAP} + 1, {retrieve.CHUNK})) AS chunk_md5 FROM (
        SELECT doc_id, text, unnest(range(greatest(CAST(ceil((length(text) - {retrieve.OVERLAP}) / {retrieve.CHUNK - retrieve.OVERLAP}.0) AS BIGINT), 1))) AS i FROM documents WHERE text IS NOT NULL)"""
)
def fixed_chunks(spark, d):
    """F2 F3 as windows."""
    docs = _t(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.explode(retrieve.fixed_chunks(F.col("text"))).alias("c")).select("doc_id", F.col("c.chunk_idx").alias("chunk_idx"), F.md5("c.chunk").alias("chunk_md5"))


@query(_with("SELECT repo_id, src, dst, CASE relation WHEN 'contains' THEN 'amber' WHEN 'imports' THEN 'blue' WHEN 'exports' THEN 'green' WHEN 'includes' THEN 'violet' ELSE 'grey' END AS colour FROM edges"))
def edge_style(spark, d):
    """Colours of edges."""
    return graphops.edge_style(_graph(spark, d)[1])


@query(_with("SELECT repo_id, id, CASE type WHEN 'file' THEN 0 WHEN 'directory' THEN 2 ELSE 1 END AS phase FROM nodes"))
def node_order(spark, d):
    """The order in which a builder writes nodes."""
    return graphops.in_order(_graph(spark, d)[0]).select("repo_id", "id", "position.phase")


_NEAR = """, near AS (SELECT repo_id, dst AS id, src AS other, CASE WHEN relation = 'imports' THEN 'importers' WHEN relation = 'contains' THEN 'folders' END AS kind FROM edges UNION ALL SELECT repo_id, src, dst, CASE WHEN relation = 'contains' THEN 'folders' END FROM edges),
   listed AS (SELECT x.*, string_split(n.label, chr(10))[1] AS label, row_number() OVER (PARTITION BY x.repo_id, x.id, x.kind ORDER BY x.other) AS k FROM near x JOIN nodes n ON n.repo_id = x.repo_id AND n.id = x.other WHERE kind IS NOT NULL)"""


@query(_with("SELECT n.repo_id, n.id, coalesce(string_agg(l.label, ', ' ORDER BY l.other) FILTER (l.kind = 'importers' AND k <= 50), '') AS importers, coalesce(string_agg(l.label, ', ' ORDER BY l.other) FILTER (l.kind = 'folders' AND k <= 50), '') AS folders FROM nodes n LEFT JOIN listed l ON l.repo_id = n.repo_id AND l.id = n.id GROUP BY ALL", more=_NEAR))
def neighbour_labels(spark, d):
    """The labels that a hover shows."""
    return graphops.neighbour_labels(*_graph(spark, d))


@query()
def recursive_chunks(spark, d):
    """F2 F3 with separators."""
    return retrieve.recursive_chunks(_t(spark, d, "documents"), "doc_id", "text")


_DOC = "'File: ' || path || chr(10) {body} || CASE WHEN functions IS NOT NULL THEN 'Functions: ' || array_to_string(functions, ', ') || chr(10) ELSE '' END || CASE WHEN classes IS NOT NULL THEN 'Classes: ' || array_to_string(classes, ', ') || chr(10) ELSE '' END || CASE WHEN imports IS NOT NULL THEN 'Imports: ' || array_to_string(imports, ', ') || chr(10) ELSE '' END"


@query(_with(f"SELECT repo_id, path, md5({_DOC.format(body='')}) AS text_md5 FROM info"))
def short_documents(spark, d):
    """F15."""
    c = F.col
    return _info(spark, d).select("repo_id", "path", F.md5(retrieve.short_document(c("path"), c("functions"), c("classes"), c("imports"))).alias("text_md5"))


@query(
    """SELECT query_id, vec_id, round(dist, 6) AS dist, CAST(rank AS INT) AS rank FROM (
        SELECT q.vec_id AS query_id, v.vec_id, d.dist, row_number() OVER (PARTITION BY q.vec_id ORDER BY d.dist, v.vec_id) AS rank
        FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0) q, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) v, LATERAL (SELECT sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist) d) WHERE rank <= 200"""
)
def knn_l2(spark, d):
    """Every vector whose id is divisible by 20, against all."""
    v = _t(spark, d, "embeddings")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieve.knn(v, q).withColumn("dist", F.round("dist", 6))


@query(
    """SELECT q.vec_id AS query_id, v.vec_id, round(CASE WHEN nq * nv = 0 THEN 0 ELSE list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) / (nq * nv) END, 6) AS cosine
       FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS nq FROM embeddings WHERE vec_id % 20 = 0) q,
            (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS nv FROM embeddings) v
       WHERE CASE WHEN nq * nv = 0 THEN 0 ELSE list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) / (nq * nv) END >= 0.5"""
)
def cosine_matches(spark, d):
    """every vector whose id is divisible by 20, against all, kept from 0.5."""
    v = _t(spark, d, "embeddings")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieve.cosine_above(v, q, 0.5).withColumn("cosine", F.round("cosine", 6))


@query("SELECT a.vec_id, b.vec_id AS next_id, round(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])), 5) AS dot FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1")
def vector_expressions(spark, d):
    """F7 as column expressions, on neighbouring ids."""
    v = _t(spark, d, "embeddings").select("vec_id", "embedding")
    w = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("embedding").alias("other"))
    return v.join(w, "vec_id").select("vec_id", "next_id", F.round(vectors.dot(F.col("embedding"), F.col("other")), 5).alias("dot"))


@query(_with(f"SELECT repo_id, id, round(0.7 * (length(id) % 10) / 10.0 + 0.3 * score, 8) AS score FROM r{PAGERANK_ROUNDS}", more=_pagerank_sql(PAGERANK_ROUNDS)))
def hybrid_relevance(spark, d):
    """F8: similarity (here a number made of the id) and centrality weighed."""
    n, e = _graph(spark, d)
    r = graphops.pagerank(n, e, iterations=PAGERANK_ROUNDS, tol=None)
    sim = (F.length("id") % 10) / F.lit(10.0)
    return r.select("repo_id", "id", F.round(retrieve.relevance(sim, F.col("score")), 8).alias("score"))


@query()
def hybrid_relevance_cosine(spark, d):
    """F8: cosine of every embedded id with a question, and centrality after the rounds of the survey, weighed."""
    n, e = _graph(spark, d)
    q = F.array(*[F.lit(float(x)) for x in retrieve._EMBEDDER[0](QUESTION)])
    sim = retrieve.embedded(n.select("repo_id", "id"), "id", "a").select("repo_id", "id", vectors.cosine(F.col("a"), q).alias("sim"))
    r = sim.join(graphops.pagerank(n, e, iterations=SURVEYED_ROUNDS, tol=None), ["repo_id", "id"], "left")
    return r.select("repo_id", "id", F.round(retrieve.relevance(F.col("sim"), F.col("score")), 8).alias("score"))


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS INT) AS tokens FROM documents WHERE text IS NOT NULL")
def token_count(spark, d):
    """F10."""
    return _t(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", tx.token_count(F.col("text")).alias("tokens"))


@query(
    r"""SELECT repo_id, doc_id, CAST(tokens AS INT) AS tokens, CAST(running AS BIGINT) AS running FROM (SELECT repo_id, doc_id, tokens, sum(tokens) OVER (PARTITION BY repo_id ORDER BY doc_id) AS running FROM (
        SELECT repo_id, doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS tokens FROM documents WHERE text IS NOT NULL AND repo_id IS NOT NULL)) WHERE running <= 4000"""
)
def budget_pack(spark, d):
    """each repository's documents in order, up to the budget of a question about a file."""
    docs = _t(spark, d, "documents").filter("text IS NOT NULL AND repo_id IS NOT NULL").select("repo_id", "doc_id", "text")
    return retrieve.packed(docs, "repo_id", "doc_id", "text", F.lit(tx.BUDGETS["file"])).select("repo_id", "doc_id", "tokens", "running")


_LAST_FILE = "SELECT repo_id, path, regexp_replace(arg_max(content, file_id), '\\r\\n?', chr(10), 'g') AS content FROM repo_files WHERE content IS NOT NULL GROUP BY ALL"


def _context(spark, d):
    files = _t(spark, d, "repo_files").filter("content IS NOT NULL").select("repo_id", "path", "content", "file_id")
    return repository.prepared(repository.latest(files, "file_id")).select("repo_id", "path", "content").join(_info(spark, d), ["repo_id", "path"])


@query(_with(f"SELECT i.repo_id, i.path, md5({_DOC.format(body='|| chr(10) || content || chr(10) || chr(10)')}) AS entry_md5 FROM info i JOIN ({_LAST_FILE}) f ON f.repo_id = i.repo_id AND f.path = i.path".replace("|| path ||", "|| i.path ||")))
def context_entries(spark, d):
    """F1 F11 F12."""
    c = F.col
    return _context(spark, d).select("repo_id", "path", F.md5(retrieve.context_entry(c("path"), c("content"), c("functions"), c("classes"), c("imports"))).alias("entry_md5"))


@query(
    _with(
        f"""SELECT i.repo_id, i.path, '- ' || i.path || chr(10) || CASE WHEN functions IS NOT NULL THEN '  Functions: ' || array_to_string(functions, ', ') || chr(10) ELSE '' END || CASE WHEN classes IS NOT NULL THEN '  Classes: ' || array_to_string(classes, ', ') || chr(10) ELSE '' END
            || '  Content Preview: ' || substring(content, 1, 100) || '...' || chr(10) AS entry FROM info i JOIN ({_LAST_FILE}) f ON f.repo_id = i.repo_id AND f.path = i.path"""
    )
)
def overview_listing(spark, d):
    """F14."""
    c = F.col
    kind = F.lit(None).cast("string")
    return _context(spark, d).select("repo_id", "path", retrieve.overview_entry(c("path"), kind, c("functions"), c("classes"), c("content")).alias("entry"))


@query(
    _with(
        f"SELECT DISTINCT repo_id, id FROM (SELECT repo_id, id FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY round(score, 8) DESC, id) AS k FROM r{PAGERANK_ROUNDS}) WHERE k <= 20 UNION ALL SELECT repo_id, id FROM nodes WHERE contains(lower(label), '{TERM}'))",
        more=_pagerank_sql(PAGERANK_ROUNDS),
    )
)
def general_union(spark, d):
    """Hits of a search and central nodes, each once."""
    n, _ = _graph(spark, d)
    hits = n.filter(F.contains(F.lower("label"), F.lit(TERM))).select("repo_id", "id")
    return hits.unionByName(pagerank_top20(spark, d).select("repo_id", "id")).distinct()


@query()
def general_union_surveyed(spark, d):
    """The same with central nodes after the rounds of the survey."""
    n, _ = _graph(spark, d)
    hits = n.filter(F.contains(F.lower("label"), F.lit(TERM))).select("repo_id", "id")
    return hits.unionByName(pagerank_surveyed(spark, d).select("repo_id", "id")).distinct()


# ---------------------------------------------------------------- questions and conversations
def _class_sql(c: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({c}), '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in tx.CLASSES.items()) + " ELSE 'general' END"


@query(f"SELECT session_id, turn, text, c AS query_class, CAST(CASE c WHEN 'codebase' THEN 8000 WHEN 'directory' THEN 6000 WHEN 'file' THEN 4000 WHEN 'function' THEN 2000 ELSE 6000 END AS INT) AS budget FROM (SELECT *, {_class_sql('text')} AS c FROM chat_messages WHERE text IS NOT NULL AND role = 'human')")
def classify_query(spark, d):
    """G1 G2."""
    c = tx.query_class(F.col("text"))
    return _t(spark, d, "chat_messages").filter("text IS NOT NULL AND role = 'human'").select("session_id", "turn", "text", c.alias("query_class"), tx.budget_of(c).alias("budget"))


@query(
    f"""SELECT repo_id, md5(a || ':' || b || ':' || n) AS session_id FROM (SELECT repo_id, CAST(sum(CAST('0x' || substring(h, 1, 15) AS HUGEINT)) AS VARCHAR) AS a, CAST(sum(CAST('0x' || substring(h, 17, 15) AS HUGEINT)) AS VARCHAR) AS b, CAST(count(*) AS VARCHAR) AS n
        FROM (SELECT repo_id, md5(path || chr(31) || md5(content)) AS h FROM ({_LAST_FILE})) GROUP BY repo_id)"""
)
def session_hash(spark, d):
    """G7."""
    files = _t(spark, d, "repo_files").filter("content IS NOT NULL").select("repo_id", "path", "content", "file_id")
    return chat.session_of(repository.prepared(repository.latest(files, "file_id")))


@query("SELECT session_id, arg_min(repo_id, (turn, role, text)) AS repo_id FROM (SELECT DISTINCT * FROM chat_messages WHERE repo_id IS NOT NULL AND text IS NOT NULL) GROUP BY session_id")
def sessions(spark, d):
    """Each session once, with the repository of its first message."""
    m = _t(spark, d, "chat_messages").filter("repo_id IS NOT NULL AND text IS NOT NULL")
    first = m.groupBy("session_id").agg(F.min_by("repo_id", F.struct("turn", "role", "text")).alias("repo_id"))
    return chat.new_sessions(first, first.limit(0))


@query(
    """SELECT session_id, turn, role, text, count(*) OVER w AS history_turns, CAST(coalesce(sum(length(text)) OVER w, 0) AS BIGINT) AS history_chars, lag(text) OVER (PARTITION BY session_id ORDER BY turn, role, text) AS previous
       FROM (SELECT DISTINCT session_id, turn, role, text FROM chat_messages WHERE trim(text, ' ') <> '') WINDOW w AS (PARTITION BY session_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def history_buffer(spark, d):
    """G9 G15."""
    return chat.history(_t(spark, d, "chat_messages"))


@query(
    """SELECT session_id, turn, role, text, md5(coalesce(string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY session_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS buffer_md5
       FROM (SELECT DISTINCT session_id, turn, role, text FROM chat_messages WHERE trim(text, ' ') <> '')"""
)
def conversation_buffer(spark, d):
    """The whole conversation before each message."""
    return chat.buffer(_t(spark, d, "chat_messages")).select("session_id", "turn", "role", "text", F.md5("buffer").alias("buffer_md5"))


@query(
    _with(
        f"""SELECT m.session_id, m.turn, m.text, md5('Repository:' || chr(10) || coalesce(o.entry, '') || chr(10) || chr(10) || 'Relevant files:' || chr(10) || chr(10) || chr(10) || 'Question: ' || m.text || chr(10) || chr(10) || '{chat.STEPS}') AS prompt_md5
            FROM (SELECT DISTINCT session_id, turn, text, repo_id FROM chat_messages WHERE role = 'human' AND text IS NOT NULL) m LEFT JOIN (SELECT repo_id, min('- ' || path || chr(10)) AS entry FROM info GROUP BY ALL) o ON o.repo_id = m.repo_id"""
    )
)
def prompt_assembly(spark, d):
    """Prompts of all questions; the overview is cut to the first file here, as a table of whole prompts would repeat it for each question."""
    m = _t(spark, d, "chat_messages").filter("role = 'human' AND text IS NOT NULL").select("session_id", "turn", "text", "repo_id").distinct()
    o = _info(spark, d).groupBy("repo_id").agg(F.min(F.concat(F.lit("- "), "path", F.lit("\n"))).alias("entry"))
    p = chat.prompt(F.col("entry"), F.lit(""), F.col("text"))
    return m.join(o, "repo_id", "left").select("session_id", "turn", "text", F.md5(p).alias("prompt_md5"))


@query()
def prompt_routed(spark, d):
    """Prompts of all questions.  For each repository and class of question the relevant nodes are routed, scored, packed under the
    class's budget and joined to one context, once; the overview, of any length, stands in the prompt by a digest of all its entries."""
    n, e = _graph(spark, d)
    q = F.array(*[F.lit(float(x)) for x in retrieve._EMBEDDER[0](QUESTION)])
    sim = retrieve.embedded(n.select("repo_id", "id"), "id", "a").select("repo_id", "id", vectors.cosine(F.col("a"), q).alias("sim"))
    rank = graphops.pagerank(n, e, iterations=PAGERANK_ROUNDS, tol=None)
    score = checkpointed(sim.join(rank, ["repo_id", "id"], "left").select("repo_id", "id", retrieve.relevance(F.col("sim"), F.col("score")).alias("score")))
    best = lambda t: graphops.top_by_type(n.filter(F.col("type") == t), score, ("repo_id",)).select("repo_id", "id")
    routes = {
        "codebase": n.select("repo_id", "id"), "directory": graphops.descendants(e, best("directory")), "file": graphops.ego(e, best("file"), "out"),
        "function": graphops.ego(e, best("import")), "general": _central(score).select("repo_id", "id"),
    }
    relevant = None
    for cls, nodes in routes.items():
        part = nodes.withColumn("query_class", F.lit(cls))
        relevant = part if relevant is None else relevant.unionByName(part)
    c = F.col
    files = _context(spark, d)
    entry = retrieve.context_entry(c("path"), c("content"), c("functions"), c("classes"), c("imports")).alias("entry")
    rows = files.select("repo_id", c("path").alias("id"), entry).join(relevant, ["repo_id", "id"]).join(score, ["repo_id", "id"])
    rows = rows.select(F.struct("repo_id", "query_class").alias("g"), F.struct((-F.round("score", 8)).alias("s"), "id").alias("pos"), "entry")
    kept = retrieve.packed(rows, "g", "pos", "entry", tx.budget_of(c("g.query_class")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry"))), lambda x: x["entry"]), "\n\n")  # bounded by the budget
    context = kept.groupBy("g").agg(text.alias("context"), F.count("*").alias("files"), F.sum("tokens").alias("tokens")).select("g.*", "context", "files", "tokens")
    listed = files.select("repo_id", F.xxhash64(retrieve.overview_entry(c("path"), F.lit(None).cast("string"), c("functions"), c("classes"), c("content"))).alias("h"))
    overview = listed.groupBy("repo_id").agg(F.md5(F.concat_ws(":", F.bit_xor("h").cast("string"), F.count("*").cast("string"))).alias("overview"))
    m = _t(spark, d, "chat_messages").filter("role = 'human' AND text IS NOT NULL").select("session_id", "turn", "text", "repo_id").distinct().withColumn("query_class", tx.query_class(c("text")))
    j = m.join(context, ["repo_id", "query_class"], "left").join(overview, "repo_id", "left")
    return j.select("session_id", "turn", "text", "query_class", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.md5(chat.prompt(c("overview"), c("context"), c("text"))).alias("prompt_md5"))


@query(
    r"""SELECT session_id, turn, role, CAST(line_no AS INT) AS line_no, CASE WHEN fence = 1 THEN 'fence' WHEN n % 2 = 1 THEN 'code' WHEN regexp_matches(line, '^\d+\.\s') THEN 'item' ELSE 'paragraph' END AS kind, line
        FROM (SELECT *, sum(fence) OVER (PARTITION BY rid ORDER BY line_no) AS n FROM (SELECT *, CASE WHEN starts_with(ltrim(line, ' '), '```') THEN 1 ELSE 0 END AS fence FROM (
          SELECT rid, session_id, turn, role, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT row_number() OVER () AS rid, session_id, turn, role, string_split(text, chr(10)) AS l FROM chat_messages WHERE text IS NOT NULL))))
        WHERE trim(line, ' ') <> ''"""
)
def line_classify(spark, d):
    """G14."""
    return chat.message_lines(_t(spark, d, "chat_messages"))


@query(
    """SELECT session_id, min(sent_at) AS start, max(sent_at) + INTERVAL 30 MINUTE AS "end", count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS chars
       FROM (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY sent_at, turn, role, text ROWS UNBOUNDED PRECEDING) AS part
             FROM (SELECT *, CASE WHEN sent_at - lag(sent_at) OVER (PARTITION BY session_id ORDER BY sent_at, turn, role, text) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh
                   FROM (SELECT DISTINCT session_id, turn, role, text, sent_at FROM chat_messages WHERE sent_at IS NOT NULL AND text IS NOT NULL)))
       GROUP BY session_id, part"""
)
def session_activity(spark, d):
    """Stretches of conversations between long pauses (the batch form of the streaming operator)."""
    return ingest.session_activity(_t(spark, d, "chat_messages"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
