"""Registered queries of the library's own operators, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import graph, health, lexical, retrieval, traverse, workspace
from ..sources import files as file_tables
from ..streaming import jobs
from .fixtures import frame, sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, *views: str, body: str) -> Callable[[Callable], Callable]:
    """Register a function of the views' DataFrames as a query, with the SQL `body` over the same views."""

    def register(make: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: make(*(frame(spark, sf_dir, v) for v in views))
        SQL[name] = sql(*(v for v in views if v.startswith("fx_")), body=body) if any(v.startswith("fx_") for v in views) else body
        return make

    return register


_LANGUAGES = ", ".join(f"('{k}', '{v}')" for k, v in file_tables.EXTENSIONS.items())
_FROM_TO = """FROM fx_relations r JOIN fx_symbols a ON a.symbol_id = r.src AND a.repo_id = r.repo_id
  JOIN fx_symbols b ON b.symbol_id = r.dst AND b.repo_id = r.repo_id"""

query("s4_file_facts", "fx_files", body="""
SELECT file_id, CAST(strlen(content) AS BIGINT) AS size_bytes, sha256(content) AS content_hash, len(string_split(content, chr(10))) AS line_count FROM fx_files
""")(lambda f: file_tables.file_facts(f).select("file_id", "size_bytes", "content_hash", "line_count"))  # fmt: skip

query("s5_detect_language", "fx_files", body=f"""
WITH names(ending, language) AS (VALUES {_LANGUAGES})
SELECT file_id, n.language FROM fx_files LEFT JOIN names n ON n.ending = lower(regexp_extract(path, '\\.([^./]*)$', 1))
""")(lambda f: f.select("file_id", file_tables.language_of(F.col("path")).alias("language")))  # fmt: skip

query("s6_diff_snapshot", "fx_files", body="""
WITH a AS (SELECT repo_id, path, sha256(content) AS h FROM fx_files WHERE CAST(file_id AS BIGINT) % 3 <> 0),
 b AS (SELECT repo_id, path, sha256(CASE WHEN CAST(file_id AS BIGINT) % 5 = 0 THEN concat(content, 'x') ELSE content END) AS h FROM fx_files WHERE CAST(file_id AS BIGINT) % 4 <> 0)
SELECT repo_id, path, CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS status
FROM a FULL JOIN b USING (repo_id, path)
""")(lambda f: file_tables.diff_snapshot(
    f.where(F.col("file_id").cast("long") % 3 != 0).withColumn("content_hash", F.sha2("content", 256)),
    f.where(F.col("file_id").cast("long") % 4 != 0).withColumn(
        "content_hash", F.sha2(F.when(F.col("file_id").cast("long") % 5 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")), 256)
    ),
))

_ODD = """CASE CAST(file_id AS BIGINT) % 9 WHEN 0 THEN concat('node_modules/', path) WHEN 1 THEN concat('.git/', path) WHEN 2 THEN concat(path, '.min.js') WHEN 3 THEN 'a/package-lock.json'
 WHEN 4 THEN concat('a/.hidden/', path) WHEN 5 THEN concat('a/x', file_id, '.PNG') WHEN 6 THEN 'a/Dockerfile' ELSE path END"""
query("s2_skip_filter", "fx_src", body=f"""
WITH f AS (SELECT file_id, {_ODD} AS path, CASE WHEN CAST(file_id AS BIGINT) % 20 = 7 THEN 0 WHEN CAST(file_id AS BIGINT) % 20 = 8 THEN 2000000 ELSE size_bytes END AS n FROM fx_src)
SELECT file_id FROM f WHERE n BETWEEN 1 AND 1048576 AND CAST(file_id AS BIGINT) % 9 > 5
""")(lambda f: file_tables.skip_filter(f.withColumns({
    "path": F.expr(_ODD), "size_bytes": F.expr("CASE WHEN CAST(file_id AS BIGINT) % 20 = 7 THEN 0 WHEN CAST(file_id AS BIGINT) % 20 = 8 THEN 2000000 ELSE size_bytes END")})).select("file_id"))

query("s5_language_by_name", "fx_src", body=f"""
WITH names(ending, language) AS (VALUES {_LANGUAGES}), f AS (SELECT file_id, {_ODD} AS path FROM fx_src)
SELECT file_id, CASE WHEN path LIKE '%/Dockerfile' THEN 'dockerfile' ELSE n.language END AS language FROM f LEFT JOIN names n ON n.ending = lower(regexp_extract(path, '\\.([^./]*)$', 1))
""")(lambda f: f.select("file_id", file_tables.language_of(F.expr(_ODD)).alias("language")))  # fmt: skip

query("s15_directory_tree", "fx_files", body="""
WITH nodes AS (
  SELECT DISTINCT repo_id, '' AS directory, split_part(path, '/', 1) AS name, false AS is_file FROM fx_files
  UNION SELECT DISTINCT repo_id, split_part(path, '/', 1), split_part(path, '/', 2), false FROM fx_files
  UNION SELECT DISTINCT repo_id, concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)), split_part(path, '/', 3), true FROM fx_files)
SELECT repo_id, directory, count(*) FILTER (is_file) AS n_files, count(*) FILTER (NOT is_file) AS n_directories FROM nodes GROUP BY 1, 2
""")(file_tables.directory_tree)  # fmt: skip

query("s16_path_filter", "fx_files", body="SELECT repo_id, path FROM fx_files WHERE contains(lower(path), 'd3/')")(
    lambda f: file_tables.path_filter(f, "D3/").select("repo_id", "path")
)

query("g1_module_edges", "fx_symbols", "fx_relations", body=f"""
SELECT r.repo_id, split_part(a.path, '/', 1) AS from_module, split_part(b.path, '/', 1) AS to_module, relation_type, count(*) AS edge_count
{_FROM_TO} WHERE split_part(a.path, '/', 1) <> split_part(b.path, '/', 1) GROUP BY ALL
""")(graph.module_edges)  # fmt: skip

query("g2_file_edges", "fx_symbols", "fx_relations", body=f"""
SELECT repo_id, from_path, to_path, relation_type, edge_count FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY edge_count DESC, from_path, to_path, relation_type) AS place FROM (
    SELECT r.repo_id, a.path AS from_path, b.path AS to_path, relation_type, count(*) AS edge_count {_FROM_TO} WHERE a.path <> b.path GROUP BY ALL)) WHERE place <= 2000
""")(graph.file_edges)  # fmt: skip

query("g3_symbol_edges", "fx_symbols", "fx_relations", body=f"""
SELECT repo_id, src, dst, relation_type FROM (
  SELECT r.repo_id, src, dst, relation_type, row_number() OVER (PARTITION BY r.repo_id ORDER BY relation_type, src, dst) AS place {_FROM_TO}
  WHERE a.kind <> 'enum' AND b.kind <> 'enum') WHERE place <= 1000
""")(lambda s, r: graph.symbol_edges(s, r).select("repo_id", "src", "dst", "relation_type"))  # fmt: skip

query("g4_node_metadata", "fx_symbol_files", "fx_symbols", body="""
SELECT f.repo_id, f.file_id, f.path, f.language, f.line_count, count(s.symbol_id) AS symbol_count, split_part(f.path, '/', 2) AS label
FROM fx_symbol_files f LEFT JOIN fx_symbols s ON s.file_id = f.file_id AND s.repo_id = f.repo_id GROUP BY ALL
""")(graph.node_metadata)  # fmt: skip

_MODULES = f"""edges AS (SELECT r.repo_id, split_part(a.path, '/', 1) AS f, split_part(b.path, '/', 1) AS t, relation_type, count(*) AS n
  {_FROM_TO} WHERE split_part(a.path, '/', 1) <> split_part(b.path, '/', 1) GROUP BY ALL),
nodes AS (SELECT repo_id, node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (
  SELECT repo_id, f AS node, 0 AS i, n AS o FROM edges UNION ALL SELECT repo_id, t, n, 0 FROM edges) GROUP BY 1, 2)"""

query("g8_module_nodes", "fx_symbols", "fx_relations", body=f"""
WITH {_MODULES}, w AS (SELECT *, in_degree + out_degree AS d, least(min(in_degree + out_degree) OVER (PARTITION BY repo_id), 0) AS lo,
  greatest(max(in_degree + out_degree) OVER (PARTITION BY repo_id), 1) AS hi FROM nodes)
SELECT repo_id, node, in_degree, out_degree, CAST(CASE WHEN hi = lo THEN 5 ELSE floor(1 + (d - lo) / CAST(hi - lo AS DOUBLE) * 9 + 0.5) END AS INT) AS size FROM w
""")(lambda s, r: graph.module_graph(s, r)[0])  # fmt: skip

query("g7_top_nodes", "fx_symbols", "fx_relations", body=f"""
WITH {_MODULES} SELECT repo_id, node, in_degree, out_degree, CAST(place AS INT) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY in_degree + out_degree DESC, node) AS place FROM nodes) WHERE place <= 3
""")(lambda s, r: graph.top_nodes(graph.module_graph(s, r)[0].drop("size"), 3))  # fmt: skip

query("g9_graph_stats", "fx_symbols", "fx_relations", "fx_symbol_files", body=f"""
WITH e AS (SELECT repo_id, s, t, relation_type, n FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, s, t, relation_type) AS place FROM (
  SELECT r.repo_id, a.path AS s, b.path AS t, relation_type, count(*) AS n {_FROM_TO} WHERE a.path <> b.path GROUP BY ALL)) WHERE place <= 2000),
d AS (SELECT repo_id, node, sum(i) AS i, sum(o) AS o FROM (SELECT repo_id, s AS node, 0 AS i, n AS o FROM e UNION ALL SELECT repo_id, t, n, 0 FROM e) GROUP BY 1, 2),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY i + o DESC, node) AS place FROM d) WHERE place <= 150),
x AS (SELECT repo_id, count(*) AS n_edges FROM e WHERE (repo_id, s) IN (SELECT (repo_id, node) FROM k) AND (repo_id, t) IN (SELECT (repo_id, node) FROM k) GROUP BY 1)
SELECT repo_id, count(*) AS n_nodes, any_value(n_edges) AS n_edges, avg(i + o) AS avg_degree, count(DISTINCT split_part(node, '/', 1)) AS n_groups FROM k JOIN x USING (repo_id) GROUP BY 1
""")(lambda s, r, f: graph.graph_stats(*graph.build_graph(s, r, f, level="file", most_edges=2000)))  # fmt: skip

query("g5_normalize_relation", "fx_relations", body="""
SELECT repo_id, CASE relation_type WHEN 'imports' THEN 'imports' WHEN 'calls' THEN 'calls' WHEN 'extends' THEN 'extends' ELSE 'uses' END AS kind, count(*) AS n,
  CAST(CASE WHEN count(*) >= 10 THEN 5 WHEN count(*) >= 5 THEN 4 WHEN count(*) >= 3 THEN 3 WHEN count(*) >= 2 THEN 2 ELSE 1 END AS INT) AS weight
FROM fx_relations GROUP BY 1, 2
""")(lambda r: r.groupBy("repo_id", text.normalize_relation(F.col("relation_type")).alias("kind")).agg(F.count("*").alias("n"))
     .withColumn("weight", text.scale_weight(F.col("n"))))

query("g20_module_dependencies", "fx_symbols", "fx_relations", body=f"""
WITH files AS (SELECT repo_id, split_part(path, '/', 1) AS m, count(DISTINCT path) AS n FROM fx_symbols GROUP BY 1, 2),
e AS (SELECT r.repo_id, split_part(a.path, '/', 1) AS from_module, split_part(b.path, '/', 1) AS to_module, count(*) AS dependency_count
  {_FROM_TO} WHERE split_part(a.path, '/', 1) <> split_part(b.path, '/', 1) GROUP BY ALL)
SELECT e.repo_id, from_module, to_module, dependency_count, x.n AS from_files, y.n AS to_files FROM e
JOIN files x ON x.repo_id = e.repo_id AND x.m = from_module JOIN files y ON y.repo_id = e.repo_id AND y.m = to_module
""")(graph.module_dependencies)  # fmt: skip

query("g21_class_hierarchy", "fx_symbols", "fx_relations", body="""
SELECT s.repo_id, s.symbol_id, s.name, s.kind, x.relation_type, x.dst, x.parent_name FROM fx_symbols s LEFT JOIN (
  SELECT r.repo_id, r.src, r.relation_type, r.dst, p.name AS parent_name FROM fx_relations r JOIN fx_symbols p ON p.symbol_id = r.dst AND p.repo_id = r.repo_id
  WHERE relation_type IN ('extends', 'implements')) x ON x.src = s.symbol_id AND x.repo_id = s.repo_id WHERE s.kind IN ('class', 'interface', 'type')
""")(graph.class_hierarchy)  # fmt: skip

query("g27_unreferenced_symbols", "fx_src_symbols", "fx_src_relations", body="""
SELECT repo_id, symbol_id, name, path FROM fx_src_symbols s WHERE kind IN ('function', 'class', 'method') AND NOT regexp_matches(path, '/index\\.|/main\\.|route\\.|page\\.|layout\\.|\\.test\\.|\\.spec\\.')
 AND NOT EXISTS (SELECT 1 FROM fx_src_relations r WHERE r.dst = s.symbol_id AND r.repo_id = s.repo_id)
""")(lambda s, r: graph.unreferenced_symbols(s, r).select("repo_id", "symbol_id", "name", "path"))  # fmt: skip

query("g30_neighbors", "fx_relations", body="""
SELECT DISTINCT repo_id, node, direction, relation_type, neighbor FROM (
  SELECT repo_id, src AS node, 'out' AS direction, relation_type, dst AS neighbor FROM fx_relations UNION ALL SELECT repo_id, dst, 'in', relation_type, src FROM fx_relations) WHERE relation_type IN ('calls', 'extends')
""")(lambda r: graph.neighbors(r.select("repo_id", F.col("src").alias("node")).union(r.select("repo_id", "dst")).distinct(), r, types=["calls", "extends"]))  # fmt: skip
query("g30_neighbor_counts", "fx_relations", body="""
SELECT repo_id, node, direction, relation_type, count(*) AS n FROM (
  SELECT repo_id, src AS node, 'out' AS direction, relation_type FROM fx_relations UNION ALL SELECT repo_id, dst, 'in', relation_type FROM fx_relations) GROUP BY ALL
""")(lambda r: graph.neighbor_counts(graph.neighbors(r.select("repo_id", F.col("src").alias("node")).union(r.select("repo_id", "dst")).distinct(), r)))  # fmt: skip

_REACH = """RECURSIVE walk(repo_id, source, node, depth) AS (
  SELECT repo_id, n, n, 0 FROM (SELECT repo_id, src AS n FROM fx_src_relations UNION SELECT repo_id, dst FROM fx_src_relations)
  UNION SELECT w.repo_id, w.source, r.{to}, w.depth + 1 FROM walk w JOIN fx_src_relations r ON r.repo_id = w.repo_id AND r.{at} = w.node WHERE w.depth < {depth}),
reached AS (SELECT repo_id, source, node, min(depth) AS depth FROM walk GROUP BY 1, 2, 3 HAVING min(depth) > 0 AND node <> source)"""


def _sources(relations: DataFrame) -> DataFrame:
    """Every node of relations."""
    return relations.select("repo_id", F.col("src").alias("source")).union(relations.select("repo_id", "dst")).distinct()


query("g12_impact", "fx_src_relations", body=f"WITH {_REACH.format(to='src', at='dst', depth=4)} SELECT * FROM reached")(
    lambda r: traverse.reach(_sources(r), r, max_depth=4).select("repo_id", "source", "node", "depth")
)
query("g22_call_chains", "fx_src_relations", body=f"""WITH {_REACH.format(to='dst', at='src', depth=2)},
starts AS (SELECT repo_id, source, node, depth FROM reached UNION ALL SELECT repo_id, n, n, 0 FROM (SELECT repo_id, src AS n FROM fx_src_relations UNION SELECT repo_id, dst FROM fx_src_relations))
SELECT s.repo_id, s.source, r.src, r.dst, r.relation_type, depth + 1 AS depth FROM starts s JOIN fx_src_relations r ON r.repo_id = s.repo_id AND r.src = s.node""")(
    lambda r: traverse.call_chains(_sources(r), r)
)
_IMPACT = f"""WITH {_REACH.format(to='src', at='dst', depth=4)},
typed AS (SELECT a.repo_id, a.source, a.node, a.depth, min(r.relation_type) AS relation_type FROM reached a JOIN fx_src_relations r ON r.repo_id = a.repo_id AND r.src = a.node
  LEFT JOIN reached b ON b.repo_id = a.repo_id AND b.source = a.source AND b.node = r.dst
  WHERE coalesce(b.depth, CASE WHEN r.dst = a.source THEN 0 END) = a.depth - 1 GROUP BY 1, 2, 3, 4),
used AS (SELECT s.repo_id, s.file_id, count(DISTINCT r.src) AS n FROM fx_src_relations r JOIN fx_src_symbols s ON s.repo_id = r.repo_id AND s.symbol_id = r.dst GROUP BY 1, 2),
scored AS (SELECT t.*, s.path, least(100, CASE depth WHEN 1 THEN 80 WHEN 2 THEN 50 ELSE 30 END + CASE WHEN relation_type IN ('extends', 'implements') THEN 10 ELSE 0 END
  + CASE WHEN coalesce(u.n, 0) > 5 THEN 5 ELSE 0 END + CASE WHEN regexp_matches(s.path, '/api/|route\\.(ts|js|tsx|jsx)$|handler\\.(ts|js)$|controller\\.(ts|js)$') THEN 10 ELSE 0 END) AS risk FROM typed t JOIN fx_src_symbols s ON s.repo_id = t.repo_id AND s.symbol_id = t.node
  LEFT JOIN used u ON u.repo_id = s.repo_id AND u.file_id = s.file_id)"""
query("g14_risk_score", "fx_src_symbols", "fx_src_relations", body=f"""{_IMPACT} SELECT repo_id, source, node, depth, relation_type, CAST(risk AS INT) AS risk,
 CASE depth WHEN 1 THEN 'direct' WHEN 2 THEN 'indirect' ELSE 'transitive' END AS level FROM scored""")(
    lambda s, r: traverse.impact(_sources(r), s, r).select("repo_id", "source", "node", "depth", "relation_type", "risk", "level")
)
query("g16_impacted_files", "fx_src_symbols", "fx_src_relations", body=f"{_IMPACT} SELECT repo_id, source, path, count(*) AS n_nodes, CAST(max(risk) AS INT) AS max_risk FROM scored GROUP BY 1, 2, 3")(
    lambda s, r: traverse.impacted_files(traverse.impact(_sources(r), s, r))
)
query("g17_impact_summary", "fx_src_symbols", "fx_src_relations", body=f"""{_IMPACT} SELECT repo_id, source, count(*) FILTER (depth = 1) AS n_direct, count(*) FILTER (depth = 2) AS n_indirect,
 count(*) FILTER (depth > 2) AS n_transitive, count(DISTINCT path) AS n_files, count(*) FILTER (risk >= 70) AS n_high_risk FROM scored GROUP BY 1, 2""")(
    lambda s, r: traverse.impact_summary(traverse.impact(_sources(r), s, r))
)
query("g12_reach_all", "fx_relations", body="""
WITH e AS (SELECT DISTINCT repo_id, dst AS a, src AS b FROM fx_relations), one AS (SELECT repo_id, a AS source, b AS node FROM e),
two AS (SELECT DISTINCT x.repo_id, source, b AS node FROM one x JOIN e ON e.repo_id = x.repo_id AND e.a = x.node)
SELECT repo_id, source, node, min(depth) AS depth FROM (SELECT *, 1 AS depth FROM one UNION ALL SELECT *, 2 FROM two) WHERE source <> node GROUP BY 1, 2, 3
""")(lambda r: traverse.reach_all(r, max_depth=2))  # fmt: skip
query("g25_find_cycles", "fx_relations", body="""
WITH e AS (SELECT DISTINCT repo_id, src AS a, dst AS b FROM fx_relations WHERE relation_type = 'imports'),
p2 AS (SELECT repo_id, [a, b] AS n FROM e WHERE a < b),
p3 AS (SELECT p.repo_id, list_append(n, e.b) AS n FROM p2 p JOIN e ON e.repo_id = p.repo_id AND e.a = n[-1] WHERE e.b > n[1] AND NOT list_contains(n, e.b)),
p4 AS (SELECT p.repo_id, list_append(n, e.b) AS n FROM p3 p JOIN e ON e.repo_id = p.repo_id AND e.a = n[-1] WHERE e.b > n[1] AND NOT list_contains(n, e.b)),
p5 AS (SELECT p.repo_id, list_append(n, e.b) AS n FROM p4 p JOIN e ON e.repo_id = p.repo_id AND e.a = n[-1] WHERE e.b > n[1] AND NOT list_contains(n, e.b)),
p AS (SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4 UNION ALL SELECT * FROM p5)
SELECT p.repo_id, CAST(len(n) AS INT) AS length, array_to_string(n, '>') AS nodes FROM p JOIN e ON e.repo_id = p.repo_id AND e.a = n[-1] AND e.b = n[1]
""")(lambda r: traverse.find_cycles(r).withColumn("nodes", F.array_join("nodes", ">")))  # fmt: skip

query("h1_symbol_counts", "fx_symbols", body="""
SELECT repo_id, file_id, count(*) AS symbol_count, count(*) FILTER (kind IN ('function', 'method')) AS function_count,
 sum(CASE WHEN kind IN ('function', 'method') THEN greatest((end_line - start_line) / 10.0, 1.0) ELSE 0.0 END)::DOUBLE AS complexity FROM fx_symbols GROUP BY 1, 2
""")(lambda s: health.symbol_counts(s).withColumn("complexity", F.col("complexity").cast("double")))  # fmt: skip

query("h2_coupling", "fx_symbols", "fx_relations", body=f"""
SELECT coalesce(x.repo_id, y.repo_id) AS repo_id, coalesce(x.file_id, y.file_id) AS file_id, coalesce(afferent, 0) AS afferent, coalesce(efferent, 0) AS efferent
FROM (SELECT b.repo_id, b.file_id, count(DISTINCT src) AS afferent {_FROM_TO} GROUP BY 1, 2) x
FULL JOIN (SELECT a.repo_id, a.file_id, count(DISTINCT dst) AS efferent {_FROM_TO} GROUP BY 1, 2) y ON x.repo_id = y.repo_id AND x.file_id = y.file_id
""")(health.coupling)  # fmt: skip

query("h3_chunk_stats", "fx_chunks", body="""
SELECT repo_id, file_id, count(*) AS chunk_count, avg(token_count) AS avg_tokens,
 count(*) FILTER (content LIKE '//%' OR content LIKE '/*%' OR content LIKE '#%' OR content LIKE '"%') AS comment_chunks FROM fx_chunks GROUP BY 1, 2
""")(health.chunk_stats)  # fmt: skip


_HEALTH = f"""c AS (SELECT repo_id, file_id, count(*) AS sc, sum(CASE WHEN kind IN ('function', 'method') THEN greatest((end_line - start_line) / 10.0, 1.0) ELSE 0.0 END)::DOUBLE AS cx FROM fx_symbols GROUP BY 1, 2),
k AS (SELECT coalesce(x.repo_id, y.repo_id) AS repo_id, coalesce(x.file_id, y.file_id) AS file_id, coalesce(aff, 0) AS aff, coalesce(eff, 0) AS eff
FROM (SELECT b.repo_id, b.file_id, count(DISTINCT src) AS aff {_FROM_TO} GROUP BY 1, 2) x
FULL JOIN (SELECT a.repo_id, a.file_id, count(DISTINCT dst) AS eff {_FROM_TO} GROUP BY 1, 2) y ON x.repo_id = y.repo_id AND x.file_id = y.file_id),
t AS (SELECT repo_id, file_id, count(*) FILTER (content LIKE '//%' OR content LIKE '/*%' OR content LIKE '#%' OR content LIKE '"{'"' * 2}%' OR content LIKE '''''''%') / count(*)::DOUBLE AS docs
 FROM fx_symbol_chunks GROUP BY 1, 2),
m AS (SELECT f.*, coalesce(docs, 0) AS docs, coalesce(sc, 0) AS sc, coalesce(cx, 0) AS cx, CASE WHEN coalesce(aff, 0) + coalesce(eff, 0) > 0 THEN eff / (aff + eff)::DOUBLE ELSE 0 END AS inst
 FROM fx_symbol_files f LEFT JOIN c USING (repo_id, file_id) LEFT JOIN k USING (repo_id, file_id) LEFT JOIN t USING (repo_id, file_id)),
h AS (SELECT *, CAST(greatest(0, 100 - CASE WHEN cx > 50 THEN 20 WHEN cx > 20 THEN 10 ELSE 0 END - CASE WHEN inst > 0.8 THEN 15 WHEN inst > 0.5 THEN 5 ELSE 0 END
 - CASE WHEN line_count > 500 THEN 15 WHEN line_count > 300 THEN 5 ELSE 0 END - CASE WHEN docs < 0.05 THEN 10 ELSE 0 END - CASE WHEN sc > 30 THEN 10 ELSE 0 END) AS INT) AS score FROM m)"""
query("h4_file_health", "fx_symbol_files", "fx_symbols", "fx_relations", "fx_symbol_chunks", body=f"WITH {_HEALTH} SELECT repo_id, file_id, cx AS complexity, inst AS instability, score FROM h")(
    lambda f, s, r, c: health.file_health(f, s, r, c).select("repo_id", "file_id", F.col("complexity").cast("double").alias("complexity"), "instability", "score")
)
query("h5_repo_health", "fx_symbol_files", "fx_symbols", "fx_relations", "fx_symbol_chunks", body=f"""WITH {_HEALTH} SELECT repo_id, count(*) AS file_count, round(avg(cx), 6) AS avg_complexity,
 round(avg(inst), 6) AS avg_instability, max(size_bytes) AS max_size, avg(size_bytes) AS avg_size, CAST(floor(avg(score) + 0.5) AS INT) AS score FROM h GROUP BY 1""")(
    lambda f, s, r, c: health.repo_health(health.file_health(f, s, r, c)).withColumns(
        {c: F.round(F.col(c).cast("double"), 6) for c in ("avg_complexity", "avg_instability")}
    )
)
query("h6_hotspots", "fx_symbol_files", "fx_symbols", "fx_relations", "fx_symbol_chunks", body=f"""WITH {_HEALTH} SELECT repo_id, path, score, CAST(place AS INT) AS place FROM (
 SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY score, path) AS place FROM h) WHERE place <= 10""")(
    lambda f, s, r, c: health.hotspots(health.file_health(f, s, r, c)).select("repo_id", "path", "score", "place")
)
query("h7_language_breakdown", "fx_symbol_files", body="""
SELECT repo_id, coalesce(language, 'unknown') AS language, count(*) AS file_count, CAST(sum(line_count) AS BIGINT) AS line_count,
 count(*) / sum(count(*)) OVER (PARTITION BY repo_id) AS file_share FROM fx_symbol_files GROUP BY 1, 2
""")(health.language_breakdown)  # fmt: skip
query("h8_repo_counts", "fx_symbol_files", "fx_symbols", "fx_relations", body="""
SELECT repo_id, n_files, n_symbols, n_relations FROM (SELECT repo_id, count(*) AS n_files FROM fx_symbol_files GROUP BY 1)
JOIN (SELECT repo_id, count(*) AS n_symbols FROM fx_symbols GROUP BY 1) USING (repo_id) JOIN (SELECT repo_id, count(*) AS n_relations FROM fx_relations GROUP BY 1) USING (repo_id)
""")(health.repo_counts)  # fmt: skip
query("h10_size_shares", "fx_symbol_files", body="""
SELECT repo_id, path, CAST(place AS INT) AS place, line_count / sum(line_count) OVER (PARTITION BY repo_id) AS line_share FROM (
 SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY line_count DESC, path) AS place FROM fx_symbol_files) WHERE place <= 150
""")(lambda f: health.size_shares(f).select("repo_id", "path", "place", "line_share"))  # fmt: skip

query("r1_semantic_topk", "embeddings", body="""
SELECT query_id, chunk_id, similarity, CAST(rank AS INT) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) WHERE similarity >= 0.3) WHERE rank <= 20
""")(lambda e: retrieval.semantic_topk(
    e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("chunk_id"), "embedding")
))

query("r3_lexical_topk", "fx_chunks", "benchmark", body="""
WITH t AS (SELECT chunk_id, list_filter(string_split_regex(lower(content), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS terms FROM fx_chunks),
p AS (SELECT chunk_id, n, term, count(*) AS tf FROM (SELECT chunk_id, len(terms) AS n, unnest(terms) AS term FROM t) GROUP BY ALL),
tot AS (SELECT count(*) AS nc, avg(len(terms)) AS ml FROM t),
q AS (SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS nt FROM (SELECT item_id AS query_id, unnest(list_distinct(list_filter(string_split_regex(
  lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> ''))) AS term FROM benchmark)),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query_id, chunk_id, nt, count(*) AS m, round(sum(ln(1 + (nc - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / ml))), 6) AS score
 FROM p JOIN q USING (term) JOIN df USING (term), tot GROUP BY 1, 2, 3)
SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE m = nt) WHERE rank <= 20
""")(lambda c, b: lexical.lexical_topk(b.select(F.col("item_id").alias("query_id"), "text"), c.drop("repo_id")))  # fmt: skip

query("r4_trigram_similarity", "part", body="""
WITH w AS (SELECT p_partkey, unnest(list_filter(string_split_regex(lower(p_name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w, 0 AS side FROM part
 UNION ALL SELECT p_partkey, unnest(list_filter(string_split_regex(lower(p_type), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')), 1 FROM part),
g AS (SELECT DISTINCT p_partkey, side, substr('  ' || w || ' ', i, 3) AS g FROM w, range(1, 60) r(i) WHERE i <= length(w) + 1),
n AS (SELECT p_partkey, g, count(*) AS k FROM g GROUP BY 1, 2)
SELECT p_partkey, count(*) FILTER (k = 2) / count(*)::DOUBLE AS similarity FROM n GROUP BY 1
""")(lambda p: p.select("p_partkey", text.trigram_similarity(F.col("p_name"), F.col("p_type")).alias("similarity")))  # fmt: skip

_NORMAL = """n AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM fx_candidates WINDOW w AS (PARTITION BY query_id, strategy)),
z AS (SELECT *, CASE WHEN hi > lo THEN (score - lo) / (hi - lo)::DOUBLE WHEN hi > 0 THEN 1.0 ELSE 0.0 END AS x FROM n)"""
_FUSED = f"""{_NORMAL}, f AS (SELECT query_id, chunk_id, file_path, token_count, count(DISTINCT strategy) AS n_strategies,
 round(least(1.0, coalesce(max(x) FILTER (strategy = 'semantic'), 0) * 0.45 + coalesce(max(x) FILTER (strategy = 'lexical'), 0) * 0.3
  + coalesce(max(x) FILTER (strategy = 'structural'), 0) * 0.25 + CASE WHEN count(DISTINCT strategy) >= 2 THEN 0.15 ELSE 0 END), 6) AS final FROM z GROUP BY 1, 2, 3, 4)"""
query("r10_minmax_normalize", "fx_candidates", body=f"WITH {_NORMAL} SELECT query_id, chunk_id, file_path, strategy, token_count, round(x, 6) AS normalized FROM z")(
    lambda c: retrieval.minmax_normalize(c).select("query_id", "chunk_id", "file_path", "strategy", "token_count", F.round("normalized", 6).alias("normalized"))
)
query("r11_fuse_rankings", "fx_candidates", body=f"WITH {_FUSED} SELECT query_id, chunk_id, file_path, token_count, n_strategies, final FROM f")(retrieval.fuse_rankings)
query("c7_duplicate_chunks", "fx_chunks", body="SELECT sha256(content) AS content_hash, count(*) AS n, min(chunk_id) AS first_chunk_id FROM fx_chunks GROUP BY 1 HAVING count(*) > 1")(
    retrieval.duplicate_chunks
)
query("r36_suggest_symbols", "fx_symbols", "nation", body="""
SELECT repo_id, prefix, symbol_id, name, CAST(place AS INT) AS place FROM (SELECT repo_id, p AS prefix, symbol_id, name, row_number() OVER (PARTITION BY repo_id, p ORDER BY name, symbol_id) AS place
 FROM fx_symbols, (SELECT DISTINCT lower(n_name[2:4]) AS p FROM nation UNION SELECT DISTINCT name[3:5] FROM fx_symbols WHERE length(name) >= 5) WHERE contains(lower(name), p)) WHERE place <= 50
""")(lambda s, n: retrieval.suggest_symbols(
    n.select(F.lower(F.substring("n_name", 2, 3)).alias("prefix")).union(s.where(F.length("name") >= 5).select(F.substring("name", 3, 3))).distinct(), s))
query("r6_symbol_candidates", "conversations", body="""
WITH m AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(text, '\\b([A-Z][a-z]{2,})\\b', 1))) AS word FROM conversations)
SELECT word, count(*) AS n FROM m GROUP BY 1
""")(lambda c: c.select(F.explode(text.symbol_candidates(F.col("text"))).alias("word")).where(F.col("word").rlike("^[A-Z][a-z]{2,}$"))
     .groupBy("word").agg(F.count("*").alias("n")))

query("k3_shared_types", "fx_symbols", body="""
SELECT DISTINCT a.repo_id AS from_repo, b.repo_id AS to_repo, a.name, a.kind FROM fx_symbols a JOIN fx_symbols b ON a.name = b.name AND a.kind = b.kind
WHERE a.repo_id < b.repo_id AND a.kind IN ('interface', 'type', 'class', 'enum')
""")(workspace.shared_types)  # fmt: skip
query("k5_shared_modules", "fx_symbol_files", body="""
SELECT a.repo_id AS from_repo, b.repo_id AS to_repo, a.path, CASE WHEN a.line_count = b.line_count THEN 'high' ELSE 'medium' END AS confidence
FROM fx_symbol_files a JOIN fx_symbol_files b ON a.path = b.path AND a.repo_id < b.repo_id WHERE NOT regexp_matches(a.path, 'lock|node_modules|vendor')
""")(lambda f: workspace.shared_modules(f.withColumn("content_hash", F.col("line_count").cast("string"))))  # fmt: skip
query("k1_repo_pairs", "fx_symbol_files", body="""
WITH r AS (SELECT DISTINCT repo_id FROM fx_symbol_files) SELECT 'w' AS workspace_id, a.repo_id AS from_repo, b.repo_id AS to_repo FROM r a JOIN r b ON a.repo_id < b.repo_id
""")(lambda f: workspace.repo_pairs(f.select(F.lit("w").alias("workspace_id"), "repo_id").distinct()))  # fmt: skip
query("t1_timeline", "fx_commits", body="""
SELECT repo_id, sha, ts, total, CAST(place AS INT) AS place FROM (SELECT *, count(*) OVER (PARTITION BY repo_id) AS total,
 row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, sha) AS place FROM fx_commits WHERE ts >= '1994-01-01') WHERE place <= 50
""")(lambda c: workspace.timeline(c, most=50, since="1994-01-01").select("repo_id", "sha", "ts", "total", "place"))  # fmt: skip
query("t1_timeline_of_path", "fx_commits", "fx_commit_files", body="""
WITH f AS (SELECT min(path) AS p FROM fx_commit_files)
SELECT repo_id, sha, ts, total, CAST(place AS INT) AS place FROM (SELECT *, count(*) OVER (PARTITION BY repo_id) AS total,
 row_number() OVER (PARTITION BY repo_id ORDER BY ts DESC, sha) AS place FROM fx_commits WHERE sha IN (SELECT sha FROM fx_commit_files, f WHERE path = p)) WHERE place <= 200
""")(lambda c, f: workspace.timeline(c, path=f.agg(F.min("path")).first()[0], files=f).select("repo_id", "sha", "ts", "total", "place"))  # fmt: skip
query("t2_commit_stats", "fx_commit_files", body="""
SELECT repo_id, sha, count(*) AS n_files, CAST(sum(additions) AS BIGINT) AS additions, CAST(sum(deletions) AS BIGINT) AS deletions, count(DISTINCT path) AS n_paths FROM fx_commit_files GROUP BY 1, 2
""")(workspace.commit_stats)  # fmt: skip
query("t3_touched_symbols", "fx_fork_files", "fx_symbols", body="""
WITH c AS (SELECT *, dense_rank() OVER (PARTITION BY repo_id, sha ORDER BY path) AS place FROM fx_fork_files)
SELECT c.repo_id, c.sha, array_to_string(list_sort(list_distinct(list(s.name))), '|') AS names FROM c JOIN fx_symbols s ON s.repo_id = c.repo_id AND s.path = c.path AND s.start_line <= c.change_end AND s.end_line >= c.change_start
WHERE place <= 5 GROUP BY 1, 2
""")(lambda c, s: workspace.touched_symbols(c, s).withColumn("names", F.array_join("names", "|")))  # fmt: skip

query("o3_top_symbols", "fx_symbols", "fx_relations", body="""
SELECT repo_id, symbol_id, name, n_references, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n_references DESC, symbol_id) AS place FROM (
 SELECT s.repo_id, symbol_id, name, count(r.src) AS n_references FROM fx_symbols s LEFT JOIN fx_relations r ON r.dst = s.symbol_id AND r.repo_id = s.repo_id GROUP BY 1, 2, 3)) WHERE place <= 20
""")(workspace.top_symbols)  # fmt: skip
query("o1_repo_overview", "fx_symbol_files", body="""
WITH p AS (SELECT repo_id, 'files' AS part, '' AS name, count(*) AS n FROM fx_symbol_files GROUP BY 1 UNION ALL SELECT repo_id, 'language', language, count(*) FROM fx_symbol_files WHERE language IS NOT NULL GROUP BY 1, 3
 UNION ALL SELECT repo_id, 'directory', split_part(path, '/', 1), count(*) FROM fx_symbol_files GROUP BY 1, 3)
SELECT repo_id, part, name, n, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, part ORDER BY n DESC, name) AS place FROM p) WHERE place <= CASE part WHEN 'language' THEN 6 ELSE 10 END
""")(workspace.repo_overview)  # fmt: skip
query("o2_entry_points", "fx_files", body="""
WITH f AS (SELECT repo_id, replace(path, 'doc', CASE CAST(file_id AS BIGINT) % 3 WHEN 0 THEN 'main.ts.' WHEN 1 THEN 'server.js' ELSE 'x' END) AS path FROM fx_files)
SELECT repo_id, path, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS place FROM f WHERE contains(path, 'main.ts') OR contains(path, 'server.js')) WHERE place <= 15
""")(lambda f: workspace.entry_points(f.select("repo_id", F.replace("path", F.lit("doc"), F.expr(
    "CASE CAST(file_id AS BIGINT) % 3 WHEN 0 THEN 'main.ts.' WHEN 1 THEN 'server.js' ELSE 'x' END")).alias("path"))))

query("n1_thread_list", "orders", "lineitem", body="""
SELECT o_orderkey AS thread_id, o_orderstatus AS status, count(l_orderkey) AS n_comments, max(l_shipdate) AS last_comment_at
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY 1, 2
""")(lambda o, l: workspace.thread_list(
    o.select(F.col("o_orderkey").alias("thread_id"), F.col("o_orderstatus").alias("status")),
    l.select(F.col("l_orderkey").alias("thread_id"), F.col("l_shipdate").alias("created_at")), "O"))
query("n7_history_window", "conversations", body="""
SELECT conv_id, turn, role, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations)
WHERE place <= 4 AND role IN ('user', 'assistant')
""")(lambda c: workspace.history_window(c, 4).select("conv_id", "turn", "role", "place"))  # fmt: skip
query("n8_conversation_title", "conversations", body="""
WITH f AS (SELECT conv_id, trim(regexp_replace(arg_min(text, turn), '\\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT conv_id, CASE WHEN length(t) <= 80 THEN t ELSE t[1:77] || '...' END AS title FROM f
""")(workspace.conversation_titles)  # fmt: skip
_CITED = """c AS (SELECT doc_id AS message_id, concat(lang, '/d', CAST(doc_id % 10 AS STRING), '/doc', CAST(doc_id AS STRING), '.ts') AS file_path, 1 AS start_line, CAST(doc_id % 40 AS INT) AS end_line FROM documents
 UNION SELECT doc_id, 'none.ts', 1, 2 FROM documents)"""
query("n9_parse_citations", "fx_citations", body=f"WITH {_CITED} SELECT * FROM c")(workspace.parse_citations)
query("n10_validate_citations", "fx_citations", "fx_files", body=f"""
WITH {_CITED}, f AS (SELECT path, len(string_split(content, chr(10))) AS n FROM fx_files)
SELECT message_id, file_path, start_line, end_line, CASE WHEN n IS NULL THEN 'unknown file' WHEN start_line > n THEN 'start out of range' WHEN end_line < start_line OR end_line > n THEN 'end out of range' END AS reason
FROM c LEFT JOIN f ON f.path = c.file_path
""")(lambda m, f: workspace.validate_citations(workspace.parse_citations(m), file_tables.file_facts(f)))  # fmt: skip

query("e1_route_path", "fx_src", body="""
WITH i AS (SELECT file_id, CASE WHEN strpos(path, '/app/') > 0 THEN regexp_replace(path[strpos(path, '/app/') + 5:], '/?route\\.[jt]sx?$', '') WHEN strpos(path, '/pages/') > 0
  THEN regexp_replace(regexp_replace(path[strpos(path, '/pages/') + 7:], '\\.[jt]sx?$', ''), '/index$', '') ELSE regexp_replace(path, '/?route\\.[jt]sx?$', '') END AS p FROM fx_src)
SELECT file_id, concat('/', array_to_string(list_transform(list_filter(string_split(p, '/'), lambda x: x <> ''),
  lambda x: regexp_replace(regexp_replace(x, '^\\[\\.\\.\\.(.*)\\]$', ':\\1*'), '^\\[(.*)\\]$', ':\\1')), '/')) AS route FROM i
""")(lambda f: f.select("file_id", paths.route_path(F.col("path")).alias("route")))  # fmt: skip

query("z1_quota_decisions", "events", body="""
WITH e AS (SELECT *, 2 + length(key_prefix) % 3 AS most, epoch_us(ts) // 60000000 AS w FROM (SELECT event_id, ts, user_id, event_type AS key_prefix FROM events)), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, key_prefix, w ORDER BY ts, event_id) AS n FROM e)
SELECT event_id, user_id, key_prefix, n <= most AS allowed, CAST(greatest(most - n, 0) AS BIGINT) AS remaining, CAST(((w + 1) * 60000000 - epoch_us(ts)) // 1000 AS BIGINT) AS reset_ms FROM n
""")(lambda e: jobs.quota_decisions(
    e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("key_prefix")),
    e.select(F.col("event_type").alias("key_prefix"), (2 + F.length("event_type") % 3).alias("most")).distinct()).drop("ts"))
query("z1_quota_windows", "events", body="""
WITH m AS (SELECT event_type, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 1 ELSE 3 END AS most FROM events GROUP BY 1)
SELECT time_bucket(INTERVAL 60 SECONDS, ts) AS window_start, user_id, e.event_type AS key_prefix, count(*) AS n, most, greatest(most - count(*), 0) AS remaining FROM events e JOIN m ON m.event_type = e.event_type GROUP BY 1, 2, 3, 5
""")(lambda e: jobs.quota_windows(
    e.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("key_prefix")),
    e.groupBy(F.col("event_type").alias("key_prefix")).agg(F.lit(0).alias("k")).select("key_prefix", F.expr("CASE WHEN key_prefix = min(key_prefix) OVER () THEN 1 ELSE 3 END").alias("most")),
).withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))
