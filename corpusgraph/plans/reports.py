"""Queries of the smaller reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import health, relations, reports, traverse, workspace
from ..sources import files as file_tables
from .registry import _CITED, _HEALTH, _IMPACT, _REACH, _sources, query

query("p11_naming_mix", "part", body="""
WITH s AS (SELECT p_partkey % 4 AS repo_id, p_partkey AS symbol_id, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '_') ELSE concat(replace(p_name, ' ', ''), 'ByName') END AS name FROM part)
SELECT repo_id, symbol_id, name FROM s WHERE regexp_full_match(name, '[a-z][a-z0-9]*(_[a-z0-9]+)+')
""")(lambda p: reports.naming_mix(p.select(
    (F.col("p_partkey") % 4).alias("repo_id"), F.col("p_partkey").alias("symbol_id"), F.lit("function").alias("kind"),
    F.when(F.col("p_partkey") % 3 == 0, F.translate("p_name", " ", "_")).otherwise(F.concat(F.translate("p_name", " ", ""), F.lit("ByName"))).alias("name"),
)).select("repo_id", "symbol_id", "name"))

query("p9_parameter_count", "part", body="""
SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS INT) + 2 AS n FROM part
""")(lambda p: p.select("p_partkey", reports.parameter_count(F.concat(
    F.lit("function f("), F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(", cb: (a, b) => void, m: Map<k, v>): void"))).alias("n")))

query("g18_impact_shares", "fx_src_symbols", "fx_src_relations", body=f"""{_IMPACT} SELECT repo_id, source, node, round(risk / sum(risk) OVER (PARTITION BY repo_id, source, depth), 6) AS share,
 round(coalesce(sum(risk) OVER (PARTITION BY repo_id, source, depth ORDER BY risk DESC, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(risk) OVER (PARTITION BY repo_id, source, depth), 6) AS start FROM scored""")(
    lambda s, r: reports.impact_shares(traverse.impact(_sources(r), s, r)).select(
        "repo_id", "source", "node", F.round("share", 6).alias("share"), F.round("start", 6).alias("start"))
)

query("r8_k_hop", "fx_src_relations", body="WITH " + _REACH.format(to="to", at="at", depth=2).replace(
    "JOIN fx_src_relations r", "JOIN (SELECT repo_id, src AS at, dst AS to FROM fx_src_relations UNION SELECT repo_id, dst, src FROM fx_src_relations) r"
).replace("r.to,", 'r."to",') + " SELECT * FROM reached")(
    lambda r: traverse.reach(_sources(r), r, max_depth=2, direction="both").select("repo_id", "source", "node", "depth")
)

query("h6_best_files", "fx_symbol_files", "fx_symbols", "fx_relations", "fx_symbol_chunks", body=f"""WITH {_HEALTH} SELECT repo_id, path, score, CAST(place AS INT) AS place FROM (
 SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, path) AS place FROM h WHERE line_count > 0) WHERE place <= 5""")(
    lambda f, s, r, c: health.best_files(health.file_health(f, s, r, c)).select("repo_id", "path", "score", "place")
)

query("r32_page_results", "lineitem", body="""
WITH u AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_path, start_line ORDER BY score DESC, chunk_id) AS n FROM (SELECT DISTINCT l_suppkey AS query_id, l_shipmode AS file_path,
 CAST(l_quantity AS INT) AS start_line, l_partkey AS chunk_id, l_extendedprice AS score FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem)))
SELECT query_id, file_path, start_line, chunk_id, total, CAST(place AS INT) AS place FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS total,
 row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id, file_path, start_line) AS place FROM u WHERE n = 1) WHERE place BETWEEN 11 AND 20
""")(lambda l: reports.page_results(l.select(
    F.col("l_suppkey").alias("query_id"), F.col("l_returnflag").alias("file_path"), F.col("l_quantity").cast("int").alias("start_line"),
    F.col("l_partkey").alias("chunk_id"), F.col("l_extendedprice").alias("score")).distinct(), limit=10, offset=10)
    .select("query_id", "file_path", "start_line", "chunk_id", "total", "place"))

query("n4_open_threads", "orders", body="""
SELECT o_custkey % 10 AS repo_id, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) AS n_threads FROM orders GROUP BY 1
""")(lambda o: reports.open_threads(o.select((F.col("o_custkey") % 10).alias("repo_id"), F.col("o_orderstatus").alias("status")), status="O"))  # fmt: skip

query("n6_latest_conversations", "orders", body="""
SELECT user_id, conv_id, CAST(place AS INT) AS place FROM (SELECT o_custkey AS user_id, o_orderkey AS conv_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place <= 5
""")(lambda o: reports.latest_conversations(o.select(
    F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("conv_id"), F.col("o_orderdate").alias("updated_at")), 5).drop("updated_at"))

query("n6_messages_of", "conversations", body="""
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS place, role, text FROM conversations
""")(lambda c: reports.messages_of(c.select("conv_id"), c))  # fmt: skip

query("n11_citation_density", "fx_messages", "fx_files", body="""
WITH c AS (SELECT DISTINCT doc_id AS message_id, CASE doc_id % 3 WHEN 0 THEN concat(lang, '/d', CAST(doc_id % 10 AS STRING), '/doc', CAST(doc_id AS STRING), '.ts') ELSE 'none.ts' END AS p FROM documents WHERE doc_id % 3 < 2),
f AS (SELECT path, len(string_split(content, chr(10))) AS n FROM fx_files), v AS (SELECT message_id, count(*) AS k FROM c JOIN f ON f.path = c.p WHERE n >= 2 GROUP BY 1),
w AS (SELECT message_id, CAST(len(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '')) AS INT) AS n_words FROM fx_messages)
SELECT message_id, n_words, coalesce(k, 0) AS n_valid, coalesce(k, 0) >= greatest(1.0, n_words / 100) AS dense, n_words > 30 AND coalesce(k, 0) = 0 AS uncited FROM w LEFT JOIN v USING (message_id)
""")(lambda m, f: reports.citation_density(m, workspace.validate_citations(workspace.parse_citations(m), file_tables.file_facts(f))))  # fmt: skip

query("t5_default_summary", "documents", body="SELECT CAST(doc_id AS STRING) AS sha, text[1:120] AS summary, 'minor' AS level FROM documents")(
    lambda d: reports.default_summaries(d.select(F.col("doc_id").cast("string").alias("sha"), F.col("text").alias("message")))
)

query("s10_latest_job", "orders", body="""
SELECT o_custkey AS repo_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS job_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, max(o_orderdate) AS created_at FROM orders GROUP BY 1
""")(lambda o: reports.latest_job(o.select(
    F.col("o_custkey").alias("repo_id"), F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))))

query("n12_workspace_repos", "orders", body="""
SELECT o_custkey % 100 AS workspace_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest, count(*) AS n_repos FROM orders GROUP BY 1
""")(lambda o: reports.workspace_repos(o.select(
    (F.col("o_custkey") % 100).alias("workspace_id"), F.col("o_orderkey").alias("repo_id"), F.col("o_orderdate").alias("created_at"))))

query("k4_manifest_dependencies", "supplier", "nation", body="""
SELECT DISTINCT s_suppkey AS from_repo, CAST(1000000 + n_nationkey AS BIGINT) AS to_repo, n_name AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey
""")(lambda s, n: reports.manifest_dependencies(
    s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        F.col("s_suppkey").cast("long").alias("repo_id"), F.to_json(F.struct(F.create_map("n_name", F.lit("^1")).alias("dependencies"))).alias("content"))
    .unionByName(n.select((F.col("n_nationkey") + 1_000_000).cast("long").alias("repo_id"), F.to_json(F.struct(F.col("n_name").alias("name"))).alias("content")))
))

query("x10_assign_parents", "fx_symbols", body="""
SELECT symbol_id, parent_symbol_id FROM (SELECT i.symbol_id, o.symbol_id AS parent_symbol_id, row_number() OVER (PARTITION BY i.symbol_id ORDER BY o.end_line - o.start_line, o.symbol_id) AS n
 FROM fx_symbols i LEFT JOIN fx_symbols o ON o.repo_id = i.repo_id AND o.file_id = i.file_id AND o.start_line <= i.start_line AND o.end_line >= i.end_line
  AND (o.start_line < i.start_line OR o.end_line > i.end_line)) WHERE n = 1
""")(lambda s: relations.assign_parents(s).select("symbol_id", "parent_symbol_id"))  # fmt: skip

query("n3_anchor_to_symbol", "fx_fork_files", "fx_symbols", body="""
WITH r AS (SELECT DISTINCT repo_id, path, change_start AS a, change_end AS b FROM fx_fork_files)
SELECT r.repo_id, concat(r.path, ':', CAST(a AS STRING), ':', CAST(b AS STRING)) AS range_id, arg_min(s.symbol_id, (s.end_line - s.start_line, s.symbol_id)) AS symbol_id
FROM r JOIN fx_symbols s ON s.repo_id = r.repo_id AND s.path = r.path AND s.start_line <= b AND s.end_line >= a GROUP BY 1, 2
""")(lambda c, s: relations.anchor_to_symbol(
    c.select("repo_id", F.concat_ws(":", "path", "change_start", "change_end").alias("range_id"), F.col("path").alias("file_id"),
             F.col("change_start").alias("from_line"), F.col("change_end").alias("to_line")).distinct(),
    s.select("repo_id", F.col("path").alias("file_id"), "symbol_id", "start_line", "end_line")))

_ASKED = "w AS (SELECT DISTINCT upper(name) AS query_id, lower(name) AS low FROM fx_src_symbols)"


def _by_name(s):
    """Every name, in upper case."""
    return s.select(F.upper("name").alias("query_id"), F.upper("name").alias("name")).distinct()


query("r27_find_definitions", "fx_src_symbols", "fx_src_chunks", body=f"""
WITH {_ASKED}, r AS (SELECT w.query_id, s.repo_id, s.symbol_id, s.name, s.kind, s.path, c.chunk_id, c.start_line, c.end_line, row_number() OVER (PARTITION BY w.query_id ORDER BY
 CASE WHEN s.kind IN ('class', 'function', 'interface', 'type', 'enum') THEN 0 ELSE 1 END, low, s.name, s.path, s.start_line, s.repo_id, s.symbol_id, c.start_line, c.chunk_id) AS rank
 FROM w JOIN fx_src_symbols s ON lower(s.name) = low LEFT JOIN fx_src_chunks c ON c.repo_id = s.repo_id AND c.symbol_id = s.symbol_id)
SELECT * REPLACE (CAST(rank AS INT) AS rank) FROM r WHERE rank <= 20 AND chunk_id IS NOT NULL
""")(lambda s, c: relations.find_definitions(_by_name(s), s, c))  # fmt: skip

query("r28_find_usages", "fx_src_symbols", "fx_src_relations", "fx_src_chunks", body=f"""
WITH {_ASKED}, t AS (SELECT query_id, repo_id, symbol_id FROM (SELECT w.query_id, s.*, row_number() OVER (PARTITION BY w.query_id ORDER BY s.path, s.start_line, s.repo_id, s.symbol_id) AS n FROM w JOIN fx_src_symbols s ON lower(s.name) = low) WHERE n <= 20),
u AS (SELECT DISTINCT query_id, r.repo_id, r.src AS symbol_id FROM t JOIN fx_src_relations r ON r.repo_id = t.repo_id AND r.dst = t.symbol_id WHERE relation_type IN ('calls', 'uses', 'imports', 'extends', 'implements', 'references')),
k AS (SELECT u.query_id, u.repo_id, u.symbol_id, s.path, c.chunk_id, c.start_line, c.end_line, row_number() OVER (PARTITION BY query_id ORDER BY s.path, c.start_line NULLS LAST, u.repo_id, u.symbol_id, c.chunk_id) AS rank
 FROM u JOIN fx_src_symbols s USING (repo_id, symbol_id) LEFT JOIN fx_src_chunks c ON c.repo_id = u.repo_id AND c.symbol_id = u.symbol_id)
SELECT * REPLACE (CAST(rank AS INT) AS rank) FROM k WHERE rank <= 20 AND chunk_id IS NOT NULL
""")(lambda s, r, c: relations.find_usages(_by_name(s), s, r, c))  # fmt: skip
