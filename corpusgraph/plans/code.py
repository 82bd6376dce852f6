"""Queries over source files: symbols, blocks, chunks, endpoints and pattern reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blocks, chunks, endpoints, extract, patterns, relations
from ..sources import files as file_tables
from .fixtures import frame, sql
from .registry import QUERIES, SQL, query

_LINES = """l AS (SELECT repo_id, file_id, path, language, unnest(string_split(content, chr(10))) AS line,
  CAST(unnest(range(1, len(string_split(content, chr(10))) + 1)) AS INT) AS start_line FROM fx_src)"""


def _values(kinds: set[str] | None, skip: tuple[str, ...] = ()) -> str:
    """The pattern table as SQL rows (language, ordinal, kind, pattern)."""
    rows = []
    for language, table in extract.PATTERNS.items():
        for i, (kind, pattern) in enumerate(table):
            if (kinds is None or kind in kinds) and kind not in skip:
                rows.append("('%s', %d, '%s', '%s')" % (language, i, kind, pattern.replace("'", "''")))
    return ", ".join(rows)


def _matched(kinds: set[str] | None, skip: tuple[str, ...] = ()) -> str:
    return f"""{_LINES}, p(language, ordinal, kind, pattern) AS (VALUES {_values(kinds, skip)}),
 m AS (SELECT repo_id, file_id, path, start_line, line, ordinal, kind, regexp_extract(line, pattern, 1) AS name FROM l JOIN p USING (language))"""


query("x1_extract_symbols", "fx_src", body=f"""
WITH {_matched(None, ('import', 'export'))}
SELECT repo_id, file_id, name, kind, start_line, trim(line) AS signature FROM (
 SELECT *, row_number() OVER (PARTITION BY repo_id, file_id, start_line, name ORDER BY ordinal) AS n FROM m WHERE name <> '') WHERE n = 1
""")(lambda c: extract.extract_symbols(extract.declarations(c)))  # fmt: skip

query("x2_extract_imports", "fx_src", body=f"""
WITH {_matched({'import'})}
SELECT repo_id, file_id, name AS source, array_to_string(list_filter(list_transform(string_split(regexp_extract(trim(line), '\\{{([^}}]*)\\}}', 1), ','),
 lambda x: trim(regexp_replace(x, '\\s+as\\s+.*$', ''))), lambda x: x <> ''), '|') AS names FROM m WHERE name <> ''
""")(lambda c: extract.extract_imports(extract.declarations(c)).withColumn("names", F.array_join("names", "|")))  # fmt: skip

query("x3_extract_exports", "fx_src", body=f"WITH {_matched({'export'})} SELECT DISTINCT repo_id, file_id, name FROM m WHERE name <> ''")(
    lambda c: extract.extract_exports(extract.declarations(c))
)

query("x9_inheritance", "fx_src", body=f"""
WITH {_matched(None, ('import', 'export'))}, c AS (SELECT DISTINCT repo_id, file_id, name, line FROM m WHERE kind = 'class' AND name <> '')
SELECT repo_id, file_id, name, 'extends' AS relation_type, regexp_extract(line, '\\bextends\\s+(\\w+)', 1) AS parent FROM c WHERE regexp_extract(line, '\\bextends\\s+(\\w+)', 1) <> ''
UNION ALL SELECT repo_id, file_id, name, 'implements', trim(x) FROM (SELECT *, unnest(string_split(regexp_extract(line, '\\bimplements\\s+([\\w\\s,]+)', 1), ',')) AS x FROM c) WHERE trim(x) <> ''
""")(lambda c: extract.inheritance(extract.extract_symbols(extract.declarations(c))))  # fmt: skip


def _declared(c):
    """Symbols of fx_src files with ids, paths and end lines."""
    found = blocks.block_ends(extract.extract_symbols(extract.declarations(c)), c)
    ids = F.concat_ws(":", "file_id", "start_line", "name")
    return found.join(c.select("repo_id", "file_id", "path"), ["repo_id", "file_id"]).withColumn("symbol_id", ids)


query("x9_resolve_inheritance", "fx_src", body=f"""
WITH {_matched(None, ('import', 'export'))}, t AS (SELECT DISTINCT repo_id, path, name, start_line, line, concat(file_id, ':', CAST(start_line AS STRING), ':', name) AS id FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id, file_id, start_line, name ORDER BY ordinal) AS n FROM m WHERE name <> '') WHERE n = 1 AND kind IN ('class', 'interface', 'type')),
k AS (SELECT repo_id, path, name, regexp_extract(line, '\\bextends\\s+(\\w+)', 1) AS parent FROM t WHERE line LIKE '%class%' AND regexp_extract(line, '\\bextends\\s+(\\w+)', 1) <> '')
SELECT repo_id, src, dst, 'extends' AS relation_type FROM (SELECT k.repo_id, s.id AS src, d.id AS dst, row_number() OVER (PARTITION BY s.id, k.parent ORDER BY CASE WHEN d.path = k.path THEN 0
  WHEN regexp_replace(d.path, '[^/]*$', '') = regexp_replace(k.path, '[^/]*$', '') THEN 1 ELSE 2 END, d.path, d.id) AS n
 FROM k JOIN t s ON s.repo_id = k.repo_id AND s.path = k.path AND s.name = k.name JOIN t d ON d.repo_id = k.repo_id AND d.name = k.parent WHERE s.id <> d.id) WHERE n = 1
""")(lambda c: relations.resolve_inheritance(
    extract.inheritance(extract.extract_symbols(extract.declarations(c))).join(c.select("repo_id", "file_id", "path"), ["repo_id", "file_id"]), _declared(c)))

query("x4_block_ends", "fx_src", body=f"""
WITH {_matched(None, ('import', 'export'))}, s AS (SELECT DISTINCT repo_id, file_id, language, name, start_line FROM m JOIN (SELECT repo_id, file_id, language FROM fx_src) USING (repo_id, file_id) WHERE name <> ''),
n AS (SELECT repo_id, file_id, count(*) AS lines FROM l GROUP BY 1, 2),
b AS (SELECT repo_id, file_id, start_line AS line, i, c FROM (SELECT repo_id, file_id, start_line, unnest(range(1, length(line) + 1)) AS i, unnest(string_split(line, '')) AS c FROM l WHERE length(line) > 0) WHERE c IN ('{{', '}}')),
d AS (SELECT *, sum(CASE c WHEN '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY repo_id, file_id ORDER BY line, i) AS depth FROM b),
o AS (SELECT s.repo_id, s.file_id, s.start_line, min(d.line * 100000 + d.i) AS at_open FROM (SELECT DISTINCT repo_id, file_id, start_line FROM s) s JOIN d ON d.repo_id = s.repo_id AND d.file_id = s.file_id AND d.line >= s.start_line AND c = '{{' GROUP BY 1, 2, 3),
q AS (SELECT o.*, coalesce((SELECT sum(CASE c WHEN '{{' THEN 1 ELSE -1 END) FROM b WHERE b.repo_id = o.repo_id AND b.file_id = o.file_id AND b.line < o.start_line), 0) AS base FROM o),
z AS (SELECT q.repo_id, q.file_id, q.start_line, min(d.line) AS shut FROM q JOIN d ON d.repo_id = q.repo_id AND d.file_id = q.file_id AND c = '}}' AND depth = base AND d.line * 100000 + d.i > at_open GROUP BY 1, 2, 3),
y AS (SELECT s.repo_id, s.file_id, s.start_line, min(e.start_line) - 1 AS less FROM s JOIN l a ON a.repo_id = s.repo_id AND a.file_id = s.file_id AND a.start_line = s.start_line
  JOIN l e ON e.repo_id = s.repo_id AND e.file_id = s.file_id AND e.start_line > s.start_line AND regexp_matches(e.line, '\\S') AND length(e.line) - length(ltrim(e.line)) <= length(a.line) - length(ltrim(a.line)) GROUP BY 1, 2, 3)
SELECT s.repo_id, s.file_id, s.name, s.start_line, CAST(CASE WHEN language = 'python' THEN coalesce(less, lines) WHEN at_open IS NULL THEN s.start_line ELSE coalesce(shut, least(s.start_line + 49, lines)) END AS INT) AS end_line
FROM s JOIN n USING (repo_id, file_id) LEFT JOIN q USING (repo_id, file_id, start_line) LEFT JOIN z USING (repo_id, file_id, start_line) LEFT JOIN y USING (repo_id, file_id, start_line)
""")(lambda c: blocks.block_ends(extract.extract_symbols(extract.declarations(c)), c).select("repo_id", "file_id", "name", "start_line", "end_line"))  # fmt: skip

query("c1_token_count", "documents", body="SELECT doc_id, CAST(ceil(length(text) / 4.0) AS INT) AS tokens FROM documents")(
    lambda d: d.select("doc_id", chunks.token_count(F.col("text")).alias("tokens"))
)
query("c6_link_chunks", "fx_src_chunks", "fx_src_symbols", body="""
SELECT c.repo_id, c.chunk_id, arg_max(s.symbol_id, (s.start_line, s.symbol_id)) AS symbol_id FROM fx_src_chunks c
LEFT JOIN fx_src_symbols s ON s.repo_id = c.repo_id AND s.file_id = c.file_id AND s.name = concat('fn', c.file_id) GROUP BY 1, 2
""")(lambda c, s: chunks.link_chunks(c.drop("symbol_id").withColumn("symbol_name", F.concat(F.lit("fn"), "file_id")), s).select("repo_id", "chunk_id", "symbol_id"))  # fmt: skip


def _plain(name: str, *views: str):
    """Register a query that SQL does not express; tests hold it against a plain version."""

    def register(make):
        QUERIES[name] = lambda spark, sf_dir: make(*(frame(spark, sf_dir, v) for v in views))
        return make

    return register


_plain("c2_chunk_by_symbols", "fx_src")(lambda c: chunks.chunk_by_symbols(c, _declared(c)))
_plain("c4_chunk_by_lines", "fx_files")(chunks.chunk_by_lines)
_plain("c5_add_overlap", "fx_files")(lambda f: chunks.add_overlap(chunks.chunk_by_lines(f), f))
_plain("c8_embed_chunks", "fx_chunks")(chunks.embed_chunks)
_plain("e8_detect_endpoints", "fx_src")(endpoints.detect_endpoints)

query("s9_index_report", "fx_src", "fx_src_symbols", "fx_src_chunks", body="""
WITH f AS (SELECT repo_id, file_id, CAST(file_id AS BIGINT) % 3 <> 0 AS old, CAST(file_id AS BIGINT) % 5 = 0 AS edited FROM fx_src),
a AS (SELECT repo_id, count(*) FILTER (NOT old OR edited) AS files_processed, count(*) FILTER (old AND NOT edited) AS files_skipped, count(*) FILTER (CAST(file_id AS BIGINT) % 50 = 7) AS errors FROM f GROUP BY 1),
s AS (SELECT repo_id, count(*) AS symbols FROM fx_src_symbols GROUP BY 1), c AS (SELECT repo_id, count(*) AS chunks, count(*) FILTER (CAST(chunk_id AS BIGINT) % 2 = 0) AS embeddings FROM fx_src_chunks GROUP BY 1)
SELECT repo_id, files_processed, files_skipped, coalesce(symbols, 0) AS symbols, chunks, embeddings, errors FROM a LEFT JOIN s USING (repo_id) LEFT JOIN c USING (repo_id)
""")(lambda f, s, c: file_tables.index_report(
    f, s, c, c.where(F.col("chunk_id").cast("long") % 2 == 0),
    file_tables.diff_snapshot(
        f.where(F.col("file_id").cast("long") % 3 != 0).withColumn("content_hash", F.sha2("content", 256)),
        f.withColumn("content_hash", F.when(F.col("file_id").cast("long") % 5 == 0, F.lit("edited")).otherwise(F.sha2("content", 256)))),
    f.where(F.col("file_id").cast("long") % 50 == 7)))

_METHODS = "'GET', 'POST', 'PUT', 'PATCH', 'DELETE'"
query("e2_app_route_methods", "fx_src", body=f"""
WITH a AS (SELECT file_id, list_distinct(list_concat(regexp_extract_all(content, 'export\\s+(?:async\\s+)?function\\s+(GET|POST|PUT|PATCH|DELETE)\\s*\\(', 1),
 list_filter(list_transform(string_split(array_to_string(regexp_extract_all(content, 'export\\s+\\{{([^}}]+)\\}}', 1), ','), ','), lambda x: trim(x)), lambda x: x IN ({_METHODS})))) AS m FROM fx_src)
SELECT file_id, CASE WHEN len(m) > 0 THEN array_to_string(list_sort(m), '|') ELSE 'GET' END AS methods FROM a
""")(lambda c: c.select("file_id", F.array_join(F.array_sort(endpoints.app_route_methods(F.col("content"))), "|").alias("methods")))  # fmt: skip
query("e2_pages_methods", "fx_src", body=f"""
WITH a AS (SELECT file_id, list_distinct(list_filter(regexp_extract_all(content, 'req\\.method\\s*===?\\s*[''"]([A-Z]+)[''"]', 1), lambda x: x IN ({_METHODS}))) AS m FROM fx_src)
SELECT file_id, CASE WHEN len(m) > 0 THEN array_to_string(list_sort(m), '|') ELSE 'ALL' END AS methods FROM a
""")(lambda c: c.select("file_id", F.array_join(F.array_sort(endpoints.pages_methods(F.col("content"))), "|").alias("methods")))  # fmt: skip
query("e3_call_routes", "fx_src", body="""
SELECT file_id, upper(x.m) AS method, x.p AS route FROM (SELECT file_id, unnest(list_zip(regexp_extract_all(content, '(?i)(?:app|router|server)\\.(get|post|put|patch|delete|all)\\s*\\(\\s*[''"`]([^''"` ]+)[''"`]', 1),
  regexp_extract_all(content, '(?i)(?:app|router|server)\\.(get|post|put|patch|delete|all)\\s*\\(\\s*[''"`]([^''"` ]+)[''"`]', 2))) AS z, struct_pack(m := z[1], p := z[2]) AS x FROM fx_src)
UNION ALL SELECT file_id, unnest(['GET', 'POST']), concat('/w', CAST(CAST(file_id AS BIGINT) % 10 AS STRING)) FROM fx_src WHERE content LIKE '%router.route(%'
""")(lambda c: c.select("file_id", F.inline(endpoints.call_routes(F.col("content")))).withColumnRenamed("path", "route"))  # fmt: skip
query("e4_decorator_routes", "fx_src", body=f"""
WITH {_LINES}, d AS (SELECT *, regexp_extract(line, '(?i)@(?:app|router)\\.(get|post|put|patch|delete)\\s*\\(\\s*[''"]([^''"]+)[''"]', 1) AS fm, regexp_extract(line, '(?i)@(?:app|router)\\.(get|post|put|patch|delete)\\s*\\(\\s*[''"]([^''"]+)[''"]', 2) AS fp,
  regexp_extract(line, '(?i)@app\\.route\\s*\\(\\s*[''"]([^''"]+)[''"]', 1) AS kp, regexp_extract_all(regexp_extract(line, 'methods\\s*=\\s*\\[([^\\]]*)\\]', 1), '[''"]([A-Z]+)[''"]', 1) AS km FROM l WHERE path LIKE '%.py'),
h AS (SELECT repo_id, path, start_line AS line_at, regexp_extract(line, '^def\\s+(\\w+)\\s*\\(', 1) AS handler FROM l WHERE regexp_matches(line, '^def\\s+\\w+\\s*\\(')),
r AS (SELECT repo_id, path, 'fastapi' AS framework, upper(fm) AS method, fp AS route, start_line FROM d WHERE fm <> '' UNION ALL SELECT repo_id, path, 'flask', unnest(CASE WHEN len(km) > 0 THEN km ELSE ['GET'] END), kp, start_line FROM d WHERE kp <> '')
SELECT r.repo_id, r.path, framework, method, route, start_line, (SELECT arg_min(h.handler, h.line_at) FROM h WHERE h.repo_id = r.repo_id AND h.path = r.path AND h.line_at > r.start_line) AS handler FROM r
""")(lambda c: endpoints.decorator_routes(c).select("repo_id", "path", "framework", "method", "route", "start_line", "handler"))  # fmt: skip
query("e5_requires_auth", "fx_src", body="""
SELECT file_id, regexp_matches(content, 'requireSession\\s*\\(|getSession\\s*\\(|authenticate\\s*\\(|verifyToken\\s*\\(|jwt\\.verify\\s*\\(|isAuthenticated|checkAuth|authMiddleware|Depends\\(get_current_user|login_required|current_user|@jwt_required')
 OR regexp_matches(lower(content), 'bearertoken|authorization') AS auth FROM fx_src
""")(lambda c: c.select("file_id", endpoints.requires_auth(F.col("content")).alias("auth")))  # fmt: skip
query("e6_extract_parameters", "fx_src", body="""
WITH p AS (SELECT file_id, 0 AS o, 'path' AS location, unnest(regexp_extract_all(path, '\\[(?:\\.\\.\\.)?([a-zA-Z_][a-zA-Z0-9_]*)\\]', 1)) AS name FROM fx_src
 UNION ALL SELECT file_id, 1, 'query', unnest(regexp_extract_all(content, '(?:searchParams|query)\\.get\\s*\\(\\s*[''"]([^''"]+)[''"]\\s*\\)', 1)) FROM fx_src
 UNION ALL SELECT file_id, 1, 'query', unnest(regexp_extract_all(content, '(?:req|request)\\.query\\.([a-zA-Z_]\\w*)', 1)) FROM fx_src
 UNION ALL SELECT file_id, 2, 'body', unnest(['name', 'age']) FROM fx_src WHERE content LIKE '%= await req.json()%'
 UNION ALL SELECT file_id, 3, 'header', unnest(list_filter(regexp_extract_all(lower(content), 'headers\\.get\\s*\\(\\s*[''"]([a-z][a-z0-9\\-]*)[''"]', 1), lambda h: h[1:2] = 'x-')) FROM fx_src)
SELECT file_id, name, location FROM (SELECT *, row_number() OVER (PARTITION BY file_id, name ORDER BY o) AS n FROM p) WHERE n = 1
""")(lambda c: c.select("file_id", F.inline(endpoints.parameters(F.col("content"), F.col("path")))).select("file_id", "name", "location"))  # fmt: skip
query("e7_response_type", "fx_src", body="""
SELECT file_id, CASE WHEN regexp_matches(content, 'NextResponse\\.json\\s*\\(') OR regexp_matches(content, 'Response\\s*\\(\\s*JSON\\.stringify') OR regexp_matches(content, 'res\\.json\\s*\\(') THEN 'JSON'
 WHEN regexp_matches(content, 'return\\s+Response\\s*\\(') THEN 'Response' WHEN content LIKE '%StreamingTextResponse%' THEN 'StreamingText' WHEN content LIKE '%NextResponse.redirect%' THEN 'Redirect'
 WHEN regexp_matches(content, 'res\\.send\\s*\\(') THEN 'Text' END AS kind FROM fx_src
""")(lambda c: c.select("file_id", endpoints.response_type(F.col("content")).alias("kind")))  # fmt: skip
query("e9_db_tables", "fx_src", body="""
SELECT file_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(content, '\\.(?:from|insert|update|delete)\\s*\\(\\s*([a-zA-Z_]\\w*)\\s*\\)', 1),
 regexp_extract_all(content, 'prisma\\.([a-zA-Z_]\\w*)\\.(?:find|create|update|delete|upsert)', 1)))), '|') AS tables,
 array_to_string(list_sort(list_distinct(regexp_extract_all(content, 'fetch\\s*\\(\\s*[''"`]https?://([^/''"` ]+)', 1))), '|') AS hosts FROM fx_src
""")(lambda c: c.select(
    "file_id", F.array_join(F.array_sort(endpoints.db_tables(F.col("content"))), "|").alias("tables"), F.array_join(F.array_sort(endpoints.external_hosts(F.col("content"))), "|").alias("hosts")))
_ROUTES = """r AS (SELECT repo_id, file_id AS endpoint_id, concat('/api/', CASE k % 4 WHEN 0 THEN concat('a', CAST(g % 3 AS STRING), '/list/more') WHEN 1 THEN concat('b', CAST(g % 3 AS STRING), '/:id/x') WHEN 2 THEN ':all*' ELSE '' END) AS route,
 CASE k % 3 WHEN 0 THEN 'express' WHEN 1 THEN 'flask' ELSE 'nextjs-pages' END AS framework, CASE k % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS method, k % 5 = 0 AS auth_required FROM fx_src)"""
_RESOURCE = "CASE k % 4 WHEN 0 THEN concat('/api/a', CAST(g % 3 AS STRING)) WHEN 1 THEN concat('/api/b', CAST(g % 3 AS STRING)) ELSE '/api' END"


def _routes(c):
    g = (F.col("g") % 3).cast("string")
    tail = (
        F.when(F.col("k") % 4 == 0, F.concat(F.lit("a"), g, F.lit("/list/more"))).when(F.col("k") % 4 == 1, F.concat(F.lit("b"), g, F.lit("/:id/x")))
        .when(F.col("k") % 4 == 2, ":all*").otherwise("")
    )
    return c.select(
        "repo_id", F.col("file_id").alias("endpoint_id"), F.concat(F.lit("/api/"), tail).alias("route"),
        F.when(F.col("k") % 3 == 0, "express").when(F.col("k") % 3 == 1, "flask").otherwise("nextjs-pages").alias("framework"),
        F.when(F.col("k") % 2 == 0, "GET").otherwise("POST").alias("method"), (F.col("k") % 5 == 0).alias("auth_required"),
    )


query("e10_related_endpoints", "fx_src", body=f"""
SELECT repo_id, file_id AS endpoint_id, {_RESOURCE} AS resource, count(*) OVER (PARTITION BY repo_id, {_RESOURCE}) - 1 AS n_related FROM fx_src
""")(lambda c: endpoints.related_endpoints(_routes(c)))  # fmt: skip
query("e10_endpoints_by_resource", "fx_src", body=f"""
SELECT repo_id, {_RESOURCE} AS resource, array_to_string(list_sort(list(file_id)), '|') AS endpoint_ids FROM fx_src GROUP BY 1, 2
""")(lambda c: endpoints.endpoints_by_resource(_routes(c)).withColumn("endpoint_ids", F.array_join("endpoint_ids", "|")))  # fmt: skip
query("e11_main_framework", "fx_src", body=f"""
WITH {_ROUTES} SELECT repo_id, framework, n FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, framework) AS place FROM (SELECT repo_id, framework, count(*) AS n FROM r GROUP BY 1, 2)) WHERE place = 1
""")(lambda c: endpoints.main_framework(_routes(c)))  # fmt: skip
query("e12_filter_endpoints", "fx_src", body=f"""
WITH {_ROUTES} SELECT repo_id, endpoint_id, method, route FROM r WHERE method = 'GET' AND NOT auth_required AND contains(lower(route), 'list')
""")(lambda c: endpoints.filter_endpoints(_routes(c), methods=["GET"], auth="public", text="List").select("repo_id", "endpoint_id", "method", "route"))  # fmt: skip

_FUNCTIONS = "SELECT DISTINCT repo_id, file_id FROM fx_src_symbols WHERE kind IN ('function', 'method')"
query("p1_singletons", "fx_src_chunks", body="""
SELECT repo_id, path, start_line, end_line FROM fx_src_chunks WHERE regexp_matches(content, '(?i)let\\s+instance\\s*[=:]') OR regexp_matches(content, 'export\\s+const\\s+\\w+\\s*=\\s*new\\s+\\w+|export\\s+const\\s+\\w+\\s*=\\s*\\w+\\(\\)|getInstance\\s*\\(|_instance\\s*=|static\\s+instance\\s*:')
""")(lambda c: patterns.singletons(c).select("repo_id", "path", "start_line", "end_line"))  # fmt: skip
query("p2_factories", "fx_src_chunks", "fx_src_symbols", body=f"""
SELECT repo_id, path FROM fx_src_chunks JOIN ({_FUNCTIONS}) USING (repo_id, file_id) WHERE regexp_matches(content, 'switch\\s*\\(.*\\)\\s*\\{{(?s:.{{0,500}})return\\s+new\\s+\\w+')
 OR regexp_matches(content, 'if\\s*\\(.*\\)\\s*\\{{(?s:.{{0,200}})return\\s+new\\s+\\w+') OR regexp_matches(content, 'return\\s+\\{{\\s*\\.\\.\\.')
""")(lambda c, s: patterns.factories(c, s).select("repo_id", "path"))  # fmt: skip
query("p3_service_layers", "fx_src", "fx_src_symbols", body="""
SELECT repo_id, f.path, concat(CAST(count(*) AS STRING), ' functions') AS evidence FROM fx_src f JOIN fx_src_symbols s USING (repo_id, file_id)
WHERE regexp_matches(f.path, '(?i)(service|queries|repository|repo|store|dao)\\.(ts|js|tsx)$') AND s.kind IN ('function', 'method') GROUP BY 1, 2
""")(lambda f, s: patterns.service_layers(f, s).select("repo_id", "path", "evidence"))  # fmt: skip
query("p4_observers", "fx_src_chunks", body="""
WITH m AS (SELECT repo_id, path, CAST(content LIKE '%EventEmitter%' AS INT) + CAST(regexp_matches(content, '\\.on\\s*\\(') AS INT) + CAST(regexp_matches(content, '\\.emit\\s*\\(') AS INT) + CAST(content LIKE '%addEventListener%' AS INT)
 + CAST(content LIKE '%removeEventListener%' AS INT) + CAST(regexp_matches(content, '\\.subscribe\\s*\\(') AS INT) + CAST(content LIKE '%Observable%' AS INT) AS n FROM fx_src_chunks)
SELECT repo_id, path, concat(CAST(n AS STRING), ' marks') AS evidence FROM m WHERE n >= 2
""")(lambda c: patterns.observers(c).select("repo_id", "path", "evidence"))  # fmt: skip
query("p5_barrels", "fx_src", "fx_src_symbols", body="""
SELECT repo_id, f.path, CAST(any_value(f.line_count) AS INT) AS end_line, concat(CAST(count(*) AS STRING), ' symbols') AS evidence FROM fx_src f JOIN fx_src_symbols s USING (repo_id, file_id)
WHERE regexp_matches(f.path, '(^|/)index\\.(ts|js|tsx|jsx)$') GROUP BY 1, 2
""")(lambda f, s: patterns.barrels(f, s).select("repo_id", "path", "end_line", "evidence"))  # fmt: skip
query("p6_god_files", "fx_symbol_files", "fx_symbols", body="""
WITH s AS (SELECT repo_id, concat(repo_id, '/', split_part(file_id, '/', 2)) AS file_id, count(*) AS n FROM fx_symbols WHERE kind IN ('function', 'method') GROUP BY 1, 2),
f AS (SELECT repo_id, concat(repo_id, '/', split_part(file_id, '/', 2)) AS file_id, CAST(max(line_count) * 3 AS INT) AS line_count FROM fx_symbol_files GROUP BY 1, 2)
SELECT f.repo_id, f.file_id AS path, coalesce(n, 0) AS n_functions, line_count, CASE WHEN coalesce(n, 0) > 15 THEN 'critical' ELSE 'warning' END AS severity FROM f LEFT JOIN s USING (repo_id, file_id) WHERE coalesce(n, 0) > 15 OR line_count > 500
""")(lambda f, s: patterns.god_files(
    f.groupBy("repo_id", F.concat_ws("/", "repo_id", F.split_part("file_id", F.lit("/"), F.lit(2))).alias("file_id")).agg((F.max("line_count") * 3).cast("int").alias("line_count")).withColumn("path", F.col("file_id")),
    s.withColumn("file_id", F.concat_ws("/", "repo_id", F.split_part("file_id", F.lit("/"), F.lit(2))))))
query("p7_circular_dependencies", "fx_src_symbols", "fx_src_relations", body="""
WITH c AS (SELECT DISTINCT a.repo_id, least(a.src, a.dst) AS x, greatest(a.src, a.dst) AS y FROM fx_src_relations a JOIN fx_src_relations b ON b.repo_id = a.repo_id AND b.src = a.dst AND b.dst = a.src WHERE a.relation_type = 'imports' AND b.relation_type = 'imports')
SELECT DISTINCT c.repo_id, least(p.path, q.path) AS path, concat(least(p.path, q.path), ' <-> ', greatest(p.path, q.path)) AS evidence FROM c JOIN fx_src_symbols p ON p.symbol_id = x JOIN fx_src_symbols q ON q.symbol_id = y
""")(lambda s, r: patterns.circular_dependencies(s, r).select("repo_id", "path", "evidence"))  # fmt: skip
query("p8_deep_nesting", "fx_src_symbols", body="""
SELECT repo_id, path, name AS symbol, start_line, end_line, 'depth 4' AS evidence FROM fx_src_symbols WHERE symbol_id LIKE '%:d3'
""")(lambda s: patterns.deep_nesting(s).select("repo_id", "path", "symbol", "start_line", "end_line", "evidence"))  # fmt: skip
query("p9_long_parameter_lists", "fx_src_symbols", body="""
SELECT repo_id, path, symbol, start_line FROM (SELECT repo_id, path, name AS symbol, start_line, row_number() OVER (PARTITION BY repo_id ORDER BY path, start_line, symbol_id) AS n FROM fx_src_symbols
 WHERE kind IN ('function', 'method') AND len(string_split(signature, ',')) > 5) WHERE n <= 50
""")(lambda s: patterns.long_parameter_lists(s).select("repo_id", "path", "symbol", "start_line"))  # fmt: skip
query("p10_dead_code", "fx_src_symbols", "fx_src_relations", body="""
SELECT repo_id, path, symbol, evidence FROM (SELECT repo_id, path, name AS symbol, kind AS evidence, row_number() OVER (PARTITION BY repo_id ORDER BY path, start_line, symbol_id) AS n FROM fx_src_symbols s
 WHERE NOT regexp_matches(path, '/index\\.|/main\\.|route\\.|page\\.|layout\\.|\\.test\\.|\\.spec\\.') AND NOT EXISTS (SELECT 1 FROM fx_src_relations r WHERE r.repo_id = s.repo_id AND r.dst = s.symbol_id)) WHERE n <= 50
""")(lambda s, r: patterns.dead_code(s, r).select("repo_id", "path", "symbol", "evidence"))  # fmt: skip
query("p12_missing_companions", "fx_src", body="""
WITH d AS (SELECT repo_id, regexp_replace(path, '/[^/]*$', '') AS d, bool_or(regexp_matches(path, '/service\\.[^/]*$')) AS s, bool_or(regexp_matches(path, '/(queries|repository)\\.[^/]*$')) AS q FROM fx_src WHERE path LIKE '%/%' GROUP BY 1, 2)
SELECT repo_id, concat(d, '/') AS path, concat(CAST(n AS STRING), ' service directories') AS evidence FROM (SELECT *, count(*) OVER (PARTITION BY repo_id) AS n FROM d WHERE s) WHERE n >= 3 AND NOT q
""")(lambda f: patterns.missing_companions(f).select("repo_id", "path", "evidence"))  # fmt: skip
query("p13_unhandled_routes", "fx_src", body="""
WITH r AS (SELECT repo_id, path, content LIKE '%try {%' OR content LIKE '%try{%' AS safe, content LIKE '%async%' OR content LIKE '%await%' AS waits FROM fx_src WHERE regexp_matches(path, '/route\\.(ts|js)$|route\\.tsx$')),
c AS (SELECT *, count(*) FILTER (safe) OVER (PARTITION BY repo_id) AS n, count(*) OVER (PARTITION BY repo_id) AS k FROM r)
SELECT repo_id, path, concat(CAST(n AS STRING), ' handle errors') AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path) AS place FROM c WHERE NOT safe AND waits AND n > 0 AND k >= 2) WHERE place <= 20
""")(lambda f: patterns.unhandled_routes(f).select("repo_id", "path", "evidence"))  # fmt: skip


def _all_patterns(f, c, s, r):
    return patterns.detect_patterns(f, c, s, r)


_VIEWS = ("fx_src", "fx_src_chunks", "fx_src_symbols", "fx_src_relations")
_plain("p14_detect_patterns", *_VIEWS)(_all_patterns)
def _report_sql() -> str:
    """The counts of each pattern's own query; naming mixes, which have none over these views, by the names with an underscore; no file here is a god class."""
    own = [
        ("p1_singletons", "singleton", "design-pattern", "info"), ("p2_factories", "factory", "design-pattern", "info"), ("p3_service_layers", "repository-service-layer", "design-pattern", "info"),
        ("p4_observers", "observer-event", "design-pattern", "info"), ("p5_barrels", "module-pattern", "design-pattern", "info"), ("p7_circular_dependencies", "circular-dependencies", "anti-pattern", "critical"),
        ("p8_deep_nesting", "deep-nesting", "anti-pattern", "warning"), ("p9_long_parameter_lists", "long-parameter-list", "anti-pattern", "warning"), ("p10_dead_code", "dead-code", "anti-pattern", "warning"),
        ("p12_missing_companions", "missing-service-queries-pattern", "inconsistency", "warning"), ("p13_unhandled_routes", "inconsistent-error-handling", "inconsistency", "warning"),
    ]
    each = [f"SELECT repo_id, '{name}' AS pattern_id, '{kind}' AS pattern_type, '{grade}' AS severity, count(*) AS n FROM ({SQL[query_name]}) GROUP BY 1" for query_name, name, kind, grade in own]
    mixes = sql("fx_src_symbols", body="SELECT repo_id, least(count(*), 20) AS n FROM fx_src_symbols WHERE contains(name, '_') GROUP BY 1")
    each.append(f"SELECT repo_id, 'naming-convention-mix', 'inconsistency', 'warning', CAST(n AS BIGINT) FROM ({mixes})")
    return " UNION ALL ".join(each)


QUERIES["p14_pattern_report"] = lambda spark, sf_dir: patterns.pattern_report(_all_patterns(*(frame(spark, sf_dir, v) for v in _VIEWS)))
SQL["p14_pattern_report"] = _report_sql()
_plain("p14_pattern_summary", *_VIEWS)(lambda f, c, s, r: patterns.pattern_summary(patterns.pattern_report(_all_patterns(f, c, s, r))))
query("p15_filter_patterns", "fx_src", "fx_src_chunks", "fx_src_symbols", "fx_src_relations", body="""
SELECT a.repo_id, 'circular-dependencies' AS pattern_id, count(DISTINCT concat(least(a.src, a.dst), greatest(a.src, a.dst))) AS n FROM fx_src_relations a JOIN fx_src_relations b ON b.repo_id = a.repo_id AND b.src = a.dst AND b.dst = a.src
 WHERE a.relation_type = 'imports' AND b.relation_type = 'imports' GROUP BY 1
""")(lambda f, c, s, r: patterns.filter_patterns(patterns.pattern_report(_all_patterns(f, c, s, r)), pattern_type="anti-pattern", severity="critical").select("repo_id", "pattern_id", "n"))  # fmt: skip
