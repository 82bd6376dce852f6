"""Queries of search, context, cross-repository relations, described changes, and the graphs of files and symbols."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import changes, crossrepo, domains, graph, health, inverted, lexical, relations, reports, retrieval, search, traverse, workspace
from ..operators.settled import settled
from ..sources import files as file_tables
from ..sources import index as source_index
from ..streaming import jobs
from .code import _matched, _plain
from .registry import _HEALTH, _IMPACT, _sources, query

# ---- search

_FUSED = """n AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM fx_candidates WINDOW w AS (PARTITION BY query_id, strategy)),
 z AS (SELECT *, CASE WHEN hi > lo THEN (score - lo) / (hi - lo)::DOUBLE WHEN hi > 0 THEN 1.0 ELSE 0.0 END AS x FROM n),
 f AS (SELECT query_id, chunk_id, file_path, token_count, round(least(1.0, coalesce(max(x) FILTER (strategy = 'semantic'), 0) * 0.45 + coalesce(max(x) FILTER (strategy = 'lexical'), 0) * 0.3
  + coalesce(max(x) FILTER (strategy = 'structural'), 0) * 0.25 + CASE WHEN count(DISTINCT strategy) >= 2 THEN 0.15 ELSE 0 END), 6) AS final FROM z GROUP BY 1, 2, 3, 4)"""


def _ranked(c):
    """Fused candidates with a range of lines for each, and their place."""
    rows = retrieval.fuse_rankings(c)
    start = F.pmod(F.col("chunk_id").cast("long"), F.lit(7)).cast("int")
    place = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY final DESC, chunk_id, file_path, token_count)")
    return rows.withColumns({"start_line": start, "end_line": start + 5, "place": place})


_PLACED = f"""{_FUSED}, p AS (SELECT *, CAST(CAST(chunk_id AS BIGINT) % 7 AS INT) AS start_line, CAST(CAST(chunk_id AS BIGINT) % 7 AS INT) + 5 AS end_line,
  row_number() OVER (PARTITION BY query_id ORDER BY final DESC, chunk_id, file_path, token_count) AS place FROM f),
 s AS (SELECT *, (place % 5 = 0) AS scoped FROM p),
 a AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_path, start_line ORDER BY place, chunk_id) AS k FROM s WHERE scoped),
 b AS (SELECT *, 100 + sum(token_count) OVER (PARTITION BY query_id ORDER BY place, chunk_id ROWS UNBOUNDED PRECEDING) AS so_far FROM a WHERE k = 1),
 first AS (SELECT * FROM b WHERE so_far <= 3000),
 u AS (SELECT q.query_id, coalesce(max(so_far), 100) AS used FROM (SELECT DISTINCT query_id FROM p) q LEFT JOIN first USING (query_id) GROUP BY 1),
 c AS (SELECT s.*, row_number() OVER (PARTITION BY s.query_id, s.file_path, s.start_line ORDER BY s.place, s.chunk_id) AS k FROM s
  WHERE NOT EXISTS (SELECT 1 FROM first t WHERE t.query_id = s.query_id AND t.file_path = s.file_path AND t.start_line = s.start_line)),
 d AS (SELECT c.*, used + sum(token_count) OVER (PARTITION BY c.query_id ORDER BY place, chunk_id ROWS UNBOUNDED PRECEDING) AS so_far FROM c JOIN u USING (query_id) WHERE k = 1)"""


def _packed(c):
    rows = _ranked(c)
    queries = rows.select("query_id").distinct().withColumn("repo_id", F.lit("r"))
    summaries = queries.sparkSession.range(1).select(F.lit("r").alias("repo_id"), F.repeat(F.lit("s"), F.lit(400)).alias("summary_text"))
    return search.pack_context(rows, queries, scoped=rows.where("place % 5 = 0"), summaries=summaries, budget=3000)


query("r18_pack_context", "fx_candidates", body=f"""WITH {_PLACED} SELECT 'scoped' AS part, query_id, chunk_id, token_count, CAST(so_far AS BIGINT) AS tokens_so_far FROM first
UNION ALL SELECT 'ranked', query_id, chunk_id, token_count, CAST(so_far AS BIGINT) FROM d WHERE so_far <= 3000""")(
    lambda c: _packed(c).select("part", "query_id", "chunk_id", "token_count", "tokens_so_far")
)
query("r19_render_context", "fx_candidates", body=f"""WITH {_PLACED}, e AS (SELECT 0 AS later, query_id, chunk_id, file_path, start_line, end_line, place FROM first UNION ALL SELECT 1, query_id, chunk_id, file_path, start_line, end_line, place FROM d WHERE so_far <= 3000),
 t AS (SELECT query_id, string_agg(concat('### File: ', file_path, ' (lines ', CAST(start_line AS STRING), '-', CAST(end_line AS STRING), ')', chr(10), '```sql', chr(10), 'c', chunk_id, chr(10), '```', chr(10)), chr(10) ORDER BY later, place, chunk_id) AS body FROM e GROUP BY 1)
SELECT q.query_id, concat('## Relevant Code (ordered by relevance)', chr(10), chr(10), coalesce(body, '')) AS context FROM (SELECT DISTINCT query_id FROM p) q LEFT JOIN t USING (query_id)""")(
    lambda c: search.render_context(
        _packed(c), c.select("chunk_id").distinct().withColumns({"content": F.concat(F.lit("c"), "chunk_id"), "language": F.lit("sql")}),
        c.select("query_id").distinct().withColumn("repo_id", F.lit("r")))
)
query("r22_low_confidence", "fx_candidates", body=f"WITH {_FUSED} SELECT query_id, max(final) < 0.7 AS low FROM f GROUP BY 1")(
    lambda c: search.low_confidence(retrieval.fuse_rankings(c), least=0.7)
)
query("r21_retrieval_trace", "fx_candidates", body=f"""WITH {_FUSED}, k AS (SELECT query_id, count(*) AS n_kept FROM f WHERE final >= 0.4 GROUP BY 1),
 g AS (SELECT query_id, sum(token_count) OVER (PARTITION BY query_id ORDER BY final DESC, chunk_id, file_path, token_count ROWS UNBOUNDED PRECEDING) AS t FROM f),
 h AS (SELECT query_id, count(*) AS n_packed, CAST(max(t) AS BIGINT) AS tokens FROM g WHERE t <= 3000 GROUP BY 1)
SELECT c.query_id, count(*) AS n_candidates, coalesce(any_value(n_kept), 0) AS n_kept, coalesce(any_value(n_packed), 0) AS n_packed, coalesce(any_value(tokens), 0) AS tokens
FROM fx_candidates c LEFT JOIN k USING (query_id) LEFT JOIN h USING (query_id) GROUP BY 1""")(
    lambda c: search.retrieval_trace(
        c, retrieval.fuse_rankings(c).where("final >= 0.4"),
        search.pack_context(_ranked(c).withColumns({"start_line": F.col("place"), "end_line": F.col("place")}), c.select("query_id", F.lit("r").alias("repo_id")).distinct(), budget=3000))
)
query("r12_drop_overlaps", "fx_candidates", body=f"""WITH RECURSIVE {_FUSED}, p AS (SELECT query_id, file_path, chunk_id, final, CAST(CAST(chunk_id AS BIGINT) % 7 AS INT) * 4 AS a,
  row_number() OVER (PARTITION BY query_id, file_path ORDER BY final DESC, chunk_id) AS i FROM f),
 w(query_id, file_path, i, kept) AS (SELECT query_id, file_path, 1, [a] FROM p WHERE i = 1
  UNION ALL SELECT p.query_id, p.file_path, p.i, CASE WHEN len(list_filter(w.kept, lambda b: least(p.a, b) + 5 - greatest(p.a, b) + 1 >= 3)) > 0 THEN w.kept ELSE list_append(w.kept, p.a) END
  FROM w JOIN p ON p.query_id = w.query_id AND p.file_path = w.file_path AND p.i = w.i + 1),
 k AS (SELECT p.*, len(w.kept) - coalesce(lag(len(w.kept)) OVER (PARTITION BY w.query_id, w.file_path ORDER BY w.i), 0) AS added FROM w JOIN p USING (query_id, file_path, i))
SELECT query_id, chunk_id, file_path, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, chunk_id, file_path) AS rank FROM k WHERE added = 1) WHERE rank <= 15""")(
    lambda c: reports.drop_overlaps(
        retrieval.fuse_rankings(c).withColumn("start_line", F.pmod(F.col("chunk_id").cast("long"), F.lit(7)).cast("int") * 4)
        .withColumns({"end_line": F.col("start_line") + 5, "score": F.col("final")})).select("query_id", "chunk_id", "file_path", "rank")
)

_WORDS = {d: ", ".join("'" + w.lower().replace("'", "''") + "'" for w in words) for d, words in domains.QUESTION_WORDS.items()}
_ASKED = "q AS (SELECT conv_id, turn, text, lower(text) AS low FROM conversations)"
_DOMAIN = ", ".join(f"len(list_filter([{words}], lambda w: contains(low, w))) AS {d}" for d, words in _WORDS.items())
query("r14_query_domain", "conversations", body=f"""
WITH {_ASKED}, n AS (SELECT conv_id, turn, {_DOMAIN} FROM q)
SELECT conv_id, turn, CASE greatest(security, frontend, backend, database, config, testing) WHEN 0 THEN NULL WHEN security THEN 'security' WHEN frontend THEN 'frontend' WHEN backend THEN 'backend'
 WHEN database THEN 'database' WHEN config THEN 'config' ELSE 'testing' END AS domain FROM n
""")(lambda c: c.select("conv_id", "turn", domains.question_domain(F.col("text")).alias("domain")))  # fmt: skip


def _domain_sql() -> str:
    parts = []
    for d, (paths, names, words) in domains.FILE_RULES.items():
        hits = [f"2.0 * CAST(contains(low, '{p.lower()}') AS INT)" for p in paths]
        for p in names:
            x = p.lower()
            if x.count("*") == 1:
                hits.append(f"3.0 * CAST(ends_with(low, '{x[1:]}') AS INT)")
            elif "*" in x:
                hits.append("3.0 * CAST(" + " AND ".join(f"contains(name, '{y}')" for y in x.split("*") if y) + " AS INT)")
            else:
                hits.append(f"3.0 * CAST(contains(low, '{x}') AS INT)")
        hits += [f"0.5 * CAST(contains(body, '{w.lower()}') AS INT)" for w in words]
        parts.append(f"SELECT *, '{d}' AS domain, {len(parts)} AS o, CAST({' + '.join(hits)} AS DOUBLE) AS score FROM base")
    return " UNION ALL ".join(parts)


_SCORED = f"""base AS (SELECT repo_id, file_id, path, lower(path) AS low, lower(split_part(path, '/', -1)) AS name, lower(content[1:2000]) AS body FROM fx_src), d AS ({_domain_sql()})"""
query("r13_domain_scores", "fx_src", body=f"WITH {_SCORED} SELECT repo_id, path, domain, score FROM d WHERE score > 0")(domains.domain_scores)
_BOOSTED = f"""{_SCORED}, t AS (SELECT repo_id, file_id, arg_max(domain, (score, -o)) AS top, max(score) AS best FROM d GROUP BY 1, 2),
 r AS (SELECT c.chunk_id, c.repo_id AS query_id, CASE c.repo_id WHEN 'r0' THEN 'backend' WHEN 'r1' THEN 'frontend' WHEN 'r2' THEN 'security' END AS query_domain, round(CAST(CAST(c.chunk_id AS BIGINT) % 100 AS DOUBLE) / 100, 6) AS final0, top, best
  FROM fx_src_chunks c JOIN t ON t.file_id = c.file_id)"""


def _with_scores(c):
    return c.select("chunk_id", F.col("repo_id").alias("query_id"), "file_path", "content", F.round(F.col("chunk_id").cast("long") % 100 / 100, 6).alias("final"))


def _questions(c):
    asked = F.create_map(*map(F.lit, ("r0", "an endpoint", "r1", "a react modal", "r2", "the password", "r3", "nothing")))
    return c.select(F.col("repo_id").alias("query_id")).distinct().withColumn("text", asked[F.col("query_id")])


query("r15_domain_boost", "fx_src", "fx_src_chunks", body=f"""WITH {_BOOSTED}
SELECT query_id, chunk_id, CASE WHEN best > 0 AND top = query_domain THEN round(least(1.0, final0 + 0.2), 6) ELSE final0 END AS final, CASE WHEN best > 0 AND top = query_domain THEN best ELSE 0.0 END AS domain_score FROM r
""")(lambda _, c: domains.domain_boost(_with_scores(c), _questions(c)).select("query_id", "chunk_id", "final", "domain_score"))  # fmt: skip
query("r16_domain_order", "fx_src", "fx_src_chunks", body=f"""WITH {_BOOSTED}
SELECT query_id, r.chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, final0 DESC, r.chunk_id) AS INT) AS place FROM r LEFT JOIN (SELECT file_id AS chunk_id, domain, score FROM d) x ON x.chunk_id = r.chunk_id AND x.domain = r.query_domain
""")(lambda _, c: domains.domain_order(_with_scores(c).join(
    _questions(c).select("query_id", domains.question_domain(F.col("text")).alias("query_domain")), "query_id")).select("query_id", "chunk_id", "place"))

_GRAM = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_WORDS = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"
_BM25 = "round(sum(ln(1 + (nc - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / ml))), 6)"
query("r5_lexical_with_fallback", "fx_src_chunks", "region", "benchmark", body=f"""
WITH q AS (SELECT r_regionkey AS query_id, concat('export function ', lower(r_name)) AS text FROM region UNION ALL SELECT 100 + r_regionkey, 'NextResponse users' FROM region WHERE r_regionkey < 2
 UNION ALL SELECT 1000 + item_id, text FROM benchmark),
t AS (SELECT chunk_id, {_WORDS.format('content')} AS terms, {_GRAM.format('content')} AS grams FROM fx_src_chunks),
p AS (SELECT chunk_id, n, term, count(*) AS tf FROM (SELECT chunk_id, len(terms) AS n, unnest(terms) AS term FROM t) GROUP BY ALL), tot AS (SELECT count(*) AS nc, avg(len(terms)) AS ml FROM t),
w AS (SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS nt FROM (SELECT query_id, unnest(list_distinct({_WORDS.format('text')})) AS term FROM q)),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query_id, chunk_id, nt, count(*) AS m, {_BM25} AS score FROM p JOIN w USING (term) JOIN df USING (term), tot GROUP BY 1, 2, 3),
e AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE m = nt) WHERE rank <= 20),
c AS (SELECT q.query_id, {_GRAM.format('text')} AS grams, (SELECT count(*) FROM e WHERE e.query_id = q.query_id) AS k FROM q),
g AS (SELECT c.query_id, t.chunk_id, k, len(list_intersect(c.grams, t.grams)) / (len(c.grams) + len(t.grams) - len(list_intersect(c.grams, t.grams)))::DOUBLE AS sim FROM c, t WHERE k < 20),
h AS (SELECT query_id, chunk_id, sim, k + row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM g WHERE sim > 0.1 AND NOT EXISTS (SELECT 1 FROM e WHERE e.query_id = g.query_id AND e.chunk_id = g.chunk_id))
SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM e UNION ALL SELECT query_id, chunk_id, round(sim * 0.5, 6), CAST(rank AS INT) FROM h WHERE rank <= 20
""")(lambda c, r, b: lexical.lexical_with_fallback(
    r.select(F.col("r_regionkey").cast("long").alias("query_id"), F.concat(F.lit("export function "), F.lower("r_name")).alias("text"))
    .unionByName(r.where("r_regionkey < 2").select((F.col("r_regionkey") + 100).cast("long").alias("query_id"), F.lit("NextResponse users").alias("text")))
    .unionByName(b.select((F.col("item_id") + 1000).alias("query_id"), "text")), c))


def _web_queries(b):
    """Of the first words of each benchmark text, in web syntax: the first two in a row or the third, and the fourth, and not the fifth; and the same without the last."""
    w = lexical.terms_of("text")
    some = b.select("item_id", *(F.get(w, F.lit(i)).alias(f"w{i + 1}") for i in range(5)))
    either = F.format_string('"%s %s" OR %s %s', "w1", "w2", "w3", "w4")
    return some.select(F.inline(F.array(
        F.struct((F.col("item_id") * 2).alias("query_id"), F.concat(either, F.lit(" -"), F.col("w5")).alias("text")), F.struct((F.col("item_id") * 2 + 1).alias("query_id"), either.alias("text"))
    )))


query("r3_web_search", "fx_chunks", "benchmark", body=f"""
WITH t AS (SELECT chunk_id, {_WORDS.format('content')} AS terms FROM fx_chunks),
pos AS (SELECT chunk_id, len(terms) AS n, unnest(terms) AS term, generate_subscripts(terms, 1) AS i FROM t),
p AS (SELECT chunk_id, n, term, count(*) AS tf FROM pos GROUP BY ALL), tot AS (SELECT count(*) AS nc, avg(len(terms)) AS ml FROM t), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
b AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
q AS (SELECT item_id * 2 AS query_id, w, w[5] AS no FROM b UNION ALL SELECT item_id * 2 + 1, w, NULL FROM b),
ph AS (SELECT DISTINCT query_id, x.chunk_id FROM q JOIN pos x ON x.term = w[1] JOIN pos y ON y.chunk_id = x.chunk_id AND y.term = w[2] AND y.i = x.i + 1),
m AS (SELECT q.query_id, d.chunk_id, list_distinct(CASE WHEN ph.chunk_id IS NULL THEN [] ELSE w[1:2] END || CASE WHEN c.chunk_id IS NULL THEN [] ELSE w[3:3] END || w[4:4]) AS terms
 FROM q JOIN p d ON d.term = w[4] LEFT JOIN ph ON ph.query_id = q.query_id AND ph.chunk_id = d.chunk_id LEFT JOIN p c ON c.term = w[3] AND c.chunk_id = d.chunk_id LEFT JOIN p e ON e.term = no AND e.chunk_id = d.chunk_id
 WHERE e.chunk_id IS NULL AND (ph.chunk_id IS NOT NULL OR c.chunk_id IS NOT NULL)),
s AS (SELECT query_id, chunk_id, {_BM25} AS score FROM (SELECT query_id, chunk_id, unnest(terms) AS term FROM m) JOIN p USING (chunk_id, term) JOIN df USING (term), tot GROUP BY 1, 2)
SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 20
""")(lambda c, b: lexical.lexical_topk(_web_queries(b), c.drop("repo_id")))  # fmt: skip


def _names(s):
    """Names asked for: symbols of part of the files as they are, upper-cased, parts of names, and unknown ones."""
    own = s.where("kind = 'function'")
    some = own.select("repo_id", F.concat(F.lit("q"), "file_id").alias("query_id"), F.when(F.col("file_id").cast("long") % 3 == 0, F.upper("name")).when(
        F.col("file_id").cast("long") % 3 == 1, F.substring("name", 2, 3)).otherwise(F.lit("zzz")).alias("name"))
    return some


_NAMES = """w AS (SELECT repo_id, concat('q', file_id) AS query_id, CASE CAST(file_id AS BIGINT) % 3 WHEN 0 THEN upper(name) WHEN 1 THEN name[2:4] ELSE 'zzz' END AS name FROM fx_src_symbols WHERE kind = 'function'),
 x AS (SELECT DISTINCT query_id, w.repo_id, symbol_id, s.name AS n, path, start_line FROM w JOIN fx_src_symbols s ON s.repo_id = w.repo_id AND lower(s.name) = lower(w.name)),
 y AS (SELECT DISTINCT query_id, w.repo_id, symbol_id, s.name AS n, path, start_line FROM w JOIN fx_src_symbols s ON s.repo_id = w.repo_id AND contains(lower(s.name), lower(w.name)) WHERE query_id NOT IN (SELECT query_id FROM x)),
 seeds AS (SELECT query_id, repo_id, symbol_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n, path, start_line, symbol_id) AS k FROM x) WHERE k <= 50
  UNION ALL SELECT query_id, repo_id, symbol_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n, path, start_line, symbol_id) AS k FROM y) WHERE k <= 30)"""
query("r7_seed_symbols", "fx_src_symbols", body=f"WITH {_NAMES} SELECT query_id, repo_id, symbol_id FROM seeds")(lambda s: search.seed_symbols(_names(s), s))
_BOTH = "(SELECT repo_id, src AS a, dst AS b FROM fx_src_relations UNION SELECT repo_id, dst, src FROM fx_src_relations)"
query("r9_structural_topk", "fx_src_symbols", "fx_src_relations", "fx_src_chunks", body=f"""WITH {_NAMES},
 h1 AS (SELECT DISTINCT query_id, s.repo_id, b AS symbol_id FROM seeds s JOIN {_BOTH} e ON e.repo_id = s.repo_id AND e.a = s.symbol_id),
 h2 AS (SELECT DISTINCT query_id, s.repo_id, b AS symbol_id FROM h1 s JOIN {_BOTH} e ON e.repo_id = s.repo_id AND e.a = s.symbol_id),
 r AS (SELECT query_id, repo_id, symbol_id, min(depth) AS depth FROM (SELECT *, 0 AS depth FROM seeds UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY 1, 2, 3),
 l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY depth, symbol_id) AS k FROM r) WHERE k <= 200),
 s AS (SELECT query_id, chunk_id, max(CASE depth WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0.3 END)::DOUBLE AS score FROM l JOIN fx_src_chunks c ON c.repo_id = l.repo_id AND c.symbol_id = l.symbol_id GROUP BY 1, 2)
SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 20""")(
    lambda s, r, c: search.structural_topk(_names(s), s, r, c)
)


def _corpus(c, s, r):
    from ..operators.chunks import embed_chunks

    return search.Corpus(c, embed_chunks(c).select("chunk_id", "embedding"), s, r, c.select("repo_id").distinct().withColumn("summary_text", F.lit("A repository.")))


def _embedded(queries):
    from ..operators.chunks import embed_chunks

    made = embed_chunks(queries.select(F.col("query_id").alias("chunk_id"), F.col("text").alias("content")))
    return queries.join(made.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")


def _asked(s, words: str = "where is `%s` defined"):
    """A question about every function, in its repository."""
    own = s.where("kind = 'function'")
    return _embedded(own.select("repo_id", F.concat(F.lit("q"), "file_id").alias("query_id"), F.format_string(words, "name").alias("text"), F.when(F.col("file_id").cast("long") % 2 == 0, F.col("path")).alias("scope_path")))


query("r17_file_scope_context", "fx_src_chunks", "fx_src_symbols", "fx_src_relations", body="""
WITH w AS (SELECT concat('q', file_id) AS query_id, repo_id, path AS p FROM fx_src_symbols WHERE kind = 'function' AND CAST(file_id AS BIGINT) % 2 = 0),
i AS (SELECT w.query_id, c.chunk_id, c.file_path, row_number() OVER (PARTITION BY w.query_id, a.path ORDER BY c.start_line, c.chunk_id) AS k FROM w JOIN fx_src_symbols b ON b.repo_id = w.repo_id AND b.path = w.p JOIN fx_src_relations r ON r.repo_id = w.repo_id AND r.dst = b.symbol_id
 JOIN fx_src_symbols a ON a.repo_id = w.repo_id AND a.symbol_id = r.src JOIN fx_src_chunks c ON c.repo_id = w.repo_id AND c.symbol_id = a.symbol_id WHERE a.path <> w.p AND r.relation_type IN ('imports', 'calls', 'uses'))
SELECT w.query_id, c.chunk_id, 1.0::DOUBLE AS score FROM w JOIN fx_src_chunks c ON c.repo_id = w.repo_id AND c.file_path = w.p
UNION ALL SELECT query_id, chunk_id, 0.7::DOUBLE FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY file_path) AS n FROM i WHERE k = 1) WHERE n <= 10
""")(lambda c, s, r: search.file_scope_context(
    s.where("kind = 'function' AND CAST(file_id AS BIGINT) % 2 = 0").select(F.concat(F.lit("q"), "file_id").alias("query_id"), "repo_id", F.col("path").alias("scope_path")),
    search.Corpus(c, c, s, r, c)).select("query_id", "chunk_id", "score"))
_SEARCHED = ("fx_src_chunks", "fx_src_symbols", "fx_src_relations")
_plain("r20_retrieve", *_SEARCHED)(lambda c, s, r: search.retrieve(_asked(s), _corpus(c, s, r))[0].select("query_id", "chunk_id", "file_path", "final", "rank", "query_domain"))
_plain("r20_packed", *_SEARCHED)(lambda c, s, r: search.retrieve(_asked(s), _corpus(c, s, r))[1])
_plain("r33_search", *_SEARCHED)(lambda c, s, r: search.search(_asked(s).drop("scope_path"), _corpus(c, s, r)))


def _vectors(text_column):
    """Vectors of a text as column functions: the counts of 64 places by the words' checksums."""
    places = F.transform(F.filter(F.split(F.lower(text_column), r"\W+"), lambda w: w != ""), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(256)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))


_plain("r37_role_context", *_SEARCHED)(lambda c, s, r: search.role_context(c.select("repo_id").distinct(), _vectors, _corpus(c, s, r)))
_plain("r38_discovery_context", *_SEARCHED)(lambda c, s, r: search.discovery_context(c.select("repo_id").distinct(), _vectors, _corpus(c, s, r)))
_plain("r2_semantic_topk_approx", "embeddings")(
    lambda e: inverted.semantic_topk_approx(
        e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("chunk_id"), "embedding"))
)

query("r23_multi_query_merge", "fx_candidates", body="""
WITH r AS (SELECT DISTINCT query_id % 50 AS question_id, query_id AS ordinal, file_path, CAST(CAST(chunk_id AS BIGINT) % 20 AS INT) AS start_line, chunk_id FROM fx_candidates),
k AS (SELECT *, row_number() OVER (PARTITION BY ordinal ORDER BY chunk_id, file_path) AS rank FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY question_id, file_path, start_line ORDER BY ordinal, rank) AS n FROM k)
SELECT question_id, ordinal, file_path, start_line, chunk_id, CAST(rank AS INT) AS rank, CAST(row_number() OVER (PARTITION BY question_id ORDER BY ordinal, rank) AS INT) AS place FROM o WHERE n = 1
""")(lambda c: search.multi_query_merge(c.select(
    (F.col("query_id") % 50).alias("question_id"), F.col("query_id").alias("ordinal"), "file_path", F.pmod(F.col("chunk_id").cast("long"), F.lit(20)).cast("int").alias("start_line"), "chunk_id").distinct()
    .withColumn("rank", F.expr("row_number() OVER (PARTITION BY ordinal ORDER BY chunk_id, file_path)"))))
_QUESTION = """q AS (SELECT p_partkey AS query_id, CASE p_partkey % 8 WHEN 0 THEN concat('where is the definition of ', p_name) WHEN 1 THEN concat('who calls ', p_name) WHEN 2 THEN concat('functions without ', p_name, ' in *.py')
 WHEN 3 THEN concat('code similar to ', p_name) WHEN 4 THEN concat('singleton ', p_name, ' in the api folder') WHEN 5 THEN concat('show me all ', p_name, ' typescript') WHEN 6 THEN concat('Explain ', p_name) ELSE p_name END AS text FROM part)"""


def _part_questions(p):
    k = F.col("p_partkey") % 8
    say = lambda a, b="": F.concat(F.lit(a), "p_name", F.lit(b))
    words = (
        F.when(k == 0, say("where is the definition of ")).when(k == 1, say("who calls ")).when(k == 2, say("functions without ", " in *.py")).when(k == 3, say("code similar to "))
        .when(k == 4, say("singleton ", " in the api folder")).when(k == 5, say("show me all ", " typescript")).when(k == 6, say("Explain ")).otherwise(F.col("p_name"))
    )
    return p.select(F.col("p_partkey").alias("query_id"), words.alias("text"))


query("r24_classify_queries", "part", body=f"""WITH {_QUESTION} SELECT query_id, CASE query_id % 8 WHEN 0 THEN 'find_definition' WHEN 1 THEN 'find_usage' WHEN 2 THEN 'find_missing' WHEN 3 THEN 'find_similar' WHEN 4 THEN 'find_pattern' WHEN 5 THEN 'find_code'
 WHEN 6 THEN 'find_code' ELSE CASE WHEN regexp_matches(text, '[A-Z][a-z]{{2,}}|[a-z][a-z0-9]*_[a-z0-9]|[a-z][a-z]*[0-9]') THEN 'find_code' ELSE 'general' END END AS intent FROM q""")(
    lambda p: search.classify_queries(_part_questions(p)).select("query_id", "intent")
)
query("r25_extract_filters", "part", body=f"""WITH {_QUESTION} SELECT query_id, CASE query_id % 8 WHEN 2 THEN '*.py' WHEN 4 THEN 'api/**' END AS path_glob, CASE WHEN contains(text, 'typescript') THEN 'typescript' WHEN contains(text, 'rust') THEN 'rust'
 WHEN contains(lower(text), 'go') THEN 'go' WHEN contains(text, 'java') THEN 'java' WHEN contains(text, 'ruby') THEN 'ruby' WHEN contains(text, 'php') THEN 'php' END AS query_language FROM q""")(
    lambda p: search.classify_queries(_part_questions(p)).select("query_id", "path_glob", "query_language")
)
query("r26_normalize_queries", "part", body=f"""WITH {_QUESTION} SELECT query_id, trim(regexp_replace(regexp_replace(trim(text), '(?i)\\b(?:where\\s+is|show\\s+(?:me\\s+)?(?:all\\s+)?)\\b', ' ', 'g'), '\\s{{2,}}', ' ', 'g')) AS normalized FROM q""")(
    lambda p: _part_questions(p).select("query_id", search.normalized_query(F.col("text")).alias("normalized"))
)
query("r34_search_suggestions", "part", body=f"""WITH {_QUESTION} SELECT query_id, CASE query_id % 4 WHEN 0 THEN 'Try: ''find all error handlers''|Try: ''where is N defined''' WHEN 1 THEN 'Try: ''where is N used''|Try: ''find all functions similar to N'''
 WHEN 2 THEN 'Try: ''where is N defined''' ELSE 'Try using specific function or class names|Try: ''find all API handlers''' END AS hints FROM q""")(
    lambda p: p.select(F.col("p_partkey").alias("query_id"), F.array_join(search.search_suggestions(
        F.element_at(F.array(*map(F.lit, ("find_missing", "find_definition", "find_usage", "general"))), (F.col("p_partkey") % 4 + 1).cast("int")), F.array(F.lit("N"))), "|").alias("hints"))
)
query("r29_find_missing", "fx_candidates", body=f"""WITH {_FUSED} SELECT query_id, chunk_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final, chunk_id) AS rank FROM (SELECT query_id, chunk_id, min(final) AS final FROM f GROUP BY 1, 2)) WHERE rank <= 2""")(
    lambda c: search.find_missing(retrieval.fuse_rankings(c).groupBy("query_id", "chunk_id").agg(F.min("final").alias("final")).withColumn("rank", F.lit(0)), limit=2).select("query_id", "chunk_id", "rank")
)
query("r30_match_reason", "fx_candidates", body="""
WITH s AS (SELECT query_id, chunk_id, coalesce(max(score) FILTER (strategy = 'semantic'), 0) AS v, coalesce(max(score) FILTER (strategy = 'lexical'), 0) AS k FROM fx_candidates GROUP BY 1, 2)
SELECT query_id, chunk_id, CASE WHEN v > k THEN 'semantic match' WHEN k > 0 THEN 'keyword match' ELSE 'structural match' END AS reason FROM s
""")(lambda c: c.groupBy("query_id", "chunk_id").agg(
    *(F.coalesce(F.max(F.when(F.col("strategy") == s, F.col("score"))), F.lit(0)).alias(s) for s in ("semantic", "lexical")))
    .select("query_id", "chunk_id", search.match_reason(F.col("semantic"), F.col("lexical")).alias("reason")))
query("r31_apply_result_filters", "fx_src_chunks", body="""
WITH g AS (SELECT * FROM (VALUES (1, '*.ts', NULL), (2, 'src/**/route.ts', 'typescript'), (3, NULL, 'java')) v(query_id, path_glob, query_language))
SELECT query_id, chunk_id FROM g, fx_src_chunks WHERE CASE query_id WHEN 1 THEN regexp_matches(file_path, '[^/]*\\.ts') WHEN 2 THEN regexp_matches(file_path, 'src/.*/route\\.ts') ELSE true END
 AND (query_language IS NULL OR contains(language, query_language) OR contains(query_language, language))
""")(lambda c: search.apply_result_filters(c.select("chunk_id", "file_path", "language", F.inline(F.array(
    *(F.struct(F.lit(i).alias("query_id"), F.lit(g).cast("string").alias("path_glob"), F.lit(w).cast("string").alias("query_language"))
      for i, g, w in ((1, "*.ts", None), (2, "src/**/route.ts", "typescript"), (3, None, "java"))))))).select("query_id", "chunk_id"))
query("r35_search_across_repos", "embeddings", body="""
WITH v AS (SELECT vec_id, concat('r', CAST(vec_id % 6 AS STRING)) AS repo_id, embedding::DOUBLE[] AS e FROM embeddings), w AS (SELECT DISTINCT repo_id, CASE WHEN repo_id < 'r4' THEN 'w0' ELSE 'w1' END AS workspace_id FROM v),
n AS (SELECT workspace_id, count(*) AS k FROM w GROUP BY 1), q AS (SELECT vec_id AS query_id, CASE WHEN vec_id % 100 = 0 THEN 'w0' ELSE 'w1' END AS workspace_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT workspace_id, query_id, repo_id, vec_id AS chunk_id, k, round(list_cosine_similarity(q.e, v.e), 6) AS similarity FROM q JOIN w USING (workspace_id) JOIN n USING (workspace_id) JOIN v USING (repo_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, repo_id ORDER BY similarity DESC, chunk_id) AS rank FROM s WHERE similarity >= 0.25),
p AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, query_id ORDER BY similarity DESC, repo_id, chunk_id) AS place FROM r WHERE rank <= ceil(30 / k) + 5)
SELECT workspace_id, query_id, repo_id, chunk_id, similarity, CAST(place AS INT) AS place FROM p WHERE place <= 30
""")(lambda e: search.search_across_repos(
    e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 100 == 0, "w0").otherwise("w1").alias("workspace_id"), F.col("embedding").alias("vector")),
    e.select(F.concat(F.lit("r"), (F.col("vec_id") % 6).cast("string")).alias("repo_id"), F.col("vec_id").alias("chunk_id"), "embedding"),
    e.select(F.concat(F.lit("r"), (F.col("vec_id") % 6).cast("string")).alias("repo_id")).distinct().withColumn("workspace_id", F.when(F.col("repo_id") < "r4", "w0").otherwise("w1"))))

# ---- repositories

_CALLED = """called AS (SELECT DISTINCT a.repo_id AS from_repo, b.repo_id AS to_repo, a.path AS from_path, b.path AS to_path FROM fx_src a JOIN fx_src b ON b.repo_id <> a.repo_id AND b.k = 1 AND a.k = 3
 AND contains(a.content, concat('/api/n', CAST(CAST(b.file_id AS BIGINT) % 10 AS STRING), '/d', b.file_id)))"""


def _calling(f):
    """fx_src in which a call names the route of the file 18 before, which lies in the repository before."""
    route = F.concat(F.lit("fetch('/api/n"), ((F.col("file_id").cast("long") - 18) % 10).cast("string"), F.lit("/d"), (F.col("file_id").cast("long") - 18).cast("string"), F.lit("')\n"))
    return f.withColumn("content", F.when(F.col("k") == 3, F.concat(route, "content")).otherwise(F.col("content")))


_CONSUMERS = r"""cf AS (SELECT repo_id, path, lower(CASE WHEN k = 3 THEN concat('fetch(''/api/n', CAST((CAST(file_id AS BIGINT) - 18) % 10 AS STRING), '/d', CAST(CAST(file_id AS BIGINT) - 18 AS STRING), ''')', chr(10), content) ELSE content END) AS low FROM fx_src),
 rt AS (SELECT repo_id, path, lower(concat('/', seg)) AS seg FROM (SELECT repo_id, path, CASE WHEN regexp_matches(path, '/api/[^/]+(/[^/]+)*?/route\.[jt]sx?$') THEN regexp_extract(path, '/(api/[^/]+(?:/[^/]+)*?)/route\.[jt]sx?$', 1)
  ELSE regexp_extract(path, '/routes/([^/]+)\.[jt]sx?$', 1) END AS seg FROM fx_src) WHERE seg <> ''),
 ac AS (SELECT DISTINCT cf.repo_id AS from_repo, rt.repo_id AS to_repo, cf.path AS from_path, rt.path AS to_path, seg AS name FROM cf JOIN rt ON cf.repo_id <> rt.repo_id AND contains(low, seg)
  WHERE contains(low, 'fetch(') OR contains(low, 'axios.') OR contains(low, 'http.get(') OR contains(low, '.get("/') OR contains(low, '.post("/') OR contains(low, '.put("/') OR contains(low, '.delete("/'))"""
query("k2_api_consumers", "fx_src", body=f"WITH {_CONSUMERS} SELECT * FROM ac")(
    lambda f: crossrepo.api_consumers(_calling(f)).select("from_repo", "to_repo", "from_path", "to_path", "name")
)


def _manifests(f):
    """A package.json for each repository: r1 is package @scope/pkg1 and needs that of r2, and so on."""
    number = F.substring("repo_id", 2, 5)
    name = F.concat(F.lit("@scope/pkg"), number)
    other = F.concat(F.lit("@scope/pkg"), ((number.cast("int") + 1) % 4).cast("string"))
    return f.select("repo_id").distinct().select("repo_id", F.to_json(F.struct(name.alias("name"), F.create_map(other, F.lit("^1")).alias("dependencies"))).alias("content"))


query("k6_import_patterns", "fx_src", body="""
SELECT DISTINCT repo_id AS from_repo, concat('r', x) AS to_repo, path AS from_path, concat('@scope/pkg', x) AS name FROM (SELECT repo_id, path, CAST(CAST(file_id AS BIGINT) % 10 AS STRING) AS x FROM fx_src WHERE k = 6) WHERE x < '4' AND concat('r', x) <> repo_id
""")(lambda f: crossrepo.import_patterns(f, _manifests(f)).select("from_repo", "to_repo", "from_path", "name"))  # fmt: skip
query("s14_read_manifests", "fx_src", body="SELECT DISTINCT repo_id, concat('@scope/pkg', repo_id[2:]) AS name FROM fx_src")(lambda f: crossrepo.package_names(_manifests(f)))


def _related(f, s):
    return crossrepo.cross_repo_relations(_calling(f), s, _manifests(f))


_TYPED = f"""{_CONSUMERS},
 t AS (SELECT repo_id AS from_repo, concat('r', x) AS to_repo, 'import-pattern' AS relation_type FROM (SELECT DISTINCT repo_id, path, CAST(CAST(file_id AS BIGINT) % 10 AS STRING) AS x FROM fx_src WHERE k = 6) WHERE x < '4' AND concat('r', x) <> repo_id
 UNION ALL SELECT DISTINCT repo_id, concat('r', CAST((CAST(repo_id[2:] AS INT) + 1) % 4 AS STRING)), 'npm-dependency' FROM fx_src
 UNION ALL SELECT from_repo, to_repo, 'api-consumer' FROM (SELECT from_repo, to_repo, row_number() OVER (PARTITION BY from_repo, to_repo ORDER BY from_path, to_path) AS n FROM ac) WHERE n <= 20
 UNION ALL SELECT from_repo, to_repo, 'shared-type' FROM (SELECT *, row_number() OVER (PARTITION BY from_repo, to_repo ORDER BY name) AS n FROM (SELECT DISTINCT a.repo_id AS from_repo, b.repo_id AS to_repo, a.name FROM fx_symbols a JOIN fx_symbols b ON a.name = b.name AND a.kind = b.kind AND a.repo_id < b.repo_id WHERE a.kind IN ('interface', 'type', 'class', 'enum'))) WHERE n <= 30)"""
query("k7_relation_summary", "fx_src", "fx_symbols", body=f"""WITH {_TYPED}
SELECT from_repo, to_repo, count(*) AS n, count(*) FILTER (relation_type = 'api-consumer') AS n_api_consumer, count(*) FILTER (relation_type = 'shared-type') AS n_shared_type, count(*) FILTER (relation_type = 'npm-dependency') AS n_npm_dependency,
 count(*) FILTER (relation_type = 'shared-module') AS n_shared_module, count(*) FILTER (relation_type = 'import-pattern') AS n_import_pattern FROM t WHERE to_repo IN (SELECT repo_id FROM fx_src) GROUP BY 1, 2""")(
    lambda f, s: crossrepo.relation_summary(_related(f, s))
)
query("k8_filter_relations", "fx_src", "fx_symbols", body=f"""WITH {_TYPED} SELECT from_repo, to_repo, relation_type, count(*) AS n_pair FROM t WHERE relation_type = 'npm-dependency' AND to_repo IN (SELECT repo_id FROM fx_src) GROUP BY 1, 2, 3""")(
    lambda f, s: crossrepo.filter_relations(_related(f, s), "npm-dependency").groupBy("from_repo", "to_repo", "relation_type").agg(F.count("*").alias("n_pair"))
)

# ---- described changes

_SAID = """c AS (SELECT concat('c', file_id) AS change_id, repo_id, file_id, path, name, CASE CAST(file_id AS BIGINT) % 6 WHEN 0 THEN 'remove' WHEN 1 THEN 'split' WHEN 2 THEN 'modify' WHEN 3 THEN 'add' WHEN 4 THEN 'replace' ELSE 'modify' END AS change_type FROM fx_src_symbols WHERE kind = 'function')"""


def _described(s):
    k = F.col("file_id").cast("long") % 6
    verb = F.element_at(F.array(*map(F.lit, ("Remove", "split", "please rework", "create", "swap", "look at"))), (k + 1).cast("int"))
    words = F.concat(verb, F.lit(" "), "name", F.lit(" in  "), F.element_at(F.split("path", "/"), -1), F.lit(" and the billing service"))
    return changes.parse_change(s.where("kind = 'function'").select(F.concat(F.lit("c"), "file_id").alias("change_id"), "repo_id", words.alias("text")))


query("v1_parse_change", "fx_src_symbols", body=f"WITH {_SAID} SELECT change_id, change_type, CASE WHEN path LIKE '%/service.ts' THEN 'in|billing' ELSE 'billing' END AS modules FROM c")(
    lambda s: _described(s).select("change_id", "change_type", F.array_join("modules", "|").alias("modules"))
)


def _of_names(s):
    """Parsed changes that name a symbol only."""
    none = F.array().cast("array<string>")
    return _described(s).withColumns({"files": none, "modules": none, "names": F.array(F.regexp_extract("text", r"(\w+) in  ", 1))})


_HIT = f"""{_SAID}, f AS (SELECT change_id, repo_id, symbol_id, path FROM (SELECT change_id, c.repo_id, s.symbol_id, s.path, row_number() OVER (PARTITION BY change_id ORDER BY s.path, s.start_line, s.symbol_id) AS n FROM c
 JOIN fx_src_symbols s ON s.repo_id = c.repo_id AND lower(s.name) = lower(c.name)) WHERE n <= 20)"""
query("v2_resolve_targets", "fx_src", "fx_src_symbols", body=f"WITH {_HIT} SELECT change_id, symbol_id, path FROM f")(
    lambda f, s: changes.resolve_targets(_of_names(s), f, s)[1].select("change_id", "symbol_id", "path")
)
_REACHED = f"""{_HIT}, a1 AS (SELECT DISTINCT f.change_id, r.repo_id, r.src AS node FROM f JOIN fx_src_relations r ON r.repo_id = f.repo_id AND r.dst = f.symbol_id),
 a2 AS (SELECT DISTINCT a.change_id, r.repo_id, r.src AS node FROM a1 a JOIN fx_src_relations r ON r.repo_id = a.repo_id AND r.dst = a.node), a3 AS (SELECT DISTINCT a.change_id, r.repo_id, r.src AS node FROM a2 a JOIN fx_src_relations r ON r.repo_id = a.repo_id AND r.dst = a.node),
 z AS (SELECT change_id, repo_id, node, min(d) AS d FROM (SELECT change_id, repo_id, symbol_id AS node, 0 AS d FROM f UNION ALL SELECT *, 1 FROM a1 UNION ALL SELECT *, 2 FROM a2 UNION ALL SELECT *, 3 FROM a3) GROUP BY 1, 2, 3),
 i AS (SELECT z.change_id, CASE d WHEN 1 THEN 'direct' ELSE 'indirect' END AS scope, s.path, z.node AS symbol_id, CASE WHEN change_type = 'remove' AND d > 1 THEN 'warning' WHEN change_type IN ('remove', 'replace') THEN 'break' WHEN change_type = 'add' THEN 'info' ELSE 'warning' END AS severity,
  d = 1 AND change_type IN ('remove', 'move', 'split', 'replace') AS breaks FROM z JOIN c USING (change_id) JOIN fx_src_symbols s ON s.repo_id = z.repo_id AND s.symbol_id = z.node WHERE d > 0),
 items AS (SELECT * FROM i UNION ALL SELECT DISTINCT f.change_id, 'direct', f.path, NULL, 'info', false FROM f JOIN c USING (change_id) WHERE change_type <> 'add' AND NOT EXISTS (SELECT 1 FROM i WHERE i.change_id = f.change_id AND i.path = f.path AND scope = 'direct'))"""
_CHANGED = ("fx_src", "fx_src_symbols", "fx_src_relations")
query("v3_affected_items", *_CHANGED, body=f"WITH {_REACHED} SELECT change_id, scope, path, symbol_id, severity, breaks FROM items")(
    lambda f, s, r: changes.affected_items(_of_names(s), f, s, r)
)
query("v4_potential_breaks", *_CHANGED, body=f"WITH {_REACHED} SELECT change_id, path, symbol_id FROM items WHERE breaks")(
    lambda f, s, r: changes.potential_breaks(changes.affected_items(_of_names(s), f, s, r))
)
query("v5_change_risk", *_CHANGED, body=f"""WITH {_REACHED}, n AS (SELECT c.change_id, count(*) FILTER (scope = 'direct') AS a, count(*) FILTER (breaks) AS b FROM c LEFT JOIN items USING (change_id) GROUP BY 1)
SELECT change_id, a AS n_direct, b AS n_breaks, CASE WHEN b > 10 OR a > 30 THEN 'critical' WHEN b > 4 OR a > 10 THEN 'high' WHEN b > 0 OR a > 2 THEN 'medium' ELSE 'low' END AS risk,
 CASE WHEN a > 30 THEN 'epic' WHEN a > 15 THEN 'large' WHEN a > 5 THEN 'medium' WHEN a > 0 THEN 'small' ELSE 'trivial' END AS effort FROM n""")(
    lambda f, s, r: changes.change_risk(_of_names(s), changes.affected_items(_of_names(s), f, s, r))
)

# ---- graphs

_FILE_EDGES = """e AS (SELECT r.repo_id, a.path AS s, b.path AS t, relation_type, count(*) AS n FROM fx_src_relations r JOIN fx_src_symbols a ON a.symbol_id = r.src AND a.repo_id = r.repo_id
 JOIN fx_src_symbols b ON b.symbol_id = r.dst AND b.repo_id = r.repo_id WHERE a.path <> b.path GROUP BY ALL),
 d AS (SELECT repo_id, node, sum(i) AS i, sum(o) AS o FROM (SELECT repo_id, s AS node, 0 AS i, n AS o FROM e UNION ALL SELECT repo_id, t, n, 0 FROM e) GROUP BY 1, 2),
 k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY i + o DESC, node) AS place FROM d) WHERE place <= 150)"""
_GRAPH = ("fx_src_symbols", "fx_src_relations", "fx_src")
query("g11_file_graph_nodes", *_GRAPH, body=f"""WITH {_FILE_EDGES}, w AS (SELECT k.*, f.line_count AS v, least(min(f.line_count) OVER (PARTITION BY k.repo_id), 0) AS lo, greatest(max(f.line_count) OVER (PARTITION BY k.repo_id), 1) AS hi FROM k JOIN fx_src f ON f.repo_id = k.repo_id AND f.path = k.node)
SELECT repo_id, node, split_part(node, '/', -1) AS label, split_part(node, '/', 1) AS "group", CAST(i AS BIGINT) AS in_degree, CAST(o AS BIGINT) AS out_degree, CAST(floor(1 + (v - lo) / CAST(hi - lo AS DOUBLE) * 9 + 0.5) AS INT) AS size FROM w""")(
    lambda s, r, f: graph.build_graph(s, r, f, level="file")[0]
)
query("g11_file_graph_edges", *_GRAPH, body=f"""WITH {_FILE_EDGES} SELECT repo_id, s AS source, t AS target, relation_type AS kind, CAST(CASE WHEN n >= 10 THEN 5 WHEN n >= 5 THEN 4 WHEN n >= 3 THEN 3 WHEN n >= 2 THEN 2 ELSE 1 END AS INT) AS weight FROM e
WHERE (repo_id, s) IN (SELECT (repo_id, node) FROM k) AND (repo_id, t) IN (SELECT (repo_id, node) FROM k)""")(lambda s, r, f: graph.build_graph(s, r, f, level="file")[1])
query("g11_symbol_graph_nodes", *_GRAPH, body="""WITH d AS (SELECT repo_id, node, sum(i) AS i, sum(o) AS o FROM (SELECT repo_id, src AS node, 0 AS i, 1 AS o FROM fx_src_relations UNION ALL SELECT repo_id, dst, 1, 0 FROM fx_src_relations) GROUP BY 1, 2),
 k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY i + o DESC, node) AS place FROM d) WHERE place <= 150)
SELECT k.repo_id, node, name AS label, split_part(path, '/', 1) AS "group", CAST(i AS BIGINT) AS in_degree, CAST(o AS BIGINT) AS out_degree FROM k JOIN fx_src_symbols s ON s.repo_id = k.repo_id AND s.symbol_id = k.node""")(
    lambda s, r, f: graph.build_graph(s, r, f, level="symbol")[0].drop("size")
)
query("g13_impact_of_files", "fx_src_symbols", "fx_src_relations", body="""
WITH RECURSIVE w(repo_id, source, node, depth) AS (SELECT repo_id, path, symbol_id, 0 FROM fx_src_symbols UNION SELECT w.repo_id, w.source, r.src, depth + 1 FROM w JOIN fx_src_relations r ON r.repo_id = w.repo_id AND r.dst = w.node WHERE depth < 4),
m AS (SELECT repo_id, source, node, min(depth) AS depth FROM w GROUP BY 1, 2, 3) SELECT repo_id, source, node, depth FROM m WHERE depth > 0
""")(lambda s, r: traverse.impact_of_files(s, s, r).select("repo_id", "source", "node", "depth"))  # fmt: skip
query("g19_sort_impact", "fx_src_symbols", "fx_src_relations", body=f"""{_IMPACT} SELECT repo_id, source, node, CAST(row_number() OVER (PARTITION BY repo_id, source ORDER BY risk DESC, node) AS INT) AS place FROM scored WHERE depth = 1""")(
    lambda s, r: traverse.sort_impact(traverse.impact(_sources(r), s, r, max_depth=1), level="direct").select("repo_id", "source", "node", "place")
)
query("g23_api_flow_edges", "fx_src_symbols", "fx_src_relations", body="""
SELECT DISTINCT r.repo_id, a.path AS from_path, b.path AS to_path, CASE WHEN b.path LIKE '%queries%' OR b.path LIKE '%schema%' OR b.path LIKE '%db%' THEN 'database' ELSE 'file' END AS target_kind FROM fx_src_relations r JOIN fx_src_symbols a ON a.symbol_id = r.src AND a.repo_id = r.repo_id
JOIN fx_src_symbols b ON b.symbol_id = r.dst AND b.repo_id = r.repo_id WHERE a.path LIKE '%/api/%' AND a.path <> b.path
""")(graph.api_flow_edges)  # fmt: skip
query("g24_diagram_edges", "fx_src_symbols", "fx_src_relations", body="""
WITH m AS (SELECT r.repo_id, regexp_replace(a.path, '/[^/]*$', '') AS x, regexp_replace(b.path, '/[^/]*$', '') AS y FROM fx_src_relations r JOIN fx_src_symbols a ON a.symbol_id = r.src AND a.repo_id = r.repo_id JOIN fx_src_symbols b ON b.symbol_id = r.dst AND b.repo_id = r.repo_id),
e AS (SELECT repo_id, array_to_string(string_split(x, '/')[1:3], '/') AS source, array_to_string(string_split(y, '/')[1:3], '/') AS target, count(*) AS n FROM m GROUP BY ALL)
SELECT repo_id, source, target, CASE WHEN n > 1 THEN CAST(n AS STRING) END AS label, CASE WHEN n > 5 THEN 'thick' WHEN n > 1 THEN 'labelled' ELSE 'plain' END AS style FROM e WHERE source <> target
""")(lambda s, r: graph.diagram_tables("module-dependency", s, r)[1])  # fmt: skip
query("g24_component_nodes", "fx_symbols", "fx_relations", body="SELECT repo_id, symbol_id AS node, name AS label, kind AS node_type FROM fx_symbols WHERE kind IN ('class', 'interface', 'type')")(
    lambda s, r: graph.diagram_tables("component", s, r)[0]
)
query("g26_nesting_depth", "fx_src_symbols", body="""
SELECT repo_id, symbol_id, CASE WHEN symbol_id LIKE '%:d1' THEN 2 WHEN symbol_id LIKE '%:d2' THEN 3 WHEN symbol_id LIKE '%:d3' THEN 4 ELSE 1 END AS depth FROM fx_src_symbols
""")(graph.nesting_depth)  # fmt: skip
query("g28_trace_flow", "fx_src_symbols", "fx_src_relations", "fx_src_chunks", body="""
WITH RECURSIVE w(repo_id, source, node, depth) AS (SELECT repo_id, symbol_id, symbol_id, 0 FROM fx_src_symbols WHERE kind = 'function' UNION SELECT w.repo_id, w.source, r.dst, depth + 1 FROM w JOIN fx_src_relations r ON r.repo_id = w.repo_id AND r.src = w.node WHERE depth < 5),
m AS (SELECT repo_id, source, node, min(depth) AS depth FROM w GROUP BY 1, 2, 3) SELECT m.repo_id, m.source, m.node, m.depth, s.name, c.content AS code FROM m JOIN fx_src_symbols s ON s.repo_id = m.repo_id AND s.symbol_id = m.node JOIN fx_src_chunks c ON c.repo_id = m.repo_id AND c.symbol_id = m.node
""")(lambda s, r, c: traverse.trace_flow(s.where("kind = 'function'").select("repo_id", F.col("symbol_id").alias("source")), s, r, c).select("repo_id", "source", "node", "depth", "name", "code"))  # fmt: skip
query("g29_resolve_symbols", "fx_src_symbols", body=f"""WITH {_NAMES}, u AS (SELECT DISTINCT repo_id, name AS wanted FROM w), e AS (SELECT u.repo_id, wanted, min((s.name, s.symbol_id)) AS b FROM u JOIN fx_src_symbols s ON s.repo_id = u.repo_id AND s.name = wanted GROUP BY 1, 2),
 p AS (SELECT u.repo_id, wanted, min((s.name, s.symbol_id)) AS b FROM u JOIN fx_src_symbols s ON s.repo_id = u.repo_id AND contains(lower(s.name), lower(wanted)) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.repo_id = u.repo_id AND e.wanted = u.wanted) GROUP BY 1, 2)
SELECT repo_id, wanted, b[2] AS symbol_id FROM e UNION ALL SELECT repo_id, wanted, b[2] FROM p""")(
    lambda s: relations.resolve_symbols(_names(s).select("repo_id", F.col("name").alias("wanted")).distinct(), s)
)

# ---- files, timelines, overviews, annotations

_HEALTHY = ("fx_symbol_files", "fx_symbols", "fx_relations", "fx_symbol_chunks")
query("h9_sort_files", *_HEALTHY, body=f"""WITH {_HEALTH} SELECT repo_id, path, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY cx DESC, path) AS place FROM h) WHERE place <= 25""")(
    lambda f, s, r, c: health.sort_files(health.file_health(f, s, r, c), by="complexity", descending=True, limit=25).select("repo_id", "path", "place")
)
query("h11_find_files", *_HEALTHY, body=f"""WITH {_HEALTH} SELECT repo_id, path, total, CAST(place AS INT) AS place FROM (SELECT *, count(*) OVER (PARTITION BY repo_id) AS total, row_number() OVER (PARTITION BY repo_id ORDER BY line_count DESC, path) AS place FROM h
 WHERE contains(lower(path), 'brand#1') OR contains(coalesce(language, ''), 'brand#1')) WHERE place BETWEEN 6 AND 10""")(
    lambda f, s, r, c: health.find_files(health.file_health(f, s, r, c), "Brand#1", by="line_count", descending=True, page=1, page_size=5).select("repo_id", "path", "total", "place")
)
query("t4_filter_timeline", "orders", body="SELECT o_orderkey AS sha FROM orders WHERE o_orderstatus IN ('O', 'F') AND (o_orderpriority[1:1] = '1' OR o_orderstatus = 'F')")(
    lambda o: workspace.filter_timeline(o.select(F.col("o_orderkey").alias("sha"), F.col("o_orderstatus").alias("level"), F.array(F.left("o_orderpriority", F.lit(1)), "o_orderstatus").alias("tags")), levels=["O", "F"], tags=["1", "F"]).select("sha")
)
query("o4_validate_references", "fx_src_symbols", "fx_src", body="""
SELECT repo_id, path, name FROM (SELECT repo_id, CASE CAST(file_id AS BIGINT) % 2 WHEN 0 THEN path ELSE concat(path, 'x') END AS path, name FROM fx_src_symbols WHERE CAST(file_id AS BIGINT) % 2 = 0)
""")(lambda s, f: workspace.validate_references(s.select("repo_id", F.when(F.col("file_id").cast("long") % 2 == 0, F.col("path")).otherwise(F.concat("path", F.lit("x"))).alias("path"), "name"), f, s).select("repo_id", "path", "name"))  # fmt: skip
query("o5_suggest_flows", "fx_src_symbols", "fx_src_relations", body="""
WITH g AS (SELECT repo_id, src AS symbol_id, count(*) AS d FROM fx_src_relations GROUP BY 1, 2), e AS (SELECT repo_id, symbol_id, name, path, 0 AS source, row_number() OVER (PARTITION BY repo_id ORDER BY path, name, symbol_id) AS n FROM fx_src_symbols WHERE (path LIKE '%/api/%' OR path LIKE '%route.ts%') AND name IN ('GET', 'POST')
 UNION ALL SELECT s.repo_id, s.symbol_id, name, path, 1, row_number() OVER (PARTITION BY s.repo_id ORDER BY d DESC, path, name, s.symbol_id) FROM fx_src_symbols s JOIN g ON g.repo_id = s.repo_id AND g.symbol_id = s.symbol_id WHERE d >= 2
 UNION ALL SELECT repo_id, symbol_id, name, path, 2, row_number() OVER (PARTITION BY repo_id ORDER BY path, name, symbol_id) FROM fx_src_symbols WHERE path LIKE '%service%' AND kind IN ('function', 'method', 'class')),
o AS (SELECT *, row_number() OVER (PARTITION BY repo_id, name, path ORDER BY source, n, symbol_id) AS k FROM e WHERE n <= 5)
SELECT repo_id, CAST(place AS INT) AS place, source, symbol_id, name, path FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY source, n) AS place FROM o WHERE k = 1) WHERE place <= 10
""")(workspace.suggest_flows)  # fmt: skip
query("n2_thread_detail", "lineitem", body="SELECT l_orderkey AS thread_id, count(*) AS n, array_to_string(list(CAST(l_linenumber AS STRING) ORDER BY l_shipdate, l_linenumber), ',') AS lines FROM lineitem GROUP BY 1")(
    lambda l: reports.thread_detail(l.select(F.col("l_orderkey").alias("thread_id"), F.col("l_shipdate").alias("created_at"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0").alias("author"), F.col("l_linenumber").cast("string").alias("text")))
    .select("thread_id", F.size("comments").cast("long").alias("n"), F.array_join(F.transform("comments", lambda c: c["text"]), ",").alias("lines"))
)
query("n5_bookmarks_by_file", "orders", "documents", body="""
WITH b AS (SELECT o_custkey % 50 AS user_id, concat('f', CAST(o_orderkey % 7 AS STRING)) AS file_path, o_orderpriority AS title, CASE WHEN o_orderkey % 3 = 0 THEN text[1:300] END AS note, o_orderkey AS created_at FROM orders LEFT JOIN documents ON doc_id = o_orderkey)
SELECT user_id, file_path, count(*) AS n, array_to_string(list(title ORDER BY created_at DESC, title DESC), '|') AS titles FROM b
WHERE contains(lower(title), 'high') OR contains(lower(file_path), 'high') OR contains(lower(coalesce(note, '')), 'high') GROUP BY 1, 2
""")(lambda o, d: reports.bookmarks_by_file(
    o.join(d, o["o_orderkey"] == d["doc_id"], "left").select(
        (F.col("o_custkey") % 50).alias("user_id"), F.concat(F.lit("f"), (F.col("o_orderkey") % 7).cast("string")).alias("file_path"), F.col("o_orderpriority").alias("title"),
        F.when(F.col("o_orderkey") % 3 == 0, F.substring("text", 1, 300)).alias("note"), F.col("o_orderkey").alias("created_at")), "HIGH").withColumn("titles", F.array_join("titles", "|")))
query("o6_progress", "lineitem", body="""
WITH p AS (SELECT l_suppkey AS user_id, arg_max(l_linenumber, (l_shipdate, l_orderkey, l_linenumber)) AS steps FROM lineitem GROUP BY 1) SELECT user_id, CAST(round(steps * 100 / 8.0) AS INT) AS percent FROM p
""")(lambda l: reports.progress(l.select(
    F.col("l_suppkey").alias("user_id"), F.lit("r").alias("repo_id"), F.lit("dev").alias("role"), F.sequence(F.lit(1), F.col("l_linenumber").cast("int")).alias("completed_steps"),
    F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("updated_at")), 8).select("user_id", "percent"))
query("x5_path_index", "fx_src", body="""
WITH p AS (SELECT repo_id, path, string_split(regexp_replace(path, '\\.(ts|tsx|js|jsx|mjs|cjs|py|go|rs|java|rb|php|kt|swift|cs|scala)$', ''), '/') AS s FROM fx_src)
SELECT DISTINCT repo_id, array_to_string(s[i:], '/') AS key, path AS target FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM p)
UNION SELECT repo_id, array_to_string(s[:-2], '/'), path FROM p WHERE s[-1] = 'index' AND len(s) > 1 UNION SELECT repo_id, s[-2], path FROM p WHERE s[-1] = 'index' AND len(s) > 1
""")(relations.path_index)  # fmt: skip
query("x7_build_relations", "fx_src", "fx_src_symbols", body="""
SELECT DISTINCT a.repo_id, concat(a.file_id, ':f') AS src, concat(b.file_id, ':f') AS dst, 'imports' AS relation_type FROM fx_src a JOIN fx_src b ON b.repo_id = a.repo_id AND a.k = 7 AND b.k = 6 AND b.g = a.g WHERE a.path LIKE 'src/mod/%' OR a.path LIKE 'src/lib/%'
""")(lambda c, s: relations.build_relations(
    s.where("kind = 'function'"),
    c.where("k = 7").select("repo_id", "path", F.concat(F.lit("../../mod/g"), F.col("g").cast("string"), F.lit("/service")).alias("source"), F.array(F.lit("build")).alias("names")),
    c.where("k = 6").select("repo_id", "path", F.lit("build").alias("name")), c))

# ---- lines of version control, snapshots, manifests

query("s11_parse_commits", "orders", body="""
SELECT CAST(o_orderkey AS STRING) AS sha, CAST(o_custkey AS STRING) AS date, o_orderstatus AS author, concat('a|', o_orderpriority) AS subject FROM orders
""")(lambda o: file_tables.parse_commits(o.select(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", F.lit("a"), "o_orderpriority").alias("value"))))  # fmt: skip
query("s12_parse_numstat", "lineitem", body="""
SELECT concat('p', CAST(l_partkey AS STRING), chr(9), 'q') AS path, CASE WHEN l_linenumber = 1 THEN 0 ELSE CAST(l_quantity AS INT) END AS additions, CAST(l_linenumber AS INT) AS deletions FROM lineitem
""")(lambda l: file_tables.parse_numstat(l.select(F.concat_ws(
    "\t", F.when(F.col("l_linenumber") == 1, "-").otherwise(F.col("l_quantity").cast("int").cast("string")), "l_linenumber", F.concat(F.lit("p"), "l_partkey"), F.lit("q")).alias("value"))))
query("s13_parse_hunks", "lineitem", body="""
SELECT CAST(line AS INT) AS line, count(*) AS n FROM (SELECT unnest(range(l_partkey, l_partkey + CASE WHEN l_linenumber = 2 THEN 1 ELSE greatest(l_linenumber - 1, 1) END)) AS line FROM lineitem) GROUP BY 1
""")(lambda l: file_tables.parse_hunks(l.select(F.concat(
    F.lit("@@ -1,2 +"), "l_partkey", F.when(F.col("l_linenumber") == 2, "").otherwise(F.concat(F.lit(","), (F.col("l_linenumber") - 1).cast("string"))), F.lit(" @@")).alias("value")))
    .groupBy("line").agg(F.count("*").alias("n")))
query("s3_drop_binary", "documents", body="SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 OR strlen(text) >= 8192")(
    lambda d: file_tables.drop_binary(d.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(F.encode("text", "UTF-8"), F.lit(b"\0"))).otherwise(F.encode("text", "UTF-8")).alias("bytes"))).select("doc_id")
)


def _snapshots(f):
    """Two states of fx_src: without every third file and with another first line in every fifth, and as it is."""
    n = F.col("file_id").cast("long")
    files = f.select("repo_id", "path", "content")
    return f.where(n % 3 != 0).select("repo_id", "path", F.when(n % 5 == 0, F.concat(F.lit("// export function old() {}\n"), "content")).otherwise(F.col("content")).alias("content")), files


def _second(f, name):
    """A table of the index after both states."""
    first, last = _snapshots(f)
    tables = {k: settled(v) for k, v in source_index.derived(first).items() if k != "chunks"}
    if name == "relations":
        tables[name] = settled(source_index.related(tables))
    fresh, gone = source_index.advance(tables, last)
    return source_index.applied(tables, fresh, gone)[name]


query("s7_apply_snapshot", "fx_src", body=f"""
WITH {_matched(None, ('import', 'export'))}
SELECT repo_id, path, name, kind, start_line, trim(line) AS signature FROM (
 SELECT *, row_number() OVER (PARTITION BY repo_id, file_id, start_line, name ORDER BY ordinal) AS n FROM m WHERE name <> '') WHERE n = 1
""")(lambda f: _second(f, "symbols").select("repo_id", "path", "name", "kind", "start_line", "signature"))  # fmt: skip
query("z2_incremental_relations", "fx_src", body=f"""
WITH {_matched(None, ('import', 'export'))}, t AS (SELECT DISTINCT repo_id, path, name, start_line, line, concat(path, ':', CAST(start_line AS STRING), ':', name) AS id FROM (
  SELECT *, row_number() OVER (PARTITION BY repo_id, file_id, start_line, name ORDER BY ordinal) AS n FROM m WHERE name <> '') WHERE n = 1 AND kind IN ('class', 'interface', 'type')),
k AS (SELECT repo_id, path, name, regexp_extract(line, '\\bextends\\s+(\\w+)', 1) AS parent FROM t WHERE line LIKE '%class%' AND regexp_extract(line, '\\bextends\\s+(\\w+)', 1) <> '')
SELECT repo_id, path, src, dst FROM (SELECT k.repo_id, k.path, s.id AS src, d.id AS dst, row_number() OVER (PARTITION BY k.repo_id, s.id, k.parent ORDER BY CASE WHEN d.path = k.path THEN 0
  WHEN regexp_replace(d.path, '[^/]*$', '') = regexp_replace(k.path, '[^/]*$', '') THEN 1 ELSE 2 END, d.path, d.id) AS n
 FROM k JOIN t s ON s.repo_id = k.repo_id AND s.path = k.path AND s.name = k.name JOIN t d ON d.repo_id = k.repo_id AND d.name = k.parent WHERE s.id <> d.id) WHERE n = 1
""")(lambda f: _second(f, "relations").where("relation_type = 'extends'").select("repo_id", "path", "src", "dst"))  # fmt: skip
query("s14_manifest_tables", "fx_src", body="""
SELECT DISTINCT repo_id, concat('@scope/pkg', repo_id[2:]) AS name, concat('@scope/pkg', CAST((CAST(repo_id[2:] AS INT) + 1) % 4 AS STRING)) AS dependency, '^1' AS version FROM fx_src
""")(lambda f: crossrepo.read_manifests(_manifests(f).withColumn("path", F.lit("package.json")).unionByName(f.select("repo_id", "content", "path"))).select(
    "repo_id", "name", F.explode("dependencies").alias("dependency", "version")))
query("z3_progress_counts", "events", body="SELECT user_id AS job_id, event_type AS phase, count(*) AS n FROM events GROUP BY 1, 2")(
    lambda e: jobs.progress_counts(e.select(F.col("user_id").alias("job_id"), F.col("event_type").alias("phase")))
)
