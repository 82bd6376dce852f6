"""Search for tables of questions: candidates of all strategies, fused and packed into context; routing by intent; searches over repositories."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import intent_of, symbol_candidates
from . import domains, lexical, relations, reports, retrieval, traverse
from .settled import settled

# Words for a language in a question, in the order in which they are looked for.
LANGUAGE_WORDS = [
    ("typescript", "typescript"), (" ts ", "typescript"), ("javascript", "javascript"), (" js ", "javascript"), ("python", "python"), (" py ", "python"),
    ("rust", "rust"), ("go", "go"), ("golang", "go"), ("java", "java"), ("ruby", "ruby"), ("php", "php"), ("csharp", "csharp"), ("c#", "csharp"),
    ("cpp", "cpp"), ("c++", "cpp"),
]
# Phrases that are left out of a question before it is searched for.
STOP_PHRASES = (
    r"(?i)\b(?:where\s+is|where\s+are|find\s+(?:all\s+)?|show\s+(?:me\s+)?(?:all\s+)?|list\s+(?:all\s+)?|how\s+(?:is|are)\s+|search\s+for\s+"
    r"|look\s+for\s+|which\s+files?\s+(?:have|contain|don't\s+have|lack)\s+)\b"
)
# The broad questions by which design decisions are looked for.
DISCOVERY = [
    "framework library technology stack dependencies package.json",
    "architecture design patterns structure modules",
    "database storage schema migrations",
    "api routes endpoints handlers",
    "authentication authorization security",
    "deployment docker configuration infrastructure",
]
# What reviewers of a kind look for.
ROLES = {
    "Security": "security authentication authorization validation input",
    "Architecture": "architecture structure patterns design modules",
    "Performance": "performance caching async database queries optimization",
    "Code Style": "naming conventions types documentation exports",
    "Authentication": "authentication login session token password jwt oauth",
    "Authorization": "authorization permission role middleware guard protect",
    "Data Protection": "encryption sanitize validate input secret api key database query",
    "Dependency Security": "package.json dependencies config environment docker deployment",
}


@dataclass(frozen=True)
class Corpus:
    """The tables that searches read.

    chunks (repo_id, chunk_id, file_id, file_path, language, start_line, end_line, content, token_count, symbol_id), embeddings (chunk_id,
    embedding), symbols (repo_id, symbol_id, file_id, path, name, kind, start_line, end_line), relations (repo_id, src, dst, relation_type),
    summaries (repo_id, summary_text).
    """

    chunks: DataFrame
    embeddings: DataFrame
    symbols: DataFrame
    relations: DataFrame
    summaries: DataFrame


def _top(rows: DataFrame, by: list, k: int, *order: Column | str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def candidate_names(queries: DataFrame) -> DataFrame:
    """(query_id, repo_id, name): the identifiers of each question."""
    return queries.select("query_id", "repo_id", F.explode(symbol_candidates(F.col("text"))).alias("name")).distinct()


def seed_symbols(names: DataFrame, symbols: DataFrame, *, most: int = 50, most_near: int = 30) -> DataFrame:
    """(query_id, repo_id, symbol_id): the symbols of the names (query_id, repo_id, name), case aside; for queries without any, those that hold one."""
    there = symbols.select("repo_id", "symbol_id", F.col("name").alias("symbol_name"), "path", "start_line").distinct().withColumn("key", F.lower("symbol_name"))
    wanted = names.select("query_id", "repo_id", F.lower("name").alias("key")).distinct()
    order = ["symbol_name", "path", "start_line", "symbol_id"]
    # what is first of all names of a query is first of one of them, so names are cut before they meet the queries that share them
    of_name = _top(there.join(wanted.select("repo_id", "key").distinct(), ["repo_id", "key"]), ["repo_id", "key"], most, *order)
    exact = wanted.join(of_name, ["repo_id", "key"]).select("query_id", "repo_id", *order).distinct()
    missed = wanted.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    near = retrieval.contains_join(missed.select("repo_id", F.col("key").alias("held")).distinct(), there.drop("key"), "held", "symbol_name", ["repo_id"])
    near = missed.join(_top(near.withColumnRenamed("held", "key"), ["repo_id", "key"], most_near, *order), ["repo_id", "key"]).select("query_id", "repo_id", *order).distinct()
    rows = _top(exact, ["query_id"], most, *order).unionByName(_top(near, ["query_id"], most_near, *order))
    return rows.select("query_id", "repo_id", "symbol_id")


def structural_topk(names: DataFrame, symbols: DataFrame, edges: DataFrame, chunks: DataFrame, *, k: int = 20, hops: int = 2, most_nodes: int = 200) -> DataFrame:
    """(query_id, chunk_id, score, rank): chunks of the named symbols (1.0) and of those one (0.6) or two (0.3) relations away."""
    # queries for the same names have the same result: it is made once for each set of names
    asked = names.groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct("repo_id", F.lower("name").alias("name")))).alias("asked"))
    sets = settled(asked.groupBy("asked").agg(F.min("query_id").alias("set_id")))
    asked = asked.join(sets, "asked").select("query_id", "set_id")
    sets = sets.select(F.col("set_id").alias("query_id"), F.inline("asked"))
    seeds = seed_symbols(sets, symbols)
    starts = seeds.select("repo_id", F.col("query_id").alias("source"), F.col("symbol_id").alias("node"))
    reached = traverse.nearest(starts, edges, most=most_nodes, max_depth=hops, direction="both")
    nodes = reached.select("repo_id", F.col("source").alias("query_id"), F.col("node").alias("symbol_id"), "depth")
    score = F.when(F.col("depth") == 0, 1.0).when(F.col("depth") == 1, 0.6).otherwise(0.3)
    rows = nodes.join(chunks.select("repo_id", "symbol_id", "chunk_id"), ["repo_id", "symbol_id"]).groupBy("query_id", "chunk_id").agg(F.max(score).alias("score"))
    found = _top(rows, ["query_id"], k, F.desc("score"), "chunk_id").withColumnRenamed("query_id", "set_id")
    return asked.join(found, "set_id").select("query_id", "chunk_id", "score", "rank")


def file_scope_context(scopes: DataFrame, corpus: Corpus, *, importers: int = 10) -> DataFrame:
    """(query_id, chunk_id, file_path, start_line, end_line, token_count, score, place): for scopes (query_id, repo_id, scope_path) the chunks of the
    file in order of lines, then one chunk each of the first files that import, call or use it."""
    wanted = scopes.where("scope_path IS NOT NULL").select("query_id", "repo_id", "scope_path")
    cols = ["query_id", "chunk_id", "file_path", "start_line", "end_line", "token_count"]
    own = wanted.join(corpus.chunks, (wanted["repo_id"] == corpus.chunks["repo_id"]) & (wanted["scope_path"] == corpus.chunks["file_path"])).select(*cols)
    own = own.withColumns({"score": F.lit(1.0), "part": F.lit(0)})
    place = corpus.symbols.select("repo_id", "symbol_id", "path")
    used = corpus.relations.where(F.col("relation_type").isin("imports", "calls", "uses"))
    into = used.join(place.toDF("repo_id", "dst", "scope_path"), ["repo_id", "dst"]).join(place.toDF("repo_id", "src", "from_path"), ["repo_id", "src"])
    into = wanted.join(into.where("from_path <> scope_path"), ["repo_id", "scope_path"]).select("query_id", "repo_id", F.col("src").alias("symbol_id"), "from_path").distinct()
    rows = into.join(corpus.chunks, ["repo_id", "symbol_id"]).select(*cols, "from_path")
    one = _top(rows, ["query_id", "from_path"], 1, "start_line", "chunk_id").drop("rank")
    one = _top(one, ["query_id"], importers, "from_path").drop("rank", "from_path").withColumns({"score": F.lit(0.7), "part": F.lit(1)})
    order = Window.partitionBy("query_id").orderBy("part", F.when(F.col("part") == 0, F.col("start_line")), "file_path", "chunk_id")
    return own.unionByName(one).withColumn("place", F.row_number().over(order)).drop("part")


def pack_context(ranked: DataFrame, queries: DataFrame, *, scoped: DataFrame | None = None, summaries: DataFrame | None = None, budget: int = 12_000) -> DataFrame:
    """(query_id, part, place, chunk_id, file_path, start_line, end_line, token_count, tokens_so_far) of what fits into the budget.

    ranked (query_id, chunk_id, file_path, start_line, end_line, token_count, place); queries (query_id, repo_id). A summary's tokens come
    off first, then scoped chunks up to the first that doesn't fit, then ranked ones with what is left, without those of a range that is in
    already, up to the first that doesn't fit.
    """
    cols = ["query_id", "chunk_id", "file_path", "start_line", "end_line", "token_count", "place"]
    start = queries.select("query_id", "repo_id")
    if summaries is None:
        start = start.select("query_id", F.lit(0).alias("used"))
    else:
        tokens = summaries.select("repo_id", F.ceil(F.length("summary_text") / 4).cast("int").alias("used"))
        start = start.join(tokens, "repo_id", "left").select("query_id", F.coalesce("used", F.lit(0)).alias("used"))

    def fitting(rows: DataFrame, used: DataFrame, part: str) -> DataFrame:
        range_key = Window.partitionBy("query_id", "file_path", "start_line", "end_line").orderBy("place", "chunk_id")
        rows = rows.withColumn("n_", F.row_number().over(range_key)).where("n_ = 1").drop("n_")
        so_far = F.sum("token_count").over(Window.partitionBy("query_id").orderBy("place", "chunk_id").rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.join(used, "query_id").withColumn("tokens_so_far", so_far + F.col("used")).where(F.col("tokens_so_far") <= budget)
        return rows.select(F.lit(part).alias("part"), *cols, F.col("tokens_so_far").cast("long").alias("tokens_so_far"))

    if scoped is None:
        return fitting(ranked.select(*cols), start, "ranked")
    first = fitting(scoped.select(*cols), start, "scoped")
    taken = first.groupBy("query_id").agg(F.max("tokens_so_far").cast("int").alias("after"))
    used = start.join(taken, "query_id", "left").select("query_id", F.coalesce("after", "used").alias("used"))
    rest = ranked.select(*cols).join(first.select("query_id", "file_path", "start_line", "end_line").distinct(), ["query_id", "file_path", "start_line", "end_line"], "left_anti")
    return first.unionByName(fitting(rest, used, "ranked"))


def render_context(packed: DataFrame, chunks: DataFrame, queries: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """(query_id, context): the packed chunks as text with headings, in their order. A query's chunks fit its budget, so a text is small."""
    text = chunks.select("chunk_id", "content", "language", F.col("symbol_name") if "symbol_name" in chunks.columns else F.lit(None).cast("string").alias("symbol_name"))
    head = F.format_string("### File: %s (lines %d-%d)", "file_path", "start_line", "end_line")
    label = F.when(F.col("symbol_name").isNotNull(), F.concat(F.lit(" — "), "symbol_name")).otherwise("")
    block = F.concat(head, label, F.lit("\n```"), F.coalesce("language", F.lit("")), F.lit("\n"), "content", F.lit("\n```\n"))
    order = F.struct((F.col("part") != "scoped").alias("later"), "place", "chunk_id", block.alias("block"))
    rows = packed.join(text, "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_list(order)).alias("blocks"))
    body = F.concat(F.lit("## Relevant Code (ordered by relevance)\n\n"), F.coalesce(F.array_join(F.transform("blocks", lambda b: b["block"]), "\n"), F.lit("")))
    rows = queries.select("query_id", "repo_id").join(rows, "query_id", "left")
    if summaries is None:
        return rows.select("query_id", body.alias("context"))
    rows = rows.join(summaries.select("repo_id", "summary_text"), "repo_id", "left")
    intro = F.coalesce(F.concat(F.lit("## Repository Overview\n"), "summary_text", F.lit("\n\n")), F.lit(""))
    return rows.select("query_id", F.concat(intro, body).alias("context"))


def candidates(queries: DataFrame, corpus: Corpus, *, pool: int = 20, min_similarity: float = 0.3) -> DataFrame:
    """(query_id, chunk_id, strategy, score) of all strategies for queries (query_id, repo_id, text, vector)."""
    chunks = corpus.chunks
    vectors = corpus.embeddings.join(chunks.select("chunk_id", "repo_id"), "chunk_id")
    found = [
        retrieval.semantic_topk(queries, vectors, k=pool, min_similarity=min_similarity).select("query_id", "chunk_id", F.col("similarity").alias("score"), F.lit("semantic").alias("strategy")),
        lexical.lexical_with_fallback(queries, chunks, k=pool).select("query_id", "chunk_id", "score", F.lit("lexical").alias("strategy")),
        structural_topk(candidate_names(queries), corpus.symbols, corpus.relations, chunks).select("query_id", "chunk_id", "score", F.lit("structural").alias("strategy")),
    ]
    return reduce(DataFrame.unionByName, found)


def retrieve(queries: DataFrame, corpus: Corpus, *, max_results: int = 15, budget: int = 12_000, pool: int = 20) -> tuple[DataFrame, DataFrame]:
    """Ranked chunks and the packed context for queries (query_id, repo_id, text, vector, and scope_path if there are scoped ones).

    Candidates of three strategies are fused, chunks that overlap a better one go, the first `max_results` (25 if over 20) are raised by domain,
    and packed in the order of the query's domain. All queries go through one plan.
    """
    top = 25 if max_results > 20 else max_results
    found = settled(candidates(queries, corpus, pool=pool))
    info = corpus.chunks.select("chunk_id", "repo_id", "file_path", "start_line", "end_line", "token_count", "content", "language", "symbol_id")
    scored = found.join(info.select("chunk_id", "file_path", "token_count"), "chunk_id")
    scope = queries.select("query_id", "scope_path") if "scope_path" in queries.columns else None
    fused = retrieval.fuse_rankings(scored, scope)
    each = found.groupBy("query_id", "chunk_id").agg(
        *(F.coalesce(F.max(F.when(F.col("strategy") == s, F.col("score"))), F.lit(0.0)).alias(f"{s}_score") for s in ("semantic", "lexical", "structural"))
    )
    lines = info.select("chunk_id", "start_line", "end_line")
    ranked = fused.join(lines, "chunk_id").withColumn("score", F.col("final"))
    kept = reports.drop_overlaps(ranked, most=top).select("query_id", "chunk_id", F.col("score").alias("final"))
    rows = kept.join(info, "chunk_id").join(each, ["query_id", "chunk_id"])
    boosted = domains.domain_boost(rows, queries)
    order = Window.partitionBy("query_id").orderBy(F.desc("final"), "chunk_id")
    boosted = settled(boosted.withColumn("rank", F.row_number().over(order)))
    placed = domains.domain_order(boosted)
    scoped = None if scope is None else file_scope_context(queries.select("query_id", "repo_id", "scope_path"), corpus)
    return boosted, pack_context(placed, queries, scoped=scoped, summaries=corpus.summaries, budget=budget)


def retrieval_trace(found: DataFrame, ranked: DataFrame, packed: DataFrame) -> DataFrame:
    """(query_id, n_candidates, n_kept, n_packed, tokens) of candidates, ranked and packed chunks."""
    a = found.groupBy("query_id").agg(F.count("*").alias("n_candidates"))
    b = ranked.groupBy("query_id").agg(F.count("*").alias("n_kept"))
    c = packed.groupBy("query_id").agg(F.count("*").alias("n_packed"), F.max("tokens_so_far").alias("tokens"))
    rows = a.join(b, "query_id", "left").join(c, "query_id", "left")
    return rows.select("query_id", "n_candidates", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("n_kept", "n_packed", "tokens")))


def low_confidence(ranked: DataFrame, *, least: float = 0.3) -> DataFrame:
    """(query_id, low): whether all scores of a query are under `least`."""
    return ranked.groupBy("query_id").agg((F.max("final") < least).alias("low"))


def multi_query_merge(results: DataFrame) -> DataFrame:
    """Results (question_id, ordinal, rank, file_path, start_line, ...) of several queries of a question, the first of each place, in order."""
    once = Window.partitionBy("question_id", "file_path", "start_line").orderBy("ordinal", "rank")
    order = Window.partitionBy("question_id").orderBy("ordinal", "rank")
    return results.withColumn("n_", F.row_number().over(once)).where("n_ = 1").drop("n_").withColumn("place", F.row_number().over(order))


def extract_filters(text: Column) -> tuple[Column, Column]:
    """A glob (`*.ext`, or `folder/**` of "in the X folder") and a language of a question, null without."""
    glob, folder = F.regexp_extract(text, r"\*\.\w+", 0), F.regexp_extract(text, r"(?i)\bin\s+(?:the\s+)?([a-z][a-z0-9/_-]+(?:/|\s+folder|\s+directory))", 1)
    cut = F.trim(F.regexp_replace(F.trim(folder), r"\s+(?:folder|directory)$", ""))
    language = None
    for word, name in LANGUAGE_WORDS:
        hit = F.lower(text).contains(word)
        language = F.when(hit, F.lit(name)) if language is None else language.when(hit, F.lit(name))
    return F.when(glob != "", glob).when(folder != "", F.concat(cut, F.lit("/**"))), language


def normalized_query(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), STOP_PHRASES, " "), r"\s{2,}", " "))


def classify_queries(queries: DataFrame) -> DataFrame:
    """queries (query_id, text, ...) with intent, normalized, names, path_glob and language."""
    glob, language = extract_filters(F.trim("text"))
    return queries.withColumns(
        {"intent": intent_of(F.col("text")), "normalized": normalized_query(F.col("text")), "names": symbol_candidates(F.trim("text")), "path_glob": glob, "query_language": language}
    )


def find_missing(ranked: DataFrame, *, limit: int = 30) -> DataFrame:
    """The ranked chunks of each query with the lowest scores first: what most likely lacks the thing asked for."""
    return _top(ranked.drop("rank"), ["query_id"], limit, "final", "chunk_id")


def match_reason(vector_score: Column, keyword_score: Column) -> Column:
    return F.when(vector_score > keyword_score, "semantic match").when(keyword_score > 0, "keyword match").otherwise("structural match")


def glob_regex(glob: Column) -> Column:
    """A glob as a pattern: `**` is anything, `*` anything but a slash, all else itself."""
    escaped = F.regexp_replace(glob, r"([.+^$(){}|\[\]\\?])", r"\\$1")
    return F.replace(F.regexp_replace(F.replace(escaped, F.lit("**"), F.lit("\x01")), r"\*", "[^/]*"), F.lit("\x01"), F.lit(".*"))


def apply_result_filters(results: DataFrame) -> DataFrame:
    """results (file_path, language, path_glob, query_language, ...) whose path holds the glob and whose language fits, either way round; nulls filter nothing."""
    path_ok = F.coalesce(F.regexp_like("file_path", glob_regex(F.col("path_glob"))), F.lit(True))
    a, b = F.lower("language"), F.lower("query_language")
    return results.where(path_ok & F.coalesce(F.contains(a, b) | F.contains(b, a), F.lit(True)))


def search_suggestions(intent: Column, names: Column) -> Column:
    """Up to three hints for a search that found nothing."""
    first = F.get(names, F.lit(0))
    named = lambda text: F.format_string(text, first)
    some = F.size(names) > 0
    hints = (
        F.when(intent == "find_missing", F.array(F.lit("Try: 'find all error handlers'"), F.when(some, named("Try: 'where is %s defined'"))))
        .when((intent == "find_definition") & some, F.array(named("Try: 'where is %s used'"), named("Try: 'find all functions similar to %s'")))
        .when((intent == "find_usage") & some, F.array(named("Try: 'where is %s defined'")))
        .when(intent == "general", F.array(F.lit("Try using specific function or class names"), F.lit("Try: 'find all API handlers'")))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.slice(F.array_compact(hints), 1, 3)


def search(queries: DataFrame, corpus: Corpus, *, limit: int = 30, offset: int = 0) -> DataFrame:
    """(query_id, intent, place, total, repo_id, chunk_id, file_path, start_line, end_line, reason) for queries (query_id, repo_id, text, vector).

    Definitions and usages are looked up by name, and filled up from retrieval where fewer than five are found; missing things are the
    retrieved chunks of the lowest scores; all else is retrieved. Then filters of the question, one result for each place, and a page.
    """
    asked = settled(classify_queries(queries))
    by_name = asked.where(F.col("intent").isin("find_definition", "find_usage")).select("query_id", "repo_id", "intent", F.explode("names").alias("name")).distinct()
    defined = relations.find_definitions(by_name.where("intent = 'find_definition'").drop("intent"), corpus.symbols, corpus.chunks, 2 * limit)
    users = relations.find_usages(by_name.where("intent = 'find_usage'").drop("intent"), corpus.symbols, corpus.relations, corpus.chunks, 2 * limit)
    some = [x.select("query_id", "chunk_id", F.lit(reason).alias("reason"), "rank") for x, reason in ((defined, "symbol definition"), (users, "symbol usage"))]
    spots = corpus.chunks.select("chunk_id", "file_path", "start_line", "end_line", "language")
    direct = some[0].unionByName(some[1]).join(spots, "chunk_id").withColumn("part", F.lit(0))
    direct = settled(direct.select("query_id", "chunk_id", "file_path", "start_line", "end_line", "language", "reason", "part", "rank"))
    enough = direct.groupBy("query_id").agg(F.count("*").alias("n")).where("n >= 5").select("query_id")
    rest = asked.join(enough, "query_id", "left_anti").withColumn("text", F.col("normalized"))
    ranked, _ = retrieve(rest.select(*queries.columns), corpus, max_results=limit + offset)
    reasons = ranked.withColumn("reason", match_reason(F.col("semantic_score"), F.col("lexical_score"))).join(asked.select("query_id", "intent"), "query_id")
    kinds = corpus.symbols.where(F.col("kind").isin(*relations.DEFINITION_KINDS)).select("repo_id", "symbol_id")
    missing = find_missing(reasons.where("intent = 'find_missing'"), limit=limit)
    definitions = reasons.where("intent = 'find_definition'").join(kinds, ["repo_id", "symbol_id"], "left_semi").withColumn("reason", F.lit("symbol definition"))
    others = reasons.where(~F.col("intent").isin("find_missing", "find_definition"))
    some = [x.select("query_id", "chunk_id", "file_path", "start_line", "end_line", "language", "reason", F.lit(1).alias("part"), "rank") for x in (missing, definitions, others)]
    rows = reduce(DataFrame.unionByName, [direct, *some]).join(asked.select("query_id", "repo_id", "intent", "path_glob", "query_language"), "query_id")
    rows = apply_result_filters(rows)
    once = Window.partitionBy("query_id", "file_path", "start_line").orderBy("part", "rank", "chunk_id")
    rows = rows.withColumn("n_", F.row_number().over(once)).where("n_ = 1")
    query = Window.partitionBy("query_id")
    rows = rows.withColumns({"total": F.count("*").over(query), "place": F.row_number().over(query.orderBy("part", "rank", "chunk_id"))})
    page = rows.where(F.col("place").between(offset + 1, offset + limit))
    return page.select("query_id", "intent", "place", "total", "repo_id", "chunk_id", "file_path", "start_line", "end_line", "reason")


def search_across_repos(queries: DataFrame, vectors: DataFrame, repos: DataFrame, *, limit: int = 30, min_similarity: float = 0.25) -> DataFrame:
    """(workspace_id, query_id, repo_id, chunk_id, similarity, place) for queries (query_id, workspace_id, vector).

    vectors (repo_id, chunk_id, embedding), repos (workspace_id, repo_id). Each repository gives its first ceil(limit / repositories) + 5, then
    the first `limit` of the workspace stay.
    """
    sizes = repos.groupBy("workspace_id").agg(F.count("*").alias("n"))
    placed = repos.join(sizes, "workspace_id").select("workspace_id", "repo_id", (F.ceil(F.lit(limit) / F.col("n")) + 5).alias("share"))
    some = queries.join(placed, "workspace_id").select("query_id", "workspace_id", "repo_id", "share", "vector")
    keyed = some.select(F.struct("workspace_id", "query_id", "repo_id", "share").alias("query_id"), "repo_id", "vector")
    found = retrieval.semantic_topk(keyed, vectors, k=limit + 5, min_similarity=min_similarity)
    rows = found.select("query_id.*", "chunk_id", "similarity", "rank").where("rank <= share")
    order = Window.partitionBy("workspace_id", "query_id").orderBy(F.desc("similarity"), "repo_id", "chunk_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("share", "rank")


def role_context(repos: DataFrame, embed, corpus: Corpus, *, roles: dict[str, str] | None = None, budget_chars: int = 32_000) -> DataFrame:
    """(repo_id, role, context): what a reviewer of each role is shown of repos (repo_id), an empty text if nothing is found; embed turns a text column into a
    vector column."""
    named = [F.struct(F.lit(r).alias("role"), F.lit(f"{words} {r}").alias("text")) for r, words in (roles or ROLES).items()]
    queries = repos.select("repo_id", F.inline(F.array(*named))).withColumn("query_id", F.concat_ws("/", "repo_id", "role"))
    ranked, _ = retrieve(queries.withColumn("vector", embed(F.col("text"))), corpus, max_results=12, budget=6_000)
    block = F.format_string("### File: %s (L%d-L%d)\n%s", "file_path", "start_line", "end_line", "content")
    lists = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("x"))
    text = F.left(F.array_join(F.transform("x", lambda b: b["block"]), "\n\n"), F.lit(budget_chars))
    return queries.select("query_id", "repo_id", "role").join(lists, "query_id", "left").select("repo_id", "role", F.coalesce(text, F.lit("")).alias("context"))


def discovery_context(repos: DataFrame, embed, corpus: Corpus, *, most: int = 25, chars: int = 1_500) -> DataFrame:
    """(repo_id, place, file_path, start_line, text): the first chunks that broad questions find in repos (repo_id), one of each file."""
    asked = [F.struct(F.lit(i).alias("ordinal"), F.lit(t).alias("text")) for i, t in enumerate(DISCOVERY)]
    queries = repos.select("repo_id", F.inline(F.array(*asked))).withColumn("query_id", F.concat_ws("/", "repo_id", "ordinal"))
    ranked, _ = retrieve(queries.withColumn("vector", embed(F.col("text"))), corpus, max_results=8, budget=3_000)
    rows = ranked.join(queries.select("query_id", "ordinal"), "query_id")
    one = _top(rows.withColumnRenamed("rank", "own"), ["repo_id", "file_path"], 1, "ordinal", "own", "chunk_id").drop("rank")
    first = _top(one, ["repo_id"], most, "ordinal", "own", "chunk_id")
    return first.select("repo_id", F.col("rank").alias("place"), "file_path", "start_line", F.left("content", F.lit(chars)).alias("text"))
