"""Domains of files and questions, by words and paths, and how they move ranked chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What makes a file belong to a domain: parts of its path, endings and names, words of its content.
FILE_RULES = {
    "security": (
        ["auth", "crypto", "token", "jwt", "oauth", "password", "session", "middleware"],
        ["*.key", "*.pem"],
        ["encrypt", "hash", "secret", "permission"],
    ),
    "frontend": (
        ["components/", "hooks/", "context/", "pages/", "app/", "ui/"],
        ["*.tsx", "*.jsx", "*.css", "*.scss"],
        ["useState", "useEffect", "render", "component"],
    ),
    "backend": (
        ["api/", "server/", "services/", "controllers/", "routes/"],
        ["route.ts", "service.ts", "controller.ts"],
        ["request", "response", "endpoint", "handler"],
    ),
    "database": (
        ["db/", "schema", "migration", "model/", "drizzle/"],
        ["*.sql", "schema.ts"],
        ["table", "column", "index", "query", "SELECT"],
    ),
    "config": (
        ["docker", ".github/", "infra/", ".env"],
        ["*.yml", "*.yaml", "*.json", "*.toml", "Dockerfile"],
        ["config", "environment", "deploy"],
    ),
    "testing": (
        ["test/", "spec/", "__tests__", "e2e/"],
        ["*.test.*", "*.spec.*"],
        ["describe", "it(", "expect", "assert", "mock"],
    ),
}
# Words that point a question to a domain.
QUESTION_WORDS = {
    "security": [
        "auth", "authentication", "authorization", "login", "logout", "jwt", "oauth", "token", "session", "permission", "role", "rbac", "acl",
        "encrypt", "decrypt", "hash", "password", "secret", "csrf", "cors", "sanitize", "xss", "injection", "security", "credential", "cookie",
        "guard", "policy",
    ],
    "frontend": [
        "component", "react", "vue", "svelte", "render", "ui", "page", "view", "hook", "usestate", "useeffect", "props", "css", "style", "layout",
        "form", "button", "modal", "frontend", "client", "browser", "dom",
    ],
    "backend": [
        "api", "endpoint", "route", "handler", "controller", "service", "server", "middleware", "request", "response", "rest", "graphql", "grpc",
        "rpc", "backend", "express", "fastify", "koa", "nest",
    ],
    "database": [
        "database", "db", "query", "sql", "table", "column", "row", "schema", "migration", "index", "transaction", "join", "select", "insert",
        "update", "delete", "orm", "drizzle", "prisma", "model", "entity",
    ],
    "config": [
        "config", "configuration", "environment", "env", "deploy", "deployment", "docker", "dockerfile", "compose", "ci", "cd", "pipeline",
        "github actions", "yaml", "yml", "toml", "infra", "infrastructure", "terraform",
    ],
    "testing": [
        "test", "spec", "jest", "vitest", "mocha", "chai", "assert", "mock", "stub", "fixture", "unit test", "integration test", "e2e", "coverage",
        "describe", "it(", "expect", "beforeeach",
    ],
}
BOOST = 0.2


def _count(hits: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, (h.cast("int") for h in hits))


def domain_array(path: Column, content: Column) -> Column:
    """An array of (domain, score) in the order of the rules: 2 for each part of the path, 3 for each ending or name, 0.5 for each word of
    the first 2,000 characters. A pattern with two stars is met by a file name that holds the parts between them."""
    low, name = F.lower(F.translate(path, "\\", "/")), F.lower(F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1))
    text = F.lower(F.left(F.coalesce(content, F.lit("")), F.lit(2000)))

    def named(pattern: str) -> Column:
        p = pattern.lower()
        if p.count("*") == 1 and p.startswith("*."):
            return low.endswith(p[1:])
        if "*" in p:
            return reduce(lambda a, b: a & b, (name.contains(x) for x in p.split("*") if x))
        return low.contains(p)

    out = []
    for domain, (parts, names, words) in FILE_RULES.items():
        score = _count([low.contains(p.lower()) for p in parts]) * 2.0 + _count([named(p) for p in names]) * 3.0 + _count([text.contains(w.lower()) for w in words]) * 0.5
        out.append(F.struct(F.lit(domain).alias("domain"), score.alias("score")))
    return F.array(*out)


def top_domain(scores: Column) -> Column:
    """The (domain, score) of the highest score, the first of equal ones; null if all are 0."""
    best = F.aggregate(scores, scores[0], lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a))
    return F.when(best["score"] > 0, best)


def domain_scores(files: DataFrame) -> DataFrame:
    """(repo_id, path, domain, score) of files (repo_id, path, content), for scores over 0."""
    return files.select("repo_id", "path", F.inline(domain_array(F.col("path"), F.col("content")))).where("score > 0")


def question_domain(text: Column) -> Column:
    """The domain with the most words in a question, the first of equal ones; null without any."""
    low = F.lower(text)
    counts = [F.struct(F.lit(d).alias("domain"), _count([low.contains(w) for w in words]).alias("n")) for d, words in QUESTION_WORDS.items()]
    best = F.aggregate(F.array(*counts), counts[0], lambda a, x: F.when(x["n"] > a["n"], x).otherwise(a))
    return F.when(best["n"] > 0, best["domain"])


def domain_boost(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """ranked (query_id, file_path, content, final, ...) with final raised where the chunk's domain is that of its query (query_id, text), 1 at most."""
    wanted = queries.select("query_id", question_domain(F.col("text")).alias("query_domain"))
    top = top_domain(domain_array(F.col("file_path"), F.col("content")))
    rows = ranked.join(wanted, "query_id", "left").withColumn("top", top)
    same = F.coalesce(F.col("top.domain") == F.col("query_domain"), F.lit(False))
    final = F.when(same, F.round(F.least(F.lit(1.0), F.col("final") + BOOST), 6)).otherwise(F.col("final"))
    return rows.withColumns({"final": final, "domain_score": F.when(same, F.col("top.score")).otherwise(0.0)}).drop("top")


def domain_order(ranked: DataFrame) -> DataFrame:
    """ranked (query_id, query_domain, file_path, content, final, chunk_id) with place: by the score in the query's domain, then by final and id."""
    own = F.filter(domain_array(F.col("file_path"), F.col("content")), lambda x: x["domain"] == F.col("query_domain"))
    rows = ranked.withColumn("own_score", F.coalesce(F.get(own, F.lit(0))["score"], F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc("own_score"), F.desc("final"), "chunk_id")
    return rows.withColumn("place", F.row_number().over(order))
