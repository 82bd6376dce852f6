"""File and repository health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def symbol_counts(symbols: DataFrame) -> DataFrame:
    """Of each file: symbols, functions, and complexity as a tenth of the lines of functions, 1 each at least."""
    call = F.col("kind").isin("function", "method")
    lines = F.greatest((F.col("end_line") - F.col("start_line")) / 10.0, F.lit(1.0))
    return symbols.groupBy("repo_id", "file_id").agg(
        F.count("*").alias("symbol_count"), F.count_if(call).alias("function_count"), F.sum(F.when(call, lines).otherwise(0.0)).alias("complexity")
    )


def coupling(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """Of each file: distinct symbols that lead into it (afferent) and that it leads to (efferent)."""
    of = symbols.select("repo_id", "symbol_id", "file_id")
    into = relations.join(of.withColumnRenamed("symbol_id", "dst"), ["repo_id", "dst"]).groupBy("repo_id", "file_id").agg(F.countDistinct("src").alias("afferent"))
    out = relations.join(of.withColumnRenamed("symbol_id", "src"), ["repo_id", "src"]).groupBy("repo_id", "file_id").agg(F.countDistinct("dst").alias("efferent"))
    return into.join(out, ["repo_id", "file_id"], "full_outer").select(
        "repo_id", "file_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("afferent", "efferent"))
    )


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Of each file: chunks, mean tokens, and chunks that begin with a comment."""
    marks = ("//", "/*", "#", '"""', "'''")
    comment = F.lit(False)
    for m in marks:
        comment = comment | F.col("content").startswith(m)
    return chunks.groupBy("repo_id", "file_id").agg(
        F.count("*").alias("chunk_count"), F.avg("token_count").alias("avg_tokens"), F.count_if(comment).alias("comment_chunks")
    )


def file_health(files: DataFrame, symbols: DataFrame, relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Of each file of files (repo_id, file_id, path, language, line_count, size_bytes): metrics, a score from 0 to 100, and the issues."""
    key = ["repo_id", "file_id"]
    rows = files.join(symbol_counts(symbols), key, "left").join(coupling(symbols, relations), key, "left").join(chunk_stats(chunks), key, "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("symbol_count", "complexity", "afferent", "efferent", "chunk_count", "avg_tokens", "comment_chunks")}
    rows = rows.withColumns(zero)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = rows.withColumns(
        {
            "instability": share(F.col("efferent"), F.col("afferent") + F.col("efferent")),
            "doc_ratio": share(F.col("comment_chunks"), F.col("chunk_count")),
            "chunk_density": share(F.col("chunk_count") * 100, F.col("line_count")),
        }
    )
    c, i, n, d, s = (F.col(x) for x in ("complexity", "instability", "line_count", "doc_ratio", "symbol_count"))
    # Thresholds, what they take off, and what they are called.
    rules = [
        [(c > 50, 20, "Very high complexity (>50)"), (c > 20, 10, "High complexity (>20)")],
        [(i > 0.8, 15, "Very unstable coupling (instability >0.8)"), (i > 0.5, 5, "Moderate instability (>0.5)")],
        [(n > 500, 15, "Very large file (>500 lines)"), (n > 300, 5, "Large file (>300 lines)")],
        [(d < 0.05, 10, "Low documentation coverage (<5%)")],
        [(s > 30, 10, "High symbol density (>30 symbols)")],
    ]
    score, issues = F.lit(100), []
    for rule in rules:
        off, name = F.when(rule[0][0], rule[0][1]), F.when(rule[0][0], F.lit(rule[0][2]))
        for test, points, text in rule[1:]:
            off, name = off.when(test, points), name.when(test, F.lit(text))
        score = score - off.otherwise(0)
        issues.append(name)
    return rows.withColumns({"score": F.greatest(score, F.lit(0)), "issues": F.array_compact(F.array(*issues))})


def repo_health(health: DataFrame) -> DataFrame:
    return health.groupBy("repo_id").agg(
        F.count("*").alias("file_count"), F.avg("complexity").alias("avg_complexity"), F.avg("instability").alias("avg_instability"),
        F.max("size_bytes").alias("max_size"), F.avg("size_bytes").alias("avg_size"), F.floor(F.avg("score") + 0.5).cast("int").alias("score"),
    )


def hotspots(health: DataFrame, most: int = 10) -> DataFrame:
    order = Window.partitionBy("repo_id").orderBy("score", "path")
    return health.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def best_files(health: DataFrame, most: int = 5) -> DataFrame:
    order = Window.partitionBy("repo_id").orderBy(F.desc("score"), "path")
    return health.where("line_count > 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def language_breakdown(files: DataFrame) -> DataFrame:
    language = F.coalesce("language", F.lit("unknown"))
    counts = files.groupBy("repo_id", language.alias("language")).agg(F.count("*").alias("file_count"), F.sum("line_count").alias("line_count"))
    return counts.withColumn("file_share", F.col("file_count") / F.sum("file_count").over(Window.partitionBy("repo_id")))


def repo_counts(files: DataFrame, symbols: DataFrame, relations: DataFrame) -> DataFrame:
    parts = [d.groupBy("repo_id").agg(F.count("*").alias(n)) for d, n in ((files, "n_files"), (symbols, "n_symbols"), (relations, "n_relations"))]
    both = parts[0].join(parts[1], "repo_id", "left").join(parts[2], "repo_id", "left")
    return both.select("repo_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_files", "n_symbols", "n_relations")))


def size_shares(files: DataFrame, most: int = 150) -> DataFrame:
    repo = Window.partitionBy("repo_id")
    top = files.withColumn("place", F.row_number().over(repo.orderBy(F.desc("line_count"), "path"))).where(F.col("place") <= most)
    return top.withColumn("line_share", F.col("line_count") / F.sum("line_count").over(repo))


def sort_files(rows: DataFrame, *, by: str = "score", descending: bool = False, limit: int = 100) -> DataFrame:
    """The first files of each repository by score, complexity, instability or line_count; ties by path. At most 500."""
    if by not in ("score", "complexity", "instability", "line_count"):
        by = "score"
    order = Window.partitionBy("repo_id").orderBy(F.desc(by) if descending else F.asc(by), "path")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= min(500, max(1, limit)))


def find_files(rows: DataFrame, text: str = "", *, by: str = "score", descending: bool = False, page: int = 0, page_size: int = 20) -> DataFrame:
    """A page of the files of each repository whose path or language holds the text, with the number of all of them; ties by path."""
    hit = F.lower("path").contains(text.lower()) | F.coalesce(F.lower("language").contains(text.lower()), F.lit(False))
    key = F.coalesce("language", F.lit("")) if by == "language" else F.col(by)
    repo = Window.partitionBy("repo_id")
    order = repo.orderBy(key.desc() if descending else key.asc(), "path")
    some = rows.where(hit).withColumns({"total": F.count("*").over(repo), "place": F.row_number().over(order)})
    return some.where(F.col("place").between(page * page_size + 1, (page + 1) * page_size))
