"""Cross-repository relations, commit timelines, overviews, annotations, citations and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_of
from .intervals import overlaps
from .settled import settled


def shared_types(symbols: DataFrame) -> DataFrame:
    """(from_repo, to_repo, name, kind): types, classes, interfaces and enums of one name in two repositories."""
    some = symbols.where(F.col("kind").isin("interface", "type", "class", "enum")).select("repo_id", "name", "kind").distinct()
    other = some.withColumnRenamed("repo_id", "to_repo")
    return some.withColumnRenamed("repo_id", "from_repo").join(other, ["name", "kind"]).where("from_repo < to_repo")


def shared_modules(files: DataFrame) -> DataFrame:
    """(from_repo, to_repo, path, confidence) of equal paths: high if the contents are equal, else medium; lock and vendor files aside."""
    some = files.where(~F.col("path").rlike(r"lock|node_modules|vendor")).select("repo_id", "path", "content_hash")
    other = some.select(F.col("repo_id").alias("to_repo"), "path", F.col("content_hash").alias("other"))
    both = some.withColumnRenamed("repo_id", "from_repo").join(other, "path").where("from_repo < to_repo")
    return both.select("from_repo", "to_repo", "path", F.when(F.col("content_hash") == F.col("other"), "high").otherwise("medium").alias("confidence"))


def repo_pairs(repos: DataFrame) -> DataFrame:
    a = repos.select("workspace_id", F.col("repo_id").alias("from_repo"))
    b = repos.select("workspace_id", F.col("repo_id").alias("to_repo"))
    return a.join(b, "workspace_id").where("from_repo < to_repo")


def timeline(commits: DataFrame, *, most: int = 200, since: str | None = None, path: str | None = None, files: DataFrame | None = None) -> DataFrame:
    """The newest commits of each repository since a time, `most` at most, with their number before the cut; commits (repo_id, sha, ts, ...).

    path keeps the commits that changed it, by files (repo_id, sha, path).
    """
    some = commits.where(F.col("ts") >= since) if since else commits
    if path is not None:
        some = some.join(files.where(F.col("path") == path).select("repo_id", "sha").distinct(), ["repo_id", "sha"], "left_semi")
    repo = Window.partitionBy("repo_id")
    rows = some.withColumns({"total": F.count("*").over(repo), "place": F.row_number().over(repo.orderBy(F.desc("ts"), "sha"))})
    return rows.where(F.col("place") <= most)


def filter_timeline(entries: DataFrame, *, levels: list[str] | None = None, tags: list[str] | None = None) -> DataFrame:
    """entries (level, tags) of one of the levels that have one of the tags; None filters nothing."""
    rows = entries if levels is None else entries.where(F.col("level").isin(levels))
    return rows if not tags else rows.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))


def commit_stats(commit_files: DataFrame) -> DataFrame:
    """(repo_id, sha, n_files, additions, deletions, n_paths) of the changed files of each commit; equal shas of two repositories are two commits."""
    return commit_files.groupBy("repo_id", "sha").agg(
        F.count("*").alias("n_files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.countDistinct("path").alias("n_paths")
    )


def touched_symbols(commit_files: DataFrame, symbols: DataFrame, *, most_files: int = 5) -> DataFrame:
    """(repo_id, sha, names): symbols whose lines overlap a changed range, in the first `most_files` changed files of each commit.

    commit_files (repo_id, sha, path, change_start, change_end); symbols (repo_id, path, name, start_line, end_line). Each range of a file is looked up once,
    however many commits changed it.
    """
    changed = commit_files.select("repo_id", "sha", "path", "change_start", "change_end")
    rank = F.dense_rank().over(Window.partitionBy("repo_id", "sha").orderBy("path"))
    # equal rows have one rank, and lie together: this needs no second shuffle
    first = changed.withColumn("place", rank).where(F.col("place") <= most_files).drop("place").distinct()
    span = F.struct(F.col("change_start").alias("start"), F.col("change_end").alias("end"))
    # of all ranges, those of later files too: fewer than the rows of `first` by far, which are not made twice or kept for it
    spans = changed.select("repo_id", "path", span.alias("left_id")).distinct().select("*", "left_id.start", "left_id.end")
    named = symbols.select("repo_id", "path", F.col("name").alias("right_id"), F.col("start_line").alias("start"), F.col("end_line").alias("end")).distinct()
    hit = settled(overlaps(spans, named, ["repo_id", "path"]).groupBy("repo_id", "path", "left_id").agg(F.collect_set("right_id").alias("names")))
    rows = first.withColumn("left_id", span).join(hit, ["repo_id", "path", "left_id"])
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("names"))))
    return rows.groupBy("repo_id", "sha").agg(names.alias("names"))


def top_symbols(symbols: DataFrame, relations: DataFrame, most: int = 20) -> DataFrame:
    """Symbols with the most incoming relations of each repository; those without count 0."""
    used = relations.groupBy("repo_id", F.col("dst").alias("symbol_id")).agg(F.count("*").alias("n"))
    rows = symbols.join(used, ["repo_id", "symbol_id"], "left").withColumn("n_references", F.coalesce("n", F.lit(0)))
    order = Window.partitionBy("repo_id").orderBy(F.desc("n_references"), "symbol_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("repo_id", "symbol_id", "name", "n_references", "place")


def repo_overview(files: DataFrame, *, languages: int = 6, directories: int = 10) -> DataFrame:
    """(repo_id, part, name, n, place): the number of files, the most frequent languages, and the first path parts with the most files."""
    repo = Window.partitionBy("repo_id")
    total = files.groupBy("repo_id").agg(F.count("*").alias("n")).select("repo_id", F.lit("files").alias("part"), F.lit("").alias("name"), "n", F.lit(1).alias("place"))

    def top(name, part: str, most: int) -> DataFrame:
        counts = files.where(name.isNotNull()).groupBy("repo_id", name.alias("name")).agg(F.count("*").alias("n"))
        rows = counts.withColumn("place", F.row_number().over(repo.orderBy(F.desc("n"), "name"))).where(F.col("place") <= most)
        return rows.select("repo_id", F.lit(part).alias("part"), "name", "n", "place")

    return total.unionByName(top(F.col("language"), "language", languages)).unionByName(top(F.split_part("path", F.lit("/"), F.lit(1)), "directory", directories))


def validate_references(references: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """references (repo_id, path, name) that exist: files by path where name is null, symbols by name and path, or by path alone."""
    paths = files.select("repo_id", "path").distinct()
    return references.join(paths, ["repo_id", "path"], "left_semi").unionByName(
        references.join(paths, ["repo_id", "path"], "left_anti").join(symbols.select("repo_id", "path", "name").distinct(), ["repo_id", "path", "name"], "left_semi")
    )


def suggest_flows(symbols: DataFrame, relations: DataFrame, *, most: int = 10) -> DataFrame:
    """(repo_id, place, source, symbol_id, name, path): API handlers, symbols with many relations, and service code, five of each at most, each once."""
    path, name = F.col("path"), F.col("name")
    repo = Window.partitionBy("repo_id")
    cols = ["repo_id", "symbol_id", "name", "path", "source", "n"]

    def first(rows: DataFrame, ordinal: int, *order) -> DataFrame:
        return rows.withColumns({"source": F.lit(ordinal), "n": F.row_number().over(repo.orderBy(*order, "path", "name", "symbol_id"))}).where("n <= 5").select(*cols)

    handlers = symbols.where((path.contains("/api/") | path.contains("route.ts")) & (name.isin("GET", "POST", "PUT", "DELETE", "PATCH") | name.contains("Handler") | name.contains("handler")))
    degree = relations.groupBy("repo_id", F.col("src").alias("symbol_id")).agg(F.count("*").alias("degree"))
    hubs = symbols.join(degree, ["repo_id", "symbol_id"])
    services = symbols.where(path.rlike("service|Service|worker|Worker|pipeline") & F.col("kind").isin("function", "method", "class"))
    every = first(handlers, 0).unionByName(first(hubs.where("degree >= 2"), 1, F.desc("degree"))).unionByName(first(services, 2))
    once = Window.partitionBy("repo_id", "name", "path").orderBy("source", "n", "symbol_id")
    rows = every.withColumn("k", F.row_number().over(once)).where("k = 1").drop("k")
    rows = rows.withColumn("place", F.row_number().over(repo.orderBy("source", "n"))).where(F.col("place") <= most)
    return rows.select("repo_id", "place", "source", "symbol_id", "name", "path")


def entry_points(files: DataFrame, most: int = 15) -> DataFrame:
    """Route handlers, main, app, server and index files, the first by path of each repository."""
    hit = F.lower("path").rlike(r"(?:^|/)index\.(?:ts|tsx|js)$|route\.ts|main\.ts|main\.js|app\.ts|app\.js|server\.ts|server\.js")
    order = Window.partitionBy("repo_id").orderBy("path")
    return files.where(hit).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def thread_list(threads: DataFrame, comments: DataFrame, status: str | None = None) -> DataFrame:
    """threads (thread_id, status, author, created_at) with the number and latest time of comments (thread_id, created_at)."""
    counts = comments.groupBy("thread_id").agg(F.count("*").alias("n_comments"), F.max("created_at").alias("last_comment_at"))
    some = threads.where(F.col("status") == status) if status else threads
    return some.join(counts, "thread_id", "left").withColumn("n_comments", F.coalesce("n_comments", F.lit(0)))


def history_window(messages: DataFrame, last: int = 10) -> DataFrame:
    """The last messages of each conversation, then those of user and assistant only."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("place", F.row_number().over(order)).where((F.col("place") <= last) & F.col("role").isin("user", "assistant"))


def conversation_titles(messages: DataFrame) -> DataFrame:
    first = messages.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", F.struct("turn", "text")).alias("text"))
    return first.select("conv_id", title_of(F.col("text")).alias("title"))


def parse_citations(messages: DataFrame) -> DataFrame:
    """(message_id, file_path, start_line, end_line) of each `[file:path:La-Lb]`, each once."""
    pattern = r"\[file:([^\]:]+):L(\d+)-L(\d+)\]"
    group = lambda k: F.regexp_extract_all("content", F.lit(pattern), F.lit(k))
    rows = messages.select("message_id", F.explode(F.arrays_zip(group(1).alias("p"), group(2).alias("a"), group(3).alias("b"))).alias("x"))
    return rows.select("message_id", F.col("x.p").alias("file_path"), F.col("x.a").cast("int").alias("start_line"), F.col("x.b").cast("int").alias("end_line")).distinct()


def validate_citations(citations: DataFrame, files: DataFrame) -> DataFrame:
    """citations with why they don't hold: the file is unknown, or a line lies outside of it; null if they hold."""
    known = files.select(F.col("path").alias("file_path"), "line_count")
    reason = (
        F.when(F.col("line_count").isNull(), "unknown file")
        .when((F.col("start_line") < 1) | (F.col("start_line") > F.col("line_count")), "start out of range")
        .when((F.col("end_line") < F.col("start_line")) | (F.col("end_line") > F.col("line_count")), "end out of range")
    )
    return citations.join(known, "file_path", "left").withColumn("reason", reason).drop("line_count")


def god_files(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files of more than 15 functions (critical) or 500 lines (warning)."""
    n = symbols.where(F.col("kind").isin("function", "method")).groupBy("repo_id", "file_id").agg(F.count("*").alias("n"))
    rows = files.join(n, ["repo_id", "file_id"], "left").withColumn("n_functions", F.coalesce("n", F.lit(0)))
    severity = F.when(F.col("n_functions") > 15, "critical").otherwise("warning")
    return rows.where("n_functions > 15 OR line_count > 500").select("repo_id", "path", "n_functions", "line_count", severity.alias("severity"))
