"""Smaller reports: patterns, annotations, paging, overlap removal, impact shares, jobs and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_of


def drop_overlaps(ranked: DataFrame, *, share: float = 0.5, most: int = 15) -> DataFrame:
    """Greedy by score: a chunk goes if at least `share` of its lines lie in a kept chunk of its file; then the first `most` of each query.

    ranked (query_id, file_path, chunk_id, start_line, end_line, score). A query's candidates of one file are few and are
    folded in one array; rows of different files never meet.
    """
    item = F.struct((-F.col("score")).alias("order"), "chunk_id", "start_line", "end_line")
    lists = ranked.groupBy("query_id", "file_path").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def lies_in(x: Column, k: Column) -> Column:
        common = F.least(x["end_line"], k["end_line"]) - F.greatest(x["start_line"], k["start_line"]) + 1
        return common >= (x["end_line"] - x["start_line"] + 1) * share

    def add(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda k: lies_in(x, k)), kept).otherwise(F.concat(kept, F.array(x)))

    kept = lists.withColumn("kept", F.aggregate("items", F.slice("items", 1, 0), add))
    rows = kept.select("query_id", "file_path", F.explode("kept").alias("x")).select(
        "query_id", "file_path", F.col("x.chunk_id").alias("chunk_id"), "x.start_line", "x.end_line", (-F.col("x.order")).alias("score")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id", "file_path")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def page_results(ranked: DataFrame, *, limit: int, offset: int) -> DataFrame:
    """Each query's results once for each (file_path, start_line), the rows of one page, and the total before paging."""
    one = Window.partitionBy("query_id", "file_path", "start_line").orderBy(F.desc("score"), "chunk_id")
    unique = ranked.withColumn("n", F.row_number().over(one)).where("n = 1").drop("n")
    query = Window.partitionBy("query_id")
    rows = unique.withColumns(
        {"total": F.count("*").over(query), "place": F.row_number().over(query.orderBy(F.desc("score"), "chunk_id", "file_path", "start_line"))}
    )
    return rows.where(F.col("place").between(offset + 1, offset + limit))


def impact_shares(rows: DataFrame) -> DataFrame:
    """Each node's share of its source's and depth's risk, and where in the ring it starts."""
    ring = Window.partitionBy("repo_id", "source", "depth")
    before = ring.orderBy(F.desc("risk"), "node").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("risk").over(ring)
    return rows.withColumns({"share": F.col("risk") / total, "start": F.coalesce(F.sum("risk").over(before), F.lit(0)) / total})


def naming_mix(symbols: DataFrame) -> DataFrame:
    """snake_case function names of repositories that use camelCase as well."""
    calls = symbols.where(F.col("kind").isin("function", "method"))
    snake, camel = F.col("name").rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)+$"), F.col("name").rlike("^[a-z][a-z0-9]*([A-Z][a-z0-9]*)+$")
    repo = Window.partitionBy("repo_id")
    marked = calls.withColumns({"snake": snake, "both": (F.count_if(snake).over(repo) > 0) & (F.count_if(camel).over(repo) > 0)})
    return marked.where("snake AND both").drop("snake", "both")


def parameter_count(signature: Column) -> Column:
    """Top-level commas of the first parentheses, plus one; 0 for empty ones."""
    inner = F.regexp_extract(signature, r"\((.*)\)", 1)
    fold = F.aggregate(
        F.split(inner, ""),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n")),
        lambda a, c: F.struct(
            (a["depth"] + F.when(c.isin("(", "[", "{", "<"), 1).when(c.isin(")", "]", "}", ">"), -1).otherwise(0)).alias("depth"),
            (a["n"] + F.when((c == ",") & (a["depth"] == 0), 1).otherwise(0)).alias("n"),
        ),
    )
    return F.when(F.trim(inner) == "", 0).otherwise(fold["n"] + 1)


def thread_detail(comments: DataFrame) -> DataFrame:
    """(thread_id, comments) in order of time."""
    return comments.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "author", "text"))).alias("comments"))


def open_threads(threads: DataFrame, status: str = "open") -> DataFrame:
    """(repo_id, n_open, n_threads): threads of a status, and all."""
    return threads.groupBy("repo_id").agg(F.count_if(F.col("status") == status).alias("n_open"), F.count("*").alias("n_threads"))


def latest_conversations(conversations: DataFrame, most: int = 20) -> DataFrame:
    """The newest conversations (user_id, conv_id, updated_at) of each user, with their place; ties by conv_id."""
    order = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "conv_id")
    return conversations.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def messages_of(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the messages of the conversations (conv_id) in order of turn."""
    own = messages.join(conversations.select("conv_id").distinct(), "conv_id", "left_semi")
    return own.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("place"), "role", "text")


def citation_density(messages: DataFrame, valid: DataFrame) -> DataFrame:
    """Of each message: words, valid citations, whether one for each 100 words is reached, and whether over 30 words have none."""
    n = valid.where("reason IS NULL").groupBy("message_id").agg(F.count("*").alias("n"))
    words = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
    rows = messages.select("message_id", words.alias("n_words")).join(n, "message_id", "left").withColumn("n_valid", F.coalesce("n", F.lit(0))).drop("n")
    return rows.withColumns(
        {"dense": F.col("n_valid") >= F.greatest(F.lit(1.0), F.col("n_words") / 100), "uncited": (F.col("n_words") > 30) & (F.col("n_valid") == 0)}
    )


def default_summaries(commits: DataFrame) -> DataFrame:
    """(sha, summary, level): the message cut to 120 characters, level minor."""
    return commits.select("sha", F.left("message", F.lit(120)).alias("summary"), F.lit("minor").alias("level"))


def latest_job(jobs: DataFrame) -> DataFrame:
    """The newest job of each repository, as (repo_id, job_id, status, created_at) and its progress if jobs has one."""
    cols = ["job_id", "status", "created_at"] + ["progress"] * ("progress" in jobs.columns)
    newest = jobs.groupBy("repo_id").agg(F.max_by(F.struct(*cols), F.struct("created_at", "job_id")).alias("x"))
    return newest.select("repo_id", "x.*")


def workspace_repos(repos: DataFrame) -> DataFrame:
    """Of each workspace: the newest repository and their number."""
    return repos.groupBy("workspace_id").agg(F.max_by("repo_id", F.struct("created_at", "repo_id")).alias("newest"), F.count("*").alias("n_repos"))


def bookmarks_by_file(bookmarks: DataFrame, text: str = "") -> DataFrame:
    """(user_id, file_path, n, titles): each user's bookmarks (user_id, file_path, title, note, created_at) whose title, path or note holds the text, case
    aside, newest first."""
    hit = F.lower(F.concat_ws("\n", "title", "file_path", "note")).contains(text.lower())
    titles = F.reverse(F.array_sort(F.collect_list(F.struct("created_at", title_of(F.col("title")).alias("title")))))
    return bookmarks.where(hit).groupBy("user_id", "file_path").agg(F.count("*").alias("n"), F.transform(titles, lambda t: t["title"]).alias("titles"))


def progress(rows: DataFrame, n_steps: int) -> DataFrame:
    """The newest row of each user, repository and role, with the percentage of steps that are done."""
    newest = rows.groupBy("user_id", "repo_id", "role").agg(F.max_by("completed_steps", "updated_at").alias("completed_steps"))
    return newest.withColumn("percent", F.round(F.size(F.array_distinct("completed_steps")) * 100 / n_steps).cast("int"))


def manifest_dependencies(manifests: DataFrame) -> DataFrame:
    """(from_repo, to_repo, name): repositories whose package another one's manifest (repo_id, content) depends on."""
    kind = "struct<name:string,dependencies:map<string,string>,devDependencies:map<string,string>>"
    read = manifests.select("repo_id", F.from_json("content", kind).alias("m"))
    none = F.create_map().cast("map<string,string>")
    names = F.array_union(F.map_keys(F.coalesce("m.dependencies", none)), F.map_keys(F.coalesce("m.devDependencies", none)))
    wants = read.select(F.col("repo_id").alias("from_repo"), F.explode(names).alias("name"))
    has = read.where("m.name IS NOT NULL").select(F.col("repo_id").alias("to_repo"), F.col("m.name").alias("name"))
    return wants.join(has, "name").where("from_repo <> to_repo").select("from_repo", "to_repo", "name").distinct()
