"""Files as tables: scanning, filters, facts, languages, snapshots and directory trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What the scan leaves out, and languages by file name and by extension.
SKIP_DIRS = [
    "node_modules", ".git", "vendor", "dist", "build", "__pycache__", ".next", ".nuxt", "coverage", ".cache", ".tox", ".venv", "venv", ".env", "env",
    ".eggs", ".mypy_cache", ".pytest_cache", ".gradle", ".idea", ".vscode", ".vs", "target", "out", ".output", ".turbo", ".vercel", ".svelte-kit",
    "bower_components", ".bundle", "__snapshots__",
]
SKIP_EXTENSIONS = [
    ".min.js", ".min.css", ".map", ".lock", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".woff", ".woff2", ".ttf", ".eot", ".mp4", ".webm",
    ".mp3", ".wav", ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z", ".rar", ".pdf", ".exe", ".dll", ".so", ".dylib", ".pyc", ".pyo", ".class", ".o",
    ".obj", ".a", ".lib", ".wasm", ".bin", ".dat", ".db", ".sqlite", ".sqlite3",
]
SKIP_FILES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "Gemfile.lock", "poetry.lock", "composer.lock", "go.sum", ".DS_Store",
    "Thumbs.db",
]
MOST_BYTES = 1_048_576
#: Language by extension.
EXTENSIONS = {
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript",
    "cts": "typescript", "py": "python", "pyi": "python", "pyw": "python", "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp",
    "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "cs": "csharp", "rb": "ruby", "rake": "ruby", "gemspec": "ruby", "php": "php",
    "swift": "swift", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "sh": "shell", "bash": "shell", "zsh": "shell", "html": "html",
    "htm": "html", "css": "css", "scss": "scss", "sass": "sass", "less": "less", "vue": "vue", "svelte": "svelte", "json": "json", "yaml": "yaml",
    "yml": "yaml", "toml": "toml", "xml": "xml", "ini": "ini", "cfg": "ini", "md": "markdown", "mdx": "markdown", "rst": "restructuredtext",
    "tex": "latex", "sql": "sql", "ex": "elixir", "exs": "elixir", "erl": "erlang", "hs": "haskell", "lua": "lua", "r": "r", "dart": "dart",
    "zig": "zig", "dockerfile": "dockerfile", "graphql": "graphql", "gql": "graphql", "proto": "protobuf",
}
#: Language by whole file name.
FILE_NAMES = {
    "Dockerfile": "dockerfile", "Makefile": "makefile", "CMakeLists.txt": "cmake", "Rakefile": "ruby", "Gemfile": "ruby", "Vagrantfile": "ruby",
    ".gitignore": "gitignore", ".dockerignore": "dockerignore", ".env": "dotenv", ".env.example": "dotenv", ".env.local": "dotenv",
}


def scan_files(spark: SparkSession, root: str, repo_id: str) -> DataFrame:
    """(repo_id, path, size_bytes, bytes) of all files below root; unreadable ones are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root)
    base = root.rstrip("/") + "/"
    path = F.substring_index(F.col("path"), base, -1)
    return raw.select(F.lit(repo_id).alias("repo_id"), path.alias("path"), F.col("length").alias("size_bytes"), F.col("content").alias("bytes"))


def skip_filter(files: DataFrame) -> DataFrame:
    """files (path, size_bytes) without listed and dotted directories, lock, generated and binary files, empty and large ones."""
    parts = F.split("path", "/")
    folders, name = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
    endings = "|".join(e.replace(".", r"\.") for e in SKIP_EXTENSIONS)
    return files.where(
        ~F.exists(folders, lambda d: d.isin(SKIP_DIRS) | d.startswith("."))
        & ~name.isin(SKIP_FILES)
        & ~F.lower(name).rlike(f"(?:{endings})$")
        & F.col("size_bytes").between(1, MOST_BYTES)
    )


def drop_binary(files: DataFrame) -> DataFrame:
    """files (bytes) without those that have a zero byte in their first 8192."""
    head = F.decode(F.substring("bytes", 1, 8192), "ISO-8859-1")
    return files.where(F.instr(head, "\0") == 0)


def file_facts(files: DataFrame) -> DataFrame:
    """files (content) with size_bytes, content_hash and line_count."""
    return files.withColumns(
        {
            "size_bytes": F.octet_length("content").cast("long"),
            "content_hash": F.sha2("content", 256),
            "line_count": F.size(F.split("content", "\n")),
        }
    )


def language_of(path: Column) -> Column:
    """The language by file name, else by the extension after the last dot; null if neither is known."""
    name = F.element_at(F.split(path, "/"), -1)
    pairs = lambda table: [F.lit(x) for pair in table.items() for x in pair]
    ending = F.when(F.instr(name, ".") > 0, F.lower(F.element_at(F.split(name, r"\."), -1)))
    return F.coalesce(F.create_map(*pairs(FILE_NAMES))[name], F.create_map(*pairs(EXTENSIONS))[ending])


def diff_snapshot(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(repo_id, path, status): new, changed, unchanged or deleted by content_hash."""
    old = previous.select("repo_id", "path", F.col("content_hash").alias("old"))
    now = current.select("repo_id", "path", F.col("content_hash").alias("now"))
    status = (
        F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("old") == F.col("now"), "unchanged").otherwise("changed")
    )
    return old.join(now, ["repo_id", "path"], "full_outer").select("repo_id", "path", status.alias("status"))


def apply_snapshot(tables: dict[str, DataFrame], fresh: dict[str, DataFrame], diff: DataFrame) -> dict[str, DataFrame]:
    """Each table (repo_id, path, ...) without rows of files that went or changed, with the fresh rows of changed and new ones."""
    stale = diff.where(F.col("status").isin("changed", "deleted")).select("repo_id", "path")
    return {
        name: rows.join(stale, ["repo_id", "path"], "left_anti").unionByName(fresh[name]) if name in fresh else rows.join(stale, ["repo_id", "path"], "left_anti")
        for name, rows in tables.items()
    }


def write_index(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet by repo_id; only the repositories in the tables are replaced."""
    for name, rows in tables.items():
        rows.write.partitionBy("repo_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/{name}")


def directory_tree(files: DataFrame) -> DataFrame:
    """(repo_id, directory, n_files, n_directories) of every directory: what lies directly in it."""
    parts = F.split("path", "/")
    nodes = files.select(
        "repo_id",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(parts)),
                lambda i: F.struct(
                    F.array_join(F.slice(parts, 1, i - 1), "/").alias("directory"), parts[i - 1].alias("name"), (i == F.size(parts)).alias("is_file")
                ),
            )
        ).alias("x"),
    ).select("repo_id", "x.*")
    return nodes.distinct().groupBy("repo_id", "directory").agg(
        F.count_if("is_file").alias("n_files"), F.count_if(~F.col("is_file")).alias("n_directories")
    )


def path_filter(files: DataFrame, term: str) -> DataFrame:
    return files.where(F.lower("path").contains(term.lower()))


def parse_commits(lines: DataFrame) -> DataFrame:
    """(sha, date, author, subject) of lines `sha|date|author|subject`; the subject may hold more bars."""
    p = F.split("value", r"\|", 4)
    return lines.where(F.size(p) == 4).select(*(p[i].alias(n) for i, n in enumerate(("sha", "date", "author", "subject"))))


def parse_numstat(lines: DataFrame) -> DataFrame:
    """(path, additions, deletions) of tab-separated lines; `-`, a binary file, counts as 0."""
    p = F.split("value", "\t", 3)
    number = lambda c: F.coalesce(c.try_cast("int"), F.lit(0))
    return lines.where(F.size(p) == 3).select(p[2].alias("path"), number(p[0]).alias("additions"), number(p[1]).alias("deletions"))


def parse_hunks(lines: DataFrame) -> DataFrame:
    """(line) for each changed new line of `@@ -a,b +c,d @@`; d counts as 1 if missing, and at least 1 line is given."""
    start = F.regexp_extract("value", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
    count = F.coalesce(F.nullif(F.regexp_extract("value", r"^@@ -\d+(?:,\d+)? \+\d+,(\d+)", 1), F.lit("")).cast("int"), F.lit(1))
    first = start.try_cast("int")
    return lines.where(start != "").select(F.explode(F.sequence(first, first + F.greatest(count, F.lit(1)) - 1)).alias("line"))


def index_report(files: DataFrame, symbols: DataFrame, chunks: DataFrame, embeddings: DataFrame, diff: DataFrame, errors: DataFrame) -> DataFrame:
    """(repo_id, files_processed, files_skipped, symbols, chunks, embeddings, errors): what an index run did, by its tables and its diff_snapshot.

    embeddings (chunk_id), errors (repo_id, path, message): one row for each file that failed.
    """
    repos = files.select("repo_id").union(diff.select("repo_id")).distinct()
    done = diff.groupBy("repo_id").agg(
        F.count_if(F.col("status").isin("new", "changed")).alias("files_processed"), F.count_if(F.col("status") == "unchanged").alias("files_skipped")
    )
    count = lambda rows, name: rows.groupBy("repo_id").agg(F.count("*").alias(name))
    vectors = chunks.select("repo_id", "chunk_id").join(embeddings.select("chunk_id"), "chunk_id")
    out = repos.join(done, "repo_id", "left")
    names = ["files_processed", "files_skipped"]
    for rows, name in ((symbols, "symbols"), (chunks, "chunks"), (vectors, "embeddings"), (errors, "errors")):
        out = out.join(count(rows, name), "repo_id", "left")
        names.append(name)
    return out.select("repo_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))
