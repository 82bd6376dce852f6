"""Reports of design patterns, weak spots and inconsistencies: rows (pattern_id, repo_id, path, start_line, end_line, symbol, evidence)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, traverse
from .reports import naming_mix, parameter_count
from .workspace import god_files

# What the reports look for in code and in paths.
SINGLETON = [
    r"(?i)let\s+instance\s*[=:]",
    r"export\s+const\s+\w+\s*=\s*new\s+\w+",
    r"export\s+const\s+\w+\s*=\s*\w+\(\)",
    r"getInstance\s*\(",
    r"_instance\s*=",
    r"static\s+instance\s*:",
]
FACTORY = [
    r"switch\s*\(.*\)\s*\{[\s\S]{0,500}return\s+new\s+\w+",
    r"if\s*\(.*\)\s*\{[\s\S]{0,200}return\s+new\s+\w+",
    r"return\s+\{\s*\.\.\.",
]
OBSERVER = [r"EventEmitter", r"\.on\s*\(", r"\.emit\s*\(", r"addEventListener", r"removeEventListener", r"\.subscribe\s*\(", r"Observable"]
LAYERS = r"(?i)(?:service|queries|repository|repo|store|dao)\.(?:ts|js|tsx)$"
BARREL = r"(?:^|/)index\.(?:ts|js|tsx|jsx)$"
# Each report's type and severity.
PATTERNS = {
    "singleton": ("design-pattern", "info"),
    "factory": ("design-pattern", "info"),
    "repository-service-layer": ("design-pattern", "info"),
    "observer-event": ("design-pattern", "info"),
    "module-pattern": ("design-pattern", "info"),
    "god-class": ("anti-pattern", "warning"),
    "circular-dependencies": ("anti-pattern", "critical"),
    "deep-nesting": ("anti-pattern", "warning"),
    "long-parameter-list": ("anti-pattern", "warning"),
    "dead-code": ("anti-pattern", "warning"),
    "naming-convention-mix": ("inconsistency", "warning"),
    "missing-service-queries-pattern": ("inconsistency", "warning"),
    "inconsistent-error-handling": ("inconsistency", "warning"),
}


def _found(rows: DataFrame, pattern_id: str, evidence: Column, *, start: Column | None = None, end: Column | None = None, symbol: Column | None = None) -> DataFrame:
    return rows.select(
        F.lit(pattern_id).alias("pattern_id"), "repo_id", "path", (start if start is not None else F.lit(1)).cast("int").alias("start_line"),
        (end if end is not None else F.lit(1)).cast("int").alias("end_line"), (symbol if symbol is not None else F.lit(None)).cast("string").alias("symbol"),
        evidence.cast("string").alias("evidence"),
    )


def _matches(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur."""
    return reduce(lambda a, b: a + b, (text.rlike(p).cast("int") for p in patterns))


def _first_chunk(chunks: DataFrame, hit: Column) -> DataFrame:
    """The first chunk of each file for which hit holds."""
    first = Window.partitionBy("repo_id", "file_id").orderBy("start_line", "chunk_id")
    return chunks.where(hit).withColumn("n_", F.row_number().over(first)).where("n_ = 1").drop("n_")


def _functions(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("kind").isin("function", "method", "arrow_function"))


def singletons(chunks: DataFrame) -> DataFrame:
    """Files with a single shared instance; chunks (repo_id, file_id, path, chunk_id, start_line, end_line, content)."""
    which = F.coalesce(*(F.when(F.col("content").rlike(p), F.lit(i)) for i, p in enumerate(SINGLETON)))
    rows = _first_chunk(chunks, _matches(F.col("content"), SINGLETON) > 0)
    return _found(rows, "singleton", F.concat(F.lit("pattern "), which), start=F.col("start_line"), end=F.col("end_line"))


def factories(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files with functions that return new objects by branches."""
    some = chunks.join(_functions(symbols).select("repo_id", "file_id").distinct(), ["repo_id", "file_id"], "left_semi")
    which = F.coalesce(*(F.when(F.col("content").rlike(p), F.lit(i)) for i, p in enumerate(FACTORY)))
    rows = _first_chunk(some, _matches(F.col("content"), FACTORY) > 0)
    return _found(rows, "factory", F.concat(F.lit("pattern "), which), start=F.col("start_line"), end=F.col("end_line"))


def _with_count(files: DataFrame, symbols: DataFrame) -> DataFrame:
    counts = symbols.groupBy("repo_id", "file_id").agg(F.count("*").alias("n"))
    return files.join(counts, ["repo_id", "file_id"])


def service_layers(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files named as a service or data layer that have functions; files (repo_id, file_id, path, line_count)."""
    rows = _with_count(files.where(F.col("path").rlike(LAYERS)), symbols.where(F.col("kind").isin("function", "method")))
    return _found(rows, "repository-service-layer", F.concat("n", F.lit(" functions")), end=F.col("line_count"))


def observers(chunks: DataFrame) -> DataFrame:
    """Files with a chunk that has two or more marks of events."""
    n = _matches(F.col("content"), OBSERVER)
    rows = _first_chunk(chunks.withColumn("marks", n), F.col("marks") >= 2)
    return _found(rows, "observer-event", F.concat("marks", F.lit(" marks")), start=F.col("start_line"), end=F.col("end_line"))


def barrels(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Index files that have symbols."""
    rows = _with_count(files.where(F.col("path").rlike(BARREL)), symbols)
    return _found(rows, "module-pattern", F.concat("n", F.lit(" symbols")), end=F.col("line_count"))


def circular_dependencies(symbols: DataFrame, relations: DataFrame, *, max_len: int = 5) -> DataFrame:
    """File pairs (first node's file and last node's) of import cycles, each pair once."""
    cycles = traverse.find_cycles(relations, max_len=max_len)
    ends = cycles.select("repo_id", F.col("nodes")[0].alias("a"), F.element_at("nodes", -1).alias("b")).distinct()
    place = symbols.select("repo_id", "symbol_id", "path")
    both = ends.join(place.toDF("repo_id", "a", "path_a"), ["repo_id", "a"]).join(place.toDF("repo_id", "b", "path_b"), ["repo_id", "b"])
    pairs = both.select("repo_id", F.least("path_a", "path_b").alias("path"), F.greatest("path_a", "path_b").alias("other")).distinct()
    return _found(pairs, "circular-dependencies", F.concat("path", F.lit(" <-> "), "other"))


def deep_nesting(symbols: DataFrame, *, over: int = 3) -> DataFrame:
    """The deepest symbol of each file whose chain of parents is longer than `over`; ties by line and id."""
    deep = graph.nesting_depth(symbols).where(F.col("depth") > over)
    rows = deep.join(symbols.select("repo_id", "symbol_id", "file_id", "path", "name", "start_line", "end_line"), ["repo_id", "symbol_id"])
    first = Window.partitionBy("repo_id", "file_id").orderBy(F.desc("depth"), "start_line", "symbol_id")
    rows = rows.withColumn("n_", F.row_number().over(first)).where("n_ = 1")
    return _found(rows, "deep-nesting", F.concat(F.lit("depth "), "depth"), start=F.col("start_line"), end=F.col("end_line"), symbol=F.col("name"))


def long_parameter_lists(symbols: DataFrame, *, over: int = 5, most: int = 50) -> DataFrame:
    """Functions with more than `over` parameters, the first `most` of each repository by path and line."""
    kinds = F.col("kind").isin("function", "method", "arrow_function", "constructor")
    rows = symbols.where(kinds & F.col("signature").isNotNull()).withColumn("n", parameter_count(F.col("signature"))).where(F.col("n") > over)
    first = Window.partitionBy("repo_id").orderBy("path", "start_line", "symbol_id")
    rows = rows.withColumn("n_", F.row_number().over(first)).where(F.col("n_") <= most)
    return _found(rows, "long-parameter-list", F.concat("n", F.lit(" parameters")), start=F.col("start_line"), end=F.col("end_line"), symbol=F.col("name"))


def dead_code(symbols: DataFrame, relations: DataFrame, *, most: int = 50) -> DataFrame:
    """Symbols that nothing refers to, the first `most` of each repository by path, line and id."""
    rows = graph.unreferenced_symbols(symbols, relations)
    first = Window.partitionBy("repo_id").orderBy("path", "start_line", "symbol_id")
    rows = rows.withColumn("n_", F.row_number().over(first)).where(F.col("n_") <= most)
    return _found(rows, "dead-code", F.col("kind"), start=F.col("start_line"), end=F.col("end_line"), symbol=F.col("name"))


def naming_mixes(symbols: DataFrame, files: DataFrame, *, most: int = 20) -> DataFrame:
    """snake_case names of scripts whose repository has camelCase ones too, the first `most` by path, line and name."""
    rows = naming_mix(symbols.join(files.where(F.col("language").isin("typescript", "javascript")).select("repo_id", "file_id"), ["repo_id", "file_id"], "left_semi"))
    first = Window.partitionBy("repo_id").orderBy("path", "start_line", "name")
    rows = rows.withColumn("n_", F.row_number().over(first)).where(F.col("n_") <= most)
    return _found(rows, "naming-convention-mix", F.lit("snake_case"), start=F.col("start_line"), end=F.col("end_line"), symbol=F.col("name"))


def missing_companions(files: DataFrame, *, least: int = 3) -> DataFrame:
    """Directories with a service file but no queries or repository file, where `least` directories of the repository have a service file."""
    name, folder = F.lower(F.element_at(F.split("path", "/"), -1)), F.regexp_replace("path", "/[^/]*$", "")
    dirs = files.where(F.col("path").contains("/")).groupBy("repo_id", folder.alias("directory")).agg(
        F.max(name.startswith("service.")).alias("service"), F.max(name.startswith("queries.") | name.startswith("repository.")).alias("data")
    )
    dirs = dirs.where("service").withColumn("n", F.count("*").over(Window.partitionBy("repo_id"))).where((F.col("n") >= least) & ~F.col("data"))
    rows = dirs.withColumn("path", F.concat("directory", F.lit("/")))
    return _found(rows, "missing-service-queries-pattern", F.concat("n", F.lit(" service directories")))


def unhandled_routes(files: DataFrame, *, most: int = 20) -> DataFrame:
    """Route files that await without a try, where other route files of the repository have one; files with content."""
    routes = files.where(F.col("path").rlike(r"/route\.(?:ts|js)$|route\.tsx$"))
    safe = F.col("content").contains("try {") | F.col("content").contains("try{")
    repo = Window.partitionBy("repo_id")
    rows = routes.withColumns({"safe": safe, "awaits": F.col("content").contains("async") | F.col("content").contains("await")})
    rows = rows.withColumns({"n_safe": F.count_if("safe").over(repo), "n_": F.count("*").over(repo)}).where("NOT safe AND awaits AND n_safe > 0 AND n_ >= 2")
    rows = rows.withColumn("n_", F.row_number().over(repo.orderBy("path"))).where(F.col("n_") <= most)
    return _found(rows, "inconsistent-error-handling", F.concat("n_safe", F.lit(" handle errors")), end=F.col("line_count"))


def god_classes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    rows = god_files(files, symbols)
    return _found(rows, "god-class", F.concat("n_functions", F.lit(" functions")), end=F.col("line_count"))


def detect_patterns(files: DataFrame, chunks: DataFrame, symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """All reports in one table, with each pattern's type and severity. A file of more than 15 functions is critical."""
    every = [
        singletons(chunks), factories(chunks, symbols), service_layers(files, symbols), observers(chunks), barrels(files, symbols),
        god_classes(files, symbols), circular_dependencies(symbols, relations), deep_nesting(symbols), long_parameter_lists(symbols),
        dead_code(symbols, relations), naming_mixes(symbols, files), missing_companions(files), unhandled_routes(files),
    ]
    rows = reduce(DataFrame.unionByName, every)
    pick = lambda i: F.create_map(*(x for k, v in PATTERNS.items() for x in (F.lit(k), F.lit(v[i]))))[F.col("pattern_id")]
    many = (F.col("pattern_id") == "god-class") & (F.split_part("evidence", F.lit(" "), F.lit(1)).cast("int") > 15)
    return rows.withColumns({"pattern_type": pick(0), "severity": F.when(many, "critical").otherwise(pick(1))})


def pattern_report(found: DataFrame) -> DataFrame:
    """(repo_id, pattern_id, pattern_type, severity, n): each pattern's findings, with the worst severity among them."""
    worst = F.max(F.array_position(F.array(*map(F.lit, ("info", "warning", "critical"))), F.col("severity")))
    rows = found.groupBy("repo_id", "pattern_id", "pattern_type").agg(worst.alias("w"), F.count("*").alias("n"))
    names = F.array(*map(F.lit, ("info", "warning", "critical")))
    return rows.select("repo_id", "pattern_id", "pattern_type", F.element_at(names, F.col("w").cast("int")).alias("severity"), "n")


def pattern_summary(report: DataFrame) -> DataFrame:
    """(repo_id, design_patterns, anti_patterns, inconsistencies, critical) of a pattern_report."""
    of = lambda k: F.count_if(F.col("pattern_type") == k)
    return report.groupBy("repo_id").agg(
        of("design-pattern").alias("design_patterns"), of("anti-pattern").alias("anti_patterns"), of("inconsistency").alias("inconsistencies"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
    )


def filter_patterns(report: DataFrame, *, pattern_type: str | None = None, severity: str | None = None) -> DataFrame:
    rows = report if pattern_type is None else report.where(F.col("pattern_type") == pattern_type)
    return rows if severity is None else rows.where(F.col("severity") == severity)
