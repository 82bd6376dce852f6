"""Import resolution and relations between symbols, enclosing symbols, and lookups by name and line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlaps
from .retrieval import contains_join

# The endings that a module path leaves out.
_ENDING = r"\.(ts|tsx|js|jsx|mjs|cjs|py|go|rs|java|rb|php|kt|swift|cs|scala)$"
DEFINITION_KINDS = ("function", "method", "class", "interface", "type", "enum")


def path_index(files: DataFrame) -> DataFrame:
    """(repo_id, key, target): every name a file (repo_id, path) can be imported by: its path without ending and all ends of it, and for
    an index file its directory."""
    parts = F.split(F.regexp_replace("path", _ENDING, ""), "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    folders = F.slice(parts, 1, F.size(parts) - 1)
    is_index = (F.element_at(parts, -1) == "index") & (F.size(parts) > 1)
    own = F.when(is_index, F.array(F.array_join(folders, "/"), F.get(parts, F.size(parts) - 2))).otherwise(F.array().cast("array<string>"))
    rows = files.select("repo_id", F.col("path").alias("target"), F.explode(F.array_distinct(F.concat(suffixes, own))).alias("key"))
    return rows.select("repo_id", "key", "target").distinct()


def normalized_source(source: Column, path: Column) -> Column:
    """The path that a local import means: `@/` is the root, `./` and `../` start at the importing file; null for packages."""
    parts = F.split(path, "/")
    joined = F.concat(F.slice(parts, 1, F.size(parts) - 1), F.split(source, "/"))
    walked = F.aggregate(
        F.filter(joined, lambda p: ~p.isin("", ".")),
        F.array().cast("array<string>"),
        lambda a, p: F.when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))),
    )
    return (
        F.when(source.rlike(r"^\.\.?/"), F.array_join(walked, "/"))
        .when(source.startswith("@/"), F.substr(source, F.lit(3)))
        .when(source.startswith("/") | source.startswith("."), source)
    )


def resolve_imports(imports: DataFrame, index: DataFrame) -> DataFrame:
    """imports (repo_id, path, source, ...) with target: the files by the whole path, else by its last part."""
    rows = imports.withColumn("key", normalized_source(F.col("source"), F.col("path"))).where(F.col("key").isNotNull())
    whole = rows.join(index, ["repo_id", "key"])
    missed = rows.join(index.select("repo_id", "key").distinct(), ["repo_id", "key"], "left_anti")
    last = missed.withColumn("key", F.element_at(F.split("key", "/"), -1)).where("key <> ''").join(index, ["repo_id", "key"])
    return whole.unionByName(last).drop("key")


def import_edges(symbols: DataFrame, imports: DataFrame, exports: DataFrame, index: DataFrame) -> DataFrame:
    """(repo_id, path, src, dst, relation_type): an edge of the importing file (path) for each imported name that the target exports.

    symbols (repo_id, path, symbol_id, name, kind, start_line), imports (repo_id, path, source, names), exports (repo_id, path, name), index as of path_index.
    A file without exports offers all its symbols. The edge starts at a variable of that name in the importing file, else at its first symbol.
    """
    order = F.struct("start_line", "symbol_id")
    named = resolve_imports(imports, index).select("repo_id", "path", "target", F.explode("names").alias("name"))
    closed = exports.select("repo_id", "path").distinct()
    there = symbols.join(named.select("repo_id", F.col("target").alias("path"), "name").distinct(), ["repo_id", "path", "name"], "left_semi")
    offered = there.join(exports, ["repo_id", "path", "name"], "left_semi").unionByName(there.join(closed, ["repo_id", "path"], "left_anti"))
    ends = offered.groupBy("repo_id", F.col("path").alias("target"), "name").agg(F.max_by("symbol_id", order).alias("dst"))
    own = symbols.join(named.select("repo_id", "path").distinct(), ["repo_id", "path"], "left_semi")
    variables = own.where("kind = 'variable'").groupBy("repo_id", "path", "name").agg(F.min_by("symbol_id", order).alias("own"))
    firsts = own.groupBy("repo_id", "path").agg(F.min_by("symbol_id", order).alias("first"))
    rows = named.join(ends, ["repo_id", "target", "name"]).join(variables, ["repo_id", "path", "name"], "left").join(firsts, ["repo_id", "path"], "left")
    edges = rows.select("repo_id", "path", F.coalesce("own", "first").alias("src"), "dst", F.lit("imports").alias("relation_type"))
    return edges.where("src IS NOT NULL").distinct()


def build_relations(symbols: DataFrame, imports: DataFrame, exports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, src, dst, relation_type): import_edges of all files (repo_id, path)."""
    return import_edges(symbols, imports, exports, path_index(files)).drop("path").distinct()


def inheritance_edges(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo_id, path, src, dst, relation_type) for links (repo_id, path, name, relation_type, parent): the parent is the symbol of that name
    in the nearest file: the same one, one of the same directory, any other; ties by path and id."""
    folder = lambda c: F.regexp_replace(c, "[^/]*$", "")
    types = symbols.where(F.col("kind").isin("class", "interface", "type"))
    own = types.groupBy("repo_id", "path", "name").agg(F.min_by("symbol_id", F.struct("start_line", "symbol_id")).alias("src"))
    ends = types.select("repo_id", F.col("name").alias("parent"), F.col("path").alias("parent_path"), F.col("symbol_id").alias("dst"))
    rows = links.join(own, ["repo_id", "path", "name"]).join(ends, ["repo_id", "parent"]).where("src <> dst")
    far = F.when(F.col("path") == F.col("parent_path"), 0).when(folder("path") == folder("parent_path"), 1).otherwise(2)
    return rows.groupBy("repo_id", "path", "src", "parent", "relation_type").agg(F.min_by("dst", F.struct(far, "parent_path", "dst")).alias("dst")).select(
        "repo_id", "path", "src", "dst", "relation_type"
    )


def resolve_inheritance(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo_id, src, dst, relation_type): inheritance_edges without the file."""
    return inheritance_edges(links, symbols).drop("path")


def assign_parents(symbols: DataFrame) -> DataFrame:
    """symbols (repo_id, file_id, symbol_id, start_line, end_line) with parent_symbol_id: the tightest larger symbol of the file around each."""
    key = ["repo_id", "file_id"]
    span = [F.col("start_line").alias("start"), F.col("end_line").alias("end")]
    inner, outer = (symbols.select(*key, F.col("symbol_id").alias(name), *span) for name in ("left_id", "right_id"))
    tightest = overlaps(inner, outer, key, within=True, tightest=True).withColumnsRenamed({"left_id": "symbol_id", "right_id": "parent_symbol_id"})
    return symbols.join(tightest, [*key, "symbol_id"], "left")


def anchor_to_symbol(ranges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo_id, range_id, symbol_id): for ranges (range_id, repo_id, file_id, from_line, to_line) the overlapping symbol of the smallest span."""
    key = ["repo_id", "file_id"]
    wanted = ranges.select(*key, F.col("range_id").alias("left_id"), F.col("from_line").alias("start"), F.col("to_line").alias("end"))
    there = symbols.select(*key, F.col("symbol_id").alias("right_id"), F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    found = overlaps(wanted, there, key, tightest=True)
    return found.select("repo_id", F.col("left_id").alias("range_id"), F.col("right_id").alias("symbol_id"))


def resolve_symbols(names: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo_id, wanted, symbol_id): for names (repo_id, wanted) the symbol of that name, else one that holds it, case aside; the first by name and id."""
    there = symbols.select("repo_id", "symbol_id", "name")
    exact = names.join(there.withColumn("wanted", F.col("name")), ["repo_id", "wanted"])
    missed = names.join(exact.select("repo_id", "wanted").distinct(), ["repo_id", "wanted"], "left_anti")
    near = contains_join(missed, there, "wanted", "name", ["repo_id"])
    rows = exact.unionByName(near)
    return rows.groupBy("repo_id", "wanted").agg(F.min_by("symbol_id", F.struct("name", "symbol_id")).alias("symbol_id"))


def _lowered(wanted: DataFrame) -> DataFrame:
    """wanted (query_id, name, and repo_id if there is one), with names in lower case, each once."""
    repo = [c for c in ("repo_id",) if c in wanted.columns]
    return wanted.select("query_id", *repo, F.lower("name").alias("low_")).distinct()


def find_definitions(wanted: DataFrame, symbols: DataFrame, chunks: DataFrame, most: int = 20) -> DataFrame:
    """(query_id, repo_id, symbol_id, name, kind, path, chunk_id, start_line, end_line, rank): chunks of the symbols of the names, case aside.

    wanted (query_id, name, and repo_id to look in one repository). Classes, functions, interfaces, types and enums before methods, then by name, case aside, path and
    line. The first `most` are taken, of which those without a chunk fall out.
    """
    low = _lowered(wanted)
    later = F.when(F.col("kind").isin("class", "function", "interface", "type", "enum"), 0).otherwise(1)
    there = symbols.where(F.lower("kind").isin(*DEFINITION_KINDS)).withColumns({"low_": F.lower("name"), "line_": F.col("start_line")})
    rows = low.join(there, [c for c in low.columns if c != "query_id"]).select("query_id", "repo_id", "symbol_id", "name", "low_", "kind", "path", "line_", later.alias("later_"))
    rows = rows.join(chunks.select("repo_id", "symbol_id", "chunk_id", "start_line", "end_line"), ["repo_id", "symbol_id"], "left")
    order = Window.partitionBy("query_id").orderBy("later_", "low_", "name", "path", "line_", "repo_id", "symbol_id", "start_line", "chunk_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= most) & F.col("chunk_id").isNotNull())
    return rows.select("query_id", "repo_id", "symbol_id", "name", "kind", "path", "chunk_id", "start_line", "end_line", "rank")


#: The relation types that are a use of their target.
USAGES = ("calls", "uses", "imports", "extends", "implements", "references")


def find_usages(wanted: DataFrame, symbols: DataFrame, relations: DataFrame, chunks: DataFrame, most: int = 20, most_targets: int = 20) -> DataFrame:
    """(query_id, repo_id, symbol_id, path, chunk_id, start_line, end_line, rank): chunks of the symbols that use one of the names, case aside.

    wanted (query_id, name, and repo_id to look in one repository). A query's first `most_targets` symbols by path and line are its targets. Results are ordered by path and line; the first `most`
    are taken, of which those without a chunk fall out.
    """
    low = _lowered(wanted)
    named = low.join(symbols.withColumn("low_", F.lower("name")), [c for c in low.columns if c != "query_id"])
    first = Window.partitionBy("query_id").orderBy("path", "start_line", "repo_id", "symbol_id")
    targets = named.withColumn("n_", F.row_number().over(first)).where(F.col("n_") <= most_targets).select("query_id", "repo_id", F.col("symbol_id").alias("dst"))
    sources = symbols.select("repo_id", F.col("symbol_id").alias("src"), "path")
    used = relations.where(F.col("relation_type").isin(*USAGES)).select("repo_id", "src", "dst")
    rows = targets.join(used, ["repo_id", "dst"]).select("query_id", "repo_id", "src").distinct().join(sources, ["repo_id", "src"]).withColumnRenamed("src", "symbol_id")
    rows = rows.join(chunks.select("repo_id", "symbol_id", "chunk_id", "start_line", "end_line"), ["repo_id", "symbol_id"], "left")
    order = Window.partitionBy("query_id").orderBy("path", F.asc_nulls_last("start_line"), "repo_id", "symbol_id", "chunk_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= most) & F.col("chunk_id").isNotNull())
    return rows.select("query_id", "repo_id", "symbol_id", "path", "chunk_id", "start_line", "end_line", "rank")
