"""What a change that is described in words would touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import retrieval, traverse
from .settled import settled

# The words for a kind of change, in the order in which they are looked for; else it is "modify".
VERBS = [
    ("remove", r"(?i)\b(remove|delete|drop|eliminate|get rid of)\b"),
    ("split", r"(?i)\b(split|break up|decompose|divide)\b"),
    ("merge", r"(?i)\b(merge|combine|consolidate|unify|join)\b"),
    ("move", r"(?i)\b(move|relocate|migrate)\b"),
    ("replace", r"(?i)\b(replace|swap|substitute|switch)\b"),
    ("add", r"(?i)\b(add|create|introduce|implement|insert)\b"),
    ("modify", r"(?i)\b(change|update|refactor|modify|rename|improve|rework|rewrite)\b"),
]
# How files, modules and identifiers look in a description, and capitalised words that are none.
FILES = r"\b([\w./\-]+\.(?:ts|tsx|js|jsx|py|go|rs|java|rb|php|cs|cpp|c|h|md|json|yaml|yml|toml|sql))\b"
MODULES = (
    r"(?i)\b(the\s+)?([a-z][a-z0-9]*(?:-[a-z][a-z0-9]*)*)\s+(?:module|service|component|package|library|handler|controller|middleware|provider|helper"
    r"|util|utils|hook|store|context|reducer|action|selector|resolver|repository|adapter|gateway|client|server)\b"
)
NAMES = (
    r"\b([A-Z][a-zA-Z0-9]*(?:[A-Z][a-zA-Z0-9]*)*|[a-z][a-zA-Z0-9]*(?:[A-Z][a-zA-Z0-9]+)+|[a-z][a-z0-9]*(?:_[a-z][a-z0-9]*)+|[A-Z][A-Z0-9]*(?:_[A-Z][A-Z0-9]*)+)\b"
)
COMMON = [
    "What", "If", "I", "the", "The", "a", "an", "in", "to", "from", "into", "with", "by", "for", "as", "is", "are", "was", "will", "would", "should",
    "could", "can", "do", "does", "did", "be", "been", "have", "has", "had", "this", "that", "these", "those", "my", "your", "its", "our", "their",
    "which", "who", "whom", "when", "where", "how", "why",
]
# How grave a kind of change is for what depends on the changed thing, and whether it breaks it.
SEVERITY = {"remove": "break", "replace": "break", "add": "info"}
BREAKING = ["remove", "move", "split", "replace"]


def change_type(text: Column) -> Column:
    out = None
    for name, pattern in VERBS:
        out = F.when(text.rlike(pattern), F.lit(name)) if out is None else out.when(text.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("modify"))


def parse_change(descriptions: DataFrame) -> DataFrame:
    """descriptions (change_id, repo_id, text) with change_type, files, modules and names."""
    clean = F.trim(F.regexp_replace("text", r"\s+", " "))
    files = F.array_distinct(F.regexp_extract_all(clean, F.lit(FILES), F.lit(1)))
    modules = F.array_distinct(F.regexp_extract_all(clean, F.lit(MODULES), F.lit(2)))
    names = F.array_distinct(F.regexp_extract_all(clean, F.lit(NAMES), F.lit(1)))
    names = F.filter(F.array_except(names, F.array(*map(F.lit, COMMON))), lambda n: (F.length(n) > 2) & ~F.exists(files, lambda f: F.contains(f, n)))
    return descriptions.withColumns({"change_type": change_type(clean), "files": files, "modules": modules, "names": names})


def resolve_targets(changes: DataFrame, files: DataFrame, symbols: DataFrame, *, most_symbols: int = 20, most_near: int = 5) -> tuple[DataFrame, DataFrame]:
    """(change_id, repo_id, path) and (change_id, repo_id, symbol_id, path): what parsed changes mean.

    Files by the end of their path, modules by a directory or file of that name, symbols by name, case aside, the first `most_symbols`, with their
    files. Changes without any of these get up to `most_near` files for each name whose path holds it.
    """
    paths = files.select("repo_id", "path").distinct()
    # a path ends in each of its suffixes, so files are found by a join; a name inside a directory's name counts too
    wanted = changes.select("change_id", "repo_id", F.explode("files").alias("end"))
    ends = paths.withColumn("end", F.explode(F.transform(F.sequence(F.lit(1), F.length("path")), lambda i: F.substr(F.col("path"), i))))
    by_file = wanted.join(ends, ["repo_id", "end"]).select("change_id", "repo_id", "path")
    parts = F.split("path", "/")
    stems = F.concat(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), F.array(F.element_at(parts, -1), F.split_part(F.element_at(parts, -1), F.lit("."), F.lit(1))))
    places = paths.where(F.size(parts) > 1).withColumn("module", F.explode(F.array_distinct(stems)))
    by_module = changes.select("change_id", "repo_id", F.explode("modules").alias("module")).join(places, ["repo_id", "module"]).select("change_id", "repo_id", "path")
    names = changes.select("change_id", "repo_id", F.explode("names").alias("name"))
    there = symbols.select("repo_id", "symbol_id", "path", "start_line", F.lower("name").alias("low")).distinct()
    wanted = names.select("change_id", "repo_id", F.lower("name").alias("low")).distinct()
    # what is first of all names of a change is first of one of them, so names are cut before they meet the changes that share them
    of_name = Window.partitionBy("repo_id", "low").orderBy("path", "start_line", "symbol_id")
    there = there.join(wanted.select("repo_id", "low").distinct(), ["repo_id", "low"]).withColumn("n", F.row_number().over(of_name)).where(F.col("n") <= most_symbols).drop("n")
    found = wanted.join(there, ["repo_id", "low"]).select("change_id", "repo_id", "symbol_id", "path", "start_line").distinct()
    order = Window.partitionBy("change_id").orderBy("path", "start_line", "symbol_id")
    found = settled(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most_symbols).select("change_id", "repo_id", "symbol_id", "path"))
    known = settled(by_file.unionByName(by_module).unionByName(found.select("change_id", "repo_id", "path")).distinct())
    lost = names.join(known.select("change_id").distinct(), "change_id", "left_anti")
    near = retrieval.contains_join(lost, paths, "name", "path", ["repo_id"])
    first = Window.partitionBy("change_id", "name").orderBy("path")
    near = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most_near).select("change_id", "repo_id", "path")
    return known.unionByName(near).distinct(), found


def affected_items(changes: DataFrame, files: DataFrame, symbols: DataFrame, relations: DataFrame, *, max_depth: int = 3) -> DataFrame:
    """(change_id, scope, path, symbol_id, severity, breaks): dependents of the targets, direct or indirect, and target files without any.

    Indirect dependents of a removal are only warned. breaks: whether a direct dependent must be changed.
    """
    targets, found = resolve_targets(changes, files, symbols)
    # changes of the same symbols have the same dependents: they are looked for once for each set of symbols
    aims = found.groupBy("change_id").agg(F.sort_array(F.collect_list(F.struct("repo_id", "symbol_id"))).alias("aims"))
    sets = settled(aims.groupBy("aims").agg(F.min("change_id").alias("set_id")))
    of_set = settled(aims.join(sets, "aims").select("change_id", "set_id"))
    starts = sets.select(F.col("set_id").alias("source"), F.inline("aims")).select("repo_id", "source", F.col("symbol_id").alias("node"))
    reached = traverse.reach(starts, relations, max_depth=max_depth)
    kinds = changes.select("change_id", "change_type")
    place = symbols.select("repo_id", F.col("symbol_id").alias("node"), "path")
    reached = settled(reached.join(place, ["repo_id", "node"]).select(F.col("source").alias("set_id"), "node", "depth", "path"))
    rows = reached.join(of_set.join(kinds, "change_id"), "set_id")
    direct = F.col("depth") == 1
    severity = F.create_map(*(x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))))
    grave = F.when(~direct & (F.col("change_type") == "remove"), "warning").otherwise(F.coalesce(severity[F.col("change_type")], F.lit("warning")))
    items = rows.select(
        "change_id", F.when(direct, "direct").otherwise("indirect").alias("scope"), "path", F.col("node").alias("symbol_id"), grave.alias("severity"),
        (direct & F.col("change_type").isin(BREAKING)).alias("breaks"),
    )
    alone = targets.join(kinds.where("change_type <> 'add'"), "change_id").select("change_id", "path").join(of_set, "change_id", "left")
    alone = alone.join(reached.where("depth = 1").select("set_id", "path").distinct(), ["set_id", "path"], "left_anti")
    return items.unionByName(
        alone.select("change_id", F.lit("direct").alias("scope"), "path", F.lit(None).cast("string").alias("symbol_id"), F.lit("info").alias("severity"), F.lit(False).alias("breaks"))
    )


def potential_breaks(items: DataFrame) -> DataFrame:
    return items.where("breaks").select("change_id", "path", "symbol_id")


def change_risk(changes: DataFrame, items: DataFrame) -> DataFrame:
    """(change_id, n_direct, n_breaks, risk, effort): by the numbers of direct items and of breaks."""
    counts = items.groupBy("change_id").agg(F.count_if(F.col("scope") == "direct").alias("a"), F.count_if("breaks").alias("b"))
    rows = changes.select("change_id").join(counts, "change_id", "left").select("change_id", F.coalesce("a", F.lit(0)).alias("n_direct"), F.coalesce("b", F.lit(0)).alias("n_breaks"))
    a, b = F.col("n_direct"), F.col("n_breaks")
    risk = F.when((b > 10) | (a > 30), "critical").when((b > 4) | (a > 10), "high").when((b > 0) | (a > 2), "medium").otherwise("low")
    effort = F.when(a > 30, "epic").when(a > 15, "large").when(a > 5, "medium").when(a > 0, "small").otherwise("trivial")
    return rows.withColumns({"risk": risk, "effort": effort})
