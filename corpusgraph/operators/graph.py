"""Dependency graphs over symbols (repo_id, symbol_id, file_id, path, name, kind, start_line, end_line) and relations (repo_id, src, dst, relation_type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import group_of, is_api_path, module_of
from ..functions.text import normalize_relation, scale_weight
from .settled import settled

KINDS = ("function", "class", "method", "interface", "type")
HIERARCHY = ("class", "interface", "type")


def _ends(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """relations with the columns of both ends, as from_ and to_ columns; both ends lie in the relation's repository."""
    cols = [c for c in symbols.columns if c not in ("repo_id", "symbol_id")]
    side = lambda key, p: symbols.select("repo_id", F.col("symbol_id").alias(key), *(F.col(c).alias(p + c) for c in cols))
    return relations.join(side("src", "from_"), ["repo_id", "src"]).join(side("dst", "to_"), ["repo_id", "dst"])


def module_edges(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """Counts of relations between different first path parts, by type."""
    ends = _ends(symbols.select("repo_id", "symbol_id", "path"), relations)
    part = lambda c: F.split_part(F.col(c), F.lit("/"), F.lit(1))
    ends = ends.withColumns({"from_module": part("from_path"), "to_module": part("to_path")}).where("from_module <> to_module")
    return ends.groupBy("repo_id", "from_module", "to_module", "relation_type").agg(F.count("*").alias("edge_count"))


def file_edges(symbols: DataFrame, relations: DataFrame, *, focus: str | None = None, most: int | None = 2000) -> DataFrame:
    """Counts of relations between different files, by type; the `most` largest of each repository, or all."""
    ends = _ends(symbols.select("repo_id", "symbol_id", "path"), relations).where("from_path <> to_path")
    if focus:
        ends = ends.where(F.col("from_path").startswith(focus + "/") | F.col("to_path").startswith(focus + "/"))
    counts = ends.groupBy("repo_id", "from_path", "to_path", "relation_type").agg(F.count("*").alias("edge_count"))
    if most is None:
        return counts
    order = Window.partitionBy("repo_id").orderBy(F.desc("edge_count"), "from_path", "to_path", "relation_type")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def symbol_edges(symbols: DataFrame, relations: DataFrame, *, path: str | None = None, most: int | None = 1000) -> DataFrame:
    """Relations between symbols of five kinds, the `most` first of each repository by type and ids, or all."""
    some = symbols.where(F.col("kind").isin(*KINDS)).select("repo_id", "symbol_id", "name", "kind", "path")
    ends = _ends(some, relations)
    if path:
        ends = ends.where((F.col("from_path") == path) | (F.col("to_path") == path))
    if most is None:
        return ends
    order = Window.partitionBy("repo_id").orderBy("relation_type", "src", "dst")
    return ends.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def node_metadata(files: DataFrame, symbols: DataFrame) -> DataFrame:
    counts = symbols.groupBy("repo_id", "file_id").agg(F.count("*").alias("symbol_count"))
    return files.join(counts, ["repo_id", "file_id"], "left").select(
        "repo_id", "file_id", "path", "language", "line_count", F.coalesce("symbol_count", F.lit(0)).alias("symbol_count"),
        F.element_at(F.split("path", "/"), -1).alias("label"),
    )


def degrees(edges: DataFrame, source: str, target: str, weight: str | None = None) -> DataFrame:
    """(repo_id, node, in_degree, out_degree): edge counts, or sums of weight."""
    total = F.sum(weight) if weight else F.count("*")
    out = edges.groupBy("repo_id", F.col(source).alias("node")).agg(total.alias("out_degree"))
    into = edges.groupBy("repo_id", F.col(target).alias("node")).agg(total.alias("in_degree"))
    return out.join(into, ["repo_id", "node"], "full_outer").select(
        "repo_id", "node", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("in_degree", "out_degree"))
    )


def top_nodes(nodes: DataFrame, most: int) -> DataFrame:
    """The nodes of highest total degree of each repository; ties by name."""
    order = Window.partitionBy("repo_id").orderBy(F.desc(F.col("in_degree") + F.col("out_degree")), "node")
    return nodes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def module_graph(symbols: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with degrees and a size from 1 to 10, and edges with a weight from 1 to 5, of the module level."""
    edges = module_edges(symbols, relations)
    nodes = degrees(edges, "from_module", "to_module", "edge_count")
    total, repo = F.col("in_degree") + F.col("out_degree"), Window.partitionBy("repo_id")
    low, high = F.least(F.min(total).over(repo), F.lit(0)), F.greatest(F.max(total).over(repo), F.lit(1))
    size = F.floor(F.lit(1) + (total - low) / (high - low) * 9 + 0.5)
    return nodes.withColumn("size", F.when(high == low, 5).otherwise(size).cast("int")), edges.withColumn("weight", scale_weight(F.col("edge_count")))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of each repository: nodes, edges, average degree and groups."""
    n = nodes.groupBy("repo_id").agg(
        F.count("*").alias("n_nodes"), F.avg(F.col("in_degree") + F.col("out_degree")).alias("avg_degree"), F.countDistinct(group_of(F.col("node"))).alias("n_groups")
    )
    e = edges.groupBy("repo_id").agg(F.count("*").alias("n_edges"))
    return n.join(e, "repo_id", "left").select("repo_id", "n_nodes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "avg_degree", "n_groups")


def module_dependencies(symbols: DataFrame, relations: DataFrame, *, depth: int = 3) -> DataFrame:
    """Dependencies between modules of up to `depth` directories, with the numbers of files of both sides."""
    placed = symbols.select("repo_id", "symbol_id", "path").withColumn("module", module_of(F.col("path"), depth))
    files = placed.groupBy("repo_id", "module").agg(F.countDistinct("path").alias("files"))
    ends = _ends(placed.select("repo_id", "symbol_id", "module"), relations).where("from_module <> to_module")
    counts = ends.groupBy("repo_id", "from_module", "to_module").agg(F.count("*").alias("dependency_count"))
    side = lambda p: files.select("repo_id", F.col("module").alias(f"{p}_module"), F.col("files").alias(f"{p}_files"))
    return counts.join(side("from"), ["repo_id", "from_module"]).join(side("to"), ["repo_id", "to_module"])


def class_hierarchy(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """Classes, interfaces and types with what they extend or implement; those without stay, with null."""
    kinds = symbols.where(F.col("kind").isin(*HIERARCHY)).select("repo_id", F.col("symbol_id").alias("src"), "name", "kind")
    links = relations.where(F.col("relation_type").isin("extends", "implements"))
    names = symbols.select("repo_id", F.col("symbol_id").alias("dst"), F.col("name").alias("parent_name"))
    found = links.join(names, ["repo_id", "dst"])
    return kinds.join(found, ["repo_id", "src"], "left").select("repo_id", F.col("src").alias("symbol_id"), "name", "kind", "relation_type", "dst", "parent_name")


def unreferenced_symbols(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """Functions, classes and methods outside of entry points that nothing refers to."""
    entry = "/index\\.|/main\\.|route\\.|page\\.|layout\\.|\\.test\\.|\\.spec\\."
    some = symbols.where(F.col("kind").isin("function", "class", "method") & ~F.col("path").rlike(entry))
    used = relations.select("repo_id", F.col("dst").alias("symbol_id")).distinct()
    return some.join(used, ["repo_id", "symbol_id"], "left_anti")


def neighbors(nodes: DataFrame, relations: DataFrame, *, types: list[str] | None = None) -> DataFrame:
    """(repo_id, node, direction, relation_type, neighbor): what nodes (repo_id, node) refer to (out) and are referred to by (in), of some types or all."""
    some = relations if types is None else relations.where(F.col("relation_type").isin(types))
    out = some.select("repo_id", F.col("src").alias("node"), F.lit("out").alias("direction"), "relation_type", F.col("dst").alias("neighbor"))
    into = some.select("repo_id", F.col("dst").alias("node"), F.lit("in").alias("direction"), "relation_type", F.col("src").alias("neighbor"))
    return out.unionByName(into).join(nodes, ["repo_id", "node"], "left_semi").distinct()


def neighbor_counts(found: DataFrame) -> DataFrame:
    """(repo_id, node, direction, relation_type, n) of neighbors."""
    return found.groupBy("repo_id", "node", "direction", "relation_type").agg(F.count("*").alias("n"))


def api_flow_edges(symbols: DataFrame, relations: DataFrame) -> DataFrame:
    """File pairs that calls and imports lead to from API files, with the kind of the target."""
    some = relations.where(F.col("relation_type").isin("calls", "imports"))
    ends = _ends(symbols.select("repo_id", "symbol_id", "path"), some).where(is_api_path(F.col("from_path")) & (F.col("from_path") != F.col("to_path")))
    kind = F.when(is_api_path(F.col("to_path")), "api").when(F.lower("to_path").rlike("db|schema|queries"), "database").otherwise("file")
    return ends.select("repo_id", "from_path", "to_path", kind.alias("target_kind")).distinct()


def nesting_depth(symbols: DataFrame, *, most: int = 10) -> DataFrame:
    """(repo_id, symbol_id, depth): 1 for symbols without parent_symbol_id, one more for each parent; those of more than `most` levels, or whose
    parents form a ring or are unknown, are left out.

    Each round doubles how far a symbol looks up, so a depth of 10 takes four joins.
    """
    ups = symbols.select("repo_id", "symbol_id", F.col("parent_symbol_id").alias("up"), F.lit(1).alias("depth"))
    reach = 1
    while reach < most:
        ups = settled(ups)
        above = ups.select("repo_id", F.col("symbol_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        farther = ups.where("up IS NOT NULL").join(above, ["repo_id", "up"]).select("repo_id", "symbol_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        ups = ups.where("up IS NULL").unionByName(farther)
        reach *= 2
    return ups.where((F.col("depth") <= most) & F.col("up").isNull()).select("repo_id", "symbol_id", "depth")


def _sized(nodes: DataFrame, value: str) -> DataFrame:
    """nodes with size: value scaled to 1..10 over the repository, 5 where all are equal."""
    repo = Window.partitionBy("repo_id")
    low, high = F.least(F.min(value).over(repo), F.lit(0)), F.greatest(F.max(value).over(repo), F.lit(1))
    size = F.floor(F.lit(1) + (F.col(value) - low) / (high - low) * 9 + 0.5)
    return nodes.withColumn("size", F.when(high == low, 5).otherwise(size).cast("int"))


def build_graph(
    symbols: DataFrame, relations: DataFrame, files: DataFrame, *, level: str = "module", most: int = 150, most_edges: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Nodes (repo_id, node, label, group, in_degree, out_degree, size) and edges (repo_id, source, target, kind, weight) of a level.

    level: module, file or symbol. The `most` nodes of the highest degree of each repository stay, and the edges between them. Degrees count all edges, or
    of files and symbols the `most_edges` first of each repository. Size follows the degree of a module, the lines of a file, and the span of a symbol.
    """
    if level == "module":
        nodes, found = module_graph(symbols, relations)
        nodes = nodes.drop("size").withColumns({"label": F.col("node"), "path": F.concat("node", F.lit("/")), "value": F.col("in_degree") + F.col("out_degree")})
        edges = found.select("repo_id", F.col("from_module").alias("source"), F.col("to_module").alias("target"), "relation_type", F.col("edge_count").alias("n"))
    elif level == "file":
        found = file_edges(symbols, relations, most=most_edges)
        meta = files.select("repo_id", F.col("path").alias("node"), F.col("path"), F.element_at(F.split("path", "/"), -1).alias("label"), F.col("line_count").alias("value"))
        nodes = degrees(found, "from_path", "to_path", "edge_count").join(meta, ["repo_id", "node"], "left")
        edges = found.select("repo_id", F.col("from_path").alias("source"), F.col("to_path").alias("target"), "relation_type", F.col("edge_count").alias("n"))
    else:
        found = symbol_edges(symbols, relations, most=most_edges)
        meta = symbols.select("repo_id", F.col("symbol_id").alias("node"), F.col("name").alias("label"), "path", (F.col("end_line") - F.col("start_line")).alias("value"))
        nodes = degrees(found, "src", "dst").join(meta, ["repo_id", "node"], "left")
        edges = found.select("repo_id", F.col("src").alias("source"), F.col("dst").alias("target"), "relation_type", F.lit(1).alias("n"))
    nodes = _sized(top_nodes(nodes, most).withColumn("value", F.coalesce("value", F.lit(0))), "value")
    nodes = nodes.select("repo_id", "node", "label", group_of(F.col("path")).alias("group"), "in_degree", "out_degree", "size")
    ends = nodes.select("repo_id", "node")
    kept = edges.join(ends.toDF("repo_id", "source"), ["repo_id", "source"], "left_semi").join(ends.toDF("repo_id", "target"), ["repo_id", "target"], "left_semi")
    kind = normalize_relation(F.col("relation_type"))
    return nodes, kept.select("repo_id", "source", "target", kind.alias("kind"), scale_weight(F.col("n")).alias("weight"))


def diagram_tables(kind: str, symbols: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (repo_id, node, label, node_type) and edges (repo_id, source, target, label, style) of a diagram.

    kind: module-dependency, component or data-flow. Edges of more than five relations are thick, of more than one labelled.
    """
    if kind == "module-dependency":
        found = module_dependencies(symbols, relations)
        ends = found.select("repo_id", F.col("from_module").alias("node")).union(found.select("repo_id", "to_module")).distinct()
        last = F.element_at(F.split("node", "/"), -1)
        nodes = ends.select("repo_id", "node", last.alias("label"), F.when(last.isin("db", "database", "storage"), "database").otherwise("module").alias("node_type"))
        edges = found.select("repo_id", F.col("from_module").alias("source"), F.col("to_module").alias("target"), F.col("dependency_count").alias("n"))
    elif kind == "component":
        found = class_hierarchy(symbols, relations)
        nodes = found.select("repo_id", F.col("symbol_id").alias("node"), F.col("name").alias("label"), F.col("kind").alias("node_type")).distinct()
        edges = found.where("dst IS NOT NULL").groupBy("repo_id", F.col("symbol_id").alias("source"), F.col("dst").alias("target")).agg(F.count("*").alias("n"))
    else:
        found = api_flow_edges(symbols, relations)
        ends = found.select("repo_id", F.col("from_path").alias("node"), F.lit("api").alias("node_type")).union(found.select("repo_id", "to_path", "target_kind"))
        nodes = ends.groupBy("repo_id", "node").agg(F.min("node_type").alias("node_type"))
        nodes = nodes.select("repo_id", "node", F.element_at(F.split("node", "/"), -1).alias("label"), "node_type")
        edges = found.select("repo_id", F.col("from_path").alias("source"), F.col("to_path").alias("target"), F.lit(1).alias("n"))
    label = F.when(F.col("n") > 1, F.col("n").cast("string"))
    style = F.when(F.col("n") > 5, "thick").when(F.col("n") > 1, "labelled").otherwise("plain")
    return nodes, edges.select("repo_id", "source", "target", label.alias("label"), style.alias("style"))
