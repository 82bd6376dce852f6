"""Breadth-first traversal of relations, for all sources at once, level by level."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import is_api_path
from .settled import settled


def reach(starts: DataFrame, relations: DataFrame, *, max_depth: int, direction: str = "in", with_starts: bool = False) -> DataFrame:
    """(repo_id, source, node, depth, relation_type, relation_path) of what sources reach, each node at its smallest depth.

    starts (repo_id, source), each source being its own node, or (repo_id, source, node) for sources of several nodes. direction: `in` follows
    relations backwards (dependents), `out` forwards, `both` either way. Of several relations of the smallest depth the first
    type by name is given, and with it the types passed on the way. The starts themselves are left out unless `with_starts`. Each level
    is one join of the frontier with the steps and an anti join with what was reached, both settled, so
    a level costs its own work only; a reached pair is never expanded again, so cycles end.
    """
    forward = relations.select("repo_id", F.col("src").alias("at"), F.col("dst").alias("to"), "relation_type")
    backward = relations.select("repo_id", F.col("dst").alias("at"), F.col("src").alias("to"), "relation_type")
    steps = {"in": backward, "out": forward, "both": forward.unionByName(backward)}[direction]
    steps = settled(steps.distinct())
    node = F.col("node") if "node" in starts.columns else F.col("source")
    none = F.array().cast("array<string>")
    first = starts.select("repo_id", "source", node.alias("node")).distinct()
    levels = [settled(first.select("*", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("relation_type"), none.alias("relation_path")))]
    for depth in range(1, max_depth + 1):
        found = reduce(DataFrame.unionByName, levels).select("repo_id", "source", "node")
        nearer = (
            levels[-1].select("repo_id", "source", F.col("node").alias("at"), "relation_path")
            .join(steps, ["repo_id", "at"])
            .groupBy("repo_id", "source", F.col("to").alias("node"))
            .agg(F.min(F.struct("relation_type", "relation_path")).alias("x"))
            .join(found, ["repo_id", "source", "node"], "left_anti")
            .select(
                "repo_id", "source", "node", F.lit(depth).alias("depth"), F.col("x.relation_type").alias("relation_type"),
                F.concat("x.relation_path", F.array("x.relation_type")).alias("relation_path"),
            )
        )
        frontier = settled(nearer)
        if frontier.isEmpty():
            break
        levels.append(frontier)
    return reduce(DataFrame.unionByName, levels if with_starts else levels[1:] or [levels[0].where("false")])


def nearest(starts: DataFrame, relations: DataFrame, *, most: int, max_depth: int, direction: str = "in") -> DataFrame:
    """(repo_id, source, node, depth): the starts (repo_id, source, node) and what they reach in up to max_depth steps, of each source the `most` first by depth and node.

    As reach, without the relations passed. A source that has its `most` nodes goes no further, as later levels can't be among them, so a
    level has up to `most` nodes for each source.
    """
    forward = relations.select("repo_id", F.col("src").alias("at"), F.col("dst").alias("to"))
    backward = relations.select("repo_id", F.col("dst").alias("at"), F.col("src").alias("to"))
    steps = settled({"in": backward, "out": forward, "both": forward.unionByName(backward)}[direction].distinct())
    by_node = Window.partitionBy("source").orderBy("node", "repo_id")

    def level(rows: DataFrame, depth: int) -> DataFrame:
        """Nodes of one depth after the n_ that their source has, as far as there is room; full says that there is no more."""
        rows = rows.withColumn("place", F.row_number().over(by_node) + F.col("n_")).where(F.col("place") <= most)
        of_source = F.max("place").over(Window.partitionBy("source"))
        return settled(rows.select("repo_id", "source", "node", F.lit(depth).alias("depth"), of_source.cast("int").alias("n_")))

    levels = [level(starts.select("repo_id", "source", "node").distinct().withColumn("n_", F.lit(0)), 0)]
    for depth in range(1, max_depth + 1):
        front = levels[-1].where(F.col("n_") < most).select("repo_id", "source", F.col("node").alias("at"), "n_")
        found = reduce(DataFrame.unionByName, levels).select("repo_id", "source", "node")
        met = front.join(steps, ["repo_id", "at"]).select("repo_id", "source", F.col("to").alias("node"), "n_").distinct()
        levels.append(level(met.join(found, ["repo_id", "source", "node"], "left_anti"), depth))
    return reduce(DataFrame.unionByName, levels).select("repo_id", "source", "node", "depth")


def reach_all(relations: DataFrame, *, max_depth: int = 2, direction: str = "in") -> DataFrame:
    """(repo_id, source, node, depth): what every node of the relations reaches in up to max_depth steps, each node at its smallest depth, itself left out.

    As reach with all nodes as sources and without the relations passed, for graphs with hubs: a step carries the sets of sources that have come to a node
    as bitmaps of 32,768 sources each, so its rows are relations by blocks of sources, not by sources, and they are united before and after the
    shuffle. Pairs are made at the end only.
    """
    at, to = ("dst", "src") if direction == "in" else ("src", "dst")
    steps = settled(relations.select("repo_id", F.col(at).alias("at"), F.col(to).alias("to")).distinct())
    nodes = steps.select("repo_id", F.col("at").alias("node")).union(steps.select("repo_id", "to")).distinct()
    nodes = settled(nodes.repartition("repo_id", "node").sortWithinPartitions("repo_id").withColumn("number", F.monotonically_increasing_id() + 1))
    block, place = F.bitmap_bucket_number("number"), F.bitmap_bit_position("number")
    levels = [settled(nodes.groupBy("repo_id", "node", block.alias("block")).agg(F.bitmap_construct_agg(place).alias("bits")))]
    for _ in range(max_depth):
        met = levels[-1].withColumnRenamed("node", "at").join(steps, ["repo_id", "at"]).select("repo_id", F.col("to").alias("node"), "block", "bits")
        levels.append(settled(met.groupBy("repo_id", "node", "block").agg(F.bitmap_or_agg("bits").alias("bits"))))
    tagged = [x.withColumn("depth", F.lit(d)) for d, x in enumerate(levels)]
    sets = reduce(DataFrame.unionByName, tagged).groupBy("repo_id", "node", "block").agg(F.array_sort(F.collect_list(F.struct("depth", "bits"))).alias("levels"))
    kinds = {f.name: f.dataType for f in nodes.schema.fields}
    schema = T.StructType([T.StructField("repo_id", kinds["repo_id"]), T.StructField("node", kinds["node"]), T.StructField("number", T.LongType()), T.StructField("depth", T.IntegerType())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                before = np.zeros(4096, np.uint8)
                for level in batch.column(3)[i].as_py():
                    bits = np.frombuffer(level["bits"], np.uint8)
                    fresh = np.flatnonzero(np.unpackbits(bits & ~before, bitorder="little"))
                    before = before | bits
                    if level["depth"] and len(fresh):
                        # numbers and blocks begin at 1, places at 0
                        numbers = fresh + 32768 * (batch.column(2)[i].as_py() - 1) + 1
                        own = pa.array(np.full(len(fresh), i))
                        columns = [batch.column(0).take(own), batch.column(1).take(own), pa.array(numbers), pa.array(np.full(len(fresh), level["depth"], np.int32))]
                        yield pa.RecordBatch.from_arrays(columns, schema.names)

    pairs = sets.select("repo_id", "node", "block", "levels").mapInArrow(unpack, schema)
    sources = nodes.select(F.col("node").alias("source"), "number")
    return pairs.join(sources, "number").where("source <> node").select("repo_id", "source", "node", "depth")


def call_chains(starts: DataFrame, relations: DataFrame, *, max_depth: int = 3, types: tuple[str, ...] = ("calls", "imports", "extends", "implements")) -> DataFrame:
    """(repo_id, source, src, dst, relation_type, depth): the forward relations of four types on the way from sources, up to max_depth steps."""
    some = relations.where(F.col("relation_type").isin(*types))
    nodes = reach(starts, some, max_depth=max_depth - 1, direction="out", with_starts=True).select("repo_id", "source", F.col("node").alias("src"), "depth")
    return nodes.join(some, ["repo_id", "src"]).select("repo_id", "source", "src", "dst", "relation_type", (F.col("depth") + 1).alias("depth"))


def impact(sources: DataFrame, symbols: DataFrame, relations: DataFrame, *, max_depth: int = 4) -> DataFrame:
    """Dependents of sources with level and risk: by depth 80, 50 or 30, more for inheritance, API files and much used files."""
    reached = reach(sources, relations, max_depth=max_depth)
    of = symbols.select("repo_id", F.col("symbol_id").alias("node"), "file_id", "path")
    uses = relations.join(of.select("repo_id", F.col("node").alias("dst"), "file_id"), ["repo_id", "dst"])
    many = uses.groupBy("repo_id", "file_id").agg(F.countDistinct("src").alias("afferent"))
    rows = reached.join(of, ["repo_id", "node"]).join(many, ["repo_id", "file_id"], "left")
    bonus = (
        F.when(F.col("relation_type").isin("extends", "implements"), 10).otherwise(0)
        + F.when(is_api_path(F.col("path")), 10).otherwise(0)
        + F.when(F.col("afferent") > 5, 5).otherwise(0)
    )
    base = F.when(F.col("depth") == 1, 80).when(F.col("depth") == 2, 50).otherwise(30)
    level = F.when(F.col("depth") == 1, "direct").when(F.col("depth") == 2, "indirect").otherwise("transitive")
    return rows.select(
        "repo_id", "source", "node", "depth", "relation_type", "file_id", "path", F.least(F.lit(100), base + bonus).alias("risk"), level.alias("level")
    )


def impacted_files(rows: DataFrame) -> DataFrame:
    return rows.groupBy("repo_id", "source", "path").agg(F.count("*").alias("n_nodes"), F.max("risk").alias("max_risk"))


def impact_summary(rows: DataFrame) -> DataFrame:
    level = lambda k: F.count_if(F.col("level") == k).alias(f"n_{k}")
    return rows.groupBy("repo_id", "source").agg(
        level("direct"), level("indirect"), level("transitive"), F.countDistinct("path").alias("n_files"), F.count_if(F.col("risk") >= 70).alias("n_high_risk")
    )


def impact_of_files(files: DataFrame, symbols: DataFrame, relations: DataFrame, *, max_depth: int = 4) -> DataFrame:
    """As impact, with all symbols of files (repo_id, path) as the nodes of the source `path`, and each node at its smallest depth from any."""
    starts = symbols.join(files.select("repo_id", "path").distinct(), ["repo_id", "path"]).select(
        "repo_id", F.col("path").alias("source"), F.col("symbol_id").alias("node")
    )
    return impact(starts, symbols, relations, max_depth=max_depth)


def sort_impact(rows: DataFrame, *, by: str = "risk", descending: bool = True, level: str | None = None) -> DataFrame:
    """Impact rows of a level (or all) with their place for each source; level orders direct, indirect, transitive; ties by node."""
    key = F.array_position(F.array(*map(F.lit, ("direct", "indirect", "transitive"))), F.col("level")) if by == "level" else F.col(by)
    some = rows if level is None else rows.where(F.col("level") == level)
    order = Window.partitionBy("repo_id", "source").orderBy(key.desc() if descending else key.asc(), "node")
    return some.withColumn("place", F.row_number().over(order))


def trace_flow(
    entries: DataFrame, symbols: DataFrame, relations: DataFrame, chunks: DataFrame, *, max_depth: int = 5, fan_out: int = 10, max_steps: int = 15
) -> DataFrame:
    """(repo_id, source, step, node, depth, name, path, code): what entries (repo_id, source) call, breadth first, `max_steps` rows with the entry.

    A node offers its first `fan_out` relations by type and target; nodes are in the order of the level, of the node that offers them first,
    and of its relations. code is the chunk of the symbol, else the first chunk that overlaps its lines.
    """
    ranked = Window.partitionBy("repo_id", "src").orderBy("relation_type", "dst")
    steps = settled(relations.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= fan_out).select("repo_id", F.col("src").alias("at"), "dst", "n"))
    levels = [settled(entries.select("repo_id", "source", F.col("source").alias("node"), F.lit(0).alias("depth"), F.lit(1).alias("at_place")).distinct())]
    for depth in range(1, max_depth + 1):
        found = reduce(DataFrame.unionByName, levels).select("repo_id", "source", "node")
        met = levels[-1].select("repo_id", "source", F.col("node").alias("at"), "at_place").join(steps, ["repo_id", "at"])
        offered = met.groupBy("repo_id", "source", F.col("dst").alias("node")).agg(F.min(F.struct("at_place", "n")).alias("o"))
        fresh = offered.join(found, ["repo_id", "source", "node"], "left_anti")
        order = Window.partitionBy("repo_id", "source").orderBy("o", "node")
        # nodes beyond max_steps can't be in the result, nor what only they lead to
        level = fresh.withColumn("at_place", F.row_number().over(order)).where(F.col("at_place") <= max_steps)
        level = settled(level.select("repo_id", "source", "node", F.lit(depth).alias("depth"), "at_place"))
        if level.isEmpty():
            break
        levels.append(level)
    order = Window.partitionBy("repo_id", "source").orderBy("depth", "at_place")
    rows = reduce(DataFrame.unionByName, levels).withColumn("step", F.row_number().over(order) - 1).where(F.col("step") < max_steps)
    of = symbols.select("repo_id", F.col("symbol_id").alias("node"), "name", "file_id", "path", "start_line", "end_line")
    rows = rows.join(of, ["repo_id", "node"])
    own = chunks.where("symbol_id IS NOT NULL").groupBy("repo_id", F.col("symbol_id").alias("node")).agg(F.min_by("content", "chunk_id").alias("own"))
    lines = chunks.select("repo_id", "file_id", F.col("start_line").alias("c_start"), F.col("end_line").alias("c_end"), "content", "chunk_id")
    nodes = rows.select("repo_id", "node", "file_id", "start_line", "end_line").distinct()
    over = nodes.join(lines, ["repo_id", "file_id"]).where("c_start <= end_line AND c_end >= start_line")
    first = over.groupBy("repo_id", "node").agg(F.min_by("content", F.struct("c_start", "chunk_id")).alias("near"))
    both = rows.join(own, ["repo_id", "node"], "left").join(first, ["repo_id", "node"], "left")
    code = F.coalesce("own", "near", F.lit("// Source code not available"))
    return both.select("repo_id", "source", "step", "node", "depth", "name", "path", code.alias("code"))


def find_cycles(relations: DataFrame, *, max_len: int = 5, relation_type: str = "imports", trims: int = 2) -> DataFrame:
    """(repo_id, length, nodes) of cycles of up to max_len relations of a type, each once, from its smallest node on.

    Relations that begin where none ends, or end where none begins, are on no cycle; `trims` rounds take them away. A cycle is a way out of its smallest
    node and a way back of half its length each, which meet in a node; so ways of more than half of max_len are never made.
    """
    steps = settled(relations.where(F.col("relation_type") == relation_type).select("repo_id", F.col("src").alias("at"), F.col("dst").alias("to")).where("at <> to").distinct())
    n = steps.count()
    for _ in range(trims):
        ends, begins = steps.select("repo_id", F.col("to").alias("at")), steps.select("repo_id", F.col("at").alias("to"))
        steps = settled(steps.join(ends, ["repo_id", "at"], "left_semi").join(begins, ["repo_id", "to"], "left_semi"))
        if steps.count() == n:
            break
        n = steps.count()

    def ways(last: str, then: str, most: int) -> list[DataFrame]:
        """Ways of 1 to `most` steps from a smallest node `start`, along or against the relations, through `inner` nodes to `end`."""
        own = steps.select("repo_id", F.col(last).alias("end"), F.col(then).alias("next"))
        found = [settled(own.where("end < next").select("repo_id", F.col("end").alias("start"), F.array().cast("array<string>").alias("inner"), F.col("next").alias("end")))]
        for _ in range(1, most):
            longer = found[-1].join(own, ["repo_id", "end"]).where((F.col("next") > F.col("start")) & ~F.array_contains("inner", F.col("next")) & (F.col("next") != F.col("end")))
            found.append(settled(longer.select("repo_id", "start", F.concat("inner", F.array("end")).alias("inner"), F.col("next").alias("end"))))
        return found

    out, back = ways("at", "to", (max_len + 1) // 2), ways("to", "at", max(1, max_len // 2))
    closed = []
    for length in range(2, max_len + 1):
        there, home = out[(length + 1) // 2 - 1], back[length // 2 - 1].withColumnRenamed("inner", "inner_")
        met = there.join(home, ["repo_id", "start", "end"]).where(~F.arrays_overlap("inner", "inner_"))
        closed.append(met.select("repo_id", F.lit(length).alias("length"), F.concat(F.array("start"), "inner", F.array("end"), F.reverse("inner_")).alias("nodes")))
    return reduce(DataFrame.unionByName, closed)
