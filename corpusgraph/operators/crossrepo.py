"""Relations between repositories of a workspace: HTTP calls of routes, shared names and files, package dependencies and imports."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .reports import manifest_dependencies
from .settled import settled
from .workspace import shared_modules, shared_types

# What a call of an HTTP client and the path of a route file hold, case aside.
HTTP_CALLS = ["fetch(", "axios.", "http.get(", '.get("/', '.post("/', '.put("/', '.delete("/']
ROUTE_FILES = r"(?i)/api/|/routes/|route\.ts$|route\.js$|\.controller\.ts$|\.controller\.js$"
#: The most relations of a type that are kept for two repositories; the others have no limit.
MOST = {"api-consumer": 20, "shared-type": 30, "shared-module": 20}
_COLUMNS = ["from_repo", "to_repo", "relation_type", "from_path", "to_path", "name", "confidence"]


def route_segment(path: Column) -> Column:
    """The URL part that a route file stands for, null for other files."""
    api, routes = r"/(api/[^/]+(?:/[^/]+)*?)/route\.[jt]sx?$", r"/routes/([^/]+)\.[jt]sx?$"
    a, b = F.regexp_extract(path, api, 1), F.regexp_extract(path, routes, 1)
    return F.when(a != "", F.concat(F.lit("/"), a)).when(b != "", F.concat(F.lit("/"), b))


class _Finder:
    """An automaton that finds all of some texts in another text in one pass (Aho and Corasick)."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for n, word in enumerate(words):
            state = 0
            for c in word:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                state = self.next[state][c]
            self.ends[state].append(n)
        self.back = [0] * len(self.next)
        queue = list(self.next[0].values())
        for state in queue:  # grows while it is read: shorter beginnings first
            for c, to in self.next[state].items():
                back = self.back[state]
                while back and c not in self.next[back]:
                    back = self.back[back]
                self.back[to] = self.next[back].get(c, 0)
                self.ends[to] = self.ends[to] + self.ends[self.back[to]]
                queue.append(to)

    def find(self, text: str) -> set[int]:
        state, found = 0, set()
        for c in text:
            while state and c not in self.next[state]:
                state = self.back[state]
            state = self.next[state].get(c, 0)
            if self.ends[state]:
                found.update(self.ends[state])
        return found


def texts_holding(texts: DataFrame, words: DataFrame, *, block: int = 20_000) -> DataFrame:
    """(id, word): which of the distinct words (word) each of texts (id, text) holds, anywhere in it.

    Words are broadcast as one automaton for each about `block` of them, every one of which reads the texts once; empty words are in no text.
    """
    distinct = settled(words.select("word").where("word <> ''").distinct())
    blocks = max(1, -(-distinct.count() // block))
    schema = T.StructType([T.StructField("id", texts.schema["id"].dataType), T.StructField("word", T.StringType())])
    found = []
    for i in range(blocks):
        some = [r.word for r in distinct.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == i).collect()]  # about `block` words
        shared = texts.sparkSession.sparkContext.broadcast((some, _Finder(some)))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, finder = shared.value
            for batch in batches:
                hits = [sorted(finder.find(t)) if t else [] for t in batch.column(1).to_pylist()]
                at = [n for n, own in enumerate(hits) for _ in own]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([names[w] for own in hits for w in own], pa.string())], schema.names)

        found.append(texts.select("id", "text").mapInArrow(work, schema))
    return reduce(DataFrame.unionByName, found)


def api_consumers(files: DataFrame) -> DataFrame:
    """HTTP calls of one repository whose text holds a route of another one, case aside; files (repo_id, path, content)."""
    low = F.lower("content")
    called = files.where(reduce(lambda a, b: a | b, (low.contains(c) for c in HTTP_CALLS)))
    segment = F.lower(route_segment(F.col("path")))
    routes = files.where(F.col("path").rlike(ROUTE_FILES)).select(F.col("repo_id").alias("to_repo"), F.col("path").alias("to_path"), segment.alias("word")).where("word IS NOT NULL")
    held = texts_holding(called.select(F.struct("repo_id", "path").alias("id"), low.alias("text")), routes)
    found = held.select(F.col("id.repo_id").alias("from_repo"), F.col("id.path").alias("from_path"), "word").distinct().join(routes, "word").where("from_repo <> to_repo")
    return found.select("from_repo", "to_repo", F.lit("api-consumer").alias("relation_type"), "from_path", "to_path", F.col("word").alias("name"), F.lit("high").alias("confidence")).distinct()


def package_names(manifests: DataFrame) -> DataFrame:
    """(repo_id, name) of manifests (repo_id, content): the package that a repository is."""
    return manifests.select("repo_id", F.from_json("content", "struct<name:string>")["name"].alias("name")).where("name IS NOT NULL")


def read_manifests(files: DataFrame) -> DataFrame:
    """(repo_id, name, dependencies): the root package.json of each repository of files (repo_id, path, content), with dependencies and
    devDependencies in one map, the latter first where both name a package; files that are no JSON are left out."""
    kind = "struct<name:string,dependencies:map<string,string>,devDependencies:map<string,string>>"
    read = files.where("path = 'package.json'").select("repo_id", F.from_json("content", kind).alias("m")).where("m IS NOT NULL")
    none = F.create_map().cast("map<string,string>")
    plain, dev = F.coalesce("m.dependencies", none), F.coalesce("m.devDependencies", none)
    only = F.map_filter(plain, lambda k, v: ~F.map_contains_key(dev, k))
    return read.select("repo_id", F.col("m.name").alias("name"), F.map_concat(only, dev).alias("dependencies"))


def import_patterns(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Files that import another repository's package, by `from "name` or `require("name` in their text.

    A quoted source is cut to all its beginnings, which are joined with the package names.
    """
    quoted = F.regexp_extract_all("content", F.lit(r"(?:from |require\()[\"']([^\"'\n]+)"), F.lit(1))
    sources = files.select(F.col("repo_id").alias("from_repo"), F.col("path").alias("from_path"), F.explode(F.array_distinct(quoted)).alias("source"))
    starts = F.transform(F.sequence(F.lit(1), F.least(F.length("source"), F.lit(214))), lambda i: F.left(F.col("source"), i))  # a package name has 214 characters at most
    keys = sources.select("from_repo", "from_path", F.explode(starts).alias("name")).distinct()
    names = package_names(manifests).select(F.col("repo_id").alias("to_repo"), "name")
    found = keys.join(names, "name").where("from_repo <> to_repo")
    return found.select("from_repo", "to_repo", F.lit("import-pattern").alias("relation_type"), "from_path", F.lit("package.json").alias("to_path"), "name", F.lit("high").alias("confidence")).distinct()


def cross_repo_relations(files: DataFrame, symbols: DataFrame, manifests: DataFrame) -> DataFrame:
    """All relations (from_repo, to_repo, relation_type, from_path, to_path, name, confidence), of some types the first MOST of two repositories."""
    names = shared_types(symbols).select("from_repo", "to_repo", F.lit("shared-type").alias("relation_type"), F.lit("").alias("from_path"), F.lit("").alias("to_path"), "name", F.lit("medium").alias("confidence"))
    modules = shared_modules(files.select("repo_id", "path", F.sha2("content", 256).alias("content_hash")))
    modules = modules.select("from_repo", "to_repo", F.lit("shared-module").alias("relation_type"), F.col("path").alias("from_path"), F.col("path").alias("to_path"), F.lit("").alias("name"), "confidence")
    packages = manifest_dependencies(manifests).select("from_repo", "to_repo", F.lit("npm-dependency").alias("relation_type"), F.lit("package.json").alias("from_path"), F.lit("package.json").alias("to_path"), "name", F.lit("high").alias("confidence"))
    every = [api_consumers(files), names.distinct(), packages, modules, import_patterns(files, manifests)]
    rows = reduce(DataFrame.unionByName, (x.select(*_COLUMNS) for x in every))
    order = Window.partitionBy("from_repo", "to_repo", "relation_type").orderBy("from_path", "to_path", "name", "confidence")
    most = F.create_map(*(x for k, v in MOST.items() for x in (F.lit(k), F.lit(v))))[F.col("relation_type")]
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.coalesce(most, F.col("place"))).drop("place")


def relation_summary(relations: DataFrame) -> DataFrame:
    """(from_repo, to_repo, n, and a count for each type)."""
    types = ["api-consumer", "shared-type", "npm-dependency", "shared-module", "import-pattern"]
    counts = [F.count_if(F.col("relation_type") == t).alias("n_" + t.replace("-", "_")) for t in types]
    return relations.groupBy("from_repo", "to_repo").agg(F.count("*").alias("n"), *counts)


def filter_relations(relations: DataFrame, relation_type: str | None = None) -> DataFrame:
    """relations of a type (or all), each with the number of its type in n_of_type."""
    counts = relations.groupBy("relation_type").agg(F.count("*").alias("n_of_type"))  # a row for each of five types
    rows = relations.join(F.broadcast(counts), "relation_type")
    return rows if relation_type is None else rows.where(F.col("relation_type") == relation_type)
