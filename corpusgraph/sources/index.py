"""An index of source files that is kept up with snapshots of repositories: symbols, imports, exports, chunks and relations follow each changed file.

Tables by file (repo_id, path, ...): files, symbols, imports, exports, links (of classes to their parents), keys (the names that a file can be imported
by) and chunks. relations (repo_id, path, src, dst, relation_type) belong to the file that imports or inherits, but depend on others as well.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, chunks, extract, relations
from ..operators.settled import settled
from .files import diff_snapshot, file_facts, language_of

_FILE = ["repo_id", "path"]
#: The tables and their columns; of all but relations each row depends on one file alone.
SCHEMAS = {
    "files": "repo_id string, path string, content string, language string, content_hash string",
    "symbols": "repo_id string, path string, symbol_id string, name string, kind string, start_line int, end_line int, signature string",
    "imports": "repo_id string, path string, source string, names array<string>",
    "exports": "repo_id string, path string, name string",
    "links": "repo_id string, path string, name string, relation_type string, parent string",
    "keys": "repo_id string, path string, key string",
    "chunks": "repo_id string, path string, chunk_id string, seq int, start_line int, end_line int, symbol_name string, symbol_id string, content string, token_count int",
    "relations": "repo_id string, path string, src string, dst string, relation_type string",
}


def derived(files: DataFrame) -> dict[str, DataFrame]:
    """The tables by file of files (repo_id, path, content). Each file's lines are matched once."""
    rows = files.select(*_FILE, F.coalesce("content", F.lit("")).alias("content")).withColumns({"file_id": F.col("path"), "language": language_of(F.col("path"))})
    found = settled(extract.declarations(rows))
    symbols = blocks.block_ends(extract.extract_symbols(found), rows)
    symbols = settled(symbols.withColumns({"path": F.col("file_id"), "symbol_id": F.concat_ws(":", "file_id", "start_line", "name")}))
    placed = lambda df: df.withColumnRenamed("file_id", "path")
    cut = chunks.link_chunks(chunks.chunk_by_symbols(rows, symbols), symbols)
    return {
        "files": file_facts(rows).select(*_FILE, "content", "language", "content_hash"),
        "symbols": symbols.select(*_FILE, "symbol_id", "name", "kind", "start_line", "end_line", "signature"),
        "imports": placed(extract.extract_imports(found)).select(*_FILE, "source", "names"),
        "exports": placed(extract.extract_exports(found)).select(*_FILE, "name"),
        "links": placed(extract.inheritance(symbols)).select(*_FILE, "name", "relation_type", "parent"),
        "keys": relations.path_index(rows).select("repo_id", F.col("target").alias("path"), "key"),
        "chunks": placed(cut).withColumn("chunk_id", F.concat_ws(":", "path", "seq")).select(
            *_FILE, "chunk_id", "seq", "start_line", "end_line", "symbol_name", "symbol_id", "content", "token_count"
        ),
    }


def related(tables: dict[str, DataFrame], owners: DataFrame | None = None) -> DataFrame:
    """The relations of the files owners (repo_id, path), or of all files."""
    own = lambda rows: rows if owners is None else rows.join(owners, _FILE, "left_semi")
    index = tables["keys"].select("repo_id", "key", F.col("path").alias("target"))
    edges = relations.import_edges(tables["symbols"], own(tables["imports"]), tables["exports"], index)
    return edges.unionByName(relations.inheritance_edges(own(tables["links"]), tables["symbols"])).distinct()


def advance(tables: dict[str, DataFrame], snapshot: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """What a snapshot (repo_id, path, content) of some whole repositories changes: new rows of each table, and the files (repo_id, path) whose rows
    go, of the tables by file under "files", of the relations under "relations".

    Relations are made again for the changed files; for the files with an import that a name of a changed, new or deleted file fits; and for those
    with a class whose parent has the name of a type that such a file has or had. All others stay as they are.
    """
    here = snapshot.select("repo_id").distinct()
    now = settled(file_facts(snapshot.select(*_FILE, F.coalesce("content", F.lit("")).alias("content")).dropDuplicates(_FILE)))
    diff = settled(diff_snapshot(tables["files"].join(here, "repo_id", "left_semi"), now).where("status <> 'unchanged'"))
    fresh = derived(now.join(diff.where("status <> 'deleted'"), _FILE, "left_semi"))
    gone = diff.where("status <> 'new'").select(*_FILE)
    after = applied(tables, fresh, {"files": gone})
    touched = diff.select(*_FILE)
    old_keys, old_symbols = (tables[name].join(touched, _FILE, "left_semi") for name in ("keys", "symbols"))
    keys = fresh["keys"].select("repo_id", "key").union(old_keys.select("repo_id", "key")).distinct()
    names = fresh["symbols"].select("repo_id", F.col("name").alias("parent")).union(old_symbols.select("repo_id", "name")).distinct()
    wanted = after["imports"].join(here, "repo_id", "left_semi").withColumn("key", relations.normalized_source(F.col("source"), F.col("path")))
    whole, last = wanted.select(*_FILE, "key"), wanted.select(*_FILE, F.element_at(F.split("key", "/"), -1).alias("key"))
    importers = whole.union(last).join(keys, ["repo_id", "key"], "left_semi").select(*_FILE)
    heirs = after["links"].join(here, "repo_id", "left_semi").join(names, ["repo_id", "parent"], "left_semi").select(*_FILE)
    owners = settled(touched.union(importers).union(heirs).distinct())
    fresh["relations"] = related(after, owners)
    return fresh, {"files": gone, "relations": owners}


def applied(tables: dict[str, DataFrame], fresh: dict[str, DataFrame], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after a change as `advance` gives it."""
    out = {}
    for name, rows in tables.items():
        stale = gone.get("relations" if name == "relations" else "files")
        left = rows if stale is None else rows.join(stale, _FILE, "left_anti")
        out[name] = left.unionByName(fresh[name].select(*rows.columns)) if name in fresh else left
    return out


class IndexStore:
    """An index in a folder that all machines share, as runs of batches: each adds rows and says which files' older rows go.

    A batch's rows become visible all at once with its manifest, which is written last, under another name, and renamed. A batch that failed on its
    way left no manifest: repeated, it writes the same folders again. A batch whose manifest is there is not applied again. A manifest lists the runs
    that make up the index, and so do the older ones that stay until `compact`; what a batch writes is as large as what it changes.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _manifests(self) -> dict[int, str]:
        system, path = self._path("manifests")
        names = [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []
        return {int(n.split(".")[0]): n for n in names if n.endswith(".json")}

    def runs(self) -> list[str]:
        """The runs of the newest manifest, oldest first."""
        found = self._manifests()
        if not found:
            return []
        text = self.spark.read.text(f"{self.folder}/manifests/{found[max(found)]}", wholetext=True).first()[0]
        return json.loads(text)["runs"]

    def _publish(self, number: int, runs: list[str]) -> None:
        system, hidden = self._path("manifests", f".{number:012d}")
        _, path = self._path("manifests", f"{number:012d}.json")
        out = system.create(hidden, True)
        out.write(bytearray(json.dumps({"runs": runs}).encode()))
        out.close()
        if not system.rename(hidden, path):
            raise OSError(f"manifest {number} could not be put in place")

    def tables(self) -> dict[str, DataFrame]:
        """The index as it stands."""
        runs = self.runs()
        numbered = lambda name, schema: reduce(DataFrame.unionByName, [
            self.spark.read.schema(schema).parquet(f"{self.folder}/{run}/{name}").withColumn("run_", F.lit(i)) for i, run in enumerate(runs)
        ])
        out = {}
        for name, schema in SCHEMAS.items():
            if not runs:
                out[name] = self.spark.createDataFrame([], schema)
                continue
            kind = "gone_relations" if name == "relations" else "gone_files"
            last = numbered(kind, "repo_id string, path string").groupBy(*_FILE).agg(F.max("run_").alias("gone_"))
            rows = numbered(name, schema).join(last, _FILE, "left").where("gone_ IS NULL OR run_ >= gone_")
            out[name] = rows.drop("run_", "gone_")
        return out

    def apply(self, snapshot: DataFrame, number: int) -> bool:
        """Apply a snapshot of some whole repositories as batch `number`; False if it was applied before."""
        if any(n >= number for n in self._manifests()):
            return False
        fresh, gone = advance(self.tables(), snapshot)
        self._write(f"run-{number:012d}", fresh, gone)
        self._publish(number, [*self.runs(), f"run-{number:012d}"])
        return True

    def _write(self, run: str, fresh: dict[str, DataFrame], gone: dict[str, DataFrame]) -> None:
        for name in SCHEMAS:
            fresh[name].write.mode("overwrite").parquet(f"{self.folder}/{run}/{name}")
        for kind in ("files", "relations"):
            gone[kind].select(*_FILE).write.mode("overwrite").parquet(f"{self.folder}/{run}/gone_{kind}")

    def compact(self) -> None:
        """Write the index as one run, in place of all runs of the newest manifest; readers of older manifests keep theirs."""
        found, runs = self._manifests(), self.runs()
        if len(runs) < 2:
            return
        number = max(found)
        none = self.spark.createDataFrame([], "repo_id string, path string")
        run = f"whole-{number:012d}"
        self._write(run, self.tables(), {"files": none, "relations": none})
        system, path = self._path("manifests", f"{number:012d}.json")
        _, hidden = self._path("manifests", f".whole-{number:012d}")
        out = system.create(hidden, True)
        out.write(bytearray(json.dumps({"runs": [run]}).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(hidden, path, options)
