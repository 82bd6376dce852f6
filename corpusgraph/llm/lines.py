"""Line dedup that can be undone: sharded cuckoo filters over exact reference-count tables.

A line's key is the line without `[\\x20\\x09-\\x0D]` at its ends, A-Z lower-cased, held as a 128-bit
digest. An exact table has each key's reference count and owner, the smallest doc_id that holds it; another one has the references, a row for
each key and document. Each shard of the key space has a cuckoo filter with the keys that it
holds: a batch is probed against the filters, and only keys that may be known are joined with the exact tables; the others enter
the counts as new. Filters give false positives, which the join settles, and no false negatives.

Insertion appends references, brings the counts of the batch's keys up to date and adds new keys to the filters; deletion of documents removes their
references, lowers counts, and takes keys whose count falls to 0 out of the filters. What `drops` then says, from the counts, is the same
as if the deleted documents had never come, so a line kept only in a deleted document returns in the next.

Defined results: a null text is one empty line; keys shorter than `least` code points are never
dropped; a key repeated inside one document only is no duplicate; rows with the same doc_id and
different texts count as one document for the counts and are each cleaned; rows with a null doc_id
give no references and lose no lines; an empty table gives an empty index.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import free_name, kept_table, map_rows, quoted, table, tidied

#: What is stripped, and so never part of a key's ends.
BLANK = " \t\n\x0b\f\r"
_LOWER = {i: i + 32 for i in range(65, 91)}


def key_of(line: str) -> str:
    return line.strip(BLANK).translate(_LOWER) if not line.isascii() else line.strip(BLANK).lower()


def digest(key: str) -> bytes:
    return hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16).digest()


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; a key has two buckets, each the other's xor.

    Keys are 128-bit digests as two uint64. Insertion works on whole arrays: keys that find a free place in
    either bucket take it at once; the rest evict in turn. A filter that can't place a key
    doubles, from the exact keys its shard's table holds, so no key is ever lost.
    """

    SLOTS = 4

    def __init__(self, buckets: int, cells: np.ndarray | None = None):
        self.buckets = buckets
        self.cells = np.zeros((buckets, self.SLOTS), np.uint16) if cells is None else cells

    @classmethod
    def sized_for(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(2, int(np.ceil(np.log2(max(keys, 1) / cls.SLOTS / 0.8)))))

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        cells = np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy()
        return cls(len(cells), cells)

    def to_bytes(self) -> bytes:
        return self.cells.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(self.buckets - 1)
        mark = (keys[:, 1] >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (keys[:, 0] & mask).astype(np.int64)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        spread = (mark.astype(np.uint64) * np.uint64(0x5BD1E9955BD1E995)) >> np.uint64(20)
        return bucket ^ (spread & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        return ((self.cells[one] == mark[:, None]) | (self.cells[two] == mark[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> bool:
        """Add distinct new keys; False if some found no place (the caller makes a larger filter of the exact keys)."""
        mark, one, two = self._places(keys)
        left = np.arange(len(keys))
        for bucket in (one, two):
            for slot in range(self.SLOTS):
                free = left[self.cells[bucket[left], slot] == 0]
                _, first = np.unique(bucket[free], return_index=True)  # one key for each free cell
                placed = free[first]
                self.cells[bucket[placed], slot] = mark[placed]
                left = np.setdiff1d(left, placed, assume_unique=True)
        for i in left:
            b, m = int(two[i]), mark[i]
            for kick in range(500):
                free = np.flatnonzero(self.cells[b] == 0)
                if len(free):
                    self.cells[b, free[0]] = m
                    break
                slot = (kick * 7 + b) % self.SLOTS
                m, self.cells[b, slot] = self.cells[b, slot], m
                b = int(self._other(np.array([b]), np.array([m], np.uint16))[0])
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted."""
        for m, *both in zip(*self._places(keys), strict=True):
            for b in both:
                at = np.flatnonzero(self.cells[b] == m)
                if len(at):
                    self.cells[b, at[0]] = 0
                    break


def _key_array(keys: pa.Array | list) -> np.ndarray:
    return np.frombuffer(b"".join(keys if isinstance(keys, list) else keys.to_pylist()), np.uint64).reshape(-1, 2)


def line_references(docs: DataFrame, *, least: int = 10) -> DataFrame:
    """Each document's distinct keys of at least `least` code points: (key, doc_id)."""

    def refer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {k for line in (text or "").split("\n") if len(line) >= least and len(k := key_of(line)) >= least}
                ids += [doc_id] * len(own)
                keys += map(digest, own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(refer), "key binary, doc_id long")


def _on_filters(filters: DataFrame, keys: DataFrame, work: str) -> DataFrame:
    """For each shard, its filter meets the shard's keys (distinct). work: probe, insert or delete.

    probe gives (shard, key) of the keys that may be in the filter; insert and delete give new filters.
    """

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        shard = (left if len(left) else right).column("shard")[0].as_py()
        own = right.column("key").combine_chunks()
        cuckoo = CuckooFilter.from_bytes(left.column("filter")[0].as_py()) if len(left) else None
        if work == "probe":
            hit = cuckoo.contains(_key_array(own)) if cuckoo and len(own) else np.zeros(len(own), bool)
            found = own.filter(pa.array(hit))
            return pa.table({"shard": pa.array([shard] * len(found), pa.int32()), "key": found.cast(pa.binary())})
        keys = _key_array(own)
        if work == "delete":
            if cuckoo:
                cuckoo.delete(keys)
        else:
            cuckoo = CuckooFilter.sized_for(len(keys))
            while not cuckoo.insert(keys):
                cuckoo = CuckooFilter(2 * cuckoo.buckets)
        data = [cuckoo.to_bytes()] if cuckoo else []
        return pa.table({"shard": pa.array([shard] * len(data), pa.int32()), "filter": pa.array(data, pa.binary())})

    schema = "shard int, key binary" if work == "probe" else "shard int, filter binary"
    return filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInArrow(meet, schema)


class LineIndex:
    """The index after some insertions and deletions.

    references (key, doc_id): every document's keys. counts (key, n_docs, owner): the exact reference count of each key, and the smallest doc_id that
    holds it, kept as a table that each insertion and deletion brings up to date for the keys it meets. filters (shard, filter) with their keys (shard,
    key): the cuckoo filters; an insertion adds filters of its new keys as a level of their own, sized for them, so a filter never has
    to grow. The filters decide which keys of a batch are looked up: a key that no filter may hold enters the counts as new without meeting the table.
    `shards` should be about the expected keys over 500,000.
    """

    def __init__(self, levels: list[tuple[DataFrame, DataFrame]], references: DataFrame | None, counts: DataFrame | None, *, least: int = 10, shards: int = 16):
        self.levels, self.references, self.counts, self.least, self.shards = levels, references, counts, least, shards

    @classmethod
    def empty(cls, *, least: int = 10, shards: int = 16) -> LineIndex:
        return cls([], None, None, least=least, shards=shards)

    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.select(F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard"), "key")

    def maybe_known(self, keys: DataFrame) -> DataFrame:
        """Those of the distinct keys that a filter may hold: all that the index holds, and a few others."""
        hits = [_on_filters(filters, self._sharded(keys), "probe").select("key") for filters, _ in self.levels]
        return reduce(DataFrame.unionByName, hits).distinct() if hits else keys.where(F.lit(False))

    def known(self, keys: DataFrame) -> DataFrame:
        """Those of the distinct keys that the index holds: the filters say which may be, the exact table which are."""
        if self.references is None:
            return keys.where(F.lit(False))
        return self.maybe_known(keys).join(self.counts.select("key"), "key", "left_semi")

    def _new_filters(self, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        fresh = kept_table(self._sharded(keys))
        return kept_table(_on_filters(fresh.select("shard", F.lit(b"").alias("filter")).where(F.lit(False)), fresh, "insert")), fresh

    def insert(self, references: DataFrame) -> LineIndex:
        """The index with more (key, doc_id), as line_references gives them. Pairs that it has already change nothing."""
        pairs = references.select("key", "doc_id").distinct()
        counted = lambda df: df.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("owner"))
        if self.references is None:
            counts = kept_table(counted(pairs))
            return LineIndex([self._new_filters(counts.select("key"))], references, counts, least=self.least, shards=self.shards)
        batch = kept_table(counted(pairs))
        maybe = kept_table(self.maybe_known(batch.select("key")))
        new = batch.join(maybe, "key", "left_anti")
        # of keys that may be known, the pairs that the index doesn't have yet
        more = counted(pairs.join(maybe, "key", "left_semi").join(self.references, ["key", "doc_id"], "left_anti"))
        old = self.counts.select("key", F.col("n_docs").alias("n"), F.col("owner").alias("first"))
        met = kept_table(more.join(old, "key", "left"))
        changed = met.select("key", (F.col("n_docs") + F.coalesce("n", F.lit(0))).alias("n_docs"), F.least("owner", "first").alias("owner"))
        counts = kept_table(self.counts.join(met.select("key"), "key", "left_anti").unionByName(changed).unionByName(new))
        fresh = new.select("key").unionByName(met.where("n IS NULL").select("key"))
        levels = [*self.levels, self._new_filters(fresh)]
        return LineIndex(levels, self.references.unionByName(references), counts, least=self.least, shards=self.shards)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index without the documents of the column doc_id."""
        if self.references is None:
            return self
        ids = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        stay = kept_table(self.references.join(ids, "doc_id", "left_anti").select("key", "doc_id"))
        lost = self.references.join(ids, "doc_id", "left_semi").select("key", "doc_id").distinct().groupBy("key").agg(F.count("*").alias("lost"))
        met = kept_table(self.counts.join(lost, "key").withColumn("n_docs", F.col("n_docs") - F.col("lost")).select("key", "n_docs"))
        owners = stay.join(met.where("n_docs > 0").select("key"), "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("owner"))
        changed = met.where("n_docs > 0").join(owners, "key").select("key", "n_docs", "owner")
        counts = kept_table(self.counts.join(met.select("key"), "key", "left_anti").unionByName(changed))
        dead = kept_table(self._sharded(met.where("n_docs = 0")))
        levels = []
        for filters, own in self.levels:
            gone = own.join(dead.select("key"), "key", "left_semi").select("shard", "key")
            levels.append((kept_table(_on_filters(filters, gone, "delete")), own.join(dead.select("key"), "key", "left_anti").select("shard", "key")))
        return LineIndex(levels, stay, counts, least=self.least, shards=self.shards)

    def drops(self, docs_least: int = 2) -> DataFrame:
        """(doc_id, keys): the keys whose lines each document loses, by the counts. A key's hot row set is split by the join, by AQE."""
        repeated = self.counts.where(F.col("n_docs") >= docs_least)
        lost = self.references.select("key", "doc_id").join(repeated, "key").where(F.col("doc_id") != F.col("owner"))
        return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


def drop_lines(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """docs with the lines of `drops` (doc_id, keys) left out of `text`, and as last columns longs n_lines and n_dropped.

    Columns of docs are kept whatever their names; if docs has an n_lines or n_dropped, the new one is called n_lines_1 and so on.
    """
    names = docs.columns
    own, keys = free_name(names, "doc"), free_name(names, "keys")
    counts = [free_name(names, "n_lines"), free_name(names, "n_dropped")]
    marked = docs.withColumn(own, F.col("doc_id").cast("long")).join(drops.select(F.col("doc_id").alias(own), F.col("keys").alias(keys)), own, "left")
    text_at = names.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, gone_keys in zip(batch.column(text_at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                if gone_keys:
                    gone = set(gone_keys)
                    kept = [x for x in lines if digest(key_of(x)) not in gone]
                    texts.append("\n".join(kept))
                    n_dropped.append(len(lines) - len(kept))
                else:
                    texts.append(text)
                    n_dropped.append(0)
            columns = [pa.array(texts, pa.string()) if i == text_at else batch.column(i) for i in range(len(names))]
            columns += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, *counts])

    schema = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema]
        + [T.StructField(n, T.LongType()) for n in counts]
    )
    return map_rows(marked.select(*map(quoted, names), keys), clean, schema)


def line_index(docs: DataFrame, *, least: int = 10, batches: int = 2, shard_keys: int = 500_000) -> LineIndex:
    """An index of docs, inserted in `batches` batches (by a hash of doc_id)."""
    references = kept_table(line_references(docs, least=least))
    shards = max(16, math.ceil(references.count() / shard_keys))
    index = LineIndex.empty(least=least, shards=shards)
    for k in range(batches):
        index = index.insert(references.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    return index


def dedup_lines(docs: DataFrame, *, least: int = 10) -> DataFrame:
    """docs without lines whose key is in a smaller doc_id too; with n_lines and n_dropped. A null text stays null."""
    return drop_lines(docs, line_index(docs, least=least).drops())


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = """
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
          unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
), repeated AS (
  SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.*, r.key IS NOT NULL AND l.doc_id <> r.owner AS gone FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
