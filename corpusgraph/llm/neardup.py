"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures, confirmed on whole shingle sets.

1. Each text gets its set of distinct 5-word shingles (as 64-bit hashes) and a signature of 36 symbols of 16 bits, one for
   each minhash. Equal sets are one node from here on, found by a 64-bit fingerprint of the set.
2. The signature is split into 6 chunks of 6 symbols. By pigeonhole, two signatures that differ in up to 17 symbols have a
   chunk that differs in 2 at most. These chunk errors are enumerated: each of the 15 ways to leave out two symbols of a
   chunk gives a key, so any such pair of nodes shares one of 90 keys. (Of two texts at the similarity of 0.75 itself, one
   pair in 40,000 shares none; pairs above it are surer.)
3. Nodes that share a key are compared: signatures first, then whole sets. Not all pairs of a key: its nodes are first held
   against one of them, the one that shares most keys with others. Confirmed links make components. What remains of keys whose nodes are in several components is compared in blocks, component against
   component, so no link between components is lost; inside a component further links change nothing. Before this, each
   node's shingles that no other such node has are counted: they bound its similarity to any other, exactly.

So a group of thousands of copies around one text costs a few comparisons each, whatever its size, and equal texts none.

Defined results: null and blank texts have empty sets (n_shingles 0) and are alone; with fewer than 5 words the whole sequence is the
one shingle; equal doc_ids count as one document for component_id, and each row is returned; a null doc_id gives a null component_id
and kept = false, and links nothing.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import kept_table, table, tidied
from .components import connected_components
from .words import mix, runs, shingle_sets, text_bytes, word_hashes

CHUNKS, SYMBOLS, ERRORS = 6, 6, 2
HASHES = CHUNKS * SYMBOLS
_KEPT = np.array(list(itertools.combinations(range(SYMBOLS), SYMBOLS - ERRORS)))
KEYS = CHUNKS * len(_KEPT)
_RNG = np.random.Generator(np.random.PCG64(77))
_FACTORS = (_RNG.integers(0, 2**63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_SHIFTS = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
#: Longer sketches, of one byte for each minhash, for nodes that are compared in blocks; at 0.75, one pair in 400,000 has
#: fewer equal bytes than LEAST_BYTES.
SKETCH, LEAST_BYTES = 512, 340
_SKETCH_FACTORS = (_RNG.integers(0, 2**63, SKETCH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_SKETCH_SHIFTS = _RNG.integers(0, 2**63, SKETCH, dtype=np.uint64)
#: Signatures with fewer equal symbols are not compared further: at 0.75, one pair in 100,000 has as few.
LEAST_EQUAL = 14


def signatures(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The low 16 bits of each minhash of each set; sets must not be empty."""
    out = np.empty((len(at) - 1, HASHES), np.uint16)
    for k in range(HASHES):
        out[:, k] = mix(np.minimum.reduceat((shingles ^ _SHIFTS[k]) * _FACTORS[k], at[:-1])).astype(np.uint16)
    return out


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    raw, at = text_bytes(column)
    for i, j in runs(at):
        shingles, begin = shingle_sets(*word_hashes(raw[at[i] : at[j]], at[i : j + 1] - at[i]))
        yield i, shingles, begin


def _fingerprints(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(shingles + np.uint64(1)), dtype=np.uint64)])
    return mix((total[at[1:]] - total[at[:-1]]) ^ (np.diff(at).astype(np.uint64) << np.uint64(32))).view(np.int64)


def text_signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, node, signature) of each row; signature is null where the set is empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, signs = [], [], []
            for _, shingles, at in _sets(batch.column(1)):
                n = np.diff(at)
                full = np.flatnonzero(n)
                made: list = [None] * len(n)
                if len(full):
                    own = signatures(shingles, np.append(at[:-1][full], at[-1]))
                    for i, s in zip(full.tolist(), own, strict=True):
                        made[i] = s.tobytes()
                sizes.append(n)
                nodes.append(_fingerprints(shingles, at))
                signs += made
            empty = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate([empty, *sizes])), pa.array(np.concatenate([empty, *nodes])), pa.array(signs, pa.binary())],
                ["doc_id", "n", "node", "signature"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(work), "doc_id long, n long, node long, signature binary")


def _signs(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def chunk_keys(signs: np.ndarray) -> np.ndarray:
    """The KEYS keys of each signature: four symbols of a chunk and which they are."""
    wide = signs.astype(np.uint64).reshape(-1, CHUNKS, SYMBOLS)
    out = np.empty((len(signs), KEYS), np.uint64)
    for c in range(CHUNKS):
        for k, (p, q, r, s) in enumerate(_KEPT):
            x = wide[:, c]
            packed = x[:, p] | (x[:, q] << np.uint64(16)) | (x[:, r] << np.uint64(32)) | (x[:, s] << np.uint64(48))
            j = c * len(_KEPT) + k
            out[:, j] = mix(packed + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
    return out


def _keys(nodes: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, len(batch), 1000)):
                keys = chunk_keys(_signs(part.column(1))).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), KEYS))], ["key", "node"]
                )

    return nodes.select("node", "signature").mapInArrow(tidied(work), "key long, node long")


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose sizes, common shingles (at most, column common) and signatures allow the similarity."""
    some = nodes.select("node", "n", "common", "signature")
    both = pairs.join(some.toDF("u", "n_u", "c_u", "s_u"), "u").join(some.toDF("v", "n_v", "c_v", "s_v"), "v")
    most = F.least("c_u", "c_v")
    both = both.where(most * 100 >= (F.col("n_u") + F.col("n_v") - most) * 75)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_signs(batch.column(2)) == _signs(batch.column(3))).sum(axis=1) >= LEAST_EQUAL
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(near))

    return both.select("u", "v", "s_u", "s_v").mapInArrow(tidied(work), "u long, v long")


def _whole_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """(node, shingles) of the wanted nodes, made again from the text of each node's first document."""
    chosen = kept_table(nodes.join(wanted, "node", "left_semi").select("doc_id", "node"))
    few = chosen.count() <= broadcast_rows  # two numbers each; more rows are joined by a shuffle
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen) if few else chosen, "doc_id").select("node", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted_nodes = batch.column(0).to_numpy()
            for i, shingles, at in _sets(batch.column(1)):
                same = _fingerprints(shingles, at) == wanted_nodes[i : i + len(at) - 1]
                own = np.flatnonzero(same)
                data = [shingles[at[k] : at[k + 1]].tobytes() for k in own.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(wanted_nodes[i + own]), pa.array(data, pa.binary())], ["node", "shingles"])

    return rows.mapInArrow(tidied(work), "node long, shingles binary").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) with 100 * |u & v| >= 75 * |u | v|."""
    both = pairs.join(sets.toDF("u", "s_u"), "u").join(sets.toDF("v", "s_v"), "v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both_in = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((both_in[1:] == both_in[:-1]).sum())
                ok.append(100 * common >= 75 * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return both.select("u", "v", "s_u", "s_v").mapInArrow(tidied(work), "u long, v long")


def _common_counts(sets: DataFrame) -> DataFrame:
    """(node, alone): how many of each node's shingles no other node of sets (node, shingles) has."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, len(batch), 200)):
                data = part.column(1).to_pylist()
                owner = np.repeat(part.column(0).to_numpy(), [len(x) // 8 for x in data])
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(data), np.int64)), pa.array(owner)], ["shingle", "node"])

    held = sets.mapInArrow(tidied(spread), "shingle long, node long").groupBy("shingle").agg(F.count("*").alias("k"), F.min("node").alias("node"))
    return held.where("k = 1").groupBy("node").agg(F.count("*").alias("alone"))


def _sketches(sets: DataFrame) -> DataFrame:
    """(node, sketch) of sets (node, shingles)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, len(batch), 200)):
                data = part.column(1).to_pylist()
                at = np.cumsum([0, *(len(x) // 8 for x in data)])[:-1]
                shingles = np.frombuffer(b"".join(data), np.uint64)
                out = np.empty((len(data), SKETCH), np.uint8)
                for k in range(SKETCH):
                    out[:, k] = mix(np.minimum.reduceat((shingles ^ _SKETCH_SHIFTS[k]) * _SKETCH_FACTORS[k], at)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in out], pa.binary())], ["node", "sketch"])

    return sets.mapInArrow(tidied(work), "node long, sketch binary")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def _rest_pairs(members: DataFrame, nodes: DataFrame, block: int = 512, rows_at_once: int = 20_000) -> DataFrame:
    """Pairs (u, v) of different components that share a key, alike by their sketches; each only from its first shared key.

    members (key, node, component). A key's nodes are dealt into blocks of about `block`; every two blocks meet.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = members.join(sizes, "key").withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("cell", F.xxhash64("key", F.least("b", "other"), F.greatest("b", "other")))
    dealt = kept_table(dealt.select("cell", "key", "node", "component", "b"))
    groups = max(1, math.ceil(dealt.count() / rows_at_once))
    full = dealt.join(nodes.select("node", "n", "common", "signature", "sketch"), "node").withColumn("g", F.pmod(F.col("cell"), F.lit(groups)))

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("cell")
        cell, key = rows.column("cell").to_numpy(), rows.column("key").to_numpy()
        node, component = rows.column("node").to_numpy(), rows.column("component").to_numpy()
        n, common = rows.column("n").to_numpy(), rows.column("common").to_numpy()
        b, signs = rows.column("b").to_numpy(), _signs(rows.column("signature"))
        sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        left, right = [], []
        for x, y in zip(starts, np.append(starts[1:], len(cell)), strict=True):
            s, size, most, comp, blocks = sketches[x:y], n[x:y], common[x:y], component[x:y], b[x:y]
            for i in range(y - x - 1):
                ok = comp[i + 1 :] != comp[i]
                if blocks.min() != blocks.max():  # nodes of one block meet in the block's own cell
                    ok &= blocks[i + 1 :] != blocks[i]
                both = np.minimum(most[i + 1 :], most[i])
                ok &= 100 * both >= 75 * (size[i + 1 :] + size[i] - both)
                at = np.flatnonzero(ok)
                if len(at):
                    at = at[(s[i + 1 + at] == s[i]).sum(axis=1) >= LEAST_BYTES]
                left += [x + i] * len(at)
                right += (x + i + 1 + at).tolist()
        left, right = np.array(left, np.int64), np.array(right, np.int64)
        if len(left):
            shared = np.zeros(len(left), bool)
            for i in range(0, len(left), 5000):
                p, q = chunk_keys(signs[left[i : i + 5000]]), chunk_keys(signs[right[i : i + 5000]])
                first = (p == q).argmax(axis=1)
                shared[i : i + 5000] = p[np.arange(len(p)), first].view(np.int64) == key[left[i : i + 5000]]
            left, right = left[shared], right[shared]
        return pa.table({"u": pa.array(node[left], pa.int64()), "v": pa.array(node[right], pa.int64())})

    return full.groupBy("g").applyInArrow(compare, "u long, v long")


def _open(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows (key, node, weight, component) of members whose key's nodes are in several components."""
    placed = members.select("key", "node", "weight").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    return placed.join(apart, "key", "left_semi").select("key", "node", "weight", "component")


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id, text)."""
    rows = kept_table(text_signatures(docs))
    some = rows.where("doc_id IS NOT NULL AND n > 0")
    nodes = kept_table(some.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("signature").alias("signature")))
    nodes = nodes.withColumn("common", F.col("n"))
    keys = _keys(nodes)
    shared = kept_table(keys.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"))
    members = kept_table(keys.join(shared, "key").select("key", "node", "k"))
    weight = members.groupBy("node").agg(F.sum("k").alias("weight"))
    members = kept_table(members.join(weight, "node").select("key", "node", "weight"))
    sets = kept_table(_whole_sets(docs, nodes, members.select("node").distinct()))
    top = F.max_by("node", F.struct("weight", "node"))

    pivots = members.groupBy("key").agg(top.alias("pivot"))
    star = _ordered(members.join(pivots, "key").select(F.col("node").alias("u"), F.col("pivot").alias("v")))
    links = kept_table(_confirmed(_alike(star, nodes), sets))
    parts = connected_components(links)

    # keys whose nodes are in several components
    placed = kept_table(_open(members, parts))
    alone = _common_counts(sets.join(placed.select("node").distinct(), "node", "left_semi"))
    bounded = nodes.drop("common").join(alone, "node", "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0)))
    few = sets.join(placed.select("node").distinct(), "node", "left_semi")
    bounded = kept_table(bounded.join(_sketches(few), "node"))
    rest = _rest_pairs(placed.select("key", "node", "component"), bounded)
    links = kept_table(links.unionByName(_confirmed(_ordered(rest), sets)))
    parts = connected_components(links)

    placed = nodes.join(parts, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_node = placed.join(smallest, "component").select("node", "component_id")
    out = rows.select("doc_id", "n", "node").join(by_node, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))
