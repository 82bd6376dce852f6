"""Retrieval for tables of queries: vector, lexical and fused ranking, and joins by substring."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .settled import settled


def semantic_topk(queries: DataFrame, vectors: DataFrame, *, k: int = 20, min_similarity: float = 0.3, block: int = 2_000) -> DataFrame:
    """(query_id, chunk_id, similarity, rank): cosine similarity, rounded to 6 places, of queries (query_id, vector) and vectors (chunk_id, embedding).

    If both have a repo_id, only those of one repository meet. Queries are broadcast in blocks of about `block` rows; every batch of vectors is
    multiplied with a block's matrix, and leaves its tasks with the best k of each query only. Vectors that are null, zero or of another
    length than a query's are not found.
    """
    in_repo = "repo_id" in queries.columns and "repo_id" in vectors.columns
    columns = ["query_id", "vector"] + ["repo_id"] * in_repo
    asked = settled(queries.select(*columns).withColumn("q", F.monotonically_increasing_id()))
    blocks = max(1, -(-asked.count() // block))
    rows = vectors.select("chunk_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("repo_id") if in_repo else F.lit(None)).cast("string").alias("repo_id"))
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("chunk_id", vectors.schema["chunk_id"].dataType), T.StructField("s", T.DoubleType())])
    found = []
    for i in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).select(
            "q", F.col("vector").cast("array<double>").alias("v"), (F.col("repo_id") if in_repo else F.lit(None)).cast("string").alias("repo_id")
        ).collect()  # about `block` rows: bounded
        by_length: dict[int, list] = {}
        for r in some:
            if r.v and all(x is not None for x in r.v) and any(r.v):
                by_length.setdefault(len(r.v), []).append(r)
        packed = {
            n: (np.array([r.q for r in own]), np.array([r.v for r in own]), np.array([r.repo_id or "" for r in own])) for n, own in by_length.items()
        }
        shared = vectors.sparkSession.sparkContext.broadcast(packed)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists, repos = batch.column(1), np.array([x or "" for x in batch.column(2).to_pylist()])
                length = np.array([-1 if x is None else x for x in pc.list_value_length(lists).to_pylist()])
                for n, (q, matrix, q_repos) in shared.value.items():
                    at = np.flatnonzero(length == n)
                    if not len(at):
                        continue
                    v = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                    norms = np.linalg.norm(v, axis=1)
                    ok = np.isfinite(norms) & (norms > 0)
                    at, v, norms = at[ok], v[ok], norms[ok]
                    s = (matrix / np.linalg.norm(matrix, axis=1)[:, None]) @ v.T / norms
                    if in_repo:
                        s = np.where(q_repos[:, None] == repos[at], s, -2.0)
                    low = np.full(len(q), min_similarity - 1e-6)
                    if s.shape[1] > k:  # of equal similarities all go on
                        low = np.maximum(low, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - 1e-6)
                    x, y = np.nonzero(s >= low[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(q[x]), batch.column(0).take(pa.array(at[y])), pa.array(s[x, y])], ["q", "chunk_id", "s"])

        found.append(rows.mapInArrow(work, schema))
    near = reduce(DataFrame.unionByName, found).withColumn("similarity", F.round("s", 6)).where(F.col("similarity") >= min_similarity)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "chunk_id"))).where(F.col("rank") <= k)
    return best.join(asked.select("q", "query_id"), "q").select("query_id", "chunk_id", "similarity", "rank")


def minmax_normalize(scored: DataFrame) -> DataFrame:
    """score to 0..1 for each query and strategy; where all are equal, 1 if over 0 else 0."""
    w = Window.partitionBy("query_id", "strategy")
    low, high = F.min("score").over(w), F.max("score").over(w)
    value = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.when(high > 0, 1.0).otherwise(0.0))
    return scored.withColumn("normalized", value)


def fuse_rankings(scored: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, file_path, token_count, final): weighted strategies, a bonus for two or more, and for the scoped file; 1 at most.

    scored (query_id, chunk_id, file_path, token_count, strategy, score); scope (query_id, scope_path).
    """
    best = minmax_normalize(scored).groupBy("query_id", "chunk_id", "file_path", "token_count", "strategy").agg(F.max("normalized").alias("x"))
    of = lambda s, w: F.coalesce(F.max(F.when(F.col("strategy") == s, F.col("x"))), F.lit(0.0)) * w
    fused = best.groupBy("query_id", "chunk_id", "file_path", "token_count").agg(
        (of("semantic", 0.45) + of("lexical", 0.30) + of("structural", 0.25)).alias("base"), F.countDistinct("strategy").alias("n_strategies")
    )
    final = F.col("base") + F.when(F.col("n_strategies") >= 2, 0.15).otherwise(0.0)
    if scope is not None:
        fused = fused.join(scope, "query_id", "left")
        final = final + F.when(F.col("file_path") == F.col("scope_path"), 0.30).otherwise(0.0)
    return fused.withColumn("final", F.round(F.least(F.lit(1.0), final), 6)).select("query_id", "chunk_id", "file_path", "token_count", "n_strategies", "final")


def duplicate_chunks(chunks: DataFrame) -> DataFrame:
    """(content_hash, n, first_chunk_id) of contents that occur more than once."""
    return chunks.groupBy(F.sha2("content", 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_chunk_id")).where("n > 1")


def contains_join(left: DataFrame, right: DataFrame, needle: str, hay: str, on: list[str]) -> DataFrame:
    """The rows of left and right of equal `on` columns where the text `hay` of right holds the text `needle` of left, case aside.

    Rows meet by a gram that every text with the needle has: of its three-letter pieces (a shorter needle is its own) the one that the fewest texts of
    right have, so a frequent piece is a key only for needles without a rarer one. Empty needles find nothing.
    """
    pieces = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(n)))
    low, want = F.lower(hay), F.lower("needle_")
    in_hay = F.filter(F.array_distinct(F.concat(pieces(low, 3), pieces(low, 2), pieces(low, 1))), lambda g: g != "")
    needles = left.select(F.col(needle).alias("needle_")).distinct().where("needle_ <> ''")
    asked = needles.select("needle_", F.explode(F.array_distinct(F.when(F.length(want) >= 3, pieces(want, 3)).otherwise(F.array(want)))).alias("gram_"))
    keyed = right.withColumn("gram_", F.explode(in_hay))
    counted = keyed.select("gram_").join(asked.select("gram_").distinct(), "gram_", "left_semi").groupBy("gram_").agg(F.count("*").alias("n_"))
    # a piece that no text has is a needle that no text has
    rarest = asked.join(counted, "gram_", "left").groupBy("needle_").agg(F.min_by("gram_", F.struct(F.coalesce("n_", F.lit(0)), "gram_")).alias("gram_"))
    near = left.join(rarest, left[needle] == rarest["needle_"]).drop("needle_")
    return near.join(keyed, ["gram_", *on]).where(F.lower(hay).contains(F.lower(needle))).drop("gram_")


def suggest_symbols(prefixes: DataFrame, symbols: DataFrame, *, most: int = 50) -> DataFrame:
    """Symbols whose name holds a text of prefixes (prefix), case aside; by name and id."""
    # of the symbols of one name no more than `most` can be among a prefix's first, so names are cut before they meet the prefixes
    own = Window.partitionBy("repo_id", "name").orderBy("symbol_id")
    few = symbols.withColumn("n_", F.row_number().over(own)).where(F.col("n_") <= most)
    named = few.groupBy("repo_id", "name").agg(F.sort_array(F.collect_list(F.struct("symbol_id"))).alias("ids_"))
    # a prefix's names, first to last, until they have `most` symbols
    before = Window.partitionBy("repo_id", "prefix").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    met = contains_join(prefixes, named, "prefix", "name", []).withColumn("before_", F.coalesce(F.sum(F.size("ids_")).over(before), F.lit(0))).where(F.col("before_") < most)
    rows = met.select("repo_id", "prefix", "name", "before_", F.posexplode("ids_").alias("at_", "id_")).select("*", "id_.symbol_id").withColumn("place", (F.col("before_") + F.col("at_") + 1).cast("int"))
    return rows.where(F.col("place") <= most).select("repo_id", "prefix", "symbol_id", "name", "place")
