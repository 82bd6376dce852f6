"""Exact ranked lexical search of all documents, with documents as impact vectors in buckets of falling length.

A term is a maximal run of ASCII letters and digits and of any characters beyond ASCII, A-Z lower-cased. A document is a sparse vector with one
coordinate for each query term it holds, sqrt(w) * impact, and a query one of sqrt(w) * occurrences, so that their inner product is the score. All
documents are ordered by vector length and cut into buckets. A query leaves out a bucket when the product of both lengths can't reach its
k-th score so far. Inside a bucket the query's largest coordinates are summed over their postings until what is left of the query is short; a document
whose sum, with the lengths of both rests multiplied (the bound of Cauchy and Schwarz), stays under the k-th score is left out. The survivors are
scored again in 64-bit integers, and only these scores count. The longest buckets are searched first; their k-th scores open the search of all others.

Every document meets every query, as bucket, bound or score; nothing is capped. Items are taken in groups of `group_bytes` of text, so that what is
broadcast (a group's terms, weights and vectors) is bounded; each group reads the documents once.

Rows: a null or empty text, and one without terms, counts nowhere and is never found. Repeated rows of documents are documents of their own; equal
scores are ordered by doc_id, a null one last. Equal rows of items are one item; different texts of one item_id are ranked apart, as is a null
item_id. Very long texts are one vector each. Empty tables give no rows. Columns other than the named ones are not read, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import kept_table, table, tidied
from .words import LOOSE, runs, text_bytes, word_hashes


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(first, append=len(keys))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, pa.int32()))


def term_counts(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs): all terms of each text counted, and those of the sorted vocabulary of term hashes, by place there."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            raw, at = text_bytes(batch.column(1))
            for a, b in runs(at):
                hashes, begin = word_hashes(raw[at[a] : at[b]], at[a : b + 1] - at[a], LOOSE)
                n = np.diff(begin)
                place = np.searchsorted(known, hashes)
                hit = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == hashes) if len(known) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(b - a), n)[hit]
                keys, tf = _counted(row * len(known) + place[hit])
                per_row = np.bincount(keys // max(len(known), 1), minlength=b - a)
                columns = [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), _lists(keys % max(len(known), 1), per_row), _lists(tf, per_row)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(work), "doc_id long, n long, terms array<int>, tfs array<int>")


def impacts(postings: DataFrame, n_docs: int, n_terms: int, weights: np.ndarray) -> DataFrame:
    """(doc_id, terms, impacts, length) of the documents with a term of positive weight."""
    shared = postings.sparkSession.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            terms, tf = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))
            count = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(count)), count)
            value = (1_000_000_000 * tf) // (1000 * tf + 8 * batch.column(1).to_numpy()[row])
            keep = (w[terms] > 0) & (value > 0)
            row, terms, value = row[keep], terms[keep], value[keep]
            square = np.bincount(row, w[terms] * value.astype(float) ** 2, len(count))
            left = np.bincount(row, minlength=len(count))
            full = left > 0
            columns = [batch.column(0).filter(pa.array(full)), _lists(terms, left[full]), _lists(value, left[full]), pa.array(np.sqrt(square[full]))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "terms", "impacts", "length"])

    m = F.expr(f"100 - 75 + (75L * n * {n_docs}L) div {max(n_terms, 1)}L")  # ANSI arithmetic: an overflow is an error
    rows = postings.where(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tfs")
    return rows.mapInArrow(tidied(work), "doc_id long, terms array<int>, impacts array<int>, length double")


def length_buckets(vectors: DataFrame, *, bucket_rows: int = 2048, bucket_terms: int = 1 << 19) -> DataFrame:
    """(longest, ids, lengths, counts, terms, impacts): runs of the vectors in order of falling length, each of at most bucket_rows rows, and of
    about bucket_terms entries unless one row has more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[pa.RecordBatch] = []
        rows = entries = 0

        def bucket() -> pa.RecordBatch:
            whole = pa.Table.from_batches(some).combine_chunks().to_batches()[0]
            count = whole.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            columns = [whole.column(0), whole.column(3), pa.array(count), whole.column(1).flatten(), whole.column(2).flatten()]
            return pa.RecordBatch.from_arrays([whole.column(3).slice(0, 1), *map(one, columns)], ["longest", "ids", "lengths", "counts", "terms", "impacts"])

        for batch in batches:
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False))
            a = 0
            while a < len(ends):
                before = int(ends[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(ends, before + bucket_terms - entries, "right")))
                b = min(b, a + bucket_rows - rows)
                some.append(batch.slice(a, b - a))
                rows, entries = rows + b - a, entries + int(ends[b - 1]) - before
                if rows >= bucket_rows or entries >= bucket_terms or b < len(ends):
                    yield bucket()
                    some, rows, entries = [], 0, 0
                a = b
        if some:
            yield bucket()

    # a length that a third of all rows have is dealt out by doc_id
    order = [F.desc("length"), F.xxhash64("doc_id").asc()]
    placed = vectors.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "longest double, ids array<long>, lengths array<double>, counts array<int>, terms array<int>, impacts array<int>"
    return placed.mapInArrow(tidied(work), schema)


@dataclass(frozen=True)
class Query:
    """A query's terms in order of falling coordinate; rest[i] is the length of the vector without its first i coordinates."""

    terms: np.ndarray
    counts: np.ndarray
    values: np.ndarray
    rest: np.ndarray


def query_vector(terms: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> Query:
    terms, counts = terms[weights[terms] > 0], counts[weights[terms] > 0]
    values = counts * np.sqrt(weights[terms])
    order = np.argsort(-values, kind="stable")
    terms, counts, values = terms[order], counts[order], values[order]
    rest = np.sqrt(np.concatenate([np.cumsum(values[::-1] ** 2)[::-1], [0.0]]))
    return Query(terms, counts, values, rest)


class Bucket:
    """Some documents' vectors, by row and by term."""

    def __init__(self, ids: pa.Array, lengths: np.ndarray, counts: np.ndarray, terms: np.ndarray, values: np.ndarray, weights: np.ndarray):
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.lengths, self.longest = lengths, float(lengths.max())
        self.at = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
        self.terms, self.column = np.unique(terms, return_inverse=True)
        self.impacts = values.astype(np.int64)
        self.weights = weights
        order = np.argsort(self.column, kind="stable")
        self.rows = np.repeat(np.arange(len(counts)), counts)[order]
        self.values = (np.sqrt(weights[terms]) * values)[order]
        self.begin = np.concatenate([np.searchsorted(self.column[order], np.arange(len(self.terms))), [len(terms)]])

    def survivors(self, query: Query, kth: int) -> np.ndarray:
        """Rows whose score may reach kth, and is above 0."""
        if not len(query.terms) or query.rest[0] * self.longest * (1 + 1e-9) < kth:  # no length in the bucket is enough
            return np.zeros(0, np.int64)
        focus = int(np.searchsorted(-query.rest, -kth / (2 * self.longest))) if kth > 0 else len(query.terms)
        place = np.searchsorted(self.terms, query.terms[:focus])
        total, used = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        for i in np.flatnonzero(self.terms[np.minimum(place, len(self.terms) - 1)] == query.terms[:focus]).tolist():
            span = slice(self.begin[place[i]], self.begin[place[i] + 1])
            rows, values = self.rows[span], self.values[span]
            total[rows] += query.values[i] * values
            used[rows] += values * values
        left = np.sqrt(np.maximum(self.lengths**2 - used, 0) + 1e-9 * self.lengths**2)
        bound = total + query.rest[focus] * left + 1e-9 * query.rest[0] * self.lengths
        return np.flatnonzero((bound >= kth) & ((total > 0) | (query.rest[focus] > 0)))

    def scores(self, query: Query, rows: np.ndarray) -> np.ndarray:
        """Exact scores of the rows."""
        factor = np.zeros(len(self.terms), np.int64)
        place = np.minimum(np.searchsorted(self.terms, query.terms), len(self.terms) - 1)
        known = self.terms[place] == query.terms
        factor[place[known]] = (query.counts * self.weights[query.terms])[known]
        count = self.at[rows + 1] - self.at[rows]
        first = np.cumsum(count) - count
        entry = np.arange(count.sum()) + np.repeat(self.at[rows] - first, count)
        return np.add.reduceat(factor[self.column[entry]] * self.impacts[entry], first) if len(rows) else np.zeros(0, np.int64)


def search_buckets(buckets: DataFrame, queries: list[Query], floors: list[int], weights: np.ndarray, k: int) -> DataFrame:
    """(query, doc_id, score): of each task's buckets the k best rows for each query, of scores of at least the query's floor."""
    shared = buckets.sparkSession.sparkContext.broadcast((queries, floors, weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, floors, weights = shared.value
        empty = np.zeros(0, np.int64)
        best = [(empty, np.zeros(0, bool), empty) for _ in queries]
        kth = list(floors)
        for batch in batches:
            for i in range(batch.num_rows):
                lengths, counts, terms, values = (batch.column(c).slice(i, 1).flatten().to_numpy() for c in (2, 3, 4, 5))
                bucket = Bucket(batch.column(1).slice(i, 1).flatten(), lengths, counts, terms, values, weights)
                for q, query in enumerate(queries):
                    rows = bucket.survivors(query, kth[q])
                    if not len(rows):
                        continue
                    score = bucket.scores(query, rows)
                    good = score >= max(kth[q], 1)
                    rows, score = rows[good], score[good]
                    parts = zip(best[q], (score, bucket.null[rows], bucket.ids[rows]), strict=True)
                    score, null, ids = (np.concatenate(x) for x in parts)
                    order = np.lexsort((ids, null, -score))[:k]
                    best[q] = score[order], null[order], ids[order]
                    if len(order) == k:
                        kth[q] = max(kth[q], int(score[order[-1]]))
        made = [np.concatenate([b[i] for b in best]) for i in range(3)] if best else [empty] * 3
        which = np.repeat(np.arange(len(best)), [len(b[0]) for b in best])
        columns = [pa.array(which, pa.int32()), pa.array(made[2], pa.int64(), mask=made[1].astype(bool)), pa.array(made[0], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["query", "doc_id", "score"])

    return buckets.mapInArrow(tidied(work), "query int, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def _ranked_group(docs: DataFrame, items: list, k: int, head: int) -> DataFrame:
    """(item_id, rank, doc_id, score) for the items (rows of item_id, text) of one group."""
    spark = docs.sparkSession
    raw, at = text_bytes(pa.array([r.text for r in items], pa.string()))
    hashes, begin = word_hashes(raw, at, LOOSE)
    vocabulary, place = np.unique(hashes, return_inverse=True)
    postings = kept_table(term_counts(docs, vocabulary))
    sums = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, n_terms = sums[0], sums[1]
    # a row for each term of the group at most
    df = postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, count in df:
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * count + 1)))
    queries = []
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        queries.append(query_vector(*_counted(place[a:b]), weights))
    buckets = kept_table(length_buckets(impacts(postings, n_docs, n_terms, weights)))
    longest = [r.longest for r in buckets.select("longest").orderBy(F.desc("longest")).limit(head).collect()]
    least = F.col("longest") >= (longest[-1] if longest else 0.0)
    first = kept_table(_best(search_buckets(buckets.where(least), queries, [0] * len(queries), weights, k), k).drop("rank"))
    floors = [0] * len(queries)
    # k-th scores: a row for each item of the group at most
    for r in first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).collect():
        floors[r["query"]] = r.kth
    rest = search_buckets(buckets.where(~least), queries, floors, weights, k)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(items)], "query int, item_id long")
    return _best(first.unionByName(rest), k).join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, *, k: int = 10, group_bytes: int = 8 << 20, head: int = 8) -> DataFrame:
    """(item_id, rank, doc_id, score): for each of items (item_id, text) the k documents (doc_id, text) of the highest scores above 0.

    A term's weight is floor(1000 * ln((2N + 2) / (2df + 1))), its impact (10**9 * tf) div (1000 * tf + 8m), with m = 25 + (75 * n * N) div L.
    group_bytes bounds the text of the items that are searched together, but for one longer item; the `head` longest buckets are searched first.
    """
    spark = docs.sparkSession
    items = kept_table(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0).distinct())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = math.ceil(size / group_bytes)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for g in range(groups):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).orderBy("item_id", "text").collect()
        if some:
            ranked = _ranked_group(docs, some, k, head)
            out = ranked if groups == 1 else out.unionByName(kept_table(ranked))
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS terms, row_number() OVER () AS r FROM documents
), sized AS (SELECT r, doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0
), total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sized
), tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM sized) GROUP BY ALL
), weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, n_docs
), q AS (
  SELECT item_id, term, count(*) AS qtf FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), scored AS (
  SELECT item_id, r, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN weight USING (term) JOIN tf USING (term) JOIN sized USING (r), total GROUP BY item_id, r, doc_id
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
) WHERE rank <= 10
"""
