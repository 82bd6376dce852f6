"""Ranked lexical search in web syntax over positional postings, and the trigram search that fills short results up."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .settled import settled


def terms_of(text_column: str) -> Column:
    return F.filter(F.split(F.lower(text_column), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def web_terms(text: Column) -> Column:
    """The items of a search in web syntax: an array of (clause, negative, terms). An item's terms stand in a row: a quoted phrase, or a word with
    signs inside, has several. Items around OR share a clause, of which one is enough; an item after - must not occur."""
    tokens = F.regexp_extract_all(text, F.lit(r'-?"[^"]*"|\S+'), F.lit(0))
    start = F.struct(F.lit(0).alias("clause"), F.lit(False).alias("joined"), F.array().cast("array<struct<clause:int,negative:boolean,terms:array<string>>>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        words = F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
        negative = t.startswith("-")
        clause = a["clause"] + F.when(a["joined"] & (F.size(a["out"]) > 0), 0).otherwise(1)
        item = F.struct(clause.cast("int").alias("clause"), negative.alias("negative"), words.alias("terms"))
        is_or = t == "OR"
        return F.struct(
            F.when(is_or | (F.size(words) == 0), a["clause"]).otherwise(clause).alias("clause"),
            F.when(F.size(words) == 0, a["joined"]).otherwise(is_or).alias("joined"),
            F.when(is_or | (F.size(words) == 0), a["out"]).otherwise(F.concat(a["out"], F.array(item))).alias("out"),
        )

    return F.aggregate(tokens, start, step)["out"]


def positional_postings(chunks: DataFrame, wanted: DataFrame, blocks: int = 1) -> DataFrame:
    """(term, chunk_id, block, length, tf, places, and repo_id if there is one) of the wanted terms (term, phrased) in chunks (chunk_id, content).

    Chunks are dealt to blocks by hash. places are kept for phrased terms only, in order.
    """
    repo = [c for c in ("repo_id",) if c in chunks.columns]
    words = chunks.select("chunk_id", *repo, terms_of("content").alias("terms")).withColumn("length", F.size("terms"))
    few = wanted.count() <= 500_000  # terms of the queries, not of the corpus; more of them are joined by a shuffle
    each = words.select("chunk_id", *repo, "length", F.posexplode("terms").alias("at", "term")).join(F.broadcast(wanted) if few else wanted, "term")
    places = F.array_sort(F.collect_list(F.when(F.col("phrased"), F.col("at"))))
    block = F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int")
    return each.groupBy("term", "chunk_id", *repo, "length").agg(F.count("*").alias("tf"), places.alias("places")).withColumn("block", block)


def _phrase_occurs(terms: Column, places: Column) -> Column:
    """Whether the terms stand in a row somewhere; places is a map from term to places."""
    starts = F.aggregate(
        F.sequence(F.lit(1), F.size(terms) - 1), F.try_element_at(places, terms[0]),
        lambda found, i: F.array_intersect(found, F.transform(F.try_element_at(places, F.get(terms, i)), lambda p: p - i)),
    )
    return F.size(starts) > 0


def lexical_topk(
    queries: DataFrame, chunks: DataFrame, *, k: int = 20, k1: float = 1.2, b: float = 0.75, block_rows: int = 4_096, head: int = 4
) -> DataFrame:
    """(query_id, chunk_id, score, rank): the best chunks for queries (query_id, text) in web syntax, by BM25 rounded to 6 places.

    A chunk meets a query if it has an item (a word, or a phrase at consecutive places) of each clause and no negative one; a query of
    negative items only finds nothing. Its score sums BM25 over the distinct terms of all positive items it has. If both have a repo_id, only
    those of one repository meet; frequencies are of all chunks.

    Chunks are dealt to blocks of about `block_rows`. A block's bound for a query is the sum of its terms' largest parts there; a block without one of the clauses is
    left out. The `head` blocks of the highest bounds are searched first, then those whose bound reaches the k-th score found there.
    In a block only the chunks that have an item of the query's rarest clause meet its other terms.
    """
    repo = [c for c in ("repo_id",) if c in queries.columns and c in chunks.columns]
    items = queries.select("query_id", *repo, F.posexplode(web_terms(F.col("text"))).alias("item", "x")).select("query_id", *repo, "item", "x.*")
    items = settled(items.withColumn("terms", F.col("terms")).withColumn("n_distinct", F.size(F.array_distinct("terms"))))
    words = items.select("*", F.explode(F.array_distinct("terms")).alias("term"))
    wanted = words.groupBy("term").agg(F.max(F.size("terms") > 1).alias("phrased"))
    # one row
    n_chunks, mean_length = chunks.select(F.size(terms_of("content")).alias("n")).agg(F.count("*"), F.coalesce(F.avg("n"), F.lit(1.0))).first()
    blocks = max(1, -(-n_chunks // block_rows))
    index = settled(positional_postings(chunks, settled(wanted), blocks))
    frequency = index.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n_chunks - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(float(mean_length))))
    words = settled(words.join(frequency, "term", "left").withColumn("df", F.coalesce("df", F.lit(0))))
    index = index.join(words.select("term", "df").distinct(), "term").withColumn("part", part).select("term", "chunk_id", *repo, "block", "part", "places")

    positive = words.where("NOT negative")
    maxima = index.groupBy(*repo, "term", "block").agg(F.max("part").alias("most"))
    n_clauses = positive.groupBy("query_id").agg(F.countDistinct("clause").alias("n_clauses"))
    by_clause = positive.select("query_id", *repo, "clause", "term").distinct().join(maxima, [*repo, "term"]).groupBy("query_id", *repo, "clause", "block").agg(F.sum("most").alias("most"))
    bounds = by_clause.groupBy("query_id", *repo, "block").agg(F.sum("most").alias("bound"), F.count("*").alias("met")).join(n_clauses, "query_id").where("met = n_clauses")
    best_first = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    bounds = settled(bounds.withColumn("n", F.row_number().over(best_first)).select("query_id", *repo, "block", "bound", "n", "n_clauses"))

    # an item is looked for by its rarest term, a clause costs the sum of these, and the cheapest clause leads
    leads = positive.groupBy("query_id", "clause", "item").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.min("df").alias("df"))
    cost = F.sum("df").over(Window.partitionBy("query_id", "clause"))
    cheapest = F.min(F.struct("cost", "clause")).over(Window.partitionBy("query_id"))["clause"]
    leads = leads.withColumn("cost", cost).withColumn("cheapest", cheapest).where("clause = cheapest").select("query_id", "term").distinct()

    def search(some: DataFrame) -> DataFrame:
        met = some.join(leads, "query_id").join(index, [*repo, "term", "block"]).select("query_id", "n_clauses", "chunk_id").distinct()
        hits = met.join(words.drop("df", *repo), "query_id").join(index.select("term", "chunk_id", "part", "places"), ["chunk_id", "term"])
        each = hits.repartition("query_id", "chunk_id").groupBy("query_id", "chunk_id", "n_clauses", "item", "clause", "negative", "terms", "n_distinct")
        found = each.agg(F.count("*").alias("m"), F.collect_list(F.struct("term", "part")).alias("parts"), F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))
        found = found.where("m = n_distinct").where((F.size("terms") == 1) | _phrase_occurs(F.col("terms"), F.col("at")))
        parts = F.array_distinct(F.flatten(F.collect_list(F.when(~F.col("negative"), F.col("parts")))))
        chunk = found.groupBy("query_id", "chunk_id", "n_clauses").agg(
            F.countDistinct(F.when(~F.col("negative"), F.col("clause"))).alias("met"), F.max("negative").alias("bad"), parts.alias("parts")
        )
        score = F.round(F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"]), 6)
        return chunk.where("met = n_clauses AND NOT bad").select("query_id", "chunk_id", score.alias("score"))

    def best(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = best(search(bounds.where(F.col("n") <= head)))
    if blocks <= head:
        return first
    first = settled(first.drop("rank"))
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    rest = bounds.where(F.col("n") > head).join(kth, "query_id", "left").where(F.coalesce(F.col("bound") + 1e-6 >= F.col("kth"), F.lit(True)))
    return best(first.unionByName(search(rest.drop("kth"))))


# trigrams


class _Asked:
    """Some queries' trigrams as inverted lists, those of each query split: its most frequent ones, of which it needs not any to be similar enough, apart."""

    def __init__(self, rows: list, frequency: dict[int, int], least: float):
        self.sizes = np.array([len(r.grams) for r in rows], np.int64)
        self.repos = np.array([r.repo_id or "" for r in rows])
        self.vocabulary = np.array(sorted({g for r in rows for g in r.grams}), np.int64)
        place = {int(g): i for i, g in enumerate(self.vocabulary)}
        rare: list[list[int]] = [[] for _ in place]
        common: list[list[int]] = [[] for _ in place]
        self.n_common = np.zeros(len(rows), np.int64)
        for q, r in enumerate(rows):
            # of more than least * size shared trigrams one is among all but the last least * size
            first = len(r.grams) - int(np.floor(least * len(r.grams)))
            self.n_common[q] = len(r.grams) - first
            for n, g in enumerate(sorted(r.grams, key=lambda g: (frequency.get(g, 0), g))):
                (rare if n < first else common)[place[g]].append(q)
        self.rare, self.common = map(self._lists, (rare, common))

    @staticmethod
    def _lists(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64), np.array([q for x in lists for q in x], np.int64)

    def shared(self, row: np.ndarray, gram: np.ndarray, n_rows: int, lists: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """How many trigrams of the lists each row shares with each query."""
        at, members = lists
        count = at[gram + 1] - at[gram]
        out = np.zeros(n_rows * len(self.sizes), np.int64)
        ends = np.cumsum(count)
        step = 0
        while step < len(gram):  # about two million entries at a time
            last = max(step + 1, int(np.searchsorted(ends, (ends[step - 1] if step else 0) + (1 << 21), "right")))
            c = count[step:last]
            begin = np.cumsum(c) - c
            entry = np.arange(c.sum()) + np.repeat(at[gram[step:last]] - begin, c)
            out += np.bincount(np.repeat(row[step:last], c) * len(self.sizes) + members[entry], minlength=len(out))
            step = last
        return out.reshape(n_rows, len(self.sizes))


@cache
def _in_words() -> np.ndarray:
    """Which code points are letters or numbers, the characters of words."""
    return np.array([unicodedata.category(chr(c))[0] in "LN" for c in range(sys.maxunicode + 1)])


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of each distinct trigram of some lower-cased texts, in order: as functions.text.trigrams cuts them, 21 bits for each character."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n_chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), n_chars)
    inside = _in_words()[chars]
    joined = inside[1:] & inside[:-1] & (row[1:] == row[:-1])
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~joined
    last[:-1] &= ~joined
    # two blanks before each word, one after it
    width = inside + 2 * first + last
    at = np.cumsum(width) - width + 2 * first
    padded, own = np.full(width.sum(), 32, np.int64), np.repeat(row, width)
    padded[at[inside]] = chars[inside]
    # a trigram starts at each place of a padded word but its last two
    starts = np.ones(len(padded), bool)
    ends = (at + 1)[last]  # the blanks after words
    starts[ends] = starts[ends - 1] = False
    begin = np.flatnonzero(starts)
    number = (padded[begin] << 42) | (padded[begin + 1] << 21) | padded[begin + 2] if len(begin) else np.zeros(0, np.int64)
    order = np.lexsort((number, own[begin]))
    number, own = number[order], own[begin][order]
    new = np.ones(len(number), bool)
    new[1:] = (number[1:] != number[:-1]) | (own[1:] != own[:-1])
    return own[new], number[new]


def with_grams(df: DataFrame, text: str) -> DataFrame:
    """df with the column text replaced by grams: its distinct trigrams as sorted numbers; rows without any are left out."""
    others = [c for c in df.columns if c != text]
    schema = T.StructType([*(df.schema[c] for c in others), T.StructField("grams", T.ArrayType(T.LongType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                some = batch.slice(a, 500)
                row, number = _grams(some.column(len(others)))
                count = np.bincount(row, minlength=some.num_rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(number))
                full = pa.RecordBatch.from_arrays([*some.columns[:-1], lists], schema.names)
                yield full.filter(pa.array(count > 0))

    return df.select(*others, F.lower(F.col(text)).alias(text)).mapInArrow(work, schema)


def trigram_topk(queries: DataFrame, chunks: DataFrame, *, k: int, least: float = 0.1, block: int = 500) -> DataFrame:
    """(query_id, chunk_id, similarity): the k chunks (chunk_id, content) of the most similar trigrams for each of queries (query_id, text), over `least`.

    If both have a repo_id, only those of one repository meet. A similarity join by inverted lists of the queries' trigrams, without a shuffle of the
    chunks: chunks of a size that rules out the similarity are left out, as are those without one of a query's rarer trigrams; the frequent trigrams
    are counted for the others only. Each task keeps its k best, and what can't reach the k-th of them is left out.
    Queries are broadcast in blocks of about `block`; each block reads the chunks' trigrams, cut once, again.
    """
    same_repo = "repo_id" in queries.columns and "repo_id" in chunks.columns
    repo = F.col("repo_id").cast("string") if same_repo else F.lit(None).cast("string")
    asked = settled(with_grams(queries.select("query_id", repo.alias("repo_id"), "text"), "text"))
    blocks = -(-asked.count() // block)
    cut = settled(with_grams(chunks.select("chunk_id", repo.alias("repo_id"), "content"), "content"))
    kind = chunks.schema["chunk_id"].dataType
    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("chunk_id", kind), T.StructField("similarity", T.DoubleType())])
    out = None
    for i in range(max(1, blocks)):
        # about `block` rows; a query's trigrams are bounded by its text
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks))) == i)
        rows = own.collect()
        grams = own.select(F.explode("grams").alias("g")).distinct()
        counted = cut.select(F.explode("grams").alias("g")).join(F.broadcast(grams), "g").groupBy("g").count().collect() if rows else []
        shared = chunks.sparkSession.sparkContext.broadcast(_Asked(rows, {r.g: r["count"] for r in counted}, least))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            n_q = len(asked.sizes)
            kth = np.zeros(n_q)
            best: pa.Table | None = None
            for batch in batches:
                size = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                step = max(1, (1 << 20) // max(n_q, 1))
                for a in range(0, batch.num_rows, step):
                    some = batch.slice(a, step)
                    n_c = size[a : a + step, None]
                    value, row = some.column(2).flatten().to_numpy(), np.repeat(np.arange(len(n_c)), n_c[:, 0])
                    place = np.minimum(np.searchsorted(asked.vocabulary, value), max(len(asked.vocabulary) - 1, 0))
                    known = asked.vocabulary[place] == value if n_q else np.zeros(len(value), bool)
                    row, gram = row[known], place[known]
                    near = np.minimum(asked.sizes, n_c) > np.maximum(least, kth - 1e-9) * np.maximum(asked.sizes, n_c)
                    if same_repo:
                        near &= np.array([x or "" for x in some.column(1).to_pylist()])[:, None] == asked.repos
                    common = asked.shared(row, gram, len(n_c), asked.rare)
                    most = np.minimum(common + asked.n_common, np.minimum(asked.sizes, n_c))
                    bound = most / (asked.sizes + n_c - most)
                    near &= (common > 0) & (bound > least) & (bound >= kth - 1e-9)
                    left = near.any(axis=1)
                    on = left[row]
                    common += asked.shared(row[on], gram[on], len(n_c), asked.common)
                    similarity = common / np.maximum(asked.sizes + n_c - common, 1)
                    y, q = np.nonzero(near & (similarity > least) & (similarity >= kth - 1e-9))
                    if not len(y):
                        continue
                    columns = [pa.array(q, pa.int32()), some.column(0).take(pa.array(y)), pa.array(similarity[y, q])]
                    found = pa.Table.from_arrays(columns, ["q", "chunk_id", "similarity"])
                    both = found if best is None else pa.concat_tables([best, found])
                    both = both.take(pc.sort_indices(both, [("q", "ascending"), ("similarity", "descending"), ("chunk_id", "ascending")]))
                    of = both.column(0).to_numpy()
                    n = np.arange(len(of)) - np.searchsorted(of, of)
                    best = both.filter(pa.array(n < k))
                    last = n == k - 1
                    kth[of[last]] = both.column(2).to_numpy()[last]
            if best is not None:
                yield from best.combine_chunks().to_batches()

        found = cut.mapInArrow(work, schema)
        names = own.sparkSession.createDataFrame([(n, r.query_id) for n, r in enumerate(rows)], T.StructType([T.StructField("q", T.IntegerType()), asked.schema["query_id"]]))
        found = found.join(F.broadcast(names), "q").select("query_id", "chunk_id", "similarity")
        out = found if out is None else out.unionByName(settled(found))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    return out.withColumn("n_", F.row_number().over(order)).where(F.col("n_") <= k).drop("n_")


def lexical_with_fallback(queries: DataFrame, chunks: DataFrame, *, k: int = 20, least: float = 0.1, share: float = 0.5) -> DataFrame:
    """(query_id, chunk_id, score, rank): lexical_topk, and for queries short of k the chunks of the most similar trigrams, at `share` of that score."""
    exact = settled(lexical_topk(queries, chunks, k=k).select("query_id", "chunk_id", "score", "rank"))
    counts = exact.groupBy("query_id").agg(F.count("*").alias("n"))
    short = settled(queries.join(counts, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < k))
    near = trigram_topk(short, chunks, k=k, least=least).join(exact, ["query_id", "chunk_id"], "left_anti").join(short.select("query_id", "n"), "query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    near = near.withColumn("rank", F.row_number().over(order) + F.col("n").cast("int")).where(F.col("rank") <= k)
    return exact.unionByName(near.select("query_id", "chunk_id", F.round(F.col("similarity") * share, 6).alias("score"), "rank"))
