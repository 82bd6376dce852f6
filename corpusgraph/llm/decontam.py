"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment of words scores them.

Words are runs of letters, digits and bytes over 127, A-Z lower-cased, so that edits of case and punctuation don't count.
A test item's seeds are its n-word sequences whose chance to stand at a place of the corpus, as the product of
their words' shares, is small; this measure, unlike their own count, is not raised by the copies that are looked for. An item
without such seeds keeps all its sequences. Wherever a document has a seed, the passage around it that
the item could cover is aligned with the whole item (match +2, mismatch and gap -1; local), and the best score over
2 * words of the item is the pair's score.

The items are taken in blocks of `block_words` words, each of which is broadcast: a block's size is fixed, and a larger
benchmark means more passes over the documents, not larger ones. Documents are never shuffled, so
a passage that many documents hold is no hot key, and a document's work is bounded by its own hits.

Defined results: documents and items without words, and nulls, are in no pair; items of fewer than n words have their
whole sequence as seed; repeated documents and repeated items each give their own rows; rows with a null doc_id give rows with
a null doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import map_rows, table, tidied
from .words import LOOSE, runs, sequence_hashes, text_bytes, word_hashes

MATCH, MISMATCH, GAP = 2, -1, -1


def align(items: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each row of word hashes with its passage, and where in the passage it ends.

    Rows are padded: items with 0, passages with 1, which never match.
    """
    n, width = passages.shape
    row = np.zeros((n, width + 1), np.int32)
    steps = np.arange(width + 1, dtype=np.int32) * GAP
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(items.shape[1]):
        here = np.zeros((n, width + 1), np.int32)
        score = np.where(passages == items[:, i : i + 1], MATCH, MISMATCH)
        here[:, 1:] = np.maximum(np.maximum(row[:, :-1] + score, row[:, 1:] + GAP), 0)
        here = np.maximum.accumulate(here - steps, axis=1) + steps
        top = here.argmax(axis=1)
        value = here[np.arange(n), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
        row = here
    return best, end


@dataclass(frozen=True)
class Items:
    """A block of test items: word hashes one after another, and the seeds that lead to them."""

    ids: list
    words: np.ndarray
    begin: np.ndarray
    sizes: np.ndarray  # distinct seed lengths
    seeds: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # for each length: sorted hashes, item, place


def _hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(*text_bytes(pa.array(texts, pa.string())), LOOSE)


def word_shares(docs: DataFrame, words: np.ndarray) -> tuple[dict[int, int], int]:
    """How often each of the words stands in the documents, and how many words there are in all."""
    wanted = np.unique(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = np.zeros(len(wanted) + 1, np.int64), 0
        for batch in batches:
            raw, at = text_bytes(batch.column(0))
            for i, j in runs(at):
                own, _ = word_hashes(raw[at[i] : at[j]], at[i : j + 1] - at[i], LOOSE)
                total += len(own)
                if len(wanted):
                    place = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                    found += np.bincount(place[wanted[place] == own], minlength=len(wanted) + 1)
        found[-1] = total
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(found[some], pa.int64())], ["i", "n"])

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidied(count), "i int, n long").groupBy("i").agg(F.sum("n"))
    rows = {r[0]: r[1] for r in counts.collect()}  # a row for each distinct word of a block of items at most
    return {int(w): rows.get(i, 0) for i, w in enumerate(wanted)}, rows.get(len(wanted), 0)


def choose_seeds(ids: list, texts: list[str | None], counts: dict[int, int], total: int, n: int, chance: float) -> Items:
    words, begin = _hashes(texts)
    share = np.array([max(counts.get(int(w), 0), 0.5) / max(total, 1) for w in words])
    by_size: dict[int, list[tuple[int, int, int]]] = {}
    for k in range(len(ids)):
        own, odds = words[begin[k] : begin[k + 1]], share[begin[k] : begin[k + 1]]
        size = min(n, len(own))
        if not size:
            continue
        hashes, _ = sequence_hashes(own, np.array([0, len(own)]), size)
        rare = np.array([odds[i : i + size].prod() for i in range(len(hashes))]) <= chance
        for i in np.flatnonzero(rare if rare.any() else ~rare).tolist():
            by_size.setdefault(size, []).append((int(hashes[i]), k, i))
    seeds = []
    for size in sorted(by_size):
        order = sorted(by_size[size])
        seeds.append((np.array([x[0] for x in order], np.uint64), np.array([x[1] for x in order]), np.array([x[2] for x in order])))
    return Items(ids, words, begin, np.array(sorted(by_size)), seeds)


def _passages(items: Items, words: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Rows (text, item, first word, end word) of the passages that hold seeds, merged where they overlap."""
    found = []
    for size, (hashes, item, place) in zip(items.sizes.tolist(), items.seeds, strict=True):
        own, at = sequence_hashes(words, begin, size)
        low = np.searchsorted(hashes, own, "left")
        hit = np.flatnonzero((low < len(hashes)) & (hashes[np.minimum(low, len(hashes) - 1)] == own))
        if not len(hit):
            continue
        many = np.searchsorted(hashes, own[hit], "right") - low[hit]
        seed = np.repeat(low[hit] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        spot = np.repeat(hit, many)
        text = np.searchsorted(at, spot, "right") - 1
        word = spot - at[text] + begin[text]
        k, i = item[seed], place[seed]
        length = items.begin[k + 1] - items.begin[k]
        slack = length // 4 + 2
        found.append(
            np.stack([text, k, np.maximum(word - i - slack, begin[text]), np.minimum(word - i + length + slack, begin[text + 1])], 1)
        )
    if not found:
        return np.zeros((0, 4), np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    same = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1])
    # within a text and an item ends rise with starts, but for the text's own end
    new[1:] = ~(same & (rows[1:, 2] <= rows[:-1, 3]))
    starts = np.flatnonzero(new)
    ends = np.maximum.reduceat(rows[:, 3], starts)
    return np.column_stack([rows[starts, :3], ends])


def _scored(items: Items, words: np.ndarray, passages: np.ndarray, cells: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Score of each passage with its item, and the word where the alignment ends; long passages in overlapping pieces."""
    score, end = np.zeros(len(passages)), np.zeros(len(passages), np.int64)
    m = items.begin[passages[:, 1] + 1] - items.begin[passages[:, 1]]
    piece: list[tuple[int, int, int]] = []
    for p, (_, _, a, b) in enumerate(passages.tolist()):
        step = 4 * int(m[p])
        for x in range(a, b, step):  # an alignment spans under 3 * m words: each lies in a piece whole
            piece.append((p, x, min(b, x + step + 3 * int(m[p]))))
            if piece[-1][2] == b:
                break
    piece.sort(key=lambda x: (m[x[0]], x[2] - x[1]))
    first = 0
    while first < len(piece):
        last, width = first, 0
        while last < len(piece) and last - first < 4096:
            width = max(width, piece[last][2] - piece[last][1])
            if last > first and width * (last - first + 1) > cells:
                break
            last += 1
        some = piece[first:last]
        width, height = max(b - a for _, a, b in some), max(int(m[p]) for p, _, _ in some)
        item, passage = np.zeros((len(some), height), np.uint64), np.ones((len(some), width), np.uint64)
        for r, (p, a, b) in enumerate(some):
            k = passages[p, 1]
            item[r, : m[p]] = items.words[items.begin[k] : items.begin[k + 1]]
            passage[r, : b - a] = words[a:b]
        best, where = align(item, passage)
        for r, (p, a, _) in enumerate(some):
            value = best[r] / (MATCH * m[p])
            if value > score[p]:
                score[p], end[p] = value, a + where[r]
        first = last
    return score, end


def _hits(items: Items, column: pa.Array, threshold: float) -> dict[tuple[int, int], tuple[float, int]]:
    """For each text and item of the block with a score of at least threshold: the score, and the passage's last word."""
    raw, at = text_bytes(column)
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for i, j in runs(at):
        words, begin = word_hashes(raw[at[i] : at[j]], at[i : j + 1] - at[i], LOOSE)
        passages = _passages(items, words, begin)
        if not len(passages):
            continue
        score, end = _scored(items, words, passages)
        for (text, k, _, _), s, e in zip(passages.tolist(), score.tolist(), end.tolist(), strict=True):
            if s >= threshold and s > best.get((i + text, k), (0.0, 0))[0]:
                best[i + text, k] = (s, e - int(begin[text]) - 1)
    return best


def item_blocks(docs: DataFrame, benchmark: DataFrame, n: int, chance: float, block_words: int) -> Iterator[Items]:
    """The benchmark in blocks of about block_words words, with seeds chosen by the documents' word shares."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    ids: list = []
    texts: list = []
    size = 0
    for row in (*rows.toLocalIterator(), None):  # a partition at a time; a block is all that is held
        if row is not None:
            ids.append(row.item_id)
            texts.append(row.text)
            size += len((row.text or "").split())
        if ids and (row is None or size >= block_words):
            counts, total = word_shares(docs, _hashes(texts)[0])
            yield choose_seeds(ids, texts, counts, total, n, chance)
            ids, texts, size = [], [], 0


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, n: int = 3, chance: float = 1e-7, threshold: float = 0.5, block_words: int = 500_000
) -> DataFrame:
    """(doc_id, item_id, score, end_word): pairs whose alignment scores at least threshold; end_word is the passage's last word."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, score double, end_word long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for block in item_blocks(docs, benchmark, n, chance, block_words):
        shared = spark.sparkContext.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best = _hits(shared.value, batch.column(1), threshold)
                keys = list(best)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([t for t, _ in keys], pa.int64())),
                        pa.array([shared.value.ids[k] for _, k in keys], pa.int64()),
                        pa.array([best[x][0] for x in keys], pa.float64()),
                        pa.array([best[x][1] for x in keys], pa.int64()),
                    ],
                    ["doc_id", "item_id", "score", "end_word"],
                )

        out = out.unionByName(rows.mapInArrow(tidied(work), schema))
    return out


def clean_documents(
    docs: DataFrame, benchmark: DataFrame, *, n: int = 3, chance: float = 1e-7, threshold: float = 0.5, block_words: int = 500_000
) -> DataFrame:
    """The rows of docs whose text is in no pair of `contaminated`, with all their columns; found without a shuffle."""
    out, at = docs, docs.columns.index("text")
    for block in item_blocks(docs, benchmark, n, chance, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(len(batch), bool)
                clean[[text for text, _ in _hits(shared.value, batch.column(at), threshold)]] = False
                yield batch.filter(pa.array(clean))

        out = map_rows(out, work, docs.schema)
    return out


def op10_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
