"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each text becomes a few statistics (shares of kinds of characters, word lengths, repetition); random
cosine features of these approximate a Gaussian kernel. Each partition of labelled rows sums its part of
the normal equations, the sums are added up by row of the matrix, and the driver solves one system of `features` + 1
unknowns. Raw scores of the labelled rows are counted in bins, and a rising curve fitted to the bins
turns them into probabilities. What the driver sees has a fixed size; all labelled training rows are used.

Defined results: null and empty texts have statistics 0 and get a score like others; labels other than 0 and 1
and nulls are ignored; several labels of one doc_id are averaged; without any labels every score is 0.5; repeated rows get equal scores;
an empty table gives no rows. Columns other than doc_id and text are kept by score_documents, whatever their names, and never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import free_name, held_out, kept_table, map_rows, table, tidied, with_field
from .calibration import calibrate, fit_isotonic
from .words import runs, sequence_hashes, shingle_sets, text_bytes, word_hashes

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:?'\"-()",
    "shout": b"!",
    "bar": b"|",
    "symbol": b"#$%&*@^~<>{}[]\\/=+_`",
    "blank": b" \t\r\x0b\x0c",
    "line": b"\n",
}
_KIND_OF = np.zeros(256, np.uint8)
for _k, _chars in enumerate(_KINDS.values(), 1):
    _KIND_OF[list(_chars)] = _k
_KIND_OF[128:] = len(_KINDS) + 1
STATISTICS = len(_KINDS) + 8


def _sums(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _longest_run(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How often the most frequent value of each text's sorted values occurs."""
    if not len(hashes):
        return np.zeros(len(begin) - 1)
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[begin[:-1][begin[:-1] < len(hashes)]] = True
    starts = np.flatnonzero(new)
    length = np.diff(np.append(starts, len(hashes)))
    owner = np.searchsorted(begin, starts, "right") - 1
    out = np.zeros(len(begin) - 1)
    np.maximum.at(out, owner, length)
    return out


def text_statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS numbers for each text."""
    raw_all, at_all = text_bytes(column)
    out = np.zeros((len(at_all) - 1, STATISTICS))
    for first, last in runs(at_all):
        raw, at = raw_all[at_all[first] : at_all[last]], at_all[first : last + 1] - at_all[first]
        size = np.diff(at)
        n = np.maximum(size, 1)
        kinds = _KIND_OF[raw]
        part = out[first:last]
        for k in range(1, len(_KINDS) + 1):
            part[:, k - 1] = np.sqrt(_sums(kinds == k, at) / n)
        words, begin = word_hashes(raw, at)
        n_words = np.diff(begin)
        w = np.maximum(n_words, 1)
        same = np.zeros(len(words), bool)
        same[1:] = words[1:] == words[:-1]
        same[begin[:-1][begin[:-1] < len(words)]] = False
        double = np.zeros(len(raw), bool)
        double[1:] = (raw[1:] == raw[:-1]) & (kinds[1:] != 2) & (kinds[1:] <= len(_KINDS)) & (kinds[1:] != 8)
        pairs, pairs_at = sequence_hashes(words, begin, 2)
        del pairs
        _, singles = shingle_sets(words, begin, 1)
        _, couples = shingle_sets(words, begin, 2)
        by_value = words.copy()
        for i in range(len(begin) - 1):
            by_value[begin[i] : begin[i + 1]].sort()
        extra = len(_KINDS)
        part[:, extra] = np.log1p(size) / 4
        part[:, extra + 1] = np.log1p(size / w)
        part[:, extra + 2] = np.sqrt(_sums(same, begin) / w)
        part[:, extra + 3] = np.diff(singles) / w**0.8
        part[:, extra + 4] = np.diff(couples) / np.maximum(np.diff(pairs_at), 1)
        part[:, extra + 5] = np.sqrt(_longest_run(by_value, begin) / w)
        part[:, extra + 6] = np.sqrt(_sums(double, at) / n)
        part[:, extra + 7] = np.log1p(n_words / np.maximum(_sums(kinds == 9, at) + 1, 1)) / 4
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats): the statistics of each row's text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = text_statistics(batch.column(1))
            rows = pa.ListArray.from_arrays(np.arange(len(stats) + 1, dtype=np.int32) * STATISTICS, pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["doc_id", "stats"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(work), "doc_id long, stats array<double>")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, STATISTICS))


@dataclass(frozen=True)
class QualityModel:
    """Everything a score needs; its size depends on the number of features alone."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.hstack([waves, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return calibrate(self.raw(stats), self.knots)


def _mapped(df: DataFrame, make: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield make(rows)

    return df.mapInPandas(work, schema)


def fit_quality(
    stats: DataFrame, labels: DataFrame, *, features: int = 256, ridge: float = 1e-4, width: float = 1.0, seed: int = 7
) -> QualityModel:
    """The model for stats (doc_id, stats) and labels (doc_id, label)."""
    label = labels.where(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.avg("label").cast("double").alias("label"))
    rows = kept_table(stats.join(label, "doc_id").select("stats", "label"))
    each = [F.col("stats")[i] for i in range(STATISTICS)]
    sums = rows.agg(F.count("*"), *(F.avg(c) for c in each), *(F.stddev_pop(c) for c in each)).first()
    n = sums[0]
    rng = np.random.default_rng(seed)
    directions = rng.normal(0, 1 / (width * np.sqrt(STATISTICS)), (STATISTICS, features))
    phases = rng.uniform(0, 2 * np.pi, features)
    if not n:
        flat = (np.array([0.0]), np.array([0.5]))
        return QualityModel(np.zeros(STATISTICS), np.ones(STATISTICS), directions, phases, np.zeros(features + 1), flat)
    mean, spread = np.array(sums[1 : 1 + STATISTICS]), np.array(sums[1 + STATISTICS :])
    start = QualityModel(mean, np.maximum(spread, 1e-3), directions, phases, np.zeros(features + 1), (mean, mean))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((features + 1, features + 2))
        for some in batches:
            z = start.features(_matrix(some["stats"]))
            total[:, :-1] += z.T @ z
            total[:, -1] += z.T @ some["label"].to_numpy(float)
        if total.any():
            some_parts = TaskContext.get().partitionId() // 512
            yield pd.DataFrame({"row": range(features + 1), "some": some_parts, "sums": list(total)})

    def add(some: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": some["row"].iloc[:1], "some": some["some"].iloc[:1], "sums": [np.sum(np.stack(some["sums"].to_numpy()), axis=0)]})

    schema = "row int, some int, sums array<double>"
    # sums of up to 512 partitions first, then of these; features + 1 rows of features + 2 numbers come to the driver
    parts = rows.mapInPandas(partial, schema).groupBy("row", "some").applyInPandas(add, schema)
    parts = parts.groupBy("row").applyInPandas(add, schema).orderBy("row").collect()
    system = np.array([r.sums for r in parts])
    weights = np.linalg.solve(system[:, :-1] + ridge * n * np.eye(features + 1), system[:, -1])
    fitted = QualityModel(start.mean, start.scale, directions, phases, weights, start.knots)

    def binned(some: pd.DataFrame) -> pd.DataFrame:
        raw = fitted.raw(_matrix(some["stats"]))
        bins = np.clip(np.floor(raw * 200), -400, 600).astype(int)
        return pd.DataFrame({"bin": bins, "raw": raw, "label": some["label"]}).groupby("bin", as_index=False).agg(
            raw=("raw", "sum"), label=("label", "sum"), n=("label", "size")
        )

    counted = _mapped(rows, binned, "bin int, raw double, label double, n long")
    # a row for each of 1001 bins at most
    curve = counted.groupBy("bin").agg(F.sum("raw"), F.sum("label"), F.sum("n")).collect()
    count = np.array([float(r[3]) for r in curve])
    knots = fit_isotonic(np.array([r[1] for r in curve]) / count, np.array([r[2] for r in curve]) / count, count)
    return QualityModel(start.mean, start.scale, directions, phases, weights, knots)


def quality_scores(stats: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) for stats (doc_id, stats)."""

    def make(some: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": some["doc_id"], "score": model.score(_matrix(some["stats"]))})

    return _mapped(stats, make, "doc_id long, score double")


def score_documents(docs: DataFrame, model: QualityModel, column: str = "score") -> DataFrame:
    """docs with the score of each row's text as last column, in one pass and without a shuffle; called score_1 and so on if docs has one."""
    names, at, column = docs.columns, docs.columns.index("text"), free_name(docs.columns, column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(text_statistics(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*names, column])

    return map_rows(docs, work, with_field(docs.schema, column, "double"))


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of rows that may be learnt from: crc32 of doc_id as text, mod 5, is not 0."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("label"))
    return rows.where(~held_out(F.col("doc_id"), 0))


def op3_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stats = kept_table(with_statistics(docs))
    model = fit_quality(stats, training_labels(labels, "quality"))
    scored = quality_scores(stats, model)
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
