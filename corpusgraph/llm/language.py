"""Language of texts by a sparse multinomial logistic regression on TF-IDF of character n-grams.

A text is lower-cased, what is no letter becomes a blank, and its n-grams of one to `longest` characters that don't reach over a blank (but may hold the
one before or after a word) are hashed into 2 ** `bits` buckets. A bucket's value is (1 + ln tf) * idf, the text's values have length 1. Document
frequencies are counted over all documents that may be learnt from.

Weights are trained with follow-the-regularised-leader: each step sums gradients and their squares, Spark adds them up, and the weights are solved anew from
all sums so far, with an L1 penalty, which leaves most at 0, and an L2 penalty. A step's rows are one of `slices` parts of the training sample; they are
read from a table of their features, and the sums are the same however the rows are partitioned, but for rounding. What comes to the driver at each step
is one row for each bucket and language that the slice touched. The sample is bounded by `sample_rows` for each language, taken by hash, so that one
language may have a third of all rows. A part of it, held apart, gives the temperature that divides the logits.

Rows: a null text, or one without a letter (str.isalpha), has language `und` and score 0, as have all texts if nothing could be learnt. Empty texts are
without a letter. Long texts count whole. Repeated rows get the same result each. Of languages whose scores tie the first by name is taken. A null lang is
not learnt from. If only one language was learnt, it has score 1. Rows with a null doc_id are scored, and held out as the text '' would be. Columns other
than the named ones are not read, whatever they are called.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import kept_table, table, tidied
from .words import mix, runs, text_bytes


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def gram_counts(texts: pa.Array, bits: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For non-null texts: row, bucket and count of each text's distinct buckets, in order of rows, and whether each text has a letter."""
    lower = pc.utf8_lower(texts)
    n_chars = pc.utf8_length(lower).to_numpy(zero_copy_only=False).astype(np.int64)
    raw, _ = text_bytes(lower)
    chars = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), n_chars)
    inside = _letters()[chars]
    has_letter = np.bincount(row[inside], minlength=len(texts)) > 0
    # one blank between words and around each text; runs of other characters become one
    gap = ~inside
    keep = inside.copy()
    keep[1:] |= gap[1:] & inside[:-1]
    starts = np.concatenate([[0], np.cumsum(n_chars)])[:-1][n_chars > 0]
    keep[starts] |= gap[starts]
    code, row = np.where(inside, chars, 32)[keep].astype(np.uint64), row[keep]
    keys, hashed = [], np.zeros(len(code), np.uint64)
    for size in range(1, longest + 1):
        # hashed[i]: of the size characters from i on
        n = len(code) - size + 1
        if n <= 0:
            break
        hashed = hashed[:n] * np.uint64(0x100000001B3) + code[size - 1 :]
        ok = row[:n] == row[size - 1 :]
        for inner in range(1, size - 1):
            ok &= code[inner : n + inner] != 32
        if size == 1:
            ok &= code != 32
        bucket = mix(hashed[ok] + np.uint64(size)) >> np.uint64(64 - bits)
        keys.append((row[:n][ok].astype(np.uint64) << np.uint64(bits)) | bucket)
    all_keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]])) if len(all_keys) else np.zeros(0, np.int64)
    distinct = all_keys[first]
    count = np.diff(first, append=len(all_keys))
    return (distinct >> np.uint64(bits)).astype(np.int64), (distinct & np.uint64((1 << bits) - 1)).astype(np.int64), count, has_letter


def _runs_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.Array]]:
    """The texts of a batch, null as empty, in runs of bounded size, each with its first row."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    at = text_bytes(texts)[1]
    for a, b in runs(at):
        yield a, texts.slice(a, b - a)


def document_frequencies(texts: DataFrame, bits: int, longest: int) -> tuple[int, np.ndarray]:
    """Number of texts with a letter, and how many have each bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for _, some in _runs_of(batch, 0):
                _, bucket, _, has_letter = gram_counts(some, bits, longest)
                df += np.bincount(bucket, minlength=1 << bits)
                n += int(has_letter.sum())
        full = np.flatnonzero(df)
        columns = [pa.array(np.append(full, -1), pa.int32()), pa.array(np.append(df[full], n), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "df"])

    found = texts.select("text").mapInArrow(tidied(work), "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    df, n = np.zeros(1 << bits), 0  # 2 ** bits + 1 rows at most
    for r in found:
        if r.bucket < 0:
            n = r.df
        else:
            df[r.bucket] = r.df
    return n, df


def _values(row: np.ndarray, bucket: np.ndarray, count: np.ndarray, idf: np.ndarray, n_rows: int) -> np.ndarray:
    value = (1 + np.log(count)) * idf[bucket]
    length = np.sqrt(np.bincount(row, value * value, n_rows))
    return value / np.maximum(length, 1e-12)[row]


def _logits(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, weights: np.ndarray, bias: np.ndarray, n_rows: int) -> np.ndarray:
    active = np.abs(weights).sum(axis=1) > 0
    on = active[bucket]
    row, bucket, value = row[on], bucket[on], value[on]
    out = np.empty((n_rows, weights.shape[1]))
    for c in range(weights.shape[1]):
        out[:, c] = np.bincount(row, value * weights[bucket, c], n_rows) + bias[c]
    return out


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class LanguageModel:
    """Everything a prediction needs; its size depends on the buckets and languages alone."""

    languages: list[str]
    bits: int
    longest: int
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each of some non-null texts."""
        n = len(texts)
        if not self.languages:
            return ["und"] * n, np.zeros(n)
        row, bucket, count, has_letter = gram_counts(texts, self.bits, self.longest)
        value = _values(row, bucket, count, self.idf, n)
        p = _softmax(_logits(row, bucket, value, self.weights, self.bias, n) / self.temperature)
        best = p.argmax(axis=1)
        found = [self.languages[c] if letter else "und" for c, letter in zip(best.tolist(), has_letter.tolist(), strict=True)]
        return found, np.where(has_letter, p[np.arange(n), best], 0.0)


class Leader:
    """Follow the regularised leader: sums of gradients less those of the weights' pull, and sums of squares, for each weight."""

    def __init__(self, shape: tuple[int, ...], *, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(shape), np.zeros(shape)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self) -> np.ndarray:
        pull = (self.beta + np.sqrt(self.n)) / self.alpha + self.l2
        return np.where(np.abs(self.z) <= self.l1, 0.0, -(self.z - np.sign(self.z) * self.l1) / pull)

    def add(self, at: tuple, gradient: np.ndarray, square: np.ndarray) -> None:
        """Take in a step's gradient and the sum of its rows' squared gradients at some weights."""
        before = self.weights()[at]
        step = (np.sqrt(self.n[at] + square) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += gradient - step * before
        self.n[at] += square


def _features(sample: DataFrame, languages: list[str], bits: int, longest: int, idf: np.ndarray) -> DataFrame:
    """(slice, label, buckets, values) for a sample (slice, lang, text)."""
    number = {name: i for i, name in enumerate(languages)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in _runs_of(batch, 2):
                row, bucket, count, _ = gram_counts(texts, bits, longest)
                value = _values(row, bucket, count, idf, len(texts))
                at = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32))
                labels = pa.array([number[x] for x in batch.column(1).slice(a, len(texts)).to_pylist()], pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (bucket.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), labels, *lists], ["slice", "label", "buckets", "values"])

    schema = "slice int, label int, buckets array<int>, values array<float>"
    return sample.select("slice", "lang", "text").mapInArrow(tidied(work), schema)


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Label of each row of features; row, bucket and value of each entry."""
    count = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
    bucket, value = batch.column(2).flatten().to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy().astype(float)
    return batch.column(1).to_numpy(), np.repeat(np.arange(len(count)), count), bucket, value


def _gradient(features: DataFrame, weights: np.ndarray, bias: np.ndarray) -> list:
    """Rows (bucket, gradients, squares) with a number for each language, over all features; the bias is the bucket after the last."""
    n_buckets, n_languages = weights.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, square = np.zeros((n_buckets + 1, n_languages)), np.zeros((n_buckets + 1, n_languages))
        for batch in batches:
            label, row, bucket, value = _rows(batch)
            error = _softmax(_logits(row, bucket, value, weights, bias, len(label)))
            error[np.arange(len(label)), label] -= 1
            for c in range(n_languages):
                each = error[row, c] * value
                gradient[:-1, c] += np.bincount(bucket, each, n_buckets)
                square[:-1, c] += np.bincount(bucket, each * each, n_buckets)
            gradient[-1] += error.sum(axis=0)
            square[-1] += (error * error).sum(axis=0)
        full = np.flatnonzero(square.any(axis=1))
        columns = [pa.array(full, pa.int32()), pa.array(list(gradient[full]), pa.list_(pa.float64())), pa.array(list(square[full]), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "gradients", "squares"])

    parts = features.mapInArrow(tidied(work), "bucket int, gradients array<double>, squares array<double>")
    add = [F.array(*(F.sum(F.col(name)[c]) for c in range(n_languages))).alias(name) for name in ("gradients", "squares")]
    return parts.groupBy("bucket").agg(*add).collect()


def _losses(features: DataFrame, weights: np.ndarray, bias: np.ndarray, temperatures: np.ndarray) -> np.ndarray:
    """The log loss of all features at each temperature."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(temperatures))
        for batch in batches:
            label, row, bucket, value = _rows(batch)
            logits = _logits(row, bucket, value, weights, bias, len(label))
            for i, t in enumerate(temperatures):
                total[i] -= np.log(np.maximum(_softmax(logits / t)[np.arange(len(label)), label], 1e-300)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["i", "loss"])

    found = features.mapInArrow(tidied(work), "i int, loss double").groupBy("i").agg(F.sum("loss").alias("loss")).orderBy("i").collect()
    return np.array([r.loss for r in found]) if found else np.zeros(len(temperatures))


def fit_languages(
    rows: DataFrame, *, bits: int = 15, longest: int = 3, sample_rows: int = 6000, slices: int = 6, epochs: int = 3,
    alpha: float = 1.0, beta: float = 1.0, l1: float = 0.5, l2: float = 1e-3,
) -> LanguageModel:
    """The model of rows (doc_id, text, lang). About `sample_rows` texts of each language are trained on, all if there are no more."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # a row for each language, and 2 ** bits rows of frequencies
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    n, df = document_frequencies(rows, bits, longest)
    idf = np.log((n + 1) / (df + 1)) + 1
    if len(languages) < 2:
        return LanguageModel(languages, bits, longest, idf, np.zeros((1 << bits, len(languages))), np.zeros(len(languages)))
    share = F.create_map(*(F.lit(x) for name in languages for x in (name, sample_rows / sizes[name])))
    place = (F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 40) - 1))) / F.lit(float(1 << 40))
    # every eighth row of the sample gives the temperature, the others are dealt to the slices
    dealt = F.pmod(F.xxhash64("text", F.lit(1)), F.lit(8 * slices)).cast("int")
    sample = rows.where(place < share[F.col("lang")]).withColumn("slice", F.when(dealt % 8 == 0, -1).otherwise((dealt / 8).cast("int")))
    features = kept_table(_features(sample, languages, bits, longest, idf))
    kind = {"alpha": alpha, "beta": beta, "l1": l1, "l2": l2}
    leader, biases = Leader((1 << bits, len(languages)), **kind), Leader((len(languages),), **(kind | {"l1": 0.0}))
    for step in range(slices * epochs):
        for r in (found := _gradient(features.where(F.col("slice") == step % slices), leader.weights(), biases.weights())):
            if r.bucket == 1 << bits:
                biases.add((slice(None),), np.array(r.gradients), np.array(r.squares))
        some = [r for r in found if r.bucket < 1 << bits]
        if some:
            leader.add((np.array([r.bucket for r in some]),), np.array([r.gradients for r in some]), np.array([r.squares for r in some]))
    weights, bias = leader.weights(), biases.weights()
    temperatures = np.exp(np.linspace(np.log(0.02), np.log(20), 81))
    losses = _losses(features.where(F.col("slice") == -1), weights, bias, temperatures)
    temperature = float(temperatures[losses.argmin()]) if losses.any() else 1.0
    return LanguageModel(languages, bits, longest, idf, weights, bias, temperature)


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) for docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in _runs_of(batch, 1):
                found, score = shared.value.predict(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), pa.array(found, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(work), "doc_id long, lang_pred string, score double")


def held_out_quarter(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text, mod 4, is 2. A null doc_id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op11_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(~held_out_quarter(F.col("doc_id"))).select("doc_id", "text", F.col("lang").cast("string").alias("lang")))
    out = predict_languages(docs, model)
    return out.select("doc_id", held_out_quarter(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
