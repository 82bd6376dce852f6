"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, compared window by window.

Two dictionaries are trained: one on windows of ordinary text, one on the words that are common in
toxic texts and rare in ordinary ones; where no word is so, on windows of the toxic texts. Each window of a few words is compressed twice, with the ordinary
dictionary and with the toxic one in front of it; the difference of the two lengths is what the toxic
text explains of the window. How likely each difference is in toxic and in ordinary texts gives the window's
weight; a text's sum of weights goes through a rising curve, fitted to the labelled sample, to a probability.

The dictionaries are trained on at most `window_sample` windows of each class, spread over the sampled texts, of `window_bytes` bytes at most.
This bounds the fit alone: a text is scored by all its windows, whole.

The model is fitted to a bounded sample of labelled rows, `sample_rows` of each class, those with the smallest hashes of
doc_id. So what is broadcast and what comes to the driver is bounded whatever the input's size. Scoring
reads each whole text once, without a shuffle.

Defined results: a null or empty text has no windows, a sum of 0; labels other than 0 and 1 are ignored; of several labels
of a doc_id the highest counts; without labels of both classes every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import held_out, kept_table, table, tidied
from .calibration import calibrate, fit_isotonic
from .quality import training_labels

_EDGE = b".,!?;:|\"'()[]*#$%&"
_LEVEL = 3
#: Length differences are counted from -3 to 12 bytes.
_LOW, _HIGH = -3, 12


def windows(text: str | None, words: int) -> list[bytes]:
    """The text in runs of so many words, A-Z lower-cased, single blanks around each word."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return [b" " + b" ".join(own[i : i + words]) + b" " for i in range(0, len(own), words)]


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    words: int
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]


class _Comparer:
    """Both compressors of a model, in one worker."""

    def __init__(self, model: ToxicityModel):
        def compressor(content: bytes):
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=_LEVEL)
            return zstandard.ZstdCompressor(
                level=_LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False
            ).compress

        self.words = model.words
        self.plain, self.with_toxic = compressor(model.ordinary), compressor(model.toxic + model.ordinary)

    def histogram(self, text: str | None) -> np.ndarray:
        """How often each length difference occurs among the text's windows."""
        plain, other = self.plain, self.with_toxic
        gains = [len(plain(w)) - len(other(w)) for w in windows(text, self.words)]
        return np.bincount(np.clip(np.array(gains, np.int64), _LOW, _HIGH) - _LOW, minlength=_HIGH - _LOW + 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(label, text): the distinct labelled texts, of at most sample_rows documents for each label."""
    label = labels.where(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    some = [label.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for k in (0, 1)]
    chosen = some[0].unionByName(some[1])  # 2 * sample_rows rows of two numbers: bounded, so broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id").select("label", "text").dropDuplicates()


def _telling_words(sample: DataFrame, n_toxic: int, n_ordinary: int, share: float, lift: float, most: int) -> list[tuple[bytes, int]]:
    """Words in at least `share` of the toxic texts and `lift` times rarer in ordinary ones, with their counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[bytes, int], int] = {}
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in {w.strip(_EDGE) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()}:
                    counts[w, label] = counts.get((w, label), 0) + 1
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())],
                ["word", "label", "n"],
            )

    counts = sample.mapInArrow(tidied(work), "word binary, label int, n long").groupBy("word").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("ordinary"),
    )
    telling = counts.where(
        (F.length("word") > 1) & (F.col("toxic") >= max(3.0, share * n_toxic))
        & (F.col("toxic") / n_toxic > lift * (F.col("ordinary") + 0.5) / max(n_ordinary, 1))
    )
    return [(bytes(r.word), r.toxic) for r in telling.orderBy(F.desc("toxic"), "word").limit(most).collect()]


def _train(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, of a third of the samples' bytes at most; where these are too few to train one, the samples themselves."""
    size = min(size, max(256, sum(map(len, samples)) // 3))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    sample_rows: int = 10_000,
    words: int = 5,
    share: float = 0.012,
    lift: float = 8.0,
    ordinary_bytes: int = 126_000,  # with toxic_bytes under 128 KB, where zstandard changes its parameters
    toxic_bytes: int = 3_000,
    window_sample: int = 150_000,
    window_bytes: int = 400,
) -> ToxicityModel:
    """The model for docs (doc_id, text) and labels (doc_id, label: 1 is toxic)."""
    sample = kept_table(labelled_sample(docs, labels, sample_rows))
    n = {r.label: r[1] for r in sample.groupBy("label").count().collect()}
    total = {r.label: r[1] for r in labels.where(F.col("label").isin(0, 1)).groupBy("label").count().collect()}
    none = ToxicityModel(b"", b"", words, np.zeros(_HIGH - _LOW + 1), (np.array([0.0]), np.array([0.0])))
    if not n.get(0) or not n.get(1):
        return none
    telling = _telling_words(sample, n[1], n[0], share, lift, 4_000)

    def pieces(label: int) -> list[bytes]:
        """At most window_sample windows of 8 words from the texts of a label."""
        each = max(1, window_sample // n[label])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for text in batch.column(1).to_pylist():
                    own = windows(text, 8)
                    found += own[:: max(1, len(own) // each)][:each]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["w"])

        rows = sample.where(F.col("label") == label).mapInArrow(tidied(cut), "w binary")
        return [bytes(r.w)[:window_bytes] for r in rows.limit(window_sample).collect()]

    repeats = [w for w, k in telling for _ in range(max(1, round(2_000 * k / n[1])))]
    np.random.default_rng(11).shuffle(repeats)
    samples = [b"".join(b" " + w + b" " for w in repeats[i : i + 4]) for i in range(0, len(repeats), 4)]
    toxic = _train(samples or pieces(1), toxic_bytes)
    # zstandard enters every third place of a dictionary into its tables: keep the places of the ordinary part the same
    toxic = toxic.rjust(-(-len(toxic) // 24) * 24, b" ")
    ordinary = _train(pieces(0), ordinary_bytes)
    model = ToxicityModel(ordinary, toxic, words, none.weights, none.knots)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compare = _Comparer(shared.value)
        for batch in batches:
            rows = [compare.histogram(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tolist() for r in rows], pa.list_(pa.int64()))], ["label", "h"])

    spread = sample.repartition(64)
    rows = spread.mapInArrow(tidied(measure), "label int, h array<long>").collect()  # at most 2 * sample_rows rows of 16 counts
    label = np.array([r.label for r in rows])
    counts = np.array([r.h for r in rows], float)
    seen = [counts[label == k].sum(axis=0) + 1 for k in (0, 1)]
    weights = np.log(seen[1] / seen[1].sum()) - np.log(seen[0] / seen[0].sum())
    of_row = np.where(label == 1, total[1] / (label == 1).sum(), total[0] / (label == 0).sum())
    return ToxicityModel(ordinary, toxic, words, weights, fit_isotonic(counts @ weights, label.astype(float), of_row))


def toxicity_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compare, given = None, shared.value
        for batch in batches:
            if not given.ordinary:
                raw = np.zeros(len(batch))
            else:
                compare = compare or _Comparer(given)
                raw = np.array([compare.histogram(t) @ given.weights for t in batch.column(1).to_pylist()], float)
            score = calibrate(raw, given.knots) if given.ordinary else raw
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidied(work), "doc_id long, score double")


def op4_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, training_labels(labels, "toxic"))
    return toxicity_scores(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
