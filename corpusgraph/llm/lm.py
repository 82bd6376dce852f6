"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counts are cut to levels of powers of two, 1 + floor(log2 count), and an n-gram is put into the filter once for each level up
to its own; reading probes level after level until one is missing. Unigrams are stored from level 1 and
bigrams that occur `min_count` times or more from that count's level. The model is P(w | h) = (d(h, w) + (c(h) - T(h)) * P(w)) /
c(h): d is the filter's count of the pair less a discount, T(h) the sum of d over all stored pairs of h, and c(h) the count of h
(more, should T(h) be larger). What pairs that occur once and the discounts leave goes to P(w), which comes from the filter's unigram
counts; so each context's probabilities sum to 1 but for false positives. Every word is a context; a text begins in the context of
an end. A bigram's key is a 64-bit hash of both words.

Beside the model there is the exact unigram score. The counts of frequent words, and as contexts their T(h), are broadcast (at most
`contexts` of them); those of all others are joined by a shuffle, which has no hot keys, since each rare word has fewer
occurrences than the frequent ones. Both ways give the same.

The filter is cut into segments of 64 KB by hash; a segment is one small group's work, so it is built without a large task. It
is broadcast whole up to `broadcast_bytes`. A larger one is worked through in parts of that size, one pass over the texts
for each, which keeps what was read for each token so far beside the text: more passes, the same result.

Tokens: words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, as 64-bit hashes, and one end for each text. A null text is
empty: one end. Rows with equal or null doc_id are texts of their own. With nothing to learn from, N and all counts are 0 and each
token has the probability 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import held_out, kept_table, table, tidied
from .words import mix, runs, text_bytes, word_hashes

END = np.uint64(0x5AFE0E2D5AFE0E2D)
_SEGMENT_BITS = 1 << 19
_PROBES = 6


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count); 0 for 0."""
    return np.frexp(counts.astype(np.float64))[1]


def value_of(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: 1, then the middle of its range."""
    return np.where(levels <= 1, levels, 1.4 * np.exp2(levels - 1.0))


def _first_and_step(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Each key's first place at a level and the step to its next ones, to be taken modulo _SEGMENT_BITS, a power of two."""
    h = mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
    return h, (h >> np.uint64(40)) | np.uint64(1)


def _bits(keys: np.ndarray, level: int) -> np.ndarray:
    """The places in its segment of each key at a level: _PROBES columns."""
    h, step = _first_and_step(keys, level)
    return ((h[:, None] + step[:, None] * np.arange(_PROBES, dtype=np.uint64)) % np.uint64(_SEGMENT_BITS)).astype(np.int64)


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xC0FFEE)) % np.uint64(segments)).astype(np.int64)


def unigram_keys(words: np.ndarray) -> np.ndarray:
    return mix(words ^ np.uint64(0x1111111111111111))


def before(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The context of each token: the token before; a text's first token has the end."""
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[first] = END
    return context


def bigram_keys(context: np.ndarray, words: np.ndarray) -> np.ndarray:
    """64-bit hashes of both words."""
    return mix(mix(context ^ np.uint64(0x2222222222222222)) + words)


@dataclass(frozen=True)
class FilterPart:
    """Segments [first, first + len(bits)) of a filter of `segments` segments."""

    segments: int
    first: int
    bits: np.ndarray

    def own(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys have their segment in this part, and its row of bits for each of these."""
        segment = segment_of(keys, self.segments) - self.first
        at = np.flatnonzero((segment >= 0) & (segment < len(self.bits)))
        return at, segment[at]

    def read(self, keys: np.ndarray, lowest: int) -> np.ndarray:
        """The level stored for each key, 0 if none. Keys of other parts' segments give 0.

        The places are those of _bits, each made only for the keys that no earlier place has ruled out.
        """
        found = np.zeros(len(keys), np.int64)
        at, segment = self.own(keys)
        data = self.bits.reshape(-1)
        own, row = keys[at], segment * (_SEGMENT_BITS // 8)
        level = lowest
        while len(at):
            place, step = _first_and_step(own, level)
            start, left = row, None
            for _ in range(_PROBES):
                inside = place & np.uint64(_SEGMENT_BITS - 1)
                byte = data[(inside >> np.uint64(3)).view(np.int64) + start]
                byte >>= inside.astype(np.uint8) & np.uint8(7)
                hit = (byte & np.uint8(1)).view(bool)
                if not hit.all():
                    some = np.flatnonzero(hit)
                    place, step, start = place[some], step[some], start[some]
                    left = some if left is None else left[some]
                place += step
            if left is not None:
                at, own, row = at[left], own[left], row[left]
            found[at] = level
            level += 1
        return found


def _token_runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, tokens, whether a token is a text's first, begin) for runs of texts; each text ends with END."""
    raw, at = text_bytes(column)
    for i, j in runs(at):
        words, begin = word_hashes(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        tokens = np.insert(words, begin[1:], END)
        begin = begin + np.arange(len(begin))
        first = np.zeros(len(tokens), bool)
        first[begin[:-1]] = True
        yield i, tokens, first, begin


class _Counter:
    """Counts of 64-bit keys, each with the value that goes with it, merged now and then, so memory follows the distinct keys."""

    def __init__(self, limit: int = 500_000):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.limit = 0, limit

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        made, at, counts = np.unique(keys, return_index=True, return_counts=True)
        self.parts.append((made, values[at], counts.astype(np.int32)))
        self.size += len(made)
        if self.size > self.limit:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
        keys, values, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts = []
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        return keys[new], values[order[new]], np.add.reduceat(counts, new) if len(new) else counts

    def batches(self) -> Iterator[pa.RecordBatch]:
        columns = self.merged()
        self.size = 0
        for i in range(0, len(columns[0]), 50_000):
            key, _, n = (x[i : i + 50_000] for x in columns)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int32))], ["key", "n"])


def count_words(texts: DataFrame) -> DataFrame:
    """(key, n) of all tokens of the column text, ends included."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for batch in batches:
            for _, tokens, _, _ in _token_runs(batch.column(0)):
                counter.add(tokens, tokens)
                if counter.size > 400_000:
                    yield from counter.batches()
        yield from counter.batches()

    return texts.mapInArrow(tidied(work), "key long, n int").groupBy("key").agg(F.sum("n").alias("n"))


def count_pairs(texts: DataFrame, *, min_count: int = 1, tokens: int | None = None, segment_keys: int = 400_000) -> DataFrame:
    """(key, value, n) of the bigrams of the column text that occur min_count times or more: value is the context's hash.

    A task's counts leave it as packed arrays, one for each segment of the key space, and a segment's arrays are merged in one small
    group. tokens: the number of tokens in texts, from which the number of segments follows.
    """
    segments = max(1, -(-(texts.count() if tokens is None else tokens) // segment_keys))
    edges = np.array([(k << 64) // segments for k in range(1, segments)], np.uint64)

    def packed(counter: _Counter) -> Iterator[pa.RecordBatch]:
        keys, values, counts = counter.merged()
        counter.size = 0
        if not len(keys):
            return
        cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
        full = np.flatnonzero(np.diff(cut))
        blobs = [[x[cut[k] : cut[k + 1]].tobytes() for k in full] for x in (keys, values, counts.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), *(pa.array(b, pa.binary()) for b in blobs)], ["segment", "keys", "values", "counts"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for batch in batches:
            for _, tokens_of_run, first, _ in _token_runs(batch.column(0)):
                context = before(tokens_of_run, first)
                counter.add(bigram_keys(context, tokens_of_run), context)
                if counter.size > 400_000:
                    yield from packed(counter)
        yield from packed(counter)

    def merge(rows: pa.Table) -> pa.Table:
        keys, values, counts = (
            np.frombuffer(b"".join(rows.column(c).to_pylist()), kind) for c, kind in (("keys", np.uint64), ("values", np.uint64), ("counts", np.int32))
        )
        order = np.argsort(keys, kind="stable")
        keys, total = keys[order], counts[order].astype(np.int64)
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        total = np.add.reduceat(total, new)
        kept = np.flatnonzero(total >= min_count)
        return pa.table({"key": keys[new[kept]].view(np.int64), "value": values[order[new[kept]]].view(np.int64), "n": total[kept]})

    dealt = texts.mapInArrow(tidied(work), "segment long, keys binary, values binary, counts binary")
    return dealt.groupBy("segment").applyInArrow(merge, "key long, value long, n long")


@dataclass(frozen=True)
class Frequent:
    """The frequent words: sorted hashes with counts, and for each as a context the sum of its stored pairs."""

    words: np.ndarray
    counts: np.ndarray
    sums: np.ndarray

    def find(self, tokens: np.ndarray) -> np.ndarray:
        """The number of each token among the frequent words, -1 if it is none."""
        if not len(self.words):
            return np.full(len(tokens), -1)
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        return np.where(self.words[at] == tokens, at, -1)

    def levels(self, part: FilterPart) -> np.ndarray:
        """The unigram level that the part of the filter holds of each."""
        return part.read(unigram_keys(self.words), 1)


def frequent_words(counts: DataFrame, most: int) -> Frequent:
    """The words of counts (key, n, t) of the highest n, as many as whole count classes fit into `most`."""
    bins = counts.groupBy(F.floor(F.log2("n") * 64).alias("b")).agg(F.count("*").alias("k"), F.min("n").alias("low")).collect()
    least, total = None, 0
    for r in sorted(bins, key=lambda r: -r.b):  # a few hundred rows
        if total + r.k > most:
            break
        total, least = total + r.k, r.low
    end = F.col("key") == int(END.view(np.int64))  # the end has the count of all texts, and is broadcast in any case
    rows = counts.where(end if least is None else (F.col("n") >= least) | end).toArrow()
    words, n, t = rows.column("key").to_numpy().view(np.uint64), rows.column("n").to_numpy(), rows.column("t").to_numpy()
    order = np.argsort(words)
    return Frequent(words[order], n[order], t[order])


def _filter_segments(entries: DataFrame, segments: int) -> DataFrame:
    """(segment, bits) of entries (key, low, high): each key with all its levels."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(segment_of(keys, segments).astype(np.int32)), *batch.columns], ["segment", "key", "low", "high"])

    def build(rows: pa.Table) -> pa.Table:
        keys = rows.column("key").to_numpy().view(np.uint64)
        low, high = rows.column("low").to_numpy(), rows.column("high").to_numpy()
        bits = np.zeros(_SEGMENT_BITS, bool)
        for level in range(int(low.min()), int(high.max()) + 1):
            own = keys[(low <= level) & (level <= high)]
            if len(own):
                bits[_bits(own, level).ravel()] = True
        data = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"segment": rows.column("segment").slice(0, 1), "bits": pa.array([data], pa.binary())})

    dealt = entries.mapInArrow(tidied(deal), "segment int, key long, low int, high int")
    return dealt.groupBy("segment").applyInArrow(build, "segment int, bits binary")


@dataclass
class LanguageModel:
    """What scoring needs: frequent words, counts (key, n, t) of all words, and the filter (its parts are rows of `segments_table`)."""

    frequent: Frequent
    segments_table: DataFrame
    segments: int
    counts: DataFrame
    train_tokens: int
    distinct: int
    filter_tokens: float
    lowest_pair: int
    discount: float

    def parts(self, broadcast_bytes: int) -> Iterator[FilterPart]:
        size = max(1, broadcast_bytes // (_SEGMENT_BITS // 8))
        for first in range(0, self.segments, size):
            bits = np.zeros((min(size, self.segments - first), _SEGMENT_BITS // 8), np.uint8)
            rows = self.segments_table.where(F.col("segment").between(first, first + len(bits) - 1))
            for r in rows.toLocalIterator():
                bits[r.segment - first] = np.frombuffer(r.bits, np.uint8)
            yield FilterPart(self.segments, first, bits)


def fit_language_model(
    texts: DataFrame, *, contexts: int = 131_000, min_count: int = 2, bits_per_entry: int = 12, discount: float = 0.9
) -> LanguageModel:
    """The model of the column text of texts."""
    counts = kept_table(count_words(texts))
    level = F.floor(F.log2("n")).cast("int") + 1
    stands = F.when(level <= 1, F.lit(1.0)).otherwise(F.lit(1.4) * F.pow(F.lit(2.0), level - 1))
    n, distinct, seen, uni_entries = counts.agg(F.sum("n"), F.count("*"), F.sum(stands), F.sum(level)).first()
    lowest = int(levels_of(np.array([min_count]))[0])
    pairs = kept_table(count_pairs(texts, min_count=min_count, tokens=n or 0))
    by_context = pairs.groupBy(F.col("value").alias("key")).agg(F.sum(stands - discount).alias("t"))
    counts = kept_table(counts.join(by_context, "key", "left").select("key", "n", F.coalesce("t", F.lit(0.0)).alias("t")))
    frequent = frequent_words(counts, contexts)
    entries = int(uni_entries or 0) + int(pairs.agg(F.sum(level - lowest + 1)).first()[0] or 0)
    segments = max(1, -(-entries * bits_per_entry // _SEGMENT_BITS))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(0).to_numpy().view(np.uint64)
            pair = batch.column(1).to_numpy(zero_copy_only=False)
            made = np.where(pair, raw, unigram_keys(raw)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(made), batch.column(2), batch.column(3)], ["key", "low", "high"])

    all_entries = counts.select("key", F.lit(False).alias("pair"), F.lit(1).alias("low"), level.alias("high")).unionByName(
        pairs.select("key", F.lit(True).alias("pair"), F.lit(lowest).alias("low"), level.alias("high"))
    )
    hashed = all_entries.mapInArrow(tidied(keys), "key long, low int, high int")
    filter_rows = kept_table(_filter_segments(hashed, segments))
    return LanguageModel(frequent, filter_rows, segments, counts, n or 0, distinct, seen or 0.0, lowest, discount)


def _read_levels(rows: DataFrame, model: LanguageModel, part: FilterPart) -> DataFrame:
    """rows (id, doc_id, text, levels) with what the part of the filter holds of each token added to levels (2 bytes a token)."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((part, model.lowest_pair, model.frequent, model.frequent.levels(part)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_part, lowest, frequent, stored = shared.value
        for batch in batches:
            made = []
            old = batch.column(3).to_pylist()
            for i, tokens, first, begin in _token_runs(batch.column(2)):
                both = read_own_tokens(filter_part, lowest, tokens, first, frequent, stored)
                for k in range(len(begin) - 1):
                    own = both[begin[k] : begin[k + 1]]
                    if old[i + k] is not None:
                        own = np.maximum(own, np.frombuffer(old[i + k], np.uint8).reshape(-1, 2))
                    made.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(made, pa.binary())], ["id", "doc_id", "text", "levels"])

    return rows.mapInArrow(tidied(work), "id long, doc_id long, text string, levels binary")


def read_tokens(
    part: FilterPart, lowest: int, tokens: np.ndarray, first: np.ndarray, number: np.ndarray, stored: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The filter's unigram level of each token, and the level of the bigram with the token before.

    number: each token's number among the frequent words, whose unigram levels `stored` were read before; -1 for others.
    """
    one = np.zeros(len(tokens), np.int64)
    known = number >= 0
    one[known] = stored[number[known]]
    words, where = np.unique(tokens[~known], return_inverse=True)
    one[~known] = part.read(unigram_keys(words), 1)[where]
    keys, back = np.unique(bigram_keys(before(tokens, first), tokens), return_inverse=True)
    return one, part.read(keys, lowest)[back]


def read_own_tokens(
    part: FilterPart, lowest: int, tokens: np.ndarray, first: np.ndarray, frequent: Frequent, stored: np.ndarray
) -> np.ndarray:
    """Both columns of read_tokens in a byte each, for a part of several: what is of other parts is left at 0 after one hash."""
    both = np.zeros((len(tokens), 2), np.uint8)
    at, _ = part.own(unigram_keys(tokens))
    number = frequent.find(tokens[at])
    known = number >= 0
    both[at[known], 0] = stored[number[known]]
    rare = at[~known]
    both[rare, 0] = part.read(unigram_keys(tokens[rare]), 1)
    keys = bigram_keys(before(tokens, first), tokens)
    at, _ = part.own(keys)
    own, back = np.unique(keys[at], return_inverse=True)
    both[at, 1] = part.read(own, lowest)[back]
    return both


def pair_probability(value: np.ndarray, share: np.ndarray, kept: np.ndarray, times: np.ndarray) -> np.ndarray:
    """P(w | h) from the filter's discounted count of the pair, P(w), T(h) and c(h). The same in Spark is in score_texts."""
    times = np.maximum(times, kept + 1)
    return np.minimum((np.minimum(value, kept) + (times - kept) * share) / times, 1.0)


def score_texts(docs: DataFrame, model: LanguageModel, *, broadcast_bytes: int = 256 << 20) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    parts = model.parts(broadcast_bytes)
    part = next(parts)
    for following in parts:
        rows = kept_table(_read_levels(rows if "levels" in rows.columns else rows.withColumn("levels", F.lit(None).cast("binary")), model, part))
        part = following
    many = "levels" in rows.columns
    base_of_all = model.train_tokens + 0.5 * (model.distinct + 1)
    shared = spark.sparkContext.broadcast((model.frequent, model.frequent.levels(part), part, model.lowest_pair))
    seen_of_all, discount = model.filter_tokens + 0.5 * (model.distinct + 1), model.discount

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, stored, filter_part, lowest = shared.value
        end = frequent.find(np.array([END]))
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            old = batch.column(3).to_pylist() if many else None
            for i, tokens, first, begin in _token_runs(batch.column(2)):
                number = frequent.find(tokens)
                one, two = read_tokens(filter_part, lowest, tokens, first, number, stored)
                if old is not None:
                    levels = np.frombuffer(b"".join(old[i : i + len(begin) - 1]), np.uint8).reshape(-1, 2)
                    one, two = np.maximum(one, levels[:, 0]), np.maximum(two, levels[:, 1])
                context = np.concatenate([end, number[:-1]])  # the number of the token before
                context[first] = end
                share = (value_of(one) + 0.5) / seen_of_all
                value = np.where(two > 0, value_of(two) - discount, 0.0)
                model_log = np.zeros(len(tokens))
                own = np.flatnonzero(context >= 0)
                kept, times = frequent.sums[context[own]], frequent.counts[context[own]]
                model_log[own] = np.log10(pair_probability(value[own], share[own], kept, times))
                known = number >= 0
                base_log = np.zeros(len(tokens))
                base_log[known] = np.log10((frequent.counts[number[known]] + 0.5) / base_of_all)
                out[0].append(np.diff(begin))
                for k, values in ((1, known.astype(np.int64)), (2, base_log), (3, model_log)):
                    out[k].append(np.add.reduceat(values, begin[:-1]))
                # A text's last token is its end, so the token after a rare one is of the same text. Without a known end all is rare.
                rare = np.flatnonzero(~known)
                after = np.minimum(rare + 1, len(tokens) - 1)
                owner = np.searchsorted(begin, rare, "right") - 1
                out[4].append(tokens[rare].view(np.int64))
                out[5].append(value[after])
                out[6].append(share[after])
                out[7].append(np.bincount(owner, minlength=len(begin) - 1))
            n, has, base, model_score, rare_tokens, rare_value, rare_share, rare_n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
            offsets = pa.array(np.concatenate([[0], np.cumsum(rare_n)]).astype(np.int32))
            items = pa.StructArray.from_arrays(
                [pa.array(rare_tokens, pa.int64()), pa.array(rare_value, pa.float64()), pa.array(rare_share, pa.float64())], ["key", "value", "share"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(has, pa.int64()), pa.array(base, pa.float64()),
                    pa.array(model_score, pa.float64()), pa.ListArray.from_arrays(offsets, items),
                ],
                ["id", "doc_id", "n_tokens", "n_frequent", "base", "score", "rare"],
            )

    schema = "id long, doc_id long, n_tokens long, n_frequent long, base double, score double, rare array<struct<key: long, value: double, share: double>>"
    scored = kept_table(rows.mapInArrow(tidied(work), schema))
    rare = scored.select("id", F.inline("rare"))
    joined = rare.join(model.counts, "key", "left")
    kept = F.coalesce("t", F.lit(0.0))
    times = F.greatest(F.coalesce("n", F.lit(0)).cast("double"), kept + 1)
    after = F.least((F.least("value", kept) + (times - kept) * F.col("share")) / times, F.lit(1.0))
    per_text = joined.groupBy("id").agg(
        F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.5) / base_of_all)).alias("rare_base"), F.count("n").alias("rare_known"),
        F.sum(F.log10(after)).alias("rare_score"),
    )
    both = scored.drop("rare").join(per_text, "id", "left")
    return both.select(
        "doc_id",
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_language_model(docs.where(~held_out(F.col("doc_id"), 1)).select(F.col("text").cast("string").alias("text")))
    return score_texts(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id"), 1).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
