"""Repeated passages by a logarithmic family of sampled suffix arrays.

A full suffix array has an entry for each byte; these hold about one for each 190 bytes, and lose nothing. Every
`length`-byte window of a text is filed under its anchor, the smallest hash among its 64-byte grams. Equal windows
have equal anchors, so a window whose anchor stands nowhere else is unique. Consecutive windows of one anchor are one
entry: (anchor, hash of the whole run of bytes, place). An array is the entries of some texts in the order of anchor
and run.

The index is a family of arrays. A new batch becomes an array of its own, is merge-scanned against each existing level for
anchors that both have, and then levels of equal size are merged, so n batches make log n levels. What the scans found is
looked at closely: runs that are equal as a whole are repeated in all their windows; from the different runs of an
anchor one of each kind is cut from the texts, and their windows are compared by hashes, anchor by anchor. Anchors of very many
different runs are not one task's work: their windows are dealt out by hash and counted.

Every byte covered by a window that starts anywhere else too, in the same text as well, is marked, and marked bytes are removed.

Defined results: a null text is empty; texts shorter than `length` bytes lose nothing; rows with equal or null doc_id and different texts
are texts of their own, and equal rows are texts that repeat each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import kept_table, table, tidied
from .words import _BYTE, _power_tables, mix, runs, text_bytes, word_hashes

GRAM = 64


def _rolling(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which span_hashes makes the hash of any span of units (a uint64 for each byte or word)."""
    up, down = _power_tables(len(units) + 1)
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * up[: len(units)], out=sums[1:])
    return sums, down


def span_hashes(rolling: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums, down = rolling
    return mix((sums[end] - sums[start]) * down[start])


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` consecutive values."""
    count = len(values) - width + 1
    full = np.concatenate([values, np.full(-len(values) % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def entries_of(units: np.ndarray, at: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Entries of the windows of `length` units of texts that begin at `at`: text, first window, number of windows, anchor, hash of the run,
    whether it may repeat in itself."""
    none = tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    if len(units) < length:
        return none
    rolling = _rolling(units)
    place = np.arange(len(units) - gram + 1)
    grams = span_hashes(rolling, place, place + gram)
    least = _sliding_min(grams, length - gram + 1)
    inside = np.zeros(len(least) + 1, np.int32)
    long = np.flatnonzero(np.diff(at) >= length)
    if not len(long):
        return none
    np.add.at(inside, at[long], 1)
    np.add.at(inside, at[long + 1] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    text = np.searchsorted(at, windows, "right") - 1
    new = np.ones(len(windows), bool)
    new[1:] = (least[windows[1:]] != least[windows[:-1]]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    low, high = windows[first], windows[np.append(first[1:], len(windows)) - 1]
    # a run in which a window begins with its anchor before the run's last window may hold a window twice
    begins = np.concatenate([[0], np.cumsum(grams[: len(least)] == least)])
    whole = span_hashes(rolling, low, high + length)
    return text[first], low - at[text[first]], high - low + 1, least[low], whole, begins[high] > begins[low]


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))


def suffix_entries(docs: DataFrame, *, length: int = 400) -> DataFrame:
    """The entries of docs (doc_id, text): (anchor, run, d, t, low, n, self); d and t identify the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column(2))
            d, t = batch.column(0), batch.column(1)
            for i, j in runs(at):
                text, low, n, anchor, run, own = entries_of(_BYTE[raw[at[i] : at[j]]], at[i : j + 1] - at[i], length)
                of = pa.array(text + i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(run.view(np.int64)), d.take(of), t.take(of), pa.array(low), pa.array(n), pa.array(own)],
                    ["anchor", "run", "d", "t", "low", "n", "self"],
                )

    return _identified(docs).mapInArrow(tidied(work), "anchor long, run long, d long, t long, low long, n long, self boolean")


class SuffixIndex:
    """levels: (size in batches, array of entries); repeated: anchors that stand at two places or may repeat in their own run."""

    def __init__(self, levels: list[tuple[int, DataFrame]] | None = None, repeated: DataFrame | None = None):
        self.levels, self.repeated = levels or [], repeated

    @staticmethod
    def _array(entries: DataFrame) -> DataFrame:
        """Entries in the order of anchor and run, inside partitions by anchor."""
        return kept_table(entries.sortWithinPartitions("anchor", "run"))

    def insert(self, entries: DataFrame) -> SuffixIndex:
        """The index with a batch more: its array is scanned against every level, then equal levels are merged."""
        batch = self._array(entries)
        own = kept_table(batch.groupBy("anchor").agg(F.count("*").alias("k"), F.max("self").alias("self")))
        found = own.where("k > 1 OR self").select("anchor")
        for _, level in self.levels:
            found = found.unionByName(own.select("anchor").join(level.select("anchor").distinct(), "anchor", "left_semi"))
        found = found if self.repeated is None else found.unionByName(self.repeated)
        levels, size, array = list(self.levels), 1, batch
        while levels and levels[-1][0] == size:
            array = self._array(levels.pop()[1].unionByName(array))
            size *= 2
        return SuffixIndex([*levels, (size, array)], kept_table(found.distinct()))

    def candidates(self) -> DataFrame:
        """The entries of all levels whose anchor is repeated."""
        rows = None
        for _, level in self.levels:
            rows = level if rows is None else rows.unionByName(level)
        return rows.join(self.repeated, "anchor", "left_semi")


def _slices(docs: DataFrame, entries: DataFrame, length: int, broadcast_rows: int = 500_000) -> DataFrame:
    """entries (anchor, d, t, low, n, c) with their bytes, cut from the texts."""
    lists = kept_table(entries.groupBy("d", "t").agg(F.collect_list(F.struct("anchor", "low", "n", "c")).alias("cuts")))
    few = entries.count() <= broadcast_rows  # of four numbers each; more are joined by a shuffle
    wanted = F.broadcast(lists) if few else lists
    texts = _identified(docs)
    rows = texts.join(wanted, texts["d"].eqNullSafe(wanted["d"]) & (texts["t"] == wanted["t"])).select(texts["d"], texts["t"], "text", "cuts")
    schema = "anchor long, d long, t long, low long, c long, bytes binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t, text, cuts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                yield pa.RecordBatch.from_pylist(
                    [
                        {"anchor": x["anchor"], "d": d, "t": t, "low": x["low"], "c": x["c"], "bytes": raw[x["low"] : x["low"] + x["n"] - 1 + length]}
                        for x in cuts
                    ],
                    schema=pa.schema(
                        [("anchor", pa.int64()), ("d", pa.int64()), ("t", pa.int64()), ("low", pa.int64()), ("c", pa.int64()), ("bytes", pa.binary())]
                    ),
                )

    return rows.mapInArrow(tidied(work), schema).dropDuplicates(["anchor", "d", "t", "low"])


def _windows(data: bytes, length: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    start = np.arange(len(raw) - length + 1)
    return span_hashes(_rolling(_BYTE[raw]), start, start + length)


def _ranges(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _compared(slices: DataFrame, length: int, bytes_at_once: int = 1_000_000) -> DataFrame:
    """(d, t, start, end): the bytes of windows that occur twice among the slices of an anchor."""
    total = slices.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    groups = max(1, math.ceil(total / bytes_at_once))

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("anchor")
        anchor, low, c = (rows.column(k).to_numpy() for k in ("anchor", "low", "c"))
        data = rows.column("bytes").to_pylist()
        of, start, end = [], [], []
        edges = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            made = [_windows(data[i], length) for i in range(a, b)]
            _, where, count = np.unique(np.concatenate(made), return_inverse=True, return_counts=True)
            twice = count[where] > 1
            at = 0
            for i, own in zip(range(a, b), made, strict=True):
                if c[i] == 1:
                    for x, y in zip(*_ranges(twice[at : at + len(own)]), strict=True):
                        of.append(i)
                        start.append(low[i] + x)
                        end.append(low[i] + y - 1 + length)
                at += len(own)
        taken = rows.take(pa.array(of, pa.int64()))
        return pa.table({"d": taken.column("d"), "t": taken.column("t"), "start": pa.array(start, pa.int64()), "end": pa.array(end, pa.int64())})

    dealt = slices.withColumn("g", F.pmod(F.xxhash64("anchor"), F.lit(groups)))
    return dealt.groupBy("g").applyInArrow(compare, "d long, t long, start long, end long")


def _dealt_windows(slices: DataFrame, length: int) -> DataFrame:
    """The same for anchors of very many slices: each window is a row, dealt out by its hash, so no anchor is one task's work."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t, low, c, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                own = _windows(data, length)
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.view(np.int64)), pa.array([d] * n, pa.int64()), pa.array(np.full(n, t)), pa.array(low + np.arange(n)), pa.array(np.full(n, c))],
                    ["w", "d", "t", "start", "c"],
                )

    rows = slices.select("d", "t", "low", "c", "bytes").mapInArrow(tidied(cut), "w long, d long, t long, start long, c long")
    twice = rows.groupBy("w").agg(F.count("*").alias("k")).where("k > 1").select("w")
    found = rows.where("c = 1").join(twice, "w", "left_semi")
    return found.select("d", "t", "start", (F.col("start") + length).alias("end"))


def repeated_spans(docs: DataFrame, *, length: int = 400, batches: int = 4, hot: int = 4096) -> DataFrame:
    """(d, t, spans): for each text with repeated windows, the (start, end) byte ranges they cover, not yet merged."""
    entries = kept_table(suffix_entries(docs, length=length))
    index = SuffixIndex()
    for k in range(batches):
        index = index.insert(entries.where(F.pmod(F.xxhash64("d", "t"), F.lit(batches)) == k))
    found = kept_table(index.candidates())
    kinds = kept_table(
        found.groupBy("anchor", "run", "n").agg(F.count("*").alias("c"), F.max("self").alias("self"), F.min(F.struct("d", "t", "low")).alias("one"))
    )
    whole = found.join(kinds.where("c > 1").select("anchor", "run", "n"), ["anchor", "run", "n"], "left_semi")
    spans = whole.select("d", "t", F.col("low").alias("start"), (F.col("low") + F.col("n") - 1 + length).alias("end"))
    many = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max("self").alias("any_self"))
    looked_at = kinds.join(many.where("kinds > 1 OR any_self"), "anchor")
    chosen = kept_table(looked_at.select("anchor", "one.d", "one.t", "one.low", "n", "c", "kinds"))
    slices = kept_table(_slices(docs, chosen, length))
    hot_anchors = many.where(F.col("kinds") > hot).select("anchor")
    spans = spans.unionByName(_compared(slices.join(hot_anchors, "anchor", "left_anti"), length))
    if hot_anchors.limit(1).count():
        spans = spans.unionByName(_dealt_windows(slices.join(hot_anchors, "anchor", "left_semi"), length))
    return spans.groupBy("d", "t").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def shared_passages(docs: DataFrame, *, words: int = 51, gram: int = 8, broadcast_rows: int = 500_000) -> DataFrame:
    """(r, n): for texts with passages of `words` words that another row holds too, at how many of their words such a passage starts.

    r is the hash of doc_id and of the text's hash; rows with equal doc_id and text are one row. Words are runs of bytes other than
    `[\\x20\\x09-\\x0D]`, A-Z lower-cased. Passages are found as byte windows are: consecutive ones of one anchor (the smallest hash of
    `gram` words) are an entry, and equal entries are one kind. Kinds that several rows have are shared as a whole; of the other kinds of
    an anchor, and one of each shared kind beside them, the passages are cut from a text, dealt out by hash and counted.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column(1))
            for i, j in runs(at):
                text, low, n, anchor, run, _ = entries_of(*word_hashes(raw[at[i] : at[j]], at[i : j + 1] - at[i]), words, gram)
                r = batch.column(0).take(pa.array(text + i))
                kind = mix(anchor + run * np.uint64(3) + n.astype(np.uint64))
                made = [r, pa.array(anchor.view(np.int64)), pa.array(kind.view(np.int64)), pa.array(low.astype(np.int32)), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(made, ["r", "anchor", "kind", "low", "n"])

    texts = _identified(docs).select(F.xxhash64("d", "t").alias("r"), "text")
    entries = kept_table(texts.mapInArrow(tidied(find), "r long, anchor long, kind long, low int, n int"))
    kinds = kept_table(entries.groupBy("kind").agg(
        F.min("anchor").alias("anchor"), F.min("n").alias("n"), (F.min("r") != F.max("r")).alias("shared"), F.count("*").alias("c"),
        F.min(F.struct("r", "low")).alias("one")))
    whole = entries.select("kind", "r", "n").join(kinds.where("shared").select("kind"), "kind", "left_semi").select("r", F.col("n").cast("long").alias("n"))
    # equal rows give equal entries; a text's first entry begins at its first word
    equal_rows = entries.where("low = 0").groupBy("r").agg(F.count("*").alias("rows"))
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    chosen = kinds.join(mixed, "anchor", "left_semi").select("one.r", F.struct("one.low", "n", "c", "shared").alias("cut"))
    cuts = kept_table(chosen.groupBy("r").agg(F.collect_list("cut").alias("cuts")))
    few = (cuts.agg(F.sum(F.size("cuts"))).first()[0] or 0) <= broadcast_rows  # four numbers for each cut; more are joined by a shuffle
    met = texts.join(F.broadcast(cuts) if few else cuts, "r")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_bytes(batch.column(1))
            own = batch.column(2).to_pylist()
            for i, j in runs(at):
                hashes, begin = word_hashes(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                some = [(k, x) for k in range(j - i) for x in own[i + k]]
                place = np.concatenate([np.zeros(0, np.int64), *(np.arange(x["low"], x["low"] + x["n"]) for _, x in some)])
                size = [x["n"] for _, x in some]
                start = place + np.repeat([begin[k] for k, _ in some], size).astype(np.int64)
                w = span_hashes(_rolling(hashes), start, start + words)
                r = batch.column(0).take(pa.array(np.repeat([k + i for k, _ in some], size).astype(np.int64)))
                c, shared = np.repeat([x["c"] for _, x in some], size), np.repeat([x["shared"] for _, x in some], size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.view(np.int64)), r, pa.array(place), pa.array(c.astype(np.int64)), pa.array(shared.astype(bool))], ["w", "r", "start", "c", "shared"]
                )

    windows = kept_table(met.select("r", "text", "cuts").mapInArrow(tidied(cut), "w long, r long, start long, c long, shared boolean"))
    several = windows.groupBy("w").agg((F.max("shared") | (F.min("r") != F.max("r"))).alias("several")).where("several").select("w")
    parts = windows.where("NOT shared").join(several, "w", "left_semi").dropDuplicates(["w", "r", "start"]).select("r", F.col("c").alias("n"))
    found = whole.unionByName(parts).groupBy("r").agg(F.sum("n").alias("n"))
    return found.join(equal_rows, "r").select("r", F.expr("n DIV rows").alias("n"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the spans cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_spans(docs: DataFrame, spans: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """(doc_id, t, n_bytes, n_removed, n_spans, kept) of each row: kept is the binary rest of its text without the spans, t the text's hash."""
    spans = kept_table(spans)
    held = spans.agg(F.count("*"), F.sum(F.size("spans"))).first()
    few = held[0] <= broadcast_rows and (held[1] or 0) <= 10 * broadcast_rows  # two numbers for each span
    texts, found = _identified(docs), F.broadcast(spans) if few else spans
    rows = texts.join(found, texts["d"].eqNullSafe(found["d"]) & (texts["t"] == found["t"]), "left").select(texts["d"], texts["t"], "text", "spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, count, kept = [], [], [], []
            for text, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = text.encode()
                gone = merged([(x["start"], x["end"]) for x in own or ()])
                edges = [0, *(x for pair in gone for x in pair), len(raw)]
                kept.append(b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)) if gone else raw)
                size.append(len(raw))
                removed.append(sum(b - a for a, b in gone))
                count.append(len(gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (size, removed, count)), pa.array(kept, pa.binary())],
                ["doc_id", "t", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return rows.mapInArrow(tidied(work), "doc_id long, t long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns: n_passages, at how many words a passage of 51 words starts that another document holds too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = cut_spans(docs, repeated_spans(docs, length=400)).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
    shared = shared_passages(docs, words=51)
    both = out.join(shared, F.xxhash64("doc_id", "t") == shared["r"], "left")
    return both.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce(shared["n"], F.lit(0)).alias("n_passages")
    )
