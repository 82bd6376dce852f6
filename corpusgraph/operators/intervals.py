"""Joins of line ranges by overlap: a sweep over the sorted starts of each file's ranges, many files at a time in a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How many pairs are worked on at once.
_AT_ONCE = 1 << 20


def _slices(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, place) of all places from first to last of each owner, in runs of about _AT_ONCE."""
    count = np.maximum(last - first, 0)
    ends = np.cumsum(count)
    a = 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _AT_ONCE, "right")))
        c = count[a:b]
        begin = np.cumsum(c) - c
        yield np.repeat(np.arange(a, b), c), np.arange(c.sum()) + np.repeat(first[a:b] - begin, c)
        a = b


def _pairs(side: np.ndarray, home: np.ndarray, start: np.ndarray, end: np.ndarray, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (left, right) that overlap, each pair once; start and end are places on one line for all files."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    # the left one starts inside the right one
    own = left[home[left]]
    own = own[np.argsort(start[own], kind="stable")]
    for r, at in _slices(np.searchsorted(start[own], start[right]), np.searchsorted(start[own], end[right], "right")):
        x, y = own[at], right[r]
        if within:
            keep = (end[y] >= end[x]) & ((start[y] < start[x]) | (end[y] > end[x]))
            x, y = x[keep], y[keep]
        yield x, y
    if within:
        return
    # the right one starts later inside the left one
    own = right[home[right]]
    own = own[np.argsort(start[own], kind="stable")]
    for x, at in _slices(np.searchsorted(start[own], start[left], "right"), np.searchsorted(start[own], end[left], "right")):
        yield left[x], own[at]


def _whole_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of equal first n_keys columns, as they come in order, with the number of each row's group."""
    held: list[pa.RecordBatch] = []

    def numbered(rows: pa.Table) -> np.ndarray:
        new = np.zeros(len(rows), bool)
        for i in range(n_keys):
            c = rows.column(i)
            differs = pc.not_equal(c.slice(1), c.slice(0, len(c) - 1))
            null = pc.not_equal(pc.is_null(c.slice(1)), pc.is_null(c.slice(0, len(c) - 1)))
            new[1:] |= pc.fill_null(pc.or_kleene(differs, null), False).to_numpy(zero_copy_only=False).astype(bool)
        return np.cumsum(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < 50_000:
            continue
        rows = pa.Table.from_batches(held)
        group = numbered(rows)
        whole = int(np.searchsorted(group, group[-1]))
        if whole:
            yield rows.slice(0, whole), group[:whole]
            held = rows.slice(whole).to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, numbered(rows)


def overlaps(left: DataFrame, right: DataFrame, on: list[str], *, within: bool = False, tightest: bool = False, cut_rows: int = 200_000) -> DataFrame:
    """(on, left_id, right_id) of left (on, left_id, start, end) and right (on, right_id, start, end) of equal `on` whose ranges have a line in common.

    within: the right range holds the left one and is larger. tightest: of each left_id the right range of the fewest lines, the first by right_id of
    equal ones. Ranges that end before they start meet nothing.

    Both sides are brought together by `on` and sorted; a range's partners are then two runs of neighbours in the order of starts, so that tasks make no
    more pairs than there are results (with `within`, ranges that start inside), and with `tightest` no more rows than ranges. A file with more than
    `cut_rows` ranges is cut into up to 256 cells at quantiles of the starts, which are groups of their own; a range is in each cell that it
    reaches, a pair is found in the cell of its later start only.
    """
    kinds = {"left_id": left.schema["left_id"].dataType, "right_id": right.schema["right_id"].dataType}
    line = lambda c: F.col(c).cast("long").alias(c)
    a = left.select(*on, F.lit(0).alias("side"), line("start"), line("end"), "left_id", F.lit(None).cast(kinds["right_id"]).alias("right_id"))
    b = right.select(*on, F.lit(1).alias("side"), line("start"), line("end"), F.lit(None).cast(kinds["left_id"]).alias("left_id"), "right_id")
    rows = a.unionByName(b).where(F.col("end") >= F.col("start"))
    large = rows.groupBy(*on).agg(F.count("*").alias("n_")).where(F.col("n_") > cut_rows).select(*on)
    cuts = F.array_distinct(F.percentile_approx("start", [i / 256 for i in range(1, 256)], 10_000))
    cuts = rows.join(large, on, "left_semi").groupBy(*on).agg(cuts.alias("cuts_"))
    cell = lambda c: F.coalesce(F.size(F.filter("cuts_", lambda x: x <= F.col(c))), F.lit(0))
    rows = rows.join(cuts, on, "left").withColumn("first_", F.when(F.col("cuts_").isNull(), 0).otherwise(cell("start")))
    last = F.when(F.col("cuts_").isNull(), 0).otherwise(cell("end"))
    rows = rows.withColumn("cell_", F.explode(F.sequence("first_", last)))
    placed = rows.select(*on, "cell_", "side", (F.col("cell_") == F.col("first_")).alias("home"), "start", "end", "left_id", "right_id")
    placed = placed.repartition(*on, "cell_").sortWithinPartitions(*on, "cell_")
    n_on = len(on)
    fields = [*(left.schema[c] for c in on), T.StructField("left_id", kinds["left_id"]), T.StructField("right_id", kinds["right_id"])]
    made = T.StructType([*fields, T.StructField("lines", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in _whole_groups(batches, n_on + 1):
            side, home, start, end = (rows.column(n_on + i).to_numpy() for i in range(1, 5))
            low = start.min()
            width = int(end.max() - low) + 2
            start, end = group * width + (start - low), group * width + (end - low)
            lines = end - start
            keys = [rows.column(i).combine_chunks() for i in range(n_on)]
            left_ids, right_ids = (rows.column(n_on + i).combine_chunks() for i in (5, 6))

            def result(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
                at, to = pa.array(x), pa.array(y)
                return pa.RecordBatch.from_arrays([*(k.take(at) for k in keys), left_ids.take(at), right_ids.take(to), pa.array(lines[y])], made.names)

            if not tightest:
                for x, y in _pairs(side, home, start, end, within):
                    yield result(x, y)
                continue
            order = np.empty(len(side), np.int64)  # of the lines of right ranges, ties by id
            table = pa.table({"lines": lines, "id": right_ids})
            order[pc.sort_indices(table, [("lines", "ascending"), ("id", "ascending")]).to_numpy()] = np.arange(len(side))
            best = np.full(len(side), len(side))
            for x, y in _pairs(side, home, start, end, within):
                np.minimum.at(best, x, order[y])
            x = np.flatnonzero(best < len(side))
            back = np.empty(len(side), np.int64)
            back[order] = np.arange(len(side))
            yield result(x, back[best[x]])

    found = placed.mapInArrow(work, made)
    if tightest:  # a range of several cells has a row from each
        found = found.groupBy(*on, "left_id").agg(F.min_by("right_id", F.struct("lines", "right_id")).alias("right_id"))
    return found.select(*on, "left_id", "right_id")
