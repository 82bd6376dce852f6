"""Hilbert-curve ordering: rows into shards that are compact in several metadata dimensions at once.

Each dimension is quantised to a few bits, the cells so made are numbered along a Hilbert curve, rows
are ordered by that number (ties: by the tie columns), and the order is cut into runs of equal row
counts. Files of a shard therefore cover a small box of all dimensions, which is what min/max
statistics prune by. Only DataFrame functions are used; the curve is computed for the distinct cells
alone, of which there are at most 2 ** (bits * dimensions).

A global row number without a global sort: rows are counted for each cell and slice of a cell, the
counts are summed along the curve (a small table), and rows are numbered inside their slice. A cell
that holds a large part of all rows is split into slices by a hash of the ties, each of about one part in
`slices` of all rows, so no task gets many rows of one cell.

Defined results: a null dimension is a quantised value of its own, 0; null ties come first; repeated
rows are rows like others; an empty table gives no rows. Other columns of the input, whatever
their names, are kept as they are; if the input has a `shard` or `slot`, the new column is called `shard_1` and so on.
Rows of equal texts are not kept together: the law is `rows`, so a text that a third of all rows have must be in many shards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import free_name, kept_table, quoted, table


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def hilbert_index(codes: Column, dimensions: int, bits: int) -> Column:
    """Place on the Hilbert curve of the cell whose coordinates, of `bits` bits each, are in the array `codes`."""
    steps = [(1 << k, i) for k in range(bits - 1, 0, -1) for i in range(dimensions)]
    turned = codes
    if steps:
        todo = F.array(*(F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q, i in steps))

        def turn(x: Column, step: Column) -> Column:
            q, i, low = step["q"], step["i"], step["q"] - 1
            first, own = x[0], F.get(x, i)
            swap = first.bitwiseXOR(own).bitwiseAND(low)
            return F.when(
                own.bitwiseAND(q) != 0, F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
            ).otherwise(F.transform(x, lambda v, j: F.when((j == 0) | (j == i), v.bitwiseXOR(swap)).otherwise(v)))

        turned = F.aggregate(todo, codes, turn)
    gray = _let(
        turned,
        lambda x: F.transform(x, lambda _, j: F.aggregate(F.slice(x, 1, j + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v))),
    )
    powers = F.array(*(F.lit(1 << k) for k in range(bits - 1, 0, -1))) if bits > 1 else F.array().cast("array<int>")
    order = F.array(
        *(F.struct(F.lit(1 << k).alias("q"), F.lit(i).alias("i")) for k in range(bits - 1, -1, -1) for i in range(dimensions))
    )

    def flip(g: Column) -> Column:
        last = F.element_at(g, -1)
        mask = F.aggregate(
            powers, F.lit(0), lambda a, q: F.when(last.bitwiseAND(q) != 0, a.bitwiseXOR(q - 1)).otherwise(a)
        )
        return _let(mask, lambda m: F.transform(g, lambda v: v.bitwiseXOR(m)))

    return _let(
        _let(gray, flip),
        lambda x: F.aggregate(
            order,
            F.lit(0).cast("long"),
            lambda a, s: a * 2 + (F.get(x, s["i"]).bitwiseAND(s["q"]) != 0).cast("long"),
        ),
    )


def quantised(df: DataFrame, name: str, bits: int) -> Column:
    """A dimension as an int of `bits` bits; null is 0.

    Numbers: steps of half a power of two, from 1 (negative numbers and NaN too) to the highest code.
    Other types: rank among the distinct values if these fit; else values are cut into ranges of their order, at
    the quantiles of a sample of 4096 distinct values (those of the smallest hashes), so that a code covers a range of values.
    """
    most = (1 << bits) - 1
    kind, col = dict(df.dtypes)[name], F.col(quoted(name))
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        value = F.greatest(F.nanvl(col.cast("double"), F.lit(0.0)), F.lit(0.0))
        code = F.least(F.floor(F.log2(value + 1) * 2) + 1, F.lit(most)).cast("int")
        code = F.when(col.isNotNull(), code)
    else:
        value = col.cast("string")
        distinct = df.where(col.isNotNull()).select(value.alias("v")).distinct()
        # the limit bounds what comes to the driver
        seen = sorted(r.v for r in distinct.orderBy(F.xxhash64("v"), "v").limit(4096).collect())
        if len(seen) <= most:
            ranks = F.array(*map(F.lit, seen)) if seen else F.array().cast("array<string>")
            code = F.array_position(ranks, value).cast("int")
        else:
            borders = F.array(*(F.lit(seen[i * len(seen) // most]) for i in range(1, most)))
            code = F.when(value.isNotNull(), F.size(F.filter(borders, lambda b: b <= value)) + 1)
    return F.coalesce(code, F.lit(0))


def hilbert_shards(
    df: DataFrame, dimensions: list[str], ties: list[str], *, shards: int = 40, bits: int = 5, slices: int = 1 << 16
) -> DataFrame:
    """df with `shard` (0 to shards - 1; row counts differ by one at most) and `slot` (from 0 in each shard) as last columns."""
    if not 0 < bits * len(dimensions) <= 20:
        raise ValueError("bits * dimensions must be from 1 to 20: it bounds the table of cells")
    codes = [quantised(df, d, bits) for d in dimensions]
    cell = codes[0].cast("long")
    for c in codes[1:]:
        cell = cell * (1 << bits) + c
    keys = [F.col(quoted(t)) for t in ties]
    hashed = F.xxhash64(*keys) if ties else F.monotonically_increasing_id()
    tied = [f"tie{i}" for i in range(len(ties))]
    # a row of df travels as one struct, so none of its names can meet those of the columns here
    rows = df.select(
        F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("row"), cell.alias("cell"), F.pmod(hashed, F.lit(1 << 20)).cast("int").alias("part"),
        *(k.alias(t) for k, t in zip(keys, tied, strict=True)),
    )
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"))
    n = len(dimensions)
    parts = F.array(*(F.shiftright("cell", bits * (n - 1 - i)).bitwiseAND((1 << bits) - 1).cast("int") for i in range(n)))
    cells = cells.withColumns(
        {"place": hilbert_index(parts, n, bits), "slices": F.ceil(F.col("n") * slices / F.sum("n").over(Window.partitionBy())).cast("int")}
    ).drop("n")
    # at most 2 ** 20 cells of three numbers each, so this can be broadcast
    rows = rows.join(F.broadcast(cells), "cell").withColumn("slice", F.floor(F.col("part").cast("long") * F.col("slices") / (1 << 20)).cast("int"))
    counts = rows.groupBy("place", "slice").agg(F.count("*").alias("n"))
    # one row for each cell and slice: at most 2 ** 20 + slices, so these windows of all rows are bounded
    along = Window.orderBy("place", "slice")
    starts = counts.select(
        "place", "slice", (F.sum("n").over(along) - F.col("n")).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total")
    )
    inside = Window.partitionBy("place", "slice").orderBy("part", *tied)
    out = rows.join(starts, ["place", "slice"]).withColumn("rank", F.col("start") + F.row_number().over(inside) - 1)
    # the first `more` shards have size `low + 1`, the others `low`
    low, more = F.floor(F.col("total") / shards), F.col("total") % shards
    head = more * (low + 1)
    shard = (
        F.when(F.col("rank") < head, F.floor(F.col("rank") / (low + 1)))
        .otherwise(more + F.floor((F.col("rank") - head) / F.greatest(low, F.lit(1))))
        .cast("int")
    )
    out = out.withColumn("shard", shard)
    first = F.col("shard") * low + F.least(F.col("shard").cast("long"), more)
    return out.select(
        *(F.col("row")[c].alias(c) for c in df.columns), F.col("shard").alias(free_name(df.columns, "shard")),
        (F.col("rank") - first).alias(free_name(df.columns, "slot")),
    )


def write_shards(df: DataFrame, path: str) -> None:
    """Write rows that have `shard` and `slot` as one folder of Parquet files for each shard, in order of slots."""
    df.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        "lang",
        "source",
    )
    # whole texts are read once, for their sizes and checksums; what follows uses these small rows twice
    docs = kept_table(docs)
    out = hilbert_shards(docs, ["lang", "source", "size"], ["doc_id", "text_crc32"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
