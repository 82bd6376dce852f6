"""Cutting texts into chunks of whole lines."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CHUNK = pa.schema(
    [
        ("repo_id", pa.string()), ("file_id", pa.string()), ("seq", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()),
        ("symbol_name", pa.string()), ("content", pa.string()), ("token_count", pa.int32()),
    ]
)


def token_count(text: Column) -> Column:
    """The estimate of a quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("int")


def chunk_by_lines(files: DataFrame, *, most: int = 800, target: int = 500, back: int = 10, least_lines: int = 5) -> DataFrame:
    """(repo_id, file_id, seq, start_line, end_line, content, token_count) of files (repo_id, file_id, content).

    A text of `most` tokens or fewer is one chunk. Else lines are gathered up to `target` tokens and cut after the last
    blank line of the `back` lines before, but not within the chunk's first `least_lines`; without one, right there.
    """
    rows = files.select("repo_id", "file_id", "content", F.split("content", "\n").alias("lines")).withColumn("n", F.size("lines"))
    start = F.struct(F.lit(0).alias("first"), F.lit(0).alias("tokens"), F.array().cast("array<int>").alias("cuts"))

    def step(state: Column, i: Column) -> Column:
        tokens = state["tokens"] + token_count(F.col("lines")[i])
        stop = F.greatest(state["first"] + least_lines, i - back)
        blank = F.filter(F.when(stop <= i, F.sequence(i, F.least(stop, i), F.lit(-1))), lambda j: ~F.col("lines")[j].rlike(r"\S"))
        cut = F.coalesce(F.when(stop <= i, F.get(blank, F.lit(0)) + 1), i + 1)
        full = tokens >= target
        return F.struct(
            F.when(full, cut).otherwise(state["first"]).alias("first"),
            F.when(full, F.lit(0)).otherwise(tokens).alias("tokens"),
            F.when(full, F.concat(state["cuts"], F.array(cut))).otherwise(state["cuts"]).alias("cuts"),
        )

    cuts = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), start, step)["cuts"]
    cuts = F.when(token_count(F.col("content")) <= most, F.array().cast("array<int>")).otherwise(cuts)
    rows = rows.withColumn("edges", F.concat(F.array(F.lit(0)), cuts))
    rows = rows.withColumn("edges", F.when(F.element_at("edges", -1) < F.col("n"), F.concat("edges", F.array("n"))).otherwise(F.col("edges")))
    pieces = rows.select("repo_id", "file_id", "lines", "edges", F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("seq"))
    low, high = F.col("edges")[F.col("seq") - 1], F.col("edges")[F.col("seq")]
    cut = pieces.select(
        "repo_id", "file_id", "seq", (low + 1).alias("start_line"), high.alias("end_line"), F.array_join(F.slice("lines", low + 1, high - low), "\n").alias("content")
    )
    return cut.withColumn("token_count", token_count(F.col("content"))).where((F.col("token_count") > 0) | (F.col("seq") == 1))


def _tokens(text: str) -> int:
    return -(-len(text) // 4)


def symbol_pieces(lines: list[str], symbols: list[tuple[int, int, str]], *, most: int = 800, target: int = 500, least: int = 50) -> list[list]:
    """[first line, last line, symbol name or None] of a file's chunks, for symbols (first line, last line, name) in order of lines."""
    pieces: list[list] = []

    def text(a: int, b: int) -> str:
        return "\n".join(lines[a - 1 : b])

    def gap(a: int, b: int) -> None:
        """Lines outside of symbols: a chunk of their own, or the end of the chunk before."""
        size = _tokens(text(a, b))
        if size >= least:
            pieces.append([a, b, None])
        elif pieces and size > 0:
            pieces[-1][1] = b

    line = 1
    for first, last, name in symbols:
        if line < first:
            gap(line, first - 1)
        if _tokens(text(first, last)) <= most:
            pieces.append([first, last, name])
        else:
            pieces += [[a, b, name] for a, b in _split(lines, first, last, target, least)]
        line = last + 1
    if line <= len(lines):
        gap(line, len(lines))
    return pieces


def _split(lines: list[str], first: int, last: int, target: int, least: int) -> list[tuple[int, int]]:
    """A long symbol in parts of at least `target` tokens, cut after the last blank, comment or closing line; a small rest joins the part before."""
    parts, begin, good, size = [], first, first, 0
    for i in range(first, last + 1):
        size += _tokens(lines[i - 1])
        bare = lines[i - 1].strip()
        if bare in ("", "}", "},") or bare.startswith(("//", "#", "*")):
            good = i + 1
        if size >= target and i > begin:
            cut = good if good > begin else i + 1
            parts.append((begin, cut - 1))
            begin = good = cut
            size = 0
    if begin <= last:
        rest = _tokens("\n".join(lines[begin - 1 : last]))
        if parts and 0 < rest < least:
            parts[-1] = (parts[-1][0], last)
        elif rest:
            parts.append((begin, last))
    return parts


def overlapped(lines: list[str], pieces: list[list], overlap: int = 50) -> list[list]:
    """The pieces, each but the first begun with the last lines of the one before, of `overlap` tokens at most."""
    out = [list(p) for p in pieces]
    for i in range(1, len(out)):
        size, taken = 0, 0
        for j in range(out[i - 1][1], out[i - 1][0] - 1, -1):
            size += _tokens(lines[j - 1])
            if size > overlap:
                break
            taken += 1
        out[i].append(out[i - 1][1] - taken)
    return out


def chunk_by_symbols(files: DataFrame, symbols: DataFrame, *, overlap: int = 50, short: int = 30) -> DataFrame:
    """(repo_id, file_id, seq, start_line, end_line, symbol_name, content, token_count) of files (repo_id, file_id, content) with symbols
    (repo_id, file_id, name, start_line, end_line).

    Each symbol is a chunk, a long one several; lines between them are chunks or join the one before. Every chunk but the first begins with
    the last lines of the one before, up to `overlap` tokens. Files of `short` lines or fewer, or without symbols, are cut by lines. A file
    is one row of a task; its symbols are listed with it.
    """
    lists = symbols.groupBy("repo_id", "file_id").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "name"))).alias("symbols"))
    rows = files.select("repo_id", "file_id", "content").join(lists, ["repo_id", "file_id"], "left")
    long = (F.size(F.split("content", "\n")) > short) & F.col("symbols").isNotNull()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _CHUNK.names]
            for repo, file, content, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = content.split("\n")
                pieces = overlapped(lines, symbol_pieces(lines, [(x["start_line"], x["end_line"], x["name"]) for x in own]), overlap)
                for seq, (a, b, name, *before) in enumerate(pieces, 1):
                    lead = lines[before[0] : pieces[seq - 2][1]] if before else []
                    text = "\n".join([*lead, *lines[a - 1 : b]])
                    for column, value in zip(out, (repo, file, seq, max(1, a - len(lead)), b, name, text, _tokens(text)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _CHUNK, strict=True)], schema=_CHUNK)

    schema = "repo_id string, file_id string, seq int, start_line int, end_line int, symbol_name string, content string, token_count int"
    by_symbol = rows.where(long).mapInArrow(work, schema)
    by_lines = add_overlap(chunk_by_lines(rows.where(~long)), rows.where(~long), overlap=overlap)
    return by_symbol.unionByName(by_lines.withColumn("symbol_name", F.lit(None).cast("string")).select(*by_symbol.columns))


def add_overlap(chunks: DataFrame, files: DataFrame, *, overlap: int = 50) -> DataFrame:
    """chunks of chunk_by_lines, each but a file's first begun with the last lines of the one before, of `overlap` tokens at most."""
    before = Window.partitionBy("repo_id", "file_id").orderBy("seq")
    rows = chunks.withColumns({"from_": F.lag("start_line").over(before), "to_": F.lag("end_line").over(before)})
    rows = rows.join(files.select("repo_id", "file_id", F.split("content", "\n").alias("lines_")), ["repo_id", "file_id"])
    span = F.reverse(F.slice("lines_", F.col("from_"), F.col("to_") - F.col("from_") + 1))
    walk = F.aggregate(
        span,
        F.struct(F.lit(0).alias("size"), F.lit(0).alias("taken"), F.lit(True).alias("open")),
        lambda a, line: F.struct(
            (a["size"] + token_count(line)).alias("size"),
            F.when(a["open"] & (a["size"] + token_count(line) <= overlap), a["taken"] + 1).otherwise(a["taken"]).alias("taken"),
            (a["open"] & (a["size"] + token_count(line) <= overlap)).alias("open"),
        ),
    )["taken"]
    rows = rows.withColumn("taken_", F.coalesce(walk, F.lit(0)))
    lead = F.array_join(F.slice("lines_", F.col("to_") - F.col("taken_") + 1, F.col("taken_")), "\n")
    rows = rows.withColumn("content", F.when(F.col("taken_") > 0, F.concat(lead, F.lit("\n"), "content")).otherwise(F.col("content")))
    return rows.select(
        "repo_id", "file_id", "seq", F.greatest(F.lit(1), F.col("start_line") - F.col("taken_")).alias("start_line"), "end_line", "content",
        token_count(F.col("content")).alias("token_count"),
    )


def link_chunks(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """chunks (repo_id, file_id, symbol_name, ...) with symbol_id: the symbol of that name in the file, the last of several; null without."""
    last = symbols.groupBy("repo_id", "file_id", F.col("name").alias("symbol_name")).agg(F.max_by("symbol_id", F.struct("start_line", "symbol_id")).alias("symbol_id"))
    return chunks.join(last, ["repo_id", "file_id", "symbol_name"], "left")


def hashed_vectors(texts: list[str], size: int = 256) -> np.ndarray:
    """Unit vectors of word counts, each word at the place that its CRC-32 says: a model that needs no training and no network."""
    out = np.zeros((len(texts), size))
    for i, text in enumerate(texts):
        for word in re.findall(r"\w+", text.lower()):
            out[i, zlib.crc32(word.encode()) % size] += 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed_chunks(
    chunks: DataFrame, embed: Callable[[list[str]], np.ndarray] = hashed_vectors, *, model: str = "hashed-256", batch: int = 100, most_chars: int = 8_191 * 4
) -> DataFrame:
    """(chunk_id, embedding, model) of chunks (chunk_id, content): embed is called with up to `batch` texts of `most_chars` characters at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(0, len(rows), batch):
                part = rows.slice(i, batch)
                made = np.asarray(embed([(t or "")[:most_chars] for t in part.column(1).to_pylist()]), np.float32)
                ends = pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1])
                vectors = pa.ListArray.from_arrays(ends, pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), vectors], ["chunk_id", "embedding"])

    kind = T.StructType([chunks.schema["chunk_id"], T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return chunks.select("chunk_id", F.col("content").cast("string")).mapInArrow(work, kind).withColumn("model", F.lit(model))
