"""A training corpus from raw documents: quality, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. Its result is written as Parquet and reread as the
next one's docs. All but the last return the columns of docs. Rows with a null doc_id stay in all stages that find rows by
doc_id; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm import bpe, decontam, lines, neardup, quality
from corpusgraph.llm.base import kept_table, quoted, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str, *, least: float = 0.3) -> DataFrame:
    """Documents with a quality score of at least `least`, by a model of labels.quality."""
    labels = quality.training_labels(table(spark, sf_dir, "labels"), "quality")
    model = quality.fit_quality(kept_table(quality.with_statistics(docs)), labels)
    scored = quality.score_documents(docs, model)
    return scored.where(F.col(scored.columns[-1]) >= least).select(*map(quoted, docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a document of smaller doc_id has too. n_chars, if there is one, follows the text."""
    clean = lines.dedup_lines(docs).select(*map(quoted, docs.columns))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest doc_id."""
    found = neardup.near_components(docs.select("doc_id", "text")).where(F.col("doc_id").isNotNull())
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("kept")).where(~F.col("kept"))
    key = docs["doc_id"].cast("long") == gone["doc_id"]
    return docs.join(gone, key, "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, copied or edited."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the text decoded from them."""
    return bpe.round_trip_digests(docs, bpe.tokenizer_path(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL can't express the stages; tests hold the result against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
