"""Continuous jobs: quota windows, progress counts, and an index kept up with arriving snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.index import IndexStore


def quota_windows(events: DataFrame, limits: DataFrame, *, width: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Of each fixed window, user and prefix: the count, the limit of limits (key_prefix, most), what is left. Works on streams and tables.

    On a stream, rows later than `late` behind the newest are dropped by the watermark.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counts = rows.groupBy(F.window("ts", width).alias("w"), "user_id", "key_prefix").agg(F.count("*").alias("n"))
    joined = counts.join(F.broadcast(limits), "key_prefix")  # one row for each kind of request
    return joined.select(
        F.col("w.start").alias("window_start"), "user_id", "key_prefix", "n", "most", F.greatest(F.col("most") - F.col("n"), F.lit(0)).alias("remaining")
    )


def quota_decisions(events: DataFrame, limits: DataFrame, *, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """(event_id, user_id, key_prefix, ts, allowed, remaining, reset_ms) for each request of events (event_id, ts, user_id, key_prefix).

    Requests of a user and prefix are counted in fixed windows, in order of arrival; those up to the limit of limits (key_prefix, most) are allowed, and reset_ms is what is
    left of the window. In a table arrival is by time and id. On a stream the count of a window is its state, which goes with the watermark, `late` behind
    the newest event; requests of one micro-batch arrive by time and id, later ones than the watermark are dropped.
    """
    start = F.floor(F.unix_micros("ts") / (seconds * 1_000_000)) * seconds
    rows = events.join(F.broadcast(limits), "key_prefix")  # one row for each kind of request
    rows = rows.select("event_id", "user_id", "key_prefix", "ts", "most", start.cast("long").alias("window_s"))
    if rows.isStreaming:
        counted = _counted_stream(rows.withWatermark("ts", late), seconds)
    else:
        order = Window.partitionBy("user_id", "key_prefix", "window_s").orderBy("ts", "event_id")
        counted = rows.withColumn("n", F.row_number().over(order).cast("long"))
    reset = F.floor(((F.col("window_s") + seconds) * 1_000_000 - F.unix_micros("ts")) / 1000)
    return counted.select(
        "event_id", "user_id", "key_prefix", "ts", (F.col("n") <= F.col("most")).alias("allowed"), F.greatest(F.col("most") - F.col("n"), F.lit(0)).cast("long").alias("remaining"),
        reset.cast("long").alias("reset_ms"),
    )


def _counted_stream(rows: DataFrame, seconds: int) -> DataFrame:
    """rows with n, the place of each in its user's and prefix's window; one number of state for each open window."""

    def count(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        arrived = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        before = state.get[0] if state.exists else 0
        arrived["n"] = np.arange(before + 1, before + 1 + len(arrived))
        state.update((before + len(arrived),))
        state.setTimeoutTimestamp(max((int(key[2]) + seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield arrived

    made = T.StructType([*rows.schema.fields, T.StructField("n", T.LongType())])
    grouped = rows.groupBy("user_id", "key_prefix", "window_s")
    return grouped.applyInPandasWithState(count, made, "n long", "append", GroupStateTimeout.EventTimeTimeout)


def progress_counts(events: DataFrame) -> DataFrame:
    """Running counts by job and phase."""
    return events.groupBy("job_id", "phase").agg(F.count("*").alias("n"))


def incremental_index(snapshots: DataFrame, store: IndexStore, checkpoint: str) -> StreamingQuery:
    """Keep an index up with arriving snapshots of whole repositories (repo_id, path, content): each batch goes through extraction, chunks and relations.

    All tables of a batch become visible together; a batch that is repeated, after a failure or not, has the same effect as one.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        store.apply(batch, batch_id)

    return snapshots.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
