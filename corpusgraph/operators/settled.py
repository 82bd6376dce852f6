"""Cutting lineage between the steps of loops."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the checkpoint folder that driver and executors share (spark.checkpoint.dir).

    Lost executors cost their own tasks only, not the steps before. Where no folder is set, as in local tests, a temporary one is used.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        given = context.getConf().get("spark.checkpoint.dir")
        if not given and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(given or "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint()
