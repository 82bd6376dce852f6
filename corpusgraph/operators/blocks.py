"""Where the blocks of declared symbols end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def block_ends(symbols: DataFrame, files: DataFrame, *, most: int = 50) -> DataFrame:
    """symbols (repo_id, file_id, start_line, ...) with end_line, by the content and language of files (repo_id, file_id, language, content).

    With braces: the line of the first `}` that brings the depth back to what it was before the symbol, after an opening one; the symbol's own
    line if no brace follows, and at most `most` lines where the depth never comes back. Python: the last line before one that is indented no
    more than the symbol, blank lines aside, else the last line.

    Starts of symbols and braces go through windows together, none meets another in a join: running sums give the depths, and the partner of an opening brace
    is the next closing one of its depth in the order of places, met walking the file backwards. Lines of Python likewise, for each indent up to the symbol's.
    """
    key = ["repo_id", "file_id"]
    lines = files.select(*key, "language", F.posexplode(F.split("content", "\n")).alias("pos", "text")).withColumn("line", F.col("pos") + 1)
    starts = symbols.select(*key, F.col("start_line").cast("int").alias("line")).distinct()
    marks = lines.where("language <> 'python' OR language IS NULL").select(*key, "line", F.posexplode(F.regexp_extract_all("text", F.lit("[{}]"), F.lit(0))).alias("place", "brace"))
    marks = marks.select(*key, "line", "place", F.when(F.col("brace") == "{", 1).otherwise(-1).alias("step"))
    both = marks.unionByName(starts.withColumns({"place": F.lit(-1), "step": F.lit(0)}))
    file = Window.partitionBy(*key)
    onward, backward = file.orderBy("line", "place").rowsBetween(Window.unboundedPreceding, 0), file.orderBy(F.desc("line"), F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("depth", F.sum("step").over(onward))
    # the next opening brace, and then the first return to the depth before the symbol, which is the symbol's own depth here
    at = F.struct("line", "place")
    both = both.withColumn("opening", F.last(F.when(F.col("step") == 1, at), ignorenulls=True).over(backward))
    asked = both.where("step = 0 AND opening IS NOT NULL").select(*key, "depth", "opening.*", F.col("line").alias("start_line"), F.lit(False).alias("closes"))
    closing = both.where("step = -1").select(*key, "depth", "line", "place", F.lit(None).cast("int").alias("start_line"), F.lit(True).alias("closes"))
    level = Window.partitionBy(*key, "depth").orderBy(F.desc("line"), F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    shut = asked.unionByName(closing).withColumn("shut_line", F.last(F.when(F.col("closes"), F.col("line")), ignorenulls=True).over(level))
    shut = shut.where("NOT closes").select(*key, "start_line", "shut_line", F.lit(True).alias("opened"))

    indent = lines.where("language = 'python'").where(F.col("text").rlike(r"\S")).select(*key, "line", (F.length("text") - F.length(F.ltrim("text"))).alias("indent"))
    levels = indent.groupBy(*key).agg(F.array_sort(F.collect_set("indent")).alias("levels"))  # as many as a file has different indents
    own = indent.join(starts, [*key, "line"]).join(levels, key)
    asked = own.select(*key, "line", F.explode(F.filter("levels", lambda x: x <= F.col("indent"))).alias("indent"), F.lit(True).alias("asks"))
    # the asking line itself stands behind its own question, walking backwards
    rank = Window.partitionBy(*key, "indent").orderBy(F.desc("line"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, 0)
    rows = indent.withColumn("asks", F.lit(False)).unionByName(asked)
    less = rows.withColumn("next", F.last(F.when(~F.col("asks"), F.col("line")), ignorenulls=True).over(rank)).where("asks")
    less = less.groupBy(*key, F.col("line").alias("start_line")).agg((F.min("next") - 1).alias("python_line"))

    sizes = files.select(*key, F.col("language").alias("language_"), F.size(F.split("content", "\n")).alias("n_lines"))
    rows = symbols.join(sizes, key).join(shut, [*key, "start_line"], "left").join(less, [*key, "start_line"], "left")
    braces = F.when(F.col("opened").isNull(), F.col("start_line")).otherwise(F.coalesce("shut_line", F.least(F.col("start_line") + most - 1, F.col("n_lines"))))
    end = F.when(F.col("language_") == "python", F.coalesce("python_line", "n_lines")).otherwise(braces)
    return rows.select(*symbols.columns, end.cast("int").alias("end_line"))
