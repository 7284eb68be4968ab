"""Row numbers of text tables by file and position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.session import stored


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Add ``name``: 0, 1, ... over all files in the order of their paths and of the lines in them.

    ``rows`` comes straight from a file scan. A split's rows have consecutive running ids in the task that reads it; what stands
    before a split is a sum of counts, first inside its file, then over files. So a number depends on the files alone and not on how
    they are split, and a task that runs again gives the same. The rows are stored once, as both steps need the same splits.
    No line is shuffled: only counts per split are, and the sum over files has one row a file.
    """
    at = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")]
    marked = stored(rows.select("*", *at), "numbered-rows")
    spans = marked.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
    files = spans.groupBy("_file").agg(F.sum("_n").alias("_rows")).select("_file", F.sum("_rows").over(earlier).alias("_before"))
    inside = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = spans.select("_file", "_block", "_first", F.sum("_n").over(inside).alias("_in_file")).join(files, "_file")
    starts = starts.select("_file", "_block", (F.coalesce("_before", F.lit(0)) + F.coalesce("_in_file", F.lit(0)) - F.col("_first")).alias("_shift"))
    joined = marked.join(stored(starts, "split-starts"), ["_file", "_block"])
    return joined.withColumn(name, F.col("_at") + F.col("_shift")).drop("_file", "_block", "_at", "_shift")
