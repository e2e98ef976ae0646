"""Row numbers without a window over all rows of a group: sorted ranges, a count of each, and where each begins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.sources.store import written


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "line_no") -> DataFrame:
    """df with each row's number (from 0) among the rows of equal keys, in the order given; ties are numbered in any order.

    Rows are dealt by ranges of keys and order and written sorted, so a number is its place in its range and the rows of the ranges before;
    a group of any size is spread over many tasks. The ranges' counts, a row a range and key, are all that a window orders.
    discard() deletes what was written, once the result has been read for the last time.
    """
    ranges = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    x = written(ranges.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "ranges")
    groups = [f"_key{i}" for i in range(len(keys))]
    counts = x.groupBy(*(F.col(k).alias(g) for k, g in zip(keys, groups, strict=True)), F.col("_range").alias("_at")).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(g)) for k, g in zip(keys, groups, strict=True)]
    out = x.join(counts, [*same, F.col("_range") == F.col("_at")]).select(*df.columns, (F.col("_place") - F.col("_first") + F.col("_base")).alias(name))
    out.scratch_path = x.scratch_path
    return out
