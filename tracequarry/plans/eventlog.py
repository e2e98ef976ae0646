"""The events table as logs with a stored index, which is built once for a state of the table and then read by all log queries."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracequarry.functions.profiles import EDA
from tracequarry.operators.logindex import LogIndex
from tracequarry.sources.logs import event_lines
from tracequarry.sources.numbering import numbered
from tracequarry.sources.store import discard, shared, workspace

_BUILT: dict[tuple, tuple] = {}


def table_state(spark: SparkSession, path: str) -> int:
    """A number that changes when a file of the table is added, removed, resized or rewritten; no file is opened."""
    files = spark.read.format("binaryFile").load(path)
    mark = F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")
    return files.agg(F.xxhash64(F.count("*"), F.sum(mark))).first()[0]


def built(spark: SparkSession, what: str, sf_dir: str, table: str, build):
    """What build() makes of a table, kept while the table, the application and the shared folder are the same and the index is there."""
    key = spark.sparkContext.applicationId, shared(spark), what, sf_dir
    state = table_state(spark, f"{sf_dir}/{table}.parquet")
    known, index = _BUILT.get(key, (None, None))
    if known != state or not index.store.commits():
        index = build()
        _BUILT[key] = state, index
    return index


def event_index(spark: SparkSession, sf_dir: str) -> LogIndex:
    def build() -> LogIndex:
        index = LogIndex(spark, workspace(spark, "logindex"), EDA)
        x = numbered(event_lines(spark.read.parquet(f"{sf_dir}/events.parquet")), ["file"], ["ts", "event_id"])
        index.add(x.withColumn("ts_s", F.unix_seconds(F.col("ts").cast("timestamp"))))
        discard(x)
        return index

    return built(spark, "logs", sf_dir, "events", build)
