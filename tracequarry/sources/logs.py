"""Text logs as numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracequarry.functions.profiles import Profile


def text_lines(spark: SparkSession, path: str | list[str], extensions: tuple[str, ...] | None = None) -> DataFrame:
    """file, line_no (from 0), line of all logs under path (or paths); lines end at \\n only.

    Numbers come from each split's own count and the counts of the splits before it, so nothing is sorted.
    """
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    rows = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    if extensions is not None:
        rows = rows.where(F.lower(F.regexp_extract("file", r"(\.[^./]*)?$", 1)).isin(*extensions))
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("m").alias("least"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return rows.join(blocks, ["file", "block"]).select("file", (F.col("m") - F.col("least") + F.col("base")).alias("line_no"), F.col("value").alias("line"))


#: The text of an event as a log line, its file, and (for SQL) its number.
EVENT_FILE = "concat('app_', cast(user_id % 4 as string), '.log')"
EVENT_LINE = """case event_type
         when 'error' then case when value >= 150
              then 'FATAL: (EVT-' || cast(user_id % 7 as string) || '9): core dumped'
              else '**ERROR: (EVT-' || cast(user_id % 7 as string) || '1): failed in src/mod'
                   || cast(user_id % 5 as string) || '.py' end
         when 'click'  then '**WARN: (UI-' || cast(user_id % 3 as string) || '0): slow'
         when 'view'   then '    at frame' || cast(user_id % 2 as string)
         when 'signup' then '--- Starting "s' || cast(user_id % 3 as string) || '" ---'
         else               '--- Ending "s'   || cast(user_id % 3 as string) || '" ---' end"""
RENDERED = f"""
select {EVENT_FILE} as file, cast(row_number() over (partition by user_id % 4 order by ts, event_id) - 1 as bigint) as line_no,
       {EVENT_LINE} as line, ts, event_id
from {{events}}
"""


def event_lines(events: DataFrame) -> DataFrame:
    """file, ts, event_id, line of the events as logs of four files, in the order of ts and event_id."""
    return events.select(F.expr(EVENT_FILE).alias("file"), "ts", "event_id", F.expr(EVENT_LINE).alias("line"))


def classified(lines: DataFrame, profile: Profile) -> DataFrame:
    """lines with severity, and the code of severe ones."""
    out = lines.withColumn("severity", profile.severity(F.col("line")))
    return out.withColumn("code", F.when(F.col("severity").isNotNull(), profile.code_of(F.col("line"))))


def json_records(lines: DataFrame) -> DataFrame:
    """lines with m, the map of each line's JSON object; other lines are left out."""
    return lines.withColumn("m", F.from_json("line", "map<string,string>")).where("m is not null")


def documents(spark: SparkSession, path: str, pattern: str = "*.{md,markdown,txt,rst}") -> DataFrame:
    """source, text of whole files."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def write_logs(lines: DataFrame, path: str) -> None:
    """Text logs of lines (file, line_no, line), one under path/file=<file> each; a file's lines meet in one task, as a text file needs."""
    rows = lines.select("file", "line_no", "line").repartition("file").sortWithinPartitions("file", "line_no")
    rows.select("file", "line").write.partitionBy("file").option("lineSep", "\n").text(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The lines of logs that write_logs wrote."""
    return text_lines(spark, path).withColumn("file", F.url_decode(F.regexp_extract("file", "file=([^/]+)", 1)))
