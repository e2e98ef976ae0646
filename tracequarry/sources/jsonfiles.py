"""Folders of JSON files, one object a file: cases of an evaluation and saved sessions. Files that aren't JSON are left out, and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_files(spark: SparkSession, path: str, names: str = "*.json") -> DataFrame:
    """file, v of the files of such names right under path; v is null where a file isn't a JSON object."""
    raw = spark.read.option("pathGlobFilter", names).text(path, wholetext=True)
    v = F.try_parse_json("value")
    return raw.select(F.col("_metadata.file_path").alias("file"), F.when(F.schema_of_variant(v).startswith("OBJECT"), v).alias("v"))


def _get(name: str, kind: str):
    return F.try_variant_get("v", f"$.{name}", kind)


def cases(spark: SparkSession, path: str, within: str | None = None, names: str = "*.json") -> DataFrame:
    """file, id, log_path, question, mode, expected, forbidden, max_steps of the cases whose id holds `within`; facts are variants of any depth.

    A case without id, log_path or question counts as a bad file.
    """
    x = json_files(spark, path, names)
    none = F.array().cast("array<variant>")
    x = x.select("file", _get("id", "string").alias("id"), _get("log_path", "string").alias("log_path"), _get("question", "string").alias("question"), F.coalesce(_get("mode", "string"), F.lit("eda")).alias("mode"),
        F.coalesce(_get("expected_facts", "array<variant>"), none).alias("expected"), F.coalesce(_get("forbidden_facts", "array<variant>"), none).alias("forbidden"), F.coalesce(_get("max_steps", "int"), F.lit(8)).alias("max_steps"))
    x = x.where("id is not null and log_path is not null and question is not null")
    return x if within is None else x.where(F.col("id").contains(within))


def bad_files(spark: SparkSession, path: str) -> DataFrame:
    """n: files that are no case."""
    return json_files(spark, path).agg(F.count("*").alias("n")).crossJoin(cases(spark, path).agg(F.count("*").alias("m"))).select((F.col("n") - F.col("m")).alias("n"))  # one row each


def case_facts(found: DataFrame) -> list[dict]:
    """Cases for answers.nested_scores; a corpus is written by hand, so it is small."""
    plain = lambda facts: [f.toPython() for f in facts]
    return [{"case_id": r.id, "expected_facts": plain(r.expected), "forbidden_facts": plain(r.forbidden)} for r in found.orderBy("file").collect()]


def sessions(spark: SparkSession, path: str, names: str = "*.json") -> DataFrame:
    """id, path, created, updated, turns (of the user), last_question (60 characters) of saved sessions."""
    history = F.coalesce(_get("history", "array<struct<role: string, text: string>>"), F.array().cast("array<struct<role: string, text: string>>"))
    x = json_files(spark, path, names).where("v is not null").withColumn("asked", F.filter(history, lambda h: h["role"] == "user"))
    last = F.left(F.coalesce(F.try_element_at("asked", F.lit(-1))["text"], F.lit("")), F.lit(60))
    name = F.regexp_extract("file", r"([^/]*)\.json$", 1)
    text = lambda c: F.coalesce(_get(c, "string"), F.lit("")).alias(c)
    return x.select(F.coalesce(_get("id", "string"), name).alias("id"), F.col("file").alias("path"), text("created"), text("updated"), F.size("asked").cast("long").alias("turns"), last.alias("last_question"))


def write_json_files(rows: DataFrame, path: str) -> None:
    """rows (name, value) as text files of one value each, path/name=<name>/*.txt."""
    rows.repartition("name").write.partitionBy("name").text(path)
