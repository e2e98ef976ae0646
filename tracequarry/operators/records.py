"""JSON log records: severity and message by the types of their fields."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields that name a record's level and its message, the levels' spellings, fields that a summary leaves out, and its lengths.
LEVEL_FIELDS = ("level", "severity", "lvl", "log.level", "loglevel")
MESSAGE_FIELDS = ("msg", "message", "text", "event")
SPELLINGS = {"fatal": ("fatal", "critical", "crit", "emerg", "emergency", "panic", "0", "1", "2"), "error": ("error", "err", "severe", "exception", "3"), "warn": ("warn", "warning", "warning ", "4")}
SKIPPED = ("@timestamp", "ts", "time", "level", "severity", "lvl")
PART, SUMMARY = 60, 160


def typed(lines: DataFrame) -> DataFrame:
    """lines with o, the typed values of each line's JSON object by field, in their order; other lines are left out."""
    is_object = F.ltrim("line").startswith("{")
    return lines.withColumn("o", F.when(is_object, F.from_json("line", "map<string,variant>"))).where("o is not null")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def severity(o: Column) -> Column:
    """fatal, error, warn or '' by the first level field that is text, a whole number or a truth value; other types are passed over."""

    def told(value: Column) -> Column:
        text = F.lower(value.cast("string"))
        out = F.lit("")
        for name, spellings in reversed(SPELLINGS.items()):
            out = F.when(text.isin(*spellings), name).otherwise(out)
        return out

    each = [F.when(kind(o[f]).isin("STRING", "BIGINT", "BOOLEAN"), told(o[f])) for f in LEVEL_FIELDS]
    return F.coalesce(*each, F.lit(""))


def shown(value: Column) -> Column:
    """A value as a summary shows it: text in quotes, single ones unless it has some and no double ones."""
    text = value.cast("string")
    escaped = functools.reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")), text)
    double = text.contains("'") & ~text.contains('"')
    quoted = F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))
    k = kind(value)
    return F.when(k == "STRING", quoted).when(k == "BOOLEAN", F.initcap(text)).when(k == "VOID", "None").otherwise(text)


def message(o: Column) -> Column:
    """The first message field that is text; else the plain fields as name=value, each cut, up to the one that exceeds the summary's length."""
    named = F.coalesce(*(F.when(kind(o[f]) == "STRING", o[f].cast("string")) for f in MESSAGE_FIELDS))
    nested = lambda v: kind(v).startswith("OBJECT") | kind(v).startswith("ARRAY")
    plain = F.filter(F.map_entries(o), lambda e: ~e["key"].isin(*SKIPPED) & ~F.coalesce(nested(e["value"]), F.lit(False)))
    parts = F.transform(plain, lambda e: F.left(F.concat(e["key"], F.lit("="), F.coalesce(shown(e["value"]), F.lit("None"))), F.lit(PART)))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))
    joined = F.aggregate(parts, start, lambda s, p: F.when(s["n"] > SUMMARY, s).otherwise(F.struct(F.concat(s["text"], F.when(s["n"] > 0, " ").otherwise(""), p).alias("text"), (s["n"] + F.length(p)).alias("n"))))
    return F.coalesce(named, joined["text"])
