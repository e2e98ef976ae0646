"""Operators by name, as a client calls them: a profile gate, and errors as rows instead of a broken session."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions.profiles import EDA, GENERIC, PROFILES, Profile
from tracequarry.operators import logs, readlog
from tracequarry.operators.logindex import LogIndex


def resolve(mode: str | None, heads: DataFrame | None = None) -> Profile:
    """The profile of a mode: its own name, or for 'auto' what the first log looks like (heads: file, detected); unknown modes are EDA."""
    mode = (mode or "").lower()
    if mode != "auto":
        return PROFILES.get(mode, EDA)
    first = heads.orderBy("file").first() if heads is not None else None  # one row
    return PROFILES[first.detected] if first else GENERIC


@dataclass(frozen=True)
class Tool:
    """run takes an index and the call's arguments; profile names the only one it is for, if there is one."""

    run: Callable[..., DataFrame]
    profile: str | None = None


def one(rows: DataFrame, file: str | None) -> DataFrame:
    return rows if file is None else rows.where(F.col("file") == file)


TOOLS = {
    "list_logs": Tool(lambda ix: ix.table("parts").groupBy("file").agg(F.sum("n").alias("n_lines"), F.floor(F.sum("bytes") / 1024).alias("kb"))),
    "read_logs": Tool(lambda ix, path, **asked: readlog.read_logs(ix, path, **asked)),
    "log_summary": Tool(lambda ix, path=None, severity="": one(readlog.log_summary(ix, severity), path)),
    "incidents": Tool(lambda ix, path=None: one(ix.incidents(), path)),
    "find_mentions": Tool(lambda ix, token, path=None: one(logs.mentions(ix.table("lines")), path).where(F.col("token").contains(token))),
    "stage_timeline": Tool(lambda ix, path=None: one(logs.timeline(ix.stage_ranges(), ix.stage_hist()), path), EDA.name),
    "stage_codes": Tool(lambda ix, path=None: one(ix.stage_codes(), path), EDA.name),
}


def failed(spark: SparkSession, error: str) -> DataFrame:
    return spark.createDataFrame([(error,)], "error string")


def call(index: LogIndex, name: str, args: dict | None = None, tools: dict[str, Tool] = TOOLS) -> DataFrame:
    """The rows of a tool, or one row `error`: unknown names, tools of another profile than the index's, and arguments that don't fit.

    A plan is made here and run by its reader, so what fails while rows are read is the reader's to handle.
    """
    tool = tools.get(name)
    if tool is None:
        return failed(index.spark, f"unknown tool {name!r}. Available: {', '.join(tools)}")
    if tool.profile not in (None, index.profile.name):
        return failed(index.spark, f"tool {name!r} requires the {tool.profile!r} profile (active: {index.profile.name!r})")
    try:
        return tool.run(index, **(args or {}))
    except Exception as e:  # whatever a tool does with a caller's arguments
        return failed(index.spark, f"running {name}: {type(e).__name__}")
