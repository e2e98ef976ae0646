"""Reading one log as a user asks for it: first or last lines, a pattern, severities, or a view of what went wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.functions.profiles import wanted
from tracequarry.operators import logs, lookups
from tracequarry.operators.logindex import LogIndex
from tracequarry.operators.scan import early_stop


def chosen(index: LogIndex, file: str, head: int | None = None, tail: int | None = None, pattern: str | None = None, severity: str = "", context: int = 2, most: int = 200) -> DataFrame:
    """line_no, line of the lines asked for: the first of head, tail, pattern (of a severity, if one is named) and severity that is given.

    Patterns and severities come with context. With none of them it is the triage view. Names that are no severity are passed over.
    """
    names = wanted(severity)
    all_ = index.table("lines").where(F.col("file") == file)
    lines = all_.select("line_no", "line")
    if not (head or tail or pattern or names):
        return logs.triage(all_.select("file", "line_no", "line", "severity"), most, context, clip=most + 1).select("line_no", "line")
    total = index.totals().where(F.col("file") == file).first()  # one log's number
    n = total.total if total else 0
    if head:
        return lines.where(F.col("line_no") < head)
    if tail:
        return lines.where(F.col("line_no") >= n - tail)
    if pattern:
        hit = F.col("line").rlike(f"(?i){pattern}")
        return early_stop(lines, hit & index.profile.any_severity(F.col("line"), names) if names else hit, n, context, most + 1).select("line_no", "line")
    hits = all_.where(F.col("severity").isin(*names)).select("file", "line_no")
    return all_.join(logs.near(hits, context), ["file", "line_no"], "left_semi").select("line_no", "line")


def read_logs(index: LogIndex, file: str, most: int = 200, **asked) -> DataFrame:
    """line_no, line, n, run_first, gap, clipped: the first `most` lines chosen, runs of equal lines as one.

    n, run_first: the run that a line stands for. gap: lines before it are left out. clipped: there is more than `most`.
    """
    rows = chosen(index, file, most=most, **asked)
    order = Window.orderBy("line_no")  # `most` + 1 lines
    x = rows.orderBy("line_no").limit(most + 1).withColumns({"k": F.row_number().over(order), "before": F.lag("line_no").over(order)})
    x = x.crossJoin(F.broadcast(x.agg((F.count("*") > most).alias("clipped")))).where(F.col("k") <= most)  # one row
    runs = index.repeats().where(F.col("file") == file).select(F.col("first_line").alias("run_first"), "n")
    low = F.broadcast(x.agg(F.min("line_no").alias("low"), F.max("line_no").alias("high")))  # one row
    near = runs.crossJoin(low).where("run_first <= high and run_first + n > low").drop("low", "high")
    x = x.join(near, (F.col("line_no") >= F.col("run_first")) & (F.col("line_no") < F.col("run_first") + F.col("n")), "left")
    x = x.withColumn("gap", F.col("before").isNotNull() & (F.col("before") != F.col("line_no") - 1))
    again = F.col("run_first").isNotNull() & ~F.col("gap") & F.coalesce(F.col("before") >= F.col("run_first"), F.lit(False))
    return x.where(~again).select("line_no", "line", "n", "run_first", "gap", "clipped")


def header(index: LogIndex, file: str, shown: DataFrame) -> DataFrame:
    """total, n_fatal, n_error, n_warn of a log, and unseen: its severe lines that aren't among those shown (line_no)."""
    severe = index.table("lines").where((F.col("file") == file) & F.col("severity").isin("fatal", "error")).select("line_no")
    seen = severe.join(shown.select("line_no").distinct(), "line_no", "left_semi").agg(F.count("*").alias("seen"))
    x = index.census().where(F.col("file") == file).crossJoin(F.broadcast(seen))  # one row
    return x.select("total", "n_fatal", "n_error", "n_warn", (F.col("n_fatal") + F.col("n_error") - F.col("seen")).alias("unseen"))


def log_summary(index: LogIndex, severity: str = "") -> DataFrame:
    """file, code, severity, n, first_line, example of the codes of the severities named anywhere in `severity`, all if it is empty."""
    names = [s for s in ("fatal", "error", "warn") if not severity or s in severity.lower()]
    codes = index.code_table().where(F.col("severity").isin(*names))
    first = lookups.fetched(index.table("lines"), codes.select("file", F.col("first_line").alias("line_no")))
    x = codes.join(first.select("file", F.col("line_no").alias("first_line"), F.left(F.trim("line"), F.lit(110)).alias("example")), ["file", "first_line"])
    return logs.code_order(x.select("file", "code", "severity", "n", "first_line", "example"))
