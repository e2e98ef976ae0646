"""Scans that stop early: blocks of a stored log are read in order until enough lines are found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines that the first round reads; each further one reads twice as many.
FIRST = 65_536


def early_stop(lines: DataFrame, hit: Column, total: int, context: int = 0, most: int = 200, first: int = FIRST) -> DataFrame:
    """line_no, line, is_hit of one log's lines that hit, with `context` lines around, up to where `most` lines are reached.

    lines (line_no, line) are stored in the order of line_no, so a range of them is a range of the table: rounds of ranges, each twice as
    long, are searched until the lines chosen reach `most`; later ranges are never read. The scan ends at the hit that reaches it, or, with
    context, after the lines that follow the last hit without another hit among them: then all are returned, which can be more than `most`.
    total: the log's lines. A line_no occurs once.
    """
    start, size, found, cut = 0, first, [], None
    while start < total and cut is None:
        end = min(total, start + size)
        while True:  # hits come in portions of `most`, as long as those at hand don't tell where the scan ends
            after = F.col("line_no") > (max(start - 1, found[-1]) if found else start - 1)
            some = [r.line_no for r in lines.where(after & (F.col("line_no") < end)).where(hit).select("line_no").orderBy("line_no").limit(most).collect()]
            found += some
            cut = stop(found, context, most, total)
            sure = cut is not None and cut <= found[-1]
            if sure or len(some) < most:
                break
        if not sure and (cut is None or cut >= end) and end < total:
            cut = None  # a hit of the next range can still be near
        start, size = end, size * 2
    last = total if cut is None else cut + 1
    chosen = sorted({k for h in found if h < last for k in range(max(0, h - context), min(last, h + context + 1))})
    if not chosen:
        return lines.where("false").select("line_no", "line", F.lit(True).alias("is_hit"))
    near = lines.sparkSession.createDataFrame([(k, k in set(found)) for k in chosen], "line_no long, is_hit boolean")
    asked = lines.where((F.col("line_no") >= chosen[0]) & (F.col("line_no") <= chosen[-1]))
    return asked.join(F.broadcast(near), "line_no").select("line_no", "line", "is_hit")


def stop(hits: list[int], context: int, most: int, total: int) -> int | None:
    """The line at which the scan ends, or None while it goes on; hits: the first ones, in order."""
    chosen, until = 0, -1
    for k, h in enumerate(hits):
        chosen += h + 1 - max(until + 1, h - context, 0)
        until = h
        if not context and chosen >= most:
            return h
        following = hits[k + 1] if k + 1 < len(hits) else None
        end = min(h + context, total - 1)
        if following is None or following > end:
            chosen += end - h
            until = end
            if chosen >= most:
                return end
        else:
            chosen += following - h - 1
            until = following - 1
    return None
