"""Samples of a log's times: greedy jumps over timed lines, put together from blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a file that one task jumps over; tests use few.
BLOCK = 65_536


def chain(lines: np.ndarray, severe: np.ndarray, last: np.ndarray, gap: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """From each last sampled line: the last one after the block, and the lines sampled in it, step by step (-1: none any more).

    A sample is the next severe line, or the first that is `gap` lines on, whichever comes first.
    """
    at = np.append(lines, np.iinfo(np.int64).max)
    next_severe = np.append(np.minimum.accumulate(np.where(severe, np.arange(len(lines)), len(lines))[::-1])[::-1], len(lines)) if len(lines) else np.zeros(1, np.int64)
    steps = []
    while True:
        after = np.searchsorted(lines, last, side="right")
        k = np.minimum(next_severe[after], np.searchsorted(lines, last + gap))
        ok = k < len(lines)
        if not ok.any():
            return last, steps
        steps.append(np.where(ok, at[k], -1))
        last = np.where(ok, at[k], last)


def time_samples(c: DataFrame, gap: int = 100) -> DataFrame:
    """file, line_no, ts_s: timed lines that are severe or `gap` lines or more after the sample before, and each file's end.

    c: file, line_no, severity, ts_s. Lines without a time are never sampled; the first that has one is. A file whose last line isn't
    sampled gets it as a row with the file's last time, as the line to which times go. What a block makes of an earlier sample depends only
    on how far back it is, in steps up to gap: each block tells what comes out for each of these, the blocks of a file are linked by that,
    and each block then samples from what really goes in.
    """
    # Severe lines that count are errors and warnings alike: whatever has a severity.
    x = c.select("file", F.floor(F.col("line_no") / BLOCK).alias("block"), "line_no", F.col("severity").isNotNull().alias("severe"), "ts_s")
    timed = x.where("ts_s is not null")

    def out(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("line_no")
        first = int(key[1]) * BLOCK
        states = first - gap + np.arange(gap)  # the last sample's line; anything earlier is as the first of these
        end, _ = chain(frame["line_no"].to_numpy(), frame["severe"].to_numpy(), states, gap)
        return pd.DataFrame({"file": [key[0]], "block": [key[1]], "ends": [end.tolist()]})

    maps = timed.select("file", "block", "line_no", "severe").groupBy("file", "block").applyInPandas(out, "file string, block long, ends array<long>")

    def link(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame, last, enters = frame.sort_values("block"), -gap, []
        for block, ends in zip(frame["block"], frame["ends"], strict=True):
            enters.append(last)
            last = int(ends[max(0, last - (int(block) * BLOCK - gap))])
        return pd.DataFrame({"file": key[0], "block": frame["block"], "enter": enters})

    # A row a block of a file is linked by one task: numbers of `gap` entries for each 65,536 lines.
    enter = maps.groupBy("file").applyInPandas(link, "file string, block long, enter long")

    def sampled(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("line_no")
        _, steps = chain(frame["line_no"].to_numpy(), frame["severe"].to_numpy(), frame["enter"].to_numpy()[:1], gap)
        lines = np.array([s[0] for s in steps], np.int64)
        times = frame["ts_s"].to_numpy()[np.searchsorted(frame["line_no"].to_numpy(), lines)]
        return pd.DataFrame({"file": key[0], "line_no": lines, "ts_s": times})

    found = timed.join(enter, ["file", "block"]).groupBy("file", "block").applyInPandas(sampled, "file string, line_no long, ts_s long")
    last = x.groupBy("file").agg(F.max("line_no").alias("line_no"), F.max_by("ts_s", F.when(F.col("ts_s").isNotNull(), F.col("line_no"))).alias("ts_s")).where("ts_s is not null")
    return found.unionByName(last.join(found.select("file", "line_no"), ["file", "line_no"], "left_anti"))
