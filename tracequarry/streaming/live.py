"""Live forms: a census of growing logs, event windows with late data, incidents and stages as they end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracequarry.functions.profiles import STAGE, Profile


def live_census(spark: SparkSession, folder: str, profile: Profile) -> DataFrame:
    """Streaming counts per severity of all lines that arrive under folder; for complete or update mode."""
    lines = spark.readStream.option("lineSep", "\n").text(folder).withColumnRenamed("value", "line")
    return lines.groupBy(F.coalesce(profile.severity(F.col("line")), F.lit("none")).alias("severity")).agg(F.count("*").alias("n"))


def live_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and type of a stream of events (ts, event_type); rows later than `late` are left out."""
    x = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return x.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select("window.start", "window.end", "event_type", "n")


#: Lines after a severe one that can belong to its incident; how long a file may be silent before its open incident is told.
BODY, SILENCE_MS = 15, 60_000


class InOrder(StatefulProcessor):
    """Hands a file's lines on in the order of line_no, from 0, whatever order they come in; lines that came early wait as state.

    When a file was silent for `silence` ms, what waits behind missing lines is handed on too, and `end` tells what is open. A line that
    comes after its place was passed is left out.
    """

    fields: str  # of a line, beside its number
    kept: str  # of what a subclass keeps

    def __init__(self, silence: int):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getMapState("early", "line_no long", self.fields)
        self.next = handle.getValueState("next", "line_no long")
        self.open = handle.getListState("open", self.kept)

    def step(self, file: str, lines: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def end(self, file: str) -> pd.DataFrame:
        raise NotImplementedError

    def _upcoming(self) -> int:
        return int(self.next.get()[0]) if self.next.exists() else 0

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, names = self._upcoming(), [f.split()[0] for f in self.fields.split(", ")]
        new = pd.concat(list(rows))[["line_no", *names]].sort_values("line_no").drop_duplicates("line_no")
        new = new[new["line_no"] >= at]
        if len(new):
            numbers = new["line_no"].to_numpy()
            if numbers[0] == at and self.early.exists():  # those that waited may follow now
                early = pd.DataFrame([(k[0], *v) for k, v in self.early.iterator()], columns=["line_no", *names])
                new = pd.concat([new, early]).sort_values("line_no").drop_duplicates("line_no")
                self.early.clear()
                numbers = new["line_no"].to_numpy()
            ready = int(np.argmax(np.append(numbers != at + np.arange(len(numbers)), True)))
            for row in new.iloc[ready:].itertuples(index=False, name=None):
                self.early.updateValue((int(row[0]),), tuple(None if pd.isna(x) else x for x in row[1:]))
            if ready:
                self.next.update((int(numbers[ready - 1]) + 1,))
                yield self.step(key[0], new.iloc[:ready])
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.early.exists():
            names = [f.split()[0] for f in self.fields.split(", ")]
            early = pd.DataFrame([(k[0], *v) for k, v in self.early.iterator()], columns=["line_no", *names]).sort_values("line_no")
            self.early.clear()
            self.next.update((int(early["line_no"].iloc[-1]) + 1,))
            yield self.step(key[0], early)
        yield self.end(key[0])

    def close(self) -> None:
        pass


class Incidents(InOrder):
    fields, kept = "severity string, follows boolean", "head long, body_end long, severity string"

    def _told(self, file: str, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(file, *r) for r in rows], columns=["file", "head", "body_end", "severity"])

    def step(self, file: str, lines: pd.DataFrame) -> pd.DataFrame:
        before = [(int(h), int(e), s) for h, e, s in self.open.get()]  # one at most
        number, severe = lines["line_no"].to_numpy(np.int64), lines["severity"].notna().to_numpy()
        first = before[0][0] if before else -1
        head = np.maximum.accumulate(np.append(first, np.where(severe, number, -1)))[1:]
        stop = np.maximum.accumulate(np.append(first, np.where(severe | ~lines["follows"].to_numpy(bool), number, -1)))[1:]
        inside = (head >= 0) & (head == stop) & (number - head <= BODY)
        ends = {h: (e, s) for h, e, s in before}
        for h, s in zip(number[severe].tolist(), lines["severity"][severe].tolist(), strict=True):
            ends[h] = h, s
        for h, e in pd.Series(number[inside]).groupby(head[inside]).max().items():
            ends[h] = int(e), ends[h][1]
        last = int(head[-1])
        if last >= 0 and last == stop[-1] and number[-1] - last < BODY:
            self.open.put([(last, *ends.pop(last))])
        else:
            self.open.clear()
        return self._told(file, [(h, *e) for h, e in sorted(ends.items())])

    def end(self, file: str) -> pd.DataFrame:
        rows = [(int(h), int(e), s) for h, e, s in self.open.get()]
        self.open.clear()
        return self._told(file, rows)


class Stages(InOrder):
    fields, kept = "kind string, name string", "name string, start_line long"

    def step(self, file: str, lines: pd.DataFrame) -> pd.DataFrame:
        open_, told = [(n, int(s)) for n, s in self.open.get()], []
        banners = lines[lines["kind"] != ""]
        for number, kind, name in zip(banners["line_no"].tolist(), banners["kind"], banners["name"], strict=True):  # banners are rare
            if kind == "Starting":
                open_.append((name, number))
                continue
            k = next((k for k in reversed(range(len(open_))) if open_[k][0] == name), None)
            if k is not None:
                told.append((file, name, open_.pop(k)[1], number, False))
        self.open.put(open_) if open_ else self.open.clear()
        return pd.DataFrame(told, columns=["file", "name", "start_line", "end_line", "incomplete"])

    def end(self, file: str) -> pd.DataFrame:
        """Stages still open end where the file does, as far as it is known."""
        rows = [(file, n, int(s), self._upcoming(), True) for n, s in self.open.get()]
        self.open.clear()
        return pd.DataFrame(rows, columns=["file", "name", "start_line", "end_line", "incomplete"])


def live_incidents(lines: DataFrame, silence: int = SILENCE_MS) -> DataFrame:
    """file, head, body_end, severity of the incidents of a stream of classified lines (file, line_no, line, severity), when they are over.

    An incident is over when a line ends it, its body is full, or its file was silent for so many ms.
    """
    follows = F.coalesce("line", F.lit("")).rlike(r"^[ \t]|^\s*$").alias("follows")
    rows = lines.select("file", "line_no", "severity", follows)
    return rows.groupBy("file").transformWithStateInPandas(Incidents(silence), "file string, head long, body_end long, severity string", "Append", "ProcessingTime")


def live_stages(lines: DataFrame, silence: int = SILENCE_MS) -> DataFrame:
    """file, name, start_line, end_line, incomplete of the stages of a stream of lines (file, line_no, line).

    A stage is told when its closing banner comes, or, as incomplete, when its file was silent for so many ms.
    """
    part = lambda k: F.regexp_extract("line", STAGE, k)
    rows = lines.select("file", "line_no", part(1).alias("kind"), part(2).alias("name"))
    return rows.groupBy("file").transformWithStateInPandas(Stages(silence), "file string, name string, start_line long, end_line long, incomplete boolean", "Append", "ProcessingTime")
