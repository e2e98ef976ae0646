"""Live relations against their batch forms, with lines shuffled over triggers."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tracequarry.functions.profiles import EDA
from tracequarry.operators import logs
from tracequarry.sources.logs import classified
from tracequarry.streaming import live

TEXT = ["**ERROR: (AB-1): x", "FATAL: y", "**WARN: z", "  at frame", "", "plain", "plain", '--- Starting "s1" ---', '--- Ending "s1" ---', '--- Starting "s2" ---', '--- Ending "s2" ---']
SCHEMA = "file string, line_no long, line string"


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, folder, make, parts, enough, name):
    """Rows of make(stream of lines) when the parts came one after another, each in its own trigger."""
    (folder / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.json(str(folder / f"part{k}"))
        next((folder / f"part{k}").glob("*.json")).rename(folder / "in" / f"{k:03d}.json")
        time.sleep(0.02)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "cp")).trigger(processingTime="200 milliseconds").start()
    began = time.time()
    while time.time() - began < 120 and spark.table(name).count() < enough and q.isActive:
        time.sleep(0.5)
    time.sleep(1.5)  # nothing more may come
    rows = sorted(tuple(map(str, r)) for r in spark.table(name).collect())
    q.stop()
    return rows


def shuffled_log(seed, n=120):
    r = random.Random(seed)
    lines = [(f, i, r.choice(TEXT)) for f in ("a", "b") for i in range(n)]
    lines += [("a", n + k, "  at frame") for k in range(3)] + [("b", n, "ERROR last")]
    late = r.sample(lines, len(lines))
    parts = [late[i::5] for i in range(5)]
    return lines, parts + [parts[0][:7]]  # some lines come twice


def test_incidents_are_those_of_the_whole_log(rocks, tmp_path):
    lines, parts = shuffled_log(1)
    want = sorted(tuple(map(str, r)) for r in logs.incidents(classified(rocks.createDataFrame(lines, SCHEMA), EDA)).collect())
    got = run(rocks, tmp_path, lambda s: live.live_incidents(classified(s, EDA), 4000), parts, len(want), "live_incidents")
    assert got == want


def test_stages_are_those_of_the_whole_log(rocks, tmp_path):
    lines, parts = shuffled_log(2)
    want = sorted(tuple(map(str, r)) for r in logs.stage_ranges(rocks.createDataFrame(lines, SCHEMA)).collect())
    got = run(rocks, tmp_path, lambda s: live.live_stages(s, 4000), parts, len(want), "live_stages")
    assert got == want


def test_missing_lines_are_passed_after_silence(rocks, tmp_path):
    lines = [("a", i, x) for i, x in enumerate(["ERROR a", "  b", "gone", "plain", "FATAL c", "\td"])]
    got = run(rocks, tmp_path, lambda s: live.live_incidents(classified(s, EDA), 1500), [[x for x in lines if x[1] != 2]], 2, "live_missing")
    assert got == [("a", "0", "1", "error"), ("a", "4", "5", "fatal")]


def test_windows(spark, tmp_path):
    schema = "ts timestamp, event_type string"
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", t) for h, m, t in [(0, 5, "x"), (0, 50, "x"), (0, 59, "y"), (1, 0, "x"), (3, 30, "y"), (5, 0, "x"), (9, 0, "z")]]
    late = [("2024-01-01 01:10:00", "x"), ("2024-01-01 09:30:00", "z")]
    (tmp_path / "in").mkdir()
    between = [("2024-01-01 09:01:00", "z")]  # lateness is told by the watermark of the trigger before
    for k, part in enumerate((rows, between, late, [("2024-01-02 00:00:00", "end")])):
        spark.createDataFrame(part, "ts string, event_type string").coalesce(1).write.json(str(tmp_path / f"p{k}"))
        next((tmp_path / f"p{k}").glob("*.json")).rename(tmp_path / "in" / f"{k}.json")
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = live.live_windows(stream).writeStream.format("memory").queryName("live_windows").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = sorted((r.start.hour, r.event_type, r.n) for r in spark.table("live_windows").where(F.col("start") < "2024-01-02").collect())
    assert got == [(0, "x", 2), (0, "y", 1), (1, "x", 1), (3, "y", 1), (5, "x", 1), (9, "z", 3)]  # the row of 1:10 came too late
