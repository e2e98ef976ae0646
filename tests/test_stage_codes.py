"""The code map of a stage's histogram: it was left out, and only the number of codes was told."""

import pytest
from pyspark.sql import functions as F

from tracequarry.functions.profiles import EDA
from tracequarry.operators import logindex, logs
from tracequarry.operators.logindex import LogIndex
from tracequarry.sources.logs import classified

LINES = [
    "**WARN: (XY-1): early", "ERROR without a code", '--- Starting "place" ---', "**ERROR: (PL-7): x", "**ERROR: (PL-7): x again", "**WARN: (PL-9): y", "FATAL: (PL-7) z",
    '--- Ending "place" ---', '--- Starting "route" ---', *(f"**ERROR: (RT-{k}): r" for k in range(100)), '--- Starting "place" ---', "**ERROR: (PL-7): once more", '--- Ending "place" ---', "**WARN: (RT-5): late",
    '--- Ending "route" ---', '--- Starting "bare" ---', "an ERROR",
]


@pytest.mark.parametrize("block", [4, 65_536])
def test_stage_hist_has_all_codes_of_a_stage(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(logindex, "BLOCK", block)
    monkeypatch.setattr(logs, "BLOCK", block)
    lines = spark.createDataFrame([("a.log", i, x, None) for i, x in enumerate(LINES)], "file string, line_no long, line string, ts_s long")
    index = LogIndex(spark, str(tmp_path / "ix"), EDA)
    index.add(lines.where("line_no < 50"))
    index.add(lines.where("line_no >= 50"))
    route = {f"RT-{k}": 1 for k in range(100)} | {"RT-5": 2}
    want = {"<pre-stage>": {"XY-1": 1}, "place": {"PL-7": 4, "PL-9": 1}, "route": route, "bare": {}}
    c = classified(lines, EDA)
    for hist in (index.stage_hist(), logs.stage_hist(c, logs.stage_ranges(c))):
        got = {r.stage: (r.codes, r.n_codes, r.n_fatal + r.n_error + r.n_warn) for r in hist.collect()}
        assert {s: x[0] for s, x in got.items()} == want
        assert {s: x[1:] for s, x in got.items()} == {"<pre-stage>": (2, 2), "place": (2, 5), "route": (100, 101), "bare": (1, 1)}
    rows = index.stage_hist().select("stage", F.explode("codes").alias("code", "n")).exceptAll(index.stage_codes().select("stage", "code", "n"))
    assert rows.isEmpty()
