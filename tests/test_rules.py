"""Samples of times, early stops and typed records against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracequarry.operators import answers, records, sampling, scan
from tracequarry.operators.records import LEVEL_FIELDS, MESSAGE_FIELDS, SKIPPED, SPELLINGS


def plain_samples(rows, gap):
    """rows: line_no, severity, ts_s of one file."""
    out, last, latest = [], -gap, None
    for n, severity, ts in rows:
        if ts is not None:
            latest = ts
            if severity is not None or n - last >= gap:
                out.append((n, ts))
                last = n
    if out and out[-1][0] != rows[-1][0]:
        out.append((rows[-1][0], latest))
    return out


@pytest.mark.parametrize("block,gap", [(64, 5), (16, 30), (65_536, 10)])
def test_samples_over_blocks(spark, monkeypatch, block, gap):
    monkeypatch.setattr(sampling, "BLOCK", block)
    r = random.Random(block)
    files = {}
    for f, timed, severe in (("often", 0.9, 0.02), ("rare", 0.05, 0.3), ("never", 0.0, 0.5), ("one", 1.0, 0.0), ("gaps", 0.5, 0.01)):
        files[f] = [(i, r.choice(["warn", "fatal"]) if r.random() < severe else None, 1000 + i if r.random() < timed and not (f == "gaps" and i // 90 % 2) else None) for i in range(1 if f == "one" else 300)]
    df = spark.createDataFrame([(f, *x) for f, rows in files.items() for x in rows], "file string, line_no long, severity string, ts_s long").repartition(3)
    got = {}
    for x in sampling.time_samples(df, gap).collect():
        got.setdefault(x.file, []).append((x.line_no, x.ts_s))
    for f, rows in files.items():
        assert sorted(got.get(f, [])) == plain_samples(rows, gap), f


def plain_scan(hits, total, context, most):
    sel, fwd, recent = set(), 0, []
    for i in range(total):
        if i in hits:
            sel |= {*recent, i}
            fwd = context
        elif fwd > 0:
            sel.add(i)
            fwd -= 1
        recent = [*recent, i][-context:] if context else []
        if len(sel) >= most and fwd == 0:
            break
    return sorted(sel)


@pytest.mark.parametrize("context", [0, 1, 3])
def test_scans_stop_where_the_plain_one_does(spark, context):
    r = random.Random(context)
    for total, share, most, first in [(0, 0.5, 5, 4), (40, 0.0, 5, 4), (200, 0.05, 12, 8), (200, 0.9, 7, 5), (200, 0.3, 1000, 64), (120, 0.6, 20, 1000)]:
        hits = {i for i in range(total) if r.random() < share}
        df = spark.createDataFrame([(i, "hit" if i in hits else "no") for i in range(total)], "line_no long, line string")
        got = scan.early_stop(df, F.col("line") == "hit", total, context, most, first).collect()
        assert sorted(x.line_no for x in got) == plain_scan(hits, total, context, most), (total, share, most)
        assert all(x.is_hit == (x.line_no in hits) for x in got)


def test_later_lines_are_not_read(spark):
    df = spark.range(0, 100_000, 1, 8).select(F.col("id").alias("line_no"), F.when(F.col("id") >= 2000, F.raise_error(F.lit("read too far"))).when(F.col("id") % 10 == 3, "hit").otherwise("no").alias("line"))
    assert scan.early_stop(df, F.col("line") == "hit", 100_000, 2, 60, 100).count() == 60
    with pytest.raises(Exception, match="read too far"):
        scan.early_stop(df, F.col("line") == "hit", 100_000, 2, 6000, 100).count()


def plain_severity(o):
    for k in LEVEL_FIELDS:
        if isinstance(v := o.get(k), (str, int)):
            return next((s for s, names in SPELLINGS.items() if str(v).lower() in names), "")
    return ""


def plain_message(o):
    for k in MESSAGE_FIELDS:
        if isinstance(o.get(k), str):
            return o[k]
    parts = []
    for k, v in o.items():
        if k not in SKIPPED and not isinstance(v, (dict, list)):
            parts.append(f"{k}={v!r}"[:60])
            if sum(map(len, parts)) > 160:
                break
    return " ".join(parts)


def test_records_by_type(spark):
    r = random.Random(6)
    values = ["ERR", "panic", "Warning ", "info", 3, 4, 0, 99, 1.5, True, None, {"a": 1}, [1], "it's", 'say "x"', "both ' and \"", "back\\slash", "tab\t", "", "w" * 80]
    keys = [*LEVEL_FIELDS, *MESSAGE_FIELDS, "ts", "a", "b", "c", "d"]
    objects = [{k: r.choice(values) for k in r.sample(keys, r.randrange(6))} for _ in range(400)]
    lines = [(i, json.dumps(o)) for i, o in enumerate(objects)] + [(900, "[1]"), (901, "no"), (902, "{broken"), (903, None)]
    got = {x.i: (x.s, x.m) for x in records.typed(spark.createDataFrame(lines, "i int, line string")).select("i", records.severity(F.col("o")).alias("s"), records.message(F.col("o")).alias("m")).collect()}
    assert got == {i: (plain_severity(o), plain_message(o)) for i, o in enumerate(objects)}


def test_clocks_of_ports(spark):
    text = ["create_clock -period 2 [get_ports clk]", "set_x [get_clocks clk] [get_clocks late]", "create_clock [get_ports a] -name late", "set_y [get_clocks a] [get_clocks {b c}] # [get_clocks d]", "recreate_clock -name z"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(text)], "file string, line_no long, line string")
    assert sorted((x.clock, x.line_no, x.declared) for x in answers.clock_issues(df).collect()) == [("a", 3, None), ("late", 1, 2)]


def test_profiles_of_modes(spark):
    from tracequarry.functions.profiles import EDA, GENERIC
    from tracequarry.operators.contract import resolve

    heads = spark.createDataFrame([("b.log", "eda"), ("a.log", "generic")], "file string, detected string")
    assert [resolve(m) for m in ("eda", "GENERIC", "bogus", None)] == [EDA, GENERIC, EDA, EDA]
    assert (resolve("auto", heads), resolve("auto", heads.where("file = 'b.log'")), resolve("auto")) == (GENERIC, EDA, GENERIC)
