"""The stored index against whole logs: however lines arrive, and whatever a failed update left."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tracequarry.functions.profiles import EDA
from tracequarry.operators import logindex, logs
from tracequarry.operators.logindex import LogIndex
from tracequarry.sources.logs import classified
from tracequarry.sources.numbering import numbered

SCHEMA = "file string, line_no long, line string, ts_s long"
TEXT = ["**ERROR: (AB-1): x", "FATAL: (CD-2) y", "**WARN: (AB-3): z", "  at frame", "  at frame", "", "same", "same", "same", '--- Starting "s1" ---', '--- Ending "s1" ---', '--- Starting "s2" ---', '--- Ending "s2" ---', "see src/a.py", "ERROR in lib/b.v"]


def random_logs(seed, n):
    r = random.Random(seed)
    out = []
    for file in ("a.log", "b.log"):
        line = r.choice(TEXT)
        for i in range(n):
            line = line if r.random() < 0.3 else r.choice(TEXT)
            out.append((file, i, line, 1000 + i if i % 3 else None))
    return out


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def whole(spark, lines):
    c = classified(spark.createDataFrame(lines, SCHEMA), EDA)
    ranges = logs.stage_ranges(c)
    return {
        "census": logs.census(c), "code_table": logs.code_table(c), "repeats": logs.repeats(c), "incidents": logs.incidents(c), "stage_ranges": ranges,
        "stage_hist": logs.stage_hist(c, ranges), "mention_counts": logs.mention_counts(c),
        "code_hits": c.where("severity is not null").groupBy("file", "code").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("line_no")).alias("h")).select("file", "code", "n", F.slice("h", 1, 16), F.reverse(F.slice(F.reverse("h"), 1, 16))),
        "spans": c.where("ts_s is not null").groupBy("file").agg(F.min("ts_s"), F.max("ts_s")),
    }


@pytest.mark.parametrize("block,steps", [(65_536, 3), (7, 1), (5, 3)])
def test_updates_give_the_index_of_the_whole(spark, tmp_path, monkeypatch, block, steps):
    monkeypatch.setattr(logindex, "BLOCK", block)
    lines = random_logs(block * 10 + steps, 150)
    r = random.Random(steps)
    index = LogIndex(spark, str(tmp_path / "ix"), EDA)
    cuts = {f: sorted([0, *(r.randrange(150) for _ in range(steps - 1)), 150]) for f in ("a.log", "b.log")}
    for k in range(steps):
        index.add(spark.createDataFrame([x for x in lines if cuts[x[0]][k] <= x[1] < cuts[x[0]][k + 1]], SCHEMA))
    for name, want in whole(spark, lines).items():
        assert rows(getattr(index, name)()) == rows(want), name
    assert index.table("lines").count() == len(lines)
    if (block, steps) == (5, 3):
        index.compact()
        assert len(index.store.commits()) == 1
        for name in ("census", "repeats", "incidents", "stage_hist", "code_hits"):
            assert rows(getattr(index, name)()) == rows(whole(spark, lines)[name]), name


def test_an_update_reads_no_earlier_line_and_failed_ones_leave_no_trace(spark, tmp_path):
    lines = random_logs(1, 60)
    index = LogIndex(spark, str(tmp_path / "ix"), EDA)
    index.add(spark.createDataFrame([x for x in lines if x[1] < 40], SCHEMA))
    before = rows(index.census())
    bad = spark.createDataFrame([x for x in lines if x[1] >= 40], SCHEMA).withColumn("line", F.when(F.col("line_no") == 55, F.raise_error(F.lit("gone"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="gone"):
        index.add(bad)
    assert rows(index.census()) == before
    for f in (tmp_path / "ix").rglob("lines/**/*.parquet"):  # earlier lines can't be read any more
        f.write_bytes(b"")
    index.add(spark.createDataFrame([x for x in lines if x[1] >= 40], SCHEMA))
    for name, want in whole(spark, lines).items():
        assert rows(getattr(index, name)()) == rows(want), name


def test_rows_are_numbered_over_ranges(spark):
    r = random.Random(4)
    data = [(r.choice(["a", "a", "a", None]), i) for i in r.sample(range(10_000), 700)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = numbered(spark.createDataFrame(data, "k string, v int").repartition(5), ["k"], ["v"], "n").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {(k, v): n for k in ("a", None) for n, v in enumerate(sorted(v for x, v in data if x == k))}
    assert {(x.k, x.v): x.n for x in got} == want and len(got) == len(data)


def test_segments_are_read_once(spark, tmp_path):
    text = [x[2] for x in random_logs(9, 80) if x[0] == "a.log"]
    folder = tmp_path / "logs" / "file=a.log"
    folder.mkdir(parents=True)
    (folder / "0001.txt").write_text("\n".join(text[:30]) + "\n")
    (folder / "0002.txt").write_text("\n".join(text[30:50]))  # its last line has no end
    index = LogIndex(spark, str(tmp_path / "ix"), EDA)
    assert index.update(str(tmp_path / "logs")) == 2
    for name in ("0001.txt", "0002.txt"):  # an attempt to read these again would fail, or give other lines
        stamp = (folder / name).stat()
        (folder / name).write_bytes(b"FATAL\n" * 3 + b"x" * (stamp.st_size - 18))
        os.utime(folder / name, ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    (folder / "0003.txt").write_text("\n".join(text[50:]) + "\n")
    (tmp_path / "logs" / "alone.log").write_text("ERROR x\n")
    assert index.update(str(tmp_path / "logs")) == 2
    assert index.update(str(tmp_path / "logs")) == 0
    want = whole(spark, [("a.log", i, x, None) for i, x in enumerate(text)])
    for name in ("census", "repeats", "incidents", "stage_ranges"):
        assert [r for r in rows(getattr(index, name)()) if r[0] == "a.log"] == rows(want[name]), name
    assert [r.line for r in index.table("lines").where("file = 'a.log'").orderBy("line_no").collect()] == text
    (folder / "0003.txt").write_text("other")
    with pytest.raises(ValueError, match="changed"):
        index.update(str(tmp_path / "logs"))


@pytest.mark.parametrize("block", [4, 64])
def test_stages_over_blocks_without_broadcasts(spark, tmp_path, monkeypatch, block):
    """Banners and severe lines grow with a log: what is open is found by blocks, and no side of that join goes through the driver."""
    monkeypatch.setattr(logindex, "BLOCK", block)
    monkeypatch.setattr(logs, "BLOCK", block)
    lines = random_logs(block, 700)
    index = LogIndex(spark, str(tmp_path / "ix"), EDA)
    index.add(spark.createDataFrame(lines, SCHEMA))
    open_, hist, codes = {}, {}, {}
    for file, i, line, _ in lines:
        stack = open_.setdefault(file, [])
        if line.startswith("---"):
            kind, name = line.split()[1], line.split('"')[1]
            if kind == "Starting":
                stack.append(name)
            elif name in stack:
                del stack[len(stack) - 1 - stack[::-1].index(name)]
        code = next((c for c in ("AB-1", "CD-2", "AB-3") if f"({c})" in line), "(uncoded)" if line.startswith("ERROR") else None)
        if code:
            stage = stack[-1] if stack else "<pre-stage>"
            h = hist.setdefault((file, stage), [0, 0, 0, set()])
            h[{"CD-2": 0, "AB-3": 2}.get(code, 1)] += 1
            h[3].add(code)
            codes[file, stage, code] = codes.get((file, stage, code), 0) + 1
    assert {(r.file, r.stage, r.code): r.n for r in index.stage_codes().collect()} == {k: n for k, n in codes.items() if k[2] != "(uncoded)"}
    got = {(r.file, r.stage): (r.n_fatal, r.n_error, r.n_warn, r.n_codes) for r in index.stage_hist().collect()}
    assert got == {k: (*h[:3], len(h[3])) for k, h in hist.items()}
    met = logs.owners(index.table("lines").select("file", "line_no"), index.table("banners").select("file", "name", F.col("line_no").alias("start_line"), (F.col("line_no") + 3 * block).alias("end_line")), F.col("start_line"), -F.col("start_line"))
    assert "Join" not in met._jdf.queryExecution().optimizedPlan().toString()
