from pyspark.sql import functions as F

from tracequarry.functions import profiles
from tracequarry.functions.profiles import EDA, GENERIC, template, wanted
from tracequarry.operators import answers, logs, lookups, retrieval
from tracequarry.sources.logs import classified, json_records, text_lines


def lines(spark, text, file="a.log"):
    return spark.createDataFrame([(file, i, x) for i, x in enumerate(text)], "file string, line_no long, line string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_line_numbers_over_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    text = [f"line {i}\r" if i % 3 else f"x{i}" for i in range(200)]
    (tmp_path / "a.log").write_bytes("\n".join(text).encode() + b"\n")
    got = [r["line"] for r in text_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == text


def test_severity_priority_and_codes(spark):
    c = classified(lines(spark, ["**ERROR: (ABC-12): x", "WARN but error", "**WARN: (AB-1): y", "FATAL ERROR (X-1)", "fine", "éERROR"]), EDA)
    assert [r["severity"] for r in c.orderBy("line_no").collect()] == ["error", "error", "warn", "fatal", None, "error"]
    assert [r["code"] for r in c.orderBy("line_no").collect()][:4] == ["ABC-12", "(uncoded)", "AB-1", "(uncoded)"]
    g = classified(lines(spark, ["[ERROR] no", "CRITICAL: x", "E0520 klog", "[FATAL-9001] y"]), GENERIC)
    assert [(r["severity"], r["code"]) for r in g.orderBy("line_no").collect()] == [("error", "(uncoded)"), ("fatal", "(uncoded)"), ("error", "E0520"), ("fatal", "FATAL-9001")]


def test_repeats_incidents_context(spark):
    x = lines(spark, ["a", "b", "b", "b", "b", "c", "d", "d"])
    assert rows(logs.repeats(x)) == [("a.log", 1, 4)]
    c = classified(lines(spark, ["ok", "ERROR x", "  at a", "  at b", "  at c", "done"]), EDA)
    assert rows(logs.incidents(c)) == [("a.log", 1, 4, "error")]
    near = logs.context(c, F.col("line") == "ok", 1)
    assert [r["line_no"] for r in near.orderBy("line_no").collect()] == [0, 1]


def test_stages_against_a_stack(spark):
    import random

    r = random.Random(3)
    text = [f'--- {r.choice(["Starting", "Ending"])} "s{r.randrange(3)}" ---' for _ in range(300)]
    stack, want = [], []
    for i, t in enumerate(text):
        kind, name = t.split()[1], t.split('"')[1]
        if kind == "Starting":
            stack.append((name, i))
        else:
            k = next((k for k in reversed(range(len(stack))) if stack[k][0] == name), None)
            if k is not None:
                want.append(("a.log", name, stack.pop(k)[1], i, False))
    want += [("a.log", n, i, len(text), True) for n, i in stack]
    assert rows(logs.stage_ranges(lines(spark, text))) == sorted(want, key=repr)


def test_codes_and_occurrences(spark):
    c = classified(lines(spark, ["**ERROR: (IMPLF-213): x", "**WARN: (AB-1): y", "**ERROR: (IMPLF-213): z"]), EDA)
    assert rows(logs.code_table(c)) == [("a.log", "AB-1", "warn", 1, 1), ("a.log", "IMPLF-213", "error", 2, 0)]
    assert rows(logs.nth_occurrence(c, 2)) == [("a.log", "IMPLF-213", 2, 2, "head")]


def test_interpolation_clamps(spark):
    x = spark.createDataFrame([("a", i, t) for i, t in enumerate([None, 10, None, None, 40, None])], "file string, line_no long, ts_s long")
    assert [r["t"] for r in logs.interpolated(x).orderBy("line_no").collect()] == [10, 10, 20, 30, 40, 40]


def test_json_and_templates(spark):
    assert json_records(lines(spark, ['{"a": 1}', "no", "[1]"])).count() == 1
    got = lines(spark, ['**ERROR: (AB-12): file a/b.v has 3 "x" nets']).select(template(F.col("line"))).first()[0]
    assert got == "file has nets"
    assert wanted("error, FATAL/bogus") == ["error", "fatal"]


def test_retrieval_and_answers(spark):
    v = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0], [-3.0, -4.0])], "a array<float>, b array<float>, c array<float>")
    assert [round(x, 9) for x in v.select(retrieval.cosine(F.col("a"), F.col("b")), retrieval.cosine(F.col("a"), F.col("c"))).first()] == [1.0, -1.0]
    said = spark.createDataFrame([("1", "see a.log:2 and b.log:1 and a.log:9")], "id string, text string")
    total = spark.createDataFrame([("a.log", 3)], "file string, total long")
    assert [r[3] for r in rows(answers.checked(answers.citations(said), total))] == ["ok", "line out of range", "file not found"]
    sdc = lines(spark, ["set x [get_clocks core_clk]", "create_clock -name core_clk 1"])
    assert [(r["clock"], r["line_no"]) for r in answers.clock_issues(sdc).collect()] == [("core_clk", 0)]


def test_live_census(spark, tmp_path):
    from tracequarry.streaming.live import live_census

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("ERROR a\nok\nFATAL b\n")
    q = live_census(spark, str(tmp_path / "in"), EDA).writeStream.format("memory").queryName("census").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("census")) == [("error", 1), ("fatal", 1), ("none", 1)]


def test_entry_has_sql_for_its_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_stage_tiles_meet_brute_force(spark):
    import random

    from tracequarry.operators import logs

    rng = random.Random(5)
    spans = [(n, s, s + rng.choice([1, 2, 15, 16, 17, 300, 5000])) for n, s in enumerate(rng.sample(range(6000), 60))]
    lines = rng.sample(range(12000), 400)
    ranges = spark.createDataFrame([("f", f"s{n}", s, e) for n, s, e in spans], "file string, name string, start_line long, end_line long")
    severe = spark.createDataFrame([("f", i, "error", "A-1") for i in lines], "file string, line_no long, severity string, code string")
    got = {r.line_no: r.stage or "<pre-stage>" for r in logs.owners(severe.select("file", "line_no"), ranges, F.col("start_line"), -F.col("start_line")).collect()}
    want = {i: max(((s, f"s{n}") for n, s, e in spans if s <= i < e), default=(0, "<pre-stage>"))[1] for i in lines}
    assert got == want


def test_quotes_and_open_plans(spark):
    from tracequarry.operators import answers

    said = spark.createDataFrame([("a", "it says `failed to open the file now` and `src/some/long/path/file.py:12` and `no such thing anywhere`")], "id string, text string")
    results = spark.createDataFrame([("a", "x failed to open the file now y"), ("b", "no such thing anywhere")], "id string, result string")
    assert [r.quote for r in answers.unsupported(answers.quotes(said), results).collect()] == ["no such thing anywhere"]
    plan = spark.createDataFrame([("a", "[1] read_logs(path = 'x.log')\n[2] stage_errors()")], "id string, text string")
    assert [(r.step, r.call) for r in answers.todos(plan).orderBy("step").collect()] == [(1, "read_logs(path=x.log)"), (2, "stage_errors()")]


def random_log(seed, n=400):
    import random

    r = random.Random(seed)
    text = ["**ERROR: (AB-1): x", "FATAL: (CD-2) y", "**WARN: (AB-3): z", "  at frame", "", "same", "same", '--- Starting "s1" ---', '--- Ending "s1" ---', '--- Starting "s2" ---', '--- Ending "s2" ---', "see src/a.py"]
    return [r.choice(text) for _ in range(n)]


def test_results_do_not_depend_on_blocks(spark, monkeypatch):
    text = random_log(7)
    c = classified(lines(spark, text).unionByName(lines(spark, text[::-1], "b.log")), EDA).withColumn("ts_s", F.when(F.col("line_no") % 7 == 2, F.col("line_no") * 3))
    ranges = logs.stage_ranges(c)

    def every():
        found = logs.incidents(c)
        return [rows(x) for x in (logs.repeats(c), logs.repeat_of_line(c), found, logs.incident_around(found, c), logs.interpolated(c), logs.offsets(c), logs.stage_of_severe(c, ranges))]

    whole = every()
    monkeypatch.setattr(logs, "BLOCK", 11)
    assert every() == whole and all(whole)


def test_stage_errors_by_closing_order(spark):
    text = random_log(11)
    c = classified(lines(spark, text), EDA)
    open_, ranges = [], []
    for i, t in enumerate(text):
        if t.startswith("---"):
            kind, name = t.split()[1], t.split('"')[1]
            if kind == "Starting":
                open_.append((name, i))
            else:
                k = next((k for k in reversed(range(len(open_))) if open_[k][0] == name), None)
                if k is not None:
                    ranges.append((open_.pop(k)[1], i, name))
    ranges += [(i, len(text), n) for n, i in open_]
    first = {}
    for i, t in enumerate(text):
        if "ERROR" in t or "FATAL" in t:
            first.setdefault(next((n for a, b, n in ranges if a < i < b), "<pre-stage>"), i)
    got = {r["stage"]: r["line_no"] for r in logs.stage_errors(c, logs.stage_ranges(c)).collect()}
    hist = {r["stage"] for r in logs.stage_hist(c, logs.stage_ranges(c)).where("n_fatal + n_error > 0").collect()}
    assert got == {k: v for k, v in first.items() if k in hist}


def test_time_samples_like_the_greedy_rule(spark):
    from tracequarry.operators import sampling

    c = classified(lines(spark, random_log(8)), EDA).withColumn("ts_s", F.col("line_no") * 2)
    want, last = [], -20
    for r in c.orderBy("line_no").collect():
        if r["severity"] is not None or r["line_no"] - last >= 20:
            want.append(r["line_no"])
            last = r["line_no"]
    if want[-1] != 399:
        want.append(399)
    assert [r["line_no"] for r in sampling.time_samples(c, 20).orderBy("line_no").collect()] == want


def test_triage_of_quiet_and_loud_logs(spark):
    quiet = classified(lines(spark, ["fine"] * 30), EDA)
    assert [r["line_no"] for r in logs.triage(quiet, 8).orderBy("line_no").collect()] == list(range(22, 30))
    loud = classified(lines(spark, ["fine"] * 5 + ["ERROR x"] + ["fine"] * 20 + ["FATAL y"] + ["fine"] * 5), EDA)
    assert [r["line_no"] for r in logs.triage(loud, 12).orderBy("line_no").collect()] == [3, 4, 5, 6, 7, 24, 25, 26, 27, 28, 29, 30]


def test_times(spark):
    x = spark.createDataFrame([("[10:00:01  37s] a",), ("2024-05-20T14:23:01.5Z b",), ("E0520 14:23:01.250 c",), ("2024/05/20 14:23:01 d",), ("none",), ("2024-99-20 14:23:01",)], "line string")
    got = x.select(profiles.eda_seconds(F.col("line")), profiles.generic_seconds(F.col("line")), profiles.generic_seconds(F.col("line"), 2024)).collect()
    t = 1716214981
    assert list(map(tuple, got)) == [(37, None, None), (None, t, t), (None, None, t), (None, None, t), (None, None, None), (None, None, None)]


def test_citations_and_claims(spark):
    said = spark.createDataFrame([(1, "see `top.sdc` line 88, a/b.log:7 and x.log on line 3; 47 ERROR, 3 errors, 2 warnings, 5 WARNING")], "id int, text string")
    assert rows(answers.citations(said)) == [(1, "a/b.log", 7), (1, "top.sdc", 88), (1, "x.log", 3)]
    assert rows(answers.numeric_claims(said)) == [(1, "error", 47), (1, "warn", 5)]


def test_a_bad_pattern_counts_as_unmet(spark):
    said = spark.createDataFrame([("x", 1, "abc")], "id string, case_id int, text string")
    facts = spark.createDataFrame([(1, "expected", "regex", "a(b"), (1, "expected", "regex", "a.c"), (1, "expected", "sub", "BC")], "case_id int, kind string, op string, pattern string")
    assert rows(answers.case_scores(said, facts)) == [("x", 2, 1, 0, False)]


def test_lookups(spark):
    files = spark.createDataFrame([("logs/a.log",), ("logs/b.log",), ("old/a.log",)], "file string")
    wanted = spark.createDataFrame([("old/a.log",), ("x/a.log",), ("gs/b.log",), ("",), ("z.log",)], "w string")
    assert dict(rows(lookups.picked(files, wanted))) == {"old/a.log": "old/a.log", "x/a.log": "logs/a.log", "gs/b.log": "logs/b.log", "": "logs/a.log", "z.log": None}
    texts = spark.createDataFrame([("skills/one/SKILL.md", "---\nname: One\ndescription: a: b\n---\nBody here"), ("skills/two/SKILL.md", "plain")], "source string, text string")
    assert rows(lookups.skill_files(texts).drop("source")) == [("One", "a: b", "any", "Body here"), ("two", "(no description)", "any", "plain")]
    notes = spark.createDataFrame([("ok/1", "v"), ("bad key", "v"), ("none", None), ("long", "x" * 8193)], "key string, value string")
    assert dict(rows(lookups.note_errors(notes))) == {"bad key": "invalid key", "none": "no value", "long": "value too long"}
    x = spark.createDataFrame([("what does IMPLF-213 mean",), ("IMPLF-213 timing path",), ("no codes",)], "q string")
    assert [tuple(r) for r in x.select(profiles.bare_code(F.col("q")), F.size(lookups.variants(F.col("q")))).collect()] == [(True, 2), (False, 2), (False, 1)]
