"""Stored tables: what is there after changes, refusals, failed writes; the vector cache computes misses only."""

import pytest
from pyspark.sql import functions as F

from tracequarry.sources.keyed import KeyedTable, Notes, Plans, VectorCache

SAVES = "project string, key string, value string, at int"


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_changes_rewrite_touched_parts_only_and_failed_ones_nothing(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "k string, v int", ["k"], 8)
    t.change(spark.createDataFrame([(f"k{i}", i, False) for i in range(40)] + [(None, 7, False)], "k string, v int, gone boolean"))
    before, content = t._folders(), rows(t.read())
    assert len(content) == 41 and len(before) == 8
    t.change(spark.createDataFrame([("k3", 99, False), ("k3x", 5, False)], "k string, v int, gone boolean"))
    assert 6 <= sum(before[p] == f for p, f in t._folders().items())
    with pytest.raises(Exception, match="broken"):
        t.change(spark.createDataFrame([("k4", 1, False)], "k string, v int, gone boolean").withColumn("v", F.raise_error(F.lit("broken")).cast("int")))
    want = {f"k{i}": i for i in range(40)} | {"k3": 99, "k3x": 5, None: 7}
    assert rows(t.read()) == sorted((str(k), str(v)) for k, v in want.items())
    t.change(t.read().where("k is null or k <> 'k9'").withColumn("gone", F.lit(True)))
    assert rows(t.read()) == [("k9", "9")]


def test_notes(spark, tmp_path):
    notes = Notes(spark, str(tmp_path / "n"))
    many = [("p", f"key{i:03d}", f"v{i}", i) for i in range(99)]
    assert rows(notes.save(spark.createDataFrame(many + [("q", "a", "one\ntwo", 1), ("q", "bad key", "x", 1), ("q", "long", "x" * 8193, 1), ("q", None, "x", 1)], SAVES))) == [("q", "None", "invalid key"), ("q", "bad key", "invalid key"), ("q", "long", "value too long")]
    refused = notes.save(spark.createDataFrame([("p", "new1", "x", 1), ("p", "new2", "y", 2), ("p", "new3", "z", 3), ("p", "key000", None, 9), ("p", "key001", "again", 1), ("p", "key001", "last", 2), ("p", "never", None, 1)], SAVES))
    assert rows(refused) == [("p", "new3", "more than 100 keys")]  # one was deleted, two fit
    got = {r.key: r.value for r in notes.table.read().where("project = 'p'").collect()}
    assert len(got) == 100 and got["key001"] == "last" and "key000" not in got and {"new1", "new2"} <= set(got)
    assert rows(notes.listing().where("project = 'q'")) == [("q", "a", "7", "one...")]
    assert rows(notes.save(spark.createDataFrame([], SAVES))) == []


def test_plans(spark, tmp_path):
    plans = Plans(spark, str(tmp_path / "p"))
    schema = "plan string, tasks array<string>"
    refused = plans.create(spark.createDataFrame([("a", ["one", " two "]), ("b", []), ("c", ["x"] * 21), ("d", ["x", " "]), ("e", None), ("f", ["t" * 200] * 3)], schema))
    assert rows(refused) == [("b", "no tasks"), ("c", "more than 20 tasks"), ("d", "empty task"), ("e", "no tasks")]
    assert rows(plans.update(spark.createDataFrame([("a", 1, "done", " ok "), ("a", 2, "lost", ""), ("a", 9, "done", ""), ("f", 1, None, "r" * 300)], "plan string, idx int, status string, result string"))) == [("a", "2", "no such status"), ("a", "9", "no such task")]
    assert rows(plans.extend(spark.createDataFrame([("a", ["three", "", "four"]), ("z", ["x"]), ("f", ["x"] * 18)], schema))) == [("f", "more than 20 tasks"), ("z", "no plan")]
    assert rows(plans.table.read().where("plan = 'a'")) == [("a", "1", "one", "done", "ok"), ("a", "2", "two", "pending", ""), ("a", "3", "three", "pending", ""), ("a", "5", "four", "pending", "")]
    assert rows(plans.counts()) == [("a", "3", "0", "1", "0", "4"), ("f", "3", "0", "0", "0", "3")]
    assert {(len(r.text), len(r.result)) for r in plans.table.read().where("plan = 'f'").collect()} == {(160, 240), (160, 0)}
    plans.create(spark.createDataFrame([("a", ["new"])], schema))
    assert rows(plans.table.read().where("plan = 'a'")) == [("a", "1", "new", "pending", "")]


def test_vectors_are_computed_once(spark, tmp_path):
    cache, seen = VectorCache(spark, str(tmp_path / "v"), "m"), spark.sparkContext.accumulator(0)

    def compute(missed):
        def run(frames):
            for f in frames:
                seen.add(len(f))
                f["vector"] = [[float(len(t)), 1.0] for t in f["text"]]
                yield f[["key", "vector"]]

        return missed.mapInPandas(run, "key string, vector array<float>")

    texts = spark.createDataFrame([("a",), ("bb",), ("a",), (None,), ("",)], "text string")
    got = {(r.text, tuple(r.vector) if r.vector else None) for r in cache.vectors(texts, compute).collect()}
    assert got == {("a", (1.0, 1.0)), ("bb", (2.0, 1.0)), (None, None), ("", (0.0, 1.0))} and seen.value == 3
    assert cache.vectors(texts, compute).count() == 5 and seen.value == 3
    assert cache.vectors(spark.createDataFrame([("ccc",), ("a",)], "text string"), compute).count() == 2 and seen.value == 4
    name = cache.store.begin()  # another writer that computed the same
    cache.store.write(spark.createDataFrame([(r.key, r.vector) for r in cache.store.read("vectors", "key string, vector array<float>").collect()], "key string, vector array<float>"), name, "vectors")
    cache.store.commit(name)
    assert cache.vectors(texts, compute).count() == 5
    cache.compact()
    assert len(cache.store.commits()) == 1 and cache.store.read("vectors", "key string, vector array<float>").count() == 4
    assert VectorCache(spark, str(tmp_path / "v"), "other").vectors(texts, compute).count() == 5 and seen.value == 7


def test_folders_of_json_files(spark, tmp_path):
    from tracequarry.sources import jsonfiles

    good = '{"id": "one",\n "log_path": "a.log", "question": "q", "expected_facts": ["x", {"any_of": ["y", {"regex": "z+"}]}], "max_steps": 3}'
    for name, text in {"b.json": good, "a.json": good.replace("one", "two"), "broken.json": "{", "list.json": "[1]", "no_id.json": '{"log_path": "a", "question": "q"}', "other.txt": good}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "s.json").write_text('{"history": [{"role": "user", "text": "' + "w" * 80 + '"}, {"role": "tool", "name": "t", "result": "r"}]}')
    got = jsonfiles.cases(spark, str(tmp_path)).orderBy("file").collect()
    assert [(r.id, r.mode, r.max_steps) for r in got] == [("two", "eda", 3), ("one", "eda", 3)]
    assert [c["expected_facts"] for c in jsonfiles.case_facts(jsonfiles.cases(spark, str(tmp_path), "on"))] == [["x", {"any_of": ["y", {"regex": "z+"}]}]]
    assert jsonfiles.bad_files(spark, str(tmp_path)).first().n == 4
    assert [(r.id, r.turns, r.last_question, r.created) for r in jsonfiles.sessions(spark, str(tmp_path)).where("turns > 0").collect()] == [("s", 1, "w" * 60, "")]
