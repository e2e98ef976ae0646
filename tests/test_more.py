import zlib

import pytest
from pyspark.sql import functions as F

from tracequarry import config
from tracequarry.operators import answers, retrieval
from tracequarry.sources import documents


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_pdf_text(spark, tmp_path):
    shown = rb"BT (Chapter \(one\)) Tj T* [(Pla) -20 (cing)] TJ ET (not shown) BT (a\101\
b) ' ET"
    for name, body in (("a", shown), ("b", zlib.compress(shown))):
        (tmp_path / f"{name}.pdf").write_bytes(b"%PDF-1.4\n1 0 obj\n<<>>\nstream\n" + body + b"\nendstream\nendobj\n")
    (tmp_path / "broken.pdf").write_bytes(b"\x00\x01")
    (tmp_path / "other.txt").write_text("x")
    assert documents.by_streams(b"stream\n" + shown + b"\nendstream") == "Chapter (one)\nPlacing\naAb"
    got = documents.pdf_documents(spark, str(tmp_path)).collect()
    assert {r["source"][-5:] for r in got} == {"a.pdf", "b.pdf"}


@pytest.mark.parametrize(("line", "level"), [("IMPLF-213 unknown cell", 2), ("1 Placing cells", 1), ("1.2 Placing cells", 0), ("Adding Filler Cells", 2), ("Met1 = 3", 0), ("WIDTH 0.40", 0), ("VIA12 VIA 41 0", 0), ("plain words here", 0), ("Ab", 0), ("", 0), ("  Placing  ", 2), ("X" * 81, 0)])
def test_pdf_heading_level(spark, line, level):
    assert spark.createDataFrame([(line,)], "line string").select(retrieval.pdf_level(F.col("line"))).first()[0] == level


def test_pdf_headings_have_pages(spark):
    docs = spark.createDataFrame([("d", "Placing Cells\nx\f\nMore Cells\nx\fLast Part"), ("n", None)], "source string, text string")
    assert rows(retrieval.pdf_headings(docs).select("line_no", "page", "heading")) == [(1, 1, "Placing Cells"), (3, 2, "More Cells"), (4, 3, "Last Part")]


def test_nested_facts(spark):
    said = spark.createDataFrame([("1", 0, "Two ERRORS in a.log"), ("2", 0, None), ("3", 7, "no such case")], "id string, case_id long, text string")
    cases = [{"case_id": 0, "expected_facts": [{"any_of": ["three", {"regex": "two errors?"}]}, {"all_of": ["a.log", {"any_of": ["in", "zz"]}]}, {"regex": "("}, {"any_of": []}], "forbidden_facts": [{"all_of": ["b.log"]}, 5]}]
    assert rows(answers.nested_scores(said, cases)) == [("1", 2, 2, 0, False), ("2", 0, 4, 0, False)]


def test_settings_precedence(tmp_path):
    (tmp_path / "s.json").write_text('{"shuffle_partitions": 4, "data": "x", "bogus": 1}')
    s = config.load(str(tmp_path / "s.json"), {"data": "y", "master": None})
    assert (s.shuffle_partitions, s.data, s.master) == (4, "y", "local[*]")
    (tmp_path / "bad.json").write_text("[1")
    assert config.load(str(tmp_path / "bad.json")) == config.Settings()


def test_command_line(capsys):
    from tracequarry.__main__ import main

    main(["queries"])
    assert "code_table" in capsys.readouterr().out.split()
    with pytest.raises(SystemExit):
        main(["run", "no_such_query"])
