"""Chunks by the plain rule, search against plain scores, and questions about codes."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tracequarry.functions.profiles import template
from tracequarry.operators import passages
from tracequarry.operators.passages import PassageIndex

DOCS = "source string, text string"


def plain_chunks(lines):
    """lines: (number, page, level, text); level 0 is text."""
    out, stack, buf, start = [], ["", "", ""], [], None

    def flush():
        text = "\n".join(buf).strip()
        if text:
            out.append((" > ".join(s for s in stack if s.strip()) or "(no heading)", text, *start))
        buf.clear()

    for number, page, level, text in lines:
        if level:
            flush()
            stack[level - 1 :] = [text.strip()] + [""] * (3 - level)
        else:
            start = start if buf else (number, page)
            buf.append(text)
            if sum(map(len, buf)) > 1200:
                flush()
    flush()
    return out


def marked(raw):
    for n, line in enumerate(raw.splitlines(), 1):
        m = re.match(r"^(#{1,6})\s+(.*)", line)
        yield (n, None, min(len(m[1]), 3), m[2]) if m else (n, None, 0, line)


def random_docs(seed, n=80):
    r = random.Random(seed)

    def line():
        x = r.random()
        if x < 0.08:
            return "#" * r.randrange(1, 8) + r.choice([" ", "\t", ""]) + f"Head {r.randrange(9)}"
        return "" if x < 0.2 else "é word " * r.randrange(1, 60) if x < 0.9 else "z" * r.randrange(1100, 1400)

    docs = [(f"d{i}", r.choice(["\n", "\r\n", "\n"]).join(line() for _ in range(r.randrange(120))) + r.choice(["", "\n"])) for i in range(n)]
    return [*docs, ("empty", ""), ("null", None), ("heads", "# a\n## b\n"), ("blank", "\n\n\n"), ("long", "x" * 5000 + "\ny\n" + "w " * 3000), ("feed", "a\x0cb\x85c d\rend")]


def by_source(df):
    got = {}
    for c in df.collect():
        got.setdefault(c.source, []).append((c.heading, c.text, c.start_line, c.page))
    return {k: sorted(v, key=lambda x: x[2]) for k, v in got.items()}


def test_chunks_of_marked_texts(spark):
    docs = random_docs(1)
    got = by_source(passages.chunks(passages.text_lines_of(spark.createDataFrame(docs, DOCS).repartition(3))))
    assert got == {s: w for s, t in docs if (w := plain_chunks(marked(t or "")))}


def test_chunks_of_pages(spark):
    r = random.Random(2)
    pick = ["\f", "\fplain words here", "Design Setup", "2 Placing", "ABC-12 message", "word " * 100, "x = 3", "", "\f\f \f", "B\f tail", "3 Third Thing"]
    docs = [(f"d{i}", "\n".join(r.choice(pick) for _ in range(r.randrange(60)))) for i in range(40)]
    level = {"Design Setup": 2, "2 Placing": 1, "ABC-12 message": 2, "3 Third Thing": 1}

    def lines(text):
        page = 1
        for n, raw in enumerate(text.split("\n"), 1):
            page += raw.count("\f")
            line = raw.replace("\f", "")
            if line == raw or line.strip():
                yield n, page, level.get(line, 0), line

    got = by_source(passages.chunks(passages.paged_lines_of(spark.createDataFrame(docs, DOCS).repartition(2))))
    assert got == {s: w for s, t in docs if (w := plain_chunks(lines(t)))}


def words(text):
    return re.findall("[a-z0-9_]+", text.lower())


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    r = random.Random(3)
    vocabulary = [f"w{int(r.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(f"s{i // 5:03d}", r.choice(["(no heading)", "Head one", "A > B"]), " ".join(r.choices(vocabulary, k=r.randrange(1, 60))), i % 5 + 1, None) for i in range(600)]
    index = PassageIndex(spark, str(tmp_path_factory.mktemp("passages") / "ix")).build(spark.createDataFrame(rows, passages.CHUNKS).repartition(4))
    return index, sorted(rows, key=lambda x: (x[0], x[3])), vocabulary


def plain_search(rows, query, k):
    bags = [words(("" if h == "(no heading)" else h) + " " + t) for _, h, t, *_ in rows]
    avg, scores = sum(map(len, bags)) / len(bags), []
    q = [t for t in words(query) if len(t) > 1]
    df = {t: sum(t in b for b in bags) for t in set(q)}
    for i, b in enumerate(bags):
        s = sum(math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * b.count(t) * 2.5 / (b.count(t) + 1.5 * (0.25 + 0.75 * len(b) / avg)) for t in q if t in b)
        if s > 0:
            scores.append((-round(s, 6), i))
    return [(i, -s) for s, i in sorted(scores)[:k]]


def test_search_skips_blocks_and_finds_the_same(spark, built):
    index, rows, vocabulary = built
    r = random.Random(5)
    asked = [(i, " ".join(r.choices(vocabulary, k=r.randrange(1, 8)))) for i in range(30)] + [(90, ""), (91, "a"), (92, "nothing_like_it"), (93, "head head one w1 w1"), (94, rows[7][2])]
    df = spark.createDataFrame(asked, "qid long, text string")
    got = {}
    for x in index.search(df, 5).collect():
        got.setdefault(x.qid, []).append((x.id, x.score))
    for qid, text in asked:
        assert sorted(got.get(qid, []), key=lambda x: (-x[1], x[0])) == plain_search(rows, text, 5), text
    once = sorted({w for x in rows for w in words(x[2])}, key=lambda w: sum(w in words(x[2]) for x in rows))[:3]
    asked = index.words(spark.createDataFrame([(0, " ".join(once) + " w1 w2")], "qid long, text string"))
    assert index.candidates(asked, 1).count() <= 4 < -(-len(rows) // passages.RANGE)  # w1 and w2 are in every range


def test_questions_about_codes(spark, built):
    index, rows, _ = built
    codes = spark.createDataFrame([("AB-1", "**ERROR: (AB-1): " + rows[3][2]), ("AB-2", "NOTE (AB-2) two words")], "code string, line string")
    asked = spark.createDataFrame([(1, "what does AB-1 mean"), (2, "AB-2"), (3, "ZZ-9"), (4, rows[3][2] + " E0520")], "qid long, text string")
    got = {}
    for x in passages.search_manual(index, asked, codes).collect():
        got.setdefault(x.qid, []).append(x)
    assert got[1][0].query == rows[3][2] and any(x.source == rows[3][0] and x.start_line == rows[3][3] for x in got[1])
    assert [(x.rank, x.source, x.score) for x in got[2] + got[3]] == [(0, None, 0.0)] * 2  # too few words to stand for the code
    assert all(x.score >= 20 for k in (1, 4) for x in got[k])


def test_messages(spark):
    lines = ["ERR: (AB-12): Met1 in /a/b+c failed 3", "  **note x2y 12.5 \"q\" it's", "(  AB_C-9 ) : 0xFFg 0x1f v1.2.3", "Error text 'x' - end.", f"WARN '{'w' * 81}' kept"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "l string").select(template(F.col("l"))).collect()]
    assert got == ["Met1 in failed", "x2y it's", "0xFFg v1", "text - end", f"'{'w' * 81}' kept"]


def test_postings_are_made_when_a_search_asks_for_them(spark, tmp_path):
    """Reports on chunks took the time of an index of all words; a search's few words are no reason to deal all blocks by token."""
    import os

    rows = [(f"d{i:03}", passages.NO_HEADING, f"common w{i % 7} only{i}", 1, None) for i in range(150)]
    index = passages.PassageIndex(spark, str(tmp_path / "ix")).build(spark.createDataFrame(rows, passages.CHUNKS))
    assert index.chunks().count() == 150 and not os.path.exists(tmp_path / "ix" / "postings")
    asked = spark.createDataFrame([(1, "only77"), (2, "common w3")], "qid long, text string")
    found = index.search(asked, 3).collect()
    assert sorted((r.qid, r.id) for r in found) == [(1, 77), (2, 3), (2, 10), (2, 17)]
    words = index.words(asked)
    ranges = spark.createDataFrame([(1, 1)], "qid long, range long")
    plan = index.scores(words, ranges)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
    top = passages.blocks_of(spark.createDataFrame([(i, 3, ["a", "a", f"b{i % 2}"]) for i in range(100)], "id long, len long, tokens array<string>"), 3.0, 4)
    got = {(r.token, r.range): (len(r.ids), set(r.tfs), len(r.top)) for r in top.collect()}
    assert got == {("a", 0): (64, {2}, 4), ("a", 1): (36, {2}, 0), ("b0", 0): (32, {1}, 4), ("b0", 1): (18, {1}, 0), ("b1", 0): (32, {1}, 4), ("b1", 1): (18, {1}, 0)}


@pytest.mark.parametrize("k", [None, 2])
def test_cosines_a_few_queries_at_a_time(spark, monkeypatch, k):
    """A worker held the cosines of all queries with a batch, 0.5 GB and its copies for 16,384 queries."""
    from tracequarry.operators import retrieval

    monkeypatch.setattr(retrieval, "CELLS", 40)
    vectors = [(i, None if i == 4 else [float(i % 5), 1.0, float(i % 3)][: 2 if i == 7 else 3]) for i in range(20)]
    v = spark.createDataFrame(vectors, "id long, embedding array<double>").coalesce(1)
    got = {(r.qid, r.id): r.cos for r in retrieval.similar(v, v.withColumnRenamed("id", "qid"), k).collect()}
    want = {}
    for q, a in vectors:
        for i, b in vectors:
            sound = a is not None and b is not None and len(a) == len(b)
            want[q, i] = sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5 if sound else 0.0
    if k is None:
        assert got.keys() == want.keys()
    for q, _ in vectors:
        kth = sorted((want[q, i] for i, _ in vectors), reverse=True)[(k or 20) - 1]
        assert {i for i, _ in vectors if want[q, i] > kth - 1e-6} <= {i for x, i in got if x == q}
    assert all(abs(c - want[key]) < 1e-9 for key, c in got.items())
