"""Hybrid ranking against plain scores of all pairs, and what it writes on the way."""

import math
import random
import re

import pytest

from tracequarry.operators import retrieval
from tracequarry.plans.registry import QUERIES


def plain(docs, queries, vectors, asked, k):
    """docs, queries, vectors, asked: lists of (id, text or vector); ids may recur in docs, vectors and asked."""
    words = lambda x: re.findall("[a-z0-9_]+", x.lower()) if x is not None else []
    post, lens = {}, [len(words(x)) for _, x in docs if x is not None]
    for i, x in docs:
        for t in words(x):
            post[i, len(words(x)), t] = post.get((i, len(words(x)), t), 0) + 1
    df, n, mean = {}, len(docs), sum(lens) / len(lens)
    for _, _, t in post:
        df[t] = df.get(t, 0) + 1
    bm = {}
    for q, x in queries:
        for t in words(x):
            for (i, size, u), tf in post.items():
                if t == u and len(t) > 1:
                    bm[q, i] = bm.get((q, i), 0) + math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    pairs = [(q, i, bm.get((q, i), 0.0), cosine(a, b)) for q, a in asked for i, b in vectors]
    pairs += [(q, i, s, 0.0) for (q, i), s in bm.items() if not any(x[:2] == (q, i) for x in pairs)]
    out = []
    for q in {p[0] for p in pairs}:
        own = [p for p in pairs if p[0] == q]
        scale = lambda x, c: (x - min(c)) / (max(c) - min(c)) if max(c) > min(c) else 0.0
        b, c = [p[2] for p in own], [p[3] for p in own]
        best = sorted((-round(0.5 * scale(p[2], b) + 0.5 * scale(p[3], c), 6), p[1]) for p in own)[:k]
        out += [(q, i, -r) for r, i in best]
    return sorted(out)


@pytest.mark.parametrize("seed,cells,block", [(1, 1 << 20, 16_384), (2, 40, 3), (3, 7, 2)])
def test_hybrid_equals_plain_scores(spark, monkeypatch, seed, cells, block):
    """Recurring ids, equal vectors, ids with a text or a vector only, null and empty ones, other lengths, queries of either kind."""
    monkeypatch.setattr(retrieval, "CELLS", cells)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    r = random.Random(seed)
    text = lambda: r.choice([None, "", *(" ".join(r.choices(["Ab", "bc", "x", "cd", "de", "ef_1"], k=r.randrange(1, 12))) for _ in range(9))])
    vector = lambda: r.choice([None, [0.0] * 3, [1.0, 2.0], [1.0, 1.0, 0.0], [float(r.randrange(-3, 4)) for _ in range(3)], [float(r.randrange(-3, 4)) for _ in range(3)]])
    docs = [(r.randrange(60), text()) for _ in range(50)]
    queries = [(i, text()) for i in (0, 5, 10, 70, 75)]
    vectors = [(r.randrange(20, 90), vector()) for _ in range(50)]
    asked = [(i, v) for i, v in [*vectors, (5, [1.0, 0.0, 2.0])] if i % 5 == 0]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = retrieval.hybrid(table(docs, "id long, text string"), table(queries, "qid long, text string"), table(vectors, "id long, embedding array<float>"), table(asked, "qid long, embedding array<float>"), 5)
    best = {}
    for x in got.collect():
        best.setdefault(x.qid, []).append((-x.score, x.id))
    got = sorted((q, i, -s) for q, rows in best.items() for s, i in sorted(rows)[:5])
    want = plain(docs, queries, vectors, asked, 5)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=2e-6)


def test_hybrid_query_shuffles_no_pairs(spark, tmp_path):
    """All pairs of queries and vectors were joined and grouped by shuffles, which filled the disk: 50,000 pairs here."""
    r = random.Random(5)
    spark.createDataFrame([(i, f"word{i % 3} other") for i in range(20)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "word1"), (20, "other word2")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, [r.random() for _ in range(4)]) for i in range(1000)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    sc = spark.sparkContext

    def shuffled():
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = shuffled()
    assert len(QUERIES["hybrid_rank"](spark, str(tmp_path)).collect()) == 250
    assert shuffled() - before < 15_000
