"""Operators 11 to 13: against the library, all runs by comparison, and plain rounds."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from tracequarry.llm import op11_sentencepiece as o11
from tracequarry.llm import op12_periodic_runs as o12
from tracequarry.llm import op13_vector_codes as o13

P = pytest.importorskip("public_tokenizers")
S = pytest.importorskip("sentencepiece")
from sentencepiece import sentencepiece_model_pb2 as pb  # noqa: E402

MODEL = P.path("piece_bpe_32k.model")
SIGNS = [" ", "  ", "▁", "\n", "a", "é", "ß", "漢", "😀", "ﬁ", "①", "　", "Ａ", "́", "e", "\0", "<s>", "<0x0A>", "the", "�", "ｶﾞ", "\t", "½", "\xad", "​"]
CLASH = "doc_id long, text string, ids string, decoded string, runs int, x int"


def sign_texts(n, seed=1):
    r = random.Random(seed)
    return ["", " ", "▁", "\n" * 3, "x" * 3000, "漢" * 2000, "word " * 20000] + ["".join(r.choices(SIGNS, k=r.randrange(25))) for _ in range(n)]


def model(rule=None, trim=False, prefix=True):
    """The public model, with another library normaliser if a rule is named."""
    m = pb.ModelProto()
    with open(MODEL, "rb") as f:
        m.ParseFromString(f.read())
    if rule:
        n = pb.ModelProto()
        n.ParseFromString(S.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=True, remove_extra_whitespaces=trim).serialized_model_proto())
        m.normalizer_spec.CopyFrom(n.normalizer_spec)
    return m.SerializeToString()


@pytest.mark.parametrize("rule,trim,prefix", [(None, False, True), ("nmt_nfkc", True, True), ("nmt_nfkc", False, False), ("nfkc_cf", True, False)])
def test_ids_spans_and_texts_are_the_library_s(rule, trim, prefix):
    data = model(rule, trim, prefix)
    own, lib = o11.Model(data), S.SentencePieceProcessor(model_proto=data)
    texts = sign_texts(600)
    for text, (ids, limits) in zip(texts, own.encode(texts), strict=True):
        proto = lib.encode(text, return_type="proto")
        assert ids.tolist() == lib.encode(text)
        assert list(zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True)) == [(p.begin, p.end) for p in proto.pieces]
        assert own.decode(ids.tolist()) == lib.decode(ids.tolist())
    r = random.Random(2)
    for _ in range(400):  # ids that no text gives: lone bytes, control and unknown pieces
        ids = [r.randrange(300) if r.random() < 0.7 else r.randrange(32000) for _ in range(r.randrange(12))]
        assert own.decode(ids) == lib.decode(ids)


def test_models_that_are_not_known_are_refused():
    m = pb.ModelProto()
    m.ParseFromString(model())
    m.trainer_spec.byte_fallback = False
    with pytest.raises(ValueError):
        o11.Model(m.SerializeToString())


def test_encode_keeps_rows(spark):
    lib = S.SentencePieceProcessor(model_file=MODEL)
    texts = [None, *sign_texts(40), "same", "same"]
    rows = [(None if i == 3 else i // 2, t, "clash", "clash", 1, 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, CLASH).repartition(3)
    got = o11.decode(o11.encode(df, MODEL), MODEL).collect()
    want = [(r[0], lib.encode(r[1] or ""), lib.decode(lib.encode(r[1] or ""))) for r in rows]
    assert sorted(((g.doc_id, g.ids, g.decoded) for g in got), key=str) == sorted(want, key=str)
    for g in got:
        assert len(g.begins) == len(g.ends) == len(g.ids) and g.begins[1:] == g.ends[:-1]
    assert o11.decode(o11.encode(df.limit(0), MODEL), MODEL).collect() == []


def all_runs(c, least, times):
    """Every maximal stretch with a period, by comparison; its period must be the smallest."""

    def smallest(x):
        return next(q for q in range(1, len(x) + 1) if all(x[i] == x[i + q] for i in range(len(x) - q)))

    out, n = [], len(c)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if c[i] != c[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and c[i] == c[i + q]:
                i += 1
            size = i - a + q
            if size >= max(least, times * q) and smallest(c[a : a + size]) == q:
                out.append((a, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(r):
    k, n = r.choice([1, 2, 2, 3, 5]), r.randrange(70)
    c = [r.randrange(k) for _ in range(n)]
    if r.random() < 0.6 and n > 6:
        p, a = r.randrange(1, 8), r.randrange(n)
        c = [c[i] if i < a else c[min(n - 1, a + (i - a) % p)] for i in range(n)]
    return c + c if r.random() < 0.3 else c


@pytest.mark.parametrize("part", [2048, 3])
def test_runs_are_all_runs(monkeypatch, part):
    monkeypatch.setattr(o12, "PART", part)
    r = random.Random(part)
    for _ in range(1500):
        c, least = repetitive(r), r.choice([3, 6, 9, 12, 24])
        assert o12.runs_of(np.array(c, np.int32), least) == all_runs(c, least, 3)


def test_a_word_a_hundred_thousand_times():
    assert o12.runs_of(np.zeros(100_000, np.int32)) == [(0, 100_000, 1)]


def test_query_of_runs(spark, tmp_path):
    r = random.Random(7)
    texts = [None, "", " \n", "a " * 23, "a " * 24, "a b c " * 8 + "a", "x" * 4000] + [" ".join(f"w{k}" for k in repetitive(r)) + r.choice(["", "\n", " "]) for _ in range(300)]
    texts += [" ".join(r.choice("abcdefgh") for _ in range(200)) for _ in range(60)]
    rows = [(None if i == 50 else i, t, "c", "c", 1, 2) for i, t in enumerate(texts)] + [(7, "a b " * 20, "c", "c", 1, 2)] * 2
    spark.createDataFrame(rows, CLASH).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc, text, *_ in rows:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if doc is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = all_runs(words, 24, 3)
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        told = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((doc, len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    got = [tuple(x)[:8] for x in o12.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[1] for w in want) > 60
    assert o12.find_runs(spark.createDataFrame([], CLASH)).collect() == []


def plain_codes(rows, rounds=2):
    kept = [(i, [math.floor(256 * float(c)) for c in e], label) for i, e, label in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 16
    part = lambda x, p: x[p * w : (p + 1) * w]
    books = [[part(r[1], p) for r in kept[:64]] for p in range(16)]
    for k in range(rounds + 1):
        near = [[min((sum((a - b) ** 2 for a, b in zip(part(r[1], p), e, strict=True)), j) for j, e in enumerate(books[p])) for p in range(16)] for r in kept]
        for p in range(16) if k < rounds else ():
            for j in range(len(books[p])):
                own = [part(r[1], p) for r, x in zip(kept, near, strict=True) if x[p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    error, by = [sum(d for d, _ in x) for x in near], {}
    for r, e in zip(kept, error, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    end = 2**63 - 1
    return [(r[0], "".join(f"{j:02x}" for _, j in x), min(e, end), min(by[r[2]], end), digest) for r, x, e in zip(kept, near, error, strict=True)]


def made(kind, rng):
    if kind == "unit":
        v = rng.normal(size=32)
        return (v / np.linalg.norm(v)).astype(np.float32).astype(float).tolist()
    if kind == "ties":
        return (rng.integers(-2, 3, size=32) / 256).tolist()
    return (rng.normal(size=16) * 10.0 ** rng.integers(0, 38)).astype(np.float32).astype(float).tolist()


@pytest.mark.parametrize("kind,n", [("unit", 250), ("ties", 250), ("huge", 150), ("unit", 20)])
def test_codes_are_those_of_plain_rounds(spark, kind, n):
    rng = np.random.default_rng(n)
    rows = [(int(i), made(kind, rng), int(rng.integers(4)) if i % 5 else None) for i in rng.permutation(n)]
    rows += rows[:15] + [(None, made(kind, rng), 1), (9000, None, 1), (9001, [None] + made(kind, rng)[1:], 1), (9002, [float("nan")] + made(kind, rng)[1:], 1), (9003, [float("inf")] + made(kind, rng)[1:], 1)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    found, books = o13.vector_codes(df)
    got = [(*r, books.digest()) for r in o13.with_label_errors(found).select("vec_id", "code", "error", "label_error").collect()]
    assert sorted(got, key=str) == sorted(plain_codes(rows), key=str)


def test_bounds_spare_most_distances():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(2000, 64))
    x = np.floor(256 * v / np.linalg.norm(v, axis=1)[:, None]).astype(np.int64).reshape(2000, 16, 4)
    books = o13.Codebooks(x[:64].swapaxes(0, 1).copy())
    state, all_ = o13.assign(books, x, None)
    entry = state[0]
    means = np.array([[x[entry[:, p] == k, p].sum(0) // (entry[:, p] == k).sum() for k in range(64)] for p in range(16)])
    moved = np.sqrt(((means - books.entries) ** 2).sum(-1).astype(float)) * (1 + 1e-9)
    after = o13.Codebooks(means, "i8", moved)
    again, some = o13.assign(after, x, state)
    whole, _ = o13.assign(after, x, None)
    assert (again[0] == whole[0]).all() and some < 0.1 * all_
    exact = np.sqrt(((x[:, :, None, :] - means[None]) ** 2).sum(-1).astype(float))
    for p in range(16):  # bounds are bounds
        assert (o13.steps(again[2][:, p], again[3][:, p]) <= exact[:, p]).all() and (again[1][:, p] >= exact[np.arange(2000), p, again[0][:, p]]).all()


def test_vectors_that_cannot_be_cut(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert o13.vector_codes(spark.createDataFrame([], schema))[0].collect() == []
    found, books = o13.vector_codes(spark.createDataFrame([(1, [1.0, 2.0], 1)], schema))
    assert books is None and found.first().code is None
    found, books = o13.vector_codes(spark.createDataFrame([(1, [0.5] * 16, 1), (2, [0.5] * 32, 1), (3, [], 1)], schema))
    assert {r.vec_id: r.code for r in found.collect()} == {1: "00" * 16, 2: None, 3: None}


def test_license_words_far_apart_are_no_statement(spark):
    from tracequarry.llm import op8_license_scan as o8

    far = lambda words, fill: " ".join(w + (" " + fill) * 250 for w in words.split())
    texts = ["mot " * 500 + far("released under the mit license", "mot") + " mot" * 500, far("dedicated to the public domain under cc0", "wort"), "x " * 17 + "Released under the MIT license" + " x" * 90]
    got = {r.doc_id: (r.labels, r.score) for r in o8.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ("", 0.0), 1: ("", 0.0), 2: ("mit", 1.0)}


def test_trees_are_built_once_a_shard(spark, monkeypatch):
    from tracequarry.llm import op4_ball_tree as o4

    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(700)] + [(50, rng.normal(size=8).tolist()) for _ in range(600)]  # many vectors of one id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    built, searched = [], []
    trees, found_by = o4.trees, o4.found_by
    monkeypatch.setattr(o4, "trees", lambda data: built.append(1) or trees(data))
    monkeypatch.setattr(o4, "found_by", lambda *a: searched.append(len(a[1])) or found_by(*a))
    monkeypatch.setattr(o4, "QUERY_BLOCK", 100)
    got = {}
    for r in o4.top_products(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert len(built) == 1 and len(searched) == 2 * -(-614 // 100)  # the block's first trees, and the rest
    assert o4.trees(o4.whole_numbers(df)).count() == 3
    whole = {}
    for i, e in rows:
        whole.setdefault(i, []).append(np.floor(256 * np.float32(e).astype(float)))
    for q in range(0, 700, 50):
        best = sorted((-max(int(a @ b) for a in whole[q] for b in v), i) for i, v in whole.items() if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_the_query_takes_texts_without_ids(spark, tmp_path):
    """An empty text has no last piece: under ANSI rules element_at failed the whole query there."""
    spark.createDataFrame([(1, ""), (2, None), (3, "a b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in o11.op11_sentencepiece(spark, str(tmp_path)).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert [tuple(rows[i])[1:] for i in (1, 2)] == [(0, nothing, nothing, 0)] * 2
    assert rows[3].n_tokens == len(S.SentencePieceProcessor(model_file=MODEL).encode("a b")) and rows[3].n_bytes == 3
