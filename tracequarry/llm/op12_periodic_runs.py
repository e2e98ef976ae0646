"""Runs of repeated words: maximal stretches that repeat their first `period` words at least TIMES times, found by a suffix automaton.

Of each text only stretches in which every GRAM words recur can hold a run (a run of LEAST words or more, TIMES periods long, repeats each
of its grams), so the automaton is built over those stretches; equal hashes that aren't equal grams only make a stretch longer. The
automaton's states are visited from the longest on, and each merges its ordered set of end positions into its link's, the smaller into the
larger. Positions a distance d apart that meet in a state first have exactly that state's length of words before them in common: if d
doesn't exceed it, they end two equal neighbours of d words, a square. Squares of one distance that reach back to one start are one run: it
goes on to d words after the last of them. A distance that a run's smaller period divides is no period of its own.

Nulls and empty texts have no words and no runs. Repeated rows each get their row, null ids stay null, other columns are not looked at, an
empty table gives an empty result. Texts are taken whole; a state has four integers, and sets of many positions are kept in parts, so a text
of one word a million times takes seconds.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, read, text_of

LEAST, TIMES = 24, 3
#: Words of the grams that must recur; a third of LEAST, so that no gram of a run stands alone.
GRAM = LEAST // 3
#: Positions in one part of a large set.
PART = 2048

Run = tuple[int, int, int]  # start, length, period


class Ends:
    """An ordered set of many positions, in parts."""

    def __init__(self, positions: list[int]):
        self.parts = [positions[i : i + PART] for i in range(0, len(positions), PART)]
        self.heads = [p[0] for p in self.parts]
        self.size = len(positions)

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[int]:
        return (x for p in self.parts for x in p)

    def around(self, x: int) -> tuple[int | None, int | None]:
        k = bisect_right(self.heads, x) - 1
        if k < 0:
            return None, self.heads[0]
        part = self.parts[k]
        i = bisect_right(part, x)
        return part[i - 1], part[i] if i < len(part) else self.heads[k + 1] if k + 1 < len(self.heads) else None

    def add(self, x: int) -> None:
        k = max(0, bisect_right(self.heads, x) - 1)
        part = self.parts[k]
        insort(part, x)
        self.size += 1
        if len(part) > 2 * PART:
            self.parts[k : k + 1] = [part[:PART], part[PART:]]
            self.heads[k : k + 1] = [part[0], part[PART]]
        else:
            self.heads[k] = part[0]


def automaton(codes: list[int]) -> tuple[array, array]:
    """Of each state of the suffix automaton: the length of its longest word and its link; state 0 is the start."""
    length, link = array("i", [0]), array("i", [-1])
    letter, target = array("i", [-1]), array("i", [0])  # a state's first transition; others are in `more`
    more: dict[int, dict[int, int]] = {}
    last = 0
    for i, c in enumerate(codes):
        new = len(length)
        length.append(i + 1)
        link.append(0)
        letter.append(-1)
        target.append(0)
        p, q = last, -1
        while p >= 0:
            if letter[p] < 0:
                letter[p], target[p] = c, new
            elif letter[p] == c:
                q = target[p]
                break
            else:
                rest = more.get(p)
                if rest is None:
                    more[p] = {c: new}
                elif c in rest:
                    q = rest[c]
                    break
                else:
                    rest[c] = new
            p = link[p]
        if q >= 0 and length[q] == length[p] + 1:
            link[new] = q
        elif q >= 0:
            twin = len(length)
            length.append(length[p] + 1)
            link.append(link[q])
            letter.append(letter[q])
            target.append(target[q])
            if q in more:
                more[twin] = dict(more[q])
            while p >= 0:
                if letter[p] == c:
                    if target[p] != q:
                        break
                    target[p] = twin
                elif p in more and more[p].get(c) == q:
                    more[p][c] = twin
                else:
                    break
                p = link[p]
            link[q] = link[new] = twin
        last = new
    return length, link


def squares(codes: list[int]) -> dict[tuple[int, int], int]:
    """Of each (start, distance): the last end of a square's first half that reaches back to the start."""
    length, link = automaton(codes)
    # Of states of one length only one holds a new position: the first that was made, as twins are made after.
    sets: dict[int, list[int] | Ends] = {}
    longest, state = -1, 0
    order = np.argsort(-np.frombuffer(length, np.int32), kind="stable").tolist()
    for state in range(1, len(length)):
        if length[state] > longest:
            longest = length[state]
            sets[state] = [longest - 1]
    found: dict[tuple[int, int], int] = {}
    for state in order:
        up = link[state]
        own = sets.pop(state, None)
        if up <= 0 or own is None:
            continue
        other = sets.get(up)
        if other is None:
            sets[up] = own
            continue
        large, small = (other, own) if len(other) >= len(own) else (own, other)
        common = length[up]
        for x in small:
            if type(large) is list:
                i = bisect_right(large, x)
                near = (large[i - 1] if i else None, large[i] if i < len(large) else None)
            else:
                near = large.around(x)
            for y in near:
                if y is not None and (d := abs(x - y)) <= common:
                    e = min(x, y)
                    key = e - common + 1, d
                    if found.get(key, -1) < e:
                        found[key] = e
        if type(large) is list:
            if len(small) == 1:
                insort(large, small[0])
            else:
                large += small
                large.sort()
            if len(large) > 2 * PART:
                large = Ends(large)
        else:
            for x in small:
                large.add(x)
        sets[up] = large
    return found


def runs_of(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All runs of the words, by start and period."""
    n, gram = len(codes), least // 3
    if n < least:
        return []
    with np.errstate(over="ignore"):
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        hashes = np.zeros(n - gram + 1, np.uint64)
        for k in range(gram):
            hashes = hashes * np.uint64(0xD6E8FEB86659FD93) + mixed[k : n - gram + 1 + k]
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    again = np.zeros(len(hashes) + 2, np.int8)
    again[1 + order[1:][same]] = 1
    again[1 + order[:-1][same]] = 1
    edges = np.diff(again)
    out = []
    for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
        if b - a + gram - 1 >= least:
            out += [(a + s, size, d) for s, size, d in stretch_runs(codes[a : b + gram - 1].tolist(), least, times)]
    return out


def stretch_runs(codes: list[int], least: int, times: int) -> list[Run]:
    kept: list[Run] = []
    first = 0  # of the runs with the same start
    for (start, d), last in sorted(squares(codes).items()):
        if not kept or kept[-1][0] != start:
            first = len(kept)
        size = last + d + 1 - start
        if not any(d % q == 0 and size <= s for _, s, q in kept[first:]):
            kept.append((start, size, d))
    return [r for r in kept if r[1] >= max(least, times * r[2])]


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Flags of the words that no run repeats after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, size, d in runs:
        change[start + d] += 1
        change[start + size] -= 1
    return np.cumsum(change[:n]) == 0


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", places: Callable[[int | None, int], np.ndarray | None] = lambda i, n: None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period) and the text without repetitions, of each row.

    places(id, number of words) may give the words that stand in for the text's: their numbers, in order. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            counts, found, texts = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, index = text.encode().split(), {}
                if (order := places(doc, len(words))) is not None:
                    words = [words[k] for k in order.tolist()]
                codes = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words))
                runs = runs_of(codes)
                if runs:
                    words = [words[k] for k in np.flatnonzero(kept_words(len(words), runs)).tolist()]
                counts.append(len(codes))
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                texts.append(b" ".join(words).decode())
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(doc: int | None, n: int) -> np.ndarray | None:
    """The words that the query's contract puts in the place of a tenth of the texts'."""
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 or not n:
        return None
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = find_runs(read(spark, sf_dir, "documents"), places=planted)
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.aggregate("runs", none, lambda b, x: F.when(b.isNull() | (x["length"] * b["period"] > b["length"] * x["period"]), x).otherwise(b))
    told = F.array_join(F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n"))), "")
    r = r.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(told, 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"), "n_words")
    exact = F.expr("(1000 * best.length) div best.period")
    return r.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exact.alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
