"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad; its features are its own and its neighbours'. Forward-backward gives each line's marginal, the marginals
weighted by line length give the document's quality, and a logistic scale fitted on the training documents makes it a score.

The field is trained on the driver from a bounded sample: at most TRAIN_DOCS labelled ids (those of least hash), of each the least text, if
it has at most TRAIN_LINES lines, in the order of the hashes while they have TRAIN_ALL_LINES lines together. Only rows whose crc32(doc_id as text) mod 5 is not 0 are used; a document's label stands for each of its lines. Without
a row of either label the score is 0.5 throughout. Scoring needs no shuffle.

Nulls and empty texts are one empty line. Repeated rows each get their row; of different labels of one id the largest counts; null ids stay
null and count as held in. Only doc_id and text are read, so no other column can clash. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, read, text_of

TRAIN_DOCS, TRAIN_LINES, TRAIN_ALL_LINES, SEGMENT = 4000, 2000, 400_000, 64
CUT = 0.3
#: Classes of bytes that are counted in each line.
CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&<>@^~=+_\\/{}[]", "pipe": b"|", "bang": b"!?", "stop": b".,;:", "blank": b" \t\r\x0b\x0c", "wide": bytes(range(128, 256))}
OWN = len(CLASSES) + 6
FEATURES = 3 * OWN + 3


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of all texts: features, lengths in bytes (1 at least); and each text's number of lines."""
    data = np.frombuffer("\n".join(texts).encode(), np.uint8)
    number = np.full(256, len(CLASSES), np.uint8)
    for k, own in enumerate(CLASSES.values()):
        number[list(own)] = k
    kind = number[data]
    breaks = np.flatnonzero(data == 10)
    start, end = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(data)]])
    length = end - start
    share = np.zeros((len(start), OWN), np.float32)
    most = np.maximum(length, 1)
    for k in range(len(CLASSES)):
        upto = np.concatenate([[0], np.cumsum(kind == k)])
        share[:, k] = (upto[end] - upto[start]) / most
    blank = np.append(kind == list(CLASSES).index("blank"), True)
    blank[breaks] = True
    first = ~blank[:-1]
    first[1:] &= blank[:-2]
    upto = np.concatenate([[0], np.cumsum(first)])
    words = upto[end] - upto[start]
    k = len(CLASSES)
    share[:, k] = np.log1p(length) / 8
    share[:, k + 1] = length / np.maximum(words, 1) / 12
    share[:, k + 2] = length == 0
    full = np.flatnonzero(length)
    share[full, k + 3] = np.isin(data[end[full] - 1], list(b".!?"))
    share[full, k + 4] = kind[start[full]] == list(CLASSES).index("upper")
    lines_of = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
    again, at = [], 0
    for t in texts:
        seen: set[int] = set()
        for line in t.split("\n"):
            h = hash(line)
            again.append(h in seen and line != "")
            seen.add(h)
    share[:, k + 5] = again
    np.minimum(share, 4, out=share)
    return share, most, lines_of


def with_neighbours(own: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
    """Each line's own features, the previous line's, the next line's, whether it is the first or last, and 1."""
    end = np.cumsum(lines_of)
    out = np.zeros((len(own), FEATURES), np.float32)
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = own[:-1]
    out[:-1, 2 * OWN : 3 * OWN] = own[1:]
    first, last = end - lines_of, end - 1
    out[first, OWN : 2 * OWN] = 0
    out[last, 2 * OWN : 3 * OWN] = 0
    out[first, 3 * OWN] = 1
    out[last, 3 * OWN + 1] = 1
    out[:, 3 * OWN + 2] = 1
    return out


@dataclass
class Field:
    """Weights of the good state's emission and of the four transitions (bad = 0, good = 1), and the final logistic scale."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    scale: float = 0.0
    shift: float = 0.0

    def messages(self, odds: np.ndarray, lines_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward log odds of the good state for lines that lie behind each other, document by document."""
        start = np.cumsum(lines_of) - lines_of
        order = np.argsort(-lines_of, kind="stable")
        start, n = start[order], lines_of[order]
        ahead, back = odds.astype(np.float64).copy(), np.zeros(len(odds))
        m = self.moves
        active = len(n)
        for t in range(1, int(n[0]) if len(n) else 0):
            while n[active - 1] <= t:
                active -= 1
            at = start[:active] + t
            was = ahead[at - 1]
            ahead[at] += np.logaddexp(was + m[1, 1], m[0, 1]) - np.logaddexp(was + m[1, 0], m[0, 0])
            at = start[:active] + n[:active] - 1 - t
            then = back[at + 1] + odds[at + 1]
            back[at] = np.logaddexp(then + m[1, 1], m[1, 0]) - np.logaddexp(then + m[0, 1], m[0, 0])
        return ahead, back

    def marginals(self, own: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
        odds = with_neighbours(own, lines_of) @ self.weights
        ahead, back = self.messages(odds, lines_of)
        return 1 / (1 + np.exp(-np.clip(ahead + back, -50, 50)))

    def quality(self, own: np.ndarray, length: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
        """Each document's mean marginal, weighted by line length."""
        first = np.cumsum(lines_of) - lines_of
        p = self.marginals(own, lines_of)
        return np.add.reduceat(p * length, first) / np.add.reduceat(length.astype(np.float64), first) if len(first) else np.zeros(0)

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.quality(*line_features(texts)) + self.shift, -50, 50)))

    def fit(self, own: np.ndarray, length: np.ndarray, lines_of: np.ndarray, labels: np.ndarray, steps: int = 150, l2: float = 1e-4) -> Field:
        """Maximum likelihood by Adam; long documents are trained in segments."""
        if not len(labels) or labels.min() == labels.max():
            return self
        x = with_neighbours(own, lines_of)
        y = np.repeat(labels, lines_of).astype(np.float64)
        parts = np.array([k for n in lines_of.tolist() for k in [*[SEGMENT] * (n // SEGMENT), n % SEGMENT] if k])
        inner = np.ones(len(y), bool)
        inner[np.cumsum(parts) - parts] = False
        at = np.flatnonzero(inner)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
        theta = np.concatenate([self.weights, self.moves.ravel()])
        mean, square = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            self.weights, self.moves = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
            odds = x @ self.weights
            ahead, back = self.messages(odds, parts)
            p = 1 / (1 + np.exp(-(ahead + back)))
            both = np.stack([self.moves[i, j] + i * ahead[at - 1] + j * (odds[at] + back[at]) for i in (0, 1) for j in (0, 1)])
            both = np.exp(both - both.max(0))
            expected = (both / both.sum(0)).sum(1)
            g = np.concatenate([(y - p) @ x, seen.ravel() - expected]) / len(y) - l2 * theta
            mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
            theta = theta + 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        self.weights, self.moves = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
        q = self.quality(own, length, lines_of)
        self.scale, self.shift = 1.0, 0.0
        for _ in range(25):  # Newton's method, slightly regularised
            s = 1 / (1 + np.exp(-(self.scale * q + self.shift)))
            w = s * (1 - s)
            g = np.array([((labels - s) * q).sum() - 0.01 * self.scale, (labels - s).sum() - 0.01 * self.shift])
            h = np.array([[(w * q * q).sum() + 0.01, (w * q).sum()], [(w * q).sum(), w.sum() + 0.01]])
            self.scale, self.shift = (np.array([self.scale, self.shift]) + np.linalg.solve(h, g)).tolist()
        return self


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Field:
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("_label")).withColumn("doc_id", F.col("doc_id").cast("long"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    rows = rows.where(F.size(F.split("text", "\n")) <= TRAIN_LINES).select("_label", "text", F.xxhash64("doc_id").alias("_hash"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            own, length, lines_of = line_features(batch.column(1).to_pylist())
            cut = np.cumsum(lines_of)[:-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.tobytes() for a in np.split(own, cut)]), pa.array([a.astype(np.int64).tobytes() for a in np.split(length, cut)]), pa.array(lines_of), batch.column(2), batch.column(3)], ["label", "own", "length", "lines", "hash", "doc_id"])

    rows = rows.mapInArrow(run, "label int, own binary, length binary, lines long, hash long, doc_id long")
    upto = F.sum("lines").over(Window.orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # one task, of TRAIN_DOCS rows at most
    got = sorted((bytes(r["own"]), bytes(r["length"]), r["label"]) for r in rows.withColumn("upto", upto).where(F.col("upto") <= TRAIN_ALL_LINES).select("own", "length", "label").collect())
    if not got:
        return Field()
    length = [np.frombuffer(b, np.int64) for _, b, _ in got]
    own = np.concatenate([np.frombuffer(a, np.float32).reshape(-1, OWN) for a, *_ in got])
    return Field().fit(own, np.concatenate(length), np.array(list(map(len, length))), np.array([float(y > 0) for *_, y in got]))


def score(docs: DataFrame, model: Field) -> DataFrame:
    """docs with the columns of op1's result only: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(model.score(batch.column(1).to_pylist()))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def accepted(docs: DataFrame, model: Field, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score reaches CUT, with their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, at):
            keep = model.score([t or "" for t in batch.column(at).to_pylist()]) >= CUT
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
