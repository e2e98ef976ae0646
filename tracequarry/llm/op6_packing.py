"""Hierarchical residual best-fit packing.

Each task tokenizes its documents, cuts the long ones, and packs the pieces best-fit (longest first) into bins of CAPACITY tokens. Nearly
full bins are emitted. Underfull bins go on as items: each further round merges FAN_IN partitions into one, packs their bins best-fit
again, and emits what is nearly full by then; the last rounds take what is left. A task of a later round gets at most about ROUND_ITEMS
bins; when a round on the least number of partitions for that hardly reduces the bins (by under 2 %), they are emitted as they are.

A bin travels as its fill and the bytes of its members' records, so texts and ids never leave the first task, and every round is a
table in the shared folder.

Nulls and empty texts are one piece with just the separator. Repeated rows each are packed, null ids stay null, other columns are not
looked at, an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, read, text_of, written

CAPACITY, SEPARATOR = 2048, 0
#: Bins with at most so many free tokens are nearly full.
SLACK = 4
FAN_IN, ROUND_ITEMS = 8, 200_000
PIECE = np.dtype([("doc", "<i8"), ("known", "u1"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
BIN = "done boolean, fill int, members binary"


def pieces_of(doc_id: int | None, ids: np.ndarray, capacity: int) -> list[tuple]:
    """Records of a document's pieces: full ones, but for the first, which takes the remainder."""
    n, out, at = len(ids), [], 0
    while at < n:
        length = (n - at) % capacity or capacity
        out.append((doc_id or 0, doc_id is not None, len(out), at, length, zlib.crc32(ids[at : at + length].astype("<u4").tobytes())))
        at += length
    return out


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that has room. A bit of `open` stands for each amount of room."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    room_open = 0
    for i in order:
        fits = room_open >> sizes[i]
        if fits:
            room = sizes[i] + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                room_open ^= 1 << room
            bins[k].append(i)
        else:
            k, room = len(bins), capacity
            bins.append([i])
        left = room - sizes[i]
        if left:
            by_room[left].append(k)
            room_open |= 1 << left
    return bins


def packed(fills: list[int], members: list[bytes], capacity: int, slack: int) -> Iterator[pa.RecordBatch]:
    """The bins of BIN rows, some thousand a batch."""
    bins = best_fit(fills, capacity)
    for at in range(0, len(bins), 5000):
        some = bins[at : at + 5000]
        full = [sum(fills[i] for i in b) for b in some]
        yield pa.RecordBatch.from_arrays([pa.array([f >= capacity - slack for f in full]), pa.array(full, pa.int32()), pa.array([b"".join(members[i] for i in b) for b in some], pa.binary())], ["done", "fill", "members"])


def first_round(docs: DataFrame, tokenizer: str, capacity: int, slack: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import fast

        bpe, fills, members = fast(tokenizer), [], []
        for batch in chunks(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), bpe.ids(batch.column(1).to_pylist()), strict=True):
                for p in pieces_of(doc_id, np.append(ids, np.uint32(SEPARATOR)), capacity):
                    fills.append(p[4])
                    members.append(np.array([p], PIECE).tobytes())
        yield from packed(fills, members, capacity, slack)

    return docs.mapInArrow(run, BIN)


def later_round(bins: DataFrame, capacity: int, slack: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fills, members = [], []
        for batch in batches:
            fills += batch.column(0).to_pylist()
            members += batch.column(1).to_pylist()
        yield from packed(fills, members, capacity, slack)

    return bins.select("fill", "members").mapInArrow(run, BIN)


def rows_of(bins: DataFrame) -> DataFrame:
    """A row per piece; bins have a number `sequence_id`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                data = part.column(1).to_pylist()
                m = np.frombuffer(b"".join(data), PIECE)
                n = np.array([len(x) // PIECE.itemsize for x in data])
                upto = np.cumsum(m["length"]) - m["length"]
                first = np.cumsum(n) - n
                offset = upto - np.repeat(upto[first], n) if len(m) else upto
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m["doc"], pa.int64(), mask=m["known"] == 0), pa.array(m["piece"]), pa.array(m["start"]), pa.array(m["length"].astype(np.int64)), pa.array(m["crc"].astype(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), n)), pa.array(offset.astype(np.int64))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
                )

    return bins.select("sequence_id", "members").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, slack: int = SLACK, fan_in: int = FAN_IN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rounds = [written(first_round(rows, tokenizer, capacity, slack), "packing")]
    parts = max(1, rounds[0].rdd.getNumPartitions())
    emitted, before = [], 0
    while True:
        now, open_bins = rounds[-1], rounds[-1].where("not done")
        left = open_bins.count()
        fewest = -(-left // ROUND_ITEMS)
        if not left or before and parts == fewest and (parts == 1 or left > 0.98 * before):
            emitted.append(now)
            break
        parts = 1 if fewest == 1 else max(-(-parts // fan_in), fewest)
        emitted.append(now.where("done"))
        before = left
        rounds.append(written(later_round(open_bins.repartition(parts), capacity, slack), "packing"))
    numbered = [b.select((F.monotonically_increasing_id() + F.lit(k << 56)).alias("sequence_id"), "members") for k, b in enumerate(emitted)]
    out = numbered[0]
    for b in numbered[1:]:
        out = out.union(b)
    return rows_of(out)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
