"""Vector codes by Lloyd's rounds with Elkan's bounds, one codebook for each of 16 parts of a vector.

Every round is one pass over a written table that holds, of each vector, its whole-number components, each part's entry, an upper bound of
the part's distance to that entry and a lower bound of its distance to every entry. An entry is passed over only if its lower bound, or half
its distance to the part's entry, is strictly above the upper bound; whatever could tie is settled by exact squared distances in whole
numbers, the lower index first. When entries have moved, lower bounds fall and upper bounds rise by the movement, in the next pass. Upper
bounds are kept in 32 bits, lower ones in 8 bits of a part's own scale, rounded to the safe side, so rounding can only cost work. Sums by part and entry come from partial sums of each
task; what the driver holds is the codebooks: ENTRIES vectors.

Vectors null or holding null or non-finite components take no part. Rows count as often as they occur; the first codebooks are the ENTRIES
least rows by vec_id and then by vector, null ids last; with fewer rows there are fewer entries. The length of the first of them counts:
vectors of another length get null code and errors, and if it isn't a multiple of PARTS nothing can be cut, so all do. Components that long
arithmetic could overflow are handled as Python's integers, sums in limbs; errors beyond a long are held at its end. Other columns are not
looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that a task works on at a time.
BATCH = 2048
LONG = 2**63 - 1
#: Whole numbers that doubles still hold.
FAR = 10**300
#: Sums beyond 62 bits are added up in limbs of so many bits.
LIMB = 32
#: Labels of at least so small a share of all rows meet their sums by broadcast, so at most so many are broadcast.
FREQUENT = 50_000

STATE = "vec_id long, label string, unlabelled boolean, x binary, entry binary, upper binary, lower binary, step binary"


class Codebooks:
    """entries: parts x entries x width, int64 or, without a kind in which components are stored, Python's integers; moved: how far each
    entry came since the pass before."""

    def __init__(self, entries: np.ndarray, kind: str | None = "i8", moved: np.ndarray | None = None):
        self.entries, self.kind, self.wide, self.moved = entries, kind, kind is None, moved
        wide = self.wide
        self.parts, self.count, self.width = entries.shape
        with np.errstate(over="ignore"):
            e = np.clip(entries, -FAR, FAR).astype(np.float64) if wide else entries.astype(np.float64)  # clipping brings none further apart
            self.apart = np.sqrt(((e[:, :, None, :] - e[:, None, :, :]) ** 2).sum(-1)) * (1 - 1e-9)  # never more than the distance
        self.apart = np.nan_to_num(self.apart, nan=0.0, posinf=0.0)

    def squared(self, part: int, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Exact squared distances of rows of x to entries of the part, one each."""
        d = x - self.entries[part][entry]
        return (d * d).sum(-1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()


def root(squared: np.ndarray) -> np.ndarray:
    if squared.dtype == object:  # beyond doubles: infinite, which as a bound cuts nothing off
        squared = np.array([float(v) if v < FAR else np.inf for v in squared.ravel().tolist()]).reshape(squared.shape)
    return np.sqrt(squared.astype(np.float64))


def up32(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nextafter((x * (1 + 1e-9)).astype(np.float32), np.float32(np.inf))


def down8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds (rows x entries) as steps of 8 bits and each row's size of a step; what steps() makes of them is at most x."""
    x = np.clip(x, 0.0, 1e30)
    size = np.maximum((x.max(1) / 255).astype(np.float32), np.float32(1e-30))
    return np.minimum(np.floor(x / size[:, None].astype(np.float64) * (1 - 1e-6)), 255).astype(np.uint8), size


def steps(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    return count * (size.astype(np.float64) * (1 - 1e-6))[:, None]


State = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # entry, upper bound, lower bounds in steps, size of a step


def assign(books: Codebooks, x: np.ndarray, state: State | None) -> tuple[State, int]:
    """The state of each vector's parts (x: rows x parts x width), and the number of distances computed."""
    n, made = len(x), 0
    entry, upper, lower, size = np.zeros((n, books.parts), np.uint8), np.zeros((n, books.parts), np.float32), np.zeros((n, books.parts, books.count), np.uint8), np.zeros((n, books.parts), np.float32)
    rows = np.arange(n)
    for p in range(books.parts):
        if state is None:
            squared = np.stack([books.squared(p, x[:, p], np.full(n, k)) for k in range(books.count)], 1)
            made += squared.size
            best = squared.argmin(1) if not books.wide else np.array([min(range(books.count), key=row.__getitem__) for row in squared.tolist()], np.int64).reshape(n)
            entry[:, p], upper[:, p] = best, up32(root(squared[rows, best]))
            lower[:, p], size[:, p] = down8(root(squared) * (1 - 1e-9))
            continue
        own = state[0][:, p].astype(np.int64)
        moved = books.moved[p]
        high = state[1][:, p].astype(np.float64) + moved[own]
        low = np.maximum(steps(state[2][:, p], state[3][:, p]) - moved, 0.0)
        # Only parts that some other entry could reach, by both tests, are looked at; their upper bound is then made exact.
        half = books.apart[p][own] / 2
        open_ = ~((low > high[:, None]) | (half > high[:, None]))
        open_[rows, own] = False
        near = np.flatnonzero(open_.any(1))
        if len(near):
            exact = books.squared(p, x[near, p], own[near])
            made += len(near)
            best, least = own[near], exact.copy()
            first = root(exact) * (1 + 1e-9)
            high[near] = first
            low[near, own[near]] = root(exact) * (1 - 1e-9)
            still = open_[near] & ~((low[near] > first[:, None]) | (half[near] > first[:, None]))
            for k in np.flatnonzero(still.any(0)).tolist():
                at = np.flatnonzero(still[:, k])
                other = books.squared(p, x[near[at], p], np.full(len(at), k))
                made += len(at)
                low[near[at], k] = root(other) * (1 - 1e-9)
                better = (other < least[at]) | ((other == least[at]) & (k < best[at]))
                best[at] = np.where(better, k, best[at])
                least[at] = np.where(better, other, least[at])
            own[near] = best
            high[near] = root(least)
        entry[:, p], upper[:, p] = own, up32(high)
        lower[:, p], size[:, p] = down8(low)
    return (entry, upper, lower, size), made


def pack(x: np.ndarray, kind: str | None) -> pa.Array:
    """Rows of components as bytes of a kind; without one, Python's integers as text."""
    return pa.array([" ".join(map(str, r)).encode() for r in x.reshape(len(x), -1).tolist()], pa.binary()) if kind is None else binary(x.astype(kind))


def unpack(column: pa.Array, kind: str | None, width: int) -> np.ndarray:
    flat = np.array([int(v) for r in column.to_pylist() for v in r.split()], object) if kind is None else flat_bytes(column, kind).astype(np.int64)
    return flat.reshape(len(column), PARTS, width)


def binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes, without a copy of its own."""
    data = np.ascontiguousarray(rows)
    ends = np.arange(len(data) + 1, dtype=np.int32) * (data.nbytes // max(1, len(data)))
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])


def flat_bytes(column: pa.Array, kind: str) -> np.ndarray:
    """The bytes of all rows, one after another, as numbers of a kind."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            yield b.slice(at, BATCH)


def whole_numbers(values: np.ndarray, wide: bool) -> np.ndarray:
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * values.astype(np.float64))
    if not wide:
        return scaled.astype(np.int64)
    # A component near the end of doubles can overflow when scaled: then in integers.
    return np.array([int(s) if np.isfinite(s) else int(v) * SCALE for s, v in zip(scaled.ravel().tolist(), values.ravel().tolist(), strict=True)], object).reshape(values.shape)


NAMES = [c.split()[0] for c in STATE.split(", ")]


def stored(x: pa.Array, state: State) -> list[pa.Array]:
    return [x, *map(binary, state)]


def first_pass(rows: DataFrame, books: Codebooks) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            flat = b.column(3).flatten().to_numpy(zero_copy_only=False)
            x = whole_numbers(flat, books.wide).reshape(b.num_rows, books.parts, books.width)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *stored(pack(x, books.kind), assign(books, x, None)[0])], NAMES)

    return rows.mapInArrow(run, STATE)


def of_state(b: pa.RecordBatch, books: Codebooks) -> tuple[np.ndarray, State]:
    n = b.num_rows
    state = flat_bytes(b.column(4), "u1").reshape(n, PARTS), flat_bytes(b.column(5), "f4").reshape(n, PARTS), flat_bytes(b.column(6), "u1").reshape(n, PARTS, books.count), flat_bytes(b.column(7), "f4").reshape(n, PARTS)
    return unpack(b.column(3), books.kind, books.width), state


def later_pass(table: DataFrame, books: Codebooks) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x, state = of_state(b, books)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *stored(b.column(3), assign(books, x, state)[0])], NAMES)

    return table.mapInArrow(run, STATE)


def last_pass(table: DataFrame, books: Codebooks) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x, state = of_state(b, books)
            entry = assign(books, x, state)[0][0]
            error = sum(books.squared(p, x[:, p], entry[:, p].astype(np.int64)) for p in range(books.parts))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r.tobytes().hex() for r in entry]), pa.array([min(LONG, int(e)) for e in error.tolist()], pa.int64())], ["vec_id", "label", "unlabelled", "code", "error"])

    return table.mapInArrow(run, "vec_id long, label string, unlabelled boolean, code string, error long")


def partial_sums(table: DataFrame, books: Codebooks, limbs: int) -> DataFrame:
    """Of each task, part and entry: the number of parts and the sum of each component, in limbs."""
    kind, width, parts, count = books.kind, books.width, books.parts, books.count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((parts, count), np.int64)
        total = np.zeros((parts, count, width), object if limbs > 1 else np.int64)
        for b in slices(batches):
            x, entry = unpack(b.column(0), kind, width), flat_bytes(b.column(1), "u1").reshape(b.num_rows, PARTS)
            for p in range(parts):
                n[p] += np.bincount(entry[:, p], minlength=count)
                np.add.at(total[p], entry[:, p], x[:, p])
        found = [(p, k) for p, k in np.argwhere(n).tolist()]
        if found:
            sums = [[int(v) for v in total[p, k]] for p, k in found]
            split = [[(v >> (LIMB * j)) & ((1 << LIMB) - 1) if j < limbs - 1 else v >> (LIMB * j) for v in s for j in range(limbs)] for s in sums]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([k for _, k in found], pa.int32()), pa.array([int(n[p, k]) for p, k in found], pa.int64()), pa.array(split, pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    made = table.select("x", "entry").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    return made.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[j]) for j in range(width * limbs))).alias("sums"))


def moved_books(table: DataFrame, books: Codebooks, limbs: int) -> Codebooks:
    """Entries replaced by the floors of their parts' means; unused ones stay."""
    entries = books.entries.copy()
    for r in partial_sums(table, books, limbs).collect():  # at most PARTS * ENTRIES rows
        values = [sum(v << (LIMB * j) for j, v in enumerate(r.sums[c * limbs : (c + 1) * limbs])) for c in range(books.width)]
        entries[r.part, r.entry] = [v // r.n for v in values]
    d = entries - books.entries
    with np.errstate(over="ignore"):
        moved = root((d * d).sum(-1)) * (1 + 1e-9)
    return Codebooks(entries, books.kind, moved)


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label (as text), code and error of the rows that take part, and the last codebooks."""
    label = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), label.isNull().alias("unlabelled"), F.col("embedding").cast("array<double>").alias("x")).where("x is not null").where(sound)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).collect()
    length = len(first[0].x) if first else 0
    if not length or length % PARTS:
        return rows.select("vec_id", "label", "unlabelled", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), None
    width = length // PARTS
    fit = rows.where(F.size("x") == length)
    most, n = fit.agg(F.max(F.array_max(F.transform("x", lambda v: F.abs(v)))), F.count("*")).first()
    bits = (int(most) * SCALE + SCALE).bit_length()
    wide = 2 * (bits + 1) + length.bit_length() > 62
    limbs = 1 if bits + int(n).bit_length() < 62 else -(-(bits + 1) // LIMB) + 1
    seeds = [r.x for r in first if len(r.x) == length]
    books = Codebooks(whole_numbers(np.array(seeds), wide).reshape(len(seeds), PARTS, width).swapaxes(0, 1).copy(), None if wide else "i4" if bits < 31 else "i8")
    state = written(first_pass(fit, books), "codes-state")
    for k in range(rounds):
        books = moved_books(state, books, limbs)
        if k < rounds - 1:
            after = written(later_pass(state, books), "codes-state")
            discard(state)
            state = after
    done = written(last_pass(state, books), "codes")
    discard(state)
    other = rows.where(F.size("x") != length).select("vec_id", "label", "unlabelled", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return done.unionAll(other), books


def with_label_errors(found: DataFrame) -> DataFrame:
    """found and the sum of its errors over equal labels. Frequent labels meet their sums by broadcast, so no task gathers a hot label."""
    key = F.coalesce("label", F.lit(""))
    sums = found.groupBy("unlabelled", key.alias("key")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    sums = sums.select("unlabelled", "key", F.least("s", F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error"), "n")
    cut = found.count() // FREQUENT
    hot, cold = sums.where(F.col("n") > cut).drop("n"), sums.where(F.col("n") <= cut).drop("n")
    rows = found.withColumn("key", key)
    common = rows.join(F.broadcast(hot), ["unlabelled", "key"])
    rest = rows.join(F.broadcast(hot), ["unlabelled", "key"], "left_anti").join(cold, ["unlabelled", "key"])
    return common.unionByName(rest)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = vector_codes(read(spark, sf_dir, "embeddings"))
    digest = F.lit(books.digest() if books else None).cast("string")
    return with_label_errors(found).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


def _round(n: int) -> str:
    """SQL of the assignment to the codebooks b{n}, and of the codebooks b{n + 1}."""
    return f"""
a{n} as materialized (
    select r, p, arg_min(k, d * 64 + k) as k, min(d) as d
    from (select r, p, b.k, list_inner_product(v.x, v.x) - 2e0 * list_inner_product(v.x, b.x) + list_inner_product(b.x, b.x) as d from parts v join b{n} b using (p)) group by r, p
), m{n} as (
    select p, k, list(m order by i) as x from (
        select p, k, i, floor(sum(x[i]) / count(*)) as m from a{n} join parts using (r, p), lateral (select unnest(range(1, len(x) + 1)) as i) group by p, k, i) group by p, k
), b{n + 1} as materialized (select p, k, coalesce(m{n}.x, b{n}.x) as x from b{n} left join m{n} using (p, k))"""


ORACLE = f"""
with v as (
    select row_number() over (order by vec_id, embedding) as r, vec_id, label, list_transform(embedding, lambda x: floor(256e0 * x::double)) as x from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as materialized (select r, p, x[p * len(x) // 16 + 1 : (p + 1) * len(x) // 16] as x from v, range(16) t(p)),
b0 as (select p, r - 1 as k, x from parts where r <= 64), {_round(0)}, {_round(1)}, {_round(2)},
e as (select r, string_agg(printf('%02x', k::integer), '' order by p) as code, sum(d)::bigint as error from a2 group by r),
h as (select sha256(string_agg(c, ',' order by p, k)) as codebooks_sha256 from (select p, k, array_to_string(list_transform(x, lambda c: c::bigint::varchar), ',') as c from b2))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from v join e using (r), h
"""
