"""Byte-level BPE by recursive DuckDB queries in each partition.

A partition's distinct pieces become rows of (piece, position, token). A recursive query joins each adjacent pair with the merge
table, contracts every piece's leftmost pair of least rank, and ends when no pair of any piece can merge. An ordered aggregation
gives a piece's ids, another one decodes ids to bytes. One contraction a step is quadratic in a piece's length, so the same query for
pieces beyond LONG_PIECE bytes (no words of any language) contracts all pairs of the least rank in a step, from the left: the leftmost
would be the next each time, unless the new token can make a pair of a lower rank. For such tokens (unsafe) a step contracts the leftmost
only. A query keeps the rows of all its steps, so it stops at STEP_ROWS of them and the next one goes on from its last step.

Nulls and empty texts have no ids. Repeated rows each get their row, null ids stay null, other columns are not looked at, an empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Pieces
from .common import chunks, read, text_of

#: Pieces that one query contracts, and pieces whose ids a worker keeps; both bound its memory.
QUERY_PIECES, CACHE_PIECES = 60_000, 600_000
#: One query's pieces have at most so many bytes together, but for a single longer piece.
QUERY_BYTES = 600_000

#: Memory of a worker's DuckDB, which has no folder to spill to, and what a byte of a query's pieces needs of it, for single huge pieces.
MEMORY_MB, PIECE_BYTE_MEMORY = 220, 250
#: Beyond so many bytes a piece's pairs of least rank are contracted in one step; the ids are the same.
LONG_PIECE = 256
#: Rows of all steps that one query keeps.
STEP_ROWS = 2_000_000

CONTRACT = """
with recursive steps(w, pos, tok, step) as (
    select w, pos, tok, 0 from start
    union all (
        with pairs as materialized (
            select s.w, s.pos, s.tok, s.step, s.nxt, (m.rank << 32) + s.pos as key
            from (
                select w, pos, tok, step, lead(pos) over q as nxt, case when lead(w) over q = w then lead(tok) over q end as after
                from steps window q as (order by w, pos)
            ) s
            left join merges m on m.a = s.tok and m.b = s.after
        ),
        least as (select w, min(key) as key, arg_min(nxt, key) as gone from pairs where key is not null group by w)
        select w, pos, case when p.key = l.key then (l.key >> 32)::integer else tok end, step + 1
        from pairs p join least l using (w) where pos <> gone and step < $most
    )
"""

CONTRACT_ALL = """
with recursive steps(w, pos, tok, step) as (
    select w, pos, tok, 0 from start
    union all (
        with pairs as materialized (
            select s.w, s.pos, s.tok, s.step, s.n, m.rank
            from (
                select w, pos, tok, step, row_number() over q as n, case when lead(w) over q = w then lead(tok) over q end as after
                from steps window q as (order by w, pos)
            ) s
            left join merges m on m.a = s.tok and m.b = s.after
        ),
        least as (
            select w, l.rank, case when u.tok is not null then l.pos end as lone
            from (select w, min(rank) as rank, arg_min(pos, (rank << 32) + pos) as pos from pairs where rank is not null group by w) l
            left join unsafe u on u.tok = l.rank
        ),
        hit as (
            select n, n - row_number() over (order by n) as run
            from pairs join least using (w) where pairs.rank = least.rank and (lone is null or pos = lone)
        ),
        chosen as materialized (select n from (select n, row_number() over (partition by run order by n) as k from hit) where k % 2 = 1)
        select p.w, p.pos, case when c.n is not null then p.rank else p.tok end, p.step + 1
        from pairs p join least using (w) left join chosen c on c.n = p.n left join chosen gone on gone.n = p.n - 1
        where gone.n is null and p.step < $most
    )
"""

LAST = """
)
select w, pos, tok, step from steps semi join (select w, max(step) as step from steps group by w) last using (w, step)
"""

DECODE = """
select w, string_agg(tok::varchar, ' ' order by pos) as told, string_agg(t.bytes, '' order by pos) as bytes
from ids join tokens t using (tok) group by w
"""


class SqlBPE:
    """ranks: token bytes to rank, which is the id too."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.con = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": "", "preserve_insertion_order": False})
        self.ranks, self.byte = ranks, np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self._table("merges", pa.table(dict(zip("ab", map(pa.array, zip(*((a, b) for a, b, _ in pairs), strict=True)), strict=True)) | {"rank": pa.array([r for *_, r in pairs])} if pairs else {"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "rank": pa.array([], pa.int64())}))
        self._table("unsafe", pa.table({"tok": pa.array(sorted({x for a, b, r in pairs for x in (a, b) if r < x}), pa.int64())}))
        self._table("tokens", pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array([t.hex() for t in ranks])}))
        self.known: dict[bytes, str] = {}  # ids as text
        self.other: dict[bytes, bytes] = {}  # decoded bytes, where they aren't the piece's

    def _table(self, name: str, rows: pa.Table) -> None:
        self.con.register("arriving", rows)
        self.con.execute(f"create or replace temp table {name} as select * from arriving")
        self.con.unregister("arriving")

    def _contract(self, sql: str, rows: pa.Table) -> None:
        """Adds the ids of pieces to the table ids; rows: w, pos, tok of their bytes."""
        while rows.num_rows:
            most = max(1, STEP_ROWS // rows.num_rows)
            self._table("start", rows)
            self.con.execute("create or replace temp table ended as " + (sql + LAST).replace("$most", str(most)))
            self.con.execute(f"insert into ids select w, pos, tok from ended where step < {most}")
            rows = self.con.sql(f"select w, pos, tok from ended where step = {most}").to_arrow_table()

    def _query(self, pieces: list[bytes]) -> None:
        """Adds ids as text and decoded bytes of the pieces to what is known."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        needed = max(MEMORY_MB, len(data) * PIECE_BYTE_MEMORY >> 20)
        self.con.execute(f"set memory_limit = '{needed}MB'")
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int32, len(pieces))
        own = np.flatnonzero(whole >= 0).astype(np.int32)
        self._table("ids", pa.table({"w": own, "pos": np.zeros(len(own), np.int32), "tok": whole[own]}))
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        place = (np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        for sql, long in ((CONTRACT, False), (CONTRACT_ALL, True)):
            at = np.repeat((whole < 0) & ((sizes > LONG_PIECE) == long), sizes)
            self._contract(sql, pa.table({"w": piece[at], "pos": place[at], "tok": self.byte[data[at]]}))
        for w, told, text in self.con.execute(DECODE).fetchall():
            self.known[pieces[w]] = told
            if (found := bytes.fromhex(text)) != pieces[w]:
                self.other[pieces[w]] = found

    def learn(self, pieces: list[bytes]) -> tuple[list[str], list[bytes]]:
        """Of each piece the ids, as text, and the bytes they decode to."""
        if len(self.known) > CACHE_PIECES:
            self.known, self.other = {}, {}
        some: list[bytes] = []
        size = 0
        for p in pieces:
            if p not in self.known:
                if some and (len(some) >= QUERY_PIECES or size + len(p) > QUERY_BYTES):
                    self._query(some)
                    some, size = [], 0
                some.append(p)
                size += len(p)
        if some:
            self._query(some)
        return [self.known[p] for p in pieces], [self.other.get(p, p) for p in pieces] if self.other else pieces


@lru_cache(2)
def of_file(path: str) -> SqlBPE:
    with open(path, "rb") as f:
        return SqlBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def encode_decode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (space-joined) and decoded bytes' digests of each row. No shuffle: each partition works alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = of_file(ranks)
        for batch in chunks(batches):
            texts = batch.column(1).to_pylist()
            pieces = Pieces(texts)
            told, decoded = bpe.learn(pieces.unique)
            codes, before = pieces.codes.tolist(), 0
            n, ids, data = [], [], []
            for to in pieces.ends.tolist():
                own = codes[before:to]
                text = " ".join([told[c] for c in own])
                n.append(text.count(" ") + 1 if text else 0)
                ids.append(hashlib.sha256(text.encode()).hexdigest())
                data.append(hashlib.sha256(b"".join([decoded[c] for c in own])).hexdigest())
                before = to
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(data)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
