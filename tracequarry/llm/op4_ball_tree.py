"""Exact top-k by integer inner product: ball trees per shard, searched best bound first.

Each task gathers shards of vectors and builds a ball tree of each, once; the trees are a stored table. Blocks of queries (about QUERY_BLOCK,
so what is broadcast is bounded) go over the trees, whose nodes are visited in the order of their upper bound q.c + |q| r. A node whose bound
is below the query's current kth score is cut off with all that follow; one that only ties is skipped unless it holds a smaller id. The kth
score is shared: a block first searches every TURNS-th tree, the kth scores found are collected (one number a query of the block), and the
other trees are searched from those on; within a task they go from tree to tree. What the tasks found is merged by query.

Vectors null or holding null or non-finite components take no part, nor do null ids; only vectors of the query's length are compared. Of
repeated ids the best score counts, and an id is reported once. Products are exact: where doubles could round, leaves are
multiplied in Python's integers, and scores beyond a long are held at its ends. Vectors without components have products of 0. Only vec_id and embedding are read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, scratch, written

TOP, SCALE, LEAF = 5, 256, 128
QUERY_BLOCK, TURNS = 2048, 16
#: A tree has at most so many vectors, and so many bytes of them.
SHARD_ROWS, SHARD_BYTES = 32_768, 16 << 20
LONG = 2**63 - 1

Top = list[tuple[int, int]]  # (-score, id), in order


class BallTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rounded: bool | None = None):
        self.rounded = rounded  # whether doubles may round the products, so that leaves are multiplied in integers
        self.order = np.arange(len(ids))
        self.nodes: list[tuple[int, int, int, int]] = []  # start, end, left child, right child
        self.ids, self.vectors = ids, vectors
        stack = [(0, len(ids), -1, 0)]
        centers, radii, least = [], [], []
        while stack:
            a, b, parent, side = stack.pop()
            own = self.order[a:b]
            v = vectors[own]
            c = v.mean(0)
            k = len(self.nodes)
            self.nodes.append((a, b, -1, -1))
            centers.append(c)
            radii.append(float(np.sqrt(((v - c) ** 2).sum(1).max())))
            least.append(int(ids[own].min()))
            if parent >= 0:
                x = self.nodes[parent]
                self.nodes[parent] = (*x[:2], k, x[3]) if side == 0 else (*x[:3], k)
            if b - a > LEAF and v.shape[1]:
                dim = int(np.argmax(v.max(0) - v.min(0)))
                half = (b - a) // 2
                self.order[a:b] = own[np.argpartition(v[:, dim], half, kind="introselect")]
                stack += [(a + half, b, k, 1), (a, a + half, k, 0)]
        self.centers, self.radii, self.least = np.array(centers), np.array(radii), np.array(least)
        self.ids, self.vectors = ids[self.order], vectors[self.order]

    def stored(self) -> bytes:
        return pickle.dumps((self.nodes, self.centers, self.radii, self.least, self.ids, self.vectors))

    @staticmethod
    def of(data: bytes) -> BallTree:
        tree = BallTree.__new__(BallTree)
        tree.nodes, tree.centers, tree.radii, tree.least, tree.ids, tree.vectors = pickle.loads(data)
        tree.rounded = None
        return tree

    def exact(self, a: int, b: int, query: np.ndarray) -> np.ndarray:
        """Products of vectors a to b - 1 in Python's integers, held at a long's ends."""
        whole = [int(x) for x in query]
        return np.array([max(-LONG - 1, min(LONG, sum(int(x) * y for x, y in zip(v, whole, strict=True)))) for v in self.vectors[a:b]], object)

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, top: Top, floor: int | None) -> Top:
        """top, with what this tree has better; bounds: the query's for each node; floor: a score that k others reach elsewhere."""
        heap = [(-bounds[0], 0)]
        while heap:
            bound, k = heapq.heappop(heap)
            bound = int(np.floor(-bound)) if np.isfinite(bound) else LONG
            kth, worst = (-top[TOP - 1][0], top[TOP - 1][1]) if len(top) >= TOP else (None, None)
            need = max((x for x in (kth, floor) if x is not None), default=None)
            if need is not None and bound < need:
                break
            if kth is not None and bound == kth and self.least[k] > worst:
                continue
            a, b, left, right = self.nodes[k]
            if left >= 0:
                heapq.heappush(heap, (-bounds[left], left))
                heapq.heappush(heap, (-bounds[right], right))
                continue
            score = self.vectors[a:b] @ query if self.rounded is None else self.exact(a, b, query)
            at = np.flatnonzero(score >= need) if need is not None else np.arange(b - a)
            if len(at):
                top = merged(top, [(-int(s), int(i)) for s, i in zip(score[at], self.ids[a:b][at], strict=True) if i != own])
        return top


def merged(a: Top, b: Top) -> Top:
    """The TOP best of both, each id once."""
    out: dict[int, int] = {}
    for s, i in sorted(a + b):
        out.setdefault(i, s)
        if len(out) == TOP:
            break
    return [(s, i) for i, s in out.items()]


def exact_in_doubles(*parts: np.ndarray) -> bool:
    most = max((float(np.abs(p).max()) if p.size else 0.0) for p in parts)
    return most * most * parts[0].shape[1] < 2.0**52


def search_block(tops: dict[int, Top], floors: dict[int, int], q_ids: np.ndarray, queries: np.ndarray, tree: BallTree) -> None:
    """Betters tops (by the queries' numbers) with the vectors of one tree."""
    tree.rounded = None if exact_in_doubles(queries, tree.vectors) else True
    with np.errstate(all="ignore"):  # bounds beyond doubles are infinite and cut nothing off
        bounds = queries @ tree.centers.T + np.sqrt((queries**2).sum(1))[:, None] * tree.radii
        bounds += 1e-9 * (np.abs(bounds) + np.abs(queries) @ np.abs(tree.centers.T)) + 1e-6
    bounds = np.nan_to_num(bounds, nan=np.inf, posinf=np.inf, neginf=np.inf)
    for k, q in enumerate(queries):
        tops[k] = tree.search(q, int(q_ids[k]), bounds[k], tops.get(k, []), floors.get(k))


def whole_numbers(df: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null").where(sound)


def arrays(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By vector length: length, ids, scaled vectors."""
    ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    size = np.diff(column.offsets.to_numpy())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False))
    start = np.cumsum(size) - size
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        yield n, ids[own], flat[start[own][:, None] + np.arange(n)]


def trees(data: DataFrame) -> DataFrame:
    """width, turn, tree of the shards of whole_numbers()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        turn = TaskContext.get().partitionId()

        def built(n: int) -> pa.RecordBatch:
            nonlocal turn
            ids, v = (np.concatenate(x) for x in zip(*held.pop(n), strict=True))
            with np.errstate(all="ignore"):
                tree = BallTree(ids, v)
            turn += 1
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([(turn - 1) % TURNS], pa.int32()), pa.array([tree.stored()], pa.binary())], ["width", "turn", "tree"])

        for n, ids, v in (g for b in batches if b.num_rows for g in arrays(b)):
            most = max(1, min(SHARD_ROWS, SHARD_BYTES // max(8 * n, 1)))
            for at in range(0, len(ids), most):
                held.setdefault(n, []).append((ids[at : at + most], v[at : at + most]))
                if sum(len(i) for i, _ in held[n]) >= most:
                    yield built(n)
        for n in list(held):
            yield built(n)

    return data.mapInArrow(run, "width int, turn int, tree binary")


Block = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by width: query ids, queries, their rows in the block


def found_by(table: DataFrame, block: Block, floors: dict[int, int]) -> DataFrame:
    """row (of the block), vec_id, score: what a task's trees have for each query of the block; floors: kth scores by row."""
    shared = table.sparkSession.sparkContext.broadcast((block, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, floors = shared.value
        tops: dict[int, dict[int, Top]] = {n: {} for n in block}
        for b in batches:
            for n, data in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                if n in block:
                    ids, queries, rows = block[n]
                    own = {k: floors[r] for k, r in enumerate(rows.tolist()) if r in floors}
                    search_block(tops[n], own, ids, queries, BallTree.of(data.as_py()))
        told = [(int(block[n][2][k]), i, -s) for n, by in tops.items() for k, top in by.items() for s, i in top]
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*told, strict=True)], ["row", "vec_id", "score"])

    return table.mapInArrow(run, "row long, vec_id long, score long")


def top_products(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score of each query's TOP best."""
    spark = vectors.sparkSession
    asked = whole_numbers(queries).dropDuplicates()
    table = written(trees(whole_numbers(vectors)), "trees")
    path, out = scratch(spark, "top"), "query_id long, vec_id long, score long"
    spark.createDataFrame([], out).write.parquet(path)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    for number in range(blocks):
        # Dealt by id and vector, so the different vectors of one repeated id are spread over the blocks too.
        mine = asked.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)) == number).toArrow().combine_chunks().to_batches()
        block: Block = {}
        base, names = 0, []
        for n, ids, q in (g for b in mine if b.num_rows for g in arrays(b)):
            block[n] = ids, q, base + np.arange(len(ids))
            names += ids.tolist()
            base += len(ids)
        named = F.broadcast(spark.createDataFrame([(k, i) for k, i in enumerate(names)], "row long, query_id long"))  # the block's queries
        first = written(found_by(table.where("turn = 0"), block, {}), "top-first")
        best = first.dropDuplicates(["row", "vec_id"]).withColumn("k", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score")))).where(F.col("k") == TOP)
        rest = found_by(table.where("turn > 0"), block, {r.row: r.score for r in best.select("row", "score").collect()})
        first.unionByName(rest).join(named, "row").select("query_id", "vec_id", "score").write.mode("append").parquet(path)
    best = spark.read.schema(out).parquet(path).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= TOP).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_products(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLE = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256e0 * x::double)) as e from embeddings
    where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
    from (select * from v where vec_id % 50 = 0) q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e)
)
select query_id, rank::integer as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""
