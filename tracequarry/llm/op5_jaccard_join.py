"""Exact Jaccard join of word n-gram sets, with set-relation skipping, and its connected components.

1. Texts become sets of 64-bit shingle hashes; equal sets are one class (known by a 128-bit digest), so exact copies cost nothing more.
2. Extended prefix filter: of two linked sets, the prefixes of n - ceil(t n) + l hashes share at least l. Counting the prefixes' hashes
   leaves the classes with enough hashes that another class has too; only their whole sets are made again, from their texts.
3. Their prefixes (hashes in more than HOT of them last, by that number) give index lists; lists with the same members are one, weighted.
   Pairs of short lists (SHORT members at most) are counted, and remain if these and the long lists of both could make up what links must
   share. Sets with so many long lists that these alone could do so hang together by them. What hangs together is joined at one place, so
   each set moves once; beyond BLOCK_TOKENS hashes or BLOCK_SETS sets it is dealt in blocks by set size and hash, and pairs of blocks
   whose sizes can't link are left out.
4. In a block pair, index lists hold a prefix's hashes in order of set size, then position. A list's entries of one size are a block: the
   search of a set skips blocks whose size rules the hash's position out, and the rest of a block from the position on at which what
   follows in the two sets can't make a link. A set with candidates has its overlaps counted from whole lists; for a set that is highly
   similar to one so counted they are derived from that one's, by the lists of the hashes in which the two differ. What leaves is a
   spanning forest of the links and each set's number of links, never the pairs.
5. The forests' edges are contracted to components.

A null or empty text, or one without words, has an empty set, links with nothing, and its component is its own doc_id. Repeated rows each
get their row and count as links of each other; a null id is passed over for the component's id. Only doc_id and text are read, an empty
table gives an empty result. Hashes of 64 bits stand for shingles: two different shingles of one pair coincide with odds of about 2**-45.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import chunks, discard, read, text_of, written
from .components import components

WORDS, PERCENT = 4, 85
#: Share of a set's hashes by which the first filter's prefixes are longer than needed.
EXTRA = 0.05
BLOCK_TOKENS, BLOCK_SETS, HOT, HOT_MOST, SHORT = 1_000_000, 800, 50, 200_000, 32
#: The same for the prefixes that make the index lists.
LIST_EXTRA = 0.1
#: Ids that may be broadcast (16 bytes each); beyond, texts are shuffled.
BROADCAST_IDS = 1_000_000
BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
INVERSE = U(pow(int(MULTIPLIER), -1, 1 << 64))


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, in order."""
    with np.errstate(over="ignore"):
        coded = [t.encode() for t in texts]
        data = LOWER[np.frombuffer(b" ".join(coded) + b" ", np.uint8)]
        blank = BLANK[data]
        start = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        end = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
        steps = np.full(len(data), MULTIPLIER)
        steps[0] = 1
        power = np.cumprod(steps)
        total = np.concatenate([[U(0)], np.cumsum(LETTERS[data] * power)])
        back = np.full(len(data), INVERSE)
        back[0] = 1
        word = mix((total[end] - total[start]) * np.cumprod(back)[start] + (end - start).astype(np.uint64))
        run = word.copy()
        for k in range(1, words):
            run = mix(run * MULTIPLIER + np.concatenate([word[k:], np.zeros(min(k, len(word)), np.uint64)])[: len(word)])
        upto = np.searchsorted(start, np.cumsum([len(c) + 1 for c in coded])).tolist()
        out, before = [], 0
        for to in upto:
            n = to - before
            if n >= words:
                out.append(np.unique(run[before : to - words + 1]))
            elif n:
                x = word[before : before + 1]
                for k in range(before + 1, to):
                    x = mix(x * MULTIPLIER + word[k : k + 1])
                out.append(mix(x + U(n)))
            else:
                out.append(np.zeros(0, np.uint64))
            before = to
    return out


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def extra(n: int) -> int:
    return max(1, int(EXTRA * n))


def digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _sets(batches: Iterator[pa.RecordBatch], words: int, percent: int, whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        sets = shingle_sets(batch.column(1).to_pylist(), words)
        part = sets if whole else [s[: len(s) - least_overlap(len(s), percent) + extra(len(s))] for s in sets]
        size = np.concatenate([[0], np.cumsum([len(p) for p in part])]).astype(np.int32)
        tokens = pa.ListArray.from_arrays(pa.array(size), pa.array(np.concatenate(part).view(np.int64) if part else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), tokens], ["doc_id", "n", "cls", "tokens"])


def set_table(rows: DataFrame, words: int, percent: int, whole: bool) -> DataFrame:
    """doc_id, n, cls, tokens of rows (doc_id, text); tokens: all hashes, or the first filter's prefix."""
    return rows.mapInArrow(lambda b: _sets(b, words, percent, whole), "doc_id long, n long, cls binary, tokens array<long>")


def key_of(cls: str = "cls"):
    """64 bits of the digest, for filters that may keep too much."""
    return F.xxhash64(cls)


def candidate_classes(own: DataFrame, percent: int) -> DataFrame:
    """Keys of the classes (cls, n, tokens; one row each) with enough prefix hashes that another class's prefix has too."""
    each = own.select(key_of().alias("key"), "n", F.explode("tokens").alias("token"))
    twice = each.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    partner = F.ceil(F.col("n") * percent / 100)
    need = F.greatest(F.lit(1), F.floor(partner * F.lit(EXTRA) - F.lit(1e-6)))
    return each.join(twice, "token", "left_semi").groupBy("key", "n").agg(F.count("*").alias("k")).where(F.col("k") >= need).select("key")


def _postings(whole: DataFrame, percent: int, hot: np.ndarray, count: np.ndarray) -> DataFrame:
    """cls, n, token of the prefixes; hot hashes, in order, come last, by their count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, n, token = [], [], []
            for c, tokens in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = tokens.values.to_numpy()
                p = len(t) - least_overlap(len(t), percent) + max(1, int(LIST_EXTRA * len(t)))
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, t), len(hot) - 1)
                    t = t[np.argsort(np.where(hot[at] == t, count[at], 0), kind="stable")]
                token.append(t[:p])
                cls += [c] * p
                n += [len(t)] * p
            if cls:
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(n, pa.int64()), pa.array(np.concatenate(token))], ["cls", "n", "token"])

    return whole.select("cls", "tokens").mapInArrow(run, "cls binary, n long, token long")


def bounded(ids: DataFrame, most: int) -> DataFrame:
    """A written table of ids, to be broadcast if it has at most so many rows."""
    return F.broadcast(ids) if ids.count() <= most else ids


def one_of_class(rows: DataFrame, classes: DataFrame, words: int, percent: int, broadcast_ids: int) -> DataFrame:
    """cls, n and prefix tokens of every class with hashes, from the text of its first row; nothing is stored, so texts are read per use."""
    first = bounded(classes.where("mult > 1").select(key_of().alias("key"), "first", F.lit(True).alias("copied")), broadcast_ids)
    each = set_table(rows, words, percent, False).where("n > 0").withColumn("key", key_of()).join(first, "key", "left")
    return each.where(F.col("copied").isNull() | F.col("doc_id").eqNullSafe(F.col("first"))).select("cls", "n", "tokens")


def index_lists(whole: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The postings (cls, n, token) and the lists (token, m, total, weight) of two or more sets; those with the same members are one."""
    none = np.zeros(0, np.int64)
    counts = _postings(whole, percent, none, none).groupBy("token").agg(F.count("*").alias("k")).where(F.col("k") > HOT)
    hot = counts.orderBy(F.desc("k"), "token").limit(HOT_MOST).toPandas().sort_values("token")  # any order will do that is the same for all sets
    postings = written(_postings(whole, percent, hot["token"].to_numpy(np.int64), hot["k"].to_numpy(np.int64)), "postings")
    lists = postings.groupBy("token").agg(F.count("*").alias("m"), F.min("n").alias("least"), F.max("n").alias("most"), F.bit_xor(F.xxhash64("cls")).alias("s1"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("s2"))
    lists = lists.where("m > 1").where(f"m > 2 or least * 100 >= most * {percent}")
    return postings, written(lists.groupBy("s1", "s2", "m").agg(F.min("token").alias("token"), F.count("*").alias("weight")), "lists")


def least_shared(n):
    """How many prefix hashes links of a set of n hashes, the smaller one, share."""
    return F.greatest(F.lit(1), F.floor(n * F.lit(LIST_EXTRA) - F.lit(1e-6)))


def short_pairs(postings: DataFrame, lists: DataFrame, long: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs that can share enough prefix hashes, one at least by short lists; such a list gives SHORT * SHORT / 2 pairs at most.

    long: cls, n_long, how many hashes of long lists a set has; a pair shares no more of them than either has.
    """
    rows = postings.join(lists.where(F.col("m") <= SHORT).select("token", "weight"), "token").join(long.select("cls", "n_long"), "cls", "left").na.fill(0, ["n_long"])
    groups = rows.groupBy("token", "weight").agg(F.array_sort(F.collect_list(F.struct("n", "cls", "n_long"))).alias("g"))
    each = groups.select("weight", "g", F.posexplode("g").alias("i", "x")).select("weight", "x", F.explode(F.slice(F.col("g"), F.col("i") + 2, F.lit(SHORT))).alias("y"))
    each = each.where(F.col("x.n") * 100 >= F.col("y.n") * percent)
    shared = each.groupBy(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), F.col("x.n").alias("n"), F.least("x.n_long", "y.n_long").alias("more")).agg(F.sum("weight").alias("k"))
    return shared.where(F.col("k") + F.col("more") >= least_shared(F.col("n"))).select("a", "b")


def long_edges(members: DataFrame, long: DataFrame, percent: int) -> DataFrame:
    """a, b: from each set whose long lists alone could make a link to the least such set of each of its lists; members: cls, token."""
    able = long.where(F.col("n_long") >= least_shared(F.ceil(F.col("n") * percent / 100))).select("cls")
    rows = members.join(able, "cls", "left_semi")
    least = rows.groupBy("token").agg(F.min("cls").alias("b"), F.count("*").alias("m")).where("m > 1")
    return rows.join(least, "token").select(F.col("cls").alias("a"), "b")


def dealt(places: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """bundle, left, right, block, cls: the block pairs to which each set of places (cls, bundle) goes; a small bundle is one pair.

    A size class spans a little more than linked sets can differ by, so links are within a class or between two in a row. Each class of a
    large bundle has as many blocks as it needs; a set meets those of its own class and of the two beside it.
    """
    rows = places.join(sizes, "cls")
    total = rows.groupBy("bundle").agg(F.sum("n").alias("tokens"), F.count("*").alias("m"))
    beyond = written(total.where((F.col("tokens") > BLOCK_TOKENS) | (F.col("m") > BLOCK_SETS)).select("bundle"), "large")
    some = bounded(beyond, BROADCAST_IDS)
    c = F.floor(F.log(F.col("n").cast("double")) / -math.log((percent - 1) / 100)).cast("int")
    small, large = rows.join(some, "bundle", "left_anti"), rows.join(some, "bundle", "left_semi").withColumn("c", c)
    block = lambda c, r: F.struct(c.cast("int").alias("c"), r.cast("int").alias("r"))
    pair = lambda a, b: F.struct(F.least(a, b).alias("left"), F.greatest(a, b).alias("right"))
    count = large.groupBy("bundle", "c").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_TOKENS), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("k"))
    count = written(count, "blocks")
    few = count.count() <= BROADCAST_IDS // 4
    for d in (-1, 0, 1):
        large = large.join((F.broadcast(count) if few else count).select("bundle", (F.col("c") - d).alias("c"), F.col("k").alias(f"k{d + 1}")), ["bundle", "c"], "left")
    own = block(F.col("c"), F.pmod(F.xxhash64("cls"), F.col("k1")))
    near = F.flatten(F.array(*(_near(F.col("c"), F.col(f"k{d + 1}"), own, pair, block, d) for d in (-1, 0, 1))))
    large = large.select("bundle", "cls", own.alias("block"), F.explode(near).alias("pair")).select("bundle", "pair.left", "pair.right", "block", "cls")
    one = block(F.lit(0), F.lit(0))
    return small.select("bundle", one.alias("left"), one.alias("right"), one.alias("block"), "cls").union(large)


def _near(c, k, own, pair, block, d: int):
    there = F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(there, lambda x: pair(own, block(c + d, x)))


def spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start[0], ..., end[0] - 1, start[1], ..."""
    n = np.maximum(end - start, 0)
    upto = np.cumsum(n)
    return np.repeat(start - (upto - n), n) + np.arange(int(upto[-1]) if len(upto) else 0)


class Index:
    """Index lists of sets that are numbered by size.

    Whole lists hold the numbers of the sets with an item, in order. Prefix lists hold an item's entries (set, position) of the prefixes, by
    set size and position; entries of one item and size are a block. Items are in order of frequency, rare ones first.
    """

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.size = size = np.array([len(s) for s in sets])
        self.percent = percent
        _, item, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(often), np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(len(often))
        self.own = [np.sort(x) for x in np.split(rank[item], np.cumsum(size)[:-1])]
        item, who = np.concatenate(self.own), np.repeat(np.arange(len(sets)), size)
        self.who = who[np.argsort(item, kind="stable")]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(item, minlength=len(often)))])
        self.place = np.sort(item.astype(np.int64) * len(sets) + who)
        self.prefix = size + percent * size // -100 + 1  # n - ceil(t n) + 1
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        at = spans(first, first + self.prefix)
        item, who, position = item[at], who[at], at - first[who[at]]
        order = np.lexsort((position, size[who], item))
        item, self.entry, self.position = item[order], who[order], position[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(item) != 0) | (np.diff(size[self.entry]) != 0)]))
        self.block, self.block_size = np.append(new, len(item)), size[self.entry[new]]
        self.blocks_of = np.searchsorted(item[new], np.arange(len(often) + 1))
        self.longest = int(size.max()) + 1
        self.key = np.repeat(np.arange(len(new)), np.diff(self.block)) * self.longest + self.position

    def overlap(self, n: int, m: np.ndarray) -> np.ndarray:
        """The least overlap of linked sets of sizes n and m."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def candidates(self, i: int) -> np.ndarray:
        """The sets, of size n or more, that the prefix lists leave for set i: the others' blocks, or their ends, are skipped."""
        n, items = self.size[i], self.own[i][: self.prefix[i]]
        b = spans(self.blocks_of[items], self.blocks_of[items + 1])
        at = np.repeat(np.arange(len(items)), self.blocks_of[items + 1] - self.blocks_of[items])
        m = self.block_size[b]
        least = self.overlap(n, m)
        open_ = (m >= n) & (m * self.percent <= 100 * n) & (at <= n - least)
        b, m, least = b[open_], m[open_], least[open_]
        end = np.searchsorted(self.key, b * self.longest + (m - least), side="right")
        return np.unique(self.entry[spans(self.block[b], np.minimum(end, self.block[b + 1]))])

    def counts(self, items: np.ndarray, low: int, high: int) -> np.ndarray:
        """Of each set from low to high - 1: in how many of the items' whole lists it is; the lists' other parts are skipped."""
        base = items.astype(np.int64) * len(self.own)
        found = self.who[spans(np.searchsorted(self.place, base + low), np.searchsorted(self.place, base + high))]
        return np.bincount(found - low, minlength=high - low)


#: Counted overlaps that a group keeps for others to be derived from; of older ones, sets are counted anew.
KEPT_COUNTS = 16_000_000


def links_of_group(n: np.ndarray, tokens: list[np.ndarray], left: np.ndarray, same: bool, percent: int) -> tuple[list[tuple[int, int]], list[tuple[int, np.ndarray]]]:
    """Edges of a spanning forest of the links, and for each set with links the numbers of the sets linked to it after it by size.

    left: whether a set is in the left block; same: the blocks are one. Sets are given by size.
    """
    index = Index(tokens, percent)
    component = np.arange(len(n))
    high = np.searchsorted(n * percent, n * 100, side="right")  # sets up to here are small enough to link
    edges, found = [], []
    kept: dict[int, np.ndarray] = {}
    closest, shared = np.full(len(n), -1), np.zeros(len(n), np.int64)  # of the counted sets, the one a set shares most with, and how much
    for i in range(len(n)):
        low, to = i + 1, int(high[i])
        own, near = index.own[i], int(closest[i])
        apart = len(own) + int(n[near]) - 2 * int(shared[i]) if near in kept else 0
        derived = near in kept and 2 * apart < len(own) and near + 1 + len(kept[near]) >= to
        if to <= low or not derived and not (index.candidates(i) > i).any():
            continue
        if derived:
            was = index.own[near]
            overlap = kept[near][low - near - 1 : to - near - 1] - index.counts(np.setdiff1d(was, own, assume_unique=True), low, to) + index.counts(np.setdiff1d(own, was, assume_unique=True), low, to)
        else:
            wide = int(high[to - 1])  # so that sets linked to this one can be derived
            overlap = index.counts(own, low, wide)
            kept[i] = overlap
            while len(kept) > 1 and sum(map(len, kept.values())) > KEPT_COUNTS:
                del kept[next(iter(kept))]
            closer = np.flatnonzero(overlap > shared[low:wide]) + low
            closest[closer], shared[closer] = i, overlap[closer - low]
            overlap = overlap[: to - low]
        m = n[low:to]
        hit = 100 * overlap >= percent * (m + n[i] - overlap)
        if not same:
            hit &= left[low:to] != left[i]
        hit = np.flatnonzero(hit) + low
        if len(hit):
            found.append((i, hit))
            for other in np.unique(component[hit]).tolist():
                if other != component[i]:
                    edges.append((i, int(hit[component[hit] == other][0])))
                    component[component == other] = component[i]
    return edges, found


def _join_groups(pairs: DataFrame, percent: int) -> DataFrame:
    """a, b of forest edges, and rows with b null and the number of links of a."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        same = first["left"] == first["right"]
        group = group.assign(n=[len(t) for t in group["tokens"]]).sort_values(["n", "cls"], ignore_index=True)
        n, cls, mult = group["n"].to_numpy(), group["cls"].tolist(), group["mult"].to_numpy()
        left = np.array([b == first["left"] for b in group["block"]])
        edges, found = links_of_group(n, list(group["tokens"]), left, same, percent)
        total = np.zeros(len(n), np.int64)
        for i, hit in found:
            total[i] += mult[hit].sum()
            total[hit] += mult[i]
        some = np.flatnonzero(total)
        return pd.DataFrame({"a": [cls[i] for i, _ in edges] + [cls[i] for i in some], "b": [cls[j] for _, j in edges] + [None] * len(some), "k": [0] * len(edges) + total[some].tolist()})

    return pairs.groupBy("bundle", "left", "right").applyInPandas(run, "a binary, b binary, k long")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, broadcast_ids: int = BROADCAST_IDS, classes_too: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of each row of docs (doc_id, text); classes_too: also cls and its component's label."""
    more = ["label"] if classes_too else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    named_rows = written(set_table(rows, words, percent, False).select("doc_id", "n", "cls"), "rows")
    classes = written(named_rows.groupBy("cls", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("mult")), "classes")
    keys = written(candidate_classes(one_of_class(rows, classes, words, percent, broadcast_ids), percent), "candidates")
    chosen = written(classes.withColumn("key", key_of()).join(bounded(keys, broadcast_ids), "key", "left_semi").select("cls", F.col("first").alias("doc_id"), "mult"), "chosen")
    discard(keys)
    n_chosen = chosen.count()
    ids = chosen.select("doc_id").distinct()
    again = rows.alias("r").join((F.broadcast(ids) if n_chosen <= broadcast_ids else ids).alias("i"), F.col("r.doc_id").eqNullSafe(F.col("i.doc_id")), "left_semi")
    same = F.col("w.cls").eqNullSafe(F.col("c.cls")) & F.col("w.doc_id").eqNullSafe(F.col("c.doc_id"))
    whole = written(set_table(again, words, percent, True).alias("w").join((F.broadcast(chosen) if n_chosen <= broadcast_ids else chosen).alias("c"), same).select("w.cls", "n", "mult", "tokens"), "whole-sets")
    if whole.count() > n_chosen:  # repeated rows of one id and text
        repeated, whole = whole, written(whole.dropDuplicates(["cls"]), "whole-sets")
        discard(repeated)
    sizes = whole.select("cls", "n")
    postings, lists = index_lists(whole, percent)
    members = written(postings.join(lists.where(F.col("m") > SHORT).select("token", "weight"), "token").select("cls", "n", "token", "weight"), "long-lists")
    long = written(members.groupBy("cls", "n").agg(F.sum("weight").alias("n_long")), "long")
    label = components(short_pairs(postings, lists, long, percent).union(long_edges(members, long, percent)))
    places = written(label.select(F.col("node").alias("cls"), F.col("label").alias("bundle")), "places")
    discard(chosen, postings, lists, members, long, label)
    parts = written(dealt(places, sizes, percent), "dealt")
    links = written(_join_groups(whole.select("cls", "mult", "tokens").join(bounded(parts, broadcast_ids // 4), "cls"), percent), "links")
    discard(whole, places, parts)
    label = components(links.where("b is not null"))
    number = links.where("b is null").groupBy("a").agg(F.sum("k").alias("links"))
    named = classes.join(label.select(F.col("node").alias("cls"), "label"), "cls", "left").join(number.withColumnRenamed("a", "cls"), "cls", "left")
    named = named.select("cls", "n", "first", "mult", F.coalesce("label", "cls").alias("label"), F.coalesce("links", F.lit(0)).alias("links"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    named = written(named.join(least, "label").select("cls", "n", "component_id", (F.col("links") + F.col("mult") - 1).alias("n_links"), *more).where("n > 0"), "named")
    discard(links, classes, label)
    out = named_rows.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(named.drop("n"), "cls", "left")
    empty = F.col("n_shingles") == 0
    return out.select("doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(empty, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), *(["cls"] if more else []), *more)


def _with_class(docs: DataFrame, words: int) -> DataFrame:
    """docs with the class of each text as _op5_cls."""
    at, names = docs.columns.index("text"), [*docs.columns, "_op5_cls"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, at):
            sets = shingle_sets([t or "" for t in batch.column(at).to_pylist()], words)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([digest(s) for s in sets], pa.binary())], names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_op5_cls", BinaryType())]))


def one_of_each(docs: DataFrame, words: int, percent: int, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """docs without the rows whose text's component has a smaller doc_id; of rows with one doc_id and text class the first stays.

    If a component's least doc_id has several of its texts, one of them stays. Rows with a null doc_id can't be told apart and stay.
    """
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    found = written(jaccard_components(docs, words, percent, broadcast_ids, bool(again)).select("doc_id", "component_id", *(["cls", "label"] if again else [])), "groups")
    if not again:
        lost = found.where("doc_id <> component_id").select("doc_id").distinct()
        return docs.join(F.broadcast(lost) if lost.count() <= broadcast_ids else lost, "doc_id", "left_anti").select(*docs.columns)
    known = found.where("doc_id is not null and label is not null")
    first = known.groupBy("label").agg(F.min(F.struct("doc_id", "cls")).alias("first"))
    lost = written(known.join(first, "label").where(F.struct("doc_id", "cls") != F.col("first")).select("doc_id", F.col("cls").alias("_op5_cls")).distinct(), "lost")
    kept = _with_class(docs, words).join(bounded(lost, broadcast_ids), ["doc_id", "_op5_cls"], "left_anti")
    return kept.where("doc_id is not null").dropDuplicates(["doc_id", "_op5_cls"]).union(kept.where("doc_id is null")).select(*docs.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))
