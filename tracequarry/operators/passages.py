"""Passages of documents and a stored index of them: chunks under headings, postings in blocks, top-k that skips blocks by their maxima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracequarry.functions.profiles import bare_code, codes_like, template
from tracequarry.operators.retrieval import K1, B, pdf_level, tokens
from tracequarry.sources.numbering import numbered
from tracequarry.sources.store import Generations, discard, written

#: Characters after which a chunk is cut, headings that a breadcrumb has, ends of lines, headings of text documents, what a chunk
#: without heading is called; the score below which a passage isn't relevant, in corpora of so many chunks.
CHUNK, DEPTH = 1200, 3
LINE_ENDS = "\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
HEADING = r"^(#{1,6})\s+(.*)"
NO_HEADING = "(no heading)"
FLOOR, FLOOR_FROM = 20.0, 50
#: Passages in one block of the postings; blocks that one group makes; query words up to which blocks are read without being dealt.
RANGE, GROUP, FEW = 64, 16, 100_000

CHUNKS = "source string, heading string, text string, start_line long, page long"


def text_lines_of(docs: DataFrame) -> DataFrame:
    """source, lines, levels, titles, pages of texts with marked headings."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), LINE_ENDS, "\n")
    lines = F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)
    level = lambda x: F.least(F.length(F.regexp_extract(x, HEADING, 1)), F.lit(DEPTH))
    x = docs.select("source", lines.alias("lines"))
    return x.select("source", "lines", F.transform("lines", level).alias("levels"), F.transform("lines", lambda x: F.regexp_extract(x, HEADING, 2)).alias("titles"), F.lit(None).cast("array<int>").alias("pages"))


def paged_lines_of(docs: DataFrame) -> DataFrame:
    """The same of texts whose pages end at form feeds and whose headings are told by their looks; lines of nothing but form feeds are left out."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    x = docs.select("source", lines.alias("raw"))
    bare = F.transform("raw", lambda x: F.replace(x, F.lit("\f"), F.lit("")))
    x = x.select("source", "raw", bare.alias("lines"))
    skipped = F.zip_with("raw", "lines", lambda r, x: (F.length(r) > F.length(x)) & (F.trim(x) == ""))
    levels = F.zip_with(F.transform("lines", lambda x: pdf_level(x)), skipped, lambda k, gone: F.when(gone, -1).otherwise(k))
    return x.select("source", "lines", levels.alias("levels"), F.col("lines").alias("titles"), F.zip_with("raw", "lines", lambda r, x: F.length(r) - F.length(x)).alias("pages"))


def chunks(lines: DataFrame) -> DataFrame:
    """CHUNKS of source, lines, levels (0: text, 1 to 3: a heading, -1: left out), titles and pages (form feeds in each line, or null).

    A chunk's first lines go on until their characters exceed CHUNK, or a heading comes. Where each line's chunk would end is found for all
    lines of a batch at once, from sums of their lengths; which of these cuts are made follows by doubling the jumps from the sections'
    first lines. Every document is cut where it lies, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                yield cut(batch.slice(k, 64))

    return lines.mapInArrow(run, CHUNKS)


def last_before(hit: np.ndarray) -> np.ndarray:
    """For each place the last place up to it that is hit, else -1."""
    return np.maximum.accumulate(np.where(hit, np.arange(len(hit)), -1)) if len(hit) else np.zeros(0, np.int64)


def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    column = batch.column(1)
    text = column.flatten()
    sizes = np.diff(column.offsets.to_numpy())
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    n, place = len(text), np.arange(len(text))
    if not n:
        return pa.RecordBatch.from_pylist([], pa.schema([("source", pa.string()), ("heading", pa.string()), ("text", pa.string()), ("start_line", pa.int64()), ("page", pa.int64())]))
    level = batch.column(2).flatten().to_numpy(zero_copy_only=False)
    titles = batch.column(3).flatten()
    first = np.zeros(n, bool)
    first[(ends - sizes)[sizes > 0]] = True
    number = place - last_before(first) + 1
    body = np.flatnonzero(level == 0)
    # Sections: stretches of lines of one document without a heading between them, among the lines of text alone.
    section = np.cumsum(first | (level > 0))[body]
    size = pc.utf8_length(text).to_numpy(zero_copy_only=False)[body]
    before = np.cumsum(size) - size
    jump = np.searchsorted(before, before + CHUNK, side="right")
    jump = np.minimum(jump, np.searchsorted(section, section, side="right"))
    jump = np.append(jump, len(body))  # the end leads to itself
    starts = np.flatnonzero(np.diff(section, prepend=-1))
    open_ = np.searchsorted(section, section[starts], side="right")  # where the section of each start ends
    found, limit = starts, open_
    while len(starts):
        nxt = jump[starts]
        ok = nxt < limit
        new, over = nxt[ok], limit[ok]
        # all starts found so far, moved on by the doubled jump
        found = np.concatenate([found, new])
        starts, limit = np.concatenate([starts, new]), np.concatenate([limit, over])
        if not len(new):
            break
        jump = jump[jump]
    found = np.unique(found)
    until = np.minimum(np.append(found[1:], len(body)), np.searchsorted(section, section[found], side="right")) if len(found) else found
    at, told = body[found] if len(found) else found, []
    words = text.to_pylist()
    flat = [words[i] for i in body.tolist()]
    told = ["\n".join(flat[a:b]).strip() for a, b in zip(found.tolist(), until.tolist(), strict=True)]
    # The headings in force: of each level the last, unless one of a higher level came after it.
    crumbs, barrier = [], np.full(n, -1)
    start_of_doc = last_before(first)
    for k in range(1, DEPTH + 1):
        own = last_before(level == k)
        crumbs.append(np.where((own > barrier) & (own >= start_of_doc), own, -1)[at])
        barrier = np.maximum(barrier, own)
    name = titles.to_pylist()
    strip = lambda i: (name[i] or "").strip() if i >= 0 else ""
    headings = [" > ".join(h for h in (strip(i) for i in triple) if h) or NO_HEADING for triple in zip(*(c.tolist() for c in crumbs), strict=True)]
    feeds = batch.column(4)
    if feeds.null_count == len(feeds):
        pages = pa.nulls(len(at), pa.int64())
    else:
        passed = np.cumsum(feeds.flatten().to_numpy(zero_copy_only=False))
        pages = pa.array((1 + passed - np.where(start_of_doc > 0, passed[np.maximum(start_of_doc - 1, 0)], 0))[at], pa.int64())
    out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[at])), pa.array(headings, pa.string()), pa.array(told, pa.string()), pa.array(number[at], pa.int64()), pages], ["source", "heading", "text", "start_line", "page"])
    return out.filter(pc.not_equal(out.column(2), ""))


def crumb_and_text(heading: Column, text: Column) -> Column:
    return F.concat(F.when(heading == NO_HEADING, "").otherwise(heading), F.lit(" "), text)


STORED = f"id long, {CHUNKS}, len long"
BLOCKS = "token string, range long, ids array<long>, tfs array<int>, lens array<int>, most double"
MADE = f"{BLOCKS}, top array<double>"
WORDS = "token string, df long, best array<double>"
STATS = "n long, avg_len double"


def blocks_of(rows: DataFrame, avg: float, keep: int) -> DataFrame:
    """MADE of chunks (id, len, tokens): the blocks of GROUP ranges are made together, so a chunk's tokens are dealt once and as they are.

    top, in the first block of a token and group, has the token's `keep` greatest factors there; it is empty in the others.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        ids, lens = t.column("id").to_numpy(), t.column("len").to_numpy()
        found = t.column("tokens").combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.string()))
        found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
        coded = found.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(ids)), pc.list_value_length(found).to_numpy(zero_copy_only=False))
        key, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(ids)) + row, return_counts=True)
        token, row = key // max(1, len(ids)), key % max(1, len(ids))
        part, n = ids[row] // RANGE, len(key)
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * (np.maximum(lens[row], 1) / (avg if avg > 0 else 1.0))))
        fresh = np.diff(token, prepend=-1) != 0
        at = np.flatnonzero(fresh | (np.diff(part, prepend=-1) != 0))
        order = np.lexsort((-weight, token))  # token by token as before, the greatest first
        place = np.arange(n) - last_before(fresh)
        best = weight[order][place < keep]
        many = np.where(fresh[at], np.bincount(token, minlength=1).clip(max=keep)[token[at]] if n else 0, 0)
        lists = lambda values, kind, ends: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, kind))
        ends = np.append(at, n)
        columns = [coded.dictionary.take(pa.array(token[at])), pa.array(part[at]), lists(ids[row], pa.int64(), ends), lists(tf, pa.int32(), ends), lists(lens[row], pa.int32(), ends), pa.array(np.maximum.reduceat(weight, at) if n else np.zeros(0)), lists(best, pa.float64(), np.append(0, np.cumsum(many)))]
        return pa.Table.from_arrays(columns, ["token", "range", "ids", "tfs", "lens", "most", "top"])

    return rows.groupBy(F.floor(F.col("id") / (RANGE * GROUP)).alias("_group")).applyInArrow(run, MADE)


class PassageIndex:
    """Stored tables of a corpus: chunks with ids in the order of source and line, statistics, and postings in blocks of RANGE ids.

    Postings are made when they are first asked for: what only tells of chunks doesn't need them.

    Every block has the greatest factor that a passage of it can give its token; every token has its KEEP greatest ones. Searching reads
    blocks, tokens and statistics, never the texts.
    """

    KEEP, SEEDS = 16, 4

    def __init__(self, spark: SparkSession, path: str):
        self.store = Generations(spark, path)
        self.names: list[str] | None = None
        self.made: str | None = None

    def _table(self, name: str, schema: str) -> DataFrame:
        if self.names is None:
            self.names = self.store.commits()[-1:]
        if name in ("blocks", "words") and self.names:
            return self.posted().read(name, schema, self.names)
        return self.store.read(name, schema, self.names)

    def build(self, found: DataFrame) -> PassageIndex:
        """Stores the chunks (CHUNKS) with their ids and statistics."""
        name = self.store.begin()
        length = F.size(tokens(crumb_and_text(F.col("heading"), F.col("text")))).cast("long")
        # A short key stands for the source, so no text but the chunks' own is sorted; equal keys are told apart by the source.
        cut = written(found.withColumn("len", length).withColumn("corpus", F.lit(0)), "chunks")  # else ranges are sought by cutting all texts once more
        rows = numbered(cut, ["corpus"], ["source", "start_line", "page"], "id")
        self.store.write(rows.select(*(c.split()[0] for c in STORED.split(", "))), name, "chunks")
        discard(rows)
        discard(cut)
        self.names = [name]
        c = self.chunks()
        self.store.write(c.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len")).coalesce(1), name, "stats")
        self.store.commit(name)
        return self

    def posted(self) -> Generations:
        """The tables of the postings of the chunks, under the same name."""
        store, name = Generations(self.store.spark, f"{self.store.path}/postings"), self.names[0]
        if self.made == name or name in store.commits():
            self.made = name
            return store
        avg = self.stats().first().avg_len or 1.0
        rows = self.chunks().select("id", "len", tokens(crumb_and_text(F.col("heading"), F.col("text"))).alias("tokens"))
        # A writer that failed left tables under the name: they are written over.
        blocks_of(rows, avg, self.KEEP).write.mode("overwrite").parquet(f"{store.path}/blocks/generation={name}")
        best = store.read("blocks", MADE, [name]).select("token", "range", F.size("ids").alias("m"), F.col("top").alias("b"))
        # Of a frequent token only what can be among the best goes on: first the best of groups of blocks, then of those.
        kept = F.slice(F.sort_array(F.flatten(F.collect_list(F.when(F.size("b") > 0, F.col("b")))), False), 1, self.KEEP).alias("b")
        part = best.groupBy("token", F.floor(F.col("range") / (RANGE * GROUP)).alias("g")).agg(F.sum("m").alias("m"), kept)
        words = part.groupBy("token").agg(F.sum("m").alias("df"), kept.alias("best"))
        words.write.mode("overwrite").parquet(f"{store.path}/words/generation={name}")
        store.commit(name)
        self.made = name
        return store

    def asked(self, words: DataFrame) -> DataFrame:
        """words for a join with the blocks: sent to all executors if they are FEW, else dealt with the blocks by token."""
        return F.broadcast(words) if words.select(F.lit(1)).limit(FEW + 1).count() <= FEW else words

    def chunks(self) -> DataFrame:
        return self._table("chunks", STORED)

    def stats(self) -> DataFrame:
        return self._table("stats", STATS)

    def words(self, asked: DataFrame) -> DataFrame:
        """qid, token, w, avg_len, best: the words of queries (qid, text) that the corpus has, with their weights."""
        each = asked.select("qid", F.explode(tokens(F.col("text"))).alias("token")).where(F.length("token") > 1).groupBy("qid", "token").agg(F.count("*").alias("qf"))
        idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
        x = self._table("words", WORDS).join(self.asked(each), "token").crossJoin(F.broadcast(self.stats()))  # one row
        return x.select("qid", "token", (F.col("qf") * idf).alias("w"), "avg_len", "best")

    def scores(self, words: DataFrame, ranges: DataFrame) -> DataFrame:
        """qid, id, s of all passages in ranges (qid, range) that have a word."""
        x = self._table("blocks", BLOCKS).drop("most").join(self.asked(words.select("qid", "token", "w", "avg_len")), "token").join(ranges, ["qid", "range"], "left_semi")
        x = x.select("qid", "w", "avg_len", F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("e"))
        return x.groupBy("qid", F.col("e.ids").alias("id")).agg(F.sum(F.col("w") * factor(F.col("e.tfs"), F.col("e.lens"), F.col("avg_len"))).alias("s"))

    def candidates(self, words: DataFrame, k: int) -> DataFrame:
        """qid, range: where a passage among the k best can be.

        The blocks' maxima of a range together bound its scores. The kth score is bounded from below by the kth best factor of any word,
        as a passage scores at least what one word gives it, and by the kth score within the SEEDS ranges of the highest bounds.
        """
        kth = words.groupBy("qid").agg(F.coalesce(F.max(F.when(F.size("best") >= k, F.col("w") * F.get("best", F.lit(k - 1)))), F.lit(0.0)).alias("one"))
        bounds = self._table("blocks", BLOCKS).select("token", "range", "most").join(self.asked(words.select("qid", "token", "w")), "token")
        bounds = written(bounds.groupBy("qid", "range").agg(F.sum(F.col("w") * F.col("most")).alias("bound")), "bounds")  # read twice
        first = Window.partitionBy("qid").orderBy(F.desc("bound"), "range")
        seeds = bounds.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= self.SEEDS).select("qid", "range")
        best = Window.partitionBy("qid").orderBy(F.desc("s"), "id")
        reached = self.scores(words, seeds).withColumn("_k", F.row_number().over(best)).where(F.col("_k") == k).select("qid", F.col("s").alias("several"))
        need = kth.join(reached, "qid", "left").select("qid", F.greatest("one", F.coalesce("several", F.lit(0.0))).alias("need"))
        return bounds.join(need, "qid").where(F.col("bound") * (1 + 1e-6) + 1e-6 >= F.col("need")).select("qid", "range")

    def search(self, asked: DataFrame, k: int = 5) -> DataFrame:
        """qid, id, score (BM25) of the k best passages of queries (qid, text); of equal scores, to six places, the lower ids."""
        if k > self.KEEP:
            raise ValueError(f"k goes up to {self.KEEP}")
        words = written(self.words(asked), "asked")  # read by each step of the search
        best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
        scored = self.scores(words, self.candidates(words, k)).select("qid", "id", F.round("s", 6).alias("score"))
        return scored.withColumn("k", F.row_number().over(best)).where(F.col("k") <= k).drop("k")

    def floor(self) -> DataFrame:
        return self.stats().select(F.when(F.col("n") >= FLOOR_FROM, FLOOR).otherwise(0.0).alias("floor"))


def factor(tf: Column, length: Column, avg: Column) -> Column:
    """What a token's tf in a passage multiplies its rarity by."""
    size = F.greatest(length, F.lit(1)) / F.when(avg > 0, avg).otherwise(1.0)
    return tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * size))


def promoted(asked: DataFrame, codes: DataFrame) -> DataFrame:
    """asked (qid, text) with query: the message by which a question that is only a code is searched, where the log has that code.

    codes: code, line, a row a code (of the log that is meant).
    """
    code = F.when(bare_code(F.col("text")), F.get(codes_like(F.col("text")), F.lit(0)))
    x = asked.withColumn("code", code).join(codes.select("code", template(F.col("line")).alias("message")), "code", "left")
    enough = F.size(F.filter(F.split("message", " "), lambda w: w != "")) >= 3
    return x.select("qid", "text", F.when(enough, F.col("message")).otherwise(F.col("text")).alias("query"), enough.alias("by_message"))


def search_manual(index: PassageIndex, asked: DataFrame, codes: DataFrame, k: int = 4) -> DataFrame:
    """qid, rank, source, start_line, page, heading, score, query: the best relevant passages of questions (qid, text).

    A question that is only a code is searched by its message; codes in a question are searched on their own too, and a passage counts with
    its best score. A question without a relevant passage gets one row with rank 0 and the best score, else null columns.
    """
    q = promoted(asked, codes)
    variants = F.concat(F.array("query"), F.filter(codes_like(F.col("query")), lambda c: F.lower(c) != F.lower(F.col("query"))))
    each = q.select("qid", F.posexplode(variants).alias("v", "text")).select(F.struct("qid", "v").alias("qid"), "text")
    found = index.search(each, k).groupBy(F.col("qid.qid").alias("qid"), "id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    ranked = ranked.crossJoin(F.broadcast(index.floor()))  # one row
    told = ranked.where("score >= floor").join(index.chunks().drop("len"), "id")
    best = ranked.groupBy("qid").agg(F.max("score").alias("best"))
    none = q.join(told.select("qid").distinct(), "qid", "left_anti").join(best, "qid", "left")
    null = lambda kind: F.lit(None).cast(kind)
    out = told.join(q, "qid").select("qid", F.col("rank").cast("long").alias("rank"), "source", "start_line", "page", "heading", "score", "query")
    return out.unionByName(none.select("qid", F.lit(0).cast("long").alias("rank"), null("string").alias("source"), null("long").alias("start_line"), null("long").alias("page"), null("string").alias("heading"), F.coalesce("best", F.lit(0.0)).alias("score"), "query"))


def code_lookup(index: PassageIndex, wanted: DataFrame, severe: DataFrame, k: int = 2) -> DataFrame:
    """code, nth, n, line_no, line, state, query, passages of wanted (code, nth; null: the first) in one log.

    severe: line_no, line, code, severity of the log's lines with a code. state: found, no such code, out of range. passages: rank, source,
    start_line, heading, score of the k best relevant ones for the message of the code's first line; the code where that has under three words.
    """
    mine = severe.join(F.broadcast(wanted.select("code").distinct()), "code", "left_semi")  # what a user names
    runs = mine.groupBy("code").agg(F.count("*").alias("n"), F.min_by("line", "line_no").alias("first"))
    place = mine.withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy("line_no"))).select("code", F.col("k").alias("nth_"), "line_no", F.left(F.trim("line"), F.lit(200)).alias("line"))
    x = wanted.join(runs, "code", "left").withColumn("nth_", F.coalesce("nth", F.lit(1))).join(place, ["code", "nth_"], "left")
    state = F.when(F.col("n").isNull(), "no such code").when((F.col("nth_") < 1) | (F.col("nth_") > F.col("n")), "out of range").otherwise("found")
    message = template(F.col("first"))
    query = F.when(F.size(F.filter(F.split(message, " "), lambda w: w != "")) >= 3, message).otherwise(F.col("code"))
    x = x.select("code", "nth", F.coalesce("n", F.lit(0)).alias("n"), "line_no", "line", state.alias("state"), query.alias("query"))
    found = index.search(x.select(F.col("code").alias("qid"), F.col("query").alias("text")).distinct(), k).crossJoin(F.broadcast(index.floor())).where("score >= floor")
    found = found.join(index.chunks(), "id").groupBy(F.col("qid").alias("code")).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id", "source", "start_line", "heading"))).alias("p"))
    told = F.transform("p", lambda e, i: F.struct((i + 1).cast("long").alias("rank"), e["source"].alias("source"), e["start_line"].alias("start_line"), e["heading"].alias("heading"), (-e["less"]).alias("score")))
    return x.join(found, "code", "left").select("code", "nth", "n", "line_no", "line", "state", "query", F.coalesce(told, F.array().cast("array<struct<rank: long, source: string, start_line: long, heading: string, score: double>>")).alias("passages"))


def evidence(index: PassageIndex, asked: DataFrame, severe: DataFrame, file: str) -> DataFrame:
    """id, text: for answers (id, codes in the order they were looked up) a line a code that the log has: where it came first and what it
    said, with its best passage, or that the manual has none."""
    each = asked.select("id", F.posexplode(F.array_distinct(F.transform("codes", lambda c: F.upper(F.trim(c))))).alias("k", "code")).where("code <> ''")
    found = code_lookup(index, each.select("code", F.lit(None).cast("int").alias("nth")).distinct(), severe, 1).where("state = 'found'")
    top = F.get("passages", F.lit(0))
    text = found.withColumn("p", top).join(index.chunks().select("source", "start_line", F.col("text").alias("passage")), (F.col("p.source") == F.col("source")) & (F.col("p.start_line") == F.col("start_line")), "left")
    words = F.trim(F.replace("passage", F.lit("\n"), F.lit(" ")))
    short = F.when(F.length(words) > 220, F.concat(F.rtrim(F.left(words, F.lit(220))), F.lit("…"))).otherwise(words)
    place = F.concat(F.lit("`"), F.substring_index("p.source", "/", -1), F.lit(":"), F.col("p.start_line").cast("string"), F.lit("` > "), "p.heading", F.lit(" — "), short)
    bullet = F.concat(F.lit(f"- `{file}:"), (F.col("line_no") + 1).cast("string"), F.lit("` → "), "line", F.lit("\n  Manual: "), F.coalesce(place, F.concat(F.lit("no entry for "), "code")))
    lines = each.join(text.select("code", bullet.alias("bullet")), "code").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "bullet"))).alias("b"))  # an answer's codes
    return lines.select("id", F.array_join(F.transform("b", lambda b: b["bullet"]), "\n").alias("text"))
