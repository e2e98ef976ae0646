"""Relations of classified lines (file, line_no, line, severity, code): counts, codes, windows, stages, incidents, repeats, mentions."""

from __future__ import annotations

import functools
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tracequarry.functions.profiles import MENTION, PROFILES, SOURCE_COMMAND, STAGE, UNCODED, Profile, detected, rank


def levels():
    return F.sequence(F.lit(0), F.lit(9))


#: Lines of a file that one window holds; longer files are cut, and a short summary of each block is carried to the next.
BLOCK = 65_536


def cut(df: DataFrame) -> DataFrame:
    return df.withColumn("block", F.floor(F.col("line_no") / BLOCK))


def within(back: bool = False):
    return Window.partitionBy("file", "block").orderBy(F.desc("line_no") if back else "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def earlier(back: bool = False):
    return Window.partitionBy("file").orderBy(F.desc("block") if back else "block").rowsBetween(Window.unboundedPreceding, -1)


def carry(df: DataFrame, forward: dict[str, Column], back: dict[str, Column] | None = None) -> DataFrame:
    """df with, for each name, the last value that isn't null at or before each line (back: the first at or after it); one row a line.

    df is read twice: once for the last and first values of each block, once for the lines, whose windows go no further than a block.
    """
    back = back or {}
    x = cut(df.withColumns({f"_v_{n}": v for n, v in (forward | back).items()}))
    known = lambda n: F.when(F.col(f"_v_{n}").isNotNull(), F.col("line_no"))
    ends = x.groupBy("file", "block").agg(*(F.max_by(f"_v_{n}", known(n)).alias(n) for n in forward), *(F.min_by(f"_v_{n}", known(n)).alias(n) for n in back))
    ends = ends.select("file", "block", *(F.last(n, ignorenulls=True).over(earlier(n in back)).alias(f"_e_{n}") for n in forward | back))
    x = x.withColumns({n: F.last(f"_v_{n}", ignorenulls=True).over(within(n in back)) for n in forward | back}).join(ends, ["file", "block"])
    return x.withColumns({n: F.coalesce(n, f"_e_{n}") for n in forward | back}).drop("block", *(f"_{k}_{n}" for k in "ve" for n in forward | back))


def carried(df: DataFrame, name: str, value: Column, back: bool = False) -> DataFrame:
    return carry(df, {}, {name: value}) if back else carry(df, {name: value})


def near(hits: DataFrame, around: int) -> DataFrame:
    """file, line_no of the hits and of `around` lines on either side, each once."""
    lines = F.sequence(F.col("line_no") - around, F.col("line_no") + around)
    return hits.select("file", F.explode(lines).alias("line_no")).distinct()


def census(c: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s)
    return c.groupBy("file").agg(n("fatal").alias("n_fatal"), n("error").alias("n_error"), n("warn").alias("n_warn"), F.count("*").alias("total"))


def code_table(c: DataFrame) -> DataFrame:
    """Per code: the severity of its first line, its count over all severities, its first line."""
    rows = c.where("severity is not null").groupBy("file", "code")
    return rows.agg(F.min_by("severity", "line_no").alias("severity"), F.count("*").alias("n"), F.min("line_no").alias("first_line"))


def code_order(codes: DataFrame) -> DataFrame:
    return codes.orderBy("file", rank(F.col("severity")), F.desc("n"), "code")


def prefix_families(codes: DataFrame) -> DataFrame:
    """Fatal and error codes of each file by the text before their last dash: the first in code order, its figures, and the others."""
    rows = codes.where((F.col("code") != UNCODED) & F.col("severity").isin("fatal", "error")).withColumn("prefix", F.regexp_replace("code", "-[^-]*$", ""))
    each = F.array_sort(F.collect_list(F.struct(rank(F.col("severity")).alias("rank"), (-F.col("n")).alias("less"), "code", "severity", "first_line")))
    x = rows.groupBy("file", "prefix").agg(each.alias("each"))
    first = F.col("each")[0]
    others = F.transform(F.slice("each", 2, F.greatest(F.size("each") - 1, F.lit(1))), lambda e: e["code"])
    return x.select("file", "prefix", first["code"].alias("primary_code"), first["severity"].alias("severity"), (-first["less"]).alias("n"), first["first_line"].alias("first_line"), F.array_join(others, ",").alias("others"))


def run_starts(lines: DataFrame) -> DataFrame:
    """lines with t, the text without its end, and run, the line at which equal consecutive lines began."""
    x = cut(lines.withColumn("t", F.regexp_replace("line", r"[\r\n]+$", "")))
    ends = x.groupBy("file", (F.col("block") + 1).alias("block")).agg(F.max_by("t", "line_no").alias("_end"))
    before = F.coalesce(F.lag("t").over(Window.partitionBy("file", "block").orderBy("line_no")), F.col("_end"))
    x = x.join(ends, ["file", "block"], "left").withColumn("_new", ~F.col("t").eqNullSafe(before)).drop("_end", "block")
    return carried(x, "run", F.when(F.col("_new"), F.col("line_no"))).drop("_new")


def repeats(lines: DataFrame, least: int = 3) -> DataFrame:
    """Runs of equal consecutive lines that aren't blank."""
    x = run_starts(lines).where(F.trim("t") != "")
    return x.groupBy("file", F.col("run").alias("first_line")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def repeat_of_line(lines: DataFrame, least: int = 3) -> DataFrame:
    """Each line of a repeat with the run's first line and length."""
    x = run_starts(lines.select("file", "line_no", "line"))
    return x.select("file", "line_no", F.col("run").alias("first_line")).join(repeats(lines, least), ["file", "first_line"])


def incidents(c: DataFrame, body: int = 15) -> DataFrame:
    """Every severe line with the indented or blank lines after it."""
    x = carried(c, "head", F.when(F.col("severity").isNotNull(), F.col("line_no"))).where(F.col("line_no") - F.col("head") <= body)
    inside = (F.col("line_no") == F.col("head")) | F.col("line").rlike(r"^[ \t]|^\s*$")
    one = Window.partitionBy("file", "head").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # body + 1 lines at most
    x = x.withColumn("broken", F.max((~inside).cast("int")).over(one)).where("broken = 0")
    return x.groupBy("file", "head").agg(F.max("line_no").alias("body_end"), F.min_by("severity", "line_no").alias("severity"))


def incident_around(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (file, line_no): the last incident that starts at or before it, and whether it reaches the line."""
    heads = found.select("file", F.col("head").alias("line_no"), F.struct("head", "body_end", "severity").alias("i"))
    asked = wanted.select("file", "line_no").distinct().withColumn("asked", F.lit(True))
    x = carried(asked.join(heads, ["file", "line_no"], "full"), "last", F.col("i")).where("asked and last is not null")
    return x.select("file", "line_no", "last.head", "last.body_end", "last.severity", (F.col("line_no") <= F.col("last.body_end")).alias("inside"))


def stage_ranges(lines: DataFrame) -> DataFrame:
    """Ranges between banners: an ending closes the latest open start of its name, an open start ends at the file's total."""
    banners = lines.select("file", "line_no", F.regexp_extract("line", STAGE, 1).alias("kind"), F.regexp_extract("line", STAGE, 2).alias("name"))
    return ranges_of_banners(banners, lines.groupBy("file").agg(F.count("*").alias("total")))


def ranges_of_banners(banners: DataFrame, total: DataFrame) -> DataFrame:
    """stage_ranges of banners (file, line_no, kind, name) and the totals of their files (file, total)."""
    x = banners.where("name <> ''")
    by_name = Window.partitionBy("file", "name").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("balance", F.sum(F.when(F.col("kind") == "Starting", 1).otherwise(-1)).over(by_name))
    x = x.withColumn("depth", F.col("balance") - F.least(F.lit(0), F.min("balance").over(by_name)))
    before = F.lag("depth", 1, 0).over(Window.partitionBy("file", "name").orderBy("line_no"))
    x = x.withColumn("level", F.when(F.col("kind") == "Starting", F.col("depth")).otherwise(before)).where("level > 0")
    then = Window.partitionBy("file", "name", "level").orderBy("line_no")
    x = x.withColumns({"next": F.lead("line_no").over(then), "next_kind": F.lead("kind").over(then)}).where("kind = 'Starting'")
    closed = F.col("next_kind") == "Ending"
    x = x.join(total, "file")
    return x.select("file", "name", F.col("line_no").alias("start_line"), F.when(closed, F.col("next")).otherwise(F.col("total")).alias("end_line"), (~F.coalesce(closed, F.lit(False))).alias("incomplete"))


def covers(start, end):
    """Blocks (level, block) of 16**level lines that tile [start, end): at most 30 a level, so a logarithmic number for any length."""

    def blocks(k):
        w, wide = F.pow(F.lit(16.0), k).cast("long"), F.pow(F.lit(16.0), k + 1).cast("long")
        low, high = F.ceil(start / w), F.floor(end / w)
        left, right = F.least(high, F.ceil(start / wide) * 16), F.greatest(low, F.floor(end / wide) * 16)
        span = lambda x, y: F.when(x < y, F.sequence(x.cast("long"), y.cast("long") - 1)).otherwise(F.array().cast("array<long>"))
        found = F.when(F.ceil(start / wide) < F.floor(end / wide), F.concat(span(low, left), span(right, high))).otherwise(span(low, high))
        return F.transform(found, lambda b: F.struct(k.alias("level"), b.alias("block")))

    return F.flatten(F.transform(levels(), blocks))


def owners(rows: DataFrame, ranges: DataFrame, start: Column, first: Column) -> DataFrame:
    """rows (file, line_no, ...) with stage: of the ranges with start <= line < end_line the one of least `first` (a number); null where there is none.

    Rows and ranges meet by blocks of lines. A block gets the ranges that begin or end in it, at most two a banner, and of those that go on
    through all of it only the first: these are tiled by blocks of powers of 16, and each tile keeps its first. So no pairs of lines and
    ranges are made, nothing is broadcast, and no key has more than a block. Files of up to 16**10 blocks.
    """
    of = lambda line: F.floor(line / BLOCK)
    never = F.col("incomplete") if "incomplete" in ranges.columns else F.lit(False).alias("incomplete")
    x = ranges.select("file", start.alias("low"), F.col("end_line").alias("high"), first.cast("long").alias("first"), "name", never).where("low < high")
    # No line comes after the end of a range that is never closed: it holds its last block to the end.
    x = x.withColumns({"from": of(F.col("low")), "to": of(F.col("high") - 1) + F.col("incomplete").cast("int")})
    edges = x.select("file", "low", "high", "first", "name", F.explode(F.array_distinct(F.when(F.col("incomplete"), F.array("from")).otherwise(F.array("from", "to")))).alias("block"))
    tiles = x.where("to - from > 1").select("file", F.struct("first", "name").alias("x"), F.explode(covers(F.col("from") + 1, F.col("to"))).alias("t"))
    tiles = tiles.groupBy("file", F.col("t.level").alias("level"), F.col("t.block").alias("tile")).agg(F.min("x").alias("x"))
    wide = F.pow(F.lit(16.0), F.col("level")).cast("long")
    through = tiles.select("file", "x", F.explode(F.sequence(F.col("tile") * wide, (F.col("tile") + 1) * wide - 1)).alias("block")).groupBy("file", "block").agg(F.min("x").alias("x"))
    through = through.select("file", (F.col("block") * BLOCK).alias("low"), ((F.col("block") + 1) * BLOCK).alias("high"), "x.first", "x.name", "block")
    columns = rows.columns

    def run(mine: pa.Table, near: pa.Table) -> pa.Table:
        mine, near = mine.sort_by("line_no"), near.sort_by("low")
        coming = list(zip(*(near.column(c).to_pylist() for c in ("low", "first", "name", "high")), strict=True))
        at, heap, found = 0, [], []
        for line in mine.column("line_no").to_pylist():
            while at < len(coming) and coming[at][0] <= line:
                heapq.heappush(heap, coming[at][1:])
                at += 1
            while heap and heap[0][2] <= line:
                heapq.heappop(heap)
            found.append(heap[0][1] if heap else None)
        return mine.select(columns).append_column("stage", pa.array(found, pa.string()))

    schema = StructType([*rows.schema.fields, StructField("stage", StringType())])
    near = edges.union(through).select(F.col("file").alias("_file"), "low", "high", "first", "name", F.col("block").alias("_block"))
    return cut(rows).groupBy("file", "block").cogroup(near.groupBy("_file", "_block")).applyInArrow(run, schema)


def stage_of_severe(c: DataFrame, ranges: DataFrame) -> DataFrame:
    """Severe lines with the open stage of greatest start; '<pre-stage>' where none is open."""
    severe = c.where("severity is not null").select("file", "line_no", "severity", "code")
    return owners(severe, ranges, F.col("start_line"), -F.col("start_line")).withColumn("stage", F.coalesce("stage", F.lit("<pre-stage>")))


def stage_hist(c: DataFrame, ranges: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s).alias(f"n_{s}")
    first = F.min(F.when(F.col("severity") != "warn", F.col("line_no"))).alias("first_severe_line")
    return hist_of_codes(stage_of_severe(c, ranges).groupBy("file", "stage", "code").agg(n("fatal"), n("error"), n("warn"), first))


def hist_of_codes(x: DataFrame) -> DataFrame:
    """file, stage, n_fatal, n_error, n_warn, n_codes, first_severe_line, codes of the counts of each code in a stage (one row each).

    codes maps all codes, in their order, to their counts over all severities; lines without a code have no place in it, but count as one in n_codes.
    """
    n = F.struct("code", (F.col("n_fatal") + F.col("n_error") + F.col("n_warn")).alias("n"))
    codes = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("code") != UNCODED, n))))
    sums = [F.sum(c).alias(c) for c in ("n_fatal", "n_error", "n_warn")]
    return x.groupBy("file", "stage").agg(*sums, F.count("code").alias("n_codes"), F.min("first_severe_line").alias("first_severe_line"), codes.alias("codes"))


def stage_timeline(c: DataFrame, ranges: DataFrame) -> DataFrame:
    return timeline(ranges, stage_hist(c, ranges))


def timeline(ranges: DataFrame, hist: DataFrame) -> DataFrame:
    """The ranges with the counts of their stage and how each went."""
    h = hist.withColumnRenamed("stage", "name")
    x = ranges.join(h, ["file", "name"], "left")
    fatal, error = F.coalesce("n_fatal", F.lit(0)), F.coalesce("n_error", F.lit(0))
    status = F.when(F.col("incomplete"), "INCOMPLETE").when(fatal > 0, "FATAL").when(error > 0, "ERROR").otherwise("OK")
    return x.select("file", "name", "start_line", "end_line", fatal.alias("n_fatal"), error.alias("n_error"), status.alias("status"))


def stage_errors(c: DataFrame, ranges: DataFrame, most: int = 10) -> DataFrame:
    """Per stage the first error or fatal line strictly inside it, and how many its name has; '<pre-stage>' for lines outside all stages.

    A line inside several ranges belongs to the one that closes first; ranges never closed come last. Files without stages list their
    first `most` lines, with no stage and no number.
    """
    severe = c.where("severity in ('fatal', 'error')").select("file", "line_no", "severity", "line")
    closing = F.when(F.col("incomplete"), F.col("start_line") + (1 << 62)).otherwise(F.col("end_line"))
    staged = ranges.select("file").distinct()
    own = severe.select("file", "line_no").join(staged, "file", "left_semi")
    named = F.coalesce("stage", F.lit("<pre-stage>")).alias("stage")
    first = owners(own, ranges, F.col("start_line") + 1, closing).groupBy("file", named).agg(F.min("line_no").alias("line_no"))
    n = owners(own, ranges, F.col("start_line"), -F.col("start_line")).groupBy("file", named).agg(F.count("*").alias("n"))
    text = lambda x: F.left(F.trim(x), F.lit(160)).alias("line")
    grouped = severe.join(first.join(n, ["file", "stage"]), ["file", "line_no"]).select("file", "stage", "n", "line_no", "severity", text(F.col("line")))
    flat = severe.join(staged, "file", "left_anti").withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("line_no"))).where(F.col("k") <= most)
    none = F.lit(None)
    return grouped.unionByName(flat.select("file", none.cast("string").alias("stage"), none.cast("long").alias("n"), "line_no", "severity", text(F.col("line"))))


def context(c: DataFrame, hit, around: int = 2) -> DataFrame:
    """Lines with a hit at most `around` lines away."""
    return c.withColumn("is_hit", hit).join(near(c.where(hit), around), ["file", "line_no"], "left_semi")


def pattern_filter(c: DataFrame, profile: Profile, pattern: str, severities: list[str]) -> DataFrame:
    hit = F.col("line").rlike(f"(?i){pattern}")
    return c.where(hit & profile.any_severity(F.col("line"), severities) if severities else hit)


def head_tail(lines: DataFrame, head: int, tail: int) -> DataFrame:
    total = lines.groupBy("file").agg(F.count("*").alias("total"))
    return lines.join(total, "file").where((F.col("line_no") < head) | (F.col("line_no") >= F.col("total") - tail)).drop("total")


def triage(c: DataFrame, most: int = 200, around: int = 2, many: int = 2000, clip: int | None = None) -> DataFrame:
    """The first third of `most` severe lines and all fatal ones with context, stage banners, and the last quarter; a file's first `clip` (`most`) of these.

    The last quarter is of severe lines in files with more than `many`, else of all lines. Files without severe lines show their last `most`.
    """
    severe = c.where("severity in ('fatal', 'error')").select("file", "line_no", "severity")
    size = c.groupBy("file").agg(F.count("*").alias("total"), F.count_if(F.col("severity").isin("fatal", "error")).alias("n_severe"))
    up, down = Window.partitionBy("file").orderBy("line_no"), Window.partitionBy("file").orderBy(F.desc("line_no"))
    head = severe.withColumn("k", F.row_number().over(up)).where(F.col("k") <= max(1, most // 3))
    tail = severe.withColumn("k", F.row_number().over(down)).where(F.col("k") <= max(1, most // 4)).join(size.where(F.col("n_severe") > many), "file", "left_semi")
    hits = head.select("file", "line_no").union(tail.select("file", "line_no")).union(severe.where("severity = 'fatal'").select("file", "line_no"))
    left = F.when(F.col("n_severe") == 0, most).when(F.col("n_severe") <= many, most // 4).otherwise(0)
    ends = size.where(left > 0).select("file", F.explode(F.sequence(F.greatest(F.lit(0), F.col("total") - left), F.col("total") - 1)).alias("line_no"))
    banners = c.where(F.col("line").rlike(STAGE)).join(size.where("n_severe > 0"), "file", "left_semi").select("file", "line_no")
    shown = near(hits, around).union(ends).union(banners).distinct()
    x = c.select("file", "line_no", "line").join(shown, ["file", "line_no"], "left_semi")
    return x.withColumn("k", F.row_number().over(up)).where(F.col("k") <= (clip or most)).drop("k")


def nth_occurrence(c: DataFrame, nth: int, most: int = 16) -> DataFrame:
    """The nth line (from 1) of every code that has so many, and whether it is among the first or last `most` hits or between."""
    w = Window.partitionBy("file", "code").orderBy("line_no")
    severe = c.where("severity is not null").select("file", "code", "line_no")
    total = severe.groupBy("file", "code").agg(F.count("*").alias("n"))
    x = severe.withColumn("k", F.row_number().over(w)).where(F.col("k") == nth).join(total, ["file", "code"])
    place = F.when(F.col("k") <= most, "head").when(F.col("k") > F.col("n") - most, "tail").otherwise("between")
    return x.select("file", "code", "line_no", "n", place.alias("place"))


def mentions(lines: DataFrame) -> DataFrame:
    """file, token, line_no of the paths and sourced scripts that lines name; each once per line."""
    found = F.concat(F.regexp_extract_all("line", F.lit(MENTION), F.lit(1)), F.transform(F.regexp_extract_all("line", F.lit(SOURCE_COMMAND), F.lit(1)), lambda x: F.concat(F.lit("CMD:"), x)))
    return lines.select("file", F.explode(F.array_distinct(found)).alias("token"), "line_no")


def mention_counts(lines: DataFrame) -> DataFrame:
    return mentions(lines).groupBy("file", "token").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


def region(c: DataFrame, start: int, end: int) -> DataFrame:
    """Counts, codes and time span of the lines start to end (from 1, inclusive) of each file."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(f"n_{s}")
    return c.where(F.col("line_no").between(start - 1, end - 1)).groupBy("file").agg(n("fatal"), n("error"), n("warn"), F.countDistinct("code").alias("n_codes"), F.min("ts_s").alias("first_ts"), F.max("ts_s").alias("last_ts"))


def region_details(c: DataFrame, ranges: DataFrame, found: DataFrame, start: int, end: int, most: int = 8, heads: int = 5) -> DataFrame:
    """file, kind, name, n, place: the region's top codes and mentions, the stages it crosses, its number of incidents and the first of them."""
    low, high = start - 1, end - 1
    inside = c.where(F.col("line_no").between(low, high))
    top = Window.partitionBy("file").orderBy(F.desc("n"), "name")
    counted = lambda df, kind: df.groupBy("file", "name").agg(F.count("*").alias("n")).withColumn("place", F.row_number().over(top)).where(F.col("place") <= most).select("file", F.lit(kind).alias("kind"), "name", "n", F.col("place").cast("long").alias("place"))
    codes = counted(inside.where("severity is not null").select("file", F.col("code").alias("name")), "code")
    named = counted(mentions(inside).select("file", F.col("token").alias("name")), "mention")
    crossed = overlapping(ranges, low, high).select("file", F.lit("stage").alias("kind"), "name", F.lit(1).cast("long").alias("n"), F.col("start_line").alias("place"))
    first = found.where(F.col("head").between(low, high))
    heads_ = first.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("head"))).where(F.col("k") <= heads)
    heads_ = heads_.select("file", F.lit("incident").alias("kind"), F.col("severity").alias("name"), (F.col("body_end") - F.col("head") + 1).alias("n"), F.col("head").alias("place"))
    total = first.groupBy("file").agg(F.count("*").alias("n")).select("file", F.lit("incidents").alias("kind"), F.lit("all").alias("name"), "n", F.lit(0).cast("long").alias("place"))
    return codes.union(named).union(crossed).union(heads_).union(total)


def correlate(timed: DataFrame, anchor: DataFrame, window: int, most: int = 200) -> DataFrame:
    """Lines of all files within the window of the anchor second (one row, column anchor), in order."""
    near = F.abs(F.col("ts_s") - F.col("anchor")) <= window
    return timed.join(F.broadcast(anchor), near).orderBy("ts_s", "file", "line_no").limit(most).select("ts_s", "file", "line_no", F.left("line", F.lit(180)).alias("line"))


def interpolated(lines: DataFrame) -> DataFrame:
    """lines with t: their own second, or one between the nearest timed lines, clamped at both ends."""
    known = F.when(F.col("ts_s").isNotNull(), F.struct("ts_s", "line_no"))
    x = carry(lines.select("file", "line_no", "ts_s"), {"lo": known}, {"hi": known})
    span = F.col("hi.line_no") - F.col("lo.line_no")
    inside = F.col("lo.ts_s") + F.floor((F.col("hi.ts_s") - F.col("lo.ts_s")) * (F.col("line_no") - F.col("lo.line_no")) / span)
    return x.select("file", "line_no", F.coalesce(F.when(span > 0, inside), F.col("lo.ts_s"), F.col("hi.ts_s")).cast("long").alias("t"))


def offsets(lines: DataFrame) -> DataFrame:
    """lines with start, the byte at which each begins."""
    x = cut(lines.select("file", "line_no", "line")).withColumn("own", F.octet_length("line") + 1)
    base = x.groupBy("file", "block").agg(F.sum("own").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(earlier()), F.lit(0)).alias("base"))
    return x.join(base, ["file", "block"]).select("file", "line_no", "line", (F.sum("own").over(within()) - F.col("own") + F.col("base")).alias("start"))


def profile_hits(lines: DataFrame, active: Profile, most: int = 8192) -> DataFrame:
    """file, active, detected, and for both profiles how often each severity's vocabulary occurs in the first `most` bytes of each log.

    The detected profile's counts are null where it is the active one.
    """
    head = lines.where(F.col("line_no") < most).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line_no", F.left("line", F.lit(most)).alias("line")))).alias("l"))  # `most` short lines
    text = F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n"))
    head = head.select("file", F.make_valid_utf8(F.substring(F.encode(text, "utf-8"), 1, most).cast("string")).alias("head"))
    head = head.withColumn("detected", detected(F.col("head")))
    counts = [F.regexp_count("head", F.lit(getattr(active, s))).cast("long").alias(f"active_{s}") for s in ("fatal", "error", "warn")]
    other = lambda s: functools.reduce(lambda out, p: F.when(F.col("detected") == p.name, F.regexp_count("head", F.lit(getattr(p, s)))).otherwise(out), (p for p in PROFILES.values() if p is not active), F.lit(None))
    return head.select("file", F.lit(active.name).alias("active"), "detected", *counts, *(other(s).cast("long").alias(f"detected_{s}") for s in ("fatal", "error", "warn")))


def listing(lines: DataFrame) -> DataFrame:
    size = F.sum(F.octet_length("line") + 1)
    return lines.groupBy("file").agg(F.count("*").alias("n_lines"), F.floor(size / 1024).alias("kb"))


def summary(c: DataFrame) -> DataFrame:
    """The code table with each code's first line, in code order; one aggregation, no join back to the lines."""
    rows = c.where("severity is not null").groupBy("file", "code")
    first = F.min_by(F.struct("severity", "line"), "line_no")
    out = rows.agg(first.alias("f"), F.count("*").alias("n"), F.min("line_no").alias("first_line"))
    return code_order(out.select("file", "code", "f.severity", "n", "first_line", F.col("f.line").alias("example")))


def retained(c: DataFrame, most: int = 16) -> DataFrame:
    """The first and last hits of every code; a hit in both counts as head."""
    severe = c.where("severity is not null").select("file", "code", "line_no")
    some = lambda order, part: severe.withColumn("k", F.row_number().over(Window.partitionBy("file", "code").orderBy(order))).where(F.col("k") <= most).drop("k").withColumn("part", F.lit(part))
    head = some("line_no", "head")
    return head.union(some(F.desc("line_no"), "tail").join(head, ["file", "code", "line_no"], "left_anti"))


def gaps(shown: DataFrame) -> DataFrame:
    """shown with gap: whether lines before this one, but not at the start, are left out."""
    before = shown.select("file", (F.col("line_no") + 1).alias("line_no"), F.lit(True).alias("_before"))
    first = shown.groupBy("file").agg(F.min("line_no").alias("_first"))
    x = shown.join(before, ["file", "line_no"], "left").join(first, "file")
    return x.withColumn("gap", F.col("_before").isNull() & (F.col("line_no") > F.col("_first"))).drop("_before", "_first")


def unseen(c: DataFrame, shown: DataFrame) -> DataFrame:
    """Per file, the severe lines that a view left out."""
    severe = c.where("severity in ('fatal', 'error')").select("file", "line_no")
    return severe.join(shown.select("file", "line_no"), ["file", "line_no"], "left_anti").groupBy("file").agg(F.count("*").alias("n_unseen"))


def overlapping(ranges: DataFrame, start: int, end: int) -> DataFrame:
    return ranges.where((F.col("start_line") <= end) & (F.col("end_line") >= start)).select("file", "name", "start_line", "end_line")
