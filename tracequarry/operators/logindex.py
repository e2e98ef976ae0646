"""A stored index of logs that grows with them: numbered, classified lines and mergeable summaries of their parts.

An update takes new lines only. They are numbered on from what is stored, cut in parts (a block of BLOCK lines, or what of it is new), and
one pass of windows within parts notes for each line where its run of equal lines, the severe line before it, the last line that ends an
incident, and the last banner are. All else are aggregations of the stored lines, a few rows a part: what crosses a part's edge (a run, an
incident's body, the open stage) is put together from the parts' edges when the index is asked, so an update never reads earlier lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracequarry.functions.profiles import STAGE, UNCODED, Profile, eda_seconds, generic_seconds
from tracequarry.operators import logs
from tracequarry.sources.logs import classified, text_lines
from tracequarry.sources.store import Generations, discard, written

#: Lines of a file that one window holds.
BLOCK = 65_536
#: Hits of a code that a part keeps from either end; lines that an incident's body has at most; least length of a run of equal lines.
ENDS, BODY, REPEATED = 16, 15, 3

LINES = "file string, part long, line_no long, line string, severity string, code string, ts_s long, run long, head long, stop long, banner long"
PARTS = "file string, part long, n long, bytes long, n_fatal long, n_error long, n_warn long, first_ts long, last_ts long, lead long, trail_start long, trail long, first_text string, last_text string, first_stop long, open_head long, last_banner long"
CODES = "file string, part long, code string, severity string, n long, first_line long, first_hits array<long>, last_hits array<long>"
RUNS = "file string, first_line long, n long"
INCIDENTS = "file string, head long, body_end long, severity string"
BANNERS = "file string, line_no long, kind string, name string, ts_s long"
STAGED = "file string, part long, banner long, code string, n_fatal long, n_error long, n_warn long, first_severe_line long"
MENTIONS = "file string, part long, token string, n long, first_line long"
SEGMENTS = "segment string, length long, changed long"
TABLES = {"segments": SEGMENTS, "lines": LINES, "parts": PARTS, "codes": CODES, "runs": RUNS, "incidents": INCIDENTS, "banners": BANNERS, "staged": STAGED, "mentions": MENTIONS}


def annotated(lines: DataFrame, profile: Profile) -> DataFrame:
    """LINES of new lines (file, line_no, line, ts_s): one sort within parts."""
    c = classified(lines.select("file", "line_no", "line", F.col("ts_s").cast("long").alias("ts_s")), profile)
    c = c.withColumns({"block": F.floor(F.col("line_no") / BLOCK), "_t": F.regexp_replace("line", r"[\r\n]+$", "")})
    order = Window.partitionBy("file", "block").orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = lambda hit: F.last(F.when(hit, F.col("line_no")), ignorenulls=True).over(upto)
    severe, follows = F.col("severity").isNotNull(), F.col("line").rlike(r"^[ \t]|^\s*$")
    c = c.withColumn("_new", ~F.col("_t").eqNullSafe(F.lag("_t").over(order)) | (F.row_number().over(order) == 1))
    c = c.withColumns({"part": F.first("line_no").over(upto), "run": at(F.col("_new")), "head": at(severe), "stop": at(severe | ~follows), "banner": at(F.col("line").rlike(STAGE))})
    return c.select(*(f.split()[0] for f in LINES.split(", ")))


def parts_of(lines: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s).alias(f"n_{s}")
    text = F.regexp_replace("line", r"[\r\n]+$", "")
    last = F.max_by(F.struct("run", "head", "stop"), "line_no")
    timed = F.col("ts_s").isNotNull()
    x = lines.groupBy("file", "part").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes"), n("fatal"), n("error"), n("warn"),
        F.min_by("ts_s", F.when(timed, F.col("line_no"))).alias("first_ts"), F.max_by("ts_s", F.when(timed, F.col("line_no"))).alias("last_ts"),
        F.count_if(F.col("run") == F.col("part")).alias("lead"), last.alias("last"), F.min_by(text, "line_no").alias("first_text"), F.max_by(text, "line_no").alias("last_text"),
        F.min("stop").alias("first_stop"), F.max("banner").alias("last_banner"),
    )
    end, last = F.col("part") + F.col("n"), F.col("last")
    opened = F.when((last["head"] == last["stop"]) & (end - 1 - last["head"] < BODY), last["head"])
    return x.withColumns({"trail_start": last["run"], "trail": end - last["run"], "open_head": opened}).select(*(f.split()[0] for f in PARTS.split(", ")))


def codes_of(lines: DataFrame) -> DataFrame:
    hits = F.array_sort(F.collect_list("line_no"))  # of one code in one part
    x = lines.where("severity is not null").groupBy("file", "part", "code").agg(F.min_by("severity", "line_no").alias("severity"), F.count("*").alias("n"), F.min("line_no").alias("first_line"), hits.alias("hits"))
    return x.select("file", "part", "code", "severity", "n", "first_line", F.slice("hits", 1, ENDS).alias("first_hits"), F.slice("hits", F.greatest(F.size("hits") - ENDS + 1, F.lit(1)), F.lit(ENDS)).alias("last_hits"))


def runs_of(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """Long runs that touch no edge of their part."""
    x = lines.where("run > part and run is not null").groupBy("file", "part", F.col("run").alias("first_line")).agg(F.count("*").alias("n"), F.first("line").alias("line"))
    x = x.where((F.col("n") >= REPEATED) & (F.trim("line") != "")).join(parts.select("file", F.col("trail_start").alias("first_line")), ["file", "first_line"], "left_anti")
    return x.select("file", "first_line", "n")


def incidents_of(lines: DataFrame) -> DataFrame:
    x = lines.where((F.col("head") == F.col("stop")) & (F.col("line_no") - F.col("head") <= BODY)).groupBy("file", "head")
    return x.agg(F.max("line_no").alias("body_end"), F.min_by("severity", "line_no").alias("severity"))


def banners_of(lines: DataFrame) -> DataFrame:
    x = lines.where("banner = line_no")
    return x.select("file", "line_no", F.regexp_extract("line", STAGE, 1).alias("kind"), F.regexp_extract("line", STAGE, 2).alias("name"), "ts_s")


def staged_of(lines: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s).alias(f"n_{s}")
    first = F.min(F.when(F.col("severity") != "warn", F.col("line_no")))
    return lines.where("severity is not null").groupBy("file", "part", "banner", "code").agg(n("fatal"), n("error"), n("warn"), first.alias("first_severe_line"))


def mentions_of(lines: DataFrame) -> DataFrame:
    x = logs.mentions(lines.select("file", F.struct("part", "line_no").alias("line_no"), "line"))
    return x.groupBy("file", F.col("line_no.part").alias("part"), "token").agg(F.count("*").alias("n"), F.min("line_no.line_no").alias("first_line"))


class LogIndex:
    def __init__(self, spark: SparkSession, path: str, profile: Profile):
        self.spark, self.profile = spark, profile
        self.store = Generations(spark, path)

    def table(self, name: str) -> DataFrame:
        return self.store.read(name, TABLES[name])

    def totals(self) -> DataFrame:
        """file, total lines that are stored."""
        return self.table("parts").groupBy("file").agg(F.sum("n").alias("total"))

    def add(self, lines: DataFrame, segments: DataFrame | None = None) -> None:
        """Stores new lines (file, line_no, line, ts_s), numbered on from what is stored; all or, where writing fails, nothing."""
        name = self.store.begin()
        write = lambda rows, table: self.store.write(rows, name, table)
        read = lambda table: self.store.read(table, TABLES[table], [name])
        write(annotated(lines, self.profile).sortWithinPartitions("file", "line_no"), "lines")
        new = read("lines")
        write(parts_of(new), "parts")
        for table, rows in (("codes", codes_of(new)), ("runs", runs_of(new, read("parts"))), ("incidents", incidents_of(new)), ("banners", banners_of(new)), ("staged", staged_of(new)), ("mentions", mentions_of(new))):
            write(rows, table)
        write(self.spark.createDataFrame([], SEGMENTS) if segments is None else segments, "segments")
        self.store.commit(name)

    def update(self, path: str) -> int:
        """Stores the lines of segment files under path that aren't stored yet, and tells how many those are; others aren't opened.

        A log is what lies under one folder file=<name>, its segments in the order of their paths, each after all that are stored already;
        a file elsewhere is a log of its own. A stored segment that has another size or time now can't be followed: that is an error.
        """
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        now = files.select(F.col("path").alias("segment"), "length", F.unix_millis("modificationTime").alias("changed"))
        known = self.table("segments")
        new = now.join(known, ["segment", "length", "changed"], "left_anti").join(known.select("segment", F.lit(True).alias("was")), "segment", "left").collect()  # a row a new file
        if changed := [r.segment for r in new if r.was]:
            raise ValueError(f"segments changed after they were stored: {changed[:5]}")
        if not new:
            return 0
        lines = written(text_lines(self.spark, [r.segment for r in new]).withColumnRenamed("file", "segment"), "segments")
        log = F.coalesce(F.nullif(F.url_decode(F.regexp_extract("segment", "file=([^/]+)/", 1)), F.lit("")), F.col("segment"))
        n = lines.groupBy("segment").agg(F.count("*").alias("n")).withColumn("file", log)
        before = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
        base = n.join(self.totals(), "file", "left").select("segment", "file", (F.coalesce("total", F.lit(0)) + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("base"))
        seconds = eda_seconds(F.col("line")) if self.profile.stages else generic_seconds(F.col("line"))
        rows = lines.join(base, "segment").select("file", (F.col("line_no") + F.col("base")).alias("line_no"), "line", seconds.alias("ts_s"))
        self.add(rows, self.spark.createDataFrame([(r.segment, r.length, r.changed) for r in new], SEGMENTS))
        discard(lines)
        return len(new)

    def compact(self) -> None:
        """One generation in the place of all, after many small updates; what the index tells stays the same."""
        names = self.store.commits()
        if len(names) > 1:
            name = self.store.begin()
            for table, schema in TABLES.items():
                rows = self.store.read(table, schema, names)
                self.store.write(rows.repartitionByRange("file", "line_no").sortWithinPartitions("file", "line_no") if table == "lines" else rows.coalesce(8), name, table)
            self.store.commit(name, instead=True)

    # What follows reads summaries only: a few rows a part.

    def census(self) -> DataFrame:
        return self.table("parts").groupBy("file").agg(*(F.sum(f"n_{s}").alias(f"n_{s}") for s in ("fatal", "error", "warn")), F.sum("n").alias("total"))

    def spans(self) -> DataFrame:
        """file, first_ts, last_ts: the first and last time of each log."""
        at = lambda c: F.when(F.col(c).isNotNull(), F.col("part"))
        return self.table("parts").groupBy("file").agg(F.min_by("first_ts", at("first_ts")).alias("first_ts"), F.max_by("last_ts", at("last_ts")).alias("last_ts"))

    def code_table(self) -> DataFrame:
        x = self.table("codes").groupBy("file", "code")
        return x.agg(F.min_by("severity", "first_line").alias("severity"), F.sum("n").alias("n"), F.min("first_line").alias("first_line"))

    def code_hits(self) -> DataFrame:
        """file, code, n, first_hits, last_hits: the first and last ENDS lines of each code, put together from the parts' own."""
        x = self.table("codes").groupBy("file", "code").agg(F.sum("n").alias("n"), F.array_sort(F.flatten(F.collect_list("first_hits"))).alias("f"), F.array_sort(F.flatten(F.collect_list("last_hits"))).alias("l"))
        return x.select("file", "code", "n", F.slice("f", 1, ENDS).alias("first_hits"), F.slice("l", F.greatest(F.size("l") - ENDS + 1, F.lit(1)), F.lit(ENDS)).alias("last_hits"))

    def repeats(self) -> DataFrame:
        """Runs of equal lines: those within parts, and those that edges of neighbouring parts make together."""
        p = self.table("parts")
        whole = F.col("trail_start") == F.col("part")
        edge = lambda start, n, text, new: F.struct(start.alias("start"), n.alias("n"), text.alias("text"), new.alias("apart"))
        lead = edge(F.col("part"), F.col("lead"), F.col("first_text"), F.lit(False))
        trail = edge(F.col("trail_start"), F.col("trail"), F.col("last_text"), F.lit(True))
        edges = p.select("file", F.explode(F.when(whole, F.array(lead)).otherwise(F.array(lead, trail))).alias("e")).select("file", "e.*")
        w = Window.partitionBy("file").orderBy("start")
        edges = edges.withColumn("new", (F.col("apart") | ~F.col("text").eqNullSafe(F.lag("text").over(w))).cast("int"))
        edges = edges.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        joined = edges.where(F.trim("text") != "").groupBy("file", "run").agg(F.min("start").alias("first_line"), F.sum("n").alias("n")).where(F.col("n") >= REPEATED)
        return self.table("runs").unionByName(joined.select("file", "first_line", "n"))

    def incidents(self) -> DataFrame:
        """Incidents; the last of a part goes on through the lines of the next ones up to the first that ends it."""
        p = self.table("parts")
        later = Window.partitionBy("file").orderBy("part").rowsBetween(1, Window.unboundedFollowing)
        total = F.max(F.col("part") + F.col("n")).over(Window.partitionBy("file"))
        ends = p.select("file", F.col("open_head").alias("head"), F.coalesce(F.first("first_stop", ignorenulls=True).over(later), total).alias("next")).where("head is not null")
        x = self.table("incidents").join(ends, ["file", "head"], "left")
        on = F.when(F.col("next").isNotNull(), F.least(F.col("head") + BODY, F.col("next") - 1)).otherwise(F.col("body_end"))
        return x.select("file", "head", on.alias("body_end"), "severity")

    def stage_ranges(self) -> DataFrame:
        return logs.ranges_of_banners(self.table("banners"), self.totals())

    def _staged(self) -> DataFrame:
        """The counts since each banner, with the stage that is open then; before a part's first banner it is what is open at its first line."""
        x = self.table("staged").withColumn("line_no", F.coalesce("banner", "part")).drop("banner")
        x = logs.owners(x, self.stage_ranges(), F.col("start_line"), -F.col("start_line"))
        return x.withColumn("stage", F.coalesce("stage", F.lit("<pre-stage>")))

    def stage_hist(self) -> DataFrame:
        """The counts of each stage, with its map of codes."""
        sums = [F.sum(c).alias(c) for c in ("n_fatal", "n_error", "n_warn")]
        return logs.hist_of_codes(self._staged().groupBy("file", "stage", "code").agg(*sums, F.min("first_severe_line").alias("first_severe_line")))

    def stage_codes(self) -> DataFrame:
        """file, stage, code, n: the codes of each stage, a row each; lines without a code don't count."""
        return self._staged().where(F.col("code") != UNCODED).groupBy("file", "stage", "code").agg(F.sum(F.col("n_fatal") + F.col("n_error") + F.col("n_warn")).alias("n"))

    def mention_counts(self) -> DataFrame:
        return self.table("mentions").groupBy("file", "token").agg(F.sum("n").alias("n"), F.min("first_line").alias("first_line"))
