"""Fetches, lookups and small stores: picked logs, line ranges, code questions, skills, plans, sessions, audit logs, notes, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.functions.profiles import codes_like, template
from tracequarry.operators import logs


def picked(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """w, file: of each wanted path the log of that path, else the first of its base name, else the first that ends so; '' gives the first log.

    files: one row a log; wanted: a few paths that a user names.
    """
    base = lambda p: F.substring_index(p, "/", -1)
    f, w = files.select("file", base("file").alias("fb")), F.broadcast(wanted.select("w", base("w").alias("wb")).distinct())
    exact = f.join(w, F.col("file") == F.col("w")).select("w", F.lit(0).alias("k"), "file")
    named = f.join(w, F.col("fb") == F.col("wb")).select("w", F.lit(1).alias("k"), "file")
    ending = f.join(w, F.col("file").endswith(F.col("w"))).select("w", F.lit(2).alias("k"), "file")
    best = exact.union(named).union(ending).groupBy("w").agg(F.min(F.struct("k", "file"))["file"].alias("file"))
    return wanted.select("w").distinct().join(best, "w", "left")


def fetched(lines: DataFrame, numbers: DataFrame) -> DataFrame:
    """file, line_no, line of the lines named by numbers (file, line_no)."""
    return lines.select("file", "line_no", "line").join(numbers.select("file", "line_no").distinct(), ["file", "line_no"], "left_semi")


def line_range(lines: DataFrame, start: int, end: int) -> DataFrame:
    """Lines start to end, from 1, inclusive."""
    return lines.where(F.col("line_no").between(start - 1, end - 1))


def first_hits(hits: DataFrame, most: int) -> DataFrame:
    """Each file's first hits."""
    return hits.withColumn("_k", F.row_number().over(Window.partitionBy("file").orderBy("line_no"))).where(F.col("_k") <= most).drop("_k")


def collapsed(lines: DataFrame) -> DataFrame:
    """file, line_no, shown, n: lines, with each repeat as its first line and its length."""
    x = lines.select("file", "line_no", "line").join(logs.repeat_of_line(lines), ["file", "line_no"], "left")
    n = F.coalesce("n", F.lit(1))
    shown = F.when(n > 1, F.concat("line", F.lit("  [x"), n.cast("string"), F.lit("]"))).otherwise(F.col("line"))
    return x.where("first_line is null or first_line = line_no").select("file", "line_no", shown.alias("shown"), n.alias("n"))


def durations(ranges: DataFrame, times: DataFrame) -> DataFrame:
    """ranges with seconds from the opening to the closing banner; null where never closed. times: file, line_no, ts_s."""
    at = lambda line, name: times.select("file", F.col("line_no").alias(line), F.col("ts_s").alias(name))
    x = ranges.join(at("start_line", "_a"), ["file", "start_line"], "left").join(at("end_line", "_b"), ["file", "end_line"], "left")
    return x.withColumn("seconds", F.when(~F.col("incomplete"), F.col("_b") - F.col("_a"))).drop("_a", "_b")


def variants(question: Column) -> Column:
    """The question and each code in it that isn't the question itself."""
    return F.concat(F.array(question), F.filter(codes_like(question), lambda c: F.lower(c) != F.lower(question)))


def code_questions(c: DataFrame, least: int = 3) -> DataFrame:
    """file, code, line, question: a code's first line and the message by which documents are searched; the code if that is under `least` words."""
    first = c.where("severity is not null").groupBy("file", "code").agg(F.min_by("line", "line_no").alias("line"))
    told = template(F.col("line"))
    return first.withColumn("question", F.when(F.size(F.split(told, " ")) >= least, told).otherwise(F.col("code")))


def domain_fits(domain: Column, profile: str) -> Column:
    return F.lower(F.trim(F.coalesce(domain, F.lit("any")))).isin("", "any", profile.lower())


def skill_scores(skills: DataFrame, asked: DataFrame) -> DataFrame:
    """qid, id, score of skills (id, name, description) for questions (qid, text): term count times rarity, question words counted as often as they come."""
    words = lambda text: F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))).alias("token")
    tf = skills.select("id", words(F.concat_ws(" ", "name", "description"))).groupBy("id", "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    n = F.broadcast(skills.agg(F.count("*").alias("n")))  # one row
    x = asked.select("qid", words(F.col("text"))).join(df, "token").join(tf, "token").crossJoin(n)
    rare = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    return x.groupBy("qid", "id").agg(F.sum(F.col("tf") * rare).alias("score"))


def skill_files(texts: DataFrame) -> DataFrame:
    """source, name, description, domain, body of SKILL.md files (source, text): front matter between '---' lines, split at the first colon."""
    head = F.regexp_extract("text", r"(?s)^---(.*?)\n---", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.map_from_entries(F.array_distinct(F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, "^[^:]*:", ""))))))
    x = texts.withColumn("m", F.when(F.size(lines) > 0, pairs))
    folder = F.element_at(F.split("source", "/"), -2)
    body = F.when(head != "", F.regexp_replace("text", r"(?s)^---.*?\n---\s*|\s+$", "")).otherwise(F.col("text"))
    get = lambda key, other: F.coalesce(F.col("m")[key], other).alias(key)
    return x.select("source", get("name", folder), get("description", F.lit("(no description)")), get("domain", F.lit("any")), body.alias("body"))


def pages(docs: DataFrame) -> DataFrame:
    """doc_id, page (from 1), text of texts whose pages end at form feeds."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\f", -1)).alias("page", "text")).select("doc_id", (F.col("page") + 1).cast("long").alias("page"), "text")


def plan_counts(tasks: DataFrame) -> DataFrame:
    """Tasks (plan, status) by status."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return tasks.groupBy("plan").agg(*map(n, ("pending", "in_progress", "done", "blocked")))


def totals(calls: DataFrame, by: str) -> DataFrame:
    return calls.groupBy(by).agg(*(F.sum(c).cast("long").alias(c) for c in ("llm_calls", "tokens_in", "tokens_out", "latency_ms")))


def newest(rows: DataFrame, time: str, name: str, most: int) -> DataFrame:
    return rows.orderBy(F.desc(time), name).limit(most)


def audit_tail(lines: DataFrame, most: int, schema: str) -> DataFrame:
    """The last records of lines (line_no, line) of JSON; lines that don't parse are skipped."""
    x = lines.withColumn("r", F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})).where("r._bad is null and r is not null")
    return x.orderBy(F.desc("line_no")).limit(most).select("r.*").drop("_bad")


def latest_notes(saves: DataFrame) -> DataFrame:
    """key, value, saves of a log of saves (key, value, at); a null value deletes."""
    x = saves.groupBy("key").agg(F.max(F.struct("at", "value"))["value"].alias("value"), F.count("*").alias("saves"))
    return x.where("value is not null")


def note_errors(notes: DataFrame) -> DataFrame:
    """key, error of notes that may not be saved."""
    key = ~F.coalesce(F.col("key"), F.lit("")).rlike(r"^[A-Za-z0-9_.\-/]{1,80}$")
    return notes.select("key", F.when(key, "invalid key").when(F.col("value").isNull(), "no value").when(F.length("value") > 8192, "value too long").alias("error")).where("error is not null")


def stale(known: DataFrame, now: DataFrame, key: str, marks: list[str]) -> DataFrame:
    """key, state (new, changed, gone) of what differs between a stored table of files and the present one; unchanged files need no reading."""
    a, b = known.select(key, F.struct(*marks).alias("_a")), now.select(key, F.struct(*marks).alias("_b"))
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full").select(key, state.alias("state")).where("state is not null")


def sniffed(lines: DataFrame, first: int = 5) -> DataFrame:
    """file, jsonl: whether the first line that isn't blank, among the first five, is a JSON object."""
    head = lines.withColumn("_k", F.row_number().over(Window.partitionBy("file").orderBy("line_no"))).where(F.col("_k") <= first)
    head = head.where(F.trim("line") != "").groupBy("file").agg(F.min_by("line", "_k").alias("line"))
    is_object = F.trim("line").startswith("{") & F.from_json("line", "map<string,string>").isNotNull()
    return lines.select("file").distinct().join(head, "file", "left").select("file", F.coalesce(is_object, F.lit(False)).alias("jsonl"))
