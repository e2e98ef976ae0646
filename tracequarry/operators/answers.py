"""Checks of answers against data, evaluation scores, sessions, constraint lint."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.functions.profiles import CODE_SHAPE


#: Citations (path:line, or path line N), manual references, claims of having read the manual, counts, calls in text.
CITE = r"(?i)`?([A-Za-z0-9_./\\-]+\.[A-Za-z0-9]{1,8})`?(?:\s*(?:on\s+)?line\s+|:)([0-9]+)(?![A-Za-z0-9_])"
MANUAL_REF = r"(?i)(?<![A-Za-z0-9_])manual[:/]([A-Za-z0-9_./\\-]+\.[A-Za-z0-9]{1,8})(?![A-Za-z0-9_])"
MANUAL_CLAIM = r"(?i)(?<![A-Za-z0-9_])(?:reference|referenc(?:ing|ed)|consult(?:ing|ed)?|check(?:ing|ed)?|cite(?:s|d)?|cit(?:ing|ed)|per|according to|from)\s+(?:the\s+)?manual(?![A-Za-z0-9_])"
CLAIM = r"(?i)(?<![A-Za-z0-9_])([0-9]+)\s+(FATAL|ERROR|WARN(?:ING)?)(?![A-Za-z0-9_])"
COUNT = r"(?i)([0-9]+)\s+(FATAL|ERROR|WARN(?:ING)?)"
CALL = r'(?s)\{\s*"name"\s*:\s*"([A-Za-z_][A-Za-z0-9_]*)"\s*,\s*"arguments"\s*:\s*\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}\s*\}'


def found_pairs(text: str, rx: str, first: str, second: str) -> Column:
    """The distinct (group 1, group 2) of all matches."""
    return F.array_distinct(F.arrays_zip(*(F.regexp_extract_all(text, F.lit(rx), F.lit(k)).alias(name) for k, name in ((1, first), (2, second)))))


def citations(answers: DataFrame) -> DataFrame:
    """id, path, line_no (from 1) of 'path:line' and 'path line N' in answers (id, text), the path in backticks or not."""
    return answers.select("id", F.explode(found_pairs("text", CITE, "path", "line_no")).alias("c")).select("id", "c.path", F.col("c.line_no").cast("long").alias("line_no"))


def resolved(cites: DataFrame, files: DataFrame) -> DataFrame:
    """cites with file: the known file of that path, else the first of the same base name; null if there is none."""
    base = lambda p: F.substring_index(p, "/", -1)
    exact = files.select(F.col("file").alias("path"), F.col("file").alias("_exact")).distinct()
    named = files.groupBy(base("file").alias("_base")).agg(F.min("file").alias("_named"))
    x = cites.withColumn("_base", base("path")).join(exact, "path", "left").join(named, "_base", "left")
    return x.withColumn("file", F.coalesce("_exact", "_named")).drop("_base", "_exact", "_named")


def checked(cites: DataFrame, totals: DataFrame) -> DataFrame:
    """Each citation with what is wrong with it; totals: file, total."""
    x = cites.join(totals, cites["path"] == totals["file"], "left")
    reason = F.when(F.col("total").isNull(), "file not found").when((F.col("line_no") < 1) | (F.col("line_no") > F.col("total")), "line out of range").otherwise("ok")
    return x.select("id", "path", "line_no", reason.alias("reason"))


def numeric_claims(answers: DataFrame, rx: str = CLAIM) -> DataFrame:
    """id, severity, claimed of 'N FATAL/ERROR/WARN(ING)'."""
    x = answers.select("id", F.explode(found_pairs("text", rx, "n", "s")).alias("c"))
    return x.select("id", F.regexp_replace(F.lower("c.s"), "warning", "warn").alias("severity"), F.col("c.n").cast("long").alias("claimed")).distinct()


def told_counts(summaries: DataFrame) -> DataFrame:
    """id, severity, claimed of the header 'EXACT counts ...: N FATAL, ...' of summaries (id, text); rows of codes below it don't count."""
    return numeric_claims(summaries.select("id", F.regexp_extract("text", r"EXACT counts[^\n]*?:\s*([^\n]+)", 1).alias("text")), COUNT)


def manual_claims(answers: DataFrame, tools: DataFrame, manual: DataFrame) -> DataFrame:
    """id, claims (the manual is named as read but no search of this id is in tools (id, tool)), refs, refs_missing (not in manual (path))."""
    searched = tools.where("tool = 'search_manual'").select("id").distinct().withColumn("searched", F.lit(True))
    refs = answers.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(MANUAL_REF), F.lit(1)))).alias("path"))
    known = manual.select("path").distinct().withColumn("known", F.lit(True))
    refs = refs.join(known, "path", "left").groupBy("id").agg(F.count("*").alias("refs"), F.count_if(F.col("known").isNull()).alias("refs_missing"))
    x = answers.join(searched, "id", "left").join(refs, "id", "left")
    return x.select("id", (F.col("text").rlike(MANUAL_CLAIM) & F.col("searched").isNull()).alias("claims"), F.coalesce("refs", F.lit(0)).alias("refs"), F.coalesce("refs_missing", F.lit(0)).alias("refs_missing"))


def calls_in_text(answers: DataFrame) -> DataFrame:
    """id, name of every tool call that an answer states as JSON text."""
    return answers.select("id", F.explode(F.regexp_extract_all("text", F.lit(CALL), F.lit(1))).alias("name"))


def without_evidence(codes: DataFrame, results: DataFrame) -> DataFrame:
    """Codes (id, code) that no result (id, text) of the same id holds, case aside; a result's codes are taken out once and joined on equality."""
    shown = results.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit(CODE_SHAPE), F.lit(1)))).alias("code"))
    return codes.select("id", F.upper(F.trim("code")).alias("code")).distinct().join(shown, ["id", "code"], "left_anti")


def sound(facts: DataFrame) -> DataFrame:
    """facts with op 'never' where a pattern isn't one, so that it counts as unmet instead of ending the job; facts are written by hand, and
    their patterns are tried on the driver."""

    def fine(pattern: str | None) -> bool:
        try:
            re.compile(pattern)
        except (re.error, TypeError):
            return False
        return True

    bad = [r.pattern for r in facts.where("op = 'regex'").select("pattern").distinct().collect() if not fine(r.pattern)]
    hit = F.coalesce(F.col("pattern").isin([p for p in bad if p is not None]), F.lit(True)) if bad else F.lit(False)
    return facts.withColumn("op", F.when((F.col("op") == "regex") & hit, "never").otherwise(F.col("op")))


def met(answer: Column, op: Column, pattern: Column) -> Column:
    """Whether an answer states a fact: a substring whatever the case, or a pattern."""
    return F.when(op == "regex", F.regexp(answer, pattern)).when(op == "sub", F.lower(answer).contains(F.lower(pattern))).otherwise(F.lit(False))


def case_scores(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """id, hits, misses, forbidden, passed; facts: kind (expected, forbidden), op, pattern, of each case of answers (id, case_id, text)."""
    x = answers.join(sound(facts), "case_id").withColumn("met", F.coalesce(met(F.col("text"), F.col("op"), F.col("pattern")), F.lit(False)))
    e, f = F.col("kind") == "expected", F.col("kind") == "forbidden"
    out = x.groupBy("id").agg(F.count_if(e & F.col("met")).alias("hits"), F.count_if(e & ~F.col("met")).alias("misses"), F.count_if(f & F.col("met")).alias("forbidden"))
    return out.withColumn("passed", (F.col("misses") == 0) & (F.col("forbidden") == 0))


def stated(answer: Column, fact: str | dict) -> Column:
    """Whether an answer states a fact: a substring, or any_of, all_of (facts again) or regex, case aside; false for anything else."""
    if isinstance(fact, str):
        return F.lower(answer).contains(fact.lower())
    for key, both, start in (("any_of", Column.__or__, False), ("all_of", Column.__and__, True)):
        if isinstance(fact, dict) and key in fact:
            return functools.reduce(both, (stated(answer, f) for f in fact[key]), F.lit(start))
    try:
        re.compile(fact["regex"])
    except (re.error, TypeError, KeyError):
        return F.lit(False)
    return answer.rlike(f"(?i){fact['regex']}")


def nested_scores(answers: DataFrame, cases: list[dict]) -> DataFrame:
    """id, hits, misses, forbidden, passed of answers (id, case_id, text); cases: case_id, expected_facts, forbidden_facts.

    The cases are a corpus written by hand, so their facts become expressions of one projection.
    """
    text = F.coalesce("text", F.lit(""))
    count = lambda facts: functools.reduce(Column.__add__, (stated(text, f).cast("long") for f in facts), F.lit(0).cast("long"))
    each = F.lit(None).cast("struct<hits:bigint,misses:bigint,forbidden:bigint>")
    for case in cases:
        hits = count(case.get("expected_facts", []))
        told = F.struct(hits.alias("hits"), (F.lit(len(case.get("expected_facts", []))) - hits).cast("long").alias("misses"), count(case.get("forbidden_facts", [])).alias("forbidden"))
        each = F.when(F.col("case_id") == case["case_id"], told).otherwise(each)
    out = answers.select("id", each.alias("s")).where("s is not null").select("id", "s.*")
    return out.withColumn("passed", (F.col("misses") == 0) & (F.col("forbidden") == 0))


def run_averages(runs: DataFrame) -> DataFrame:
    """Means of steps, calls, tokens and seconds of runs, verification passes beyond each run's first, and runs with an error."""
    mean = lambda c, by=1: F.round(F.avg(c) / by, 6).alias
    return runs.agg(mean("steps")("avg_steps"), mean("llm_calls")("avg_llm_calls"), mean("tokens_in")("avg_tokens_in"), mean("tokens_out")("avg_tokens_out"), mean("latency_ms", 1000)("avg_latency_s"),
        F.sum(F.greatest(F.lit(0), F.col("verification_passes") - 1)).cast("long").alias("reasks"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errored"))


def summary(scores: DataFrame) -> DataFrame:
    rate = lambda c: F.avg(c.cast("double"))
    facts = F.col("hits") + F.col("misses")
    return scores.agg(F.count("*").alias("cases"), F.round(rate(F.col("passed")), 6).alias("pass_rate"), F.round(F.sum("hits") / F.sum(facts), 6).alias("recall"), F.round(rate(F.col("forbidden") > 0), 6).alias("hallucination_rate"))


def sessions(history: DataFrame) -> DataFrame:
    """conv_id, turns of the user and the last of them, of history (conv_id, turn, role, text)."""
    user = history.where("role = 'user'").groupBy("conv_id")
    return user.agg(F.count("*").alias("turns"), F.max_by("text", "turn").alias("last_question"))


# How constraint files declare clocks, by name or by port, and use them.
NAMED_CLOCK = r"(?U)\bcreate_clock\b[^#\n]*?-name\s+(\w+)"
PORT_CLOCK = r"(?U)\bcreate_clock\b(?![^#\n]*?-name\b)[^#\n]*?\[get_ports\s+(\w+)\s*\]"
USED_CLOCK = r"(?U)\bget_clocks\s+(\w+)"


def clock_issues(lines: DataFrame) -> DataFrame:
    """file, clock, line_no, declared: clocks used before, or without, their declaration in constraint files (file, line_no, line)."""
    x = lines.withColumn("code", F.substring_index("line", "#", 1))
    all_of = lambda rx: F.regexp_extract_all("code", F.lit(rx), F.lit(1))
    declared = x.select("file", "line_no", F.explode(F.concat(all_of(NAMED_CLOCK), all_of(PORT_CLOCK))).alias("clock")).groupBy("file", "clock").agg(F.min("line_no").alias("declared"))
    used = x.select("file", "line_no", F.explode(all_of(USED_CLOCK)).alias("clock"))
    return used.join(declared, ["file", "clock"], "left").where("declared is null or declared > line_no").select("file", "clock", "line_no", "declared")


def quotes(answers: DataFrame) -> DataFrame:
    """id, quote of backtick texts of 20 characters or more that aren't path:line, each once."""
    found = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("`([^`\\n]{20,})`"), F.lit(1))))
    return answers.select("id", found.alias("quote")).where(~F.col("quote").rlike(r"^[A-Za-z0-9_./-]+\.[A-Za-z0-9]+:[0-9]+$"))


def unsupported(said: DataFrame, results: DataFrame) -> DataFrame:
    """Quotes (id, quote) whose first 40 characters no result (id, result) of the same id holds."""
    r = results.select(F.col("id").alias("i"), "result")
    return said.join(r, (F.col("id") == F.col("i")) & F.col("result").contains(F.left("quote", F.lit(40))), "left_anti")


def todos(plans: DataFrame) -> DataFrame:
    """id, step, call of '[N] tool(args)' in plans (id, text); quotes and blanks don't count in a call."""
    rx = r"\[([0-9]+)\]\s*([A-Za-z_]\w*\([^()\n]*\))"
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(rx), F.lit(1)).alias("n"), F.regexp_extract_all("text", F.lit(rx), F.lit(2)).alias("call"))
    return plans.select("id", F.explode(pairs).alias("p")).select("id", F.col("p.n").cast("long").alias("step"), F.regexp_replace("p.call", r"[\"'\s]", "").alias("call"))


def signatures(calls: DataFrame, by: list[str]) -> DataFrame:
    """How often each text comes per group, case, quotes and blanks aside."""
    return calls.groupBy(*by, F.md5(F.regexp_replace(F.lower("text"), "[\"' ]", "")).alias("signature")).agg(F.count("*").alias("n"))
