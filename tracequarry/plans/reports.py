"""More registered queries: summaries, listings, offsets, retained hits, open plans, quotes, constraint lint, query variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequarry.functions.profiles import GENERIC
from tracequarry.operators import answers, logs, retrieval
from tracequarry.plans.registry import BM25, CLASSED, SEVERE, STAGED, TRIAGE, _bm25, query, table_query
from tracequarry.sources.logs import classified

OFFSETS = "o as (select file, line_no, line, (sum(strlen(line) + 1) over (partition by file order by line_no) - strlen(line) - 1)::bigint as start from log)"
NEAR = """near as (select file, line_no from (
    select *, max((coalesce(severity = 'fatal', false))::int) over (partition by file order by line_no rows between 2 preceding and 2 following) as near from c) where near = 1)"""
@query("select file, line_no, start from o", f"{CLASSED}, {OFFSETS}")
def byte_offsets(c):
    return logs.offsets(c).select("file", "line_no", "start")


@query("select file, count(*)::bigint as n_lines, (sum(strlen(line) + 1) // 1024)::bigint as kb from log group by file")
def log_listing(c):
    return logs.listing(c)


@query(r"select file, code, severity, n, first_line, line as example from codes join log using (file) where line_no = first_line")
def log_summary(c):
    return logs.summary(c)


@query("""select file, code, line_no, case when a <= 16 then 'head' else 'tail' end as part from (
    select *, row_number() over (partition by file, code order by line_no) as a, row_number() over (partition by file, code order by line_no desc) as z from c where severity is not null)
where a <= 16 or z <= 16""")
def retained_hits(c):
    return logs.retained(c)


@query("select file, line_no, coalesce(line_no <> lag(line_no) over (partition by file order by line_no) + 1, false) as gap from near", f"{CLASSED}, {NEAR}")
def context_gaps(c):
    return logs.gaps(logs.context(c, F.coalesce(F.col("severity") == "fatal", F.lit(False)))).select("file", "line_no", "gap")


@query("select file, count(*)::bigint as n_unseen from c where severity in ('fatal', 'error') and (file, line_no) not in (select (file, line_no) from shown) group by file", f"{CLASSED}, {TRIAGE}")
def unseen_severe(c):
    return logs.unseen(c, logs.triage(c))


@query("select file, name, start_line, end_line from ranges where start_line <= 500 and end_line >= 100", f"{CLASSED}, {STAGED}")
def stage_overlap(c):
    return logs.overlapping(logs.stage_ranges(c), 100, 500)


@query(f"select file, code, {SEVERE} from c where severity is not null group by file, code")
def generic_codes(c):
    n = lambda s: F.count_if(F.col("severity") == s).alias(f"n_{s}")
    x = classified(c.select("file", "line_no", "line"), GENERIC).where("severity is not null")
    return x.groupBy("file", "code").agg(n("fatal"), n("error"), n("warn"))


BLOCK = "blocks as (select file || '#' || (line_no // 50)::bigint as id, line_no, line, line || case when line_no % 2 = 1 then ' never' else '' end as quote from log)"


@query("""select distinct id, quote from blocks q
where length(quote) >= 20 and not exists (select 1 from blocks x where x.id = q.id and contains(x.line, q.quote[:40]))""", f"{CLASSED}, {BLOCK}")
def quote_check(c):
    """Every line quoted, every other one with a word more, against the results of its block."""
    x = c.select(F.concat_ws("#", "file", F.floor(F.col("line_no") / 50).cast("string")).alias("id"), "line_no", "line")
    said = x.select("id", F.concat(F.lit("it says `"), "line", F.when(F.col("line_no") % 2 == 1, " never").otherwise(""), F.lit("` there")).alias("text"))
    return answers.unsupported(answers.quotes(said).distinct(), x.select("id", F.col("line").alias("result")))


@query("select file as id, 2::bigint as step, 'log_summary(path=' || file || ')' as call from log group by file union all select file, 1, 'read_logs(path=' || file || ')' from log where file > 'app_1.log' group by file")
def plan_open(c):
    f = c.select(F.col("file").alias("id")).distinct()
    told = f.select("id", F.concat(F.lit("[1] read_logs(path = '"), "id", F.lit("')\n[2] log_summary(path=\""), "id", F.lit('")')).alias("text"))
    done = f.where("id <= 'app_1.log'").select("id", F.concat(F.lit("read_logs(path="), "id", F.lit(")")).alias("call"))
    return answers.todos(told).join(done, ["id", "call"], "left_anti").select("id", "step", "call")


@table_query(f"with {BM25} select qid, count(*)::bigint as n from s where score >= (select case when count(*) >= 50 then 20 else 0 end from documents) group by qid")
def relevance_floor(spark, read):
    n = read("documents").agg(F.when(F.count("*") >= 50, 20.0).otherwise(0.0).alias("floor"))
    return _bm25(read).crossJoin(F.broadcast(n)).where("score >= floor").groupBy("qid").agg(F.count("*").alias("n"))  # one row


@table_query("select conv_id, role, md5(regexp_replace(lower(text), '[\"'' ]', '', 'g')) as signature, count(*)::bigint as n from conversations where text is not null group by all")
def call_signatures(spark, read):
    return answers.signatures(read("conversations").where("text is not null"), ["conv_id", "role"])


@table_query(f"""select source, line_no, page, case when length(s) > {retrieval.HEADING_CHARS} then 0 when regexp_matches(s, '{retrieval.CODE_HEAD}') then 2
when regexp_matches(s, '{retrieval.NOT_HEAD}') or regexp_matches(s, '{retrieval.NUMBERS_LAST}') or regexp_matches(s, '{retrieval.DECIMAL}') then 0
when letters < 4 or digits > letters // 2 then 0 when regexp_matches(s, '{retrieval.NUMBERED}') then 1 when regexp_matches(s, '{retrieval.TITLE}') then 2 else 0 end::bigint as level, trim(line, ' ') as heading
from (select *, trim(line, chr(9) || chr(10) || chr(12) || chr(13) || ' ') as s, length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) as letters, length(regexp_replace(line, '[^0-9]', '', 'g')) as digits from (
    select doc_id::varchar as source, 1::bigint as page, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1)::bigint as line_no from documents))
where level > 0""")
def pdf_headings(spark, read):
    return retrieval.pdf_headings(read("documents").select(F.col("doc_id").cast("string").alias("source"), "text"))


#: Cases of the evaluation: nested facts, one of them with a pattern that isn't one.
CASES = [
    {"case_id": 0, "expected_facts": [{"any_of": ["the", {"regex": r"\b[0-9]+\b"}]}, {"all_of": ["a", {"any_of": ["e", "zzz"]}]}], "forbidden_facts": ["zzz"]},
    {"case_id": 1, "expected_facts": ["I", {"regex": "("}], "forbidden_facts": [{"regex": "q"}]},
]


@table_query(r"""select id, hits, misses, forbidden, misses = 0 and forbidden = 0 as passed from (
    select id, case when k = 0 then h0 else h1 end as hits, 2 - case when k = 0 then h0 else h1 end as misses, case when k = 0 then contains(t, 'zzz')::bigint else contains(t, 'q')::bigint end as forbidden
    from (select *, (contains(t, 'the') or regexp_matches(t, '\b[0-9]+\b'))::bigint + (contains(t, 'a') and (contains(t, 'e') or contains(t, 'zzz')))::bigint as h0, contains(t, 'i')::bigint as h1
        from (select conv_id || '/' || turn as id, conv_id % 3 as k, lower(coalesce(text, '')) as t from conversations where role = 'assistant') where k < 2))""")
def nested_eval(spark, read):
    said = read("conversations").where("role = 'assistant'")
    return answers.nested_scores(said.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), (F.col("conv_id") % 3).alias("case_id"), "text"), CASES)


@table_query("""select round(avg(turn), 6) as avg_steps, round(avg(turn % 4), 6) as avg_llm_calls, round(avg(length(text)), 6) as avg_tokens_in, round(avg(length(text) % 7), 6) as avg_tokens_out,
round(avg(conv_id % 900) / 1000, 6) as avg_latency_s, sum(greatest(0, conv_id % 4 - 1))::bigint as reasks, count_if(conv_id % 5 = 0)::bigint as errored from conversations""")
def eval_averages(spark, read):
    size = F.length("text")
    x = read("conversations").select(F.col("turn").alias("steps"), (F.col("turn") % 4).alias("llm_calls"), size.alias("tokens_in"), (size % 7).alias("tokens_out"), (F.col("conv_id") % 900).alias("latency_ms"),
        (F.col("conv_id") % 4).alias("verification_passes"), F.when(F.col("conv_id") % 5 == 0, "stopped").alias("error"))
    return answers.run_averages(x)
