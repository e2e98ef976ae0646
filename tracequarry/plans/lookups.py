"""More registered queries: times, fetches, lookups, evidence checks, skills, sessions, plans, notes, freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequarry.functions import profiles
from tracequarry.functions.profiles import EDA
from tracequarry.operators import answers, logs, lookups, retrieval
from tracequarry.plans.registry import BM25, CLASSED, INCIDENT, MENTION_SQL, STAGED, TOKENS, _top, message, query, table_query
from tracequarry.sources.logs import classified, read_logs, write_logs
from tracequarry.sources.store import workspace

TIMED = "timed as (select *, '[' || strftime(ts, '%H:%M:%S') || '  ' || ts_s || 's] ' || line as eda, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z ' || line as iso from c)"


def _timed(c):
    clock = F.date_format(F.timestamp_seconds("ts_s"), "HH:mm:ss")
    eda = F.concat(F.lit("["), clock, F.lit("  "), F.col("ts_s").cast("string"), F.lit("s] "), "line")
    iso = F.concat(F.date_format(F.timestamp_seconds("ts_s"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z "), "line")
    return c.select("file", "line_no", "severity", "code", eda.alias("eda"), iso.alias("iso"))


@query("select file, line_no, regexp_extract(eda, '([0-9]+)s\\]', 1)::bigint as eda_s, epoch(strptime(iso[:19], '%Y-%m-%dT%H:%M:%S'))::bigint as iso_s from timed", f"{CLASSED}, {TIMED}")
def log_times(c):
    x = _timed(c)
    return x.select("file", "line_no", profiles.eda_seconds(F.col("eda")).alias("eda_s"), profiles.generic_seconds(F.col("iso")).alias("iso_s"))


def _text_logs(c):
    """The log with times, written as text files and read again."""
    path = workspace(c.sparkSession, "logs")
    write_logs(_timed(c).select("file", "line_no", F.col("eda").alias("line")), path)
    x = classified(read_logs(c.sparkSession, path), EDA)
    return x.withColumn("ts_s", profiles.eda_seconds(F.col("line")))


@query("select * from codes")
def text_log_codes(c):
    return logs.code_table(_text_logs(c))


@query("select file, count(*)::bigint as n_lines, (sum(strlen(eda) + 1) // 1024)::bigint as kb from timed group by file", f"{CLASSED}, {TIMED}")
def text_log_listing(c):
    return logs.listing(_text_logs(c))


@query("""select ts_s, file, line_no, eda[:180] as line from timed, (select max(ts_s) as anchor from c where file = 'app_1.log' and line_no = 100)
where ts_s between anchor - 3600 and anchor + 3600 order by ts_s, file, line_no limit 200""", f"{CLASSED}, {TIMED}")
def text_log_correlate(c):
    x = _text_logs(c)
    return logs.correlate(x, x.where("file = 'app_1.log' and line_no = 100").agg(F.max("ts_s").alias("anchor")), 3600)


@query("""select r.file as name, r.name as stage, r.start_line, r.end_line, b.ts_s - a.ts_s as seconds from ranges r
join c a on a.file = r.file and a.line_no = r.start_line left join c b on b.file = r.file and b.line_no = r.end_line and not r.incomplete""", f"{CLASSED}, {STAGED}")
def stage_durations(c):
    x = lookups.durations(logs.stage_ranges(c), c.select("file", "line_no", "ts_s"))
    return x.select(F.col("file").alias("name"), F.col("name").alias("stage"), "start_line", "end_line", "seconds")


@query("""select w, coalesce(min(f) filter (f = w), min(f) filter (regexp_extract(f, '[^/]*$') = regexp_extract(w, '[^/]*$')), min(f) filter (ends_with(f, w))) as file
from (values ('app_1.log'), ('logs/app_2.log'), ('3.log'), ('gone.log'), ('')) t(w), (select distinct file as f from log) group by w""")
def pick_log(c):
    wanted = c.sparkSession.createDataFrame([("app_1.log",), ("logs/app_2.log",), ("3.log",), ("gone.log",), ("",)], "w string")
    return lookups.picked(c.select("file").distinct(), wanted)


@query("select c.file, c.line_no, c.line from c join (select file, min(line_no) as first_line from c where severity is not null group by file, code) h on h.file = c.file and h.first_line = c.line_no group by all")
def fetch_lines(c):
    return lookups.fetched(c, logs.code_table(c).select("file", F.col("first_line").alias("line_no")))


@query("""select file, line_no, line from (select *, row_number() over (partition by file order by line_no) as k
from c where regexp_matches(line, '(?i)mod3') and regexp_matches(line, '(?i)\\b(ERROR|ERR|FAIL(ED|URE)?)\\b')) where k <= 20""")
def pattern_scan(c):
    """The first 20 matches of each file."""
    return lookups.first_hits(logs.pattern_filter(c, EDA, "mod3", ["error"]), 20).select("file", "line_no", "line")


@query("select file, line_no, line from c join (select file as f, count(*) as total from c group by file) on f = file where line_no between 199 and 398")
def read_range(c):
    return lookups.line_range(c, 200, 399).select("file", "line_no", "line")


@query("""select r.file, s.line_no, r.first_line, r.n from (
    select file, min(line_no) as first_line, count(*)::bigint as n, max(line_no) as z from (
        select *, line_no - row_number() over (partition by file, line order by line_no) as island from log where trim(line) <> '') group by file, line, island having count(*) >= 3
) r join log s on s.file = r.file and s.line_no between r.first_line and r.z""")
def repeat_of_line(c):
    return logs.repeat_of_line(c)


@query("""select file, line_no, shown, n from (select l.file, l.line_no, l.line as shown, 1::bigint as n from log l anti join r on r.file = l.file and l.line_no between r.first_line and r.z
union all select l.file, l.line_no, l.line || '  [x' || n || ']', n from r join log l on l.file = r.file and l.line_no = r.first_line)""",
    f"""{CLASSED}, r as (select file, min(line_no) as first_line, count(*)::bigint as n, max(line_no) as z from (
        select *, line_no - row_number() over (partition by file, line order by line_no) as island from log where trim(line) <> '') group by file, line, island having count(*) >= 3)""")
def collapsed_lines(c):
    return lookups.collapsed(c)


REGION = """
w as (select * from c where line_no between 99 and 499),
top as (select *, row_number() over (partition by file, kind order by n desc, name) as place from (
    select file, 'code' as kind, code as name, count(*) as n from w where severity is not null group by all
    union all select file, 'mention', token, count(*) from m where line_no between 99 and 499 group by all)),
heads as (select *, row_number() over (partition by file order by head) as k from incidents where head between 99 and 499)"""


@query("""select file, kind, name, n::bigint as n, place::bigint as place from top where place <= 8
union all select file, 'stage', name, 1, start_line from ranges where start_line <= 499 and end_line >= 99
union all select file, 'incident', severity, body_end - head + 1, head from heads where k <= 5
union all select file, 'incidents', 'all', count(*), 0 from heads group by file""", f"{CLASSED}, {STAGED}, {INCIDENT}, {MENTION_SQL}, {REGION}")
def region_details(c):
    return logs.region_details(c, logs.stage_ranges(c), logs.incidents(c), 100, 500)


@query("""select i.file || '#' || i.first_line as id, i.code from codes i anti join (select file, code from codes where n % 2 = 0) e on e.file = i.file and e.code = i.code where i.code <> '(uncoded)'""")
def code_evidence(c):
    """Codes said to be looked up, of which half have a result that names them."""
    codes = logs.code_table(c).where("code <> '(uncoded)'").withColumn("id", F.concat_ws("#", "file", F.col("first_line").cast("string")))
    shown = codes.where("n % 2 = 0").select("id", F.concat(F.lit("result for "), F.lower("code"), F.lit(" there")).alias("text"))
    return answers.without_evidence(codes.select("id", F.concat(F.lit(" "), F.lower("code")).alias("code")), shown)


@query("""select id, path, line_no, coalesce(e.file, n.file) as file from (
    select distinct file || '#' || line_no as id, case line_no % 3 when 0 then 'logs/' || file when 1 then file else 'gone.log' end as path, line_no + 1 as line_no, file as f from log) x
left join (select distinct file from log) e on e.file = x.path left join (select distinct file from log) n on n.file = regexp_extract(x.path, '[^/]*$')""")
def cite_resolve(c):
    path = F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("logs/"), "file")).when(F.col("line_no") % 3 == 1, F.col("file")).otherwise("gone.log")
    said = c.select(F.concat_ws("#", "file", F.col("line_no").cast("string")).alias("id"), F.concat(F.lit("see `"), path, F.lit("` line "), (F.col("line_no") + 1).cast("string"), F.lit(".")).alias("text"))
    return answers.resolved(answers.citations(said), c.select("file").distinct()).select("id", "path", "line_no", "file")


@query("select file as id, unnest(['fatal', 'error', 'warn']) as severity, unnest([count_if(severity = 'fatal'), count_if(severity = 'error'), count_if(severity = 'warn')])::bigint as claimed from c group by file")
def census_parse(c):
    n = logs.census(c)
    text = F.concat_ws(" ", F.lit("# log\nEXACT counts (whole file):"), F.col("n_fatal").cast("string"), F.lit("FATAL ·"), F.col("n_error").cast("string"), F.lit("ERROR ·"), F.col("n_warn").cast("string"), F.lit("WARN\nEVT-1 99 ERROR"))
    return answers.told_counts(n.select(F.col("file").alias("id"), text.alias("text")))




@query(f"""select file, code, case when len(string_split(q, ' ')) >= 2 then q else code end as question from (
    select c.file, c.code, {message('c.line')} as q from codes join c on c.file = codes.file and c.line_no = codes.first_line)""")
def code_questions(c):
    """What a code is looked up by: the message of its first line, if it has two words at least."""
    return lookups.code_questions(c, 2).select("file", "code", "question")


@table_query(f"""with {BM25.replace("unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as token from benchmark where item_id % 20 = 0)", "unnest(regexp_extract_all(lower(" + message("'**ERROR: (DOC-' || item_id || '): ' || text") + "), '[a-z0-9_]+')) as token from benchmark where item_id % 20 = 0)")}
select 'DOC-' || qid as code, id, r as score from (select *, row_number() over (partition by qid order by r desc, id) as k from (select qid, id, round(score, 6) as r from s)) where k <= 2 and r >= 20""")
def code_passages(spark, read):
    """Codes to the messages of their first lines to the two best passages at or above the floor."""
    line = F.concat(F.lit("**ERROR: (DOC-"), F.col("item_id").cast("string"), F.lit("): "), "text")
    c = classified(read("benchmark").where("item_id % 20 = 0").select(F.lit("a.log").alias("file"), F.col("item_id").alias("line_no"), line.alias("line")), EDA)
    asked = lookups.code_questions(c).select(F.col("code").alias("qid"), F.col("question").alias("text"))
    docs = read("documents").select(F.col("doc_id").alias("id"), "text")
    return _top(retrieval.bm25(docs, asked), 2).where("score >= 20").withColumnRenamed("qid", "code")


@table_query(f"""with {TOKENS}, x as (select item_id, 'what does EVT-' || (item_id % 9) || case when item_id % 2 = 0 then ' mean' else ' mean for E0520 timing' end as text from benchmark)
select item_id, text, item_id % 2 = 0 as bare, case when item_id % 2 = 0 then 2 else 3 end::bigint as variants from x""")
def question_variants(spark, read):
    n = F.col("item_id")
    text = F.concat(F.lit("what does EVT-"), (n % 9).cast("string"), F.when(n % 2 == 0, " mean").otherwise(" mean for E0520 timing"))
    x = read("benchmark").select("item_id", text.alias("text"))
    return x.select("item_id", "text", profiles.bare_code(F.col("text")).alias("bare"), F.size(lookups.variants(F.col("text"))).cast("long").alias("variants"))


VARIANTS = """vq as (
    select item_id as qid, v, unnest(regexp_extract_all(lower(t), '[a-z0-9_]+')) as token from (
        select item_id, unnest([text || ' E' || lpad(item_id::varchar, 4, '0'), 'E' || lpad(item_id::varchar, 4, '0')]) as t, unnest([0, 1]) as v from benchmark where item_id % 20 = 0)),
vs as (select qid, v, id, sum(qf * ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * len / a))) as score
    from p join (select qid, v, token, count(*) as qf from vq where length(token) > 1 group by all) using (token)
    join (select token, count(*) as df from p group by token) using (token), (select count(*) as n, avg(len(t)) as a from t) group by all)"""


@table_query(f"with {BM25}, {VARIANTS}, b as (select qid, id, round(max(score), 6) as r from vs group by all) select qid, id, r as score from (select *, row_number() over (partition by qid order by r desc, id) as k from b) where k <= 5")
def query_variants(spark, read):
    """Each question and its codes as questions of their own; a document's best score counts."""
    docs = read("documents").select(F.col("doc_id").alias("id"), "text")
    asked = read("benchmark").where("item_id % 20 = 0").select("item_id", F.concat("text", F.lit(" E"), F.lpad(F.col("item_id").cast("string"), 4, "0")).alias("text"))
    each = asked.select("item_id", F.posexplode(lookups.variants(F.col("text"))).alias("v", "text")).select(F.struct("item_id", "v").alias("qid"), "text")
    best = retrieval.best_of(retrieval.bm25(docs, each).withColumn("base", F.col("qid.item_id")))
    return _top(best.withColumnRenamed("base", "qid"), 5)


SKILLS = """sk as (select doc_id as id, split_part(text, ' ', 1) || '-' || doc_id as name, text as description, case doc_id % 3 when 0 then 'any' when 1 then 'EDA' else 'generic' end as domain from documents),
mine as (select id, regexp_extract_all(lower(name || ' ' || description), '[a-z]{3,}') as t from sk where lower(domain) in ('', 'any', 'eda')),
tf as (select id, token, count(*) as tf from (select id, unnest(t) as token from mine) group by all)"""


@table_query(f"""with {SKILLS}, q as (select item_id as qid, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) as token from benchmark where item_id % 20 = 0),
s as (select qid, id, round(sum(tf * ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0))), 6) as score from q join tf using (token) join (select token, count(*) as df from tf group by token) using (token), (select count(*) as n from mine) group by all)
select qid, id, score from (select *, row_number() over (partition by qid order by score desc, id) as k from s) where k <= 8""")
def skill_ranking(spark, read):
    d = read("documents")
    domain = F.when(F.col("doc_id") % 3 == 0, "any").when(F.col("doc_id") % 3 == 1, "EDA").otherwise("generic")
    skills = d.select(F.col("doc_id").alias("id"), F.concat_ws("-", F.split("text", " ")[0], F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("description"), domain.alias("domain"))
    asked = read("benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("qid"), "text")
    return _top(lookups.skill_scores(skills.where(lookups.domain_fits(F.col("domain"), "eda")), asked), 8)


@table_query("select doc_id, len(text) as n, case when len(text) <= 400 then text else text[:280] || chr(10) || chr(10) || '... [truncated ' || (len(text) - 380) || ' chars] ...' || chr(10) || chr(10) || text[-100:] end as short, left(sha1('model' || chr(10) || text), 16) as key from documents")
def truncated_texts(spark, read):
    return read("documents").select("doc_id", F.length("text").cast("long").alias("n"), profiles.truncated(F.col("text"), 400).alias("short"), profiles.chunk_key("model", F.col("text")).alias("key"))


@table_query("""select conv_id, turn, case when len(text) <= 100 then text else '[compacted ' || (len(text) - 90) || ' chars — re-call the tool to re-fetch]' || chr(10) || text[:60] || chr(10) || '... [middle elided] ...' || chr(10) || text[-30:] end as text
from conversations where text is not null""")
def compacted_history(spark, read):
    return read("conversations").where("text is not null").select("conv_id", "turn", profiles.compacted(F.col("text"), 100).alias("text"))


@table_query("select doc_id, (i - 1)::bigint + 1 as page, l[i] as text from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(replace(text, chr(10), chr(12)), chr(12)) as l from documents))")
def form_feed_pages(spark, read):
    return lookups.pages(read("documents").select(F.col("doc_id"), F.translate("text", "\n", "\f").alias("text")))


@table_query("select user_id % 50 as user, path, regexp_matches(path, '\\.key|secret|\\.env') as refused, path = '/data/a' or starts_with(path, '/data/a/') as allowed from (select user_id, '/data/' || (['a', 'ab', 'a/b'])[1 + event_id % 3] || (['/x.log', '/my.KEY', '/.env', '/secrets.txt'])[1 + event_id % 4] as p from events), lateral (select lower(p) as path) group by all")
def path_rules(spark, read):
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % n + 1).cast("int"))
    path = F.lower(F.concat(F.lit("/data/"), pick(["a", "ab", "a/b"], 3), pick(["/x.log", "/my.KEY", "/.env", "/secrets.txt"], 4)))
    x = read("events").select((F.col("user_id") % 50).alias("user"), path.alias("path")).distinct()
    return x.select("user", "path", profiles.sensitive(F.col("path")).alias("refused"), profiles.under(F.col("path"), "/data/a").alias("allowed"))


@table_query("select conv_id, 'call_' || (turn % 3) as name, count(*)::bigint as n from conversations where role = 'assistant' and turn % 2 = 1 group by all")
def calls_in_text(spark, read):
    call = F.when(F.col("turn") % 2 == 1, F.concat(F.lit('so {"name": "call_'), (F.col("turn") % 3).cast("string"), F.lit('", "arguments": {"path": {"x": 1}}} then'))).otherwise("none {}")
    return answers.calls_in_text(read("conversations").where("role = 'assistant'").select(F.col("conv_id").alias("id"), call.alias("text"))).groupBy(F.col("id").alias("conv_id"), "name").agg(F.count("*").alias("n"))


@table_query("""select conv_id || '/' || turn as id, turn % 3 = 1 as claims, (turn % 2)::bigint as refs, case when turn % 4 = 3 then 1 else 0 end::bigint as refs_missing from conversations where role = 'assistant'""")
def manual_claims(spark, read):
    t = F.col("turn")
    text = F.concat(F.when(t % 3 == 0, "I looked. ").otherwise("According to the manual, "), F.when(t % 4 == 1, "see manual:a/b.md here").when(t % 4 == 3, "see manual/gone.txt").otherwise("that is all"))
    said = read("conversations").where("role = 'assistant'").select(F.concat_ws("/", F.col("conv_id").cast("string"), t.cast("string")).alias("id"), text.alias("text"), t.alias("turn"))
    tools = said.where("turn % 3 = 2").select("id", F.lit("search_manual").alias("tool"))
    return answers.manual_claims(said.select("id", "text"), tools, spark.createDataFrame([("a/b.md",)], "path string"))


@table_query("select user_id % 20 as plan, count_if(event_type = 'view')::bigint as pending, count_if(event_type = 'click')::bigint as in_progress, count_if(event_type in ('signup', 'purchase'))::bigint as done, count_if(event_type = 'error')::bigint as blocked from events group by all")
def plan_status(spark, read):
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "in_progress").when(F.col("event_type") == "error", "blocked").otherwise("done")
    return lookups.plan_counts(read("events").select((F.col("user_id") % 20).alias("plan"), status.alias("status")))


@table_query("select conv_id, count_if(role = 'assistant')::bigint as llm_calls, sum(case when role = 'user' then length(text) else 0 end)::bigint as tokens_in, sum(case when role = 'assistant' then length(text) else 0 end)::bigint as tokens_out, sum(turn * 10)::bigint as latency_ms from conversations group by conv_id")
def telemetry_totals(spark, read):
    n = lambda role: F.when(F.col("role") == role, F.length("text")).otherwise(0)
    x = read("conversations").select("conv_id", n("user").alias("tokens_in"), n("assistant").alias("tokens_out"), (F.col("turn") * 10).alias("latency_ms"), (F.col("role") == "assistant").cast("int").alias("llm_calls"))
    return lookups.totals(x, "conv_id")


@table_query("select conv_id, max(turn)::bigint as updated from conversations group by conv_id order by updated desc, conv_id limit 20")
def newest_sessions(spark, read):
    return lookups.newest(read("conversations").groupBy("conv_id").agg(F.max("turn").cast("long").alias("updated")), "updated", "conv_id", 20)


@table_query("select conv_id, turn, left(text, 500) as question from conversations where role = 'user' and turn % 7 <> 0 order by conv_id desc, turn desc limit 50")
def audit_tail(spark, read):
    """The last records of an audit log of JSON lines; broken lines are skipped."""
    record = F.to_json(F.struct("conv_id", "turn", F.left("text", F.lit(500)).alias("question")))
    rows = read("conversations").where("role = 'user'").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("line_no"), F.when(F.col("turn") % 7 == 0, "{broken").otherwise(record).alias("line"))
    return lookups.audit_tail(rows, 50, "conv_id long, turn long, question string")


@table_query("select user_id % 40 as key, arg_max(event_type || ' ' || event_id, (ts, event_id)) as value, count(*)::bigint as saves from events where event_type <> 'error' group by all having arg_max(event_type, (ts, event_id)) <> 'view'")
def notes(spark, read):
    """Saves and deletions of notes in order, as the table they leave."""
    value = F.when(F.col("event_type") != "view", F.concat_ws(" ", "event_type", F.col("event_id").cast("string")))
    x = read("events").where("event_type <> 'error'").select((F.col("user_id") % 40).alias("key"), value.alias("value"), F.struct("ts", "event_id").alias("at"))
    return lookups.latest_notes(x)


@table_query("""select coalesce(a.id, b.id) as path, case when b.id is null then 'gone' when a.id is null then 'new' else 'changed' end as state from (select doc_id as id, n_chars as size from documents where doc_id % 7 <> 0) a
full join (select doc_id as id, n_chars + (doc_id % 5 = 0)::int as size from documents where doc_id % 11 <> 0) b on a.id = b.id where a.id is null or b.id is null or a.size <> b.size""")
def stale_files(spark, read):
    d = read("documents")
    known = d.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"))
    now = d.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("path"), (F.col("n_chars") + (F.col("doc_id") % 5 == 0).cast("int")).alias("size"))
    return lookups.stale(known, now, "path", ["size"])


@table_query("select user_id % 30 as file, bool_or(event_type = 'click' and r = 1) as jsonl from (select *, row_number() over (partition by user_id % 30 order by event_id) as r from events where event_type <> 'view') group by all")
def jsonl_sniff(spark, read):
    line = F.when(F.col("event_type") == "click", F.col("props")).when(F.col("event_type") == "error", "{broken").otherwise("plain")
    e = read("events").where("event_type <> 'view'")
    return lookups.sniffed(e.select((F.col("user_id") % 30).alias("file"), F.col("event_id").alias("line_no"), line.alias("line")))
