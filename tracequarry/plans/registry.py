"""All registered queries and their SQL. Log queries run on the rendered events log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracequarry.functions.profiles import EDA, template
from tracequarry.operators import answers, logs, retrieval
from tracequarry.operators.logindex import LogIndex
from tracequarry.plans.eventlog import event_index
from tracequarry.sources.logs import RENDERED, json_records
from tracequarry.sources.store import workspace

LOG = RENDERED.format(events="events").replace("as string", "as varchar")
CLASSED = rf"""
log as ({LOG}),
c as (
    select *, epoch_us(ts) // 1000000 as ts_s,
           case when regexp_matches(line, '(?i)\b(FATAL|PANIC|ABORT|core dumped|Segmentation fault)\b') then 'fatal'
                when regexp_matches(line, '(?i)\b(ERROR|ERR|FAIL(ED|URE)?)\b') then 'error'
                when regexp_matches(line, '(?i)\bWARN(ING)?\b') then 'warn' end as severity,
           coalesce(nullif(regexp_extract(line, '\(([A-Z][A-Z0-9]+-\d+)\)', 1), ''), '(uncoded)') as code
    from log
),
codes as (select file, code, arg_min(severity, line_no) as severity, count(*)::bigint as n, min(line_no) as first_line from c where severity is not null group by all)
"""
STAGED = r"""
b as (
    select file, line_no, regexp_extract(line, '--- (Starting|Ending) "([^"]+)"', 1) as kind, regexp_extract(line, '--- (Starting|Ending) "([^"]+)"', 2) as name
    from c where regexp_matches(line, '--- (Starting|Ending) "')
), b1 as (select *, sum(case when kind = 'Starting' then 1 else -1 end) over (partition by file, name order by line_no) as bal from b),
b2 as (select *, bal - least(0, min(bal) over (partition by file, name order by line_no)) as depth from b1),
b3 as (select *, case when kind = 'Starting' then depth else lag(depth, 1, 0) over (partition by file, name order by line_no) end as level from b2),
b4 as (
    select *, lead(line_no) over (partition by file, name, level order by line_no) as nxt, lead(kind) over (partition by file, name, level order by line_no) as nk
    from b3 where level > 0
), ranges as (
    select file, name, line_no as start_line, case when nk = 'Ending' then nxt else total end as end_line, coalesce(nk, '') <> 'Ending' as incomplete
    from b4 join (select file, count(*) as total from c group by file) t using (file) where kind = 'Starting'
), owned as (
    select s.file, s.line_no, s.severity, s.code, coalesce(arg_max(r.name, r.start_line), '<pre-stage>') as stage
    from (select * from c where severity is not null) s left join ranges r on r.file = s.file and r.start_line <= s.line_no and s.line_no < r.end_line
    group by all
), hist as (
    select file, stage, count_if(severity = 'fatal')::bigint as n_fatal, count_if(severity = 'error')::bigint as n_error, count_if(severity = 'warn')::bigint as n_warn,
           count(distinct code)::bigint as n_codes, min(case when severity <> 'warn' then line_no end) as first_severe_line
    from owned group by all
)
"""
INCIDENT = r"""
i1 as (select *, max(case when severity is not null then line_no end) over (partition by file order by line_no) as head from c),
i2 as (
    select *, max(case when line_no = head or (regexp_matches(line, '^[ \t]|^\s*$') and line_no - head <= 15) then 0 else 1 end)
        over (partition by file, head order by line_no) as broken
    from i1 where head is not null
), incidents as (select file, head, max(line_no) as body_end, arg_min(severity, line_no) as severity from i2 where broken = 0 group by file, head)
"""
QUERIES: dict = {}
ORACLES: dict = {}
ANCHOR = 1_704_100_000


def query(sql: str | None = None, parts: str = CLASSED):
    """Registers a function of (lines classified, sf_dir) on the log; sql follows the parts."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(event_index(spark, sf_dir).table("lines").select("file", "line_no", "line", "severity", "code", "ts_s"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = f"with {parts} {sql}"
        return f

    return add


def index_query(sql: str, parts: str = CLASSED):
    """Registers a function of the log's stored index; sql follows the parts."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(event_index(spark, sf_dir))
        ORACLES[f.__name__] = f"with {parts} {sql}"
        return f

    return add


def table_query(sql: str | None = None):
    """Registers a function of (spark, read) on tables; read gives a table by name."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def message(line: str) -> str:
    """SQL for what a log line says, by the rules of the log's messages."""
    x = f"regexp_replace(trim({line}), '^\\s*(\\*\\*)?(FATAL|ERROR|ERR|WARN(?:ING)?|INFO|NOTE)\\s*:?\\s*', '', 'i')"
    for rx, put in (("\\(\\s*[A-Z][A-Z0-9_]+-\\d+\\s*\\)\\s*:?\\s*", ""), ("\\S*/\\S+", " "), ("\\b0x[0-9a-fA-F]+\\b", " "), ("[''\"][^''\"]{1,80}[''\"]", " "), ("\\b\\d+(?:\\.\\d+)?\\b", " ")):
        x = f"regexp_replace({x}, '{rx}', '{put}', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' :.-')"


SEVERE = ", ".join(f"count_if(severity = '{s}')::bigint as n_{s}" for s in ("fatal", "error", "warn"))


@query("select file, line_no, line from log")
def log_render(c):
    return c.select("file", "line_no", "line")


@index_query(f"select file, {SEVERE}, count(*)::bigint as total from c group by file")
def severity_census(ix):
    return ix.census()


@index_query("select * from codes")
def code_table(ix):
    return logs.code_order(ix.code_table())


@index_query("""select file, prefix, codes[1] as primary_code, severities[1] as severity, ns[1] as n, firsts[1] as first_line, array_to_string(codes[2:], ',') as others
from (select file, regexp_replace(code, '-[^-]*$', '') as prefix, list(code order by r, n desc, code) as codes, list(severity order by r, n desc, code) as severities,
             list(n order by r, n desc, code) as ns, list(first_line order by r, n desc, code) as firsts
      from (select *, case severity when 'fatal' then 0 else 1 end as r from codes where severity <> 'warn' and code <> '(uncoded)') group by all)""")
def prefix_families(ix):
    return logs.prefix_families(ix.code_table())


@index_query("""select file, min(line_no) as first_line, count(*)::bigint as n from (
    select *, sum(brk) over (partition by file order by line_no) as run from (
        select *, case when line is distinct from lag(line) over (partition by file order by line_no) then 1 else 0 end as brk from log)
) where trim(line) <> '' group by file, run having count(*) >= 3""")
def repeats(ix):
    return ix.repeats()


@index_query("select file, code, severity, n, first_line from codes")
def index_grown(ix):
    """Half of each log is indexed, then the rest is added: the code table is that of the whole."""
    half = ix.table("lines").join(ix.totals(), "file").select("file", "line_no", "line", "ts_s", (F.col("line_no") * 2 < F.col("total")).alias("early"))
    grown = LogIndex(ix.spark, workspace(ix.spark, "logindex"), ix.profile)
    grown.add(half.where("early"))
    grown.add(half.where("not early"))
    return grown.code_table()


@index_query("select * from incidents", f"{CLASSED}, {INCIDENT}")
def incidents(ix):
    return ix.incidents()


@query("""select w.file, w.line_no, i.head, i.body_end, i.severity, w.line_no <= i.body_end as inside
from log w asof join incidents i on i.file = w.file and w.line_no >= i.head""", f"{CLASSED}, {INCIDENT}")
def incident_around(c):
    return logs.incident_around(logs.incidents(c), c.select("file", "line_no"))


@index_query("select * from ranges", f"{CLASSED}, {STAGED}")
def stage_ranges(ix):
    return ix.stage_ranges()


@index_query("""select hist.*, coalesce(codes, '') as codes from hist left join (
    select file, stage, string_agg(code || ':' || n, ',' order by code) as codes from (select file, stage, code, count(*) as n from owned where code <> '(uncoded)' group by all) group by all) using (file, stage)""", f"{CLASSED}, {STAGED}")
def stage_hist(ix):
    """The map of codes as text: code:n, comma-joined in the order of the codes."""
    each = F.transform(F.map_entries("codes"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return ix.stage_hist().withColumn("codes", F.array_join(each, ","))


@index_query("""select r.file, r.name, r.start_line, r.end_line, coalesce(n_fatal, 0) as n_fatal, coalesce(n_error, 0) as n_error,
case when incomplete then 'INCOMPLETE' when n_fatal > 0 then 'FATAL' when n_error > 0 then 'ERROR' else 'OK' end as status
from ranges r left join hist h on h.file = r.file and h.stage = r.name""", f"{CLASSED}, {STAGED}")
def stage_timeline(ix):
    return logs.timeline(ix.stage_ranges(), ix.stage_hist())


@query("""select f.file, f.stage, h.n, f.line_no, f.severity, trim(f.line)[:160] as line from (
    select file, stage, min(line_no) as line_no, arg_min(severity, line_no) as severity, arg_min(line, line_no) as line from (
        select s.file, s.line_no, s.severity, s.line, coalesce(arg_min(r.name, case when r.incomplete then 1e15 + r.start_line else r.end_line end), '<pre-stage>') as stage
        from c s left join ranges r on r.file = s.file and s.line_no > r.start_line and s.line_no < r.end_line where s.severity in ('error', 'fatal') group by all
    ) group by file, stage) f
join (select file, stage, count_if(severity <> 'warn')::bigint as n from owned group by file, stage) h using (file, stage) where h.n > 0""", f"{CLASSED}, {STAGED}")
def stage_errors(c):
    return logs.stage_errors(c, logs.stage_ranges(c))


@query("""select file, null::varchar as stage, null::bigint as n, line_no, severity, trim(line)[:160] as line from (
    select *, row_number() over (partition by file order by line_no) as k from c where severity in ('error', 'fatal') and not contains(line, '--- ')) where k <= 10""")
def stage_errors_flat(c):
    """Logs without banners: the first severe lines, flat."""
    plain = c.where("not contains(line, '--- ')")
    return logs.stage_errors(plain, logs.stage_ranges(plain))


@query("""select file, line_no, line, is_hit from (
    select *, max(is_hit::int) over (partition by file order by line_no rows between 2 preceding and 2 following) as near
    from (select *, coalesce(severity = 'fatal', false) as is_hit from c)) where near = 1""")
def context_window(c):
    return logs.context(c, F.coalesce(F.col("severity") == "fatal", F.lit(False))).select("file", "line_no", "line", "is_hit")


@query("select file, line_no, line, severity from c where severity in ('error', 'fatal')")
def severity_filter(c):
    return c.where(F.col("severity").isin("error", "fatal")).select("file", "line_no", "line", "severity")


@query(r"select file, line_no, line from c where regexp_matches(line, '(?i)mod[0-2]\.py') and regexp_matches(line, '(?i)\b(ERROR|ERR|FAIL(ED|URE)?)\b')")
def pattern_filter(c):
    return logs.pattern_filter(c, EDA, r"mod[0-2]\.py", ["error"]).select("file", "line_no", "line")


TRIAGE = """
f as (select *, count(*) over (partition by file) as total, count_if(severity in ('error', 'fatal')) over (partition by file) as n_severe,
             case when severity in ('error', 'fatal') then row_number() over (partition by file, severity in ('error', 'fatal') order by line_no) end as up,
             case when severity in ('error', 'fatal') then row_number() over (partition by file, severity in ('error', 'fatal') order by line_no desc) end as down from c),
f1 as (select *, coalesce(severity = 'fatal' or up <= 66 or (n_severe > 2000 and down <= 50), false) as hit from f),
f2 as (select *, max(hit::int) over (partition by file order by line_no rows between 2 preceding and 2 following) as near from f1),
f3 as (select *, row_number() over (partition by file order by line_no) as k from f2 where near = 1 or (n_severe > 0 and regexp_matches(line, '--- (Starting|Ending) "'))
       or line_no >= total - case when n_severe = 0 then 200 when n_severe <= 2000 then 50 else 0 end),
shown as (select file, line_no, line from f3 where k <= 200)"""


@query("select * from shown", f"{CLASSED}, {TRIAGE}")
def triage(c):
    return logs.triage(c)


@query("select file, line_no, line from log join (select file, count(*) as total from log group by file) using (file) where line_no < 10 or line_no >= total - 15")
def head_tail(c):
    return logs.head_tail(c.select("file", "line_no", "line"), 10, 15)


@query("""select file, code, line_no, n, case when k <= 16 then 'head' when k > n - 16 then 'tail' else 'between' end as place from (
    select *, row_number() over (partition by file, code order by line_no) as k, count(*) over (partition by file, code) as n from c where severity is not null) where k = 20""")
def nth_occurrence(c):
    return logs.nth_occurrence(c, 20)


MENTION_SQL = r"m as (select distinct file, unnest(regexp_extract_all(line, '\b([A-Za-z0-9_./\-]+\.(?:tcl|sdc|lef|def|vhd|sv|vh|v|lib|rpt|log|md|conf|yaml|yml|json|py|cpp|c|hpp|h|csh|sh))\b', 1)) as token, line_no from log)"


@index_query("select file, token, count(*)::bigint as n, min(line_no) as first_line from m group by all", f"{CLASSED}, {MENTION_SQL}")
def mentions(ix):
    return ix.mention_counts()


@query("select file, token, line_no from m where contains(token, 'mod3')", f"{CLASSED}, {MENTION_SQL}")
def find_mentions_substring(c):
    return logs.mentions(c).where(F.col("token").contains("mod3"))


@query(f"select file, {SEVERE}, count(distinct case when severity is not null then code end)::bigint as n_codes, min(ts_s) as first_ts, max(ts_s) as last_ts from c where line_no between 99 and 499 group by file")
def region_summary(c):
    return logs.region(c, 100, 500)


@query("""select ts_s, file, line_no, line[:180] as line from c, (select max(ts_s) as anchor from c where file = 'app_1.log' and line_no = 100)
where ts_s between anchor - 3600 and anchor + 3600 order by ts_s, file, line_no limit 200""")
def correlate(c):
    return logs.correlate(c, c.where("file = 'app_1.log' and line_no = 100").agg(F.max("ts_s").alias("anchor")), 3600)


@query("""select file, line_no, coalesce(case when hl > ll then lt + floor((ht - lt) * (line_no - ll) / (hl - ll))::bigint end, lt, ht) as t from (
    select file, line_no, last_value(k ignore nulls) over w as lt, last_value(l ignore nulls) over w as ll, first_value(k ignore nulls) over v as ht, first_value(l ignore nulls) over v as hl
    from (select *, case when line_no % 10 = 3 then ts_s end as k, case when line_no % 10 = 3 then line_no end as l from c)
    window w as (partition by file order by line_no rows between unbounded preceding and current row), v as (partition by file order by line_no rows between current row and unbounded following))""")
def time_interpolate(c):
    return logs.interpolated(c.withColumn("ts_s", F.when(F.col("line_no") % 10 == 3, F.col("ts_s"))))


@query(f"select file, line_no, {message('line')} as template from log")
def template_normalise(c):
    return c.select("file", "line_no", template(F.col("line")).alias("template"))


@query("select id, path, line_no, case when total is null then 'file not found' when line_no < 1 or line_no > total then 'line out of range' else 'ok' end as reason from (select distinct file || '#' || line_no as id, case when line_no % 3 = 0 then 'gone.log' else file end as path, line_no * 2 as line_no from log) x left join (select file, count(*) as total from log group by file) t on t.file = x.path")
def cite_check(c):
    told = F.concat(F.lit("see "), F.when(F.col("line_no") % 3 == 0, "gone.log").otherwise(F.col("file")), F.when(F.col("line_no") % 2 == 0, ":").otherwise(" on line "), (F.col("line_no") * 2).cast("string"), F.lit(" for more"))
    said = c.select(F.concat_ws("#", "file", F.col("line_no").cast("string")).alias("id"), told.alias("text"))
    return answers.checked(answers.citations(said), c.groupBy("file").agg(F.count("*").alias("total")))


@query("select file as id, severity, claimed, claimed = case severity when 'fatal' then f when 'error' then e else w end as holds from (select file, count_if(severity = 'fatal') as f, count_if(severity = 'error') as e, count_if(severity = 'warn') as w from c group by file), lateral (values ('fatal', f::bigint), ('error', (e + 1)::bigint), ('warn', w::bigint)) as x(severity, claimed)")
def numeric_claims(c):
    n = logs.census(c)
    said = n.select(F.col("file").alias("id"), F.concat_ws(" ", F.lit("There are"), F.col("n_fatal").cast("string"), F.lit("FATAL and"), (F.col("n_error") + 1).cast("string"), F.lit("ERROR and"), F.col("n_warn").cast("string"), F.lit("warning in all.")).alias("text"))
    true = n.select(F.col("file").alias("id"), F.posexplode(F.array("n_fatal", "n_error", "n_warn")).alias("k", "n")).withColumn("severity", F.element_at(F.array(*map(F.lit, ("fatal", "error", "warn"))), F.col("k") + 1))
    return answers.numeric_claims(said).join(true, ["id", "severity"]).select("id", "severity", "claimed", (F.col("claimed") == F.col("n")).alias("holds"))


@table_query("select event_id, json_extract_string(props, '$.k') as k from events where json_extract_string(props, '$.k') in ('1', '2', '3')")
def json_field_filter(spark, read):
    x = json_records(read("events").withColumnRenamed("props", "line"))
    return x.select("event_id", F.col("m")["k"].alias("k")).where(F.col("k").isin("1", "2", "3"))


@table_query("select doc_id, (i - 1)::bigint as line_no, l[i] as line from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, chr(10)) as l from documents))")
def doc_lines(spark, read):
    return read("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


TOKENS = "t as (select doc_id as id, regexp_extract_all(lower(text), '[a-z0-9_]+') as t from documents)"
BM25 = f"""{TOKENS}, p as (select id, len, token, count(*) as tf from (select id, len(t) as len, unnest(t) as token from t) group by all),
q as (select qid, token, count(*) as qf from (select item_id as qid, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as token from benchmark where item_id % 20 = 0) where length(token) > 1 group by all),
s as (
    select qid, p.id, sum(qf * ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * len / a))) as score
    from p join q using (token) join (select token, count(*) as df from p group by token) using (token), (select count(*) as n, avg(len(t)) as a from t) group by all
)"""


def _bm25(read):
    docs = read("documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.bm25(docs, read("benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("qid"), "text"))


def _top(df, k, score="score", by="qid"):
    w = Window.partitionBy(by).orderBy(F.desc("r"), "id")
    return df.withColumn("r", F.round(score, 6)).withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).select(by, "id", F.col("r").alias("score"))


@table_query(f"with {TOKENS} select token, count(distinct id)::bigint as df from (select id, unnest(t) as token from t) group by token")
def term_df(spark, read):
    return retrieval.postings(read("documents").select(F.col("doc_id").alias("id"), "text")).groupBy("token").agg(F.count("*").alias("df"))


@table_query(f"with {TOKENS} select id as doc_id, len(t)::bigint as n_tokens from t")
def doc_len(spark, read):
    return read("documents").select("doc_id", F.size(retrieval.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@table_query(f"with {BM25} select qid, id, r as score from (select *, row_number() over (partition by qid order by r desc, id) as k from (select qid, id, round(score, 6) as r from s)) where k <= 5")
def bm25_topk(spark, read):
    return _top(_bm25(read), 5)


COS = """cs as (select q.vec_id as qid, v.vec_id as id, list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))) as cos
from (select vec_id, embedding::double[] as e from embeddings where vec_id % 20 = 0) q, (select vec_id, embedding::double[] as e from embeddings) v)"""


def _cosine(read, k=None):
    """The stated query set, ids divisible by 20, against all vectors."""
    v = read("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.similar(v, v.where("id % 20 = 0").withColumnRenamed("id", "qid"), k)


@table_query(f"with {COS} select qid, id, r as score from (select *, row_number() over (partition by qid order by r desc, id) as k from (select qid, id, round(cos, 6) as r from cs)) where k <= 5")
def cosine_topk(spark, read):
    return _top(_cosine(read, 5), 5, "cos")


@table_query(f"""with {BM25}, {COS}, j as (select coalesce(s.qid, cs.qid) as qid, coalesce(s.id, cs.id) as id, coalesce(score, 0) as b, coalesce(cos, 0) as c from s full join cs on cs.qid = s.qid and cs.id = s.id),
h as (select qid, id, 0.5e0 * case when max(b) over w > min(b) over w then (b - min(b) over w) / (max(b) over w - min(b) over w) else 0 end
 + 0.5e0 * case when max(c) over w > min(c) over w then (c - min(c) over w) / (max(c) over w - min(c) over w) else 0 end as score from j window w as (partition by qid))
select qid, id, r as score from (select *, row_number() over (partition by qid order by r desc, id) as k from (select qid, id, round(score, 6) as r from h)) where k <= 5""")
def hybrid_rank(spark, read):
    docs, v = read("documents").select(F.col("doc_id").alias("id"), "text"), read("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = read("benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("qid"), "text")
    return _top(retrieval.hybrid(docs, asked, v, v.where("id % 20 = 0").withColumnRenamed("id", "qid"), 5), 5)


FACTS = "(0, 'expected', 'sub', 'THE'), (0, 'expected', 'regex', '[a-z]+ing'), (1, 'expected', 'sub', 'and'), (1, 'forbidden', 'sub', 'scum'), (2, 'forbidden', 'regex', '[0-9]{3}')"
SCORES = f"""facts(case_id, kind, op, pattern) as (values {FACTS}),
sc as (select id, count_if(kind = 'expected' and met)::bigint as hits, count_if(kind = 'expected' and not met)::bigint as misses, count_if(kind = 'forbidden' and met)::bigint as forbidden from (
 select conv_id || '/' || turn as id, kind, case when op = 'regex' then regexp_matches(text, pattern) else contains(lower(text), lower(pattern)) end as met
 from conversations join facts on case_id = conv_id % 3 where role = 'assistant') group by id)"""


def _scores(spark, read):
    said = read("conversations").where("role = 'assistant'").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), (F.col("conv_id") % 3).alias("case_id"), "text")
    facts = spark.sql(f"select * from values {FACTS} as t(case_id, kind, op, pattern)")
    return answers.case_scores(said, F.broadcast(facts))


@table_query(f"with {SCORES} select *, misses = 0 and forbidden = 0 as passed from sc")
def eval_score(spark, read):
    return _scores(spark, read)


@table_query(f"with {SCORES} select count(*)::bigint as cases, round(avg((misses = 0 and forbidden = 0)::double), 6) as pass_rate, round(sum(hits) / sum(hits + misses), 6)::double as recall, round(avg((forbidden > 0)::double), 6) as hallucination_rate from sc")
def eval_summary(spark, read):
    return answers.summary(_scores(spark, read))


@table_query("select conv_id, count(*)::bigint as turns, arg_max(text, turn) as last_question from conversations where role = 'user' group by conv_id")
def session_manifest(spark, read):
    return answers.sessions(read("conversations"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What failed, how often, where first."""
    return QUERIES["code_table"](spark, sf_dir)
