"""Queries whose input holds the odd cases that rules are about; their SQL states what must come out, apart from the code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.functions.profiles import EDA, GENERIC
from tracequarry.operators import answers, contract, logs, readlog, records, sampling, scan
from tracequarry.operators.logindex import LogIndex
from tracequarry.plans.eventlog import event_index
from tracequarry.plans.registry import CLASSED, MENTION_SQL, ORACLES, QUERIES, STAGED, TRIAGE, index_query, query, table_query
from tracequarry.sources.logs import classified

#: Records of an event, by its id; {n} stands for the id, {w} for a long word.
RECORDS = (
    '{"level": {"a": 1}, "severity": "ERR", "msg": "m{n}"}',
    ' {"level": 3, "message": "x", "msg": 5}',
    '{"level": 3.5, "lvl": "warning ", "text": null, "event": "e"}',
    '{"ts": 1, "level": "info", "severity": "fatal", "a": "it\'s {n}", "b": 2, "c": null, "d": true, "e": [1], "f": 1.5, "g": {"h": 1}}',
    'no record {n}',
    '{"level": null, "severity": true, "lvl": "fatal", "text": 5, "event": "boot {n}"}',
    '{"log.level": "PANIC", "a": "{w}", "b": "{w}", "c": "{w}", "d": {n}}',
    '[1, {n}]',
    '{"level": "4", "q": "a \\"b\\" \'c\'", "p": "x\\\\y\\nz"}',
    '{"level": "Emergency", "z": false, "msg": {"a": 1}, "message": ""}',
    '{broken {n}',
)


def _records(events):
    pick = F.element_at(F.array(*map(F.lit, RECORDS)), (F.col("event_id") % len(RECORDS) + 1).cast("int"))
    line = F.replace(F.replace(pick, F.lit("{n}"), F.col("event_id").cast("string")), F.lit("{w}"), F.lit("w" * 70))
    return records.typed(events.select("event_id", line.alias("line")))


SEVERITY_SQL = f"case event_id % {len(RECORDS)} when 0 then 'error' when 1 then 'error' when 2 then 'warn' when 6 then 'fatal' when 8 then 'warn' when 9 then 'fatal' else '' end"


@table_query(f"select {SEVERITY_SQL} as severity, count(*)::bigint as n from events where event_id % {len(RECORDS)} not in (4, 7, 10) group by all")
def json_severity(spark, read):
    return _records(read("events")).groupBy(records.severity(F.col("o")).alias("severity")).agg(F.count("*").alias("n"))


@table_query(f"""select event_id, case event_id % {len(RECORDS)} when 0 then 'm' || event_id when 1 then 'x' when 2 then 'e' when 3 then 'a="it''s ' || event_id || '" b=2 c=None d=True f=1.5' when 5 then 'boot ' || event_id
when 6 then 'log.level=''PANIC'' a=''' || repeat('w', 57) || ' b=''' || repeat('w', 57) || ' c=''' || repeat('w', 57) when 8 then 'q=''a "b" \\''c\\'''' p=''x\\\\y\\nz''' when 9 then '' end as message
from events where event_id % {len(RECORDS)} not in (4, 7, 10)""")
def json_message(spark, read):
    return _records(read("events")).select("event_id", records.message(F.col("o")).alias("message"))


HITS = r"""select file, 'generic' as active, case when regexp_matches(head, '--- (Starting|Ending) "|\([A-Z][A-Z0-9]+-\d+\)|(?i)\b(innovus|primetime|genus|nanoroute|encounter)\b') then 'eda' else 'generic' end as detected,
 len(regexp_extract_all(head, '(?i)\b(FATAL|CRITICAL|CRIT|EMERG(ENCY)?|PANIC|ABORT|core dumped|Segmentation fault)\b|Traceback \(most recent call last\)|\[FATAL\]|\[CRITICAL\]|^<[0-2]>'))::bigint as active_fatal,
 len(regexp_extract_all(head, '(?i)\b(ERROR|ERR|SEVERE|EXCEPTION|FAIL(ED|URE)?)\b|\[ERROR\]|\bE\d{4}\b|^<3>'))::bigint as active_error, len(regexp_extract_all(head, '(?i)\b(WARN(ING)?)\b|\[WARN(ING)?\]|\bW\d{4}\b|^<4>'))::bigint as active_warn,
 len(regexp_extract_all(head, '(?i)\b(FATAL|PANIC|ABORT|core dumped|Segmentation fault)\b'))::bigint as detected_fatal, len(regexp_extract_all(head, '(?i)\b(ERROR|ERR|FAIL(ED|URE)?)\b'))::bigint as detected_error,
 len(regexp_extract_all(head, '(?i)\b(WARN(ING)?)\b'))::bigint as detected_warn
from (select file, (string_agg(line, chr(10) order by line_no) || chr(10))[:8192] as head from log where line_no < 8192 group by file)"""


@query(HITS)
def profile_report(c):
    """Each log's first 8 KB under the generic profile: what it looks like, and how often each vocabulary occurs in it."""
    return logs.profile_hits(c, GENERIC)


CLOCKS = "k as (select user_id % 4 as file, event_id as line_no, event_type, 'k' || user_id % 97 as clock, case event_type when 'signup' then event_id % 5 end as made from events)"


@table_query(f"""with {CLOCKS}, d as (select file, clock, min(line_no) as declared from (select file, line_no, case when made = 2 then 'other' else clock end as clock from k where made < 3) group by all),
u as (select file, clock, line_no from k where event_type = 'click' union all select file, unnest([clock, 'other']), line_no from k where made = 3)
select file, clock, u.line_no, declared from u left join d using (file, clock) where declared is null or declared > u.line_no""")
def constraint_lint(spark, read):
    clock, n = F.concat(F.lit("k"), (F.col("user_id") % 97).cast("string")), F.col("event_id") % 5
    signup, text = F.col("event_type") == "signup", lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    line = (
        F.when(signup & (n == 0), text("create_clock -period 2 -name ", clock, " [get_ports c]"))
        .when(signup & (n == 1), text("  create_clock -period 2 [get_ports  ", clock, " ] -add"))
        .when(signup & (n == 2), text("create_clock [get_ports ", clock, "] -name other"))
        .when(signup & (n == 3), text("set_x [get_clocks ", clock, "] [get_clocks other]"))
        .when(signup, text("# create_clock -name ", clock))
        .when(F.col("event_type") == "click", text("set_false_path -from [get_clocks ", clock, "] # get_clocks none"))
        .otherwise(text("set_x [get_clocks {", clock, " b}] recreate_clock -name z"))
    )
    return answers.clock_issues(read("events").select((F.col("user_id") % 4).alias("file"), F.col("event_id").alias("line_no"), line.alias("line")))


@query("""select 1""")
def time_samples(c):
    """A log in which two of three lines have a time, and every other stretch of 90 lines none."""
    timed = (F.col("line_no") % 3 != 1) & (F.floor(F.col("line_no") / 90) % 2 == 0)
    rare = F.when(F.col("line_no") % 50 == 2, F.col("severity"))
    return sampling.time_samples(c.select("file", "line_no", rare.alias("severity"), F.when(timed, F.col("ts_s")).alias("ts_s")), 12)


ORACLES["time_samples"] = f"""with recursive {CLASSED},
tm as (select file, line_no, ts_s, severity is not null and line_no % 50 = 2 as s from c where line_no % 3 <> 1 and line_no // 90 % 2 = 0),
nx as (
    select file, line_no, least(min(case when s then line_no end) over (partition by file order by line_no rows between 1 following and unbounded following),
                                min(line_no) over (partition by file order by line_no range between 12 following and unbounded following)) as nxt from tm
),
smp(file, line_no) as (select file, min(line_no) from tm group by file union all select nx.file, nx.nxt from smp join nx using (file, line_no) where nx.nxt is not null)
select file, line_no, ts_s from smp join tm using (file, line_no)
union all
select file, total - 1, last_ts from (select file, count(*) as total from c group by file) join (select file, arg_max(ts_s, line_no) as last_ts from tm group by file) using (file)
where (file, total - 1) not in (select (file, line_no) from smp)"""


def _scan(context: int, most: int):
    def run(spark, sf_dir):
        index = event_index(spark, sf_dir)
        file = "app_1.log"
        total = index.totals().where(F.col("file") == file).first()
        lines = index.table("lines").where(F.col("file") == file).select("line_no", "line")
        hit = F.col("line").rlike(r"(?i)mod[0-2]\.py") & EDA.any_severity(F.col("line"), ["error"])
        return scan.early_stop(lines, hit, total.total if total else 0, context, most, 64)

    return run


QUERIES["early_stop"] = _scan(0, 40)
QUERIES["early_stop_context"] = _scan(2, 40)
ORACLES["early_stop"] = rf"""with {CLASSED} select line_no, line, true as is_hit from c where file = 'app_1.log' and regexp_matches(line, '(?i)mod[0-2]\.py') and severity in ('error') order by line_no limit 40"""
#: SQL for the lines that a scan with context chooses: z has all lines with is_hit, near and fwd; `last` where the scan ends.
SCANNED = r"""x as (select line_no, line, regexp_matches(line, '(?i)mod[0-2]\.py') and regexp_matches(line, '(?i)\bERROR\b') as is_hit from c where file = 'app_1.log'),
y as (select *, max(is_hit::int) over (order by line_no rows between 2 preceding and 2 following) as near, max(is_hit::int) over (order by line_no rows between 2 preceding and current row) as tail,
             max(is_hit::int) over (order by line_no rows between 1 preceding and current row) as fwd from x),
z as (select * from y),
ends as (
    select coalesce(min(line_no), 1000000000) as last from (
        select *, (select count(*) from z a where a.near = 1 and a.line_no <= z.line_no and (a.tail = 1 or exists (select 1 from z b where b.is_hit and b.line_no between a.line_no and least(a.line_no + 2, z.line_no)))) as got from z
    ) where got >= {most} and fwd = 0
)"""
ORACLES["early_stop_context"] = f"with {CLASSED}, {SCANNED.format(most=40)} select line_no, line, is_hit from z, ends where near = 1 and line_no <= last"

MODES = {"head": {"head": 30}, "tail": {"tail": 45}, "pattern": {"pattern": r"mod[0-2]\.py", "severity": "error"}, "severity": {"severity": "FATAL/bogus, warning"}, "triage": {"severity": "warning"}}


@index_query("""select mode, line_no, line, n, run_first, gap, clipped from out""", f"""{CLASSED}, {TRIAGE}, {SCANNED.format(most=41)},
own as (select * from c where file = 'app_1.log'),
sel as (
    select 'head' as mode, line_no, line from own where line_no < 30 union all select 'tail', line_no, line from own where line_no >= (select count(*) from own) - 45
    union all select 'pattern', line_no, line from z, ends where near = 1 and line_no <= last
    union all select 'severity', line_no, line from (select *, max((coalesce(severity = 'fatal', false))::int) over (order by line_no rows between 2 preceding and 2 following) as near from own) where near = 1
    union all select 'triage', line_no, line from (
        select *, max(hit::int) over (order by line_no rows between 2 preceding and 2 following) as near from (
            select *, count_if(severity in ('fatal', 'error')) over () as sev, count(*) over () as total, coalesce(severity = 'fatal' or (severity = 'error' or severity = 'fatal') and sum((severity in ('fatal', 'error'))::int) over (order by line_no) <= 13, false) as hit from own))
        where near = 1 or regexp_matches(line, '--- (Starting|Ending) "') or line_no >= total - 10
),
cl as (select *, count(*) over (partition by mode) > 40 as clipped from sel qualify row_number() over (partition by mode order by line_no) <= 40),
rp as (
    select min(line_no) as run_first, count(*)::bigint as n from (select *, sum(brk) over (order by line_no) as run from (select *, case when line is distinct from lag(line) over (order by line_no) then 1 else 0 end as brk from own))
    where trim(line) <> '' group by run having count(*) >= 3
),
jn as (select cl.*, rp.n, rp.run_first, lag(line_no) over (partition by mode order by line_no) as before from cl left join rp on line_no >= run_first and line_no < run_first + n),
out as (select *, before is not null and before <> line_no - 1 as gap from jn where not (run_first is not null and before = line_no - 1 and coalesce(before >= run_first, false)))""")
def read_logs(ix):
    """One log read in each way: precedence, context, clip at 40 lines, runs as one, gaps."""
    part = lambda mode, asked: readlog.read_logs(ix, "app_1.log", 40, **asked).select(F.lit(mode).alias("mode"), "line_no", "line", "n", "run_first", "gap", "clipped")
    return reduce(DataFrame.unionAll, (part(*m) for m in MODES.items()))


@index_query("select total, n_fatal, n_error, n_warn, n_fatal + n_error - (select count(*) from c where file = 'app_1.log' and severity in ('fatal', 'error') and line_no < 30)::bigint as unseen from (select count(*)::bigint as total, count_if(severity = 'fatal')::bigint as n_fatal, count_if(severity = 'error')::bigint as n_error, count_if(severity = 'warn')::bigint as n_warn from c where file = 'app_1.log')")
def read_header(ix):
    return readlog.header(ix, "app_1.log", readlog.read_logs(ix, "app_1.log", 40, head=30))


@index_query("select codes.file, codes.code, codes.severity, n, first_line, trim(line)[:110] as example from codes join c on c.file = codes.file and c.line_no = first_line where codes.severity in ('fatal', 'error')")
def summary_of_severities(ix):
    return readlog.log_summary(ix, "ERROR fatal")


CALLS = [
    ("list_logs", {}),
    ("read_logs", {"path": "app_1.log", "tail": 25}),
    ("read_logs", {"path": "app_1.log", "no_such": 1}),
    ("read_logs", {}),
    ("log_summary", {"severity": "fatal"}),
    ("stage_codes", {"path": "app_2.log"}),
    ("find_mentions", {"token": "mod3"}),
    ("grep", {}),
]


@index_query("""select * from (
    select 0 as call, count(distinct file) as n, null as error from c union all
    select 1, count(*) filter (where not again), null from (select coalesce(line = lag(line) over (order by line_no) and cnt >= 3, false) as again, line_no, total from (
        select *, count(*) over () as total, count(*) over (partition by run) as cnt from (select *, sum(brk) over (order by line_no) as run from (select *, case when line is distinct from lag(line) over (order by line_no) then 1 else 0 end as brk from c where file = 'app_1.log'))))
        where line_no >= total - 25 union all
    select 2, 1, 'running read_logs: TypeError' union all select 3, 1, 'running read_logs: TypeError' union all
    select 4, count(*), null from codes where severity = 'fatal' union all
    select 5, count(*), null from (select distinct stage, code from owned where file = 'app_2.log' and code <> '(uncoded)') union all
    select 6, count(*), null from m where contains(token, 'mod3') union all
    select 7, 1, 'unknown tool ''grep''. Available: list_logs, read_logs, log_summary, incidents, find_mentions, stage_timeline, stage_codes' union all
    select 8, 1, 'tool ''stage_timeline'' requires the ''eda'' profile (active: ''generic'')')""", f"{CLASSED}, {STAGED}, {MENTION_SQL}")
def tool_calls(ix):
    """Calls of tools by name, good ones and bad ones: how many rows each gives, and its error."""
    other = LogIndex(ix.spark, ix.store.path, GENERIC)
    each = [contract.call(ix, *c) for c in CALLS] + [contract.call(other, "stage_timeline")]
    counts = [x.agg(F.count("*").alias("n"), F.max("error" if "error" in x.columns else F.lit(None)).cast("string").alias("error")).select(F.lit(k).alias("call"), "n", "error") for k, x in enumerate(each)]
    return reduce(DataFrame.unionAll, counts)


#: Lines of an application's log, with the severity and code that each has.
GENERIC_LINES = [
    ("FATAL: [FATAL-9001] disk", "fatal", "FATAL-9001"),
    ("E0520 12:00:01.123 lost", "error", "E0520"),
    ("exception (ABC_D-7) raised by XYZ-12", "error", "ABC_D-7"),
    ("svc XYZ-12 failed (ABC-1)", "error", "XYZ-12"),
    ("[CRITICAL] out", "fatal", "(uncoded)"),
    ("Traceback (most recent call last):", "fatal", "(uncoded)"),
    ("<3>kernel oops", "error", "(uncoded)"),
    ("W1234 slow", "warn", "W1234"),
    ("warning XY-1 small", "warn", "(uncoded)"),
    ("all fine XYZ-12", None, None),
    ("an emergency: Warning", "fatal", "(uncoded)"),
]


def _text(value: str | None) -> str:
    return "null" if value is None else f"'{value}'"


@table_query("select event_id, severity, code from events join (values " + ", ".join(f"({k}, {_text(s)}, {_text(c)})" for k, (_, s, c) in enumerate(GENERIC_LINES)) + f") as t(k, severity, code) on k = event_id % {len(GENERIC_LINES)}")
def generic_lines(spark, read):
    line = F.element_at(F.array(*(F.lit(x) for x, *_ in GENERIC_LINES)), (F.col("event_id") % len(GENERIC_LINES) + 1).cast("int"))
    return classified(read("events").select("event_id", line.alias("line")), GENERIC).select("event_id", "severity", "code")


@table_query("""select file, token, count(*)::bigint as n, min(event_id) as first_line from (
    select user_id % 4 as file, event_id, unnest(case event_id % 3 when 0 then ['CMD:scripts/run_' || user_id % 9 || '.tcl', 'scripts/run_' || user_id % 9 || '.tcl'] when 1 then ['lib/a.v', 'top.sdc'] else ['CMD:setup'] end) as token from events) group by all""")
def command_mentions(spark, read):
    """Paths and sourced scripts; a path that a line names twice counts once."""
    n = F.col("event_id") % 3
    line = F.when(n == 0, F.concat(F.lit("<CMD> source scripts/run_"), (F.col("user_id") % 9).cast("string"), F.lit(".tcl"))).when(n == 1, "lib/a.v:3 and lib/a.v need top.sdc, not top.sdcx").otherwise("<CMD>  source setup  # x.so")
    return logs.mention_counts(read("events").select((F.col("user_id") % 4).alias("file"), F.col("event_id").alias("line_no"), line.alias("line")))


@index_query("select file, stage, code, count(*)::bigint as n from owned where code <> '(uncoded)' group by all", f"{CLASSED}, {STAGED}")
def stage_codes(ix):
    return ix.stage_codes()
