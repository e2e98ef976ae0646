"""Queries over passages: documents as texts with marked headings, a stored index of their chunks, and a log whose messages are looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions.profiles import EDA
from tracequarry.operators import passages, retrieval
from tracequarry.operators.passages import PassageIndex
from tracequarry.plans.eventlog import built
from tracequarry.plans.registry import ORACLES, QUERIES, message, table_query
from tracequarry.sources.logs import classified
from tracequarry.sources.store import workspace


def headed(docs: DataFrame) -> DataFrame:
    """source, text of the documents: each fifth line is a heading, of levels 1 to 3 in turn."""
    mark = lambda x, i: F.when(i % 5 == 0, F.concat(F.repeat(F.lit("#"), (F.floor(i / 5) % 3 + 1).cast("int")), F.lit(" "), x)).otherwise(x)
    return docs.select(F.col("doc_id").cast("string").alias("source"), F.array_join(F.transform(F.split("text", "\n", -1), mark), "\n").alias("text"))


def paged(docs: DataFrame) -> DataFrame:
    """source, text of the documents as pages of 7 lines; each ninth line has a heading's looks."""
    looks = lambda i: F.element_at(F.array(*map(F.lit, ("Design Setup", "2 Placing", "ABC-12 message"))), (F.floor(i / 9) % 3 + 1).cast("int"))
    line = lambda x, i: F.when(i % 9 == 4, looks(i)).otherwise(F.concat(F.when(i % 7 == 6, "\f").otherwise(""), x))
    return docs.select(F.col("doc_id").cast("string").alias("source"), F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("text"))


def manual_index(spark: SparkSession, sf_dir: str) -> PassageIndex:
    """The index of the documents' chunks."""

    def build() -> PassageIndex:
        found = passages.chunks(passages.text_lines_of(headed(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
        return PassageIndex(spark, workspace(spark, "passages")).build(found)

    return built(spark, "passages", sf_dir, "documents", build)


def manual_query(sql: str):
    """Registers a function of (index, read); sql follows CHUNKED."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(manual_index(spark, sf_dir), lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        ORACLES[f.__name__] = f"{CHUNKED} {sql}"
        return f

    return add


LINES_SQL = r"regexp_replace(coalesce(text, ''), '\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g')"
CUTS = r"""
h as (
    select *, sum((level > 0)::int) over w as sec,
           max(case when level = 1 then n end) over w as n1, max(case when level = 2 then n end) over w as n2, max(case when level = 3 then n end) over w as n3
    from lv window w as (partition by source order by n)
),
body as (select *, sum(length(line)) over (partition by source, sec order by n) - length(line) as p, row_number() over (partition by source, sec order by n) as i from h where level = 0),
nx as (select *, max(i) over (partition by source, sec order by p range between unbounded preceding and 1200 following) + 1 as nxt from body),
cuts(source, sec, i) as (select source, sec, i from nx where i = 1 union all select nx.source, nx.sec, nx.nxt from cuts join nx using (source, sec, i)),
named as (
    select b.source, b.sec, b.i, b.n, b.line, b.page, max(case when c.i is not null then b.i end) over (partition by b.source, b.sec order by b.i) as cut,
           array_to_string(list_filter([t1.title, case when n2 > coalesce(n1, 0) then t2.title end, case when n3 > greatest(coalesce(n1, 0), coalesce(n2, 0)) then t3.title end], lambda x: x is not null and trim(x) <> ''), ' > ') as crumb
    from body b left join cuts c using (source, sec, i)
    left join lv t1 on t1.source = b.source and t1.n = n1 left join lv t2 on t2.source = b.source and t2.n = n2 left join lv t3 on t3.source = b.source and t3.n = n3
),
ch as (
    select * from (
        select source, coalesce(nullif(any_value(crumb), ''), '(no heading)') as heading, regexp_replace(string_agg(line, chr(10) order by i), '^\s+|\s+$', '', 'g') as text, min(n)::bigint as start_line, arg_min(page, i)::bigint as page
        from named group by source, sec, cut
    ) where text <> ''
)"""
CHUNKED = rf"""with recursive md as (
    select source, unnest(l) as raw, generate_subscripts(l, 1) as n from (
        select source, string_split({LINES_SQL}, chr(10)) as l from (
            select doc_id::varchar as source, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: case when (i - 1) % 5 = 0 then repeat('#', 1 + ((i - 1) // 5)::int % 3) || ' ' || x else x end), chr(10)) as text from documents))
),
lv as (select source, n, raw as line, least(3, length(regexp_extract(raw, '^(#{{1,6}})\s+', 1))) as level, trim(regexp_extract(raw, '^#{{1,6}}\s+(.*)', 1)) as title, null::bigint as page from md), {CUTS},
ix as (select *, row_number() over (order by source, start_line) - 1 as id, regexp_extract_all(lower(case when heading = '(no heading)' then '' else heading end || ' ' || text), '[a-z0-9_]+') as t from ch),
p as (select id, len(t) as len, unnest(t) as token from ix), pt as (select id, len, token, count(*) as tf from p group by all),
st as (select count(*) as n, avg(len(t)) as a from ix), df as (select token, count(*) as df from pt group by token)"""
PAGED = rf"""with recursive md as (
    select source, unnest(l) as raw, generate_subscripts(l, 1) as n from (
        select doc_id::varchar as source, string_split(array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
            case when (i - 1) % 9 = 4 then ['Design Setup', '2 Placing', 'ABC-12 message'][1 + ((i - 1) // 9)::int % 3] else case when (i - 1) % 7 = 6 then chr(12) else '' end || x end), chr(10)), chr(10)) as l from documents)
),
fed as (select *, length(raw) - length(replace(raw, chr(12), '')) as feeds, replace(raw, chr(12), '') as line from md),
lk as (select *, 1 + sum(feeds) over (partition by source order by n) as page, trim(line, chr(9) || chr(10) || chr(11) || chr(13) || ' ') as s, length(regexp_replace(line, '[^\p{{L}}]', '', 'g')) as letters, length(regexp_replace(line, '[^0-9]', '', 'g')) as digits from fed),
lv as (
    select source, n, line, page, s as title, case when s = '' or length(s) > {retrieval.HEADING_CHARS} then 0 when regexp_matches(s, '{retrieval.CODE_HEAD}') then 2
        when regexp_matches(s, '{retrieval.NOT_HEAD}') or regexp_matches(s, '{retrieval.NUMBERS_LAST}') or regexp_matches(s, '{retrieval.DECIMAL}') or letters < 4 or digits > letters // 2 then 0
        when regexp_matches(s, '{retrieval.NUMBERED}') then 1 when regexp_matches(s, '{retrieval.TITLE}') then 2 else 0 end as level
    from lk where not (feeds > 0 and trim(line) = '')
), {CUTS}"""


def searched(asked: str, k: int) -> str:
    """SQL for the best k of the queries in `asked` (qid, v, text), by question."""
    return f"""
qw as (select qid, v, token, count(*) as qf from (select qid, v, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as token from {asked}) where length(token) > 1 group by all),
sv as (
    select qid, v, id, round(sum(qf * ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * len / a))), 6) as score
    from pt join qw using (token) join df using (token), st group by all
),
top as (select qid, id, score, row_number() over (partition by qid order by score desc, id) as rank from (select qid, id, max(score) as score from sv group by all) qualify rank <= {k})"""


@table_query(f"{CHUNKED} select source, heading, text, start_line from ch")
def chunk_documents(spark, read):
    return passages.chunks(passages.text_lines_of(headed(read("documents")))).drop("page")


@table_query(f"{PAGED} select source, heading, text, start_line, page from ch")
def chunk_pages(spark, read):
    return passages.chunks(passages.paged_lines_of(paged(read("documents"))))


@manual_query("select count(*)::bigint as chunks, count(distinct source)::bigint as sources, count_if(heading <> '(no heading)')::bigint as with_heading, round(avg(length(text)), 6) as mean_length from ch")
def index_report(index, read):
    return index.chunks().agg(F.count("*").alias("chunks"), F.countDistinct("source").alias("sources"), F.count_if(F.col("heading") != passages.NO_HEADING).alias("with_heading"), F.round(F.avg(F.length("text")), 6).alias("mean_length"))


@manual_query("select source, count(*)::bigint as n, min(start_line) as first_line, max(start_line) as last_line from ch group by source")
def index_files(index, read):
    return index.chunks().groupBy("source").agg(F.count("*").alias("n"), F.min("start_line").alias("first_line"), F.max("start_line").alias("last_line"))


SAMPLE = 40


@manual_query(f"select source, start_line, heading[:60] as heading from ix, st where id % greatest(1, n // {SAMPLE}) = 0 and id // greatest(1, n // {SAMPLE}) < {SAMPLE}")
def index_sample(index, read):
    """Every so many-th chunk, in the order of sources and lines: chunks are numbered where they lie, so nothing is sorted again."""
    step = F.greatest(F.lit(1), F.expr(f"n div {SAMPLE}"))
    x = index.chunks().crossJoin(F.broadcast(index.stats().select("n")))  # one row
    return x.where((F.col("id") % step == 0) & (F.floor(F.col("id") / step) < SAMPLE)).select("source", "start_line", F.left("heading", F.lit(60)).alias("heading"))


@manual_query(f", a as (select item_id as qid, 0 as v, text from benchmark where item_id % 20 = 0), {searched('a', 5)} select qid, id, score from top")
def passage_topk(index, read):
    return index.search(read("benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("qid"), "text"), 5)


def _log(read) -> DataFrame:
    """Each item of the benchmark as an error with a code of its own, and again as a warning."""
    n, text = F.col("item_id"), F.coalesce("text", F.lit(""))
    line = lambda what: F.concat(F.lit(what), F.lit(" (BM-"), n.cast("string"), F.lit("): 'x1' in /lib/a.v 0x1F failed 3 times: "), text)
    both = F.array(F.struct((n * 2).alias("line_no"), line("**ERROR:").alias("line")), F.struct((n * 2 + 1).alias("line_no"), line("**WARN:").alias("line")))
    return classified(read("benchmark").select(F.lit("a.log").alias("file"), F.explode(both).alias("e")).select("file", "e.*"), EDA)


LOG_SQL = """lg as (select item_id * 2 + k as line_no, case k when 0 then '**ERROR:' else '**WARN:' end || ' (BM-' || item_id || '): ''x1'' in /lib/a.v 0x1F failed 3 times: ' || coalesce(text, '') as line, 'BM-' || item_id as code, item_id from benchmark, range(2) r(k))"""


@manual_query(rf""", {LOG_SQL},
a0 as (select item_id as qid, case item_id // 20 % 3 when 0 then 'what does BM-' || item_id || ' mean' when 1 then text || ' BM-' || item_id || ' E0520' else 'ZZ-999999' end as text, item_id // 20 % 3 as kind from benchmark where item_id % 20 = 0),
a1 as (select qid, kind, case when kind = 0 then (select {message('line')} from lg where lg.item_id = qid and line_no % 2 = 0) else text end as query from a0),
a as (select qid, unnest(list_distinct(list_concat([query], regexp_extract_all(query, '\b([A-Z][A-Z0-9_]+-\d+|[EWIF]\d{{4,}})\b', 1)))) as text, 0 as v0 from a1),
av as (select qid, row_number() over (partition by qid order by text) as v, text from a), {searched('av', 4)},
fl as (select case when n >= 50 then 20e0 else 0e0 end as floor from st)
select qid, rank, source, start_line, null::bigint as page, heading, score, query from top join ix using (id) join a1 using (qid), fl where score >= floor
union all
select qid, 0, null, null, null, null, coalesce((select max(score) from top where top.qid = a1.qid), 0), query from a1, fl where not exists (select 1 from top where top.qid = a1.qid and score >= floor)""")
def search_manual(index, read):
    n = F.col("item_id")
    kind = F.floor(n / 20) % 3
    code = F.concat(F.lit("BM-"), n.cast("string"))
    text = F.when(kind == 0, F.concat(F.lit("what does "), code, F.lit(" mean"))).when(kind == 1, F.concat("text", F.lit(" "), code, F.lit(" E0520"))).otherwise("ZZ-999999")
    asked = read("benchmark").where("item_id % 20 = 0").select(n.alias("qid"), text.alias("text"))
    codes = _log(read).groupBy("code").agg(F.min_by("line", "line_no").alias("line"))
    return passages.search_manual(index, asked, codes)


@manual_query(rf""", {LOG_SQL}, w as (
    select case when item_id // 20 % 4 = 3 then 'NO-1' else 'BM-' || item_id end as code, case item_id // 20 % 4 when 0 then null else item_id // 20 % 4 end as nth, item_id from benchmark where item_id % 20 = 0
), f as (
    select w.code, w.nth, (select count(*) from lg where lg.code = w.code) as n, lg.line_no, trim(lg.line)[:200] as line, {message('(select line from lg x where x.code = w.code order by line_no limit 1)')} as m
    from (select distinct code, nth from w) w left join lg on lg.code = w.code and lg.line_no % 2 + 1 = coalesce(w.nth, 1)
), g as (select *, case when n = 0 then 'no such code' when coalesce(nth, 1) > n then 'out of range' else 'found' end as state, case when m is not null and len(list_filter(string_split(m, ' '), lambda x: x <> '')) >= 3 then m else code end as query from f),
av as (select distinct code as qid, 0 as v, query as text from g), {searched('av', 2)},
fl as (select case when n >= 50 then 20e0 else 0e0 end as floor from st),
told as (select qid as code, count(*)::bigint as passages, string_agg(source || ':' || start_line || ' ' || heading || ' ' || round(score, 3)::decimal(18, 3)::varchar, '; ' order by rank) as places from top join ix using (id), fl where score >= floor group by qid)
select code, nth::bigint as nth, n::bigint as n, line_no::bigint as line_no, line, state, query, coalesce(passages, 0) as passages, coalesce(places, '') as places from g left join told using (code)""")
def code_lookup(index, read):
    n = F.col("item_id")
    kind = F.floor(n / 20) % 4
    wanted = read("benchmark").where("item_id % 20 = 0").select(F.when(kind == 3, "NO-1").otherwise(F.concat(F.lit("BM-"), n.cast("string"))).alias("code"), F.when(kind > 0, kind).alias("nth")).distinct()
    x = passages.code_lookup(index, wanted, _log(read).where("severity is not null"))
    place = lambda p: F.concat(p["source"], F.lit(":"), p["start_line"].cast("string"), F.lit(" "), p["heading"], F.lit(" "), F.round(p["score"], 3).cast("decimal(18,3)").cast("string"))
    return x.withColumns({"places": F.array_join(F.transform("passages", place), "; "), "passages": F.size("passages").cast("long")})


#: A fifth of the events as messages with what a log's messages can hold.
ODD = [
    ("'ERR: (AB-12): Met1 in /a/b+c failed ' || {n}", "concat('ERR: (AB-12): Met1 in /a/b+c failed ', {n})"),
    ("'  **note x2y 12.5 \"q' || {n} || '\" it''s'", "concat('  **note x2y 12.5 \"q', {n}, '\" it\\'s')"),
    ("'(  AB_C-9 ) : 0xFFg 0x1f v1.2.' || {n}", "concat('(  AB_C-9 ) : 0xFFg 0x1f v1.2.', {n})"),
    ("'WARNING:: ''' || repeat('w', ({n} % 120)::int) || ''' - end.'", "concat('WARNING:: \\'', repeat('w', cast({n} % 120 as int)), '\\' - end.')"),
    ("'INFO(Z-1):a/b ''''  \"\" ' || {n} || '.'", "concat('INFO(Z-1):a/b \\'\\'  \"\" ', {n}, '.')"),
]


@table_query(f"select event_id, {message('line')} as template from (select event_id, case event_id % 5 {' '.join(f'when {k} then {sql.format(n='event_id')}' for k, (sql, _) in enumerate(ODD))} end as line from events)")
def template_cases(spark, read):
    from tracequarry.functions.profiles import template

    line = F.expr("case event_id % 5 " + " ".join(f"when {k} then {expr.format(n='event_id')}" for k, (_, expr) in enumerate(ODD)) + " end")
    return read("events").select("event_id", template(line).alias("template"))
