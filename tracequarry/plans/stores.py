"""Queries over stored notes, plans and vectors, folders of JSON files, and the evidence of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequarry.operators import answers, passages
from tracequarry.plans.manual import LOG_SQL, _log, manual_query, searched
from tracequarry.plans.registry import message, table_query
from tracequarry.sources import jsonfiles
from tracequarry.sources.keyed import Notes, Plans, VectorCache
from tracequarry.sources.store import workspace

SAVES = """s as (select event_id % 2 as batch, 'p' || user_id % 3 as project, case when event_id % 37 = 0 then 'bad key' else 'k/' || (event_id * 7 + user_id) % 150 end as key,
    case when event_type = 'view' and event_id % 2 = 1 then null else repeat(event_type || chr(10), (event_id % 9)::int) || event_id end as value, event_id as ord from events),
l as (select batch, project, key, (arg_max(struct_pack(v := value), ord)).v as value, max(ord) as ord from s where key <> 'bad key' group by all),
n0 as (select project, key, value from (select *, row_number() over (partition by project order by ord, key) as k from l where batch = 0) where k <= 100),
d as (select n0.project, n0.key, case when l.key is null then n0.value else l.value end as value, l.key is not null and l.value is null as gone from n0 left join l on l.batch = 1 and l.project = n0.project and l.key = n0.key),
kept as (select project, key, value from d where not gone), room as (select project, 100 - count(*) as room from kept group by project),
new as (select project, key, value from (select *, row_number() over (partition by project order by ord, key) as k from l where batch = 1 and value is not null and (project, key) not in (select (project, key) from n0)) join room using (project) where k <= room)"""


@table_query(f"with {SAVES} select project, key, length(value)::bigint as chars, split_part(value, chr(10), 1)[:80] || case when length(value) > 80 or contains(value, chr(10)) then '...' else '' end as shown from (select * from kept union all select * from new)")
def notes_stored(spark, read):
    """Two batches of saves and deletions of up to 150 keys a project, of which 100 fit."""
    n = F.col("event_id")
    value = F.when((F.col("event_type") == "view") & (n % 2 == 1), None).otherwise(F.concat(F.repeat(F.concat("event_type", F.lit("\n")), (n % 9).cast("int")), n.cast("string")))
    key = F.when(n % 37 == 0, "bad key").otherwise(F.concat(F.lit("k/"), ((n * 7 + F.col("user_id")) % 150).cast("string")))
    saves = read("events").select(n.alias("at"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("project"), key.alias("key"), value.alias("value"))
    notes = Notes(spark, workspace(spark, "notes"))
    notes.save(saves.where("at % 2 = 0"))
    notes.save(saves.where("at % 2 = 1"))
    return notes.listing()


@table_query("""with t as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as idx, count(*) over (partition by conv_id) as n, max((trim(coalesce(text, '')) = '')::int) over (partition by conv_id) as odd from conversations)
select conv_id::varchar as plan, count_if(idx % 3 = 1)::bigint as pending, 0::bigint as in_progress, count_if(idx % 3 = 0)::bigint as done, count_if(idx % 3 = 2)::bigint as skipped, count(*)::bigint as total from t where n <= 20 and odd = 0 group by conv_id""")
def plans_stored(spark, read):
    """Each conversation's turns as tasks of a plan, of which a third gets done and another is skipped."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    plans = Plans(spark, workspace(spark, "plans"))
    plans.create(read("conversations").groupBy(F.col("conv_id").cast("string").alias("plan")).agg(each.alias("tasks")))
    status = F.when(F.col("idx") % 3 == 0, "done").when(F.col("idx") % 3 == 2, "skipped").otherwise("never")
    plans.update(plans.table.read().select("plan", "idx", status.alias("status"), F.lit("seen").alias("result")))
    return plans.counts()


def _letters(missed):
    """How often each letter comes: what stands in for an embedding model, which is a parameter of the cache."""
    low = F.lower("text")
    return missed.select("key", F.array(*(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit(""))) for c in map(chr, range(97, 123)))).cast("array<float>").alias("vector"))


@table_query("select doc_id, sha1('letters' || chr(10) || text)[:16] as key, (length(lower(text)) - length(replace(lower(text), 'e', '')))::bigint as e, (length(lower(text)) - length(regexp_replace(lower(text), '[a-z]', '', 'g')))::bigint as letters from documents where text is not null")
def vectors_cached(spark, read):
    """Half of the documents is computed first; then all are asked for, and only the rest is computed."""
    docs = read("documents").select("doc_id", "text").where("text is not null")
    cache = VectorCache(spark, workspace(spark, "vectors"), "letters")
    cache.vectors(docs.where("doc_id % 2 = 0"), _letters)
    found = cache.vectors(docs, _letters)
    return found.select("doc_id", "key", F.get("vector", F.lit(4)).cast("long").alias("e"), F.aggregate("vector", F.lit(0.0).cast("float"), lambda s, x: s + x).cast("long").alias("letters"))


@manual_query(rf""", {LOG_SQL}, w as (select item_id // 20 % 2 as id, list_distinct(['BM-' || item_id, 'NO-1'])[1] as a, 'BM-' || item_id as code, item_id from benchmark where item_id % 20 = 0),
f as (select w.id, w.code, w.item_id, (select min(line_no) from lg where lg.code = w.code) as line_no, trim((select line from lg where lg.code = w.code order by line_no limit 1))[:200] as line from w),
g as (select *, {message("(select x.line from lg x where x.code = f.code order by line_no limit 1)")} as m from f),
av as (select code as qid, 0 as v, case when len(list_filter(string_split(m, ' '), lambda x: x <> '')) >= 3 then m else code end as text from g), {searched('av', 1)},
fl as (select case when n >= 50 then 20e0 else 0e0 end as floor from st),
b as (select g.id, g.item_id, '- `a.log:' || (g.line_no + 1) || '` → ' || g.line || chr(10) || '  Manual: ' || coalesce('`' || ix.source || ':' || ix.start_line || '` > ' || ix.heading || ' — ' ||
    case when length(trim(replace(ix.text, chr(10), ' '))) > 220 then rtrim(trim(replace(ix.text, chr(10), ' '))[:220]) || '…' else trim(replace(ix.text, chr(10), ' ')) end, 'no entry for ' || g.code) as t
    from g cross join fl left join top on top.qid = g.code and score >= floor left join ix on ix.id = top.id)
select id::bigint as id, string_agg(t, chr(10) order by item_id) as text from b group by id""")
def evidence(index, read):
    items = read("benchmark").where("item_id % 20 = 0").select((F.floor(F.col("item_id") / 20) % 2).cast("long").alias("id"), "item_id")
    code = F.concat(F.lit("bm-"), F.col("item_id").cast("string"))
    codes = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("item_id", code.alias("code")))), lambda x: F.array(x["code"], F.lit("NO-1"))))
    return passages.evidence(index, items.groupBy("id").agg(codes.alias("codes")), _log(read).where("severity is not null"), "a.log")


@table_query("""select conv_id::varchar as id, '2024-01-01' as created, 't' || count(*) as updated, count_if(role = 'user')::bigint as turns, coalesce(arg_max(coalesce(text, '')[:60], turn) filter (where role = 'user'), '') as last_question
from conversations where conv_id % 7 <> 0 group by conv_id""")
def saved_sessions(spark, read):
    """Conversations as session files, a seventh of them broken."""
    history = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    x = read("conversations").groupBy("conv_id").agg(history.alias("history"))
    told = F.to_json(F.struct(F.lit(1).alias("schema"), F.col("conv_id").cast("string").alias("id"), F.lit("2024-01-01").alias("created"), F.concat(F.lit("t"), F.size("history").cast("string")).alias("updated"), "history"), {"pretty": "true"})
    path = workspace(spark, "sessions")
    jsonfiles.write_json_files(x.select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("name"), F.when(F.col("conv_id") % 7 == 0, F.left(told, F.length(told) - 1)).otherwise(told).alias("value")), path)
    return jsonfiles.sessions(spark, f"{path}/name=*", "*.txt").drop("path")


CASE = r'{{"id": "c{n}", "log_path": "a.log", "question": "q", "expected_facts": ["the", {{"any_of": ["zzz", {{"regex": "\\b{n}[0-9]*\\b"}}, {{"all_of": ["a", {{"any_of": ["e", "qq"]}}]}}]}}, {{"regex": "("}}, 7], "forbidden_facts": [{{"regex": "W{n}\\w"}}]}}'


@table_query(r"""select id, hits, 4 - hits as misses, regexp_matches(t, 'w' || k || '\w')::bigint as forbidden, false as passed from (
    select *, contains(t, 'the')::bigint + (contains(t, 'zzz') or regexp_matches(t, '\b' || k || '[0-9]*\b') or (contains(t, 'a') and (contains(t, 'e') or contains(t, 'qq'))))::bigint as hits
    from (select conv_id || '/' || turn as id, conv_id % 4 as k, lower(coalesce(text, '')) as t from conversations where role = 'assistant') where k <> 3)""")
def eval_files(spark, read):
    """Answers scored by cases that are read from files; the file of every fourth case is broken, so its answers have no score."""
    path = workspace(spark, "cases")
    n = (F.col("conv_id") % 4).cast("string")
    text = F.replace(F.lit(CASE.format(n="@")), F.lit("@"), n)
    jsonfiles.write_json_files(read("conversations").select(F.concat(F.lit("c"), n).alias("name"), F.when(n == "3", F.left(text, F.lit(40))).otherwise(text).alias("value")).distinct(), path)
    corpus = jsonfiles.case_facts(jsonfiles.cases(spark, f"{path}/name=*", names="*.txt"))
    said = read("conversations").where("role = 'assistant'").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.concat(F.lit("c"), n).alias("case_id"), "text")
    return answers.nested_scores(said, corpus)
