"""Quality rules: a threshold table compiled into Spark projections over built-in functions only.

Nulls and empty texts have no words and are not kept. Repeated rows each get their row, null ids stay null. Other columns travel
in one struct beside the intermediate columns, so none can clash. An empty table gives an empty result.
Repeated windows are found by sorting each text's window hashes, so a very long text costs n log n and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_of

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of the corpus's languages.
STOP_WORDS = sorted(
    set("the of and to in is that it was for on are with as be at by this have from or an not which".split())
    | set("de la le les et des en un une du que est pour dans par sur avec au il elle se qui".split())
    | set("el los las y del se por con para su al lo como no más esta".split())
    | set("der die und das den von zu mit sich auf für ist im dem nicht ein eine als auch es an".split())
)

#: (rule, metric, comparison that must hold, threshold). Ratios of an empty whole are 0.
RULES: list[tuple[str, str, str, float]] = [
    ("few words", "n_words", ">=", 50),
    ("short words", "mean_word", ">=", 2.0),
    ("long words", "mean_word", "<=", 14.0),
    ("symbols", "symbol_ratio", "<=", 0.05),
    ("stop words", "stop_ratio", ">=", 0.01),
    ("repeated lines", "dup_line_ratio", "<=", 0.5),
    ("repeated windows", "repeat_ratio", "<=", 0.5),
    ("upper case", "upper_ratio", "<=", 0.5),
]
TESTS = {">=": Column.__ge__, "<=": Column.__le__}


def compiled(rules: list[tuple[str, str, str, float]], metrics: dict[str, Column]) -> Column:
    """The conjunction of the table's rules; a metric without a value fails."""
    verdict = F.lit(True)
    for _, metric, test, threshold in rules:
        verdict = verdict & F.coalesce(TESTS[test](metrics[metric], F.lit(threshold)), F.lit(False))
    return verdict


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """_q_row, a struct of the columns of docs, with the columns _q_*: words, windows and the counts the rules use."""
    text = F.col("_q_text")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_q_row"), text_of(f"`{text_col}`").alias("_q_text"))
    rows = rows.withColumns({"_q_words": F.array_remove(F.split(text, BLANK), ""), "_q_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    words = F.col("_q_words")
    n = F.size(words)
    gram = lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("i"))
    rows = rows.withColumn("_q_sorted", F.when(n >= 3, F.array_sort(F.transform(F.sequence(F.lit(0), n - 3), gram))))
    found = F.col("_q_sorted")
    twice = F.flatten(F.filter(F.zip_with(found, F.slice(found, 2, F.size(found)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull()))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2))))
    return rows.withColumns(
        {
            "_q_n_words": n.cast("long"),
            "_q_word_chars": F.length(F.array_join(words, "")).cast("long"),
            "_q_n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
            "_q_n_upper": (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long"),
            "_q_n_lines": F.size("_q_lines").cast("long"),
            "_q_n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "_q_n_stop": F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
            "_q_n_repeat": F.when(n >= 3, F.size(covered)).otherwise(F.lit(0)).cast("long"),
        }
    )


def metrics() -> dict[str, Column]:
    c = lambda name: F.col(f"_q_{name}")
    return {
        "n_words": c("n_words"),
        "mean_word": ratio(c("word_chars"), c("n_words")),
        "symbol_ratio": ratio(c("n_symbols"), c("word_chars")),
        "stop_ratio": ratio(c("n_stop"), c("n_words")),
        "dup_line_ratio": ratio(c("n_dup_lines"), c("n_lines")),
        "repeat_ratio": ratio(c("n_repeat"), c("n_words")),
        "upper_ratio": ratio(c("n_upper"), c("word_chars")),
    }


def base_failed() -> Column:
    return (F.col("_q_n_words") < 50) | (F.col("_q_n_repeat") * 100 > F.col("_q_n_words") * 50)


def verdict(rules: list[tuple[str, str, str, float]]) -> Column:
    """Whether a row passes. As it isn't deterministic, a filter on it stays above the projections; below, it would repeat them per word."""
    return ~base_failed() & compiled(rules, metrics()) & (F.monotonically_increasing_id() >= 0)


def apply_rules(docs: DataFrame, rules: list[tuple[str, str, str, float]] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, kept of each row."""
    rows = measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return rows.select(
        "_q_row.doc_id",
        *(F.col(f"_q_{name}").alias(out) for name, out in (("n_words", "n_words"), ("word_chars", "word_chars"), ("n_symbols", "n_symbols"), ("n_dup_lines", "n_dup_lines"), ("n_repeat", "n_repeat_words"))),
        base_failed().alias("base_failed"),
        verdict(rules).alias("kept"),
    )


def kept_only(docs: DataFrame, rules: list[tuple[str, str, str, float]] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, with their columns."""
    return measured(docs, text_col).withColumn("_q_kept", verdict(rules)).where("_q_kept").select("_q_row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read(spark, sf_dir, "documents"))


def _sql() -> str:
    blank = r"\x20\x09-\x0D"
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
with t as (
    select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^{blank}]+') as w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{blank}]')) as l
    from documents
), g as (
    select doc_id, i, count(*) over (partition by doc_id, a, b, c) as k
    from (select doc_id, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from t))
), r as (
    select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from g where k > 1) group by doc_id
), m as (
    select t.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
           (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
           (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words, len(l) as lines,
           length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as upper,
           len(list_filter(w, lambda x: lower(x) in ({stops}))) as stops
    from t left join r on r.doc_id = t.doc_id
), b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and word_chars >= 2e0 * n_words and word_chars <= 14e0 * n_words and n_symbols <= 0.05e0 * word_chars
       and stops >= 0.01e0 * n_words and n_dup_lines <= 0.5e0 * lines and upper <= 0.5e0 * word_chars as kept
from b
"""


ORACLE = _sql()
