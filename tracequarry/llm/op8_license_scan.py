r"""License scan: an exact set-similarity join of text blocks (windows of words) with license templates by containment.

Tokens of the templates are ordered by their frequency in the whole corpus, rarest first. A template of n tokens that needs an overlap
of o can only match a block with one of its first n - o + 1 tokens (prefix filter), with o tokens of the vocabulary (length filter), and
with enough tokens after the first shared one on either side (positional filter); what remains is verified. The template table is small
and fixed, so the join needs no shuffle: each block is probed against it where it lies, with built-in functions only.

Blocks are windows of twice the longest template's words, each begun by that template's length after the one before, whatever the lines:
what is no longer than the longest template is whole in a window, wrapped or not, and no block is so long that a template's words meet in it
by chance.

Nulls and empty texts have no words and no labels. Repeated rows each get their row, null ids stay null, only the id and the text are
read, an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, in texts that are not lower-cased yet; a word is one or more other characters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_BEFORE, WORD_AFTER = r"(?<![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])", r"(?![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: License statements and their labels.
TEMPLATES: list[tuple[str, str]] = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0", "subject to the terms of the mozilla public license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "dedicated to the public domain under cc0"),
]
THRESHOLD = 0.9
#: Words of the longest template: from window to window; a window has twice as many.
STEP = max(len(t.split()) for _, t in TEMPLATES)


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def vocabulary() -> list[str]:
    return sorted({w for _, t in TEMPLATES for w in t.split()})


def corpus_order(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The templates' tokens by their count over all texts, rarest first; as many rows reach the driver as the table has tokens."""
    vocab = vocabulary()
    pattern = f"(?i){WORD_BEFORE}({'|'.join(sorted(vocab, key=lambda w: (-len(w), w)))}){WORD_AFTER}"
    found = docs.select(F.explode(F.regexp_extract_all(text_of(text_col), F.lit(pattern), F.lit(1))).alias("w"))
    counts = {r["w"]: r["n"] for r in found.select(lowered(F.col("w")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(vocab, key=lambda w: (counts.get(w, 0), w))


def needed(n: int, threshold: float) -> int:
    return next(o for o in range(n + 1) if o >= threshold * n - 1e-9)


def containment(block: Column, order: list[str], template: list[str], threshold: float) -> Column:
    """Of a block (its vocabulary tokens in corpus order): the template's share in it if it reaches the threshold, else 0."""
    tokens = sorted(set(template), key=order.index)
    n, o = len(tokens), needed(len(set(template)), threshold)
    whole, prefix = F.array(*map(F.lit, tokens)), F.array(*map(F.lit, tokens[: n - o + 1]))
    first = F.element_at(F.array_intersect(prefix, block), 1)
    room = F.least(F.lit(n) - F.array_position(whole, first), F.size(block) - F.array_position(block, first)) + 1
    shared = F.size(F.array_intersect(whole, block))
    return F.when((F.size(block) >= o) & F.arrays_overlap(prefix, block), F.when(room >= o, F.when(shared >= o, shared / F.lit(float(n))))).otherwise(F.lit(None))


def best(blocks: Column, order: list[str], template: list[str], threshold: float) -> Column:
    return F.array_max(F.transform(blocks, lambda b: containment(b, order, template, threshold)))


def places(words: Column, phrase: str) -> Column:
    """The starts at which the phrase's words stand consecutively."""
    parts = phrase.split()
    here = lambda i: reduce(Column.__and__, [F.coalesce(F.get(words, i + k), F.lit("")) == p for k, p in enumerate(parts)])
    return F.when(F.size(words) >= len(parts), F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row."""
    order = corpus_order(docs, text_col)
    prefixes = sorted({w for _, t in TEMPLATES for w in sorted(set(t.split()), key=order.index)[: len(set(t.split())) - needed(len(set(t.split())), threshold) + 1]})
    hint = f"(?i){WORD_BEFORE}({'|'.join(prefixes)}){WORD_AFTER}"
    phrase = "(?i)(" + "|".join(GAP.join(p.split()) for p in PHRASES) + ")"
    text = F.col("_l_text")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_l_text"))
    rows = rows.select(
        "doc_id",
        F.size(words_of(text)).cast("long").alias("n_words"),
        F.when(text.rlike(phrase), words_of(lowered(text))).otherwise(F.array().cast("array<string>")).alias("_l_words"),
        F.when(text.rlike(hint), words_of(lowered(text))).otherwise(F.array().cast("array<string>")).alias("_l_all"),
    )
    vocab = F.array(*map(F.lit, order))
    at = F.sequence(F.lit(1), F.greatest(F.size("_l_all"), F.lit(1)), F.lit(STEP))
    blocks = F.transform(at, lambda i: F.slice("_l_all", i, 2 * STEP))
    least = min(needed(len(set(t.split())), threshold) for _, t in TEMPLATES)
    rows = rows.withColumn("_l_blocks", F.filter(F.transform(blocks, lambda x: F.array_intersect(vocab, x)), lambda x: F.size(x) >= least))
    rows = rows.withColumns({f"_l_p{k}": places(F.col("_l_words"), p) for k, p in enumerate(PHRASES)} | {f"_l_t{k}": best(F.col("_l_blocks"), order, t.split(), threshold) for k, (_, t) in enumerate(TEMPLATES)})
    starts = F.flatten(F.array(*(F.col(f"_l_p{k}") for k in range(len(PHRASES)))))
    base = [F.when(F.size(f"_l_p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]
    more = [F.when(F.col(f"_l_t{k}").isNotNull(), F.lit(label)) for k, (label, _) in enumerate(TEMPLATES)]
    named = lambda parts: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*parts)))), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        named(base).alias("base_labels"),
        named(base + more).alias("labels"),
        F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(F.coalesce(F.greatest(*(F.col(f"_l_t{k}") for k in range(len(TEMPLATES)))), F.lit(0.0))).alias("score"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _sql() -> str:
    gap = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
    hit = " union all ".join(
        f"select doc_id, i, '{label}' as label from p where " + " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) for p, label in PHRASES.items()
    )
    tokens = ", ".join(f"({k}, '{label}', [{', '.join(repr(w) for w in sorted(set(t.split())))}])" for k, (label, t) in enumerate(TEMPLATES))
    return f"""
with t as (
    select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as text, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{gap}]+') as w from documents
), p as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from t), h as ({hit}),
b as (
    select doc_id, count(*) as n, min(i) - 1 as a, max(i) - 1 as z, string_agg(distinct label, ',' order by label) as labels from h group by doc_id
), templates(k, label, tokens) as (values {tokens}),
lines as (select doc_id, w[i : i + {2 * STEP - 1}] as words from (select doc_id, w, unnest(range(1, len(w) + 1, {STEP})) as i from t)),
c as (
    select doc_id, label, len(list_intersect(tokens, words)) / len(tokens) as share from lines, templates
    where len(list_intersect(tokens, words)) >= ceil({THRESHOLD}e0 * len(tokens) - 1e-9)
), best as (select doc_id, max(share) as share from c group by doc_id),
every as (
    select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from c union all select doc_id, label from h) group by doc_id
)
select t.doc_id, len(t.w)::bigint as n_words, coalesce(b.n, 0)::bigint as n_base, b.a::bigint as first_word, b.z::bigint as last_word,
       coalesce(b.labels, '') as base_labels, coalesce(every.labels, '') as labels, (case when b.n > 0 then 1e0 else coalesce(best.share, 0e0) end)::double as score
from t left join b using (doc_id) left join best using (doc_id) left join every using (doc_id)
"""


ORACLE = _sql()
