"""Log profiles: vocabularies as patterns, compiled to column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII word boundaries; Java's own are Unicode-aware.
B, E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
UNCODED = "(uncoded)"


@dataclass(frozen=True)
class Profile:
    """fatal, error, warn: patterns anywhere in a line, in this priority; code: alternatives whose first non-empty group is the code."""

    name: str
    fatal: str
    error: str
    warn: str
    code: str
    groups: int
    stages: bool
    extensions: tuple[str, ...]

    def severity(self, line: Column) -> Column:
        return F.when(line.rlike(self.fatal), "fatal").when(line.rlike(self.error), "error").when(line.rlike(self.warn), "warn")

    def any_severity(self, line: Column, names: list[str]) -> Column:
        """Whether any of the named severities' patterns occur, whatever the line's own severity."""
        hit = F.lit(False)
        for n in names:
            hit = hit | line.rlike(getattr(self, n))
        return hit

    def code_of(self, line: Column) -> Column:
        found = [F.nullif(F.regexp_extract(line, self.code, g), F.lit("")) for g in range(1, self.groups + 1)]
        return F.coalesce(*found, F.lit(UNCODED))


# The vocabularies that results must agree on.
EDA = Profile(
    name="eda",
    fatal=f"(?i){B}(FATAL|PANIC|ABORT|core dumped|Segmentation fault){E}",
    error=f"(?i){B}(ERROR|ERR|FAIL(ED|URE)?){E}",
    warn=f"(?i){B}(WARN(ING)?){E}",
    code=r"\(([A-Z][A-Z0-9]+-\d+)\)",
    groups=1,
    stages=True,
    extensions=(".log", ".rpt", ".txt", ".out", ""),
)
GENERIC = Profile(
    name="generic",
    fatal=rf"(?i){B}(FATAL|CRITICAL|CRIT|EMERG(ENCY)?|PANIC|ABORT|core dumped|Segmentation fault){E}|Traceback \(most recent call last\)|\[FATAL\]|\[CRITICAL\]|^<[0-2]>",
    error=rf"(?i){B}(ERROR|ERR|SEVERE|EXCEPTION|FAIL(ED|URE)?){E}|\[ERROR\]|{B}E\d{{4}}{E}|^<3>",
    warn=rf"(?i){B}(WARN(ING)?){E}|\[WARN(ING)?\]|{B}W\d{{4}}{E}|^<4>",
    code=rf"\(([A-Z][A-Z0-9_]+-\d+)\)|\[([A-Z][A-Z0-9_]+-\d+)\]|{B}([A-Z][A-Z0-9_]+-\d{{2,}}){E}|{B}([EWIF]\d{{4,}}){E}",
    groups=4,
    stages=False,
    extensions=(".log", ".txt", ".out", ".err", ".json", ".jsonl", ".ndjson", ""),
)
PROFILES = {p.name: p for p in (EDA, GENERIC)}
# Signatures of a profile, file types that count as mentions, banners, times, code shapes, paths that are never opened.
SIGNATURES = (r"--- (Starting|Ending) \"", r"\([A-Z][A-Z0-9]+-\d+\)", rf"(?i){B}(innovus|primetime|genus|nanoroute|encounter){E}")
MENTIONED = "tcl sdc lef def v sv vhd vh lib rpt log md conf yaml yml json py c h cpp hpp sh csh".split()
MENTION = rf"{B}(?=[A-Za-z0-9_])([A-Za-z0-9_./\-]+\.(?:{'|'.join(MENTIONED)}){E})"
SOURCE_COMMAND = r"<CMD>\s+source\s+([A-Za-z0-9_./\-]+)"
STAGE = r'--- (Starting|Ending) "([^"]+)"'
EDA_TIME = r"\[\d{2}:\d{2}:\d{2}\s+(\d+)s\]"
ISO_TIME = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?)"
KLOG_TIME = r"^[EWIF](\d{4}\s+\d{2}:\d{2}:\d{2}\.\d+)"
SLASH_TIME = r"^(\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})"
CODE_SHAPE = rf"{B}([A-Z][A-Z0-9_]+-\d+|[EWIF]\d{{4,}}){E}"
STOPPED = "the and for with from what does mean this that error warning code".split()
SENSITIVE = ".ssh/ id_rsa id_ed25519 .pem .key .pfx .p12 shadow .aws/ .netrc .env credentials secret .gnupg/ .docker/config.json .kube/config .npmrc .pypirc".split()
SEVERITIES = ("fatal", "error", "warn")


def rank(severity: Column) -> Column:
    return F.when(severity == "fatal", 0).when(severity == "error", 1).when(severity == "warn", 2).otherwise(3)


def detected(head: Column) -> Column:
    """The profile's name for the first bytes of a log."""
    hit = F.lit(False)
    for s in SIGNATURES:
        hit = hit | head.rlike(s)
    return F.when(hit, EDA.name).otherwise(GENERIC.name)


def wanted(severity: str) -> list[str]:
    """The known names in a list split at commas, blanks, slashes or bars."""
    import re

    return [s for s in re.split(r"[,\s/|]+", severity.lower()) if s in SEVERITIES]


# What a message loses, in this order, and what stands in its place.
STRIPPED = (
    (r"(?i)^\s*(\*\*)?(FATAL|ERROR|ERR|WARN(ING)?|INFO|NOTE)\s*:?\s*", ""),
    (r"\(\s*[A-Z][A-Z0-9_]+-[0-9]+\s*\)\s*:?\s*", ""),
    (r"\S*/\S+", " "),
    (r"\b0x[0-9a-fA-F]+\b", " "),
    (r"['\"][^'\"]{1,80}['\"]", " "),
    (r"\b[0-9]+(\.[0-9]+)?\b", " "),
)


def template(line: Column) -> Column:
    """A message without severity prefix, code, paths, hex numbers, short quoted text and numbers that are words."""
    x = line
    for pattern, put in STRIPPED:
        x = F.regexp_replace(x, f"(?U){pattern}", put)
    return F.btrim(F.regexp_replace(x, r"(?U)\s+", " "), F.lit(" :.-"))


def eda_seconds(line: Column) -> Column:
    """The seconds of '[HH:MM:SS  Ns]'."""
    return F.regexp_extract(line, EDA_TIME, 1).try_cast("bigint")


def generic_seconds(line: Column, year: int | None = None) -> Column:
    """Seconds since 1970 (UTC) of a leading ISO time; with a year, also of klog times in it, and of slash dates."""
    at = lambda x, form: F.unix_seconds(F.try_to_timestamp(x, F.lit(form)))
    iso = at(F.left(F.translate(F.regexp_extract(line, ISO_TIME, 1), "T", " "), F.lit(19)), "yyyy-MM-dd HH:mm:ss")
    if year is None:
        return iso
    klog = F.regexp_replace(F.split(F.regexp_extract(line, KLOG_TIME, 1), "\\.")[0], r"\s+", " ")
    slash = F.regexp_replace(F.regexp_extract(line, SLASH_TIME, 1), r"\s+", " ")
    return F.coalesce(iso, at(F.when(klog != "", F.concat(F.lit(f"{year:04d}"), klog)), "yyyyMMdd HH:mm:ss"), at(slash, "yyyy/MM/dd HH:mm:ss"))


def codes_like(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CODE_SHAPE), F.lit(1)))


def bare_code(text: Column) -> Column:
    """Whether a question has codes and no other word than common ones."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(text, CODE_SHAPE, " ")), F.lit("[a-z]{3,}"), F.lit(0))
    return (F.size(codes_like(text)) > 0) & (F.size(F.array_except(words, F.array(*map(F.lit, STOPPED)))) == 0)


def sensitive(path: Column) -> Column:
    x = F.lower(F.translate(path, "\\", "/"))
    hit = F.lit(False)
    for part in SENSITIVE:
        hit = hit | x.contains(part)
    return hit


def under(path: Column, root: str) -> Column:
    """Whether a path is the root or inside it."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def truncated(text: Column, budget: int) -> Column:
    """A text over the budget as its first 70 %, a mark, and its last 25 %."""
    head, tail = int(budget * 0.7), int(budget * 0.25)
    cut = (F.length(text) - head - tail).cast("string")
    short = F.concat(F.left(text, F.lit(head)), F.lit("\n\n... [truncated "), cut, F.lit(" chars] ...\n\n"), F.right(text, F.lit(tail)))
    return F.when(F.length(text) <= budget, text).otherwise(short)


def compacted(text: Column, budget: int) -> Column:
    """A tool's result over the budget as its first 60 % and last 30 %, marked once."""
    head, tail = int(budget * 0.6), int(budget * 0.3)
    cut = (F.length(text) - head - tail).cast("string")
    short = F.concat(F.lit("[compacted "), cut, F.lit(" chars \u2014 re-call the tool to re-fetch]\n"), F.left(text, F.lit(head)), F.lit("\n... [middle elided] ...\n"), F.right(text, F.lit(tail)))
    return F.when((F.length(text) <= budget) | text.startswith("[compacted "), text).otherwise(short)


def chunk_key(model: str, text: Column) -> Column:
    return F.left(F.sha1(F.concat(F.lit(model + "\n"), text)), F.lit(16))
