"""Secret scan with multipart credential linking.

Strong kinds (assign, access, hex) are reported wherever their pattern and length hold. Weak parts - identifiers, random-looking
keys, endpoints - are reported only when a complementary part lies within WINDOW code points in the same scope: an interval join of
identifiers, secrets and endpoints. A scope is a run of lines without a blank line. All parts of a scope are in one text, so the join
is a sweep over sorted intervals in the task that has the text; nothing is shuffled and no pairs are made.

Nulls and empty texts have no spans. Repeated rows each get their row, null ids stay null, other columns are not looked at, an empty
table gives an empty result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, read, text_of

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")

#: Weak parts.
IDENTIFIER = re.compile(r"""\b(?:client_?id|key_?id|account(?:_?id)?|user(?:_?name|_?id)?|login)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9@._-]{3,}""", re.I | re.A)
KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
URL = re.compile(r"""[a-z][a-z0-9+]{1,15}://[^\s"'<>]+""")
HOST = re.compile(r"(?<![A-Za-z0-9.-])[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+:[0-9]{2,5}(?![0-9])")
BLANK = re.compile(r"\n[\x20\t\r]*\n")
WINDOW = 240
#: What a weak part needs nearby.
NEEDS = {"identifier": ("secret",), "key": ("id",), "endpoint": ("id", "secret")}
ROLE = {"assign": "secret", "hex": "secret", "key": "secret", "access": "id", "identifier": "id", "endpoint": "endpoint"}

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind's number, end) of the strong kinds, in order."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def weak_spans(text: str, strong: list[Span]) -> list[Span]:
    """Weak parts that don't overlap a strong one."""
    found = [(m.start(), 3, m.end()) for m in IDENTIFIER.finditer(text)] if ":" in text or "=" in text else []
    if not found and not strong:
        return []
    found += [(m.start(), 4, m.end()) for m in KEY.finditer(text) if mixed(m[0])]
    if "://" in text:
        found += [(m.start(), 5, m.end()) for m in URL.finditer(text)]
    if re.search(":[0-9]", text):
        found += [(m.start(), 5, m.end()) for m in HOST.finditer(text)]
    kept: list[Span] = []
    taken = [(a, b) for a, _, b in strong]
    for a, k, b in sorted(found):
        i = bisect_left(taken, (a, b))
        if (i == len(taken) or taken[i][0] >= b) and (i == 0 or taken[i - 1][1] <= a):
            taken.insert(i, (a, b))
            kept.append((a, k, b))
    return kept


def mixed(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s)


def linked(text: str, strong: list[Span], weak: list[Span]) -> list[Span]:
    """The weak parts for which every complementary role is met within the window in their scope."""
    if not weak:
        return []
    breaks = [m.start() for m in BLANK.finditer(text)]
    by: dict[str, list[tuple[int, int]]] = {}
    for a, k, b in sorted([*strong, *weak]):
        parts = by.setdefault(ROLE[KINDS[k]], [])
        if not parts or b > parts[-1][1]:  # one inside another, as hex in an assignment, adds nothing
            parts.append((a, b))
    out = []
    for a, k, b in weak:
        scope = bisect_left(breaks, a)
        low = max(a - WINDOW, breaks[scope - 1] if scope else 0)
        high = min(b + WINDOW, breaks[scope] if scope < len(breaks) else len(text))
        if all(meets(by.get(role, []), low, high, (a, b)) for role in NEEDS[KINDS[k]]):
            out.append((a, k, b))
    return out


def meets(parts: list[tuple[int, int]], low: int, high: int, own: tuple[int, int]) -> bool:
    """Whether a part other than own overlaps [low, high); the parts don't contain each other, so neighbours suffice."""
    i = bisect_left(parts, (low, -1))
    return any(p != own and p[0] < high and p[1] > low for p in parts[max(0, i - 1) : i + 2])


def spans_of(text: str) -> tuple[list[Span], list[Span]]:
    """The strong spans and all spans, each in order."""
    strong = base_spans(text)
    return strong, sorted(strong + linked(text, strong, weak_spans(text, strong)))


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = [(s, told(every), len(every) - len(s)) for s, every in map(spans_of, batch.column(1).to_pylist())]
            n = [pa.array([sum(x[1] == k for x in s) for s, *_ in rows], pa.int64()) for k in range(3)]
            digests = pa.array([hashlib.sha256(told(s).encode()).hexdigest() for s, *_ in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), *n, digests, pa.array([x for _, x, _ in rows], pa.string()), pa.array([x for *_, x in rows], pa.int64())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every reported span replaced by mark (overlapping spans by one); other columns stay, n_chars follows the text.

    A null text stays null.
    """
    names = docs.columns
    at, count = names.index(text_col), names.index("n_chars") if "n_chars" in names else None

    def clean(text: str | None) -> str | None:
        every = spans_of(text)[1] if text else []
        out, upto = [], 0
        for a, _, b in every:
            if a >= upto:
                out += [text[upto:a], mark]
            upto = max(upto, b)
        return "".join([*out, text[upto:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, at):
            columns = batch.columns
            old = columns[at].to_pylist()
            new = [clean(x) for x in old]
            if count is not None:
                columns[count] = pa.array([len(y) if x != y else c for x, y, c in zip(old, new, columns[count].to_pylist(), strict=True)], columns[count].type)
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
