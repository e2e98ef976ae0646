"""Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans (numbers, written-out mail, account and document numbers, streets with house numbers, names
after a title or a word that announces one, dates). Boosted trees score each
by its format and its context, and spans at or above their kind's threshold are added; thresholds are calibrated on held-out examples for
a precision of PRECISION if RATE of the candidates were personal. Of overlapping ones the likeliest stays, and none overlaps a base span. The base kinds (email, ip, card, phone) are always reported.

The trees are trained on a bounded, seeded set of written examples (EXAMPLES rows), not on the corpus, so results are alike at every
size. Nulls and empty texts have no spans. Repeated rows each get their row, null ids stay null, other columns are not looked at, an
empty table gives an empty result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import chunks, read, text_of

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Every ip, card or phone match lies in one of these runs.
NUMERIC = re.compile(r"[0-9+][0-9+ ().-]*")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "address_like", "number_like", "document_like", "street_like", "name_like", "date_like")
#: RATE: the share of personal candidates that thresholds reckon with.
EXAMPLES, SEED, PRECISION, RATE = 12_000, 20240, 0.98, 0.05

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from their @: each local part is looked at once, however long."""
    out, upto, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > upto and text[a - 1] in LOCAL:
            a -= 1
        if a < at and (m := DOMAIN.match(text, at + 1)):
            out.append((a, 0, m.end()))
            upto = m.end()
        else:
            upto = at + 1
        at = text.find("@", upto)
    return out


def base_spans(text: str) -> list[Span]:
    out = emails(text)
    for zone in NUMERIC.finditer(text):
        a, b = zone.span()
        if b - a < 7:
            continue
        for m in IP.finditer(text, a, b):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text, a, b):
            d = digits_of(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in zone[0]:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text, a, b) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


WRITTEN = re.compile(r"[\w.+-]{1,64}\s{0,2}(?:@|\(at\)|\[at\]|\{at\})\s{0,2}[\w-]{1,64}(?:\s{0,2}(?:\.|\(dot\)|\[dot\])\s{0,2}[\w-]{1,64}){0,4}")
NUMBER = re.compile(r"[+(]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,18}(?![0-9])")
DASHED = re.compile(r"(?<![0-9-])[0-9]{2,5}(?:[-. ][0-9]{2,6}){1,4}(?![0-9-])")

ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
PAPER = re.compile(r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6,9}(?![A-Za-z0-9])")


#: What streets, titles and months are called in the corpus's languages.
STREET = re.compile(
    r"(?<![\w.,-])[0-9]{1,5}[A-Za-z]? (?:[A-Z][a-z]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Terrace)\b"
    r"|\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|weg|platz|allee|gasse) [0-9]{1,4}[a-z]?\b"
    r"|(?<![\w.,-])[0-9]{1,4},? (?:rue|avenue|boulevard|chemin) (?:de |du |des |la |l')*[A-ZÀ-Þ][a-zà-ÿ]+"
    r"|\b(?:Calle|Avenida|Plaza) (?:de |del |la |los )*[A-ZÀ-Þ][a-zà-ÿ]+,? [0-9]{1,4}\b"
)
ANNOUNCED = re.compile(r"\b(?:[Nn]ame(?: is|:)?|[Nn]amed|Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Herrn?|Frau|Monsieur|Madame|Señora?|[Ss]igned(?: by)?:?|[Pp]atient:?|[Cc]ustomer:?|[Nn]om:?|[Nn]ombre:?) ")
NAME = re.compile(r"[A-ZÀ-Þ][a-zà-ÿ'-]+(?: [A-Z]\.)?(?: [A-ZÀ-Þ][a-zà-ÿ'-]+){1,2}")
#: What a text with a street or an announced name has; told before the patterns look at each place.
STREETS = (" Street", " St", " Avenue", " Ave", " Road", " Rd", " Lane", " Ln", " Drive", " Boulevard", " Blvd", " Court", " Square", " Terrace", "straße ", "strasse ", "weg ", "platz ", "allee ", "gasse ", " rue ", " avenue ", " boulevard ", " chemin ", "Calle ", "Avenida ", "Plaza ")
ANNOUNCING = ("ame ", "ame:", "amed ", "Mr", "Ms", "Dr", "Herr", "Frau", "Monsieur", "Señor", "igned", "atient", "ustomer", "Nom", "nom ", "nom:", "Nombre", "nombre")
DAY = re.compile(r"[0-9]{1,4}[./ -]")
MONTHS = "January February March April May June July August September October November December Januar Februar März Juni Juli Oktober Dezember janvier février mars avril mai juin juillet août septembre octobre novembre décembre enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
DATE = re.compile(rf"(?<![\w.-])(?:[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)[0-9]{{2}}|(?:19|20)[0-9]{{2}}-[01][0-9]-[0-3][0-9]|[0-3]?[0-9]\.? (?:de )?(?:{'|'.join(MONTHS)}) (?:de )?(?:19|20)[0-9]{{2}})(?![\w-])")
BIRTH = ("born", "birth", "birthday", "dob", "geboren", "geburtsdatum", "geb", "née", "né", "naissance", "nacido", "nacida", "nacimiento")


def checked_account(s: str) -> bool:
    """Whether an account number's check digits hold (remainder 1 by 97)."""
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def candidates(text: str) -> list[Span]:
    out = set()
    if "@" in text or "at)" in text or "at]" in text or "at}" in text:
        out |= {(m.start(), 4, m.end()) for m in WRITTEN.finditer(text)}
    out |= {(m.start(), 6, m.end()) for rx in (ACCOUNT, PAPER) for m in rx.finditer(text)}
    if any(w in text for w in STREETS):
        out |= {(m.start(), 7, m.end()) for m in STREET.finditer(text)}
    if any(w in text for w in ANNOUNCING):
        out |= {(m.start(), 8, m.end()) for told in ANNOUNCED.finditer(text) if (m := NAME.match(text, told.end()))}
    out |= {(m.start(), 9, m.end()) for day in DAY.finditer(text) if (m := DATE.match(text, day.start()))}
    for zone in NUMERIC.finditer(text):
        a, b = zone.span()
        if b - a >= 7:
            a -= a > 0 and text[a - 1] == "("
            out |= {(m.start(), 5, m.end()) for rx in (NUMBER, DASHED) for m in rx.finditer(text, a, b) if len(digits_of(m[0])) >= 7}
    return sorted(out)


#: Context words, by what they hint at.
HINTS = {
    "phone": ("phone", "tel", "telefon", "téléphone", "teléfono", "call", "mobile", "fax", "handy"),
    "mail": ("mail", "email", "e-mail", "contact", "write", "reach"),
    "identity": ("ssn", "social", "passport", "licence", "license", "iban", "account", "card", "visa"),
    "other": ("version", "page", "isbn", "order", "invoice", "build", "section", "date", "since", "id", "serial", "figure"),
}


#: Capitalised words that stand after a title or a number without being a name or a street; words before where someone lives.
NOT_NAMES = frozenset("The This That Company Group Service Version Number January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday University Street Office Server System Project".split())
NOT_STREETS = frozenset("Points Ways Rules Steps Chapters Great Next Best First Wall".split())
LIVED = frozenset("live lives lived address at home resident wohnt adresse anschrift habite demeurant adresse vive dirección domicilio reside resides".split())

#: The feature that tells document numbers; those of the later kinds.
DOCUMENT, LATER = 25, {7: 27, 8: 28, 9: 29}


def features(text: str, span: Span) -> list[float]:
    a, kind, b = span
    s, left, right = text[a:b], text[max(0, a - 40) : a].lower(), text[b : b + 20].lower()
    d = digits_of(s)
    groups = re.findall("[0-9]+", s)
    before, after = text[a - 1] if a else " ", text[b] if b < len(text) else " "
    near = re.findall(r"[\w-]+", left)[-5:]
    out = [
        float(kind == 4), b - a, len(d), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), len(groups[-1]) if groups else 0,
        s.count("-"), s.count("."), s.count(" "), s.count("/"), s.count("("), float(s[0] == "+"), float(s[0] == "("), len(set(d)), float(luhn(d)) if 12 <= len(d) <= 19 else 0.5,
        float("@" in s), float("at" in s.lower()), float("dot" in s.lower() or "." in s), float(before.isalnum() or before in "-_./"), float(after.isalnum() or after in "-_/%"),
        float(d[:2] in ("19", "20") and len(groups) > 0 and len(groups[0]) == 4), float(groups == [x for x in groups if len(x) in (3, 4)] and len(groups) == 3), float([len(x) for x in groups] == [3, 2, 4]), float(bool(re.match(r"\W{0,3}[0-9]", right))),
        float(kind == 6), float(kind == 6 and len(s) >= 12 and checked_account(s)),
        float(kind == 7), float(kind == 8), float(kind == 9), float(any(w in BIRTH for w in near)), float(kind == 9 and int(re.search("(?:19|20)[0-9]{2}", s)[0])), float(kind == 8 and any(w in NOT_NAMES for w in s.split())), float(kind == 7 and any(w in NOT_STREETS for w in s.split())),
        float(any(w in LIVED for w in near)),
    ]
    return out + [float(any(w in words for w in near)) for words in HINTS.values()]


TITLES = ("name is", "Name:", "named", "Mr", "Mr.", "Mrs", "Ms.", "Dr.", "Herr", "Frau", "Monsieur", "Madame", "Señor", "signed by", "Patient:", "customer")


def written_examples(n: int = EXAMPLES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Seeded sentences with one personal or harmless item each: features and labels of all candidates in them."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choices("0123456789", k=k))
    word = lambda: "".join(r.choices("aeinorstlu", k=r.randint(2, 8)))
    sep = lambda: r.choice("- .")

    name = lambda: word().capitalize() + r.choice(["", "n", "r"])

    def street() -> str:
        return r.choice([
            lambda: f"{r.randint(1, 9999)} {name()} {r.choice(['Street', 'St', 'Avenue', 'Road', 'Lane', 'Drive', 'Court'])}",
            lambda: f"{name()}{r.choice(['straße', 'weg', 'platz', 'allee'])} {r.randint(1, 300)}",
            lambda: f"{r.randint(1, 300)} {r.choice(['rue', 'avenue', 'boulevard'])} {r.choice(['', 'de ', 'du '])}{name()}",
            lambda: f"{r.choice(['Calle', 'Avenida', 'Plaza'])} {r.choice(['', 'de '])}{name()} {r.randint(1, 300)}",
        ])()

    def date(first: int, last: int) -> str:
        day, month, year = r.randint(1, 28), r.randint(1, 12), r.randint(first, last)
        return r.choice([f"{day:02d}.{month:02d}.{year}", f"{year}-{month:02d}-{day:02d}", f"{day}/{month}/{year}", f"{day} {r.choice(MONTHS)} {year}"])

    def personal() -> tuple[str, str]:
        kind = r.randrange(12)
        if kind == 8:
            return r.choice(sorted(LIVED)), street()
        if kind in (9, 10):
            return r.choice(TITLES), f"{name()} {name()}" if r.random() < 0.7 else f"{name()} {r.choice('ABCDEF')}. {name()}"
        if kind == 11:
            return r.choice(BIRTH), date(1920, 2012)
        if kind == 5:
            body, country = num(r.choice([16, 18, 20])), "".join(r.choices("ABDEFGILNPST", k=2))
            s = next(x for x in (f"{country}{k:02d}{body}" for k in range(2, 99)) if checked_account(x))
            return r.choice([*HINTS["identity"], word()]), s if r.random() < 0.5 else " ".join(s[k : k + 4] for k in range(0, len(s), 4))
        if kind == 6:
            return r.choice(HINTS["identity"]), "".join(r.choices("CEGLPXY", k=r.randint(1, 2))) + num(r.randint(6, 9))
        if kind == 7:
            return r.choice(HINTS["phone"]), num(10)
        if kind == 0:
            return r.choice(HINTS["mail"]), f"{word()}{r.choice('._')}{word()}{r.choice([' (at) ', '(at)', ' [at] ', ' @ '])}{word()}{r.choice([' (dot) ', '.', ' [dot] '])}{r.choice(['com', 'org', 'net'])}"
        if kind == 1:
            return r.choice(HINTS["phone"]), f"({num(3)}) {num(3)}-{num(4)}"
        if kind == 2:
            s = sep()
            return r.choice(HINTS["phone"]), f"{num(3)}{s}{num(3)}{s}{num(4)}"
        if kind == 3:
            return r.choice(HINTS["identity"]), f"{num(3)}-{num(2)}-{num(4)}"
        return r.choice(HINTS["phone"]), f"0{num(2)} {num(3)} {num(4)}"

    def harmless() -> tuple[str, str]:
        kind = r.randrange(13)
        other = r.choice(HINTS["other"])
        if kind in (9, 10):
            return r.choice([other, word(), "on", "since", "until"]), date(1950, 2030)
        if kind == 11:
            return r.choice(["Dr", "Mr.", "customer:", "signed", "named", "name", "name is"]), " ".join(r.sample(sorted(NOT_NAMES), r.choice([1, 2])) + [name()][: r.choice([0, 1, 1])])
        if kind == 12:
            return word(), f"{r.randint(1, 99)} {r.choice(sorted(NOT_STREETS))} {r.choice(['Street', 'Road', 'Drive', 'Court'])}"
        if kind == 7:
            return r.choice([other, word()]), "".join(r.choices("ABCDEFGHKMX", k=r.randint(1, 2))) + num(r.randint(6, 9))
        if kind == 8:
            return r.choice([other, word()]), f"{''.join(r.choices('ABCDEFG', k=2))}{num(2)} {num(4)} {num(4)} {num(4)}"
        if kind == 0:
            return other, f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}"
        if kind == 1:
            return other, num(r.randint(7, 19))
        if kind == 2:
            return other, f"{num(2)}.{num(2)}.{num(3)}.{num(2)}"
        if kind == 3:
            return other, f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}"
        if kind == 4:
            return other, f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}"
        if kind == 5:
            return word(), f"{word()} @ {word()}"
        return word(), num(r.randint(7, 19))

    x, y = [], []
    for _ in range(n):
        good = r.random() < 0.5
        hint, item = personal() if good else harmless()
        lead = [word() for _ in range(r.randint(1, 6))]
        if good and hint in TITLES:
            lead.append(hint)  # a name is proposed by what announces it
        elif item.isalnum() and good or good and hint in BIRTH or r.random() < (0.6 if good else 0.8):
            lead.append(hint + r.choice(["", ":", " is"]))  # a bare number is personal by its hint alone, so these always have theirs
        text = f"{' '.join(lead)} {item}{r.choice(['', ',', '.', '.'])} {' '.join(word() for _ in range(4))}"
        a = text.index(item)
        for span in candidates(text):
            whole = span[0] <= a + 1 and span[2] >= a + len(item) - 1
            x.append(features(text, span))
            y.append(float(good and whole))
    return np.array(x), np.array(y)


@lru_cache(1)
def trained() -> tuple[BoostedTrees, dict[int, float]]:
    """The trees, and the threshold of each added kind."""
    x, y = written_examples()
    model = BoostedTrees().fit(x, y)
    kind = np.where(x[:, 0] > 0, 4, np.where(x[:, DOCUMENT] > 0, 6, 5))
    for k, column in LATER.items():
        kind[x[:, column] > 0] = k
    return model, {k: model.threshold(x, y, PRECISION, RATE, kind == k) for k in (4, 5, 6, *LATER)}


def added(text: str, base: list[Span], model: BoostedTrees, least: dict[int, float]) -> list[Span]:
    taken: list[tuple[int, int]] = []
    for a, _, b in base:  # in order; merged, as base kinds may overlap
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    found = [c for c in candidates(text) if free(taken, c)]
    if not found:
        return []
    p = model.predict(np.array([features(text, c) for c in found]))
    out: list[Span] = []
    for i in sorted(range(len(found)), key=lambda i: (-p[i], found[i])):
        if p[i] >= least[found[i][1]] and free(taken, found[i]):
            insort(taken, (found[i][0], found[i][2]))
            out.append(found[i])
    return out


def free(taken: list[tuple[int, int]], span: Span) -> bool:
    """Whether the span overlaps none of the disjoint, sorted intervals."""
    i = bisect_left(taken, (span[0], span[2]))
    return (i == len(taken) or taken[i][0] >= span[2]) and (i == 0 or taken[i - 1][1] <= span[0])


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a count per base kind, base_sha256, spans, n_added of each row. No shuffle; the model travels with the tasks."""
    model, least = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                more = added(text, base, model, least)
                rows.append((base, told(sorted(base + more)), len(more)))
            n = [pa.array([sum(x[1] == k for x in b) for b, *_ in rows], pa.int64()) for k in range(4)]
            digests = pa.array([hashlib.sha256(told(b).encode()).hexdigest() for b, *_ in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), *n, digests, pa.array([x for _, x, _ in rows], pa.string()), pa.array([x for *_, x in rows], pa.int64())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(read(spark, sf_dir, "documents"))
