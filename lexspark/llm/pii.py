"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their score.

Style: an Arrow map. Spans with offsets, Luhn and mod-97 have no counterpart among the built-in functions.
Every document is handled on its own, so there is no shuffle and no state.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Kinds in the order in which spans are listed. The first four are the base kinds: context never removes them.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone")
BASE = KINDS[:4]

# Words that, near a span, make a kind more likely.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "sozial", "sécurité"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
}
#: Score of a span before context is seen, when its checksum (if the kind has one) holds.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "local_phone": 0.3}

# Lengths of international account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}

SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:double>>"

# All repeats are possessive where giving back cannot lead to another match, so that time stays linear.
_DIGIT = re.compile(r"[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}(?=[0-9]{2})")
#: By country: its whole number, with or without single blanks, not followed by more of a word.
_IBAN_OF = {c: re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){%d}(?![A-Za-z0-9])" % (n - 4)) for n, names in IBAN_LENGTHS.items() for c in names.split()}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-][0-9]{2,4}){2,4}(?![0-9])")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(text: str) -> bool:
    """The check of international account numbers: country and check digits go last, letters count from 10."""
    s = text.replace(" ", "")
    rest = 0
    for ch in s[4:] + s[:4]:
        n = int(ch, 36)
        rest = (rest * (10 if n < 10 else 100) + n) % 97
    return rest == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ so that long runs without one cost nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(text: str, start: int, end: int) -> str:
    return _NOT_DIGIT.sub("", text[start:end])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", *x) for x in emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        for m in _CARD.finditer(text):
            d = _digits(text, *m.span())
            if 13 <= len(d) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(text, *m.span())) <= 15]
    return found


def added_spans(text: str) -> list[tuple[str, int, int]]:
    if not _DIGIT.search(text):
        return []
    found = []
    for start in _IBAN.finditer(text):
        if (of := _IBAN_OF.get(start[0])) and (m := of.match(text, start.start())) and mod97(m[0]):
            found.append(("iban", *m.span()))
    found += [("ssn", *m.span()) for m in _SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000"]
    found += [("local_phone", *m.span()) for m in _LOCAL_PHONE.finditer(text) if 7 <= len(_digits(text, *m.span())) <= 12]
    return found


@dataclass(frozen=True)
class PiiOptions:
    window: int = 40
    bonus: float = 0.3
    threshold: float = 0.5


def score(text: str, kind: str, start: int, end: int, o: PiiOptions) -> float:
    near = text[max(0, start - o.window) : start] + " " + text[end : end + o.window]
    words = {w.lower() for w in _WORD.findall(near)}
    return min(1.0, PRIOR[kind] + o.bonus * bool(words & set(CONTEXT[kind])))


def _meets(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a span overlaps one of ``taken``, which are sorted and don't overlap each other."""
    k = bisect_left(taken, (end,))
    return k > 0 and taken[k - 1][1] > start


def spans_of(text: str | None, o: PiiOptions = PiiOptions()) -> list[tuple[str, int, int, float]]:
    """All spans of a text, by kind and start. Added kinds need the threshold and may not overlap a base span."""
    if not text:
        return []
    base = base_spans(text)
    out = [(*s, score(text, *s, o)) for s in base]
    # each kind's spans are sorted and apart, so the only ones that can meet a span are its neighbours by start
    taken: dict[str, list[tuple[int, int]]] = {}
    for kind, s, e in base:
        taken.setdefault(kind, []).append((s, e))
    for kind, s, e in added_spans(text):
        if (p := score(text, kind, s, e, o)) >= o.threshold and not any(_meets(t, s, e) for t in taken.values()):
            out.append((kind, s, e, p))
            taken.setdefault(kind, []).append((s, e))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda x: (rank[x[0]], x[1]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: PiiOptions = PiiOptions()) -> DataFrame:
    """``(doc_id, spans)`` for every row, in code points with an exclusive end.

    Null and empty texts have no spans; a null id stays null; repeated rows give repeated results; an empty table
    gives an empty result; other columns are not read. Very long texts are handled whole, in linear time.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    to = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans_of(t, options)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, to)], ["id", "spans"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {kind}, spans {SPAN_TYPE}").withColumnRenamed("id", id_col)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
