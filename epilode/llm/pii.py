"""Personal data in texts: patterns propose, checksums confirm, context adjusts the score.

All matching takes time in proportion to the text, also for long runs of digits or
letters: e-mail addresses are sought around their at sign, and dotted or parted
numbers are taken as whole runs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilode.llm.common import add_column

#: Kinds that are always reported, in their order; the others need a score of `THRESHOLD`.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "tel")
THRESHOLD = 0.6
_NEAR = 48  # code points around a span whose words count as context
_RAISE = 0.3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PARTED = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9].)[A-Z][0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.DOTALL)
_SSN = re.compile(r"[0-9](?<![0-9-].)[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])", re.DOTALL)
_TEL = re.compile(r"[(0-9](?<![0-9+(-].)(?<=[(2-9])(?:(?<=\()[2-9][0-9]{2}\) ?|(?<=[2-9])[0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9-])", re.DOTALL)
_WORD = re.compile(r"[^\W\d_]+")

_START = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "tel": 0.4}
_FOR = {
    "email": {"mail", "email", "contact", "write"},
    "ip": {"ip", "address", "host", "server"},
    "card": {"card", "credit", "debit", "visa", "mastercard", "payment"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "cell"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security"},
    "tel": {"phone", "tel", "call", "mobile", "fax", "cell"},
}
_AGAINST = {"ip": {"version", "release", "build"}, "card": {"order", "tracking", "isbn"}, "phone": {"isbn"}}

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
Span = tuple[str, int, int, float]


def luhn(digits: str) -> bool:
    """Checksum of card numbers."""
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(text: str) -> bool:
    """Checksum of bank account numbers (ISO 7064)."""
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        start, parts = run.start(), run.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield start, end
            start = end + 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for run in _PARTED.finditer(text):
        if run.end() - run.start() <= 37:
            digits = _digits(run.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield run.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for run in _PHONE.finditer(text):
        if 9 <= len(_digits(run.group())) <= 15:
            yield run.span()


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for run in _SSN.finditer(text):
        area, group, serial = run.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield run.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's own score, raised or lowered by the words around the span."""
    near = {w.lower() for w in _WORD.findall(text[max(0, start - _NEAR) : start] + " " + text[end : end + _NEAR])}
    value = _START[kind]
    value += _RAISE if near & _FOR[kind] else 0
    value -= _RAISE if near & _AGAINST.get(kind, set()) else 0
    return round(min(1.0, max(0.0, value)), 2)


def find_spans(text: str | None) -> list[Span]:
    """All spans (kind, start, end, score) in code points, by start, then kind, then end."""
    text = text or ""
    found = [("email", *s) for s in _emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *s) for s in _addresses(text)]
        found += [("card", *s) for s in _cards(text)]
        found += [("phone", *s) for s in _phones(text)] if "+" in text else []
        base = sorted((s, e) for _, s, e in found)
        more = [("iban", *m.span()) for m in _IBAN.finditer(text) if mod97(m.group())]
        more += [("ssn", *s) for s in _ssns(text)]
        more += [("tel", *m.span()) for m in _TEL.finditer(text)]
        # What a base span covers is not proposed again.
        found += [m for m in more if not any(s <= m[1] and m[2] <= e for s, e in base)]
    scored = [(k, s, e, score(text, k, s, e)) for k, s, e in found]
    kept = [x for x in scored if x[0] in BASE or x[3] >= THRESHOLD]
    return sorted(kept, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact_text(text: str, spans: list[Span]) -> str:
    """Put the kind in brackets in place of each span; overlapping spans become one."""
    out, done = [], 0
    for kind, start, end, _ in spans:
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def find(docs: DataFrame, into: str = "pii", text_col: str = "text") -> DataFrame:
    """`docs` and a struct column `into`: `spans` (kind, start, end, score) and the `redacted` text.

    Null texts count as empty and have no spans; their redacted text is null.  Spans of
    the base kinds are all reported whatever their score, the others from `THRESHOLD`.
    Every row is judged alone, over its whole text, and keeps its columns; `into` must
    be a new name.
    """
    kind = pa.struct([("spans", pa.list_(SPAN)), ("redacted", pa.string())])

    def values(texts: list) -> list[dict]:
        out = []
        for text in texts:
            spans = find_spans(text)
            out.append({
                "spans": [dict(zip(("kind", "start", "end", "score"), s)) for s in spans],
                "redacted": redact_text(text, spans) if spans else text,
            })
        return out

    return add_column(docs, docs.columns, into, kind, [F.col(text_col).cast("string")], values)


def joined(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
