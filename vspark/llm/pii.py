"""Operator 9: personal data. Expressions propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import with_computed

#: Order of kinds where spans start together; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
#: Score of a proposal by kind before its checksum and its context are looked at.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.3, "phone": 0.6, "iban": 0.2, "ssn": 0.3, "secret": 0.5}
CHECKED = 0.5
NEAR = 0.3
FAR = -0.3
THRESHOLD = 0.6
#: Code points before and after a span in which context words count.
WINDOW = 48
CONTEXT = {
    "card": re.compile(r"\b(?:card|credit|debit|visa|mastercard|amex|pan|karte|carte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|mobile|cell|call|fax|telefon|téléphone|teléfono)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social|security|insurance)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|server)\b", re.I),
    "email": re.compile(r"\b(?:mail|e-mail|email|contact)\b", re.I),
    "secret": re.compile(r"\b(?:token|secret|api|key|password|passwd|pwd|bearer)\b", re.I),
}
AGAINST = re.compile(r"\b(?:version|release|example|isbn|order|invoice|serial|part)\b", re.I)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The looks behind and the possessive signs change no match: a match from inside a run of digits implies one from its start.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Code points of an IBAN by country, as registered.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO EG GT HN HU LB NI PL SV", 29: "BR PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?i:token|secret|api[_-]?key|password|passwd|pwd)[\x20\t]{0,4}[=:][\x20\t]{0,4}[\"']?([A-Za-z0-9+/_-]{16,}+)")
HAS = re.compile(r"[0-9@]")


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ibans(text: str) -> list[tuple[int, int]]:
    """Spans that mod-97 confirms. A candidate may take words after it: it is cut to its country's length, or else tried whole, and, of a country without a known length, at the ends of its shorter groups.

    What follows a span, or the first group of a candidate without one, is looked at again. A candidate has at most 44 code points, so the time is linear.
    """
    spans, m = [], IBAN.search(text)
    while m:
        start, whole = m.span()
        groups = [e for e in range(whole, start, -1) if e == whole or text[e] == " "]
        known = IBAN_LENGTHS.get(text[start : start + 2])
        tried = groups if known is None else [e for e in groups if e - start - text.count(" ", start, e) == known] + [whole]
        end = next((e for e in tried if mod97(text[start:e])), None)
        if end:
            spans.append((start, end))
        m = IBAN.search(text, end or start + 1)
    return spans


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ in time linear in the text: each @ looks back over its run of local characters, as far as the last match."""
    spans, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            spans.append((start, m.end()))
            end = m.end()
        # What was looked back over holds no @, so that no later look goes over it again.
        at = text.find("@", m.end() if m else at + 1)
    return spans


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The base spans as (start, end, kind), by start, then kind."""
    found = []
    if HAS.search(text):
        found += [(a, b, "email") for a, b in emails(text)]
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                found.append((*m.span(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(digits_of(m[0])) <= 15:
                    found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def proposals(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, whether a checksum confirms it) of the kinds beyond the base."""
    found = []
    if HAS.search(text):
        found += [(a, b, "iban", True) for a, b in ibans(text)]
        found += [(*m.span(), "ssn", False) for m in SSN.finditer(text)]
    found += [(*m.span(1), "secret", any(c.isdigit() for c in m[1])) for m in SECRET.finditer(text)]
    return found


def score(text: str, start: int, end: int, kind: str, checked: bool) -> float:
    """PRIOR, plus CHECKED if a checksum confirms it, plus NEAR or FAR by the context words close by; cut to 0..1. Words against it don't bring a confirmed IBAN below THRESHOLD."""
    around = text[max(0, start - WINDOW) : start] + " \0 " + text[end : end + WINDOW]
    value = PRIOR[kind] + CHECKED * checked + NEAR * bool(CONTEXT[kind].search(around)) + FAR * bool(AGAINST.search(around))
    return min(1.0, max(THRESHOLD if kind == "iban" and checked else 0.0, value))


def find_spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, float]]]:
    """Base spans, and all spans with scores: every base span, and each proposal that scores THRESHOLD or more and does not lie within a base span."""
    text = text or ""
    base = base_spans(text)
    kept = [(a, b, k, score(text, a, b, k, k == "card")) for a, b, k in base]
    starts, reach = [x for x, _, _ in base], list(accumulate((y for _, y, _ in base), max))
    for a, b, k, checked in proposals(text):
        before = bisect_right(starts, a)
        if (s := score(text, a, b, k, checked)) >= THRESHOLD and not (before and reach[before - 1] >= b):
            kept.append((a, b, k, s))
    return base, sorted(kept, key=lambda s: (s[0], KINDS.index(s[2])))


def redact(text: str | None, spans: list[tuple[int, int, str, float]]) -> str | None:
    """text with each span, or run of overlapping spans, replaced by <KIND> of its first span."""
    if not text or not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, kind = spans[i][:3]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][1])
        out += [text[at:start], f"<{kind.upper()}>"]
        at, i = end, i + 1
    return "".join(out) + text[at:]


SPANS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_email", "n_ip", "n_card", "n_phone")] + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans", "scores")])


def _found() -> Callable[[str | None], tuple]:
    joined = lambda spans: ",".join(f"{s[2]}:{s[0]}:{s[1]}" for s in spans)

    def one(text: str | None) -> tuple:
        base, spans = find_spans(text)
        counts = [sum(k == kind for _, _, k in base) for kind in KINDS[:4]]
        return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), ",".join(f"{s[3]:.2f}" for s in spans))

    return one


def find_pii(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns of docs with the counts of base spans by kind, base_sha256, spans and their scores.

    Offsets are code points, end exclusive. Null text: as empty. Texts without a span: counts 0, spans '' and
    the hash of ''. Texts of any length are read whole, in linear time. Repeated rows: each is looked at by itself. Spans that
    start together stand in the order of KINDS. Empty tables: no rows. Other columns are not read. No shuffle.
    """
    return with_computed(docs, ["text"], keep, SPANS, _found)


def redact_pii(docs: DataFrame) -> DataFrame:
    """docs with the found spans replaced in text; null stays null, the columns and the rows stay, n_chars (if there) follows the text. Long texts, repeated rows and empty tables: as in find_pii."""
    has_length = "n_chars" in docs.columns
    added = T.StructType([T.StructField("text", T.StringType())] + [T.StructField("n_chars", T.LongType())] * has_length)

    def make() -> Callable:
        def one(text: str | None, *length: int | None) -> tuple:
            spans = find_spans(text)[1]
            new = redact(text, spans)
            return (new, len(new) if spans else length[0]) if has_length else (new,)

        return one

    return with_computed(docs, ["text"] + ["n_chars"] * has_length, docs.columns, added, make).select(*[f"`{c}`" for c in docs.columns])


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
