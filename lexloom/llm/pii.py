"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust a score.

Base kinds are email, ip, card and phone; ``iban`` (mod-97) is added by the method. Offsets count
code points, the end is exclusive. Of spans with one start the order is that of the kinds; kinds may
overlap. Base spans stay whatever their score; added ones need ``least``. Null and empty texts have no
spans, repeated rows theirs each. Extra columns don't matter, an empty table gives an empty result.
All searches are linear in the text, so very long runs of one character don't matter.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, utf8

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_DIGIT = re.compile("[0-9]")
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "BA": 20, "BE": 16, "BG": 22, "BR": 29, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GE": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IS": 26, "IT": 27, "KZ": 20, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TN": 24, "TR": 26, "UA": 29,
    "AZ": 28, "BH": 22, "BI": 27, "BY": 28, "CR": 22, "DJ": 27, "DO": 28, "EG": 29, "FK": 18, "FO": 18, "GI": 23, "GL": 18, "GT": 28, "HN": 28, "IQ": 23, "JO": 30, "KW": 30, "LB": 28, "LC": 32, "LY": 25, "MN": 20, "MR": 27, "MU": 30, "NI": 28, "OM": 23,
    "PK": 24, "PS": 29, "QA": 29, "RU": 33, "SC": 31, "SD": 18, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
#: The score before context: how much the pattern with its checksum proves.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT = {
    "email": re.compile(r"mail|contact|courriel|correo", re.I),
    "ip": re.compile(r"\bip\b|address|adresse|server|host", re.I),
    "card": re.compile(r"card|visa|credit|carte|tarjeta|karte", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|appel|llam", re.I),
    "iban": re.compile(r"iban|bank|account|konto|compte|cuenta", re.I),
}
NEAR = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str):
    end = 0
    at = text.find("@")
    while at >= 0:
        start = end + len(text[end:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))
        if not m:
            end = max(end, start)


def _ibans(text: str):
    end = 0
    for m in _IBAN.finditer(text):
        want, at, found = IBAN_LENGTHS.get(m.group()[:2], 0) - 4, m.end(), [m.group()]
        if want <= 0 or m.start() < end:
            continue
        while want and at < len(text):
            c = text[at]
            if c == " " and at + 1 < len(text) and text[at - 1] != " ":
                at += 1
                continue
            if not ("0" <= c <= "9" or "A" <= c <= "Z"):
                break
            found.append(c)
            want, at = want - 1, at + 1
        if not want and not (at < len(text) and text[at].isalnum()) and mod97("".join(found)):
            yield m.start(), at
            end = at


def find(text: str) -> list[tuple[str, int, int]]:
    """Confirmed spans as (kind, start, end), by start, then kind as listed."""
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
        out += [("iban", *s) for s in _ibans(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def score(text: str, kind: str, start: int, end: int) -> float:
    """The prior, raised where a context word stands within ``NEAR`` characters."""
    near = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    return min(1.0, PRIOR[kind] + 0.2 * bool(CONTEXT[kind].search(near)))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scored(text: str, least: float) -> list[tuple[str, int, int, float]]:
    """Confirmed spans with their scores; those of added kinds only from ``least`` on."""
    found = [(k, s, e, score(text, k, s, e)) for k, s, e in find(text)]
    return [f for f in found if f[0] in BASE or f[3] >= least]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """Per row: ``key`` and ``spans``, an array of (kind, start, end, value, score)."""

    def make():
        def work(ids, texts):
            out = []
            for raw in texts:
                t = raw.decode("utf-8", "replace")
                out.append([{"kind": k, "start": s, "end": e, "value": t[s:e], "score": x} for k, s, e, x in scored(t, least)])
            return ids, out

        return work

    kept = docs.select(F.col(key), utf8(text))
    return map_rows(kept, make, f"{key} {kept.schema[key].dataType.simpleString()}, spans array<struct<kind: string, start: long, end: long, value: string, score: double>>")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``scan``'s spans."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(k) for k in KINDS]
    return found.select(
        "doc_id", *counts[:4], F.sha2(F.array_join(F.transform(base, one), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", one), ",").alias("spans"), counts[4],
        F.array_min(F.transform("spans", lambda s: s["score"])).alias("lowest_score"),
    )
