"""Character ranges and protected corrections (rows A18, F34, C12, C13, D5, J11, W6, T25)."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import c


def merge_ranges(df: DataFrame, by: list[str]) -> DataFrame:
    """Gaps and islands over (start, end); touching ranges join, empty ones go."""
    w = W.partitionBy(*by).orderBy("start", "end")
    rows = df.where(F.col("start") < F.col("end")).withColumn("_reach", F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("_island", F.sum(F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), 1).otherwise(0)).over(w))
    return rows.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def overlaps(ranges: Column | str, start, end) -> Column:
    """Half-open."""
    return F.exists(c(ranges), lambda r: (c(start) < r["end"]) & (c(end) > r["start"]))


PROTECTED = [r"https?://\S+|www\.\S+", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", r"(?:[A-Za-z]:\\|/)[\w./\\-]+", r"</?[A-Za-z][^>]*>", r"\b(?=\w*\d)(?=\w*[A-Za-z])[\w-]+\b", r"\b\d+(?:[,.]\d+)? ?(?:%|°C|[kmµn]?[gmlsVAW]|[kMG]?Hz)?", r"\S+\s*=\s*\S+"]


def protected_ranges(text: str, terms: Iterable[str] = ()) -> list[tuple[int, int]]:
    """Technical spans and whole user terms, merged."""
    found = [m.span() for p in PROTECTED for m in re.finditer(p, text)]
    found += [m.span() for t in terms for m in re.finditer(rf"(?<!\w){re.escape(t)}(?!\w)", text, re.I)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(s for s in found if s[0] < s[1]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def best_replacement(fragment: str, options: list[str]) -> str | None:
    """Accents or case alone first, then similarity, then length."""
    import unicodedata

    bare = lambda s: "".join(x for x in unicodedata.normalize("NFD", s.casefold()) if unicodedata.category(x) != "Mn")
    ranked = [(bare(o) != bare(fragment), -difflib.SequenceMatcher(None, fragment, o).ratio(), abs(len(o) - len(fragment)), i) for i, o in enumerate(options)]
    return options[min(ranked)[3]] if ranked else None


def correct(text: str, checker: Callable[[str], list[tuple[int, int, list[str]]]], terms: Iterable[str] = ()) -> str:
    """The checker's matches (start, length, options) outside of protected ranges, right to left."""
    spans, limit = protected_ranges(text, terms), len(text)
    for start, length, options in sorted(checker(text), key=lambda m: -m[0]):
        end = start + length
        if end > limit or any(start < b and end > a for a, b in spans):
            continue
        new = best_replacement(text[start:end], options)
        if new is not None:
            text, limit = text[:start] + new + text[end:], start
    return text


def styled_runs(text: str, styles: list[int]) -> list[tuple[str, int]]:
    """Runs of characters of one style."""
    out: list[list] = []
    for ch, s in zip(text, styles):
        if out and out[-1][1] == s:
            out[-1][0] += ch
        else:
            out.append([ch, s])
    return [(t, s) for t, s in out]


def projected_styles(old: str, new: str, styles: list[int]) -> list[int]:
    """The styles of a corrected text; replaced parts take the commonest style of what they replace."""
    out: list[int] = []
    for op, a, b, x, y in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if op == "equal":
            out += styles[a:b]
        elif op != "delete":
            near = styles[a:b] or styles[max(0, a - 1) : a] or styles[:1] or [0]
            out += [max(near, key=near.count)] * (y - x)
    return out
