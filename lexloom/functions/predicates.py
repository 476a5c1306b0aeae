"""Predicates on sentences (rows F14-F30) and the numeric quality score (A19), for either dialect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import B, E, WORD, Spark, any_word

_N = r"\d+([.,]\d+)?"
NUMBER = rf"{B}\d+([eE][+-]?\d+)?{E}"
METADATA = rf"https?://|{B}(accepted|copyright|correspondence|creativecommons|doi|e-?mail|issn|issue|license|orcid|published|revision|submitted|volume){E}"
_MONTHS = "january february march april may june july august september october november december".split()
_UNITS = (
    "a bar cm ev g g/cm3 gev ghz h hr hz k kev kev/c kg kg/m3 khz km/h kmh-1 kpa kt kv kw l m m/s ma mbar mev mev/c mev/c2 mg mhz "
    "ml mm mmol mol mpa ms ms-1 ms-2 mt mv mw nm ns pa pm ppb ppm ppt ps s t tev ua ug ul um us v w µa µg µl µm µs"
).split()
UNIT = rf"[%‰]|(?i)[{WORD}]°c{E}|{B}p\.p\.[bmt]\.[{WORD}]|{B}({'|'.join(sorted(_UNITS, key=len, reverse=True))}){E}"
MEASURE = rf"(?i){B}({_N}\s*(±|\+/-)\s*\d|{_N}\(\d+([.,]\d+)?\)[{chr(92)}p{{L}}{chr(92)}p{{N}}_]|{_N} *[x×] *10 *\^ *[-+]?\d|10 *\^ *[-+]?\d|{_N}e[+-]?\d+{E})"
_VERBS = (
    "allow allowed allows are be been being consumed corresponded decreased detected finds found gave generated had has have improved increased is lasted measured observed obtained "
    "achieved produced provide provided provides reached reduced remained reported showed shown shows transported was were yielded"
).split()
COMPARES = any_word("better than", "compared with", "consistent with", "corresponding to", "factor of", "precision of", "respectively", "resulted in")
_LETTER = "A-Za-zÀ-ÿ"
ALPHA_WORD = rf"[{_LETTER}][{_LETTER}'-]*"


def number(d, x):
    return d.match(x, NUMBER)


def metadata(d, x):
    return d.match(f"lower({x})", METADATA)


def date_only(d, x):
    """F16: numbers only as parts of dates. Years and months are dropped up to their ends."""
    left = d.sub(x, r"(\d\d?[/-]){2}\d{2,4}", " ")
    left = d.sub(left, rf"{B}(19|20)\d\d{E}", "$1 $3")
    return f"({number(d, x)} and not {number(d, d.sub(left, any_word(*_MONTHS), ' '))})"


def reference_fragment(d, x):
    many = f"{d.count(x, ';')} >= 3 and {d.count(x, '[(]')} >= 2"
    return f"({d.match(x, any_word('et al'))} and {d.match(x, '[(]')} and {d.match(x, '[)]')} or {d.guarded(x, r'(^|[^A-Za-z0-9_à-ÿ])[-a-zà-ÿ]+, *[A-Z][.]', ', *[A-Z][.]')} or {many})"


def layout_fragment(d, x):
    return f"(trim({x}) = '' or {d.match(x, r'^[()%/x×=±+.:;,\d\s^-]+$')} or {d.match(x, r'(?i)^\s*page\s+\d+\s*$')})"


def alpha_words(d, x):
    return d.count(x, ALPHA_WORD)


def digits(d, x):
    return d.count(x, "[0-9]")


def unit(d, x):
    return d.match(x, UNIT)


def measure(d, x):
    return d.match(x, MEASURE)


def verb(d, x):
    return d.match(x, any_word(*_VERBS))


def reference_entry(d, x):
    return d.match(x, r"^[0-9]+[.]\s+[A-Z][-A-Za-z]+")


def journal(d, x):
    year, pages = r"[(]\d{4}[)]", rf"{B}\d+ *, *\d+ *- *\d+"
    named = d.match(x, rf"{B}(Nature|Science|Lett){E}|{B}(Phys\.\s*Rev|Rev\.\s*Mod\.\s*Phys)")
    return f"({d.match(x, any_word('et al'))} and {d.match(x, year)} or {named} and ({d.match(x, year)} or {d.match(x, pages + E)}) or {d.match(x, pages + r'\s*[(]\d{4}[)]')})"


def caption(d, x):
    return d.match(x, rf"(?i)^((figure|figs?\.?|table|extended data (fig\.?|table))\s*\d+[a-z]?{E}|figure:)")


def axis_fragment(d, x):
    quantities = "acceleration amplitude counts? current frequency intensity signal temperature time voltage".split() + ["number of protons"]
    three = r"(^|[^\p{L}\p{N}_.-])(-?\d+(\.\d+)?\s+){2}-?\d+(\.\d+)?" + E
    wordy = f"{d.match(x, r'^\s*[A-Za-z()/%.+-][A-Za-z ()/%.+\s-]*$')} and {d.match(f'trim({x})', r'\s[^\s].*\s[^\s]|\s \s')}"  # three parts without digits, told without backtracking
    return f"({d.count(x, '[|]')} >= 2 or {d.match(x, rf'(?i){B}({"|".join(quantities)})\s*[(][^)]+[)]')} or {wordy} or {d.match(x, three)} and {alpha_words(d, x)} <= 8)"


def page_counter(d, x):
    return d.match(x, rf"(?i){B}\d+\s+of\s+\d+{E}|^page\s+\d+$")


def section_title(d, x):
    return f"(length({x}) <= 140 and ({d.match(x, r'^[0-9]+([.][0-9]+){1,3}\s+[A-Z]')} or {d.match(x, rf'(?i)^(appendix|extended data|section|subsection|supplementary){E}')}))"


def too_short(d, x):
    return f"({alpha_words(d, x)} <= 4 and not {unit(d, x)} and not {measure(d, x)})"


def incomplete(d, x):
    """F19."""
    start = r"(?i)^(but|and|or|including|such as|while|whereas|with) "
    return f"(length({x}) < 30 or {d.match(x, r'[(,:;\[]\s*$')} or {d.match(x, start)} or {d.match(x, rf'(?i){B}(including|that|where|whereas|which|while|compared with|respectively)\s*$')})"


def continuation(d, x):
    """F20."""
    return d.match(x, r"^\p{Ll}|^[)\],;:%]|^(?i)(but|and|or|including|respectively|while|whereas|with) ")


def score(d, x):
    """One sum of cases, without a shuffle."""
    n = alpha_words(d, x)
    tiers = [f"case when length({x}) >= 60 then 2 when length({x}) >= 35 then 1 else 0 end", f"case when {n} >= 10 then 2 when {n} >= 6 then 1 else 0 end"]
    parts = [
        (unit(d, x), 3), (measure(d, x), 3), (verb(d, x), 2), (f"{d.match(x, ',')} and {n} >= 8", 1), (d.match(x, COMPARES), 1), (page_counter(d, x), -8), (caption(d, x), -7), (journal(d, x), -7),
        (reference_entry(d, x), -6), (section_title(d, x), -5), (axis_fragment(d, x), -5), (reference_fragment(d, x), -4), (layout_fragment(d, x), -4), (too_short(d, x), -4),
        (f"{d.count(x, f'[{_LETTER}]')} < 10 and {digits(d, x)} >= 3", -4), (f"{d.count(x, ';')} >= 2", -2), (f"{d.count(x, ',')} >= 5 and {n} <= 8", -3),
    ]
    return " + ".join(tiers + [f"case when {c} then {v} else 0 end" for c, v in parts])


def column(f, x: str) -> Column:
    """A predicate of this module as a Spark column over the column named ``x``."""
    return F.expr(f(Spark, x))


FLAGS = {f.__name__: f for f in (number, metadata, date_only, reference_fragment, layout_fragment, unit, measure, verb, reference_entry, journal, caption, axis_fragment, page_counter, section_title, too_short, incomplete, continuation)}
