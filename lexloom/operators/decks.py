"""Correction of slide decks (rows C13, C14, F35, F36, F37, T24, T25, P39, P41, D6, K16, X3, X4, A16).

A deck is a row (path, bytes). Its slides' XML is walked paragraph by paragraph, in shapes, groups and
tables alike; runs are rebuilt with the styles of the characters they keep. The checker is a
parameter: a factory, called once a task and language, of functions from a text to matches.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import LANGUAGE_WORDS
from ..sources import files as sources
from . import ranges

_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
FONTS = {"calibri": "Aptos", "calibri light": "Aptos Light"}
STYLE = {"category": ("PLAIN_ENGLISH", "REDUNDANCY", "SEMANTICS", "STYLE"), "rule": ("PASSIVE_VOICE", "READABILITY", "REDUNDANCY", "SENTENCE_LENGTH", "STYLE", "WORDINESS")}
STYLE_WORDS = ("long sentence", "more concise", "phrase longue", "plus concis", "plus simple", "redondan", "redundant", "reformul", "repetition", "rephrase", "répétition", "simpler wording", "style")
ISSUES = ("duplication", "grammar", "grammatical", "misspelling", "typographical")
CATEGORIES = ("AGREEMENT", "CASING", "CONCORDANCE", "GRAMMAIRE", "GRAMMAR", "PUNCTUATION", "SPELLING", "TYPOGRAPHY", "TYPOS")
RULES = ("AGREEMENT", "CONCORD", "DET", "NOUN")


@dataclass
class Match:
    """What a checker finds: a place, options to put there, and what kind of finding it is."""

    start: int
    length: int
    options: list[str]
    category: str = ""
    rule: str = ""
    message: str = ""
    issue: str = "misspelling"


Checker = Callable[[str], list[Match]]


@dataclass
class Counts:
    applied: int = 0
    ignored: int = 0
    protected: int = 0
    style: int = 0
    without: int = 0
    fonts: int = 0
    slides: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)


def is_style(m: Match) -> bool:
    """advice on style."""
    return any(k in m.category.upper() for k in STYLE["category"]) or any(k in m.rule.upper() for k in STYLE["rule"]) or any(k in m.message.casefold() for k in STYLE_WORDS)


def is_allowed(m: Match) -> bool:
    """an error of spelling, grammar or typography, and no advice."""
    return not is_style(m) and (m.issue in ISSUES or any(k in m.category.upper() for k in CATEGORIES) or any(k in m.rule.upper() for k in RULES))


def corrected_segment(text: str, check: Checker, terms: Iterable[str], told: Counts) -> str:
    """Allowed matches outside of protected ranges, the best option each, from right to left."""
    if not re.search(r"[^\W\d_]", text):
        return text
    safe, edits = ranges.protected_ranges(text, terms), []
    for m in check(text):
        end = m.start + m.length
        if is_style(m):
            told.style += 1
        elif not is_allowed(m):
            pass
        elif not m.options:
            told.without += 1
        elif any(m.start < b and end > a for a, b in safe):
            told.protected += 1
        else:
            new = ranges.best_replacement(text[m.start : end], m.options)
            if new != text[m.start : end]:
                edits.append((m.start, end, new))
            continue
        told.ignored += 1
    limit = len(text) + 1
    for a, b, new in sorted(edits, key=lambda e: (e[0], e[1]), reverse=True):
        if b > limit:
            told.ignored += 1
            continue
        text, limit = text[:a] + new + text[b:], a
        told.applied += 1
    return text


def corrected(text: str, check: Checker, terms: Iterable[str], told: Counts) -> str:
    """Line by line, line ends and soft breaks in their places."""
    return "".join(p if p in "\n\x0b" else corrected_segment(p, check, terms, told) for p in re.findall(r"[\n\x0b]|[^\n\x0b]+", text))


def language_text(text: str) -> str:
    """The text without technical spans, blanks collapsed."""
    chars = list(text)
    for a, b in ranges.protected_ranges(text):
        chars[a:b] = " " * (b - a)
    return " ".join("".join(chars).split())


def language(text: str, profiles=None, least: int = 300) -> tuple[str | None, str]:
    """French or English by function words, or why not."""
    clean = language_text(text)
    if len(clean) < least:
        return None, f"fewer than {least} useful characters"
    words = re.findall(r"\w+", clean.lower())
    found = sorted((-sum(w in set(ws) for w in words), name) for name, ws in (profiles or LANGUAGE_WORDS).items())
    if not found or not found[0][0]:
        return None, "language not found"
    return (found[0][1], "") if found[0][1] in ("fr", "en") else (None, f"language not supported: {found[0][1]}")


def paragraphs(root: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """Each paragraph once: of shapes, groups and table cells; parts of a merged cell that another one spans are empty."""
    skip = {id(p) for cell in root.iter(f"{_A}tc") if cell.get("hMerge") == "1" or cell.get("vMerge") == "1" for p in cell.iter(f"{_A}p")}
    return (p for p in root.iter(f"{_A}p") if id(p) not in skip)


def new_fonts(paragraph: ElementTree.Element, told: Counts, fonts: dict[str, str] = FONTS) -> bool:
    """Typefaces named in the runs."""
    changed = False
    for latin in (x for r in paragraph.findall(f"{_A}r") for x in r.iter(f"{_A}latin")):
        new = fonts.get((latin.get("typeface") or "").strip().casefold())
        if new and new != latin.get("typeface"):
            latin.set("typeface", new)
            told.fonts += 1
            changed = True
    return changed


def rebuilt(paragraph: ElementTree.Element, check: Checker, terms: Iterable[str], told: Counts) -> bool:
    """The paragraph's text corrected, each character in the style it had; true where something changed."""
    changed = new_fonts(paragraph, told)
    pieces = [e for e in paragraph if e.tag in (f"{_A}r", f"{_A}br")]
    text, styles, props = "", [], []
    for e in pieces:
        part = "\x0b" if e.tag == f"{_A}br" else "".join(t.text or "" for t in e.findall(f"{_A}t"))
        text += part
        styles += [len(props)] * len(part)
        props.append(e.find(f"{_A}rPr"))
    new = corrected(text, check, terms, told) if text.strip() else text
    if new == text:
        return changed
    at = list(paragraph).index(pieces[0])
    for e in pieces:
        paragraph.remove(e)
    for part, style in ranges.styled_runs(new, ranges.projected_styles(text, new, styles)):
        for bit in re.findall(r"\x0b|[^\x0b]+", part):
            e = ElementTree.Element(f"{_A}br" if bit == "\x0b" else f"{_A}r")
            if props[style] is not None:
                e.append(props[style])
            if bit != "\x0b":
                ElementTree.SubElement(e, f"{_A}t").text = bit
            paragraph.insert(at, e)
            at += 1
    return True


def correct_deck(data: bytes, checkers: Callable[[str], Checker], terms: Iterable[str] = (), detect=language, first: int = 5) -> tuple[str, str, Counts, bytes | None]:
    """(status, reason, counts, the new file where it changed): CORRECTED, UNCHANGED, SKIPPED or FAILED.

    The result is validated before it counts; a file that fails stays as it is.
    """
    told = Counts()
    reason = sources.pptx_status("x.pptx", data)
    if reason != "ok":
        return "SKIPPED", reason, told, None
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            parts = {i.filename: z.read(i) for i in z.infolist()}
        number = lambda n: int(re.findall(r"\d+", n)[-1])
        slides = sorted((n for n in parts if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number)
        texts = [t for n in slides[:first] for p in paragraphs(ElementTree.fromstring(parts[n])) if (t := "".join(x.text or "" for x in p.iter(f"{_A}t"))).strip()]
        found, reason = detect("\n".join(texts))
        if found is None:
            return "SKIPPED", reason, told, None
        check = checkers(found)
        for n in slides:
            for _, (prefix, uri) in ElementTree.iterparse(io.BytesIO(parts[n]), events=["start-ns"]):
                ElementTree.register_namespace(prefix, uri)
            root = ElementTree.fromstring(parts[n])
            if any([rebuilt(p, check, terms, told) for p in paragraphs(root)]):
                parts[n] = ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True)
            told.slides += 1
        if not told.applied and not told.fonts:
            return "UNCHANGED", "", told, None
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n, body in parts.items():
                z.writestr(n, body)
        if (bad := sources.pptx_status("x.pptx", out.getvalue())) != "ok":
            return "FAILED", bad, told, None
        return "CORRECTED", "", told, out.getvalue()
    except Exception as e:
        return "FAILED", f"{type(e).__name__}: {e}", told, None


_STATISTICS = "path string, status string, reason string, applied long, ignored long, protected long, style long, without long, fonts long, slides long"


def correct_decks(files: DataFrame, checkers: Callable[[str], Checker], terms: Iterable[str] = (), detect=language) -> DataFrame:
    """C14: of rows (path, content) the counts, and the new content where the deck changed."""
    terms = list(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[str, Checker] = {}
        cached = lambda lang: made[lang] if lang in made else made.setdefault(lang, checkers(lang))
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                status, reason, c, new = correct_deck(bytes(data), cached, terms, detect)
                rows.append((path, status, reason, c.applied, c.ignored, c.protected, c.style, c.without, c.fonts, c.slides, new))
            yield pd.DataFrame(rows, columns=[*(x.split()[0] for x in _STATISTICS.split(", ")), "content"])

    return files.select("path", "content").mapInPandas(run, f"{_STATISTICS}, content binary")


def summary(corrected_: DataFrame) -> DataFrame:
    """Files by status and the sums of corrections and fonts."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return corrected_.agg(F.count("*").alias("files"), *(count(s) for s in ("CORRECTED", "UNCHANGED", "SKIPPED", "FAILED")), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("applied", "ignored", "fonts")))


def replace_files(corrected_: DataFrame) -> DataFrame:
    """Each new deck is written beside its original and moved over it; (path, error)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            errors = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    files, at = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
                    with files.open_output_stream(part := f"{at}.part") as out:
                        out.write(bytes(data))
                    files.move(part, at)
                    errors.append(None)
                except Exception as e:
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": pdf["path"], "error": pd.Series(errors, dtype=object)})

    return corrected_.where("content is not null").select("path", "content").mapInPandas(run, "path string, error string")


def validated(decks: str, terms: str) -> None:
    """the folder and the file of terms must exist; all that is wrong is told at once."""
    from pathlib import Path

    wrong = [f"no folder of decks: {decks}"] * (not Path(decks).is_dir()) + [f"no file of terms: {terms}"] * (not Path(terms).is_file())
    if wrong:
        raise ValueError("; ".join(wrong))
