"""Licence recognition by sentence rules.

A text is cut into pieces at line ends and sentence marks; a piece, or a run of pieces that only
line ends, colons and semicolons of one paragraph part, is normalised and looked up among known
licence sentences (texts, headers, notices and tags of 47 licences, see ``licenses``), so
that wrapped texts and comments are read too. The sequence of identifiers is then matched against
ordered rules, the first match of each licence counting; a licence whose text another one found
contains doesn't count.

Null and empty texts match nothing; a sentence that occurs twice is listed twice, and of readings
that begin at one piece the longest counts. Repeated rows are matched each; extra columns don't
matter; very long texts are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, utf8
from .licenses import CONTAINS, RULES, known, normalise

KNOWN = known()
_CUT = re.compile(r"(?<=[.!?:;])[\x20\t\r\f\v]+")
_COMMENT = re.compile(r"^[\x20\t]*(?:dnl|rem)(?=[\x20\t\r]|$)")


def prefixes_of(sentences) -> set[str]:
    """The known sentences' beginnings, by words."""
    return {" ".join(ws[:n]) for ws in map(str.split, sentences) for n in range(1, len(ws) + 1)}


def identify(text: str, sentences: dict[str, str], triggers: tuple[str, ...], prefixes: set[str]) -> list[str]:
    """Identifiers of the known sentences of a text, in order."""
    low = text.lower()
    if not any(t in low for t in triggers):
        return []
    pieces, ended = [], []  # ended: no sentence goes on behind the piece
    for line in low.split("\n"):
        bare = _COMMENT.sub("", line)
        some = False
        for reading in _CUT.split(bare):
            if piece := normalise(reading):
                some = True
                pieces.append(piece)
                ended.append(reading.rstrip()[-1] in ".!?")
        if not some and ended:
            ended[-1] = True  # a line without words ends a paragraph
    out = []
    for i, run in enumerate(pieces):
        found, at = None, i
        while run in prefixes:
            found = sentences.get(run, found)
            if ended[at] or at + 1 == len(pieces):
                break
            at += 1
            run += " " + pieces[at]
        if found:
            out.append(found)
    return out


def match(ids: list[str], rules=RULES, contains=CONTAINS) -> list[tuple[str, str]]:
    """(rule, licence) of the first rule of each licence whose identifiers occur in order."""
    out, seen = [], set()
    for rule, licence, wanted in rules if ids else ():
        rest = iter(ids)
        if licence not in seen and all(w in rest for w in wanted):
            seen.add(licence)
            out.append((rule, licence))
    inner = {x for licence in seen for x in contains.get(licence, ())}
    return [(r, x) for r, x in out if x not in inner]


def triggers_of(sentences) -> tuple[str, ...]:
    """A few words one of which each known sentence holds, so that most texts need no cutting."""
    left, out = [set(s.split()) for s in sentences], []
    while left:
        count: dict[str, int] = {}
        for s in left:
            for w in s:
                count[w] = count.get(w, 0) + 1
        best = max((w for w in count if w.isalpha() and len(w) >= 3), key=lambda w: (len(w) * count[w], w))
        out.append(best)
        left = [s for s in left if best not in s]
    return tuple(w for w in out if not any(v != w and v in w for v in out))


def scan(docs: DataFrame, sentences: dict[str, str] = KNOWN, rules=RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, sentence_ids and rules and licenses as arrays in order of text and rules.

    ``sentences``: normal form -> identifier.
    """
    triggers, prefixes = triggers_of(sentences), prefixes_of(sentences)

    def make():
        def work(ids, texts):
            found = [identify(t.decode("utf-8", "replace"), sentences, triggers, prefixes) for t in texts]
            hits = [match(f, rules) for f in found]
            return ids, found, [[r for r, _ in h] for h in hits], [[x for _, x in h] for h in hits]

        return work

    kept = docs.select(F.col(key), utf8(text))
    return map_rows(kept, make, f"{key} {kept.schema[key].dataType.simpleString()}, sentence_ids array<string>, rules array<string>, licenses array<string>")
