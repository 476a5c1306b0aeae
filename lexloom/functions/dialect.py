"""Expressions written once as SQL text, for Spark and, in the oracles, for DuckDB.

Patterns keep to what Java's and RE2's regular expressions share: explicit letter classes instead of
word classes and boundaries, no lookaround.
"""

from __future__ import annotations

import re
import unicodedata



def _bare_letters() -> tuple[str, str]:
    """Letters with marks and the letters below them, by canonical decomposition; then the marks, which go.

    Of the basic plane; letters that decompose into several (Hangul syllables) stay.
    """
    marked, bare, marks = [], [], []
    for c in map(chr, range(0x80, 0x10000)):
        if unicodedata.category(c) == "Mn":
            marks.append(c)
        elif not 0xD800 <= ord(c) < 0xE000 and (left := "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")) != c and len(left) == 1 and left != "'":
            marked.append(c)
            bare.append(left)
    return "".join(marked + marks), "".join(bare)


_MARKED, _BARE = _bare_letters()

#: Inside a bracket: what belongs to a word.
WORD = r"\p{L}\p{N}_"
#: A boundary before and after a word; both may take one character.
B, E = rf"(^|[^{WORD}])", rf"($|[^{WORD}])"
BEHIND, AHEAD = rf"(?<![{WORD}])", rf"(?![{WORD}])"

#: A boundary before a list of plain words, and before digits.
_LISTS = re.compile(re.escape(B) + r"\(((?:[A-Za-zµ](?![?*+])[^()|\\\[\]*+]*)(?:\|[A-Za-zµ](?![?*+])[^()|\\\[\]*+]*)*)\)")
_NUMBERS = re.compile(re.escape(B) + r"(?=\\d)")
_STARTS = B.replace("\\", "\\\\")


def _first(found: re.Match) -> str:
    """The list with its words' first letters, in either case, before the boundary."""
    starts = sorted({c for w in found[1].split("|") for c in (w[0].lower(), w[0].upper() if w[0] != "µ" else "µ")})
    return f"(?=[{''.join(starts)}]){found[0]}"


class Spark:
    @staticmethod
    def lit(s: str) -> str:
        return 'r"' + s.replace('"', r"\x22") + '"'

    @classmethod
    def match(cls, x: str, p: str) -> str:
        """Whether ``p`` is found; boundaries, which only begin and end patterns, look instead of taking a character.

        Before one that begins a list of words or numbers, the next character is looked at, which is cheaper.
        """
        return f"rlike({x}, {cls.lit(_NUMBERS.sub(rf'(?=[0-9]){_STARTS}', _LISTS.sub(_first, p)).replace(B, BEHIND).replace(E, AHEAD))})"

    @classmethod
    def guarded(cls, x: str, p: str, sign: str) -> str:
        """``match`` for a pattern that is only found where the cheaper ``sign`` is; RE2 needs no such help."""
        return f"(rlike({x}, {cls.lit(sign)}) and {cls.match(x, p)})"

    @classmethod
    def held(cls, x: str, words: list[str]) -> str:
        """That ``x`` contains the words, cheaply, before a pattern that needs them is tried; ends in ``and``."""
        return "".join(f"contains({x}, {cls.lit(w)}) and " for w in words)

    @classmethod
    def count(cls, x: str, p: str) -> str:
        return f"regexp_count({x}, {cls.lit(p)})"

    @classmethod
    def sub(cls, x: str, p: str, to: str = "") -> str:
        return f"regexp_replace({x}, {cls.lit(p)}, {cls.lit(to)})"

    @classmethod
    def first(cls, x: str, p: str, group: int = 0) -> str:
        return f"nullif(regexp_extract({x}, {cls.lit(p)}, {group}), '')"

    @classmethod
    def all(cls, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {cls.lit(p)}, {group})"

    @staticmethod
    def accents(x: str) -> str:
        return f"translate({x}, '{_MARKED}', '{_BARE}')"


class Duck(Spark):
    @staticmethod
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    @classmethod
    def match(cls, x: str, p: str) -> str:
        return f"regexp_matches({x}, {cls.lit(p)})"

    @classmethod
    def guarded(cls, x: str, p: str, sign: str) -> str:
        return cls.match(x, p)

    @classmethod
    def held(cls, x: str, words: list[str]) -> str:
        return ""

    @classmethod
    def count(cls, x: str, p: str) -> str:
        return f"len(regexp_extract_all({x}, {cls.lit(p)}))"

    @classmethod
    def sub(cls, x: str, p: str, to: str = "") -> str:
        return f"regexp_replace({x}, {cls.lit(p)}, {cls.lit(to.replace('$', chr(92)))}, 'g')"

    @staticmethod
    def accents(x: str) -> str:
        return f"strip_accents({x})"


def any_word(*words: str) -> str:
    """A pattern for one of the words, whole."""
    return f"(?i){B}({'|'.join(words)}){E}"
