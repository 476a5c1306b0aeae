"""Scalar text functions (rows P1-P36): SQL for either dialect where both can, else Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import Spark

#: ASCII punctuation, as ``string.punctuation`` lists it.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACES = r"[ \t\n\x0B\f\r]"
#: Unusual spaces and dashes; P7: superscripts and subscripts.
UNUSUAL, USUAL = "\u00a0\u2009\u202f\u2212\u2013\u2014", "   ---"
SMALL, PLAIN = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻₀₁₂₃₄₅₆₇₈₉₊₋", "0123456789+-0123456789+-"
#: T5: tokens of the French alphabet; other letters part words.
FRENCH_TOKEN = "[a-zàâäçéèêëîïôöùûüÿñæœ0-9]+"


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ngram_normal(x) -> Column:
    """Lower case, apostrophes and ASCII punctuation to spaces, spaces collapsed and trimmed."""
    plain = F.translate(F.lower(c(x)), "’" + PUNCTUATION, " " * (len(PUNCTUATION) + 1))
    return F.trim(F.regexp_replace(plain, f"{SPACES}+", " "))


def squeeze(d, x):
    """Runs of white space to one space, trimmed."""
    return f"trim({d.sub(x, SPACES + '+', ' ')})"


def ascii_fold(d, x):
    """Lower case without accents, ligatures spelt out."""
    low = f"replace(replace(replace(lower({x}), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss')"
    return f"trim({d.accents(low)})"


def ontology_normal(d, x):
    """Lower case; all but letters, digits, spaces, apostrophe and hyphen to a space."""
    return squeeze(d, d.sub(f"lower({x})", r"[^\p{L}\p{N}_ \t\n\x0B\f\r'-]+", " "))


def line_normal(d, x):
    """P5: line ends unified, blanks collapsed, at most one empty line, trimmed."""
    s = d.sub(x, r"\r\n?", "\n")
    return d.sub(d.sub(d.sub(s, r"[ \t]+", " "), "\n\n\n+", "\n\n"), r"^[ \t\n]+|[ \t\n]+$", "")


def bullets_off(d, x):
    """P10: the bullet or number before a line, which also takes a leading number of the sentence."""
    return d.sub(x, r"^\s*[-•*\d.)(]+\s*", "")


def idea(d, x):
    """P11."""
    return d.sub(squeeze(d, bullets_off(d, x)), r"^[ •*-]+|[ •*-]+$", "")


def idea_key(d, x):
    """D3: the first 20 tokens of a-z and 0-9; other letters part them."""
    return f"array_to_string(list_slice({d.all(f'lower({x})', '[a-z0-9]+')}, 1, 20), ' ')" if d is not Spark else f"array_join(slice({d.all(f'lower({x})', '[a-z0-9]+')}, 1, 20), ' ')"


def numeric_key(d, x):
    """P14."""
    return squeeze(d, d.sub(f"lower({x})", "[−–—]", "-"))


def title_part(d, x, most: int = 100):
    """Extension off, forbidden signs to _, trimmed of spaces and dots, cut, trimmed."""
    s = squeeze(d, d.sub(x, r"(?i)\.(pdf|docx?|pptx?|xlsx?)$", ""))
    s = d.sub(d.sub(s, r"[\\/:*?\x22<>|]", "_"), r"^[ .]+|[ .]+$", "")
    return d.sub(f"left({s}, {most})", r"^[ .]+|[ .]+$", "")


def final_name(d, year, x):
    """``YEAR - TITLE.pdf``, upper case without accents."""
    return f"concat({year}, ' - ', upper(replace({d.accents(title_part(d, x))}, 'ß', 'ss')), '.pdf')"


def url_normal(d, x):
    """Without fragment and closing slashes."""
    return d.sub(d.sub(x, "#.*$", ""), "/+$", "")


def domain(d, x):
    """Host and port, lower case."""
    return f"lower(coalesce({d.first(x, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)}, ''))"


def url_filename(d, x):
    """Host without www., path and query, other signs and repeats of _ to one _, at most 180 characters."""
    host = f"replace({domain(d, x)}, 'www.', '')"
    path = d.sub(f"coalesce({d.first(x, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)}, '')", "^/+|/+$", "")
    query = f"left({d.sub(f"coalesce({d.first(x, '^[^?#]*[?]([^#]*)', 1)}, '')", r'[^\p{L}\p{N}_]', '_')}, 40)"
    name = d.sub(f"concat({host}, '_', {path}, '_', {query})", r"[^\p{L}\p{N}_.-]+", "_")
    return f"concat(left({d.sub(d.sub(name, '_+', '_'), '^_+|_+$', '')}, 180), '.html')"


def year_in(d, x):
    """The first 20xx that starts a word and ends one."""
    return f"cast({d.first(x, r'(^|[^\p{L}\p{N}_])(20\d\d)($|[^\p{L}\p{N}_])', 2)} as int)"


def video_id(d, x):
    """Of at least six signs; the short form, ``v=``, shorts and embeds, in this order."""
    return "coalesce(" + ", ".join(d.first(x, p + "([-0-9A-Z_a-z]{6,})", 1) for p in (r"youtu\.be/", "[?&]v=", "/shorts/", "/embed/")) + ")"


def column(f, x: str, *more) -> Column:
    return F.expr(f(Spark, x, *more))


def scientific(x) -> Column:
    """Super- and subscripts to ASCII, powers of ten written as ``10^n``."""
    s = F.translate(c(x), SMALL, PLAIN)
    s = F.regexp_replace(s, r"(?U)([x×])\s*10 *([+-]) *(\d+)(?![/\d])", r"$1 10^$2$3")
    return F.regexp_replace(s, r"(?U)(?<![\p{L}\p{N}])10 *([+-]) *(\d+)(?![/\d])", r"10^$1$2")


def document_normal(x) -> Column:
    """Dashes and spaces unified, then P5's line rules and P7."""
    s = F.translate(c(x), UNUSUAL, USUAL)
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "\r\n?", "\n"), r"[ \t]+", " "), "\n\n\n+", "\n\n")
    return F.btrim(scientific(s), F.lit(" \t\n\r"))


def markdown_off(x) -> Column:
    """Per line; headings stay as they are, table rules and images go, links and emphasis lose their signs."""

    def line(s):
        t = F.regexp_replace(s, r"!\[[^]]*][(][^)]*[)]", "")
        t = F.regexp_replace(t, r"\[([^]]+)][(][^)]*[)]", "$1")
        t = F.regexp_replace(F.regexp_replace(t, r"\*\*([^*]+)\*\*|__([^_]+)__", "$1$2"), r"\*([^*]+)\*", "$1")
        return F.when(s.rlike(r"^\s*#{1,6}\s"), s).otherwise(F.regexp_replace(t, "`([^`]+)`", "$1"))

    lines = F.filter(F.split(c(x), "\n"), lambda s: ~s.rlike(r"^\s*\|?[\s:|-]*-{3,}[\s:|-]*$"))
    return F.array_join(F.transform(lines, line), "\n")


ABBREVIATIONS = "al dr eq eqs fig figs inc jr ltd mr mrs ms no nos prof ref refs sr vs"


def protect_abbreviations(x) -> Column:
    """P12; ``restore_abbreviations`` undoes the mark."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(c(x), r"(?i)\bet al\.", "et al"), r"(?i)\be\.g\.", "eg"), r"(?i)\bi\.e\.", "ie")
    return F.regexp_replace(s, rf"(?i)\b({ABBREVIATIONS.replace(' ', '|')})\.", "$1<DOT>")


def restore_abbreviations(x) -> Column:
    return F.replace(c(x), F.lit("<DOT>"), F.lit("."))


def numeric_sentence(x) -> Column:
    """P13."""
    s = F.regexp_replace(F.regexp_replace(document_normal(x), r"\(\s+", "("), r"\s+\)", ")")
    s = F.btrim(F.regexp_replace(s, r"\s+", " "), F.lit(" -•\t;,"))
    return F.trim(F.regexp_replace(s, r"(?i)^\s*(refs?\.?|\d+\.|\[\d[\d, ]*\])\s+", ""))


def urls(x) -> Column:
    """P32."""
    return F.regexp_extract_all(c(x), F.lit(r"https?://\S+"), F.lit(0))


def url_line(x) -> Column:
    """A line of URLs alone keeps each once, in order; other lines stay."""
    return F.when(c(x).rlike(r"^\s*(https?://\S+\s*)+$"), F.array_join(F.array_distinct(urls(x)), " ")).otherwise(c(x))


def model_title(x) -> Column:
    """P20: the first line with text, unquoted, without a lead-in, as a title part; else a default."""
    line = F.regexp_extract(c(x), r"(?m)^\s*(\S.*?)\s*$", 1)
    line = F.btrim(line, F.lit(" \"'«»“”`"))
    line = F.regexp_replace(line, r"(?i)^(le )?(titre|title)( du document| of the document| est| is)?\s*[:=-]\s*", "")
    done = F.left(F.btrim(F.translate(F.regexp_replace(F.btrim(line, F.lit(" \"'«»“”`")), r"(?i)\.(pdf|docx?|pptx?|xlsx?)$", ""), '\\/:*?"<>|', "_________"), F.lit(" .")), F.lit(100))
    return F.when(F.length(done) > 0, done).otherwise(F.lit("TITRE INCONNU"))


def pdf_year(x) -> Column:
    """P23."""
    return F.coalesce(F.nullif(F.regexp_extract(c(x), r"\b((19|20)\d{2})\b", 1), F.lit("")), F.nullif(F.regexp_extract(c(x), r"D:(\d{4})", 1), F.lit(""))).cast("int")


def years(x) -> Column:
    """P24."""
    return F.transform(F.regexp_extract_all(c(x), F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))


def number_suffix(x) -> Column:
    """Null (last in an ascending order with nulls last) where there is none."""
    return F.nullif(F.regexp_extract(c(x), r"(\d+)[.][^.]+$", 1), F.lit("")).cast("long")
