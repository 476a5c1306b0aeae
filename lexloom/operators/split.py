"""Splitting into sentences, blocks and greedy chunks (rows T1-T24). Every row carries its position."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .shared import by_steps


def posed(df: DataFrame, pieces: Column, name: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(pieces).alias("pos", name))


def sentences(x) -> Column:
    """At white space after . ! ? and at line ends; trimmed, at least two characters."""
    parts = F.split(tx.c(x), r"(?<=[.!?])[ \t\n\x0B\f\r]+|\n+")
    return F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(" \t\n\r\f\x0b"))), lambda s: F.length(s) >= 2)


def paragraphs(x, least: int = 1) -> Column:
    """At empty lines, trimmed."""
    return F.filter(F.transform(F.split(tx.c(x), r"\n\n"), lambda s: F.btrim(s, F.lit(" \t\n\r"))), lambda s: F.length(s) >= least)


def blocks(x, size: int = 1200, least: int = 200) -> Column:
    """Blocks of ``size`` characters, trimmed."""
    x = tx.c(x)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(x) - 1) / size).cast("int"))), lambda i: F.btrim(F.substring(x, i * size + 1, F.lit(size)), F.lit(" \t\n\r")))
    return F.filter(cut, lambda s: F.length(s) >= least)


def topic_chunks(x) -> Column:
    """Paragraphs, or blocks where fewer than three are long enough."""
    ps = paragraphs(x, 200)
    return F.when(F.size(ps) >= 3, ps).otherwise(blocks(x))


def basic_sentences(x) -> Column:
    """At white space after . ! ?, trimmed, empty ones out."""
    return F.filter(F.transform(F.split(tx.c(x), r"(?<=[.!?])[ \t\n\x0B\f\r]+"), lambda s: F.btrim(s, F.lit(" \t\n\r\f\x0b"))), lambda s: F.length(s) > 0)


def line_segments(x) -> Column:
    """The parts between line ends and soft line breaks, and these, in order."""
    return F.regexp_extract_all(tx.c(x), F.lit(r"[\n\x0B]|[^\n\x0B]+"), F.lit(0))


def numeric_sentences(x) -> Column:
    """After . ! ? ; where the next starts with a capital, a digit or a bracket; abbreviations hold."""
    ps = F.split(tx.protect_abbreviations(tx.document_normal(x)), r"\n{2,}")
    cut = F.flatten(F.transform(ps, lambda p: F.split(F.regexp_replace(p, "\n", " "), r"(?<=[.!?;])\s+(?=[\p{Lu}\d(\[])")))
    return F.filter(F.transform(cut, lambda s: F.trim(F.replace(s, F.lit("<DOT>"), F.lit(".")))), lambda s: F.length(s) > 0)


def pack_paragraphs(parts: list[str], most: int = 7000) -> list[str]:
    """Greedy packing by characters (two more a paragraph); too long ones are cut after a flush."""
    out, held, size = [], [], 0
    for p in parts:
        if len(p) > most:
            if held:
                out.append("\n\n".join(held))
            held, size = [], 0
            out += [p[i : i + most] for i in range(0, len(p), most)]
        else:
            if held and size + len(p) + 2 > most:
                out.append("\n\n".join(held))
                held, size = [], 0
            held.append(p)
            size += len(p) + 2
    return out + (["\n\n".join(held)] if held else [])


def pack_words(parts: list[str], most: int = 1000) -> list[str]:
    """Greedy packing by words; too long paragraphs are cut by words after a flush."""
    out, held, size = [], [], 0
    for p in parts:
        ws = p.split()
        if held and size + len(ws) > most:
            out.append("\n\n".join(held))
            held, size = [], 0
        if len(ws) > most:
            out += [" ".join(ws[i : i + most]) for i in range(0, len(ws), most)]
        else:
            held.append(p)
            size += len(ws)
    return out + (["\n\n".join(held)] if held else [])


def pack_lines(lines: list[str], most: int = 1600, least: int = 350) -> list[str]:
    """Greedy packing of lines with text by words, then chunks below ``least`` words merge forward."""
    import re

    count = lambda s: len(re.findall(r"\w+", s))
    first, held, size = [], [], 0
    for x in filter(None, map(str.strip, lines)):
        n = count(x)
        if held and size + n > most:
            first.append("\n".join(held))
            held, size = [], 0
        held.append(x)
        size += n
    first += ["\n".join(held)] if held else []
    out, buffer = [], ""
    for x in first:
        buffer = f"{buffer}\n{x}" if buffer else x
        if count(buffer) >= least:
            out.append(buffer)
            buffer = ""
    return out + ([buffer] if buffer else [])


def split_by_size(lines: list[str], hint: int = 2_000_000) -> list[str]:
    """Lines until their characters reach the hint, then a new part."""
    out, held, size = [], [], 0
    for x in lines:
        held.append(x)
        size += len(x)
        if size >= hint:
            out.append("".join(held))
            held, size = [], 0
    return out + (["".join(held)] if held else [])


def folded(fold, x: Column, *args) -> Column:
    """A greedy fold over each row's array of strings, as an Arrow UDF."""
    return by_steps(lambda v: None if v is None else fold(list(v), *args), pa.list_(pa.string()), "array<string>")(x)


ABSTRACTS = ("abstract", "résumé", "summary")


def headed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The lines with text of Markdown documents with what the headings so far make of them.

    Columns: ``key``, pos, line, level (0: no heading), name, kind of the last heading (title, abstract,
    section, sub), title, sec (sections opened so far), sub (subsections of it), section, subsection.
    """
    from pyspark.sql import Window as W

    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", F.btrim("line", F.lit(" \t\r\f\x0b"))).where("line <> ''")
    lines = lines.withColumn("level", F.length(F.regexp_extract("line", r"^(#{1,6})\s+\S", 1))).withColumn("name", F.btrim(F.regexp_replace("line", r"^#{1,6}\s+", ""), F.lit(" \t")))
    run = W.partitionBy(key).orderBy("pos")
    head = F.col("level") > 0
    lines = lines.withColumn("_heads", F.sum(head.cast("int")).over(run))
    own = F.when(head & (F.col("_heads") == 1), "title").when(head & F.lower("name").isin(*ABSTRACTS), "abstract").when(head & (F.col("level") <= 2), "section").when(head, "sub")
    lines = lines.withColumn("_own", own).withColumn("kind", F.last("_own", ignorenulls=True).over(run))
    lines = lines.withColumn("title", F.first(F.when(head, F.col("name")), ignorenulls=True).over(run)).withColumn("sec", F.sum((F.col("_own") == "section").cast("int")).over(run))
    lines = lines.withColumn("sec", F.coalesce("sec", F.lit(0))).withColumn("section", F.coalesce(F.last(F.when(F.col("_own") == "section", F.col("name")), ignorenulls=True).over(run), F.lit("Untitled section")))
    inner = W.partitionBy(key, "sec").orderBy("pos")
    lines = lines.withColumn("sub", F.coalesce(F.sum((F.col("_own") == "sub").cast("int")).over(inner), F.lit(0)))
    return lines.withColumn("subsection", F.last(F.when(F.col("_own") == "sub", F.col("name")), ignorenulls=True).over(inner)).drop("_heads", "_own")


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The body lines of Markdown documents with title, section and subsection carried forward.

    The first heading of any level is the title. A heading that says abstract opens the abstract, one
    of level 1 or 2 a section, a deeper one a subsection; lines before any of these are lost.
    """
    body = headed(docs, key, text).where((F.col("level") == 0) & F.col("kind").isin("abstract", "section", "sub"))
    is_abstract = F.col("kind") == "abstract"
    return body.select(
        key, "pos", "title", F.when(is_abstract, "Abstract").otherwise(F.col("section")).alias("section"), F.when(F.col("kind") == "sub", F.col("subsection")).alias("subsection"), is_abstract.alias("is_abstract"), "line",
    )
