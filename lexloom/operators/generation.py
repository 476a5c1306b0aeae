"""Map, merge and reduce with a pluggable text generator (rows X1, P38, T13, T19-T21, C4, C6, C7, U1, U2, K7)."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.dialect import Spark
from .shared import by_steps

Generator = Callable[[str], str]


def extractive(prompt: str) -> str:
    """The offline stand-in: after the last ``TEXT:``, the first sentences with figures, else the first."""
    body = prompt.rpartition("TEXT:")[2]
    parts = [s.strip() for s in re.split(r"(?<=[!.?])\s+|\n+", body) if s.strip()]
    best = [s for s in parts if re.search(r"\d", s)][:3] or parts[:2]
    return "\n".join(map("- {}".format, best))


def answered(generate: Generator, prompt: str | None) -> str:
    """The answer; an error is one too, not the job's end."""
    try:
        return "" if prompt is None else generate(prompt)
    except Exception as e:
        return f"ERREUR {type(e).__name__}: {e}"


def generated(prompts: DataFrame, column: str, out: str, generate: Generator = extractive) -> DataFrame:
    """One call a row, by batches in the executors."""
    run = by_steps(lambda p: answered(generate, p), pa.string(), "string")
    return prompts.withColumn(out, run.asNondeterministic()(F.col(column)))


def folded_rows(df: DataFrame, fold, columns: list[str], out: str) -> DataFrame:
    """``out``: what ``fold`` makes, a list of strings, of the row's columns; for calls that depend on one another."""
    run = by_steps(fold, pa.list_(pa.string()), "array<string>")
    return df.withColumn(out, run.asNondeterministic()(F.struct(*columns)))


def bullet_list(x) -> Column:
    """The lines behind "- ", trimmed; others don't count."""
    lines = F.transform(F.split(tx.c(x), "\n"), lambda s: F.trim(s))
    return F.filter(F.transform(F.filter(lines, lambda s: s.startswith("- ")), lambda s: F.trim(F.regexp_replace(s, "^- ", ""))), lambda s: s != "")


def bullet_lines(x) -> Column:
    """Every line with text but NONE, cleaned."""
    lines = F.filter(F.transform(F.split(tx.c(x), "\n"), lambda s: F.trim(s)), lambda s: (s != "") & (F.upper(s) != "NONE"))
    bare = F.transform(lines, lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "^- ", ""), r"^\s*[-•*\d.)(]+\s*", ""), r"\s+", " "))
    return F.filter(F.transform(bare, lambda s: F.btrim(s, F.lit(" -•*"))), lambda s: s != "")


def lines_of(answer: str) -> list[str]:
    """T21 of one answer, in Python."""
    if answer.strip().upper() == "NONE":
        return []
    lines = (re.sub(r"\s+", " ", re.sub(r"^\s*[-•*\d.)(]+\s*", "", s.strip().removeprefix("- "))).strip(" -•*") for s in answer.split("\n") if s.strip().upper() != "NONE")
    return [s for s in lines if s]


bullets = bullet_lines


def two_sections(x) -> Column:
    """(numeric, ideas); a line with NUMERIC DATA starts the one, a heading with IDEAS the other."""
    zero = F.struct(F.lit("").alias("at"), F.array().cast("array<string>").alias("numeric"), F.array().cast("array<string>").alias("ideas"))

    def step(acc, s):
        at = F.when(F.contains(F.upper(s), F.lit("NUMERIC DATA")), F.lit("n")).when(s.startswith("#") & F.contains(F.upper(s), F.lit("IDEAS")), F.lit("i"))
        item = F.when(at.isNull() & s.startswith("- "), F.trim(F.regexp_replace(s, "^- ", "")))
        more = lambda name, here: F.when(item.isNotNull() & (acc["at"] == here), F.concat(acc[name], F.array(item))).otherwise(acc[name])
        return F.struct(F.coalesce(at, acc["at"]).alias("at"), more("numeric", "n").alias("numeric"), more("ideas", "i").alias("ideas"))

    return F.aggregate(F.transform(F.split(tx.c(x), "\n"), lambda s: F.trim(s)), zero, step)


def parted(answer: str) -> tuple[list[str], list[str]]:
    """T20 of one answer, in Python."""
    out: dict[str, list[str]] = {"n": [], "i": [], "": []}
    at = ""
    for s in map(str.strip, answer.split("\n")):
        if "NUMERIC DATA" in s.upper():
            at = "n"
        elif s.startswith("#") and "IDEAS" in s.upper():
            at = "i"
        elif s.startswith("- ") and s[2:].strip():
            out[at].append(s[2:].strip())
    return out["n"], out["i"]


def fused_extractive(prompt: str) -> str:
    """The offline stand-in for the fused calls: what the text has and the lists in the prompt don't."""
    head, _, body = prompt.rpartition("TEXT:")
    if "REVIEW" in head:
        return "\n".join(x for x in body.split("\n") if re.search(r"\d\D*[%a-zA-Z]", x)) or "NONE"
    parts = [s.strip() for s in re.split(r"(?<=[!.?])\s+|\n+", body) if s.strip()]
    numeric, ideas = ([s for s in parts if bool(re.search(r"\d", s)) == told][:2] for told in (True, False))
    listed = lambda xs: "\n".join(f"- {x}" for x in xs if f"- {x}\n" not in head) or "NONE"
    return f"### NUMERIC DATA\n{listed(numeric)}\n### IDEAS\n{listed(ideas)}"


def numeric_and_ideas(chunks: DataFrame, generate: Generator = fused_extractive, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, numeric, ideas): one call a chunk for both, a call that cleans the figures, then a check chunk by chunk.

    The check's lists grow (U2: what is in them isn't added again) and are told to the next call, so it
    is a fold over a document's chunks in order; documents are in parallel. Both lists come in one
    array, the figures first, their number before them.
    """
    asked = F.concat(F.lit("Extract sentences with meaningful figures, and all ideas, as two lists: ### NUMERIC DATA, ### IDEAS.\nTEXT:"), text)
    first = generated(chunks.withColumn("_p", asked), "_p", "_a", generate).withColumn("_s", two_sections("_a"))
    flat = lambda name: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", F.col(f"_s.{name}").alias("l")))), lambda s: s["l"]))
    per = first.groupBy(key).agg(flat("numeric").alias("_n"), flat("ideas").alias("_i"), F.array_sort(F.collect_list(F.struct("chunk", F.col(text).alias("text")))).alias("_chunks"))
    listed = F.array_join(F.transform("_n", lambda s: F.concat(F.lit("- "), s)), "\n")
    cleaned = generated(per.withColumn("_p", F.when(F.size("_n") > 0, F.concat(F.lit("REVIEW the list: remove sentences that are noise.\nTEXT:\n"), listed))), "_p", "_a", generate)
    cleaned = cleaned.withColumn("_n", F.when(F.upper(F.trim("_a")) == "NONE", F.array().cast("array<string>")).otherwise(bullet_list("_a")))

    def check(numeric, ideas, chunks_):
        numeric, ideas = list(numeric), list(ideas)
        for c in chunks_:
            lists = "".join(f"{name}:\n" + ("".join(f"- {x}\n" for x in xs) or "NONE\n") for name, xs in (("FIGURES FOUND", numeric), ("IDEAS FOUND", ideas)))
            more = parted(answered(generate, f"Which sentences with figures and which ideas are missing?\n{lists}Answer as ### NUMERIC DATA, ### IDEAS.\nTEXT:{c['text']}"))
            for have, new in zip((numeric, ideas), more):
                for x in new:
                    if x not in have:
                        have.append(x)
        return [str(len(numeric)), *numeric, *ideas]

    done = folded_rows(cleaned, check, ["_n", "_i", "_chunks"], "_all")
    n = F.col("_all")[0].cast("int")
    return done.select(key, F.slice("_all", F.lit(2), n).alias("numeric"), F.slice("_all", n + 2, F.size("_all")).alias("ideas"))


def fused_report(numeric: str = "numeric", ideas: str = "ideas") -> Column:
    """K7: Markdown, with a word for an empty section."""
    part = lambda head, c: F.concat(F.lit(f"## {head}\n\n"), F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda s: F.concat(F.lit("- "), s)), "\n")).otherwise("_None found._"), F.lit("\n"))
    return F.concat(part("Numeric data", numeric), F.lit("\n"), part("Ideas", ideas))


def ideas(chunks: DataFrame, generate: Generator = extractive, key: str = "doc_id", text: str = "text") -> DataFrame:
    """D3, U1 without plans: ideas of each chunk, then of its sentences in reverse, the first by key."""
    asked = chunks.withColumn("_p", F.concat(F.lit("List the distinct ideas as bullets.\nTEXT:"), text))
    first = generated(asked, "_p", "_a", generate).select(key, "chunk", F.posexplode(bullets("_a")).alias("pos", "idea"))
    again = chunks.withColumn("_p", F.concat(F.lit("List ideas that are still missing.\nTEXT:"), F.array_join(F.reverse(F.split(text, r"(?<=[!.?])\s+")), "\n")))
    second = generated(again, "_p", "_a", generate).select(key, "chunk", F.posexplode(bullets("_a")).alias("pos", "idea"))
    both = first.withColumn("pass", F.lit(1)).unionByName(second.withColumn("pass", F.lit(2)))
    both = both.withColumn("idea", tx.column(tx.idea, "idea")).withColumn("_k", F.expr(tx.idea_key(Spark, "idea"))).where("_k <> ''")
    best = both.groupBy(key, "_k").agg(F.min(F.struct("pass", "chunk", "pos", "idea")).alias("_b"))
    return best.select(key, "_b.*")


def summaries(chunks: DataFrame, generate: Generator = extractive, group: int = 6, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Notes by chunk, merged by groups of six, the merged ones into one answer a document."""
    notes = generated(chunks.withColumn("_p", F.concat(F.lit("Take notes.\nTEXT:"), text)), "_p", "note", generate)
    groups = notes.groupBy(key, F.floor(F.col("chunk") / group).alias("g")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "note"))), lambda s: s["note"]), "\n").alias("n"))
    merged = generated(groups.withColumn("_p", F.concat(F.lit("Merge the notes.\nTEXT:"), "n")), "_p", "m", generate)
    whole = merged.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "m"))), lambda s: s["m"]), "\n").alias("n"))
    out = generated(whole.withColumn("_p", F.concat(F.lit("Summarise.\nTEXT:"), "n")), "_p", "summary", generate)
    return out.select(key, F.when(F.trim("summary") == "", F.lit("ERREUR : résumé vide")).otherwise(F.col("summary")).alias("summary"))
