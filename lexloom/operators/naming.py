"""Titles, years and renames of document files (rows P19, P21, F32, W5, A15, A17, C10, C11, K15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.dialect import Spark
from . import dedup

UNKNOWN = "TITRE INCONNU"


def reliable(title: Column) -> Column:
    """F32."""
    t = F.trim(title)
    return title.isNotNull() & (F.length(t) >= 5) & (F.upper(t) != UNKNOWN) & ~F.upper(t).startswith("ERREUR")


def best_title(candidates: Column | str) -> Column:
    """The first reliable one of an array, else the first, else unknown."""
    cs = tx.c(candidates)
    return F.coalesce(F.try_element_at(F.filter(cs, reliable), F.lit(1)), F.try_element_at(cs, F.lit(1)), F.lit(UNKNOWN))


def document_year(metadata: Column, changed: Column, text: Column) -> Column:
    """From PDF metadata, else the file's change, else the latest year of the text not after now."""
    found = F.array_max(F.filter(tx.years(text), lambda y: y <= F.year(F.current_date())))
    return F.coalesce(tx.pdf_year(metadata), changed, found)


def complete_name(x) -> Column:
    """P19."""
    s = F.btrim(F.translate(F.trim(F.regexp_replace(tx.c(x), r"\s+", " ")), '\\/:*?"<>|', "_________"), F.lit(" ."))
    return F.when(F.lower(s).endswith(".pdf"), s).otherwise(F.concat(s, F.lit(".pdf")))


def plain_name(x) -> Column:
    """Lower case without accents, at most 180 characters, ``document`` where nothing is left."""
    s = F.left(F.lower(F.regexp_replace(F.expr(Spark.accents(x)), r"(?i)\.pdf$", "")), F.lit(180))
    return F.concat(F.when(F.length(s) > 0, s).otherwise(F.lit("document")), F.lit(".pdf"))


def rename_plan(files: DataFrame) -> DataFrame:
    """(path, old, title, year) -> (path, old, new, action); applying it is the driver's choice."""
    year = F.coalesce(F.col("year").cast("string"), F.lit("UNKNOWN"))
    named = files.withColumn("_y", year).withColumn("new", F.expr(tx.final_name(Spark, "_y", "title")))
    named = dedup.rank_names(named, "new", "old")
    action = F.when(~reliable(F.col("title")), "failed").when(F.col("new") == F.col("old"), "unchanged").otherwise("renamed")
    return named.select("path", "old", "new", action.alias("action"))


def counters(plan: DataFrame) -> DataFrame:
    """A15, A16."""
    return plan.groupBy("action").agg(F.count("*").alias("n"))
