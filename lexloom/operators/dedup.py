"""Order-preserving deduplication (rows D1-D4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .shared import ranked


def first_rows(df: DataFrame, key: Column | str, order: list, by: list[str] | None = None) -> DataFrame:
    """Keeps the first row of each key in the given order; partial aggregation, no window.

    ``min`` of (order, row) is combined on the map side, so a hot key doesn't gather in one task.
    """
    names = df.columns
    keyed = df.withColumn("_key", tx.c(key))
    best = keyed.groupBy(*(by or []), "_key").agg(F.min(F.struct(*(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)), F.struct(*names).alias("_row"))).alias("_b"))
    return best.select("_b._row.*")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """D1 within each document: blank lines go, URL lines are made distinct, then first lines stay."""
    every = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).where(~F.col("line").rlike(r"^[ \t\r\f\x0B]*$"))
    return first_rows(every.withColumn("line", tx.url_line("line")), "line", ["pos"], [key])


def best_of(df: DataFrame, key: Column | str, score: str, text: str, by: list[str]) -> DataFrame:
    """Per key the highest score, then the longest, then the earliest; at the first position."""
    keyed = df.withColumn("_key", tx.c(key))
    best = keyed.groupBy(*by, "_key").agg(F.min("pos").alias("_first"), F.min(F.struct((-F.col(score)).alias("a"), (-F.length(text)).alias("b"), F.col("pos").alias("c"), F.col(text).alias("t"))).alias("_b"))
    return best.select(*by, F.col("_first").alias("pos"), F.col("_b.t").alias(text), (-F.col("_b.a")).alias(score))


def rank_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Conflicting names get _2, _3, … before the extension, in the given order; also a name that most rows have."""
    stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"\.[^.]*$", 0)
    out = ranked(df, [name], [order], "_n")
    return out.withColumn(name, F.when(F.col("_n") > 1, F.concat(stem, F.lit("_"), F.col("_n").cast("string"), ext)).otherwise(F.col(name))).drop("_n")
