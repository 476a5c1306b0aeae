"""Extraction of numeric facts (rows T18, C2, C3, J8, F31, L2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions import text as tx
from . import dedup, shared, split


def merge_broken(sentences: Column) -> Column:
    """A fold; the sentence so far is tested again with each next one."""
    has = lambda s: s.rlike(p.NUMBER)
    open_ = lambda s: (F.length(s) < 30) | s.rlike(r"[(,:;\[]\s*$") | s.rlike(r"(?i)^(but|and|or|including|such as|while|whereas|with) ") | s.rlike(r"(?i)\b(including|that|where|whereas|which|while|compared with|respectively)\s*$")
    goes_on = lambda s: s.rlike(r"^\p{Ll}|^[)\],;:%]") | s.rlike(r"(?i)^(but|and|or|including|respectively|while|whereas|with) ")

    def step(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        joins = last.isNotNull() & ((has(last) & open_(last)) | (has(s) & goes_on(s)) | (has(last) & has(s) & (F.length(last) < 45)))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws(" ", last, s)))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(sentences, F.array().cast("array<string>"), step)


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Numeric sentences of each paragraph, without layout, metadata, dates and references."""
    parts = docs.select(key, F.posexplode(split.paragraphs(text)).alias("para", "paragraph")).where(F.col("paragraph").rlike("[0-9]"))
    rows = parts.select(key, "para", F.posexplode(merge_broken(split.numeric_sentences("paragraph"))).alias("pos", "_raw"))
    rows = rows.withColumn("sentence", tx.numeric_sentence("_raw")).drop("_raw").where("sentence <> ''")
    flag = lambda f: p.column(f, "sentence")
    return rows.where(flag(p.number) & ~flag(p.layout_fragment) & ~flag(p.metadata) & ~flag(p.date_only) & ~flag(p.reference_fragment))


def uncovered_lines(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Numeric lines of the paragraphs that hold no sentence found so far (of 25 characters).

    An anti-join within the document, so both sides are shuffled by ``key`` alone.
    """
    keys = found.where(F.length("sentence") >= 25).groupBy(key).agg(F.collect_set(tx.column(tx.numeric_key, "sentence")).alias("_keys"))
    parts = docs.select(key, F.posexplode(split.paragraphs(text)).alias("para", "paragraph")).where(F.col("paragraph").rlike("[0-9]")).withColumn("_p", tx.column(tx.numeric_key, "paragraph"))
    rest = parts.join(keys, key, "left").where(~F.coalesce(F.exists("_keys", lambda k: F.contains("_p", k)), F.lit(False)))
    rows = rest.select(key, "para", F.posexplode(F.split("paragraph", "\n")).alias("pos", "_raw")).withColumn("sentence", tx.numeric_sentence("_raw")).drop("_raw")
    flag = lambda f: p.column(f, "sentence")
    return rows.where(flag(p.number) & ~flag(p.layout_fragment) & ~flag(p.metadata) & ~flag(p.date_only) & ~flag(p.page_counter) & ~flag(p.caption) & ~flag(p.journal))


def numeric_facts(docs: DataFrame, least: int = 1, top: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Both passes, scored, the best of each text kept at its first place, at most ``top`` a document."""
    one = shared.cut(candidates(docs, key, text))  # both passes use it
    both = one.withColumn("_pass", F.lit(0)).unionByName(uncovered_lines(docs, one, key, text).withColumn("_pass", F.lit(1)))
    both = both.withColumn("pos", F.row_number().over(W.partitionBy(key).orderBy("_pass", "para", "pos"))).withColumn("score", p.column(p.score, "sentence"))
    best = dedup.best_of(both.where(F.col("score") >= least), tx.column(tx.numeric_key, "sentence"), "score", "sentence", [key])
    rank = F.row_number().over(W.partitionBy(key).orderBy("pos"))
    return best.withColumn("pos", rank).where(F.col("pos") <= top)
