"""Dictionary tagging and ontology classification (rows J1-J3, C1, A5-A8, A11)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.dialect import B, E, Spark


def tags(phrase: Column, dictionary: list[tuple[int, str, str, int]]) -> Column:
    """Per tag, in the dictionary's order, the first keyword that the phrase contains.

    The dictionary is a driver-side list, so this is an array of cases in one projection; there is
    no nested-loop join and no explosion of phrases.
    """
    by: dict[tuple[int, str], list[str]] = {}
    for order, tag, word, _ in sorted(dictionary, key=lambda r: (r[0], r[3])):
        by.setdefault((order, tag), []).append(word)
    found = [F.struct(F.lit(tag).alias("tag"), F.coalesce(*(F.when(F.contains(phrase, F.lit(w)), F.lit(w)) for w in words)).alias("word")) for (_, tag), words in by.items()]
    return F.filter(F.array(*found), lambda s: s["word"].isNotNull())


def tag_phrases(docs: DataFrame, dictionary, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Lines, folded to ASCII, with their tags and keywords joined by ``;``."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.select(key, "pos", tx.column(tx.ascii_fold, "line").alias("phrase")).where("phrase <> ''")
    lines = lines.withColumn("_t", tags(F.col("phrase"), dictionary))
    return lines.select(key, "pos", "phrase", F.array_join("_t.tag", ";").alias("tags"), F.array_join("_t.word", ";").alias("motcle"))


def tag_counts(tagged: DataFrame) -> DataFrame:
    """A11."""
    return tagged.where("tags <> ''").select(F.explode(F.split("tags", ";")).alias("tag")).groupBy("tag").agg(F.count("*").alias("count"))


def legacy_tags(docs: DataFrame, dictionary: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """J2, the older form: lines of ``#TAG,word,word`` in order, blank phrases too.

    A tag goes in only where it is no part of what has been put together so far, each tag with ``;``;
    words are looked for without, but listed with, blanks at their end; an empty word is in every phrase.
    """
    pairs = [(tag, word) for line in dictionary for tag, *words in [line.split(",")] for word in words]
    if not pairs:
        raise ValueError("an empty dictionary")
    known = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(w).alias("w"), F.lit(w.rstrip()).alias("b"), F.lit(t.rstrip()).alias("n")) for t, w in pairs))
    zero = F.struct(F.lit("").alias("tags"), F.lit("").alias("words"))

    def step(acc, k):
        new = F.contains(F.col("phrase"), k["b"]) & ~F.contains(acc["tags"], k["n"])
        return F.when(new, F.struct(F.concat(acc["tags"], k["t"], F.lit(";")).alias("tags"), F.concat(acc["words"], k["w"], F.lit(";")).alias("words"))).otherwise(acc)

    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).select(key, "pos", tx.column(tx.ascii_fold, "line").alias("phrase"))
    found = lines.withColumn("_f", F.aggregate(known, zero, step))
    cut = lambda c: F.left(c, F.greatest(F.lit(0), F.length(c) - 1))
    return found.select(key, "pos", "phrase", cut(F.col("_f.tags")).alias("tags"), cut(F.col("_f.words")).alias("motcle"))


def synonyms(x: str, rules: list[tuple[str, list[str]]], d=Spark) -> str:
    """Whole-word variants to their canonical form, one rule after the other."""
    for canonical, variants in rules:
        for v in variants:
            x = d.sub(x, rf"{B}{re.escape(v)}{E}", f"$1{canonical}$2")
    return x


def keyword_hits(d, x: str, words: list[str]) -> str:
    """How many of a category's keywords stand in the sentence as whole words."""
    return "(" + " + ".join(f"case when {d.held(x, w.split())}{d.match(x, B + r'\s+'.join(map(re.escape, w.split())) + E)} then 1 else 0 end" for w in words) + ")"


def keywords_found(words: list[str], x: str = "rewritten") -> Column:
    return F.array_join(F.array_compact(F.array(*(F.when(F.expr(keyword_hits(Spark, x, [w])) == 1, F.lit(w)) for w in words))), ",")


def classify(sentences: DataFrame, ontology, rules=(), least: int = 1, sentence: str = "sentence", multi: bool = True, most: int = 0) -> DataFrame:
    """The row with its normal form, scores of the categories found, and the dominant one.

    One projection over the sentence; categories are driver-side. Dominant is the highest score, then
    the first label; sentences without a category are ``unclassified``. Without ``multi`` only the
    dominant category counts (A8); ``most`` keeps the first sentences of a text alone, by ``pos`` (L1).
    Labels and keywords are told too (A6), the keywords of a category with commas.
    """
    if most:
        sentences = sentences.where(F.col("pos") < most)
    out = sentences.withColumn("normalized", tx.column(tx.ontology_normal, sentence))
    out = out.withColumn("rewritten", F.col("normalized"))
    for canonical, variants in rules:
        for v in variants:
            out = out.withColumn("rewritten", F.expr(f"case when {Spark.held('rewritten', [v])}true then {synonyms('rewritten', [(canonical, [v])])} else rewritten end"))
    hits = F.array(*(F.struct((-F.expr(keyword_hits(Spark, "rewritten", kws))).alias("s"), F.lit(label).alias("label"), F.lit(ident).alias("id"), keywords_found(kws).alias("kws")) for _, ident, label, kws in sorted(ontology)))
    out = out.withColumn("_hits", F.array_sort(F.filter(hits, lambda h: h["s"] <= -least)))
    if not multi:
        out = out.withColumn("_hits", F.slice("_hits", 1, 1))
    one = F.size("_hits") > 0
    return out.select(
        *sentences.columns, "normalized", "rewritten", F.when(one, F.array_join("_hits.id", ";")).otherwise("unclassified").alias("all_categories"),
        F.when(one, F.array_join(F.transform("_hits.s", lambda s: (-s).cast("string")), ";")).otherwise("0").alias("all_scores"),
        F.when(one, F.array_join("_hits.label", ";")).otherwise("Unclassified").alias("all_labels"), F.when(one, F.array_join("_hits.kws", ";")).otherwise("").alias("all_keywords"),
        F.coalesce(F.try_element_at("_hits", F.lit(1))["id"], F.lit("unclassified")).alias("dominant"), F.coalesce(-F.try_element_at("_hits", F.lit(1))["s"], F.lit(0)).alias("dominant_score"),
    )


def category_stats(classified: DataFrame, ontology) -> DataFrame:
    """Occurrences and share of sentences of every category, none found included, most frequent first."""
    spark = classified.sparkSession
    dim = spark.createDataFrame([(i, label) for _, i, label, _ in ontology] + [("unclassified", "Unclassified")], "category_id string, category_label string")
    marked = F.explode(F.array_append(F.split("all_categories", ";"), F.lit("")))  # "" counts the sentences
    counts = classified.select(marked.alias("category_id")).groupBy("category_id").agg(F.count("*").alias("occurrences"))
    dim = dim.unionByName(spark.createDataFrame([("", "")], "category_id string, category_label string"))
    met = dim.join(counts, "category_id", "left").withColumn("_n", F.max(F.when(F.col("category_id") == "", F.col("occurrences"))).over(W.partitionBy())).where("category_id <> ''")
    n = F.coalesce("occurrences", F.lit(0)).cast("long")
    return met.select("category_id", "category_label", n.alias("occurrences"), F.when(F.col("_n") > 0, n / F.col("_n")).otherwise(0.0).alias("share")).orderBy(F.desc("occurrences"), "category_label")
