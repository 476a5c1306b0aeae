"""From raw documents to a training mix: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents, extra ones too;
these travel under names of their own, so none can clash with an operator's. A stage drops whole
rows only, but for the passages that decontamination cuts out.

Rows with nulls in any column, empty and very long texts pass like others: a null text is an empty
one to every operator and stays null. Repeated rows are one document to exact_dedup; a doc_id over
several texts is one document to near_dedup. Ties go to the smallest doc_id, null ones last. Empty
tables give empty results, an empty labels table rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import decontaminate, exact_dedup, minhash_dedup, mixing, quality
from lexloom.llm.common import table, written


def _packed(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """doc_id, text and source as they are, and every column under a name of our own."""
    carry = tuple(f"_keep_{i}" for i in range(len(docs.columns)))
    return docs.select("doc_id", "text", "source", *(F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, carry))), carry


def _unpacked(df: DataFrame, carry: tuple[str, ...], names: list[str], *more: str) -> DataFrame:
    return df.select(*(F.col(k).alias(c) for k, c in zip(carry, names)), *more)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Without labelled documents none is rejected."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    if model is None:
        return docs
    packed, carry = _packed(docs)
    return _unpacked(quality.score(packed, model, carry=carry).where("predicted = 1"), carry, docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    packed, carry = _packed(docs)
    return _unpacked(exact_dedup.dedup(packed, carry=carry).where("kept"), carry, docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (five-word shingles, 80 %) the smallest doc_id stays."""
    gone = minhash_dedup.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; passages below the coverage limit are cut out of the others' texts."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix with size, source_size, target, taken (words the mix takes) and first_slot."""
    packed, carry = _packed(docs)
    more = ("size", "source_size", "target", "taken", "first_slot")
    mixed = mixing.mix(packed, carry=carry).where("taken > 0")
    names = [c if c.lower() not in more else f"document_{c}" for c in docs.columns]
    return _unpacked(mixed, carry, names, *more)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mixing", mixing_stage),
]

#: A trained classifier can't be told in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
