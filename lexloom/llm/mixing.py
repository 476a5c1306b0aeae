"""Mixing sources to target weights by a low-discrepancy schedule.

Targets are found by filling up: sources share all tokens by weight, none above ``most`` times its
own size, the excess shared again. Sources whose targets have equally many hexadecimal digits form a
tier, so that none of a tier is over 16 times another, and a tier has blocks of equally many tokens,
at least FINE of them in its smallest target. Slot n of a tier has the point n * golden ratio mod 1;
the source whose interval of cumulative targets holds the point gets the slot. Slots are ranked
within their source, and rank r takes block r of the source's documents, shuffled by a hash and cut
into blocks end to end, in the pass over them that r divided by the number of blocks tells; ranks
beyond ``most`` passes go. What a document gives is what its tokens' blocks are taken. So a source's
tokens come within a few blocks (a golden-ratio interval misses by fewer than three slots, a last
block is smaller) of its target. Read in the order of ``at``, all tiers' slots are one mix, any
beginning of which has the sources in proportion.

Nulls in the text count 0 tokens; the null source comes last. Repeated rows are documents of their
own. Empty tables give empty results; a source of size 0 has target 0. Very long texts span blocks.
Extra columns travel under names of their own. All is DataFrame work: the prefix sums of the shuffled
documents are taken per source and hash bucket, so that a hot source is spread over ``16 ** HEX``
windows; a source has fewer than 32 * FINE slots, whatever the input. The windows without a
partition see one row a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, written

FINE = 1024
GOLDEN = 2654435769  # the golden ratio's fraction times 2 ** 32
HEX = 3
#: Rows of the slots' table that are broadcast at most.
BROADCAST_ROWS = 200_000
_CHUNK = 1 << 16


def sized(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    size = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    name = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    return docs.select(F.col(key).alias("_id"), size.alias("_size"), name.alias("_source"), F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("_hash"), *(F.col(c).alias(f"_c_{c}") for c in carry))


def targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """Per source: its size and target. The unpartitioned windows see one row a source."""
    per = sizes.groupBy("_source").agg(F.sum("_size").alias("_total"))
    per = per.withColumn("_w", (F.row_number().over(W.orderBy("_source")) - 1) % 3 + 1).withColumn("_r", most * F.col("_total") / F.col("_w"))
    before = W.orderBy("_r", "_source").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    left = F.sum("_total").over(whole) - F.coalesce(most * F.sum("_total").over(before), F.lit(0))
    level = left / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    per = per.withColumn("_level", level)
    per = per.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_r"), F.struct(F.col("_r"), F.col("_source"), F.col("_level")))).over(whole)["_level"])
    per = per.withColumn("_target", F.least((most * F.col("_total")).cast("double"), F.col("_level") * F.col("_w")))
    return per.select("_source", "_total", "_w", "_target").withColumn("_need", F.least(F.floor(F.col("_target") + 0.5), most * F.col("_total")))


def tiers(per: DataFrame, fine: int = FINE) -> DataFrame:
    """``targets`` with a need: _tier, _block (tokens), _n (slots), and the source's interval [_lo, _hi) of 2 ** 32 points."""
    run = W.partitionBy("_tier").orderBy("_source").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("_tier")
    rows = per.where("_need > 0").withColumn("_tier", F.length(F.hex("_need")))
    rows = rows.withColumn("_block", F.greatest(F.lit(1), F.floor(F.min("_need").over(whole) / fine))).withColumn("_all", F.sum("_need").over(whole))
    rows = rows.withColumn("_to", F.sum("_need").over(run)).withColumn("_sources", F.count("*").over(whole))
    span = F.lit(2.0**32)
    return rows.select(
        "_tier", "_source", "_total", "_need", "_block", F.expr("(2 * _all + _block) div (2 * _block)").alias("_n"), "_sources",
        F.floor((F.col("_to") - F.col("_need")) / F.col("_all") * span).alias("_lo"), F.floor(F.col("_to") / F.col("_all") * span).alias("_hi"),
    )


def schedule(per: DataFrame, most: int = 3, fine: int = FINE) -> DataFrame:
    """One row a slot: _tier, slot, at (0 to 1, the order of the mix), _source, rank, block and pass.

    ``per`` needs _source, _total and _need. Points meet intervals by an equi-join on cells as wide
    as a tier's mean interval, each of which has at most 17 sources.
    """
    rows = tiers(per, fine)
    width = F.greatest(F.lit(1), F.expr("4294967296 div _sources"))
    cells = rows.where("_hi > _lo").withColumn("_cell", F.explode(F.sequence(F.expr("_lo div greatest(1, 4294967296 div _sources)"), F.expr("(_hi - 1) div greatest(1, 4294967296 div _sources)"))))
    chunks = rows.groupBy("_tier").agg(F.max("_n").alias("_slots"), F.max(width).alias("_width"))
    chunks = chunks.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_slots - 1) div {_CHUNK}"))))
    chunks = chunks.repartition(int(per.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # so that no one task makes all slots
    points = chunks.select("_tier", "_width", F.explode(F.sequence(F.expr(f"_c * {_CHUNK}"), F.expr(f"least(_slots, (_c + 1) * {_CHUNK}) - 1"))).alias("slot"))
    point = F.expr(f"(((slot div 65536) * {GOLDEN}L % 4294967296L) * 65536 + (slot % 65536) * {GOLDEN}L) % 4294967296L")  # slot * GOLDEN, without overflow
    points = points.withColumn("_p", point).withColumn("_cell", F.expr("_p div _width"))
    hit = points.join(cells, ["_tier", "_cell"]).where("_p >= _lo and _p < _hi")
    hit = hit.withColumn("rank", F.row_number().over(W.partitionBy("_source").orderBy("slot")) - 1).withColumn("_blocks", F.expr("(_total + _block - 1) div _block"))
    hit = hit.where(F.col("rank") < most * F.col("_blocks"))
    at = (F.col("slot") + 0.5) / F.col("_n")
    return hit.select("_tier", "slot", at.alias("at"), "_source", F.col("rank").cast("long").alias("rank"), F.expr("rank % _blocks").alias("block"), F.expr("rank div _blocks").alias("pass"), F.col("_block").alias("tokens"))


def _taken_blocks(slots: DataFrame) -> DataFrame:
    """Per (_source, block) with slots: _times, _first (its first slot), _upto (tokens taken of the blocks before it)."""
    times = slots.groupBy("_source", "block").agg(F.count("*").alias("_times"), F.min("slot").alias("_first"), F.first("tokens").alias("_b"))
    before = W.partitionBy("_source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return times.withColumn("_upto", F.coalesce(F.sum(F.col("_times") * F.col("_b")).over(before), F.lit(0)))


def _streams(per: DataFrame, rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """``rows`` with _start and _end, their tokens' places in the shuffled stream of their source, and _total, _target, _tokens (of a block)."""
    bucket = F.substring("_hash", 1, HEX).alias("_bucket")
    parts = narrow.groupBy("_source", bucket).agg(F.sum("_size").alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("_source", "_bucket", F.coalesce(before, F.lit(0)).alias("_before")).join(per, "_source")
    rows = rows.withColumn("_bucket", bucket)
    inner = W.partitionBy("_source", "_bucket").orderBy("_hash", "_id", "_size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.coalesce(F.sum("_size").over(inner), F.lit(0))).join(parts, ["_source", "_bucket"])
    return rows.withColumn("_start", F.col("_before") + F.col("_at")).withColumn("_end", F.col("_start") + F.col("_size"))


def _planned(docs: DataFrame, most: int, fine: int, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The narrow rows, the sources with targets and block sizes, and the slots."""
    narrow, _ = written(sized(docs, key=key), "sizes")
    per, _ = written(targets(narrow, most), "targets")
    slots, _ = written(schedule(per, most, fine), "slots")
    per = per.join(tiers(per, fine).select(F.col("_source").alias("_s"), F.col("_block").alias("_tokens")), F.col("_source") == F.col("_s"), "left").drop("_s")
    return narrow, per.withColumn("_tokens", F.coalesce("_tokens", F.lit(1).cast("long"))), slots


def mix(docs: DataFrame, most: int = 3, key: str = "doc_id", carry: tuple[str, ...] = (), fine: int = FINE) -> DataFrame:
    """Per row: ``key``, size, source_size, target, taken (tokens the slots take of it), first_slot (the first that takes the block of its first token), ``carry``."""
    narrow, per, slots = _planned(docs, most, fine, key)
    blocks = _taken_blocks(slots)
    last = F.least(F.col("_b"), F.col("_total") - F.col("block") * F.col("_b"))
    took = blocks.join(per.select("_source", "_total"), "_source").groupBy("_source").agg(F.sum(F.col("_times") * last).alias("_took"))
    per = per.join(took, "_source", "left").withColumn("_took", F.coalesce("_took", F.lit(0)))
    rows = _streams(per, sized(docs, key=key, carry=carry) if carry else narrow, narrow)
    rows = rows.withColumn("_i", F.expr("_start div _tokens")).withColumn("_j", F.expr("_end div _tokens"))
    spread = (lambda df: F.broadcast(df)) if blocks.count() <= BROADCAST_ROWS else (lambda df: df)  # a checked size
    for name in ("_i", "_j"):  # the blocks of the row's first token and of the one behind its last
        side = blocks.select(F.col("_source").alias("_bs"), F.col("block").alias("_bb"), *(F.col(c).alias(f"{name}{c}") for c in ("_times", "_upto", "_first")))
        rows = rows.join(spread(side), (F.col("_source") == F.col("_bs")) & (F.col(name) == F.col("_bb")), "left").drop("_bs", "_bb")
    upto = lambda n, x: F.coalesce(F.col(f"{n}_upto") + F.col(f"{n}_times") * (F.col(x) - F.col(n) * F.col("_tokens")), F.col("_took"))
    taken = upto("_j", "_end") - upto("_i", "_start")
    return rows.select(
        F.col("_id").alias(key), F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), taken.cast("long").alias("taken"),
        F.when(taken > 0, F.col("_i_first")).cast("long").alias("first_slot"), *(F.col(f"_c_{c}").alias(c) for c in carry),
    )


def sequence(docs: DataFrame, most: int = 3, key: str = "doc_id", fine: int = FINE) -> DataFrame:
    """The mix itself, to be read in the order of (at, _tier, first word of the stream).

    Per slot and document that it reads of: at, tier, slot, source, ``key``, first (the document's
    word that it starts with) and words. Blocks meet the documents by an equi-join; a document has a
    row for each block that it reaches into.
    """
    narrow, per, slots = _planned(docs, most, fine, key)
    rows = _streams(per, narrow, narrow).where("_size > 0").withColumn("block", F.explode(F.sequence(F.expr("_start div _tokens"), F.expr("(_end - 1) div _tokens"))))
    met = rows.join(slots, ["_source", "block"])
    begin, end = F.greatest(F.col("_start"), F.col("block") * F.col("_tokens")), F.least(F.col("_end"), (F.col("block") + 1) * F.col("_tokens"))
    return met.select("at", F.col("_tier").alias("tier"), "slot", F.col("_source").alias("source"), F.col("_id").alias(key), F.col("pass"), (begin - F.col("_start")).alias("first"), (end - begin).alias("words"))
