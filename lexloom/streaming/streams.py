"""Streaming forms: dedup with a watermark, running tag counts, a journal by available-now runs, growing lists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import tagging


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of new text files with the time they were read."""
    return spark.readStream.text(path).select(F.col("value").alias("line"), F.current_timestamp().alias("ts"))


def distinct_lines(stream: DataFrame, delay: str = "1 hour", key: str = "line", ts: str = "ts") -> DataFrame:
    """First occurrence of each line; the watermark bounds the state, which D1's set doesn't."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def tag_counts(stream: DataFrame, dictionary, window: str = "10 minutes", delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    hits = tagging.tags(F.lower("line"), dictionary)
    rows = stream.withWatermark(ts, delay).select(ts, F.explode(hits).alias("_t"))
    return rows.groupBy(F.window(ts, window), F.col("_t.tag").alias("tag")).agg(F.count("*").alias("count"))


def once(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what has come since the last run and stops; the checkpoint is the journal."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def growing_lists(stream: DataFrame, key: str = "doc_id", item: str = "item") -> DataFrame:
    """Items that a key's list has not had yet, with their place in it (U2 as a stream).

    The list is the state of its key; it grows with the distinct items of one document, as the fold
    over its chunks does in a batch. Within a batch items come in the order of their arrival.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = stream.schema[key].dataType.simpleString()

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        had = list(state.get[0]) if state.exists else []
        known, out = set(had), []
        for pdf in batches:
            for x in pdf[item]:
                if x is not None and x not in known:
                    known.add(x)
                    had.append(x)
                    out.append((keys[0], len(had) - 1, x))
        state.update((had,))
        yield pd.DataFrame(out, columns=[key, "place", item])

    return stream.select(key, item).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, place int, {item} string", "items array<string>", "append", GroupStateTimeout.NoTimeout)
