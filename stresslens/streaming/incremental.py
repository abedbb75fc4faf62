"""An extension: prediction rows as a stream, each key once within its watermark, counts by window and condition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stresslens.operators import metrics


def once(rows: DataFrame, keys: list[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first row of each key; state is dropped once the watermark has passed it."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_confusion(rows: DataFrame, by: list[str], window: str = "1 hour", time: str = "ts", late: str = "10 minutes", threshold: float = 0.5) -> DataFrame:
    """tp, fn, fp, tn of each window; final in append mode once the watermark has passed the window."""
    return rows.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(*metrics.counts(threshold)).select(F.col("window.start").alias("start"), *by, "tp", "fn", "fp", "tn")


def append_batches(rows: DataFrame, path: str, keys: list[str], checkpoint: str):
    """A query that appends what the output doesn't have yet; a batch that is run again adds nothing."""
    from stresslens.sources.files import append_pending

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: append_pending(batch, path, keys) and None).start()
