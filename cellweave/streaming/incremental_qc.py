"""Quality control of counts that arrive as a stream: an extension, since batch operators see the whole matrix at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_qc(counts: DataFrame) -> DataFrame:
    """(obs_id, n_genes, total) of all rows so far (obs_id, gene_id, value): for complete or update output."""
    return counts.groupBy("obs_id").agg(F.count_if(F.col("value") > 0).alias("n_genes"), F.sum("value").alias("total"))


def windowed_qc(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n, total) per tumbling window of (ts, key, value): append output, rows later than ``late`` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "key").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "key", "n", "total")
