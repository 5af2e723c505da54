"""The stateless cleaner on a stream (beyond parity): the same reasons, one micro-batch after the other.

Duplicates within the watermark are dropped by keyed state; the batch chain counts them, a stream forgets them after
the delay, so state stays bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.operators.clean import pair_reasons


def clean_stream(pairs: DataFrame, time_col: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Kept pairs of a stream (ts, a, b), each pair once within the delay."""
    kept = pair_reasons(pairs).filter("reason = 'kept'").drop("reason")
    return kept.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["a", "b"])


def reason_windows(pairs: DataFrame, time_col: str = "ts", window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, reason, n): counts of reasons by event-time window; late rows beyond the delay are left out."""
    marked = pair_reasons(pairs).withWatermark(time_col, delay)
    return marked.groupBy(F.window(time_col, window).alias("w"), "reason").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "reason", "n")
