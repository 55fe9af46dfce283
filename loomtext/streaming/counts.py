"""Counts over an unbounded stream of tokenised paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_words(stream: DataFrame, at: str = "ingested_at", *, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Occurrences of each token per window of `at`; rows later than `delay` are left
    out and finished windows leave the state. Works on a bounded frame too."""
    words = stream.withWatermark(at, delay).select(at, F.explode(F.flatten("sentences")).alias("word"))
    return words.groupBy(F.window(at, window).alias("w"), "word").agg(F.count("*").alias("n")).select("w.start", "word", "n")
