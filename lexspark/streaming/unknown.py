"""Unknown words in a stream of texts, counted by windows of event time. An extension: it keeps state.

A row that comes again within the watermark counts once; windows and keys older than the watermark are let go, and rows
that come later than that are dropped, as the stream's owner asks by ``delay``. Each batch writes the windows that it has
changed into a folder of its own, so that a batch that is run again after a failure replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lexicon import Lexicon


def unknown_words(texts: DataFrame, lexicon: Lexicon, keys: tuple[str, ...], time: str = "time", text: str = "text", delay: str = "1 hour") -> DataFrame:
    """``(time, word)`` for each word of a row of the stream, less those that the dictionary has; repeated rows once."""
    once = texts.withWatermark(time, delay).dropDuplicatesWithinWatermark([*keys])
    words = once.select(F.col(time).alias("time"), F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    return words.join(lexicon.words(), "word", "left_anti")


def count_unknown(texts: DataFrame, lexicon: Lexicon, keys: tuple[str, ...], output: str, checkpoint: str, window: str = "1 hour", delay: str = "1 hour") -> StreamingQuery:
    """Starts counting unknown words by window, for all that is there; ``unknown_counts`` reads what it has written."""
    counts = unknown_words(texts, lexicon, keys, delay=delay).groupBy(F.window("time", window).start.alias("start")).agg(F.count(F.lit(1)).alias("words"))

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("number", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unknown_counts(spark: SparkSession, output: str) -> DataFrame:
    """``(start, words)``: the newest count of each window."""
    written = spark.read.parquet(output)
    return written.groupBy("start").agg(F.max_by("words", "number").alias("words"))
