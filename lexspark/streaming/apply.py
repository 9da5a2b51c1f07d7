"""A dictionary applied to a stream of words: a stateless join of the stream with the dictionary's table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.lexicon import Lexicon, applied, lookup


def words_stream(spark: SparkSession, folder: str) -> DataFrame:
    """``(word)``: lines of text files as they arrive; empty lines are skipped."""
    return spark.readStream.text(folder).where("value <> ''").withColumnRenamed("value", "word")


def stream_lookup(words: DataFrame, lexicon: Lexicon, column: str = "word") -> DataFrame:
    """The left join of the stream with the dictionary; it keeps no state, so late words are words like others."""
    return lookup(words, lexicon, column, "left")


def stream_apply(words: DataFrame, lexicon: Lexicon, output: str, checkpoint: str, skip_tags: bool = False) -> StreamingQuery:
    """Starts writing ``word => stem tag`` lines to text files, each input word exactly once, for all that is there."""
    lines = applied(words, lexicon, skip_tags=skip_tags)
    return lines.writeStream.format("text").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
