"""Live jobs: messages scored as they come, conversations that gather risk, inboxes, duplicates. Logs of which the newest record
of each key counts are in `sources.versions`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signals as S
from ..functions import wording as W


def scored_messages(messages: DataFrame) -> DataFrame:
    """Stateless: each message with its codes and score; append mode. messages: conv_id, turn, text."""
    df = messages.withColumn("signals", W.lexicon_signals(F.col("text")))
    return df.select("conv_id", "turn", S.codes(F.col("signals")).alias("codes"), S.noisy_or(F.col("signals")).alias("score"))


def conversation_scores(messages: DataFrame) -> DataFrame:
    """The score of all messages so far, kept as a sum of logarithms for each conversation; update mode."""
    safe = F.greatest(1 - S.noisy_or(W.lexicon_signals(F.col("text"))), F.lit(1e-12))
    return messages.groupBy("conv_id").agg((1 - F.exp(F.sum(F.log(safe)))).alias("score"), F.count("*").alias("messages"))


def inbox(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of a folder's JSON files, each read once; broken lines are skipped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def without_duplicates(listings: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Listings whose fingerprint did not occur within the watermark. listings: ts, fingerprint, ..."""
    return listings.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["fingerprint"])
