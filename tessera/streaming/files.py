"""Linking records as their files arrive: each micro-batch runs the batch plan against the reference table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.pipeline import Preset, link
from tessera.sources.records import RECORD, with_ordinal


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """Tab-separated record files of a folder as a stream."""
    raw = spark.readStream.schema(RECORD).option("sep", "\t").option("quote", "").option("header", True).csv(folder)
    return with_ordinal(raw.na.fill(""))


def link_stream(records: DataFrame, s1: DataFrame, model: Model, threshold: float, preset: Preset, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands the scored pairs of each batch of targets to ``sink(pairs, batch)``; all that has arrived is taken, then it ends."""

    def batch(targets: DataFrame, number: int) -> None:
        sink(link(s1, targets, model, threshold, preset)[0], number)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
