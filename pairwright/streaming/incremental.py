"""Incremental runs as streams: the same functions as in batch, on files as they arrive, without doing anything twice."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.registry import Registry
from ..sources.rewrite import Files


def stream_files(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def run_incrementally(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str) -> StreamingQuery:
    """Apply ``step`` to each batch and add the rows whose key is not in the ``Registry`` at ``out`` yet.

    What is repeated, within a batch, across batches or after a restart, is added once; the final table, ``Registry.rows``, is that
    of one batch over all. A batch is named after the stream's own id, which its checkpoint keeps, and its number: the
    same batch after a restart replaces what its first attempt left, and a stream with a new checkpoint has names of its own.
    """
    spark = stream.sparkSession
    Registry(spark, out, key)

    def add(rows: DataFrame, number: int) -> None:
        name = json.loads(Files(rows.sparkSession, checkpoint).text(f"{checkpoint}/metadata"))["id"]
        Registry(rows.sparkSession, out, key).add(step(rows), f"{name}-{number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def judged_stream(pairs: DataFrame, judge: Callable[[DataFrame], DataFrame], id: str = "pair_id") -> DataFrame:
    """A row per pair and flag, of a stream of pairs: stateless, so no watermark is needed."""
    return judge(pairs).select(id, "ok", F.explode_outer("flags").alias("flag")).select(id, "ok", "flag.*")


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by kind and window of event time; rows later than ``late`` are left out, and state is bounded by it."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
