"""Queries that run a stream to its end, with the SQL of what the table then holds."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.checkpoints import shared_folder
from ..sources.registry import Registry
from ..streaming.incremental import run_incrementally, stream_files
from .pairs import table

Query = Callable[[SparkSession, str], DataFrame]


def incremental_append(spark: SparkSession, folder: str) -> DataFrame:
    """Events in three overlapping sets of files, streamed one by one into a table with one row per event."""
    place = f"{shared_folder(spark)}/incremental-{uuid.uuid4().hex}"
    events = table(spark, folder, "events").select("event_id", "event_type", "value")
    for part in range(3):
        events.where((F.col("event_id") % 3 == part) | (F.col("event_id") % 10 == 0)).write.mode("append").parquet(f"{place}/in")
    query = run_incrementally(stream_files(spark, f"{place}/in", events.schema), lambda rows: rows.where("value >= 0"), f"{place}/out", f"{place}/state", "event_id")
    query.awaitTermination()
    return Registry(spark, f"{place}/out", "event_id").rows().groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"))


QUERIES: dict[str, Query] = {"incremental_append": incremental_append}
ORACLE = {"incremental_append": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_ids FROM events WHERE value >= 0 GROUP BY 1"}
