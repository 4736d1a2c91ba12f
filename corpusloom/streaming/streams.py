"""Scans and request metrics as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reports import normalize_route
from ..operators.scan import ScanStore

#: A row for each scan: its number and the folder of its listing.
MANIFEST = "scan_id long, listing string"


def incremental_scan_stream(spark: SparkSession, manifests: str, store: ScanStore, checkpoint: str, mode: str = "INCREMENTAL", on_changes: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Applies each scan that a manifest announces to the store: changes, file table, chunks, endpoints, graph, report.

    A listing is a Parquet folder of any number of files, in the form that ScanStore.scan takes; the stream itself
    carries one small row for each scan. A batch that is run again writes the same partitions of the store again. Review
    decisions are kept. on_changes gets the changes of every scan, in order."""
    feed = spark.readStream.schema(MANIFEST).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(manifests)

    def apply(batch: DataFrame, _: int) -> None:
        for row in batch.distinct().orderBy("scan_id").collect():
            changes = store.scan(spark.read.parquet(row["listing"]), row["scan_id"], mode)
            if on_changes:
                on_changes(changes, row["scan_id"])

    return feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def route_metrics_stream(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, route, requests, errors, total, max_ms) of a stream (ts, method, route, status, duration_ms) by tumbling
    windows; rows later than `late` are dropped. Sums over windows are the batch result of route_metrics."""
    key = F.concat(F.col("method"), F.lit(" "), normalize_route(F.col("route")))
    by = log.withWatermark("ts", late).groupBy(F.window("ts", window), key.alias("route"))
    return by.agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"), F.sum("duration_ms").alias("total"), F.max("duration_ms").alias("max_ms"))
