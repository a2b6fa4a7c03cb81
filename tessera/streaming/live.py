"""Streaming forms of the batch operators (an extension: the batch semantics stay the reference)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.purl import normalize


def purl_probe(lines: DataFrame, purl: str = "purl") -> DataFrame:
    """Stateless canonicalization of a stream of package URLs."""
    return normalize(lines, purl)


def first_references(refs: DataFrame, event_time: str, delay: str = "1 day") -> DataFrame:
    """First reference of each locator by arrival; state is dropped behind the watermark."""
    return refs.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["file_id", "locator"])


def releases_per_window(events: DataFrame, event_time: str, package: str, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Releases of each package in event-time windows; late events inside the delay still count."""
    return events.withWatermark(event_time, delay).groupBy(F.window(event_time, size), package).agg(F.count("*").alias("releases"))


def each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Run ``sink`` once a micro-batch; it must be idempotent by batch number, as a batch may run again."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def periodic_sweep(spark: SparkSession, sweep: Callable[[int], None], checkpoint: str, every: str = "24 hours"):
    """Call ``sweep(batch)`` on a fixed cadence."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, n: sweep(n)).trigger(processingTime=every).option("checkpointLocation", checkpoint).start()
