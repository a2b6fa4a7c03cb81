"""Cache eviction: by age, then oldest first down to nine tenths of the ceiling."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .running import RANGE, ranged, running

MAX_AGE, MAX_CACHE_BYTES, EVERY = 30 * 86400, 10 << 30, 86400


def due(last_sweep: int | None, now: int, every: int = EVERY) -> bool:
    """Whether the daily gate is open; a marker from the future doesn't shut it."""
    return last_sweep is None or now < last_sweep or now - last_sweep >= every


#: Session settings of the sweep: retention in days, and the ceiling in bytes.
DAYS_SETTING, BYTES_SETTING = "spark.tessera.cache.days", "spark.tessera.cache.bytes"


def settings(spark: SparkSession, default_bytes: int = MAX_CACHE_BYTES) -> tuple[int, int]:
    """(seconds of retention, ceiling in bytes) of a session; what isn't a positive whole number of 64 bits counts as not set."""

    def positive(name: str, default: int) -> int:
        text = spark.conf.get(name, "")
        value = int(text) if re.fullmatch(r"\+?[0-9]+", text) else 0
        return value if 0 < value < 1 << 64 else default

    return min(positive(DAYS_SETTING, MAX_AGE // 86400) * 86400, (1 << 63) - 1), min(positive(BYTES_SETTING, default_bytes), (1 << 63) - 1)


def evict(entries: DataFrame, now: int | Column, component: str = "component", path: str = "path", modified: str = "modified", size: str = "bytes", max_age: int = MAX_AGE, max_bytes: int = MAX_CACHE_BYTES) -> DataFrame:
    """Append ``evicted_by``: ``age``, ``size`` or null.

    Older than ``max_age`` goes. Of the rest, if a component holds more than ``max_bytes``, the oldest go
    until it holds at most nine tenths of that; ties in age go by path. The running sum over a
    component's survivors is made in ranges, so one component may hold all entries.
    """
    now = F.lit(now) if isinstance(now, int) else now
    order = [modified, path]
    rows = ranged(entries.withColumn("__old", now - F.col(modified) > max_age), [component], order)
    alive = F.when(F.col("__old"), 0).otherwise(F.col(size))
    rows = running(rows, [component], order, {"__gone": alive})
    over = (F.col("__gone_all") > max_bytes) & (F.col("__gone_all") - F.col("__gone") > max_bytes // 10 * 9)
    return rows.withColumn("evicted_by", F.when(F.col("__old"), "age").when(over, "size")).drop("__old", "__gone", "__gone_all", RANGE)
