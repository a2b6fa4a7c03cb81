"""Freshness and the daily sweep as state of streams: what a batch run keeps in marker files is kept per key.

State lives in the stream's checkpoint, so a restarted stream goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sweep import EVERY, due


def expirations(answers: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(key, fetched_at, expired_at): when the newest of ``answers(key, fetched_at timestamp, lifetime long seconds)`` stops being fresh.

    A newer answer moves the end of its key's lifetime; an older one that comes late changes nothing, nor
    does one whose lifetime is over before the key's newest. An end is told once, when the watermark has
    passed it; then the key is forgotten. Rows with a null key, time or lifetime are passed over.
    """
    rows = answers.where("key IS NOT NULL AND fetched_at IS NOT NULL AND lifetime IS NOT NULL").withWatermark("fetched_at", delay)
    rows = rows.withColumn("at", F.unix_millis("fetched_at")).withColumn("until", F.col("at") + F.col("lifetime") * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, until = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "fetched_at": pd.to_datetime([at], unit="ms"), "expired_at": pd.to_datetime([until], unit="ms")})
            return
        at, until = state.get if state.exists else (None, None)
        for batch in batches:
            i = batch["at"].idxmax()  # the first of equal ones
            if at is None or batch["at"][i] > at:
                at, until = int(batch["at"][i]), int(batch["until"][i])
        state.update((at, until))
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))

    return rows.groupBy("key").applyInPandasWithState(run, "key string, fetched_at timestamp, expired_at timestamp", "at long, until long", "append", GroupStateTimeout.EventTimeTimeout)


def due_sweeps(ticks: DataFrame, every: int = EVERY) -> DataFrame:
    """(component, at, last): those of ``ticks(component, at long seconds)`` at which a component is due for its sweep.

    A component is due at its first tick, and when ``every`` seconds have passed since the last one that
    was due; a marker from the future (a clock that was set back) doesn't shut the gate. ``last`` is the
    marker before, null at first. Ticks of a batch are taken in the order of time.
    """
    rows = ticks.where("component IS NOT NULL AND at IS NOT NULL")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for at in sorted({int(x) for batch in batches for x in batch["at"]}):
            if due(last, at, every):
                out.append((key[0], at, last))
                last = at
        if out:
            state.update((last,))
            yield pd.DataFrame({"component": [r[0] for r in out], "at": [r[1] for r in out], "last": pd.array([r[2] for r in out], dtype="Int64")})

    return rows.groupBy("component").applyInPandasWithState(run, "component string, at long, last long", "last long", "append", GroupStateTimeout.NoTimeout)
