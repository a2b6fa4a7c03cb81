"""Answers to a table of requests: canned, refusing or live, all with the same columns.

A backend takes ``requests(url[, headers][, body])`` and returns a row for each distinct request, under
``fetching.request_key``. A request with a body is a POST.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.purl import split_host
from ..operators.fetching import request_key
from . import fixtures

SCHEMA = "key string, url string, status int, final_url string, content_type string, content binary, error string"
_ARROW = pa.schema([("key", pa.string()), ("url", pa.string()), ("status", pa.int32()), ("final_url", pa.string()), ("content_type", pa.string()), ("content", pa.binary()), ("error", pa.string())])
#: How many requests a task has under way.
LEAST_WORKERS, MOST_WORKERS = 2, 16
#: Bytes that answers under way may take in a task, and bytes of a batch that is handed on.
IN_FLIGHT, BATCH = 1 << 30, 8 << 20
#: Tasks that a host's requests are dealt over.
SALTS = 8

Backend = Callable[[DataFrame], DataFrame]


def keyed(requests: DataFrame) -> DataFrame:
    """(key, url, headers, body): each distinct request once."""
    kinds = {"headers": "array<struct<name:string,value:string>>", "body": "string"}
    rows = requests.select(request_key(requests).alias("key"), "url", *[(F.col(c) if c in requests.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    return rows.groupBy("key").agg(*[F.first(c).alias(c) for c in ("url", *kinds)])


def canned(answers: DataFrame) -> Backend:
    """Answers from a table ``answers(url[, headers][, body], status, content_type, content)``; what it lacks is an error."""

    def serve(requests: DataFrame) -> DataFrame:
        held = answers.select(request_key(answers).alias("key"), "status", "content_type", F.col("content").cast("binary").alias("content"), F.lit(True).alias("__hit"))
        why = F.when(F.col("__hit").isNull(), F.lit("transport: no fixture")).when(~F.col("status").between(200, 299), F.concat(F.lit("status: "), F.col("status")))
        rows = keyed(requests).join(held, "key", "left")
        return rows.select("key", "url", F.col("status").cast("int").alias("status"), F.col("url").alias("final_url"), "content_type", F.when(why.isNull(), F.col("content")).alias("content"), why.alias("error"))

    return serve


def refusing(requests: DataFrame) -> DataFrame:
    """Every request is refused: what is left is what would have been read."""
    none = lambda t: F.lit(None).cast(t)
    return keyed(requests).select("key", "url", none("int").alias("status"), none("string").alias("final_url"), none("string").alias("content_type"), none("binary").alias("content"), F.lit("refused: probe").alias("error"))


def _fetch(url: str, headers: dict, body: str | None, cap: int) -> tuple:
    """(status, final URL, type, content, error) of one request."""
    return fixtures.fetch(url, cap, "GET" if body is None else "POST", headers, body)[1:]


def answered(requests: Iterable[tuple], fetch: Callable, cap: int, workers: int, in_flight: int = IN_FLIGHT) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` in the order of ``requests`` (key, url, headers, body), ``workers`` under way at a time.

    Requests are taken as answers are handed on, and only so many as their bodies may fill ``in_flight``
    together, so a slow reader slows the fetching. A request that fails in any way is an error row.
    """
    under_way, room = deque(), max(1, min(2 * workers, in_flight // max(1, cap)))

    def one(request: tuple) -> tuple:
        key, url, headers, body = request
        try:
            return key, url, *fetch(url, {h["name"]: h["value"] for h in headers or []}, body, cap)
        except Exception as e:  # one request's fault must not cost the others
            return key, url, None, None, None, None, f"transport: {type(e).__name__}: {e}"

    with ThreadPoolExecutor(min(workers, room)) as pool:
        for request in requests:
            if len(under_way) == room:
                yield under_way.popleft().result()
            under_way.append(pool.submit(one, request))
        while under_way:
            yield under_way.popleft().result()


def live(fetch: Callable = _fetch, cap: int = fixtures.CAP, workers: int | None = None, in_flight: int = IN_FLIGHT, salts: int = SALTS) -> Backend:
    """Answers over HTTPS (or by another ``fetch(url, headers, body, cap)``): a bounded pool of threads in each task.

    Requests are dealt by host, each host over ``salts`` tasks, so that a host which all ask neither
    waits in one task nor meets every executor.
    """

    def run(batches):
        many = workers or max(LEAST_WORKERS, min(MOST_WORKERS, os.cpu_count() or 4))
        asked = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        rows, held = [], 0
        for row in answered(asked, fetch, cap, many, in_flight):
            rows.append(row)
            held += 256 + len(row[5] or b"")
            if held >= BATCH:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def serve(requests: DataFrame) -> DataFrame:
        rows = keyed(requests).where("url IS NOT NULL")
        dealt = rows.withColumns({"__host": split_host("url"), "__salt": F.pmod(F.xxhash64("key"), F.lit(salts))})
        return dealt.repartition("__host", "__salt").select("key", "url", "headers", "body").mapInArrow(run, SCHEMA)

    return serve


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
