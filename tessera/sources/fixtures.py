"""Fetch backends as a Python data source: canned responses by default, HTTPS only when asked for."""

from __future__ import annotations

import ipaddress
import json
import socket
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.udfs import blocked_ip_one

SCHEMA = "url string, status int, final_url string, content_type string, content binary, error string"
REDIRECTS, TIMEOUT, CAP = 10, 30, 256 << 20


def canned(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Responses to ``requests(url)`` from a table ``answers(url, status, content_type, content)``; a miss is an error row."""
    got = answers.select("url", "status", "content_type", "content", F.lit(True).alias("__hit"))
    rows = requests.select("url").distinct().join(got, "url", "left")
    return rows.select("url", "status", F.col("url").alias("final_url"), "content_type", "content", F.when(F.col("__hit").isNull(), F.lit("transport: no fixture")).when(F.col("status") >= 400, F.concat(F.lit("status: "), F.col("status"))).alias("error"))


def refusing(requests: DataFrame) -> DataFrame:
    """The probe backend: every request is refused, which leaves the URLs it would have read."""
    return requests.select("url", F.lit(None).cast("int").alias("status"), F.lit(None).cast("string").alias("final_url"), F.lit(None).cast("string").alias("content_type"), F.lit(None).cast("binary").alias("content"), F.lit("refused: probe").alias("error"))


class HttpsSource(DataSource):
    """``spark.read.format("guarded_https").option("urls", "u1\\nu2")``: one partition a host.

    Options ``method`` (GET or POST), ``body`` and ``headers`` (a JSON object) hold for all URLs, ``cap``
    for the bytes of a body.
    """

    @classmethod
    def name(cls):
        return "guarded_https"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return HttpsReader(self.options)


class _Host(InputPartition):
    def __init__(self, urls):
        self.urls = urls


class HttpsReader(DataSourceReader):
    def __init__(self, options):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.cap, self.method, self.body = int(options.get("cap", CAP)), options.get("method", "GET").upper(), options.get("body")
        self.headers = json.loads(options.get("headers", "{}"))

    def partitions(self):
        hosts: dict = {}
        for u in self.urls:
            hosts.setdefault(urlsplit(u).hostname, []).append(u)
        return [_Host(us) for us in hosts.values()] or [_Host([])]

    def read(self, partition):
        for url in partition.urls:
            yield fetch(url, self.cap, self.method, self.headers, self.body)


def checked(url: str) -> tuple[list[str], str | None]:
    """(addresses to connect to, why not): not HTTPS, no host, or a host that resolves to blocked addresses alone."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port or 443
    except ValueError as e:
        return [], f"refused: {e}"
    if parts.scheme.lower() != "https" or not host:
        return [], "refused: not https"
    try:
        ipaddress.ip_address(host)
        found = [host]
    except ValueError:
        try:
            found = list(dict.fromkeys(a[4][0] for a in socket.getaddrinfo(host, port, type=socket.SOCK_STREAM)))
        except (OSError, UnicodeError) as e:
            return [], f"transport: {e}"
    free = [a for a in found if blocked_ip_one(a.split("%")[0]) is False]
    return free, None if free else "refused: blocked address"


def refused(url: str) -> str | None:
    """Why a URL must not be fetched; null if it may be."""
    return checked(url)[1]


def _connect(addresses: list[str], port: int, timeout: float):
    """A connection to the first of the checked addresses that answers; names aren't resolved again."""
    for k, a in enumerate(addresses):
        try:
            return socket.create_connection((a, port), timeout)
        except OSError:
            if k == len(addresses) - 1:
                raise


def fetch(url: str, cap: int = CAP, method: str = "GET", headers: dict | None = None, body: str | None = None) -> tuple:
    """One request with guarded, counted redirects and a capped body, as a row of ``SCHEMA``.

    Every hop is resolved once and connects to an address that was checked. A POST isn't redirected: it
    fails with the status, as all do that isn't a success.
    """
    import http.client

    at = url
    for _ in range(REDIRECTS + 1):
        addresses, why = checked(at)
        if why:
            return (url, None, at, None, None, why)
        parts = urlsplit(at)
        conn = http.client.HTTPSConnection(parts.hostname, parts.port or 443, timeout=TIMEOUT)
        conn._create_connection = lambda to, timeout, source=None: _connect(addresses, to[1], timeout)
        try:
            conn.request(method, (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), body, headers or {})
            r = conn.getresponse()
            if method == "GET" and r.status in (301, 302, 303, 307, 308) and r.getheader("location"):
                at = urljoin(at, r.getheader("location"))
                continue
            size = r.getheader("content-length") or ""
            if size.isdigit() and int(size) > cap:
                return (url, r.status, at, None, None, "too large")
            body = r.read(cap + 1)
            error = "too large" if len(body) > cap else None if 200 <= r.status < 300 else f"status: {r.status}"
            return (url, r.status, at, r.getheader("content-type"), None if error else body, error)
        except TimeoutError:
            return (url, None, at, None, None, "timeout")
        except (OSError, http.client.HTTPException, ValueError) as e:
            return (url, None, at, None, None, f"transport: {type(e).__name__}: {e}")
        finally:
            conn.close()
    return (url, None, at, None, None, "refused: too many redirects")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpsSource)
