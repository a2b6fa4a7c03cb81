import os
import threading
import time

from pyspark.sql import functions as F

from tessera.operators import fetching
from tessera.sources import backends


def test_answers_come_in_order_with_bounded_work():
    state, lock = {"now": 0, "most": 0, "begun": 0}, threading.Lock()

    def fetch(url, headers, body, cap):
        with lock:
            state["now"] += 1
            state["begun"] += 1
            state["most"] = max(state["most"], state["now"])
        time.sleep(0.002 * (hash(url) % 5))
        with lock:
            state["now"] -= 1
        if url == "u7":
            raise ValueError("bad")
        return 200, url, "t", (headers.get("a", "") + (body or "")).encode(), None

    requests = [(f"k{i}", f"u{i}", [{"name": "a", "value": "1"}] if i % 2 else None, "b" if i % 3 == 0 else None) for i in range(60)]
    rows = backends.answered(iter(requests), fetch, 10, 4)
    first = next(rows)
    assert state["begun"] <= 8 + 1  # no more than two for each worker before anything is read
    got = [first, *rows]
    assert [r[0] for r in got] == [f"k{i}" for i in range(60)] and 1 < state["most"] <= 4
    assert got[3][5] == b"1b" and got[7][2:] == (None, None, None, None, "transport: ValueError: bad")
    assert [r[0] for r in backends.answered(iter(requests), fetch, 1 << 30, 4, in_flight=1 << 20)] == [f"k{i}" for i in range(60)]
    assert list(backends.answered(iter([]), fetch, 10, 4)) == []


def _echo(url, headers, body, cap):
    if "bad" in url:
        return 404, url, None, None, "status: 404"
    return 200, url, "text", f"{os.getpid()} {headers} {body}".encode(), None


def test_live_table_of_requests(spark):
    rows = [(f"https://one.example/{i % 40}", None, None) for i in range(80)] + [("https://two.example/bad", None, None), ("https://one.example/0", [("a", "1")], None), ("https://one.example/0", None, "x"), (None, None, None)]
    asked = spark.createDataFrame(rows, "url string, headers array<struct<name:string,value:string>>, body string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = backends.live(_echo)(asked).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(got) == 43 and len({r.key for r in got}) == 43
    assert {r.error for r in got} == {None, "status: 404"}
    assert len({bytes(r.content).split()[0] for r in got if r.content}) > 1  # one host, several tasks
    posted = [r for r in got if r.content and bytes(r.content).endswith(b" x")]
    assert len(posted) == 1 and posted[0].key == asked.where("body = 'x'").select(fetching.request_key(asked).alias("k")).first().k


def test_one_interface(spark):
    asked = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "url string")
    answers = spark.createDataFrame([("a", 200, "t", "A"), ("b", 302, "t", "B")], "url string, status int, content_type string, content string")
    canned = {r.url: (r.status, r.content and bytes(r.content), r.error) for r in backends.canned(answers)(asked).collect()}
    assert canned == {"a": (200, b"A", None), "b": (302, None, "status: 302"), "c": (None, None, "transport: no fixture")}
    assert {(r.url, r.error) for r in backends.refusing(asked).collect()} == {(u, "refused: probe") for u in "abc"}
    for serve in (backends.canned(answers), backends.refusing, backends.live(_echo)):
        assert serve(asked).columns == [f.split()[0] for f in backends.SCHEMA.split(", ")]
    cache = spark.createDataFrame([], "key string, fetched_at bigint, content binary")
    served = fetching.documents(asked.withColumn("tier", F.lit("unpinned")), cache, backends.canned(answers)(asked), 0)
    assert {(r.url, r.served) for r in served.collect()} == {("a", "network"), ("b", None), ("c", None)}
