from tessera.sources.cache import SETTING, Cache

DAY = 86400


def test_cache_keeps_newest_and_sweeps(spark, tmp_path):
    cache = Cache(spark, str(tmp_path / "cache"))
    rows = lambda *kv: spark.createDataFrame(list(kv), "key string, content string")
    assert cache.entries().count() == 0
    cache.put(rows(("a", "one"), ("b", "bb"), (None, "x"), ("c", None)), "refs", 100)
    cache.put(rows(("a", "newer")), "refs", 200)
    got = {r.key: (bytes(r.content), r.fetched_at, r.accessed_at) for r in cache.entries().collect()}
    assert got == {"a": (b"newer", 200, 200), "b": (b"bb", 100, 100)}
    cache.touch(rows(("b", "")), 100 + 10)  # within a day: not noted
    assert {r.key: r.accessed_at for r in cache.entries().collect()}["b"] == 100
    cache.touch(rows(("b", ""), ("gone", "")), 100 + 2 * DAY)
    assert {r.key: r.accessed_at for r in cache.entries().collect()} == {"a": 200, "b": 100 + 2 * DAY}
    assert [tuple(r) for r in cache.sizes().collect()] == [("refs", 2, 7)]
    told = {r.key: r.evicted_by for r in cache.sweep(200 + 2 * DAY, max_age=DAY).collect()}
    assert told == {"a": "age", "b": None}
    assert [r.key for r in cache.entries().collect()] == ["b"]
    cache.put(rows(("d", "dd")), "refs", 300 + 2 * DAY)
    assert sorted(r.key for r in cache.entries().collect()) == ["b", "d"]


def test_disabled_cache(spark):
    assert spark.conf.get(SETTING, None) is None
    cache = Cache(spark)
    cache.put(spark.createDataFrame([("a", "x")], "key string, content string"), "refs", 1)
    assert cache.entries().count() == 0 and cache.sweep(10).count() == 0
