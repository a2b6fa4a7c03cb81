from datetime import datetime

from tessera.streaming import lifetimes


def run(spark, tmp_path, name, schema, files, op):
    """Each of ``files`` is a batch of a stream that is started anew over one checkpoint; the rows of all batches."""
    folder, out = tmp_path / name, []
    folder.mkdir()
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))
        stream = op(spark.readStream.schema(schema).json(str(folder)))
        query = stream.writeStream.foreachBatch(lambda df, n: out.extend((i, *r) for r in df.collect())).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    return out


def test_lifetimes_end_once_and_move_with_newer_answers(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1, 0, s // 60, s % 60)
    files = [
        [("a", at(0), 60), ("b", at(0), 600), (None, at(0), 1), ("c", None, 5), ("d", at(0), None)],
        [("a", at(30), 60), ("a", at(10), 9000), ("e", at(30), 10)],  # a is fetched again, a late answer doesn't count
        [("x", at(80), 900)],
        [("x", at(100), 900)],
        [("x", at(101), 900)],
    ]
    got = run(spark, tmp_path, "answers", "key string, fetched_at timestamp, lifetime long", files, lifetimes.expirations)
    told = {r[1]: (r[2], r[3]) for r in got}
    assert told == {"a": (at(30), at(90)), "e": (at(30), at(40))} and len(got) == 2


def test_sweeps_are_due_daily(spark, tmp_path):
    day = 86400
    files = [[("m", 0), ("m", 5), ("n", 100), (None, 1)], [("m", day - 1), ("m", day), ("m", day + 1), ("n", day + 99)], [("m", 3 * day), ("n", 50), ("n", 100 - day)]]
    got = run(spark, tmp_path, "ticks", "component string, at long", files, lifetimes.due_sweeps)
    assert sorted(got, key=str) == sorted([(0, "m", 0, None), (0, "n", 100, None), (1, "m", day, 0), (2, "m", 3 * day, day), (2, "n", 100 - day, 100)], key=str)
