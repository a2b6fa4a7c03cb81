import random

from pyspark.sql import functions as F

from tessera.operators import fetching, sweep
from tessera.operators.running import RANGE, ranged, running


def test_running_sums_over_ranges(spark):
    """One group over many ranges, null groups, nulls as values; against a serial run."""
    rng = random.Random(5)
    rows = [(g, rng.randrange(5), i, rng.choice([None, 1, 2, 50])) for i, g in enumerate(["big"] * 900 + [None] * 40 + list("abcdefgh") * 3)]
    df = spark.createDataFrame(rows, "g string, t int, id int, v long").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = ranged(df, ["g"], ["t", "id"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert dealt.where("g = 'big'").select(RANGE).distinct().count() > 1
    got = {r.id: (r.s, r.s_all, r.n) for r in running(dealt, ["g"], ["t", "id"], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    want, sums = {}, {}
    for g, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        s, n = sums.get(g, (0, 0))
        want[i], sums[g] = (s, n), (s + (v or 0), n + 1)
    assert got == {i: (want[i][0], sums[g][0], want[i][1]) for g, _, i, _ in rows}
    assert running(ranged(df.limit(0), ["g"], ["id"]), ["g"], ["id"], {"s": F.col("v")}).count() == 0


def test_claim_and_evict_equal_serial_runs(spark):
    rng = random.Random(6)
    rows = [("s" if i % 3 else f"t{i % 5}", i, rng.random() < 0.7, rng.choice([None, 1, 5, 9])) for i in range(400)]
    df = spark.createDataFrame(rows, "source string, seq int, miss boolean, size long").repartition(5)
    got = {r.seq: (r.claimed, r.within_bytes) for r in fetching.claim(df, ["seq"], ["source"], 30, 200).collect()}
    taken, spent = {}, {}
    for s, i, miss, size in rows:
        taken[s] = taken.get(s, 0) + miss
        claimed = not miss or taken[s] <= 30
        assert got[i] == (claimed, spent.get(s, 0) < 200)
        spent[s] = spent.get(s, 0) + (size or 0) * claimed
    entries = [("c", f"p{i}", rng.randrange(50), 10 * i) for i in range(60)] + [("d", "x", 3, 5), (None, "y", 1, 10_000)]
    df = spark.createDataFrame(entries, "component string, path string, modified int, bytes long")
    got = {(r.component, r.path): r.evicted_by for r in sweep.evict(df, 60, max_age=40, max_bytes=1000).collect()}
    for c in ("c", "d", None):
        own = sorted((e for e in entries if e[0] == c), key=lambda e: (e[2], e[1]))
        left = sum(e[3] for e in own if 60 - e[2] <= 40)
        over = left > 1000
        for _, path, modified, size in own:
            by = "age" if 60 - modified > 40 else "size" if over and left > 900 else None
            assert got[c, path] == by
            left -= size if by == "size" else 0


def test_sweep_gate_and_settings(spark):
    assert sweep.due(None, 5) and sweep.due(10, 9) and sweep.due(0, 86400) and not sweep.due(0, 86399) and not sweep.due(7, 7)
    assert sweep.settings(spark) == (30 * 86400, 10 << 30)
    try:
        for days, size, want in (("2", "7", (2 * 86400, 7)), ("0", "-1", (30 * 86400, 5)), ("x", "", (30 * 86400, 5)), ("99999999999999999999", "18446744073709551616", (30 * 86400, 5)), ("18446744073709551615", "+3", ((1 << 63) - 1, 3))):
            spark.conf.set(sweep.DAYS_SETTING, days)
            spark.conf.set(sweep.BYTES_SETTING, size)
            assert sweep.settings(spark, 5) == want
    finally:
        spark.conf.unset(sweep.DAYS_SETTING)
        spark.conf.unset(sweep.BYTES_SETTING)
