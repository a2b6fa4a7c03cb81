"""Conversation repair against a forward search over audits, and its edge cases."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import repair

NEXT = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
ROLE = {"u": "user", "a": "assistant"}


def by_hand(rows):
    """The summary of one conversation's ordered (turn, role, text) rows, by carrying whole audits forward."""
    seen, kinds = set(), []
    for _, role, text in rows:
        inner = text.strip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else None)
        seen.add((role, text))
    best = {"0": (0, "", ())}

    def put(into, state, found):
        if state not in into or found[:2] < into[state][:2]:
            into[state] = found

    def inserted(best):
        for _ in range(3):
            for state in list(best):
                c, a, o = best[state]
                for x in "ua":
                    if (state, x) in NEXT:
                        put(best, NEXT[state, x], (c + 5, a + "I", (*o, (ROLE[x], ""))))
        return best

    for (_, role, text), kind in zip(rows, kinds):
        after = {}
        for state, (c, a, o) in inserted(best).items():
            put(after, state, (c + 2, a + "D", o))
            if kind not in ("blank", "duplicate"):
                c += 5 * (kind == "truncated")
                if (state, role[:1]) in NEXT:
                    put(after, NEXT[state, role[:1]], (c, a + "K", (*o, (role, text))))
                for x in "ua":
                    if (state, x) in NEXT:
                        put(after, NEXT[state, x], (c + 1, a + "R", (*o, (ROLE[x], text))))
        best = after
    best = inserted(best)
    cost, audit, out = min(best[s] for s in "0a" if s in best)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    told = "\n".join(f"{r}:{t}" for r, t in out)
    return gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(told.encode()).hexdigest()


def damaged_by_hand(table):
    out = defaultdict(list)
    shown = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in table:
        fault = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        role = "user" if fault == 4 else role
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out[conv] += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return {c: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for c, rows in out.items()}


def test_query_equals_brute_force(spark):
    for sf in ("sf0.001", "sf0.1"):
        table = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
        want = {c: by_hand(rows) for c, rows in damaged_by_hand(table).items()}
        got = {r.conv_id: tuple(r)[1:] for r in repair.op12_conversation_repair(spark, f"/root/testdata/{sf}").collect()}
        assert got == want


@pytest.fixture(scope="module")
def odd(spark):
    """Random short and long conversations of all kinds of rows, with nulls in every column and clashing names."""
    rng, rows = np.random.default_rng(12), []
    roles = ["user", "assistant", "system", "tool", "", "unit", "User", None]
    texts = ["Yes.", "No!", "cut off", "", " \t\n", "so? ", "end.\x0b", None, "…", "é?"]
    for c in range(150):
        n = int(rng.integers(1, 12)) if c else 700
        for t in range(n):
            rows.append((None if c == 7 else c, None if rng.random() < 0.05 else int(t + rng.integers(0, 2) * (t > 3) * 100), roles[rng.integers(0, 8 if c % 3 else 2)], texts[rng.integers(0, 10)] if rng.random() < 0.5 else f"t{t}."))
    rows = list({(c, t): (c, t, r, x, 0, "k") for c, t, r, x in rows}.values())  # one row a turn: ties have an order of their own
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, deal int, kind string"), rows


def test_random_conversations(spark, odd):
    df, rows = odd
    want = {c: by_hand(v) for c, v in damaged_by_hand([r[:4] for r in rows]).items()}
    from pyspark.sql import functions as F

    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_summary(repair.damage(df), gone=F.col("gone")).collect()}
    assert got == want and len(want[0][6]) > 500


def test_steps_make_the_summary(spark, odd):
    df, _ = odd
    steps, told = defaultdict(list), {}
    for r in repair.repair(df).collect():
        steps[r.conv_id].append(r)
    for r in repair.repair_summary(df).collect():
        own = sorted(steps[r.conv_id], key=lambda s: s.step)
        assert "".join(s.edit for s in own) == r.audit
        kept = [f"{s.role}:{s.text}" for s in own if s.edit != "D"]
        assert hashlib.sha256("\n".join(kept).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(s.role[0] for s in own if s.edit != "D"))
        assert sum(s.fault == "blank" for s in own) == r.blank and sum(s.fault == "truncated" for s in own) == r.truncated
        told[r.conv_id] = r
    assert set(told) == set(steps)


def test_ranks_order_all_audits():
    """Ranks of nodes equal the order of their least audits, written out letter by letter."""
    rng = np.random.default_rng(3)
    length = np.array([0, 1, 9, 40])
    start = np.cumsum(length) - length
    initial, bound, cut = rng.integers(0, 4, length.sum()), rng.random(length.sum()) < 0.2, rng.random(length.sum()) < 0.3
    cost = repair.costs_to_go(start, length, initial, bound, cut)
    target = repair.optimal_arcs(cost, start, length, initial, bound, cut)
    rank = repair.rank_nodes(target)

    def audit(v):
        out = ""
        while (k := int((target[v] >= 0).argmax())) > 0:
            out, v = out + repair.LETTERS[k], target[v, k]
        return out

    audits = [audit(v) for v in range(len(target))]
    order = {a: i for i, a in enumerate(sorted(set(audits)))}
    assert [order[a] for a in audits] == rank.tolist()


def test_edges(spark):
    kind = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], kind)
    assert repair.repair(empty).count() == 0 and repair.repair_summary(empty).count() == 0 and repair.damage(empty).count() == 0
    nothing = hashlib.sha256(b"").hexdigest()
    table = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (2, 1, "user", "Long. " * 200_000), (2, 2, "assistant", "Yes.")], kind)
    got = {r.conv_id: r for r in repair.repair_summary(table).collect()}
    assert tuple(got[1])[1:] == (0, 2, 0, 0, 1, 4, "DD", nothing)
    assert (got[2].audit, got[2].cost) == ("KK", 0)
    named = spark.createDataFrame([("x", 1, "user", "A."), ("x", 1, "user", "A.")], "conv_id string, turn int, role string, text string")
    assert [(r.conv_id, r.audit, r.duplicate) for r in repair.repair_summary(named).collect()] == [("x", "DD", 1)]
