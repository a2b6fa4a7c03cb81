"""Conversation structure repair by cost DP and prefix-doubling path ranking.

Rows of a conversation are kept, given another role, deleted or joined by inserted ones until the role
initials read ``(s?(ua)+)?`` at the least cost. A backward DP gives the cost to go of every node (rows
read, grammar state). The optimal arcs form a graph whose nodes are ranked by the first 1, 2, 4, ...
letters of their least audit (ranks of half the length and of the node that the doubled pointer reaches give the
rank of the whole); the ranks then select each node's arc, and doubled pointers read off all least
audits at once. All conversations of a portion are solved together in numpy.

A row travels twice in one exchange: first as flags and a digest, then as text. So a conversation's
edits are known before its texts pass by, and no text waits: a task holds some bytes a row, however
long the texts are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RETITLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LETTERS = "\0DIKR"  # in ASCII order; the first is the end
#: Grammar states: nothing yet, after s, after u, after a. KEEP[initial][state] is the next one (4: none), by initials other, s, u, a.
KEEP = np.array([[4, 4, 4, 4], [1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4]])
TURN = np.array([2, 2, 3, 2])  # where a user or assistant row leads that fits
ACCEPT = np.array([True, False, False, True])
NEVER = np.int64(1) << 60
#: Rows of a portion; at least ``LEAST_DEALS`` portions, so that small inputs use all tasks.
DEAL, LEAST_DEALS = 4096, 512
SPACE = " \t\n\x0b\x0c\r"


def _relaxed(base: np.ndarray) -> np.ndarray:
    """Costs to go where inserted rows may come first; two of them lead to every state."""
    cost = base
    for _ in range(2):
        cost = np.minimum(base, INSERT + cost[:, TURN])
    return cost


def _row_costs(after: np.ndarray, initial: np.ndarray, bound: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """(rows, state, letter D I K R) costs to go by what happens to the row; ``after`` are those of the next position."""
    wide = np.hstack([after, np.full((len(after), 1), NEVER)])
    stay = np.where(bound, NEVER, TRUNCATED * cut.astype(np.int64))[:, None]
    keep = stay + np.take_along_axis(wide, KEEP[initial], 1)
    return np.stack([DELETE + after, np.full_like(after, NEVER), keep, stay + RETITLE + after[:, TURN]], 2)


def costs_to_go(start: np.ndarray, length: np.ndarray, initial: np.ndarray, bound: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """(position, state) costs; conversation c has ``length[c] + 1`` positions from ``start[c] + c`` on.

    ``initial``, ``bound`` (must go) and ``cut`` (truncated) are those of the rows. One step back from
    the ends is taken in all conversations that are long enough.
    """
    base = start + np.arange(len(start))
    cost = np.empty((len(initial) + len(start), 4), np.int64)
    cost[base + length] = _relaxed(np.where(ACCEPT, 0, NEVER)[None, :].repeat(len(start), 0))
    by_length = np.argsort(-length, kind="stable")
    longer = len(start) - np.searchsorted(np.sort(length), np.arange(1, length.max(initial=0) + 1))
    for back, many in enumerate(longer.tolist(), 1):
        c = by_length[:many]
        row, at = start[c] + length[c] - back, base[c] + length[c] - back
        cost[at] = _relaxed(_row_costs(cost[at + 1], initial[row], bound[row], cut[row]).min(2))
    return cost


def optimal_arcs(cost: np.ndarray, start: np.ndarray, length: np.ndarray, initial, bound, cut) -> tuple[np.ndarray, np.ndarray]:
    """(node, letter) targets of arcs on cheapest ways, -1 for none; a node is 4 * position + state. A letter leads to one node."""
    last = np.zeros(len(cost), bool)
    last[start + np.arange(len(start)) + length] = True
    at = np.flatnonzero(~last)  # positions before a row, in the order of the rows
    target = np.full((len(cost), 4, 5), -1)
    state = np.arange(4)
    insert = INSERT + cost[:, TURN] == cost
    target[:, :, 2] = np.where(insert, 4 * np.arange(len(cost))[:, None] + TURN, -1)
    ends = last[:, None] & ACCEPT & (cost == 0)
    target[:, :, 0] = np.where(ends, 4 * np.arange(len(cost))[:, None] + state, -1)
    if len(at):
        best = _row_costs(cost[at + 1], initial, bound, cut) == cost[at][:, :, None]
        nexts = 4 * (at + 1)[:, None]
        target[at, :, 1] = np.where(best[:, :, 0], nexts + state, -1)
        target[at, :, 3] = np.where(best[:, :, 2], nexts + KEEP[initial], -1)
        target[at, :, 4] = np.where(best[:, :, 3], nexts + TURN, -1)
    return target.reshape(-1, 5)


def rank_nodes(target: np.ndarray) -> np.ndarray:
    """The rank of each node's least audit among those of all nodes (equal audits share a rank).

    Ranks by one letter first; then, again and again, by twice as many: the rank by the first half and
    that of the node the pointer reaches. Ends are reached in the end by all pointers.
    """
    letter = (target >= 0).argmax(1)
    rank, reach = letter.astype(np.int64), target[np.arange(len(target)), letter]
    while rank[reach].any():
        both = rank * (rank.max() + 1) + rank[reach]
        rank = np.unique(both, return_inverse=True)[1].astype(np.int64)  # an end's own is the least: 0, followed by 0
        reach = reach[reach]
    return np.unique(rank * (rank.max() + 1) + rank[reach], return_inverse=True)[1] if len(rank) else rank


def least_paths(target: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start number, node, letter) along the least audits from the nodes ``first``, in order.

    Ranks select the arc of each node; pointers doubled from them extend all paths to twice their length.
    """
    rank = rank_nodes(target)
    many = len(rank) + 1
    value = np.where(target >= 0, np.arange(5) * many + rank[target], 5 * many)
    letter = value.argmin(1)
    step = target[np.arange(len(target)), letter]
    own, place, node, reach, far = np.arange(len(first)), np.zeros(len(first), np.int64), first, step, 1
    alive = letter[node] > 0
    own, place, node = own[alive], place[alive], node[alive]
    while len(node):
        more = reach[node]
        go = letter[more] > 0
        if not go.any():
            break
        own, place, node = np.r_[own, own[go]], np.r_[place, place[go] + far], np.r_[node, more[go]]
        reach, far = reach[reach], 2 * far
    order = np.lexsort((place, own))
    return own[order], node[order], letter[node[order]]


class Portion:
    """The rows of some whole conversations without their texts, and their repair."""

    def __init__(self):
        self.parts: list[dict] = []

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append({n: batch.column(n) for n in ("conv", "turn", "initial", "kind", "digest")})

    def solve(self) -> None:
        names = [x for p in self.parts for x in p["conv"].to_pylist()]
        column = lambda n: np.concatenate([p[n].to_numpy(zero_copy_only=False) for p in self.parts])
        kind, initial = column("kind"), column("initial")
        turn = pa.chunked_array([p["turn"] for p in self.parts], self.parts[0]["turn"].type)
        late, turns = np.asarray(turn.is_null()), turn.fill_null(0).to_numpy()
        digest = np.frombuffer(b"".join(x or bytes(16) for p in self.parts for x in p["digest"].to_pylist()), np.int64).reshape(-1, 2)
        new = np.array([True, *[a != b for a, b in zip(names, names[1:])]])
        self.names = [names[i] for i in np.flatnonzero(new)]
        conv = np.cumsum(new) - 1
        real = kind < 3  # others only name their conversation
        self.parts, count = [], len(self.names)
        conv, kind, initial, late, turns, digest = conv[real], kind[real], initial[real], late[real], turns[real], digest[real]
        n = len(conv)
        length = np.bincount(conv, minlength=count)
        start = np.cumsum(length) - length
        order = np.lexsort((np.arange(n), digest[:, 1], digest[:, 0], conv))
        same = np.zeros(n, bool)
        if n:
            a, b = order[:-1], order[1:]
            same[b] = (conv[a] == conv[b]) & (digest[a] == digest[b]).all(1)
        blank, cut = kind == 1, kind == 2
        again = same & ~blank
        cut = cut & ~again
        with_next = np.flatnonzero(conv[:-1] == conv[1:]) if n else np.zeros(0, int)
        pair = 4 * initial[with_next].astype(int) + initial[with_next + 1]
        odd = with_next[~np.isin(pair, (4 * 1 + 2, 4 * 2 + 3, 4 * 3 + 2))]
        tally = lambda flags: np.bincount(conv[flags], minlength=count)
        self.blank, self.duplicate, self.truncated, self.illegal = tally(blank), tally(again), tally(cut), np.bincount(conv[odd], minlength=count)
        timed = np.flatnonzero(~late)
        c, t = conv[timed], turns[timed]  # sorted in each conversation
        first = np.r_[True, c[1:] != c[:-1]] if len(c) else np.zeros(0, bool)
        fresh = first | np.r_[True, t[1:] != t[:-1]] if len(c) else first
        self.gaps = np.zeros(count, np.int64)
        heads = np.flatnonzero(first)
        tails = np.r_[heads[1:], len(c)] - 1
        if len(heads):
            self.gaps[c[heads]] = t[tails] - t[heads] + 1
            self.gaps -= np.bincount(c[fresh], minlength=count)
        bound = blank | again
        cost = costs_to_go(start, length, initial, bound, cut)
        base = start + np.arange(count)
        own, node, letter = least_paths(optimal_arcs(cost, start, length, initial, bound, cut), 4 * base)
        self.cost = cost[base, 0]
        audit = np.frombuffer(LETTERS.encode(), np.uint8)[letter].tobytes().decode()
        ends = np.cumsum(np.bincount(own, minlength=count))
        self.audit = [audit[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        # what stands before each position and what happens to its row, for the texts to come
        at, state = node // 4, node % 4
        self.added, self.adds = np.zeros((len(cost), 2), np.uint8), np.zeros(len(cost), np.uint8)
        put = letter == 2
        self.adds[:] = np.bincount(at[put], minlength=len(cost))
        second = put & np.r_[False, put[:-1] & (at[1:] == at[:-1]) & (own[1:] == own[:-1])] if len(put) else put
        self.added[at[put], second[put].astype(int)] = TURN[state[put]]
        self.edit, self.role = np.zeros(len(cost), np.uint8), np.zeros(len(cost), np.uint8)
        self.edit[at[~put]] = letter[~put]
        self.role[at[~put]] = TURN[state[~put]]
        self.length, self.base, self.fault = length, base, np.where(blank, 1, np.where(again, 2, np.where(cut, 3, 0)))

    def steps(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        """(conversation number, letter, fault, turn, role bytes, text bytes) in order, (number, None...) at each end; ``rows`` are (turn, role, text)."""
        at = 0
        for c, (begin, n) in enumerate(zip(self.base.tolist(), self.length.tolist())):
            for p in range(begin, begin + n + 1):
                for k in range(self.adds[p]):
                    yield c, "I", 0, None, b"user" if self.added[p, k] == 2 else b"assistant", b""
                if p < begin + n:
                    turn, role, text = next(rows)
                    edit = self.edit[p]
                    if edit == 4:
                        role = b"user" if self.role[p] == 2 else b"assistant"
                    yield c, LETTERS[edit], int(self.fault[at]), turn, role, text
                    at += 1
            yield c, None, 0, None, None, None


def _portions(batches) -> Iterator[tuple[Portion, Iterator[tuple]]]:
    """A solved portion and the stream of its rows' texts, for each portion of the sorted stream."""
    pieces = _pieces(batches)
    held = next(pieces, None)
    while held:
        deal, portion = held[0], Portion()
        while held and held[:2] == (deal, 0):
            portion.add(held[2])
            held = next(pieces, None)
        portion.solve()

        def rows():
            nonlocal held
            while held and held[:2] == (deal, 1):
                batch = held[2]
                yield from zip(batch.column("turn").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist())
                held = next(pieces, None)

        texts = rows()
        yield portion, texts
        for _ in texts:  # moves on to the next portion
            pass


def _pieces(batches) -> Iterator[tuple]:
    """(deal, pass, rows) slices of the batches."""
    for batch in batches:
        if batch.num_rows:
            deal, turn = batch.column("deal").to_numpy(), batch.column("pass").to_numpy()
            cuts = np.flatnonzero((deal[1:] != deal[:-1]) | (turn[1:] != turn[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                yield int(deal[a]), int(turn[a]), batch.slice(a, b - a)


def _dealt(rows: DataFrame, names: dict[str, str], gone: Column | None, many: int | None) -> DataFrame:
    """Rows twice, flags first, in the order of the repair; whole conversations in a task."""
    spark = rows.sparkSession
    role, text = (F.coalesce(F.col(names[n]).cast("string"), F.lit(" ")) for n in ("role", "text"))
    rows = rows.select(F.col(names["id"]).alias("conv"), F.col(names["turn"]).cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("gone"))
    deals = max(LEAST_DEALS, ceil((rows.count() if many is None else many) / DEAL))
    end = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    kind = F.when(F.col("gone"), 3).when(end == "", 1).when(~end.isin(".", "!", "?"), 2).otherwise(0)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    flags = rows.select(F.pmod(F.xxhash64("conv"), F.lit(deals)).cast("int").alias("deal"), "conv", "turn", "role", "text", kind.cast("tinyint").alias("kind"), initial.cast("tinyint").alias("initial"), digest.alias("digest"))
    twice = flags.withColumn("pass", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    twice = twice.withColumn("text", F.when(F.col("pass") == 1, F.col("text").cast("binary"))).withColumn("role", F.col("role").cast("binary"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(deals / 64))
    return twice.repartition(parts, "deal").sortWithinPartitions("deal", "pass", F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "digest")


_NAMES = {"id": "conv_id", "turn": "turn", "role": "role", "text": "text"}


def repair(rows: DataFrame, *, names: dict[str, str] = _NAMES, gone: Column | None = None, many: int | None = None) -> DataFrame:
    """(id, step, edit, fault, turn, role, text): the edits of every conversation in order.

    ``edit`` is K, R, D or I; ``role`` and ``text`` are those of the repaired row (those deleted for
    D); ``fault`` is blank, duplicate, truncated or null. Rows count by turn, null first; ties by role and
    digest. Null roles and texts count as one space. Roles that begin with none of s, u, a are never
    kept as they are. Null ids are one conversation; repeated rows are duplicates; an empty table gives
    none. Where ``gone`` holds, a row only names its conversation. ``many`` may give the number of rows.
    """

    def run(batches):
        for portion, texts in _portions(batches):
            made, step = [], 0
            for c, letter, fault, turn, role, text in portion.steps(texts):
                if letter is None:
                    step = 0
                    continue
                made.append((portion.names[c], step, letter, (None, "blank", "duplicate", "truncated")[fault], turn, role, text))
                step += 1
                if len(made) == 10_000:
                    yield batch_of(made)
                    made = []
            if made:
                yield batch_of(made)

    kind = rows.schema[names["id"]].dataType
    types = [_arrow(kind), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
    fields = ["conv", "step", "edit", "fault", "turn", "role", "text"]
    batch_of = lambda made: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=fields)
    schema = T.StructType([T.StructField(n, t) for n, t in zip(fields, [kind, T.LongType(), T.StringType(), T.StringType(), T.LongType(), T.BinaryType(), T.BinaryType()])])
    out = _dealt(rows, names, gone, many).mapInArrow(run, schema)
    return out.select(F.col("conv").alias(names["id"]), "step", "edit", "fault", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def repair_summary(rows: DataFrame, *, names: dict[str, str] = _NAMES, gone: Column | None = None, many: int | None = None) -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conversation.

    The same edits as ``repair`` (see there for nulls and ties), counted and hashed as they pass.
    ``gaps`` is the span of the turns less their number; a conversation without rows has zeros.
    """

    def run(batches):
        for portion, texts in _portions(batches):
            digests, hashed, begun = [], hashlib.sha256(), False
            for _, letter, _, _, role, text in portion.steps(texts):
                if letter is None:
                    digests.append(hashed.hexdigest())
                    hashed, begun = hashlib.sha256(), False
                elif letter != "D":
                    hashed.update(b"\n%b:" % role if begun else b"%b:" % role)
                    hashed.update(text)
                    begun = True
            numbers = [portion.gaps, portion.blank, portion.duplicate, portion.truncated, portion.illegal, portion.cost]
            yield pa.RecordBatch.from_arrays([pa.array(portion.names, id_type), *[pa.array(x.astype(np.int64)) for x in numbers], pa.array(portion.audit, pa.string()), pa.array(digests)], names=fields)

    kind = rows.schema[names["id"]].dataType
    id_type, fields = _arrow(kind), ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    schema = T.StructType([T.StructField("conv", kind), *[T.StructField(n, T.LongType()) for n in fields[1:7]], *[T.StructField(n, T.StringType()) for n in fields[7:]]])
    return _dealt(rows, names, gone, many).mapInArrow(run, schema).withColumnRenamed("conv", names["id"])


def _arrow(kind: T.DataType) -> pa.DataType:
    return {T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}.get(kind, pa.string())


def damage(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, gone)`` with faults by crc32 of ``conv_id:turn`` modulo 20, nulls as one space.

    0 drops the row (``gone``), 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 sets role user.
    """
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fault.alias("fault"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by rule, and its cheapest repair."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair_summary(damage(table), gone=F.col("gone"), many=table.count())


def _edited(state: str, cost: str, letter: str, row: str = "''") -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {row}}}"


def _least(*states: str) -> str:
    return f"list_sort([{', '.join(states)}])[1]"


def _kept(states: str, initial: str) -> list[str]:
    """Keep or retitle the row from these states, where it may stay and fits."""
    role = {"s": "system", "u": "user", "a": "assistant"}[initial]
    out = []
    for x in states.split():
        keep = _edited(x, "5 * CAST(cut AS INT)", "K", "role || ':' || text || chr(10)")
        out.append(f"CASE WHEN NOT bound AND left(role, 1) = '{initial}' THEN {keep} ELSE none END")
        if initial != "s":
            again = _edited(x, "1 + 5 * CAST(cut AS INT)", "R", f"'{role}:' || text || chr(10)")
            out.append(f"CASE WHEN NOT bound THEN {again} ELSE none END")
    return out


_NONE = "{'c': CAST(1000000000000 AS BIGINT), 'a': '', 't': ''}"
_MORE_U = _least("u", *(_edited(x, "5", "I", "'user:' || chr(10)") for x in "oca"))
_MORE_A = _least("a", _edited("u", "5", "I", "'assistant:' || chr(10)"))

#: A forward DP that carries, for each grammar state (o: nothing yet, c: after s, u, a), the least cost, audit and text.
ORACLE_SQL = rf"""
WITH RECURSIVE faults AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda acc, c: list_reduce(list_prepend(xor(acc, c), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)), CAST(4294967295 AS BIGINT)) % 20 AS f
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM faults, unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copies(copy)
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open_end
  FROM damaged
), seen AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS following, i = max(i) OVER (PARTITION BY conv_id) AS last
  FROM ordered
), rows AS (
  SELECT *, blank OR again AS bound, NOT blank AND NOT again AND open_end AS cut FROM seen
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated,
         count(*) FILTER (NOT last AND left(role, 1) || following NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM rows GROUP BY conv_id
), ids AS (
  SELECT DISTINCT conv_id FROM conversations
), dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS o, {_NONE} AS c, {_NONE} AS u, {_NONE} AS a, {_NONE} AS none FROM ids
  UNION ALL
  SELECT conv_id, i, {_edited("o", "2", "D")}, {_least(_edited("c", "2", "D"), *_kept("o", "s"))}, {_least(_edited("u", "2", "D"), *_kept("o c a", "u"))}, {_least(_edited("a", "2", "D"), *_kept("u", "a"))}, none
  FROM (
    SELECT more.* REPLACE ({_MORE_A} AS a), r.role, r.text, r.bound, r.cut, r.i
    FROM (SELECT conv_id, i AS before, o, c, {_MORE_U} AS u, a, none FROM dp) more JOIN rows r ON r.conv_id IS NOT DISTINCT FROM more.conv_id AND r.i = more.before + 1
  ) AS at_row
), ends AS (
  SELECT dp.conv_id, o, {_MORE_U} AS u, a FROM dp LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id WHERE dp.i = coalesce(n.n, 0)
), best AS (
  SELECT conv_id, {_least("o", _MORE_A)} AS x FROM ends
)
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       x.c AS cost, x.a AS audit, sha256(CASE WHEN x.t = '' THEN '' ELSE left(x.t, length(x.t) - 1) END) AS repaired_sha256
FROM best LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM best.conv_id
"""
