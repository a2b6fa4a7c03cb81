"""Suffix-array dedup of repeated byte strings with a run-length (r-) index.

Which bytes a text repeats from documents with smaller ids is found in four steps. Texts are dealt by
hash into packets of about ``PACKET`` bytes; all that is said about a packet is packed into few rows.

1. Anchors. Every window of ``LENGTH`` bytes selects its smallest rolling hash of ``GRAM`` bytes, so
   equal windows hold equal anchors at equal places. An anchor's context is all that windows around
   it can reach, cut at the text's ends.
2. Classes. Anchors are dealt by hash into shards; those with equal anchor and context form a class.
   All members but those of the smallest id repeat their whole context. A class whose anchor also
   occurs in other contexts with the same 13 bytes on one side asks for its context's bytes, at every
   place the smallest id has it. Equality is that of over 100 bits of digests.
3. Index. These contexts are dealt again by (anchor, 13 bytes to the right) and (anchor, 13 bytes to
   the left); two that share ``LENGTH`` bytes around an anchor share one of the two. Each share gets a
   run-compressed Burrows-Wheeler transform. From every end of every context a matching statistic
   is streamed backwards: the longest string that ends there and occurs twice, up to ``LENGTH``. Ends
   that reach it fall into intervals, and because all contexts of the share are streamed, the ends of
   an interval are all its occurrences: those of larger ids than its smallest are marked. So the
   bytes themselves decide here, and suffix samples to locate occurrences aren't needed.
4. Removal. Marks meet their packet and the bytes are cut.

Hot strings: of equal anchors with equal contexts a packet sends one, and only what surrounds a hot
string in different ways asks for bytes, where equal contexts count once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM  # how far a window can reach beyond an anchor on either side
SIDE = SPAN // 2
PACKET, CHUNK, SHARD_BYTES = 4 << 20, 1 << 18, 16 << 20
LAST = (1 << 63) - 1  # orders a null id after all others

_U = np.uint64
_B = [_U(pow(0x9E3779B97F4A7C15, n, 1 << 64)) for n in range(GRAM + 1)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def _grams(b: np.ndarray) -> np.ndarray:
    """Hash of the GRAM (24 = 16 + 8) bytes from each place of ``b``, by doubling."""
    h = b.astype(_U) + _U(1)
    at = {1: h}
    for n in (1, 2, 4, 8):
        at[2 * n] = at[n][:-n] + at[n][n:] * _B[n]
    return _mix(at[16][: len(b) - GRAM + 1] + at[8][16:] * _B[16])


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """Least (or greatest) of each ``width`` neighbours, by doubling."""
    n, out = 1, x
    while 2 * n <= width:
        out = least(out[:-n], out[n:])
        n *= 2
    return least(out[: len(x) - width + 1], out[width - n :][: len(x) - width + 1]) if n < width else out


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, place, context start, context end, hash, context digest, digests to the right and left) of all anchors, in order.

    A side's digest is that of the anchor and ``SIDE`` more bytes; 0 where the text ends before.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)])
    empty = np.zeros(0, np.int64)
    if start[-1] < LENGTH:
        return empty, empty, empty, empty, *[empty.astype(_U)] * 4
    h = _grams(np.frombuffer(b"".join(texts), np.uint8))
    short = (h >> _U(32)).astype(np.uint32) | np.uint32(1)
    low = _sliding(short, SPAN + 1, np.minimum)  # one for each window of LENGTH bytes
    for e in start[1:-1]:  # windows across two texts select nothing
        low[max(0, e - LENGTH + 1) : e] = 0
    padded = np.concatenate([np.zeros(SPAN, np.uint32), low, np.zeros(SPAN, np.uint32)])
    place = np.flatnonzero(_sliding(padded, SPAN + 1, np.maximum) == short)
    text = np.searchsorted(start, place, "right") - 1
    a, b = np.maximum(place - SPAN, start[text]), np.minimum(place + LENGTH, start[text + 1])
    ctx = (place - a).astype(_U) * _U(131) + (b - place).astype(_U)
    for at in (a, np.minimum(a + GRAM, b - GRAM), np.minimum(a + 2 * GRAM, b - GRAM), b - GRAM):
        ctx = _mix(ctx * _B[3] + h[at])
    right, left = place + SIDE, place - SIDE  # grams that end or begin SIDE bytes beyond the anchor
    r = np.where(right + GRAM <= b, _mix(h[place] * _B[5] + h[np.minimum(right, len(h) - 1)]) | _U(1), _U(0))
    l = np.where(left >= a, _mix(h[place] * _B[7] + h[np.maximum(left, 0)]) | _U(1), _U(0))
    base = start[text]
    return text, place - base, a - base, b - base, h[place], ctx, r, l


def _chunks(texts: list[bytes]):
    """Slices of ``texts`` of about ``CHUNK`` bytes, so that hash arrays stay small."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _split(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, 40 further bits) of an anchor's hash."""
    return ((h >> _U(40)) % _U(shards)).astype(np.int64), h & _U((1 << 40) - 1)


_ENTRY = "packet long, shard int, docs binary, counts binary, marks binary, contexts binary"
_REPLY = "packet long, shard int, cut binary, ask_right binary, ask_left binary, texts binary, starts binary"
_SNIPPET = "to int, packet long, number int, doc long, at long, snippet binary"
_MATCH = "packet long, texts binary, starts binary"


class Packet:
    """The rows of one packet in order of (id, text), with their anchors.

    ``later`` marks anchors whose context a smaller id of the same packet has: known to repeat.
    """

    def __init__(self, table: pa.Table, shards: int):
        docs, texts = table.column("doc").to_pylist(), table.column("text").to_pylist()
        order = sorted(range(len(docs)), key=lambda k: (docs[k], texts[k]))
        self.docs = np.array([docs[k] for k in order], np.int64)
        self.texts = [texts[k] for k in order]
        parts = []
        for i, j in _chunks(self.texts):
            text, *more = anchors(self.texts[i:j])
            parts.append((text + i, *more))
        self.text, self.place, self.start, self.end, self.hash, ctx, self.right, self.left = (np.concatenate(c) for c in zip(*parts))
        self.shard, self.mark = _split(self.hash, shards)
        sides = (self.right >> _U(48) | self.right & _U(1)) | (self.left >> _U(48) | self.left & _U(1)) << _U(16)
        self.context = (ctx & _U(0xFFFFFFFF)) | sides << _U(32)
        order = np.lexsort((self.text, ctx, self.hash))
        same = np.zeros(len(order), bool)
        same[1:] = (self.hash[order][1:] == self.hash[order][:-1]) & (ctx[order][1:] == ctx[order][:-1])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(order) else order
        doc = self.docs[self.text[order]]
        self.later = np.zeros(len(order), bool)
        self.later[order] = doc > doc[head]

    def sent(self, shard: int) -> np.ndarray:
        """The anchors of which a shard is told, in order."""
        return np.flatnonzero((self.shard == shard) & ~self.later)

    def told(self, replies: pa.Table, field: str) -> np.ndarray:
        """The anchors that ``replies`` name in ``field``."""
        out = []
        for shard, bits in zip(replies.column("shard").to_pylist(), replies.column(field).to_pylist()):
            if shard is not None and bits:
                at = self.sent(shard)
                out.append(at[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(at)).view(bool)])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _binary(*columns) -> list[pa.Array]:
    return [pa.array(c, pa.binary()) for c in columns]


def _classify(table: pa.Table) -> pa.Table:
    """One shard's entries -> for each entry, which anchors repeat their context and which must show it, as bits."""
    docs, marks, ctx, sizes = [], [], [], []
    for d, c, m, x in zip(*[table.column(n).to_pylist() for n in ("docs", "counts", "marks", "contexts")]):
        docs.append(np.repeat(np.frombuffer(d, "<i8"), np.frombuffer(c, "<u4")))
        wide = np.zeros((len(docs[-1]), 8), np.uint8)
        wide[:, :5] = np.frombuffer(m, np.uint8).reshape(-1, 5)
        marks.append(wide.reshape(-1).view("<u8"))
        ctx.append(np.frombuffer(x, "<u8"))
        sizes.append(len(docs[-1]))
    docs, marks, ctx = np.concatenate(docs), np.concatenate(marks), np.concatenate(ctx)
    cut, right, left = (np.zeros(len(docs), bool) for _ in range(3))
    order = np.lexsort((docs, ctx, marks))
    d, m, c = docs[order], marks[order], ctx[order]
    new_mark = np.r_[True, m[1:] != m[:-1]]
    new_class = new_mark | np.r_[True, c[1:] != c[:-1]]
    heads = np.flatnonzero(new_class)
    klass = np.cumsum(new_class) - 1
    cut[order] = d > d[heads][klass]
    run = (np.cumsum(new_mark) - 1)[heads]  # the anchor of each class
    for shift, ask in ((32, right), (48, left)):  # only classes that also agree on one side can share LENGTH bytes
        side = (c[heads] >> _U(shift)) & _U(0xFFFF)
        near = np.lexsort((side, run))
        begin = np.flatnonzero(np.r_[True, (run[near][1:] != run[near][:-1]) | (side[near][1:] != side[near][:-1])])
        lo, hi = np.minimum.reduceat(d[heads][near], begin), np.maximum.reduceat(d[heads][near], begin)
        group = np.zeros(len(near), np.int64)
        group[near] = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(near)]))
        ask[order] = (d == d[heads][klass]) & ((lo < hi)[group] & (side > 0))[klass]  # every place of the head's document
    ends = np.cumsum(sizes)
    bits = [[np.packbits(x[e - n : e]).tobytes() for e, n in zip(ends, sizes)] for x in (cut, right, left)]
    none = pa.nulls(len(sizes), pa.binary())
    return pa.table([table.column("packet"), table.column("shard"), *_binary(*bits), none, none], names=["packet", "shard", "cut", "ask_right", "ask_left", "texts", "starts"])


SEED = 32


def suffix_order(t: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order of ``depth`` or more symbols, rank of each by its first ``SEED``, places of new ranks).

    Prefix doubling from eight symbols a machine word; equal prefixes share a rank, which is the place
    of the first of them, so a rank and the next one bound the interval of a seed.
    """
    n = len(t)
    padded = np.concatenate([t, np.zeros(8, t.dtype)]).astype(_U)
    key = np.zeros(n, _U)
    for i in range(8):
        key = key << _U(8) | padded[i : i + n]
    width, seed, bounds = 8, np.zeros(n, np.int64), np.zeros(0, np.int64)
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        fresh = np.r_[True, sorted_[1:] != sorted_[:-1]] if n else np.zeros(0, bool)
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        if width == SEED:
            seed, bounds = rank, np.flatnonzero(fresh)
        if width >= max(depth, SEED):
            return order, seed, bounds
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        key = (rank * (n + 1) + after).astype(_U)
        width *= 2


class RunIndex:
    """Run-compressed Burrows-Wheeler transform with a table of the intervals of all ``SEED``-symbol strings.

    ``text`` is a sequence of symbols 1 to 255 in which every document ends with a 0. The suffix order
    serves to build it and isn't kept; of the transform only runs are: their symbols, starts and
    lengths, and the symbol's count before each run.
    """

    def __init__(self, text: np.ndarray, depth: int):
        order, self.seed, bounds = suffix_order(text, depth)
        bwt = text[order - 1].astype(np.int64)  # text[-1] is a 0
        start = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])
        self.n, self.start, self.symbol = len(text), start, bwt[start]
        self.length = np.diff(np.r_[start, len(bwt)])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=256))])
        by_symbol = np.lexsort((start, self.symbol))
        before = np.cumsum(self.length[by_symbol]) - self.length[by_symbol]
        self.before = np.empty(len(start), np.int64)
        self.before[by_symbol] = before - self.first[self.symbol[by_symbol]]
        self.key = self.symbol[by_symbol] * (self.n + 1) + start[by_symbol]  # runs of a symbol, in order of place
        self.run = by_symbol
        self.seed_end = np.empty(self.n + 1, np.int64)
        self.seed_end[bounds] = np.r_[bounds[1:], self.n]

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` in the transform before ``place``."""
        i = np.searchsorted(self.key, symbol * (self.n + 1) + place, "left") - 1
        run = self.run[np.maximum(i, 0)]
        own = (i >= 0) & (self.symbol[run] == symbol)
        return np.where(own, self.before[run] + np.minimum(self.length[run], place - self.start[run]), 0)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffixes that start with ``symbol`` and go on as in [lo, hi)."""
        return self.first[symbol] + self.rank(symbol, lo), self.first[symbol] + self.rank(symbol, hi)


def earlier_matches(snippets: list[bytes], docs: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each snippet, the offsets whose ``length`` bytes also occur in a snippet of a smaller document.

    Equal snippets are indexed once, for the smallest of their documents; the others match it whole.
    """
    place: dict[bytes, int] = {}
    same = np.array([place.setdefault(s, len(place)) for s in snippets], np.int64)
    own = np.full(len(place), LAST, np.int64)
    np.minimum.at(own, same, docs)
    hits = _matches(list(place), own, length)
    return [np.arange(max(0, len(s) - length + 1)) if d > own[i] else hits[i] for s, d, i in zip(snippets, docs, same)]


#: Symbols of the index: bytes shifted by one, 255 (never in UTF-8) free for it, 0 for the ends.
_SHIFT = bytes(min(255, b + 1) for b in range(256))


def _matches(snippets: list[bytes], docs: np.ndarray, length: int) -> list[np.ndarray]:
    sizes = np.array([len(s) for s in snippets], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.frombuffer(b"\0".join(s.translate(_SHIFT) for s in snippets) + b"\0", np.uint8)
    index = RunIndex(text, length)
    many = np.maximum(sizes - length + 1, 0)
    who = np.repeat(np.arange(len(snippets)), many)
    offset = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
    end = start[who] + offset + length
    depth = SEED if length > SEED else 0
    lo = index.seed[end - SEED] if depth else np.zeros(len(who), np.int64)
    hi = index.seed_end[lo] if depth else np.full(len(who), len(text))
    live = np.flatnonzero(hi - lo > 1)
    live = live[np.argsort(lo[live])]  # neighbours in the index side by side
    lo, hi = lo[live], hi[live]
    for k in range(depth + 1, length + 1):  # a string that occurs once has reached its statistic, under ``length``
        lo, hi = index.step(text[end[live] - k].astype(np.int64), lo, hi)
        more = hi - lo > 1
        live, lo = live[more], lo[more]
        hi = hi[more]
    out = np.zeros(len(who), bool)
    if len(live):
        order = np.argsort(lo, kind="stable")
        begin = np.flatnonzero(np.r_[True, lo[order][1:] != lo[order][:-1]])
        doc = docs[who[live[order]]]
        out[live[order]] = np.repeat(np.minimum.reduceat(doc, begin), np.diff(np.r_[begin, len(doc)])) < doc
    bounds = np.cumsum(many)
    return [offset[b - m : b][out[b - m : b]] for b, m in zip(bounds, many)]


def _runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of the spans."""
    order = np.argsort(start)
    start, end = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.flatnonzero(np.r_[True, start[1:] > end[:-1]]) if len(end) else np.zeros(0, np.int64)
    return start[new], end[np.r_[new[1:] - 1, len(end) - 1]] if len(end) else end


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row.

    A byte goes if a string of 50 bytes over it also starts in a document with a smaller id; overlaps
    count, and what repeats is judged on the input. ``spans`` lists the removed runs (start, end).
    Ids are integers; a null id comes after all others; rows of one id never repeat one another, so
    repeated rows get equal results. Null and empty texts have 0 bytes; texts under 50 bytes lose
    nothing; an empty table gives none; bytes that aren't UTF-8 count like any. Texts are whole, and
    each is held by one task, as in the input.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "rindex")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    packets, shards = max(1, -(-total // PACKET)), max(spark.sparkContext.defaultParallelism, -(-total // SHARD_BYTES))
    texts = rows.withColumn("packet", F.pmod(F.xxhash64("doc", "text"), F.lit(packets)))

    def find(table: pa.Table) -> pa.Table:
        packet = Packet(table, shards)
        out: list[tuple] = []
        for s in np.unique(packet.shard[~packet.later]):
            at = packet.sent(s)
            who, counts = np.unique(packet.text[at], return_counts=True)
            marks = packet.mark[at].astype("<u8").view("u1").reshape(-1, 8)[:, :5]
            out.append((int(s), packet.docs[who].tobytes(), counts.astype("<u4").tobytes(), marks.tobytes(), packet.context[at].astype("<u8").tobytes()))
        shard, *columns = zip(*out) if out else [()] * 5
        return pa.table([table.column("packet").slice(0, 1).take(pa.array([0] * len(out), pa.int64())), pa.array(shard, pa.int32()), *_binary(*columns)], names=["packet", "shard", "docs", "counts", "marks", "contexts"])

    entries = texts.groupBy("packet").applyInArrow(find, _ENTRY)
    replies = work.table(entries.groupBy("shard").applyInArrow(_classify, _REPLY), "replies")

    def show(table: pa.Table, told: pa.Table) -> pa.Table:
        packet = Packet(table, shards)
        right, left = packet.told(told, "ask_right"), packet.told(told, "ask_left")
        # a window with SIDE bytes to the right is the right side's, any other has more than SIDE to the left
        start = np.r_[np.maximum(packet.start[right], packet.place[right] - SIDE), packet.start[left]]
        end = np.r_[packet.end[right], np.minimum(packet.end[left], packet.place[left] - SIDE - 1 + LENGTH)]
        to = (_mix(np.r_[packet.right[right], packet.left[left] ^ _U(LAST)]) % _U(packets)).astype(np.int32)
        text = packet.text[np.r_[right, left]]
        keep = end - start >= LENGTH
        start, end, to, text = start[keep], end[keep], to[keep], text[keep]
        snippets = [packet.texts[k][a:b] for k, a, b in zip(text.tolist(), start.tolist(), end.tolist())]
        numbers = np.full(len(to), table.column("packet")[0].as_py() if len(table) else 0)
        columns = [pa.array(x) for x in (to, numbers, text.astype(np.int32), packet.docs[text], start)]
        return pa.table([*columns, *_binary(snippets)], names=["to", "packet", "number", "doc", "at", "snippet"])

    def match(table: pa.Table) -> pa.Table:
        packet, number, doc, at = (table.column(n).to_numpy() for n in ("packet", "number", "doc", "at"))
        hits = earlier_matches(table.column("snippet").to_pylist(), doc)
        many = np.array([len(h) for h in hits])
        starts = np.concatenate(hits) + np.repeat(at, many)
        packet, number = np.repeat(packet, many), np.repeat(number, many)
        order = np.argsort(packet, kind="stable")
        home, first = np.unique(packet[order], return_index=True)
        parts = [order[i:j] for i, j in zip(first, [*first[1:], len(order)])]
        return pa.table([pa.array(home, pa.int64()), *_binary([number[p].astype("<i4").tobytes() for p in parts], [starts[p].astype("<i8").tobytes() for p in parts])], names=["packet", "texts", "starts"])

    shown = texts.groupBy("packet").cogroup(replies.groupBy("packet")).applyInArrow(show, _SNIPPET)
    matched = shown.groupBy("to").applyInArrow(match, _MATCH)
    none = F.lit(None).cast("binary")
    found = replies.select("packet", "shard", "cut", "texts", "starts").unionByName(matched.select("packet", F.lit(None).cast("int").alias("shard"), none.alias("cut"), "texts", "starts"))

    def remove(table: pa.Table, told: pa.Table) -> pa.Table:
        packet = Packet(table, shards)
        size = np.array([len(t) for t in packet.texts], np.int64)
        base = np.cumsum(size + 1) - size - 1  # texts lie one apart, so that runs never touch across them
        cut = np.r_[np.flatnonzero(packet.later), packet.told(told, "cut")]
        start, end = [base[packet.text[cut]] + packet.start[cut]], [base[packet.text[cut]] + packet.end[cut]]
        for texts_, starts in zip(told.column("texts").to_pylist(), told.column("starts").to_pylist()):
            if starts:
                at = base[np.frombuffer(texts_, "<i4")] + np.frombuffer(starts, "<i8")
                start.append(at)
                end.append(at + LENGTH)
        start, end = _runs(np.concatenate(start), np.concatenate(end))
        owner = np.searchsorted(base, start, "right") - 1
        start, end = start - base[owner], end - base[owner]
        bounds = np.searchsorted(owner, np.arange(len(size) + 1))
        digests = []
        for k, text in enumerate(packet.texts):
            i, j = bounds[k], bounds[k + 1]
            at, kept = 0, []
            for a, b in zip(start[i:j].tolist(), end[i:j].tolist()):
                kept.append(text[at:a])
                at = b
            digests.append(hashlib.sha256(b"".join([*kept, text[at:]])).hexdigest())
        gone = np.r_[0, np.cumsum(end - start)]
        spans = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["start", "end"]))
        ids = pa.array(packet.docs, mask=packet.docs == LAST)
        return pa.table([ids, pa.array(size), pa.array(gone[bounds[1:]] - gone[bounds[:-1]]), pa.array(np.diff(bounds)), pa.array(digests, pa.string()), spans], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>"
    return texts.groupBy("packet").cogroup(found.groupBy("packet")).applyInArrow(remove, schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document repeats of 50 bytes or more from documents with smaller ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_bytes(docs).drop("spans")
