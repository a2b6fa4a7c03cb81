"""Packing by minimum bin slack.

Every document is cut into full sequences and one rest shorter than a sequence. Rests are packed
window by window: the longest rest opens a sequence, and a bitset subset-sum over the multiset of
remaining lengths finds the lengths that fill it closest to capacity; walking the stored bitsets back
gives how many rests of each length to take. Work stays in the task that read the rows, so nothing
is shuffled and no source or length can become hot.
"""

from __future__ import annotations

import base64
import os
import zlib
from array import array
from collections import defaultdict

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import texts

CAPACITY, WINDOW, SEPARATOR = 1024, 1 << 15, 0


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is the largest one that is at most ``room``.

    ``counts`` is the multiset of lengths. Bit s of a level says that sum s can be made of the lengths
    so far; a count is added in binary portions, so a level costs log(count) shifts. Ties prefer
    longer lengths, which come first. The search ends as soon as ``room`` itself is reached.
    """
    levels, bits, mask = [(0, 0, 1)], 1, (1 << (room + 1)) - 1
    for size in sorted((s for s in counts if s <= room and counts[s] > 0), reverse=True):
        left, portion = min(counts[size], room // size), 1
        while left:
            portion = min(portion, left)
            new = (bits | bits << (size * portion)) & mask
            if new != bits:
                bits = new
                levels.append((size, portion, bits))
            left -= portion
            portion *= 2
        if bits >> room & 1:
            break
    at, take = bits.bit_length() - 1, defaultdict(int)
    for k in range(len(levels) - 1, 0, -1):
        size, portion, _ = levels[k]
        if not levels[k - 1][2] >> at & 1:
            take[size] += portion
            at -= size * portion
    return dict(take)


def pack(lengths: list[int], capacity: int, last: bool = True) -> tuple[list[list[int]], list[int]]:
    """Pack item numbers into sequences; returns (sequences, item numbers left for a later window).

    Each sequence opens with the longest item left. Without ``last``, a sequence that isn't full and
    doesn't end at a power of two is left for the next window once the short items are used up.
    """
    shelf: dict[int, list[int]] = defaultdict(list)
    for i in sorted(range(len(lengths)), reverse=True):
        shelf[lengths[i]].append(i)
    counts = {s: len(v) for s, v in shelf.items()}
    bins, kept = [], []
    for size in sorted(shelf, reverse=True):
        while counts.get(size):
            counts[size] -= 1
            chosen = fill(counts, capacity - size)
            total = size + sum(s * n for s, n in chosen.items())
            times = 1 + min([counts[s] // n - 1 for s, n in chosen.items() if s != size] or [0]) if size not in chosen and total == capacity else 1
            times = max(1, min(times, counts[size] + 1))
            for r in range(times):
                if r:
                    counts[size] -= 1
                items = [shelf[size].pop()]
                for s, n in chosen.items():
                    counts[s] -= n
                    items += [shelf[s].pop() for _ in range(n)]
                if last or total == capacity or total & (total - 1) == 0:
                    bins.append(items)
                else:
                    kept += items
    return bins, kept


class Encoder:
    """Ids of a byte-level BPE ``tokenizers`` file, as packed little-endian 32-bit numbers.

    Ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``, which takes the file's
    special tokens where a text spells them out. When the rank file of the same vocabulary is there,
    its faster library makes the same ids (a worker checks it on a sample when it starts, a test on
    whole tables and random texts); otherwise the tokenizer file makes them.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        own = public_tokenizers.path("byte_bpe_50k.json")
        self.slow = Tokenizer.from_file(path or own)
        self.fast = None
        ranked = public_tokenizers.path("byte_bpe_50k.tiktoken")
        if path in (None, own) and os.path.exists(ranked):
            import tiktoken

            with open(ranked, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
            probe = "A b  c\n\n\t d1234's naïve 東京 🙂 <|endoftext|>  x"
            if fast.encode(probe, allowed_special="all") == self.slow.encode(probe, add_special_tokens=False).ids:
                self.fast = fast

    def __call__(self, text: str) -> array:
        if self.fast is not None:
            return array("I", self.fast.encode(text, allowed_special="all"))
        return array("I", self.slow.encode(text, add_special_tokens=False).ids)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_ENCODERS: dict = {}


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, window: int = WINDOW, tokenizer: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids; one row per piece.

    A document is its ids and then id 0; null and empty texts are that one id. Output columns:
    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. Pieces fill ``offset``
    gaplessly from 0 in their sequence. Ids of sequences are the task's number times 2^36 plus a
    counter, so they are unique, and a task that runs again gives the same ones. Rests wait at most
    ``window`` at a time in memory; only a task's last sequences can be short. Null and repeated ids
    are packed like others; an empty table gives none; other columns are not read.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(f.name, T.LongType()) for f in _SCHEMA][1:]])

    def run(batches):
        encode = _ENCODERS.get(tokenizer) or _ENCODERS.setdefault(tokenizer, Encoder(tokenizer))
        base, made = TaskContext.get().partitionId() << 36, 0
        rests: list[tuple] = []

        def emit(rows):
            cols = list(zip(*rows)) or [()] * 7
            ids = pa.array(cols[0], type=id_type[0])
            return pa.RecordBatch.from_arrays([ids, *[pa.array(c, type=pa.int64()) for c in cols[1:]]], names=_SCHEMA.names)

        def close(last):
            nonlocal made, rests
            bins, kept = pack([r[2] for r in rests], capacity, last)
            for items in bins:
                at = 0
                for i in items:
                    yield (*rests[i], base + made, at)
                    at += rests[i][2]
                made += 1
            rests = [rests[i] for i in kept]

        id_type = [pa.int64()]
        for batch in batches:
            id_type[0] = batch.column(0).type
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                ids = encode(text or "")
                ids.append(SEPARATOR)
                raw, n = memoryview(ids).cast("B"), len(ids)
                full = n - n % capacity
                for start in range(0, full, capacity):
                    rows.append((doc, start, capacity, zlib.crc32(raw[4 * start : 4 * (start + capacity)]), n, base + made, 0))
                    made += 1
                if n > full:
                    rests.append((doc, full, n - full, zlib.crc32(raw[4 * full :]), n))
                if len(rests) >= window:
                    rows += close(False)
                    if len(rests) >= window // 2:
                        rows += close(True)
                if len(rows) >= 10000:
                    yield emit(rows)
                    rows = []
            if rows:
                yield emit(rows)
        rows = list(close(True))
        for at in range(0, len(rows), 10000):
            yield emit(rows[at : at + 10000])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 ids."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
