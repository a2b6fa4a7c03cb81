"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut at line ends into paragraphs, and long paragraphs at content-defined points (about every
64 bytes, where a hash of the eight bytes before has six low zero bits), so that a change moves no cut
but those it touches. Each piece gives a 64-bit digest that also holds how often it came before. A
sketch adds every digest to one cell in each of three rows of cells (count, xor of digests, xor of
checks). The fingerprint is the sketch as text; its rows are powers of two that grow with the text.
To compare two, the larger is folded to the rows of the smaller, cells subtract, which cancels what
the texts share, and peeling cells with a single digest recovers what differs. When peeling gets
stuck both sketches are built four times as large with other hashes.
"""

from __future__ import annotations

import base64
import bisect
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import texts

CUT, CELLS, ROWS = 6, 4, 3
#: Texts that are measured at once: so many, or so many characters.
GROUP, GROUP_CHARS = 256, 4 << 20

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def pieces(text: str) -> list[bytes]:
    """A text's paragraphs, long ones cut at content-defined points; together they are the text."""
    raw = text.encode("utf-8", "replace")
    b = np.frombuffer(raw, np.uint8)
    cuts = np.flatnonzero(b == 10) + 1
    if len(b) > 8:
        eight = np.ndarray(len(b) - 8, "<u8", raw, strides=(1,))  # the eight bytes from each place
        cuts = np.union1d(cuts, np.flatnonzero((eight * _U(0x9E3779B97F4A7C15)) >> _U(64 - CUT) == 0) + 8)
    edges = [0, *cuts.tolist(), len(raw)]
    return [raw[x:y] for x, y in zip(edges, edges[1:]) if x < y]


def digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests of a text's pieces; equal pieces differ by their count."""
    h = np.array([xxhash.xxh3_64_intdigest(p) for p in pieces(text)], _U)
    h.sort()
    first = np.r_[0, np.flatnonzero(h[1:] != h[:-1]) + 1] if len(h) else np.zeros(0, int)
    nth = np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)])) if len(h) else first
    return _mix(h + nth.astype(_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def rows_for(n: np.ndarray) -> np.ndarray:
    """Cells a row for ``n`` digests: a power of two, so many that about ``n`` differences peel."""
    return np.maximum(CELLS, 2 ** np.ceil(np.log2(np.maximum(1, 0.45 * np.asarray(n, float) + 1))).astype(np.int64))


class Cells:
    """Sketches of many texts side by side; text i has ``ROWS`` rows of ``size[i]`` cells, a power of two."""

    def __init__(self, size: np.ndarray, salt: np.ndarray):
        self.size, self.salt = size.astype(np.int64), salt.astype(_U)
        self.start = np.concatenate([[0], np.cumsum(ROWS * self.size)])
        self.count = np.zeros(self.start[-1], np.int64)
        self.key, self.check = np.zeros(self.start[-1], _U), np.zeros(self.start[-1], _U)

    def add(self, keys: np.ndarray, owner: np.ndarray, sign) -> None:
        check = _mix(keys ^ _U(0xA5A5A5A5A5A5A5A5))
        size, start = self.size[owner], self.start[owner]
        for row in range(ROWS):
            spot = _mix(keys + _U((row + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF) + self.salt[owner] * _U(0x8CB92BA72F3D8DD7))
            at = start + row * size + (spot % size.astype(_U)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(digests left with sign +1, with sign -1, whether all were recovered) for each text."""
        n = len(self.size)
        owner = np.repeat(np.arange(n), ROWS * self.size)
        plus, minus = np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = np.arange(len(self.count))
        while len(at):
            at = at[np.abs(self.count[at]) == 1]
            at = at[_mix(self.key[at] ^ _U(0xA5A5A5A5A5A5A5A5)) == self.check[at]]
            _, once = np.unique(self.key[at] ^ _mix(owner[at].astype(_U)), return_index=True)
            at = at[once]
            keys, who, sign = self.key[at].copy(), owner[at], self.count[at].copy()
            if not len(keys):
                break
            np.add.at(plus, who[sign > 0], 1)
            np.add.at(minus, who[sign < 0], 1)
            self.add(keys, who, -sign)
            at = np.flatnonzero(self.count)
        stuck = np.zeros(n, bool)
        stuck[owner[(self.count != 0) | (self.key != 0)]] = True
        return plus, minus, ~stuck

    def folded(self, size: np.ndarray) -> "Cells":
        """The same sketches with rows of ``size`` cells, no more than before: cells that fall together add up."""
        out = Cells(size, self.salt)
        owner = np.repeat(np.arange(len(self.size)), ROWS * self.size)
        row, cell = np.divmod(np.arange(len(owner)) - self.start[owner], self.size[owner])
        at = out.start[owner] + row * out.size[owner] + cell % out.size[owner]
        np.add.at(out.count, at, self.count)
        np.bitwise_xor.at(out.key, at, self.key)
        np.bitwise_xor.at(out.check, at, self.check)
        return out

    def less(self, other: "Cells") -> "Cells":
        """What is left when sketches of the same sizes are subtracted."""
        out = Cells(self.size, self.salt)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def text(self, i: int) -> str:
        """Text i's sketch, 12 bytes a cell, in base64."""
        a, b = self.start[i], self.start[i + 1]
        out = np.zeros(b - a, np.dtype([("n", "<u2"), ("key", "<u8"), ("check", "<u2")]))
        out["n"], out["key"], out["check"] = self.count[a:b] & 0xFFFF, self.key[a:b], self.check[a:b] & _U(0xFFFF)
        return base64.b64encode(out.tobytes()).decode()


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate(sets) if sets else np.zeros(0, _U)), np.repeat(np.arange(len(sets)), [len(s) for s in sets])


def sketches(sets: list[np.ndarray]) -> Cells:
    """The sketches that fingerprints hold."""
    cells = Cells(rows_for(np.array([len(x) for x in sets])), np.zeros(len(sets)))
    cells.add(*_flat(sets), 1)
    return cells


def likeness(a: list[np.ndarray], b: list[np.ndarray], sketch_a: Cells | None = None, sketch_b: Cells | None = None) -> np.ndarray:
    """Shared digests over all digests of each pair; 1 for two empty sets.

    Sketches are subtracted and peeled; pairs that get stuck are sketched again, four times as large.
    """
    n_a, n_b = np.array([len(x) for x in a], float), np.array([len(x) for x in b], float)
    only_a, only_b = np.zeros(len(a)), np.zeros(len(a))
    sketch_a, sketch_b = sketch_a or sketches(a), sketch_b or sketches(b)
    size = np.minimum(sketch_a.size, sketch_b.size)
    plus, minus, whole = sketch_a.folded(size).less(sketch_b.folded(size)).peel()
    only_a[whole], only_b[whole] = plus[whole], minus[whole]
    todo, salt = np.flatnonzero(~whole), 1
    while len(todo):
        size[todo] = np.minimum(size[todo] * 4, 4 * rows_for((n_a + n_b)[todo]))
        cells = Cells(size[todo], np.full(len(todo), salt))
        cells.add(*_flat([a[i] for i in todo]), 1)
        cells.add(*_flat([b[i] for i in todo]), -1)
        plus, minus, whole = cells.peel()
        only_a[todo[whole]], only_b[todo[whole]] = plus[whole], minus[whole]
        todo, salt = todo[~whole], salt + 1
    union = n_a + only_b
    return np.where(union > 0, (n_a - only_a) / np.maximum(union, 1), 1.0)


def edit(text: str, following: str) -> str:
    """The last floor(n / 2) characters replaced by as many first ones of ``following``, or all it has."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


_OUT = [("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]


def _measure(pairs: list[tuple], own: list[np.ndarray], following: list[np.ndarray]) -> list[list]:
    """Columns of ``_OUT`` for (text, next text) pairs whose digests are known."""
    edited = [edit(t, n) for t, n in pairs]
    changed = [digests(e) for e in edited]
    mine, theirs = sketches(own), sketches(changed)
    return [
        [len(t) for t, _ in pairs],
        [hashlib.sha256(e.encode("utf-8", "replace")).hexdigest() for e in edited],
        [mine.text(i) for i in range(len(own))],
        [theirs.text(i) for i in range(len(own))],
        likeness(own, changed, mine, theirs).tolist(),
        likeness(own, following, mine).tolist(),
    ]


def _rank(doc, h) -> tuple:
    """Sorts ascending as (id, hash of the text) does, null ids first."""
    return (True, doc, h) if doc is not None else (False, h)


def _bounds(rows: DataFrame, parts: int, each: int = 20) -> list[tuple]:
    """Keys that cut ``rows(doc, h)`` into ``parts`` ranges, from a sample of about ``each`` keys a range drawn by hash."""
    slots = 1 << 30
    share = min(slots, slots * each * parts // max(1, rows.count()))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit("bounds"), "doc", "h"), F.lit(slots)) < share).select("doc", "h").distinct().limit(4 * each * parts).collect()
    keys = sorted(_rank(*r) for r in drawn)
    return [keys[len(keys) * k // parts] for k in range(1, parts)] if keys else []


def _part_of(bounds: list[tuple]):
    """Number of the range of a key, the largest keys first: a function of the key, the same in every job."""

    @F.arrow_udf("int")
    def part(doc: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array([len(bounds) - bisect.bisect_right(bounds, _rank(d, x)) for d, x in zip(doc.to_pylist(), h.to_pylist())], pa.int32())

    return part


def fingerprint_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The next document is the one that follows in descending order of id (then of the text's hash; a
    null id comes last), and after the last comes the first; a lone document follows itself. Null
    texts are empty. Equal texts have equal fingerprints, and two empty ones a likeness of 1. Rows
    meet their neighbours by one range exchange, in which each task measures all but its last row; that
    row meets the first one of the next task in a second, small step. Ids are integers (or strings); an
    empty table gives none.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.col("doc").desc_nulls_last(), F.col("h").desc()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.withColumn("part", _part_of(_bounds(rows, parts))("doc", "h"))
    dealt = keyed.repartitionById(parts, F.col("part")).sortWithinPartitions(*order)
    schema = T.StructType([rows.schema["doc"], *[T.StructField(n, t) for n, t in _OUT]])
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc", *[n for n, _ in _OUT]]

    def made(docs_, kind, pairs, own, following):
        got = _measure(pairs, own, following)
        return pa.RecordBatch.from_arrays([pa.array(docs_, kind), *[pa.array(c, k) for c, k in zip(got, kinds)]], names=names)

    def run(batches):
        held: list[tuple] = []  # (doc, text, digests); the last of them waits for its follower
        chars, kind = 0, None

        def measured():
            now, then = held[:-1], held[1:]
            return made([a[0] for a in now], kind, [(a[1], b[1]) for a, b in zip(now, then)], [a[2] for a in now], [b[2] for b in then])

        for batch in batches:
            kind = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                held.append((doc, text, digests(text)))
                chars += len(text)
                if len(held) > GROUP or chars > GROUP_CHARS and len(held) > 1:
                    yield measured()
                    held, chars = held[-1:], len(text)
        if len(held) > 1:
            yield measured()

    def close(batches):
        for batch in batches:
            pairs = list(zip(texts(batch.column(1)), texts(batch.column(2))))
            yield made(batch.column(0).to_pylist(), batch.column(0).type, pairs, [digests(a) for a, _ in pairs], [digests(b) for _, b in pairs])

    rank = F.struct(F.col("doc").isNotNull(), "doc", "h")
    ends = keyed.select("part", rank.alias("rank")).groupBy("part").agg(F.max("rank").alias("first"), F.min("rank").alias("last")).orderBy("part").collect()  # two keys a task
    links = [(k, role, r["doc"], r["h"]) for k in range(len(ends)) for role, r in (("last", ends[k]["last"]), ("next", ends[(k + 1) % len(ends)]["first"]))]
    named = spark.createDataFrame(links, T.StructType([T.StructField("link", T.IntegerType()), T.StructField("role", T.StringType()), rows.schema["doc"], T.StructField("h", T.LongType())]))
    key = F.struct("doc", "h").alias("key")
    met = rows.select("doc", "text", key).join(F.broadcast(named.select("link", "role", key)), "key")
    pick = lambda role, value: F.first(F.when(F.col("role") == role, F.struct(value)), ignorenulls=True)[value]
    last = met.groupBy("link").agg(pick("last", "doc").alias("doc"), pick("last", "text").alias("text"), pick("next", "text").alias("next_text")).select("doc", "text", "next_text")
    whole = dealt.select("doc", "text").mapInArrow(run, schema).unionByName(last.mapInArrow(close, schema))
    return whole.withColumnRenamed("doc", id_col)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint_versions(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
