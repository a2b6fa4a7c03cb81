"""MinHash-style near-dedup with SetSketch registers.

A document's set of word shingles becomes ``REGISTERS`` exponentially spaced, truncated minima:
register j is floor(1 - log_b x_j), with x_j the least of one exponential draw a shingle. Registers
of a union are the maxima of registers, and equal sets give equal registers. Then, on classes of
equal sets:

1. Bands of registers put classes into buckets. In a bucket the joint likelihood of two register
   vectors and the two set sizes tells which pairs can reach the threshold; a bucket answers with
   stars (class, smallest likely class), one row a class, and their components are clusters.
2. A cluster's texts meet once. Its pairs that share a band and are likely are compared on their full
   sets, and the cluster answers with stars over true links.

Skew: a bucket or cluster larger than a block is dealt into blocks by hash. Each block is compared in
itself and with a few drawn pilots of the whole group, which joins nearly all that is linked; then
only classes outside the group's largest component still travel to the other blocks. So rows that
move are in proportion to the group, or to the group's blocks times those left outside, a task holds
two blocks at most, and no pair is ever a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .workspace import Workspace

WORDS, PERCENT = 5, 75
REGISTERS, BANDED, BAND, BASE, RATE, TOP = 256, 128, 4, 1.001, 20.0, 65535
#: Weight of a block (a class weighs ``1024 + 16 * shingles``, about its bytes in a task) and pilots drawn for a group of several.
BLOCK, PILOTS = 8 << 20, 64
#: Pairs that wait for one evaluation of the likelihood.
CHUNK = 1 << 15
#: Log-likelihood that a candidate may lose at the threshold against its best fit (4.5 standard deviations).
SLACK = 10.125
#: Equal registers that a candidate has at least: six standard deviations below what the threshold gives.
EQUAL = int(REGISTERS * (PERCENT / 100 - 6 * (PERCENT / 100 * (1 - PERCENT / 100) / REGISTERS) ** 0.5))

_FACTORS = np.random.default_rng(20240229).integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """64-bit hashes of words; emptied when it has grown to 300,000."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit digests of the distinct shingles; one for the whole sequence when words are few."""
    if not text:
        return np.empty(0, np.uint64)
    raw = text if isinstance(text, bytes) else text.encode("utf-8", "replace")
    found = raw.lower().split()  # bytes: only A-Z change, only \x20 \x09-\x0D split
    if not found:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    n = max(1, len(w) - words + 1)
    h = np.full(n, np.uint64(min(words, len(w))), np.uint64)
    for i in range(min(words, len(w))):
        h = h * _STEP + w[i : i + n]
    return np.unique(_mix(h))


def registers(items: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of a set of 64-bit digests."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 2048):
        np.minimum(low, np.multiply.outer(_FACTORS, items[at : at + 2048]).min(axis=1), out=low)
    x = -np.log1p(-np.minimum(low.astype(np.float64) / 2.0**64, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, TOP).astype("<u2")


def plausible(n_u: np.ndarray, n_v: np.ndarray, above: np.ndarray, below: np.ndarray, share: float = PERCENT / 100) -> np.ndarray:
    """Whether a Jaccard of ``share`` or more is within ``SLACK`` of the best joint likelihood.

    ``above``/``below`` count registers of u over and under those of v. With sizes known, u has the
    larger register with probability p(a - b J), p(x) = -log_b(1 - x (b - 1) / b), a and b the
    shares of the sizes; this is the sketch's likelihood of J, maximised over a grid.
    """
    n_u, n_v = np.asarray(n_u, float), np.asarray(n_v, float)
    a = n_u / (n_u + n_v)
    limit = np.minimum(n_u, n_v) / np.maximum(n_u, n_v)
    prob = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    equal = REGISTERS - above - below
    best, good = np.full(len(a), -np.inf), np.full(len(a), -np.inf)
    for j in np.concatenate([np.linspace(0, 1, 41), [share]]):
        at = np.minimum(j, limit)
        up, down = prob(a - (1 - a) * at), prob(1 - a - a * at)
        like = above * np.log(np.maximum(up, 1e-9)) + below * np.log(np.maximum(down, 1e-9)) + equal * np.log(np.maximum(1 - up - down, 1e-9))
        best = np.maximum(best, like)
        good = np.where(j >= share, np.maximum(good, like), good)
    return (limit >= share) & (best - good <= SLACK)


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, version, n_shingles, cid, regs) for every row; ``cid`` and ``regs`` are null for empty sets."""
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("version"), F.col(text_col).cast("binary").alias("text"))
    names = ["doc", "version", "n_shingles", "cid", "regs"]

    def run(batches):
        for batch in batches:
            n, cid, regs = [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py())
                n.append(len(s))
                cid.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            made = [pa.array(n, pa.int64()), pa.array(cid, pa.binary()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=names)

    schema = T.StructType([*rows.schema.fields[:2], T.StructField("n_shingles", T.LongType()), T.StructField("cid", T.BinaryType()), T.StructField("regs", T.BinaryType())])
    return rows.mapInArrow(run, schema)


class _Forest:
    """Union-find over the rows of a batch, with labels as an array for vectorised tests."""

    def __init__(self, start: np.ndarray):
        _, first, self.label = np.unique(start, return_index=True, return_inverse=True)
        self.root = list(range(len(first)))
        self.of, self.joined = self.label.copy(), False

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(self.of[a].tolist(), self.of[b].tolist()):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                self.joined = True

    def settle(self) -> None:
        if self.joined:
            self.label = np.array([self.find(x) for x in range(len(self.root))], np.int64)[self.of]
            self.joined = False


def _linked(sets: dict, table: pa.Table, forest: _Forest, a: np.ndarray, b: np.ndarray) -> None:
    """Join the pairs that reach the threshold on full sets; all partners of one row are counted at once."""

    def full(x: int) -> np.ndarray:
        if x not in sets:
            sets[x] = shingles(table.column("text")[x].as_py())
        return sets[x]

    order = np.lexsort((b, a))
    edges = np.flatnonzero(np.r_[True, a[order][1:] != a[order][:-1], True]) if len(a) else []
    for i, j in zip(edges[:-1], edges[1:]):
        x = int(a[order[i]])
        other = b[order[i:j]]
        top = forest.find(int(forest.of[x]))
        other = other[[forest.find(int(c)) != top for c in forest.of[other]]]
        if not len(other):
            continue
        s, parts = full(x), [full(int(y)) for y in other]
        size = np.array([len(t) for t in parts])
        flat = np.concatenate(parts)
        hit = s[np.minimum(np.searchsorted(s, flat), len(s) - 1)] == flat
        both = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
        good = other[100 * both >= PERCENT * (len(s) + size - both)]
        forest.join(np.full(len(good), x), good)


def _stars(table: pa.Table, exact: bool) -> pa.Table:
    """Whole cells, in order of ``cell`` -> (a, b): each row that a link joins, with its component's first row.

    ``part`` holds components known before; rows of one part aren't compared. In a bucket (``band`` not
    negative) a pair counts where its first equal band is the bucket's, so it is looked at once.
    """
    table = table.combine_chunks()
    cell, band, n = (table.column(c).to_numpy() for c in ("cell", "band", "n"))
    regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), "<u2").reshape(-1, REGISTERS)
    bands = regs[:, :BANDED].copy().view("<u8").reshape(len(regs), -1)
    end = np.searchsorted(cell, cell, "right")
    forest, sets = _Forest(table.column("part").to_numpy()), {}
    start = forest.label.copy()
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush():
        a, b, alike = (np.concatenate(x) for x in zip(*waiting))
        waiting.clear()
        sure = alike >= REGISTERS * PERCENT / 100  # their best estimate is above the threshold
        if not exact:
            forest.join(a[sure], b[sure])
            forest.settle()
            left = ~sure & (forest.label[a] != forest.label[b])
            a, b = a[left], b[left]
            sure = np.zeros(len(a), bool)
        ok = sure.copy()
        ok[~sure] = plausible(n[a[~sure]], n[b[~sure]], (regs[a[~sure]] > regs[b[~sure]]).sum(1), (regs[a[~sure]] < regs[b[~sure]]).sum(1))
        if exact:
            _linked(sets, table, forest, a[ok & sure], b[ok & sure])
            _linked(sets, table, forest, a[ok & ~sure], b[ok & ~sure])
        else:
            forest.join(a[ok], b[ok])
        forest.settle()

    i, d, held = np.arange(len(cell)), 0, 0
    while len(i):
        d += 1
        i = i[i + d < end[i]]
        for at in range(0, len(i), CHUNK):
            a = i[at : at + CHUNK]
            b = a + d
            a, b = (x[(forest.label[a] != forest.label[b]) & (100 * np.minimum(n[a], n[b]) >= PERCENT * np.maximum(n[a], n[b]))] for x in (a, b))
            same = bands[a] == bands[b]
            meet = same.any(1) & ((band[a] < 0) | (same.argmax(1) == band[a]))
            a, b = a[meet], b[meet]
            alike = (regs[a] == regs[b]).sum(1)
            near = alike >= EQUAL
            if near.any():
                waiting.append((a[near], b[near], alike[near]))
                held += int(near.sum())
            if held >= CHUNK:
                flush()
                held = 0
    if waiting:
        flush()
    first = np.full(len(forest.root), len(cell))
    np.minimum.at(first, forest.label, np.arange(len(cell)))
    part = np.full(len(forest.root), -1)
    part[forest.label] = start
    grown = np.zeros(len(forest.root), bool)
    np.logical_or.at(grown, forest.label, part[forest.label] != start)
    out = np.flatnonzero(grown[forest.label] & (first[forest.label] != np.arange(len(cell))))
    node = table.column("node").combine_chunks()
    return pa.table({"a": node.take(pa.array(out)), "b": node.take(pa.array(first[forest.label[out]]))})


def _tested(cells: DataFrame, payload: DataFrame, exact: bool) -> DataFrame:
    """Stars (a, b) of all ``cells(cell, node, part, band)``; cells are sorted in their partition and read as a stream."""
    kind = cells.schema["node"].dataType

    def run(batches):
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = batch.column("cell")[batch.num_rows - 1].as_py()
            if held[0].column("cell")[0].as_py() == last:
                continue  # one cell so far: at most two blocks
            table = pa.Table.from_batches(held)
            cut = int(np.searchsorted(table.column("cell").to_numpy(), last))
            yield from _stars(table.slice(0, cut), exact).combine_chunks().to_batches()
            held = table.slice(cut).to_batches()
        if held:
            yield from _stars(pa.Table.from_batches(held), exact).combine_chunks().to_batches()

    full = cells.join(payload, "node").repartition("cell").sortWithinPartitions("cell")
    return full.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def _links(groups: DataFrame, payload: DataFrame, exact: bool, work: Workspace) -> DataFrame:
    """Stars over the links in each group of ``groups(group, node, band, blocks, members)``, enough to join what is linked."""
    several, home = F.col("blocks") > 1, F.pmod(F.xxhash64(F.lit("home"), "node"), F.col("blocks"))
    pilot = several & (F.pmod(F.xxhash64(F.lit("pilot"), "node"), F.col("members")) < PILOTS)
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    at = F.explode(F.when(pilot, everywhere).otherwise(F.array(home))).alias("at")
    own = F.xxhash64(F.lit("part"), "node").alias("part")
    cells = groups.select("group", "node", "band", at).select(F.xxhash64("group", "at").alias("cell"), "node", own, "band")
    found = work.table(_tested(cells, payload, exact), "stars")
    large = groups.where(several)
    if not large.limit(1).count():
        return found
    inside = large.join(connected_components(found, work), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    inside = work.table(inside, "parts")
    top = inside.groupBy("group", "part").agg(F.count("*").alias("n")).groupBy("group").agg(F.max(F.struct("n", "part")).alias("top"), F.count("*").alias("parts"))
    marked = inside.join(top.where("parts > 1").select("group", F.col("top.part").alias("major"), F.col("top.n").alias("n_major")), "group")
    decks = F.greatest(F.lit(1), F.ceil((F.col("members") - F.col("n_major")) * F.col("blocks") / F.col("members"))).cast("long")
    marked = marked.withColumns({"decks": decks, "part": F.xxhash64("part"), "major": F.xxhash64("major")})
    deck = F.pmod(F.xxhash64(F.lit("deck"), "node"), F.col("decks"))
    strangers = marked.where("part <> major").select("group", "node", "part", "band", F.explode(everywhere).alias("at"), deck.alias("deck"))
    others = marked.select("group", "node", "part", "band", home.alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("decks") - 1)).alias("deck"))
    met = others.unionByName(strangers).select(F.xxhash64("group", "at", "deck").alias("cell"), "node", "part", "band").distinct()
    return found.unionByName(work.table(_tested(met, payload, exact), "more-stars"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc, version, n_shingles, component_id, kept) for every row of ``docs``.

    Documents link when 100 * |A and B| >= 75 * |A or B| over their distinct 5-word shingles (ASCII
    lower-cased words between ASCII blanks; fewer words: the whole sequence as one). ``component_id``
    is the smallest id reachable over links, ``kept`` whether it is the row's own. Null, empty and
    blank texts have no shingle and link with nothing. Rows with equal id and text are one document;
    rows with equal id and other text are compared like any; a null id comes after all others. Every
    link is confirmed on full sets. The bands miss a link at exactly 0.75 with a chance of about 5 in a
    million and the likelihood about 3 in a million, less above. An empty table gives none.
    Intermediate tables are dropped before the result, a small written table, is returned.
    """
    work = Workspace(docs.sparkSession, "near-dedup")
    rows = work.table(sketch(docs, id_col, text_col), "sketch")
    rep = F.struct(F.col("doc").isNull().alias("late"), "doc", "version")
    classes = work.table(rows.where("cid IS NOT NULL").groupBy("cid").agg(F.min(rep).alias("node"), F.max("n_shingles").alias("n"), F.max("regs").alias("regs")), "classes")
    width = 2 * BAND
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDED // BAND - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.substring("regs", i * width + 1, F.lit(width))).alias("group")))
    keys = classes.select(F.inline(bands), "node")
    sizes = keys.groupBy("group").agg(F.count("*").alias("members")).where("members > 1")
    blocks = F.ceil(F.col("members") * 2048 / block).cast("long")
    buckets = work.table(keys.join(sizes, "group").select("group", "node", "band", blocks.alias("blocks"), "members"), "buckets")
    sketches = classes.select("node", "n", "regs")
    clusters = work.table(connected_components(_links(buckets, sketches, False, work), work).select("node", F.xxhash64("component").alias("group")), "clusters")
    weight = clusters.join(classes.select("node", "n"), "node").groupBy("group").agg(F.ceil(F.sum(1024 + 16 * F.col("n")) / block).cast("long").alias("blocks"), F.count("*").alias("members"))
    groups = work.table(clusters.join(weight, "group").select("group", "node", F.lit(-1).alias("band"), "blocks", "members"), "groups")
    texts = docs.select(F.struct(F.col(id_col).isNull().alias("late"), F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("version")).alias("node"), F.col(text_col).cast("binary").alias("text"))
    # both sides grow with the corpus: never broadcast, so that all sizes have one plan
    whole = work.table(clusters.select("node").hint("merge").join(texts, "node").groupBy("node").agg(F.first("text").alias("text")).join(sketches, "node"), "texts")
    found = connected_components(_links(groups, whole, True, work), work)
    named = classes.select("cid", "node").join(found, "node", "left").select("cid", F.coalesce("component", "node").alias("top"))
    out = rows.select("doc", "version", "n_shingles", "cid").join(named, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("doc")).otherwise(F.col("top.doc"))
    result = work.table(out.select("doc", "version", "n_shingles", component.alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept")), "result")
    work.keep(result)
    return result


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group (the smallest id); all columns stay.

    Of rows with equal id and text one stays. Documents without words are no duplicates and all stay.
    Columns may have any names; an empty table stays empty.
    """
    key = lambda i, v: F.struct(F.col(i).alias("doc"), v.alias("version"))
    marks = near_duplicates(docs, id_col, text_col).where("kept").select(key("doc", F.col("version")).alias("key")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key(id_col, F.xxhash64(text_col)).alias("key"))
    return rows.join(marks, "key").dropDuplicates(["key"]).select("row.*")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("doc").alias("doc_id"), "n_shingles", "component_id", "kept")


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), held AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM held a JOIN held b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS x, doc_id AS r FROM sets UNION SELECT l.b, reach.r FROM reach JOIN both_ways l ON l.a = reach.x
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.r) AS component_id, min(r.r) = s.doc_id AS kept
FROM sets s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
