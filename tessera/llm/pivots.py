"""Embedding near-dedup with a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order. Inverted lists hold, for
each label and each pair of pivots, the vectors that have both among their first ``PREFIX``: vectors
that meet there share at least two pivots. What meets is verified by cosine in double precision.

Scale: pivots follow the root of the number of vectors, so lists keep their length as the input
grows. Equal vectors collapse into one class first. Lists are read as a sorted stream, many a batch. A
list of more than ``BLOCK`` classes is dealt into blocks, and each pair of blocks is one cell: a link
count needs every cosine of a dense group, but no task holds more than two blocks. A cell returns link
counts and stars, never pairs; a pair that meets in several lists counts in the one with the smallest
key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .workspace import Workspace

COSINE, PREFIX, BLOCK, LEAST_PIVOTS = 0.98, 5, 2048, 32
#: Bound of the broadcast: pivots of one width (33 MB at 64 numbers); reached at a billion vectors.
MOST_PIVOTS = 1 << 16
#: A width with at most so many classes needs no pivots: it is one list a label.
FEW = 64
#: Lists up to this length are compared row by row, many lists at once; longer ones by matrix products.
SHORT, CHUNK = 48, 1 << 15


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest magnitude first, so that no square overflows or vanishes."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def permutation(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The ``prefix`` nearest pivots of each unit vector, nearest first; ties go by pivot number."""
    near = vectors @ pivots.T
    k = min(prefix, len(pivots))
    first = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < len(pivots) else np.tile(np.arange(k), (len(near), 1))
    order = np.lexsort((first, -np.take_along_axis(near, first, 1)), axis=1)
    return np.take_along_axis(first, order, 1)


def shared_keys(prefixes: np.ndarray, pivots: int) -> np.ndarray:
    """One key for each unordered pair of pivots of a prefix; a lone pivot pairs with itself."""
    k = prefixes.shape[1]
    a, b = np.triu_indices(k, 1) if k > 1 else (np.zeros(1, int), np.zeros(1, int))
    x, y = prefixes[:, a], prefixes[:, b]
    return np.minimum(x, y).astype(np.int64) * pivots + np.maximum(x, y)


def _matrix(column) -> np.ndarray:
    """A list column as a matrix; its rows have one width."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def choose_pivots(vectors: DataFrame, count: int) -> np.ndarray:
    """At most ``count`` of the ``vectors(v, h)`` of one width: those of smallest hash (one bounded sort a task)."""
    drawn = [tuple(r[0]) for r in vectors.orderBy("h", "v").select("v").limit(count).collect()]
    return unit(np.array(drawn)) if drawn else np.zeros((0, 1))


def _first_shared(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest key that rows a and b of ``keys`` share (-1 pads)."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), CHUNK):
        x, y = keys[a[at : at + CHUNK]], keys[b[at : at + CHUNK]]
        both = (x[:, :, None] == y[:, None, :]).any(2) & (x >= 0)
        out[at : at + CHUNK] = np.where(both, x, np.iinfo(np.int64).max).min(1)
    return out


def _pairs(v: np.ndarray, begin: np.ndarray, end: np.ndarray, cosine: float):
    """Row pairs of equal cell whose cosine is high enough, in portions; cells are [begin, end)."""
    long = end - begin > SHORT
    for b, e in zip(begin[long].tolist(), end[long].tolist()):
        for at in range(b, e, 512):
            x, y = np.nonzero(v[at : min(e, at + 512)] @ v[at:e].T >= cosine)
            yield at + x[x < y], at + y[x < y]
    i = np.concatenate([np.arange(b, e) for b, e in zip(begin[~long], end[~long])] or [np.zeros(0, np.int64)])
    last, d = np.repeat(end[~long], (end - begin)[~long]), 0
    while len(i):
        d += 1
        i, last = i[i + d < last], last[i + d < last]
        for at in range(0, len(i), CHUNK):
            x = i[at : at + CHUNK]
            hit = np.einsum("ij,ij->i", v[x], v[x + d]) >= cosine
            yield x[hit], x[hit] + d


def _verify(table: pa.Table, cosine: float) -> pa.Table:
    """Whole cells in order -> (node, links, root) for each row with links; only pairs of two sides count in mixed cells."""
    table = table.combine_chunks()
    cell, size, side, this = (table.column(c).to_numpy() for c in ("cell", "size", "side", "key"))
    width = np.diff(table.column("v").combine_chunks().offsets.to_numpy())
    lists = table.column("keys").to_pylist()
    keys = np.full((len(lists), max(map(len, lists))), -1, np.int64)
    for r, own in enumerate(lists):
        keys[r, : len(own)] = own
    links, root = np.zeros(len(cell), np.int64), np.arange(len(cell))
    begin = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    end = np.r_[begin[1:], len(cell)]

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    column = table.column("v").combine_chunks()
    for w in np.unique(width):  # a cell has one width
        own = np.flatnonzero(width == w)
        v = unit(_matrix(column.take(pa.array(own))))
        mine = width[begin] == w
        near = np.searchsorted(own, begin[mine])
        for a, b in _pairs(v, near, near + (end - begin)[mine], cosine):
            a, b = own[a], own[b]
            ok = (_first_shared(keys, a, b) == this[a]) & ((side[a] < 0) | (side[a] != side[b]))
            a, b = a[ok], b[ok]
            np.add.at(links, a, size[b])
            np.add.at(links, b, size[a])
            apart = root[a] != root[b]
            for x, y in zip(a[apart].tolist(), b[apart].tolist()):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
    hit = np.flatnonzero(links)
    nodes = table.column("node").combine_chunks()
    return pa.table({"node": nodes.take(pa.array(hit)), "links": pa.array(links[hit]), "root": nodes.take(pa.array([find(x) for x in hit], pa.int64()))})


def _streamed(batches, work):
    """``work`` on whole cells of a stream sorted by ``cell``; at most one cell waits for its end."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = batch.column("cell")[batch.num_rows - 1].as_py()
        if held[0].column("cell")[0].as_py() == last:
            continue
        table = pa.Table.from_batches(held)
        cut = int(np.searchsorted(table.column("cell").to_numpy(), last))
        yield from work(table.slice(0, cut)).combine_chunks().to_batches()
        held = table.slice(cut).to_batches()
    if held:
        yield from work(pa.Table.from_batches(held)).combine_chunks().to_batches()


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", cosine: float = COSINE, prefix: int = PREFIX, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    Rows link when labels are equal and not null and the cosine is at least ``cosine``; vectors that
    are null, empty, zero or hold null or non-finite numbers link with nothing, nor do vectors of
    different lengths. ``n_links`` counts other rows, equal vectors and repeated rows among them.
    ``component_id`` is the smallest id reachable; a null id comes last. The index is approximate: a
    link is found when both vectors share two of their first ``prefix`` pivots; a test holds recall on
    the given embeddings against brute force. The number of pivots of a width follows the root of its
    number of vectors up to ``MOST_PIVOTS``; every width is indexed. An empty table gives none.
    """
    work = Workspace(vectors.sparkSession, "pivots")
    label = F.col(label_col) if label_col else F.lit(0)
    wide = F.col(vec_col).cast("array<double>")
    rows = work.table(vectors.select(F.col(id_col).alias("id"), label.alias("label"), wide.alias("v")), "rows")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))
    key = F.struct(F.col("id").isNull().alias("late"), "id")
    classes = work.table(valid.groupBy("label", "v").agg(F.min(key).alias("first"), F.count("*").alias("size")).withColumn("node", F.struct("first", F.xxhash64("v").alias("of"))).drop("first"), "classes")
    widths = {r[0]: r[1] for r in classes.groupBy(F.size("v").alias("d")).count().collect()}
    hashed = classes.select("v", F.xxhash64(F.lit("pivot"), "v").alias("h"))
    points = {d: choose_pivots(hashed.where(F.size("v") == d), pivots or int(min(MOST_PIVOTS, max(LEAST_PIVOTS, 2 * n**0.5)))) for d, n in widths.items() if n > FEW or pivots}
    shared = vectors.sparkSession.sparkContext.broadcast(points)

    def describe(batches):
        for batch in batches:
            width = np.diff(batch.column("v").offsets.to_numpy())
            keys: list = [[0]] * len(width)
            for d in np.unique(width):
                own = shared.value.get(int(d))
                if own is None:
                    continue
                at = np.flatnonzero(width == d)
                v = unit(_matrix(batch.column("v").take(pa.array(at))))
                step = max(1, (1 << 22) // len(own))  # rows whose distances to all pivots are held at once
                for x in range(0, len(at), step):
                    got = shared_keys(permutation(v[x : x + step], own, prefix), len(own))
                    for i, k in zip(at[x : x + step], got):
                        keys[i] = np.unique(k).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], names=[*batch.schema.names, "keys"])

    described = work.table(classes.mapInArrow(describe, T.StructType(classes.schema.fields[:]).add("keys", T.ArrayType(T.LongType()))), "described")
    posts = described.select("label", F.size("v").alias("d"), "node", F.explode("keys").alias("key"))
    lists = posts.groupBy("label", "d", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    home = posts.join(lists, ["label", "d", "key"]).withColumn("home", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    low, high = F.least("home", "other"), F.greatest("home", "other")
    side = F.when(low == high, F.lit(-1)).otherwise(F.col("home")).alias("side")  # in a cell of two blocks only pairs across count
    cells = home.select("label", "d", "key", "node", "home", other).select(F.xxhash64("label", "d", "key", low, high).alias("cell"), "key", "node", side)
    full = cells.join(described.select("node", "v", "size", "keys"), "node").repartition("cell").sortWithinPartitions("cell")
    kind = described.schema["node"].dataType
    schema = T.StructType([T.StructField("node", kind), T.StructField("links", T.LongType()), T.StructField("root", kind)])
    found = work.table(full.mapInArrow(lambda batches: _streamed(batches, lambda table: _verify(table, cosine)), schema), "found")
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), work)
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(sums, "node", "left").join(parts, "node", "left")
    named = named.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce(F.col("component.first.id"), F.col("node.first.id")).alias("component_id"))
    out = rows.join(named, ["label", "v"], "left")
    component = F.coalesce("component_id", "id")
    result = work.table(out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")), "result")
    work.keep(result)
    return result


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked vectors and their components over all embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


ORACLE_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT vec_id AS x, vec_id AS r FROM embeddings UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.x
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(any_value(c.n), 0) AS n_links, min(r.r) AS component_id, min(r.r) = e.vec_id AS kept
FROM embeddings e JOIN reach r ON r.x = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id GROUP BY e.vec_id
"""
