"""Embedding whitening by mixed-precision refinement of the covariance's eigenvectors.

Entries become whole numbers, so counts, sums and the Gram matrix are exact and don't depend on how
rows are dealt over tasks or on retries. The covariance is built from them on the driver (one matrix of the
width of the vectors, whatever the number of rows). Float32 eigenvectors of it are then corrected by
the Ogita-Aishima iteration, four matrix products a step in extended precision; eigenvalues closer
than the iteration's error bound are solved as small problems of their own, on the matrix shifted to
the cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import Workspace

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Scaled entries are kept within this magnitude, so that sums over a batch stay exact.
MOST = 1 << 40
#: Eigenvalues below this share of the largest are no components: their direction is rounding.
LEAST_SHARE = 1e-13
ROUNDS, ROWS = 30, 2048


def refine(a: np.ndarray, x: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of symmetric ``a``, corrected from approximate eigenvectors ``x``.

    Everything is computed in the precision of ``a``. Eigenvalues that the step can't tell apart
    (nearer than its error bound) form a cluster: in it, the step only restores orthonormality, and a
    sub-solve rotates the basis. Ends when corrections no longer shrink.
    """
    one = np.eye(len(a), dtype=a.dtype)
    size = np.sqrt((a * a).sum()) or a.dtype.type(1)
    unit = np.finfo(a.dtype).eps
    before = np.inf
    for _ in range(rounds):
        order, x = _solve_clusters(a, x, size)
        x = x[:, order]
        r = one - x.T @ x
        s = x.T @ (a @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2  # else rounding over a small gap would cost orthogonality
        value = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        bound = 2 * (np.sqrt((off * off).sum()) + size * np.sqrt((r * r).sum())) + len(a) * unit * size
        gap = value[None, :] - value[:, None]
        apart = np.abs(gap) > bound
        e = np.where(apart, (s + value[None, :] * r) / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        step = float(np.abs(e).max())
        if step <= 4 * unit or step >= before and step < 1e3 * unit:
            break
        before = step
    x = x / np.sqrt((x * x).sum(0))
    value = (x * (a @ x)).sum(0)
    order = np.argsort(-value, kind="stable")
    return value[order], x[:, order]


def _solve_clusters(a: np.ndarray, x: np.ndarray, size) -> tuple[np.ndarray, np.ndarray]:
    """Columns by falling Rayleigh quotient, and ``x`` with the basis of each cluster turned to its own eigenvectors.

    A cluster is a run of quotients whose neighbours are nearer than float32 resolves. Its small matrix
    is taken relative to its mean eigenvalue, so that double precision sees the differences alone.
    """
    x = x / np.sqrt((x * x).sum(0))
    value = (x * (a @ x)).sum(0)
    order = np.argsort(-value, kind="stable")
    near = np.abs(np.diff(value[order])) <= 64 * np.finfo(np.float32).eps * size
    x, at = x.copy(), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and near[end - 1]:
            end += 1
        if end - at > 1:
            own = order[at:end]
            y = x[:, own]
            for _ in range(2):  # orthonormal within the cluster, by the iteration's own correction
                y = y + y @ ((np.eye(end - at, dtype=a.dtype) - y.T @ y) / 2)
            mean = value[own].mean()
            small = y.T @ (a @ y - mean * y)
            small = (small + small.T) / 2
            top = np.abs(small).max()
            if top > 0:
                _, turn = np.linalg.eigh((small / top).astype(np.float64))
                y = y @ turn[:, ::-1].astype(a.dtype)
            x[:, own] = y
        at = end
    return order, x


def eigen(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns) of a symmetric matrix in extended precision."""
    top = np.abs(covariance).max() if covariance.size else 0
    if not top > 0:
        return np.zeros(len(covariance)), np.eye(len(covariance))
    a = covariance / top
    _, x = np.linalg.eigh(a.astype(np.float32))
    value, x = refine(a, x.astype(a.dtype))
    return (value * top).astype(np.float64), x.astype(np.float64)


@dataclass
class Whitening:
    """A fitted whitening of one width: ``n`` vectors with sums ``sums``, ``vectors`` as columns, all exact or double."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """(x - S/n in double, the exact sum of (n*x - S)^2 of each row or None where it exceeds 64 bits)."""
        least, most = min(self.sums, default=0), max(self.sums, default=0)
        if self.n * MOST * 2 < 1 << 62 or self.n * int(np.abs(x).max(initial=0)) + max(-least, most) < 1 << 62:
            d = self.n * x - np.array(self.sums, np.int64)
        else:
            d = self.n * x.astype(object) - np.array(self.sums, object)
        top = max(int(d.max(initial=0)), -int(d.min(initial=0)))
        if top * top * max(1, d.shape[1]) < 1 << 63:
            own = (d.astype(np.int64) ** 2).sum(1).tolist()
        else:
            own = [v if v < 1 << 63 else None for v in (d.astype(object) ** 2).sum(1).tolist()]
        return d.astype(np.float64) / self.n, own

    def whiten(self, z: np.ndarray) -> np.ndarray:
        """Centred rows projected on the components, over the roots of the eigenvalues."""
        return z @ (self.vectors / np.sqrt(self.values))


def _matrix(column, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def _by_width(column):
    """(rows, matrix) for each width that a list column holds, ``ROWS`` rows at a time."""
    width = np.diff(column.offsets.to_numpy())
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        for at in range(0, len(own) if w else 0, ROWS):
            rows = own[at : at + ROWS]
            yield rows, column.take(pa.array(rows))


def _summed(rows: DataFrame, of) -> dict[tuple, int]:
    """Exact sums over all tasks: ``of`` gives a matrix for a batch of one width, added up by place."""

    def run(batches):
        total: dict = {}
        for batch in batches:
            for _, column in _by_width(batch.column(0)):
                x = _matrix(column, np.int64)
                width = x.shape[1]
                got = of(x)
                total[width] = got if width not in total else [a + b for a, b in zip(total[width], got)]
        for width, parts in total.items():
            for k, part in enumerate(parts):
                flat = np.asarray(part).ravel()
                for at in range(0, len(flat), 10_000):
                    some = flat[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([width] * len(some), pa.int32()), pa.array([k] * len(some), pa.int32()), pa.array(range(at, at + len(some)), pa.int32()), pa.array([str(int(v)) for v in some])], names=["width", "part", "place", "value"])

    made = rows.mapInArrow(run, "width int, part int, place int, value string")
    total = made.groupBy("width", "part", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    return {(r.width, r.part, r.place): int(r.value) for r in total.collect()}  # the square of the widths, whatever the rows


def _exact(x: np.ndarray) -> np.ndarray:
    """Whole numbers as doubles where products of ``ROWS`` rows stay exact, as Python numbers elsewhere."""
    return x.astype(np.float64) if int(np.abs(x).max(initial=0)) ** 2 * ROWS < 1 << 53 else x.astype(object)


def _moments(x: np.ndarray) -> list[np.ndarray]:
    return [np.array([len(x)], object), x.sum(0, dtype=np.int64).astype(object)]


def fit(distinct: DataFrame, components: int) -> dict[int, Whitening]:
    """The whitening of each width in ``distinct(x array<long>)``, every vector once."""
    spark = distinct.sparkSession
    first = _summed(distinct, _moments)
    count = {w: v for (w, part, _), v in first.items() if part == 0}
    sums = {w: [first[w, 1, i] for i in range(w)] for w in count}
    middle = {w: np.array([s // count[w] for s in sums[w]], np.int64) for w in count}
    shared = spark.sparkContext.broadcast(middle)

    def gram(x):
        y = _exact(x - shared.value[x.shape[1]])
        return [(y.T @ y).astype(object)]

    second = _summed(distinct, gram)
    models = {}
    for w, n in count.items():
        rest = [s - n * int(m) for s, m in zip(sums[w], middle[w])]  # of vectors centred on whole numbers
        exact = [[n * second[w, 0, i * w + j] - rest[i] * rest[j] for j in range(w)] for i in range(w)]
        square = np.longdouble(n) * np.longdouble(n)
        v = np.array([[np.longdouble(str(c)) / square for c in row] for row in exact], np.longdouble)
        value, vectors = eigen(v)
        keep = value[:components] > LEAST_SHARE * max(value.max(initial=0), 0)
        k = int(np.argmin(keep)) if not keep.all() else len(keep)
        models[w] = Whitening(n, sums[w], value[:k], vectors[:, :k], float(np.trace(v)))
    _measure(distinct, models)
    return models


def _measure(distinct: DataFrame, models: dict[int, Whitening]) -> None:
    """Set each model's ``identity_error`` from the covariance of the whitened fit list."""
    shared = distinct.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        total: dict = {}
        for batch in batches:
            for _, column in _by_width(batch.column(0)):
                x = _matrix(column, np.int64)
                y = shared.value[x.shape[1]].whiten(shared.value[x.shape[1]].centred(x)[0])
                got = np.vstack([y.sum(0), y.T @ y])
                total[x.shape[1]] = total.get(x.shape[1], 0) + got
        for width, part in total.items():
            flat = part.ravel()
            yield pa.RecordBatch.from_arrays([pa.array([width] * len(flat), pa.int32()), pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["width", "place", "value"])

    sums = distinct.mapInArrow(run, "width int, place int, value double").groupBy("width", "place").agg(F.sum("value").alias("value"))
    found: dict = {}
    for r in sums.collect():  # at most (components + 1) * components a width
        found.setdefault(r.width, {})[r.place] = r.value
    for w, part in found.items():
        k = len(models[w].values)
        flat = np.array([part[i] for i in range((k + 1) * k)]).reshape(k + 1, k) / models[w].n
        models[w].identity_error = float(np.abs(flat[1:] - np.outer(flat[0], flat[0]) - np.eye(k)).max(initial=0))


def whole_numbers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): rows whose vector is whole, entries as floor(64 * c) + 1,000,000."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    sound = rows.where("v IS NOT NULL AND size(v) > 0").where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    entry = lambda c: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), SCALE * c))) + SHIFT
    return sound.select("id", F.transform("v", entry).alias("x"))


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

    Vectors that are null or hold null or non-finite entries are dropped. The fit list is each
    distinct vector of whole numbers once, so copies weigh nothing; repeated rows and ids are all
    returned. Vectors of each width are fitted and whitened by themselves; empty ones have no
    component. Entries beyond 2^40 / 64 in magnitude count as that. ``deviation`` is exact, and null
    where it exceeds 64 bits. Directions without variance (less than ``LEAST_SHARE`` of the largest) are no
    components, so equal vectors give no rows, and an empty table gives none. Eigenvectors of equal
    eigenvalues are some basis of their space, the same for all rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "whitening")
    rows = whole_numbers(vectors, id_col, vec_col)
    distinct = work.table(rows.select("x").distinct(), "distinct")
    models = fit(distinct, components)
    work.drop(distinct)
    shared = spark.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            for own, column in _by_width(batch.column("x")):
                x = _matrix(column, np.int64)
                model = shared.value[x.shape[1]]
                k = len(model.values)
                if not k:
                    continue
                z, deviation = model.centred(x)
                m = len(own)
                share = model.values / model.trace
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(np.repeat(own, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n)),
                        pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(model.whiten(z).ravel()),
                        pa.array(np.tile(share, m)),
                        pa.array(np.full(m * k, model.identity_error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    fields = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *[T.StructField(n, t) for n, t in fields]])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened on their first 16 principal components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
