"""Operator 11: whitening of embeddings by blockwise TSQR and one-sided Jacobi rotations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import common

LONG = 2**62


@dataclass(frozen=True)
class WhiteningSettings:
    components: int = 8
    scale: int = 1024
    shift: int = 100_000
    rows: int = 8192  # of a batch that are factored at once
    stacked: int = 8_000_000  # numbers of the triangles that one task stacks
    sweeps: int = 60


def _lists(column: pa.Array, dims: int) -> np.ndarray:
    """A column of lists of one length, none null, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def integers(vectors: np.ndarray, s: WhiteningSettings) -> np.ndarray:
    """Entries as the integers that all further work is on."""
    return np.floor(vectors.astype(np.float64) * s.scale).astype(np.int64) + s.shift


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: in Python's integers where 64 bits could overflow."""
    most = int(np.abs(x).max(initial=0))
    if n * most + max(map(abs, sums), default=0) < LONG:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(y: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; None where it isn't a long."""
    most = int(np.abs(y).max(initial=0))
    if y.dtype != object and most * most * y.shape[1] < LONG:
        return (y * y).sum(axis=1).tolist()
    return [k if k < 2**63 else None for k in (sum(int(v) * int(v) for v in row) for row in y)]


def jacobi_svd(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors as columns, of a triangle or any other matrix.

    Plane rotations from the right make two columns orthogonal at a time; a round turns d / 2 disjoint
    pairs at once, and a sweep's d - 1 rounds meet every pair (the order of a round-robin tournament).
    The columns' lengths are then the singular values, accurate relative to themselves, and the rotations'
    product holds the vectors.
    """
    a = np.array(r, np.float64)
    d = a.shape[1]
    v = np.eye(d)
    scale = np.abs(a).max(initial=0.0)
    if d < 2 or not scale:
        return np.linalg.norm(a, axis=0), v
    a /= scale
    seats = np.arange(d + d % 2)  # an odd number has a bye
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
            ok = (p < d) & (q < d)
            p, q = p[ok], q[ok]
            left, right = a[:, p], a[:, q]
            alpha, beta, gamma = (left * left).sum(axis=0), (right * right).sum(axis=0), (left * right).sum(axis=0)
            act = np.abs(gamma) > 1e-15 * np.sqrt(alpha * beta)
            if not act.any():
                continue
            turned = True
            p, q, alpha, beta, gamma = p[act], q[act], alpha[act], beta[act], gamma[act]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            cos = 1 / np.hypot(1, t)
            sin = cos * t
            for m in (a, v):
                m[:, p], m[:, q] = cos * m[:, p] - sin * m[:, q], sin * m[:, p] + cos * m[:, q]
        if not turned:
            break
    sizes = np.linalg.norm(a, axis=0) * scale
    order = np.argsort(-sizes, kind="stable")
    return sizes[order], v[:, order]


@dataclass(frozen=True)
class Whitening:
    """What a fit gives: count and sums per dimension of the fit list, components as columns, their
    variances, and the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    settings: WhiteningSettings

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) if self.trace > 0 else 0.0 for e in self.variances]

    @property
    def spread(self) -> np.ndarray:
        """Which components vary at all: others can't be scaled to variance 1."""
        return self.variances > 1e-24 * max(self.trace, 0.0)


def usable(vectors: DataFrame, vector_column: str, s: WhiteningSettings) -> DataFrame:
    """Rows whose vector is neither null nor empty, all of whose entries are finite and, scaled, below 2^53."""
    v = F.col(vector_column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) * s.scale >= float(2**53)))
    return vectors.where((F.size(v) > 0) & ~bad)


def _sums(vectors: DataFrame, s: WhiteningSettings) -> tuple[int, list[int]]:
    """Rows and sums per dimension of the vectors of the commonest length (of two, the longer).

    Every task adds its rows up, in two halves of the digits so that longs hold any sum; the tasks' sums are
    added by position, and one number for each dimension comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            column = batch.column(0)
            lengths = column.value_lengths().to_numpy()
            for d in np.unique(lengths):
                x = integers(_lists(column.filter(pa.array(lengths == d)), int(d)), s)
                kept = found.setdefault(int(d), [0, np.zeros(int(d), np.int64), np.zeros(int(d), np.int64)])
                kept[0] += len(x)
                kept[1] += (x >> 26).sum(axis=0)
                kept[2] += (x & (2**26 - 1)).sum(axis=0)
        rows = [(d, k, n if k == 0 else 0, int(high[k]), int(low[k])) for d, (n, high, low) in found.items() for k in range(d)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["dims", "k", "n", "high", "low"])

    parts = vectors.mapInArrow(run, "dims long, k long, n long, high long, low long")
    added = common.materialise(parts.groupBy("dims", "k").agg(*[F.sum(F.col(x).cast("decimal(38,0)")).alias(x) for x in ("n", "high", "low")]), "sums")
    most = added.where("k = 0").orderBy(F.desc("n"), F.desc("dims")).first()
    if most is None:
        return 0, []
    rows = added.where(F.col("dims") == most["dims"]).orderBy("k").collect()
    common.discard(added)
    return int(most["n"]), [(int(r["high"]) << 26) + int(r["low"]) for r in rows]


def _triangle(vectors: DataFrame, n: int, sums: list[int], s: WhiteningSettings) -> np.ndarray:
    """The triangle R of a QR factorisation of all centred rows x - S/n, by blocks and then by a tree.

    A task folds its rows into one triangle; triangles are stacked and factored again, as many at once
    as hold `stacked` numbers, until one is left: each level is a written table, so a lost executor costs
    one level, and a triangle has d * d numbers however many rows there are."""
    d = len(sums)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for i in range(0, batch.num_rows, s.rows):
                x = integers(_lists(batch.column(0).slice(i, s.rows), d), s)
                y = deviations(x, n, sums).astype(np.float64) / n
                r = np.linalg.qr(np.concatenate([r, y]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], ["r"])

    def stack(group: pd.DataFrame) -> pd.DataFrame:
        r = np.linalg.qr(np.concatenate([np.reshape(x, (-1, d)) for x in group["r"]]), mode="r")
        return pd.DataFrame({"r": [r.ravel().tolist()]})

    level = common.materialise(vectors.mapInArrow(fold, "r array<double>"), "triangles")
    width = max(2, s.stacked // (d * d))
    while (left := level.count()) > 1:
        groups = -(-left // width)
        place = F.pmod(F.xxhash64("r"), F.lit(groups)) if groups > 1 else F.lit(0)
        before, level = level, common.materialise(level.groupBy(place.alias("g")).applyInPandas(stack, "r array<double>"), "triangles")
        common.discard(before)
    r = np.reshape(level.first()["r"], (-1, d))
    common.discard(level)
    return r


def fit_whitening(vectors: DataFrame, settings: WhiteningSettings = WhiteningSettings(), vector_column: str = "embedding") -> Whitening | None:
    """Components of all usable vectors of the commonest length; None if there are none.

    Two passes over the vectors: exact sums, then the triangle of the centred rows. Only the sums and the
    triangle reach the driver, of d and d * d numbers.
    """
    good = usable(vectors, vector_column, settings).select(F.col(vector_column).alias("v"))
    n, sums = _sums(good, settings)
    if not n:
        return None
    r = _triangle(good.where(F.size("v") == len(sums)), n, sums, settings)
    sizes, components = jacobi_svd(r, settings.sweeps)
    variances = sizes**2 / n
    k = min(settings.components, len(sums))
    return Whitening(n, sums, components[:, :k].copy(), variances[:k], float(variances.sum()), settings)


def whiten(vectors: DataFrame, model: Whitening, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, deviation and whitened (array, one number for each component) of each usable vector of the
    model's length; no shuffle. A component without variance gives 0; a deviation beyond a long is null."""
    s, n, sums, d = model.settings, model.n, model.sums, model.dims
    scale = np.where(model.spread, 1 / np.sqrt(np.where(model.spread, model.variances, 1.0)), 0.0)
    onto = model.components * scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = deviations(integers(_lists(batch.column(1), d), s), n, sums)
            white = (y.astype(np.float64) / n) @ onto
            ends = np.arange(len(white) + 1, dtype=np.int32) * white.shape[1]
            arrays = [batch.column(0), pa.array(_squares(y), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(white.ravel()))]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "deviation", "whitened"])

    rows = usable(vectors, vector_column, s).where(F.size(vector_column) == d)
    rows = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v"))
    return rows.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def identity_error(white: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened columns' covariance minus the identity, over the components
    that vary (0 if none does).

    Every task centres its rows by their own means before multiplying; the tasks' moments, of equal and
    small size, are merged by the formula for parallel variances in a second round."""
    ok = np.flatnonzero(model.spread)
    k = len(ok)
    if not k:
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                w = _lists(batch.column(0), len(model.spread))[:, ok]
                mean = w.mean(axis=0)
                total = merged(total, (len(w), mean, (w - mean).T @ (w - mean)))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[float(total[0]), *total[1], *total[2].ravel()]], pa.list_(pa.float64()))], ["m"])

    def merged(x, y):
        if x is None:
            return y
        n, gap = x[0] + y[0], y[1] - x[1]
        return n, x[1] + gap * (y[0] / n), x[2] + y[2] + np.outer(gap, gap) * (x[0] * y[0] / n)

    def merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for m in batch.column(0).to_pylist():
                total = merged(total, (m[0], np.array(m[1 : k + 1]), np.reshape(m[k + 1 :], (k, k))))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[float(total[0]), *total[1], *total[2].ravel()]], pa.list_(pa.float64()))], ["m"])

    # One row for each task, of 1 + k + k * k numbers: few enough for one task.
    (last,) = white.select("whitened").mapInArrow(moments, "m array<double>").repartition(1).mapInArrow(merge_rows, "m array<double>").collect()
    m = last["m"]
    return float(np.abs(np.reshape(m[k + 1 :], (k, k)) / m[0] - np.eye(k)).max())


def whitening_report(vectors: DataFrame, settings: WhiteningSettings = WhiteningSettings(), id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error, one row for each usable
    vector and component.

    Dropped are vectors that are null, empty, hold null or non-finite entries or ones of 2^53 / 1024 and more
    (no long could hold those), or have another length than most. Repeated rows and ids count and
    come back as often as they are there; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit_whitening(vectors, settings, vector_column)
    if model is None:
        return spark.createDataFrame([], schema)
    white = common.materialise(whiten(vectors, model, id_column, vector_column), "whitened")
    error = identity_error(white, model)
    parts = F.arrays_zip(F.col("whitened").alias("w"), F.array(*map(F.lit, model.explained)).alias("e"))
    rows = white.select("vec_id", "deviation", F.posexplode(parts).alias("at", "p"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("p.w").alias("whitened"), F.col("p.e").alias("explained"), F.lit(error).alias("identity_error"))
