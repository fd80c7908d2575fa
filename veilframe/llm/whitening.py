"""Whitening of embeddings on their largest principal components.

Entries become integers, so the list of distinct vectors, its sums and its products are exact and do not depend on how
the rows are spread. Spark makes the list and adds the sums up; the driver holds one matrix of dimension by dimension,
whose pairs come from contour integration (``feast``). The rows are then projected where they are.
"""

from __future__ import annotations

from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.feast import largest
from veilframe.plans.staging import stage

SCALE = 256
LIMBS = 5  # of 32 bits: room for products of any two longs, added up
EXACT = 1 << 53  # whole numbers up to here are exact in a double
BLOCK = 8192
SUMS = ", ".join(["i int", "j int", *(f"w{k} long" for k in range(LIMBS))])


class Whitening(NamedTuple):
    """``vectors`` has a component a column; ``sums`` are the sums of the fitted vectors, exact."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.sums])
        return (x.astype(float) - mean) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over the dimensions of (n x - S)^2; None where that is no long."""
        reach = max(self.n * int(np.abs(x).max(initial=0)), max(map(abs, self.sums), default=0))
        if 4 * reach * reach * max(x.shape[1], 1) < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in exact]


def _whole(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of the rows with a vector of finite entries that fit a long, their integer vectors filled up with zeros to
    ``dim``, and the longest length among them."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    start, length = np.asarray(lists.offsets), np.diff(np.asarray(lists.offsets))
    flat = lists.values.to_numpy(zero_copy_only=False).astype(float)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(SCALE * flat)
        bad = np.r_[0, np.cumsum(~(np.abs(scaled) < 2.0 ** 63))]
    good = ~np.asarray(lists.is_null()) & (bad[start[1:]] == bad[start[:-1]])
    places = np.flatnonzero(good)
    longest = int(length[places].max(initial=0))
    x = np.zeros((len(places), longest if dim is None else dim), np.int64)
    row = np.repeat(np.arange(len(places)), length[places])
    at = np.arange(len(row)) - np.repeat(np.cumsum(length[places]) - length[places], length[places])
    x[row, at] = scaled[np.repeat(start[places], length[places]) + at].astype(np.int64)
    return places, x, longest


def _pieces(batches):
    for b in batches:
        for lo in range(0, b.num_rows, BLOCK):
            yield b.slice(lo, BLOCK)


def _lengths(batches):
    longest = 0
    for b in _pieces(batches):
        longest = max(longest, _whole(b.column(0))[2])
    yield pa.RecordBatch.from_arrays([pa.array([longest], pa.int32())], ["dim"])


def _distinct(dim: int):
    """Each distinct vector of a batch, packed in the narrowest whole numbers that hold it."""

    def distinct(batches):
        for b in _pieces(batches):
            x = _whole(b.column(0), dim)[1]
            width = np.zeros(len(x), int)
            for k, kind in enumerate(("<i2", "<i4")):
                info = np.iinfo(kind)
                width[(x.min(axis=1, initial=0) < info.min) | (x.max(axis=1, initial=0) > info.max)] = k + 1
            packed = {row.tobytes() for k, kind in enumerate(("<i2", "<i4", "<i8")) for row in x[width == k].astype(kind)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(packed), pa.binary())], ["x"])

    return distinct


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.empty((len(rows), dim), np.int64)
    for kind in ("<i2", "<i4", "<i8"):
        size = np.dtype(kind).itemsize * dim
        at = [i for i, r in enumerate(rows) if len(r) == size]
        if at:
            out[at] = np.frombuffer(b"".join(rows[i] for i in at), kind).reshape(len(at), dim)
    return out


def _limbs(i: np.ndarray, j: np.ndarray, values: list[int]) -> pa.RecordBatch:
    """Whole numbers of any size as sums of longs."""
    parts = []
    for k in range(LIMBS):
        parts.append(pa.array([v >> 32 * k if k == LIMBS - 1 else v >> 32 * k & 0xFFFFFFFF for v in values], pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *parts],
                                      ["i", "j", *(f"w{k}" for k in range(LIMBS))])


def _added(df: DataFrame) -> dict[tuple[int, int], int]:
    """Sums by place: one row for each pair of dimensions, whatever the number of vectors."""
    sums = df.groupBy("i", "j").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in range(LIMBS)])
    return {(r.i, r.j): sum(r[f"w{k}"] << 32 * k for k in range(LIMBS)) for r in sums.collect()}


def _first_moments(dim: int):
    def moments(batches):
        total, n = np.zeros(dim, object), 0
        for b in _pieces(batches):
            x = _unpacked(b.column(0), dim)
            small = int(np.abs(x).max(initial=0)) * len(x) < 1 << 62
            total = total + (x if small else x.astype(object)).sum(axis=0).astype(object)
            n += len(x)
        at = np.arange(dim + 1)
        yield _limbs(at, np.zeros_like(at), [*map(int, total), n])

    return moments


def _second_moments(dim: int, middle: list[int]):
    """Sums of z and of z z' for z = x - middle, the upper half by rows."""
    upper = np.triu_indices(dim)
    centre = np.array(middle, object)
    near = all(abs(m) < 1 << 62 for m in middle)

    def moments(batches):
        first, second = np.zeros(dim, object), np.zeros(len(upper[0]), object)
        for b in _pieces(batches):
            x = _unpacked(b.column(0), dim)
            if near and int(np.abs(x).max(initial=0)) < 1 << 62:
                z = x - centre.astype(np.int64)
                if int(np.abs(z).max(initial=0)) ** 2 * len(z) < EXACT:
                    z = z.astype(float)  # every product and sum below is a whole number under 2^53
                    first = first + z.sum(axis=0).astype(np.int64).astype(object)
                    second = second + (z.T @ z)[upper].astype(np.int64).astype(object)
                    continue
            z = x.astype(object) - centre
            first, second = first + z.sum(axis=0), second + (z.T @ z)[upper]
        yield _limbs(upper[0], upper[1], list(map(int, second)))
        yield _limbs(np.full(dim, -1), np.arange(dim), list(map(int, first)))

    return moments


def _spread(fitted: Whitening, dim: int):
    """Sums of the whitened vectors and of their products."""
    k = len(fitted.values)
    upper = np.triu_indices(k)

    def spread(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for b in _pieces(batches):
            w = fitted.project(_unpacked(b.column(0), dim))
            first, second = first + w.sum(axis=0), second + w.T @ w
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[upper[0], np.full(k, -1)], pa.int32()), pa.array(np.r_[upper[1], np.arange(k)], pa.int32()),
             pa.array(np.r_[second[upper], first])], ["i", "j", "v"])

    return spread


def _projected(fitted: Whitening, dim: int, error: float):
    k = len(fitted.values)
    shares = fitted.values / fitted.trace

    def project(batches):
        for b in _pieces(batches):
            places, x, _ = _whole(b.column(1), dim)
            n = len(places)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(np.repeat(places, k))), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()),
                pa.array(np.full(n * k, fitted.n)),
                pa.array([v for v in fitted.deviations(x) for _ in range(k)], pa.int64()),
                pa.array(fitted.project(x).ravel()), pa.array(np.tile(shares, n)), pa.array(np.full(n * k, error)),
            ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return project


def fit(vectors: DataFrame, components: int, vector_col: str = "embedding") -> tuple[Whitening, int, float]:
    """The whitening of the distinct integer vectors, their dimension and the largest entry by which the covariance of
    the whitened list misses the identity."""
    entries = vectors.select(F.col(vector_col).cast("array<double>").alias("v"))
    dim = entries.mapInArrow(_lengths, "dim int").agg(F.max("dim")).first()[0] or 0
    none = Whitening(0, [0] * dim, np.zeros(0), np.zeros((dim, 0)), 0.0)
    if not dim:
        return none, 0, 0.0
    listed = stage(entries.mapInArrow(_distinct(dim), "x binary").groupBy("x").agg(F.lit(1).alias("one"))).select("x")
    added = _added(listed.mapInArrow(_first_moments(dim), SUMS))
    n, sums = added.get((dim, 0), 0), [added.get((j, 0), 0) for j in range(dim)]
    if not n:
        return none, dim, 0.0
    middle = [round(Fraction(s, n)) for s in sums]
    added = _added(listed.mapInArrow(_second_moments(dim, middle), SUMS))
    first = [added[-1, j] for j in range(dim)]
    v = np.empty((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            v[i, j] = v[j, i] = (n * added[i, j] - first[i] * first[j]) / (n * n)  # whole numbers up to the division
    values, found = largest(v, components)
    fitted = Whitening(n, sums, values, found, float(np.trace(v)))
    k = len(values)
    if not k:
        return fitted, dim, 0.0
    rows = listed.mapInArrow(_spread(fitted, dim), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    got = {(r.i, r.j): r.v / n for r in rows.collect()}
    error = max(abs(got[i, j] - got[-1, i] * got[-1, j] - (i == j)) for i in range(k) for j in range(i, k))
    return fitted, dim, float(error)


def whitened(vectors: DataFrame, components: int = 4, id_col: str = "vec_id",
             vector_col: str = "embedding") -> DataFrame:
    """One row for each vector and component: the id, component (from 1, by falling eigenvalue), n, deviation, whitened,
    explained and identity_error.

    An entry c counts as floor(256 c). Vectors that are null or hold null or non-finite entries have no rows, nor have
    entries whose integer is no long. Shorter vectors count as zero in the dimensions they lack, an empty vector in all.
    Every row with a vector gets its rows, equal and null ids too; equal vectors are fitted once. There are fewer
    components than asked for where the fitted vectors span fewer directions, and no rows for a single distinct vector
    or an empty table. Components of equal eigenvalues may be any basis of their space, the same for all rows. A
    deviation over the range of a long is null. Other columns are not read.
    """
    if id_col in ("component", "n", "deviation", "whitened", "explained", "identity_error"):
        raise ValueError("the id column has the name of a result")
    fitted, dim, error = fit(vectors, components, vector_col)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_projected(fitted, dim, error), f"id {kind}, component int, n long, deviation long, "
                           "whitened double, explained double, identity_error double").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
