"""Whitening of embeddings from exact cross-products, by bit-sliced scatter.

Every entry becomes an integer.  A batch of rows is shifted by each dimension's least value and written as bit planes: bit b of
dimension i, over all rows of the batch, packed into 64-bit words.  The sum over rows of y_i * y_j is then the sum over pairs of bits of
2^(a + b) times the ones in (plane a of i AND plane b of j), an exact integer, and undoing the shift keeps it exact.  Batches add
up in decimals that Spark sums; the driver sees one number for each pair of dimensions, however many rows there are.  The
covariance is centred as an integer, n * X_ij - S_i * S_j, and only then divided and handed to ``eigh``.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.scratch import Scratch

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Rows whose planes are packed together.
ROWS = 1 << 14
#: The integers end here, far beyond any embedding, so that sums over rows stay within decimal(38, 0).
LIMIT = 1 << 50
#: Eigenvalues below this share of the largest are rounding errors of a covariance without full rank.
RANK = 1e-13


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(64 * c) + 1,000,000 of each entry, as long."""
    return np.clip(np.floor(SCALE * vectors), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, dimension, bit) of each bit plane of the non-negative ``y`` (rows, dimensions) that has a one; words are (planes, words)."""
    rows, dims = y.shape
    found, dim, bit = [], [], []
    for b in range(int(y.max(initial=0)).bit_length()):
        ones = ((y >> b) & 1).astype(np.uint8).T
        used = np.flatnonzero(ones.any(axis=1))
        packed = np.packbits(ones[used], axis=1)
        packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
        found.append(packed.view(np.uint64))
        dim.append(used)
        bit.append(np.full(len(used), b))
    if not found:
        return np.zeros((0, 1), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(dim), np.concatenate(bit)


def cross_products(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact sums over rows of x_i, and of x_i * x_j for i <= j, as Python integers."""
    rows, dims = x.shape
    least = x.min(axis=0)
    y = x - least
    words, dim, bit = planes(y)
    # Products of bits a and b add up in exact integers per a + b; ones per pair of planes are below 2^63.
    total = [[0] * dims for _ in range(dims)]
    widest = 2 * int(bit.max(initial=0)) + 2 + rows.bit_length()
    kind = np.int64 if widest < 62 else object
    sums = np.zeros((dims, dims), dtype=kind)
    for p in range(len(words)):
        ones = np.bitwise_count(words[p] & words[p:]).sum(axis=1, dtype=np.int64)
        weight = (ones << (bit[p] + bit[p:])) if kind is np.int64 else np.array([int(o) << int(bit[p] + b) for o, b in zip(ones, bit[p:], strict=True)], dtype=object)
        np.add.at(sums[dim[p]], dim[p:], weight)
        np.add.at(sums[:, dim[p]], dim[p + 1:], weight[1:])
    by_plane = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    s = [0] * dims
    for p in range(len(words)):
        s[dim[p]] += int(by_plane[p]) << int(bit[p])
    m = [int(v) for v in least]
    for i in range(dims):
        for j in range(i, dims):
            total[i][j] = int(sums[i, j]) + m[i] * s[j] + m[j] * s[i] + rows * m[i] * m[j]
    return [s[i] + rows * m[i] for i in range(dims)], total


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(flat), dims)


def _scatter(dims: int):
    """(i, n, s, x): of each block of rows, for each dimension, the rows, its sum and its cross-products with itself and later ones."""
    def block(parts):
        s, x = cross_products(integers(np.concatenate(parts)))
        n = sum(map(len, parts))
        return pa.RecordBatch.from_arrays(
            [pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array([Decimal(v) for v in s], pa.decimal128(38, 0)),
             pa.array([[Decimal(v) for v in row[i:]] for i, row in enumerate(x)], pa.list_(pa.decimal128(38, 0)))], names=["i", "n", "s", "x"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                held.append(_matrix(batch.column("vector").slice(at, ROWS), dims))
                n += len(held[-1])
                if n >= ROWS:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)
    return run


def covariance(n: int, s: list[int], x: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance with divisor n, centred in integers."""
    dims = len(s)
    out = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            out[i, j] = out[j, i] = (n * x[i, j] - s[i] * s[j]) / (n * n)  # Python integers: the quotient is rounded once
    return out


def principal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and unit eigenvectors (columns), each with its entry of greatest size positive."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(len(e))])
    return e, u * np.where(sign == 0, 1, sign)


def _projected(dims: int, n: int, s: list[int], to: np.ndarray):
    """Each row's projections on the columns of ``to``, and the sum over dimensions of (n * x - s)^2, exact."""
    whole, rest = np.array([v // n for v in s], dtype=np.int64), np.array([v % n for v in s], dtype=np.int64)

    def run(batches):
        for batch in batches:
            x = integers(_matrix(batch.column("vector"), dims))
            near = x - whole  # so n * x - s = n * near - rest
            squares = np.zeros(len(x), dtype=object)
            for k in range(dims):
                off = near[:, k].astype(object) * n - int(rest[k])
                squares += off * off
            deviation = [Decimal(int(v)) if v < 10 ** 38 else None for v in squares]
            white = np.where(np.isfinite(to).all(axis=0), (near - rest / n) @ np.nan_to_num(to), np.nan)
            values = pa.array(white.reshape(-1), mask=np.isnan(white).reshape(-1))
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * to.shape[1])
            yield pa.RecordBatch.from_arrays([*(c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "vector"),
                                              pa.array(deviation, pa.decimal128(38, 0)), pa.ListArray.from_arrays(at, values)],
                                             names=["vec_id", "deviation", "whitened"])
    return run


def _moments(k: int):
    """Per batch: the sums of the whitened values and of their products."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                w = _matrix(batch.column("whitened"), k)
                yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(w.sum(axis=0)), pa.array((w.T @ w).tolist(), pa.list_(pa.float64()))],
                                                 names=["i", "s", "p"])
    return run


def _schema(id_type: str) -> str:
    return f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each vector and component.

    Vectors that are null, empty or hold null or non-finite entries are left out; so are those of another length than the
    commonest (of equally common ones the greatest).  Rows without id and repeated rows count each by itself.  Entries beyond
    2^50 / 64 count as that.  Where the covariance has no full rank, components beyond it have explained 0 and whitened null;
    ``identity_error`` is measured on the whitened values of all others (0 if there are none).  ``deviation`` is null beyond 38 digits.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[id_col].dataType.simpleString()
    vector = F.col(vector_col).cast("array<double>")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), vector.alias("vector")).where(F.col(vector_col).isNotNull() & (F.size(vector) > 0) & ~bad)
    widths = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if widths is None:
        return spark.createDataFrame([], _schema(id_type))
    dims, n = widths["dims"], widths["count"]
    rows = rows.where(F.size("vector") == dims)
    keep = Scratch(spark, "whiten")
    parts = keep.keep(rows.select("vector").mapInArrow(_scatter(dims), "i int, n long, s decimal(38,0), x array<decimal(38,0)>"))
    sums = {r["i"]: (int(r["s"]), int(r["n"])) for r in parts.groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
    products = parts.select("i", F.posexplode("x").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    x = {(r["i"], r["i"] + r["j"]): int(r["x"]) for r in products.collect()}  # one number for each pair of dimensions
    s, n = [sums[i][0] for i in range(dims)], sums[0][1]
    v = covariance(n, s, x)
    e, u = principal(v)
    trace, found = math.fsum(np.diag(v)), min(components, dims)
    real = e[:found] > RANK * max(float(e[0]), 0.0)
    to = np.where(real, u[:, :found] / np.sqrt(np.where(real, e[:found], 1)), np.nan)
    shares = [float(a / trace) if ok else 0.0 for a, ok in zip(e[:found], real, strict=True)]
    projected = keep.keep(rows.mapInArrow(_projected(dims, n, s, to), f"vec_id {id_type}, deviation decimal(38,0), whitened array<double>"))
    error = _identity_error(projected, n, np.flatnonzero(real))
    return projected.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
        F.element_at(F.lit(shares), F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))


def _identity_error(projected: DataFrame, n: int, real: np.ndarray) -> float:
    """The largest entry by size of the covariance of the whitened values, over all rows, minus the identity."""
    if not len(real):
        return 0.0
    k = len(real)  # components of full rank come first
    sums = projected.select(F.slice("whitened", 1, k).alias("whitened")).mapInArrow(_moments(k), "i int, s double, p array<double>")
    one, two = np.zeros(k), np.zeros((k, k))
    got = sums.select("i", "s", F.posexplode("p").alias("j", "p")).groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("p").alias("p")).collect()
    for r in got:
        one[r["i"]], two[r["i"], r["j"]] = r["s"] / n, r["p"] / n
    return float(np.abs(two - np.outer(one, one) - np.eye(k)).max())
