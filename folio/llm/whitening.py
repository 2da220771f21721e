"""Whitening of embeddings on leading principal components, found by LOBPCG.

Every entry c becomes the integer x = floor(256 * c). The fit list is each distinct x vector
once; it is stored as blocks of rows in binary, so that a pass over it moves bytes, not cells.
What the method needs of the covariance V are products V @ B with a block of a few columns:
each task centres its rows, multiplies, and its d x m partial sums are added up by Spark. The
driver holds d x m matrices only, whatever the number of rows.

Each step of LOBPCG takes the iterate X, its residual W (orthogonal to X) and the previous
direction P, and solves the small eigenproblem on the span of the three (Rayleigh-Ritz); one pass
gives the products of W and P. X's product is an orthonormal combination of those; once it looks
converged, V @ X is computed anew, and only residuals of that product end the iteration
(``tolerance`` times the largest eigenvalue). If they do not hold, P is dropped and it goes on.
``guards`` more columns than components take part, so that speed depends on the gap behind them.

Defined cases: rows whose vector is null or holds a null or non-finite entry are dropped; a
shorter vector counts as followed by zeros; repeated rows each come back; a null id is carried.
Components whose eigenvalue is zero to working precision have no whitened value and are left
out (one distinct vector: no rows; two: one component). An empty table, or vectors without
entries, give no rows. Equal eigenvalues leave their components' basis undetermined; one basis
is used for all rows. Columns beyond id and vector are ignored. A deviation beyond 63 bits
stops the job instead of wrapping.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.scratch import materialise, remove

SCALE = 256
_BLOCK_CELLS = 1 << 19  # of the stored fit list: 4 MB a block
_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Fit:
    """n, sums (exact, as Python integers), the unit components as columns, their eigenvalues and V's trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    passes: int
    identity_error: float = float("nan")

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums], dtype=np.float64)


def integer_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and x (array of long) of each row that stays."""
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    vector = embeddings[vector_col].cast("array<double>")
    x = F.transform(vector, lambda c: F.floor(c * SCALE).cast("long"))
    return embeddings.filter(vector.isNotNull() & F.forall(vector, ok)).select(embeddings[id_col].alias("id"), x.alias("x"))


def _matrix(x: pa.Array, d: int) -> np.ndarray:
    """A column of lists as a matrix of d columns; shorter lists end in zeros."""
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    flat, sizes = x.flatten().to_numpy(zero_copy_only=False), np.diff(x.offsets.to_numpy())
    if (sizes == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(x), d), np.int64)
    out[np.repeat(np.arange(len(x)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def fit_blocks(vectors: DataFrame, d: int) -> DataFrame:
    """The distinct vectors, stored as blocks: rows (int) and cells (binary, int64 row by row)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_block = max(1, _BLOCK_CELLS // d)
        held, n = [], 0

        def block() -> pa.RecordBatch:
            cells = np.concatenate(held)
            return pa.record_batch({"rows": pa.array([len(cells)], pa.int32()), "cells": pa.array([cells.tobytes()], pa.binary())})

        for batch in batches:
            m = _matrix(batch.column(0), d)
            for at in range(0, len(m), per_block):
                held.append(m[at : at + per_block])
                n += len(held[-1])
                if n >= per_block:
                    yield block()
                    held, n = [], 0
        if n:
            yield block()

    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x")))
    return materialise(vectors.select(padded.alias("x")).distinct().mapInArrow(pack, "rows int, cells binary"), "whitening-fit")


def _summed(blocks: DataFrame, shape: tuple[int, ...], of_rows, kind: str = "double") -> np.ndarray:
    """The sum over all blocks of of_rows(x), an array of this shape. Spark adds the tasks' partial sums cell by cell."""
    size, dtype = int(np.prod(shape)), {"double": np.float64, "long": np.int64}[kind]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype)
        for batch in batches:
            for rows, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total += of_rows(np.frombuffer(cells.as_buffer(), np.int64).reshape(rows, -1)).reshape(-1)
        yield pa.record_batch({"at": pa.array(np.arange(size, dtype=np.int32)), "value": pa.array(total)})

    out = np.zeros(size, dtype)
    for at, value in blocks.mapInArrow(partial, f"at int, value {kind}").groupBy("at").agg(F.sum("value")).collect():
        out[at] = value
    return out.reshape(shape)


def _orthonormal(b: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of b's span outside the given orthonormal blocks."""
    for _ in range(2):
        for q in against:
            b = b - q @ (q.T @ b)
        size = np.linalg.norm(b, axis=0)
        b = b[:, size > 0] / size[size > 0]
        s, u = np.linalg.eigh(b.T @ b)
        keep = s > 1e-10 * max(s.max(initial=0), 1e-300)
        b = b @ (u[:, keep] / np.sqrt(s[keep]))
    return b


def lobpcg(product, d: int, k: int, guards: int, tolerance: float, most: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Leading k eigenpairs of a symmetric matrix known by its products: values, vectors, the largest certified residual over the largest value, passes."""
    m = min(d, k + guards)
    k = min(k, d)
    symmetric = lambda g: (g + g.T) / 2
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, m)))[0]
    vx, p, fresh, passes, best = product(x), x[:, :0], True, 1, None
    while True:
        theta, turn = np.linalg.eigh(symmetric(x.T @ vx))
        order = np.argsort(-theta)
        theta, x, vx = theta[order], x @ turn[:, order], vx @ turn[:, order]
        r = vx - x * theta
        residual = float(np.linalg.norm(r[:, :k], axis=0).max() / max(abs(theta[0]), 1e-300))
        if fresh and (best is None or residual < best[2]):
            best = (theta[:k], x[:, :k], residual)
        if fresh and (residual <= tolerance or passes >= most or m == d):
            return *best, passes
        if residual <= tolerance or passes >= most:  # of a combination of products: look at the true one before believing it
            x = np.linalg.qr(x)[0]
            vx, p, fresh, passes = product(x), x[:, :0], True, passes + 1
            continue
        w = _orthonormal(r, x)
        p = _orthonormal(p, x, w)
        if w.shape[1] == 0 and fresh:
            return *best, passes
        more = np.hstack([w, p])
        basis, image, passes = np.hstack([x, more]), np.hstack([vx, product(more)]), passes + 1
        values, c = np.linalg.eigh(symmetric(basis.T @ image))
        c = c[:, np.argsort(-values)[:m]]
        p = more @ c[m:]
        x, vx, fresh = basis @ c, image @ c, False


def fit(vectors: DataFrame, k: int = 4, guards: int = 12, tolerance: float = 1e-13, most: int = 500) -> Fit | None:
    """``most`` bounds the passes; a fit that ends there without certified residuals is an error."""
    d = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    if d == 0:
        return None
    blocks = fit_blocks(vectors, d)
    counted = _summed(blocks, (d + 1,), lambda x: np.append(x.sum(axis=0), len(x)), "long")
    n, sums = int(counted[-1]), [int(s) for s in counted[:-1]]
    mean = np.array([s / n for s in sums])
    trace = float(_summed(blocks, (1,), lambda x: np.array([((x - mean) ** 2).sum()]))[0]) / n

    def product(b: np.ndarray) -> np.ndarray:
        def of_rows(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ b)

        return _summed(blocks, b.shape, of_rows) / n

    if trace <= 0:
        remove(blocks)
        return None
    values, components, residual, passes = lobpcg(product, d, k, guards, tolerance, most)
    real = values > 16 * d * np.finfo(float).eps * values[0]
    if residual > 10 * tolerance:
        raise ArithmeticError(f"residuals are certified to {residual:.1e} of the largest eigenvalue only, after {passes} passes")
    found = Fit(n, sums, components[:, real], values[real], trace, residual, passes)
    turn = found.components / np.sqrt(found.values)
    size = turn.shape[1]

    def moments(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ turn
        return np.vstack([w.T @ w, w.sum(axis=0)])

    both = _summed(blocks, (size + 1, size), moments) / n
    found.identity_error = float(np.abs(both[:size] - np.outer(both[size], both[size]) - np.eye(size)).max())
    remove(blocks)
    return found


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Exact sum over dimensions of (n * x - S) ** 2."""
    reach = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max((abs(s) for s in sums), default=0)
    if reach * reach * max(1, len(sums)) < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1)
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return np.array(exact, dtype=np.int64)  # raises OverflowError beyond 63 bits


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, **how) -> DataFrame:
    """A row for each remaining row and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    vectors = integer_vectors(embeddings, id_col, vector_col)
    schema = f"`{id_col}` {embeddings.schema[id_col].dataType.simpleString()}, {_OUT}"
    found = fit(vectors, components, **how)
    if found is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    n, sums, mean, d, k = found.n, found.sums, found.mean, len(found.sums), len(found.values)
    turn, explained, error = found.components / np.sqrt(found.values), found.values / found.trace, found.identity_error

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), d)
            rows = len(x)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, n, np.int64)),
                pa.array(np.repeat(deviations(x, n, sums), k)),
                pa.array(((x - mean) @ turn).reshape(-1)),
                pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *(c.split()[0] for c in _OUT.split(", "))])

    return vectors.mapInArrow(project, schema)
