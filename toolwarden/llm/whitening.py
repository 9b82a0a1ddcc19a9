"""Whitening of embeddings by Jacobi-Davidson, without the covariance matrix.

The leading eigenvectors of the covariance are found from products with blocks of vectors alone:
each product is one pass over the stored rows, which are centred before they are multiplied, and
brings back a matrix of dimensions times block, summed on the way in groups of tasks.  The driver
holds a search space of a few blocks.  A round takes the Ritz pairs of the space; pairs whose
residual is down to rounding are locked; for each of the others the correction equation,
projected off what is locked and off the Ritz vectors, is solved for some steps of MINRES, all of
them side by side so that a step is one pass; and the corrections, made orthogonal, join the
space.  A full space restarts from its best Ritz vectors.  The last step is Rayleigh-Ritz over
all that is locked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import kept

#: Steps of MINRES for a round's corrections, and rounds until the search is given up.
INNER_STEPS = 6
ROUNDS = 200
#: Entries of this size or more, scaled, are no exact double: their rows take no part.
LIMIT = 1 << 52
#: Partial sums that meet in one task.
FAN_IN = 64


class Fit(NamedTuple):
    """What the rows have in common: number, dimensions, sums, and the largest size of an entry."""

    n: int
    dims: int
    total: np.ndarray  # of Python integers
    largest: int

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        if self.n * self.largest >= 1 << 61:
            return x.astype(object) * self.n - self.total
        return x * self.n - self.total.astype(np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once or twice however large the mean is."""
        return self.scaled(x).astype(np.float64) / self.n


def _rows(batch: pa.RecordBatch, dims: int, column: int = 0) -> np.ndarray:
    packed = batch.column(column)
    data = b"".join(packed.to_pylist()) if packed.null_count else packed.buffers()[2]
    first, last = (int(v) for v in np.frombuffer(packed.buffers()[1], np.int32)[[packed.offset, packed.offset + len(packed)]])
    return np.frombuffer(data, np.int64, (last - first) // 8, first).reshape(-1, dims)


def packed(vectors: DataFrame, scale: int, shift: int) -> DataFrame:
    """(id, dims, x) of (id, vector) rows: whole numbers floor(scale * c) + shift, eight bytes each.

    Vectors that are null or empty, or hold entries that are null, not finite or too large, are left out.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            size = np.zeros(len(column), np.int64)
            size[~np.array(column.is_null())] = np.diff(column.drop_null().offsets.to_numpy())
            flat = column.flatten()
            value = np.floor(scale * flat.fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64))
            good = np.abs(value) < LIMIT
            total = np.concatenate([[0], np.cumsum(good)])
            end = np.cumsum(size)
            fine = np.flatnonzero((total[end] - total[end - size] == size) & (size > 0))
            x = np.where(good, value, 0).astype(np.int64) + shift
            yield pa.record_batch(
                [batch.column(0).take(pa.array(fine)), pa.array(size[fine].astype(np.int32)),
                 pa.array([x[end[k] - size[k]:end[k]].tobytes() for k in fine], pa.binary())], names=["id", "dims", "x"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(pack, f"id {kind}, dims int, x binary")


def fitted(rows: DataFrame) -> Fit:
    """Number, sums and largest entry of packed rows of the most frequent length (of several, the smallest)."""
    sizes = rows.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(1).collect()
    if not sizes:
        return Fit(0, 0, np.zeros(0, object), 0)
    dims = sizes[0].dims

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch, dims)
                # Halves of the numbers add up without overflow.
                low, high = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)
                yield pa.record_batch([pa.array(np.arange(dims, dtype=np.int32)), pa.array(low), pa.array(high),
                                       pa.array(np.abs(x).max(axis=0))], names=["k", "low", "high", "most"])

    parts = (rows.where(F.col("dims") == dims).select("x").mapInArrow(sums, "k int, low bigint, high bigint, most bigint")
             .groupBy("k").agg(F.sum(F.col("low").cast("decimal(38,0)")).alias("low"),
                               F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.max("most").alias("most"))
             .orderBy("k").collect())
    total = np.array([int(r.low) + (int(r.high) << 32) for r in parts], object)
    return Fit(sizes[0]["count"], dims, total, max(r.most for r in parts))


def _summed(parts: DataFrame, tasks: int, merge: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
    """One array from a row ``part`` (float64, as bytes) per task, merged in groups and then here."""
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.frombuffer(v, np.float64) for batch in batches for v in batch.column(0).to_pylist()]
        if found:
            yield pa.record_batch([pa.array([merge(found).tobytes()], pa.binary())], names=["part"])

    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        parts = parts.repartition(tasks).mapInArrow(meet, "part binary")
    return merge([np.frombuffer(r.part, np.float64) for r in parts.collect()])


def product(rows: DataFrame, fit: Fit) -> Callable[[np.ndarray], np.ndarray]:
    """The covariance of the rows times a block of vectors, as a function; a call is one pass."""
    tasks = rows.rdd.getNumPartitions()

    def apply(block: np.ndarray) -> np.ndarray:
        sent = rows.sparkSession.sparkContext.broadcast((fit, block))

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fit, block = sent.value
            out, some = np.zeros(block.shape), False
            for batch in batches:
                if batch.num_rows:
                    y, some = fit.centred(_rows(batch, fit.dims)), True
                    out += y.T @ (y @ block)
            if some:
                yield pa.record_batch([pa.array([out.tobytes()], pa.binary())], names=["part"])

        try:
            whole = _summed(rows.select("x").mapInArrow(multiply, "part binary"), tasks, lambda found: np.sum(found, axis=0))
        finally:
            sent.unpersist()
        return whole.reshape(block.shape) / fit.n

    return apply


def _off(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``block`` without its part in the span of an orthonormal basis; twice, as once leaves rounding."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    return block


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to ``basis``."""
    norm = np.linalg.norm(block, axis=0)
    block = block[:, norm > 0] / norm[norm > 0]
    for _ in range(2):
        left, weight, _ = np.linalg.svd(_off(block, basis), full_matrices=False)
        block = left[:, weight > 1e-8 * max(1.0, weight.max(initial=0))]
    return block[:, :len(basis) - basis.shape[1]]


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, tolerance: float = 1e-3) -> np.ndarray:
    """Least-residual solutions of symmetric systems, one per column of ``right``; each step is one call.

    Columns run side by side with coefficients of their own; one that is done no longer changes.
    """
    def safe(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x, 1.0)

    size = np.linalg.norm(right, axis=0)
    beta, first = size, right / safe(size)
    before, now = np.zeros_like(right), first
    out = np.zeros_like(right)
    older, old = np.zeros_like(right), np.zeros_like(right)
    c, s, c1, s1 = np.ones_like(size), np.zeros_like(size), np.ones_like(size), np.zeros_like(size)
    rest = size.copy()
    active, last = size > 0, np.zeros_like(size)
    for _ in range(steps):
        if not active.any():
            break
        image = apply(now) - last * before
        alpha = np.sum(now * image, axis=0)
        image = image - alpha * now
        beta = np.linalg.norm(image, axis=0)
        # The last two rotations on the new column of the tridiagonal matrix, then a third that clears beta.
        epsilon, kappa = s1 * last, c1 * last
        delta, gamma = c * kappa + s * alpha, c * alpha - s * kappa
        rho = np.hypot(gamma, beta)
        c1, s1 = c, s
        c, s = np.where(rho > 0, gamma / safe(rho), 1.0), np.where(rho > 0, beta / safe(rho), 0.0)
        way = (now - epsilon * older - delta * old) / safe(rho)
        older, old = old, way
        out = out + np.where(active, rest * c, 0) * way
        rest = -s * rest
        active = active & (rho > 0) & (np.abs(rest) > tolerance * size) & (beta > 1e-14 * safe(np.abs(alpha)))
        before, now, last = now, image / safe(beta), beta
    return out


class Components(NamedTuple):
    """Eigenvalues by fall, eigenvectors in columns, and the largest residual of a pair."""

    values: np.ndarray
    vectors: np.ndarray
    residual: float


def jacobi_davidson(apply: Callable[[np.ndarray], np.ndarray], dims: int, count: int, inner: int = INNER_STEPS,
                    rounds: int = ROUNDS, seed: int = 3) -> Components:
    """The ``count`` leading eigenpairs of a symmetric matrix of ``dims`` rows, known by its products.

    Residuals are brought to the rounding of a product, a few units of the last place of the
    largest eigenvalue.  Where rounding holds them above that, the search ends once they have
    stopped falling below 1e-12 of it; a search that doesn't get there is an error.
    """
    count = min(count, dims)
    widest = min(dims, 3 * count + 16)
    rng = np.random.default_rng(seed)
    space = np.linalg.qr(rng.standard_normal((dims, min(dims, count + 8))))[0]
    images = apply(space)
    locked, locked_images, done = np.zeros((dims, 0)), np.zeros((dims, 0)), np.zeros(0)
    best, still = np.inf, 0
    for _ in range(rounds):
        small = space.T @ images
        value, turn = np.linalg.eigh((small + small.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        space, images = space @ turn, images @ turn
        need = count - len(done)
        residual = _off(images[:, :need] - space[:, :need] * value[:need], locked)
        norm = np.linalg.norm(residual, axis=0)
        scale = max(value.max(initial=0.0), done.max(initial=0.0), np.finfo(float).tiny)
        tolerance = 8 * np.sqrt(dims) * np.finfo(float).eps * scale
        still = 0 if norm.max() < best / 2 else still + 1
        best = min(best, norm.max())
        if still >= 4 and norm.max() <= 1e-12 * scale:
            tolerance = norm.max()
        lock = norm <= tolerance
        if lock.any():
            at = np.flatnonzero(lock)
            locked, locked_images = np.hstack([locked, space[:, at]]), np.hstack([locked_images, images[:, at]])
            done, best, still = np.append(done, value[at]), np.inf, 0
            stay = np.setdiff1d(np.arange(space.shape[1]), at)
            space, images, value = space[:, stay], images[:, stay], value[stay]
            if len(done) == count:
                if not len(value) or value[0] <= done.min() + tolerance:
                    break
                # A larger one was found meanwhile: the smallest goes back into the space.
                least, others = done.argmin(), np.arange(count) != done.argmin()
                space, images = np.column_stack([space, locked[:, least]]), np.column_stack([images, locked_images[:, least]])
                locked, locked_images, done = locked[:, others], locked_images[:, others], done[others]
                continue
            residual, need = residual[:, ~lock], count - len(done)
        if space.shape[1] + need > widest - locked.shape[1] and space.shape[1] + locked.shape[1] < dims:
            rest = min(space.shape[1], 2 * need + 8)
            space, images = space[:, :rest], images[:, :rest]
        shut = np.hstack([locked, space[:, :need]])
        shift = value[:need]
        correction = minres(lambda v: _off(apply(_off(v, shut)) - _off(v, shut) * shift, shut),
                            -_off(residual, shut), inner)
        # A random direction goes along, so that nothing orthogonal to the start stays hidden.
        fresh = np.hstack([_off(correction, shut), rng.standard_normal((dims, 1))])
        fresh = _orthonormal(fresh, np.hstack([locked, space]))
        if fresh.shape[1]:
            space, images = np.hstack([space, fresh]), np.hstack([images, apply(fresh)])
        elif still >= 4:
            raise ArithmeticError(f"residuals stay at {norm.max():.3g} of {scale:.3g}")
    else:
        raise ArithmeticError(f"residuals still at {best:.3g} after {rounds} rounds")
    locked = np.linalg.qr(locked)[0]
    images = apply(locked)
    small = locked.T @ images
    value, turn = np.linalg.eigh((small + small.T) / 2)
    value, vectors, images = value[::-1], (locked @ turn)[:, ::-1], (images @ turn)[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(count)] < 0, -1, 1)
    signed = images * np.sign(np.sum(images * vectors, axis=0))
    return Components(value, vectors, float(np.linalg.norm(signed - vectors * value, axis=0).max()))


def _spread(found: list[np.ndarray], width: int) -> np.ndarray:
    """Number, mean and centred products of several parts as one: [n, mean, products]."""
    n, mean, products = 0.0, np.zeros(width), np.zeros((width, width))
    for part in found:
        m, own, more = part[0], part[1:width + 1], part[width + 1:].reshape(width, width)
        off = own - mean
        products = products + more + np.outer(off, off) * (n * m / (n + m))
        mean, n = mean + off * (m / (n + m)), n + m
    return np.concatenate([[n], mean, products.ravel()])


def _identity_error(rows: DataFrame, fit: Fit, turn: np.ndarray) -> float:
    """The largest entry of the whitened rows' covariance minus the identity."""
    sent = rows.sparkSession.sparkContext.broadcast((fit, turn))
    width = turn.shape[1]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, turn = sent.value
        whole: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                y = fit.centred(_rows(batch, fit.dims)) @ turn
                mean = y.mean(axis=0)
                own = np.concatenate([[len(y)], mean, ((y - mean).T @ (y - mean)).ravel()])
                whole = [_spread([*whole, own], width)]
        yield pa.record_batch([pa.array([w.tobytes() for w in whole], pa.binary())], names=["part"])

    total = _summed(rows.select("x").mapInArrow(spread, "part binary"), rows.rdd.getNumPartitions(),
                    lambda found: _spread(found, width))
    return float(np.abs(total[width + 1:].reshape(width, width) / total[0] - np.eye(width)).max())


def _trace(rows: DataFrame, fit: Fit) -> float:
    """The sum of all eigenvalues: mean squared distance from the mean."""
    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = fit.centred(_rows(batch, fit.dims))
            yield pa.record_batch([pa.array([float(np.sum(y * y))])], names=["square"])

    return rows.select("x").mapInArrow(squares, "square double").agg(F.sum("square")).first()[0] / fit.n


class Whitening(NamedTuple):
    """Fitted components: the rows' fit, the eigenpairs, the shares of the trace, and the check of the result."""

    fit: Fit
    components: Components
    explained: np.ndarray
    identity_error: float


def fit_whitening(rows: DataFrame, count: int = 32) -> Whitening:
    """Components of packed rows; those whose eigenvalue is no more than rounding are not there."""
    fit = fitted(rows)
    rows = rows.where(F.col("dims") == fit.dims)
    trace = _trace(rows, fit) if fit.n else 0.0
    if trace == 0:
        return Whitening(fit, Components(np.zeros(0), np.zeros((fit.dims, 0)), 0.0), np.zeros(0), 0.0)
    found = jacobi_davidson(product(rows, fit), fit.dims, count)
    some = int(np.sum(found.values > 1e-12 * found.values[0]))
    found = Components(found.values[:some], found.vectors[:, :some], found.residual)
    return Whitening(fit, found, found.values / trace, _identity_error(rows, fit, found.vectors / np.sqrt(found.values)))


def whiten(vectors: DataFrame, count: int = 32, scale: int = 64, shift: int = 1_000_000, id_: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """One row per vector: the id, n, deviation, whitened, explained, identity_error.

    Entries become floor(``scale`` * c) + ``shift``; n vectors are fitted and S is their sum.
    ``whitened`` has, for up to ``count`` leading eigenvectors of the covariance (divisor n), the
    centred vector's projection over the root of the eigenvalue; ``explained`` their shares of the
    variance; ``deviation`` is the exact sum of (n * x - S) squared; ``identity_error`` the largest
    entry of the whitened rows' covariance minus the identity.

    Vectors that are null or empty or hold a null, a non-finite entry or one of 2**52 or more after
    scaling take no part, nor do those of another length than the most frequent.  Components of no
    variance beyond rounding are left out, so equal vectors have none.  Repeated rows count each,
    null ids too; an empty table gives an empty result; further columns are not read.
    """
    spark = vectors.sparkSession
    rows = kept(packed(vectors.select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("v")), scale, shift), "vectors")
    white = fit_whitening(rows, count)
    fit, turn = white.fit, white.components.vectors / np.sqrt(white.components.values)
    sent = spark.sparkContext.broadcast((fit, turn))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, turn = sent.value
        for batch in batches:
            x = _rows(batch, fit.dims, 1)
            exact = fit.scaled(x)
            if exact.size and int(np.abs(exact).max()) ** 2 * fit.dims >= 1 << 63:
                exact = exact.astype(object)
            square = pa.array([Decimal(int(v)) for v in np.sum(exact * exact, axis=1)], pa.decimal128(38, 0))
            y = fit.centred(x) @ turn
            bounds = np.arange(0, y.size + 1, max(y.shape[1], 1), dtype=np.int32) if y.size else np.zeros(len(x) + 1, np.int32)
            yield pa.record_batch([batch.column(0), square, pa.ListArray.from_arrays(pa.array(bounds), pa.array(y.ravel()))],
                                  names=["id", "deviation", "whitened"])

    kind = rows.schema["id"].dataType.simpleString()
    out = (rows.where(F.col("dims") == fit.dims).select("id", "x")
           .mapInArrow(project, f"id {kind}, deviation decimal(38,0), whitened array<double>"))
    return out.select(F.col("id").alias(id_), F.lit(fit.n).cast("bigint").alias("n"), "deviation", "whitened",
                      F.array(*[F.lit(float(v)) for v in white.explained]).cast("array<double>").alias("explained"),
                      F.lit(white.identity_error).alias("identity_error"))
