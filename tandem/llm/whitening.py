"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance is never formed. A block Q of a few columns is sent out, every task adds up Cᵀ(CQ) over
its centred rows C, and the sums are added in a grouped aggregate; one such pass costs rows x dimensions
x columns. A polynomial of the covariance, built by the Chebyshev recurrence from such passes, damps the
unwanted part of the spectrum; QR and Rayleigh-Ritz then give the best vectors of the block, and their
residuals say how far they are from eigenvectors. Rounds go on until the residuals are those of
rounding. The block has spare columns; where it shrinks slowly it is made wider, up to all dimensions.

The driver holds blocks of dimensions x columns, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import sent
from tandem.sources.workspace import stage

COMPONENTS, SCALE, SHIFT, SEED = 16, 64, 1_000_000, 12
#: Degree of the polynomial of a round, residual of a vector against the largest eigenvalue at which it
#: is certified, and rounds at most before the block is widened to all dimensions.
DEGREE, CERTIFIED, ROUNDS = 10, 1e-13, 40
#: An eigenvalue below this share of the largest one is zero: nothing can be whitened along it.
ZERO = 1e-12
#: Entries of this size and more are left out like infinite ones: their sums would not be exact.
LARGEST = 2.0**40


class Fit(NamedTuple):
    """Counts and sums of the fit list and its components."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray  # falling
    vectors: np.ndarray  # a column each
    residual: float  # largest residual against the largest eigenvalue
    passes: int


def lattice(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x): floor(scale * c) + shift of every component, as whole numbers.

    Vectors that are null, empty, or hold a null, non-finite or enormous entry are left out, and those
    whose length is not the commonest one (the greater of equally common ones).
    """
    kept = vectors.select("vec_id", F.col("embedding").alias("v"))
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists(
        "v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= LARGEST)
    )
    rows = kept.filter(usable).select(
        "vec_id",
        F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("long") + shift).alias("x"),
    )
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == (length["d"] if length else 0))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows and per-dimension sums, in whole numbers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import decimal

        n, total = 0, [0] * d
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n += len(x)
            total = [a + int(b) for a, b in zip(total, x.sum(0))]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()),
                pa.array([decimal.Decimal(x) for x in total], pa.decimal128(38, 0)),
            ],
            names=["i", "n", "s"],
        )

    parts = fit.select("x").mapInArrow(run, "i int, n long, s decimal(38,0)")
    found = {r["i"]: r for r in parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}
    return (found[0]["n"], [int(found[i]["s"]) for i in range(d)]) if found else (0, [0] * d)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: the whole part of the mean is taken off exactly, then the rest."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole) - np.array([s % n for s in sums]) / n


def _summed(
    fit: DataFrame, n: int, sums: list[int], of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]
) -> np.ndarray:
    """The sum of ``of(centred rows)`` over all rows. A task sends one matrix; matrices are added by row."""
    rows, columns = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            x = _matrix(batch.column(0), len(sums))
            for k in range(0, len(x), 4096):
                total += of(_centred(x[k : k + 4096], n, sums))
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(rows), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"]
        )

    parts = fit.select("x").mapInArrow(run, "i int, v array<double>")
    added = parts.groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(columns)]).alias("v"))
    out = np.zeros(shape)
    for row in added.collect():
        out[row["i"]] = row["v"]
    return out


def _rayleigh_ritz(q: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, falling, with their vectors and these times the covariance, from w = V q."""
    h = q.T @ w
    values, turn = np.linalg.eigh((h + h.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, w @ turn


def components(fit: DataFrame, k: int = COMPONENTS, width: int | None = None) -> Fit:
    """The first k principal components of the rows ``x`` (whole numbers, each row counted once).

    ``width`` is the number of columns of the block at first (twice k). Fewer than k components come
    back if there are fewer dimensions or the covariance has a smaller rank.
    """
    first = fit.select(F.size("x").alias("d")).first()
    d = first["d"] if first else 0
    n, sums = _exact_sums(fit, d) if d else (0, [])
    if not n:
        return Fit(0, sums, 0.0, np.empty(0), np.empty((d, 0)), 0.0, 0)
    passes, random, trace = 0, np.random.default_rng(SEED), None

    def times(q: np.ndarray) -> np.ndarray:
        """V q: one pass over the rows. The first pass adds up the squares for the trace, too."""
        nonlocal passes, trace
        passes += 1

        def of(c: np.ndarray) -> np.ndarray:
            both = c.T @ (c @ q)
            return both if trace is not None else np.hstack([both, (c * c).sum(0)[:, None]])

        found = _summed(fit, n, sums, of, (d, q.shape[1] + (trace is None))) / n
        if trace is None:
            trace = float(found[:, -1].sum())
            found = found[:, :-1]
        return found

    def block(q: np.ndarray, b: int) -> np.ndarray:
        """The columns of q, and random ones up to b, made orthonormal."""
        if b == d:
            return np.eye(d)
        return np.linalg.qr(np.hstack([q, random.normal(size=(d, b - q.shape[1]))]))[0]

    b = min(d, width or 2 * k)
    q = block(np.empty((d, 0)), b)
    values, q, w = _rayleigh_ritz(q, times(q))
    floor, lanczos, last = 0.0, random.normal(size=d), np.inf
    lanczos, earlier, beta, diagonal, beside = lanczos / np.linalg.norm(lanczos), np.zeros(d), 0.0, [], []
    for turn in range(ROUNDS + 1):
        lead = values[: min(k, b)]
        gap = np.linalg.norm(w[:, : len(lead)] - q[:, : len(lead)] * lead, axis=0).max()
        residual = float(gap / max(values[0], 1e-300))
        if b == d or residual <= CERTIFIED:
            break
        if turn and residual > last / 10:
            b = d if turn >= ROUNDS - 1 else min(d, 2 * b)
            q = block(q, b)
            values, q, w = _rayleigh_ritz(q, times(q))
            last = np.inf
            continue
        last = residual
        # Damp [floor, cut]; scaled by its value at the largest eigenvalue, so nothing overflows.
        cut = max(values[-1], floor + 1e-9 * values[0])
        middle, half = (cut + floor) / 2, (cut - floor) / 2
        sigma = first_sigma = half / (values[0] - middle)
        before, now = q, (w - middle * q) * (sigma / half)
        for _ in range(DEGREE - 1):
            # The first round also runs Lanczos steps in a column beside, for a bound below the spectrum.
            wanted = turn == 0 and beta >= 0
            product = times(np.hstack([now, lanczos[:, None]]) if wanted else now)
            if wanted:
                step = product[:, -1] - beta * earlier
                diagonal.append(float(lanczos @ step))
                step -= diagonal[-1] * lanczos
                beta, earlier = float(np.linalg.norm(step)), lanczos
                beside.append(beta)
                lanczos, beta = (step / beta, beta) if beta > 1e-9 * values[0] else (lanczos, -1.0)
                product = product[:, :-1]
            later = 1 / (2 / first_sigma - sigma)
            before, now = now, 2 * later / half * (product - middle * now) - sigma * later * before
            sigma = later
        if turn == 0:
            t = np.diag(diagonal) + np.diag(beside[:-1], 1) + np.diag(beside[:-1], -1)
            floor = max(0.0, float(np.linalg.eigvalsh(t)[0]) - beside[-1])
        q = np.linalg.qr(now)[0]
        values, q, w = _rayleigh_ritz(q, times(q))
    keep = min(k, int((values > ZERO * max(values[0], 1e-300)).sum()))
    vectors = q[:, :keep]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), range(keep)])
    return Fit(n, sums, trace, values[:keep], vectors * sign, residual, passes)


def identity_error(fit: DataFrame, found: Fit) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity."""
    k = len(found.values)
    if not k:
        return 0.0
    turn = found.vectors / np.sqrt(found.values)

    def of(c: np.ndarray) -> np.ndarray:
        w = c @ turn
        return np.vstack([w.T @ w, w.sum(0)])

    total = _summed(fit, found.n, found.sums, of, (k + 1, k)) / found.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def transform(rows: DataFrame, found: Fit) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained) for every row ``x`` and component.

    ``deviation`` is null where it does not fit 64 bits.
    """
    here = sent(rows.sparkSession, found)  # dimensions x components
    k = len(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = here()
        n, d = f.n, len(f.sums)
        turn, share = f.vectors / np.sqrt(f.values), f.values / f.trace if k else f.values
        whole = np.array([s // n for s in f.sums], np.int64) if n else np.zeros(d, np.int64)
        rest = np.array([s % n for s in f.sums], np.int64) if n else whole
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, 2048):
                some = batch.slice(at, 2048)
                x = _matrix(some.column(1), d)
                y = x - whole
                far = np.abs(n * y.astype(np.float64)).max(initial=0) >= 2.0**30
                apart = n * y.astype(object if far else np.int64) - rest
                deviation = (apart * apart).sum(1).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * k, n, np.int64)),
                        pa.array([v if v < 2**63 else None for v in deviation], pa.int64()).take(
                            pa.array(np.repeat(np.arange(len(x)), k))
                        ),
                        pa.array((_centred(x, n, f.sums) @ turn).ravel()),
                        pa.array(np.tile(share, len(x))),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained"],
                )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "x").mapInArrow(
        run,
        f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double",
    )


def whiten(
    vectors: DataFrame, k: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT
) -> DataFrame:
    """A row for each usable row of ``vectors`` and each of the first k components, with
    ``identity_error``; the components are fitted to the distinct vectors.

    Copies are folded in every task before they are dealt out, so any share of the rows may be one
    vector; each copy gets its rows, repeated or null vec_ids too. Components along which nothing varies
    are left out: a table of one distinct vector, of none, or without rows gives no rows. Ties between
    eigenvalues leave the choice of the basis open. Other columns are not read. See ``lattice`` for the
    vectors that take no part.
    """
    rows = lattice(vectors, scale, shift)
    fit = stage(rows.select("x").distinct(), "fit")
    found = components(fit, k)
    return transform(rows, found).withColumn("identity_error", F.lit(identity_error(fit, found)))
