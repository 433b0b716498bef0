"""Embedding whitening: Chebyshev-filtered subspace iteration over distributed centred products, certified by residuals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import discard, materialize, table

COMPONENTS = 4
SCALE = 256.0
BLOCK_ROWS = 4096
EXTRA = 16  # columns of the subspace beside the components
FRESH = 2  # of those, columns that are drawn anew each cycle, so that nothing missed by the first draw stays missed
DEGREE = 24  # of the filter, at most
SPREAD = 18.0  # nats by which a filter may raise one direction over another; more would drown the lesser ones in rounding
TOLERANCE = 1e-13  # of the largest eigenvalue: residual norms of the components and changes of their eigenvalues
CYCLES = 6  # before the subspace is doubled; as wide as the vectors it is exact
MAX_WIDTHS = 64
#: Ends of what a long holds, as double.
_LEAST, _MOST = -(2.0**63), 2.0**63 - 1024


@dataclass
class Whitening:
    """A fit: x-vectors, their sums, unit eigenvectors (columns), eigenvalues, the trace and the largest error from the identity."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # of integers: rounded once

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]


def integers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per width of a list column: indices of the rows that are finite throughout, and floor(256*c) of those as longs.

    What a long can't hold saturates, as a cast does."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    flat = lists.flatten()
    holds_null = np.asarray(flat.is_null())
    values = np.asarray(flat.cast(pa.float64()).fill_null(0.0))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    for width in np.unique(sizes[sizes > 0]):
        rows = np.nonzero(sizes == width)[0]
        at = starts[rows][:, None] + np.arange(width)[None, :]
        c = values[at]
        good = np.isfinite(c).all(axis=1) & ~holds_null[at].any(axis=1)
        with np.errstate(over="ignore"):
            yield rows[good], np.clip(np.floor(SCALE * c[good]), _LEAST, _MOST).astype(np.int64)


def _narrow(x: np.ndarray) -> np.ndarray:
    most = int(np.abs(x.astype(np.float64)).max(initial=0))
    return x.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def _as_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each finite vector as the bytes of its longs: what `distinct` compares."""
    for batch in batches:
        for _, x in integers(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1]), pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["dim", "x"])


def _as_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one width to blocks of at most `BLOCK_ROWS` rows, as narrow integers."""
    held: dict[int, list[bytes]] = {}

    def block(dim: int, rows: list[bytes]) -> pa.RecordBatch:
        x = _narrow(np.frombuffer(b"".join(rows), np.int64))
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(rows)], pa.int32()), pa.array([x.dtype.itemsize], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["dim", "m", "item", "x"])

    for batch in batches:
        for dim, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = held.setdefault(dim, [])
            rows.append(x)
            if len(rows) >= max(1, min(BLOCK_ROWS, 8_000_000 // (8 * dim))):
                yield block(dim, held.pop(dim))
    for dim, rows in held.items():
        yield block(dim, rows)


def fit_list(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Each distinct x-vector once, in blocks `dim, m, item, x` written to the shared folder.

    Equal vectors meet by a hash of all their bytes after a partial distinct in each task, so a vector that most rows
    hold is sent once a task; a block holds at most 4,096 rows, so memory does not depend on the input.
    """
    rows = vectors.select(F.col(f"`{vector}`").alias("v")).where("v is not null and size(v) > 0").mapInArrow(_as_rows, "dim int, x binary")
    return materialize(rows.distinct().mapInArrow(_as_blocks, "dim int, m int, item int, x binary"), "fit")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    kinds = {2: np.int16, 4: np.int32, 8: np.int64}
    for batch in batches:
        for dim, item, x in zip(*(batch.column(c).to_pylist() for c in ("dim", "item", "x")), strict=True):
            yield np.frombuffer(x, kinds[item]).reshape(-1, dim)


def _summed(blocks: DataFrame, rows: int, columns: int, part) -> np.ndarray:
    """The sum over all blocks of `part(x)`, a rows x columns matrix: one row a task and matrix row, added on the cluster.

    The driver gets rows*columns doubles, whatever the number of tasks."""
    names = [f"c{j}" for j in range(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _opened(batches):
            p = part(x)
            total = p if total is None else total + p
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows), pa.int32()), *(pa.array(np.ascontiguousarray(total[:, j])) for j in range(columns))], ["i", *names])

    parts = blocks.mapInArrow(run, "i int, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros((rows, columns))
    for r in parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r["i"]] = [r[c] for c in names]
    return out


def _sums(blocks: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Rows and exact sums of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for x in _opened(batches):
            n += len(x)
            wide = x.dtype == np.int64
            total = [a + int(b) for a, b in zip(total, (x.astype(object) if wide else x.astype(np.int64)).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim + 1), pa.int32()), pa.array([str(v) for v in [*total, n]], pa.string())], ["i", "s"])

    parts = blocks.mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    got = {r["i"]: int(r["s"]) for r in parts.collect()}
    return got[dim], [got[i] for i in range(dim)]


def chebyshev(product, y: np.ndarray, locked: np.ndarray, low: float, high: float, degree: int) -> np.ndarray:
    """T_degree of the operator mapped so that [low, high] becomes [-1, 1], applied to the columns of `y`.

    The three-term recurrence; both terms are scaled alike after each step, and the locked directions taken out."""
    centre, half = (low + high) / 2, max((high - low) / 2, np.finfo(float).tiny)
    freed = lambda z: z - locked @ (locked.T @ z)
    before, now = y, freed((product(y) - centre * y) / half)
    for _ in range(degree - 1):
        before, now = now, freed(2 * (product(now) - centre * now) / half - before)
        size = np.abs(now).max()
        before, now = before / size, now / size
    return now


def leading(product, dim: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The `k` largest eigenvalues and their unit eigenvectors of a symmetric, non-negative operator.

    A cycle filters the subspace, orthogonalises it (QR) and solves the projected problem (Rayleigh-Ritz, which takes
    one product that also gives the residuals). Certified once, after a cycle that began with fresh random columns,
    the residuals of all k are within TOLERANCE of the largest eigenvalue and the k values did not move by more.
    Converged directions are locked: they stay in the projection but leave the filter, whose degree is bounded by what
    it may raise one direction over another. A subspace that doesn't settle is doubled; as wide as `dim` it is exact.
    """
    draw = np.random.default_rng(seed)
    width, k = min(dim, k + EXTRA), min(dim, k)
    orth = lambda z: np.linalg.qr(np.linalg.qr(z)[0])[0]

    def ritz(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = product(q)
        h = q.T @ w
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, w = q @ turn, w @ turn
        return values, q, np.linalg.norm(w - q * values, axis=0)

    values, q, residual = ritz(orth(draw.standard_normal((dim, width))))
    known, cycle = None, 0
    while True:
        top = max(values[0], 0.0)
        settled = (residual[:k] <= TOLERANCE * top).all()
        if width == dim or top == 0 or settled and known is not None and np.abs(known - values[:k]).max() <= TOLERANCE * top * 4:
            return values[:k], q[:, :k]
        known = values[:k].copy()
        cycle += 1
        locked = q[:, : int(np.cumprod(residual[:k] <= TOLERANCE * top).sum())]
        rest = q[:, locked.shape[1] :]
        high = max(values[-1 - FRESH], 1e-12 * top)
        if cycle % CYCLES == 0:  # too narrow for this spectrum
            width = min(dim, 2 * width)
        fresh = draw.standard_normal((dim, width - q.shape[1] + FRESH))
        rest = np.concatenate([rest[:, : max(0, rest.shape[1] - FRESH)], fresh / np.linalg.norm(fresh, axis=0)], axis=1)
        reach = np.arccosh(max(1.0 + 1e-9, 2 * values[min(locked.shape[1], len(values) - 1)] / high - 1))
        rest = chebyshev(product, rest - locked @ (locked.T @ rest), locked, 0.0, high, int(np.clip(SPREAD / reach, 2, DEGREE)))
        values, q, residual = ritz(orth(np.concatenate([locked, rest / np.linalg.norm(rest, axis=0)], axis=1)))


def fit(blocks: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a fit list of one width; None where it has no variance."""
    n, sums = _sums(blocks, dim)
    mean, passes = np.array([s / n for s in sums]), 0
    if n == 0:
        return None

    def product(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def part(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ q)

        return _summed(blocks, dim, q.shape[1], part) / n

    trace = float(_summed(blocks, 1, 1, lambda x: np.square(x - mean).sum().reshape(1, 1))[0, 0]) / n
    if not trace > 0:
        return None
    values, vectors = leading(product, dim, components)
    held = values > 1e-13 * trace  # below that a variance is rounding
    values, vectors = values[held], vectors[:, held]
    k = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = ((x - mean) @ vectors) / np.sqrt(values)
        return np.concatenate([w.T @ w, w.sum(axis=0)[None, :]])

    got = _summed(blocks, k + 1, k, moments) / n
    error = float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())
    return Whitening(n, sums, vectors, values, trace, error, passes + 3)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Per row the sum over dimensions of (n*x - S)^2, exact; None where a long can't hold it."""
    most = n * int(np.abs(x.astype(np.float64)).max(initial=0)) + max(abs(s) for s in sums)
    if most < 2**62 and x.shape[1] * most * most < 2**63:
        return np.square(n * x - np.array(sums, np.int64)).sum(axis=1).tolist()
    exact = np.square(n * x.astype(object) - np.array(sums, object)).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, dict[int, Whitening]]:
    """Rows `vec_id, dim, n, deviation, whitened` (an array of up to `components` doubles), and the fit of each width.

    An entry c counts as the long floor(256*c). The covariance is that of the distinct such vectors (divisor n, centred
    before multiplying); a row is centred, projected on the unit eigenvectors by falling eigenvalue and divided by their
    roots. Each pass over the fit list multiplies blocks inside tasks and adds matrices of dim x (components + 16) on
    the cluster; the driver holds such matrices and nothing that grows with rows.

    Rows whose vector is null, empty or holds null, NaN or infinite entries are dropped, all others returned, also
    repeated rows and rows without an id. Vectors of another width are a space of their own (64 widths at most, else a
    ValueError). Fewer components come where there is less variance than that (none at all: no element). Equal
    eigenvalues: any unit basis of their space. `deviation` is null where a long can't hold it. No other column of
    `vectors` is read; an empty table gives no rows and no fit.
    """
    blocks = fit_list(vectors, vector)
    dims = [r["dim"] for r in blocks.select("dim").distinct().limit(MAX_WIDTHS + 1).collect()]
    if len(dims) > MAX_WIDTHS:
        raise ValueError(f"vectors of more than {MAX_WIDTHS} widths")
    fits = {d: fit(blocks.where(F.col("dim") == d), d, components) for d in sorted(dims)}
    empty = {d: _sums(blocks.where(F.col("dim") == d), d) for d, f in fits.items() if f is None}
    fits = {d: f or Whitening(*empty[d], np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, 0) for d, f in fits.items()}
    discard(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in integers(batch.column(1)):
                if len(rows) == 0 or x.shape[1] not in fits:
                    continue
                f = fits[x.shape[1]]
                w = ((x - f.mean) @ f.vectors) / np.sqrt(f.values)
                whole = pa.array(np.full(len(x), f.n), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(x), x.shape[1]), pa.int32()), whole, pa.array(deviations(x, f.n, f.sums), pa.int64()), lists], ["vec_id", "dim", "n", "deviation", "whitened"])

    src = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v")).where("v is not null and size(v) > 0")
    return src.mapInArrow(run, "vec_id long, dim int, n long, deviation long, whitened array<double>"), fits


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fits = whiten(table(spark, sf_dir, "embeddings"))
    shares = [(d, i, share, f.identity_error) for d, f in fits.items() for i, share in enumerate(f.explained)]
    sides = spark.createDataFrame(shares, "d int, i int, explained double, identity_error double")
    long = rows.select("vec_id", "dim", "n", "deviation", F.posexplode("whitened").alias("pos", "whitened"))
    joined = long.join(F.broadcast(sides), (F.col("dim") == F.col("d")) & (F.col("pos") == F.col("i")))
    return joined.select("vec_id", (F.col("pos") + 1).cast("int").alias("component"), "n", "deviation", "whitened", "explained", "identity_error")
