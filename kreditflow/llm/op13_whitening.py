"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of the centred table.

Components become integers floor(1024 * c) + 100000.  Sums are exact, and every row is centred before anything is
multiplied: with mean q + r/n in integers, the centred value is (x - q) - r/n.  One step of the bidiagonalisation is
one pass over the stored rows: tasks take the product Xv of their rows, and with it its products with the earlier left
vectors, its square and its product with their transpose, Spark adds these up, and the driver, which holds vectors of
the table's width only, orthogonalises against all earlier vectors and goes on.  The left vectors, as long as the table,
are never stored: each is X times a short vector, and tasks compute them from it.  Where the table's range is exhausted
a new start orthogonal to all right vectors is taken.  Once the wanted singular triplets have residuals at the level of
rounding, TWIN_STEPS more follow from a new start, which finds equal deviations, and then or at the table's width the
steps end.  The singular value decomposition of the small bidiagonal matrix gives the components and their deviations.

Dropped are rows whose vector is null, empty, or holds null or non-finite entries or such beyond LARGEST (2^52 and the
exact integers end there); if lengths differ, those of another length than the commonest (of ties, the longest) too.
Components of no variance are left out, so a table of one row, or of equal rows, gives no rows; ``deviation`` is null
where it doesn't fit a long.  Rows without an id and repeated rows are rows each; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kreditflow.llm.common import materialize
from kreditflow.llm.vectors import embeddings, finite, id_vector, matrix

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
LARGEST = 2.0**41
#: Residual of a singular triplet, as a share of the largest singular value, that ends the steps.
RESIDUAL = 1e-14
#: What is no more than this share of the largest is no variance.
NOTHING = 1e-12
#: Steps from a new start after the first one has converged.
TWIN_STEPS = 10
STEP = 4096


def integers(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that remain: x = floor(1024 * entry) + 100000."""
    own = id_vector(rows, id_col, vec_col)
    small = F.forall("vector", lambda c: F.abs(c.cast("double")) <= LARGEST)
    kept = own.filter((F.size("vector") > 0) & finite(F.col("vector")) & small)
    return kept.select("vec_id", F.transform("vector", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET).alias("x"))


class Mean:
    """Exact means of all columns as whole parts and remainders."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.left = [s % n for s in sums]
        self.part = np.array([r / n for r in self.left])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of the squares of n * x - S for each row, exact."""
        d = x - self.whole
        most = self.n * (int(np.abs(d).max(initial=0)) + 1)
        if most * most * x.shape[1] < 2**63:
            return ((self.n * d - np.array(self.left, np.int64)) ** 2).sum(axis=1).tolist()
        out = [sum((self.n * v - r) ** 2 for v, r in zip(row, self.left, strict=True)) for row in d.tolist()]
        return [v if v < 2**63 else None for v in out]


def _centred(batches: Iterator[pa.RecordBatch], mean: Mean) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, STEP):
            part = b.slice(at, STEP)
            x = matrix(part.column("x"), np.int64)
            yield part, x, mean.centred(x)


def _column_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, s): a task's column sums in two halves of 26 bits, place 0 the rows."""
    low = high = None
    n = 0
    for b in batches:
        for at in range(0, b.num_rows, STEP):
            x = matrix(b.column(0).slice(at, STEP), np.int64)
            n += len(x)
            lo, hi = (x & (2**26 - 1)).sum(axis=0), (x >> 26).sum(axis=0)
            low, high = (lo, hi) if low is None else (low + lo, high + hi)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low) + 1, dtype=np.int32)), pa.array([n, *low.tolist()], pa.int64()), pa.array([0, *high.tolist()], pa.int64())], ["place", "low", "high"])


def _product(mean: Mean, v: np.ndarray, left: np.ndarray):
    """(place, s) of a task for u = Xv: X'u, then u's products with earlier left vectors X @ left, u's square, the table's square."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(v) + left.shape[1] + 2)
        for _, _, x in _centred(batches, mean):
            u = x @ v
            total += np.concatenate([x.T @ u, (x @ left).T @ u, [u @ u, (x * x).sum()]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "s"])

    return run


class Bidiagonal:
    """Right vectors, left vectors as X times columns of ``left``, and the bidiagonal matrix between them."""

    def __init__(self, stored: DataFrame, mean: Mean, wanted: int):
        self.stored, self.mean, self.wanted, self.width = stored, mean, wanted, len(mean.whole)
        self.right = np.empty((self.width, 0))
        self.left = np.empty((self.width, 0))
        self.back = np.empty((self.width, 0))  # X' times the left vectors
        self.matrix = np.zeros((0, 0))
        self.square = 0.0
        self.random = np.random.default_rng(13)
        self.components, self.deviations = np.empty((self.width, 0)), np.empty(0)

    def product(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """For u = Xv over all rows: X'u, u's products with the left vectors, and u's square."""
        parts = self.stored.select("x").mapInArrow(_product(self.mean, v, self.left), "place int, s double")
        got = np.zeros(self.width + self.left.shape[1] + 2)
        for place, s in parts.groupBy("place").agg(F.sum("s")).collect():  # at most twice the width
            got[place] = s
        self.square = float(got[-1])
        return got[: self.width], got[self.width : -2], float(got[-2])

    def outside(self, v: np.ndarray) -> np.ndarray:
        """What of v is orthogonal to all right vectors."""
        for _ in range(2):
            v = v - self.right @ (self.right.T @ v)
        return v

    def fresh(self) -> np.ndarray:
        v = self.outside(self.random.normal(size=self.width))
        return v / np.linalg.norm(v)

    def step(self, v: np.ndarray) -> np.ndarray | None:
        """Take right vector v in; the next one, or None if the range ends here."""
        k = self.right.shape[1]
        self.right = np.column_stack([self.right, v])
        short, (xu, dots, square) = v, self.product(v)
        # u = Xv less its parts along the earlier left vectors, all of which are X times something short
        short = short - self.left @ dots
        xu = xu - self.back @ dots
        rest = square - float(dots @ dots)
        if k and rest < 0.5 * square:  # much is gone: a second pass measures what is left
            again, more, rest = self.product(short)
            short, xu = short - self.left @ more, again - self.back @ more
            dots, rest = dots + more, rest - float(more @ more)
        grown = np.zeros((k + 1, k + 1))
        grown[:k, :k] = self.matrix
        grown[:k, k] = dots
        alpha = np.sqrt(max(rest, 0.0))
        if alpha <= NOTHING * np.sqrt(self.square):
            alpha, short, xu = 0.0, np.zeros(self.width), np.zeros(self.width)
        else:
            short, xu = short / alpha, xu / alpha
        grown[k, k] = alpha
        self.matrix = grown
        self.left, self.back = np.column_stack([self.left, short]), np.column_stack([self.back, xu])
        following = self.outside(xu)
        self.beta = float(np.linalg.norm(following))
        return following / self.beta if self.beta > NOTHING * np.sqrt(self.square) else None

    def solve(self) -> bool:
        """Singular triplets of the bidiagonal matrix; whether the wanted ones have converged."""
        p, s, q = np.linalg.svd(self.matrix)
        self.components, self.deviations = self.right @ q.T, s
        m = min(self.wanted, len(s))
        return len(s) > self.wanted and bool((self.beta * np.abs(p[-1, :m]) <= RESIDUAL * s[0]).all())

    def run(self) -> None:
        v, least = self.fresh(), None
        while True:
            after = self.step(v)
            if self.square == 0:
                return
            size, done = self.right.shape[1], self.solve()
            if size >= self.width or (done and least is not None and size >= least):
                return
            if done and least is None:
                # a new start finds what the first one had no part of: a twin of a deviation
                least, after = size + TWIN_STEPS, None
            v = self.fresh() if after is None else after


def _gram(mean: Mean, base: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = base.shape[1]
        total = np.zeros(k * k + k)
        for _, _, x in _centred(batches, mean):
            w = x @ base
            total += np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "s"])

    return run


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whiten(mean: Mean, base: np.ndarray, explained: np.ndarray, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = base.shape[1]
        names = [c.split()[0] for c in WHITENED.split(", ")]
        for part, x, c in _centred(batches, mean):
            rows, w = len(x), c @ base
            at = pa.array(np.repeat(np.arange(rows), k))
            own = pa.array(mean.deviations(x), pa.int64())
            cols = [part.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, mean.n, np.int64)), own.take(at), pa.array(w.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row that remains."""
    spark = rows.sparkSession
    stored = materialize(integers(rows, id_col, vec_col), "whitening-integers")
    lengths = stored.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    commonest = lengths.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not commonest:
        return spark.createDataFrame([], WHITENED)
    d, n = int(commonest[0]["d"]), int(commonest[0]["n"])
    stored = stored.filter(F.size("x") == d)
    halves = stored.select("x").mapInArrow(_column_sums, "place int, low long, high long").groupBy("place")
    exact = halves.agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high"))).collect()  # width + 1 rows
    sums = {r["place"]: int(r["low"]) + (int(r["high"]) << 26) for r in exact}
    mean = Mean(n, [sums[i + 1] for i in range(d)])
    basis = Bidiagonal(stored, mean, components)
    basis.run()
    value = basis.deviations**2 / n  # eigenvalues of the covariance
    kept = min(components, int((value > NOTHING * value.max(initial=0.0)).sum())) if len(value) else 0
    if not kept:
        return spark.createDataFrame([], WHITENED)
    base = basis.components[:, :kept] / np.sqrt(value[:kept])
    parts = stored.select("x").mapInArrow(_gram(mean, base), "place int, s double").groupBy("place").agg(F.sum("s")).collect()  # components^2 rows
    got = np.zeros(kept * kept + kept)
    for place, s in parts:
        got[place] = s / n
    centre = got[kept * kept :]
    error = float(np.abs(got[: kept * kept].reshape(kept, kept) - np.outer(centre, centre) - np.eye(kept)).max())
    return stored.mapInArrow(_whiten(mean, base, value[:kept] * n / basis.square, error), WHITENED)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """Eight whitened coordinates of all ``embeddings``."""
    return whiten(embeddings(spark, sf_dir))
