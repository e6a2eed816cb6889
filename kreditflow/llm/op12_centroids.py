"""Centroid clustering of integer vectors, with bounds in PCA-rotated coordinates.

Components become integers floor(1024 * x).  An orthogonal rotation from the principal axes of all vectors is applied
once to every vector, of which the LEADING coordinates and the norm of the others are stored beside the integers.  The
squared distance of the leading coordinates plus the squared difference of the two norms is at most the squared
distance.  So an assignment computes the exact integer distance to the centroid with the least bound, and then only to
the centroids whose bound does not exceed it (by more than rounding); ties go to the smaller number.  The rotation is
in floating point and decides nothing: a bound counts only beyond a slack that covers its rounding.

Each round is one pass over the stored vectors: tasks add up counts and integer sums of their vectors for each cluster,
Spark adds these up in decimals, and the driver gets one number for each cluster and dimension and takes floors of
exact quotients.  Empty clusters keep their centroid.

Kept are vectors with exactly DIMENSIONS components, none null or non-finite and none above LARGEST in magnitude, so
that every squared distance fits a long.  Rows without an id are hashed as if it were the empty text; repeated rows and
ids are vectors each; of equal hashes the smaller vector is first; with fewer vectors than clusters there are as many
clusters as vectors; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kreditflow.llm.common import materialize
from kreditflow.llm.vectors import embeddings, finite, id_vector, matrix

DIMENSIONS, SCALE = 64, 1024
CLUSTERS, ROUNDS, SEED = 8, 10, "3"
LEADING = 16
#: 64 squares of differences of two integers of 2^27 at most are 2^62 at most.
LARGEST = 2.0**27 / SCALE
#: Relative rounding of a bound, in units of the squared norms; far above what 64 products in double precision lose.
SLACK = 1e-9
#: Rows of one step.
STEP = 4096


def integers(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, x) of the vectors that are kept: x = floor(1024 * component)."""
    own = id_vector(rows, id_col, vec_col)
    small = F.forall("vector", lambda c: F.abs(c.cast("double")) <= LARGEST)
    kept = own.filter((F.size("vector") == dimensions) & finite(F.col("vector")) & small)
    return kept.select("vec_id", F.transform("vector", lambda c: F.floor(c.cast("double") * SCALE).cast("int")).alias("x"))


# ---------------------------------------------------------------- rotation
def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        if b.num_rows:
            x = matrix(b.column(0))
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            total = x.T @ x + (0 if total is None else total)
    if total is not None:
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])


def rotation(ints: DataFrame, dimensions: int) -> np.ndarray:
    """Orthogonal matrix whose columns are the principal axes of all vectors, largest variance first."""
    out = np.zeros((dimensions + 1, dimensions + 1))
    for i, j, v in ints.select("x").mapInArrow(_moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():  # (dimensions + 1)^2 rows
        out[i, j] = v
    n = max(out[0, 0], 1)
    mean = out[0, 1:] / n
    return np.linalg.eigh(out[1:, 1:] / n - np.outer(mean, mean))[1][:, ::-1].copy()


def _rotated(x: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    y = x.astype(np.float64) @ axes
    return y[:, :leading], np.sqrt((y[:, leading:] ** 2).sum(axis=1))


STORED = "vec_id long, x array<int>, lead array<double>, rest double"


def _store(axes: np.ndarray, leading: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, STEP):
                part = b.slice(at, STEP)
                lead, rest = _rotated(matrix(part.column(1), np.int64), axes, leading)
                ends = np.arange(len(lead) + 1, dtype=np.int32) * lead.shape[1]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(lead.ravel())), pa.array(rest)], ["vec_id", "x", "lead", "rest"])

    return run


# ---------------------------------------------------------------- assignment
class Centroids:
    def __init__(self, points: list[list[int]], axes: np.ndarray, leading: int):
        self.points = np.array(points, np.int64).reshape(len(points), len(axes))
        self.lead, self.rest = _rotated(self.points, axes, leading)
        self.squares = (self.points.astype(np.float64) ** 2).sum(axis=1)

    def assign(self, x: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid of each row, the squared distance, and how many distances were computed."""
        bound = ((lead**2).sum(axis=1)[:, None] + (self.lead**2).sum(axis=1) - 2 * (lead @ self.lead.T)) + (rest[:, None] - self.rest) ** 2
        bound -= SLACK * ((x.astype(np.float64) ** 2).sum(axis=1)[:, None] + self.squares + 1)
        best = bound.argmin(axis=1)
        distance = ((x - self.points[best]) ** 2).sum(axis=1)
        first, computed = best.copy(), len(x)
        for c in range(len(self.points)):
            at = np.flatnonzero((bound[:, c] <= distance) & (first != c))
            d = ((x[at] - self.points[c]) ** 2).sum(axis=1)
            computed += len(at)
            closer = (d < distance[at]) | ((d == distance[at]) & (c < best[at]))
            best[at[closer]], distance[at[closer]] = c, d[closer]
        return best, distance, computed


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, STEP):
            part = b.slice(at, STEP)
            x = matrix(part.column("x"), np.int64)
            yield part, x, matrix(part.column("lead")), part.column("rest").to_numpy()


def _sums(centroids: Centroids):
    """(cluster, place, s) of a task: sums of its vectors; place -1 counts them, place -2 the computed distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = centroids.points.shape
        total = np.zeros((k, d + 2), np.int64)
        for _, x, lead, rest in _steps(batches):
            best, _, computed = centroids.assign(x, lead, rest)
            for c in range(k):
                own = x[best == c]
                total[c, :d] += own.sum(axis=0)
                total[c, d] += len(own)
            total[0, d + 1] += computed
        cluster, place = np.indices(total.shape)
        place[:, d], place[:, d + 1] = -1, -2
        yield pa.RecordBatch.from_arrays([pa.array(cluster.ravel(), pa.int32()), pa.array(place.ravel(), pa.int32()), pa.array(total.ravel())], ["cluster", "place", "s"])

    return run


ASSIGNED = "vec_id long, cluster int, distance long"


def _assigned(centroids: Centroids):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, lead, rest in _steps(batches):
            best, distance, _ = centroids.assign(x, lead, rest)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(best, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def clusters(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, dimensions: int = DIMENSIONS, leading: int = LEADING) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept."""
    spark = rows.sparkSession
    ints = materialize(integers(rows, id_col, vec_col, dimensions), "centroid-integers")
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    points = [list(r["x"]) for r in ints.select(F.sha2(text, 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()]
    if not points:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    axes = rotation(ints, dimensions)
    leading = min(leading, dimensions)
    stored = materialize(ints.mapInArrow(_store(axes, leading), STORED), "centroid-vectors")
    for _ in range(rounds):
        sums = stored.mapInArrow(_sums(Centroids(points, axes, leading)), "cluster int, place int, s long")
        exact = sums.groupBy("cluster", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        found = {(r["cluster"], r["place"]): int(r["s"]) for r in exact.collect()}  # clusters x (dimensions + 2) rows
        points = [[found[c, i] // found[c, -1] for i in range(dimensions)] if found.get((c, -1)) else p for c, p in enumerate(points)]
    assigned = materialize(stored.mapInArrow(_assigned(Centroids(points, axes, leading)), ASSIGNED), "centroid-assigned")
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(inertia.values())
    sha = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    fits = lambda v: v if v < 2**63 else None  # noqa: E731  (a sum beyond a long is null)
    table = [(c, fits(v), fits(total), sha[c]) for c, v in inertia.items()]
    kinds = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    return assigned.join(F.broadcast(spark.createDataFrame(table, kinds)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    """Eight clusters of all ``embeddings`` after ten rounds."""
    return clusters(embeddings(spark, sf_dir))
