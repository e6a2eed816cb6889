"""Helpers of the operators on vectors: clean arrays, matrices of Arrow columns, runs of sorted rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")


def id_vector(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vector) only; single precision stays, anything else is double."""
    kind = rows.schema[vec_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("vector"))


def finite(vector: Column) -> Column:
    """True for a vector without null or non-finite components, false for all others and for null."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """Rows of a list column of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(n, -1 if n else 0)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of the rows that agree in the first ``keys`` columns; the rows come sorted by these."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        new = np.zeros(t.num_rows, bool)
        for k in range(keys):
            x = t.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        for a, z in zip(cuts, cuts[1:], strict=False):
            yield t.slice(a, z - a)
        held = t.slice(cuts[-1])
    if held is not None:
        yield held
