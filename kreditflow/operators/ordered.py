"""Ordered prefix sums that stay parallel when one group is hot.

A window ``partitionBy(group).orderBy(...)`` puts a whole group into one task;
if one group holds a third of all rows that task is the job.  Instead the rows
are range-partitioned on ``(group, order...)`` (Spark samples the key
distribution, so a hot group spans many ranges), the range index becomes a
bucket that is monotone in the order, and a prefix sum is

    offset of the bucket (sum of earlier buckets of the group, a tiny table)
  + running sum inside the bucket (window over one bounded range).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"


def range_buckets(df: DataFrame, group_cols: list[str], order_cols: list[str], num_buckets: int | None = None) -> DataFrame:
    """Tag rows with a bucket index monotone in ``(group, order)``.

    The result is checkpointed to the shared checkpoint folder so the bucket
    ids are fixed for every later use (and lineage is cut).
    """
    spark = df.sparkSession
    n = num_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = df.repartitionByRange(n, *[F.col(c) for c in group_cols + order_cols]).withColumn(
        BUCKET, F.spark_partition_id()
    )
    return tagged.checkpoint(eager=True)


def bucket_offsets(df: DataFrame, group_cols: list[str], value_col: str, out_col: str) -> DataFrame:
    """Sum of ``value_col`` in all earlier buckets of the group.

    The input of the window is one row per (group, bucket): bounded by the
    bucket count, never by the data.
    """
    totals = df.groupBy(*group_cols, BUCKET).agg(F.sum(value_col).alias("_bt"))
    w = Window.partitionBy(*group_cols).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*group_cols, BUCKET, F.coalesce(F.sum("_bt").over(w), F.lit(0)).alias(out_col))


def prefix_sum(df: DataFrame, group_cols: list[str], order_cols: list[str], value_col: str, out_col: str) -> DataFrame:
    """Inclusive running sum of ``value_col`` per group in order; needs ``_bucket``."""
    off = bucket_offsets(df, group_cols, value_col, "_off")
    w = Window.partitionBy(*group_cols, BUCKET).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.join(off, on=group_cols + [BUCKET], how="left")
        .withColumn(out_col, F.coalesce(F.col("_off"), F.lit(0)) + F.sum(value_col).over(w))
        .drop("_off")
    )
