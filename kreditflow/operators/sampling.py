"""Deterministic sampling and splits (SPL-01..06, SET-01/02, JN-02, LIM-01).

No ``rand()``: every choice is a function of the key and a salt, so retries,
lost executors and reruns reproduce the same rows.

Exact-n selection takes the n smallest (hash, key) pairs without a global
sort: a histogram of the top hash bits (at most 65,536 rows) locates the
bucket that holds the n-th row; rows of earlier buckets are kept outright and
only that single bucket is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash values of one histogram bucket: at most 65,536 buckets.
SHIFT_BUCKETS = 65536


def key_hash(key: Column, salt: int) -> Column:
    """The first 32 bits of md5('salt:key'): independent for every salt, and the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(salt)), key.cast("string"))), 1, 8), 16, 10).cast("long")


def take_smallest(df: DataFrame, n: int, key: str, salt: int) -> DataFrame:
    """The ``n`` rows with the smallest ``(key_hash(key, salt), key)``."""
    if n <= 0:
        return df.limit(0)
    h = df.withColumn("_h", key_hash(F.col(key), salt)).withColumn("_hb", (F.col("_h") / F.lit(SHIFT_BUCKETS)).cast("long"))
    counts = h.groupBy("_hb").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_hb").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        counts.withColumn("_cum", F.sum("_c").over(w))
        .filter(F.col("_cum") >= n)
        .agg(F.min_by(F.struct("_hb", (F.col("_cum") - F.col("_c")).alias("_before")), F.col("_hb")).alias("c"))
    )
    row = cut.first()
    if row is None or row["c"] is None:  # fewer than n rows: keep all
        return df
    hb, before = row["c"]["_hb"], row["c"]["_before"]
    kept = h.filter(F.col("_hb") < hb)
    edge = h.filter(F.col("_hb") == hb)
    rk = F.row_number().over(Window.partitionBy("_hb").orderBy("_h", key))
    edge = edge.withColumn("_rk", rk).filter(F.col("_rk") <= n - before).drop("_rk")
    return kept.unionByName(edge).drop("_h", "_hb")


def balanced_sample(clean: DataFrame, salt: int = 42, key: str = "loan_id") -> DataFrame:
    """SPL-01 / SET-01: all defaulters plus as many repaid rows."""
    defaulters = clean.filter(F.col("target") == 0)
    n_def = defaulters.count()
    return defaulters.unionByName(take_smallest(clean.filter(F.col("target") == 1), n_def, key, salt))


def confident_defaulters(scored: DataFrame, cutoff: float = 0.35, score: str = "prob") -> DataFrame:
    """SPL-02."""
    return scored.filter((F.col("target") == 0) & (F.col(score) < cutoff))


def training_set(clean: DataFrame, scored: DataFrame, cutoff: float = 0.35, score: str = "prob", salt: int = 4242, key: str = "loan_id") -> DataFrame:
    """SPL-02 + SPL-03 + SET-01: confident defaulters plus a matching repaid sample.

    ``scored`` carries ``key, target, score``; returns the clean rows with a
    ``side`` column (defaulter / repaid)."""
    conf = confident_defaulters(scored, cutoff, score).select(key)
    n = conf.count()
    rep = take_smallest(clean.filter(F.col("target") == 1).select(key), n, key, salt)
    side_keys = conf.withColumn("side", F.lit("defaulter")).unionByName(rep.withColumn("side", F.lit("repaid")))
    return clean.join(side_keys, key, "inner")


def stratified_split(df: DataFrame, cuts: list[tuple[str, float]], salt: int, key: str = "loan_id", strata: str = "target") -> DataFrame:
    """SPL-04/05/06: exact sizes within every class.

    Rows of a class are taken in order of (key hash, key); ``cuts`` = [(name,
    upper share), ...] cut that order at round(share * size).  A histogram of
    hash buckets per class (at most 65,536 rows each) tells on which side of
    every cut a bucket lies; only buckets that a cut runs through are ranked.
    """
    h = df.withColumn("_h", key_hash(F.col(key), salt)).withColumn("_hb", F.floor(F.col("_h") / F.lit(SHIFT_BUCKETS)))
    by = Window.partitionBy(strata)
    cum = F.sum("_c").over(by.orderBy("_hb").rowsBetween(Window.unboundedPreceding, 0))
    counts = h.groupBy(strata, "_hb").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_upto", cum).withColumn("_n", F.sum("_c").over(by)).withColumn("_before", F.col("_upto") - F.col("_c"))
    limits = [(name, F.floor(F.lit(upper) * F.col("_n") + F.lit(0.5))) for name, upper in cuts]
    cut_inside = F.lit(False)
    for _, k in limits:
        cut_inside = cut_inside | ((F.col("_before") < k) & (k < F.col("_upto")))
    placed = h.join(F.broadcast(counts.withColumn("_edge", cut_inside)), [strata, "_hb"])  # classes x 65,536 rows at most

    def label(place: Column) -> Column:
        expr = None
        for name, k in limits:
            expr = F.when(place <= k, F.lit(name)) if expr is None else expr.when(place <= k, F.lit(name))
        return expr

    inside = F.row_number().over(Window.partitionBy(strata, "_hb").orderBy("_h", key))
    whole = placed.filter(~F.col("_edge")).withColumn("split", label(F.col("_upto")))
    edge = placed.filter(F.col("_edge")).withColumn("split", label(F.col("_before") + inside))
    return whole.unionByName(edge).select(*df.columns, "split")


TRAIN_TEST = [("train", 0.80), ("test", 1.0)]
TRAIN_VAL_TEST = [("train", 0.70), ("validation", 0.85), ("test", 1.0)]
CAL_SPLIT = [("cal_train", 0.70), ("cal_test", 1.0)]


def semi_join_keys(df: DataFrame, keys: DataFrame, key: str = "loan_id") -> DataFrame:
    """JN-02: rows whose key is in ``keys``."""
    return df.join(keys.select(key), key, "left_semi")


def first_rows(df: DataFrame, n: int = 500, key: str = "loan_id") -> DataFrame:
    """LIM-01: first n rows in key order (top-k, no global sort)."""
    return df.orderBy(key).limit(n)
