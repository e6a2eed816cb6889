"""Profiling of the clean table (AGG-01..10, AGG-33..35).

Every statistic is one aggregate pass (map-side partial aggregation, one
small shuffle); wide results are turned long with ``unpivot``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kreditflow.functions.numeric import pround

from kreditflow import constants as K
from kreditflow.operators.ordered import prefix_sum, range_buckets


def exact_medians(long: DataFrame) -> DataFrame:
    """(feature, median) of (feature, value) rows, exact and interpolated.

    Equal values are counted first; the counts are summed in order over range
    buckets, so the row that holds a middle rank is found without any task
    seeing all values of a feature.
    """
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_c")).checkpoint(eager=True)  # the input is read once
    ranked = prefix_sum(range_buckets(counts, ["feature"], ["value"]), ["feature"], ["value"], "_c", "_upto")
    total = counts.groupBy("feature").agg(F.sum("_c").alias("_n"))  # a row per feature
    ranked = ranked.join(F.broadcast(total), "feature")
    holds = lambda k: (F.col("_upto") - F.col("_c") <= k) & (k < F.col("_upto"))
    low, high = F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)
    got = ranked.filter(holds(low) | holds(high)).groupBy("feature").agg(F.max(F.when(holds(low), F.col("value"))).alias("a"), F.max(F.when(holds(high), F.col("value"))).alias("b"))
    return got.select("feature", (F.col("a") + (F.col("b") - F.col("a")) * 0.5).alias("median"))


def class_balance(clean: DataFrame) -> DataFrame:
    """AGG-01."""
    return clean.groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def default_rate(clean: DataFrame) -> DataFrame:
    """AGG-02."""
    return clean.agg(pround(F.avg((F.col("target") == 0).cast("int")), 6).alias("default_rate"))


def feature_mean_median(clean: DataFrame, features: list[str]) -> DataFrame:
    """AGG-03: mean and median per feature (NULL skipped), long form."""
    long = long_values(clean, features, [])
    means = long.groupBy("feature").agg(F.avg("value").alias("mean"))
    return means.join(exact_medians(long), "feature").select("feature", pround("mean", 6).alias("mean"), pround("median", 6).alias("median"))


def flag_prevalence(clean: DataFrame, flags: list[str]) -> DataFrame:
    """AGG-04."""
    wide = clean.agg(*[F.avg(f).alias(f) for f in flags])
    return wide.unpivot([], flags, "feature", "share").withColumn("share", pround("share", 6))


def missing_values(clean: DataFrame, features: list[str]) -> DataFrame:
    """AGG-05: missing count and percent per column in one pass."""
    wide = clean.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f).isNull()).alias(f) for f in features])
    long = wide.unpivot(["_n"], features, "feature", "missing_count")
    return long.select(
        "feature", "missing_count", pround(F.col("missing_count") / F.col("_n") * 100, 2).alias("missing_pct")
    )


def long_values(clean: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Feature values in long form (feature, value) with NULLs removed."""
    return (
        clean.select(*keep, *[F.col(f).cast("double").alias(f) for f in features])
        .unpivot(keep, features, "feature", "value")
        .filter(F.col("value").isNotNull())
    )


def density_histogram(clean: DataFrame, features: list[str], bins: int = 50) -> DataFrame:
    """AGG-06: per (feature, class) equal-width histogram over that class's own
    range, density = n / (N * width).  Range stats are one row per
    (feature, class), a table bounded by the feature list."""
    lv = long_values(clean, features, ["target"])
    rng = lv.groupBy("feature", "target").agg(F.min("value").alias("vmin"), F.max("value").alias("vmax"), F.count(F.lit(1)).alias("n_class"))
    same = F.col("vmin") == F.col("vmax")
    rng = rng.select(
        "feature", "target", "n_class",
        F.when(same, F.col("vmin") - 0.5).otherwise(F.col("vmin")).alias("lo"),
        F.when(same, F.col("vmax") + 0.5).otherwise(F.col("vmax")).alias("hi"),
    )
    j = lv.join(F.broadcast(rng), ["feature", "target"])
    b = F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))).cast("int")
    h = j.groupBy("feature", "target", b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.first("n_class").alias("n_class"), F.first("lo").alias("lo"), F.first("hi").alias("hi")
    )
    width = (F.col("hi") - F.col("lo")) / bins
    return h.select(
        "feature", "target", "bin", "n",
        pround(F.col("lo") + F.col("bin") * width, 6).alias("bin_start"),
        pround(F.col("n") / (F.col("n_class") * width), 6).alias("density"),
    )


def crosstab_share(clean: DataFrame, cat: str = "home_ownership") -> DataFrame:
    """AGG-07: category x target counts with row proportions (NULL category dropped)."""
    ct = clean.filter(F.col(cat).isNotNull()).groupBy(cat).pivot("target", [0, 1]).agg(F.count(F.lit(1))).na.fill(0)
    tot = F.col("0") + F.col("1")
    return ct.select(
        cat, F.col("0").alias("n_defaulted"), F.col("1").alias("n_repaid"),
        pround(F.col("0") / tot, 6).alias("share_defaulted"), pround(F.col("1") / tot, 6).alias("share_repaid"),
    )


#: A deviation of no more than this share of the mean is rounding.
NO_DEVIATION = 1e-13
MOMENTS = "i int, j int, n double, x double, y double, xx double, yy double, xy double"


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts, means and centred squares and products of two sets of rows together."""
    n = a[0] + b[0]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    dx, dy, w = b[1] - a[1], b[2] - a[2], a[0] * share
    return np.stack([n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w, a[5] + b[5] + dx * dy * w])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairwise-complete counts, means and centred squares and products of a task's columns: a row for each pair."""
    total = None
    for b in batches:
        v = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(np.float64)
        here = ~np.isnan(v)
        m = here.astype(np.float64)
        middle = np.where(here, v, 0.0).sum(axis=0) / np.maximum(m.sum(axis=0), 1)
        x = np.where(here, v - middle, 0.0)
        n, sx, sy = m.T @ m, x.T @ m, m.T @ x
        dx, dy = sx / np.maximum(n, 1), sy / np.maximum(n, 1)
        own = np.stack([n, middle[:, None] + dx, middle[None, :] + dy, (x * x).T @ m - n * dx * dx, m.T @ (x * x) - n * dy * dy, x.T @ x - n * dx * dy])
        total = own if total is None else _merged(total, own)
    if total is not None:
        i, j = np.triu_indices(total.shape[1])
        cols = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(total[k, i, j]) for k in range(6))]
        yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in MOMENTS.split(", ")])


def correlation_matrix(clean: DataFrame, cols: list[str]) -> DataFrame:
    """AGG-08: pairwise-complete Pearson correlations in one scan.

    A task turns its rows into one small matrix of centred moments for all
    pairs of columns; Spark puts these together, first the means, then the
    squares and products about them.
    """
    parts = clean.select(*[F.col(c).cast("double") for c in cols]).mapInArrow(_moments, MOMENTS).checkpoint(eager=True)  # a row for each pair and task
    whole = parts.groupBy("i", "j").agg(F.sum("n").alias("total"), F.try_divide(F.sum(F.col("n") * F.col("x")), F.sum("n")).alias("mx"), F.try_divide(F.sum(F.col("n") * F.col("y")), F.sum("n")).alias("my"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    got = parts.filter("n > 0").join(F.broadcast(whole.filter("total > 1")), ["i", "j"]).groupBy("i", "j").agg(
        F.first("total").alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"),
        F.sum(F.col("xx") + F.col("n") * dx * dx).alias("xx"), F.sum(F.col("yy") + F.col("n") * dy * dy).alias("yy"), F.sum(F.col("xy") + F.col("n") * dx * dy).alias("xy"))
    varies = lambda sq, mean: F.col(sq) > F.col("n") * F.pow(F.col(mean) * NO_DEVIATION, 2)
    r = F.when(varies("xx", "mx") & varies("yy", "my"), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    got = whole.select("i", "j").join(got.select("i", "j", r.alias("r")), ["i", "j"], "left")
    names = F.array(*[F.lit(c) for c in cols])
    both = F.array(F.struct("i", "j"), F.when(F.col("i") != F.col("j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    out = got.select(pround(F.when(F.col("r").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "r"))), 6).alias("corr"), F.explode(F.array_compact(both)).alias("p"))
    return out.select(F.get(names, F.col("p.i")).alias("f1"), F.get(names, F.col("p.j")).alias("f2"), "corr")


def class_means(clean: DataFrame, features: list[str]) -> DataFrame:
    """AGG-09: means per class, transposed to one row per feature."""
    g = clean.groupBy("target").agg(*[F.avg(f).alias(f) for f in features])
    long = g.unpivot(["target"], features, "feature", "mean")
    return long.groupBy("feature").pivot("target", [0, 1]).agg(F.first("mean")).select(
        "feature", pround(F.col("0"), 6).alias("mean_defaulted"), pround(F.col("1"), 6).alias("mean_repaid")
    )


def grade_counts(raw_known: DataFrame) -> DataFrame:
    """AGG-10."""
    return raw_known.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).orderBy("grade")


def medians(clean: DataFrame, features: list[str]) -> DataFrame:
    """AGG-33: median of every numeric feature; NULL for one without values."""
    names = clean.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return names.join(exact_medians(long_values(clean, features, [])), "feature", "left")


def most_frequent(clean: DataFrame, cat: str = "home_ownership") -> DataFrame:
    """AGG-34: modal category, ties to the smallest value (NULL ignored)."""
    c = clean.filter(F.col(cat).isNotNull()).groupBy(cat).agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.desc("n"), F.asc(cat)).limit(1)


def row_counts(raw: DataFrame) -> DataFrame:
    """AGG-35: raw, known-outcome and class sizes in one aggregate."""
    known = F.col("loan_status").isin(*K.KNOWN_STATUSES)
    return raw.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(known).alias("known_rows"),
        F.count_if(F.col("loan_status") == K.REPAID_STATUS).alias("repaid"),
        F.count_if(known & (F.col("loan_status") != K.REPAID_STATUS)).alias("defaulted"),
    )
