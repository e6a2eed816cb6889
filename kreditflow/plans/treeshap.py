"""ML-10: path-dependent tree attribution for a fitted ``GBTClassifier``.

For one tree and one leaf L with the features F_L split on along its path,
the path-dependent expectation with the features S known is

    v_L * prod_{f in F_L} (o_f(x) if f in S else z_f)

where o_f is 1 when x follows every split on f along the path and z_f is the
product of the cover fractions of those splits.  The Shapley value of this
product game for feature i in F_L is

    v_L * (o_i - z_i) * sum_k  k!(m-k-1)!/m! * e_k(others)

with e_k the coefficients of the polynomial prod (z_f + o_f t) over the other
m-1 features.  One walk down each tree keeps the polynomial of the path so far
for all rows at once: a split extends it by its factor; a split on a feature of
the path first unwinds that feature's factor; leaves below share what was built
above them.  At a leaf, each feature's factor is divided out once.  The shares of
the leaves of a small subtree depend on the outcomes of its splits and of those
above it alone, so they are worked out once for every combination of outcomes
(``tabulated``), and a row takes one table row for each subtree.  Summing over
leaves and trees (scaled by 2 * tree weight, the GBT log-odds scale) gives the
attribution of every feature; the base value is the cover-weighted mean of the
leaves.  So the result is exact and additive: base + sum(phi) = 2F(x).

The node tables are read from the saved model (small: trees x 2^depth rows), and
the tables of shares are broadcast (0.2 MB for a tree of depth 6); whole rows stream through ``mapInArrow`` as a struct and come back
with their numbers, so nothing is joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kreditflow import constants as K


@dataclass
class Node:
    """A leaf with its value, or a split: rows with x[feature] <= threshold go left, a share ``ratio`` of the cover."""

    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None
    ratio: float = 0.0


def tree_nodes(spark: SparkSession, gbt_model, scratch: str) -> tuple[list[Node], list[float]]:
    """The root of every tree, and the trees' weights."""
    gbt_model.write().overwrite().save(scratch)
    rows = spark.read.parquet(scratch + "/data").select("treeID", "nodeData.*").collect()  # trees x nodes: bounded by the model
    trees: dict[int, dict[int, Row]] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r

    def build(nodes: dict, at: int) -> Node:
        n = nodes[at]
        if n["leftChild"] < 0:
            return Node(value=n["prediction"])
        cover = float(n["rawCount"])
        ratio = float(nodes[n["leftChild"]]["rawCount"]) / cover if cover > 0 else 0.0
        return Node(0.0, n["split"]["featureIndex"], (n["split"]["leftCategoriesOrThreshold"] or [0.0])[0], build(nodes, n["leftChild"]), build(nodes, n["rightChild"]), ratio)

    # node ids are pre-order: the root has the smallest
    return [build(trees[t], min(trees[t])) for t in sorted(trees)], list(gbt_model.treeWeights)


@lru_cache(maxsize=None)
def _weights(m: int) -> np.ndarray:
    return np.array([factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)])


def _extended(poly: np.ndarray, z: float, o: np.ndarray) -> np.ndarray:
    """The polynomial (coefficient, row) times (z + o t)."""
    out = np.empty((len(poly) + 1, poly.shape[1]))
    out[:-1] = poly * z
    out[-1] = 0.0
    out[1:] += poly * o
    return out


def _unwound(poly: np.ndarray, z: float, o: np.ndarray) -> np.ndarray:
    """The polynomial divided by (z + o t), with o 0 or 1 and z > 0."""
    out = np.empty((len(poly) - 1, poly.shape[1]))
    carry = np.zeros(poly.shape[1])
    for k in range(len(out) - 1, -1, -1):  # where o is 1: from the highest coefficient down
        carry = poly[k + 1] - z * carry
        out[k] = carry
    return np.where(o > 0, out, poly[:-1] / z)


def _step(node: Node, left: bool, goes: np.ndarray, path: dict[int, tuple[float, np.ndarray]], poly: np.ndarray) -> tuple[dict[int, tuple[float, np.ndarray]], np.ndarray]:
    """Path and polynomial below one side of a split; ``goes`` is 1 for rows that go left."""
    z, o = (node.ratio, goes) if left else (1.0 - node.ratio, 1.0 - goes)
    below = {k: v for k, v in path.items() if k != node.feature}
    rest = poly
    if node.feature in path:
        before, met = path[node.feature]
        z, o = z * before, o * met
        rest = _unwound(poly, before, met) if before > 0 else reduce(lambda q, t: _extended(q, *t), below.values(), np.ones((1, poly.shape[1])))
    below[node.feature] = (z, o)
    return below, _extended(rest, z, o)


#: Height of the subtrees whose splits are tabulated together; most splits of one table.
CUT_HEIGHT, TABLE_BITS = 2, 12


@dataclass
class Cut:
    """A subtree with the splits above it: its leaves' shares depend on the outcomes of ``splits`` alone.

    ``table`` holds a row of shares (one for each of ``features``, those split on, in columns that lie together) for
    every combination of outcomes, the outcome of the i-th split in bit i; None where the splits are too many, so that
    the subtree is walked for the rows themselves.
    """

    above: list[tuple[Node, bool]]
    node: Node
    splits: list[Node]
    scale: float
    table: np.ndarray | None = None
    features: list[int] = field(default_factory=list)

    def shares(self, goes: list[np.ndarray], p: int) -> np.ndarray:
        """Shares (p x n) of the cut's leaves for n rows with these outcomes of the splits (1: left)."""
        n = len(goes[0]) if goes else 1
        phi = np.zeros((p, n))
        at = {id(s): g for s, g in zip(self.splits, goes, strict=True)}

        def walk(node: Node, path: dict[int, tuple[float, np.ndarray]], poly: np.ndarray) -> None:
            if node.left is None:
                for f, (z, o) in path.items():
                    # without cover and without o the factor is nothing, and neither is its share
                    others = _unwound(poly, z, o) if z > 0 else poly[1:]
                    phi[f] += self.scale * node.value * (o - z) * (_weights(len(path)) @ others)
                return
            for child, left in ((node.left, True), (node.right, False)):
                walk(child, *_step(node, left, at[id(node)], path, poly))

        path, poly = {}, np.ones((1, n))
        for split, left in self.above:
            path, poly = _step(split, left, at[id(split)], path, poly)
        walk(self.node, path, poly)
        return phi


def _splits(node: Node) -> list[Node]:
    return [] if node.left is None else [node, *_splits(node.left), *_splits(node.right)]


def _height(node: Node) -> int:
    return 0 if node.left is None else 1 + max(_height(node.left), _height(node.right))


def tabulated(trees: list[Node], weights: list[float], p: int) -> list[Cut]:
    """The trees cut into subtrees with their tables: made once for a model, whatever the number of rows.

    A tree of depth 6 has at most 16 tables of 128 rows."""
    cuts = []

    def cut(node: Node, above: list[tuple[Node, bool]], scale: float) -> None:
        if _height(node) > CUT_HEIGHT:
            cut(node.left, [*above, (node, True)], scale)
            cut(node.right, [*above, (node, False)], scale)
        elif above or node.left is not None:  # a lone leaf has no shares
            c = Cut(above, node, [s for s, _ in above] + _splits(node), scale)
            if len(c.splits) <= TABLE_BITS:
                outcomes = np.arange(1 << len(c.splits))
                c.features = sorted({s.feature for s in c.splits})
                shares = c.shares([(outcomes >> i & 1).astype(np.float64) for i in range(len(c.splits))], p)
                c.table = np.asfortranarray(shares[c.features].T)
            cuts.append(c)

    for root, w in zip(trees, weights, strict=True):
        cut(root, [], 2.0 * w)
    return cuts


def looked_up(x: np.ndarray, cuts: list[Cut]) -> np.ndarray:
    """Attributions (n x p) on the log-odds scale: the sum of a row of every table.

    Feature by feature, and only those that a table has; outcomes are gathered in the smallest numbers that hold them."""
    phi, found = np.zeros(x.shape[::-1]), np.empty(len(x))
    columns = np.asfortranarray(x)
    goes: dict[int, np.ndarray] = {}
    for c in cuts:
        if id(c.splits[0]) not in goes:  # the next tree
            goes = {}
        for s in c.splits:
            if id(s) not in goes:
                goes[id(s)] = (columns[:, s.feature] <= s.threshold).view(np.uint8)
        if c.table is None:
            phi += c.shares([goes[id(s)].astype(np.float64) for s in c.splits], x.shape[1])
            continue
        at = np.zeros(len(x), np.uint8 if len(c.splits) <= 8 else np.uint16)
        for i, s in enumerate(c.splits):
            at |= goes[id(s)].astype(at.dtype, copy=False) << at.dtype.type(i)
        row = at.astype(np.intp)
        for j, f in enumerate(c.features):
            phi[f] += np.take(c.table[:, j], row, out=found, mode="clip")
    return phi.T


def shap_values(x: np.ndarray, trees: list[Node], weights: list[float]) -> tuple[np.ndarray, float]:
    """Attributions (n x p) on the log-odds scale and the base value."""
    return looked_up(x, tabulated(trees, weights, x.shape[1])), base_value(trees, weights)


#: Rows of one step of a task.
STEP_ROWS = 16384


def attribute(df: DataFrame, model_cols: list[str], trees: list[Node], weights: list[float]) -> DataFrame:
    """Append ``attr`` (the narrative's input) to every row.

    Rows pass through Python as one struct; Python reads the model's columns and
    adds lists of numbers, of which Spark builds the structs.
    """
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(tabulated(trees, weights, len(model_cols)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = bc.value
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                b = batch.slice(at, STEP_ROWS)
                x = np.column_stack([b.column(1 + j).to_numpy(zero_copy_only=False) for j in range(b.num_columns - 1)]).astype(float)
                phi = looked_up(x, cuts)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(m).reshape(-1))) for m in (phi, x)]
                yield pa.RecordBatch.from_arrays([b.column(0), *lists], ["row", "phi", "x"])

    rows = df.select(F.struct("*").alias("row"), *[F.col(c).cast("double") for c in model_cols])
    numbers = T.ArrayType(T.DoubleType())
    shape = T.StructType([rows.schema["row"], T.StructField("phi", numbers), T.StructField("x", numbers)])
    got = rows.mapInArrow(run, shape)
    terms = [F.struct(F.lit(j).alias("idx"), F.lit(f).alias("feature"), F.get("phi", j).alias("shap"), F.get("x", j).alias("value")) for j, f in enumerate(K.ALL_FEATURES)]
    return got.select(*[F.col("row").getField(c).alias(c) for c in df.columns], F.array(*terms).alias("attr"))


def base_value(trees: list[Node], weights: list[float]) -> float:
    """Expected log-odds of the model (cover-weighted)."""

    def mean(node: Node) -> float:
        return node.value if node.left is None else node.ratio * mean(node.left) + (1.0 - node.ratio) * mean(node.right)

    return sum(2.0 * w * mean(root) for root, w in zip(trees, weights, strict=True))


def attribution_summary(attr: DataFrame) -> DataFrame:
    """AGG-28: mean |phi| and mean phi per feature over all rows."""
    e = attr.select(F.explode("attr").alias("a"))
    return e.groupBy(F.col("a.feature").alias("feature")).agg(
        F.avg(F.abs("a.shap")).alias("mean_abs_shap"), F.avg("a.shap").alias("mean_shap")
    )
