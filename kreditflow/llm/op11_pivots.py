"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its nearest reference points (pivots) in order, NEAREST of them.  Two vectors with a cosine
of 0.95 have most of these in common, unrelated ones hardly any; candidates are the pairs that share SHARED pivots.
Inverted lists hold them: if two sets of NEAREST pivots share SHARED, then in any fixed order of the pivots the first
NEAREST - SHARED + 2 of each share two, so a vector stands in the lists of all pairs of these (the pivots that are rare
in the sample come first, which keeps lists short), and the pivots that two members of a list share are counted there.
Members without a partner in a list leave it; the vectors of the others are joined to them and compared in double
precision, a list in blocks of at most BLOCK rows.  A task writes a spanning forest of the links it finds, never pairs.
Blocks of a long list are compared with each other only as far as the components found so far differ.  At last all
vectors of a component are compared with each other, in pairs of blocks of COUNT_BLOCK, and every link is counted; so a link can be
missed only between components that no retrieved link joins.

Pivots are fitted on at most SAMPLE distinct vectors of the table, in order of their hash, each at a cosine under
APART to all before it, and filled up with seeded random directions; their number is about twice the square root of
the number of distinct vectors, within PIVOTS.  All vectors are indexed.  Equal vectors are one class, which is
indexed once and counts with its rows.

A null or zero vector, or one with null or non-finite components, is linked with nothing, as are vectors of different
lengths; rows without an id take part, and component_id is null where no member has one; rows with one id are one
component if their vectors are valid; repeated rows are rows each; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kreditflow.llm.common import materialize
from kreditflow.llm.components import components
from kreditflow.llm.vectors import embeddings, finite, id_vector, matrix, runs

COSINE = 0.95
NEAREST, SHARED = 9, 4
PIVOTS = (64, 4096)
SAMPLE, SAMPLE_BYTES, APART = 16_384, 32 << 20, 0.7
BLOCK, COUNT_BLOCK = 1024, 256
#: Products nearer to the threshold than this are computed again in a fixed order.
CLOSE = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; no overflow on the way."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """Cosine of two rows of length one, summed exactly."""
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def near(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of a have which rows of b at the cosine or above; both of length one."""
    c = a @ b.T
    out = c >= least
    for i, j in zip(*np.nonzero(np.abs(c - least) < CLOSE), strict=True):
        out[i, j] = cosine(a[i], b[j]) >= least
    return out


def forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric matrix of links."""
    left = np.ones(len(linked), bool)
    for s in range(len(linked)):
        stack = [s] if left[s] else []
        left[s] = False
        while stack:
            u = stack.pop()
            found = np.flatnonzero(linked[u] & left)
            left[found] = False
            for v in found.tolist():
                yield u, v
            stack += found.tolist()


class Pivots:
    """Reference points of every length of vector: chosen ones, then random directions up to the number."""

    def __init__(self, number: int, chosen: dict[int, np.ndarray], order: dict[int, np.ndarray]):
        self.number, self.chosen, self.order = number, chosen, order
        self._all: dict[int, np.ndarray] = {}

    def of(self, length: int) -> np.ndarray:
        if length not in self._all:
            if len(self._all) > 8:
                self._all.clear()
            own = self.chosen.get(length, np.empty((0, length)))
            more = np.random.default_rng(length).normal(size=(self.number - len(own), length))
            self._all[length] = np.concatenate([own, unit(more)]) if len(more) else own
        return self._all[length]

    def rank(self, length: int) -> np.ndarray:
        """Place of each pivot in the order of the lists."""
        return self.order.get(length, np.arange(self.number))


def nearest(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k nearest pivots of rows of length one, in order."""
    c = x @ pivots.T
    k = min(k, len(pivots))
    top = np.argpartition(-c, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(c, top, 1), axis=1, kind="stable"), 1)


def fit(classes: DataFrame, n: int, k: int) -> Pivots:
    """Pivots from a bounded sample of the distinct vectors."""
    number = int(min(PIVOTS[1], max(PIVOTS[0], 2 ** math.ceil(math.log2(2 * math.sqrt(max(1, n)))))))
    rare = classes.filter(F.pmod("h", F.lit(1 << 20)) <= F.lit(min(1 << 20, math.ceil(4 * SAMPLE / max(1, n) * (1 << 20)))))
    sample = rare.select("vector").orderBy("h", "g").limit(SAMPLE).toLocalIterator()
    groups: dict[int, list] = {}
    held = 0
    for (v,) in sample:
        held += 8 * len(v)
        if held > SAMPLE_BYTES:
            break
        groups.setdefault(len(v), []).append(v)
    chosen, order = {}, {}
    for length, rows in groups.items():
        x = unit(np.array(rows, np.float64))
        own = np.empty((number, length))
        size = 0
        for row in x:
            if size < number and (not size or (own[:size] @ row).max() < APART):
                own[size] = row
                size += 1
        chosen[length] = own[:size].copy()
        p = Pivots(number, chosen, {}).of(length)
        often = np.bincount(nearest(x, p, k).ravel(), minlength=number)
        order[length] = np.argsort(np.argsort(often, kind="stable"))
    return Pivots(number, chosen, order)


POSTED = "key long, node long, nearest binary"


def _post(shared, k: int, m: int):
    pairs = np.array(list(combinations(range(max(2, k - m + 2)), 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for b in batches:
            sizes = np.diff(b.column(1).offsets.to_numpy())
            for length in np.unique(sizes).tolist():
                part = b.take(pa.array(np.flatnonzero(sizes == length)))
                for at in range(0, part.num_rows, 2000):
                    some = part.slice(at, 2000)
                    top = nearest(unit(matrix(some.column(1))), pivots.of(length), k).astype(np.int64)
                    rank = pivots.rank(length)[top]
                    listed = np.take_along_axis(top, np.argsort(rank, axis=1), 1)
                    own = pairs[pairs[:, 1] < top.shape[1]]
                    keys = (length << 32) + (listed[:, own[:, 0]] << 16) + listed[:, own[:, 1]]
                    text = pa.array([row.tobytes() for row in top.astype(np.uint16)], pa.binary())
                    at_row = np.repeat(np.arange(len(top)), len(own))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), some.column(0).take(pa.array(at_row)), text.take(pa.array(at_row))], ["key", "node", "nearest"])

    return run


def shared_pivots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many pivots each row of a shares with each row of b."""
    values, at = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
    marks = np.zeros((len(a) + len(b), len(values)), np.float32)
    marks[np.repeat(np.arange(len(marks)), a.shape[1]), at.ravel()] = 1
    return marks[: len(a)] @ marks[len(a) :].T


def _partnered(m: int):
    """Members of a list (key, sub, whole, node, nearest) that share m pivots with another one there; all of a part of a longer list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, subs, nodes, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (keys, subs, nodes)], ["key", "sub", "node"])

        for t in runs(batches, 2):
            if t.num_rows < 2:
                continue
            own = t.column("node").to_numpy()
            if t.column("whole")[0].as_py():
                top = np.frombuffer(b"".join(t.column("nearest").to_pylist()), np.uint16).reshape(len(own), -1)
                if len(top) == 2:
                    met = np.full(2, len(set(top[0].tolist()) & set(top[1].tolist())) >= m)
                else:
                    common = shared_pivots(top, top)
                    np.fill_diagonal(common, 0)
                    met = (common >= m).any(axis=1)
                own = own[met]
            if len(own):
                keys.append(t.column("key").to_numpy()[: len(own)])
                subs.append(t.column("sub").to_numpy()[: len(own)])
                nodes.append(own)
                held += len(own)
            if held > 50_000:
                yield out()
                keys, subs, nodes, held = [], [], [], 0
        if held:
            yield out()

    return run


def _link_batches(found: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for x, y in found:
        a.append(x)
        b.append(y)
        if len(a) >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _verify(least: float):
    """Links (a, b) that span what is linked among the rows (key, sub, node, vector) of one part of a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, int]]:
            for t in runs(batches, 2):
                x, nodes = unit(matrix(t.column("vector"))), t.column("node").to_numpy()
                for u, v in forest(near(x, x, least)):
                    yield nodes[u], nodes[v]

        yield from _link_batches(found())

    return run


def _verify_across(least: float):
    """Links between the rows (key, i, j, side, label, node, vector) of side 0 and of side 1 whose labels differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, int]]:
            for t in runs(batches, 3):
                x, nodes, label = unit(matrix(t.column("vector"))), t.column("node").to_numpy(), t.column("label").to_numpy()
                side = t.column("side").to_numpy()
                p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                linked = np.zeros((len(x), len(x)), bool)
                linked[np.ix_(p, q)] = near(x[p], x[q], least) & (label[p][:, None] != label[q][None, :])
                for u, v in forest(linked | linked.T):
                    yield nodes[u], nodes[v]

        yield from _link_batches(found())

    return run


def _count(least: float):
    """(node, n): linked rows, by weight, of the rows (label, i, j, own, node, w, vector) of two blocks of a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            x, nodes, w = unit(matrix(t.column("vector"))), t.column("node").to_numpy(), t.column("w").to_numpy()
            own, i, j = t.column("own").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
            n = np.zeros(len(x), np.int64)
            p, q = np.flatnonzero(own == i), np.flatnonzero(own == j)
            linked = near(x[p], x[q], least)
            if i == j:
                np.fill_diagonal(linked, False)
                n[p] = linked @ w[q]
            else:
                n[p], n[q] = linked @ w[q], linked.T @ w[p]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(n)], ["node", "n"])

    return run


def _grouped(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows with equal keys one after the other in one task."""
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _across(lists: DataFrame, labels: DataFrame, vectors: DataFrame, block: int) -> DataFrame:
    """Rows of lists of several parts, dealt to (key, i, j): the members outside the list's largest component against all."""
    own = lists.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    own = materialize(own, "pivot-long")
    counted = own.groupBy("key", "label").agg(F.count("*").alias("c"))
    largest = counted.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("size"))
    mixed = largest.filter("top.c < size").select("key", "size", F.col("top.label").alias("major"), F.ceil((F.col("size") - F.col("top.c")) / block).alias("mb"))
    rows = own.join(materialize(mixed, "pivot-mixed"), "key").join(vectors, "node")
    every = F.ceil(F.col("size") / block)
    at, zero = F.xxhash64("node"), F.lit(0).cast("long")
    cols = [F.col(c) for c in ("label", "node", "vector")]
    minor = rows.filter("label <> major").select("key", F.pmod(at, "mb").alias("i"), F.explode(F.sequence(zero, every - 1)).alias("j"), F.lit(0).alias("side"), *cols)
    major = rows.select("key", F.explode(F.sequence(zero, F.col("mb") - 1)).alias("i"), F.pmod(at, every).alias("j"), F.lit(1).alias("side"), *cols)
    return _grouped(minor.union(major), "key", "i", "j")


def index(classes: DataFrame, n: int, nearest_pivots: int, shared: int) -> DataFrame:
    """The inverted lists (key, node, nearest) of all distinct vectors."""
    pivots = classes.sparkSession.sparkContext.broadcast(fit(classes, n, nearest_pivots))
    return classes.select("node", "vector").mapInArrow(_post(pivots, nearest_pivots, shared), POSTED)


def linked_nodes(classes: DataFrame, n: int, least: float, nearest_pivots: int, shared: int, block: int, same: DataFrame) -> DataFrame:
    """(node, label) of all nodes that links, or the links ``same``, join."""
    vectors = classes.select("node", "vector")
    posted = materialize(index(classes, n, nearest_pivots, shared), "pivot-posted")
    sizes = materialize(posted.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "pivot-sizes")
    parts = F.ceil(F.col("size") / block)
    lists = posted.join(sizes, "key")
    dealt = lists.select("key", F.pmod(F.xxhash64("node", "key"), parts).alias("sub"), (parts == 1).alias("whole"), "node", "nearest")
    met = materialize(_grouped(dealt, "key", "sub").mapInArrow(_partnered(shared), "key long, sub long, node long"), "pivot-met")
    rows = met.join(vectors, "node").select("key", "sub", "node", "vector")
    links = materialize(_grouped(rows, "key", "sub").mapInArrow(_verify(least), "a long, b long").union(same).distinct(), "pivot-links")
    labels = materialize(components(links, "pivot-components"), "pivot-labels")
    long = sizes.filter(F.col("size") > block)
    if not long.isEmpty():
        rows = _across(posted.join(long, "key"), labels, vectors, block)
        more = materialize(rows.mapInArrow(_verify_across(least), "a long, b long").distinct(), "pivot-more")
        labels = materialize(components(links.union(more), "pivot-components"), "pivot-labels")
    return labels


def link_counts(classes: DataFrame, labels: DataFrame, least: float, block: int) -> DataFrame:
    """(node, n): rows of other classes linked with each node of a component."""
    sizes = materialize(labels.groupBy("label").agg(F.count("*").alias("size")), "pivot-component-sizes")
    rows = labels.join(sizes, "label").join(classes.select("node", "w", "vector"), "node")
    blocks = F.ceil(F.col("size") / block)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks))
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other")
    rows = rows.select("label", "own", "node", "w", "vector", other)
    rows = rows.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "w", "vector")
    counted = _grouped(rows, "label", "i", "j").mapInArrow(_count(least), "node long, n long")
    return counted.groupBy("node").agg(F.sum("n").alias("n"))


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, nearest_pivots: int = NEAREST, shared: int = SHARED, block: int = BLOCK, count_block: int = COUNT_BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    own = id_vector(rows, id_col, vec_col)
    valid = finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    own = own.select("vec_id", F.when(valid, F.col("vector")).alias("vector"))
    h, g = F.xxhash64("vector"), F.xxhash64(F.lit("class"), "vector")
    hashed = own.filter("vector IS NOT NULL").select("vec_id", "vector", h.alias("h"), g.alias("g"))
    classes = hashed.groupBy("h", "g").agg(F.first("vector").alias("vector"), F.min("vec_id").alias("first_id"), F.count("*").alias("w"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "pivot-classes")
    key = F.when(F.col("vector").isNotNull(), h)
    named = own.select("vec_id", key.alias("h"), F.when(F.col("vector").isNotNull(), g).alias("g"))
    named = materialize(named.join(classes.select("h", "g", "node"), ["h", "g"], "left").select("vec_id", "node"), "pivot-rows")
    shares = named.filter("vec_id IS NOT NULL AND node IS NOT NULL").groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z")
    same = named.join(shares.select("vec_id", "a"), "vec_id").filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    labels = linked_nodes(classes, classes.count(), cosine, nearest_pivots, shared, block, same)
    first = labels.join(classes.select("node", "first_id"), "node").groupBy("label").agg(F.min("first_id").alias("first"))
    joined = labels.join(materialize(first, "pivot-firsts"), "label").select("node", "first")
    counts = link_counts(classes, labels, cosine, count_block)
    of_node = classes.select("node", "first_id", "w").join(joined, "node", "left").join(counts, "node", "left")
    of_node = materialize(of_node.select("node", F.coalesce("first", "first_id").alias("first"), (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n")), "pivot-nodes")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("first"))
    out = named.join(of_node, "node", "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op11_pivots(spark, sf_dir: str) -> DataFrame:
    """Links of all ``embeddings`` at a cosine of 0.95 or more."""
    return near_vectors(embeddings(spark, sf_dir))
