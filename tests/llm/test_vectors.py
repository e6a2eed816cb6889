"""Operators on vectors against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from kreditflow.llm import op11_pivots as P
from kreditflow.llm import op12_centroids as C
from kreditflow.llm import op13_whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, node long, h long, key string, x string, w int, size int, vector string, cluster string, place int, component int, n long"
CLASH = [7, 7, 7, "x", "x", 7, 7, "x", "x", 7, 7, 7]


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def beside(rng, x, cosine):
    """A vector at a cosine from each row of x."""
    z = rng.normal(size=x.shape)
    z = unit(z - (z * x).sum(-1, keepdims=True) * x)
    return cosine * x + np.sqrt(1 - cosine**2) * z


def rows(d=64, seed=5):
    """(vec_id, vector): random ones, near copies of all sizes of group, exact copies, and every hard case."""
    rng = np.random.default_rng(seed)
    base = unit(rng.normal(size=(120, d)))
    out = [(3 * i, v) for i, v in enumerate(base)]
    hub = unit(beside(rng, np.repeat(base[:1], 70, 0), 0.985))
    out += [(1000 + i, v) for i, v in enumerate(hub)]
    chain = [base[1]]
    for _ in range(30):
        chain.append(unit(beside(rng, chain[-1], 0.97)))
    out += [(2000 + i, 3.5 * v) for i, v in enumerate(chain)]
    out += [(3000 + i, v) for i, v in enumerate(beside(rng, base[10:40], 0.975))]
    out += [(4000 + i, base[50]) for i in range(20)] + [(150, base[50]), (150, base[51]), (153, base[51])]  # copies; ids used twice
    out += [(None, base[60]), (None, base[60]), (None, unit(rng.normal(size=d))), (5000, -base[61]), (5001, 1e-30 * base[62]), (5002, 1e30 * base[62])]
    out = [(i, [float(c) for c in np.float32(v)]) for i, v in out]
    out += [(6000, None), (6001, [0.0] * d), (6002, [float("nan")] + [1.0] * (d - 1)), (6003, [float("inf")] * d), (6004, [None] + [1.0] * (d - 1)), (6000, None), (None, None)]
    out += [(6005, [1.0, 2.0]), (6006, [1.0, 2.0]), (6007, [2.0, 1.0]), (6008, []), (6009, [1.0] * (d + 1))]
    return out


def table(spark, data=None):
    return spark.createDataFrame([(i, v, *CLASH) for i, v in (rows() if data is None else data)], SCHEMA).repartition(5)


def stored(df, folder):
    df.write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def valid(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def links(data, least=0.95):
    """(vec_id, n_links, component_id, kept) by comparing all pairs; rows of one id are one node of components."""
    good = [valid(v) and any(v) for _, v in data]
    x = [P.unit(np.array([v], np.float64))[0] if g else None for (_, v), g in zip(data, good, strict=True)]
    root, n = list(range(len(data))), [0] * len(data)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if good[i] and good[j] and len(x[i]) == len(x[j]):
                near = P.cosine(x[i], x[j]) >= least
                n[i] += near
                n[j] += near
                if near or (data[i][0] is not None and data[i][0] == data[j][0]):
                    root[find(i)] = find(j)
    low = {}
    for i, (vec, _) in enumerate(data):
        low[find(i)] = min(low.get(find(i), 1 << 70), 1 << 70 if vec is None else vec)
    out = []
    for i, (vec, _) in enumerate(data):
        c = vec if not good[i] else None if low[find(i)] == 1 << 70 else low[find(i)]
        out.append((vec, n[i], c, vec == c))
    return Counter(out)


@pytest.mark.parametrize("block", [P.BLOCK, 8])
def test_links_equal_all_pairs(spark, block):
    data = rows()
    got = P.near_vectors(table(spark, data), block=block, count_block=block).collect()
    assert Counter(map(tuple, got)) == links(data)


def test_links_of_whole_tables_and_an_empty_one(spark, tmp_path):
    from pyspark.sql import functions as F

    whole = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = P.op11_pivots(spark, "/root/testdata/sf0.01").collect()
    assert Counter(map(tuple, got)) == links([tuple(r) for r in whole.select("vec_id", "embedding").collect()])
    assert P.op11_pivots(spark, stored(table(spark, []), tmp_path / "none")).collect() == []
    doubles = table(spark).withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert Counter(map(tuple, P.near_vectors(doubles).collect())) == links(rows())


def test_recall_of_isolated_pairs_near_the_threshold(spark):
    rng = np.random.default_rng(9)
    base = unit(rng.normal(size=(600, 64)))
    both = np.concatenate([base, unit(beside(rng, base, 0.952))])
    data = [(i, v.tolist()) for i, v in enumerate(both)]
    got = P.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert sum(r.n_links for r in got) >= 0.9 * 2 * 600
    assert {(r.component_id, r.vec_id) for r in got if r.n_links} <= {(i % 600, i) for i in range(1200)}


def test_threshold_ties_are_links():
    a, b = np.array([[1.0, 0.0]]), np.array([[0.95, np.sqrt(1 - 0.95**2)], [0.95 - 1e-12, np.sqrt(1 - 0.95**2)]])
    assert P.near(a, b, P.cosine(a[0], b[0])).tolist() == [[True, False]]


def clustered(data, d=64, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * np.float64(c))) for c in v]) for i, v in data if valid(v) and len(v) == d and max(map(abs, v)) <= C.LARGEST]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    points = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p, strict=True)), c) for c, p in enumerate(points))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for c in range(len(points)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == c]
            if own:
                points[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    per = Counter()
    for _, dist, c in found:
        per[c] += dist
    return Counter((i, c, dist, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()) for i, dist, c in found)


def test_clusters_equal_plain_rounds(spark, tmp_path):
    data = rows()
    assert Counter(map(tuple, C.op12_centroids(spark, stored(table(spark), tmp_path / "a")).collect())) == clustered(data)
    few = [r for r in data if r[0] in (3, 150, 6001)]  # fewer vectors than clusters, one of zeros, one id twice
    assert Counter(map(tuple, C.clusters(table(spark, few)).collect())) == clustered(few)
    assert C.op12_centroids(spark, stored(table(spark, []), tmp_path / "none")).collect() == []


def test_clusters_with_ties_and_empty_clusters(spark):
    data = [(i, [float(i % 3)] * 4) for i in range(40)] + [(None, [1.0] * 4), (50, [-131072.0, 131072.0, 0.0, 1e9])]
    got = C.clusters(spark.createDataFrame(data, "vec_id long, embedding array<double>"), dimensions=4).collect()
    assert Counter(map(tuple, got)) == clustered(data, d=4)


def test_bounds_leave_out_centroids_and_never_the_nearest():
    rng = np.random.default_rng(2)
    centres = rng.integers(-900, 900, size=(8, 64))
    x = centres[rng.integers(0, 8, 500)] + rng.integers(-60, 60, size=(500, 64))
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1].copy()
    at = C.Centroids(centres.tolist(), axes, 16)
    lead, rest = C._rotated(x, axes, 16)
    best, distance, computed = at.assign(x, lead, rest)
    plain = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (best == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()
    assert computed < 1.1 * len(x)


def check_whitened(got, x):
    """x: integer rows by vec_id, in order."""
    n, d = x.shape
    exact = [[n * int(v) - int(s) for v, s in zip(row, x.sum(axis=0), strict=True)] for row in x]
    c = np.array(exact, np.float64) / n
    value, axes = np.linalg.eigh(c.T @ c / n)
    value, axes = value[::-1], axes[:, ::-1]
    k = min(8, int((value > 1e-12 * value[0]).sum()))
    assert len(got) == n * k and {r.n for r in got} == {n}
    assert all(r.identity_error <= 1e-9 for r in got)
    w = np.array([r.whitened for r in got]).reshape(n, k)
    assert np.allclose([r.explained for r in got[:k]], value[:k] / value.sum(), rtol=1e-9)
    assert [r.deviation for r in got[::k]] == [sum(v * v for v in row) for row in exact]
    apart = np.diff(value[: k + 1] if d > k else np.append(value[:k], 0)) < -1e-6 * value[0]
    for i in range(k):  # a component is settled, but for its sign, where its deviation differs from its neighbours'
        if apart[i] and (i == 0 or apart[i - 1]):
            plain = c @ axes[:, i] / np.sqrt(value[i])
            assert min(np.abs(plain - w[:, i]).max(), np.abs(plain + w[:, i]).max()) < 1e-7


def ordered(df):
    return df.orderBy("vec_id", "component").collect()


def test_whitening_equals_direct_decomposition(spark, tmp_path):
    whole = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in r.embedding] for r in whole])
    check_whitened(ordered(W.op13_whitening(spark, "/root/testdata/sf0.01")), x)
    assert W.op13_whitening(spark, stored(table(spark, []), tmp_path / "none")).collect() == []


def test_whitening_of_hard_rows(spark):
    data = [(i, v) for i, v in rows() if not valid(v) or len(v) != 64 or max(map(abs, v)) < 1e6]
    kept = [(i, v) for i, v in data if valid(v) and len(v) == 64]
    got = W.whiten(table(spark, data)).collect()
    assert Counter(r.vec_id for r in got) == Counter({k: 8 * v for k, v in Counter(i for i, _ in kept).items()})
    numbered = [(n, v) for n, (_, v) in enumerate(kept)]
    x = np.array([[int(np.floor(1024 * np.float64(c))) + 100_000 for c in v] for _, v in numbered])
    check_whitened(ordered(W.whiten(table(spark, numbered))), x)


def test_whitening_with_few_directions_and_equal_deviations(spark):
    rng = np.random.default_rng(4)
    low = (rng.integers(-50, 50, size=(60, 3)) @ rng.integers(-3, 4, size=(3, 12))) / 1024  # rank three
    twins = np.concatenate([np.eye(12), -np.eye(12)])  # all deviations equal
    two = np.concatenate([twins, 3 * twins[[0, 1, 12, 13]], 2 * twins[[2, 14]]])  # twins above the others
    for rows_of in (low, twins, two):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows_of)], "vec_id long, embedding array<double>")
        check_whitened(ordered(W.whiten(df)), np.floor(1024 * rows_of).astype(np.int64) + 100_000)
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert W.whiten(one).collect() == [] and W.whiten(one.union(one)).collect() == []
    far = np.array([[1e9, 1.0, 5.0], [-1e9, 2.0, 4.0], [3e8, 7.0, 4.0]])  # deviations beyond a long
    got = ordered(W.whiten(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(far)], "vec_id long, embedding array<double>")))
    assert {r.deviation for r in got} == {None} and all(r.identity_error < 1e-6 for r in got)
