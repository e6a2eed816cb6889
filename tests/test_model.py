"""Tree attribution against brute-force Shapley values; model plan smoke."""
from itertools import combinations
from math import factorial

import numpy as np

from kreditflow.plans import treeshap as TS


def _value(x, S, trees, weights):
    """Expected log-odds when only the features S are known."""

    def mean(node):
        if node.left is None:
            return node.value
        if node.feature in S:
            return mean(node.left if x[node.feature] <= node.threshold else node.right)
        return node.ratio * mean(node.left) + (1 - node.ratio) * mean(node.right)

    return sum(2 * w * mean(t) for t, w in zip(trees, weights))


def brute(x, trees, weights, p):
    phi = np.zeros(p)
    for i in range(p):
        others = [j for j in range(p) if j != i]
        for k in range(p):
            for S in combinations(others, k):
                wt = factorial(k) * factorial(p - k - 1) / factorial(p)
                phi[i] += wt * (_value(x, set(S) | {i}, trees, weights) - _value(x, set(S), trees, weights))
    return phi


def brute_exact(x, trees, weights):
    """Shapley values tree by tree over the features that a tree splits on."""
    phi = np.zeros(len(x))

    def used(node):
        return set() if node.left is None else {node.feature} | used(node.left) | used(node.right)

    for t, w in zip(trees, weights):
        own = sorted(used(t))
        value = {S: _value(x, set(S), [t], [w]) for k in range(len(own) + 1) for S in combinations(own, k)}
        for S, v in value.items():
            for i in own:
                if i not in S:
                    wt = factorial(len(S)) * factorial(len(own) - len(S) - 1) / factorial(len(own))
                    phi[i] += wt * (value[tuple(sorted((*S, i)))] - v)
    return phi


def grown(rnd, depth, features):
    if depth == 0 or (depth < 3 and rnd.random() < 0.2):
        return TS.Node(value=float(rnd.normal()))
    ratio = float(rnd.choice([0.0, 1.0, rnd.random(), rnd.random(), rnd.random()]))
    return TS.Node(0.0, int(rnd.integers(features)), float(rnd.random()), grown(rnd, depth - 1, features), grown(rnd, depth - 1, features), ratio)


def test_treeshap_equals_brute_force():
    rnd = np.random.default_rng(3)
    leaf = lambda v: TS.Node(value=v)
    # two hand-built trees over 3 features, repeated feature on a path, and random ones with sides that no row covers
    t1 = TS.Node(0.0, 0, 0.5, TS.Node(0.0, 1, 0.2, leaf(1.0), leaf(-1.0), 0.3), TS.Node(0.0, 0, 0.8, leaf(0.5), leaf(2.0), 0.5), 0.6)
    t2 = TS.Node(0.0, 2, 0.1, leaf(0.3), TS.Node(0.0, 1, 0.9, leaf(-0.7), leaf(0.1), 0.5), 0.25)
    x = rnd.random((20, 3))
    for trees, weights in (([t1, t2], [1.0, 0.1]), ([leaf(0.4)], [1.0]), ([grown(rnd, 5, 3) for _ in range(6)], [1.0] + [0.1] * 5)):
        phi, base = TS.shap_values(x, trees, weights)
        assert np.isclose(base, TS.base_value(trees, weights))
        for r in range(len(x)):
            assert np.allclose(phi[r], brute(x[r], trees, weights, 3), atol=1e-10)
            assert np.isclose(phi[r].sum() + base, _value(x[r], {0, 1, 2}, trees, weights))


def test_fitted_model_attributions_calibration_and_categories(spark):
    """On a fitted GBT: attributions add up to the raw log-odds, the calibrated score rises with the raw one,
    and a category with a quote passes the preprocessor."""
    from pyspark.sql import functions as F

    from kreditflow.operators import clean as C
    from kreditflow.plans import model as M
    from kreditflow.session import scratch_path

    clean = C.clean_loans(spark, "/root/testdata/sf0.001")
    clean = clean.withColumn("home_ownership", F.when(F.col("loan_id") % 5 == 0, F.lit("OWNER'S")).otherwise(F.col("home_ownership"))).checkpoint(eager=True)
    model, _ = M.fit_stopped(clean.filter("loan_id % 4 <> 0"), clean.filter("loan_id % 4 = 0"), M.gbt(max_depth=6, max_iter=6), patience=2)
    # ids may be missing or repeated
    clean = clean.withColumn("loan_id", F.when(F.col("loan_id") % 7 > 1, F.col("loan_id")).otherwise(F.when(F.col("loan_id") % 7 == 1, F.lit(1).cast("long"))))
    scored = M.score(model, clean)
    trees, weights = TS.tree_nodes(spark, model.stages[-1], scratch_path(spark, "test_nodes"))
    got = TS.attribute(scored, M.MODEL_COLS, trees, weights).select("raw_prob", "attr.shap", "attr.feature").collect()
    base = TS.base_value(trees, weights)
    assert len(got) == clean.count()
    assert TS.attribute(scored, M.MODEL_COLS, trees, weights).drop("attr").exceptAll(scored).isEmpty()
    some = TS.attribute(scored, M.MODEL_COLS, trees, weights).select(*M.MODEL_COLS, "attr.shap").limit(3).collect()
    for r in some:
        assert np.allclose(r.shap, brute_exact(np.array(r[:-1], float), trees, weights), atol=1e-9)
    for r in got:
        assert np.isclose(base + sum(r.shap), np.log(r.raw_prob / (1 - r.raw_prob)), atol=1e-9)
    summary = TS.attribution_summary(TS.attribute(scored, M.MODEL_COLS, trees, weights)).collect()
    assert {r.feature for r in summary} == set(got[0].feature)
    importance = M.feature_importance(model).collect()
    assert np.isclose(sum(r.importance for r in importance), 1.0) and [r.importance for r in importance] == sorted((r.importance for r in importance), reverse=True)
    cal = M.calibrate(M.fit_calibration(scored), scored).select("raw_prob", "cal_prob").orderBy("raw_prob").collect()
    assert all(a.cal_prob <= b.cal_prob + 1e-12 for a, b in zip(cal, cal[1:]))
    codes = {r.home_ownership: r.f_home_ownership for r in scored.select("home_ownership", "f_home_ownership").distinct().collect()}
    assert codes["OWNER'S"] >= 0


def test_search_space_covers_the_ranges():
    from kreditflow.plans import model as M

    space = M.search_space(200)
    assert space == M.search_space(200)
    assert {s["max_depth"] for s in space} == set(range(3, 9)) and {s["min_instances"] for s in space} == set(range(1, 11))
    assert min(s["step"] for s in space) < 0.02 and max(s["step"] for s in space) > 0.25
    assert min(s["max_iter"] for s in space) >= 100 and max(s["max_iter"] for s in space) <= 500


def test_patience_rule():
    from kreditflow.plans import model as M

    dip = [1.0, 0.8, *[0.9] * 29, 0.7, *[0.75] * 29]  # no better loss for 29 rounds, then a better one
    assert M.best_round(dip, 30) == (32, False)
    assert M.best_round(dip, 29) == (2, True)
    assert M.best_round([*dip, 0.9], 30) == (32, True)
    assert M.best_round([0.5, 0.5, 0.5], 2) == (1, True)


def test_early_stopping_keeps_the_best_prefix(spark):
    """The kept model is the first trees of the whole fit, its loss is the least of the curve, and it survives saving."""
    from pyspark.sql import functions as F

    from kreditflow.operators import clean as C
    from kreditflow.plans import model as M
    from kreditflow.session import scratch_path

    clean = C.clean_loans(spark, "/root/testdata/sf0.001").checkpoint(eager=True)
    train, other = clean.filter("loan_id % 4 <> 0"), clean.filter("loan_id % 4 = 0")
    model, got = M.fit_stopped(train, other, M.gbt(max_depth=5, max_iter=40, step=0.3), patience=8)
    assert model.stages[-1].getNumTrees == got.trees == int(np.argmin(got.losses[: got.trees + 8])) + 1
    assert len(got.losses) >= min(40, got.trees + 8) and got.trees < 40
    own = M.assembled(M.fit_preprocessor(train), other, "test_other")
    assert np.isclose(model.stages[-1].evaluateEachIteration(own)[-1], got.losses[got.trees - 1])
    path = scratch_path(spark, "stopped")
    M.save(model, path)
    both = M.score(model, other).select("loan_id", "raw_prob").join(M.score(M.load(path), other).select("loan_id", F.col("raw_prob").alias("p")), "loan_id")
    assert both.filter("raw_prob <> p").isEmpty() and both.count() == other.count()
    curve = M.loss_curve(spark, got).collect()
    assert [r.trees for r in curve] == list(range(1, len(got.losses) + 1)) and sum(r.kept for r in curve) == got.trees


def test_search_goes_on_where_it_was_broken_off(spark, monkeypatch):
    from kreditflow.operators import clean as C
    from kreditflow.plans import model as M
    from kreditflow.session import scratch_path

    small = [{"max_depth": 2, "step": s, "max_iter": 5, "min_info_gain": 0.0, "subsample": 1.0, "feature_subset": "all", "min_instances": 1} for s in (0.05, 0.1, 0.2, 0.3)]
    monkeypatch.setattr(M, "search_space", lambda trials, seed=42: small[:trials])
    clean = C.clean_loans(spark, "/root/testdata/sf0.001").checkpoint(eager=True)
    train, other, runs = clean.filter("loan_id % 4 <> 0"), clean.filter("loan_id % 4 = 0"), scratch_path(spark, "runs")
    first = M.tune(train, other, runs, trials=2).runs.collect()
    boosted = []
    boost = M.boost
    monkeypatch.setattr(M, "boost", lambda *a, **k: boosted.append(1) or boost(*a, **k))
    best = M.tune(train, other, runs, trials=4)
    rows = {r.trial: r for r in best.runs.collect()}
    assert len(boosted) == 2 and sorted(rows) == [0, 1, 2, 3] and all(rows[r.trial] == r for r in first)
    assert best.validation_auc == max(r.validation_auc for r in rows.values())
    assert best.model.stages[-1].getNumTrees == best.params["max_iter"] <= 5


def test_shares_are_worked_out_once_for_a_model_not_for_its_rows(monkeypatch):
    """Rows are looked up in tables; subtrees below more splits than a table takes are walked, with the same shares."""
    rnd = np.random.default_rng(5)
    trees, weights = [grown(rnd, 6, 3) for _ in range(4)], [1.0, 0.1, 0.1, 0.1]
    chain = TS.Node(value=0.7)
    for i in range(TS.TABLE_BITS + 3):
        chain = TS.Node(0.0, i % 3, float(rnd.random()), TS.Node(value=float(rnd.normal())), chain, 0.5)
    deep = TS.tabulated([chain], [1.0], 3)
    assert any(c.table is None for c in deep) and any(c.table is not None for c in deep)
    x = rnd.random((50, 3))
    for r, got in zip(x, TS.looked_up(x, deep)):
        assert np.allclose(got, brute(r, [chain], [1.0], 3), atol=1e-10)
    cuts = TS.tabulated(trees, weights, 3)
    assert all(len(c.table) <= 128 for c in cuts)
    monkeypatch.setattr(TS, "_unwound", None)
    monkeypatch.setattr(TS, "_extended", None)
    for r, got in zip(x, TS.looked_up(x, cuts)):
        assert np.allclose(got, brute(r, trees, weights, 3), atol=1e-10)


def test_boosting_is_repeated_once_at_most_on_tasks_of_a_useful_size(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    from kreditflow.operators import clean as C
    from kreditflow.plans import model as M

    clean = C.clean_loans(spark, "/root/testdata/sf0.001").checkpoint(eager=True)
    pre = M.fit_preprocessor(clean)
    rows = M.assembled(pre, clean, "test_small", M.few_tasks(clean))
    assert rows.rdd.getNumPartitions() == 1 and rows.count() == clean.count()
    monkeypatch.setattr(M, "ROWS_A_TASK", 10)
    assert M.few_tasks(clean) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(M, "FIRST_TREES", 2)
    tried, fit = [], GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, *a: tried.append(self.getMaxIter()) or fit(self, *a))
    got = M.boost(rows, rows, M.gbt(max_depth=2, max_iter=9), patience=1)  # the loss on its own rows falls on
    assert tried == [2, 9] and len(got.losses) == 9
    # where the rule ends inside the second fit, kept trees and curve are those of fits of 2, 4 and 8 trees
    falling = [9.0, 8.0, 7.0, 6.0, 5.0, 6.0, 6.0, 6.0, 6.0]
    monkeypatch.setattr(M.GBTClassificationModel, "evaluateEachIteration", lambda self, _: falling[: self.getNumTrees])
    got = M.boost(rows, rows, M.gbt(max_depth=2, max_iter=9), patience=1)
    assert tried == [2, 9, 2, 9] and got.trees == got.model.getNumTrees == 5 and got.losses == falling[:8]
