import numpy as np
import pytest

from evalkiln.checks import CampaignValidation
from evalkiln.operators import domain, gram


def frame(spark, n=200, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) + np.array([5.0, -2.0, 0.0])
    t = (np.arange(n) % 4 == 0).astype(int)
    x[t == 1] += [1.0, 0.5, 0.0]
    rows = [(i, i % 5, [float(v) for v in x[i]], float(i), int(t[i])) for i in range(n)]
    return x, t, spark.createDataFrame(rows, "i int, fold int, x array<double>, y double, is_test int").repartition(3)


def test_leverage_equals_the_hat_matrix(spark):
    x, _, df = frame(spark)
    own = np.arange(200) % 5 != 2
    design = np.column_stack((np.ones(own.sum()), x[own]))
    inverse = np.linalg.inv(design.T @ design)
    got = {r.i: r.leverage for r in domain.leverage(df, gram.fold_moments(df, "x", ["y"]).train(2)).collect()}
    for i in range(200):
        z = np.append(1.0, x[i])
        assert got[i].score == pytest.approx(z @ inverse @ z) and got[i].threshold == pytest.approx(12 / own.sum()) and got[i].supported == (got[i].score <= got[i].threshold)


def test_leverage_off_the_plane_and_unknown(spark):
    flat = spark.createDataFrame([(0, [float(i), 3.0], 0.0) for i in range(10)], "fold int, x array<double>, y double")
    train = gram.fold_moments(flat, "x", ["y"]).train()
    rows = spark.createDataFrame([(0, [4.0, 3.0]), (1, [4.0, 3.5]), (2, [None, 3.0]), (3, None), (4, [1.0]), (5, [float("nan"), 3.0])], "i int, x array<double>")
    got = {r.i: (r.leverage.score, r.leverage.supported) for r in domain.leverage(rows, train).collect()}
    assert got[0][1] is True and got[1] == (float("inf"), False) and all(got[i] == (None, None) for i in (2, 3, 4, 5))


def test_density_ratio_equals_direct_newton_and_is_cross_fitted(spark):
    x, t, df = frame(spark)
    moments = gram.fold_moments(df, "x", ["y"])
    models = domain.separating_models(df, "x", moments)
    z = np.column_stack((np.ones(200), (x - x.mean(0)) / x.std(0)))
    ridge = np.diag([0.0, 1, 1, 1])
    for f in range(5):
        own, w = np.arange(200) % 5 != f, np.zeros(4)
        for _ in range(50):
            q = 1 / (1 + np.exp(-z[own] @ w))
            w += np.linalg.solve(z[own].T @ (z[own] * (q * (1 - q))[:, None]) + ridge, z[own].T @ (t[own] - q) - ridge @ w)
        assert models[f] == pytest.approx(w, abs=1e-6)
    got = {r.i: r.density_ratio.score for r in domain.density_ratio(df, "x", moments, models, 150, 50, 10.0).collect()}
    assert all(got[i] == pytest.approx(np.exp(z[i] @ models[i % 5]) * 3, rel=1e-6) for i in range(200))
    assert np.mean([got[i] for i in range(200) if t[i]]) > np.mean([got[i] for i in range(200) if not t[i]])


def test_three_states(spark):
    a, b = "struct<method_id:string,score:double,threshold:double,supported:boolean>", (True, False, None)
    rows = [(f"{x}{y}", ("m2", 1.0, 1.0, x), ("m1", 1.0, 1.0, y)) for x in b for y in b]
    out = {r.k: r for r in domain.assess(spark.createDataFrame(rows, f"k string, p {a}, q {a}"), ["p", "q"]).collect()}
    assert {k: r.status for k, r in out.items()} == {f"{x}{y}": domain.OUT if False in (x, y) else domain.IN if x and y else domain.UNKNOWN for x in b for y in b}
    assert [m.method_id for m in out["TrueTrue"].methods] == ["m1", "m2"]
    with pytest.raises(CampaignValidation):
        domain.assess(spark.range(1), [])


def test_decisions(spark):
    T = domain.Threshold
    df = spark.createDataFrame([(1, 0.5, "a"), (2, 1.0, "a"), (3, 2.0, "b"), (4, None, "a"), (5, 0.1, None), (6, float("nan"), "a"), (7, 2.0, None)], "i int, v double, s string")
    rules = [T("low", "v", "lt", 1.0, "reject"), T("set", "s", "in", ["a"])]
    got = {r.i: (r.decision, r.reasons) for r in domain.decide(df, rules).collect()}
    assert got == {
        1: ("accept", ["all_thresholds_hold"]), 2: ("reject", ["low"]), 3: ("reject", ["low", "set"]), 4: ("refer", ["low:missing"]),
        5: ("refer", ["set:missing"]), 6: ("reject", ["low"]), 7: ("reject", ["low", "set:missing"]),
    }
    held = lambda op, v: {r.i for r in domain.decide(df.where("v = v and v is not null"), [T("t", "v", op, v)]).where("decision = 'accept'").collect()} - {6}
    assert (held("lt", 1.0), held("lte", 1.0), held("gt", 1.0), held("gte", 1.0), held("not_in", [1.0])) == ({1, 5}, {1, 2, 5}, {3, 7}, {2, 3, 7}, {1, 3, 5, 7})
    for bad in ([], [T("a", "v", "lt", float("nan"))], [T("a", "v", "in", [])], [T("a", "v", "like", 1)], [T("a", "v", "lt", 1), T("a", "v", "gt", 0)], [T("a", "v", "lt", 1, "accept")]):
        with pytest.raises(CampaignValidation):
            domain.decide(df, bad)
