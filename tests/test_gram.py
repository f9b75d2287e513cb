import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evalkiln.checks import CampaignValidation, OofValidation
from evalkiln.operators import folds, gram


def frame(spark, n=240, p=6, seed=0, far=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p)) + far
    y = x @ rng.normal(size=(p, 2)) + rng.normal(size=(n, 2))
    rows = [(i, i % 4, [float(v) for v in x[i]], float(y[i, 0]), float(y[i, 1])) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "sample_id int, fold int, x array<double>, y double, y2 double").repartition(5)


def nipals(x, y, components):
    """Partial least squares on the rows themselves, deflating the data."""
    xm, ym = x.mean(0), y.mean(0)
    e, f = x - xm, y - ym
    ws, ps, qs = [], [], []
    for _ in range(components):
        w = np.linalg.svd(e.T @ f)[0][:, 0] if f.shape[1] > 1 else (e.T @ f)[:, 0] / np.linalg.norm(e.T @ f)
        t = e @ w
        p = e.T @ t / (t @ t)
        q = f.T @ t / (t @ t)
        e = e - np.outer(t, p)
        ws.append(w)
        ps.append(p)
        qs.append(q)
        if f.shape[1] == 1:
            f = f - np.outer(t, q)
    w, p, q = np.array(ws).T, np.array(ps).T, np.array(qs).T
    coef = w @ np.linalg.solve(p.T @ w, q.T)
    return coef, ym - xm @ coef


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_ridge_and_pls_against_direct_fits(spark, far):
    x, y, df = frame(spark, far=far)
    fold = np.arange(len(x)) % 4
    moments = gram.fold_moments(df, "x", ["y"])
    models = {m.fold: m for m in gram.fit_folds(moments, gram.ridge(2.0), refit=True)}
    pls = {k: {m.fold: m for m in gram.fit_folds(moments, gram.simpls(k), refit=True)} for k in (1, 2, 4, 6)}
    for f in (0, 1, 2, 3, gram.ALL):
        own = fold != f
        xc, yc = x[own] - x[own].mean(0), y[own, :1] - y[own, :1].mean(0)
        want = np.linalg.solve(xc.T @ xc + 2 * np.eye(6), xc.T @ yc)
        assert models[f].coef == pytest.approx(want, rel=1e-6)
        for k, by in pls.items():
            coef, intercept = nipals(x[own], y[own, :1], k)
            assert by[f].coef == pytest.approx(coef, rel=1e-5, abs=1e-7)
    got = {r.sample_id: r.value for r in gram.predict(df, list(models.values()), "x", ["value"]).collect()}
    assert all(got[i] == pytest.approx(float(x[i] @ models[fold[i]].coef[:, 0] + models[fold[i]].intercept[0]), rel=1e-9) for i in got)


def test_pls_of_two_targets(spark):
    """SIMPLS keeps the same first component as the direct fit, and all components together are least squares."""
    x, y, df = frame(spark)
    moments = gram.fold_moments(df, "x", ["y", "y2"])
    one, full = gram.simpls(1)(moments.train()), gram.simpls(6)(moments.train())
    assert one == pytest.approx(nipals(x, y, 1)[0], rel=1e-8)
    xc = x - x.mean(0)
    assert full == pytest.approx(np.linalg.lstsq(xc, y - y.mean(0), rcond=None)[0], rel=1e-6)


def test_classes(spark):
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 3, 200)
    x = rng.normal(size=(200, 5)) + 4 * np.eye(3, 5)[labels]
    df = spark.createDataFrame([(i, i % 4, [float(v) for v in x[i]], int(labels[i])) for i in range(200)], "i int, fold int, x array<double>, y int")
    out = gram.pls_da(df, "x", "y", 3).collect()
    assert len(out) == 200 and sum(r.y == r.predicted for r in out) > 180


def test_moments_refuse(spark):
    bad = spark.createDataFrame([(0, [1.0, 2.0], 1.0), (0, [1.0, None], 1.0), (1, [1.0, float("nan")], 1.0), (1, [3.0], 1.0), (1, None, 1.0), (None, [1.0, 1.0], 1.0), (1, [1.0, 1.0], None)], "fold int, x array<double>, y double")
    with pytest.raises(OofValidation, match="6 rows"):
        gram.fold_moments(bad, "x", ["y"])
    with pytest.raises(OofValidation):
        gram.fold_moments(bad.limit(0), "x", ["y"])
    same = spark.createDataFrame([(i % 2, [1.0, float(i)], float(i)) for i in range(8)], "fold int, x array<double>, y double")
    models = gram.fit_folds(gram.fold_moments(same, "x", ["y"]), gram.ridge())  # a constant column
    assert all(abs(m.coef[1, 0] - 1) < 1e-9 for m in models)
    with pytest.raises(OofValidation, match="no rows to train"):
        gram.fit_folds(gram.fold_moments(same.where("fold = 0"), "x", ["y"]), gram.ridge())


def test_variants_in_several_passes(spark, monkeypatch):
    x, y, df = frame(spark)
    variants = {f"r{r}": gram.ridge(float(r)) for r in range(5)} | {"broken": lambda m: np.linalg.inv(np.zeros((2, 2)))}
    models = gram.fit_variants(spark, gram.fold_moments(df, "x", ["y"]), variants)
    assert {m.variant for m in models} == set(variants) - {"broken"}
    whole = sorted(map(tuple, gram.score_variants(df, models, "x", "y").collect()))
    monkeypatch.setattr(gram, "MODEL_CELLS", 50)
    for a, b in zip(sorted(map(tuple, gram.score_variants(df, models, "x", "y").collect())), whole, strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:])
    for v in ("r0", "r3"):
        e = np.array([x[m.fold :: 4] @ m.coef[:, 0] + m.intercept[0] - y[m.fold :: 4, 0] for m in models if m.variant == v])
        row = next(r for r in whole if r[:2] == (v, "avg"))
        assert row[2:] == pytest.approx((240, (e * e).mean(), np.sqrt((e * e).mean()), np.abs(e).mean(), 1 - (e * e).sum() / np.square(y[:, 0] - y[:, 0].mean()).sum()))
    with pytest.raises(CampaignValidation, match="1 of 6"):
        gram.select_by_cv(gram.score_variants(df, models, "x", "y"), list(variants))


def test_selection_rules(spark):
    s = lambda rows: spark.createDataFrame(rows, "producer string, variant_id string, fold_id string, rmse double")
    two = [("p", "v1", "avg", 2.0), ("p", "v2", "avg", 1.0), ("p", "v3", "avg", 1.0), ("p", "v1", "fold0", 0.0)]
    assert gram.select_by_cv(s(two), ["v1", "v2", "v3"]) == [(1, "v2", 1.0), (2, "v3", 1.0), (3, "v1", 2.0)]
    assert [v for _, v, _ in gram.select_by_cv(s(two), ["v1", "v2", "v3"], lower_is_better=False)] == ["v1", "v2", "v3"]
    other = two + [("q", "v1", "avg", 0.0), ("q", "v2", "avg", 1.0), ("q", "v3", "avg", 2.0)]
    with pytest.raises(CampaignValidation, match="ambiguous"):
        gram.select_by_cv(s(other), ["v1", "v2", "v3"])
    assert gram.select_by_cv(s(other), ["v1", "v2", "v3"], producer="q")[0][1] == "v1"
    assert gram.select_by_cv(s(two[3:]), ["v1", "v2"]) == []
    with pytest.raises(CampaignValidation, match="no score"):
        gram.select_by_cv(s(two[:2] + [("p", "v3", "avg", float("nan"))]), ["v1", "v2", "v3"])
    with pytest.raises(CampaignValidation, match="unknown"):
        gram.select_by_cv(s(two), ["v1", "v2"])


@pytest.mark.parametrize("change, message", [
    (lambda p: p.where("sample_id <> 's3' or producer <> 'b'"), "has no prediction for: s3"), (lambda p: p.unionByName(p.where("sample_id = 's2'")), "predicts twice: s2"),
    (lambda p: p.withColumn("value", F.when(F.col("sample_id") == "s1", float("nan")).otherwise(F.col("value"))), "no finite value for: s1"),
    (lambda p: p.withColumn("partition", F.when(F.col("sample_id") == "s4", "train").otherwise(F.col("partition"))), "oof_leakage.*s4"),
])
def test_stack_refuses(spark, change, message):
    rows = spark.createDataFrame([(f"s{i}", i % 2, float(i)) for i in range(6)], "sample_id string, fold int, y double")
    p = rows.crossJoin(spark.createDataFrame([("a",), ("b",)], "producer string")).select("sample_id", "producer", F.lit("y").alias("target"), F.lit("validation").alias("partition"), (F.col("y") + F.ascii("producer")).alias("value"))
    columns = [("b", "y"), ("a", "y")]
    assert {r.sample_id: r.x for r in gram.stack(p, rows, columns).collect()}["s2"] == [100.0, 99.0]
    with pytest.raises(PySparkException, match=message):
        gram.stack(change(p), rows, columns).collect()
    twice = p.unionByName(p.withColumn("value", F.col("value") + 1))
    assert {r.sample_id: r.x for r in gram.stack(twice, rows, columns, resampled=True).collect()}["s2"] == [100.5, 99.5]


def test_resampled_folds(spark):
    """Shuffle splits and bootstraps have the sizes and multiplicities asked for; models train on each fold's draws."""
    x, y, df = frame(spark, n=90)
    shuffled = folds.shuffle_split(df, 3, 0.25, 9)
    assert {(r.fold_id, r.role): r["count"] for r in shuffled.groupBy("fold_id", "role").count().collect()} == {(f"fold{f}", role): n for f in range(3) for role, n in (("validation", 22), ("train", 68))}
    assert folds.supplied_violations(shuffled, df, partitioned=False).count() == 0
    with pytest.raises(ValueError):
        folds.shuffle_split(df, 3, 0.001, 9)
    drawn = folds.bootstrap(df, 3, 4)
    times = {(r.fold_id, r.sample_id): r.times if r.role == "train" else 0 for r in drawn.collect()}
    assert len(times) == 270 and all(sum(times[f"fold{f}", i] for i in range(90)) == 90 for f in range(3)) and len({times[k] for k in times}) > 3
    models = gram.fit_folds(gram.resampled_moments(df, drawn, "x", ["y"]), gram.ridge(1.0))
    total, count = np.zeros(90), np.zeros(90)
    for m in models:
        often = [i for i in range(90) for _ in range(times[f"fold{m.fold}", i])]
        xc, yc = x[often] - x[often].mean(0), y[often, :1] - y[often, :1].mean(0)
        assert m.coef == pytest.approx(np.linalg.solve(xc.T @ xc + np.eye(6), xc.T @ yc), rel=1e-6)
        out = np.array([times[f"fold{m.fold}", i] == 0 for i in range(90)])
        total += out * (x @ m.coef[:, 0] + m.intercept[0])
        count += out
    got = {r.sample_id: r for r in gram.resampled_oof(df, drawn, models, "x").collect()}
    for i in range(90):
        assert got[i].n == count[i] and (got[i].value is None if not count[i] else got[i].value == pytest.approx(total[i] / count[i]))


def test_supplied_folds_are_refused(spark):
    u = spark.createDataFrame([(f"s{i}", f"g{i % 3}") for i in range(6)], "sample_id string, group_id string")
    good = [(f"f{g}", f"s{i}", "validation" if i % 3 == g else "train", 1) for i in range(6) for g in range(3)]
    kind = "fold_id string, sample_id string, role string, times int"
    assert folds.supplied(spark.createDataFrame(good, kind), u, groups=u).count() == 18
    for bad, rule in (
        ([*good, ("f0", "s1", "test", 1)], "role"), ([*good, (None, "s1", "train", 1)], "null"), ([*good, good[4]], "repeated"), ([*good, ("f4", "s1", "train", 1)], "empty"), ([*good[1:], (*good[0][:3], 0)], "times"),
        ([*good, ("f0", "s0", "train", 1)], "overlap"), ([*good, ("f0", "s7", "train", 1)], "foreign"), (good[1:], "validated"), ([*[g for g in good if g[:2] != ("f0", "s3")], ("f0", "s3", "train", 1)], "group"),
    ):
        df = spark.createDataFrame(bad, kind)
        assert rule in {r.rule for r in folds.supplied_violations(df, u, groups=u).collect()}
        with pytest.raises(OofValidation):
            folds.supplied(df, u, groups=u)


def test_features_are_selected_by_train_rows(spark):
    x, y, df = frame(spark)
    moments = gram.fold_moments(df, "x", ["y"])
    for f, score, mask in gram.selected_features(moments, 2):
        own = np.arange(240) % 4 != f
        want = [np.corrcoef(x[own, j], y[own, 0])[0, 1] ** 2 for j in range(6)]
        assert score == pytest.approx(want) and [i for i, k in enumerate(mask) if k] == sorted(np.argsort(want)[-2:])
    models = gram.masked(lambda columns: gram.ridge(0.0, columns), moments, 2)
    assert all((m.coef != 0).sum() == 2 for m in models)
