import math

import numpy as np
import pytest

from evalkiln.checks import CampaignValidation
from evalkiln.operators import gram, robust


def frame(spark, n=160, p=5):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, p))
    y = x @ np.arange(1.0, p + 1) + rng.normal(size=n) * 0.3
    role = np.array(["train", "train", "calibration", "test"])[np.arange(n) % 4]
    rows = [(f"s{i}", role[i], [float(v) for v in x[i]], float(y[i])) for i in range(n)]
    return x, y, role, spark.createDataFrame(rows, "sample_id string, role string, x array<double>, y double").repartition(3)


def shifted(x, s):
    at = np.clip(np.arange(x.shape[1]) + s, 0, x.shape[1] - 1)
    low = np.floor(at).astype(int)
    return x[:, low] * (1 - at + low) + x[:, np.minimum(low + 1, x.shape[1] - 1)] * (at - low)


def replaced(x, s):
    out = x.copy()
    out[:, [0, 3]] *= 1 - min(s, 1)
    return out


def direct(x, y, role, change, levels, refit, recalibrate):
    out = {}
    for s in levels:
        train = change(x, s) if refit else x
        m = role == "train"
        xm, ym = train[m].mean(0), y[m].mean()
        b = np.linalg.solve((train[m] - xm).T @ (train[m] - xm) + 2 * np.eye(x.shape[1]), (train[m] - xm).T @ (y[m] - ym))
        predict = lambda z: (z - xm) @ b + ym
        c = role == "calibration"
        r = np.sort(np.abs(predict((change(x, s) if recalibrate else x)[c]) - y[c]))
        radius = r[math.ceil((len(r) + 1) * 0.8) - 1]
        e = predict(change(x, s)[role == "test"]) - y[role == "test"]
        out[s] = (len(e), np.sqrt((e * e).mean()), np.abs(e).mean(), radius, (np.abs(e) <= radius).mean())
    return out


@pytest.mark.parametrize("kind, mode, change", [
    ("ordered_axis_shift", "clean_frozen", shifted), ("ordered_axis_shift", "matched_recalibration", shifted), ("node_replacement", "structural_refit", replaced),
])
def test_modes_equal_direct_computation(spark, kind, mode, change):
    x, y, role, df = frame(spark)
    levels = (0.0, 0.5, 1.25)
    got = robust.scenario(df, kind, levels, mode, gram.ridge(2.0), 0.8, (0, 3)).collect()
    want = direct(x, y, role, change, levels, mode == "structural_refit", mode != "clean_frozen")
    assert len(got) == 3
    for r in got:
        assert (r.n, r.rmse, r.mae, r.radius, r.coverage) == pytest.approx(want[r.severity], rel=1e-9)
        assert (r.refit, r.recalibrated) == (mode == "structural_refit", mode != "clean_frozen")


def test_kinds(spark):
    x, _, _, df = frame(spark)
    noisy = robust.perturbed(df, "gaussian_noise", (0.0, 1.0, 2.0), seed=7).collect()
    d = {s: np.array([np.array(r.x) - x[int(r.sample_id[1:])] for r in sorted((r for r in noisy if r.severity == s), key=lambda r: int(r.sample_id[1:]))]) for s in (0.0, 1.0, 2.0)}
    assert not d[0.0].any() and abs(d[1.0].std() - 1) < 0.1 and abs(d[1.0].mean()) < 0.1 and d[2.0] == pytest.approx(2 * d[1.0])
    dropped = robust.perturbed(df, "dropout", (0.0, 0.3, 1.0)).collect()
    share = {s: np.mean([[v == 0 for v in r.x] for r in dropped if r.severity == s]) for s in (0.0, 0.3, 1.0)}
    assert share[0.0] == 0 and abs(share[0.3] - 0.3) < 0.06 and share[1.0] == 1
    assert robust.perturbed(df, "identity", (0.0,)).count() == 160


def test_refusals(spark):
    _, _, _, df = frame(spark)
    for levels in ((), (0.5,), (0.0, 0.0), (0.0, -1.0), (0.0, float("inf"))):
        with pytest.raises(CampaignValidation):
            robust.perturbed(df, "dropout", levels)
    for kind, mode, nodes in (("identity", "structural_refit", (1,)), ("node_replacement", "clean_frozen", (1,)), ("node_replacement", "structural_refit", ()), ("dropout", "none", ()), ("bend", "clean_frozen", ())):
        with pytest.raises(CampaignValidation):
            robust.scenario(df, kind, (0.0,), mode, gram.ridge(), nodes=nodes)
