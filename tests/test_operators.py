"""Small cases with known answers, and the refusals."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from evalkiln import checks
from evalkiln.functions import hashing, scalars
from evalkiln.operators import chains, conformal, folds, identity, metrics, models, predictions as P, reduce as R, select, space, views
from evalkiln.plans import campaign, graph
from evalkiln.sources import stores

PRED = "producer string, partition string, fold_id string, sample_id string, target string, value double"
MEMBERS = "fold_id string, sample_id string, role string"


@pytest.fixture(scope="module")
def uc(spark):
    """Six samples, three folds, three producers, rows out of order."""
    fold = {f"S00{i}": f"fold{(i - 1) // 2}" for i in range(1, 7)}
    rows = [(p, "validation", fold[s], s, "y", i * 10.0 + int(s[1:])) for i, p in enumerate(("a", "b", "c")) for s in reversed(sorted(fold))]
    members = [(f, s, "validation" if fold[s] == f else "train") for f in sorted(set(fold.values())) for s in fold]
    return spark.createDataFrame(rows, PRED), spark.createDataFrame(members, MEMBERS), spark.createDataFrame([(s,) for s in fold], "sample_id string")


def test_oof_success(uc):
    p, members, universe = uc
    wide = {r.sample_id: r.asDict() for r in P.oof_campaign(p, members, universe, [("a", "y"), ("b", "y"), ("c", "y")]).collect()}
    assert wide["S003"] == {"sample_id": "S003", "a__y": 3.0, "b__y": 13.0, "c__y": 23.0} and len(wide) == 6


def test_train_block_is_refused(uc):
    p, members, universe = uc
    leaky = p.withColumn("partition", F.when(F.col("producer") == "b", "train").otherwise(F.col("partition")))
    with pytest.raises(checks.OofLeakage) as e:
        P.oof_campaign(leaky, members, universe, [("a", "y")])
    assert {(r.producer, r.partition) for r in e.value.rows} == {("b", "train")} and e.value.code == "oof_leakage"


def test_missing_extra_and_repeated_samples_are_refused(uc):
    p, members, universe = uc
    for bad in (p.where("not (producer = 'a' and sample_id = 'S002')"), p.unionByName(p.limit(1)), p.withColumn("fold_id", F.lit("fold0"))):
        with pytest.raises(checks.OofValidation):
            P.oof_campaign(bad, members, universe, [("a", "y")])


def test_meta_features_refuse_repeats_unless_averaged(uc):
    p = uc[0].unionByName(uc[0])
    with pytest.raises(checks.OofValidation):
        P.meta_features(p)
    assert P.meta_features(p, average=True).count() == 18


def test_fold_violations(uc, spark):
    _, members, universe = uc
    assert folds.fold_violations(members, universe).count() == 0
    more = members.unionByName(spark.createDataFrame([("fold0", "S001", "train"), ("fold9", "S999", "train")], MEMBERS))
    assert {(r.rule, r.sample_id) for r in folds.fold_violations(more, universe).collect()} == {("overlap", "S001"), ("foreign", "S999")}


def test_seed_key_equals_python(spark):
    seed, ident = 2**63 + 11, "S1"
    digest = hashlib.sha256(seed.to_bytes(8, "little") + b"\x00kfold\xff" + ident.encode()).digest()
    key = spark.createDataFrame([(ident,)], "i string").select(hashing.seed_key(seed, "kfold", F.col("i"))).first()[0]
    assert int(key, 16) == int.from_bytes(digest[:8], "little")


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_global_position(spark, n):
    df = spark.createDataFrame([(f"k{i * 37 % 1009:05d}",) for i in range(n)], "k string").repartition(3)
    got = [r.k for r in folds.global_position(df, "k").orderBy("position").collect()]
    assert got == sorted(got) and len(got) == n
    assert sorted(r.position for r in folds.global_position(df, "k").collect()) == list(range(n))


def test_kfold_refuses_one_fold(spark):
    with pytest.raises(ValueError):
        folds.kfold(spark.createDataFrame([("a",)], "sample_id string"), 1)


def test_group_kfold_is_greedy_and_keeps_groups(spark):
    sizes = {"a": 5, "b": 4, "c": 3, "d": 3, "e": 1}
    rows = [(f"{g}{i}", g) for g, n in sizes.items() for i in range(n)]
    got = folds.group_kfold(spark.createDataFrame(rows, "sample_id string, group_id string"), 2)
    by = {r.sample_id[0]: r.fold for r in got.collect()}
    assert by == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1} and got.count() == 16


def test_relation_violations(spark):
    schema = "observation_id string, sample_id string, target_id string, group_id string, weight double"
    rows = [("o1", "s1", "t1", "g1", 1.0), ("o1", "s1", "t2", "g1", 0.0), ("o2", "s2", "t1", "g1", float("nan")), ("o3", "s2", "t1", "g2", 2.0)]
    got = {(r.rule, r.subject) for r in identity.relation_violations(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("repeated_observation", "o1"), ("several_targets", "s1"), ("several_groups", "s2"), ("weight", "o1"), ("weight", "o2")}


def test_view_policy():
    for bad in (views.ViewPolicy(fit="full_train"), views.ViewPolicy(augmented_validation=True)):
        with pytest.raises(checks.CampaignValidation):
            bad.check()
    views.ViewPolicy(fit="full_train", unsafe=frozenset({"full_train_fit"})).check()


def test_reducers(spark):
    values = [1.0, 1.0, 2.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 100.0]
    df = spark.createDataFrame([("u", v, 1.0) for v in values], "u string, v double, w double")
    got = {m: R.reduce_units(df, ["u"], ["v"], m, "w").first().v for m in ("mean", "weighted_mean", "median", "vote", "robust_mean")}
    assert got == pytest.approx({"mean": 13.1, "weighted_mean": 13.1, "median": 3.5, "vote": 1.0, "robust_mean": 30 / 8})
    assert R.reduce_units(df.withColumn("w", F.lit(0.0)), ["u"], ["v"], "weighted_mean", "w").first().v is None
    out = R.exclude_outliers(df, ["u"], ["v"]).first()
    assert (out.n, out.n_used) == (10, 9) and out.v == pytest.approx(31 / 9)
    same = R.exclude_outliers(spark.createDataFrame([("u", 2.0)] * 4 + [("p", 1.0), ("p", 9.0)], "u string, v double"), ["u"], ["v"])
    assert {r.u: (r.v, r.n_used) for r in same.collect()} == {"u": (2.0, 4), "p": (5.0, 2)}


def test_score_pair_by_id(spark):
    p = spark.createDataFrame([("s1", 2.0), ("s2", 4.0)], "sample_id string, value double")
    y = spark.createDataFrame([("s2", 5.0), ("s1", 1.0), ("s3", 0.0)], "sample_id string, y double")
    joined, lone = metrics.score_join(p, y, ["sample_id"])
    r = metrics.report(joined.withColumn("k", F.lit(1)), ["k"]).first()
    assert (r.mse, r.rmse, r.mae, r.r2) == (1.0, 1.0, 1.0, 0.75) and [(x.side, x.sample_id) for x in lone.collect()] == [("truth", "s3")]


def test_r2_of_a_constant_truth(spark):
    rows = spark.createDataFrame([("exact", 3.0, 3.0), ("exact", 3.0, 3.0), ("off", 3.0, 3.0), ("off", 4.0, 3.0)], "k string, value double, y double")
    assert {r.k: r.r2 for r in metrics.report(rows, ["k"]).collect()} == {"exact": 1.0, "off": 0.0}


def test_selection(spark):
    c = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 0.5)], "candidate_id string, value double")
    assert [r.candidate_id for r in select.rank(c).orderBy("rank").collect()] == ["c", "a", "b"]
    bad = c.unionByName(spark.createDataFrame([("c", 2.0), ("d", float("inf")), ("e", None)], c.schema))
    assert {(r.candidate_id, r.problem) for r in select.candidate_violations(bad).collect()} == {("c", "repeated"), ("d", "not_finite"), ("e", "not_finite")}


@pytest.mark.parametrize("n, c, rank", [(99, 0.07, 7), (9, 0.9, 9), (19, 0.95, 19), (4, 0.9, 5), (10, 0.5, 6)])
def test_conformal_rank_is_exact(spark, n, c, rank):
    assert spark.range(1).select(scalars.conformal_rank(F.lit(n), F.lit(c))).first()[0] == rank


def test_conformal_quantiles_ties_and_unbounded(spark):
    res = spark.createDataFrame([("y", v) for v in (1.0, 2.0, 2.0, 2.0)], "target string, residual double")
    got = {r.coverage: (r.rank, r.radius) for r in conformal.quantiles(res, conformal.coverages(spark, (0.2, 0.5, 0.9))).collect()}
    assert got == {0.2: (1, 1.0), 0.5: (3, 2.0), 0.9: (5, None)}
    with pytest.raises(ValueError):
        conformal.coverages(spark, (0.5, 0.5))


def test_conformal_ends_are_decimal(spark):
    lo, hi = scalars.interval(F.lit(0.1), F.lit(0.2))
    assert tuple(spark.range(1).select(lo, hi).first()) == (-0.1, 0.3)


def test_percentile_rank_and_z(spark):
    df = spark.createDataFrame([("d", 1, 1.0), ("d", 2, 2.0), ("d", 3, 2.0), ("d", 4, 3.0), ("one", 5, 9.0)], "dataset string, id int, score double")
    assert [r.percentile for r in chains.percentile_rank(df, "dataset", "score").orderBy("id").collect()] == [0.0, 0.5, 0.5, 1.0, 0.5]
    z = {r.id: r.z for r in chains.z_score(df, "dataset", "score").collect()}
    assert z[5] == 0.0 and z[1] == pytest.approx(-1 / math.sqrt(2 / 3) * 1.0)


def test_linear_oof_learns_from_other_folds(spark):
    rows = spark.createDataFrame([(f"s{i}", i % 3, float(i), 2.0 * i + 1) for i in range(12)], "sample_id string, fold int, x double, y double")
    assert all(r.value == pytest.approx(r.y) for r in models.linear_oof(rows, "x").collect())
    odd = rows.withColumn("y", F.when(F.col("fold") == 0, 0.0).otherwise(F.col("y")))
    assert all(r.value == pytest.approx(2 * r.x + 1) for r in models.linear_oof(odd, "x").where("fold = 0").collect())


def test_space(spark):
    a, b = space.dimension(spark, "a", [1, 2]), space.dimension(spark, "b", ["x", "y", "z"])
    with pytest.raises(ValueError):
        space.zipped(a, b)
    with pytest.raises(ValueError):
        space.checked(space.constrain(space.cartesian(a, b), exclude=[(F.lit(True), F.lit(True))]))
    with pytest.raises(ValueError):
        space.merge_overrides({("n", "p"): 1}, {("n", "p"): 2})
    ids = space.identify(space.cartesian(a, b), ["a", "b"], 1)
    assert ids.select("variant_id").distinct().count() == 6


def test_graph_refusals():
    with pytest.raises(checks.GraphValidation):
        graph.Graph.of(edges=[("a", "b"), ("b", "a")])
    with pytest.raises(checks.GraphValidation):
        graph.Graph.of(nodes=[("a", "nothing")])
    with pytest.raises(checks.GraphValidation):
        graph.Graph.of(edges=[graph.Edge("a", "b", "data", True)])
    g = graph.Graph.of(edges=[(f"n{i}", f"n{i + 1}") for i in range(400)])
    assert len(g.levels()) == 401 and g.active({"n2"}) == {"n0", "n1", "n2"}


def test_cache_fingerprint(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "producer string, value double")
    mark = hashing.table_fingerprint(df).first()["fingerprint"]
    assert stores.verified(df.orderBy(F.desc("producer")), mark) is not None
    with pytest.raises(ValueError):
        stores.verified(df.limit(1), mark)


def test_campaign_refuses_gaps(spark):
    """A key that stands in one fold only is learned by no other fold: its sample has no prediction, so the campaign is refused."""
    rows = [(f"s{i:02d}", "k" if i < 11 else "rare", float(i)) for i in range(12)]
    c = campaign.Campaign((campaign.group_mean("g"),), k=3)
    samples = spark.createDataFrame(rows, "sample_id string, g string, y double")
    with pytest.raises(checks.OofValidation, match="s11"):
        c.fit_cv(samples)
    whole = samples.where("g = 'k'")
    oof = c.fit_cv(whole)
    assert oof.count() == 11 and oof.where("value is null").count() == 0
    got = {r.sample_id: (r.value, r.n) for r in c.predict(whole, samples, c.ranking(oof)).collect()}
    assert got["s11"] == (None, 0) and got["s03"] == (5.0, 1) and len(got) == 12


def test_rank_refuses_what_it_cannot_order(spark):
    for rows in ([("a", 1.0), ("b", None)], [("a", 1.0), ("b", float("nan"))], [("a", float("inf"))], [("a", 1.0), ("a", 2.0)]):
        with pytest.raises(Exception, match="campaign_validation"):
            select.rank(spark.createDataFrame(rows, "candidate_id string, value double")).collect()
    assert select.rank(spark.createDataFrame([], "candidate_id string, value double")).count() == 0


def test_widths_are_null_where_an_interval_is_unbounded(spark):
    rows = [(0.9, 1.0, 0.0, 2.0), (0.9, 1.0, None, None), (0.5, 5.0, 0.0, 2.0)]
    got = {r.coverage: r for r in conformal.metrics(spark.createDataFrame(rows, "coverage double, y double, lower double, upper double")).collect()}
    assert (got[0.9].mean_width, got[0.9].median_width, got[0.9].winkler, got[0.9].empirical) == (None, None, None, 1.0)
    assert got[0.5].mean_width == 2.0 and got[0.5].empirical == 0.0


def test_exact_refuses_what_it_would_bend(spark):
    value = lambda x: spark.createDataFrame([(x,)], "x double").select(scalars.exact(F.col("x")).cast("double").alias("d")).first().d
    assert [value(x) for x in (0.1, -123.456, 0.0, None, 1e-18)] == [0.1, -123.456, 0.0, None, 1e-18]
    for x in (1e25, 1e-20, float("nan")):
        with pytest.raises(Exception, match="exact range"):
            value(x)


def test_ranges(spark):
    values = lambda *a, **k: [r.value for r in space.range_values(spark, *a, **k).orderBy("i").collect()]
    now, want = 0.1, []
    for _ in range(10):
        want.append(now)
        now += 0.1
    assert values(0.1, 1.0, 0.1) == want and values(0.1, 1.0, 0.1, inclusive=False) == want[:9]
    assert values(3.0, 1.0, -1.0) == [3.0, 2.0, 1.0] and values(1.0, 1.0, 5.0) == [1.0]
    for bad in ((1.0, 2.0, 0.0), (1.0, 2.0, -1.0), (2.0, 1.0, 1.0), (0.0, 1.0, 1e-6), (0.0, float("inf"), 1.0)):
        with pytest.raises(ValueError):
            values(*bad)
    with pytest.raises(ValueError):
        values(1.0, 1.0, 1.0, inclusive=False)


def test_variants_are_told_apart(spark):
    rows = space.identify(spark.createDataFrame([("1,b=2", "3"), ("1", "2,b=3")], "a string, b string"), ["a", "b"], 1).collect()
    assert rows[0].fingerprint != rows[1].fingerprint


def test_campaign_is_refused_before_the_join(spark):
    ok = [("p", "validation", f"f{i % 2}", f"s{i}", "y", float(i)) for i in range(6)]
    members = spark.createDataFrame([(f"f{g}", f"s{i}", "validation" if i % 2 == g else "train") for i in range(6) for g in range(2)], "fold_id string, sample_id string, role string")
    universe = spark.createDataFrame([(f"s{i}",) for i in range(6)], "sample_id string")
    run = lambda rows: P.oof_campaign(spark.createDataFrame(rows, "producer string, partition string, fold_id string, sample_id string, target string, value double"), members, universe, [("p", "y")])
    assert run(ok).count() == 6
    for bad, error in (
        ([*ok[:5], ("p", "train", "f1", "s5", "y", 1.0)], checks.OofLeakage), (ok[:5], checks.OofValidation), ([*ok, ("p", "validation", "f0", "s9", "y", 1.0)], checks.OofValidation),
        ([*ok, ok[0]], checks.OofValidation), ([*ok[:5], ("p", "validation", "f0", "s5", "y", 1.0)], checks.OofValidation), ([*ok[:5], ("p", "validation", "f1", "s5", "y", None)], checks.OofValidation),
    ):
        with pytest.raises(error):
            run(bad)


def campaign_of(spark, change=None, resampled=False, **more):
    """Six samples, two folds, two producers with two targets each; ``change`` plants a fault in (predictions, members, universe)."""
    p = [(f"p{j}", "validation", f"f{i % 2}", f"s{i}", t, float(i + j)) for i in range(6) for j in range(2) for t in ("y", "z")]
    m = [(f"f{g}", f"s{i}", "validation" if i % 2 == g else "train") for i in range(6) for g in range(2)]
    u = [(f"s{i}",) for i in range(6)]
    if change:
        change(p, m, u)
    frames = (spark.createDataFrame(p, PRED), spark.createDataFrame(m, MEMBERS), spark.createDataFrame(u, "sample_id string"))
    columns = [(f"p{j}", t) for j in range(2) for t in ("y", "z")]
    if "allow_train" in more:
        return P.check_campaign(*frames, columns, resampled, **more)
    return P.oof_campaign(*frames, columns, resampled)


FAULTS = {
    "overlap": (lambda p, m, u: m.append(("f0", "s0", "train")), "overlap"), "foreign": (lambda p, m, u: m.append(("f0", "s9", "train")), "foreign"),
    "repeated member": (lambda p, m, u: m.append(("f0", "s1", "train")), "repeated in one role"), "validated twice": (lambda p, m, u: m.append(("f2", "s0", "validation")), "validated"),
    "never validated": (lambda p, m, u: m.remove(("f0", "s0", "validation")), "validated"), "train-only fold": (lambda p, m, u: m.append(("f2", "s0", "train")), "no validation samples"),
    "requested twice": (lambda p, m, u: u.append(("s0",)), "requested twice"), "requested beyond": (lambda p, m, u: u.append(("s9",)), "validated"), "not requested": (lambda p, m, u: u.remove(("s0",)), "foreign"),
    "unknown fold": (lambda p, m, u: p.append(("p0", "validation", "f7", "s0", "y", 1.0)), "unknown fold"), "no fold": (lambda p, m, u: p.append(("p0", "validation", None, "s0", "z", 1.0)), "no fold"),
    "gap": (lambda p, m, u: p.remove(("p1", "validation", "f1", "s3", "z", 4.0)), "missing"), "extra": (lambda p, m, u: p.append(("p1", "validation", "f1", "s9", "z", 4.0)), "extra"),
    "repeat": (lambda p, m, u: p.append(p[5]), "1 repeated"), "other producer out of place": (lambda p, m, u: p.append(("q", "validation", "f1", "s0", "y", 4.0)), "extra"),
    "null": (lambda p, m, u: p.__setitem__(2, (*p[2][:5], None)), "value"), "infinite": (lambda p, m, u: p.__setitem__(2, (*p[2][:5], float("inf"))), "value"), "NaN": (lambda p, m, u: p.__setitem__(2, (*p[2][:5], float("nan"))), "value"),
    "null sample": (lambda p, m, u: p.append(("p0", "validation", "f1", None, "y", 4.0)), "extra"), "producer absent": (lambda p, m, u: [p.remove(r) for r in list(p) if r[0] == "p1" and r[4] == "z"], "no predictions"),
    "nothing": (lambda p, m, u: (p.clear(), m.clear(), u.clear()), "no samples"),
}


@pytest.mark.parametrize("fault", FAULTS)
def test_each_fault_is_refused(spark, fault):
    change, message = FAULTS[fault]
    with pytest.raises(checks.OofValidation, match=message):
        campaign_of(spark, change)


def test_leaking_blocks_come_first(spark):
    with pytest.raises(checks.OofLeakage) as e:
        campaign_of(spark, lambda p, m, u: p.append(("p0", "train", "f0", "s1", "z", 1.0)))
    assert ("p0", "train", "f0") in {(r.producer, r.partition, r.fold_id) for r in e.value.rows}
    assert campaign_of(spark).count() == 6


def test_allowed_train_blocks_are_checked_against_their_fold(spark):
    whole = lambda p, m, u: p.extend((f"p{j}", "train", f"f{g}", f"s{i}", t, 1.0) for i in range(6) for g in range(2) for j in range(2) for t in ("y", "z") if i % 2 != g)
    campaign_of(spark, whole, allow_train=True)
    for fault in (lambda p, m, u: (whole(p, m, u), p.remove(("p0", "train", "f0", "s1", "y", 1.0))), lambda p, m, u: (whole(p, m, u), p.append(("p0", "train", "f0", "s0", "y", 1.0)))):
        with pytest.raises(checks.OofValidation):
            campaign_of(spark, fault, allow_train=True)


def test_resampled_campaign(spark):
    """A sample may be validated in several folds, and then is predicted in each; the join averages. Overlap stays refused."""
    def again(p, m, u):
        m.remove(("f1", "s0", "train"))
        m.append(("f1", "s0", "validation"))
        p.extend((f"p{j}", "validation", "f1", "s0", t, 10.0) for j in range(2) for t in ("y", "z"))

    got = {r.sample_id: r for r in campaign_of(spark, again, resampled=True).collect()}
    assert got["s0"].p0__y == 5.0 and got["s3"].p1__z == 4.0
    with pytest.raises(checks.OofValidation):
        campaign_of(spark, again)
    with pytest.raises(checks.OofValidation, match="overlap"):
        campaign_of(spark, lambda p, m, u: (again(p, m, u), m.append(("f1", "s0", "train"))), resampled=True)


def plain_outliers(rows):
    """unit -> (means, n, used), row by row with the others written out."""
    out = {}
    for unit in {u for u, *_ in rows}:
        xs = [x for u, *x in rows if u == unit]
        t2 = []
        for i, x in enumerate(xs):
            others = xs[:i] + xs[i + 1 :]
            total = 0.0
            for c in range(2):
                if others and len({o[c] for o in others}) > 1:
                    mean = sum(o[c] for o in others) / len(others)
                    total += (x[c] - mean) ** 2 / (sum((o[c] - mean) ** 2 for o in others) / len(others))
            t2.append(total)
        kept = [x for x, t in zip(xs, t2) if t <= R.OUTLIER_T2] if len(xs) >= 3 else xs
        kept = kept or xs
        out[unit] = (*[sum(x[c] for x in kept) / len(kept) for c in range(2)], len(xs), len(kept))
    return out


def test_outliers_of_small_and_constant_units(spark):
    import random

    r = random.Random(3)
    rows = [(f"u{i}", r.gauss(10, 1), float(r.randint(0, 2))) for i in range(40) for _ in range(r.randint(1, 9))]
    rows += [("same", 1.5, 2.0)] * 5 + [("one off", 0.1, 0.3)] * 6 + [("one off", 7.0, 0.3)] + [("far", 1e6 + i * 1e-3, 0.0) for i in range(6)] + [("far", 2e6, 0.0), ("two", 1.0, 1.0), ("two", 9.0, 1.0)]
    df = spark.createDataFrame(rows, "unit string, v double, q double").repartition(3)
    got = {x.unit: (x.v, x.q, x.n, x.n_used) for x in R.exclude_outliers(df, ["unit"], ["v", "q"]).collect()}
    want = plain_outliers(rows)
    assert got.keys() == want.keys()
    for u, w in want.items():
        assert got[u] == pytest.approx(w), u


def test_outliers_of_one_huge_unit(spark):
    df = spark.range(300_000).select(F.lit("u").alias("unit"), (F.col("id") % 100).cast("double").alias("v"), F.when(F.col("id") == 5, 1e6).otherwise(F.col("id") % 7).cast("double").alias("q"))
    r = R.exclude_outliers(df, ["unit"], ["v", "q"]).first()
    assert (r.n, r.n_used) == (300_000, 299_999)


def test_outliers_with_others_that_nearly_agree(spark):
    rows = [("u", 10.0, 1.0), ("u", 10.00002, 2.0), ("u", 10.5, 3.0)]
    df = spark.createDataFrame(rows, "unit string, v double, q double")
    # the first two differ by a variance of 1e-10: too little to call the third one far, unless that counts
    told = R.exclude_outliers(df, ["unit"], ["v"]).first()
    assert (told.n_used, told.v) == (2, pytest.approx(10.00001))
    kept = R.exclude_outliers(df, ["unit"], ["v"], least_variance=1e-9).first()
    assert (kept.n_used, kept.v) == (3, pytest.approx(30.50002 / 3))


def test_shuffles_follow_the_rows(spark):
    from evalkiln.session import spread

    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")}
    try:
        spread(spark, 1000)
        assert {k: spark.conf.get(k) for k in kept} == kept
        spread(spark, 10_000_001)
        df = spark.range(100).groupBy(F.col("id") % 7).count()
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert df.rdd.getNumPartitions() == 41
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_custom_reducer_counts_nulls_and_is_called_for_many_units_at_once(spark):
    rows = [("a", 1.0), ("a", None), ("a", 4.0), (None, 2.0), ("b", None)] + [(f"u{i}", float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "u string, v double").repartition(3)
    out = R.custom_reduce(df, ["u"], "v", lambda s: s.max() + len(s))
    got = {r.u: (r.v, r.n) for r in out.collect()}
    assert got["a"] == (7.0, 3) and got[None] == (3.0, 1) and got["b"] == (None, 1)  # NaN is null, as it was
    assert all(got[f"u{i}"] == (i + 1.0, 1) for i in range(300))
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()


def test_placing_samples_whole_equals_kfold(spark):
    rows = spark.createDataFrame([(f"S{i * 7 % 23:02}", i) for i in range(23)], "sample_id string, v int")
    got = {(r.sample_id, r.v, r.fold) for r in folds.with_fold(rows, 5).collect()}
    assert got == {(r.sample_id, r.v, r.fold) for r in rows.join(folds.kfold(rows, 5), "sample_id").collect()}


def test_doubtful_members_are_those_that_break_a_rule(spark):
    universe = spark.createDataFrame([(s,) for s in "abc"], "sample_id string")
    good = [("fold0", "a", "validation", 1), ("fold0", "b", "train", 2), ("fold0", "c", "train", 1), ("fold1", "a", "train", 1), ("fold1", "b", "validation", 1), ("fold1", "c", "validation", 1)]
    faults = [[("fold0", "b", "validation", 1)], [("fold0", "b", "train", 1)], [("fold0", "z", "train", 1)], [("fold2", "a", "test", 1)], [(None, "a", "train", 1)], [("fold0", None, "train", 1)], [("fold2", "a", "train", 0)], [("fold2", "a", "train", 1)]]
    frame = lambda rows: spark.createDataFrame(rows, "fold_id string, sample_id string, role string, times int")
    assert folds.doubtful(frame(good), universe).isEmpty()
    assert folds.supplied(frame(good), universe).count() == 6
    for fault in faults:
        assert not folds.doubtful(frame(good + fault), universe, False).isEmpty(), fault
    unseen = universe.union(spark.createDataFrame([("d",)], "sample_id string"))
    assert not folds.doubtful(frame(good), unseen).isEmpty() and folds.doubtful(frame(good), unseen, False).isEmpty()


def test_few_keys_of_a_model_are_broadcast(spark):
    from evalkiln.operators import models

    rows = spark.createDataFrame([("k", i % 2, float(i)) for i in range(6)], "key string, fold int, y double")
    out = models.group_mean_oof(rows, "key")
    assert "ResolvedHint (strategy=broadcast)" in out._jdf.queryExecution().analyzed().toString() or "strategy=broadcast" in out._jdf.queryExecution().logical().toString()
    assert {(r.fold, r.value) for r in out.collect()} == {(0, 3.0), (1, 2.0)}
