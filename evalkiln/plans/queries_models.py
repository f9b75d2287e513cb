"""Queries over models that are learned from cross-products: stacking, variants by cross-validation, partial least squares."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalkiln.operators import domain, folds, gram, robust
from evalkiln.plans.prelude import FOLDS, MEMBERS, PRED, SAMPLES, sql
from evalkiln.plans.registry import query
from evalkiln.sources.stores import reread
from evalkiln.sources.testdata import folded, membership, predicted, samples, table

COLUMNS = [("m:a", "y"), ("m:b", "y")]
RIDGE = 0.5


def _stacked(spark, d):
    """(sample_id, fold, y, x): both producers' out-of-fold predictions of each sample."""
    return _kept_stack(folded(spark, d))


def _kept_stack(s, more=None):
    """The stack over samples with their fold, kept: models and predictions read it several times. ``more`` are repeated predictions."""
    p = predicted(s)
    rows = s.select("sample_id", F.col("ly").alias("y"), "fold")
    return reread(gram.stack(p.unionByName(more(p)) if more else p, rows, COLUMNS, resampled=more is not None), [])


# Normal equations of two predictors, by Cramer's rule; fold -1 is the model of all rows.
WIDE = "d as (select p.sample_id, any_value(f.fold) as fold, any_value(p.y) as y, max(value) filter (producer = 'm:a') as xa, max(value) filter (producer = 'm:b') as xb from pred p join folds f on f.sample_id = p.sample_id group by p.sample_id)"
SUMS = """sums as (select f.range as fold, count(*) as n, avg(xa) as ma, avg(xb) as mb, avg(y) as my, count(*) * var_pop(xa) as saa, count(*) * var_pop(xb) as sbb,
 count(*) * covar_pop(xa, xb) as sab, count(*) * covar_pop(xa, y) as say, count(*) * covar_pop(xb, y) as sby from d, range(-1, 5) f where d.fold <> f.range group by f.range)"""
SOLVED = """solved as (select *, ((sbb + r) * say - sab * sby) / ((saa + r) * (sbb + r) - sab * sab) as ba, ((saa + r) * sby - sab * say) / ((saa + r) * (sbb + r) - sab * sab) as bb from sums, (select {r} as r))"""
BOTH = SOLVED.format(r=RIDGE)


@query("stacked_meta_model", sql("select sample_id, round(my + ba * (xa - ma) + bb * (xb - mb), 6) as value from d join solved using (fold)", SAMPLES, FOLDS, PRED, WIDE, SUMS, BOTH))
def stacked_meta_model(spark, d):
    """A ridge meta-model over the out-of-fold predictions of all producers, itself predicting out of fold."""
    rows = _stacked(spark, d)
    models = gram.fit_folds(gram.fold_moments(rows, "x", ["y"]), gram.ridge(RIDGE))
    return gram.predict(rows, models, "x", ["value"]).select("sample_id", F.round("value", 6).alias("value"))


@query("stacked_meta_weights", sql("select cast(fold as int) as fold, producer, round(weight, 6) as weight from solved, lateral (select 'intercept' as producer, my - ba * ma - bb * mb as weight union all select 'm:a', ba union all select 'm:b', bb)", SAMPLES, FOLDS, PRED, WIDE, SUMS, BOTH))
def stacked_meta_weights(spark, d):
    """The weights of each fold's meta-model, and of the refit on all rows (fold -1)."""
    models = gram.fit_folds(gram.fold_moments(_stacked(spark, d), "x", ["y"]), gram.ridge(RIDGE), refit=True)
    rows = [(m.fold, name, float(w)) for m in models for name, w in [("intercept", m.intercept[0]), *zip((p for p, _ in COLUMNS), m.coef[:, 0])]]
    return spark.createDataFrame(rows, "fold int, producer string, weight double").withColumn("weight", F.round("weight", 6))


REPEATED = "twice as (select * from pred union all select producer, partition, fold_id, sample_id, target_id, group_id, target, value + 0.5, y from pred where producer = 'm:b' and fold_id in ('fold1', 'fold3'))"


@query("stacked_resampled", sql("select sample_id, round(my + ba * (xa - ma) + bb * (xb - mb), 6) as value from d join solved using (fold)", SAMPLES, FOLDS, PRED, REPEATED, WIDE.replace("from pred p", "from (select producer, sample_id, y, avg(value) as value from twice group by all) p"), SUMS, BOTH))
def stacked_resampled(spark, d):
    """Repeated validation rows of a resampled fold set are averaged before stacking; without that mode they are refused."""
    rows = _kept_stack(folded(spark, d), lambda p: p.where("producer = 'm:b' and fold_id in ('fold1', 'fold3')").withColumn("value", F.col("value") + 0.5))
    models = gram.fit_folds(gram.fold_moments(rows, "x", ["y"]), gram.ridge(RIDGE))
    return gram.predict(rows, models, "x", ["value"]).select("sample_id", F.round("value", 6).alias("value"))


PENALTIES = (0, 100, 10_000)
VARIANTS = {f"{name}/{r}": gram.ridge(float(r), cols) for r in PENALTIES for name, cols in (("a", [0]), ("b", [1]), ("ab", [0, 1]))}
CV = f"""solved as (select *, case v when 'b' then 0 when 'a' then say / (saa + r) else ((sbb + r) * say - sab * sby) / ((saa + r) * (sbb + r) - sab * sab) end as ba,
 case v when 'a' then 0 when 'b' then sby / (sbb + r) else ((saa + r) * sby - sab * say) / ((saa + r) * (sbb + r) - sab * sab) end as bb
 from sums, (select unnest([{', '.join(map(str, PENALTIES))}]) as r), (select unnest(['a', 'b', 'ab']) as v)),
e as (select v || '/' || r as variant_id, d.fold, my + ba * (xa - ma) + bb * (xb - mb) - y as e, y from d join solved using (fold))"""


@query("select_variant_by_cv", sql("select variant_id, rmse, cast(row_number() over (order by rmse, variant_id) as int) as rank from (select variant_id, round(sqrt(avg(e * e)), 6) as rmse from e group by variant_id)", SAMPLES, FOLDS, PRED, WIDE, SUMS, CV))
def select_variant_by_cv(spark, d):
    """Every variant fitted on every fold's train rows, scored on its own rows in one pass, and ranked."""
    rows = _stacked(spark, d)
    models = gram.fit_variants(spark, gram.fold_moments(rows, "x", ["y"]), VARIANTS)
    scores = gram.score_variants(rows, models, "x", "y").withColumn("rmse", F.round("rmse", 6))
    ranked = gram.select_by_cv(scores, list(VARIANTS))
    return spark.createDataFrame([(v, s, r) for r, v, s in ranked], "variant_id string, rmse double, rank int")


@query("variant_fold_scores", sql("select variant_id, coalesce('fold' || fold, 'avg') as fold_id, count(*) as n, round(sqrt(avg(e * e)), 6) as rmse, round(avg(abs(e)), 6) as mae, round(1 - sum(e * e) / (var_pop(y) * count(*)), 6) as r2 from e group by grouping sets ((variant_id, fold), (variant_id))", SAMPLES, FOLDS, PRED, WIDE, SUMS, CV))
def variant_fold_scores(spark, d):
    rows = _stacked(spark, d)
    models = gram.fit_variants(spark, gram.fold_moments(rows, "x", ["y"]), VARIANTS)
    return gram.score_variants(rows, models, "x", "y").select("variant_id", "fold_id", "n", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "r2")])


# --- partial least squares over the embeddings


def _vectors(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("y"))
    return rows.join(folds.kfold(rows, 5, id_col="vec_id"), "vec_id")


# By scores of the rows themselves, one component after the other: no cross-products.
PLS = """e as (select vec_id, label::double as y, embedding, (row_number() over (order by vec_id) - 1) % 5 as fold from embeddings),
l as (select vec_id, y, fold, unnest(range(64)) as j, unnest(embedding)::double as x from e),
t as materialized (select f.range as f, l.vec_id, l.y, l.j, l.x from l, range(5) f where l.fold <> f.range),
mu as (select f, j, avg(x) as mx, avg(y) as my from t group by f, j),
c as materialized (select t.f, vec_id, j, x - mx as x, y - my as y from t join mu using (f, j)),
r1 as materialized (select f, j, sum(x * y) as r from c group by f, j),
t1 as materialized (select f, vec_id, sum(x * r) as t, any_value(y) as y from c join r1 using (f, j) group by f, vec_id),
n1 as (select f, sum(t * t) as tt, sum(t * y) as ty from t1 group by f),
p1 as (select f, j, sum(x * t) as p from c join t1 using (f, vec_id) group by f, j),
k1 as (select f, sum(p * r) / sum(p * p) as k from p1 join r1 using (f, j) group by f),
r2 as materialized (select f, j, r - p * k as r from r1 join p1 using (f, j) join k1 using (f)),
n2 as (select f, sum(t * t) as tt, sum(t * y) as ty from (select f, vec_id, sum(x * r) as t, any_value(y) as y from c join r2 using (f, j) group by f, vec_id) group by f),
b as (select r1.f, r1.j, r1.r * n1.ty / n1.tt + r2.r * n2.ty / n2.tt as b from r1 join r2 using (f, j) join n1 using (f) join n2 using (f))"""


@query("ml_pls_oof", sql("select vec_id, round(any_value(my) + sum((x - mx) * b), 6) as value from l join mu on mu.f = l.fold and mu.j = l.j join b on b.f = l.fold and b.j = l.j group by vec_id", PLS))
def ml_pls_oof(spark, d):
    """Out-of-fold predictions of a partial least squares model of two components over all 64 dimensions."""
    rows = _vectors(spark, d)
    models = gram.fit_folds(gram.fold_moments(rows, "x", ["y"]), gram.simpls(2))
    return gram.predict(rows, models, "x", ["value"]).select("vec_id", F.round("value", 6).alias("value"))


@query("ml_pls_coefficients", sql("select cast(f as int) as fold, cast(j as int) as feature, round(b, 6) as coefficient from b", PLS))
def ml_pls_coefficients(spark, d):
    models = gram.fit_folds(gram.fold_moments(_vectors(spark, d), "x", ["y"]), gram.simpls(2))
    rows = [(m.fold, j, float(v)) for m in models for j, v in enumerate(m.coef[:, 0])]
    return spark.createDataFrame(rows, "fold int, feature int, coefficient double").withColumn("coefficient", F.round("coefficient", 6))


@query("ml_pls_components")
def ml_pls_components(spark, d):
    """How many components predict best: variants of one to six, scored on the folds in one pass."""
    rows = _vectors(spark, d)
    variants = {f"pls{k}": gram.simpls(k) for k in range(1, 7)}
    models = gram.fit_variants(spark, gram.fold_moments(rows, "x", ["y"]), variants)
    return gram.score_variants(rows, models, "x", "y").select("variant_id", "fold_id", "n", F.round("rmse", 6).alias("rmse"), F.round("r2", 6).alias("r2"))


@query("ml_pls_da")
def ml_pls_da(spark, d):
    """Classes by partial least squares on one indicator for each label; the largest prediction wins, ties by label."""
    rows = _vectors(spark, d)
    return gram.pls_da(rows, "x", "y", 4).select("vec_id", F.col("y").cast("int").alias("label"), F.col("predicted").cast("int").alias("predicted"))


# --- resampled and supplied fold sets

SHUFFLED = "shuffled as (select f.range as f, sample_id, row_number() over (partition by f.range order by sha256('5:' || f.range || ':' || sample_id), sample_id) as i, count(*) over (partition by f.range) as n from samples, range(3) f)"


@query("split_shuffle", sql("select 'fold' || f as fold_id, sample_id, case when i <= floor(0.3 * n) then 'validation' else 'train' end as role from shuffled", SAMPLES, SHUFFLED))
def split_shuffle(spark, d):
    return folds.shuffle_split(reread(samples(spark, d).select("sample_id"), []), 3, 0.3, 5)


DRAWN = """placed as (select sample_id, row_number() over (order by sample_id) - 1 as pos, count(*) over () as n from samples),
times as (select f.range as f, ('0x' || substr(sha256('11:' || f.range || ':' || i.pos), 1, 13))::bigint % i.n as pos, count(*) as times from placed i, range(3) f group by all),
boot as (select 'fold' || f.range as fold_id, f.range as f, sample_id, case when times is null then 'validation' else 'train' end as role, coalesce(times, 1) as times from placed cross join range(3) f left join times t on t.f = f.range and t.pos = placed.pos)"""


@query("split_bootstrap", sql("select fold_id, sample_id, role, times from boot", SAMPLES, DRAWN))
def split_bootstrap(spark, d):
    return folds.bootstrap(samples(spark, d), 3, 11)


@query("resampled_oof", sql(""", d as (select sample_id, max(value) filter (producer = 'm:a') as xa, max(value) filter (producer = 'm:b') as xb, any_value(y) as y from pred group by sample_id),
 often as (select b.f, d.* from d join boot b using (sample_id), range(50) r where role = 'train' and r.range < times),
 sums as (select f as fold, count(*) as n, avg(xa) as ma, avg(xb) as mb, avg(y) as my, count(*) * var_pop(xa) as saa, count(*) * var_pop(xb) as sbb, count(*) * covar_pop(xa, xb) as sab, count(*) * covar_pop(xa, y) as say, count(*) * covar_pop(xb, y) as sby from often group by f),
 """ + BOTH + """, v as (select sample_id, my + ba * (xa - ma) + bb * (xb - mb) as value from boot b join d using (sample_id) join solved on solved.fold = b.f where role = 'validation')
 select s.sample_id, round(avg(value), 6) as value, count(value) as n from samples s left join v using (sample_id) group by s.sample_id""", SAMPLES, FOLDS, PRED, DRAWN))
def resampled_oof(spark, d):
    """Ridge models trained on bootstrap draws; each sample has the mean of the models that never drew it."""
    s = folded(spark, d)
    rows, members = _kept_stack(s), folds.supplied(reread(folds.bootstrap(s, 3, 11), []), s, partitioned=False)
    models = gram.fit_folds(gram.resampled_moments(rows, members, "x", ["y"]), gram.ridge(RIDGE))
    return gram.resampled_oof(rows, members, models, "x").withColumn("value", F.round("value", 6))


SUPPLIED = """given as (select case when fold_id = 'fold2' then null else fold_id end as fold_id, sample_id, case when sample_id like '%3' and fold_id = 'fold1' then 'test' else role end as role from members where not (fold_id = 'fold3' and role = 'validation'))"""


@query("supplied_fold_violations", sql(""", u as (select 'role' as rule, fold_id, sample_id from given where role = 'test' union all select 'null', fold_id, sample_id from given where fold_id is null
 union all select 'empty', fold_id, null from given group by fold_id having count(*) filter (role = 'validation') = 0 or count(*) filter (role = 'train') = 0
 union all select 'overlap', fold_id, sample_id from given group by fold_id, sample_id having count(distinct role) > 1
 union all select 'validated', null, s.sample_id from samples s left join given g on g.sample_id = s.sample_id and g.role = 'validation' group by s.sample_id having count(g.sample_id) <> 1
 union all select 'group', fold_id, group_id from given join samples using (sample_id) group by fold_id, group_id having count(distinct role) > 1) select rule, fold_id, sample_id from u""", SAMPLES, FOLDS, MEMBERS, SUPPLIED))
def supplied_fold_violations(spark, d):
    m = membership(spark, d).where("not (fold_id = 'fold3' and role = 'validation')")
    given = m.select(
        F.when(F.col("fold_id") != "fold2", F.col("fold_id")).alias("fold_id"), "sample_id",
        F.when(F.col("sample_id").endswith("3") & (F.col("fold_id") == "fold1"), "test").otherwise(F.col("role")).alias("role"),
    )
    return folds.supplied_violations(given, samples(spark, d), True, samples(spark, d).select("sample_id", "group_id"))


# --- feature selection by fold

SCORES = "score as (select x.range as fold, j, corr(l.x, l.y) ** 2 as score from l, range(-1, 5) x where l.fold <> x.range group by x.range, j), best as (select fold, j, score, row_number() over (partition by fold order by score desc, j) <= 10 as kept from score)"


@query("feature_selection", sql("select cast(fold as int) as fold, list(kept order by j)::varchar as mask, round(max(score), 6) as top_score from best group by fold", PLS, SCORES))
def feature_selection(spark, d):
    """The ten best of 64 features for each fold by its own train rows, and for the refit (fold -1), as masks."""
    found = gram.selected_features(gram.fold_moments(_vectors(spark, d), "x", ["y"]), 10)
    rows = [(f, "[" + ", ".join(str(k).lower() for k in mask) + "]", max(score)) for f, score, mask in found]
    return spark.createDataFrame(rows, "fold int, mask string, top_score double").withColumn("top_score", F.round("top_score", 6))


@query("feature_selection_oof")
def feature_selection_oof(spark, d):
    """Out-of-fold predictions of least squares on each fold's own selection."""
    rows = _vectors(spark, d)
    models = gram.masked(lambda columns: gram.ridge(0.0, columns), gram.fold_moments(rows, "x", ["y"]), 10)
    return gram.predict(rows, [m for m in models if m.fold != gram.ALL], "x", ["value"]).select("vec_id", F.round("value", 6).alias("value"))


# --- the domain of the training rows

H = "1.0 / n + (sbb * (xa - ma) ** 2 - 2 * sab * (xa - ma) * (xb - mb) + saa * (xb - mb) ** 2) / (saa * sbb - sab * sab)"
LEVERAGE = f"lev as (select sample_id, xa, xb, {H} as h, 9.0 / n as threshold from d join sums using (fold) where fold = 4)"


def _leverage(spark, d):
    rows = _stacked(spark, d)
    return domain.leverage(rows.where("fold = 4"), gram.fold_moments(rows, "x", ["y"]).train(4))


@query("domain_leverage", sql("select sample_id, round(h, 10) as score, round(threshold, 10) as threshold, cast(h <= threshold as int) as supported from lev", SAMPLES, FOLDS, PRED, WIDE, SUMS, LEVERAGE))
def domain_leverage(spark, d):
    m = F.col("leverage")
    return _leverage(spark, d).select("sample_id", F.round(m["score"], 10).alias("score"), F.round(m["threshold"], 10).alias("threshold"), m["supported"].cast("int").alias("supported"))


@query("decision_operators", sql("""select sample_id, case when xb > 13.5 then 'reject' when h > threshold or sample_id in ('S000000005', 'S000000010') then 'refer' else 'accept' end as decision,
 array_to_string(case when h <= threshold and xb <= 13.5 and sample_id not in ('S000000005', 'S000000010') then ['all_thresholds_hold'] else list_filter([case when h > threshold then 'domain' end, case when xb > 13.5 then 'high' end, case when sample_id in ('S000000005', 'S000000010') then 'listed' end], lambda r: r is not null) end, ',') as reasons from lev""", SAMPLES, FOLDS, PRED, WIDE, SUMS, LEVERAGE))
def decision_operators(spark, d):
    """Accept, refer or reject by domain support, a number and a list of ids."""
    rows = domain.assess(_leverage(spark, d).withColumn("xb", F.col("x")[1]), ["leverage"])
    rules = [domain.Threshold("domain", "status", "not_in", ["out_of_support"]), domain.Threshold("high", "xb", "lte", 13.5, "reject"), domain.Threshold("listed", "sample_id", "not_in", ["S000000005", "S000000010"])]
    return domain.decide(rows, rules).select("sample_id", "decision", F.concat_ws(",", "reasons").alias("reasons"))


@query("domain_assessment")
def domain_assessment(spark, d):
    """Embeddings of the largest label against those of all others: leverage and cross-fitted density ratio, in three states."""
    rows = _vectors(spark, d).withColumn("is_test", (F.col("y") == 7).cast("int"))
    count = {r.is_test: r["count"] for r in rows.groupBy("is_test").count().collect()}
    moments = gram.fold_moments(rows, "x", ["y"])
    train = gram.fold_moments(rows.where("is_test = 0"), "x", ["y"]).train()
    models = domain.separating_models(rows, "x", moments)
    scored = domain.density_ratio(domain.leverage(rows, train), "x", moments, models, count.get(0, 1), max(1, count.get(1, 1)), 10.0)
    return domain.assess(scored, ["leverage", "density_ratio"]).select("vec_id", "is_test", "status")


# --- robustness: kinds and modes

@query("robust_axis_shift", """with e as (select vec_id, embedding::double[] as x from embeddings), l as (select vec_id, x, s.s, i, least(greatest(i + s.s, 0.0), 63.0)::double as p from e, (values (0.0), (0.5), (2.25)) s(s), range(64) r(i)),
 m as (select vec_id, s, i, x[floor(p)::int + 1] * (1 - (p - floor(p))) + case when p > floor(p) then x[floor(p)::int + 2] * (p - floor(p)) else 0 end as v from l)
 select vec_id, s::double as severity, round(sum(v * (i + 1)), 6) as moment, round(max(v) filter (i = 63), 6) as last from m group by vec_id, s""")
def robust_axis_shift(spark, d):
    """Each vector with its axis moved by none, half and two and a quarter steps."""
    rows = robust.perturbed(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x")), "ordered_axis_shift", (0.0, 0.5, 2.25), id_col="vec_id")
    moment = F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rows.select("vec_id", "severity", F.round(moment, 6).alias("moment"), F.round(F.element_at("x", -1), 6).alias("last"))


def _roles(spark, d):
    role = F.when(F.col("fold") == 4, "test").when(F.col("fold") == 3, "calibration").otherwise("train")
    return _vectors(spark, d).withColumn("role", role)


@query("robust_modes")
def robust_modes(spark, d):
    """A model of all embeddings under a shifted axis, frozen and recalibrated, and with three features replaced, refitted."""
    rows, fit = _roles(spark, d), gram.ridge(1.0)
    parts = [
        robust.scenario(rows, kind, (0.0, 0.5, 1.0), mode, fit, nodes=nodes, id_col="vec_id").withColumn("mode", F.lit(mode))
        for kind, mode, nodes in (("ordered_axis_shift", "clean_frozen", ()), ("ordered_axis_shift", "matched_recalibration", ()), ("node_replacement", "structural_refit", (0, 1, 2)))
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("mode", "severity", "n", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "radius", "coverage")], "refit", "recalibrated")
