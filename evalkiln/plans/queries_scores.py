"""Queries over scores: metrics, selection, conformal intervals, chains, robustness."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalkiln.functions import counter_rng, scalars
from evalkiln.operators import chains, conformal, metrics, robust, select
from evalkiln.plans.prelude import FOLDS, PRED, SAMPLES, sql
from evalkiln.plans.registry import query
from evalkiln.sources.testdata import fold_of, predictions, samples, table

BY_FOLD = "group by producer, fold_id"


def _scored(spark, d):
    return metrics.report(predictions(spark, d), ["producer", "fold_id"])


for _name, _sql in (("mse", "round(avg((value - y) * (value - y)), 8)"), ("rmse", "round(sqrt(avg((value - y) * (value - y))), 8)"), ("mae", "round(avg(abs(value - y)), 8)")):
    @query(f"metric_{_name}", sql(f"select producer, fold_id, count(*) as n, {_sql} as {_name} from pred {BY_FOLD}", SAMPLES, FOLDS, PRED))
    def metric(spark, d, name=_name):
        return _scored(spark, d).select("producer", "fold_id", "n", F.round(name, 8).alias(name))


R2 = "select producer, fold_id, round(1 - sum((value - y) * (value - y)) / sum((y - ym) * (y - ym)), 8) as r2 from (select *, avg(y) over (partition by producer, fold_id) as ym from pred) group by producer, fold_id"


@query("metric_r2", sql(R2, SAMPLES, FOLDS, PRED))
def metric_r2(spark, d):
    return _scored(spark, d).select("producer", "fold_id", F.round("r2", 8).alias("r2"))


LABELS = "lab as (select sample_id, label::double as y, ((label + case when k % 4 = 0 then 1 else 0 end) % 3)::double as value, segment from samples)"


def _labels(spark, d):
    guess = (F.col("label") + F.when(F.col("k") % 4 == 0, 1).otherwise(0)) % 3
    return samples(spark, d).select("sample_id", F.col("label").cast("double").alias("y"), guess.cast("double").alias("value"), "segment")


@query("metric_accuracy", sql("select segment, count(*) as n, round(avg((abs(value - y) < 0.5)::int), 8) as accuracy from lab group by segment", SAMPLES, LABELS))
def metric_accuracy(spark, d):
    return metrics.accuracy(_labels(spark, d), ["segment"]).withColumn("accuracy", F.round("accuracy", 8))


@query("metric_balanced_accuracy", sql("select segment, count(*) as n_classes, round(avg(r), 8) as balanced_accuracy from (select segment, y, avg((abs(value - y) < 0.5)::int) as r from lab group by segment, y) group by segment", SAMPLES, LABELS))
def metric_balanced_accuracy(spark, d):
    return metrics.balanced_accuracy(_labels(spark, d), ["segment"]).withColumn("balanced_accuracy", F.round("balanced_accuracy", 8))


@query("metric_report_long", sql(f", s as (select producer, fold_id, round(sqrt(avg((value - y) * (value - y))), 8) as rmse, round(avg(abs(value - y)), 8) as mae from pred {BY_FOLD}) select producer, fold_id, 'rmse' as metric, rmse as value from s union all select producer, fold_id, 'mae', mae from s", SAMPLES, FOLDS, PRED))
def metric_report_long(spark, d):
    return metrics.long_form(_scored(spark, d).select("producer", "fold_id", F.round("rmse", 8).alias("rmse"), F.round("mae", 8).alias("mae")), ["producer", "fold_id"], ["rmse", "mae"])


@query("metric_cross_fold_avg", sql(", p as (select producer, sample_id, y, avg(value) as value from (select * from pred union all select * from pred where fold_id = 'fold0') group by all) select producer, 'avg' as fold_id, count(*) as n, round(sqrt(avg((value - y) * (value - y))), 8) as rmse, round(avg(abs(value - y)), 8) as mae from p group by producer", SAMPLES, FOLDS, PRED))
def metric_cross_fold_avg(spark, d):
    p = predictions(spark, d)
    pooled = metrics.pooled(p.unionByName(p.where("fold_id = 'fold0'")), ["producer"])
    return metrics.report(pooled, ["producer"], ("rmse", "mae")).select("producer", F.lit("avg").alias("fold_id"), "n", F.round("rmse", 8).alias("rmse"), F.round("mae", 8).alias("mae"))


@query("metric_across_targets", sql(", t as (select 'y' as target, value, y from pred where producer = 'm:a' union all select 'half', value, y / 2 from pred where producer = 'm:a'), s as (select target, sqrt(avg((value - y) * (value - y))) as rmse from t group by target) select 'm:a' as producer, round(avg(rmse), 8) as rmse from s", SAMPLES, FOLDS, PRED))
def metric_across_targets(spark, d):
    p = predictions(spark, d).where("producer = 'm:a'")
    both = p.unionByName(p.withColumn("target", F.lit("half")).withColumn("y", F.col("y") / 2))
    return metrics.across_targets(metrics.report(both, ["producer", "target"], ("rmse",)), ["producer"], ["rmse"]).withColumn("rmse", F.round("rmse", 8))


@query("score_set", sql("select producer, fold_id from pred group by all having count(*) > 1 and producer = 'm:a' and fold_id in ('fold0', 'fold1')", SAMPLES, FOLDS, PRED))
def score_set(spark, d):
    s = _scored(spark, d).select("producer", "fold_id")
    return metrics.score_violations(s.unionByName(s.where("producer = 'm:a' and fold_id in ('fold0', 'fold1')")), ["producer", "fold_id"])


@query("metric_reduce", sql(f", s as (select producer, count(*) as n, avg(abs(value - y)) as value from pred {BY_FOLD}) select producer, round(avg(value), 8) as mean, round(sum(value), 8) as sum, round(sum(value * n) / sum(n), 8) as weighted_mean from s group by producer", SAMPLES, FOLDS, PRED))
def metric_reduce(spark, d):
    s = _scored(spark, d).select("producer", "n", F.col("mae").alias("value"))
    parts = [metrics.reduce_scores(s, ["producer"], how).select("producer", F.round("value", 8).alias(how)) for how in ("mean", "sum", "weighted_mean")]
    return parts[0].join(parts[1], "producer").join(parts[2], "producer")


@query("metric_custom", sql("select producer, fold_id, round(max(abs(value - y)), 8) as value from pred group by all", SAMPLES, FOLDS, PRED))
def metric_custom(spark, d):
    return metrics.custom_metric(predictions(spark, d), ["producer", "fold_id"], lambda p, y: (p - y).abs().max()).withColumn("value", F.round("value", 8))


LOSS = "loss as (select segment, case when label = 0 then 1.0 else 0.0 end::double as y, ((k % 9) + 1) / 10.0 as p from samples)"


def _loss(spark, d):
    return samples(spark, d).select("segment", F.when(F.col("label") == 0, 1.0).otherwise(0.0).alias("y"), (((F.col("k") % 9) + 1) / 10.0).alias("p"))


@query("loss_mse", sql("select segment, round(avg((p - y) * (p - y)), 8) as mse from loss group by segment", SAMPLES, LOSS))
def loss_mse(spark, d):
    return metrics.losses(_loss(spark, d), ["segment"]).select("segment", F.round("mse", 8).alias("mse"))


@query("loss_bce", sql("select segment, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 8) as bce from loss group by segment", SAMPLES, LOSS))
def loss_bce(spark, d):
    return metrics.losses(_loss(spark, d), ["segment"]).select("segment", F.round("bce", 8).alias("bce"))


@query("loss_scce", sql("select segment, round(avg(-ln(case label when 0 then 0.5 when 1 then 0.3 else 0.2 end)), 8) as scce from samples group by segment", SAMPLES))
def loss_scce(spark, d):
    p = F.when(F.col("label") == 0, 0.5).when(F.col("label") == 1, 0.3).otherwise(0.2)
    return samples(spark, d).groupBy("segment").agg(F.round(F.avg(-F.ln(p)), 8).alias("scce"))


# --- selection

CAND = "cand as (select segment || '/' || priority as candidate_id, segment as group_id, round(avg(y), 8) as value from samples group by segment, priority)"


def _candidates(spark, d):
    return samples(spark, d).groupBy(F.concat_ws("/", "segment", "priority").alias("candidate_id"), F.col("segment").alias("group_id")).agg(F.round(F.avg("y"), 8).alias("value"))


@query("select_rank", sql("select candidate_id, value, cast(row_number() over (order by value, candidate_id) as int) as rank from cand", SAMPLES, CAND))
def select_rank(spark, d):
    return select.rank(_candidates(spark, d)).select("candidate_id", "value", "rank")


@query("select_groups", sql("select group_id, candidate_id, cast(row_number() over (partition by group_id order by value desc, candidate_id) as int) as rank from cand", SAMPLES, CAND))
def select_groups(spark, d):
    return select.rank(_candidates(spark, d), False, "group_id").select("group_id", "candidate_id", "rank")


@query("select_best", sql("select group_id, candidate_id, value from (select *, row_number() over (partition by group_id order by value, candidate_id) as r from cand) where r = 1", SAMPLES, CAND))
def select_best(spark, d):
    return select.top_k(_candidates(spark, d), 1, True, "group_id").select("group_id", "candidate_id", "value")


@query("select_top_k", sql("select group_id, candidate_id, cast(r as int) as rank from (select *, row_number() over (partition by group_id order by value, candidate_id) as r from cand) where r <= 3", SAMPLES, CAND))
def select_top_k(spark, d):
    return select.top_k(_candidates(spark, d), 3, True, "group_id").select("group_id", "candidate_id", "rank")


@query("select_violations", sql("select candidate_id, 'not_finite' as problem from cand where candidate_id like '%1-URGENT'", SAMPLES, CAND))
def select_violations(spark, d):
    c = _candidates(spark, d).withColumn("value", F.when(F.col("candidate_id").endswith("1-URGENT"), float("nan")).otherwise(F.col("value")))
    return select.candidate_violations(c)


@query("select_variant", sql(", v as (select producer || '*' || scale as variant_id, scale * value as value, y from pred, (values (0.9), (1.0), (1.1)) s(scale)), r as (select variant_id, round(sqrt(avg((value - y) * (value - y))), 8) as rmse from v group by variant_id) select variant_id, rmse, cast(row_number() over (order by rmse, variant_id) as int) as rank from r", SAMPLES, FOLDS, PRED))
def select_variant(spark, d):
    p = predictions(spark, d).withColumn("scale", F.explode(F.array(F.lit(0.9), F.lit(1.0), F.lit(1.1))))
    rows = p.select(F.concat(F.col("producer"), F.lit("*"), F.col("scale").cast("string")).alias("candidate_id"), (F.col("scale") * F.col("value")).alias("value"), "y")
    scores = metrics.report(rows, ["candidate_id"], ("rmse",)).select("candidate_id", F.round("rmse", 8).alias("value"))
    return select.rank(scores).select(F.col("candidate_id").alias("variant_id"), F.col("value").alias("rmse"), "rank")


@query("select_refit_ensemble", sql("select sample_id, round(avg(value), 8) as value, count(*) as n from pred group by sample_id", SAMPLES, FOLDS, PRED))
def select_refit_ensemble(spark, d):
    p = predictions(spark, d)
    scores = metrics.report(p, ["producer"], ("rmse",)).select(F.col("producer").alias("candidate_id"), F.col("rmse").alias("value"))
    return select.refit_ensemble(p, select.rank(scores), 2).withColumn("value", F.round("value", 8))


@query("early_stop_best", sql(", c as (select producer, cast(substr(fold_id, 5) as int) as iteration, round(avg(abs(value - y)), 8) as loss from pred group by all) select producer, arg_min(iteration, loss) as best_iteration, min(loss) as loss from c group by producer", SAMPLES, FOLDS, PRED))
def early_stop_best(spark, d):
    curve = _scored(spark, d).select("producer", F.substring("fold_id", 5, 9).cast("int").alias("iteration"), F.round("mae", 8).alias("loss"))
    return curve.groupBy("producer").agg(F.min_by("iteration", "loss").alias("best_iteration"), F.min("loss").alias("loss"))


# --- conformal

RES = "res as (select case when label = 2 then 'y2' else 'y1' end as target, sample_id, abs(value - pred.y) as residual, value, pred.y as y, fold_id, pred.group_id from pred join samples using (sample_id) where producer = 'm:a')"
COVER = "cov as (select * from (values (0.07, 7), (0.5, 50), (0.9, 90), (0.95, 95)) c(coverage, pct))"
RADII = "radii as (select target, coverage, rank, max(case when i = rank then residual end) as radius from (select r.target, c.coverage::double as coverage, ((n + 1) * pct + 99) // 100 as rank, i, residual from (select *, row_number() over (partition by target order by residual) as i, count(*) over (partition by target) as n from res where fold_id <> 'fold4') r, cov c) group by all)"
WANTED = (0.07, 0.5, 0.9, 0.95)


def _residuals(spark, d):
    p = predictions(spark, d).where("producer = 'm:a'").join(samples(spark, d).select("sample_id", "label"), "sample_id")
    return p.select(F.when(F.col("label") == 2, "y2").otherwise("y1").alias("target"), "sample_id", F.abs(F.col("value") - F.col("y")).alias("residual"), "value", "y", "fold_id", "group_id")


def _radii(spark, d):
    return conformal.quantiles(_residuals(spark, d).where("fold_id <> 'fold4'"), conformal.coverages(spark, WANTED))


@query("conformal_rank", "select n, coverage::double as coverage, ((n + 1) * pct + 99) // 100 as rank from (select count(*) as n from orders union all select 99 union all select 9 union all select 19), (values (0.07, 7), (0.5, 50), (0.9, 90), (0.95, 95)) c(coverage, pct)")
def conformal_rank(spark, d):
    n = table(spark, d, "orders").agg(F.count("*").alias("n")).union(spark.createDataFrame([(99,), (9,), (19,)], "n bigint"))
    return n.crossJoin(conformal.coverages(spark, WANTED)).select("n", "coverage", scalars.conformal_rank(F.col("n"), F.col("coverage")).alias("rank"))


@query("conformal_quantiles_marginal", sql("select target, coverage, rank::bigint as rank, round(radius, 8) as radius from radii", SAMPLES, FOLDS, PRED, RES, COVER, RADII))
def conformal_quantiles_marginal(spark, d):
    return _radii(spark, d).withColumn("radius", F.round("radius", 8))


@query("conformal_quantiles_joint", sql(", j as (select sample_id, max(abs(value - y)) as residual from pred group by sample_id), o as (select *, row_number() over (order by residual) as i, count(*) over () as n from j) select '*' as target, coverage::double as coverage, (((n + 1) * pct + 99) // 100)::bigint as rank, round(max(case when i = ((n + 1) * pct + 99) // 100 then residual end), 8) as radius from o, cov group by coverage, ((n + 1) * pct + 99) // 100", SAMPLES, FOLDS, PRED, COVER))
def conformal_quantiles_joint(spark, d):
    r = predictions(spark, d).select("sample_id", F.abs(F.col("value") - F.col("y")).alias("residual"))
    return conformal.quantiles(conformal.joint_max(r), conformal.coverages(spark, WANTED)).withColumn("radius", F.round("radius", 8))


APPLIED = "applied as (select res.*, coverage, value - radius as lower, value + radius as upper from res join radii using (target) where fold_id = 'fold4')"


@query("conformal_intervals", sql("select sample_id, coverage, round(lower, 8) as lower, round(upper, 8) as upper, round(lower / 2 + upper / 2, 8) as mid from applied", SAMPLES, FOLDS, PRED, RES, COVER, RADII, APPLIED))
def conformal_intervals(spark, d):
    out = conformal.apply(_residuals(spark, d).where("fold_id = 'fold4'").drop("residual"), _radii(spark, d))
    return out.select("sample_id", "coverage", F.round("lower", 8).alias("lower"), F.round("upper", 8).alias("upper"), F.round(scalars.midpoint(F.col("lower"), F.col("upper")), 8).alias("mid"))


BOUNDED = "case when count(*) = count(upper - lower) then"
SCORED = f"count(*) as n, round(avg(case when y between lower and upper then 1.0 else 0.0 end), 8) as empirical, {BOUNDED} round(avg(upper - lower), 8) end as mean_width, {BOUNDED} round(avg(upper - lower + 2.0 / (1 - coverage) * case when y < lower then lower - y when y > upper then y - upper else 0 end), 8) end as winkler"


def _interval_metrics(spark, d, *keys):
    out = conformal.apply(_residuals(spark, d).where("fold_id = 'fold4'").drop("residual"), _radii(spark, d))
    m = conformal.metrics(out, keys)
    return m.select(*keys, "n", F.round("empirical", 8).alias("empirical"), F.round("mean_width", 8).alias("mean_width"), F.round("winkler", 8).alias("winkler"))


@query("conformal_metrics", sql(f"select target, coverage, {SCORED} from applied group by target, coverage", SAMPLES, FOLDS, PRED, RES, COVER, RADII, APPLIED))
def conformal_metrics(spark, d):
    return _interval_metrics(spark, d, "target", "coverage")


@query("conformal_metrics_by_group", sql(f"select group_id, coverage, {SCORED} from applied group by group_id, coverage", SAMPLES, FOLDS, PRED, RES, COVER, RADII, APPLIED))
def conformal_metrics_by_group(spark, d):
    return _interval_metrics(spark, d, "group_id", "coverage")


@query("conformal_fit_apply", sql("select target, coverage, count(*) as n, count(*) filter (y between lower and upper) as inside from applied group by target, coverage", SAMPLES, FOLDS, PRED, RES, COVER, RADII, APPLIED))
def conformal_fit_apply(spark, d):
    out = conformal.apply(_residuals(spark, d).where("fold_id = 'fold4'").drop("residual"), _radii(spark, d))
    return out.groupBy("target", "coverage").agg(F.count("*").alias("n"), F.count_if((F.col("y") >= F.col("lower")) & (F.col("y") <= F.col("upper"))).alias("inside"))


@query("cohort_disjoint", sql("select sample_id from folds where fold = 3 and sample_id like '%5'", SAMPLES, FOLDS))
def cohort_disjoint(spark, d):
    f = fold_of(spark, d)
    return conformal.cohort_overlap(f.where("fold = 3").select("sample_id"), f.where("fold <> 3 or endswith(sample_id, '5')").select("sample_id"))


# --- chains

CH = "ch as (select event_id as id, event_type as dataset, value as score from events)"


def _chains(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("dataset"), F.col("value").alias("score"))


RANKED = "select id, dataset, case when n = 1 then 0.5 else (lower + (ties - 1) / 2.0) / (n - 1) end as goodness from (select id, dataset, rank() over (partition by dataset order by -score) - 1 as lower, count(*) over (partition by dataset, score) as ties, count(*) over (partition by dataset) as n from ch)"


@query("chain_rank_by_dataset", sql(f"select id, dataset, round(goodness, 8) as goodness from ({RANKED})", CH))
def chain_rank_by_dataset(spark, d):
    return chains.chain_effect(_chains(spark, d), "rank_by_dataset", True).select("id", "dataset", F.round("goodness", 8).alias("goodness"))


@query("chain_z_by_dataset", sql("select id, dataset, round(coalesce((score - avg(score) over w) / nullif(stddev_samp(score) over w, 0), 0), 6) as goodness from ch window w as (partition by dataset)", CH))
def chain_z_by_dataset(spark, d):
    return chains.chain_effect(_chains(spark, d), "z_by_dataset", False).select("id", "dataset", F.round("goodness", 6).alias("goodness"))


@query("chain_raw", sql("select id, dataset, round(-score, 6) as goodness from ch", CH))
def chain_raw(spark, d):
    return chains.chain_effect(_chains(spark, d), "raw", True).select("id", "dataset", F.round("goodness", 6).alias("goodness"))


@query("chain_baseline", sql(f"select round(median(goodness), 8) as baseline, count(*) as n from ({RANKED})", CH))
def chain_baseline(spark, d):
    return chains.baseline(chains.chain_effect(_chains(spark, d), "rank_by_dataset", True)).select(F.round("baseline", 8).alias("baseline"), "n")


@query("chain_step_effects", sql(f", g as ({RANKED}), s as (select id, 'user' || (user_id % 7) as token, 'model' as role from events join (select event_id as id from events) x on x.id = event_id union select event_id, 'even', 'preprocessing' from events where event_id % 2 = 0) select token, role, count(*) as n, round(avg(goodness) - (select median(goodness) from g), 8) as effect from g join s using (id) group by token, role", CH))
def chain_step_effects(spark, d):
    step = lambda token, role: F.struct(token.alias("token"), token.alias("label"), F.lit(role).alias("role"))
    own = F.array(step(F.concat(F.lit("user"), (F.col("user_id") % 7).cast("string")), "model"))
    steps = F.when(F.col("event_id") % 2 == 0, F.concat(own, F.array(step(F.lit("even"), "preprocessing")))).otherwise(own)
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("dataset"), F.col("value").alias("score"), steps.alias("steps"))
    return chains.step_effects(chains.chain_effect(rows, "rank_by_dataset", True)).withColumn("effect", F.round("effect", 8))


KINDS = "transform y_transform split model augmentation feature_join source_join fork map prediction_join mixed_join tag exclude adapter aggregator generator restructure tuner subgraph chart".split()


LISTED = "list_value(" + ", ".join(f"'{k}'" for k in KINDS) + ")"


@query("chain_roles", f"select event_id, case when kind = 'transform' then 'preprocessing' when kind = 'y_transform' then 'target' when kind in ('split', 'model', 'augmentation') then kind when kind in ('feature_join', 'source_join') then 'feature' else 'other' end as role from (select event_id, ({LISTED})[event_id % {len(KINDS)} + 1] as kind from events)")
def chain_roles(spark, d):
    """The role of the node that each event is about."""
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("event_id") % len(KINDS)).cast("int"))
    return table(spark, d, "events").select("event_id", scalars.chain_role(kind).alias("role"))


@query("sanitize_label", "select p_name, regexp_replace(regexp_replace(p_type || ' #' || p_brand || '!', '[^A-Za-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g') as label from part")
def sanitize_label(spark, d):
    return table(spark, d, "part").select("p_name", scalars.sanitise_label(F.concat("p_type", F.lit(" #"), "p_brand", F.lit("!"))).alias("label"))


NAMES = {
    "GroupKFold": "split", "StandardScaler": "transform", "RandomForestRegressor": "model", "GridSearchCV": "tuner", "Chart2D": "transform", "chart_2d": "chart", "LinearRegression": "model",
    "Ridge": "model", "SNV": "transform", "sklearn.model_selection.LeaveOneOut": "split", "DataSplitter": "split", "ShuffleFold": "split", "optuna.Study": "tuner", "pkg.charts.Plot": "chart",
    "sklearn.model_selection.GridSearchCV": "tuner", "xgboost.XGBRanker": "model", "sklearn.svm.NuSVC": "model", "a.b:PLS": "model", "operators.splitters.Custom": "split", "MetaModel": "model", "plot": "transform",
}


NAMED = "list_value(" + ", ".join(f"'{n}'" for n in NAMES) + ")"
EXPECTED = "list_value(" + ", ".join(f"'{k}'" for k in NAMES.values()) + ")"


@query("alias_kind", f"select event_id, ({NAMED})[event_id % {len(NAMES)} + 1] as name, ({EXPECTED})[event_id % {len(NAMES)} + 1] as kind from events")
def alias_kind(spark, d):
    """The kind of the operator whose class each event names."""
    name = F.get(F.array(*map(F.lit, NAMES)), (F.col("event_id") % len(NAMES)).cast("int"))
    return table(spark, d, "events").select("event_id", name.alias("name")).withColumn("kind", scalars.alias_kind(F.col("name")))


# --- robustness

def _robust(spark, d):
    return predictions(spark, d).where("producer = 'm:a'").select("sample_id", "value", "y", "group_id")


@query("robust_shift", sql("select severity::double as severity, count(*) as n, round(sqrt(avg(pow(value + severity * 100 - y, 2))), 8) as rmse from pred, (values (0), (1), (2)) s(severity) where producer = 'm:a' group by severity", SAMPLES, FOLDS, PRED))
def robust_shift(spark, d):
    rows = robust.severities(_robust(spark, d), "shift", (0, 1, 2))
    return metrics.report(rows, ["severity"], ("rmse",)).select("severity", "n", F.round("rmse", 8).alias("rmse"))


@query("robust_dropout", sql("select severity::double as severity, count(*) as n, round(avg(abs(case when ('0x' || substr(sha256('dropout|' || sample_id), 1, 8))::ubigint / 4294967296.0 < severity then 0 else value end - y)), 8) as mae from pred, (values (0.0), (0.1), (0.5)) s(severity) where producer = 'm:a' group by severity", SAMPLES, FOLDS, PRED))
def robust_dropout(spark, d):
    rows = robust.severities(_robust(spark, d), "dropout", (0.0, 0.1, 0.5))
    return metrics.report(rows, ["severity"], ("mae",)).select("severity", "n", F.round("mae", 8).alias("mae"))


@query("robust_slices", sql(", r as (select value, y, group_id, 'd' || (k % 3) as environment from pred join (select sample_id, k from samples) using (sample_id) where producer = 'm:a') select group_id, environment, count(*) as n, round(sqrt(avg((value - y) * (value - y))), 8) as rmse, round(avg(abs(value - y)), 8) as mae from r group by grouping sets ((), (group_id), (environment))", SAMPLES, FOLDS, PRED))
def robust_slices(spark, d):
    rows = _robust(spark, d).join(samples(spark, d).select("sample_id", F.concat(F.lit("d"), (F.col("k") % 3).cast("string")).alias("environment")), "sample_id")
    return robust.slices(rows, [], ["group_id", "environment"]).select("group_id", "environment", "n", F.round("rmse", 8).alias("rmse"), F.round("mae", 8).alias("mae"))


@query("domain_support", """with e as (select vec_id, embedding[1]::double as f1, embedding[2]::double as f2, label from embeddings), b as (select min(f1) a1, max(f1) b1, min(f2) a2, max(f2) b2 from e where label < 5)
 select vec_id, cast((f1 < a1 or f1 > b1)::int + (f2 < a2 or f2 > b2)::int as int) as n_outside, case when f1 between a1 and b1 and f2 between a2 and b2 then 'in_support' else 'out_of_support' end as state from e, b where label >= 5""")
def domain_support(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("f1"), F.col("embedding")[1].cast("double").alias("f2"), "label")
    return robust.support(e.where("label < 5").select("f1", "f2"), e.where("label >= 5"), ["f1", "f2"]).select("vec_id", "n_outside", "state")


@query("decision_block", sql("select sample_id, case when r < 0.5 then 'accept' when r > 1.5 then 'reject' else 'refer' end as decision from (select sample_id, abs(value - y) as r from pred where producer = 'm:b')", SAMPLES, FOLDS, PRED))
def decision_block(spark, d):
    rows = predictions(spark, d).where("producer = 'm:b'").select("sample_id", F.abs(F.col("value") - F.col("y")).alias("r"))
    return robust.decide(rows, "r", 0.5, 1.5).select("sample_id", "decision")


@query("tcv1", "select c_custkey, upper('41' || printf('%016x', 2) || '53' || printf('%016x', strlen(c_name)) || hex(c_name::blob) || '49' || printf('%016x', length(c_custkey::varchar)) || hex(c_custkey::varchar::blob)) as encoded from customer")
def typed_encoding(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.hex(counter_rng.sequence(counter_rng.text(F.col("c_name")), counter_rng.integer(F.col("c_custkey")))).alias("encoded"))


@query("robustness_rng")
def robustness_rng(spark, d):
    identity = counter_rng.sequence(counter_rng.number(0.5), counter_rng.text(F.col("sample_id")), counter_rng.text(F.lit("global")), counter_rng.integer(F.lit(0)))
    block = counter_rng.philox(counter_rng.counter_words(identity), 42)
    return samples(spark, d).select("sample_id", block.alias("b")).select("sample_id", counter_rng.uniform(F.col("b")).alias("u"))


@query("robust_noise")
def robust_noise(spark, d):
    rows = robust.noisy(_robust(spark, d), (0.0, 0.1, 0.5), seed=7)
    return metrics.report(rows, ["severity"], ("rmse",)).select("severity", "n", F.round("rmse", 8).alias("rmse"))
