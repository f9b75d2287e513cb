"""Queries over relations, views, folds and combinations of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalkiln.functions import hashing, scalars
from evalkiln.operators import combine, folds, identity, views
from evalkiln.plans.prelude import FOLDS, MEMBERS, OBS, SAMPLES, sql
from evalkiln.plans.registry import query
from evalkiln.sources.testdata import fold_of, membership, observations, sample_id, samples, table

IN_FOLD = "select sample_id from folds where fold"
EXCLUDED = "select sample_id from obs group by sample_id having bool_or(excluded)"


@query("scan_observations", sql("select sample_id, observation_id, source_id, rep_id, target_id, group_id, round(v, 8) as v, q from obs", SAMPLES, OBS))
def scan_observations(spark, d):
    return observations(spark, d).select("sample_id", "observation_id", "source_id", "rep_id", "target_id", "group_id", F.round("v", 8).alias("v"), "q")


@query("view_generic", sql(f"select observation_id, round(v, 8) as v from obs where source_id in ('A', 'N') and sample_id in ({IN_FOLD} = 1)", SAMPLES, OBS, FOLDS))
def view_generic(spark, d):
    rows = observations(spark, d).where(F.col("source_id").isin("A", "N"))
    return views.partition_view(rows, fold_of(spark, d), "fold_validation", 1).select("observation_id", F.round("v", 8).alias("v"))


@query("view_fold_train", sql(f"select observation_id, source_id from obs where sample_id in ({IN_FOLD} <> 0) and sample_id not in ({EXCLUDED})", SAMPLES, OBS, FOLDS))
def view_fold_train(spark, d):
    return views.fit_view(observations(spark, d), fold_of(spark, d), 0, ["observation_id", "source_id"])


@query("view_fold_validation", sql(f"select observation_id, source_id, cast(excluded as int) as excluded from obs where sample_id in ({IN_FOLD} = 0)", SAMPLES, OBS, FOLDS))
def view_fold_validation(spark, d):
    return views.partition_view(observations(spark, d), fold_of(spark, d), "fold_validation", 0).select("observation_id", "source_id", F.col("excluded").cast("int").alias("excluded"))


@query("view_full_train", sql("select count(*) as n, count(distinct sample_id) as n_samples from obs where sample_id in (select sample_id from folds where fold < 4)", SAMPLES, OBS, FOLDS))
def view_full_train(spark, d):
    universe = fold_of(spark, d).where("fold < 4")  # fold 4 plays the held-out test set
    return views.partition_view(observations(spark, d), universe, "full_train").agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("n_samples"))


@query("view_predict", sql("select observation_id from obs where sample_id not in (select sample_id from folds where fold < 4)", SAMPLES, OBS, FOLDS))
def view_predict(spark, d):
    return views.partition_view(observations(spark, d), fold_of(spark, d).where("fold < 4"), "predict").select("observation_id")


@query("view_by_source", sql("select observation_id, source_id from obs where source_id = 'R'", SAMPLES, OBS))
def view_by_source(spark, d):
    return views.by_source(observations(spark, d), "R").select("observation_id", "source_id")


@query("view_by_metadata", sql("select observation_id, priority from obs where priority = '1-URGENT'", SAMPLES, OBS))
def view_by_metadata(spark, d):
    rows = observations(spark, d).withColumn("metadata", F.create_map(F.lit("priority"), "priority"))
    return views.by_metadata(rows, "priority", "1-URGENT").select("observation_id", "priority")


@query("view_by_tag", sql("select observation_id from obs where status = 'O' or tag2 = 'bulk'", SAMPLES, OBS))
def view_by_tag(spark, d):
    return views.by_tags(observations(spark, d), "O", "bulk").select("observation_id")


@query("view_by_filter", sql("select observation_id, q from obs where q > 40 and weight > 0.95", SAMPLES, OBS))
def view_by_filter(spark, d):
    return views.by_filter(observations(spark, d), "q > 40 and weight > 0.95").select("observation_id", "q")


@query("view_separation", sql("select observation_id, source_id from obs where source_id = 'A'", SAMPLES, OBS))
def view_separation(spark, d):
    return views.separation(observations(spark, d), source="A", tag="bulk").select("observation_id", "source_id")


POLICY = "case when p_size % 3 = 0 then 'full_train' when p_size % 3 = 1 then 'fold_validation' else 'fold_train' end"


@query("view_policy_refusal", f"select p_partkey, case when {POLICY} in ('full_train', 'fold_validation') and p_brand not in ('Brand#1', 'Brand#2') then 'full_train_fit' when p_type like '%COPPER%' then 'augmented_validation' end as refused from part")
def view_policy_refusal(spark, d):
    """A policy for each part, some with the flag that allows an unsafe fit; what each is refused for."""
    fit = F.when(F.col("p_size") % 3 == 0, "full_train").when(F.col("p_size") % 3 == 1, "fold_validation").otherwise("fold_train")
    unsafe = F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), F.array(F.lit("full_train_fit"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "part").select("p_partkey", fit.alias("fit"), F.col("p_type").contains("COPPER").alias("augmented_validation"), unsafe.alias("unsafe"))
    return rows.select("p_partkey", views.refusal().alias("refused"))


@query("fanout_partition_values", sql("select value, 'branch_' || regexp_replace(regexp_replace(value, '[^A-Za-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g') as branch_id, 1::bigint as n_same_id from (select distinct priority as value from samples)", SAMPLES))
def fanout_partition_values(spark, d):
    return views.fan_out(samples(spark, d), "priority")


@query("rel_effective_unit", sql("select observation_id, case when rep % 3 = 0 then sample_id when rep % 3 = 1 then sample_id || '::' || source_id else observation_id end as unit from obs", SAMPLES, OBS))
def rel_effective_unit(spark, d):
    level = F.when(F.col("rep") % 3 == 0, "physical_sample").when(F.col("rep") % 3 == 1, "source_sample").otherwise("observation")
    unit = identity.effective_unit(level, F.lit(None).cast("string"), F.col("sample_id"), F.col("source_id"), F.col("observation_id"), F.lit(None).cast("string"))
    return observations(spark, d).select("observation_id", unit.alias("unit"))


@query("rel_violations", sql("""select 'repeated_observation' as rule, k as subject from (select 'L' || l_orderkey || ':' || l_linenumber as k from lineitem) group by k having count(*) > 1
 union all select 'weight', 'L' || l_orderkey || ':' || l_linenumber from lineitem where l_discount <= 0"""))
def rel_violations(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("L"), F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")).alias("observation_id"), sample_id("l_orderkey").alias("sample_id"), F.lit("t").alias("target_id"), F.lit("g").alias("group_id"), F.col("l_discount").alias("weight"))
    return identity.relation_violations(rows)


@query("rel_combo_violations", sql(""", combos as (select 'C' || sample_id as combo_id, sample_id, observation_id as a, case rep % 3 when 0 then 'C' || sample_id when 1 then 'O0:0' else observation_id end as b from obs where rep <= 3)
 select distinct combo_id, rule from (
 select combo_id, case when c = combo_id then 'self' when o.sample_id is null then 'missing' when o.sample_id <> x.sample_id then 'other_sample' end as rule
 from (select combo_id, sample_id, a as c from combos union all select combo_id, sample_id, b from combos) x left join obs o on o.observation_id = x.c
 union all select combo_id, 'repeated' from combos where a = b) where rule is not null""", SAMPLES, OBS))
def rel_combo_violations(spark, d):
    obs = observations(spark, d)
    combo = F.concat(F.lit("C"), "sample_id")
    other = F.when(F.col("rep") % 3 == 0, combo).when(F.col("rep") % 3 == 1, F.lit("O0:0")).otherwise(F.col("observation_id"))
    combos = obs.where("rep <= 3").select(combo.alias("combo_id"), "sample_id", F.array("observation_id", other).alias("components"))
    return identity.combo_violations(combos, obs)


@query("rel_obs_to_sample", sql("select observation_id, sample_id, y from obs where rep = 2", SAMPLES, OBS))
def rel_obs_to_sample(spark, d):
    return observations(spark, d).where("rep = 2").select("observation_id", "sample_id").join(samples(spark, d).select("sample_id", "y"), "sample_id")


@query("rel_sample_groups", sql("select sample_id, max(group_id) as group_id, max(target_id) as target_id from obs group by sample_id", SAMPLES, OBS))
def rel_sample_groups(spark, d):
    obs = observations(spark, d)
    return identity.sample_map(obs, "group_id").join(identity.sample_map(obs, "target_id"), "sample_id")


@query("rel_observation_count", sql("select sample_id, count(*) as n from obs group by sample_id", SAMPLES, OBS))
def rel_observation_count(spark, d):
    return observations(spark, d).groupBy("sample_id").agg(F.count("*").alias("n"))


@query("rel_excluded_samples", sql(EXCLUDED, SAMPLES, OBS))
def rel_excluded_samples(spark, d):
    return identity.excluded_samples(observations(spark, d))


@query("rel_fingerprint")
def rel_fingerprint(spark, d):
    return hashing.table_fingerprint(observations(spark, d), "sample_id", "observation_id", "source_id", "target_id", "group_id")


@query("leak_origin", sql(""", origins as materialized (select s.sample_id, o.sample_id as origin from (select sample_id, k + 1 as k from samples where k % 50 = 0) s join samples o using (k)),
 placed as materialized (select sample_id, fold from folds),
 both_ as (select a.sample_id, a.origin, f.fold as own, g.fold as other from origins a join placed f on f.sample_id = a.sample_id join placed g on g.sample_id = a.origin)
 select 'fold' || own as fold_id, sample_id, origin from both_ where own <> other union all select 'fold' || other, sample_id, origin from both_ where own <> other""", SAMPLES, FOLDS, MEMBERS))
def leak_origin(spark, d):
    s = samples(spark, d)
    origins = s.where("k % 50 = 0").select("sample_id", (F.col("k") + 1).alias("k")).join(s.select("k", F.col("sample_id").alias("origin")), "k").select("sample_id", "origin")
    return identity.origin_leaks(membership(spark, d), origins)


@query("leak_group", sql("select fold_id, group_id as unit from members join samples using (sample_id) group by fold_id, group_id having count(distinct role) > 1", SAMPLES, FOLDS, MEMBERS))
def leak_group(spark, d):
    return folds.straddling(membership(spark, d), samples(spark, d), "group_id")


@query("leak_target", sql("select fold_id, target_id as unit from members join samples using (sample_id) group by fold_id, target_id having count(distinct role) > 1", SAMPLES, FOLDS, MEMBERS))
def leak_target(spark, d):
    return folds.straddling(membership(spark, d), samples(spark, d), "target_id")


@query("leak_group_map", sql("select sample_id, group_id, 'G' || (k % 25) as claimed from samples where group_id <> 'G' || (k % 25)", SAMPLES))
def leak_group_map(spark, d):
    s = samples(spark, d)
    claimed = s.select("sample_id", F.concat(F.lit("G"), (F.col("k") % 25).cast("string")).alias("claimed"))
    return s.join(claimed, "sample_id").where("group_id <> claimed").select("sample_id", "group_id", "claimed")


@query("leak_augmented", sql("select observation_id, m.fold_id from obs join members m using (sample_id) where rep > 4 and m.role = 'validation'", SAMPLES, OBS, FOLDS, MEMBERS))
def leak_augmented(spark, d):
    augmented = observations(spark, d).where("rep > 4")  # later repetitions play augmented rows
    return augmented.join(membership(spark, d).where("role = 'validation'"), "sample_id").select("observation_id", "fold_id")


@query("fold_violations", sql(""", bad as (select fold_id, sample_id, role from members where not (fold_id = 'fold0' and sample_id like '%7') union all select 'fold1', sample_id, 'train' from members where fold_id = 'fold1' and role = 'validation' and sample_id like '%1')
 select 'overlap' as rule, fold_id, sample_id from bad group by fold_id, sample_id having count(distinct role) > 1
 union all select 'validated', null, s.sample_id from samples s left join (select sample_id, count(*) as n from bad where role = 'validation' group by sample_id) v using (sample_id) where coalesce(n, 0) <> 1""", SAMPLES, FOLDS, MEMBERS))
def fold_violations(spark, d):
    m = membership(spark, d)
    bad = m.where(~((F.col("fold_id") == "fold0") & F.col("sample_id").endswith("7")))
    twice = m.where((F.col("fold_id") == "fold1") & (F.col("role") == "validation") & F.col("sample_id").endswith("1")).withColumn("role", F.lit("train"))
    return folds.fold_violations(bad.unionByName(twice), samples(spark, d).select("sample_id"))


@query("influence_weights", sql("select observation_id, round(1.0::double / count(*) over (partition by sample_id), 8) as influence from obs where sample_id in (select sample_id from folds where fold <> 0)", SAMPLES, OBS, FOLDS))
def influence_weights(spark, d):
    rows = views.partition_view(observations(spark, d), fold_of(spark, d), "fold_train", 0)
    return identity.influence_weights(rows).select("observation_id", F.round("influence", 8).alias("influence"))


def _seed(seed: int, label: str, ids: str) -> str:
    digest = f"sha256(unhex('{seed.to_bytes(8, 'little').hex()}00') || '{label}'::blob || unhex('FF') || {ids}::blob)"
    return " || ".join(f"substr({digest}, {15 - 2 * i}, 2)" for i in range(8))


@query("influence_resample", sql(f"select sample_id, observation_id from (select *, row_number() over (partition by sample_id order by {_seed(11, 'resample', 'observation_id')}, observation_id) as r from obs) where r = 1", SAMPLES, OBS))
def influence_resample(spark, d):
    return identity.resample_equalised(observations(spark, d), 11).select("sample_id", "observation_id")


@query("merge_target_coverage", sql("select count(*) as n_requested, count(o.sample_id) as n_covered, case when count(o.sample_id) = 0 then 'none' when count(*) = count(o.sample_id) then 'complete' else 'partial' end as state from samples s left join (select distinct sample_id from obs) o using (sample_id)", SAMPLES, OBS))
def merge_target_coverage(spark, d):
    return identity.merge_target_coverage(samples(spark, d), observations(spark, d).select("sample_id").distinct())


@query("id_valid", sql("select c_name, cast(regexp_full_match(c_name, '[A-Za-z0-9_.:\\-]{1,128}') as int) as valid, cast(regexp_full_match(c_mktsegment || ' ' || c_name, '[A-Za-z0-9_.:\\-]{1,128}') as int) as valid_spaced from customer"))
def id_valid(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_name", scalars.id_valid(F.col("c_name")).cast("int").alias("valid"), scalars.id_valid(F.concat_ws(" ", "c_mktsegment", "c_name")).cast("int").alias("valid_spaced"))


@query("influence_closure", sql(""", scope as (select sample_id from folds where fold = 2), hit as (select * from obs where sample_id in (select sample_id from scope))
 select 'group' as kind, group_id as id from hit union select 'target', target_id from hit union select 'missing', sample_id from scope where sample_id not in (select sample_id from obs)""", SAMPLES, OBS, FOLDS))
def influence_closure(spark, d):
    return identity.influence_closure(fold_of(spark, d).where("fold = 2").select("sample_id"), observations(spark, d))


@query("compat_report", sql(""", a as (select sample_id, source_id, count(*) as n from obs where status = 'O' group by all), b as (select sample_id, source_id, count(*) as n from obs where q > 10 group by all)
 select count(*) filter (a.n is null or b.n is null) as sources_differ, count(*) filter (a.n <> b.n) as repetitions_differ, count(distinct case when coalesce(a.n, 0) <> coalesce(b.n, 0) then coalesce(a.sample_id, b.sample_id) end) as samples_affected
 from a full join b on a.sample_id = b.sample_id and a.source_id = b.source_id""", SAMPLES, OBS))
def compat_report(spark, d):
    obs = observations(spark, d)
    return identity.compatibility(obs.where("status = 'O'"), obs.where("q > 10"))


@query("mask_tag", sql("select observation_id, cast(q > 45 as int) as high from obs", SAMPLES, OBS))
def mask_tag(spark, d):
    return views.masks(observations(spark, d), {"high": "q > 45"}, "any").select("observation_id", F.col("high").cast("int").alias("high"))


@query("mask_exclude_any", sql("select observation_id from obs where not (q > 45 or weight < 0.93)", SAMPLES, OBS))
def mask_exclude_any(spark, d):
    return views.masks(observations(spark, d), {"a": "q > 45", "b": "weight < 0.93"}, "any").where("not masked").select("observation_id")


@query("mask_exclude_all", sql("select observation_id from obs where not (q > 45 and weight < 0.93)", SAMPLES, OBS))
def mask_exclude_all(spark, d):
    return views.masks(observations(spark, d), {"a": "q > 45", "b": "weight < 0.93"}, "all").where("not masked").select("observation_id")


# --- folds

@query("split_kfold", sql("select sample_id, cast(fold as int) as fold from folds", SAMPLES, FOLDS))
def split_kfold(spark, d):
    return fold_of(spark, d)


@query("split_kfold_shuffled", sql(f"select sample_id, cast((row_number() over (order by {_seed(42, 'kfold', 'sample_id')}, sample_id) - 1) % 4 as int) as fold from samples", SAMPLES))
def split_kfold_shuffled(spark, d):
    return folds.kfold(samples(spark, d), 4, 42)


@query("split_stratified", sql("select sample_id, cast((row_number() over (order by label, sample_id) - 1) % 5 as int) as fold from samples", SAMPLES))
def split_stratified(spark, d):
    return folds.stratified_kfold(samples(spark, d), 5, "label")


@query("split_group", """with recursive g as (select 'G' || c_nationkey as g, count(*) as n from orders join customer on o_custkey = c_custkey group by 1),
 o as (select g, n, row_number() over (order by n desc, g) as i from g),
 r(i, g, fold, l0, l1, l2, l3) as (select 1::bigint, g, 0, n, 0::bigint, 0::bigint, 0::bigint from o where i = 1
 union all select o.i, o.g, p.fold, l0 + case p.fold when 0 then n else 0 end, l1 + case p.fold when 1 then n else 0 end, l2 + case p.fold when 2 then n else 0 end, l3 + case p.fold when 3 then n else 0 end
 from r join o on o.i = r.i + 1, lateral (select case least(l0, l1, l2, l3) when l0 then 0 when l1 then 1 when l2 then 2 else 3 end as fold) p)
 select 'S' || lpad(cast(o_orderkey as varchar), 9, '0') as sample_id, cast(fold as int) as fold from orders join customer on o_custkey = c_custkey join r on r.g = 'G' || c_nationkey""")
def split_group(spark, d):
    return folds.group_kfold(samples(spark, d), 4)


@query("split_nested_kfold", sql("select fold_id as outer_fold, sample_id, cast((row_number() over (partition by fold_id order by sample_id) - 1) % 3 as int) as inner_fold from members where role = 'train'", SAMPLES, FOLDS, MEMBERS))
def split_nested_kfold(spark, d):
    return folds.nested_kfold(fold_of(spark, d), 5, 3)


NESTED_GROUP = """with recursive s as (select 'S' || lpad(cast(o_orderkey as varchar), 9, '0') as sample_id, 'G' || c_nationkey as g from orders join customer on o_custkey = c_custkey),
 f as (select *, (row_number() over (order by sample_id) - 1) % 3 as fold from s),
 sizes as (select x.range as part, g, count(*) as n from f, range(3) x where f.fold <> x.range group by x.range, g),
 o as (select *, row_number() over (partition by part order by n desc, g) as i from sizes),
 r(part, i, g, fold, l0, l1) as (select part, 1::bigint, g, 0, n, 0::bigint from o where i = 1
 union all select o.part, o.i, o.g, p.fold, l0 + case p.fold when 0 then n else 0 end, l1 + case p.fold when 1 then n else 0 end
 from r join o on o.part = r.part and o.i = r.i + 1, lateral (select case when l0 <= l1 then 0 else 1 end as fold) p)
 select 'fold' || part as outer_fold, sample_id, cast(r.fold as int) as inner_fold from f join r on r.g = f.g and r.part <> f.fold"""


@query("split_nested_group", NESTED_GROUP)
def split_nested_group(spark, d):
    s = samples(spark, d)
    return folds.nested_group_kfold(s.select("sample_id", "group_id"), folds.kfold(s, 3), 3, 2)


@query("split_repeated", sql(" union all ".join(f"select {i} as repeat, sample_id, cast((row_number() over (order by {_seed(s, 'kfold', 'sample_id')}, sample_id) - 1) % 3 as int) as fold from samples" for i, s in enumerate((7, 8))), SAMPLES))
def split_repeated(spark, d):
    return folds.repeated_kfold(samples(spark, d), 3, (7, 8))


@query("fold_fingerprint")
def fold_fingerprint(spark, d):
    return hashing.table_fingerprint(membership(spark, d))


@query("seed_derive", sql(f"select sample_id, {_seed(2**63 + 5, 'fold', 'sample_id')} as seed_hex from samples", SAMPLES))
def seed_derive(spark, d):
    return samples(spark, d).select("sample_id", hashing.seed_key(2**63 + 5, "fold", F.col("sample_id")).alias("seed_hex"))


# --- combinations of sources

PAIR = "select a.sample_id, a.observation_id as o0, b.observation_id as o1 from obs a join obs b on a.sample_id = b.sample_id and a.source_id = 'A' and b.source_id = 'R'"


def _agg_sources(source: str) -> str:
    return f"(select sample_id, avg(v) as v from obs where source_id = '{source}' group by sample_id)"


def _source_means(spark, d, source):
    return views.by_source(observations(spark, d), source).groupBy("sample_id").agg(F.avg("v").alias(f"v_{source}"))


for _how, _join in (("inner", "join"), ("left", "left join"), ("outer", "full join")):
    @query(f"align_{_how}", sql(f"select coalesce(a.sample_id, r.sample_id) as sample_id, round(a.v, 8) as v_a, round(r.v, 8) as v_r, cast(a.sample_id is not null as int) as has_left, cast(r.sample_id is not null as int) as has_right from {_agg_sources('A')} a {_join} {_agg_sources('R')} r on a.sample_id = r.sample_id", SAMPLES, OBS))
    def align(spark, d, how=_how):
        out = combine.align(_source_means(spark, d, "A"), _source_means(spark, d, "R"), how)
        return out.select("sample_id", F.round("v_A", 8).alias("v_a"), F.round("v_R", 8).alias("v_r"), "has_left", "has_right")


@query("combo_cartesian", sql(PAIR, SAMPLES, OBS))
def combo_cartesian(spark, d):
    return combine.cartesian(observations(spark, d), ("A", "R"))


@query("combo_zip", sql(", n as (select *, row_number() over (partition by sample_id, source_id order by rep) as i from obs) select a.sample_id, cast(a.i as int) as i, a.observation_id as o0, b.observation_id as o1 from n a join n b on a.sample_id = b.sample_id and a.i = b.i and a.source_id = 'A' and b.source_id = 'R'", SAMPLES, OBS))
def combo_zip(spark, d):
    return combine.zipped(observations(spark, d), ("A", "R"))


@query("combo_match_by", sql("select a.sample_id, a.status as key, a.observation_id as o0, b.observation_id as o1 from obs a join obs b on a.sample_id = b.sample_id and a.status = b.status and a.source_id = 'A' and b.source_id = 'N'", SAMPLES, OBS))
def combo_match_by(spark, d):
    return combine.match_by(observations(spark, d), ("A", "N"), "status")


@query("combo_sample_k", sql(f", c as ({PAIR}) select * from (select sample_id, o0, o1, cast(row_number() over (partition by sample_id order by " + _seed(5, "combo", "(o0 || '|' || o1)") + ", o0, o1) as int) as pick from c) where pick <= 2", SAMPLES, OBS))
def combo_sample_k(spark, d):
    return combine.sample_k(observations(spark, d), ("A", "R"), 2, 5)


@query("combo_reference_broadcast", sql(", r as (select sample_id, arg_min(observation_id, rep) as reference_id from obs where source_id = 'N' group by sample_id) select sample_id, reference_id, observation_id from obs join r using (sample_id) where source_id <> 'N'", SAMPLES, OBS))
def combo_reference_broadcast(spark, d):
    return combine.reference_broadcast(observations(spark, d), "N")


@query("combo_replay", sql(f"select * from ({PAIR}) where sample_id like '%5'", SAMPLES, OBS))
def combo_replay(spark, d):
    combos = combine.cartesian(observations(spark, d), ("A", "R"))
    recorded = combos.where(F.col("sample_id").endswith("5"))
    return combos.join(recorded, ["sample_id", "o0", "o1"], "left_semi")


WIDE = "wide as (select sample_id, avg(case when source_id = 'A' then v end) as xa, avg(case when source_id = 'N' then v end) as xn, avg(case when source_id = 'R' then v end) as xr from obs group by sample_id)"
WIDE_COLS = ["x_A", "x_N", "x_R"]


def _wide(spark, d):
    return combine.source_table(observations(spark, d), ("A", "N", "R"), "v")


def _rounded(df, *more):
    return df.select("sample_id", *[F.round(c, 8).alias(c.lower().replace("_", "")) for c in WIDE_COLS], *more)


@query("missing_drop", sql("select sample_id, round(xa, 8) as xa, round(xn, 8) as xn, round(xr, 8) as xr from wide where xa is not null and xn is not null and xr is not null", SAMPLES, OBS, WIDE))
def missing_drop(spark, d):
    return _rounded(combine.missing_policy(_wide(spark, d), WIDE_COLS, "drop"))


@query("missing_impute", sql("select sample_id, round(coalesce(xa, -1), 8) as xa, round(coalesce(xn, -1), 8) as xn, round(coalesce(xr, -1), 8) as xr from wide", SAMPLES, OBS, WIDE))
def missing_impute(spark, d):
    return _rounded(combine.missing_policy(_wide(spark, d), WIDE_COLS, "impute", -1.0))


@query("missing_mask", sql("select sample_id, round(xa, 8) as xa, round(xn, 8) as xn, round(xr, 8) as xr, cast(xa is not null as int) as mask_a, cast(xn is not null as int) as mask_n, cast(xr is not null as int) as mask_r from wide", SAMPLES, OBS, WIDE))
def missing_mask(spark, d):
    out = combine.missing_policy(_wide(spark, d), WIDE_COLS, "mask")
    return _rounded(out, F.col("mask_x_A").alias("mask_a"), F.col("mask_x_N").alias("mask_n"), F.col("mask_x_R").alias("mask_r"))


@query("fusion_concat", sql("select sample_id, 3 as width, round(coalesce(xa, 0) + 2 * coalesce(xn, 0) + 3 * coalesce(xr, 0), 8) as checksum from wide", SAMPLES, OBS, WIDE))
def fusion_concat(spark, d):
    out = combine.fuse_concat(_wide(spark, d), WIDE_COLS)
    check = F.aggregate(F.transform("features", lambda x, i: F.coalesce(x, F.lit(0.0)) * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select("sample_id", F.size("features").alias("width"), F.round(check, 8).alias("checksum"))


@query("fusion_stack", sql("select source_id, sample_id, round(avg(v), 8) as v from obs group by source_id, sample_id", SAMPLES, OBS))
def fusion_stack(spark, d):
    parts = [_source_means(spark, d, s).select(F.lit(s).alias("source_id"), "sample_id", F.round(f"v_{s}", 8).alias("v")) for s in ("A", "N", "R")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("fusion_dict", sql("select sample_id, count(distinct source_id) as n_sources, round(avg(case when source_id = 'N' then v end), 8) as v_n from obs group by sample_id", SAMPLES, OBS))
def fusion_dict(spark, d):
    return combine.fuse_dict(observations(spark, d), "v").select("sample_id", F.size("by_source").cast("bigint").alias("n_sources"), F.round(F.try_element_at("by_source", F.lit("N")), 8).alias("v_n"))


@query("repr_aggregate", sql("select sample_id, source_id, round(avg(v), 8) as v, round(avg(q), 8) as q from obs group by sample_id, source_id", SAMPLES, OBS))
def repr_aggregate(spark, d):
    return observations(spark, d).groupBy("sample_id", "source_id").agg(F.round(F.avg("v"), 8).alias("v"), F.round(F.avg("q"), 8).alias("q"))


@query("repr_stack_fixed", sql("select sample_id, count(*) as n, max(case when rep = 1 then q end) as x1, max(case when rep = 2 then q end) as x2, max(case when rep = 3 then q end) as x3 from obs group by sample_id having count(*) = 3", SAMPLES, OBS))
def repr_stack_fixed(spark, d):
    return combine.stack_fixed(observations(spark, d), "q", 3).where("n = 3")


@query("repr_stack_padded", sql("select sample_id, cast(least(count(*), 5) as int) as n_real, round(sum(case when rep <= 5 then q * rep end), 8) as checksum from obs group by sample_id", SAMPLES, OBS))
def repr_stack_padded(spark, d):
    out = combine.stack_padded(observations(spark, d), "q", 5)
    check = F.aggregate(F.transform("values", lambda x, i: F.coalesce(x, F.lit(0.0)) * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select("sample_id", F.size(F.filter("mask", lambda m: m)).alias("n_real"), F.round(check, 8).alias("checksum"))


@query("broadcast_sample_to_obs", sql("select observation_id, sample_id, y from obs", SAMPLES, OBS))
def broadcast_sample_to_obs(spark, d):
    return combine.to_units(samples(spark, d).select("sample_id", "y"), observations(spark, d))


@query("concat_transform", sql("select vec_id, (2 * len(embedding))::bigint as width, round(list_sum(list_transform(embedding, lambda x: x::double)) + list_sum(list_transform(embedding, lambda x: x::double * x::double)), 8) as checksum from embeddings"))
def concat_transform(spark, d):
    values = F.transform("embedding", lambda x: x.cast("double"))
    both = combine.concat_features(values, F.transform(values, lambda x: x * x))
    return table(spark, d, "embeddings").select("vec_id", F.size(both).cast("bigint").alias("width"), F.round(F.aggregate(both, F.lit(0.0), lambda a, x: a + x), 8).alias("checksum"))


@query("transform_snv", sql(""", e as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings)
 select vec_id, cast(i as int) as i, round((x - avg(x) over w) / stddev_samp(x) over w, 6) as z from e window w as (partition by vec_id)""".strip().lstrip(",").replace("e as", "with e as", 1)))
def transform_snv(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(scalars.snv(F.col("embedding"))).alias("i", "z"))
    return e.select("vec_id", (F.col("i") + 1).alias("i"), F.round("z", 6).alias("z"))
