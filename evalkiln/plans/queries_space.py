"""Queries over search spaces, schedules, graphs and stores."""

from __future__ import annotations

from math import comb

from pyspark.sql import functions as F

from evalkiln.functions import hashing
from evalkiln.operators import metrics, space, unrank
from evalkiln.plans import campaign, graph
from evalkiln.plans.prelude import FOLDS, PRED, SAMPLES, sql
from evalkiln.plans.queries_data import _seed
from evalkiln.plans.registry import query
from evalkiln.sources import stores
from evalkiln.sources.testdata import fold_of, predictions, table

# Dimensions are the distinct values of columns, numbered in their order.
DIM = "{0} as (select v as {0}, row_number() over (order by v) - 1 as {0}__pos from (select distinct {1} as v from {2}))"
DIMS = ", ".join([DIM.format("model", "c_mktsegment", "customer"), DIM.format("scale", "o_orderstatus", "orders"), DIM.format("pick", "l_returnflag", "lineitem"), "dims as (select * from model, scale, pick)"])


def _dims(spark, d):
    return [(name, unrank.items_of(table(spark, d, t), c)) for name, c, t in (("model", "c_mktsegment", "customer"), ("scale", "o_orderstatus", "orders"), ("pick", "l_returnflag", "lineitem"))]


def _space(spark, d, count=None):
    """(i, model, scale, pick): all variants, or the first ``count``, each computed from its rank."""
    dims = _dims(spark, d)
    total = 1
    for _, items in dims:
        total *= items.count()
    return unrank.products(unrank.ranks(spark, total, count), dims)


@query("gen_cartesian", f"with {DIMS} select model, scale, pick, cast(row_number() over (order by model__pos, scale__pos, pick__pos) as int) as position from dims")
def gen_cartesian(spark, d):
    return _space(spark, d).select("model", "scale", "pick", (F.col("i") + 1).cast("int").alias("position"))


@query("gen_zip", f"with {DIMS} select scale, pick from scale join pick on scale__pos = pick__pos")
def gen_zip(spark, d):
    _, (_, scale), (_, pick) = _dims(spark, d)
    return space.zipped(*[x.select(F.col("item").alias(n), F.col("pos").alias(f"{n}__pos")) for n, x in (("scale", scale), ("pick", pick))]).select("scale", "pick")


@query("gen_constraints", f"with {DIMS} select model, scale, pick from dims where not (model = 'BUILDING' and scale = 'F' and pick = 'R') and (model <> 'MACHINERY' or scale = 'O') and not (model = 'FURNITURE' and pick = 'A')")
def gen_constraints(spark, d):
    is_ = lambda c, v: F.col(c) == v
    return space.constrain(
        _space(spark, d), mutex=[[is_("model", "BUILDING"), is_("scale", "F"), is_("pick", "R")]], requires=[(is_("model", "MACHINERY"), is_("scale", "O"))], exclude=[(is_("model", "FURNITURE"), is_("pick", "A"))]
    ).select("model", "scale", "pick")


@query("gen_count_limit", f"with {DIMS} select model, scale, pick from dims order by model__pos, scale__pos, pick__pos limit 5")
def gen_count_limit(spark, d):
    """The first five variants; no others are made."""
    return _space(spark, d, 5).select("model", "scale", "pick")


RANK = "('0x' || substr({0}, 1, 15))::bigint"


@query("gen_sampled", f"""with f as (select v as part, row_number() over (order by v) - 1 as pos from (select distinct p_name as v from part)), n as (select count(*)::bigint as n from f),
 drawn as (select {RANK.format("(" + _seed(3, 'draw', "cast(r.range as varchar)") + ")")} % (n * n * n) as i, r.range as id from range(60) r, n),
 firsts as (select i, min(id) as id from drawn group by i order by 2 limit 20)
 select i, a.part as a, b.part as b, c.part as c from firsts, n join f a on a.pos = i // (n * n) join f b on b.pos = (i // n) % n join f c on c.pos = i % n""")
def gen_sampled(spark, d):
    """Twenty of all triples of parts, by rank: none of the others is made."""
    parts = unrank.items_of(table(spark, d, "part"), "p_name")
    at = unrank.sampled_ranks(spark, parts.count() ** 3, 20, 3)
    return unrank.products(at, [("a", parts), ("b", parts), ("c", parts)]).select("i", "a", "b", "c")


IDENT = f"with {DIMS}, f as (select model, scale, pick, sha256(cast(json_object('model', model, 'pick', pick, 'scale', scale) as varchar)) as fingerprint from dims), v as (select *, 'variant:' || substr(fingerprint, 1, 16) as variant_id from f)"


@query("gen_variant_id", f"{IDENT} select model, scale, pick, fingerprint, variant_id, {_seed(9, 'variant', 'variant_id')} as seed_hex from v")
def gen_variant_id(spark, d):
    return space.identify(_space(spark, d), ["model", "scale", "pick"], 9).select("model", "scale", "pick", "fingerprint", "variant_id", "seed_hex")


@query("gen_param_overrides", "select p_brand as node, 'size' as param, max(p_size)::varchar as value from part group by p_brand union all select p_type, 'n', count(*)::varchar from part group by p_type")
def gen_param_overrides(spark, d):
    """Overrides of two choices, one of them given twice with the same value."""
    part = table(spark, d, "part")
    sizes = part.groupBy(F.col("p_brand").alias("node")).agg(F.lit("size").alias("param"), F.max("p_size").cast("string").alias("value"))
    counts = part.groupBy(F.col("p_type").alias("node")).agg(F.lit("n").alias("param"), F.count("*").cast("string").alias("value"))
    return space.merged_overrides(sizes, counts, sizes)


@query("gen_or", "select distinct n_name as choice from nation")
def gen_or(spark, d):
    return unrank.items_of(table(spark, d, "nation"), "n_name").select(F.col("item").alias("choice"))


@query("gen_range", "select p_partkey, i::int as i, round(p_size::double + 0.25::double * i, 8) as value from part, lateral (select unnest(range(p_size % 7 * 4 + 1)) as i)")
def gen_range(spark, d):
    """A range for each part, from its size by quarters."""
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("start"), (F.col("p_size") + F.col("p_size") % 7).cast("double").alias("stop"))
    return space.ranges(rows, "start", "stop", F.lit(0.25)).select("p_partkey", "i", F.round("value", 8).alias("value"))


@query("gen_log_range", "select p_partkey, i::int as i, round(pow(10, i / 4.0 * log10(p_retailprice)), 6) as value from part, lateral (select unnest(range(5)) as i)")
def gen_log_range(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.lit(1.0).alias("start"), F.col("p_retailprice").alias("stop"))
    return space.log_ranges(rows, "start", "stop", 5).select("p_partkey", "i", F.round("value", 6).alias("value"))


@query("gen_grid", "select a.v as a, b.v as b from (select distinct r_name as v from region) a, (select distinct p_type as v from part) b")
def gen_grid(spark, d):
    a, b = unrank.items_of(table(spark, d, "region"), "r_name"), unrank.items_of(table(spark, d, "part"), "p_type")
    return unrank.products(unrank.ranks(spark, a.count() * b.count()), [("a", a), ("b", b)]).select("a", "b")


ITEMS = "items as (select r_name as item, r_regionkey as pos from region)"


def _items(spark, d):
    return table(spark, d, "region").select(F.col("r_name").alias("item"), F.col("r_regionkey").alias("pos"))


@query("gen_pick", f"with {ITEMS} select a.item as i1, b.item as i2, c.item as i3 from items a join items b on a.pos < b.pos join items c on b.pos < c.pos")
def gen_pick(spark, d):
    return space.pick(_items(spark, d), 3)


@query("gen_arrange", f"with {ITEMS} select a.item as i1, b.item as i2 from items a join items b on a.pos <> b.pos")
def gen_arrange(spark, d):
    return space.arrange(_items(spark, d), 2)


def _nations(spark, d):
    """(items): the names of the nations as one array in their order, and their number."""
    rows = unrank.items_of(table(spark, d, "nation"), "n_name")
    n = rows.count()
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("items")), n  # at most MAX_ITEMS


NATIONS = "ord as (select v as item, row_number() over (order by v) - 1 as pos from (select distinct n_name as v from nation))"


@query("gen_structural", f"with {NATIONS} select row_number() over (order by a.pos, b.pos) - 1 as i, a.item || '>' || b.item || '>pls' as sequence from ord a join ord b on a.pos < b.pos")
def gen_structural(spark, d):
    """Sequences of two of all operators and a tail, each from its rank."""
    items, n = _nations(spark, d)
    at = unrank.ranks(spark, comb(n, 2)).crossJoin(F.broadcast(items))  # one row
    return at.select("i", F.concat_ws(">", unrank.named(unrank.subset_positions(F.col("i"), n, 2), F.col("items")), F.lit("pls")).alias("sequence"))


@query("gen_then_arrange", f"""with {NATIONS}, one as (select row_number() over (order by a.pos, b.pos) - 1 as r, a.item || '+' || b.item as s from ord a join ord b on a.pos < b.pos)
 select row_number() over (order by x.r, y.r) - 1 as i, x.s || '>' || y.s as sequence from one x join one y on x.r <> y.r order by i limit 1000""")
def gen_then_arrange(spark, d):
    """The first thousand orders of two of all pairs of operators: an arrangement of what was picked before."""
    items, n = _nations(spark, d)
    at = unrank.ranks(spark, comb(n, 2) * (comb(n, 2) - 1), 1000).crossJoin(F.broadcast(items))  # one row
    both = F.transform(unrank.then(F.col("i"), n, ("pick", 2), ("arrange", 2)), lambda p: F.concat_ws("+", unrank.named(p, F.col("items"))))
    return at.select("i", F.concat_ws(">", both).alias("sequence"))


UNIT = "('0x' || substr({0}, 1, 13))::ubigint / pow(16.0, 13)"


@query("gen_sample_uniform", f"select p_partkey, round(p_size + {UNIT.format('(' + _seed(6, 'uniform', 'p_partkey::varchar') + ')')} * 10.0, 8) as value from part")
def gen_sample_uniform(spark, d):
    rows = table(spark, d, "part")
    return rows.select("p_partkey", F.round(space.uniform(6, F.col("p_partkey").cast("string"), F.col("p_size"), F.col("p_size") + 10.0), 8).alias("value"))


@query("gen_sample_log", f"select p_partkey, round(exp(ln(p_size) + {UNIT.format('(' + _seed(6, 'log_uniform', 'p_partkey::varchar') + ')')} * (ln(p_retailprice) - ln(p_size))), 6) as value from part")
def gen_sample_log(spark, d):
    rows = table(spark, d, "part")
    return rows.select("p_partkey", F.round(space.log_uniform(6, F.col("p_partkey").cast("string"), F.col("p_size"), F.col("p_retailprice")), 6).alias("value"))


@query("gen_rows", f"select p_partkey, r.i::int as row, round({UNIT.format('(' + _seed(3, 'rows', "(p_partkey || ':' || r.i)") + ')')}, 8) as x from part, lateral (select unnest(range(1, p_size + 1)) as i) r")
def gen_rows(spark, d):
    """Synthetic rows from a table of how many each generator makes; a row's values hang on its generator and number only."""
    rows = table(spark, d, "part").select("p_partkey", F.explode(F.sequence(F.lit(1), "p_size")).alias("row"))
    return rows.select("p_partkey", "row", F.round(space.uniform(3, F.concat_ws(":", "p_partkey", "row"), F.lit(0.0), F.lit(1.0), "rows"), 8).alias("x"))


@query("schedule_expand", f"{IDENT}, {SAMPLES}, {FOLDS}, n(node, level) as (values ('scale', 1), ('model', 2)) select variant_id, 'fold' || f.fold as fold_id, node, level from v, (select distinct fold from folds) f, n")
def schedule_expand(spark, d):
    variants = space.identify(_space(spark, d), ["model", "scale", "pick"], 9)
    fold_ids = fold_of(spark, d).select(F.concat(F.lit("fold"), F.col("fold").cast("string")).alias("fold_id")).distinct()
    levels = spark.createDataFrame([("scale", 1), ("model", 2)], "node string, level int").coalesce(1)
    return space.schedule(variants, fold_ids, levels)


@query("hpo_random", f"select event_id as trial, round(0.1 + {UNIT.format('(' + _seed(4, 'alpha', 'event_id::varchar') + ')')} * 0.9, 8) as alpha from events")
def hpo_random(spark, d):
    """A parameter for each trial that the table asks for."""
    trial = F.col("event_id")
    return table(spark, d, "events").select(trial.alias("trial"), F.round(space.uniform(4, trial.cast("string"), F.lit(0.1), F.lit(1.0), "alpha"), 8).alias("alpha"))


@query("hpo_asha", sql(", c as (select producer || fold_id as trial, i as rung, round(avg(abs(value - y)) / i, 8) as value from pred, (values (1), (2)) r(i) group by producer, fold_id, i) select rung, trial, value from (select *, row_number() over (partition by rung order by value, trial) as r, count(*) over (partition by rung) as n from c) where r <= greatest(1, n // 3)", SAMPLES, FOLDS, PRED))
def hpo_asha(spark, d):
    s = metrics.report(predictions(spark, d), ["producer", "fold_id"], ("mae",)).withColumn("rung", F.explode(F.array(F.lit(1), F.lit(2))))
    return space.asha_survivors(s.select("rung", F.concat("producer", "fold_id").alias("trial"), F.round(F.col("mae") / F.col("rung"), 8).alias("value")))


# --- graphs and campaigns

EDGES = "edges as (select distinct r_name as src, n_name as dst from nation join region on r_regionkey = n_regionkey union select distinct n_name, c_mktsegment from customer join nation on n_nationkey = c_nationkey union select distinct c_mktsegment, o_orderstatus from orders join customer on o_custkey = c_custkey union select distinct r_name, o_orderstatus from orders join customer on o_custkey = c_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey)"


def _edges(spark, d):
    """A graph in four levels, with edges that skip some: regions, nations, segments, states."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "right").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "right")
    rows = rows.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pairs = F.array(*[F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in (("r_name", "n_name"), ("n_name", "c_mktsegment"), ("c_mktsegment", "o_orderstatus"), ("r_name", "o_orderstatus"))])
    return rows.select(F.explode(pairs).alias("e")).select("e.*").where("src is not null and dst is not null").distinct()


@query("graph_levels", f"with recursive {EDGES}, w(node, level) as (select src, 0 from edges where src not in (select dst from edges) union select dst, level + 1 from w join edges on src = node) select node, cast(max(level) as int) as level from w group by node")
def graph_levels(spark, d):
    return graph.levels(_edges(spark, d))


@query("campaign_stack", None)
def campaign_stack(spark, d):
    return campaign.example(spark, d)


# --- stores

@query("cache_roundtrip", sql("select producer, fold_id, sample_id, round(value, 8) as value from pred", SAMPLES, FOLDS, PRED))
def cache_roundtrip(spark, d):
    p = predictions(spark, d).select("producer", "fold_id", "sample_id", F.round("value", 8).alias("value"))
    return stores.reread(p, ["producer", "fold_id"]).select("producer", "fold_id", "sample_id", "value")


@query("cache_json_roundtrip", sql("select sample_id, fold_id, producer, round(value, 8) as value from pred", SAMPLES, FOLDS, PRED))
def cache_json_roundtrip(spark, d):
    p = predictions(spark, d).select("sample_id", "fold_id", "producer", F.round("value", 8).alias("value"))
    return stores.from_json(stores.to_json(p, ["sample_id"]), p.schema, ["sample_id"])


@query("cache_arrow_roundtrip", sql("select producer, fold_id, sample_id, round(value, 8) as value from pred", SAMPLES, FOLDS, PRED))
def cache_arrow_roundtrip(spark, d):
    """Prediction blocks as Arrow streams, their digests and identities checked, and back."""
    p = predictions(spark, d).select("producer", "fold_id", "sample_id", F.round("value", 8).alias("value"))
    return stores.from_arrow(stores.to_arrow(p, ["producer", "fold_id"]), p.schema, ["producer", "fold_id"])


@query("artifact_register")
def artifact_register(spark, d):
    """The files of two tables by content; nothing was changed since they were registered."""
    found = stores.artifacts(spark, d, "part*.parquet")
    stores.strict(stores.refetch_violations(found, found), stores.CampaignValidation, "artifacts")
    return found


@query("tensor_row_major", "select 64 * vec_id + i - 1 as position, round(x, 6) as value from (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings)")
def tensor_row_major(spark, d):
    return stores.tensor(table(spark, d, "embeddings"), "vec_id", "embedding", 64, row_major=True).select("position", F.round("value", 6).alias("value"))


@query("tensor_columnar", "select (i - 1) * (select count(*) from embeddings) + vec_id as position, round(x, 6) as value from (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings)")
def tensor_columnar(spark, d):
    return stores.tensor(table(spark, d, "embeddings"), "vec_id", "embedding", 64, row_major=False).select("position", F.round("value", 6).alias("value"))


@query("fingerprint_schema")
def fingerprint_schema(spark, d):
    names = ("orders", "lineitem", "customer", "events")
    return spark.createDataFrame([(n, stores.schema_fingerprint(table(spark, d, n))) for n in names], "name string, fingerprint string")


@query("fingerprint_json", "select p_partkey, sha256('{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || '}') as fingerprint from part")
def fingerprint_json(spark, d):
    return table(spark, d, "part").select("p_partkey", hashing.row_fingerprint(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("fingerprint"))


LINEAGE = """select 'block:' || producer || ':' || fold_id as id, 'Dataset' as kind, json_object('@id', 'block:' || producer || ':' || fold_id, '@type', 'Dataset', 'n', count(*), 'first', min(sample_id), 'last', max(sample_id))::varchar as json from pred group by producer, fold_id
 union all select 'run:' || producer, 'CreateAction', json_object('@id', 'run:' || producer, '@type', 'CreateAction', 'result', list_sort(list(distinct 'block:' || producer || ':' || fold_id)))::varchar from pred group by producer"""


@query("lineage_export", sql(LINEAGE, SAMPLES, FOLDS, PRED))
def lineage_export(spark, d):
    """What a campaign made, as linked documents: a dataset for each block, an action for each producer with its results."""
    return stores.provenance(predictions(spark, d))


@query("ml_scaler", "select vec_id, round((embedding[1] - (select avg(embedding[1]::double) from embeddings)) / (select stddev_samp(embedding[1]::double) from embeddings), 5) as z from embeddings")
def ml_scaler(spark, d):
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    scaled = StandardScaler(inputCol="v", outputCol="z", withMean=True, withStd=True).fit(e).transform(e)
    return scaled.select("vec_id", F.round(vector_to_array("z")[0], 5).alias("z"))


@query("ml_ridge")
def ml_ridge(spark, d):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    e = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(8)])
    features = VectorAssembler(inputCols=[f"x{i}" for i in range(8)], outputCol="features").transform(e)
    model = LinearRegression(regParam=0.1, elasticNetParam=0.0).fit(features)
    return model.transform(features).select("vec_id", F.round("prediction", 6).alias("prediction"))
