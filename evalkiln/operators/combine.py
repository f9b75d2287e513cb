"""Several sources of one sample: alignment, combinations, missing sources, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evalkiln.functions.hashing import seed_key


def align(left: DataFrame, right: DataFrame, how: str, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Join two sources by identity, with presence masks has_left and has_right (0 or 1)."""
    joined = left.withColumn("__l", F.lit(1)).join(right.withColumn("__r", F.lit(1)), list(keys), {"outer": "full_outer"}.get(how, how))
    return joined.withColumn("has_left", F.coalesce("__l", F.lit(0))).withColumn("has_right", F.coalesce("__r", F.lit(0))).drop("__l", "__r")


def _by_source(observations: DataFrame, sources: tuple[str, ...], *fields: str) -> DataFrame:
    """One row per sample with one sorted array per source; a sample's observations are few."""
    item = F.struct(*fields)
    return observations.where(F.col("source_id").isin(*sources)).groupBy("sample_id").agg(
        *[F.array_sort(F.collect_list(F.when(F.col("source_id") == s, item))).alias(f"s{i}") for i, s in enumerate(sources)]
    )


def cartesian(observations: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """Every combination of one observation per source within a sample; one shuffle, whatever the number of sources."""
    out = _by_source(observations, sources, "observation_id")
    for i in range(len(sources)):
        out = out.withColumn(f"c{i}", F.explode(f"s{i}")).drop(f"s{i}")
    return out.select("sample_id", *[F.col(f"c{i}.observation_id").alias(f"o{i}") for i in range(len(sources))])


def zipped(observations: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """The i-th observation (by rep) of each source, up to the shortest."""
    out = _by_source(observations, sources, "rep", "observation_id")
    n = F.least(*[F.size(f"s{i}") for i in range(len(sources))])
    rows = out.withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1))))).where(F.col("i") <= n)
    return rows.select("sample_id", "i", *[F.element_at(f"s{i}", F.col("i"))["observation_id"].alias(f"o{i}") for i in range(len(sources))])


def match_by(observations: DataFrame, sources: tuple[str, ...], key: str) -> DataFrame:
    """Observations of different sources that share a key within a sample."""
    parts = [observations.where(F.col("source_id") == s).select("sample_id", F.col(key).alias("key"), F.col("observation_id").alias(f"o{i}")) for i, s in enumerate(sources)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, ["sample_id", "key"])
    return out


def sample_k(observations: DataFrame, sources: tuple[str, ...], k: int, seed: int) -> DataFrame:
    """At most k combinations per sample, the first in the order of a seeded hash."""
    combos = cartesian(observations, sources)
    ids = [f"o{i}" for i in range(len(sources))]
    order = seed_key(seed, "combo", F.concat_ws("|", *ids))
    return combos.withColumn("pick", F.row_number().over(Window.partitionBy("sample_id").orderBy(order, *ids))).where(F.col("pick") <= k)


def reference_broadcast(observations: DataFrame, reference: str) -> DataFrame:
    """The first observation of the reference source next to each other observation of the sample."""
    ref = observations.where(F.col("source_id") == reference).groupBy("sample_id").agg(F.min_by("observation_id", "rep").alias("reference_id"))
    return observations.where(F.col("source_id") != reference).join(ref, "sample_id").select("sample_id", "reference_id", "observation_id")


def source_table(observations: DataFrame, sources: tuple[str, ...], value: str) -> DataFrame:
    """One row per sample and one column per source with its mean value; null where the sample lacks the source."""
    return observations.groupBy("sample_id").agg(*[F.avg(F.when(F.col("source_id") == s, F.col(value))).alias(f"x_{s}") for s in sources])


def missing_policy(wide: DataFrame, columns: list[str], policy: str, fill: float = 0.0) -> DataFrame:
    """strict (violations are the caller's), drop, impute with a declared value, or mask."""
    if policy == "drop":
        return wide.dropna(subset=columns)
    if policy == "impute":
        return wide.fillna(fill, subset=columns)
    if policy == "mask":
        return wide.withColumns({f"mask_{c}": F.col(c).isNotNull().cast("int") for c in columns})
    return wide


def fuse_concat(wide: DataFrame, columns: list[str]) -> DataFrame:
    return wide.withColumn("features", F.array(*columns))


def fuse_dict(observations: DataFrame, value: str) -> DataFrame:
    """(sample_id, by_source): a map from source to its mean value."""
    means = observations.groupBy("sample_id", "source_id").agg(F.avg(value).alias("m"))
    return means.groupBy("sample_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_id", "m")))).alias("by_source"))


def stack_fixed(observations: DataFrame, value: str, k: int) -> DataFrame:
    """(sample_id, x1..xk, n): exactly k observations side by side by rep; other cardinalities show in n."""
    return observations.groupBy("sample_id").agg(F.count("*").alias("n"), *[F.max(F.when(F.col("rep") == i, F.col(value))).alias(f"x{i}") for i in range(1, k + 1)])


def stack_padded(observations: DataFrame, value: str, k: int) -> DataFrame:
    """(sample_id, values, mask): up to k observations by rep, padded with nulls, and what is real."""
    rows = observations.where(F.col("rep") <= k).groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rep", value))), lambda x: x[value]).alias("v"))
    values = F.concat("v", F.array_repeat(F.lit(None).cast("double"), F.greatest(k - F.size("v"), F.lit(0))))
    return rows.select("sample_id", values.alias("values")).withColumn("mask", F.transform("values", lambda x: x.isNotNull()))


def to_units(values: DataFrame, observations: DataFrame) -> DataFrame:
    """Values of samples given to each of their observations."""
    return observations.select("observation_id", "sample_id").join(values, "sample_id")


def concat_features(*arrays: Column) -> Column:
    return F.concat(*arrays)
