"""Search spaces as tables: dimensions, products, constraints, variants.

A space has one row per variant and is as large as its declared dimensions make it: it is bounded by what a user
writes down, not by data, so its products are plain cross joins of tiny tables.
"""

from __future__ import annotations

import json
import math
import sys
from itertools import combinations, permutations, product

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalkiln.functions.hashing import seed_key

#: More variants than this are refused, not cut.
MAX_VARIANTS = 1_000_000
#: Fixed value: the longest range of a parameter.
MOST_IN_A_RANGE = 10_000


def dimension(spark: SparkSession, name: str, values: list) -> DataFrame:
    """(name, name__pos): a dimension in its order."""
    return spark.createDataFrame([(str(v), i) for i, v in enumerate(values)], f"{name} string, {name}__pos int").coalesce(1)


def cartesian(*dims: DataFrame) -> DataFrame:
    """All choices; the first dimension is the slowest in the order by the positions."""
    out = dims[0]
    for d in dims[1:]:
        out = out.crossJoin(d)
    return out


def zipped(*dims: DataFrame) -> DataFrame:
    """The i-th choice of every dimension; lengths have to agree."""
    pos = [next(c for c in d.columns if c.endswith("__pos")) for d in dims]
    if len({d.count() for d in dims}) > 1:
        raise ValueError("zipped dimensions differ in length")
    out = dims[0].withColumn("i", F.col(pos[0]))
    for d, p in zip(dims[1:], pos[1:]):
        out = out.join(d.withColumn("i", F.col(p)), "i")
    return out.drop("i")


def constrain(space: DataFrame, mutex: list[list[Column]] = (), requires: list[tuple[Column, Column]] = (), exclude: list[tuple[Column, Column]] = ()) -> DataFrame:
    """mutex drops variants with all members; requires (a, b) those with a and not b; exclude those with both."""
    ok = F.lit(True)
    for members in mutex:
        every = members[0]
        for m in members[1:]:
            every = every & m
        ok = ok & ~every
    for a, b in requires:
        ok = ok & (~a | b)
    for a, b in exclude:
        ok = ok & ~(a & b)
    return space.where(ok)


def identify(space: DataFrame, names: list[str], seed: int) -> DataFrame:
    """Variants with fingerprint, variant_id and seed (16 hex digits)."""
    text = F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"})  # unlike joined text, no two choices give the same
    out = space.withColumn("fingerprint", F.sha2(text, 256))
    return out.withColumn("variant_id", F.concat(F.lit("variant:"), F.substring("fingerprint", 1, 16))).withColumn("seed_hex", seed_key(seed, "variant", F.col("variant_id")))


def capped(space: DataFrame, order: list[str], count: int) -> DataFrame:
    """The first ``count`` variants in the order of the space."""
    return space.orderBy(*order).limit(count)


def checked(space: DataFrame, most: int = MAX_VARIANTS) -> DataFrame:
    n = space.count()
    if n > most or not n:
        raise ValueError(f"a search space of {n} variants; 1 to {most} are allowed")
    return space


def range_values(spark: SparkSession, start: float, stop: float, step: float, inclusive: bool = True) -> DataFrame:
    """start, and what adding step again and again gives, up to stop; with it if ``inclusive``, within a rounding error.

    At most MOST_IN_A_RANGE values, so they may be made here; an empty range, a step of zero or away from stop, and
    numbers that aren't finite are refused.
    """
    if not all(map(math.isfinite, (start, stop, step))):
        raise ValueError("a range needs finite numbers")
    if step == 0 or (stop - start) * step < 0:
        raise ValueError("a step of zero, or away from the stop")
    error = abs(step) * 1e-12 + sys.float_info.epsilon
    room = lambda x: (stop - x) * math.copysign(1, step)
    values, now = [], float(start)
    while room(now) >= -error if inclusive else room(now) > error:
        values.append((len(values), now))
        now += step
        if len(values) > MOST_IN_A_RANGE:
            raise ValueError(f"a range of more than {MOST_IN_A_RANGE} values")
    if not values:
        raise ValueError("a range without values")
    return spark.createDataFrame(values, "i int, value double")


def log_range_values(spark: SparkSession, start: float, stop: float, count: int, base: float = 10.0) -> DataFrame:
    """``count`` points at equal distances of the logarithm."""
    low, high = math.log(start, base), math.log(stop, base)
    ratio = F.col("id") / F.lit(max(1, count - 1))
    return spark.range(count).select(F.col("id").cast("int").alias("i"), F.pow(F.lit(base), F.lit(low) + ratio * F.lit(high - low)).alias("value"))


def pick(items: DataFrame, k: int) -> DataFrame:
    """k-subsets in order: a theta join on rising positions. ``items`` has (item, pos)."""
    out = items.select(F.col("item").alias("i1"), F.col("pos").alias("p1"))
    for j in range(2, k + 1):
        out = out.join(items.select(F.col("item").alias(f"i{j}"), F.col("pos").alias(f"p{j}")), F.col(f"p{j - 1}") < F.col(f"p{j}"))
    return out.select(*[f"i{j}" for j in range(1, k + 1)])


def arrange(items: DataFrame, k: int) -> DataFrame:
    """k-permutations."""
    out = items.select(F.col("item").alias("i1"), F.col("pos").alias("p1"))
    for j in range(2, k + 1):
        differs = F.lit(True)
        for before in range(1, j):
            differs = differs & (F.col(f"p{before}") != F.col(f"p{j}"))
        out = out.join(items.select(F.col("item").alias(f"i{j}"), F.col("pos").alias(f"p{j}")), differs)
    return out.select(*[f"i{j}" for j in range(1, k + 1)])


def structural(options: list[list[str]], mode: str = "or", pick_k: int | None = None, arrange_k: int | None = None, count: int | None = None, tail: tuple[str, ...] = ()) -> list[list[str]]:
    """Operator sequences of a generator: one of, all of, subsets or orders of the options, cut to ``count``, with a tail."""
    if mode == "cartesian":
        found = [[x for part in c for x in part] for c in product(*[[[o] for o in group] for group in options])]
    else:
        found = [list(o) for o in options]
        if pick_k:
            found = [[x for part in c for x in part] for c in combinations(options, pick_k)]
        elif arrange_k:
            found = [[x for part in c for x in part] for c in permutations(options, arrange_k)]
    return [[*x, *tail] for x in found[:count]]


def merge_overrides(*overrides: dict[tuple[str, str], object]) -> dict[tuple[str, str], object]:
    """(node, param) -> value of all choices; two values for one parameter are refused."""
    out: dict[tuple[str, str], object] = {}
    for o in overrides:
        for key, value in o.items():
            if key in out and json.dumps(out[key]) != json.dumps(value):
                raise ValueError(f"conflicting overrides of {key}")
            out[key] = value
    return out


def merged_overrides(*overrides: DataFrame) -> DataFrame:
    """(node, param, value) of all choices, once each; two values for one parameter raise while the rows are made."""
    rows = overrides[0]
    for o in overrides[1:]:
        rows = rows.unionByName(o)
    one = rows.groupBy("node", "param").agg(F.min("value").alias("value"), F.max("value").alias("__other"), F.count_if(F.col("value").isNull()).alias("__null"), F.count("value").alias("__n"))
    clash = (F.col("value") != F.col("__other")) | ((F.col("__null") > 0) & (F.col("__n") > 0))
    refused = F.raise_error(F.concat(F.lit("campaign_validation: conflicting overrides of "), "node", F.lit("."), "param"))
    return one.select("node", "param", F.when(clash, refused.cast("string")).otherwise(F.col("value")).alias("value"))


def ranges(rows: DataFrame, start: str, stop: str, step: Column) -> DataFrame:
    """``rows`` with (i, value): for each row start, and what adding step again and again gives, up to stop.

    The rule of ``range_values``, for as many ranges as there are rows: a step of zero or away from the stop, numbers
    that aren't finite and more than MOST_IN_A_RANGE values are refused while the rows are made.
    """
    a, b, s = F.col(start).cast("double"), F.col(stop).cast("double"), step.cast("double")
    odd = [F.coalesce(~(F.abs(x) < float("inf")), F.lit(True)) for x in (a, b, s)]
    n = F.floor((b - a) / F.nullif(s, F.lit(0.0)) + 1e-12 + F.lit(sys.float_info.epsilon) / F.abs(s)) + 1
    bad = F.when(odd[0] | odd[1] | odd[2], "a range needs finite numbers").when((s == 0) | ((b - a) * s < 0), "a step of zero, or away from the stop").when(n > MOST_IN_A_RANGE, "a range of too many values")
    many = F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("campaign_validation: "), bad)).cast("int")).otherwise(n.cast("int"))
    grown = F.aggregate(F.sequence(F.lit(1), F.col("__n")), F.array().cast("array<double>"), lambda out, i: F.concat(out, F.array(F.when(i == 1, a).otherwise(F.element_at(out, -1) + s))))
    return rows.withColumn("__n", many).select("*", F.posexplode(grown).alias("i", "value")).drop("__n")


def log_ranges(rows: DataFrame, start: str, stop: str, count: int, base: float = 10.0) -> DataFrame:
    """``rows`` with (i, value): for each row ``count`` points at equal distances of the logarithm between two positive numbers."""
    low, high = (F.ln(F.col(c).cast("double")) / math.log(base) for c in (start, stop))
    bad = F.coalesce((F.col(start) <= 0) | (F.col(stop) <= 0), F.lit(True))
    value = lambda i: F.pow(F.lit(base), low + i / F.lit(float(max(1, count - 1))) * (high - low))
    points = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), value)
    refused = F.raise_error(F.lit("campaign_validation: a logarithmic range needs positive ends")).cast("array<double>")
    return rows.select("*", F.posexplode(F.when(bad, refused).otherwise(points)).alias("i", "value"))


def uniform(seed: int, ids: Column, low: Column, high: Column, label: str = "uniform") -> Column:
    """A number between low and high for each id, by a seeded hash; the same on every run and at every parallelism."""
    unit = F.conv(F.substring(seed_key(seed, label, ids), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    return low + unit * (high - low)


def log_uniform(seed: int, ids: Column, low: Column, high: Column, label: str = "log_uniform") -> Column:
    """Like ``uniform``, with equal chances for equal ratios; both ends positive."""
    return F.exp(uniform(seed, ids, F.ln(low), F.ln(high), label))


def schedule(variants: DataFrame, folds: DataFrame, levels: DataFrame) -> DataFrame:
    """(variant_id, fold_id, node, level): what FIT_CV runs."""
    return variants.select("variant_id").crossJoin(folds.select("fold_id")).crossJoin(levels.select("node", "level"))


def random_search(spark: SparkSession, n: int, bounds: dict[str, tuple[float, float]], seed: int) -> DataFrame:
    """n trials with uniform values from a seeded hash; the same on every run and at every parallelism."""
    trials = spark.range(n).select(F.col("id").cast("int").alias("trial"))
    unit = lambda name: F.conv(F.substring(seed_key(seed, name, F.col("trial").cast("string")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    return trials.select("trial", *[(F.lit(lo) + unit(name) * F.lit(hi - lo)).alias(name) for name, (lo, hi) in bounds.items()])


def asha_survivors(scores: DataFrame, eta: int = 3) -> DataFrame:
    """(rung, trial): on each rung the best 1/eta of its trials; ``scores`` has (rung, trial, value), lower is better."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("rung"))
    r = F.row_number().over(Window.partitionBy("rung").orderBy("value", "trial"))
    return scores.withColumn("__n", n).withColumn("__r", r).where(F.col("__r") <= F.greatest(F.lit(1), F.floor(F.col("__n") / eta))).select("rung", "trial", "value")
