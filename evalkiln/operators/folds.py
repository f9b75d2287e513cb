"""Splitters: K-fold, stratified, grouped, nested and repeated folds as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from evalkiln.checks import OofValidation, strict
from evalkiln.functions.hashing import seed_key
from evalkiln.operators.order import position as global_position, running

def kfold(samples: DataFrame, k: int, seed: int | None = None, shuffle_label: str = "kfold", id_col: str = "sample_id") -> DataFrame:
    """(sample_id, fold): position in the order of ids, or of their seeded hash, modulo k."""
    if k < 2:
        raise ValueError("k-fold needs k >= 2")
    ids = samples.select(id_col)
    if seed is None:
        placed = global_position(ids, id_col)
    else:
        placed = global_position(ids.withColumn("__key", seed_key(seed, shuffle_label, F.col(id_col))), "__key", id_col).drop("__key")
    return placed.select(id_col, (F.col("position") % k).cast("int").alias("fold"))


def with_fold(samples: DataFrame, k: int, id_col: str = "sample_id") -> DataFrame:
    """``samples`` with the column ``fold`` of the unshuffled ``kfold``: the rows are placed whole, so nothing is joined back."""
    if k < 2:
        raise ValueError("k-fold needs k >= 2")
    return global_position(samples, id_col, name="__position").withColumn("fold", (F.col("__position") % k).cast("int")).drop("__position")


def stratified_kfold(samples: DataFrame, k: int, label_col: str, seed: int | None = None, id_col: str = "sample_id") -> DataFrame:
    """Classes by label, inside a class the order of ``kfold``; the global position modulo k.

    Labels are class codes, not negative.
    """
    key = F.col(id_col) if seed is None else seed_key(seed, "kfold", F.col(id_col))
    rows = samples.select(id_col, F.col(label_col).alias("__label"), key.alias("__key"))
    # One sort key for class and id, so that a large class is numbered by ranges and not in one task.
    placed = global_position(rows.withColumn("__sorted", F.concat_ws("\u0001", F.lpad(F.col("__label").cast("string"), 12, "0"), "__key")), "__sorted", id_col)
    return placed.select(id_col, (F.col("position") % k).cast("int").alias("fold"))


#: Runs of groups of one size that may be broadcast; there are at most sqrt(2 N) sizes among N samples.
SMALL_RUNS = 20_000


def placed_runs(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, int, list[int]]]:
    """(size, from, cycle) of the greedy rule, for (size, number of groups) by falling size.

    Group i of a run of equal sizes, counted from 0, goes to fold ``cycle[(i - from) % len(cycle)]`` of the last segment
    that begins at or before i. Within a run the folds take groups in the order of load and number: the lightest one
    alone until it has caught up with the next, then both in turn, and so on, so a run has at most k segments.
    """
    loads, out = [0] * k, []
    for size, count in sizes:
        by_load = sorted(range(k), key=lambda f: (loads[f], f))
        taken = [0] * k
        start = 0
        for p in range(k):
            here = by_load[p]
            # What each lighter fold takes before this one's turn comes.
            for f in by_load[:p]:
                gap = loads[here] - loads[f]
                taken[f] = gap // size + (gap % size > 0 or f < here)
            start = sum(taken[f] for f in by_load[:p])
            if start >= count and p:
                break
            active = by_load[: p + 1]
            cycle = sorted(active, key=lambda f: (loads[f] + taken[f] * size, f))
            out.append((size, start, cycle))
            last, final = start, dict(zip(cycle, (taken[f] for f in cycle)))
        rest = count - last
        for i, f in enumerate(cycle):
            loads[f] += size * (final[f] + rest // len(cycle) + (i < rest % len(cycle)))
    return out


def _place_groups(sizes: DataFrame, k: int, parts: list[str], group: str) -> DataFrame:
    """(parts, group, fold): groups with ``count`` samples, placed by the greedy rule in each of ``parts``.

    Only the histogram of sizes comes to the driver: at most sqrt(2 N) rows for N samples. A group's place in its run is
    its position among the groups of its size.
    """
    spark = sizes.sparkSession
    histogram = sizes.groupBy(*parts, "count").agg(F.count("*").alias("groups")).collect()
    by_part: dict[tuple, list[tuple[int, int]]] = {}
    for r in histogram:
        by_part.setdefault(tuple(r[p] for p in parts), []).append((r["count"], r["groups"]))
    runs: dict[tuple, list[tuple[int, list[int]]]] = {}
    for part, found in by_part.items():
        for size, start, cycle in placed_runs(sorted(found, reverse=True), k):
            runs.setdefault((*part, size), []).append((start, cycle))
    kinds = ", ".join(f"{p} {sizes.schema[p].dataType.simpleString()}" for p in [*parts, "count"])
    table = spark.createDataFrame([(*key, segments) for key, segments in runs.items()], f"{kinds}, segments array<struct<start: bigint, cycle: array<int>>>")
    placed = global_position(sizes, group, keys=[*parts, "count"], name="i")
    joined = placed.join(F.broadcast(table) if len(runs) <= SMALL_RUNS else table, [*parts, "count"])
    last = F.element_at(F.filter("segments", lambda s: s["start"] <= F.col("i")), -1)
    fold = F.get(last["cycle"], ((F.col("i") - last["start"]) % F.size(last["cycle"])).cast("int"))
    return joined.select(*parts, group, fold.alias("fold"))


def group_kfold(samples: DataFrame, k: int, group_col: str = "group_id", id_col: str = "sample_id") -> DataFrame:
    """Groups by falling size, then id, each to the fold with the fewest samples (the first of equals).

    Groups of one size are placed together (``placed_runs``), so any number of groups is one join by size. A sample
    without a group is left out; a group is never split.
    """
    if k < 2:
        raise ValueError("k-fold needs k >= 2")
    sizes = samples.where(F.col(group_col).isNotNull()).groupBy(group_col).count()
    return samples.join(_place_groups(sizes, k, [], group_col), group_col).select(id_col, "fold")


def membership(fold_of: DataFrame, k: int, id_col: str = "sample_id") -> DataFrame:
    """(fold_id, sample_id, role): the long form, each sample once per fold; needed only where a table of roles is asked for."""
    rows = fold_of.select(id_col, "fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("f"))
    return rows.select(F.concat(F.lit("fold"), F.col("f").cast("string")).alias("fold_id"), id_col, F.when(F.col("f") == F.col("fold"), "validation").otherwise("train").alias("role"))


def nested_kfold(fold_of: DataFrame, k_outer: int, k_inner: int, id_col: str = "sample_id") -> DataFrame:
    """(outer_fold, sample_id, inner_fold): an inner K-fold over the train samples of each outer fold.

    A sample's place among the train samples of an outer fold is its place among all, less the samples of that fold
    before it: one ordered pass for all outer folds.
    """
    sums = {"__all": F.lit(1)} | {f"__own{f}": (F.col("fold") == f).cast("int") for f in range(k_outer)}
    placed = running(fold_of.select(id_col, "fold"), [id_col], sums)
    each = F.array(*[F.struct(F.lit(f).alias("f"), ((F.col("__all") - F.col(f"__own{f}")) % k_inner).cast("int").alias("inner")) for f in range(k_outer)])
    rows = placed.select(id_col, F.explode(F.filter(each, lambda e: e["f"] != F.col("fold"))).alias("e"))
    return rows.select(F.concat(F.lit("fold"), F.col("e.f").cast("string")).alias("outer_fold"), id_col, F.col("e.inner").alias("inner_fold"))


def nested_group_kfold(samples: DataFrame, fold_of: DataFrame, k_outer: int, k_inner: int, group_col: str = "group_id") -> DataFrame:
    """An inner grouped K-fold over the train samples of each outer fold, by the rule of ``group_kfold``, for all outer folds at once.

    A group's size in an outer fold's train samples is its whole size less its part in that fold.
    """
    rows = samples.select("sample_id", group_col).where(F.col(group_col).isNotNull()).join(fold_of, "sample_id")
    own = rows.groupBy(group_col).agg(F.count("*").alias("n"), *[F.count_if(F.col("fold") == f).alias(f"__own{f}") for f in range(k_outer)])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("outer"), (F.col("n") - F.col(f"__own{f}")).alias("count")) for f in range(k_outer)])).alias("e")
    sizes = own.select(group_col, each).select("e.outer", group_col, "e.count").where("count > 0")
    placed = _place_groups(sizes, k_inner, ["outer"], group_col)
    inner = rows.join(placed.withColumnRenamed("fold", "inner_fold"), group_col).where(F.col("fold") != F.col("outer"))
    return inner.select(F.concat(F.lit("fold"), F.col("outer").cast("string")).alias("outer_fold"), "sample_id", "inner_fold")


def repeated_kfold(samples: DataFrame, k: int, seeds: tuple[int, ...]) -> DataFrame:
    """(repeat, sample_id, fold): one shuffled K-fold per seed; each sample is validated once per repeat."""
    parts = [kfold(samples, k, seed).withColumn("repeat", F.lit(i)) for i, seed in enumerate(seeds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("repeat", "sample_id", "fold")


#: Hex digits of a seeded hash by which the samples of a split are counted: 4,096 parts of much the same size.
CUT_DIGITS = 3


def _cuts(keyed: DataFrame, tested: int, id_col: str) -> DataFrame:
    """(__f, __at, __last, __equal, __left): for each split of ``keyed`` (__f, __key, id) its row number ``tested`` by key and id.

    __equal rows are equal to it, __left of them are not behind it. Rows are counted by the first digits of the key, and
    only those of the part that holds the wanted row are ordered. One row for each split.
    """
    part = F.substring("__key", 1, CUT_DIGITS).alias("__part")
    held = keyed.groupBy("__f", part).agg(F.count("*").alias("__n")).withColumn("__upto", F.sum("__n").over(Window.partitionBy("__f").orderBy("__part")))
    held = held.where((F.col("__upto") >= tested) & (F.col("__upto") - F.col("__n") < tested)).select("__f", "__part", (F.col("__upto") - F.col("__n")).alias("__before"))
    near = keyed.select("*", part).join(F.broadcast(held), ["__f", "__part"])  # a row for each split
    near = near.groupBy("__f", "__before", "__key", id_col).agg(F.count("*").alias("__equal")).withColumn("__upto", F.col("__before") + F.sum("__equal").over(Window.partitionBy("__f").orderBy("__key", id_col)))
    left = tested - F.col("__upto") + F.col("__equal")
    cut = near.where((left > 0) & (F.col("__upto") >= tested)).select("__f", F.col("__key").alias("__at"), F.col(id_col).alias("__last"), "__equal", left.alias("__left"))
    return keyed.sparkSession.createDataFrame(cut.collect(), cut.schema)


def shuffle_split(samples: DataFrame, n_splits: int, test_share: float, seed: int, id_col: str = "sample_id") -> DataFrame:
    """(fold_id, sample_id, role): in each split the first floor(test_share n) samples by a seeded hash are validated, the others train.

    Splits are independent, so a sample may be validated in several or in none; the share must leave both sides rows.
    Only the last validated sample of each split is looked for; then every row tells its own side, so no split is sorted
    or moved. Samples without an id come last. Samples are read four times.
    """
    n = samples.count()
    tested = int(test_share * n)
    if not 0 < tested < n:
        raise ValueError(f"a share of {test_share} leaves {tested} of {n} samples for validation")
    rows = samples.select(id_col, F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("__f"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("__f").cast("string"), F.lit(":"), F.col(id_col).cast("string")), 256)
    keyed = rows.withColumn("__key", F.coalesce(digest, F.lit("null")))  # behind all hex digits
    cuts = _cuts(keyed, tested, id_col)
    label = F.concat(F.lit("fold"), F.col("__f").cast("string")).alias("fold_id")
    role = lambda first: F.when(first, "validation").otherwise("train").alias("role")
    last = (F.col("__key") == F.col("__at")) & F.col(id_col).eqNullSafe(F.col("__last"))
    met = keyed.join(F.broadcast(cuts), "__f")
    before = (F.col("__key") < F.col("__at")) | ((F.col("__key") == F.col("__at")) & (F.col(id_col) < F.col("__last")))
    shared = cuts.where("__left < __equal").collect()
    if not shared:
        return met.select(label, id_col, role(before | last))
    # Equal rows on both sides of a cut: as many of each as there have to be.
    out = met.where(~(last & (F.col("__left") < F.col("__equal")))).select(label, id_col, role(before))
    for r in shared:
        equal = samples.sparkSession.range(r["__equal"]).crossJoin(F.broadcast(cuts.where(F.col("__f") == r["__f"])))  # one row
        out = out.unionByName(equal.select(label, F.col("__last").alias(id_col), role(F.col("id") < F.col("__left"))))
    return out


def bootstrap(samples: DataFrame, n_splits: int, seed: int, id_col: str = "sample_id") -> DataFrame:
    """(fold_id, sample_id, role, times): n draws with replacement train each split, the samples never drawn are validated.

    ``times`` is how often a sample was drawn (1 for validation). Draw i of a split takes the sample at a hashed position;
    draws are counted by position, so a split is one aggregation and one join, whatever its size.
    """
    n = samples.count()
    if n < 2:
        raise ValueError("a bootstrap needs at least two samples")
    spark = samples.sparkSession
    draws = spark.range(n_splits * n).select((F.col("id") % n_splits).cast("int").alias("__f"), F.floor(F.col("id") / n_splits).cast("bigint").alias("__i"))
    place = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), "__f", "__i"), 256), 1, 13), 16, 10).cast("bigint") % n
    drawn = draws.select("__f", place.alias("position")).groupBy("position").agg(F.array(*[F.count_if(F.col("__f") == f) for f in range(n_splits)]).alias("__drawn"))
    # a sample meets the draws of all splits in one row, and only then is it a row for each
    placed = global_position(samples.select(id_col), id_col).join(drawn, "position", "left")
    joined = placed.select(id_col, "__drawn", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("__f")).withColumn("times", F.nullif(F.get("__drawn", F.col("__f")), F.lit(0)))
    return joined.select(
        F.concat(F.lit("fold"), F.col("__f").cast("string")).alias("fold_id"), id_col, F.when(F.col("times").isNull(), "validation").otherwise("train").alias("role"), F.coalesce("times", F.lit(1)).alias("times")
    )


def supplied_violations(members: DataFrame, universe: DataFrame, partitioned: bool = True, groups: DataFrame | None = None) -> DataFrame:
    """(rule, fold_id, sample_id): what forbids the use of a table of folds that came from elsewhere.

    ``role`` (neither train nor validation), ``null`` (no fold or sample), ``repeated`` (twice in one role; with a column
    ``times`` a repeat is a number there), ``times`` (not a positive number), ``empty`` (a fold without samples to validate
    or to train on), those of ``fold_violations`` (``validated`` only where the folds are a partition), and ``group`` (a
    group of ``groups`` (sample_id, group_id) on both sides of a fold; its id stands for the sample).
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    named = lambda rule, df: df.select(F.lit(rule).alias("rule"), text("fold_id"), text("sample_id"))
    m = members
    sides = m.groupBy("fold_id").agg(F.count_if(F.col("role") == "validation").alias("v"), F.count_if(F.col("role") == "train").alias("t"))
    out = named("role", m.where(F.col("role").isNull() | ~F.col("role").isin("train", "validation")))
    out = out.unionByName(named("null", m.where("fold_id is null or sample_id is null")))
    out = out.unionByName(named("repeated", m.groupBy("fold_id", "sample_id", "role").count().where("count > 1")))
    out = out.unionByName(named("empty", sides.where("v = 0 or t = 0").withColumn("sample_id", F.lit(None).cast("string"))))
    if "times" in m.columns:
        out = out.unionByName(named("times", m.where("times is null or times < 1")))
    rules = fold_violations(m, universe.select("sample_id").distinct(), True).where(F.lit(partitioned) | (F.col("rule") != "validated"))
    out = out.unionByName(rules.select("rule", text("fold_id"), text("sample_id")))
    if groups is not None:
        out = out.unionByName(straddling(m, groups, "group_id").select(F.lit("group").alias("rule"), text("fold_id"), F.col("unit").cast("string").alias("sample_id")))
    return out


def doubtful(members: DataFrame, universe: DataFrame, partitioned: bool = True) -> DataFrame:
    """Samples and folds where a rule of ``supplied_violations`` (but for groups) may be broken: without any row none is."""
    wrong = F.col("role").isNull() | ~F.col("role").isin("train", "validation") | F.col("fold_id").isNull() | F.col("sample_id").isNull()
    if "times" in members.columns:
        wrong = wrong | F.col("times").isNull() | (F.col("times") < 1)
    v = F.coalesce((F.col("role") == "validation").cast("int"), F.lit(0))
    text = lambda c: F.col(c).cast("string").alias(c)
    rows = members.select("sample_id", text("fold_id"), wrong.alias("wrong"), v.alias("v"), F.lit(1).alias("m"), F.lit(0).alias("u"))
    rows = rows.unionByName(universe.select("sample_id", F.lit(None).cast("string").alias("fold_id"), F.lit(False).alias("wrong"), F.lit(0).alias("v"), F.lit(0).alias("m"), F.lit(1).alias("u")))
    sums = [F.max("wrong").alias("wrong"), F.sum("v").alias("v"), F.max("u").alias("u")]
    # by sample alone, so that the second aggregation moves no rows
    each = rows.repartition("sample_id").groupBy("sample_id", "fold_id").agg(*sums, F.sum("m").alias("m"))
    one = each.groupBy("sample_id").agg(*sums, F.max("m").alias("m"))
    bad = F.col("wrong") | (F.col("m") > 1) | (F.col("u") == 0)
    sides = members.groupBy(text("fold_id")).agg(F.count_if(F.col("role") == "validation").alias("v"), F.count_if(F.col("role") == "train").alias("t"))
    return one.where(bad | (F.col("v") != 1) if partitioned else bad).select(text("sample_id")).union(sides.where("v = 0 or t = 0").select("fold_id"))


def supplied(members: DataFrame, universe: DataFrame, partitioned: bool = True, groups: DataFrame | None = None) -> DataFrame:
    """``members``, if nothing forbids their use as folds of ``universe``; else OofValidation with the first violations.

    One aggregation by sample tells whether a rule can be broken at all; only then, or with ``groups``, are the violations looked up.
    """
    if groups is None and doubtful(members, universe, partitioned).isEmpty():
        return members
    strict(supplied_violations(members, universe, partitioned, groups), OofValidation, "a supplied fold set")
    return members


def fold_violations(members: DataFrame, universe: DataFrame, partitioned: bool = True) -> DataFrame:
    """(rule, fold_id, sample_id): overlaps of train and validation, unknown samples, wrong validation counts."""
    overlap = members.groupBy("fold_id", "sample_id").agg(F.count_distinct("role").alias("n")).where("n > 1").select(F.lit("overlap").alias("rule"), "fold_id", "sample_id")
    foreign = members.join(universe, "sample_id", "left_anti").select(F.lit("foreign").alias("rule"), "fold_id", "sample_id").distinct()
    validated = members.where("role = 'validation'").groupBy("sample_id").agg(F.count("*").alias("n"))
    wrong = universe.join(validated, "sample_id", "left").where(F.coalesce("n", F.lit(0)) != 1 if partitioned else F.coalesce("n", F.lit(0)) < 1)
    return overlap.union(foreign).union(wrong.select(F.lit("validated").alias("rule"), F.lit(None).cast("string").alias("fold_id"), "sample_id"))


def straddling(members: DataFrame, units: DataFrame, unit_col: str) -> DataFrame:
    """(fold_id, unit): units (groups, targets) with samples on both sides of a fold."""
    return members.join(units.select("sample_id", unit_col), "sample_id").groupBy("fold_id", unit_col).agg(F.count_distinct("role").alias("n")).where("n > 1").select("fold_id", F.col(unit_col).alias("unit"))
