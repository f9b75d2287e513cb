"""Positions, running sums and order statistics of tables that don't fit one task.

The wanted order is cut into ranges at values of a sample. Every row finds its range by binary search; running sums are
taken within ranges, and the sums of the ranges before are added from a small table. The sample only sets how even the
ranges are, never a result. Keys are part of the order, so a key that holds most rows is cut like everything else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows that one range should hold, ranges at most, and sampled rows for each range.
RANGE_ROWS, MAX_RANGES, SAMPLED = 50_000, 10_000, 20


def with_range(df: DataFrame, order: list[str], name: str = "__range") -> DataFrame:
    """``df`` with the number of the range that a row is in, by the columns ``order``; nulls come first.

    Ranges follow the order: a row of a smaller range is never behind one of a larger. Rows that are equal in all columns
    are in one range. Up to RANGE_ROWS rows are one range, for the price of a count.
    """
    return _ranged(df, order, name)[0]


def _ranged(df: DataFrame, order: list[str], name: str = "__range") -> tuple[DataFrame, int]:
    """``with_range``, and how many ranges there are."""
    total = df.count()
    ranges = min(MAX_RANGES, -(-total // RANGE_ROWS))
    if ranges <= 1:
        return df.withColumn(name, F.lit(0)), 1
    key = F.struct(*[F.col(c) for c in order])
    drawn = df.select(key.alias("k")).sample(min(1.0, SAMPLED * ranges / total), seed=7).distinct().orderBy("k").limit(2 * SAMPLED * ranges).collect()
    cuts = [r.k for r in drawn[:: max(1, len(drawn) // ranges)]][1:]
    if not cuts:
        return df.withColumn(name, F.lit(0)), 1
    kind = df.select(key.alias("k")).schema["k"].dataType.simpleString()
    table = df.sparkSession.createDataFrame([(cuts,)], f"__range_cuts array<{kind}>")
    steps, top = [], 1
    while 2 * top <= len(cuts):
        top *= 2
    while top:
        steps.append(top)
        top //= 2

    def further(at: Column, step: Column) -> Column:
        """``step`` ranges on, if the row isn't before the cut there."""
        return F.when((at + step <= len(cuts)) & (F.get("__range_cuts", at + step - 1) <= F.col("__range_key")), at + step).otherwise(at)

    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)
    # the names are this step's own, so no column of the caller is replaced or dropped
    return df.withColumn("__range_key", key).crossJoin(F.broadcast(table)).withColumn(name, found).drop("__range_cuts", "__range_key"), len(cuts) + 1  # one row


def running(df: DataFrame, order: list[str], sums: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """``df`` with, for each of ``sums``, the sum over the rows before a row in the order of its key.

    Rows that tie in ``order`` come one after the other in no fixed order, so give columns that make it unique where that
    matters. Sums are of whole numbers. Nulls come first; an empty table stays empty.
    """
    keys = keys or []
    # the values are taken once, before the rows move
    rows, ranges = _ranged(df.withColumns({f"__v_{n}": c for n, c in sums.items()}), [*keys, *order])
    if ranges > 1:
        # a fixed number of partitions: ordered rows are packed so well that by bytes very many would be read together
        rows = rows.repartition(2 * ranges, "__range")
    window = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    within = rows.withColumns({f"__w_{n}": zero(F.sum(f"__v_{n}").over(window)) for n in sums})
    parts = rows.groupBy("__range", *keys).agg(*[F.sum(f"__v_{n}").alias(n) for n in sums])
    # At most a row for each range and key; a key's own window has at most one for each range.
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(F.col("__range").alias("__r"), *[F.col(k).alias(f"__k_{k}") for k in keys], *[zero(F.sum(n).over(earlier)).alias(f"__b_{n}") for n in sums])
    on = [F.col("__range") == F.col("__r"), *[F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]]
    joined = within.join(before if keys else F.broadcast(before), on)
    result = joined.withColumns({n: (F.col(f"__b_{n}") + F.col(f"__w_{n}")).cast("bigint") for n in sums})
    return result.drop("__range", "__r", *[f"__k_{k}" for k in keys], *[f"__{c}_{n}" for n in sums for c in "vwb"])


def position(df: DataFrame, *order: str, keys: list[str] | None = None, name: str = "position") -> DataFrame:
    """``df`` with the 0-based position of each row in the order of its key (of the whole table without keys)."""
    return running(df, list(order), {name: F.lit(1)}, keys)


def rank_of_values(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, value, before, ties): for each distinct value of a key, the rows with a smaller value and those with this one.

    Rows are counted by value first, so repeats cost nothing; the counts are added up by ranges.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("ties"))
    return running(counts, [value], {"before": F.col("ties")}, keys)


def order_statistics(df: DataFrame, value: str, wanted: DataFrame, keys: list[str], rank: str = "rank", name: str = "value") -> DataFrame:
    """``wanted`` (keys and a 1-based rank) with the value of that rank in its key, ascending; null beyond the last row.

    First the ranges are counted and each rank finds the one that holds it, then only the rows of those ranges are
    counted by value: no task sorts a key as a whole. ``wanted`` is small: a few ranks for each key.
    """
    ranged = with_range(df.select(*keys, F.col(value).alias("__value")), [*keys, "__value"])
    counts = ranged.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range"))  # ranges, not rows
    placed = counts.withColumn("__upto", upto)
    same = lambda a, b, names: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in names]
    holds = [F.col("p.__upto") >= F.col(f"w.{rank}"), F.col("p.__upto") - F.col("p.__n") < F.col(f"w.{rank}")]
    hit = wanted.alias("w").join(placed.alias("p"), [*same("w", "p", keys), *holds], "left").select("w.*", F.col("p.__range"), (F.col("p.__upto") - F.col("p.__n")).alias("__before"))
    few = hit.select(*keys, "__range").where("__range is not null").distinct()
    rows = ranged.alias("r").join(few.alias("f"), [*same("r", "f", keys), F.col("r.__range") == F.col("f.__range")], "left_semi")
    values = rows.groupBy(*keys, "__range", "__value").agg(F.count("*").alias("__n"))
    at = values.withColumn("__at", F.sum("__n").over(Window.partitionBy(*keys, "__range").orderBy("__value")))
    inside = [F.col("h.__before") + F.col("v.__at") >= F.col(f"h.{rank}"), F.col("h.__before") + F.col("v.__at") - F.col("v.__n") < F.col(f"h.{rank}")]
    found = hit.alias("h").join(at.alias("v"), [*same("h", "v", keys), F.col("h.__range") == F.col("v.__range"), *inside], "left")
    return found.select(*[F.col(f"h.{c}") for c in wanted.columns], F.col("v.__value").alias(name))
