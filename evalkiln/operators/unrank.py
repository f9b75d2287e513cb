"""Search spaces by rank: variant i is computed from i, so a count or a sample costs its own size, not that of the space.

Ranks are rows of a table; products, k-subsets, k-permutations and what is picked from those again are expressions.
"""

from __future__ import annotations

from math import comb, perm

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalkiln.functions.hashing import seed_key
from evalkiln.operators.order import position

#: Items of which subsets are taken, and the largest rank that a long holds.
MAX_ITEMS, MAX_RANK = 10_000, (1 << 63) - 1


def _checked(total: int) -> int:
    if not 0 < total <= MAX_RANK:
        raise ValueError(f"a search space of {total} variants")
    return total


def items_of(df: DataFrame, col: str) -> DataFrame:
    """(item, pos): the distinct values of a column in their order, numbered from 0."""
    return position(df.select(F.col(col).alias("item")).where("item is not null").distinct(), "item", name="pos").select("item", "pos")


def ranks(spark: SparkSession, total: int, count: int | None = None) -> DataFrame:
    """(i): the ranks of a space, or the first ``count`` of them."""
    return spark.range(min(_checked(total), total if count is None else count)).toDF("i")


def sampled_ranks(spark: SparkSession, total: int, count: int, seed: int) -> DataFrame:
    """(i): ``count`` different ranks by a seeded hash, all if there are no more.

    Draws are made in rounds of a few more than are missing; a draw that repeats an earlier one doesn't count.
    """
    if count >= _checked(total):
        return ranks(spark, total)
    if 4 * count > total:  # nearly all: an order of all ranks costs little more
        return spark.range(total).toDF("i").orderBy(seed_key(seed, "rank", F.col("i").cast("string")), "i").limit(count)
    draw = F.conv(F.substring(seed_key(seed, "draw", F.col("id").cast("string")), 1, 15), 16, 10).cast("bigint") % total
    many = 2 * count + 20
    while True:  # a quarter of the ranks at most: two draws for each find enough but by rare chance
        found = spark.range(many).select(draw.alias("i"), "id").groupBy("i").agg(F.min("id").alias("first"))
        if many > 64 * count or found.count() >= count:
            return found.orderBy("first").limit(count).select("i")
        many *= 2


def _div(a: Column, b: Column) -> Column:
    """Whole division of longs; a quotient of doubles would lose digits."""
    return F.call_function("div", a, b)


def product_positions(i: Column, sizes: list[int]) -> list[Column]:
    """The position in each dimension of product i; the first dimension is the slowest."""
    out, stride = [], _checked(_total(sizes))
    for size in sizes:
        stride //= size
        out.append((_div(i, F.lit(stride)) % size).cast("bigint"))
    return out


def _total(sizes: list[int]) -> int:
    total = 1
    for s in sizes:
        total *= s
    return total


def products(at: DataFrame, dims: list[tuple[str, DataFrame]]) -> DataFrame:
    """``at`` (i) with one column for each dimension (name, items): its choice in product i.

    ``items`` has (item, pos). Each dimension is joined by position, so no product is made.
    """
    sizes = [d.count() for _, d in dims]
    out = at.withColumns({f"__p{j}": p for j, p in enumerate(product_positions(F.col("i"), sizes))})
    for j, (name, d) in enumerate(dims):
        side = d.select(F.col("pos").alias(f"__p{j}"), F.col("item").alias(name))
        out = out.join(F.broadcast(side) if sizes[j] <= MAX_ITEMS else side, f"__p{j}")
    return out.drop(*[f"__p{j}" for j in range(len(dims))])


def subset_positions(i: Column, n: int, k: int) -> Column:
    """The positions of the i-th k-subset of n items, in the order of the rising positions."""
    if not 0 < k <= n or n > MAX_ITEMS:
        raise ValueError(f"{k} of {n} items")
    _checked(comb(n, k))
    # of[p][left]: how many subsets of the items behind p have ``left`` members
    behind = F.array(*[F.array(*[F.lit(comb(n - p - 1, left)).cast("bigint") for left in range(k)]) for p in range(n)])
    start = F.struct(i.cast("bigint").alias("rest"), F.array().cast("array<int>").alias("chosen"))

    def step(s: Column, p: Column) -> Column:
        left = F.lit(k - 1) - F.size(s["chosen"])
        with_p = F.when(left >= 0, F.get(F.get(behind, p), left)).otherwise(F.lit(0))
        take = (left >= 0) & (s["rest"] < with_p)
        return F.struct(F.when(take | (left < 0), s["rest"]).otherwise(s["rest"] - with_p).alias("rest"), F.when(take, F.concat(s["chosen"], F.array(p))).otherwise(s["chosen"]).alias("chosen"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), start, step, lambda s: s["chosen"])


def arrangement_positions(i: Column, n: int, k: int) -> Column:
    """The positions of the i-th k-permutation of n items, in the order of their positions one by one."""
    if not 0 < k <= n or n > MAX_ITEMS:
        raise ValueError(f"{k} of {n} items")
    _checked(perm(n, k))
    strides = F.array(*[F.lit(perm(n - j - 1, k - j - 1)).cast("bigint") for j in range(k)])
    start = F.struct(i.cast("bigint").alias("rest"), F.sequence(F.lit(0), F.lit(n - 1)).alias("left"), F.array().cast("array<int>").alias("chosen"))

    def step(s: Column, j: Column) -> Column:
        stride = F.get(strides, j)
        at = _div(s["rest"], stride).cast("int")
        picked = F.get(s["left"], at)
        return F.struct((s["rest"] % stride).alias("rest"), F.filter(s["left"], lambda x: x != picked).alias("left"), F.concat(s["chosen"], F.array(picked)).alias("chosen"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), start, step, lambda s: s["chosen"])


def then(i: Column, n: int, first: tuple[str, int], second: tuple[str, int]) -> Column:
    """Positions of a second pick or arrangement among the results of a first one, an array of arrays.

    ``first`` and ``second`` are ("pick" or "arrange", k): then_pick takes subsets of the found sequences, then_arrange
    orders of them. Rank i names the outer choice, whose members are ranks of the inner one.
    """
    of = {"pick": (subset_positions, comb), "arrange": (arrangement_positions, perm)}
    inner, count = of[first[0]]
    outer, _ = of[second[0]]
    return F.transform(outer(i, count(n, first[1]), second[1]), lambda r: inner(r, n, first[1]))


def named(positions: Column, items: Column) -> Column:
    """The items at the positions; ``items`` is an array in the order of positions."""
    return F.transform(positions, lambda p: F.get(items, p))
