"""Scoped views of relations: rows by identity, role, source, metadata, tag or filter, and columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from evalkiln.checks import CampaignValidation
from evalkiln.operators.identity import excluded_samples


@dataclass(frozen=True)
class ViewPolicy:
    """Which partition a phase fits on and predicts; what is unsafe has to be allowed by name."""

    fit: str = "fold_train"
    predict: str = "fold_validation"
    augmented_train: bool = True
    augmented_validation: bool = False
    unsafe: frozenset[str] = frozenset()

    def check(self) -> None:
        """Raise if ``refusal`` would name a reason."""
        if self.fit in ("full_train", "fold_validation") and "full_train_fit" not in self.unsafe:
            raise CampaignValidation(f"fitting on {self.fit} leaks validation rows")
        if self.augmented_validation and "augmented_validation" not in self.unsafe:
            raise CampaignValidation("augmented rows in validation need an unsafe flag")


#: The partition by phase; without a fold PREDICT and EXPLAIN are unrestricted.
PHASE_PARTITION = {"FIT_CV": "fold_train", "REFIT": "full_train", "PREDICT": "predict", "EXPLAIN": "predict"}


def partition_view(relations: DataFrame, fold_of: DataFrame, partition: str, fold: int | None = None) -> DataFrame:
    """Rows of a partition. Train is "not in this fold", so k-fold train sets are never materialised k times."""
    if partition == "fold_train":
        return relations.join(fold_of.where(F.col("fold") != fold), "sample_id", "left_semi")
    if partition == "fold_validation":
        return relations.join(fold_of.where(F.col("fold") == fold), "sample_id", "left_semi")
    if partition == "full_train":
        return relations.join(fold_of, "sample_id", "left_semi")
    if partition == "predict":
        return relations.join(fold_of, "sample_id", "left_anti")
    raise CampaignValidation(f"no such partition: {partition}")


def fit_view(relations: DataFrame, fold_of: DataFrame, fold: int, columns: list[str] | None = None) -> DataFrame:
    """Train rows of a fold without any row of a sample that is excluded anywhere."""
    rows = partition_view(relations, fold_of, "fold_train", fold).join(excluded_samples(relations), "sample_id", "left_anti")
    return rows.select(*columns) if columns else rows


def by_source(relations: DataFrame, source: str) -> DataFrame:
    return relations.where(F.col("source_id") == source)


def by_metadata(relations: DataFrame, key: str, value: str, column: str = "metadata") -> DataFrame:
    return relations.where(F.try_element_at(F.col(column), F.lit(key)) == value)


def refusal() -> Column:
    """Why a row of policies (fit, augmented_validation, unsafe) is refused, the rules of ``ViewPolicy.check``; null if it is allowed."""
    allowed = lambda flag: F.array_contains("unsafe", flag)
    return F.when(F.col("fit").isin("full_train", "fold_validation") & ~allowed("full_train_fit"), "full_train_fit").when(F.col("augmented_validation") & ~allowed("augmented_validation"), "augmented_validation")


def by_tags(relations: DataFrame, *tags: str) -> DataFrame:
    return relations.where(F.array_contains("tags", tags[0]) if len(tags) == 1 else F.arrays_overlap("tags", F.array(*map(F.lit, tags))))


def by_filter(relations: DataFrame, expression: str) -> DataFrame:
    """Rows for which a Spark SQL predicate is true."""
    return relations.where(F.expr(expression))


def separation(relations: DataFrame, source: str | None = None, metadata: tuple[str, str] | None = None, tag: str | None = None, expression: str | None = None) -> DataFrame:
    """The first selector that is set, in the order source, metadata, tag, filter."""
    if source is not None:
        return by_source(relations, source)
    if metadata is not None:
        return by_metadata(relations, *metadata)
    if tag is not None:
        return by_tags(relations, tag)
    if expression is not None:
        return by_filter(relations, expression)
    raise CampaignValidation("a separation needs a selector")


def fan_out(values: DataFrame, col: str) -> DataFrame:
    """(value, branch_id): one branch per distinct value; ids that collide after cleaning are a violation (n > 1)."""
    from evalkiln.functions.scalars import sanitise_label

    ids = values.select(F.col(col).alias("value")).where("value is not null").distinct().withColumn("branch_id", F.concat(F.lit("branch_"), sanitise_label(F.col("value"))))
    return ids.join(ids.groupBy("branch_id").agg(F.count("*").alias("n_same_id")), "branch_id").select("value", "branch_id", "n_same_id")


def masks(relations: DataFrame, named: dict[str, str], mode: str) -> DataFrame:
    """Rows with a boolean column per predicate and ``masked``: any of them, or all."""
    out = relations.withColumns({name: F.coalesce(F.expr(e), F.lit(False)) for name, e in named.items()})
    masked = F.lit(mode != "any")
    for name in named:
        masked = masked | F.col(name) if mode == "any" else masked & F.col(name)
    return out.withColumn("masked", masked)
