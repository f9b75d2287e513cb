"""Scalar functions: identifiers, labels, exact conformal arithmetic, vectors."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F


def id_valid(c: Column) -> Column:
    """Identifiers have 1 to 128 bytes of letters, digits, underscore, dot, colon and hyphen."""
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_.:\-]{1,128}$"), F.lit(False))


def sanitise_label(c: Column) -> Column:
    """Everything but ASCII letters, digits and underscore becomes an underscore; those at the ends go."""
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_]", "_"), r"^_+|_+$", "")


def oriented(score: Column, lower_is_better: bool) -> Column:
    return -score if lower_is_better else score


def exact(c: Column) -> Column:
    """The shortest decimal of a double, to 18 places; zero, or a size from 1e-18 to below 1e20. Others are refused, not bent."""
    d = c.cast("string").try_cast("decimal(38,18)")
    bent = d.isNull() | ((d == 0) & (c != 0))
    return F.when(c.isNotNull() & bent, F.raise_error(F.concat(F.lit("outside the exact range of 1e-18 to 1e20: "), c.cast("string"))).cast("decimal(38,18)")).otherwise(d)


def conformal_rank(n: Column, coverage: Column) -> Column:
    """ceil((n + 1) * coverage) on the shortest decimal of the coverage, not on its binary value."""
    return F.ceil((n + 1).cast("decimal(20,0)") * coverage.cast("string").cast("decimal(18,17)")).cast("bigint")


def interval(prediction: Column, radius: Column) -> tuple[Column, Column]:
    """Ends of prediction -/+ radius by decimal arithmetic; null where the radius is unbounded."""
    return (exact(prediction) - exact(radius)).cast("double"), (exact(prediction) + exact(radius)).cast("double")


def midpoint(lower: Column, upper: Column) -> Column:
    return lower / 2 + upper / 2


def snv(vector: Column) -> Column:
    """Standard normal variate of an array: minus its mean, by its sample deviation; zeros for a constant one."""
    values = F.transform(vector, lambda x: x.cast("double"))
    n = F.size(vector)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    centred = F.transform(F.array(mean), lambda m: F.transform(values, lambda x: x - m))[0]

    def scaled(v: Column) -> Column:
        sd = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) / F.greatest(n - 1, F.lit(1)))
        return F.transform(F.array(sd), lambda s: F.transform(v, lambda x: F.when(s > 0, x / s).otherwise(0.0)))[0]

    return F.transform(F.array(centred), scaled)[0]


#: Which role the nodes of a chain play. All other kinds are "other".
CHAIN_ROLES = {
    "transform": "preprocessing",
    "y_transform": "target",
    "split": "split",
    "model": "model",
    "augmentation": "augmentation",
    "feature_join": "feature",
    "source_join": "feature",
}


def chain_role(kind: Column) -> Column:
    """The role of a node kind; kinds without one are ``other``."""
    pairs = [x for k, v in CHAIN_ROLES.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit("other"))


#: What names of classes say about an operator, the first kind that fits. Of the whole dotted name, in
#: lower case: its start, all of it, or a part; of its last piece: a part, its end, or all of it.
ALIASES = {
    "chart": {"starts": ("chart_",), "is": ("chart",), "holds": (".charts.", ".visualization.")},
    "tuner": {"holds": (".tuners.", ".tuning.", "operators.tuners", "optuna", "ray.tune", "hyperopt"), "last_ends": ("tuner", "searchcv")},
    "split": {
        "holds": ("model_selection", ".splitters.", "operators.splitters"), "last_holds": ("splitter",), "last_ends": ("fold", "split"),
        "last_is": ("leaveoneout", "leavepout"),
    },
    "model": {
        "holds": (".models.", "operators.models", "linear_model", "cross_decomposition", ".ensemble.", ".svm.", ".tree.", ".neighbors.", ".neural_network.", "xgboost", "lightgbm", "catboost"),
        "last_ends": ("regressor", "classifier", "regression"),
        "last_is": ("ridge", "lasso", "elasticnet", "svr", "svc", "linearsvr", "linearsvc", "pls", "plsr", "metamodel"),
    },
}


def alias_kind(name: Column) -> Column:
    """What an operator's class name says about its kind: the first of ALIASES that fits, else ``transform``."""
    whole = F.lower(name)
    last = F.regexp_extract(whole, r"([^.:]*)$", 1)
    tests = {
        "starts": lambda x: whole.startswith(x), "is": lambda x: whole == x, "holds": lambda x: whole.contains(x),
        "last_holds": lambda x: last.contains(x), "last_ends": lambda x: last.endswith(x), "last_is": lambda x: last == x,
    }
    kinds = [F.when(reduce(or_, [tests[how](x) for how, values in rules.items() for x in values]), kind) for kind, rules in ALIASES.items()]
    return F.coalesce(*kinds, F.lit("transform"))
