"""Named postprocessors and selections, the library's extension points (checks are in ``operators.checks``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profloom.operators import joins, models, nonparam

#: Postprocessors: resources to model rows.
POSTPROCESSORS: dict[str, Callable[..., DataFrame]] = {
    "regression_analysis": models.fit_all,
    "regressogram": nonparam.regressogram,
    "moving_average": nonparam.moving_average_model,
    "kernel_regression": nonparam.kernel_model,
}


def postprocess(name: str, resources: DataFrame, *keys: str, **options) -> DataFrame:
    return POSTPROCESSORS[name](resources, *keys, **options)


#: Selections: (target profiles, versions, all profiles) to (target_id, baseline_id) pairs.
SELECTIONS: dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]] = {
    "parents": joins.parent_baselines,
    "ancestors": joins.ancestor_baselines,
}


def history_pairs(versions: DataFrame, profiles: DataFrame, selection: str = "parents", version: str | None = None) -> DataFrame:
    """Pairs to compare for one version, or for every version of the history."""
    targets = profiles if version is None else profiles.where(F.col("version") == version)
    return SELECTIONS[selection](targets, versions, profiles)
