"""Table cleansing driven by a declarative list of rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from broodline.functions.text import recode
from broodline.operators.impute import fill_missing, mode_value, present


@dataclass(frozen=True)
class CleanseRules:
    """What to do, in the order the fields are listed."""

    drop_duplicates: bool = False
    fill: Mapping[str, Any] = field(default_factory=dict)
    fill_with_mode: Sequence[str] = ()
    drop: Sequence[str] = ()
    recode: Mapping[str, Mapping[str, str | None]] = field(default_factory=dict)
    keep: Column | None = None


def booking_rules() -> CleanseRules:
    """Rules for the hotel-booking table: at least one adult per booking."""
    return CleanseRules(
        fill={"children": 0},
        fill_with_mode=["agent"],
        drop=["company"],
        recode={"meal": {"Undefined": "No Meal"}},
        keep=F.col("adults") > 0,
    )


def cleanse(
    df: DataFrame,
    rules: CleanseRules,
    before: Observation | None = None,
    after: Observation | None = None,
) -> DataFrame:
    """Apply the rules; an unknown column raises.

    ``before`` and ``after`` receive ``row_count`` when the result is computed,
    without another pass over the data.
    """
    unknown = {*rules.fill, *rules.fill_with_mode, *rules.drop, *rules.recode} - set(df.columns)
    if unknown:
        raise ValueError(f"columns not in the table: {sorted(unknown)}")
    count = F.count(F.lit(1)).alias("row_count")
    result = df.observe(before, count) if before is not None else df
    plain = df  # the same rows, not observed a second time by the subqueries
    if rules.drop_duplicates:
        result, plain = result.dropDuplicates(), plain.dropDuplicates()
    if rules.fill:
        result, plain = result.fillna(dict(rules.fill)), plain.fillna(dict(rules.fill))
    modes = {
        name: fill_missing(name, mode_value(plain, name), present(plain, name))
        for name in rules.fill_with_mode
    }
    if modes:
        result = result.withColumns(modes)
    result = result.drop(*rules.drop)
    recoded = {name: recode(name, steps) for name, steps in rules.recode.items()}
    if recoded:
        result = result.withColumns(recoded)
    if rules.keep is not None:
        result = result.where(rules.keep)
    return result.observe(after, count) if after is not None else result
