"""First contact with a table: read it, profile it, cleanse it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from broodline.operators.cleanse import CleanseRules, booking_rules, cleanse
from broodline.operators.profile import profile
from broodline.sources.tables import read_table


class Intake(NamedTuple):
    raw: DataFrame
    facts: DataFrame
    cleansed: DataFrame


def intake(
    spark: SparkSession,
    root: str,
    table: str,
    schema: str | None = None,
    rules: CleanseRules | None = None,
) -> Intake:
    """The raw table, its profile and its cleansed form; nothing runs until one is used."""
    raw = read_table(spark, root, table, schema)
    return Intake(raw, profile(raw), cleanse(raw, rules or booking_rules()))
