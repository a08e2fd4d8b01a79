"""Recent-cycle scorecards: the seven newest cycles of each group side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broodline.functions.numeric import growth_rate, percent
from broodline.functions.text import Recodes, compound, recode, to_day, to_number
from broodline.operators.windows import latest_n, spread_ranked

# Fixed value: cycles per scorecard.
RECENT = 7


def recent_scorecard(
    df: DataFrame,
    kind: str = "doc",
    kind_only: bool = False,
    inplace: bool = True,
    combination: str = "hatchery",
    brand_recodes: Recodes = (),
    place_recodes: Recodes = (),
    n: int = RECENT,
) -> DataFrame:
    """Newest ``n`` cycles per group, one wide row per group.

    Columns read: ``unit``, ``cycle_start``, the brand column named by ``kind``
    (``doc`` or ``feed``), the place column named by ``combination``,
    ``mortality_8``, ``bw_0``, ``bw_8``. The group is the brand (``kind_only``),
    the place (``inplace=False``) or ``brand_place``. Chick scorecards show
    mortality in percent and leave out rows above 100; feed scorecards show it as
    recorded. Newest first, ties by unit.
    """
    if kind not in ("doc", "feed"):
        raise ValueError(f"kind must be 'doc' or 'feed', not {kind!r}")
    chicks = kind == "doc"
    mortality = F.col("mortality_8")
    rows = df.select(
        "unit",
        to_day("cycle_start").alias("cycle_start"),
        recode(kind, brand_recodes).alias(kind),
        recode(combination, place_recodes).alias(combination),
        (percent(mortality) if chicks else mortality).alias("mortality_8"),
        to_number("bw_0").alias("bw_0"),
        to_number("bw_8").alias("bw_8"),
    ).withColumn("growth", growth_rate("bw_8", "bw_0"))
    if chicks:
        rows = rows.where(F.col("mortality_8") <= 100)

    required, shown = _layout(kind, combination, kind_only, inplace)
    keyed = rows.dropna(subset=required).withColumn(
        "grp", _group(kind, combination, kind_only, inplace)
    )
    metrics = {m: F.round(F.col(m), 2) for m in ("mortality_8", "bw_0", "bw_8", "growth")}
    newest = latest_n(keyed, ["grp"], [F.col("cycle_start").desc(), F.col("unit").asc()], n)
    return spread_ranked(newest.withColumns(metrics), ["grp"], shown, n)


def _group(kind: str, combination: str, kind_only: bool, inplace: bool) -> Column:
    if kind_only:
        return F.col(kind)
    return compound(kind, combination, "_") if inplace else F.col(combination)


def _layout(
    kind: str, combination: str, kind_only: bool, inplace: bool
) -> tuple[Sequence[str], Sequence[str]]:
    """Columns that must be present and columns shown per cycle."""
    shown = ["cycle_start", "unit", "mortality_8", "bw_0", "bw_8", "growth"]
    if kind == "doc":
        return [kind, combination], (shown + [combination] if kind_only else shown)
    if kind_only:
        return [kind], shown + [combination]
    if inplace:
        return [kind, combination], shown + [combination, kind]
    return [combination], shown + [kind]
