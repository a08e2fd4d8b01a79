"""Which brands go with a better outcome: correlations per calendar bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from broodline.functions.calendar import calendar_parts
from broodline.functions.numeric import nan_as_null, percent, price_band
from broodline.functions.text import DAY_FORMATS, Recodes, compound, recode, to_day, to_number
from broodline.operators.aggregate import brand_families, family_columns, used_families
from broodline.operators.association import indicator_correlation
from broodline.operators.impute import exact_median, fill_missing


def brand_and_place(
    df: DataFrame,
    brand: str,
    place: str,
    day: str,
    outcome: str,
    brand_recodes: Recodes = (),
    place_recodes: Recodes = (),
    outcome_is_fraction: bool = False,
    year_mode: str = "iso",
) -> DataFrame:
    """Correlation of every brand and every ``brand__place`` with the outcome (see :func:`place_rows`)."""
    dated = place_rows(df, brand, place, day, outcome, brand_recodes, place_recodes, outcome_is_fraction, year_mode)
    return indicator_correlation(dated, PLACE_CELL, place_features(), "y")


#: What a row of the brand and place report falls under.
PLACE_CELL = ["brand", "place"]


def place_features() -> Column:
    return F.array("brand", compound("brand", "place", "__"))


def place_rows(
    df: DataFrame,
    brand: str,
    place: str,
    day: str,
    outcome: str,
    brand_recodes: Recodes = (),
    place_recodes: Recodes = (),
    outcome_is_fraction: bool = False,
    year_mode: str = "iso",
) -> DataFrame:
    """``day, brand, place, y`` with the calendar parts of the day.

    A fractional outcome (mortality) is turned into percent and rows above 100
    are left out.
    """
    y = _numeric(df, outcome)
    rows = df.select(
        to_day(day, DAY_FORMATS, strict=True).alias("day"),
        recode(brand, brand_recodes).alias("brand"),
        recode(place, place_recodes).alias("place"),
        (percent(y) if outcome_is_fraction else y).alias("y"),
    )
    if outcome_is_fraction:
        rows = rows.where(F.col("y") <= 100)
    rows = rows.dropna(subset=["brand", "place", "day"])
    return rows.withColumns(calendar_parts("day", year_mode))


def brand_and_price(
    df: DataFrame,
    brand: str,
    price: str,
    day: str,
    outcome: str = "bw_28",
    brand_recodes: Recodes = (),
    year_mode: str = "iso",
) -> DataFrame:
    """Correlation of every ``brand_priceband`` with the outcome.

    Missing prices take the median price of the rows with a brand and a day.
    """
    rows = df.select(
        to_day(day, DAY_FORMATS, strict=True).alias("day"),
        recode(brand, brand_recodes).alias("brand"),
        _numeric(df, price).alias("price"),
        _numeric(df, outcome).alias("y"),
    ).dropna(subset=["brand", "day"])
    # The fill is a column of its own: each use of it in a band would be another subquery.
    filled = rows.withColumn("price", fill_missing("price", exact_median(rows, "price")))
    dated = filled.withColumns({"band": price_band("price"), **calendar_parts("day", year_mode)})
    features = F.array(compound("brand", "band", "_"))
    return indicator_correlation(dated, ["brand", "band"], features, "y")


def feed_brands(
    df: DataFrame,
    top_brand: str,
    day: str,
    outcome: str,
    phases: Sequence[str],
    days: range = range(1, 29),
    brand_recodes: Recodes = (),
    year_mode: str = "iso",
) -> DataFrame:
    """Correlation of feed use, per brand and per phase and brand, with the outcome.

    A brand counts as used when the sum of its daily columns does. Only brands
    that are some row's ``top_brand`` are reported. Only number columns other than
    the outcome can be feed columns. A day that cannot be read fails the query.
    """
    numbers = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name != outcome]
    families = family_columns(numbers, days)
    brands = brand_families(families, phases)
    rows = (
        df.withColumns(
            {
                "__day": to_day(day, DAY_FORMATS, strict=True),
                "__top": recode(top_brand, brand_recodes),
                "__y": _numeric(df, outcome),
            }
        )
        .dropna(subset=["__day", "__top", "__y"])
        .withColumns({"__used": used_families(families), **calendar_parts("__day", year_mode)})
    )
    found = indicator_correlation(rows, ["__used"], F.col("__used"), "__y")
    leading = rows.select(F.col("__top").alias("leader")).distinct()
    names = {family: _brand_of(family, brands, phases) for family in families}
    brand = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("feature")]
    return found.join(leading, brand == F.col("leader"), "left_semi")


def _numeric(df: DataFrame, name: str) -> Column:
    """The column as a double; NaN and text that is no number become NULL."""
    if isinstance(df.schema[name].dataType, NumericType):
        return nan_as_null(F.col(name).cast("double"))
    return nan_as_null(to_number(name))


def _brand_of(family: str, brands: Sequence[str], phases: Sequence[str]) -> str:
    if family in brands:
        return family
    phase = next(p for p in phases if family.startswith(f"{p}_"))
    return family[len(phase) + 1 :]
