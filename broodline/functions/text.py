"""Cleaning expressions for messy text columns.

Everything here is a native Spark expression, so a chain of them stays inside
one whole-stage-codegen projection and never adds a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ReplaceRules = Iterable[tuple[str, str]]
Recodes = Mapping[str, str | None] | Iterable[tuple[str, str | None]]

# Text a numeric column accepts: sign, digits with an optional point, exponent,
# or an infinity. Spark's own cast would also take Java suffixes such as "12d".
NUMBER_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def canonicalize(
    name: Column | str, rules: ReplaceRules, strip: str = " ", whole_value: bool = False
) -> Column:
    """Run substring replacements in the given order, then trim both ends.

    Order is part of the contract: a later rule sees the text an earlier one
    produced, and a rule whose output contains its own input is not idempotent.
    ``whole_value`` replaces complete names only, which leaves clean names alone.
    """
    if whole_value:
        return F.btrim(recode(name, rules), F.lit(strip))
    replaced = reduce(
        lambda text, rule: F.replace(text, F.lit(rule[0]), F.lit(rule[1])),
        rules,
        as_column(name),
    )
    return F.btrim(replaced, F.lit(strip))


def collapse_recodes(recodes: Recodes) -> dict[str, str | None]:
    """Fold a sequence of whole-value replacements into one lookup.

    ``[("a", "b"), ("b", "c")]`` sends both ``a`` and ``b`` to ``c``, as applying
    them one after another does; a value mapped to None stays None.
    """
    steps = list(recodes.items()) if isinstance(recodes, Mapping) else list(recodes)
    folded: dict[str, str | None] = {}
    for source, target in steps:
        for known, current in folded.items():
            if current == source:
                folded[known] = target
        folded.setdefault(source, target)
    return folded


def recode(value: Column | str, recodes: Recodes) -> Column:
    """Whole-value replacement; values without a rule pass through unchanged."""
    column = as_column(value)
    result = None
    for source, target in collapse_recodes(recodes).items():
        hit = column == F.lit(source)
        outcome = F.lit(target).cast("string")
        result = F.when(hit, outcome) if result is None else result.when(hit, outcome)
    return column if result is None else result.otherwise(column)


def normalized_key(value: Column | str, strip: str = " ") -> Column:
    """Comparison form of a name: trimmed and upper-cased; NULL stays NULL."""
    return F.upper(F.btrim(as_column(value), F.lit(strip)))


def compound(first: Column | str, second: Column | str, separator: str = "_") -> Column:
    """Joined key that is NULL as soon as one part is NULL."""
    return F.concat(as_column(first), F.lit(separator), as_column(second))


def capitalize(value: Column | str) -> Column:
    """First character upper-case, the rest lower-case."""
    column = as_column(value)
    return F.concat(F.upper(F.substring(column, 1, 1)), F.lower(F.substr(column, F.lit(2))))


def to_number(value: Column | str) -> Column:
    """Text to double; anything that is not a number becomes NULL."""
    text = as_column(value).cast("string")
    return F.when(text.rlike(NUMBER_TEXT), F.trim(text).try_cast("double"))


#: Spellings of a day that reports accept beside ISO text.
DAY_FORMATS = ("yyyy/M/d", "d MMM yyyy", "MMM d, yyyy", "M/d/yyyy")


def to_day(value: Column | str, formats: Sequence[str] = (), strict: bool = False) -> Column:
    """Timestamp, date or text to a date.

    Text is read as ISO, then by each of ``formats``. Text that fits none becomes
    NULL, or fails the query if ``strict``; NULL and blank text are NULL either way.
    """
    column = as_column(value)
    text = F.trim(column.cast("string"))
    tried = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats]
    day = F.coalesce(column.try_cast("date"), *tried)
    if not strict:
        return day
    unreadable = F.raise_error(F.concat(F.lit("not a day: "), text)).cast("date")
    return F.when(day.isNotNull() | text.isNull() | (text == ""), day).otherwise(unreadable)
