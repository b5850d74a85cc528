"""Metric definitions as Columns, used by every report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; null where whole is zero or null."""
    whole = whole.cast("double")
    return F.when(whole != 0, part.cast("double") / whole)


def yoy_pct(current: Column, prior: Column) -> Column:
    """Growth in percent, two digits; null where prior is zero."""
    return F.round(ratio((current - prior) * 100, prior), 2)


def cagr_pct(first: Column, last: Column, span: int) -> Column:
    """Compound growth a period in percent; null unless both ends and span are positive."""
    if span <= 0:
        return F.lit(None).cast("double")
    return F.when((first > 0) & (last > 0), F.round((F.pow(last.cast("double") / first.cast("double"), F.lit(1 / span)) - 1) * 100, 4))


def selling_price(sales: Column, units: Column, digits: int = 2) -> Column:
    """Average price of a unit, rounded exactly from cents; null without units."""
    return F.when(units != 0, F.round(sales.cast("decimal(20,2)") / units.cast("decimal(12,0)"), digits).cast("double"))


def in_list(column: Column, values: str | list[str] | None, strip_zeros: bool = False) -> Column:
    """Optional filter: a list or comma-separated text of values; none, empty or ALL lets all pass.

    Blanks around values and empty values don't count. With strip_zeros a value
    also matches if both agree without leading zeros.
    """
    if isinstance(values, str) or values is None:
        values = (values or "").split(",")
    wanted = [v.strip() for v in values if v.strip()]
    if not wanted or any(v.upper() == "ALL" for v in wanted):
        return F.lit(True)
    found = column.isin(wanted)
    if strip_zeros:
        found = found | F.regexp_replace(column, "^0+", "").isin([v.lstrip("0") for v in wanted])
    return found


def total(column: Column | str) -> Column:
    """Sum of money as double, exact to the cent."""
    return F.sum(column).cast("double")


def units(column: Column | str) -> Column:
    return F.sum(column).cast("long")


def greatest_or_null(*columns: Column) -> Column:
    """The greatest value; null as soon as one is null."""
    some_null = F.lit(False)
    for c in columns:
        some_null = some_null | c.isNull()
    return F.when(~some_null, F.greatest(*columns))


def vendor_label(name: Column) -> Column:
    """A vendor's name without its number and outer blanks; if it is all upper case, every run of letters
    starts with a capital, also after a hyphen, an apostrophe or a digit."""
    bare = F.regexp_replace(F.regexp_replace(name, r"(?U)^\s*\d+\s*[-:]\s*", ""), r"(?U)^\s+|\s+$", "")
    runs = F.regexp_extract_all(bare, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    title = F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))), "")
    return F.when((bare == F.upper(bare)) & bare.rlike(r"\p{Lu}"), title).otherwise(bare)


def bottle_label(millilitres: Column) -> Column:
    """A size as shown on shelves: 1L and 1.75L by name, all others in millilitres; Other if null."""
    shown = F.concat(millilitres.cast("long").cast("string"), F.lit("ml"))
    return F.when(millilitres.isNull(), "Other").when(millilitres.cast("long") == 1000, "1L").when(millilitres.cast("long") == 1750, "1.75L").otherwise(shown)
