"""Pareto tiers by selection: where the running share crosses a cut is found with histograms, not by sorting all items.

Items are in descending order of a measure, ties by item. Shares only grow while values are
positive, and those of all other items are 1 at least; so a tier ends at one item, the last whose running
share is within the cut. A histogram of the values tells the bin in which that is; bins are cut
finer until few items are left in them. The tier of an item then is a comparison with two
values, with no sort, window or join.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a histogram, and how many items are looked at one by one.
BINS, ONE_BY_ONE = 1024, 2000


@dataclass(frozen=True)
class Cut:
    """The last item of a tier: those of a greater value, and of its value those up to item, are in it."""

    value: int
    item: str

    def within(self, value: Column, item: Column) -> Column:
        return (value > self.value) | ((value == self.value) & (item <= F.lit(self.item)))


@dataclass(frozen=True)
class Measure:
    """A whole-number value (money in cents), its sum over all items, above zero, and its greatest value."""

    value: Column
    total: int
    most: int


@dataclass(frozen=True)
class _Range:
    """Values of a measure from low to high."""

    measure: str
    low: int
    high: int


def _rows(base: DataFrame, item: str, measures: dict[str, Measure], ranges: list[_Range]) -> DataFrame:
    """i (the range), value, item of the items in each range."""
    parts = (base.select(F.lit(i).alias("i"), measures[r.measure].value.alias("value"), F.col(item).alias("item")).filter(F.col("value").between(r.low, r.high)) for i, r in enumerate(ranges))
    return reduce(DataFrame.unionByName, parts)


def _bins(base: DataFrame, item: str, measures: dict[str, Measure], ranges: list[_Range]) -> dict[_Range, list]:
    """Bins of each range, the greatest values first: low, high, total, n."""
    width = [max(1, -(-(r.high - r.low + 1) // BINS)) for r in ranges]
    at = lambda numbers: F.array(*(F.lit(n).cast("long") for n in numbers))[F.col("i")]
    place = F.floor((F.col("value") - at([r.low for r in ranges])) / at(width))
    found = _rows(base, item, measures, ranges).groupBy("i", place.alias("bin")).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum(F.col("value").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n"))
    out: dict[_Range, list] = {r: [] for r in ranges}
    for r in sorted(found.collect(), key=lambda r: -r.low):  # BINS rows a range
        out[ranges[r.i]].append(r)
    return out


def cuts(base: DataFrame, item: str, measures: dict[str, Measure], shares: tuple[float, ...]) -> dict[tuple[str, float], Cut | None]:
    """For each measure and share the last item whose running share is no more; None if the first item already has more.

    Shares are below 1. Each round is a query over base for all measures at once; there are as many as it takes to cut the
    values' range to one that ONE_BY_ONE items share, each making it BINS times smaller, and one for the items
    that are left. Of items that tie on the very value of a cut, as many as fit are taken in order.
    """
    out: dict[tuple[str, float], Cut | None] = {(m, s): None for m in measures for s in shares}
    open_ = {key: (_Range(key[0], 1, measures[key[0]].most), 0) for key in out if measures[key[0]].most > 0}
    few: dict[tuple[str, float], tuple[_Range, int]] = {}
    while open_:
        found, narrower = _bins(base, item, measures, list(dict.fromkeys(r for r, _ in open_.values()))), {}
        for key, (range_, before) in open_.items():
            total, share = measures[key[0]].total, key[1]
            for b in found[range_]:
                if (before + int(b.total)) / total > share:
                    if b.n <= ONE_BY_ONE:
                        few[key] = _Range(key[0], b.low, b.high), before
                    elif b.low == b.high:  # many ties
                        fit = _fitting(before, b.low, int(b.n), total, share)
                        if fit:
                            out[key] = Cut(b.low, _nth(_rows(base, item, measures, [_Range(key[0], b.low, b.low)]), fit))
                    else:
                        narrower[key] = _Range(key[0], b.low, b.high), before
                    break
                before, out[key] = before + int(b.total), Cut(b.low - 1, "")  # the whole bin is within
        open_ = narrower
    if few:
        ranges = list(dict.fromkeys(r for r, _ in few.values()))
        items: dict[_Range, list] = {r: [] for r in ranges}
        for r in _rows(base, item, measures, ranges).collect():
            items[ranges[r.i]].append((-r.value, r.item))
        for key, (range_, before) in few.items():
            for negative, name in sorted(items[range_]):
                before -= negative
                if before / measures[key[0]].total > key[1]:
                    break
                out[key] = Cut(-negative, name)
    return out


def _fitting(before: int, value: int, n: int, total: int, share: float) -> int:
    """How many of n items of a value fit within the share."""
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if (before + mid * value) / total <= share else (low, mid - 1)
    return low


def _nth(ties: DataFrame, n: int) -> str:
    """The n-th item in order: items are counted by their first characters, and only the prefix that holds the n-th is looked into."""
    prefix = ""
    while True:
        own = ties.filter(F.col("item").startswith(prefix)) if prefix else ties
        counts = own.groupBy(F.substring("item", 1, len(prefix) + 1).alias("p")).count().orderBy("p").collect()  # characters that follow
        for r in counts:
            if n <= r["count"]:
                break
            n -= r["count"]
        if r["count"] <= ONE_BY_ONE or r.p == prefix:
            return sorted(x.item for x in own.filter(F.substring("item", 1, len(prefix) + 1) == r.p).select("item").collect())[n - 1]
        prefix = r.p


def tier(cuts_: list[Cut | None], names: tuple[str, ...], value: Column, item: Column) -> Column:
    """The name of an item's tier: the first whose cut it is within, else the last name."""
    found = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts_, names, strict=False))):
        found = F.when(cut.within(value, item), name).otherwise(found) if cut else found
    return found
